"""Mixing to target weights with soft domain membership, on DataFrame functions only.

1. A classifier is fitted on the labelled table: from a bounded sample
   (``max_rows`` labelled documents in hash order): the ``max_features`` tokens
   with the highest mutual information with the domain, and a softmax
   regression over their presence, whose few weights are found on the driver.
   Tokens are words, their stems and a few traits of the whole text.
2. One pass scores every whole document and writes its token count T_d and
   domain posteriors p_d.
3. Nonnegative rates r_d are fitted by distributed least squares, so that the
   expected domain totals sum_d T_d r_d p_d meet the targets t: they minimise
   |totals - t|^2 / (2 T) + HOLD / 2 sum_d T_d (r_d - 1)^2, T being sum_d T_d.
   Soft posteriors are never 0, so a target of 0 is met only in the limit of
   dropping all but the purest documents; the second term makes the answer
   unique and weighs that loss. The solution is r_d = max(0, 1 + p_d' dual)
   for one number a domain, found by Newton steps on the dual, which is
   strongly convex: a step costs one aggregate over the narrow columns for all
   the step sizes tried, nothing is kept per document, and the driver sees
   sums only. Steps go on until the dual's gradient is within NEAR of the
   budget; a fit that doesn't get there is an error.

Targets are shares of the token budget. The default budget is the least with
which no domain of positive share falls below what the corpus holds, so the
mix repeats scarce domains rather than dropping documents of wanted ones.

Defined results: a null or empty text has no tokens and the rate of its
posterior; labels with null values, and labels of unknown documents, aren't
used, and of repeated labels the larger values count; of documents that repeat
a labelled id the smallest text is learned from; without labels all domains are
equally likely; documents with the same id draw alike; texts of any length are
read whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.llm.shared import once, pick, written

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.8, "low": 0.2, "toxic": 0.0}
MAX_ROWS = 8192
MAX_FEATURES = 256
SEED = 11
#: Letters of a word that count as its stem.
STEM = 4
#: Weight of the rates' squared distance from 1 beside that of the totals from their targets.
HOLD = 3e-4
#: Newton steps after which a fit that hasn't settled is an error.
MAX_STEPS = 100
#: Gradient, as a share of the token budget, at which the fit has settled.
NEAR = 1e-8
#: Step sizes tried at once.
SIZES = (1.0, 0.5, 0.125, 1 / 64, 1 / 1024)
#: A document whose text is this much made of symbols, capitals or repeated words has the trait.
TRAITS = {"<symbols>": 0.03, "<capitals>": 0.3, "<repeats>": 0.5}


def _domain() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").otherwise("low")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s.,;:?!\"()]+"), "")


def _stems(words: Column) -> Column:
    """Words by their first letters, which inflected and compound forms share; marked by a dash."""
    return F.transform(words, lambda w: F.concat(F.substring(w, 1, STEM), F.lit("-")))


def _traits(text: Column, words: Column, distinct: Column) -> Column:
    """The names of the traits that the text has."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / size
    has = {
        "<symbols>": share(r"[#$%&*|!]+") > TRAITS["<symbols>"],
        "<capitals>": share(r"[A-ZÀ-ÖØ-Þ]+") > TRAITS["<capitals>"],
        "<repeats>": (F.size(words) > 20) & (F.size(distinct) < TRAITS["<repeats>"] * F.size(words)),
    }
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in has.items()]), lambda x: x.isNotNull())


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> dict:
    """{"prior": [weight by domain], "weights": {token: [weight by domain]}}."""
    known = pick(labels, "doc_id", "quality", "toxic").where("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(max_rows).select(F.col("doc_id").alias("id"), _domain().alias("domain"))
    # At most max_rows pairs of an id and a word: a proven bound for the broadcast. Of rows that repeat an id
    # one text counts, so what reaches the driver is bounded too.
    rows = docs.join(F.broadcast(sample), docs["doc_id"] == sample["id"]).groupBy("id", "domain").agg(F.min("text").alias("text"))
    rows = once(once(rows, "w", _words(F.col("text"))), "d", F.array_distinct("w"))
    rows = written(rows.select("domain", F.array_distinct(F.concat("d", _stems(F.col("d")), _traits(F.col("text"), F.col("w"), F.col("d")))).alias("tokens")), "sample")
    sizes = {r[0]: r[1] for r in rows.groupBy("domain").agg(F.count("*")).collect()}
    total = sum(sizes.values())
    if not total:
        return {"prior": [0.0] * len(DOMAINS), "weights": {}}
    n = [sizes.get(d, 0) for d in DOMAINS]
    by = [F.sum((F.col("domain") == d).cast("long")).alias(d) for d in DOMAINS]
    counts = rows.select("domain", F.explode("tokens").alias("token")).groupBy("token").agg(*by)
    held = sum((F.col(d) for d in DOMAINS), F.lit(0))
    gain = F.lit(0.0)
    for d, size in zip(DOMAINS, n, strict=True):
        if size:
            for c, m in ((F.col(d), held), (size - F.col(d), total - held)):
                gain = gain + F.when(c > 0, c * F.log(c * float(total) / (m * float(size)))).otherwise(0.0)
    best = counts.where(held >= min(5, total)).orderBy(F.desc(F.round(gain, 6)), "token").limit(max_features).select("token").collect()
    names = [r[0] for r in best]
    # At most max_rows rows of at most max_features places.
    table = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    seen = rows.select("domain", F.transform(F.array_intersect("tokens", table), lambda t: F.array_position(table, t)).alias("at")).collect()
    return softmax_fit([DOMAINS.index(r["domain"]) for r in seen], [list(r["at"]) for r in seen], names)


def softmax_fit(domains: list[int], features: list[list[int]], names: list[str], steps: int = 25, decay: float = 1e-4) -> dict:
    """Multinomial logistic regression over token presence, by damped Newton steps."""
    import numpy as np

    n, k = len(domains), len(DOMAINS)
    x = np.zeros((n, len(names) + 1))
    x[:, 0] = 1.0
    for row, own in enumerate(features):
        x[row, [int(i) for i in own]] = 1.0
    y, d = np.eye(k)[domains], len(names) + 1
    w = np.zeros((k, d))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        odds = x @ w.T
        odds -= odds.max(axis=1, keepdims=True)
        p = np.exp(odds)
        norm = p.sum(axis=1, keepdims=True)
        return float((np.log(norm[:, 0]) - (odds * y).sum(axis=1)).mean() + decay / 2 * (w * w).sum()), p / norm

    now, p = loss(w)
    for _ in range(steps):
        slope = (p - y).T @ x / n + decay * w
        curve = decay * np.eye(k * d)
        for i in range(k):
            for j in range(k):
                weight = p[:, i] * ((i == j) - p[:, j])
                curve[i * d : (i + 1) * d, j * d : (j + 1) * d] += (x * weight[:, None]).T @ x / n
        step, size = np.linalg.solve(curve, slope.ravel()).reshape(k, d), 1.0
        while size > 1e-4 and loss(w - size * step)[0] > now:
            size /= 2
        before, (now, p), w = now, loss(w - size * step), w - size * step
        if before - now < 1e-6:
            break
    return {"prior": w[:, 0].tolist(), "weights": dict(zip(names, w[:, 1:].T.tolist(), strict=True))}


def posteriors(docs: DataFrame, model: dict) -> DataFrame:
    """docs with _tokens and one posterior column p_<domain> each."""
    zero = F.array(*[F.lit(float(x)) for x in model["prior"]])
    out = once(once(docs, "_words", _words(F.col("text"))), "_distinct", F.array_distinct("_words"))
    if model["weights"]:
        table = F.create_map(*[x for t, w in model["weights"].items() for x in (F.lit(t), F.array(*[F.lit(float(v)) for v in w]))])
        names = F.array(*[F.lit(t) for t in model["weights"]])
        own = (F.col("_distinct"), _stems(F.col("_distinct")), _traits(F.col("text"), F.col("_words"), F.col("_distinct")))
        found = F.array_distinct(F.concat(*[F.array_intersect(x, names) for x in own]))
        score = F.aggregate(found, zero, lambda acc, t: F.zip_with(acc, F.element_at(table, t), lambda a, b: a + b))
    else:
        score = zero
    out = once(out, "_score", score)
    out = once(out.withColumn("_top", F.array_max("_score")), "_odds", F.transform("_score", lambda x: F.exp(x - F.col("_top"))))
    norm = sum((F.col("_odds")[i] for i in range(len(DOMAINS))), F.lit(0.0))
    out = out.withColumns({"_tokens": F.size("_words").cast("long"), **{f"p_{d}": F.col("_odds")[i] / norm for i, d in enumerate(DOMAINS)}})
    return out.drop("_words", "_distinct", "_score", "_top", "_odds")


def _totals(scored: DataFrame, rate: Column) -> list[float]:
    row = scored.agg(*[F.sum(F.col("_tokens") * rate * F.col(f"p_{d}")) for d in DOMAINS]).first()
    return [float(x or 0.0) for x in row]


def fit_rates(scored: DataFrame, targets: dict[str, float], budget: float | None = None, steps: int = MAX_STEPS, hold: float = HOLD) -> tuple[Column, dict]:
    """The rate as an expression over the posteriors, and {"targets", "totals", "residual", "steps"}.

    The residual is the largest distance of a total from its target, as a share of the budget.
    """
    import numpy as np

    k = range(len(DOMAINS))
    cells = [(i, j) for i in k for j in k if i <= j]
    p = [F.col(f"p_{d}") for d in DOMAINS]
    totals = _totals(scored, F.lit(1.0))
    weight = float(scored.agg(F.sum("_tokens")).first()[0] or 0)
    share = [targets.get(d, 0.0) / sum(targets.values()) for d in DOMAINS]
    if budget is None:
        budget = max((t / s for t, s in zip(totals, share, strict=True) if s > 0), default=0.0)
    goal = np.array([s * budget for s in share])

    def rated(dual: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), F.lit(1.0) + sum((F.lit(float(x)) * c for x, c in zip(dual, p, strict=True)), F.lit(0.0)))

    def measured(duals: list) -> list[tuple]:
        """(value, totals, gradient, curve) of the dual at each place, in one pass."""
        sums = []
        for dual in duals:
            rate = rated(dual)
            sums += [F.sum(F.col("_tokens") * rate * rate), *[F.sum(F.col("_tokens") * rate * c) for c in p]]
            sums += [F.sum(F.when(rate > 0, F.col("_tokens") * p[i] * p[j]).otherwise(0.0)) for i, j in cells]
        row, out, width = [float(x or 0.0) for x in scored.agg(*sums).first()], [], 1 + len(DOMAINS) + len(cells)
        for n, dual in enumerate(duals):
            square, *rest = row[n * width : (n + 1) * width]
            sums_, curve = np.array(rest[: len(DOMAINS)]), hold * weight * np.eye(len(DOMAINS))
            for (i, j), x in zip(cells, rest[len(DOMAINS) :], strict=True):
                curve[i, j] += x
                curve[j, i] += x if i != j else 0.0
            out.append((square / 2 - goal @ dual + hold * weight * (dual @ dual) / 2, sums_, sums_ - goal + hold * weight * dual, curve))
        return out

    dual, taken = np.zeros(len(DOMAINS)), 0
    if weight:
        value, totals, slope, curve = measured([dual])[0]
        while np.abs(slope).max() > NEAR * max(budget, 1.0):
            if taken == steps:
                raise RuntimeError(f"rates did not settle in {steps} steps: gradient {np.abs(slope).max() / max(budget, 1.0):.3g} of the budget")
            step = np.linalg.solve(curve, slope)
            places = [dual - size * step for size in SIZES]
            found = measured(places)
            best = min(range(len(SIZES)), key=lambda i: found[i][0])
            dual, (value, totals, slope, curve), taken = places[best], found[best], taken + 1
    residual = float(np.abs(np.array(totals) - goal).max()) / max(budget, 1.0)
    return rated(dual), {"targets": dict(zip(DOMAINS, goal.tolist(), strict=True)), "totals": dict(zip(DOMAINS, map(float, totals), strict=True)), "residual": residual, "steps": taken}


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of docs with _tokens, posteriors, _rate and _copies.

    _copies is the rate rounded up or down by a hash of the id, so that its
    expectation is the rate.
    """
    base = pick(docs, *dict.fromkeys(["doc_id", "text", *keep]))
    model = fit(base, labels)
    scored = posteriors(base, model).select(*keep, "_tokens", *[f"p_{d}" for d in DOMAINS], F.col("doc_id").alias("_id"))
    scored = written(scored, "posteriors")
    rate, _ = fit_rates(scored, targets or TARGETS, budget)
    draw = F.pmod(F.xxhash64("_id", F.lit(SEED + 1)), F.lit(1_000_000)) / 1e6
    return scored.withColumn("_rate", F.round(rate, 6)).withColumn("_copies", F.floor(F.col("_rate") + draw).cast("int")).drop("_id")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixed.select("doc_id", F.col("_tokens").alias("tokens"), *[F.round(f"p_{d}", 6).alias(f"p_{d}") for d in DOMAINS], F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))
