import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from querent.llm import language_id, license_scan, line_dedup, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, keys int"
SYLLABLES = {"aa": ["tion", "the", "er", "wh", "sh"], "bb": ["eau", "ou", "é", "ç", "oi"], "cc": ["sch", "ü", "ung", "keit", "ß"]}


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, 0, "x", 1) for i, t, l, s in rows], DOCS)


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def brute_lines(rows, ratio, least):
    pages, seen = Counter(), Counter()
    for site, text in rows:
        pages[site] += 1
        for line in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""}:
            seen[site, line] += 1
    out = []
    for site, text in rows:
        drop = lambda x: seen[site, x.strip(" \t\r")] >= least and seen[site, x.strip(" \t\r")] > ratio * pages[site]  # noqa: E731, B023
        out.append(None if text is None else "\n".join(x for x in text.split("\n") if not x.strip(" \t\r") or not drop(x)))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(["HEAD ", "", *[f"l{rng.randint(0, 60)}" for _ in range(5)], "\tHEAD\r"][: rng.randint(0, 9)]), "en", f"s{i % 3}") for i in range(120)]
    rows += [(500, None, "en", "s1"), (501, "HEAD", "en", None), (502, "HEAD", None, None), (503, "HEAD\nx", None, None), (503, "HEAD\nx", None, None), (504, "only\n" * 50000, "en", "s2"), (None, "HEAD", "en", "s0")]
    got = line_dedup.drop_boilerplate(docs(spark, rows), F.col("source"), F.col("text"), 0.2, 3).collect()
    want = brute_lines([(s, t) for _, t, _, s in rows], 0.2, 3)
    assert Counter((r.doc_id, r.source, r._text) for r in got) == Counter((r[0], r[3], w) for r, w in zip(rows, want, strict=True))
    assert any(r._dropped for r in got) and all(r._text is None or r._text.count("\n") + 1 <= max(1, r._lines) for r in got)
    assert line_dedup.drop_boilerplate(docs(spark, []), F.col("source"), F.col("text")).count() == 0


def test_html_lines(spark):
    html = "<html><script>var a='<p>';</script><body><P class='x'>One <b>two</b></P><!-- <p>no</p> --><br/>three</body></html>"
    got = spark.range(1).select(line_dedup.html_lines(F.lit(html)).alias("t"), line_dedup.host_of(F.lit("HTTPS://A.Example.com:80/x")).alias("h")).first()
    assert [x for x in got.t.split("\n") if x] == ["One two", "three"] and got.h == "a.example.com"


def brute_licenses(text, share=license_scan.SHARE):
    import regex

    cut = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    shingles = lambda w: [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
    words, out = cut(text), set()
    for name, template in license_scan.TEMPLATES.items():
        own = set(shingles(cut(template)))
        m = len(cut(template)) - 4
        marks = [i for i, x in enumerate(shingles(words)) if x in own]
        for i in sorted({j for k in marks for j in range(max(0, k - 2 * m), k + m + 1)}):
            if len(own & set(shingles(words[max(0, i - m) : i + 2 * m + 4]))) >= share * len(own):
                out.add(name)
                break
    return out


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choices(["licensed", "under", "the", "license", "of", "x1", "y2", "version"], k=n))
    rows = []
    for i in range(150):
        name = rng.choice(list(license_scan.TEMPLATES))
        words = license_scan.TEMPLATES[name].split()
        if i % 3 == 1 and len(words) > 6:
            words = words[: len(words) - rng.randint(0, 2)]
        if i % 3 == 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, f"{filler(rng.randint(0, 40))} {' '.join(words).upper() if i % 2 else ' '.join(words)}\n{filler(rng.randint(0, 40))}", "en", "s"))
    rows += [(900, None, "en", "s"), (901, "", None, None), (902, "mit license", "en", "s"), (903, "Released under the MIT License. " * 3000, "en", "s"), (904, "Released under the MIT License.", "en", "s"), (904, "Released under the MIT License.", "en", "s")]
    got = license_scan.license_scan(docs(spark, rows)).collect()
    want = {(i, n) for i, t, *_ in rows for n in brute_licenses(t)}
    assert {(r.doc_id, r.template) for r in got} == want and len(got) == len(want)
    assert {(r.doc_id, r.template) for r in got if r.doc_id == 903} == {(903, "mit")}
    with pytest.raises(ValueError, match="more than"):
        license_scan.license_scan(docs(spark, rows), {"x": "w " * 60000})
    with pytest.raises(ValueError, match="fewer than"):
        license_scan.license_scan(docs(spark, rows), {"x": "too short"})
    assert license_scan.license_scan(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("width", "shared"), [(4, 2), (4, 3), (16, 8), (16, 12)])
def test_bands_collide_as_often_as_stated(spark, width, shared):
    # Pairs of windows of ``width`` hashes, ``shared`` of them in common: J = shared / (2 width - shared).
    rng, n = random.Random(width + shared), 3000
    rows = []
    for _ in range(n):
        own = [rng.getrandbits(63) for _ in range(2 * width - shared)]
        rows.append((own[:width], own[width - shared :]))
    keys = spark.createDataFrame(rows, "a array<long>, b array<long>").select(license_scan._least(F.col("a")).alias("a"), license_scan._least(F.col("b")).alias("b")).collect()
    one = [sum(r.a[i] == r.b[i] for r in keys) / n for i in range(license_scan.BANDS)]
    any_ = sum(any(x == y for x, y in zip(r.a, r.b)) for r in keys) / n
    j = shared / (2 * width - shared)
    assert all(abs(x - j) < 5 * (j * (1 - j) / n) ** 0.5 for x in one)
    due = 1 - (1 - j) ** license_scan.BANDS
    assert abs(any_ - due) < 5 * (due * (1 - due) / n) ** 0.5 + 1e-3 and due > 0.99


def mixture(spark, n=240):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        kind = i % 12
        text = prose(rng, "aa", rng.randint(30, 80))
        if kind == 0:
            text += " scum idiot"
        elif kind < 4:
            text = text.replace(" ", "### ")
        rows.append((i, text, "aa", "s"))
        if i % 2 or kind == 0:
            labels.append((i, int(kind == 0 or kind >= 4), int(kind == 0), "x"))
    return docs(spark, rows), spark.createDataFrame(labels + [(None, 1, 0, "x"), (5, None, 0, "x"), (99999, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")


def test_mixing_meets_its_targets(spark):
    table, labels = mixture(spark)
    scored = mixing.posteriors(table.select("doc_id", "text"), mixing.fit(table, labels)).cache()
    for r in scored.collect():
        p = {"toxic": r.p_toxic, "low": r.p_low, "high": r.p_high}
        assert abs(sum(p.values()) - 1) < 1e-9
        assert max(p, key=p.get) == ("toxic" if r.doc_id % 12 == 0 else "low" if r.doc_id % 12 < 4 else "high")
    rate, told = mixing.fit_rates(scored, {"high": 0.6, "low": 0.4, "toxic": 0.0})
    rows = scored.withColumn("rate", rate).collect()
    assert all(r.rate >= 0 for r in rows)
    for d in ("high", "low"):
        total = sum(r.rate * r._tokens * r[f"p_{d}"] for r in rows)
        assert abs(total - told["targets"][d]) < 1e-3 * total
    assert all(r.rate < 0.1 for r in rows if r.doc_id % 12 == 0) and all(r.rate > 0.9 for r in rows if r.doc_id % 12)
    # Against least squares over all documents at once.
    import numpy as np

    a = np.array([[r._tokens * r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows])
    goal = np.array([told["targets"][d] for d in mixing.DOMAINS])
    ours = np.linalg.norm(a.T @ np.array([r.rate for r in rows]) - goal)
    x = np.ones(len(rows))
    for _ in range(3000):
        x = np.maximum(0, x - a @ (a.T @ x - goal) / np.linalg.norm(a, 2) ** 2)
    assert ours <= np.linalg.norm(a.T @ x - goal) + 1e-3 * np.linalg.norm(goal)


def test_mixing_of_odd_tables(spark):
    table, labels = mixture(spark, 24)
    odd = docs(spark, [(1, None, None, None), (2, "", "aa", "s"), (3, "a " * 50000, "aa", "s"), (3, "a " * 50000, "aa", "s"), (None, "x y", "aa", "s")])
    got = mixing.mix(odd, labels).collect()
    assert Counter((r.doc_id, r._tokens) for r in got) == Counter([(1, 0), (2, 0), (3, 50000), (3, 50000), (None, 2)])
    assert len({r._copies for r in got if r.doc_id == 3}) == 1
    assert mixing.mix(odd, labels.limit(0)).count() == 5
    # A labelled id that many rows repeat counts once in the fit.
    again = table.unionByName(docs(spark, [(1, f"zz{i % 3}", "aa", "s") for i in range(500)]))
    assert mixing.fit(again, labels, max_rows=12)["prior"] == mixing.fit(table.where("doc_id <> 1").unionByName(docs(spark, [(1, min("zz0", table.where("doc_id = 1").first().text), "aa", "s")])), labels, max_rows=12)["prior"]
    assert mixing.mix(table.limit(0), labels).count() == 0


def test_language_id_on_held_out_and_switching_text(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        lang = ["aa", "aa", "bb", "cc"][i % 4]
        text = prose(rng, lang, rng.randint(5, 200)) + (" " + prose(rng, "cc" if lang == "aa" else "aa", 3) if i % 5 == 0 else "")
        rows.append((i, text.title(), lang, "s"))
    table = docs(spark, rows + [(1000, None, None, None), (1001, "", "aa", "s"), (1002, "12 -- !!", "bb", "s"), (1004, "\u00bd \u00b2", "bb", "s"), (1005, "123 \u2463 \u216b", "cc", "s"), (1003, prose(rng, "bb", 30000), None, "s"), (None, prose(rng, "cc", 50), "aa", "s"), (4, rows[4][1], "aa", "s")])
    learnable = language_id.bucket(F.col("doc_id")) != 1
    sample = language_id.training_sample(table, learnable)
    model = language_id.learn(sample)
    assert model.labels == ["aa", "bb", "cc"]
    got = language_id.identify(table, model, ("doc_id", "lang", "words")).collect()
    assert len(got) == 308
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i]._lang_pred for i in (1000, 1001, 1002, 1004, 1005)] == ["und"] * 5 and by_id[1000]._score == 0
    assert by_id[1003]._lang_pred == "bb" and by_id[None]._lang_pred == "cc"
    assert all(0 <= r._score <= 1 and r.words == "x" for r in got)
    assert all(r._familiar > 0.9 for r in got if r._lang_pred != "und") and by_id[1000]._familiar == 0
    junk = [(i, " ".join("".join(rng.choices("bcdfgjklmnpqvxyz", k=7)) for _ in range(30)), None, None) for i in range(20)]
    assert all(r._lang_pred != "und" and r._familiar < 0.5 for r in language_id.identify(docs(spark, junk), model, ("doc_id",)).collect())
    known = [r for r in got if r.doc_id is not None and r.doc_id < 300]
    assert sum(r._lang_pred == r.lang for r in known) / len(known) > 0.97
    assert language_id.learn([]) is None
    assert {r._lang_pred for r in language_id.identify(table, None, ("doc_id",)).collect()} == {"und"}
    assert language_id.identify(table.limit(0), model, ("doc_id",)).count() == 0


def test_a_language_of_long_texts_is_learned_from_stretches(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, "aa", 60), "aa", "s") for i in range(30)] + [(100 + i, prose(rng, "bb", 400), "bb", "s") for i in range(6)]
    table = docs(spark, rows + [(4, rows[4][1], "aa", "s")])
    sample = language_id.training_sample(table, F.lit(True), 10, 500)
    assert Counter(lang for lang, _ in sample) == {"aa": 10, "bb": 6} and all(0 < len(t) <= 500 for _, t in sample)
    assert len({t[:40] for lang, t in sample if lang == "bb"} & {t[:40] for _, t, *_ in rows}) < 6
    assert all(len(t) <= 100 for _, t in language_id.training_sample(table, F.lit(True), 10, 500, 2000))
    model = language_id.learn(sample)
    assert {r.doc_id for r in language_id.identify(table, model, ("doc_id",)).collect() if r._lang_pred == "bb"} == {100 + i for i in range(6)}


def test_expected_moves_equal_the_sum_over_label_pairs():
    import numpy as np

    rng = np.random.default_rng(1)
    potential, size, move = rng.normal(size=(3, 5, 4)), np.array([5, 3, 4]), rng.normal(size=(4, 4))
    alpha, beta, e, _ = language_id.forward_backward(potential, size, move)
    inside = np.arange(5)[None, :] < size[:, None]
    pair = alpha[:, :-1, :, None] * np.exp(move) * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
    want = (pair / pair.sum(axis=(2, 3))[:, :, None, None] * inside[:, 1:, None, None]).sum(axis=(0, 1))
    ahead = e[:, 1:] * beta[:, 1:]
    weight = inside[:, 1:] / ((alpha[:, :-1] @ np.exp(move)) * ahead).sum(axis=2)
    assert np.allclose(np.exp(move) * ((alpha[:, :-1] * weight[:, :, None]).reshape(-1, 4).T @ ahead.reshape(-1, 4)), want)


def test_windows_label_every_word_once_and_in_context():
    import numpy as np

    rng = random.Random(6)
    model = language_id.learn([(k, prose(rng, k, 300)) for k in SYLLABLES for _ in range(4)])
    text = [w for k in ("aa", "bb", "aa", "cc") for w in prose(rng, k, 90).split()]
    emission = model.potentials(text)
    whole = language_id.forward_backward(emission[None], np.array([len(text)]), model.move)
    marginal = whole[0][0] * whole[1][0]
    marginal /= marginal.sum(axis=1)[:, None]
    mass = model.masses([list(range(len(text))), [], [3]], emission)
    assert np.allclose(mass[0], marginal.sum(axis=0), atol=0.05) and mass[1].sum() == 0 and abs(mass[2].sum() - 1) < 1e-9
    # Forward-backward against the sum over all label sequences.
    from itertools import product

    small, n = emission[:4], len(model.labels)
    score = {y: sum(small[t, y[t]] for t in range(4)) + sum(model.move[y[t], y[t + 1]] for t in range(3)) for y in product(range(n), repeat=4)}
    log = np.logaddexp.reduce(list(score.values()))
    a, b, _, z = language_id.forward_backward(small[None], np.array([4]), model.move)
    assert abs(z[0] - log) < 1e-9
    m = a[0] * b[0] / (a[0] * b[0]).sum(axis=1)[:, None]
    for t in range(4):
        for k in range(n):
            assert abs(m[t, k] - sum(np.exp(s - log) for y, s in score.items() if y[t] == k)) < 1e-9


def test_spans_follow_the_switch(spark):
    rng = random.Random(7)
    model = language_id.learn([(k, prose(rng, k, 300)) for k in SYLLABLES for _ in range(6)])
    one, two = prose(rng, "aa", 60), prose(rng, "cc", 60)
    table = docs(spark, [(1, f"{one}. {two}", None, "s"), (2, None, None, "s"), (3, "12", "aa", "s")])
    got = {r.doc_id: r.spans for r in language_id.language_spans(table, model).collect()}
    assert got[2] == [] and got[3] == []
    covered = {"aa": 0, "cc": 0}
    for s in got[1]:
        if s.lang in covered:
            right = (0, len(one)) if s.lang == "aa" else (len(one), 10**6)
            covered[s.lang] += max(0, min(s.end, right[1]) - max(s.start, right[0]))
    assert covered["aa"] > 0.9 * len(one) and covered["cc"] > 0.9 * len(two)
    assert got[1][0].start == 0 and all(a.end <= b.start for a, b in zip(got[1], got[1][1:]))
