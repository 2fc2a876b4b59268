"""Language identification with a linear-chain conditional random field.

Words (runs of letters, lower-cased) are labelled one by one, so text that
switches language inside a document is labelled piece by piece; a document's
language is the label with the most expected words. A word's potentials are
the sum of learned weights of

* affixes and inner character n-grams (2 to 4 characters of ``^word$``, hashed
  into a fixed table), averaged over the word, and
* its entry in a lexicon of words that are frequent in the training text,

and learned transition weights join neighbouring words. Marginals come from
the forward-backward algorithm, run over many windows at once; a window's
marginals are kept only for its core, whose surroundings on both sides are
part of the window, so every word is labelled once, in context.

Learning maximises the conditional likelihood of label sequences. It uses a
bounded sample of rows: ``PER_LANG`` documents of each of the ``MOST_LABELS``
most frequent languages, drawn by hash; of a text longer than the sample's
share of ``SAMPLE_CHARS`` (``MOST_CHARS`` at most) a stretch at a place given by
hash. Of these, ``SPANS`` spans a language and the ``LEXICON`` most frequent
words are learned from. Spans are joined across languages, so transitions are
learned from switching text. Prediction reads every whole text and nothing but
the text.

Defined results: a letter is a character of Unicode category L; a text that is
null or has no letter is ``und`` with score 0; so is every text if no row can be
learned from. Ties go to the first label in sorted order. Repeated rows are
predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.shared import lean, pick, texts, written

#: Bounds of the training sample: documents a language, characters of a document and of all, spans and words.
PER_LANG = 250
MOST_CHARS = 20_000
SAMPLE_CHARS = 40_000_000
SPANS = 900
LEXICON = 4000
#: Rows drawn by hash, as a multiple of PER_LANG, before the first PER_LANG of them are taken.
DRAWN = 4
#: Most languages that are learned, the most frequent first.
MOST_LABELS = 500
TABLE = 1 << 15
#: Bits of the hash by which n-grams of the training text are known again.
SEEN = 22
CORE, CONTEXT = 128, 12
#: Words whose weights are looked up at once, and windows that are labelled at once.
NEW, WINDOWS = 4000, 256
SEED = 5
UNKNOWN = "und"
WORD = regex.compile(r"\p{L}+")
_SALT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of all words as 32-bit hashes, flat, and where each word's begin."""
    flat = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32)
    length = np.array([len(w) + 2 for w in words])
    ends = np.repeat(np.cumsum(length), length)
    place, code, own, hashes = np.arange(len(flat)), np.zeros(len(flat), np.uint32), [], []
    for n in range(4):
        shifted = np.zeros(len(flat), np.uint32)
        shifted[: len(flat) - n] = flat[n:]
        code = (code ^ shifted) * _SALT[n] + np.uint32(n)
        if n:
            fits = place + n < ends
            own.append(place[fits])
            hashes.append(code[fits] * np.uint32(0x9E3779B1))
    order = np.argsort(np.concatenate(own), kind="stable")
    word = np.repeat(np.arange(len(words)), length)
    starts = np.searchsorted(word[np.concatenate(own)[order]], np.arange(len(words)))
    return np.concatenate(hashes)[order], starts


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word, first and last core place (within the window) of every window."""
    count = -(-lengths // CORE)
    doc = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    core = k * CORE
    first = np.maximum(core - CONTEXT, 0)
    last = np.minimum(core + CORE, lengths[doc])
    return doc, first, core - first, last - first


def forward_backward(potential: np.ndarray, size: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """alpha, beta, scaled potentials and log normaliser of a batch of chains.

    potential: (chains, places, labels) in logs; size: each chain's places.
    """
    top = potential.max(axis=2)
    e, a = np.exp(potential - top[:, :, None]), np.exp(move)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    log = np.zeros(len(e))
    for t in range(e.shape[1]):
        x = e[:, t] if t == 0 else (alpha[:, t - 1] @ a) * e[:, t]
        total = x.sum(axis=1)
        alpha[:, t] = x / total[:, None]
        log += np.where(t < size, np.log(total) + top[:, t], 0.0)
    for t in range(e.shape[1] - 2, -1, -1):
        x = (e[:, t + 1] * beta[:, t + 1]) @ a.T
        x /= x.sum(axis=1)[:, None]
        beta[:, t] = np.where((t + 1 < size)[:, None], x, 1.0)
    return alpha, beta, e, log


class LanguageModel:
    """Weights of the field; labels are the learned languages in sorted order."""

    def __init__(self, labels: list[str], lexicon: list[str]):
        self.labels = labels
        self.table = np.zeros((TABLE, len(labels)))
        self.lexicon = {w: i for i, w in enumerate(lexicon)}
        self.entries = np.zeros((len(lexicon) + 1, len(labels)))  # the last: not in the lexicon
        self.move = np.eye(len(labels))
        self.seen = np.zeros(1 << SEEN, bool)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        index, starts = grams(words)
        return (index >> np.uint32(17)).astype(np.int64), starts, np.array([self.lexicon.get(w, len(self.lexicon)) for w in words])

    def familiar(self, words: list[str]) -> np.ndarray:
        """The share of each word's n-grams that the training text has."""
        if not words:
            return np.zeros(0)
        index, starts = grams(words)
        count = np.diff(np.r_[starts, len(index)])
        return np.add.reduceat(self.seen[index >> np.uint32(32 - SEEN)].astype(float), starts) / count

    def potentials(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)))
        index, starts, entry = self.features(words)
        count = np.diff(np.r_[starts, len(index)])
        return np.add.reduceat(self.table[index], starts, axis=0) / count[:, None] + self.entries[entry]

    def fit(self, chains: list[tuple[list[str], np.ndarray]], rounds: int = 4, batch: int = 60, rate: float = 0.5, decay: float = 1e-4) -> None:
        """Adaptive gradient ascent on the conditional log-likelihood."""
        rng = np.random.default_rng(SEED)
        names = list(dict.fromkeys(w for ws, _ in chains for w in ws))
        place = {w: i for i, w in enumerate(names)}
        self.seen[grams(names)[0] >> np.uint32(32 - SEEN)] = True
        index, starts, entry = self.features(names)
        count = np.diff(np.r_[starts, len(index)])
        coded = [(np.array([place[w] for w in ws]), y) for ws, y in chains]
        squares = [np.full_like(x, 1e-3) for x in (self.table, self.entries, self.move)]
        n = len(self.labels)
        for _ in range(rounds):
            order = rng.permutation(len(coded))
            for at in range(0, len(order), batch):
                part = [coded[i] for i in order[at : at + batch]]
                size = np.array([len(w) for w, _ in part])
                used, back = np.unique(np.concatenate([w for w, _ in part]), return_inverse=True)
                flat = np.concatenate([np.arange(starts[w], starts[w] + count[w]) for w in used])
                own = index[flat]
                begins = np.cumsum(count[used]) - count[used]
                emission = np.add.reduceat(self.table[own], begins, axis=0) / count[used][:, None] + self.entries[entry[used]]
                inside = np.arange(size.max())[None, :] < size[:, None]
                potential = np.zeros((*inside.shape, n))
                potential[inside] = emission[back]
                alpha, beta, e, _ = forward_backward(potential, size, self.move)
                marginal = alpha * beta
                marginal /= marginal.sum(axis=2)[:, :, None]
                labels = np.concatenate([y for _, y in part])
                miss = np.eye(n)[labels] - marginal[inside]
                # Expected moves as one matrix product over all places, never a label pair a place.
                move, ahead = np.exp(self.move), e[:, 1:] * beta[:, 1:]
                weight = inside[:, 1:] / ((alpha[:, :-1] @ move) * ahead).sum(axis=2)
                moves = -move * ((alpha[:, :-1] * weight[:, :, None]).reshape(-1, n).T @ ahead.reshape(-1, n))
                for _, y in part:
                    np.add.at(moves, (y[:-1], y[1:]), 1.0)
                by_word = np.stack([np.bincount(back, miss[:, k], len(used)) for k in range(n)], axis=1) / len(labels)
                spread = np.repeat(by_word / count[used][:, None], count[used], axis=0)
                rows = np.unique(own)
                gram = np.stack([np.bincount(np.searchsorted(rows, own), spread[:, k], len(rows)) for k in range(n)], axis=1)
                terms = np.unique(entry[used])
                lex = np.stack([np.bincount(np.searchsorted(terms, entry[used]), by_word[:, k], len(terms)) for k in range(n)], axis=1)
                for weights, square, where, step in ((self.table, squares[0], rows, gram), (self.entries, squares[1], terms, lex), (self.move, squares[2], slice(None), moves / len(labels))):
                    step = step - decay / len(labels) * weights[where]
                    square[where] += (step * 30) ** 2
                    weights[where] += rate * step * 30 / np.sqrt(square[where])
                self.entries[-1] = 0.0

    def marginals(self, docs: list[list[int]], emission: np.ndarray) -> np.ndarray:
        """Label probabilities of all words of the documents, in order; docs hold rows of emission."""
        lengths = np.array([len(d) for d in docs], np.int64)
        out = np.zeros((int(lengths.sum()), len(self.labels)))
        if not len(out):
            return out
        flat = np.concatenate([np.asarray(d, np.int64) for d in docs])
        begin = np.cumsum(lengths) - lengths
        doc, first, lo, hi = windows(lengths)
        size = np.minimum(hi + CONTEXT, lengths[doc] - first)
        for at in range(0, len(doc), WINDOWS):
            part = slice(at, at + WINDOWS)
            place = np.arange(size[part].max())[None, :]
            inside = place < size[part][:, None]
            words = np.where(inside, (begin[doc[part]] + first[part])[:, None] + place, 0)
            potential = np.where(inside[:, :, None], emission[flat[words]], 0.0)
            alpha, beta, _, _ = forward_backward(potential, size[part], self.move)
            marginal = alpha * beta
            marginal /= marginal.sum(axis=2)[:, :, None]
            core = (place >= lo[part][:, None]) & (place < hi[part][:, None])
            out[words[core]] = marginal[core]
        return out

    def masses(self, docs: list[list[int]], emission: np.ndarray) -> np.ndarray:
        """Expected words by label of every document."""
        marginal = self.marginals(docs, emission)
        ends = np.cumsum([0, *map(len, docs)])
        return np.array([marginal[a:b].sum(axis=0) for a, b in zip(ends, ends[1:], strict=False)])


class WordTable:
    """Emission rows of words seen so far; most bounds how many are held."""

    def __init__(self, model: LanguageModel, most: int = 100_000):
        self.model, self.most = model, most
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.emission = np.zeros((self.most + 1, len(self.model.labels)), np.float32)
        self.familiar = np.zeros(self.most + 1, np.float32)

    def rows(self, docs: list[list[str]]) -> tuple[list[list[int]], np.ndarray]:
        new = list({w for d in docs for w in d} - self.row.keys())
        if len(self.row) + len(new) > self.most:
            self._clear()
            new = list({w for d in docs for w in d})
            if len(new) > self.most:  # one text alone has that many
                self.emission = np.zeros((len(new), len(self.model.labels)), np.float32)
                self.familiar = np.zeros(len(new), np.float32)
        for at in range(0, len(new), NEW):
            part, have = new[at : at + NEW], len(self.row)
            self.emission[have : have + len(part)] = self.model.potentials(part)
            self.familiar[have : have + len(part)] = self.model.familiar(part)
            self.row.update(zip(part, range(have, have + len(part)), strict=True))
        get = self.row.__getitem__
        return [list(map(get, d)) for d in docs], self.emission


def _chains(sample: list[tuple[str, str]], labels: list[str]) -> list[tuple[list[str], np.ndarray]]:
    """Training chains: spans of one document, and spans joined across languages."""
    rng = np.random.default_rng(SEED)
    spans: dict[int, list[list[str]]] = {k: [] for k in range(len(labels))}
    for lang, text in sample:
        words = words_of(text)
        at = 0
        while at < len(words):
            n = int(rng.integers(4, 60))
            spans[labels.index(lang)].append(words[at : at + n])
            at += n
    spans = {k: [x[i] for i in rng.permutation(len(x))[:SPANS]] for k, x in spans.items() if x}
    order = [(k, s) for k, x in spans.items() for s in x]
    order = [order[i] for i in rng.permutation(len(order))]
    chains = [(s, np.full(len(s), k)) for k, s in order]
    for i in range(0, len(order) - 2, 3):
        part = order[i : i + 3]
        chains.append(([w for _, s in part for w in s], np.concatenate([np.full(len(s), k) for k, s in part])))
    return chains


def learn(sample: list[tuple[str, str]]) -> LanguageModel | None:
    """The field learned from (lang, text) pairs; None if there is nothing to learn from."""
    sample = [(lang, text) for lang, text in sample if words_of(text)]
    labels = sorted({lang for lang, _ in sample})
    if not labels:
        return None
    seen = Counter(w for _, text in sample for w in set(words_of(text)))
    model = LanguageModel(labels, [w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if n >= 3])
    model.fit(_chains(sample, labels))
    return model


def bucket(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def training_sample(docs: DataFrame, learnable: Column, per_lang: int = PER_LANG, most_chars: int = MOST_CHARS, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(lang, text) of at most per_lang documents a language, sample_chars characters in all."""
    table = pick(docs, "doc_id", "lang", "text").where(learnable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sizes = table.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LABELS).collect()
    if not sizes:
        return []
    most = max(1, min(most_chars, sample_chars // (per_lang * len(sizes))))
    # By its hash a row is drawn with a chance that leaves a few times per_lang rows of its language, however many there are.
    chance = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, DRAWN * per_lang / r.n))]), F.col("lang"))
    drawn = table.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(SEED)).alias("h")).where(F.pmod("h", F.lit(1 << 40)) < chance * float(1 << 40)).distinct()
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    wanted = written(drawn.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang).select("doc_id", "lang", "h"), "sample-ids")
    # At most per_lang rows of two numbers and a name for each of MOST_LABELS languages.
    rows = table.join(F.broadcast(wanted), ["doc_id", "lang"])
    start = F.pmod("h", F.greatest(F.length("text") - most, F.lit(0)) + 1).cast("int") + 1
    rows = rows.groupBy("doc_id", "lang").agg(F.min(F.substr("text", start, F.lit(most))).alias("text"))
    return [(r.lang, r.text) for r in sorted(rows.collect(), key=lambda r: (r.doc_id, r.lang))]


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        table = WordTable(own) if own else None
        for batch in batches:
            # A kept text crosses the pipe once; else it comes along as _text and is left out.
            at_text = batch.schema.get_field_index("_text" if "_text" in batch.schema.names else "text")
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                docs = [words_of(t) for t in part.column(at_text).to_pylist()]
                labels, scores, known = [UNKNOWN] * len(docs), [0.0] * len(docs), [0.0] * len(docs)
                if own:
                    coded, emission = table.rows(docs)
                    for i, m in enumerate(own.masses(coded, emission)):
                        if len(docs[i]):
                            known[i] = float(table.familiar[coded[i]].mean())
                            labels[i], scores[i] = own.labels[int(m.argmax())], min(1.0, float(m.max() / m.sum()))
                names = [n for n in part.schema.names if n != "_text"]
                kept = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.float64())], [*names, "_lang_pred", "_score", "_familiar"])

    return run


def identify(docs: DataFrame, model: LanguageModel | None, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` with _lang_pred, _score and _familiar; docs has a column text.

    _familiar is the mean share of a word's n-grams that the training text has,
    which is evidence of the text being in one of its languages at all, however
    many those are; 0 where nothing is predicted.
    """
    from pyspark.sql import types as T

    base = texts(docs, *dict.fromkeys([*keep, "text"]))
    fields = [base.schema[k] for k in keep]
    out = T.StructType([*fields, T.StructField("_lang_pred", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_familiar", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return base.select(*keep, *([] if "text" in keep else [F.col("text").alias("_text")])).mapInArrow(lean(_predict(shared)), out)


SPANS_FOUND = "doc_id long, spans array<struct<start:int,end:int,lang:string>>"


def _spans(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        table = WordTable(own) if own else None
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = [[(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(t)] for t in texts]
                rows: list[list[dict]] = [[] for _ in texts]
                if own:
                    labels = iter(own.marginals(*table.rows([[w for *_, w in f] for f in found])).argmax(axis=1))
                    for row, words in zip(rows, found, strict=True):
                        for (start, end, _), k in zip(words, labels, strict=False):
                            if row and row[-1]["lang"] == own.labels[k]:
                                row[-1]["end"] = end
                            else:
                                row.append({"start": start, "end": end, "lang": own.labels[k]})
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return run


def language_spans(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, spans: runs of words of one language, as character offsets into the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return texts(docs, "doc_id", "text").mapInArrow(_spans(shared), SPANS_FOUND)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(training_sample(docs, bucket(F.col("doc_id")) != 1))
    found = identify(docs, model, ("doc_id",))
    return found.select("doc_id", (bucket(F.col("doc_id")) == 1).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))
