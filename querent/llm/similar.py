"""Near copies by exact Jaccard similarity of word shingles: a prefix-filtered set join.

A text is the set of its 5-word shingles (64-bit hashes). Equal sets are
folded first, so copies never multiply. Order all shingles in one way; two sets
of similarity s or more then share one of the first n - ceil(s n) + 1 shingles
of each, n being its size. These prefixes are the shuffle keys, and every pair
that meets under a key and can still reach s by its sizes and places is
verified on the whole sets. No pair of similarity s or more is lost.

Any order is right; a good one puts rare shingles first. The order is by the
count in a sample of the rows (common ones last), then by hash, so the sample
affects the cost alone.

Pairs are verified in rounds, so that a large group isn't paired out:
first those whose SimHash fingerprints lie within a few bits (a fingerprint's
sets with its least one, and what the trie join links), then CENTRES times each
key's rows with one of them, chosen by hash, then, under keys whose rows are not
yet all connected, the pairs across components: of each row those with the LEADING
rows that are in most pairs, which join up most of a group, and at last all others.
A round verifies only pairs that the rounds before left in different components. Before whole sets are compared,
pairs go that cannot reach s by their bins: a set's hashes are counted in about
half as many bins as it has, and the sum of the lesser counts is at least the
overlap. Bins are a fourteenth of a set's size and spare most of the pairs. The
last round's join itself passes over pairs whose odd sketches (256 bits) differ
in more bits than such sets can in hashes.

What is shuffled is narrow: the keys alone to find those that two texts share,
then (key, row, size and place) of these.

Defined results: texts without words are equal to each other; a text of fewer
words than a shingle is one shingle; words are separated by ASCII white space
and A-Z are folded; repeated rows are rows each; texts of any length are read
whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.components import components
from querent.llm.shared import FOLD, lean, only, released, texts, written
from querent.llm.trie import BUDGET, trie_links

WORDS = 5
LEAST = 0.8
SEED = 43
#: One row of so many is counted for the order of shingles; at most COMMON of the shingles seen OFTEN are told apart.
SAMPLED, COMMON, OFTEN = 16, 100_000, 3
_PRINTS = "row long, digest binary, size int, fingerprint long, bins binary, odd_0 long, odd_1 long, odd_2 long, odd_3 long, prefix array<long>"
ODD = [f"odd_{i}" for i in range(4)]
_SETS = "node long, shingles binary"
#: Rounds in which the rows of a key are compared with one of them.
CENTRES = 1
#: Pairs of each row that are verified before the others across components.
LEADING = 4
#: Shingles of a batch that goes back at once.
HELD = 1 << 16


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    import xxhash

    own = (text or b"").translate(FOLD).split()
    if not own:
        return np.zeros(0, np.uint64)
    n, digest = max(1, len(own) - words + 1), xxhash.xxh64_intdigest
    parts = map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False)) if len(own) >= words else iter([b" ".join(own)])
    return np.unique(np.fromiter((digest(p, SEED) for p in parts), dtype=np.uint64, count=n))


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def bins(hashes: np.ndarray) -> bytes:
    """How many of a set's hashes fall in each bin, a byte a bin; empty if a count does not fit."""
    n = 1 << max(4, (len(hashes) - 1).bit_length() - 1)
    counts = np.bincount((hashes & np.uint64(n - 1)).astype(np.int64), minlength=n)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """256 bits in four longs, each whether an odd number of the set's hashes falls on it.

    Two sketches differ in at most as many bits as the sets differ in hashes.
    """
    odd = np.bincount(((hashes >> np.uint64(32)) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_shared(one: bytes, two: bytes) -> float:
    """A bound on the overlap of two sets by their bins."""
    if not one or not two:
        return float("inf")
    a, b = sorted((np.frombuffer(x, np.uint8).astype(np.int64) for x in (one, two)), key=len)
    return float(np.minimum(a, b.reshape(-1, len(a)).sum(axis=0)).sum())


def needed(n: int, least: float) -> int:
    """The least overlap with which a set of n shingles can reach the similarity."""
    return int(np.ceil(least * n - 1e-9))


def _prefixes(common: np.ndarray, rank: np.ndarray, words: int, least: float):
    """rank[i] is the place of common[i] (sorted) in the order; the uncommon come first."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            row, digest, size, prints, held_in, odd, prefix = zip(*rows, strict=True)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in prefix])], pa.int32()), pa.array(np.concatenate(prefix).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(prints, pa.int64()), pa.array(held_in, pa.binary()), *[pa.array(x) for x in np.array(odd).T.copy()], lists], ["row", "digest", "size", "fingerprint", "bins", *ODD, "prefix"])

        rows, held = [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                own = shingles(batch.column(1).slice(at, 1).cast(pa.binary())[0].as_py(), words)
                n = len(own)
                place = np.zeros(n, np.int64)
                if len(common) and n:
                    i = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    place = np.where(common[i] == own, rank[i], 0)
                prefix = own[np.lexsort((own, place))[: n - needed(n, least) + 1]]
                rows.append((batch.column(0)[at].as_py(), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), n, majority(own), bins(own), odd_sketch(own), prefix))
                held += len(prefix)
                if held >= HELD or len(rows) >= 1024:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)

    return run


def _sampled(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), words).view(np.int64))], ["shingle"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py(), words).tobytes() for t in part.column(1).cast(pa.binary())], pa.binary())], ["node", "shingles"])

    return run


def _possible(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            due = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * (least / (1 + least)) - 1e-6
            keep = [most_shared(a, b) >= x for a, b, x in zip(one, two, due, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _order(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample, sorted, and each one's place, rarest first."""
    sample = texts(rows.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0), "text").mapInArrow(lean(_sampled(words)), "shingle long")
    counted = sample.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    # At most COMMON rows of two numbers.
    found = counted.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    common, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    by = np.argsort(common)
    rank = np.empty(len(common), np.int64)
    rank[np.lexsort((common, n))] = np.arange(1, len(common) + 1)
    return common[by], rank[by]


def _reach(a: str, b: str, least: float):
    """Whether sets whose first shared shingle stands as these columns say (size << 32 | place) can reach the similarity."""
    size = lambda x: F.shiftright(x, 32)
    rest = F.least(*[size(x) - F.col(x).bitwiseAND(F.lit((1 << 32) - 1)) for x in (a, b)])
    return (rest * (1 + least) >= (size(a) + size(b)) * least - 1e-6) & (F.least(size(a), size(b)) >= F.greatest(size(a), size(b)) * least - 1e-6)


def _ends(pairs: DataFrame, label: str) -> DataFrame:
    return written(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), label)


def _verified(pairs: DataFrame, prints: DataFrame, rows: DataFrame, words: int, least: float, label: str) -> DataFrame:
    """Of the pairs (u, v) those whose whole sets are similar."""
    pairs = written(pairs.distinct(), f"{label}-pairs")
    own = written(only(prints.select("row", "size", "bins"), "row", _ends(pairs, f"{label}-ends")), f"{label}-bins")
    one, two = (own.select(F.col("row").alias(n), F.col("size").alias(f"size_{n}"), F.col("bins").alias(f"bins_{n}")) for n in "uv")
    known = texts(pairs.join(one, "u").join(two, "v"), "u", "v", "size_u", "size_v", "bins_u", "bins_v")
    pairs = written(known.mapInArrow(lean(_possible(least)), "u long, v long"), f"{label}-possible")
    wanted = only(rows, "row", _ends(pairs, f"{label}-wanted"))
    sets = written(texts(wanted, "row", "text").mapInArrow(lean(_sets(words)), _SETS), f"{label}-sets")
    one, two = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
    joined = pairs.join(one, "u").join(two, "v")
    return written(texts(joined, "u", "v", "x", "y").mapInArrow(lean(_alike(least)), "u long, v long"), f"{label}-links")


def _stars(part: DataFrame) -> DataFrame:
    """The links (u, v) that tell the components of part (node, component), one a node."""
    return part.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))


def _apart(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """Of the pairs (u, v) those in different components of part (node, component)."""
    one, two = (part.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("u", "c_u"), ("v", "c_v")))
    found = pairs.join(one, "u", "left").join(two, "v", "left")
    return found.where(F.coalesce("c_u", "u") != F.coalesce("c_v", "v")).select("u", "v")


def _leading(pairs: DataFrame) -> DataFrame:
    """Of the distinct pairs (u, v) those of each row with the LEADING of its partners that are in most pairs."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = F.count("*").over(Window.partitionBy("v"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("n"), "v"))
    found = both.withColumn("n", degree).withColumn("place", place).where(F.col("place") <= LEADING)
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_copies(rows: DataFrame, words: int = WORDS, least: float = LEAST, budget: int = BUDGET) -> DataFrame:
    """row and root (a row of its group) for every row; rows has row (distinct longs) and text."""
    common, rank = _order(rows, words)
    prints = written(texts(rows, "row", "text").mapInArrow(lean(_prefixes(common, rank, words, least)), _PRINTS), "prints")
    distinct = written(prints.groupBy("digest").agg(F.min("row").alias("node"), F.min("fingerprint").alias("fingerprint")), "distinct-sets")
    heads = written(distinct.groupBy("fingerprint").agg(F.min("node").alias("head")), "heads")
    same = distinct.join(heads, "fingerprint").where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    ends = [heads.select(F.col("fingerprint").alias(x), F.col("head").alias(y)) for x, y in (("u", "h"), ("v", "k"))]
    close = trie_links(heads, budget=budget).join(ends[0], "u").join(ends[1], "v").select(F.least("h", "k").alias("u"), F.greatest("h", "k").alias("v"))
    links = _verified(same.unionByName(close), prints, rows, words, least, "trie")
    part = written(components(links), "trie-parts")
    firsts = only(prints, "row", written(distinct.select("node"), "firsts"))
    keys = firsts.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keys.select("key"), "shared-keys")
    at = F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("place").cast("long"))
    keyed = firsts.select("row", "size", F.posexplode("prefix").alias("place", "key")).select("key", F.col("row").alias("node"), at.alias("at"))
    met = written(keyed.join(shared, "key"), "met")
    released(shared)
    left, tried = met, None
    for n in range(CENTRES):
        # Each key has a row of its own for a centre, so that a group whose rows are like some of the others is joined up by many.
        order = F.struct(F.xxhash64("key", "node", F.lit(n)).alias("h"), "node", "at")
        centre = left.groupBy("key").agg(F.min(order).alias("low")).select("key", F.col("low.node").alias("centre"), F.col("low.at").alias("at_centre"))
        stars = left.join(centre, "key").where("centre <> node").where(_reach("at_centre", "at", least))
        stars = written(_apart(stars.select(F.least("centre", "node").alias("u"), F.greatest("centre", "node").alias("v")).distinct(), part), "stars")
        links = _verified(stars, prints, rows, words, least, "star")
        part = written(components(_stars(part).unionByName(links)), "star-parts")
        tried = stars if tried is None else tried.unionByName(stars)
        placed = left.join(part, "node", "left").select("key", "node", "at", F.coalesce("component", "node").alias("part"))
        open_ = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
        done, left = left, written(placed.join(open_, "key"), "open-keys")
        released(done)
    # Pairs that the sketches show to be too far apart are told by the join itself.
    sides = [prints.select(F.col("row").alias("node"), *ODD).join(left.select("node").distinct(), "node", "left_semi")]
    known = written(left.join(sides[0], "node"), "open-sketches")
    one, two = (known.select("key", *[F.col(c).alias(f"{c}_{n}") for c in ("at", "part", *ODD)], F.col("node").alias(n)) for n in "uv")
    apart = sum((F.bit_count(F.col(f"{c}_u").bitwiseXOR(F.col(f"{c}_v"))) for c in ODD), F.lit(0))
    sizes = F.shiftright("at_u", 32) + F.shiftright("at_v", 32)
    near = (F.col("part_u") != F.col("part_v")) & (F.col("u") < F.col("v")) & _reach("at_u", "at_v", least) & (apart <= sizes * ((1 - least) / (1 + least)) + 1e-6)
    across = one.join(two.withColumnRenamed("key", "key_v"), (F.col("key") == F.col("key_v")) & near).select("u", "v")
    across = written(across.join(tried, ["u", "v"], "left_anti").distinct(), "across")
    released(left, known)
    first = written(_leading(across), "leading")
    links = _verified(first, prints, rows, words, least, "leading")
    part = written(components(_stars(part).unionByName(links)), "leading-parts")
    links = _verified(_apart(across.join(first, ["u", "v"], "left_anti"), part), prints, rows, words, least, "across")
    joined = components(_stars(part).unionByName(links))
    named = distinct.join(joined, "node", "left").select("digest", F.coalesce("component", "node").alias("root"))
    return prints.select("row", "digest").join(named, "digest").select("row", "root")
