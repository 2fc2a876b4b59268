"""Exact top-k inner-product search by a three-phase uniform threshold.

The dimensions are cut into m blocks; a candidate's partial score in a block is
an entry of that block's list, and its score is the sum of its m entries. For a
block of queries (bounded, so it may be broadcast):

1. each task gathers, for every query and dimension block, the head of its
   local list: the k + 1 highest entries. Only those candidates are scored in
   full; the k-th best score found is a lower bound tau for the true k-th best.
2. tau is broadcast: a candidate whose score reaches tau has an entry of at
   least the safe cutoff tau / m in one of the lists, so each task collects the
   entries that reach the cutoff and passes over all others.
3. Only the candidates with a collected entry are resolved: their remaining
   entries are added up, and a task hands on at most k of them a query, ordered
   by (score, smaller id).

A query with fewer than k candidates found has no bound and no cutoff: all its
candidates are resolved. ``report`` tells how many full scores each phase took;
two blocks of 32 dimensions resolve fewer than four of 16 would, as the cutoff
of a block lies further out in the tail of its entries.

Queries come in blocks of ``query_block``, all rows are scanned twice for each
block, and nothing of the corpus reaches the driver but a block of queries and
its bounds. Defined results: vectors that are null or hold null or non-finite
components take no part; a null id takes no part; a query never meets rows of
its own id; rows that repeat an id are candidates each, and as a query only the
smallest vector of an id counts; vectors of another length than the query's are
not candidates, so an empty one meets empty ones only, at a score of 0; scores
beyond a long are held at its ends; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.shared import pick, written

HITS = "query_id long, vec_id long, score long"
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
EXACT = float(1 << 53)
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Bytes of the queries of a block, however long their vectors are.
BLOCK_BYTES = 32 << 20
#: Cells of a score matrix that a task holds at once.
CELLS = 1 << 20


def _vectors(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids in ascending order, integer-valued float64 matrix) of blocks of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            vectors = part.column(1)
            lengths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(lengths)
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                own = own[np.argsort(ids[own], kind="stable")]
                yield int(d), ids[own], flat[(ends[own] - d)[:, None] + np.arange(d)]


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, the first of those that tie; places are in id order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def _merge(best: dict, query: int, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    held = best.setdefault(query, [])
    held.extend((-int(s), int(i)) for s, i in zip(scores, ids, strict=True))
    if len(held) > 4 * k:
        held.sort()
        del held[k:]


def _emit(best: dict, k: int) -> Iterator[pa.RecordBatch]:
    rows = [(q, i, -s) for q, held in best.items() for s, i in sorted(held)[:k]]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_HITS)


def _entries(queries: np.ndarray, rows: np.ndarray, m: int) -> list[np.ndarray]:
    """The m lists: a (queries x rows) matrix of partial scores for each block of dimensions.

    int64 where every sum is exact in a double, else Python integers of any size.
    """
    d = queries.shape[1]
    cuts = np.linspace(0, d, max(1, min(m, d)) + 1).astype(int)
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * d
    if most < EXACT:
        return [(queries[:, a:b] @ rows[:, a:b].T).astype(np.int64) for a, b in zip(cuts, cuts[1:], strict=False)]
    wide, other = (np.array([[int(x) for x in r] for r in part], dtype=object).reshape(part.shape) for part in (queries, rows))
    return [wide[:, a:b] @ other[:, a:b].T for a, b in zip(cuts, cuts[1:], strict=False)]


def _resolved(lists: list[np.ndarray], mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Full scores of the masked cells alone, with the first of each query's cells."""
    q, c = np.nonzero(mask)
    total = sum(x[q, c] for x in lists)
    if total.dtype == object:
        total = np.array([max(LOW + 1, min(HIGH, int(x))) for x in total], np.int64)
    return total, np.searchsorted(q, np.arange(len(mask) + 1))


def _phase(block: dict, bounds: dict | None, k: int, m: int, scored):
    """The task of phase 1 (bounds None) or of phases 2 and 3; scored counts the full scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        step = max(64, CELLS // max(len(x[0]) for x in block.value.values()))
        for d, ids, rows in _vectors(batches, step):
            if d not in block.value:
                continue
            queries, matrix = block.value[d]
            lists = _entries(matrix, rows, m)
            if bounds is None:
                # k + 1, as one of them may be the query's own row.
                mask = np.full((len(queries), len(ids)), len(ids) <= k + 1)
                for x in lists if len(ids) > k + 1 else ():
                    np.put_along_axis(mask, np.argpartition(x, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1 :], True, axis=1)
            else:
                tau = [bounds.value.get(int(q)) for q in queries]
                # A bound at the lowest score may be one that was held there; it cuts nothing.
                mask = np.repeat(np.array([t is None or t <= LOW + 1 for t in tau])[:, None], len(ids), axis=1)
                cut = np.array([LOW if t is None else -(-t // len(lists)) for t in tau], np.int64)[:, None]
                for x in lists:
                    mask |= (x >= cut).astype(bool)
            mask &= queries[:, None] != ids[None, :]
            total, starts = _resolved(lists, mask)
            scored.add(len(total))
            for i in np.flatnonzero(np.diff(starts)):
                own, found = np.flatnonzero(mask[i]), total[starts[i] : starts[i + 1]]
                top = _top(found, k)
                _merge(best, int(queries[i]), ids[own[top]], found[top], k)
        yield from _emit(best, k)

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k_search(vectors: DataFrame, queries: DataFrame, k: int = 5, blocks: int = 2, query_block: int = 4096, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of vectors for each row of queries.

    Both have (vec_id long, vector array<double> of integers). query_block and
    BLOCK_BYTES bound what is broadcast at once. report, if given, gets the
    numbers of full scores: {"phase 1": n, "phase 3": n}.
    """
    spark = vectors.sparkSession
    sound = F.col("vector").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(sound)
    asked = written(queries.where(sound).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    n, longest = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    count = -(-n // max(1, min(query_block, BLOCK_BYTES // (8 * (longest or 1)))))
    first_scored, last_scored = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    out = None
    for i in range(count):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(count)) == i) if count > 1 else asked
        own: dict = {}
        for r in part.toLocalIterator():
            own.setdefault(len(r["vector"]), []).append((r["vec_id"], r["vector"]))
        if not own:
            continue
        block = spark.sparkContext.broadcast({d: (np.array([q for q, _ in x]), np.array([v for _, v in x], np.float64).reshape(len(x), d)) for d, x in own.items()})
        first = _best(rows.mapInArrow(_phase(block, None, k, blocks, first_scored), HITS), k)
        bounds = spark.sparkContext.broadcast({r[0]: r[1] for r in first.where(F.col("rank") == k).select("query_id", "score").toLocalIterator()})
        hits = written(_best(rows.mapInArrow(_phase(block, bounds, k, blocks, last_scored), HITS), k), "topk")
        out = hits if out is None else out.unionByName(hits)
    if report is not None:
        report |= {"phase 1": first_scored.value, "phase 3": last_scored.value}
    if out is None:
        out = spark.createDataFrame([], HITS).withColumn("rank", F.lit(0))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_topk_search(spark, sf_dir: str) -> DataFrame:
    table = pick(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    # floor() to long would wrap for huge components; the double keeps integers of any size.
    whole = table.select("vec_id", F.transform("embedding", lambda x: _floor(x)).alias("vector"))
    return top_k_search(whole, whole.where(F.col("vec_id") % 50 == 0))


def _floor(x):
    x = x.cast("double")
    # From 2^52 on every double is whole. A component whose product is beyond a double's range takes part at its ends.
    y = F.when(F.abs(x) == float("inf"), x).otherwise(F.greatest(F.least(x * 256.0, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max)))
    return F.when(F.isnan(x), x).when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
