"""Sharding along a Hilbert curve over several metadata dimensions.

Every document gets a cell: each dimension quantised to ``bits`` bits by
equal-frequency cut points (one approximate-percentile aggregate over all rows).
Strings are cut in their order too: they count as the number that their next
PLACES bytes form after what the smallest and the largest value share, so a
file's least and greatest value bound a stretch of the curve's dimension. Rows are sorted by the cell's index on the Hilbert curve, so a run of
rows stays close in all dimensions at once, and the sorted order is cut into
runs; readers that filter on any of the dimensions can then prune whole files
by their min/max statistics.

The sort is a range partitioning on (curve index, text checksum, id, input
position): the last two break ties, so a cell or an id that holds a third of
all rows still spreads over many tasks. Only narrow rows are sorted, never
texts. The sorted order is written once to the shared folder with each row's
task and place; global positions are that place plus the count of the tasks
before, so no row is ranked in a single task and no position can change when
an executor is lost.

Law ``rows``: shard sizes are at most one row apart. Defined results: nulls in
a dimension form the lowest cell; strings that differ only after those bytes
share a cell; a null text has size 8 and checksum 0; a text of any length is
read whole and none is moved; repeated rows are rows each; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.shared import pick, written


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of each row of cells (unsigned, ``bits`` bits a column).

    Skilling's transform (Programming the Hilbert curve, 2004), over whole columns.
    """
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - np.uint64(1)
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - np.uint64(1)), flip)
        q >>= np.uint64(1)
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return out.astype(np.int64)


#: Bytes of a string that count: as many as a double holds exactly.
PLACES = 6


def _shared(least: str | None, most: str | None) -> int:
    """How many bytes all values between the two begin with."""
    a, b = (least or "").encode(), (most or "").encode()
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _numbers(df: DataFrame, dims: list[str]) -> list[Column]:
    """Each dimension as a double in its own order; null where it is null."""
    kinds = dict(df.dtypes)
    strings = [d for d in dims if kinds[d] == "string"]
    ends = df.agg(*[f(d).alias(f"{n}_{d}") for d in strings for n, f in (("least", F.min), ("most", F.max))]).first() if strings else {}
    out = []
    for d in dims:
        if d in strings:
            own = F.rpad(F.substring(F.col(d).cast("binary"), _shared(ends[f"least_{d}"], ends[f"most_{d}"]) + 1, PLACES), PLACES, F.lit(b"\0"))
            out.append(F.conv(F.hex(own), 16, 10).cast("double"))
        else:
            out.append(F.col(d).cast("double"))
    return out


def _quantised(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    numbers = _numbers(df, dims)
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    row = df.agg(*[F.percentile_approx(x, shares, 10000).alias(f"cuts_{i}") for i, x in enumerate(numbers)]).first()
    out = []
    for i, x in enumerate(numbers):
        found = sum(((x >= float(c)).cast("int") for c in sorted(set(row[f"cuts_{i}"] or []))), F.lit(0))
        out.append(F.when(x.isNull(), 0).otherwise(found).cast("int"))
    return out


def hilbert_shards(docs: DataFrame, shards: int = 24, dims: tuple[str, ...] = ("source", "lang", "n_chars"), bits: int = 5, number: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, curve, input, shard, slot for every row of docs.

    input is the row's ``number`` (distinct longs), by default its place in this one scan of docs.
    """
    if len(dims) * bits > 62:
        raise ValueError("dims times bits must not exceed 62")
    table = docs if number is None else docs.withColumn("_number", number)
    table = pick(table, *dict.fromkeys(["doc_id", "text", *dims, *([] if number is None else ["_number"])]))
    cells = _quantised(table, list(dims), bits)

    @F.pandas_udf("long")
    def curve(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series(hilbert_index(np.column_stack([c.to_numpy() for c in columns]), bits))

    rows = table.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        curve(*cells).alias("curve"),
        (F.monotonically_increasing_id() if number is None else F.col("_number")).alias("input"),
    )
    ordered = rows.repartitionByRange("curve", "text_crc32", "doc_id", "input").sortWithinPartitions("curve", "text_crc32", "doc_id", "input")
    placed = written(ordered.withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "hilbert")
    # One row a task: small however large the corpus is.
    counts = placed.groupBy("task").agg(F.count("*").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    at = (F.col("start") + F.col("place")).alias("at")
    joined = placed.join(starts, "task").select("doc_id", "size", "text_crc32", "curve", "input", at, "total")
    # Row i of N goes to shard floor(i * shards / N); that shard begins at ceil(shard * N / shards).
    shard = F.expr(f"at * {shards} div total")
    return joined.withColumn("shard", shard.cast("int")).withColumn("slot", F.expr(f"at - (shard * total + {shards - 1}) div {shards}")).drop("at", "total")


def write_shards(docs: DataFrame, folder: str, shards: int = 24, dims: tuple[str, ...] = ("source", "lang", "n_chars"), bits: int = 5) -> None:
    """Writes docs as Parquet, a folder ``shard=<n>`` each, in curve order.

    The rows are numbered once and written, so that both passes read the same
    numbers, however the files of docs are split. A shard is written by one task, so choose as many as make files of a good size.
    """
    numbered = written(docs.withColumn("_input", F.monotonically_increasing_id()), "numbered")
    placed = hilbert_shards(numbered, shards, dims, bits, F.col("_input")).select(F.col("input").alias("_input"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = numbered.join(placed, "_input").drop("_input")
    dealt = rows.repartitionByRange(shards, "_shard").sortWithinPartitions("_shard", "_slot").drop("_slot")
    dealt.withColumnRenamed("_shard", "shard").write.partitionBy("shard").parquet(folder)


def op2_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    placed = hilbert_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
