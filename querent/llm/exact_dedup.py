"""Exact deduplication over a cuckoo-filter index of live digests.

Each task keeps a :class:`CuckooIndex`: 16-bit fingerprints of digests in
four-slot buckets, and beside every slot the digest and the contents that have
it, each with its value. A fingerprint hit counts only once the stored content
is the text itself; texts that share a digest but differ are told apart. A
better document for a known text deletes the live entry and inserts its own; an
insertion that finds no free slot resizes the filter from the stored keys.

The index runs twice. On the map side it folds the copies inside each task, so
a text that holds a third of all rows leaves a task as one head. Heads are
written with their contents, the rows with the head they belong to. Only where
a digest has heads of several tasks are contents shuffled: a second index folds
those in digest order, again by content, emptying itself between digests
whenever it is full. Neither side's memory depends on the size of the corpus or
of a group: an index holds at most ``max_entries`` digests and about
``max_bytes`` bytes of contents, and one text. The price is one copy of the
distinct texts on disk until the session ends.

Defined results: a null text counts as empty; a null doc_id sorts below every
id; of repeated rows with the same id and text exactly one is kept; texts of
any length are compared whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.shared import FOLD, only, texts, written

SLOTS = 4
MAX_KICKS = 200
#: Bytes of a digest; fewer only make more texts share one.
DIGEST = 32


class CuckooIndex:
    """Cuckoo filter with deletion whose slots also hold key and value."""

    def __init__(self, capacity: int = 1024):
        self.resizes = 0
        self._clear(max(1, capacity // SLOTS))

    def _clear(self, buckets: int) -> None:
        self.buckets = 1 << (buckets - 1).bit_length()
        self.mask = self.buckets - 1
        self.prints = [0] * (self.buckets * SLOTS)
        self.entries: list = [None] * (self.buckets * SLOTS)
        self.live = 0

    def __len__(self) -> int:
        return self.live

    def _homes(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x9E3779B1 >> 7)) & self.mask

    def _slot(self, key: bytes) -> int:
        mark, one, two = self._homes(key)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.entries[slot][0] == key:
                    return slot
        return -1

    def get(self, key: bytes):
        """The live value, or None; the filter's hit is verified against the stored key."""
        slot = self._slot(key)
        return None if slot < 0 else self.entries[slot][1]

    def find(self, key: bytes, content: bytes):
        """The value of a live text, or None; a hit is verified against the contents stored in its bucket."""
        return next((v for c, v in self.get(key) or () if c == content), None)

    def add(self, key: bytes, content: bytes, value) -> None:
        """One more content of a digest."""
        held = self.get(key)
        if held is None:
            self.insert(key, [(content, value)])
        else:
            held.append((content, value))

    def replace(self, key: bytes, content: bytes, value) -> None:
        """Deletes a live digest and inserts it with another value for the content."""
        held = [(c, value if c == content else v) for c, v in self.get(key)]
        self.delete(key)
        self.insert(key, held)

    def insert(self, key: bytes, value) -> None:
        mark, one, two = self._homes(key)
        entry = (key, value)
        for bucket in (one, two):
            if self._put(bucket, mark, entry):
                self.live += 1
                return
        bucket = two
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick * 7 + mark) % SLOTS
            self.prints[slot], mark = mark, self.prints[slot]
            self.entries[slot], entry = entry, self.entries[slot]
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark, entry):
                self.live += 1
                return
        kept = [e for e in self.entries if e is not None] + [entry]
        self.resizes += 1
        self._clear(self.buckets * 2)
        for k, v in kept:
            self.insert(k, v)

    def _put(self, bucket: int, mark: int, entry: tuple) -> bool:
        for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.prints[slot]:
                self.prints[slot], self.entries[slot] = mark, entry
                return True
        return False

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        self.prints[slot], self.entries[slot] = 0, None
        self.live -= 1
        return True

    def drain(self) -> list[tuple]:
        out = [e for e in self.entries if e is not None]
        self._clear(self.buckets)
        return out


FOUND = "doc_id long, row long, head long, digest binary, content binary, keep_id long, keep_row long, size long"
_FOUND = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("head", pa.int64()), ("digest", pa.binary()), ("content", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("size", pa.int64())])
GROUPS = "head long, keep_id long, keep_row long, size long"
_GROUPS = pa.schema([("head", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("size", pa.int64())])


def _rank(doc_id: int | None, row: int) -> tuple:
    return (doc_id is not None, doc_id or 0, row)


class _Live:
    """What an index knows of a text: its best row, the number of its rows, and its heads."""

    __slots__ = ("best", "heads", "size")

    def __init__(self, head: int, best: tuple, size: int):
        self.heads, self.best, self.size = [head], best, size


def _folded(index: CuckooIndex, key: bytes, content: bytes, head: int, best: tuple, size: int) -> _Live:
    """Counts rows of a text in the index; what is live for it afterwards."""
    live = index.find(key, content)
    if live is None:
        live = _Live(head, best, size)
        index.add(key, content, live)
        return live
    live.size += size
    if _rank(*best) > _rank(*live.best):
        better = _Live(head, best, live.size)
        better.heads = live.heads
        index.replace(key, content, better)
        live = better
    return live


def _heads(max_entries: int, max_bytes: int, width: int):
    """Rows with their head, and heads with content, best row and size, from (doc_id, text, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held = CuckooIndex(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for key, contents in index.drain():
                for content, live in contents:
                    rows.append((None, None, live.heads[0], key, content, *live.best, live.size))
            for at in range(0, len(rows), 256):
                yield _batch(rows[at : at + 256], _FOUND)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for doc_id, text, row in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    content = (text or b"").translate(FOLD)
                    digest = hashlib.sha256(content).digest()
                    live = _folded(index, digest[:width], content, row, (doc_id, row), 1)
                    held += len(content) if live.size == 1 else 0
                    rows.append((doc_id, row, live.heads[0], digest, None, None, None, None))
                    if len(index) >= max_entries or held >= max_bytes:
                        yield from flush()
                        held = 0
                yield _batch(rows, _FOUND)
        yield from flush()

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _merged(max_entries: int, max_bytes: int):
    """The final best row and size for every head, from heads in digest order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last, held = CuckooIndex(), None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(h, *live.best, live.size) for _, contents in index.drain() for _, live in contents for h in live.heads]
            if rows:
                yield _batch(rows, _GROUPS)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for head, key, content, keep_id, keep_row, size in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if key != last and (len(index) >= max_entries or held >= max_bytes):
                        yield from flush()
                        held = 0
                    last = key
                    live = _folded(index, key, content, head, (keep_id, keep_row), size)
                    if live.size == size:
                        held += len(content)
                    if head != live.heads[0]:
                        live.heads.append(head)
        yield from flush()

    return run


def exact_dedup(docs: DataFrame, max_entries: int = 1 << 17, max_bytes: int = 64 << 20, digest_bytes: int = DIGEST) -> DataFrame:
    """One row per document: doc_id, row, digest (of the folded text, whole), keep_id, group_size, kept.

    max_entries and max_bytes bound a task's index, not the corpus; the index
    knows texts by the first digest_bytes of their digests.
    """
    base = texts(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    found = written(base.mapInArrow(_heads(max_entries, max_bytes, digest_bytes), FOUND), "digests")
    heads, rows = found.where(F.col("row").isNull()), found.where(F.col("row").isNotNull())
    narrow = heads.select("head", "digest", "keep_id", "keep_row", "size")
    often = written(narrow.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("digest"), "shared-digests")
    alone = narrow.join(often, "digest", "left_anti").select("head", "keep_id", "keep_row", "size")
    # Contents are picked by their heads' numbers, so the others' needn't be shuffled to find out.
    numbers = written(narrow.join(often, "digest", "left_semi").select("head"), "shared-heads")
    shared = only(heads.select("head", "digest", "content", "keep_id", "keep_row", "size"), "head", numbers)
    merged = texts(shared.repartition("digest").sortWithinPartitions("digest"), "head", "digest", "content", "keep_id", "keep_row", "size").mapInArrow(_merged(max_entries, max_bytes), GROUPS)
    known = alone.unionByName(merged)
    joined = rows.select("doc_id", "row", "head", "digest").join(known, "head")
    return joined.select("doc_id", "row", "digest", "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), g AS (
  SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
