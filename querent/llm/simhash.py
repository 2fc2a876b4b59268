"""SimHash near-duplicates by a binary trie self-join (:mod:`querent.llm.trie`).

Fingerprints: each text's word shingles vote on 64 bits. Equal fingerprints are
folded first (map-side combined), so copies never multiply; the distinct ones
are joined by the trie, and :func:`components` groups what is linked.

With a least Jaccard similarity ``least`` the links are those of whole shingle
sets. Pairs that the trie finds within the budget are verified on the sets and
linked; as edits of a similarity of 0.8 move up to 11 bits and more, which no
trie prunes well, an exact set join then looks for the pairs beyond the budget
(:mod:`querent.llm.similar`), and no pair is lost.

Defined results: a null text or one without words has fingerprint 0, linked
like any other; a null doc_id is never the smallest unless all are null;
repeated rows are rows each; texts of any length are read whole; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm import similar
from querent.llm.components import components
from querent.llm.shared import FOLD, lean, texts, written
from querent.llm.trie import BUDGET, trie_links

SEED = 42
PRINTS = "doc_id long, fingerprint long, row long"
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    import xxhash

    words = (text or b"").translate(FOLD).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else iter([b" ".join(words)])
    digest, n, ones = xxhash.xxh64_intdigest, max(1, len(words) - size + 1), np.zeros(64, np.int64)
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype=">u8", count=n)
    for at in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = np.array([fingerprint(t) for t in part.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64)), part.column(2)], ["doc_id", "fingerprint", "row"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (as a signed long), row (its place in the input) for every row."""
    return texts(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()).mapInArrow(lean(_fingerprints), PRINTS)


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, row, fingerprint, root (a fingerprint for the component), component_id for every row."""
    prints = written(fingerprints(docs), "fingerprints")
    distinct = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")), "distinct")
    joined = components(trie_links(distinct, budget=budget))
    linked = written(joined.join(distinct, joined["node"] == distinct["fingerprint"]).select("node", "component", "least_id"), "linked")
    least = linked.groupBy(F.col("component").alias("root")).agg(F.min("least_id").alias("component_id"))
    named = linked.join(least, linked["component"] == least["root"]).select(F.col("node").alias("fingerprint"), "root", "component_id")
    known = distinct.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), F.coalesce("component_id", "least_id").alias("component_id"))
    known = written(known, "components")
    return prints.join(known, "fingerprint").select("doc_id", "row", "fingerprint", "root", "component_id")


def representatives(docs: DataFrame, keep: tuple[str, ...], words: int = similar.WORDS, least: float = similar.LEAST, budget: int = BUDGET) -> DataFrame:
    """The columns ``keep`` of one row of each group of near-duplicates: the one with the smallest doc_id, of those the first.

    Texts are near-duplicates if the Jaccard similarity of their word shingles is ``least`` or more.
    """
    # Numbered once and written: both passes read the same numbers, however the files are split.
    docs = written(texts(docs, *dict.fromkeys(["doc_id", "text", *keep])).withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = written(similar.near_copies(docs, words, least, budget).join(docs.select("row", "doc_id"), "row"), "near")
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    groups = written(found.groupBy("root").agg(F.min(first).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).select("root", F.col("first.row").alias("kept")), "near-groups")
    gone = found.join(groups, "root").where(F.col("row") != F.col("kept")).select("row")
    return docs.join(gone, "row", "left_anti").select(*keep)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
