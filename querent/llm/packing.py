"""Packing by power-of-two decomposition.

A document's tokens (with the end id) are split into pieces whose lengths are
powers of two: as many of the sequence limit as fit, then the binary digits of
the rest, longest first. Each piece is a sequence of its own and pieces of
equal length share a bucket, so no sequence crosses documents and none is
padded.

Tokenising, splitting and checksums happen in one pass where the rows lie; no
text is shuffled. The pieces are written once to the shared folder with their
task and their ordinal within (task, length). Sequence ids then follow from a
running count over (length, task), one small row each: bucket by bucket,
gapless from 0, fixed even if an executor is lost later.

Words are tokenised once and kept in a bounded table as packed id bytes: this
vocabulary drops white space, so a text's ids are those of its
white-space-separated pieces in order. A text that names one of the
vocabulary's own tokens, such as its end mark, is given to the tokenizer whole.
Defined results: a null or empty text is the end id alone, in one sequence of
length 1; repeated rows are packed each; a text of any length is read whole; an
empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.shared import FOLD, texts, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, ordinal long"
_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int32()), ("ordinal", pa.int64())]
)
#: Closing marks that are looked up apart from the word before, and what may stand before.
MARKS = (b",", b".")
LETTERS = b"abcdefghijklmnopqrstuvwxyz"
END = (1).to_bytes(4, "little")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Token ids of texts as little-endian 32-bit bytes, one word at a time.

    most bounds the words held; beyond it the table starts anew, and words still
    in use move over from the table before.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Tokens that the vocabulary finds in raw text, before it normalises and cuts.
        self.special = [t.content.encode().translate(FOLD) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        # A letter and one closing mark: the vocabulary cuts between them as well.
        marked = [w for w in words if w[-1] in b",." and w[-2:-1] in LETTERS and len(w) > 1]
        plain = list(words.difference(marked).union({w[:-1] for w in marked}, MARKS).difference(self.known))
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.known.update(zip(part, [_packed(e.ids) for e in found], strict=True))
        known = self.known
        known.update([(w, known[w[:-1]] + known[w[-1:]]) for w in marked])

    def encode(self, text: bytes) -> bytes:
        # bytes.split() cuts at ASCII white space only, all of which the vocabulary drops;
        # it lower-cases as well, so A-Z may be folded first.
        folded = text.translate(FOLD)
        if any(t in folded for t in self.special):
            return _packed(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)
        words = folded.split()
        new = set(words).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.most:
                self.known, self.older = {}, self.known
                new = set(words)
            # set.intersection() would walk the whole table, not the few new words.
            again = [w for w in new if w in self.older]
            self.known.update([(w, self.older[w]) for w in again])
            self._learn(new.difference(again))
        return b"".join(map(self.known.__getitem__, words))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One table a Python worker, kept for its later tasks."""
    return WordTokens(path)


def binary_lengths(n: int, limit: int) -> list[int]:
    """n as powers of two, longest first, none over limit (itself a power of two)."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(limit: int, path, with_ids: bool):
    schema = _PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens, task, seen = word_tokens(path or vocabulary()), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    ids = memoryview(tokens.encode(text or b"") + END)
                    n, start = len(ids) // 4, 0
                    for length in binary_lengths(n, limit):
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append((doc_id, start, length, zlib.crc32(own), n, task, seen[length], *([list(own.cast("i"))] if with_ids else [])))
                        seen[length] += 1
                        start += length
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def pack(docs: DataFrame, limit: int = 2048, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    path names the vocabulary file; by default each worker finds the public one.
    with_ids adds the token ids themselves, which are the training sequences.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    pieces = written(texts(docs, "doc_id", "text").mapInArrow(_pieces(limit, path, with_ids), f"{PIECES}, ids array<int>" if with_ids else PIECES), "pieces")
    # At most one row for each task and power of two.
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("length"), "task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "task", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    return pieces.join(starts, ["length", "task"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("ordinal")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
