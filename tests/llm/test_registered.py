"""The registered corpus queries over the test tables: against their SQL, or their contracts."""

import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from querent.llm import registry
from tests.llm.test_dedup_search import brute_components, brute_fingerprint
from tests.llm.test_mix_license_lines_language import brute_licenses
from tests.test_queries import plain

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def run(spark, name):
    return registry.queries()[name](spark, str(FOLDER))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, found = run(spark, name), con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(plain(r[n]) for n in names) for r in df.collect()) == Counter(tuple(map(plain, r)) for r in found.fetchall())


def test_op2(spark, documents):
    got = run(spark, "op2_hilbert_shards").collect()
    assert Counter(r.doc_id for r in got) == Counter(list(documents))
    shards = defaultdict(list)
    for r in got:
        text = (documents[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "rows", None)
        shards[r.shard].append(r.slot)
    assert sorted(shards) == list(range(24)) and all(sorted(x) == list(range(len(x))) for x in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_op3(spark, documents):
    got = run(spark, "op3_mixing").collect()
    assert Counter(r.doc_id for r in got) == Counter(list(documents))
    assert all(r.rate >= 0 and 0 <= r.copies - int(r.rate) <= 1 and abs(r.p_high + r.p_low + r.p_toxic - 1) < 1e-5 for r in got)


def test_op4(spark, documents):
    got = run(spark, "op4_license_scan").collect()
    assert {(r.doc_id, r.template) for r in got} == {(i, n) for i, r in documents.items() for n in brute_licenses(r.text)} and len(got) > 0


def test_op5(spark, documents):
    import numpy as np
    from tokenizers import Tokenizer

    from querent.llm.packing import vocabulary

    tokenizer, pieces = Tokenizer.from_file(vocabulary()), defaultdict(list)
    got = run(spark, "op5_packing").collect()
    for r in got:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(pieces) == set(documents) and len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    for i, own in pieces.items():
        ids, at = np.array([*tokenizer.encode(documents[i].text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for start, length, crc, total in sorted(own):
            assert (start, crc, total) == (at, zlib.crc32(ids[at : at + length].tobytes()), len(ids))
            at += length
        assert at == len(ids)


def test_op7(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op7_simhash").collect()}
    ids = sorted(documents)
    prints = [brute_fingerprint(documents[i].text) for i in ids]
    label = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, l in zip(ids, label, strict=True):
        least.setdefault(l, i)
    assert {i: (got[i].fingerprint, got[i].component_id) for i in ids} == {i: (f"{p:016x}", least[l]) for i, p, l in zip(ids, prints, label, strict=True)}


def test_op10(spark, documents):
    got = run(spark, "op10_language_id").collect()
    assert Counter(r.doc_id for r in got) == Counter(list(documents))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and documents[r.doc_id].lang]
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in held) / len(held) > 0.95
