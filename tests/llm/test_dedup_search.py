import hashlib

import numpy as np
import pytest
import xxhash

from querent.llm import components, exact_dedup, simhash, topk_search

DOCS = "doc_id long, text string, digest string, kept string, extra int"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS)


ROWS = [(1, "One two"), (2, "one TWO"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "a " * 60000), (8, "A " * 60000), (9, "one two"), (None, "one two"), (9, "one two"), (None, "x"), (None, "x")]


def test_cuckoo_index_inserts_deletes_and_resizes():
    index, keys = exact_dedup.CuckooIndex(8), [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for i, k in enumerate(keys):
        index.insert(k, i)
    assert index.resizes > 0 and len(index) == 5000
    assert [index.get(k) for k in keys] == list(range(5000))
    for k in keys[::2]:
        assert index.delete(k)
    assert len(index) == 2500 and index.get(keys[0]) is None and index.get(keys[1]) == 1
    assert not index.delete(keys[0])
    assert index.get(hashlib.sha256(b"absent").digest()) is None


@pytest.mark.parametrize(("most", "width"), [(2, 32), (1 << 17, 32), (1 << 17, 1), (3, 0)])
def test_exact_dedup_equals_brute_force(spark, most, width):
    # Digests of one byte, or none, are shared by many texts: contents alone tell them apart.
    rows = ROWS + [(100 + i, f"t{i % 97}") for i in range(300)]
    got = exact_dedup.exact_dedup(docs(spark, rows).repartition(5), most, 1000 if most == 3 else 64 << 20, width).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(fold(t).encode()).digest(), []).append(i)
    for r in got:
        own = groups[bytes(r.digest)]
        assert r.group_size == len(own) and r.keep_id == max((x for x in own if x is not None), default=None)
    kept = [(bytes(r.digest), r.doc_id) for r in got if r.kept]
    assert len(kept) == len(groups) and {k for k, _ in kept} == set(groups)
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_a_live_digest_is_deleted_only_for_a_better_row(monkeypatch):
    index, deleted = exact_dedup.CuckooIndex(), []
    drop = exact_dedup.CuckooIndex.delete
    monkeypatch.setattr(exact_dedup.CuckooIndex, "delete", lambda self, key: (deleted.append(key), drop(self, key))[1])
    for row, doc_id in enumerate([5, 3, 9, 9, None, 1]):
        exact_dedup._folded(index, b"k" * 32, b"text", row, (doc_id, row), 1)
    assert len(deleted) == 2  # 9 after 5, and the later row of 9
    live = index.find(b"k" * 32, b"text")
    assert (live.best, live.size, live.heads) == ((9, 3), 6, [0]) and index.find(b"k" * 32, b"other") is None


def brute_fingerprint(text):
    words = fold(text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, linked):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    return label


@pytest.mark.parametrize(("leaf", "budget"), [(1, 2), (8, 2), (4096, 2), (8, 0), (8, 1), (8, 3)])
def test_trie_links_equal_brute_force(spark, leaf, budget):
    rng = np.random.default_rng(3)
    centres = [int(x) for x in rng.integers(0, 1 << 63, 12)] + [0, (1 << 64) - 1]
    values = set(centres)
    for c in centres:
        for _ in range(60):
            x = c
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            values.add(x)
    values = sorted(values)
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    links = simhash.trie_links(spark.createDataFrame([(x,) for x in signed], "fingerprint long"), leaf, budget).collect()
    want = {frozenset((a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % (1 << 64)).bit_count() <= budget}
    assert len(links) == len(want) and {frozenset((r.u, r.v)) for r in links} == want
    assert simhash.trie_links(spark.createDataFrame([], "fingerprint long"), leaf, budget).count() == 0


def test_the_descent_is_pruned(spark):
    rng, report = np.random.default_rng(4), []
    rows = [(int(x),) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 3000)]
    simhash.trie_links(spark.createDataFrame(rows, "fingerprint long"), report=report)
    # Rounds end once nodes are single; of 4.5 million pairs of fingerprints few node pairs are ever met.
    assert report[0][1] > 256 and report[-1][0] <= 24 and sum(n for _, n, _ in report) < 60_000


def test_simhash_equals_brute_force(spark):
    base = " ".join(f"w{i * 7 % 83}" for i in range(400))
    rows = [(10 + i, base.replace(f"w{i}", f"v{i}", 1)) for i in range(12)] + [(1, None), (2, "  \t"), (3, "Two words"), (4, "two WORDS"), (5, base.upper()), (5, base), (None, base), (6, "q " * 70000)]
    got = simhash.near_duplicates(docs(spark, rows).repartition(4)).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), l in zip(rows, label):
        least[l] = min((x for x in (least.get(l), i) if x is not None), default=None)
    want = sorted((str(i), p, str(least[l])) for (i, _), p, l in zip(rows, prints, label))
    assert sorted((str(r.doc_id), r.fingerprint % (1 << 64), str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}}


def brute_top_k(rows, asked, k=5):
    sound = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in sound if asked(i)}):
        v = min(v for i, v in sound if i == q)
        held = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(v, w)))), i) for i, w in sound if i != q and len(w) == len(v))[:k]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(held)]
    return sorted(want)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 6)]) for i in range(400)]
    rows += [(1000 + i, [8.0] * 6) for i in range(50)] + [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (None, [1.0] * 6), (2003, []), (3000, []), (2004, [9.0, 9.0])]
    rows += [(3, [1.0] * 6), (2005, [float("inf")] + [0.0] * 5), (2006, [1e18] * 6), (2007, [-1e18] * 6)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, vector array<double>, score int")
    asked = table.where("vec_id % 20 = 3 or vec_id % 1000 = 4 or vec_id = 3000")
    got = {}
    for blocks in (200, 4096):
        got[blocks] = sorted(tuple(r) for r in topk_search.top_k_search(table.select("vec_id", "vector"), asked, query_block=blocks).collect())
    assert got[4096] == brute_top_k(rows, lambda i: i % 20 == 3 or i % 1000 == 4 or i == 3000) and got[200] == got[4096]


@pytest.mark.parametrize("size", [0, 1, 4, 6, 30])
@pytest.mark.parametrize("dims", [1, 6, 10])
def test_top_k_of_small_tables(spark, size, dims):
    rng = np.random.default_rng(size + dims)
    rows = [(i, [float(x) for x in rng.integers(-3, 3, dims)]) for i in range(size)]
    table = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = sorted(tuple(r) for r in topk_search.top_k_search(table.repartition(3), table.where("vec_id % 2 = 0"), blocks=4).collect())
    assert got == brute_top_k(rows, lambda i: i % 2 == 0)


def test_the_cutoff_passes_over_most_candidates(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 100, 32).round()]) for i in range(2000)]
    table, report = spark.createDataFrame(rows, "vec_id long, vector array<double>"), {}
    got = sorted(tuple(r) for r in topk_search.top_k_search(table, table.where("vec_id % 50 = 0"), report=report).collect())
    assert got == brute_top_k(rows, lambda i: i % 50 == 0)
    assert report["phase 1"] < 0.05 * 40 * 2000 and 200 <= report["phase 3"] < 0.1 * 40 * 2000


def test_huge_components_take_part(spark, tmp_path):
    rows = [(0, [1.0, 1.0]), (1, [1e308, 0.0]), (2, [-1.7e308, 0.0]), (3, [0.25, 0.5]), (4, [float("inf"), 0.0]), (5, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.op9_topk_search(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 256 * 192), (0, 3, 2, -(2**63) + 1)]
