"""The exact similarity join, and the pipeline's stage by it, against all pairs."""

import random

import corpus_pipeline
from querent.llm import similar
from tests.llm.test_dedup_search import brute_components


def brute_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def edited():
    """Texts, near copies of one to three changed words each (J from 0.7 to 1), short and empty ones, a common passage."""
    rng, out = random.Random(5), []
    passage = [f"c{i}" for i in range(60)]
    for i in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 30, 100, 200]))]
        words = words + passage if i % 4 == 0 else words
        out.append(" ".join(words))
        for _ in range(rng.randrange(6)):
            copy = list(words)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10000)}"
            out.append(" ".join(copy))
    return [*out, None, "", " \n", out[0].upper(), "a b", "A  b", "a b c"]


def test_bins_bound_the_overlap():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, m, both in ((1, 1, 0), (40, 33, 20), (450, 520, 400), (5000, 4100, 3900), (10, 4000, 3), (450, 450, 0)):
        x = rng.integers(0, 1 << 64, n + m, dtype=np.uint64, endpoint=False)
        a, b = x[:n], np.concatenate([x[: min(both, n)], x[n:]])[:m]
        assert similar.most_shared(similar.bins(a), similar.bins(b)) >= len(set(a) & set(b))
        odd = similar.odd_sketch(a) ^ similar.odd_sketch(b)
        assert sum(int(x).bit_count() for x in odd.view(np.uint64)) <= len(set(a) ^ set(b))
    assert similar.most_shared(similar.bins(a), similar.bins(b)) < 0.8 * 450
    same = np.full(300, 5, np.uint64)
    assert similar.bins(same) == b"" and similar.most_shared(b"", similar.bins(a)) == float("inf")


def test_near_copies_equal_all_pairs(spark):
    texts = edited()
    sets = [brute_shingles(t) for t in texts]
    want = brute_components(sets, alike)
    got = {r.row: r.root for r in similar.near_copies(spark.createDataFrame(list(enumerate(texts)), "row long, text string")).collect()}
    assert len(got) == len(texts)
    group = lambda label: {frozenset(i for i in range(len(texts)) if label[i] == x) for x in {label[i] for i in range(len(texts))}}
    assert group(got) == group(want)


def test_the_stage_drops_an_edited_copy_beyond_two_bits(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = [(1, " ".join(words), "aa", "s", 0), (2, " ".join([*words[:60], "changed", *words[61:90], "too", *words[91:]]), "aa", "s", 0), (3, "quite another text of some words", "aa", "s", 0)]
    from querent.llm.simhash import fingerprint

    assert (fingerprint(rows[0][1].encode()) ^ fingerprint(rows[1][1].encode())).bit_count() > 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]
