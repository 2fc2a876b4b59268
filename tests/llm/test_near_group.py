"""A large group of near copies isn't verified pair by pair."""

import random

from querent.llm import similar
from tests.llm.test_dedup_search import brute_components
from tests.llm.test_similar import alike, brute_shingles


def test_a_group_around_one_text_is_joined_before_its_pairs_are_compared(spark, monkeypatch):
    rng, counts, write = random.Random(9), {}, similar.written

    def counted(df, label):
        out = write(df, label)
        counts[label] = out.count() if label in ("across", "leading-pairs", "across-pairs") else 0
        return out

    monkeypatch.setattr(similar, "written", counted)
    base = [f"w{i}" for i in range(160)]
    texts = [" ".join(base)]
    for _ in range(60):
        # Three changed words leave 0.83 of the shingles of both to base and copy, and 0.68 or so to two copies.
        words = list(base)
        for at in rng.sample(range(10, 150), 3):
            words[at] = f"x{rng.randrange(100000)}"
        texts.append(" ".join(words))
    got = {r.row: r.root for r in similar.near_copies(spark.createDataFrame(list(enumerate(texts)), "row long, text string")).collect()}
    want = brute_components([brute_shingles(t) for t in texts], alike)
    assert len(got) == len(texts) and len(set(got.values())) == len(set(want)) == 1
    assert counts["across-pairs"] <= counts["across"] and counts["leading-pairs"] <= similar.LEADING * len(texts)


def test_leading_pairs_are_those_with_the_rows_in_most_pairs(spark):
    pairs = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(1, 29)] + [(i, i + 7) for i in range(1, 22)] + [(i, i + 3) for i in range(1, 26)]
    found = {(r.u, r.v) for r in similar._leading(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert found <= set(pairs) and {(0, i) for i in range(1, 30)} <= found
    assert len(found) <= similar.LEADING * 30
    assert similar._leading(spark.createDataFrame([], "u long, v long")).count() == 0
