import random
import zlib
from collections import Counter

import corpus_pipeline
from querent.llm.packing import WordTokens, binary_lengths, vocabulary
from tests.llm.test_dedup_search import brute_components, brute_fingerprint
from tests.llm.test_mix_license_lines_language import brute_lines, prose


def corpus(spark, folder):
    rng, rows, labels = random.Random(8), [], []
    for i in range(160):
        lang = ["aa", "bb", "cc"][i % 3]
        text = f"{prose(rng, lang, 60)}\n{prose(rng, lang, 40)}"
        if i % 4 == 0:
            text = f"the same head line\n{text}"
        if i % 16 == 3:
            text += " scum idiot trash"
        rows.append((i, text, lang, f"s{i % 2}", len(text)))
        labels.append((i, 1, int(i % 16 == 3)))
    rows += [(200 + i, rows[5][1] + " more" * (i == 2), "cc", "s1", 0) for i in range(4)]
    rows += [(300, None, None, None, None), (301, "", "aa", "s0", 0), (302, "?? 12", "bb", "s0", 5), (303, rows[7][1].upper(), None, "s1", 9), (7, rows[7][1], "bb", "s1", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    rows = corpus(spark, folder)
    stages, docs, seen = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet"), {}
    assert list(stages) == ["language_id", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    kept = [r for r in rows if r[0] not in (300, 301, 302)]
    assert Counter(r.doc_id for r in seen["language_id"]) == Counter(r[0] for r in kept)
    cleaned = brute_lines([(s, t) for _, t, _, s, _ in kept], 0.1, 3)
    assert Counter((r.doc_id, r.text) for r in seen["line_dedup"]) == Counter((r[0], t) for r, t in zip(kept, cleaned, strict=True))
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"]) and not any("same head" in r.text for r in seen["line_dedup"])
    prints = [brute_fingerprint(t) for t in cleaned]
    label = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for r, l in zip(kept, label, strict=True):
        first[l] = min(first.get(l, r[0]), r[0])
    assert Counter(r.doc_id for r in seen["simhash_near_dedup"]) == Counter(first.values())
    mixed = Counter(r.doc_id for r in seen["mixing"])
    clean = {i for i in first.values() if i % 16 != 3 or i >= 160}
    assert clean <= set(mixed) <= set(first.values())
    assert len([i for i in mixed if i < 160 and i % 16 == 3]) <= 2  # of ten toxic ones
    tokens = WordTokens(vocabulary())
    want = Counter()
    for r in seen["mixing"]:
        ids, at = tokens.encode(r.text.encode()) + (1).to_bytes(4, "little"), 0
        for n in binary_lengths(len(ids) // 4, 2048):
            want[r.doc_id, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])] += 1
            at += n
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in seen["packing"]) == want
    assert Counter((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, folder).collect()) == Counter((r.doc_id, r.start, r.length) for r in seen["packing"])


def test_an_empty_table_passes_every_stage(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
