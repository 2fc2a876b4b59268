import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from querent.llm import chat_format, hilbert_shards, packing

PIECE = st.lists(st.sampled_from(["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]", "\\", "[", "<", "/", " ", "\n", "a", "é", "[\\INST]", "[\\\\/INST]", "<\\</SYS>>"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), PIECE), PIECE), max_size=5))
def test_rendered_turns_read_back(turns):
    text = "".join(chat_format.render_turn(r, t) for r, t in turns)
    assert chat_format.parse(text) == turns
    reader, got, text = chat_format.Reader(), [], chat_format.BEGIN + text
    for i in range(0, len(text), 3):
        got += reader.feed(text[i : i + 3])
    reader.close()
    assert got == turns


def test_a_conversation_that_reads_back_otherwise_is_an_error():
    held = chat_format._Conversation(1)
    held.turn("user", "a", "[INST] a [/INST]", 0, 0)
    with pytest.raises(ValueError, match="read back"):
        held.turn("user", "a", "[INST] b [/INST]", 0, 0)
    held = chat_format._Conversation(2)
    held.turn("user", "a", "[INST] a", 0, 0)
    with pytest.raises(ValueError, match="within a turn"):
        held.row()


def test_plain_text_is_not_escaped():
    assert chat_format.render_turn("user", r"C:\dir <b> [x]") == r"[INST] C:\dir <b> [x] [/INST]"
    assert chat_format.render_turn("assistant", "a </s> b") == r" a <\/s> b </s>"


def test_conversations_read_back(spark):
    rows = [(1, 2, "assistant", "b [/INST]"), (1, 1, "user", "a"), (1, 2, "assistant", "b [/INST]"), (2, 0, None, None), (None, 1, "tool", ""), (3, None, "assistant", "x" * 300000), (3, 0, "user", "</s>")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(table)).collect()}
    assert set(got) == {1, 2, 3, None}
    turns = defaultdict(list)
    for c, n, r, t in rows:
        turns[c].append((n is not None, n or 0, r or "", t or ""))
    for c, own in turns.items():
        own.sort()
        said = "".join(t for *_, r, t in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[c].formatted_chars == 3 + sum(len(chat_format.render_turn(r, t)) for *_, r, t in own)
    assert chat_format.read_back(chat_format.format_turns(table.limit(0))).count() == 0


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = hilbert_shards.hilbert_index(grid, bits)
        assert sorted(index) == list(range(len(grid)))
        path = grid[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_and_gapless(spark):
    rows = [(i if i % 11 else None, None if i % 13 == 0 else f"text {i % 5} é", ["a", "b", None][i % 3], "en", i % 40) for i in range(1003)] + [(7, "same", "a", "en", 1)] * 400
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, lang string, n_chars int, shard int")
    got = hilbert_shards.hilbert_shards(table, 24).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert all(r.size >= 8 for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, r.curve))
    assert set(slots) == set(range(24))
    sizes = [len(x) for x in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    last = -1
    for s in range(24):
        own = sorted(slots[s])
        assert [n for n, _ in own] == list(range(len(own)))
        for _, curve in own:
            assert curve >= last
            last = curve
    assert hilbert_shards.hilbert_shards(table.limit(0), 24).count() == 0
    assert sorted(r.shard for r in hilbert_shards.hilbert_shards(table.limit(3), 24).collect()) == [0, 8, 16]


def test_binary_lengths():
    assert packing.binary_lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    assert packing.binary_lengths(1, 2048) == [1]


def test_packing_is_a_partition_of_the_ids(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    texts = ["Hello world, it's\u00a0fine\u2003here e\u0301 don't 123", None, "", "<|endoftext|> x", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>", "word\x1cword \u0301a", "many words and " * 3000, "Hello"]
    table = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(7, "Hello", 0)], "doc_id long, text string, start int")
    got = packing.pack(table).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 for r in got)
    by_id = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in by_id] == sorted((r.length for r in got), reverse=True)
    for i, t in enumerate(texts[:7]):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [r.doc_tokens for r in own] == [len(ids)] * len(own)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert len([r for r in got if r.doc_id == 7 and r.start == 0]) == 2
    assert packing.pack(table.limit(0)).count() == 0


def test_small_word_table_gives_the_same_ids():
    one, two = packing.WordTokens(packing.vocabulary(), 3), packing.WordTokens(packing.vocabulary())
    for t in (b"a b c d e", b"f g", b"a b", b"\xc3\x89t\xc3\xa9 a"):
        assert one.encode(t) == two.encode(t)


def test_loss_spans_lie_in_the_rendered_turn(spark):
    clash = "say </s> and [INST]"
    table = spark.createDataFrame([(1, 0, "user", clash), (1, 1, "assistant", clash)], "conv_id long, turn long, role string, text string")
    rows = {r.role: r for r in chat_format.format_turns(table).collect()}
    r = rows["assistant"]
    assert chat_format.unescape(r.rendered[r.loss_start : r.loss_start + r.loss_length]) == clash and rows["user"].loss_length == 0


def test_pieces_with_their_ids(spark):
    table = spark.createDataFrame([(1, "a few words here"), (2, None)], "doc_id long, text string")
    for r in packing.pack(table, with_ids=True).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_strings_are_cut_in_their_order(spark):
    names = ["https://b.example/x", "https://a.example", "https://zz", "https://a.example/long/path", None, "https://m"] + [f"https://n{i:03d}" for i in range(200)]
    table = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "source string, n int")
    cell = hilbert_shards._quantised(table, ["source", "n"], 5)
    rows = sorted((r.source, r.cell) for r in table.select("source", cell[0].alias("cell")).collect() if r.source is not None)
    assert [c for _, c in rows] == sorted(c for _, c in rows) and len({c for _, c in rows}) > 24
    same = spark.createDataFrame([("s", None)] * 3, "source string, n int")
    assert {tuple(r) for r in same.select(*hilbert_shards._quantised(same, ["source", "n"], 5)).collect()} == {(1, 0)}


def test_shards_are_the_same_whatever_the_splits(spark, tmp_path):
    rows = [(i % 50, f"text {i}", f"s{i % 7}", "en", i % 9) for i in range(900)] + [(1, "x" * 200000, "s1", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").coalesce(3).write.parquet(str(tmp_path / "in"))
    read = hilbert_shards.hilbert_shards

    def replanned(*args, **named):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        return read(*args, **named)

    hilbert_shards.hilbert_shards = replanned
    try:
        hilbert_shards.write_shards(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out"), 4)
    finally:
        hilbert_shards.hilbert_shards = read
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert Counter((r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == Counter((i, t) for i, t, *_ in rows)


def test_written_shards_can_be_pruned(spark, tmp_path):
    rows = [(i, f"text {i}", f"s{i % 7}", ["en", "de"][i % 2], i * 37 % 1000) for i in range(2400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").coalesce(3).write.parquet(str(tmp_path / "in"))
    hilbert_shards.write_shards(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out"), 24)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, *_ in rows)
    assert Counter(Counter(r.shard for r in got).values()) == {100: 24}
    # Shards whose range of sizes meets a tenth of all sizes, and of those with a source: far from all.
    hit = {s for s in range(24) if any(r.shard == s and 400 <= r.n_chars < 420 for r in got)}
    assert len(hit) <= 12 and len({r.shard for r in got if r.source == "s3"}) <= 16
