r"""Chat formatting proved by a grammar round trip.

Grammar of a formatted conversation (deterministic: the first characters of a
turn decide its production, and a text ends at the first raw end mark)::

    conversation := "<s>" turn*
    turn := "<<SYS>>" text "<</SYS>>"                  role system
          | "[INST] " text " [/INST]"                  role user
          | " " text " </s>"                           role assistant
          | "[ROLE]" role "[/ROLE]" text "[/TURN]"     any other role

Escaping is reversible: inside a text, a control string with k back-slashes
after its first character (``[\\INST]``) gets one more; reading takes one
away. A turn is first rendered as it is and read again by the parser; only
where the recovered turn differs from the source are its conflicting control
strings escaped, once more each time, until it is identical.

Rendering is done where the rows lie. Only then are turns sorted by
(conversation, turn), and every conversation's whole text is parsed again: the
reader is fed the text as a stream of pieces, whose ends it doesn't regard, and
every turn it recovers is held against the source; a difference is an error.
It keeps no more than the turn that has not ended, so a conversation of any
length takes bounded memory; as its digests are chains over its turns, it is
read by one task. Defined results: a null
text or role counts as empty; rows with a null conv_id form one conversation
with that id; turns that tie are ordered by role, then text; repeated rows are
turns each; a null turn comes first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.shared import pick, texts

BEGIN = "<s>"
CONTROL = r"/?INST\]|/?ROLE\]|/TURN\]|/?s>|</?SYS>>"
_RAW = re.compile(rf"([\[<])(\\*)({CONTROL})")
_ESCAPED = re.compile(rf"([\[<])\\(\\*)({CONTROL})")
#: Opening and closing mark by role; any other role is named in the text.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
NAMED = ("[ROLE]", "[/ROLE]", "[/TURN]")


def escape(text: str) -> str:
    return _RAW.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class Unfinished(ValueError):
    """The text ends before the turn does."""


def _until(text: str, mark: str, at: int) -> tuple[str, int]:
    end = text.find(mark, at)
    if end < 0:
        raise Unfinished(f"no {mark!r} after character {at}")
    return text[at:end], end + len(mark)


def _turn(text: str, at: int) -> tuple[tuple[str, str], int]:
    """The turn that begins at a place, and the place after it."""
    for role, (left, right) in MARKS.items():
        if text.startswith(left, at):
            # A control string that opens anything inside a text would make it ambiguous.
            body, at = _until(text, right, at + len(left))
            return (role, unescape(_sound(body))), at
    if text.startswith(NAMED[0], at):
        name, at = _until(text, NAMED[1], at + len(NAMED[0]))
        body, at = _until(text, NAMED[2], at)
        return (unescape(_sound(name)), unescape(_sound(body))), at
    if any(x.startswith(text[at:]) for x in (*(m[0] for m in MARKS.values()), NAMED[0])):
        raise Unfinished(f"no whole mark at character {at}")
    raise ValueError(f"no turn begins at character {at}")


def parse(text: str, at: int = 0) -> list[tuple[str, str]]:
    """The turns of a rendered string, by the grammar; ValueError if it isn't one."""
    turns = []
    while at < len(text):
        found, at = _turn(text, at)
        turns.append(found)
    return turns


class Reader:
    """The grammar over a text that comes in pieces, wherever they are cut."""

    def __init__(self) -> None:
        self.rest, self.begun = "", False

    def feed(self, piece: str) -> list[tuple[str, str]]:
        """The turns that end within this piece."""
        self.rest += piece
        if not self.begun:
            if len(self.rest) < len(BEGIN):
                return []
            if not self.rest.startswith(BEGIN):
                raise ValueError("a conversation begins with its mark")
            self.begun, self.rest = True, self.rest[len(BEGIN) :]
        turns, at = [], 0
        while at < len(self.rest):
            try:
                found, at = _turn(self.rest, at)
            except Unfinished:
                break
            turns.append(found)
        self.rest = self.rest[at:]
        return turns

    def close(self) -> None:
        if self.rest or not self.begun:
            raise ValueError("a conversation ends within a turn")


def _sound(text: str) -> str:
    if any(not m[2] for m in _RAW.finditer(text)):
        raise ValueError("a raw control string inside a text")
    return text


def render_turn(role: str, text: str) -> str:
    """The turn as it stands if that reads back, else with its control strings escaped."""
    name, body = role, text
    while True:
        left, right = MARKS.get(role, (f"{NAMED[0]}{name}{NAMED[1]}", NAMED[2]))
        out = f"{left}{body}{right}"
        try:
            if parse(out) == [(role, text)]:
                return out
        except ValueError:
            pass
        name, body = escape(name), escape(body)


RENDERED = "conv_id long, turn long, role string, text string, rendered string, loss_start int, loss_length int"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def loss_span(role: str, rendered: str) -> tuple[int, int]:
    """First character and length, in the rendered turn, of what is learned from: an assistant's text."""
    if role != "assistant":
        return 0, 0
    left, right = MARKS[role]
    return len(left), len(rendered) - len(left) - len(right)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
        roles, said = ([x or "" for x in batch.column(i).to_pylist()] for i in (2, 3))
        rendered = list(map(render_turn, roles, said))
        spans = list(map(loss_span, roles, rendered))
        columns = [batch.column(0), batch.column(1), *[pa.array(x, pa.string()) for x in (roles, said, rendered)], *[pa.array([s[i] for s in spans], pa.int32()) for i in (0, 1)]]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "text", "rendered", "loss_start", "loss_length"])


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, rendered, loss_start, loss_length: each turn with its rendered segment.

    A conversation's formatted text is BEGIN and its segments by (turn, role,
    text); the loss mask covers the span of a segment that starts at loss_start.
    """
    table = texts(turns, "conv_id", "turn", "role", "text")
    return table.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(_render, RENDERED)


class _Conversation:
    def __init__(self, conv: int | None):
        self.conv, self.reader, self.due, self.n, self.chars = conv, Reader(), [], 0, 0
        self.turns, self.loss, self.size = hashlib.sha256(), hashlib.sha256(), 0
        self.add(BEGIN)

    def add(self, piece: str) -> None:
        self.size += len(piece)
        for role, text in self.reader.feed(piece):
            self.n += 1
            if (role, text) != (source := self.due.pop(0)):
                raise ValueError(f"conversation {self.conv}, turn {self.n}: read back {role!r} where {source[0]!r} was written, or another text")
            self.turns.update(f"{role}\n{text}\n".encode())

    def turn(self, role: str, text: str, segment: str, start: int, length: int) -> None:
        self.due.append((role, text))
        self.add(segment)
        learned = unescape(segment[start : start + length])
        self.chars += len(learned)
        self.loss.update(learned.encode())

    def row(self) -> tuple:
        self.reader.close()
        if self.due:
            raise ValueError(f"conversation {self.conv}: {len(self.due)} turns were not read back")
        return self.conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.size


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: _Conversation | None = None

    for batch in batches:
        done = []
        for at in range(0, batch.num_rows, 256):
            for conv, *turn in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                if held is None or held.conv != conv:
                    if held is not None:
                        done.append(held.row())
                    held = _Conversation(conv)
                held.turn(*turn)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _READ, strict=True)], schema=_READ)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(held.row(), _READ, strict=True)], schema=_READ)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the parser finds in each conversation's whole rendered text; ValueError unless it is the source."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return texts(ordered, "conv_id", "role", "text", "rendered", "loss_start", "loss_length").mapInArrow(_read, READ)


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    table = pick(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    clash = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(clash).alias("text"))
    return read_back(format_turns(table.unionByName(extra)))


# The marks' lengths are those of MARKS and NAMED; a conflicting text or role is escaped once,
# and one that holds an escaped control string reads back differently, so it is escaped as well.
_CONTROL_SQL = r"/?INST\]|/?ROLE\]|/TURN\]|/?s>|</?SYS>>"
OP1_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(regexp_replace(text, '([\[<])(\\*)({_CONTROL_SQL})', '\1\\\2\3', 'g'))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6
      ELSE 20 + length(regexp_replace(role, '([\[<])(\\*)({_CONTROL_SQL})', '\1\\\2\3', 'g')) END AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
