"""Chat formatting with a grammar round trip.

A formatted conversation is its turns one after another. The grammar::

    conversation = turn*
    turn         = "### " role ": " text " </turn>" "\\n"

``role`` has no ``:`` and ``text`` no marker unless a backslash stands before it. Each turn is rendered as
it is, read back by the parser, and compared with its source. Where they differ, one more kind of
conflicting content is escaped (closing marks, opening marks, backslashes before those, all backslashes)
until what the parser recovers is identical. A turn is parsed together with a turn behind it, so
content that would swallow or forge a neighbour shows.

Turns are rendered where they lie; only the rendered turns are shuffled to their conversation,
sorted there, and read as a stream, so a conversation of any length needs the memory of one turn.

Defined results: null texts and roles count as empty. Null turns come last; equal turns are
ordered by role and text; repeated rows are turns of their own. Rows without a conv_id form one
conversation. Extra columns do not matter; an empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", " </turn>\n"
LEARNED_ROLE = "assistant"
#: What each level escapes by a backslash, least first. Every level holds what the one before does.
LEVELS = [None, re.compile(r"</turn>"), re.compile(r"</turn>|###"), re.compile(r"</turn>|###|\\(?=</turn>|###|\\|$)"), re.compile(r"</turn>|###|\\")]
ROLE_MARKS = re.compile(r"[\\:\n#<]")
MARK = re.compile(r"\\(.)|( </turn>\n)", re.S)
ROLE_MARK = re.compile(r"\\(.)|(: )", re.S)


class NotAConversation(ValueError):
    pass


def _read(text: str, at: int, mark: re.Pattern) -> tuple[str, int]:
    """What stands before the next bare mark, unescaped, and where the mark ends."""
    out = []
    while found := mark.search(text, at):
        out.append(text[at : found.start()])
        at = found.end()
        if found[2]:
            return "".join(out), at
        out.append(found[1])
    raise NotAConversation("a turn does not end")


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of a formatted conversation, deterministically: one token of look-ahead."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise NotAConversation(f"no turn begins at {at}")
        role, at = _read(formatted, at + len(OPEN), ROLE_MARK)
        text, at = _read(formatted, at, MARK)
        yield role, text


def _rendered(role: str, text: str, level: int) -> str:
    escape = LEVELS[level]
    inner = text if escape is None else escape.sub(lambda m: "\\" + m[0], text)
    return OPEN + ROLE_MARKS.sub(lambda m: "\\" + m[0], role) + AFTER_ROLE + inner + CLOSE


#: A turn behind the one that is tried.
NEXT = ("user", "next")
NEXT_RENDERED = _rendered(*NEXT, 0)


def render(role: str, text: str) -> tuple[str, int]:
    """The turn with the least escaping that reads back identical, and its level."""
    for level in range(len(LEVELS)):
        tried = _rendered(role, text, level)
        try:
            if list(parse(tried + NEXT_RENDERED)) == [(role, text), NEXT]:
                return tried, level
        except NotAConversation:
            pass
    raise ValueError("the last level escapes everything")


def _render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [render(r.as_py() or "", t.as_py() or "") for r, t in zip(batch.column("role"), batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"), batch.column("turn"), batch.column("role"),
                pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()),
            ],
            ["conv_id", "turn", "role", "rendered", "level"],
        )


def format_turns(conversations: DataFrame) -> DataFrame:
    """Each turn rendered, with its escaping level; a conversation's file is its turns in order."""
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(
        _render_batches, "conv_id long, turn long, role string, rendered string, level int"
    )


class _Conversation:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.formatted_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str) -> None:
        self.formatted_chars += len(rendered)
        for role, text in parse(rendered):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == LEARNED_ROLE:
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
ARROW = pa.schema(list(zip(NAMES, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])))


def _rows(done: list[_Conversation]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(NAMES, c.row())) for c in done], ARROW)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns as a stream; a conversation may go on over many batches."""
    now = None
    for batch in batches:
        done = []
        for conv_id, rendered in zip(batch.column("conv_id"), batch.column("rendered")):
            conv_id = conv_id.as_py()
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now)
                now = _Conversation(conv_id)
            now.add(rendered.as_py())
        yield _rows(done)
    if now is not None:
        yield _rows([now])


def digests(turns: DataFrame) -> DataFrame:
    """Read every conversation back from its rendered turns: counts and digests of turns and of the loss mask."""
    order = ["conv_id", F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("")), "rendered"]
    ordered = turns.repartition("conv_id").sortWithinPartitions(*order)
    return ordered.select("conv_id", "rendered").mapInArrow(_read_batches, SCHEMA)


def format_conversations(conversations: DataFrame) -> DataFrame:
    return digests(format_turns(conversations))


def loss_spans(turns: DataFrame) -> DataFrame:
    """Rendered turns with where each stands in its conversation's formatted text, and which characters of it are learned.

    ``begin`` and ``end`` are the turn's, ``loss_begin`` and ``loss_end`` those of an assistant's text as it stands there,
    escapes included; null for other roles. Code points from 0, ends exclusive. The formatted text is the
    ``rendered`` turns in order of ``begin``.
    """
    order = [F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("")), F.col("rendered")]
    size = F.length("rendered").cast("long")
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # equal turns are interchangeable, so that any order among them gives the same text
    head = F.length(F.regexp_replace(F.coalesce("role", F.lit("")), ROLE_MARKS.pattern, r"\\$0")) + len(OPEN) + len(AFTER_ROLE)
    placed = turns.withColumn("begin", F.coalesce(F.sum(size).over(before), F.lit(0)))
    learned = F.col("role") == LEARNED_ROLE
    return placed.withColumn("end", F.col("begin") + size).withColumns(
        {"loss_begin": F.when(learned, F.col("begin") + head), "loss_end": F.when(learned, F.col("end") - len(CLOSE))}
    )
