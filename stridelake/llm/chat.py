"""Chat formatting from event logs.

An event log has rows (conv_id, turn, seq, event, role, text). Events of one turn, in the order of seq, fold into its final message:
  message     a whole message; each opens a message of its own
  delta       more text of the message opened last in the turn (opens one if none is)
  edit        replaces that message's text
  regenerate  clears it, for the deltas that follow
  retract     takes it away
Other events, null among them, say nothing and are passed over; so are edits and the like in a turn without an open message.
The log is partitioned by ranges of (conv_id, turn) and sorted by sequence, so that one long conversation is dealt over many
tasks and yet no turn is split; each task folds and renders its run of turns as segments of bounded size. What reads a whole
conversation (its digest) takes the segments, in order, as a stream, and never holds it whole.

Template: <|im_start|>role\\ntext<|im_end|>\\n for each turn. Inside roles and texts a backslash is put after the < of any
"<", backslashes, "|"; taking one away again restores the text, so that no text can open or close a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Characters of a segment after which a new one begins.
SEGMENT_CHARS = 1 << 20
ASSISTANT = "assistant"
EVENTS = ("message", "delta", "edit", "regenerate", "retract")
SEGMENT_SCHEMA = "conv_id long, first_turn long, part long, formatted string, loss_spans array<long>"

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escaped(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escaped_role(role: str) -> str:
    """A role stands on one line: line feeds in it are written as \\n, backslashes doubled."""
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and the span of its text in it."""
    head = f"{OPEN}{escaped_role(role)}\n"
    body = escaped(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + r"\n", re.DOTALL)


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a formatted turn at {at}")
        yield unescaped_role(m[1]), unescaped(m[2])
        at = m.end()


def fold(events: Iterator[tuple]) -> Iterator[tuple[int | None, int | None, str, str]]:
    """Final messages (conv_id, turn, role, text) of events in order (conv_id, turn, event, role, text); holds one turn."""
    where, held = None, []
    for conv, turn, event, role, text in events:
        if (conv, turn) != where:
            yield from ((*where, r, "".join(t)) for r, t in held if t is not None)  # type: ignore[misc]
            where, held = (conv, turn), []
        if event not in EVENTS:
            continue
        if event == "message" or event == "delta" and (not held or held[-1][1] is None):
            held.append((role or "", [text or ""]))
        elif held and held[-1][1] is not None:
            if event == "delta":
                held[-1][1].append(text or "")
            else:
                held[-1] = (held[-1][0], {"edit": [text or ""], "regenerate": [], "retract": None}[event])
    if where is not None:
        yield from ((*where, r, "".join(t)) for r, t in held if t is not None)


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of whole messages (conv_id, turn, role, text) as an event log; of rows with equal turns, role and text decide."""
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.lit(0).cast("long").alias("seq"), F.lit("message").alias("event"), "role", "text")


def as_streamed(conversations: DataFrame) -> DataFrame:
    """The same table as a log of how its messages may have come about: an assistant's text as a draft that is regenerated and two
    deltas, another's as a first version that is edited. It folds to the messages of as_events()."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    event = lambda seq, name, text: F.struct(F.lit(seq).alias("at"), F.lit(name).alias("event"), text.alias("text"))
    open_, end = F.lit(1), F.length(text)
    spoken = F.array(event(0, "message", F.substr(text, half + 1, end)), event(1, "regenerate", F.lit("")), event(2, "delta", F.substr(text, open_, half)), event(3, "delta", F.substr(text, half + 1, end)))
    typed = F.array(event(0, "message", F.substr(text, open_, half)), event(1, "edit", text))
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").withColumn("_n", nth)
    rows = rows.select("conv_id", "turn", "_n", "role", F.explode(F.when(F.col("role") == ASSISTANT, spoken).otherwise(typed)).alias("e"))
    return rows.select("conv_id", "turn", (F.col("_n") * 4 + F.col("e.at")).cast("long").alias("seq"), "e.event", "role", F.col("e.text").alias("text"))


def format_chats(events: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Segments (conv_id, first_turn, part, formatted, loss_spans) of the formatted conversations; put in order of
    (first_turn, part) and joined they are the conversation's text. loss_spans: [first, end) places in code points, flat, of
    the assistant's texts within the segment.

    Null texts and roles are empty; a null conv_id is a conversation, a null turn comes first. A conversation whose
    turns are all retracted has no segment, an empty log none at all. A turn is never cut, so a segment is as long as its
    longest turn at least."""
    order = ["conv_id", "turn", "seq", "role", "text"]
    dealt = events.select("conv_id", "turn", "seq", "event", "role", "text").repartitionByRange("conv_id", "turn").sortWithinPartitions(*order)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "event", "role", "text")), strict=True))
        conv, first, part, pieces, spans, size = None, None, 0, [], [], 0

        def segment() -> pa.RecordBatch:
            values = [[conv], [first], [part], ["".join(pieces)], [spans]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["conv_id", "first_turn", "part", "formatted", "loss_spans"])

        for own, turn, role, text in fold(rows):
            if pieces and (own != conv or size >= segment_chars):
                yield segment()
                part = part + 1 if own == conv else 0
                pieces, spans, size = [], [], 0
            if not pieces:
                conv, first = own, turn
            shown, a, b = rendered(role, text)
            if role == ASSISTANT:
                spans += [size + a, size + b]
            pieces.append(shown)
            size += len(shown)
        if pieces:
            yield segment()

    return dealt.mapInArrow(render, SEGMENT_SCHEMA)


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(segments: DataFrame) -> DataFrame:
    """What each conversation says, read back from its segments: counts and SHA-256 digests, kept as running state over the
    segments in order. Only segments are shuffled, and a task holds one at a time."""
    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn", "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, conv, state = [], None, None

        def close() -> None:
            if state is not None:
                done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch() -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            for own, formatted, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                if state is None or own != conv:
                    close()
                    conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for first, end in zip(spans[::2], spans[1::2], strict=True):
                    text = unescaped(formatted[first:end])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
            if len(done) >= 10_000:
                yield batch()
                done = []
        close()
        yield batch()

    return dealt.mapInArrow(read, DIGEST_SCHEMA)
