"""Chat formatting by event-sourced reconstruction.

A log holds what happened to conversations, in any order: messages open, grow by
streamed deltas, are edited and regenerated.  It is dealt by conversation (a
long one by blocks of 256 messages, so that no task holds a conversation of a
third of all rows), sorted by sequence, and folded event by event into final
messages; a task holds no more than one block.  Blocks are rendered by a
template whose control strings are escaped inside texts, with the spans that a
loss is taken over, and written as a table.

``digests`` reads that table back: it parses the marks, takes the escapes away
and hashes what it finds.  A hash over a conversation is sequential, so one of
several blocks is streamed in order through one task, which holds one block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import fresh, lean, written

#: 2 to this many messages of a conversation are folded and rendered together.
BLOCK_BITS = 8
#: Code points in a streamed delta of ``events``.
DELTA = 400
#: Characters of rendered text in a batch of rows.
BATCH_CHARS = 1 << 20

OPEN, DELTAS, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"
BLOCKS = "conv_id long, block long, formatted string, loss array<struct<start:long,stop:long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass(frozen=True)
class Template:
    """What stands before and after a turn, by role; ``other`` also names its role.

    Every mark holds a control string: a bracket and a tail of ``TAILS``.  Inside a
    text a backslash goes between the two (one more, where there are some already),
    so no text holds a control string, and taking one away gives the text again.
    """

    marks: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>\n"), ("user", "[INST] ", " [/INST]"), ("assistant", "<s> ", "</s>\n"))
    other: tuple[str, str, str] = ("[ROLE]", "[:]", "[/ROLE]\n")
    learned: frozenset[str] = frozenset({"assistant"})

    TAILS = r"(?:s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE\]|/ROLE\]|:\])"

    def escape(self, text: str) -> str:
        return _PLAIN.sub(r"\\\g<0>", text) if "[" in text or "<" in text else text

    def unescape(self, text: str) -> str:
        return _ESCAPED.sub(r"\1", text) if "\\" in text else text

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """(rendered, start, stop): the turn, and where its escaped text lies in it."""
        body = self.escape(text)
        for r, a, b in self.marks:
            if r == role:
                return a + body + b, len(a), len(a) + len(body)
        head = self.other[0] + self.escape(role) + self.other[1]
        return head + body + self.other[2], len(head), len(head) + len(body)

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn, as ``turn`` got them."""
        at = 0
        while at < len(formatted):
            for role, a, b in self.marks:
                if formatted.startswith(a, at):
                    break
            else:
                a, middle, b = self.other
                if not formatted.startswith(a, at):
                    raise ValueError(f"no turn begins at {at}")
                stop = formatted.index(middle, at + len(a))
                role = self.unescape(formatted[at + len(a) : stop])
                at = stop + len(middle) - len(a)
            stop = formatted.index(b.strip(), at + len(a)) - (len(b) - len(b.lstrip()))
            yield role, self.unescape(formatted[at + len(a) : stop])
            at = stop + len(b)


#: Between a bracket and a tail: what an escape stands before, and an escape with what follows it.
_PLAIN = re.compile(r"(?<=[<\[])\\*(?=" + Template.TAILS + ")")
_ESCAPED = re.compile(r"(?<=[<\[])\\(\\*)(?=" + Template.TAILS + ")")


def events(conversations: DataFrame) -> DataFrame:
    """The log of a table of finished turns (conv_id, turn, role, text), as a chat service would have written it.

    An assistant's text streams in as deltas, every fourth after a first try that was regenerated; of the others' texts every third was
    first sent cut short and then edited.  ``message`` is the turn; ``stream`` tells apart rows of one turn, in an order by role and text's
    hash; rows that agree in all of these are as many messages.  Nulls: a role and a text are empty, an id and a turn stay null (and come first).
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    event = lambda kind, what, of=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if of is None else of).alias("role"), what.alias("text"))
    none = F.lit(None).cast("string")
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    deltas = F.transform(pieces, lambda p: event(DELTAS, p))
    first = F.slice(pieces, 1, 1)
    luck = F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    streamed = F.when(luck % 4 == 0, F.concat(F.transform(first, lambda p: event(DELTAS, p)), F.array(event(REGENERATE, none)), deltas)).otherwise(deltas)
    typed = F.when(luck % 3 == 0, F.concat(F.transform(first, lambda p: event(DELTAS, p)), F.array(event(EDIT, text)))).otherwise(F.array(event(DELTAS, text)))
    stream = F.format_string("%016x-%016x", F.xxhash64(role, text), F.monotonically_increasing_id())
    found = conversations.select("conv_id", F.col("turn").cast("long").alias("message"), stream.alias("stream"), F.concat(F.array(event(OPEN, none, role)), F.when(role == "assistant", streamed).otherwise(typed)).alias("_events"))
    return found.select("conv_id", "message", "stream", F.posexplode("_events").alias("seq", "_e")).select("conv_id", "message", "stream", F.col("seq").cast("long").alias("seq"), "_e.kind", "_e.role", "_e.text")


class _Folded:
    """One message as events make it; the sorted log gives them one by one."""

    def __init__(self):
        self.role, self.parts, self.seen = "", [], None

    def take(self, kind: str, role: str | None, text: str | None, seq: int | None) -> None:
        if (event := (seq, kind, role, text)) == self.seen:
            return  # delivered again
        self.seen = event
        if kind == OPEN:
            self.role = role or ""
        elif kind == DELTAS:
            self.parts.append(text or "")
        elif kind == EDIT:
            self.parts = [text or ""]
        elif kind == REGENERATE:
            self.parts = []
        else:
            raise ValueError(f"no such event: {kind}")


def fold(log: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, block, formatted, loss): the log's final messages, rendered by blocks of conversations.

    ``log``: conv_id, message (its place in the conversation), stream (who wrote the message), seq, kind, role, text; more columns are
    ignored.  An event that comes twice counts once.  A null kind is an error; other nulls are empty, and sort first.  ``loss`` holds
    the spans of code points, within ``formatted``, of the escaped texts of learned roles.  No events: no rows.
    """
    columns = ["conv_id", "message", "stream", "seq", "kind", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        chars, block, key, message = 0, None, None, None
        out: list[str] = []
        loss: list[dict] = []
        at = 0

        def done() -> None:
            nonlocal at
            if message is not None:
                rendered, start, stop = template.turn(message.role, "".join(message.parts))
                if message.role in template.learned:
                    loss.append({"start": at + start, "stop": at + stop})
                out.append(rendered)
                at += len(rendered)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names=["conv_id", "block", "formatted", "loss"])
            rows.clear()
            return batch

        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in ("conv_id", "block", "message", "stream", "seq", "kind", "role", "text")]
            for conv, number, place, stream, seq, kind, role, text in zip(*lists):
                if (conv, number, place, stream) != key:
                    done()
                    if (conv, number) != block:
                        if block is not None:
                            rows.append((*block, "".join(out), loss))
                            chars += at
                        block, out, loss, at = (conv, number), [], [], 0
                        if chars > BATCH_CHARS:
                            yield flush()
                            chars = 0
                    key, message = (conv, number, place, stream), _Folded()
                message.take(kind, role, text, seq)
        done()
        if block is not None:
            rows.append((*block, "".join(out), loss))
        if rows:
            yield flush()

    dealt = log.select(*columns).withColumn("block", F.shiftright("message", BLOCK_BITS)).select("conv_id", "block", *columns[1:])
    ordered = dealt.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "message", "stream", "seq", "kind", "role", "text")
    return ordered.mapInArrow(lean(run), BLOCKS)


def format_chats(log: DataFrame, template: Template = Template()) -> DataFrame:
    """The blocks of ``fold``, as a table of the shared folder.  A conversation's text is that of its blocks in order (none first)."""
    return written(fold(log, template), "chats")


def _digested(template: Template):
    """Rows of blocks, each conversation's in a row and in order, to a row of digests each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        none = object()
        conv, state = none, None

        def done() -> None:
            if conv is not none:
                turns, learned, n, n_learned, chars = state
                rows.append((conv, n, turns.hexdigest(), n_learned, learned.hexdigest(), chars))

        for batch in batches:
            for key, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if conv is none or key != conv:
                    done()
                    conv, state = key, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, text in template.turns(formatted):
                    state[0].update(f"{role}\n{text}\n".encode())
                    state[2] += 1
                for span in loss:
                    text = template.unescape(formatted[span["start"] : span["stop"]])
                    state[1].update(text.encode())
                    state[3] += len(text)
                state[4] += len(formatted)
            if len(rows) > 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], _SCHEMA)
                rows.clear()
        done()
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], _SCHEMA)

    return run


_NAMES = [f.split()[0] for f in DIGESTS.split(", ")]
_SCHEMA = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in _NAMES])


def digests(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """A row a conversation, read back from ``format_chats``: its turns, what is learned from, and the length of its text.

    Conversations of one block are read where they lie; only longer ones are shuffled, of which the ids are found first.
    """
    name = fresh()
    long = written(chats.groupBy(F.col("conv_id").alias(name)).agg(F.count("*").alias("n")).filter("n > 1").select(name), "long-chats")
    same = F.col("conv_id").eqNullSafe(F.col(name))
    whole = chats.join(long, same, "left_anti").select("conv_id", "formatted", "loss").mapInArrow(lean(_digested(template)), DIGESTS)
    parted = chats.join(long, same, "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return whole.unionByName(parted.select("conv_id", "formatted", "loss").mapInArrow(lean(_digested(template)), DIGESTS))


def chat_digests(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """All conversations, through their logs, formatted, and read back."""
    return digests(format_chats(events(conversations), template), template)
