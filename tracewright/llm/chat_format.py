"""Chat formatting: conversations to text segments with loss flags, by a template, and back.

A template declares, as plain values, what stands before and after a turn of each role, which roles are learned, and
a finite-state machine over roles: which role may follow in which state, and where a conversation may end. The turns of a
conversation go through the machine in order; each step emits the turn's segments, what opens it, its text, what
closes it, each with its loss flag, the state after it, and whether the machine broke there. Roles that the
template does not name are formatted too, by their name, and break the machine.

Inside texts every backslash and every control string of the template gets a backslash in front, so an output has
control strings without one only where the template put them. ``read_back`` follows the same marks: it tokenises the
joined segments, whatever their borders, takes the backslashes away, and gathers what the loss flags cover.

Turns are dealt by conversation and sorted within their partitions, once; both passes stream, and hold one batch and one
turn, however long a conversation is. A conversation stays in one task, as its order and its digests are sequential.

Defined results
  null text or role: empty. Null conversation: one of its own. Null turns come first.
  ties of turn, and repeated rows: all stay, in the order of role and text. Very long texts: whole.
  A conversation in an order that the machine does not take is formatted like any other; ``first_fault`` tells the turn.
  Empty table: empty result. Extra columns do not return, as rows are segments or conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import load, map_arrow, quoted, small_batches


class Turn(NamedTuple):
    """What opens a role's turn, and whether its text, and what closes it, are learned."""

    opens: str
    learn: bool = False
    learn_close: bool = False


class Template(NamedTuple):
    """``moves`` has, for each state, the state after each role that may come; ``other`` opens a turn of a role without entry, around its name."""

    turns: dict[str, Turn]
    moves: dict[str, dict[str, str]]
    ends: tuple[str, ...]
    begin: str = "begin"
    other: tuple[str, str] = ("### Turn of ", "</name>")
    close: str = "</turn>"
    gap: str = "\n"


#: An optional system turn, then user and assistant by turns.
DEFAULT = Template(
    turns={"system": Turn("### System: "), "user": Turn("### User: "), "assistant": Turn("### Assistant: ", learn=True)},
    moves={"begin": {"system": "briefed", "user": "asked"}, "briefed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    ends=("answered",),
)
#: The state of a machine that got a role it does not take.
BROKEN = "broken"
SEGMENTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("loss", T.BooleanType())]))
ARROW_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


class Marks:
    """A template's control strings, ready to escape texts and to read them."""

    def __init__(self, template: Template) -> None:
        self.template = template
        self.controls = [*[t.opens for t in template.turns.values()], *template.other, template.close]
        for i, a in enumerate(self.controls):
            for j, b in enumerate(self.controls):
                overlap = any(a[k:] == b[: len(a) - k] for k in range(1, len(a))) or (i != j and a in b)
                if not a or "\\" in a or overlap:
                    raise ValueError(f"control strings overlap, or hold a backslash: {a!r}, {b!r}")
        if "\\" in template.gap or any(c in template.gap for c in self.controls):
            raise ValueError("the gap holds a control string")
        either = "|".join(map(re.escape, self.controls))
        self.inside = re.compile(rf"\\|{either}")
        self.mark = re.compile(rf"(?s)\\.|({either})")
        self.role_of = {t.opens: role for role, t in template.turns.items()}

    def escape(self, text: str) -> str:
        return self.inside.sub(lambda m: "\\" + m[0], text)

    def segments(self, role: str, text: str) -> list[dict]:
        t = self.template
        turn = t.turns.get(role) or Turn(self.escape(role).join(t.other))
        said = [(turn.opens, False), (self.escape(text), turn.learn), (t.close, turn.learn_close), (t.gap, False)]
        return [{"text": x, "loss": loss} for x, loss in said]

    def read(self, text: str) -> tuple[list[tuple[str, str]], str]:
        """The whole turns that ``text`` begins with, as (role, text), and the rest."""
        t, turns, at = self.template, [], 0
        begin, role = 0, None
        for m in self.mark.finditer(text):
            if m[1] is None:
                continue
            if role is None and m[1] in self.role_of:
                role, begin = self.role_of[m[1]], m.end()
            elif role is None and m[1] == t.other[0]:
                begin, role = m.end(), ""
                named = False
            elif m[1] == t.other[1] and role == "" and not named:
                role, begin, named = unescaped(text[begin : m.start()]), m.end(), True
            elif m[1] == t.close and role is not None:
                turns.append((role, unescaped(text[begin : m.start()])))
                role, at = None, m.end() + len(t.gap)
            else:
                raise ValueError(f"a control string out of place: {m[1]!r}")
        return turns, text[at:]


def unescaped(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def format_chats(df: DataFrame, template: Template = DEFAULT, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per turn, (conversation, place from 0, segments, state, fault), sorted within partitions that hold whole conversations."""
    marks = Marks(template)
    small_batches(df.sparkSession)
    empty = lambda c: F.coalesce(quoted(c).cast("string"), F.lit("")).alias(c)
    rows = df.select(quoted(conversation).alias("conv"), quoted(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").drop("turn")
    kind = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField(conversation, kind), T.StructField("place", T.LongType()), T.StructField("segments", SEGMENTS), T.StructField("state", T.StringType()), T.StructField("fault", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place, state = object(), 0, template.begin
        for batch in batches:
            convs, roles, texts = batch.columns
            made = []
            for conv, r, t in zip(convs.to_pylist(), roles.to_pylist(), texts.to_pylist(), strict=True):
                if conv != last:
                    last, place, state = conv, 0, template.begin
                after = template.moves.get(state, {}).get(r, BROKEN)
                made.append((place, marks.segments(r, t), after, after == BROKEN and state != BROKEN))
                place, state = place + 1, after
            columns = list(zip(*made, strict=True)) or [[], [], [], []]
            arrays = [pa.array(c, k) for c, k in zip(columns, [pa.int64(), ARROW_SEGMENTS, pa.string(), pa.bool_()], strict=True)]
            yield pa.RecordBatch.from_arrays([convs, *arrays], names=[f"c{i}" for i in range(len(schema))])

    return map_arrow(rows, run, schema)


def read_back(formatted: DataFrame, template: Template = DEFAULT, in_order: bool = False) -> DataFrame:
    """A row per conversation, from the segments of ``format_chats``: n_turns, a digest of what they say, and the digest and code points of what is learned.

    ``in_order``: the rows come as ``format_chats`` leaves them; else they are dealt and sorted again. ``complete``: the
    machine never broke and ended where it may. A text that ends within a turn is an error.
    """
    marks = Marks(template)
    conversation = formatted.columns[0]
    rows = formatted.select(quoted(conversation).alias("conv"), "place", "segments", "state", "fault")
    rows = rows if in_order else rows.repartition("conv").sortWithinPartitions("conv", "place")
    schema = T.StructType([
        T.StructField(conversation, rows.schema["conv"].dataType), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()), T.StructField("first_fault", T.LongType()), T.StructField("complete", T.BooleanType()),
    ])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    class Reading:
        def __init__(self) -> None:
            self.turns = self.loss_chars = self.chars = 0
            self.said, self.learned = hashlib.sha256(), hashlib.sha256()
            self.rest, self.fault, self.state = "", None, template.begin

        def take(self, place: int, segments: list[dict], state: str, fault: bool) -> None:
            whole = "".join(s["text"] for s in segments)
            turns, self.rest = marks.read(self.rest + whole)
            for role, text in turns:
                self.said.update(f"{role}\n{text}\n".encode())
            for s in segments:
                if s["loss"]:
                    text = unescaped(s["text"])
                    self.learned.update(text.encode())
                    self.loss_chars += len(text)
            self.turns, self.chars, self.state = self.turns + len(turns), self.chars + len(whole), state
            self.fault = place if fault and self.fault is None else self.fault

        def row(self) -> tuple:
            if self.rest:
                raise ValueError("a conversation's text ends within a turn")
            return self.turns, self.said.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars, self.fault, self.fault is None and self.state in template.ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reading, kind = None, None, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * (len(kinds) + 1)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *kinds], strict=True)], names=[f"c{i}" for i in range(len(schema))])

        for batch in batches:
            kind, done = batch.column(0).type, []
            for conv, *what in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reading is None or conv != last:
                    if reading is not None:
                        done.append((last, *reading.row()))
                    last, reading = conv, Reading()
                reading.take(*what)
            yield out(done)
        if reading is not None:
            yield out([(last, *reading.row())])

    return map_arrow(rows, run, schema)


def assembled(formatted: DataFrame) -> DataFrame:
    """A row per conversation with its whole text and the code points (start, end) of it that are learned; for conversations that fit a row."""
    conversation = formatted.columns[0]
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "segments"))), lambda x: x["segments"]))
    one = formatted.groupBy(quoted(conversation)).agg(ordered.alias("s"))
    span = "array<struct<start:bigint,end:bigint>>"
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(span).alias("out"))

    def step(acc, s):
        end = acc["at"] + F.length(s["text"])
        return F.struct(end.alias("at"), F.when(s["loss"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))).otherwise(acc["out"]).alias("out"))

    return one.select(quoted(conversation), F.array_join(F.transform("s", lambda x: x["text"]), "").alias("formatted"), F.aggregate("s", begin, step, lambda acc: acc["out"]).alias("loss_spans"))


#: The contract's further conversation: both its turns say this.
ADDED = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED).alias("text"))
    return read_back(format_chats(rows.unionByName(more)), in_order=True)


ORACLE = r"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n as (select *, row_number() over w - 1 as place, coalesce(lag(role) over w, '') as before, row_number() over (partition by conv_id order by turn desc, role desc, text desc) = 1 as final from r window w as (partition by conv_id order by turn, role, text)),
e as (select *, (before, role) in (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) as fine,
  length(text) + length(regexp_replace(text, '\\|### System: |### User: |### Assistant: |### Turn of |</name>|</turn>', '@', 'g')) - length(regexp_replace(text, '\\|### System: |### User: |### Assistant: |### Turn of |</name>|</turn>', '', 'g'))
  + case role when 'system' then 12 when 'user' then 10 when 'assistant' then 15 else 19 + length(role) end + 8 as chars from n)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars, min(place) filter (not fine) as first_fault, bool_and(fine) and max(role) filter (final) = 'assistant' as complete
from e group by conv_id
"""
