"""Chat formatting: render conversations with a template that is only called, never looked into."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

#: Strings that chat formats use to mark turns.
CONTROL = ["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]
_MARKED = re.compile("|".join(rf"{re.escape(c[0])}(\\*){re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\(\\*){re.escape(c[1:])}" for c in CONTROL))


def escape(text: str) -> str:
    """Put a backslash behind the first character of each control string (one more where there are some already)."""
    return _MARKED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def _name(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unname(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_tags(turns: Turns) -> str:
    """Each turn as ``<|turn|>role``, a line end, the text, ``<|end|>`` and a line end."""
    return "".join(f"<|turn|>{_name(role)}\n{escape(text)}<|end|>\n" for role, text in turns)


def read_turn_tags(formatted: str) -> Turns:
    """The turns of an output of ``turn_tags``, unescaped."""
    out = []
    for part in formatted.split("<|end|>\n")[:-1]:
        role, _, text = part.removeprefix("<|turn|>").partition("\n")
        out.append((_unname(role), unescape(text)))
    return out


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _content(render: Template, before: Turns, role: str, output: str) -> tuple[int, int]:
    """Where the last turn's text stands in ``output``: found by rendering two other texts in its place."""
    one, two = render([*before, (role, "0")]), render([*before, (role, "1")])
    start = _common(one, two)
    return start, len(output) - (len(one) - start - 1)


def locate(render: Template, turns: Turns, segment: int | None = 32, context: int = 2) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """Output, spans and whether the template rewrites history.

    A turn's span is what its prefix's output adds to that of the prefix before; with it goes the
    span of the text itself. A prefix whose output doesn't start with that of the prefix before
    shows a template that rewrites history; then spans start where the two outputs part.

    Successive prefixes cost the square of the number of turns. So a conversation of more than
    ``segment`` turns is rendered in segments, each behind the last ``context`` turns before it, and
    the outputs of the prefixes that end with a segment are held against each other; if these part,
    or what the segments add up to isn't the output of the whole conversation, the template looks
    further back and all prefixes are rendered. What this gives up: a template that rewrites turns
    more than ``context`` back within a segment, and undoes it before the segment ends, isn't
    found out. Without a ``segment``, all prefixes are rendered at once.
    """
    whole = render(turns)
    if segment and len(turns) > segment:
        spans, before, rewrites = [], render([]), False
        added = [before]
        at = len(before)
        for first in range(0, len(turns), segment):
            now = render(turns[: first + segment])
            if not now.startswith(before):
                break
            before = now
            lead = turns[max(0, first - context) : first]
            base, got, changed = _prefixes(render, lead, turns[first : first + segment])
            rewrites |= changed
            spans += [tuple(x - base + at for x in span) for span in got[1]]
            added.append(got[0][base:])
            at += len(added[-1])
        else:
            if not rewrites and "".join(added) == whole:
                return whole, spans, False
    _, (_, spans), rewrites = _prefixes(render, [], turns)
    return whole, spans, rewrites


def _prefixes(render: Template, lead: Turns, turns: Turns) -> tuple[int, tuple[str, list[tuple[int, int, int, int]]], bool]:
    before = render(lead)
    base, spans, rewrites = len(before), [], False
    for k, (role, _) in enumerate(turns):
        done = [*lead, *turns[:k]]
        now = render([*done, turns[k]])
        start = len(before)
        if not now.startswith(before):
            rewrites, start = True, _common(before, now)
        spans.append((start, len(now), *_content(render, done, role, now)))
        before = now
    return base, (before, spans), rewrites


SCHEMA = "formatted string, spans array<struct<start:long,end:long,text_start:long,text_end:long,loss:boolean>>, n_turns long, rewrites boolean"


def format_chats(conversations: DataFrame, render: Template = turn_tags, *, loss_roles: tuple[str, ...] = ("assistant",), segment: int | None = 32) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, spans, n_turns, rewrites``.

    Rows are ordered by turn (then role and text, for ties); null roles and texts count as empty;
    null turns come first; rows with a null conv_id form one conversation; repeated rows stay.
    Spans are code-point ranges of ``formatted``, and those under the loss mask are flagged.
    Conversations reach the tasks sorted, and a task holds one of them at a time, so each must fit;
    ``segment`` is that of ``locate``.
    """
    kind = conversations.schema["conv_id"].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        turns: Turns = []
        current, some = None, False
        for conv, role, text in rows_of(batches):
            if some and conv != current:
                yield current, turns
                turns = []
            current, some = conv, True
            turns.append((role, text))
        if some:
            yield current, turns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        span = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "text_start", "text_end")] + [("loss", pa.bool_())]))
        types = [to_arrow_type(kind), pa.string(), span, pa.int64(), pa.bool_()]
        names = ["conv_id", "formatted", "spans", "n_turns", "rewrites"]
        out, size = [], 0
        for conv, turns in rows(batches):
            text, spans, rewrites = locate(render, turns, segment)
            marked = [dict(zip(("start", "end", "text_start", "text_end"), s), loss=role in loss_roles) for s, (role, _) in zip(spans, turns)]
            out.append((conv, text, marked, len(turns), rewrites))
            size += len(text)
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out), types)], names=names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out), types)], names=names)

    plain = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind.simpleString()}, {SCHEMA}")


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the loss mask, both read back from the formatted text."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for conv, text, spans, _, rewrites in zip(*(c.to_pylist() for c in batch.columns)):
                turns = read_turn_tags(text)
                said = [unescape(text[s["text_start"] : s["text_end"]]) for s in spans if s["loss"]]
                whole = "".join(f"{role}\n{words}\n" for role, words in turns)
                row = (conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest(), len(text), rewrites)
                for column, value in zip(cols, row):
                    column.append(value)
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(cols, types)], names=names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")
