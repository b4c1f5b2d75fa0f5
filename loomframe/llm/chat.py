"""Conversations as training text: turns rendered by a chat template, each turn's place found by incremental rendering.

A template is a black box that turns a list of turns into a string. The operator renders successive prefixes of a
conversation and compares consecutive outputs: what the k-th rendering has beyond the one before is the k-th turn's span.
If a rendering doesn't begin with the one before, the template rewrites history (as those do that strip earlier answers):
`rewritten` is then the first turn whose arrival did so, and no span is given, as none would hold. Inside the span of a
turn under the loss mask the text's own place is found by a second rendering, in which a mark that the role doesn't hold
stands for the text.

A conversation is rendered whole if it has at most `turns` turns. A longer one is rendered in segments of as many; the
template is told how many turns are before a segment, so that it may begin a conversation differently, and the segments
in order are the conversation's text. So rendering prefixes is quadratic within a segment only, and a conversation of
any length is spread over tasks. What a template rewrites further back than a segment can't be seen.

Defined results: a null text or role is the empty string. Null conversations are one conversation. Turns go by number (null
first), then by role and the text's hash; repeated rows are turns each. Empty texts are turns with an empty place. Very
long texts are taken whole. The rows are to be a scan or a written table, as repeated ones are told apart by their place. Extra columns are ignored, as only those that are named are read. An empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import to_python
from loomframe.operators.ordered import numbered, pieces

Turn = tuple[str, str]


@dataclass(frozen=True)
class Template:
    """render(turns, before) with the number of turns before those; read, which turns the output into turns; and unescape of one text."""

    render: Callable[[Sequence[Turn], int], str]
    read: Callable[[str], list[Turn]]
    unescape: Callable[[str], str]


def _escaped(text: str) -> str:
    return re.sub(r"[\\<>]", r"\\\g<0>", text)


def _plain(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def _tagged(turns: Sequence[Turn], before: int) -> str:
    return "".join(f"<turn {_escaped(role)}>\n{_escaped(text)}</turn>\n" for role, text in turns)


_TAGGED = re.compile(r"(?s)<turn ([^\\>]*(?:\\.[^\\>]*)*)>\n([^\\<]*(?:\\.[^\\<]*)*)</turn>\n")


def _read_tagged(text: str) -> list[Turn]:
    out, at = [], 0
    while at < len(text):
        found = _TAGGED.match(text, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((_plain(found[1]), _plain(found[2])))
        at = found.end()
    return out


#: A tag before and behind each turn; a backslash before each backslash and angle bracket of a text, so that no text holds a tag.
TAGGED = Template(_tagged, _read_tagged, _plain)


def _headed(turns: Sequence[Turn], before: int) -> str:
    line = lambda role: role.replace("\\", "\\\\").replace("\n", "\\n")
    return "".join(f"### {line(role)}:\n" + re.sub(r"(?m)^(?=\\*###)", r"\\", text) + "\n" for role, text in turns)


def _unheaded(text: str) -> str:
    return re.sub(r"(?m)^\\(?=\\*###)", "", text)


def _read_headed(text: str) -> list[Turn]:
    role = lambda x: re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], x)
    heads = list(re.finditer(r"(?<![^\n])### (.*):\n", text))
    ends = [m.start() for m in heads[1:]] + [len(text)] * bool(heads)
    return [(role(m[1]), _unheaded(text[m.end() : end - 1])) for m, end in zip(heads, ends, strict=True)]


#: A line with the role before each turn; a backslash before each line of a text that would look like one.
HEADED = Template(_headed, _read_headed, _unheaded)


def locate(template: Template, turns: Sequence[Turn], before: int, learn: Sequence[str]) -> tuple[str, list[tuple], int | None]:
    """The rendered turns; for each its span and, if its role is in learn, its text's place; and the first turn that rewrote what stood before."""
    done, out, changed = template.render([], before), [], None
    for k, (role, text) in enumerate(turns):
        now = template.render(turns[: k + 1], before)
        if changed is None and not now.startswith(done):
            changed = k
        place = (None, None)
        if changed is None and role in learn:
            mark = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in role)
            trial = template.render([*turns[:k], (role, mark)], before)
            at = trial.find(mark, len(done))
            tail = trial[at + 1 :]
            if at >= 0 and now.startswith(trial[:at]) and now.endswith(tail) and len(now) >= at + len(tail) and template.unescape(now[at : len(now) - len(tail)]) == text:
                place = (at, len(now) - len(tail))
        out.append((len(done), len(now), *place))
        done = now
    return done, [(None,) * 4] * len(turns) if changed is not None else out, changed


_SPANS = "array<struct<begin: int, end: int, text_begin: int, text_end: int>>"


def formatted(
    conversations: DataFrame, template: Template = TAGGED, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: Sequence[str] = ("assistant",), turns: int = 64
) -> DataFrame:
    """conv, at (the number of turns before a segment), formatted, spans (of turns, in code points of formatted) and rewritten (a turn's number in the segment, or null).

    The text's place is null for roles that are not learnt, and where the template doesn't give a text back whole.
    """
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = numbered(pieces(rows, ["conv"], ["turn", "role", F.xxhash64("text")], salted=True), "n")
    rows = rows.select("conv", F.expr(f"n - n % {turns}").alias("at"), "n", "role", "text")
    kind = rows.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Turn] = []
        of = None
        place = pa.struct([(n, pa.int32()) for n in ("begin", "end", "text_begin", "text_end")])

        def segment(of: tuple) -> pa.RecordBatch:
            whole, places, changed = locate(template, held, of[1], learn)
            spans = [dict(zip(("begin", "end", "text_begin", "text_end"), p, strict=True)) for p in places]
            types = [conv_kind, pa.int64(), pa.string(), pa.list_(place), pa.int32()]
            return pa.record_batch([pa.array([x], t) for x, t in zip((*of, whole, spans, changed), types, strict=True)], ["conv", "at", "formatted", "spans", "rewritten"])

        for batch in batches:
            conv_kind = batch.schema.field(0).type
            c, at, r, t = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for key, *row in zip(zip(c, at, strict=True), r, t, strict=True):
                if held and key != of:
                    yield segment(of)
                    held = []
                of = key
                held.append(tuple(row))
        if held:
            yield segment(of)

    dealt = rows.repartition("conv", "at").sortWithinPartitions("conv", "at", "n")
    return to_python(dealt, run, f"conv {kind.simpleString()}, at long, formatted string, spans {_SPANS}, rewritten int").withColumnRenamed("conv", conv)


def digests(segments: DataFrame, template: Template = TAGGED, conv: str = "conv_id") -> DataFrame:
    """A row a conversation, read back from formatted(): conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest goes over a conversation's turns in order: its segments stream through a task that holds one of them.
    """
    rows = segments.select(F.col(conv).alias("conv"), "at", "formatted", "spans").repartition("conv").sortWithinPartitions("conv", "at")
    kind = rows.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sums = None, None
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def row() -> tuple:
            n, every, m, learnt, size = sums
            return of, n, every.hexdigest(), m, learnt.hexdigest(), size

        for batch in batches:
            done = []
            for c, text, spans in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if sums is None or c != of:
                    if sums is not None:
                        done.append(row())
                    of, sums = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in template.read(text):
                    sums[0] += 1
                    sums[1].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    if s["text_begin"] is not None:
                        said = template.unescape(text[s["text_begin"] : s["text_end"]])
                        sums[2] += len(said)
                        sums[3].update(said.encode())
                sums[4] += len(text)
            yield _digested(done, names, batch.schema.field(0).type)
        if sums is not None:
            yield _digested([row()], names, batch.schema.field(0).type)

    schema = f"conv {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return to_python(rows, run, schema).withColumnRenamed("conv", conv)


def _digested(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.record_batch([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)
