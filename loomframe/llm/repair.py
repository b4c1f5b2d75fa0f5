"""Repair of conversation structure: the cheapest edits that make the roles of a conversation read (s?(ua)+)?.

A conversation's rows in order and the four states of that pattern span an acyclic graph: node (i, q) stands before row i in
state q; an arc keeps, reroles or deletes the row and leads to i + 1, or inserts a row and stays at i. Forward and backward
minimum costs identify the tight arcs, those on some cheapest path. From the start a frontier of nodes then follows, at
each step, the least letter of a tight arc out of it (D, I, K, R), so that ties go to the least string of letters.

Conversations of any length: rows are numbered along their conversation and cut into blocks. Each block gives its 4 x 4
matrix of least costs; the matrices of a conversation, one a block, are carried forwards and backwards; each block then
finds its tight arcs and where each entry state leads; and the states are carried through. A task holds a block's codes of
one byte a row, or the matrices of a conversation, never its rows. Rows take part in a shuffle with their texts when they
are dealt by ranges and when the edits come back to them.

Defined results: a null role or text is one space. Null conversations are one conversation. Rows go by turn (null first),
then by role and the text's hash; repeated rows are duplicates. A role's initial is its first code point, and an empty role
has none. The rows are to be a scan or a written table (or rows made from one without a shuffle), as repeated ones are
told apart by their place. Texts of any length are taken whole; an empty table gives no rows; columns that aren't named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import BLANKS, cut, to_python
from loomframe.operators.ordered import AT, numbered, pieces

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Codes of a row are 3 * initial + fault. Faults: none, blank or duplicate, truncated.
INITIALS, FINE, BARRED, CUT_OFF = "sua", 0, 1, 2
#: States of (s?(ua)+)?: nothing yet, behind s, behind u, behind a; what state each wants next, and the role that leads there.
WANTS, NAMES = (2, 2, 3, 2), {2: "user", 3: "assistant"}
NEVER = 1 << 60
START, END = (0, NEVER, NEVER, NEVER), (0, 2 * INSERT, INSERT, 0)


@lru_cache(None)
def arcs(state: int, code: int) -> tuple[tuple[str, int, int], ...]:
    """letter, next state and cost of what can become of a row."""
    initial, fault = divmod(code, 3)
    out = [("D", state, DELETE)]
    if fault != BARRED:
        more = TRUNCATED if fault == CUT_OFF else 0
        if initial < 3 and (initial == 0 and state == 0 or initial == WANTS[state] - 1):
            out.append(("K", initial + 1, more))
        out.append(("R", WANTS[state], REROLE + more))
    return tuple(out)


def _plus(v: tuple, d: int) -> tuple:
    return tuple(x + d if x < NEVER else NEVER for x in v)


def _inserted(v: tuple) -> tuple:
    """Least costs of states after any insertions."""
    out = list(v)
    for q in (0, 1, 3, 2):
        out[WANTS[q]] = min(out[WANTS[q]], out[q] + INSERT)
    return tuple(min(x, NEVER) for x in out)


@lru_cache(1 << 16)
def _forward(v: tuple, code: int) -> tuple[tuple, int]:
    """From least costs before a row, with insertions, to those before the next, less their least, and that."""
    out = [NEVER] * 4
    for q, x in enumerate(v):
        for _, to, cost in arcs(q, code):
            out[to] = min(out[to], x + cost)
    out = _inserted(tuple(out))
    return _plus(out, -min(out)), min(out)


@lru_cache(1 << 16)
def _backward(v: tuple, code: int) -> tuple[tuple, int]:
    """From least costs of what follows a row to those of what follows the row before, insertions first, less their least, and that."""
    out = [min(cost + v[to] for _, to, cost in arcs(q, code)) for q in range(4)]
    for q in (2, 0, 1, 3):
        out[q] = min(out[q], INSERT + out[WANTS[q]])
    out = tuple(min(x, NEVER) for x in out)
    return _plus(out, -min(out)), min(out)


def matrix(codes: bytes) -> list[tuple]:
    """Least costs from each state before a block to each behind it."""
    rows = []
    for q in range(4):
        v, total = _inserted(tuple(0 if p == q else NEVER for p in range(4))), 0
        for code in codes:
            v, d = _forward(v, code)
            total += d
        rows.append(_plus(v, total))
    return rows


def carried(blocks: list[list[tuple]]) -> tuple[list[tuple], list[tuple], int]:
    """Least costs from the start to each block and from behind each block to the end, and that of the whole."""
    to, back = [_inserted(START)], [END]
    for m in blocks[:-1]:
        to.append(_inserted(tuple(min(min(to[-1][p] + m[p][q] for p in range(4)), NEVER) for q in range(4))))
    for m in reversed(blocks):
        back.append(tuple(min(min(m[p][q] + back[-1][q] for q in range(4)), NEVER) for p in range(4)))
    return to, back[-2::-1], min(x + y for x, y in zip(START, back[-1], strict=True))


def tight(codes: bytes, before: tuple, behind: tuple, best: int, last: bool) -> list[tuple[int, int, str]]:
    """entry, exit and letters for each state in which a cheapest path of cost `best` can enter a block."""
    forward, v, total = [], before, 0
    for code in codes:
        forward.append((v, total))
        v, d = _forward(v, code)
        total += d
    forward.append((v, total))
    low = min(behind)
    backward, v, total = [], _plus(behind, -low), low
    for code in reversed(codes):
        backward.append((v, total))
        v, d = _backward(v, code)
        total += d
    backward.append((v, total))
    backward.reverse()

    def steps(i: int, state: int) -> Iterator[tuple[str, int, int]]:
        """letter, row and state of the tight arcs out of a node."""
        here = forward[i][0][state] + forward[i][1]
        if here + INSERT + backward[i][0][WANTS[state]] + backward[i][1] == best and (last or i < len(codes)):
            yield "I", i, WANTS[state]
        if i < len(codes):
            for letter, to, cost in arcs(state, codes[i]):
                if here + cost + backward[i + 1][0][to] + backward[i + 1][1] == best:
                    yield letter, i + 1, to

    out = []
    for entry in range(4):
        if before[entry] + backward[0][0][entry] + backward[0][1] != best:
            continue
        # No letter leads from one state to two, and all nodes of a frontier have read as many rows, so it stays one node here.
        frontier, letters = {(0, entry)}, []
        while found := sorted(x for node in frontier for x in steps(*node)):
            letters.append(found[0][0])
            frontier = {(i, q) for letter, i, q in found if letter == found[0][0]}
        out.append((entry, min(frontier)[1], "".join(letters)))
    return out


def _arrow(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def _streamed(batches: Iterator[pa.RecordBatch], n_key: int, kinds) -> Iterator[tuple[tuple, Iterator[tuple], dict]]:
    """Rows of a sorted partition by their first n_key columns."""
    def rows():
        for batch in batches:
            kinds.setdefault("conv", batch.schema.field(0).type)
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    return groupby(rows(), lambda r: r[:n_key])


def _batched(rows: Iterator[tuple], kinds: dict[str, pa.DataType], names: list[str], most: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield _arrow(held, {n: kinds[n] for n in names})
            held = []
    if held:
        yield _arrow(held, {n: kinds[n] for n in names})


I64, I32 = pa.int64(), pa.int32()


def edits(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 4096) -> DataFrame:
    """Every row and every inserted one with what becomes of it: conv, at and seq (their order), edit, turn, role, text, fault, new_role.

    edit: K, R, D or I. fault: null, blank, duplicate or truncated. role and text are the row's own, and null for an
    inserted one; new_role is null for a deleted one. What is left has new_role and its own text, or none.
    """
    blank = F.lit(" ")
    own = conversations.select(F.struct(F.col(conv).alias("c")).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, blank).alias("role"), F.coalesce(text, blank).alias("text"))
    rows = pieces(own, ["conv"], ["turn", "role", F.xxhash64("text")], salted=True)
    said = F.trim(F.translate("text", BLANKS, " " * len(BLANKS)))
    place = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    initial = F.when((F.col("role") == "") | (place == 0), 3).otherwise(place - 1)
    facts = numbered(rows.withColumn("at", F.col(AT))).select(
        "conv", "at", F.col("_n").alias("n"), initial.alias("initial"), (said == "").alias("blank"), (~F.right(said, F.lit(1)).isin(".", "!", "?")).alias("open"),
        F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256).alias("same"),
    )
    facts = cut(facts)
    first = facts.groupBy("conv", "same").agg(F.min_by("at", "n").alias("at")).select("at", F.lit(True).alias("fresh"))
    fault = F.when(F.col("blank") | F.col("fresh").isNull(), BARRED).when(F.col("open"), CUT_OFF).otherwise(FINE)
    name = F.when(F.col("blank"), "blank").when(F.col("fresh").isNull(), "duplicate").when(F.col("open"), "truncated")
    coded = facts.join(first.hint("merge"), "at", "left").select("conv", F.expr(f"n div {block}").alias("block"), "n", "at", (3 * F.col("initial") + fault).cast("int").alias("code"), name.alias("fault"))
    coded = cut(coded)
    kind = rows.schema["conv"].dataType.simpleString()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"block": I64, "codes": pa.binary(), "ats": pa.list_(I64), "costs": pa.list_(I64)}

        def made():
            for key, group in _streamed(batches, 2, kinds):
                group = list(group)
                codes = bytes(r[4] for r in group)
                yield *key, codes, [r[3] for r in group], [x for row in matrix(codes) for x in row]

        yield from _batched(made(), kinds, ["conv", "block", "codes", "ats", "costs"])

    dealt = coded.select("conv", "block", "n", "at", "code").repartition("conv", "block").sortWithinPartitions("conv", "block", "n")
    runs = cut(to_python(dealt, summed, f"conv {kind}, block long, codes binary, ats array<long>, costs array<long>"))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"block": I64, "before": pa.list_(I64), "behind": pa.list_(I64), "best": I64, "last": pa.bool_()}

        def made():
            for key, group in _streamed(batches, 1, kinds):
                group = list(group)
                before, behind, best = carried([[tuple(r[2][4 * q : 4 * q + 4]) for q in range(4)] for r in group])
                for r, x, y in zip(group, before, behind, strict=True):
                    yield key[0], r[1], list(x), list(y), best, r is group[-1]

        yield from _batched(made(), kinds, ["conv", "block", "before", "behind", "best", "last"])

    costs = runs.select("conv", "block", "costs").repartition("conv").sortWithinPartitions("conv", "block")
    bounds = to_python(costs, carry, f"conv {kind}, block long, before array<long>, behind array<long>, best long, last boolean")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = pa.struct([("entry", I32), ("exit", I32), ("letters", pa.string())])
        kinds = {"block": I64, "ats": pa.list_(I64), "paths": pa.list_(path)}

        def made():
            for _, group in _streamed(batches, 2, kinds):
                for c, b, codes, ats, before, behind, best, last in group:
                    yield c, b, ats, [dict(zip(("entry", "exit", "letters"), p, strict=True)) for p in tight(codes, tuple(before), tuple(behind), best, last)]

        yield from _batched(made(), kinds, ["conv", "block", "ats", "paths"])

    bounded = runs.select("conv", "block", "codes", "ats").join(bounds.hint("merge"), ["conv", "block"]).select("conv", "block", "codes", "ats", "before", "behind", "best", "last")
    paths = cut(to_python(bounded, follow, f"conv {kind}, block long, ats array<long>, paths array<struct<entry: int, exit: int, letters: string>>"))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"block": I64, "entry": I32}

        def made():
            for key, group in _streamed(batches, 1, kinds):
                state = 0
                for _, b, ways in group:
                    yield key[0], b, state
                    state = next(w["exit"] for w in ways if w["entry"] == state)

        yield from _batched(made(), kinds, ["conv", "block", "entry"])

    ways = paths.select("conv", "block", F.transform("paths", lambda p: F.struct(p["entry"].alias("entry"), p["exit"].alias("exit"))).alias("ways"))
    entries = to_python(ways.repartition("conv").sortWithinPartitions("conv", "block"), enter, f"conv {kind}, block long, entry int")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"at": I64, "seq": I32, "edit": pa.string(), "new_role": pa.string()}

        def made():
            for _, group in _streamed(batches, 2, kinds):
                for c, _, ats, state, letters, codes in group:
                    i, seq = 0, 0
                    for letter in letters:
                        if letter == "I":
                            state = WANTS[state]
                            # Behind the last row insertions count on from it; before a row they come before its own 0.
                            yield c, ats[min(i, len(ats) - 1)], (seq + 1 if i == len(ats) else seq - 1000), letter, NAMES[state]
                            seq += 1
                            continue
                        to = next(t for x, t, _ in arcs(state, codes[i]) if x == letter)
                        yield c, ats[i], 0, letter, NAMES[to] if letter == "R" else None
                        state, i, seq = to, i + 1, 0

        yield from _batched(made(), kinds, ["conv", "at", "seq", "edit", "new_role"], 4096)

    chosen = paths.join(entries.hint("merge"), ["conv", "block"]).join(runs.select("conv", "block", "codes").hint("merge"), ["conv", "block"])
    letters = F.filter("paths", lambda p: p["entry"] == F.col("entry"))[0]["letters"]
    spelt = to_python(chosen.select("conv", "block", "ats", "entry", letters.alias("letters"), "codes"), spell, f"conv {kind}, at long, seq int, edit string, new_role string")
    real = rows.select(F.col(AT).alias("at"), "turn", "role", "text").join(coded.select("at", "fault").hint("merge"), "at").withColumn("seq", F.lit(0))
    out = spelt.join(real.hint("merge"), ["at", "seq"], "left")
    new_role = F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("new_role"))
    return out.select(F.col("conv.c").alias(conv), "at", "seq", "edit", "turn", "role", "text", "fault", new_role.alias("new_role"))


def reports(edited: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A row a conversation from edits(): gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    The digest goes over a conversation's rows in order: they stream through a task, which holds counts and the audit.
    """
    rows = edited.select(F.col(conv).alias("conv"), "at", "seq", "edit", "turn", "role", "text", "fault", "new_role").repartition("conv").sortWithinPartitions("conv", "at", "seq")
    kind = rows.schema["conv"].dataType.simpleString()
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict.fromkeys(names[1:7], I64) | dict.fromkeys(names[7:], pa.string())

        def made():
            for key, group in _streamed(batches, 1, kinds):
                faults, letters, digest, turns, low, high = {"blank": 0, "duplicate": 0, "truncated": 0}, [], hashlib.sha256(), 0, None, None
                illegal, cost, previous, some = 0, 0, None, False
                for _, _, _, edit, turn, role, text, fault, new_role in group:
                    letters.append(edit)
                    cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                    if edit != "D":
                        digest.update(f"{'\n' if some else ''}{new_role}:{text or ''}".encode())
                        some = True
                    if edit != "I":
                        if fault:
                            faults[fault] += 1
                        if turn is not None:  # in order
                            turns += turn != high
                            low, high = turn if low is None else low, turn
                        illegal += previous is not None and previous + role[:1] not in ("su", "ua", "au")
                        previous = role[:1]
                yield key[0], 0 if low is None else high - low + 1 - turns, *faults.values(), illegal, cost, "".join(letters), digest.hexdigest()

        yield from _batched(made(), kinds, names)

    schema = f"conv {kind}, {', '.join(f'{n} long' for n in names[1:7])}, audit string, repaired_sha256 string"
    return to_python(rows, run, schema).withColumnRenamed("conv", conv)


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role and text of conversations with faults by a hash of conversation and turn: of twenty rows one is lost,
    one emptied, one loses its full stops, one is doubled and one goes to the user. Nulls count as one space but in conv and turn."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col(conv).cast("string"), blank), F.coalesce(F.col(turn).cast("string"), blank)).cast("binary")) % 20
    rows = conversations.select(F.col(conv), F.col(turn), F.coalesce(role, blank).alias(role), F.coalesce(text, blank).alias(text), kind.alias("_kind")).filter("_kind <> 0")
    said = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(conv, turn, F.when(F.col("_kind") == 4, "user").otherwise(F.col(role)).alias(role), said.alias(text), copies.alias("_copy")).drop("_copy")
