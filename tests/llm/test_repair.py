"""Conversation repair against all paths."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomframe.llm import repair

KIND = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def best(rows):
    """(cost, letters, repaired rows) of the cheapest edits by recursion over all of them; rows: (role, text, fault)."""
    @lru_cache(None)
    def go(i, state, room):
        out = [] if i < len(rows) or state not in "0a" else [(0, "", ())]
        want = "assistant" if state == "u" else "user"
        if room:
            c, x, y = go(i, want[0], room - 1)
            out.append((c + 5, "I" + x, ((want, ""), *y)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, x, y = go(i + 1, state, 2)
            out.append((c + 2, "D" + x, y))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] == want[0] or role[:1] == "s" and state == "0":
                    c, x, y = go(i + 1, role[:1], 2)
                    out.append((c + more, "K" + x, ((role, text), *y)))
                c, x, y = go(i + 1, want[0], 2)
                out.append((c + more + 1, "R" + x, ((want, text), *y)))
        return min(out, default=(10**9, "", ()))

    return go(0, "0", 2)


def damage(rows):
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k:
            x = "" if k == 1 else "".join(z for z in x if z not in ".!?") if k == 2 else x
            yield from [(c, t, "user" if k == 4 else r, x)] * (1 + (k == 3))


def plain(rows, hurt=damage):
    talks = {}
    for c, t, r, x in hurt(rows):
        talks.setdefault(c, []).append((t, r, x))
    for c in {r[0] for r in rows}:
        own = sorted(talks.get(c, []), key=lambda r: (r[0] is not None, r[0] or 0))
        seen, marked = set(), []
        for _, r, x in own:
            left = x.strip(BLANK)
            marked.append((r, x, "blank" if not left else "duplicate" if (r, x) in seen else "truncated" if left[-1] not in ".!?" else None))
            seen.add((r, x))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, kept = best(tuple(marked))
        faults = [m[2] for m in marked]
        yield c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()


CODES = st.lists(st.integers(0, 11), max_size=12)


@settings(max_examples=300, deadline=None)
@given(CODES, st.integers(1, 5))
def test_blocks_find_the_least_letters(codes, size):
    rows = tuple((("s", "u", "a", "x")[c // 3], f"{i}", (None, "blank", "truncated")[c % 3]) for i, c in enumerate(codes))
    cost, letters, _ = best(rows)
    blocks = [bytes(codes[i : i + size]) for i in range(0, len(codes), size)] or [b""]
    before, behind, least = repair.carried([repair.matrix(b) for b in blocks])
    state, got = 0, ""
    for k, b in enumerate(blocks):
        ways = {e: (x, s) for e, x, s in repair.tight(b, before[k], behind[k], least, k == len(blocks) - 1)}
        state, more = ways[state]
        got += more
    assert (least, got) == (cost, letters)


def talks(n=60, seed=3):
    r = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "s"], ["Yes.", "No!", "cut off", "", None, " \n", "A longer text.\n", "é?", "x" * 100_000 + "."]
    rows = [(c, t, r.choice(roles), r.choice(texts) if r.random() < 0.3 else f"{c} {t} said.") for c in [*range(n), None] for t in r.sample(range(12), r.randint(1, 9))]
    return rows + [(1000, None, "user", "one."), (1000, 4, "user", "two."), (1001, 2**40, "user", "far."), (1001, -(2**40), "assistant", "away.")]


@pytest.mark.parametrize("block", [2, 4096])
def test_reports(spark, rows, block):
    data = talks()
    df = spark.createDataFrame(data, KIND).withColumns({"at": F.lit(1), "block": F.lit("x"), "code": F.lit(2), "conv": F.lit(3), "_piece": F.lit(4), "fault": F.lit(5)})
    lost = {c for c, *_ in data} - {c for c, *_ in damage(data)}
    got = rows(repair.reports(repair.edits(repair.damaged(df), block=block)))
    assert got == sorted((r for r in plain(data) if r[0] not in lost), key=repr)


def test_a_long_conversation_and_repeats(spark, rows):
    data = [(1, i, ("user", "assistant", "assistant")[i % 3], f"row {i}.") for i in range(200)] + [(2, 0, "user", "same.")] * 40 + [(3, 0, "user", "last.")]
    got = rows(repair.reports(repair.edits(spark.createDataFrame(data, KIND), block=20)))
    assert got == sorted(plain(data, hurt=lambda r: r), key=repr)


def test_edits_are_rows(spark):
    df = spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "user", "u.")], KIND)
    got = [(r["edit"], r["role"], r["new_role"], r["text"]) for r in repair.edits(df).orderBy("at", "seq").collect()]
    assert got == [("K", "system", "system", "s."), ("R", "assistant", "user", "a."), ("R", "user", "assistant", "u.")]
    assert repair.reports(repair.edits(spark.createDataFrame([], KIND))).count() == 0


def test_query_gives_every_conversation(spark, rows, tmp_path):
    from loomframe.llm import queries

    data = talks(seed=9) + [(c, 0, "user", "only.") for c in range(2000, 2060)]
    spark.createDataFrame(data, KIND).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows(queries.op11_repair(spark, str(tmp_path))) == sorted(plain(data), key=repr)
