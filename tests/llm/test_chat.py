"""Chat formatting against plain rendering."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomframe.llm import chat

TEXT = st.text("ab \n\\<>#:é \U0001f600turn/A", max_size=30)
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a>b", "x\ny\\"]), TEXT), max_size=6)
KIND = "conv_id long, turn long, role string, text string"


def forgetful(turns, before):
    """A template that strips what earlier assistant turns said before a bar."""
    last = max((i for i, t in enumerate(turns) if t[0] == "user"), default=0)
    return "".join(f"[{r}]{t.split('|')[-1] if r == 'assistant' and i < last else t}[/]" for i, (r, t) in enumerate(turns))


FORGETFUL = chat.Template(forgetful, lambda s: [], lambda s: s)
TRIMMING = chat.Template(lambda turns, before: "".join(f"<{r}>{t.strip()}\n" for r, t in turns), lambda s: [], lambda s: s)
BEGUN = chat.Template(lambda turns, before: "".join(("" if before + i else "<s>") + f"<{r}>{t}\n" for i, (r, t) in enumerate(turns)), lambda s: [], lambda s: s)


@settings(max_examples=300, deadline=None)
@given(TURNS, st.sampled_from(["TAGGED", "HEADED"]))
def test_templates_are_read_back(turns, name):
    t = getattr(chat, name)
    whole, spans, changed = chat.locate(t, turns, 0, ("assistant",))
    assert changed is None and whole == t.render(turns, 0) and t.read(whole) == turns
    assert "".join(whole[b:e] for b, e, *_ in spans) == whole
    for (role, text), (b, e, tb, te) in zip(turns, spans):
        assert t.read(whole[b:e]) == [(role, text)]
        assert (t.unescape(whole[tb:te]) == text and b <= tb <= te <= e) if role == "assistant" else tb is None


def test_templates_that_rewrite_history_and_that_lose_text():
    turns = [("user", "q"), ("assistant", "think|a"), ("user", "r"), ("assistant", "b")]
    whole, spans, changed = chat.locate(FORGETFUL, turns, 0, ("assistant",))
    assert changed == 2 and whole == "[user]q[/][assistant]a[/][user]r[/][assistant]b[/]" and all(x is None for s in spans for x in s)
    assert chat.locate(FORGETFUL, turns[:2], 0, ("assistant",))[2] is None
    _, spans, changed = chat.locate(TRIMMING, [("assistant", " a "), ("assistant", "b")], 0, ("assistant",))
    assert changed is None and spans[0][2:] == (None, None) and spans[1][2:] == (24, 25)


def plain(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in out.items():
        said = "".join(t for r, t in turns if r == "assistant")
        yield c, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), digest(said), len(chat.TAGGED.render(turns, 0))


ODD = [(1, 0, "user", "a"), (1, 1, "assistant", "<turn user>\n\\"), (1, None, "system", None), (2, 3, None, "x"), (None, 1, "user", "n"), (None, 2, "assistant", ""), (3, 0, "assistant", "long " * 200_000),
       (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (4, 5, "user", "same"), (4, 5, "user", "same"), (4, 6, "assistant", "\U0001f600é")]


@pytest.mark.parametrize("turns", [1, 3, 64])
@pytest.mark.parametrize("template", ["TAGGED", "HEADED"])
def test_digests(spark, rows, turns, template):
    data = ODD + [(9, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(300)]  # a conversation of most rows spans pieces
    t = getattr(chat, template)
    df = spark.createDataFrame(data, KIND)
    got = rows(chat.digests(chat.formatted(df, t, turns=turns), t).drop("formatted_chars"))
    assert got == sorted((x[:5] for x in plain(data)), key=repr)


def test_a_long_conversation_is_many_segments_that_make_one_text(spark):
    data = [(9, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(300)] + [(8, 0, "user", "x"), (10, 0, "user", "y")]
    df = spark.createDataFrame(data, KIND)
    got = chat.formatted(df, BEGUN, turns=16)
    parts = [r["formatted"] for r in got.filter("conv_id = 9").orderBy("at").collect()]
    assert len(parts) == 19 and "".join(parts) == BEGUN.render([(r, t) for _, _, r, t in data[:300]], 0)
    assert got.select("formatted").where("conv_id <> 9 and not startswith(formatted, '<s>')").count() == 0


def test_empty_clashing_and_rewriting(spark):
    assert chat.digests(chat.formatted(spark.createDataFrame([], KIND))).count() == 0
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, KIND).withColumns({"at": F.lit(1), "formatted": F.lit("x"), "spans": F.lit(2), "_piece": F.lit(1), "_salt": F.lit(1), "conv": F.lit(5)})
    assert sorted(map(tuple, chat.digests(chat.formatted(df)).collect()), key=repr) == sorted(plain(ODD), key=repr)
    talk = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "t|a"), (1, 2, "user", "r")], KIND)
    assert [r["rewritten"] for r in chat.formatted(talk, FORGETFUL).collect()] == [2]
    assert [r["rewritten"] for r in chat.formatted(talk, FORGETFUL, turns=2).orderBy("at").collect()] == [None, None]
