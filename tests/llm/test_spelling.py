"""Spelling variants against all pairs."""

import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomframe.llm import spelling

KIND = "doc_id long, text string"


def vocabulary(docs, least=7):
    n = {}
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] = n.get(run, 0) + 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain(words):
    out, form = [], {}
    for w, n in words.items():
        own = [v for v in words if near(w, v)]
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
        out.append((w, n, len(own)))
    for w, n, k in out:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, n, k, words[form[w]] if form[w] else None


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abcé", min_size=1, max_size=6), min_size=1, max_size=40), st.text("abcdé", min_size=1, max_size=6))
def test_automaton_in_a_trie(words, other):
    own = sorted(w.encode("latin-1") for w in words)
    trie = spelling.Trie.unpack(spelling.Trie.of(own, list(range(1, len(own) + 1))).pack())
    for w in (*own, other.encode("latin-1")):
        got = list(trie.near(w))
        assert sorted(got) == sorted((i, v) for i, v in enumerate(own, 1) if near(w, v))


def corpus():
    words = ["language", "languages", "langauge", "langage", "lanquage", "languagé", "Straßenbahn", "straßenbahn", "aaaaaaa", "aaaaaaaa", "abababab", "babababa", "m×trices", "matrices"]
    docs = [(i, " ".join(words[j] + "," for j in range(len(words)) for _ in range(1 if (i + j) % 5 else 0))) for i in range(40)]
    return docs + [(50, "language " * 300 + "languages " * 25 + "matrices-matrices"), (51, None), (52, ""), (None, "language langage"), (53, "short ones only"), (53, "short ones only"), (54, "x" * 200_000 + " y " + "x" * 200_000), (55, "LANGUAGEİlanguage Ÿaaaaaaa")]


@pytest.mark.parametrize("small", [False, True])
def test_forms(spark, rows, monkeypatch, small):
    if small:  # many shards and many rounds
        monkeypatch.setattr(spelling, "SHARD_WORDS", 3)
        monkeypatch.setattr(spelling, "ROUND_BYTES", 400)
    docs = corpus()
    df = spark.createDataFrame(docs, KIND).withColumns({"word": F.lit(1), "n": F.lit("x"), "run": F.lit(2), "id": F.lit(3)})
    got = spelling.forms(spelling.words(df))
    assert rows(got.select("word", "form", "root", "n", "n_near", "form_n")) == sorted(plain(vocabulary(docs)), key=repr)


def test_long_chains_and_nothing(spark, rows):
    chain = {"a" * 8: 2, "a" * 7 + "b": 20, "a" * 6 + "cb": 200, "a" * 5 + "dcb": 2000, "a" * 4 + "edcb": 20000, "a" * 3 + "fedcb": 200000, "z" * 9: 5}
    got = spelling.forms(spark.createDataFrame(list(chain.items()), "word string, n long"))
    assert rows(got) == sorted(plain(chain), key=repr)
    assert {r["root"] for r in got.collect()} == {"aaafedcb", "z" * 9}
    assert spelling.forms(spelling.words(spark.createDataFrame([], KIND))).count() == 0
    with pytest.raises(ValueError):
        spelling.forms(got.select("word", "n"), times=1)
