"""Sampled segmentations: lossless, reproducible, and distributed as the lattice says."""

import math
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomframe.llm import pieces as P

ODD = ["", " ", "  a  b ", "a\nb", "▁x ▁", "日本語 漢字\t\x00z", "é" * 40 + "😀", "\n\n", "x" * 5000, "<0x0A> <s> </s> <unk>", "\0", "a\r\nb\x0bc", "   "]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5), st.integers(-(2**63), 2**63 - 1))
def test_round_trip(texts, key):
    own = P.loaded(P.MODEL, 0.5)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, counts = own.segment(texts, np.full(len(texts), key))
    at = 0
    for t, n in zip(texts, counts, strict=True):
        part = ids[at : at + n].tolist()
        assert own.text(part) == t and all(0 <= i < own.size for i in part)
        at += n


def test_same_pieces_in_any_batch():
    own = P.loaded(P.MODEL, 0.5)
    texts = ["the quick brown fox\njumps over", *ODD, "lazy dogs sleep  well"]
    keys = np.arange(len(texts)) * 7919
    together = own.segment(texts, keys)
    at = 0
    for t, k, n in zip(texts, keys, together[1], strict=True):
        alone, count = own.segment([t], np.array([k]))
        assert count[0] == n and alone.tolist() == together[0][at : at + n].tolist()
        at += n
    long = [" ".join(texts) * 20]
    assert own.segment(long, np.array([1]))[0].tolist() != own.segment(long, np.array([2]))[0].tolist()


def test_distribution_is_that_of_the_lattice():
    own = P.loaded(P.MODEL, 0.5)
    piece = {own.bytes_of[i].decode("utf-8", "ignore"): i for i in range(own.size) if own.bytes_of[i] and i > 258}

    def paths(s):
        if not s:
            return [((), 0.0)]
        return [((piece[s[:k]], *p), own.logp[piece[s[:k]]] + w) for k in range(1, len(s) + 1) if s[:k] in piece for p, w in paths(s[k:])]

    word = " then"
    weights = {p: math.exp(w) for p, w in paths(word)}
    total, n = sum(weights.values()), 20000
    ids, counts = own.segment(["then"] * n, np.arange(n))
    got, at = Counter(), 0
    for c in counts:
        got[tuple(ids[at : at + c].tolist())] += 1
        at += c
    assert set(got) <= set(weights)
    for p, w in weights.items():
        share = w / total
        assert abs(got[p] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4


def test_operator(spark):
    docs = spark.createDataFrame([*enumerate([*ODD, None, "w " * 3000]), (0, ""), (None, "no id")], "doc_id long, text string").withColumn("piece_ids", F.lit(1))
    out = P.encode(docs, check=True)
    rows = out.collect()
    assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
    null = next(r for r in rows if r["doc_id"] == len(ODD))
    assert null["piece_ids"] is None and null["n_pieces"] == 0
    back = P.decode(P.encode(docs.filter("doc_id is not null and text is not null").dropDuplicates(["doc_id"]))).select("doc_id", "decoded").join(docs.dropDuplicates(["doc_id"]), "doc_id")
    assert back.filter("decoded <> text").count() == 0 and back.count() == len(ODD) + 1
    again = {r["doc_id"]: r["piece_ids"] for r in P.encode(docs.repartition(5)).collect()}
    assert all(again[r["doc_id"]] == r["piece_ids"] for r in rows)
    assert P.encode(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "some words of a text\n" * 20_000), (2, "x" * 20_000), (3, "é" * 5_000 + " ")], "doc_id long, text string")
    assert all(r["round_trip"] and r["n_pieces"] > 0 for r in P.encode(docs, check=True).collect())
