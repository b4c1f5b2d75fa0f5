"""Mixing against a plain computation of targets and the contract's bounds."""

import random

import pytest
from pyspark.sql import functions as F

from loomframe.llm import mixing

KIND = "doc_id long, text string, source string"


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Reshare the excess until no target is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, share = total - sum(fixed.values()), sum(w[s] for s in free)
        out = {s: left * w[s] / share for s in free} if free else {}
        over = [s for s in free if out[s] > most * sizes[s]]
        if not over:
            return out | fixed
        fixed |= {s: most * sizes[s] for s in over}


def corpus(spark, n=400, seed=1):
    r = random.Random(seed)
    names = ["a"] * 10 + ["b", "c", "dd", None, "eé"]
    return spark.createDataFrame([(i, " ".join(["w"] * r.randint(0, 300)), r.choice(names)) for i in range(n)], KIND)


def test_targets_and_bounds(spark):
    docs = corpus(spark)
    got = mixing.Mix(docs, block_words=16).taken().collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = plain_targets(sizes)
    assert len(got) == 400
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s, t in want.items():
        taken = sum(r["taken"] for r in got if r["source"] == s)
        assert abs(taken - t) <= max(0.05 * t, 3 * 16), (s, taken, t)


def test_target_bound_is_reached(spark):
    docs = spark.createDataFrame([(1, "w " * 10, "a"), (2, "w " * 5000, "b"), (3, "w " * 20, "c")], KIND)
    got = {r["source"]: r for r in mixing.Mix(docs, block_words=4).taken().collect()}
    assert got["a"]["target"] == 30 and got["c"]["target"] == 60 and got["b"]["target"] == pytest.approx(4940)
    assert got["a"]["taken"] <= 30 and got["c"]["taken"] <= 60


def test_reruns_agree_whatever_the_partitions(spark, rows):
    docs = corpus(spark)
    a = mixing.Mix(docs).taken()
    b = mixing.Mix(docs.repartition(13)).taken()
    assert rows(a) == rows(b)


def test_pieces_rebuild_every_text(spark):
    texts = ["a b  c\n\td ", "", None, "  x", "one", "p q r s t u v w x y z " * 9, "\t \n"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], KIND)
    mix = mixing.Mix(docs, block_words=3, carry=[])
    got = {}
    for r in mix.pieces(with_text=True).collect():
        got.setdefault(r["doc_id"], []).append((r["piece_start"], r["piece_text"]))
    for i, t in enumerate(texts):
        if t and t.split():
            assert "".join(x for _, x in sorted(got[i])) == t


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(1).cast("long"), F.lit(5).cast("long")).alias("p"))
        got = [r["p"] for r in df.collect()]
        assert sorted(got) == list(range(n))
        assert n < 100 or sum(a == b for a, b in enumerate(got)) < n / 10


def test_edge_tables(spark):
    empty = spark.createDataFrame([], KIND)
    assert mixing.Mix(empty).taken().count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "x"), (None, "  ", "x")], KIND)
    assert [r["taken"] for r in mixing.Mix(blank).taken().collect()] == [0, 0, 0]
    twice = spark.createDataFrame([(1, "a b", "s")] * 5 + [(None, "c d e", None)] * 2, KIND).withColumns({"size": F.lit("x"), "bucket": F.lit(1), "_n": F.lit(2)})
    got = mixing.Mix(twice, block_words=2).taken().collect()
    assert len(got) == 7 and all(r["taken"] <= 3 * r["size"] for r in got)


def test_draws_of_a_shard_do_not_depend_on_how_many_there_are(spark, monkeypatch):
    """Twice the rows of each source: the same shares, so the same counts in the shards that both have."""
    docs = spark.createDataFrame([(i, "w " * 64, "abc"[i % 3]) for i in range(600)], KIND)
    more = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    counts = lambda d: {(r["shard"], r["source_no"]): r["n"] for r in mixing.Mix(d, block_words=8, shard_slots=64).shard_counts().collect()}
    monkeypatch.setattr(mixing, "SPREAD", 16)
    few, many = counts(docs), counts(more)
    last = max(s for s, _ in few)
    assert last > 60 and max(s for s, _ in many) > 2 * last
    assert {k: n for k, n in few.items() if k[0] < last} == {k: n for k, n in many.items() if k[0] < last}


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000, "a"), (2, "w " * 50_000, "b"), (3, None, "a")], KIND)
    got = {r["doc_id"]: r for r in mixing.Mix(docs).taken().collect()}
    assert got[1]["size"] == 300_000 and got[2]["taken"] <= 150_000 and got[3]["taken"] == 0
    assert abs(got[1]["taken"] - got[1]["target"]) <= 0.02 * got[1]["target"]
