"""Quality measurements against plain Python."""

import random
from collections import Counter

from pyspark.sql import functions as F

from loomframe.llm import quality as Q

SPACE = " \t\n\x0b\x0c\r"


def words(t):
    for c in SPACE:
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def plain(text):
    t = text or ""
    w = words(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered), t.count("!")


def texts():
    r = random.Random(3)
    out = [None, "", " ", "a", "a a a", "a a a a", "a b c a b c", "x y z\nx y z\n\n \nq", "é ü b #*$", "w " * 300, "A\x0bB\x0cC\rD", "a,b c d"]
    return out + [" ".join(r.choice("ab cd efg h\n \t!|".split(" ")) for _ in range(r.randint(1, 120))) for _ in range(150)]


def test_measurements(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in Q.MEASURES) for r in Q.measured(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts())}


def test_bits_policies_and_ablation(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["w%d " % i * 60 for i in range(3)] + [" ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}!!" for i in range(80)), " ".join(f"w{i}|#" for i in range(20)), None])], "doc_id long, text string")
    led = Q.ledger(docs).cache()
    bits = {r["doc_id"]: r["fail_bits"] for r in led.collect()}
    assert bits[0] == 1 << Q.BITS["repeats"] and bits[3] == 0 and bits[4] == 1 << Q.BITS["shouting"]
    assert bits[5] == (1 << Q.BITS["few_words"]) | (1 << Q.BITS["symbols"]) and bits[6] & 1
    kept = {r["doc_id"] for r in Q.apply_policy(led, Q.STANDARD).filter("kept").collect()}
    assert kept == {3}
    assert {r["doc_id"] for r in Q.apply_policy(led, Q.BASE).filter("kept").collect()} == {3, 4}
    ab = {r["rule"]: r for r in Q.ablation(led, Q.STANDARD).collect()}
    assert set(ab) == set(Q.STANDARD.rules) and ab["repeats"]["n_only"] == 3 and ab["repeats"]["n_kept_without"] == 4 and ab["symbols"]["n_only"] == 0


def test_edge_tables(spark):
    assert Q.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    extra = spark.createDataFrame([(1, "a b", 7)], "doc_id long, text string, n_words int").withColumn("fail_bits", F.lit("x"))
    assert Q.ledger(extra).first()["n_words"] == 2


def test_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000)) + "\n" + "same line here\n" * 30_000 + "#"
    docs = spark.createDataFrame([(1, long), (2, "x" * 2_000_000), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in Q.MEASURES) for r in Q.measured(docs).collect()}
    assert got == {1: plain(long), 2: plain("x" * 2_000_000), 3: plain(None)}
