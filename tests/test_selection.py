from pyspark.sql import functions as F

from loomframe.operators import selection as S


def test_preferred(spark):
    df = spark.createDataFrame([(1, "pca", 5), (1, "nnls", 3), (1, "nnls", 4), (2, "other", 1), (2, None, 0), (3, "pca", None)], "s int, c string, v int")
    got = {r["s"]: (r["c"], r["v"]) for r in S.preferred(df, ["s"], "c", ["nnls", "pca"], [-F.col("v")]).collect()}
    assert got[1] == ("nnls", 4) and got[2][0] in ("other", None) and got[3] == ("pca", None)
    assert {r["s"] for r in S.preferred(df, ["s"], "c", ["nnls", "pca"], [F.col("v")], unlisted=False).collect()} == {1, 3}


def test_registry_and_counts(spark):
    registry = [{"id": "a", "groups": ["eur"]}, {"id": "b", "groups": ["afr", "eur"]}, {"id": "c", "groups": ["any"]}]
    assert S.first_covering(registry, "eur")["id"] == "a" and S.first_covering(registry, "afr")["id"] == "b" and S.first_covering(registry, None)["id"] == "c" and S.first_covering([], "eur") is None
    df = spark.createDataFrame([(0,), (2,), (None,), (9,)], "n int")
    assert [r[0] for r in df.select(S.by_count(F.col("n"), {0: "normal", 1: "one", 2: "two"}, "unknown")).collect()] == ["normal", "two", "unknown", "unknown"]


def test_held_pairs(spark):
    rows = [("G1", "drugx", ""), ("g1", "DrugX", None), ("G1", "other", "take DrugX with G1"), ("G2", "drugx", "drug​x and G1"), ("G2", "y", "dгugx G1"), ("G2", "y", "drugxy G1"), (None, None, "сlear"), ("G2", "y", "DRUGX... (g1)")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g string, d string, t string")
    assert [r["i"] for r in S.without_held(df, [("G1", "DrugX")], "g", "d", ["t"]).orderBy("i").collect()] == [4, 5, 6]


def test_lists(spark):
    df = spark.createDataFrame([("d", "G2", None), ("d", "G1", "B"), ("d", "G1", "A"), ("e", "G9", None)], "drug string, gene string, c string")
    assert {r["drug"]: (r["items"], r["c"]) for r in S.grouped_list(df, "drug", "gene", "c").collect()} == {"d": (["G1", "G2"], "A"), "e": (["G9"], None)}
    f = spark.createDataFrame([("G1",), ("G2",), ("G3",)], "gene_symbol string")
    listed = spark.createDataFrame([("s1", "G1"), ("s1", "G3"), ("s2", "G3"), ("s3", "G9")], "score_id string, gene_symbol string")
    assert {r["score_id"]: r["genes"] for r in S.carriers_among(f, listed, ["G3"]).collect()} == {"s1": ["G1"]}
