"""Rollups against direct sums; batches count once."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loomframe.llm import tokencounts as C
from loomframe.llm.queries import op4_token_counts

KIND = "doc_id long, text string, source string, lang string"
ROWS = [(1, "one two three", "a", "en"), (2, "", "a", "en"), (3, None, None, "de"), (4, "vier fünf", "b", "de"), (4, "vier fünf", "b", "de"), (5, "x" * 3000, "b", None)]


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}


def plain(rows, version="v1"):
    e, out = C.encoder(C.RANKS), {}
    for _, t, s, g in rows:
        n, m = out.get((s, g, version), (0, 0))
        out[s, g, version] = (n + 1, m + len(e.encode_ordinary(t or "")))
    return out


def test_insert_delete_revise_once(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, KIND)
    counted = C.counted(docs).cache()
    rollup = C.Rollup(spark, str(tmp_path / "r"))
    assert totals(rollup) == {}
    assert rollup.commit("b1", C.inserts(counted, "v1")) and not rollup.commit("b1", C.inserts(counted, "v1"))
    assert totals(rollup) == plain(ROWS)
    rollup.commit("b2", C.deletes(counted.filter("doc_id = 4"), "v1"))
    assert totals(rollup)["b", "de", "v1"] == (0, 0)
    longer = counted.filter("doc_id = 1").withColumns({"old_tokens": F.col("n_tokens"), "n_tokens": F.col("n_tokens") + 5})
    rollup.commit("b3", C.revisions(longer, "v1"))
    want = plain(ROWS[:1])["a", "en", "v1"][1]
    assert totals(rollup)["a", "en", "v1"] == (2, want + 5)
    rollup.commit("b4", C.revisions(longer.withColumn("old_tokens", F.col("n_tokens")), "v2", old="v1"))
    assert totals(rollup)["a", "en", "v1"] == (1, 0) and totals(rollup)["a", "en", "v2"] == (1, want + 5)
    before = totals(rollup)
    assert rollup.compact() and totals(rollup) == before
    assert not rollup.commit("b2", C.inserts(counted, "v1")) and totals(rollup) == before
    assert rollup.compact() and totals(rollup) == before


def test_a_lost_run_is_written_anew(spark, tmp_path):
    counted = C.counted(spark.createDataFrame(ROWS, KIND))
    rollup = C.Rollup(spark, str(tmp_path / "r"))
    C.inserts(counted, "v9").write.parquet(str(tmp_path / "r" / "data" / "b1-left-by-a-lost-run"))
    assert totals(rollup) == {} and not rollup.committed("b1")
    rollup.commit("b1", C.inserts(counted, "v1"))
    assert totals(rollup) == plain(ROWS)
    with pytest.raises(ValueError):
        rollup.commit("../x", C.inserts(counted, "v1"))


def test_two_writers(spark, tmp_path):
    counted = C.counted(spark.createDataFrame(ROWS, KIND)).cache()
    a, b = C.Rollup(spark, str(tmp_path / "r")), C.Rollup(spark, str(tmp_path / "r"))
    b.committed = lambda batch: False  # looked before the other wrote
    assert a.commit("b1", C.inserts(counted, "v1")) and not b.commit("b1", C.inserts(counted, "v1"))
    assert totals(a) == plain(ROWS)
    # A batch that is committed while a compaction runs, and a second compaction from the same state.
    stale, enter = a._state(), a._enter
    assert b.commit("b2", C.inserts(counted, "v2"))
    a._state = lambda: stale
    assert a.compact() and not a.compact()
    a._state, a._enter = C.Rollup._state.__get__(a), enter
    assert totals(a) == totals(b) == plain(ROWS) | plain(ROWS, "v2")
    assert b.compact() and totals(b) == plain(ROWS) | plain(ROWS, "v2") and not a.commit("b2", C.inserts(counted, "v2"))


def test_query_against_sql_over_counts(spark):
    """The query's totals by SQL over the documents' counts: revised rows under the new vocabulary, first copies only."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
    for name, ranks in (("a", C.RANKS), ("b", C.MULTI_RANKS)):
        docs[name] = [len(C.encoder(ranks).encode_ordinary(t or "")) for t in docs["text"]]
    con = duckdb.connect()
    con.register("d", docs.drop(columns="n_chars"))
    want = con.execute("""
    WITH r AS (SELECT *, lang <> 'en' IS NOT FALSE AS other, row_number() OVER (PARTITION BY text ORDER BY doc_id, source, lang) AS n FROM d),
    now AS (SELECT source, lang, CASE WHEN other THEN 'byte_bpe_multi_50k' ELSE 'byte_bpe_50k' END AS tokenizer, 1 AS docs, CASE WHEN other THEN b ELSE a END AS tokens FROM r WHERE n = 1),
    keys AS (SELECT source, lang, 'byte_bpe_50k' AS tokenizer, 0 AS docs, 0 AS tokens FROM r UNION ALL SELECT source, lang, 'byte_bpe_multi_50k', 0, 0 FROM r WHERE other)
    SELECT source, lang, tokenizer, sum(docs)::BIGINT, sum(tokens)::BIGINT FROM (FROM now UNION ALL FROM keys) GROUP BY ALL
    """).fetchall()
    got = [tuple(r) for r in op4_token_counts(spark, folder).select("source", "lang", "tokenizer", "n_docs", "n_tokens").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(r[3] for r in got) < len(docs)


def test_edge_tables(spark, tmp_path):
    rollup = C.Rollup(spark, str(tmp_path / "r"))
    assert rollup.compact() and totals(rollup) == {}
    rollup.commit("b1", C.inserts(C.counted(spark.createDataFrame([], KIND)), "v1"))
    assert totals(rollup) == {} and rollup.batches() == ["b1"]
    long = [(1, "word " * 200_000, "a", "en"), (2, "w" * 50_000, "a", "en")]
    rollup.commit("b2", C.inserts(C.counted(spark.createDataFrame(long, KIND)), "v1"))
    assert totals(rollup) == plain(long)
    extra = spark.createDataFrame(ROWS, KIND).withColumns({"n_tokens": F.lit("x"), "tokenizer": F.lit(1)})
    assert C.counted(extra).columns == ["doc_id", "source", "lang", "n_tokens"]
