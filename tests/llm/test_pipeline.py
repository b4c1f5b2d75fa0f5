"""The pipeline's stages on the smallest tables, and the shape of every query."""

from pyspark.sql import functions as F

import corpus_pipeline as C
from loomframe.llm.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, rows = docs.columns, [docs.count()]
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, D).cache()
        assert docs.columns == columns, name
        rows.append(docs.count())
    kept, single, clean, mixed = rows[1:]
    assert 0 < kept < rows[0] and 0 < single < kept and clean == single and mixed > 0
    last = C.STAGES[-1][1](spark, docs, D)
    assert last.count() == mixed and last.filter("not round_trip").count() == 0


def test_stages_stand_extra_and_clashing_columns(spark):
    plain = spark.read.parquet(f"{D}/documents.parquet").limit(60)
    names = ("n_words", "kept", "policy", "fail_bits", "size", "block", "source_no", "bucket", "row", "start", "spans", "_node", "extra")
    docs = plain.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in names]).cache()
    columns, kinds = docs.columns, docs.dtypes
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, D).cache()
        assert docs.columns == columns and docs.dtypes == kinds, name
        rows = docs.select("doc_id", *names).collect()
        assert rows and all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in names), name
    last = C.STAGES[-1][1](spark, docs, D)
    assert last.filter("round_trip").count() == len(rows) and set(names) <= set(last.columns)


def test_stages_on_odd_rows(spark):
    """Nulls in every column, blank, repeated and very long texts, ties, and an empty table, through all stages."""
    prose = lambda k: " ".join(f"word{(i * k) % 997}" for i in range(120))
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t", "en", "a", 3), (3, prose(3), "en", None, 7), (3, prose(3), "en", None, 7), (3, prose(3), "fr", "b", 7), (4, prose(3), "en", "a", 7), (None, prose(5), None, None, None), (5, prose(7), None, "b", 1), (6, " ".join(f"w{i}" for i in range(60_000)), "en", "a", 5)]
    docs = spark.createDataFrame(rows, kind)
    counts = []
    for name, stage in C.STAGES:
        docs = stage(spark, docs, D).cache()
        counts.append(docs.count())
        if name == "simhash_near_dedup":
            assert sorted((r["doc_id"] is None, r["doc_id"]) for r in docs.collect()) == [(False, 3), (False, 5), (False, 6), (True, None)]
    assert counts[0] == 7 and counts[1] == counts[2] == 4 and counts[3] == counts[4] > 0
    assert docs.filter("not round_trip").count() == 0 and {r["doc_id"] for r in docs.collect()} == {3, None, 5, 6}
    empty = spark.createDataFrame([], kind)
    for _, stage in C.STAGES:
        empty = stage(spark, empty, D)
        assert empty.count() == 0


def test_run_reruns(spark):
    a = sorted(map(tuple, C.run(spark, D).select("doc_id", "n_chars", "piece_ids").collect()))
    b = sorted(map(tuple, C.run(spark, D).select("doc_id", "n_chars", "piece_ids").collect()))
    assert a == b and a


def test_contracts(spark):
    want = {
        "op1_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
        "op6_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, fail_bits bigint",
        "op7_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
        "op8_simhash": "doc_id bigint, fingerprint string, component_id bigint",
        "op10_html": "page_id bigint, url string, text string, n_chars bigint",
        "op11_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
        "op12_spelling": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
        "op13_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    }
    for name, kinds in want.items():
        assert ", ".join(map(" ".join, QUERIES[name](spark, D).dtypes)) == kinds
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] and set(SQL) <= set(QUERIES)
