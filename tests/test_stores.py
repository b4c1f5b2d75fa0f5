"""Stored panels, exports that refuse, documents and gates: edge cases beside the registered rows."""

import json

import pytest
from pyspark.sql import functions as F

from loomframe.functions import genotype as G
from loomframe.operators import lookup, merge, rules, scores, selection
from loomframe.plans.panels import PanelStore
from loomframe.sources import sinks, text

CALL = "sample_id int, rsid string, chrom string, pos long, genotype string, ref string, alt string, zygosity string"


def test_panels_are_replaced_and_forgotten(spark, tmp_path):
    store = PanelStore(spark, str(tmp_path / "store"))
    assert store.names() == [] and not store.delete("x")
    with pytest.raises(KeyError):
        store.panel("x")
    genes = lambda *g: spark.createDataFrame([(x,) for x in g], "gene string")
    first = store.save_genes("a/b c", genes("brca1", " TP53 ", "", "brca1"), "one")
    assert sorted(r["gene"] for r in store.panel("a/b c").collect()) == ["BRCA1", "TP53"]
    assert store.save_genes("a/b c", genes("MLH1")) != first and [r["gene"] for r in store.panel("a/b c").collect()] == ["MLH1"]
    store.save_regions("r", spark.createDataFrame([("1", 10, 20, "x")], "chrom string, start long, end long, name string"))
    rows = spark.createDataFrame([("mlh1", "9", 1, "A", 0), (None, "1", 11, "A", 1), ("X", "1", 10, "A", 2), ("X", "1", 9, "ATG", 3), ("MLH1", "1", 15, "A", 4), (None, "1", 21, "A", 5)], "gene_symbol string, chrom string, pos long, ref string, k int")
    assert sorted(r["k"] for r in store.search(rows, ["a/b c", "r"]).collect()) == [0, 1, 3, 4]
    assert store.names() == ["a/b c", "r"] and store.delete("a/b c") and store.names() == ["r"]


def test_exports_refuse_unresolved_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "r1", "2", 5, "AG", "A", "G", "het"), (1, "r2", "1", 7, "AA", "A", "G", "hom_ref"), (1, "r3", "1", 6, "GG", None, None, None)], CALL)
    sinks.export(df, str(tmp_path / "carried"), "vcf")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "carried")).collect()]
    assert [x for x in lines if not x.startswith("#")] == ["2\t5\tr1\tA\tG\t.\tPASS\t.\tGT\t0/1"]
    with pytest.raises(Exception, match="unresolved zygosity"):
        sinks.export(df, str(tmp_path / "all"), "vcf", all_positions=True)
    sinks.export(df, str(tmp_path / "csv"), "csv", all_positions=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_documents(spark):
    kind = "sample_id int, chrom string, pos long, ref string, alt string, rsid string, gene_symbol string, zygosity string"
    df = spark.createDataFrame([(1, "10", 5, "A", "G", "r1", None, "het"), (1, "2", 9, "A", "G", None, "B\"RCA", "hemi"), (1, "2", 9, "A", "G", None, "B\"RCA", "hemi"), (1, "2", 1, "A", "G", "r", "X", "hom_ref"), (2, "1", 1, "A", "G", "r", "X", "hom_ref")], kind)
    docs = {r["sample_id"]: json.loads(r["document"]) for r in sinks.resource_documents(df).collect()}
    report, *rest = docs[1]["entry"]
    assert [r["reference"] for r in report["resource"]["result"]] == [e["fullUrl"] for e in rest] and len(rest) == 2
    assert [[c["valueString"] for c in e["resource"]["component"]] for e in rest] == [["B\"RCA", "A", "G", "2:9", "Hemizygous"], ["r1", "A", "G", "10:5", "Heterozygous"]]
    assert all(e["fullUrl"] == "urn:uuid:" + e["resource"]["id"] for e in docs[1]["entry"]) and docs[2]["entry"][0]["resource"]["result"] == []
    assert docs == {r["sample_id"]: json.loads(r["document"]) for r in sinks.resource_documents(df.repartition(5)).collect()}
    with pytest.raises(Exception, match="more than 1 observations"):
        sinks.resource_documents(df, most=1).collect()
    plan = sinks.resource_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan  # rows are shuffled once, before they are resources
    none = spark.createDataFrame([(None, "1", 1, "A", "G", "r", "X", "het"), (3, "1", 1, "A", "G", "r", "X", None)], kind)
    assert {r["sample_id"]: len(json.loads(r["document"])["entry"]) for r in sinks.resource_documents(none).collect()} == {None: 1, 3: 1}


def test_tags_without_confirmed_partners(spark):
    df = spark.createDataFrame([(2, 2, 0), (2, 1, 0), (2, None, 0), (1, 2, 0), (None, 0, 2), (0, 0, 1)], "tag int, mate int, other int")
    adjusted, discordant = scores.concordant_dosages({c: F.col(c) for c in df.columns}, {"tag": ["mate", "absent"]})
    got = df.select(adjusted["tag"], discordant).collect()
    assert [(r[0], r[1]) for r in got] == [(2, []), (None, ["tag"]), (2, []), (1, []), (None, []), (0, [])]
    models = [{"name": "high", "match": {"tag": {"min": 2}}}]
    calls = [r["calls"] for r in scores.classify_rules(df, {c: F.col(c) for c in df.columns}, models, partners={"tag": ["mate"]}).collect()]
    assert calls == [["high"], [], ["high"], [], [], []]


def test_anchors_and_gates(spark):
    d = G.anchor_dosage(F.col("g"), F.lit("A"), F.col("o"))
    rows = spark.createDataFrame([("AG", "G"), ("TC", "G"), ("--", "G"), (None, "G"), ("AT", "T"), ("AA", "T"), ("GG", "T"), ("AC", "G")], "g string, o string")
    assert [tuple(r[0]) for r in rows.select(d).collect()] == [(1, "resolved"), (1, "resolved"), (None, "untyped"), (None, "untyped"), (1, "resolved"), (None, "palindrome"), (None, "unresolved"), (None, "unresolved")]
    sex = spark.createDataFrame([("XY", "XX"), (None, "XX"), ("odd", "XY"), (None, None)], "r string, i string")
    assert [r[0] for r in sex.select(rules.sex_context(F.col("r"), F.col("i"))).collect()] == ["male", "female", "male", "unresolved"]
    shown = rules.consented(spark.createDataFrame([(True, 1.5), (False, 2.5), (None, 3.5)], "c boolean, x double"), F.col("c"), ["x"]).collect()
    assert [(r["x"], r["opt_in_required"]) for r in shown] == [(1.5, False), (None, True), (None, True)]
    figures = spark.createDataFrame([("A", "f", 1), (None, "f", 9), ("A", "m", 2)], "k string, context string, x int")
    own = spark.createDataFrame([("A", "f"), ("B", "f"), (None, "f"), ("A", "m"), ("B", "m")], "k string, c string")
    assert sorted(map(tuple, lookup.by_context(own, figures, "k", F.col("c"), ["x"]).collect()), key=repr) == sorted([("A", "f", 1), ("B", "f", 9), (None, "f", 9), ("A", "m", 2), ("B", "m", None)], key=repr)


def test_registry_and_stored_rows(spark):
    registry = spark.createDataFrame([(1, "s1", ["AFR"]), (2, "s2", ["any"]), (3, "s3", ["EUR"]), (0, "s0", ["EUR", "EAS"])], "rank int, score string, covers array<string>")
    own = spark.createDataFrame([("AFR",), ("EUR",), ("OCE",), (None,)], "g string")
    assert {r["g"]: r["score"] for r in selection.covering(own, registry, "g", "covers", "rank", ["score"]).collect()} == {"AFR": "s1", "EUR": "s0", "OCE": "s2", None: "s2"}
    bare = registry.filter("score <> 's2'")
    assert {r["g"]: r["score"] for r in selection.covering(own, bare, "g", "covers", "rank", ["score"]).collect()} == {"AFR": "s1", "EUR": "s0", "OCE": None, None: None}
    stored = spark.createDataFrame([(1, "k", "T.", False, False), (2, "k", "T.", True, True), (3, "k", "T. W.", True, True), (4, "k", "T.", True, None), (5, "gone", "T.", False, False)], "id int, key string, text string, w boolean, d boolean")
    got = merge.still_declared(stored, spark.createDataFrame([("k", "n")], "key string, note string"), ["key"], ["note"], F.col("w"), F.col("d"), "W.").collect()
    assert sorted((r["id"], r["text"], r["note"]) for r in got) == [(1, "T.", "n"), (2, "T. W.", "n"), (3, "T. W.", "n")]


def test_formats_of_many_files(spark):
    heads = {"a": ["# build 37", "# rsid\tchromosome\tposition\tgenotype"], "b": ["#AncestryDNA", "rsid\tchromosome\tposition\tallele1\tallele2"], "c": ["x"], "d": ["a\0b"]}
    lines = spark.createDataFrame([(n, i, v) for n, h in heads.items() for i, v in enumerate(h + ["rs1\t1\t1\tAA"] * 80)], "file string, record long, value string")
    got = {r["file"]: (r["vendor"], r["version"], r["reason"]) for r in text.formats(lines).collect()}
    assert got == {"a": ("a", "v4", None), "b": ("b", "v2.0", None), "c": (None, None, "unknown format"), "d": (None, None, "a binary file")}
