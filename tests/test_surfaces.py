"""Sources, sinks, the query console and streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from loomframe.operators import rules
from loomframe.plans import console
from loomframe.sources import sinks, text
from loomframe.streaming import events

A_HEAD = ["# rsid\tchromosome\tposition\tgenotype"]
B_HEAD = ["#AncestryDNA raw data", "#array version: V2.0", "rsid\tchromosome\tposition\tallele1\tallele2"]


def lines(spark, items):
    return spark.createDataFrame([(x,) for x in items], "value string")


def test_sniffing():
    assert text.sniff(A_HEAD) == "a" and text.sniff(B_HEAD[2:]) == "b" and text.sniff(A_HEAD + B_HEAD) == "a"
    for bad, word in ((["##fileformat=VCFv4.2"], "VCF"), (["a,b,c", "1,2,3"], "CSV"), (["x y"], "unknown"), ([], "unknown")):
        with pytest.raises(text.FormatError, match=word):
            text.sniff(bad)
    with pytest.raises(text.FormatError, match="ZIP"):
        text.sniff(A_HEAD, b"PK\x03\x04...")
    with pytest.raises(text.FormatError, match="binary"):
        text.sniff(A_HEAD, b"abc\0d")
    assert text.version_a(["# build 36"]) == ("v3", "GRCh36") and text.version_a(["# build 37"]) == ("v4", "GRCh37") and text.version_a(["# build 37"] + ["#"] * 14) == ("v5", "GRCh37")
    assert text.version_b(B_HEAD) == "v2.0" and text.version_b(["# AncestryDNA", "rsid\tchromosome"]) == "v2.0"
    with pytest.raises(text.FormatError):
        text.version_b(["x"])


def test_genotype_files(spark):
    own = lines(spark, [*A_HEAD, "", "rs1\t23\t10\tga", "rs2\tMT\t5\tT", "rs3\t1\t7\t--", "rs4\t1\tx\tAA", "rs5\t99\t1\tAA", "rs6\t1\t1", "\t1\t1\tAA", "rs7\t1\t-4\tAA"])
    p = text.genotypes(own, "a")
    got = {r["rsid"]: (r["chrom"], r["pos"], r["genotype"], r["reason"]) for r in p.collect()}
    assert got["rs1"] == ("X", 10, "AG", None) and got["rs2"] == ("MT", 5, "T", None) and got["rs3"][2:] == ("--", None)
    assert [got[k][3] for k in ("rs4", "rs5", "rs6", "", "rs7")] == ["position", "chromosome", "arity", "rsid", "position"]
    assert tuple(text.scan_metrics(own, p).first()) == (10, 2, 3, 1)
    assert text.strict(p.filter("reason is null")).count() == 3
    with pytest.raises(Exception, match="bad line"):
        text.strict(p).collect()
    b = text.genotypes(lines(spark, [*B_HEAD, "rs1\t25\t10\tG\tA", "rs2\t26\t1\t0\tA", "rs3\t1\t2\tt\tc"]), "b")
    assert [(r["rsid"], r["chrom"], r["genotype"]) for r in b.collect()] == [("rs1", "X", "AG"), ("rs2", "MT", "--"), ("rs3", "1", "CT")]


def test_clinical_vcf(spark, tmp_path):
    rows = [
        "##x", "#CHROM\tPOS", "1\t100\t55\tA\tG,T\t.\t.\tRS=7;CLNSIG=Pathogenic/Likely_pathogenic;CLNREVSTAT=criteria_provided,_single_submitter;GENEINFO=BR:1;MC=SO:0001583|missense_variant",
        "chrX\t5\t9\tA\tC\t.\t.\tRS=8;CLNSIG=Benign;GENEINFO=XG:3|YG:4;CLNREVSTAT=practice_guideline", "1\t6\t9\tA\tC\t.\t.\tRS=x;CLNSIG=Benign", "1\t8\t9\tA\tC\t.\t.\tRS=;CLNSIG=Benign;CLNVCID=12", "1\t9\t.\tA\tC\t.\t.\tCLNACC=RCV1|RCV2", "1\t10\t.\tA\tC\t.\t.\tMC=SO:1", "1\t11\t.\tA\tC\t.\t.\tRS=000", "1\t7\t9\tA\tC\t.\t.\tAF=1", "GL1\t7\t9\tA\tC\t.\t.\tRS=1", "1\t2\tshort",
    ]
    path = tmp_path / "c.vcf.gz"
    path.write_bytes(gzip.compress("\n".join(rows).encode()))
    got = {r["pos"]: r for r in text.clinical(spark.read.text(str(path))).filter("chrom <> 'GL1'").collect()}
    assert (got[100]["rsid"], got[100]["alt"], got[100]["significance"], got[100]["review_stars"], got[100]["accession"], got[100]["gene_symbol"]) == ("rs7", "G", "Pathogenic", 1, None, "BR")
    assert (got[100]["variation_id"], got[100]["molecular_consequence"]) == (55, None)
    assert (got[5]["chrom"], got[5]["review_stars"], got[5]["gene_symbol"]) == ("X", 4, None)  # of two genes neither counts
    assert got[6]["reason"] == got[11]["reason"] == "rsid" and got[7]["reason"] == got[10]["reason"] == "no_info" and got[5]["reason"] is None
    assert (got[8]["rsid"], got[8]["accession"], got[8]["reason"]) == (None, "VCV000000012", None)  # stays, to be found by its place
    assert (got[9]["rsid"], got[9]["accession"], got[9]["reason"]) == (None, "RCV1", None)
    assert {r["reason"]: r["n"] for r in text.reasons(text.clinical(spark.read.text(str(path)))).collect()} == {"rsid": 2, "no_info": 2, "chromosome": 1}


def test_frequency_and_nested_vcf(spark):
    own = lines(spark, ["1\t10\trs1;rs2\tA\tG,T\t.\t.\tAF=0.1,0.2;AN=100", "1\t11\trs3\tA\tG,T\t.\t.\tAF=0.1;AN=5,6", "1\t12\t.\tA\tG\t.\t.\tAF=.", "1\t13\t.\tA\t\t.\t.\tAF=1"])
    got = [tuple(r) for r in text.frequencies(own, {"AF": "af", "AN": "an"}).select("rsid", "pos", "alt", "af", "an").collect()]
    assert got == [("rs1", 10, "G", 0.1, None), ("rs2", 10, "T", 0.2, None), ("rs3", 11, "G", None, 5.0), ("rs3", 11, "T", None, 6.0), (None, 12, "G", None, None)]
    own = lines(spark, ["1\t10\t.\tA\tG\t.\t.\tSpliceAI=G|X|0.1|0.9|.|0|1|2|3|4,G|Y|.|.|.|.|1|2|3|4,T|Z|1", "1\t11\t.\tA\tG\t.\t.\tDP=1"])
    assert [(r["gene"], r["ds_max"]) for r in text.nested_scores(own).collect()] == [("X", 0.9)]


def test_imputed_vcf(spark):
    own = lines(spark, ["1\t10\t.\tA\tG,T\t.\tPASS\tDR2=0.9,0.8;AF=0.1;IMP\tGT:DS\t1|2:0.9,1.1", "1\t11\t.\tC\tT\t.\tPASS\tDR2=0.5\tGT:DS\t0|1"])
    got = [tuple(r) for r in text.imputed(own).select("pos", "alt", "dosage", "copies", "quality", "af", "is_imputed").collect()]
    assert got == [(10, "G", 0.9, 1, 0.9, 0.1, True), (10, "T", 1.1, 1, 0.8, None, True), (11, "T", None, 1, 0.5, None, False)]
    with pytest.raises(Exception, match="more than one sample"):
        text.imputed(lines(spark, ["1\t1\t.\tA\tG\t.\t.\t.\tGT\t0|1\t0|1"])).collect()


def test_other_scans(spark, tmp_path):
    m = text.merge_history(lines(spark, ["7\t3\t130\t0\tx\ty\t2\t0\tc", "8\t4\t130\t0\tx\ty\t\t0\tc", "9\t9\t130\t0\tx\ty\t9\t0\tc", "1\t2"]))
    assert [(r["old_rsid"], r["current_rsid"]) for r in m.collect()] == [("rs7", "rs2"), ("rs8", "rs4")]
    odd = text.merge_history(lines(spark, ["\t".join(x) for x in (["", "3", "", "", "", "", "2"], ["rs7", "3", "b", "", "", "", "rs9"], ["7", " ", "", "", "", "", " "], ["rs7", "7", "", "", "", "", ""])]))
    assert [tuple(r) for r in odd.collect()] == [("rs7", "rs9", None)]
    b = text.bed(lines(spark, ["track x", "#c", "chr1\t5\t9\tn", "1\t9\t5", "1\ta\t5", "1\t2"])).collect()
    assert [(r["chrom"], r["start"], r["end"], r["name"], r["reason"]) for r in b] == [("1", 5, 9, "n", None), ("1", 9, 5, None, "range"), ("1", None, 5, None, "number"), ("1", 2, None, None, "arity")]
    c = text.regulatory_bed(lines(spark, ["chr1\t1\t5\tEHD1\tEH38E1\tPLS", "chr1\t1\t5\tE2,dELS\tx", "chrZ\t1\t5\tE\tPLS", "1\t1\t5\tE\tzzz", "1\tq\t5\tE\tPLS"])).collect()
    assert [(r["accession"], r["ccre_class"], r["reason"]) for r in c] == [("EH38E1", "PLS", None), ("E2", "dELS", None), ("E", "PLS", "invalid_chrom"), ("E", None, "unknown_class"), ("E", "PLS", "malformed")]
    assert text.gene_list("brca1, TP53;x y\n# c\nBRCA1 9z") == (["BRCA1", "TP53", "X", "Y"], ["not a gene symbol: 9z"])
    for bad in ("# none", "9z", " ".join(f"G{i}" for i in range(5001))):
        with pytest.raises(text.FormatError):
            text.gene_list(bad)
    path = tmp_path.parent / f"{tmp_path.name}.bed"
    path.write_text("".join(f"chr1\t{i}\t{i + 5}\tn{i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        split = text.bed(text.numbered_lines(spark, f"file://{path}")).orderBy("record").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r["record"]["file_block_start"] for r in split}) > 3 and [r["start"] for r in split] == list(range(3000))
    head = ["MAPPED_TRAIT", "DISEASE/TRAIT", "INITIAL SAMPLE SIZE", "OR or BETA", "95% CI (TEXT)", "SNPS", "P-VALUE"]
    g = spark.createDataFrame([("body height", "", "1,200 men and 300 women", "1.2", "[1.1-1.3]", "rs1", "3e-9"), ("", "Height", "none", "0.3", "[0.1-0.4] unit increase", "rs2; rs3", "x"), ("eye", "", "", "", "", "rs4", "1"), ("height", "", "", "", "", "chr1", "1")], head)
    assert [tuple(r) for r in text.associations(g, ["height"]).collect()] == [("rs1", "body height", 3e-9, 1.2, True, 1500), ("rs2", "Height", None, 0.3, False, None)]
    w = text.score_weights(spark.createDataFrame([("rs1", "1", "5", "a", "g", "0.5", "1", "6"), ("", "2", "7", "C", "", "x", "", "")], ["rsID", "chr_name", "chr_position", "effect_allele", "other_allele", "effect_weight", "hm_chr", "hm_pos"]))
    assert [tuple(r) for r in w.collect()] == [("rs1", "1", 6, "A", "G", 0.5, None), (None, "2", 7, "C", None, None, "weight")]
    assert text.score_header(["#pgs_id=PGS1", "x"]) == {"pgs_id": "PGS1"}
    p = text.phenotypes(lines(spark, ["\t".join(["1"] * 5 + ["A,B", "B1, C", "n", "SYM", "", "", "", "{Disease one}, 123456 (3), Autosomal dominant; ?Two (2)"])])).collect()
    assert [tuple(r) for r in p] == [("SYM", "Disease one", "123456", 3, "Autosomal dominant"), ("SYM", "Two", None, 2, None)]
    t = text.transcript_scores(spark.createDataFrame([("0.1;0.02;.", ".", "T;D"), (".", "-", "B")], "s string, p string, q string"), {"s": "s_min"}, {"p": "p_max"}, {"q": ("worst", {"D": 2, "T": 1})}).collect()
    assert [(r["s_min"], r["p_max"], r["worst"]) for r in t] == [(0.02, None, "D")]
    (tmp_path / "Liver.v8.tsv").write_text("variant_id\tgene_id\tslope\tpval_nominal\nv1\tg1\t0.5\t1e-3\nv9\tg1\t1\t1\n")
    e = text.tissue_files(spark, str(tmp_path), spark.createDataFrame([("v1", "rs1")], "variant_id string, rsid string")).collect()
    assert [tuple(r) for r in e] == [("Liver", "rs1", "g1", 0.5, 0.001)]
    rows, n = text.curations(spark.createDataFrame([("G", "d", "Definitive"), ("+++", "", ""), ("H", "d", "Odd")], "a string, b string, c string"), ["Definitive"])
    assert rows.count() == 1 and n.first()["n"] == 1
    a = text.allele_table(spark.createDataFrame([("G", "*1", "oops"), ("G", "*2", '[{"rsid":"rs1","ref":"A","alt":"G"}]'), ("", "*3", "[]")], "gene string, allele_name string, defining_variants string")).collect()
    assert [len(r["defining_variants"]) for r in a] == [0, 1]
    d = text.gene_phenotypes(spark.createDataFrame([("G", "M1", "b"), ("G", "M1", "a"), ("G", "M2", "c")], "gene string, disease_id string, disease_name string"), spark.createDataFrame([("G", "O1", "H2", "two", False), ("G", "O1", "H1", "one", False), ("G", "O1", "H9", "AD", True)], "gene string, source_id string, term_id string, term_name string, is_inheritance boolean"), spark.createDataFrame([("O1", "M1")], "source_id string, disease_id string"))
    got = {r["disease_id"]: r for r in d.collect()}
    assert [x["term_id"] for x in json.loads(got["M1"]["hpo_terms"])] == ["H1", "H2"] and got["M1"]["inheritance"] == "AD" and got["M2"]["hpo_terms"] is None


def variants(spark):
    rows = [("rs1", "2", 5, "AG", "A", "G", "het"), ("rs2", "1", 9, "--", None, None, None), ("rs3", "1", 7, "CT", None, None, None), ("rs4", "X", 1, "A", "A", "G", "hom_ref"), ("rs5", "10", 1, "TT", None, None, None)]
    return spark.createDataFrame(rows, "rsid string, chrom string, pos long, genotype string, ref string, alt string, zygosity string")


def test_vcf_sink_and_back(spark, tmp_path):
    path = str(tmp_path / "v")
    sinks.write_vcf(variants(spark), path)
    got = [r["value"] for r in spark.read.text(path).collect()]
    assert tuple(got[:3]) == sinks.HEADER
    assert [x.split("\t")[2:5] + [x.split("\t")[9]] for x in got[3:]] == [["rs3", "N", "C,T", "1/2"], ["rs1", "A", "G", "0/1"], ["rs5", "N", "T", "1/1"], ["rs4", "A", "G", "0"]]
    sinks.write_vcf_by_chromosome(variants(spark), str(tmp_path / "w"))
    assert spark.read.text(str(tmp_path / "w")).select("unit").distinct().count() == 4
    alleles = spark.createDataFrame([("rs3", "1", 7, "C", "T", "het")], "rsid string, chrom string, pos long, ref string, alt string, zygosity string")
    got = [r["value"] for r in sinks.region_lines(variants(spark).drop("ref", "alt", "zygosity"), alleles, "1", 6, 9).collect()]
    assert [x.split("\t")[2:5] + [x.split("\t")[9]] for x in got] == [["rs3", "C", "T", "0/1"], ["rs2", "N", ".", "./."]]


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a"b'), (1, None)], "i int, s string")
    assert "".join(sinks.delimited(df, ",", [F.col("i")])) == 'i,s\n1,\n2,"a""b"\n' and "".join(sinks.delimited(df.limit(0), "\t")) == "i\ts\n"
    assert json.loads("".join(sinks.json_array(df, [F.col("i")]))) == [{"i": 1, "s": None}, {"i": 2, "s": 'a"b'}] and "".join(sinks.json_array(df.limit(0))) == "[]"
    for kind, sep in (("csv", ","), ("tsv", "\t")):
        sinks.write_table(df.limit(0), str(tmp_path / kind), kind)
        assert spark.read.option("header", True).option("sep", sep).csv(str(tmp_path / kind)).columns == ["i", "s"]
    p = spark.createDataFrame([("s", i, z) for i, z in enumerate(["hom_alt", None, "het", "hom_ref", "het"])], "snp string, sample_id int, zygosity string")
    assert bytes(sinks.plink_codes(p).first()["block"]) == bytes([0b11100100, 0b10])
    assert json.loads(sinks.bundle(df.filter("i = 1"), F.lit("Bundle"), ["i"]).first()["value"]) == {"resourceType": "Bundle", "i": 1}


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE t", "INSERT INTO t VALUES (1)", "CREATE TABLE x AS SELECT 1", "SELECT 1; SELECT 2", "", "SELEC 1", "SELECT * FROM secret", "SELECT (SELECT max(x) FROM secret) FROM t", "SET a=b",
        "WITH c AS (SELECT * FROM secret) SELECT * FROM c", "SELECT * FROM parquet.`/etc`", "DESCRIBE t", "SELECT * FROM t WHERE i IN (SELECT x FROM secret)", "TRUNCATE TABLE t", "CACHE TABLE t", "SELECT * FROM t UNION SELECT * FROM secret",
        "SELECT * FROM secret /* , secret as ( */", "SELECT ', secret as (' AS s, x FROM secret", "SELECT reflect('java.lang.System', 'getProperty', 'java.version')", "SELECT i, java_method('java.lang.System', 'nanoTime') FROM t",
        "SELECT * FROM (WITH secret AS (SELECT 1 AS x) SELECT x FROM secret) JOIN secret", "WITH a AS (SELECT * FROM secret), secret AS (SELECT 1 AS x) SELECT * FROM a", "SELECT nothing_known(i) FROM t", "SELECT input_file_name() FROM t",
        "SELECT i FROM t WHERE EXISTS (SELECT 1 FROM secret WHERE x = i)", "SELECT sum(i) OVER (ORDER BY (SELECT max(x) FROM secret)) FROM t", "SELECT * FROM IDENTIFIER('secret')", "SELECT * FROM t, LATERAL (SELECT * FROM secret)",
        "EXECUTE IMMEDIATE 'SELECT * FROM secret'", "BEGIN SELECT 1; END", "SELECT IDENTIFIER('reflect')('java.lang.System', 'nanoTime')", "SELECT transform(array(1), x -> reflect('java.lang.System', 'nanoTime'))", "FROM secret |> SELECT x",
        "WITH `parquet./etc` AS (SELECT 1 AS x) SELECT x FROM parquet.`/etc`", "WITH `db.secret` AS (SELECT 1 AS x) SELECT x FROM db.secret", "SELECT * FROM `t.x`",
    ],
)
def test_console_refuses(spark, sql):
    spark.range(3).toDF("i").createOrReplaceTempView("t")
    spark.range(3).toDF("x").createOrReplaceTempView("secret")
    with pytest.raises(console.QueryError):
        console.run_sql(spark, sql, ["t"])


def test_console_runs(spark):
    spark.range(5).toDF("i").createOrReplaceTempView("t")
    names, rows, more = console.run_sql(spark, "WITH c AS (SELECT i FROM t WHERE i > 0) SELECT i AS drop_me FROM c WHERE i IN (SELECT i FROM t) ORDER BY i;", ["T"], limit=3)
    assert (names, rows, more) == (["drop_me"], [(1,), (2,), (3,)], True)
    assert console.run_sql(spark, "SELECT 'a;b' AS x", [])[1] == [("a;b",)]
    more = ["WITH secret AS (SELECT 7 AS i) SELECT i FROM secret WHERE i > (SELECT max(i) FROM t)", "SELECT count(*) + 3 FROM t, range(1) WHERE i >= 1", "SELECT max(v) + 1 FROM t LATERAL VIEW explode(array(i, 6)) e AS v", "SELECT i + 4 FROM t WHERE i = 3 GROUP BY i HAVING count(*) = 1", "SELECT first_value(7) OVER w FROM t WINDOW w AS (ORDER BY i) LIMIT 1"]
    assert [console.run_sql(spark, q, ["t"])[1] for q in more] == [[(7,)]] * len(more)
    with pytest.raises(TimeoutError):
        console.run_sql(spark, "SELECT sum(sin(id)) FROM range(1000000000000)", ["t"], deadline_s=2)


def test_registries_and_modules(spark):
    r = console.Registry()
    r.add("a", {"rules": []})
    with pytest.raises(KeyError):
        r.add("a", {})
    r.replace("a", ["nope"])
    assert console.Registry(r.text()).items == {"a": ["nope"]}
    with pytest.raises(rules.RuleError):
        console.preset(spark.range(1), r, "a")
    r.remove("a")
    out, errors = console.run_modules([("one", lambda s: s.range(2)), ("bad", lambda s: 1 / 0), ("two", lambda s: s.range(1).withColumn("x", F.lit(1)))], spark)
    assert out.count() == 3 and list(errors) == ["bad"]
    rows = spark.createDataFrame([("r1",), ("r2",)], "rsid string")
    got = console.tag(spark.createDataFrame([("r1", 1), ("r1", 2), ("r9", 1)], "rsid string, tag_id int"), spark.createDataFrame([(1, "b"), (2, "a")], "tag_id int, name string"), "rsid", rows)
    assert {r["rsid"]: r["tags"] for r in got.collect()} == {"r1": ["a", "b"], "r2": []}


def feed(spark, folder, parts):
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(folder)
        del i


def test_streams_equal_batches(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").cache()
    n = src.count()
    cut = src.selectExpr(f"percentile_approx(unix_micros(ts), array(0.33, 0.66)) as p").first()["p"]
    us = F.unix_micros("ts")
    folder = str(tmp_path / "in")
    feed(spark, folder, [src.filter(us < cut[0]), src.filter((us >= cut[0]) & (us < cut[1])), src.filter(us >= cut[1])])
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(events.tumbling(src).drop("total"))
    closed = key(events.drain(events.tumbling(events.read(spark, folder)), "w1").drop("total"))
    assert set(closed) <= set(whole) and len(closed) >= 0.8 * len(whole)
    assert key(events.drain(events.tumbling(events.read(spark, folder)), "w2", "complete").drop("total")) == whole
    assert events.drain(events.first_seen(events.read(spark, folder)), "d1").count() == n
    totals = events.drain(events.running_totals(events.read(spark, folder)), "t1", "update").groupBy("user_id").agg(F.max("n").alias("n"))
    assert key(totals) == key(src.groupBy("user_id").agg(F.count("*").alias("n")))


def test_late_rows_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "in")
    make = lambda rows: spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    feed(spark, folder, [make([(1, "2024-01-01 00:10:00", 1, "a", 1.0, "")]), make([(2, "2024-01-01 09:00:00", 1, "a", 1.0, "")]), make([(3, "2024-01-01 00:20:00", 1, "a", 1.0, ""), (4, "2024-01-01 12:00:00", 1, "a", 1.0, "")])])
    got = events.drain(events.tumbling(events.read(spark, folder)), "late").orderBy("window_start").collect()
    assert got[0]["n"] in (1, 2) and sum(r["n"] for r in got) <= 3
