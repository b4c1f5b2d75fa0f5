"""The enrichment pipeline on invented calls and sources."""

import pytest
from pyspark.sql import functions as F

from loomframe.plans import annotate as A

CALLS = [
    ("rs1", "1", 100, "AG"), ("rs2", "1", 200, "CC"), ("i3", "1", 300, "TT"), ("rs4", "2", 50, "--"), ("rs5", "2", 60, "AC"), ("rs6", "2", 70, "GG"), ("rs7", "3", 10, "II"), ("rs8", "3", 20, "AT"), ("rs9", "3", 30, "AG"), ("old1", "4", 5, "AG"),
]


@pytest.fixture(scope="module")
def wide(spark):
    raw = spark.createDataFrame(CALLS, "rsid string, chrom string, pos long, genotype string")
    v = "rsid string, chrom string, pos long, ref string, alt string, gene_symbol string, transcript_id string, consequence string, hgvs_coding string, hgvs_protein string, mane_select int"
    t = lambda r, c, p, ref, alt, gene, tx, cons, mane: (r, c, p, ref, alt, gene, tx, cons, None, None, mane)
    vep = spark.createDataFrame([
        t("rs1", "1", 100, "A", "G", "G1", "t2", "stop_gained", 0), t("rs1", "1", 100, "A", "G", "G1", "t1", "missense_variant&intron_variant", 1), t("rs2", "1", 200, "C", "T", "G2", "t3", "intron_variant", 0), t("rs2", "1", 200, "C", "T", "G2", "t4", "stop_lost", 0),
        t("rs30", "1", 300, "C", "T", "G3", "t5", "missense_variant", 1), t("rs5", "2", 60, "A", "C", "G5", "t6", "missense_variant", 0), t("rs5", "2", 60, "A", "G", "G5x", "t7", "stop_gained", 1), t("rs8", "3", 20, "C", "G", "G8", "t8", "stop_gained", 0), t("rs8", "3", 20, "C", "T", "G8", "t9", "stop_gained", 0),
        t("new1", "4", 5, "A", "G", "G10", "t10", "synonymous_variant", 0),
    ], v)
    c = "rsid string, chrom string, pos long, ref string, alt string, significance string, review_stars int, accession string, conditions string, gene_symbol string"
    clinvar = spark.createDataFrame([
        ("rs1", "1", 100, "A", "T", "Pathogenic", 4, "V1", "x", "G1"), ("rs1", "1", 100, "A", "G", "Likely benign", 1, "V2", "y", "G1"), ("rs2", "1", 999, "C", "T", "Pathogenic", 2, "V3", "z", "G2"), ("rs6", "2", 70, "A", "G", "Pathogenic", 2, "V4", "w", "G6"), ("rs7", "3", 9, "A", "AT", "Pathogenic", 1, "V5", "i", "G7"),
        ("rs9", "3", 30, "A", "G", "Uncertain significance", 1, "V6", "u", "G9"),
    ], c)
    g = "rsid string, chrom string, pos long, ref string, alt string, af_global double, af_afr double, homozygous_count long"
    gnomad = spark.createDataFrame([("rs1", "1", 100, "A", "G", 0.002, 0.03, 0), ("rs1", "1", 100, "A", "T", 0.5, 0.5, 9), ("rs6", "2", 70, "A", "C", 0.4, 0.4, 1), ("rs8", "3", 20, "C", "G", 0.1, 0.1, 0), ("rs8", "3", 20, "C", "T", 0.2, 0.2, 0), ("rs4", "9", 1, "A", "C", 0.3, 0.3, 1), ("rs4", "9", 2, "A", "C", 0.3, 0.3, 1)], g)
    d = "rsid string, chrom string, pos long, ref string, alt string, cadd_phred double, sift_score double, polyphen2_hsvar_score double, revel double"
    dbnsfp = spark.createDataFrame([("rs9", "3", 30, "A", "C", 1.0, 0.9, 0.1, 0.1), ("rs9", "3", 30, "A", "G", 30.0, 0.01, 0.99, 0.9), ("rs1", "1", 100, "A", "G", 30.0, 0.01, 0.99, 0.9)], d)
    am = spark.createDataFrame([("1", 100, "A", "G", 0.9, "likely_pathogenic"), ("2", 70, "A", "G", 0.1, "likely_benign")], "chrom string, pos long, ref string, alt string, am_pathogenicity double, am_class string")
    gp = spark.createDataFrame([("G1", "obsolete thing", "M0", "[]", "AD"), ("G6", "b", "M2", None, None), ("G6", "c", "M3", "[]", "AD"), ("G1", "d", "M4", None, None)], "gene_symbol string, disease_name string, disease_id string, hpo_terms string, inheritance string")
    merges = spark.createDataFrame([("old1", "new1")], "old_rsid string, current_rsid string")
    return A.annotate(raw, A.Sources(merges, vep, clinvar, gnomad, dbnsfp, am, gp)).cache()


def test_choices(wide):
    got = {r["rsid"]: r for r in wide.collect()}
    assert len(got) == len(CALLS)
    r = got["rs1"]  # the MANE transcript, the carried assertion before the one with more stars, frequencies of the exact allele
    assert (r["transcript_id"], r["clinvar_accession"], r["alt"], r["zygosity"], r["gnomad_af_global"], r["gnomad_af_popmax"]) == ("t1", "V2", "G", "het", 0.002, 0.03)
    assert r["am_class"] == "likely_pathogenic" and r["disease_name"] is None and r["annotation_coverage"] == 1 | 2 | 4 | 8 | 128 and not r["rare_flag"]
    r = got["rs2"]  # severity decides without MANE; the assertion stands elsewhere
    assert (r["transcript_id"], r["clinvar_accession"], r["zygosity"], r["annotation_coverage"]) == ("t4", None, "hom_ref", 1)
    assert got["i3"]["transcript_id"] == "t5" and got["i3"]["zygosity"] == "hom_alt"  # met by place
    assert got["rs4"]["annotation_coverage"] == 0 and got["rs4"]["gnomad_source_status"] == "locus_unresolved"
    assert got["rs5"]["transcript_id"] == "t6"  # the one allele carried, though another ranks higher
    assert got["rs6"]["gnomad_af_global"] is None and got["rs6"]["disease_id"] == "M3" and got["rs6"]["zygosity"] == "hom_alt"  # an exact miss has no way back
    assert got["rs7"]["clinvar_accession"] == "V5"  # an indel anchored one base before
    assert got["rs8"]["transcript_id"] is None and got["rs8"]["vep_ambiguous"] and got["rs8"]["gnomad_source_status"] == "allele_ambiguous"
    assert got["rs9"]["evidence_conflict"] and got["rs9"]["deleterious_count"] == 4 and not got["rs1"]["evidence_conflict"] is None
    assert got["old1"]["dbsnp_rsid_current"] == "new1" and got["old1"]["transcript_id"] == "t10"


def test_stats_and_rare(spark, wide):
    n = {r["source"]: r for r in A.coverage_stats(wide, F.lit("S1"), ["S1", "S2"]).collect()}
    assert n["S1"]["n"] == 10 and n["S1"]["n_none"] == 2 and n["S2"]["n"] == 0
    rare = [r["rsid"] for r in A.rare_variants(wide, 0.05).collect()]
    assert rare[0] in ("rs1", "rs9") and "rs2" not in rare and "rs6" not in rare  # rs6: an unsupported homozygote of a dominant gene
    assert [r["rsid"] for r in A.rare_variants(wide, 0.05, include_novel=False).collect()] == ["rs1"]
    assert A.rare_variants(wide, genes=["g9"]).first()["rsid"] == "rs9"


def test_without_sources(spark):
    raw = spark.createDataFrame(CALLS, "rsid string, chrom string, pos long, genotype string")
    out = A.annotate(raw, A.Sources())
    assert out.count() == len(CALLS) and out.filter("annotation_coverage <> 0").count() == 0
    assert A.annotate(raw.limit(0), A.Sources()).count() == 0


def test_imputed_findings(spark):
    k = "chrom string, pos long, ref string, alt string"
    imp = spark.createDataFrame([("1", 1, "A", "G", 1, 1.0, 0.9, 0.2), ("1", 2, "A", "G", 1, 1.0, 0.5, 0.2), ("1", 3, "A", "G", 0, 0.0, 0.9, 0.2), ("1", 4, "A", "G", 2, 2.0, 0.9, 0.999), ("1", 5, "A", "G", 2, 2.0, 0.95, 0.3)], k + ", copies int, dosage double, quality double, af double")
    typed = spark.createDataFrame([("1", 5, "A", "G")], k)
    clin = spark.createDataFrame([("1", i, "A", "G", "Pathogenic", s, f"V{i}{s}") for i in range(1, 6) for s in (1, 2)] + [("1", 1, "A", "G", "Benign", 4, "B")], k + ", significance string, review_stars int, accession string")
    got = A.imputed_findings(imp, typed, clin).collect()
    assert [(r["pos"], r["accession"], r["evidence_level"]) for r in got] == [(1, "V12", 3)]


def test_ingest(spark, tmp_path):
    old = tmp_path / "old.txt"
    old.write_text("# build 36\n# rsid\tchromosome\tposition\tgenotype\nrs1\t1\t150\tAG\nrs2\t1\t900\tCC\n")
    chain = spark.createDataFrame([("1", 100, 200, "1", 1000, "+", 5000, 0)], "t_chrom string, t_start long, t_end long, q_chrom string, q_start long, strand string, q_size long, block int")
    assert A.ingest(spark, str(old), str(tmp_path / "raw"), "s1", chain) == "GRCh36"
    new = tmp_path / "new.txt"
    new.write_text("# build 37\n# rsid\tchromosome\tposition\tgenotype\nrs1\t1\t150\tAG\n")
    assert A.ingest(spark, str(new), str(tmp_path / "raw"), "s2") == "GRCh37"
    got = sorted((r["sample_id"], r["rsid"], r["pos"]) for r in spark.read.parquet(str(tmp_path / "raw")).collect())
    assert got == [("s1", "rs1", 1050), ("s2", "rs1", 150)]
    with pytest.raises(ValueError):
        A.ingest(spark, str(old), str(tmp_path / "raw"), "s3")


def test_candidates_are_not_shuffled(spark):
    """Calls are dealt by id once and by place once, whatever the number of sources; equal calls and those without an id keep their rows."""
    calls = spark.createDataFrame([("rs1", "1", 5, "AG"), ("rs1", "1", 5, "AG"), (None, "1", 5, "AG"), (".", None, None, "AG")], "rsid string, chrom string, pos long, genotype string")
    vep = spark.createDataFrame([("rs1", "1", 5, "A", "G", "G1", "t1", "stop_gained", None, None, 1)], "rsid string, chrom string, pos long, ref string, alt string, gene_symbol string, transcript_id string, consequence string, hgvs_coding string, hgvs_protein string, mane_select int")
    dbnsfp = spark.createDataFrame([("rs1", "1", 5, "A", "G", 30.0)], "rsid string, chrom string, pos long, ref string, alt string, cadd_phred double")
    keyed = calls.withColumns({"_row": A.row_key(), "lookup_id": F.when(F.col("rsid") != ".", F.col("rsid"))})
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = A.again(A.picked(A.once(keyed), A.vep_pick(vep), A.dbnsfp_pick(dbnsfp)))
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2 + 2 * 2
        got = sorted((r["rsid"] or "", r["_vep"] and r["_vep"]["vep"]["way"], r["dbnsfp"] and r["dbnsfp"]["s"]["cadd_phred"]) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert got == [("", 1, 30.0), (".", None, None), ("rs1", 0, 30.0), ("rs1", 0, 30.0)]


VEP = "rsid string, chrom string, pos long, ref string, alt string, gene_symbol string, transcript_id string, consequence string, hgvs_coding string, hgvs_protein string, mane_select int"
SCORES = "rsid string, chrom string, pos long, ref string, alt string, cadd_phred double"


def test_records_are_shuffled_once(spark):
    """Records go by place only, all sources in one shuffle, if every id's records stand where its calls do."""
    calls = spark.createDataFrame([("rs1", "1", 5, "AG"), ("rs1", "1", 5, "AG"), ("i2", "1", 5, "AA"), (None, "1", 5, "AG"), (".", None, None, "AG")], "rsid string, chrom string, pos long, genotype string")
    vep = spark.createDataFrame([("rs1", "1", 5, "A", "G", "G1", "t1", "stop_gained", None, None, 1)], VEP)
    dbnsfp = spark.createDataFrame([("rs1", "1", 5, "A", "G", 30.0), (".", "7", 7, "A", "G", 1.0), (None, None, None, "A", "G", 1.0)], SCORES)
    gnomad = spark.createDataFrame([("rs1", "1", 5, "A", "G", 0.2), ("rs1", "1", 5, "A", "T", 0.1)], "rsid string, chrom string, pos long, ref string, alt string, af_global double")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = A.annotate(calls, A.Sources(vep=vep, dbnsfp=dbnsfp, gnomad=gnomad))
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        got = sorted((r["rsid"] or "", r["transcript_id"], r["cadd_phred"], r["gnomad_af_global"]) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert got == [("", "t1", 30.0, 0.2), (".", None, None, None), ("i2", "t1", 30.0, 0.2), ("rs1", "t1", 30.0, 0.2), ("rs1", "t1", 30.0, 0.2)]


@pytest.mark.parametrize("few", [1_000, 0])
def test_scattered_ids(spark, rows, monkeypatch, few):
    """Ids with records or calls at several places, or at unknown ones, give what joins by id and by place give, broadcast or not."""
    monkeypatch.setattr(A, "FEW_IDS", few)
    calls, vep, dbnsfp, clinvar = [], [], [], []
    for i in range(60):
        place = ("1", i % 25) if i % 7 else (None, i)
        genotype = ("AG", "CC", "AC", "--", "II", "GT")[i % 6]
        calls += [(i, f"rs{i % 40}" if i % 11 else None, *place, genotype)] * (1 + (i % 13 == 0))
        for j in range(i % 4):
            at = ("1", i % 25 + (i % 5 == 0)) if i % 9 else (None, None)
            ref, alt = "AC"[j % 2], "GTA"[(i + j) % 3]
            vep.append((f"rs{i % 40}", *at, ref, alt, "G", f"t{i}_{j}", ("stop_gained", "intron_variant")[j % 2], None, None, i % 2))
            dbnsfp.append((f"rs{i % 40}", *at, ref, f"{alt}{'A' * i}", float(i * 4 + j)))
            clinvar.append((f"rs{i % 40}", *at, ref, alt, "Benign", i % 3, f"V{i}_{j}", None, None))
    raw = spark.createDataFrame(calls, "k int, rsid string, chrom string, pos long, genotype string")
    vep, dbnsfp = spark.createDataFrame(vep, VEP), spark.createDataFrame(dbnsfp, SCORES)
    clinvar = spark.createDataFrame(clinvar, "rsid string, chrom string, pos long, ref string, alt string, significance string, review_stars int, accession string, conditions string, gene_symbol string")
    got = A.annotate(raw, A.Sources(vep=vep, clinvar=clinvar, dbnsfp=dbnsfp)).select("k", "transcript_id", "vep_ambiguous", "clinvar_accession", "cadd_phred")
    keyed = raw.withColumns({"_row": A.row_key(), "lookup_id": F.col("rsid")})
    want = A.again(A.picked(A.once(keyed), A.vep_pick(vep), A.clinvar_pick(clinvar), A.dbnsfp_pick(dbnsfp))).select("k", "_vep.vep.s.transcript_id", "_vep.ambiguous", "clinvar.s.accession", "dbnsfp.s.cadd_phred")
    assert rows(got) == rows(want) and any(r["transcript_id"] for r in got.collect())
    n = A.scattered(keyed, [vep, dbnsfp, clinvar])[1]
    assert 0 < n < 40
