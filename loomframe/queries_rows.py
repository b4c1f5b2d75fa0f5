"""Registered queries, third part: stores, documents, panels' special callers, rows against what is declared now."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.durable import shared_folder
from loomframe.functions import genotype as G
from loomframe.operators import lookup, merge, paging, panels, rules, scores, selection
from loomframe.plans import annotate as enrich
from loomframe.plans.panels import PanelStore
from loomframe.sources import sinks, text
from loomframe.streaming import episodes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def read(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letter(c):
    return F.substring(F.lit("ACGT"), (c % 4 + 1).cast("int"), F.lit(1))


def key() -> Column:
    return F.col("p_partkey")


def size() -> Column:
    return F.col("p_size")


# --- stores -------------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey FROM part p WHERE 'G' || p_size % 20 IN (SELECT 'G' || s_suppkey % 20 FROM supplier WHERE s_suppkey % 20 BETWEEN 3 AND 5)
OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 5 = p_partkey % 5 AND p_partkey * 10 - 1 < s_suppkey * 100 + 55 AND s_suppkey * 100 < p_partkey * 10 - 1 + length(CASE WHEN p_size % 2 = 0 THEN 'AT' ELSE 'A' END))
""")
def panel_search(spark, sf_dir):
    """Panels saved, replaced, deleted and searched by gene and by region."""
    store = PanelStore(spark, f"{shared_folder(spark)}/panels-{uuid.uuid4().hex}")
    s = read(spark, sf_dir, "supplier")
    gene = F.concat(F.lit(" g"), F.col("s_suppkey") % 20).alias("gene")
    store.save_genes("my genes/1", s.select(gene))
    store.save_genes("my genes/1", s.filter("s_suppkey % 20 between 3 and 5").select(gene), "fewer")
    at = F.col("s_suppkey") * 100
    store.save_regions("regions", s.select((F.col("s_suppkey") % 5).cast("string").alias("chrom"), at.alias("start"), (at + 55).alias("end"), F.col("s_name").alias("name")))
    store.save_genes("gone", s.select(gene))
    if not store.delete("gone") or store.names() != ["my genes/1", "regions"]:
        raise AssertionError("a deleted panel is still there")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("G"), size() % 20).alias("gene_symbol"), (key() % 5).cast("string").alias("chrom"), (key() * 10).alias("pos"), F.when(size() % 2 == 0, "AT").otherwise("A").alias("ref"))
    return store.search(rows, store.names()).select("p_partkey")


@query("""
WITH t AS (SELECT l_orderkey AS k, l_linenumber AS tag FROM lineitem WHERE l_linenumber <= 2), n AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS tag FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4)
SELECT k, tag FROM (SELECT * FROM t UNION ALL SELECT * FROM n WHERE (k, tag) NOT IN (SELECT k, tag FROM t)) WHERE (k, tag) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 3 AND l_quantity > 25)
""")
def link_rows(spark, sf_dir):
    """Links inserted where they are not there yet, and others deleted."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("tag"), "l_quantity")
    held = merge.insert_ignore(li.filter("tag <= 2").drop("l_quantity"), li.filter("tag between 2 and 4").drop("l_quantity"), ["k", "tag"])
    return merge.delete_keys(held, li.filter("tag = 3 and l_quantity > 25"), ["k", "tag"])


@query("""
WITH w AS (SELECT c_custkey AS rsid, c_mktsegment AS was, c_acctbal AS watched_at FROM customer), n AS (SELECT o_custkey AS rsid, min(o_orderpriority) AS now FROM orders GROUP BY 1)
SELECT rsid, was, now, row_number() OVER (ORDER BY watched_at DESC, rsid) AS place FROM w LEFT JOIN n USING (rsid) QUALIFY place <= 40
""")
def watched_values(spark, sf_dir):
    """The value that was stored beside the one of now, newest watch first."""
    w = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rsid"), F.col("c_mktsegment").alias("was"), F.col("c_acctbal").alias("watched_at"))
    now = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rsid"), F.col("o_orderpriority").alias("now"))
    page = paging.ranked_page(lookup.exact(w, now, ["rsid"], ["now"]), [F.col("watched_at").desc(), F.col("rsid")], 40)
    # The page's rows are numbered, so that their order is compared; it has 40 rows.
    return page.select("rsid", "was", "now", F.row_number().over(Window.orderBy(F.col("watched_at").desc(), "rsid")).cast("long").alias("place"))


@query("""
WITH src AS (SELECT o_orderkey AS w, o_custkey AS k, o_orderkey % 97 AS pos FROM orders), m AS (SELECT c_custkey AS k, c_custkey % 97 AS pos, c_name AS target FROM customer WHERE c_custkey % 2 = 0),
f AS (SELECT pos, min(target) AS t FROM m GROUP BY 1)
SELECT w, coalesce(m.target, f.t) AS target, CASE WHEN m.target IS NOT NULL THEN 'key' WHEN f.t IS NOT NULL THEN 'fallback' END AS matched_by FROM src LEFT JOIN m ON src.k = m.k LEFT JOIN f ON src.pos = f.pos
""")
def migrated_rows(spark, sf_dir):
    """Rows of one sample found in a merged one, by name and else by place."""
    src = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("w"), F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 97).alias("pos"))
    c = F.col("c_custkey")
    merged = read(spark, sf_dir, "customer").filter(c % 2 == 0).select(c.alias("k"), (c % 97).alias("pos"), F.col("c_name").alias("target"))
    return lookup.key_then_fallback(src, merged, ["k"], ["pos"], [F.col("target")], ["target"]).select("w", "target", "matched_by")


@query("""
WITH f AS (SELECT o_orderkey AS id, o_custkey AS rsid FROM orders), a AS (SELECT c_custkey AS rsid, CASE c_nationkey % 4 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely pathogenic' WHEN 2 THEN 'Benign' END AS significance, c_nationkey % 5 AS stars FROM customer)
SELECT id, rsid, significance, stars FROM f LEFT JOIN a USING (rsid) WHERE significance IN ('Pathogenic', 'Likely pathogenic')
""")
def assessed_findings(spark, sf_dir):
    """Findings with what is annotated at their row, pathogenic ones only."""
    f = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("rsid"))
    n = F.col("c_nationkey")
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rsid"), F.when(n % 4 == 0, "Pathogenic").when(n % 4 == 1, "Likely pathogenic").when(n % 4 == 2, "Benign").alias("significance"), (n % 5).alias("stars"))
    out = lookup.exact(f, a, ["rsid"], ["significance", "stars"])
    return out.filter(rules.primary_term(F.col("significance"), "Pathogenic") | rules.primary_term(F.col("significance"), "Likely pathogenic")).select("id", "rsid", "significance", "stars")


@query("""
WITH s AS (SELECT l_suppkey % 40 AS sample_id, l_suppkey % 40 % 3 AS format, avg((l_partkey % 3 = 0)::INT) AS rate FROM lineitem GROUP BY 1, 2)
SELECT a.sample_id, a.format, round(a.rate, 6) AS rate, round(CASE WHEN count(b.rate) >= 3 AND var_samp(b.rate) > 1e-12 THEN (a.rate - avg(b.rate)) / stddev_samp(b.rate) END, 3) AS z
FROM s a LEFT JOIN s b ON a.format = b.format AND a.sample_id <> b.sample_id GROUP BY a.sample_id, a.format, a.rate
""")
def cohort_outliers(spark, sf_dir):
    """A sample's rate against those of the other samples of its format."""
    li = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("sample_id"), (F.col("l_partkey") % 3 == 0).cast("int").alias("het"))
    rates = li.groupBy("sample_id").agg(F.avg("het").alias("rate")).withColumn("format", F.col("sample_id") % 3)
    return scores.z_score(rates, ["format"], "rate").select("sample_id", "format", F.round("rate", 6).alias("rate"), F.round("z", 3).alias("z"))


@query("""
WITH s AS (SELECT o_orderkey AS id, o_custkey % 50 AS card, 'old' AS note, CASE WHEN o_orderkey % 7 = 0 THEN 'Text. Withheld.' ELSE 'Text.' END AS text, o_orderkey % 5 = 0 AS withheld, o_orderkey % 2 = 0 AS drug FROM orders), d AS (SELECT n_nationkey AS card, min(n_name) AS note FROM nation GROUP BY 1)
SELECT id, card, CASE WHEN withheld AND NOT contains(text, 'Withheld.') THEN text || ' Withheld.' ELSE text END AS text, d.note FROM s JOIN d USING (card) WHERE NOT withheld OR drug
""")
def stored_cards(spark, sf_dir):
    """Stored cards brought up to the links that are declared now."""
    k = F.col("o_orderkey")
    stored = read(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_custkey") % 50).alias("card"), F.lit("old").alias("note"), F.when(k % 7 == 0, "Text. Withheld.").otherwise("Text.").alias("text"), (k % 5 == 0).alias("withheld"), (k % 2 == 0).alias("drug"))
    declared = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("card"), F.col("n_name").alias("note"))
    return merge.still_declared(stored, declared, ["card"], ["note"], F.col("withheld"), F.col("drug"), "Withheld.").select("id", "card", "text", "note")


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type IN ('error', 'purchase') AND contains(lower(props), '1') ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50")
def log_page(spark, sf_dir):
    """A page of a log, newest first, by kind and by text whatever its case."""
    e = read(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "purchase") & F.contains(F.lower("props"), F.lit("1")))
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    return paging.ranked_page(e.select("event_id", "event_type", "ts"), order, 25, 50).select("event_id", "event_type", (F.row_number().over(Window.orderBy(*order)) + 50).cast("long").alias("place"))


@query("SELECT p_partkey, upper(trim(' ' || lower(p_brand) || CASE WHEN p_size % 2 = 0 THEN '  ' ELSE '' END)) AS gene FROM part")
def normal_names(spark, sf_dir):
    """Names trimmed and in upper case."""
    raw = F.concat(F.lit(" "), F.lower("p_brand"), F.when(size() % 2 == 0, "  ").otherwise(""))
    return read(spark, sf_dir, "part").select("p_partkey", F.upper(F.trim(raw)).alias("gene"))


# --- formats ------------------------------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT p_partkey AS file, p_partkey % 9 AS k, p_size AS s FROM part)
SELECT file, CASE WHEN k IN (0, 1, 2) THEN 'a' WHEN k IN (3, 4) THEN 'b' END AS vendor, CASE WHEN k = 0 AND s % 2 = 1 THEN 'v3' WHEN k = 0 OR k = 2 AND s < 20 THEN 'v4' WHEN k = 2 THEN 'v5' WHEN k = 3 THEN 'v' || s || '.0' WHEN k = 4 THEN 'v2.0' END AS version,
  CASE WHEN k = 0 AND s % 2 = 1 THEN 'GRCh36' WHEN k IN (0, 2, 3, 4) THEN 'GRCh37' END AS build,
  CASE k WHEN 1 THEN 'the comments name no build' WHEN 5 THEN 'a VCF file; genotype exports are tab-separated' WHEN 6 THEN 'a CSV file; genotype exports are tab-separated' WHEN 7 THEN 'a ZIP archive; unpack it first' WHEN 8 THEN 'unknown format' END AS reason FROM t
""")
def file_formats(spark, sf_dir):
    """Formats, versions and rejections of a file for each part, from its first lines."""
    k, four = key() % 9, "# rsid\tchromosome\tposition\tgenotype"
    lines = lambda *x: F.array(*[v if isinstance(v, Column) else F.lit(v) for v in x])
    build = F.when(size() % 2 == 1, "# build 36").otherwise("# build 37")
    many = F.concat(F.array_repeat(F.lit("# comment"), F.when(size() < 20, 3).otherwise(30)), lines("# GRCh37", four))
    five = "rsid\tchromosome\tposition\tallele1\tallele2"
    head = (
        F.when(k == 0, lines(build, four)).when(k == 1, lines("# no such thing", four)).when(k == 2, many).when(k == 3, lines("#AncestryDNA", F.concat(F.lit("# array version: V"), size(), F.lit(".0")), five)).when(k == 4, lines("#AncestryDNA", five))
        .when(k == 5, lines("##fileformat=VCFv4.2")).when(k == 6, lines("a,b", "1,2", "x")).when(k == 7, lines("PK\x03\x04")).otherwise(lines("hello", ""))
    )
    body = F.array_repeat(F.lit("rs1\t1\t5\tAG"), size())
    rows = read(spark, sf_dir, "part").select(key().alias("file"), F.posexplode(F.when(k <= 4, F.concat(head, body)).otherwise(head)).alias("record", "value"))
    return text.formats(rows)


# --- scores, rules and gates --------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT p_partkey AS rank, p_name AS score, CASE WHEN p_size % 10 = 0 THEN ['any'] ELSE ['P' || p_size % 7, 'P' || (p_size + 1) % 9] END AS covers FROM part), e AS (SELECT rank, score, unnest(covers) AS g FROM r),
c AS (SELECT c_custkey, 'P' || c_nationkey % 12 AS ancestry FROM customer)
SELECT c_custkey, (SELECT min_by(score, rank) FROM e WHERE g = ancestry OR g = 'any') AS score FROM c
""")
def covering_scores(spark, sf_dir):
    """The first score of a registry that covers a sample's ancestry."""
    part = read(spark, sf_dir, "part")
    covers = F.when(size() % 10 == 0, F.array(F.lit("any"))).otherwise(F.array(F.concat(F.lit("P"), size() % 7), F.concat(F.lit("P"), (size() + 1) % 9)))
    registry = part.select(key().alias("rank"), F.col("p_name").alias("score"), covers.alias("covers"))
    own = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("P"), F.col("c_nationkey") % 12).alias("ancestry"))
    return selection.covering(own, registry, "ancestry", "covers", "rank", ["score"]).select("c_custkey", "score")


@query("""
WITH t AS (SELECT p_partkey, substr('ACGT', p_partkey % 4 + 1, 1) || substr('ACGT', p_size % 4 + 1, 1) AS g0, substr('ACGT', (p_partkey // 4) % 4 + 1, 1) AS e, substr('ACGT', ((p_partkey // 4) % 4 + 1 + (p_partkey // 16) % 3) % 4 + 1, 1) AS o, p_size FROM part),
u AS (SELECT p_partkey, e, o, CASE WHEN p_size % 11 = 0 THEN '--' ELSE g0 END AS g, translate(e, 'ACGT', 'TGCA') AS ce, translate(o, 'ACGT', 'TGCA') AS co FROM t)
SELECT p_partkey, CASE WHEN g = '--' THEN NULL WHEN o = ce THEN CASE WHEN g[1] IN (e, o) AND g[2] IN (e, o) AND g[1] <> g[2] THEN 1 END WHEN g[1] IN (e, o) AND g[2] IN (e, o) THEN (g[1] = e)::INT + (g[2] = e)::INT WHEN g[1] IN (ce, co) AND g[2] IN (ce, co) THEN (g[1] = ce)::INT + (g[2] = ce)::INT END AS dosage,
  CASE WHEN g = '--' THEN 'untyped' WHEN o = ce THEN CASE WHEN g[1] IN (e, o) AND g[2] IN (e, o) THEN CASE WHEN g[1] <> g[2] THEN 'resolved' ELSE 'palindrome' END ELSE 'unresolved' END WHEN g[1] IN (e, o) AND g[2] IN (e, o) OR g[1] IN (ce, co) AND g[2] IN (ce, co) THEN 'resolved' ELSE 'unresolved' END AS status FROM u
""")
def anchor_dosages(spark, sf_dir):
    """Copies of the effect allele at single markers, and why there is no number."""
    quarter, sixteenth = F.floor(key() / 4), F.floor(key() / 16)
    g = F.when(size() % 11 == 0, "--").otherwise(F.concat(letter(key()), letter(size())))
    d = G.anchor_dosage(g, letter(quarter), letter(quarter % 4 + 1 + sixteenth % 3))
    return read(spark, sf_dir, "part").select("p_partkey", d["dosage"].alias("dosage"), d["status"].alias("status"))


@query("""
WITH t AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 3 END AS g1, CASE WHEN p_size % 5 <> 0 THEN p_size % 3 END AS mate, CASE WHEN p_size % 4 <> 0 THEN (p_partkey + p_size) % 3 END AS g2, p_size % 6 = 0 AS other, p_size % 13 = 0 AS hidden FROM part),
a AS (SELECT *, coalesce(mate < g1, false) AS bad FROM t), b AS (SELECT *, CASE WHEN NOT bad THEN g1 END AS d1 FROM a),
m AS (SELECT *, CASE WHEN hidden THEN 'none' WHEN coalesce(d1 + g2 >= 2, false) THEN 'high' WHEN coalesce(d1 + g2 = 1, false) THEN 'one' WHEN coalesce(g2 IN (1, 2), false) THEN 'partial' ELSE 'none' END AS call FROM b)
SELECT k, CASE WHEN bad THEN 'g1' ELSE '' END AS discordant, call, CASE WHEN other AND call <> 'none' THEN 'other ancestry' END AS caveat FROM m
""")
def concordant_rules(spark, sf_dir):
    """A rule engine whose tag locus counts only as far as its partner bears it out, with a caveat for other ancestries."""
    t = read(spark, sf_dir, "part").select(key().alias("k"), F.when(key() % 9 != 0, (key() % 3).cast("int")).alias("g1"), F.when(size() % 5 != 0, size() % 3).alias("mate"), F.when(size() % 4 != 0, ((key() + size()) % 3).cast("int")).alias("g2"), (size() % 6 == 0).alias("other"), (size() % 13 == 0).alias("hidden"))
    total = {"rsids": ["g1", "g2"]}
    models = [{"name": "high", "match": {"total": total | {"min": 2}}}, {"name": "one", "match": {"total": total | {"min": 1, "max": 1}}}, {"name": "partial", "match": {"g2": [1, 2]}}]
    out = scores.classify_rules(t, {n: F.col(n) for n in ("g1", "mate", "g2")}, models, suppressed=F.col("hidden"), partners={"g1": ["mate"]}, caveat=F.when(F.col("other"), "other ancestry"))
    return out.select("k", F.array_join("discordant", ",").alias("discordant"), F.coalesce(F.get("calls", F.lit(0)), F.lit("none")).alias("call"), "caveat")


@query("""
WITH s AS (SELECT c_custkey AS k, 'G' || c_nationkey % 6 AS gene, c_custkey % 4 <> 0 AS consent, CASE c_custkey % 5 WHEN 0 THEN 'XX' WHEN 1 THEN 'XY' END AS recorded, CASE c_custkey % 3 WHEN 0 THEN 'XX' WHEN 1 THEN 'XY' ELSE 'manual_review' END AS inferred FROM customer),
c AS (SELECT *, CASE coalesce(recorded, inferred) WHEN 'XX' THEN 'female' WHEN 'XY' THEN 'male' ELSE 'unresolved' END AS context FROM s),
f AS (SELECT 'G' || n_nationkey AS gene, 'female' AS context, n_nationkey * 10.5 AS risk FROM nation WHERE n_nationkey < 4 UNION ALL SELECT 'G' || n_nationkey, 'male', n_nationkey * 1.5 FROM nation WHERE n_nationkey BETWEEN 2 AND 4 UNION ALL VALUES (NULL, 'female', 20.0), (NULL, 'male', 2.0))
SELECT k, c.gene, c.context, NOT consent AS opt_in_required, CASE WHEN consent THEN coalesce(f.risk, r.risk)::DOUBLE END AS risk FROM c LEFT JOIN f ON c.gene = f.gene AND c.context = f.context LEFT JOIN f r ON r.gene IS NULL AND r.context = c.context
""")
def consented_figures(spark, sf_dir):
    """Figures by gene and sex, shown with consent only."""
    c, n = F.col("c_custkey"), F.col("n_nationkey")
    sex = rules.sex_context(F.when(c % 5 == 0, "XX").when(c % 5 == 1, "XY"), F.when(c % 3 == 0, "XX").when(c % 3 == 1, "XY").otherwise("manual_review"))
    rows = read(spark, sf_dir, "customer").select(c.alias("k"), F.concat(F.lit("G"), F.col("c_nationkey") % 6).alias("gene"), (c % 4 != 0).alias("consent"), sex.alias("context"))
    nation = read(spark, sf_dir, "nation")
    figure = lambda keep, context, times: nation.filter(keep).select(F.concat(F.lit("G"), n).alias("gene"), F.lit(context).alias("context"), (n * times).alias("risk"))
    rest = spark.createDataFrame([(None, "female", 20.0), (None, "male", 2.0)], "gene string, context string, risk double")
    figures = figure(n < 4, "female", 10.5).unionByName(figure(n.between(2, 4), "male", 1.5)).unionByName(rest)
    out = rules.consented(lookup.by_context(rows, figures, "gene", F.col("context"), ["risk"]), F.col("consent"), ["risk"])
    return out.select("k", "gene", "context", "opt_in_required", "risk")


@query("""
WITH w AS (SELECT p_partkey AS pos, (p_partkey % 22 + 1)::VARCHAR AS chrom, 'rs' || p_partkey AS rsid, CASE WHEN p_size % 5 <> 0 THEN p_size / 1000.0 END AS af, CASE WHEN p_size % 3 = 0 THEN p_size / 600.0 END AS pop, CASE p_size % 4 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'risk allele' WHEN 2 THEN 'Benign' END AS sig, CASE WHEN p_size % 2 = 0 THEN 'het' WHEN p_size % 7 = 0 THEN 'hom_ref' ELSE 'hom_alt' END AS z FROM part),
k AS (SELECT * FROM w WHERE (coalesce(pop, af) < 0.02 OR af IS NULL) AND z <> 'hom_ref')
SELECT rsid, row_number() OVER (ORDER BY CASE WHEN sig = 'Pathogenic' THEN 0 WHEN sig = 'risk allele' THEN 1 ELSE 2 END, CASE WHEN af IS NULL THEN 1 ELSE 0 END, af NULLS FIRST, chrom, pos, rsid) AS place FROM k QUALIFY place <= 200
""")
def rare_ranking(spark, sf_dir):
    """The first 200 rare calls in order of evidence."""
    none = lambda kind: F.lit(None).cast(kind)
    wide = read(spark, sf_dir, "part").select(
        F.concat(F.lit("rs"), key()).alias("rsid"), (key() % 22 + 1).cast("string").alias("chrom"), key().alias("pos"), F.when(size() % 5 != 0, size() / 1000.0).alias("gnomad_af_global"), F.when(size() % 3 == 0, size() / 600.0).alias("gnomad_af_popmax"),
        F.when(size() % 4 == 0, "Pathogenic").when(size() % 4 == 1, "risk allele").when(size() % 4 == 2, "Benign").alias("clinvar_significance"), F.when(size() % 2 == 0, "het").when(size() % 7 == 0, "hom_ref").otherwise("hom_alt").alias("zygosity"),
        none("string").alias("gene_symbol"), none("string").alias("consequence"), none("string").alias("inheritance"), none("long").alias("gnomad_homozygous_count"),
    )
    ranked = enrich.rare_variants(wide, af=0.02, include_novel=True).limit(200)
    rows = ranked.select("rsid", F.monotonically_increasing_id().alias("_i")).coalesce(1)
    return rows.select("rsid", F.row_number().over(Window.orderBy("_i")).cast("long").alias("place"))


@query("""
WITH v AS (SELECT DISTINCT l_orderkey AS sample_id, (l_partkey % 22 + 1)::VARCHAR AS chrom, l_partkey AS pos, 'A' AS ref, 'G' AS alt, 'rs' || l_partkey AS rsid, CASE WHEN l_partkey % 3 <> 0 THEN 'GENE' || l_partkey % 9 END AS gene, CASE l_linenumber % 3 WHEN 0 THEN 'het' WHEN 1 THEN 'hom_alt' ELSE 'hom_ref' END AS z FROM lineitem),
h AS (SELECT *, sha1(concat_ws(chr(31), 'observation', sample_id, chrom, pos, ref, alt, rsid, coalesce(gene, ''), z)) AS s FROM v WHERE z <> 'hom_ref'),
i AS (SELECT *, concat_ws('-', substr(s, 1, 8), substr(s, 9, 4), '5' || substr(s, 14, 3), '8' || substr(s, 18, 3), substr(s, 21, 12)) AS id FROM h)
SELECT sample_id, count(id) + 1 AS n_entries, count(id) AS n_references, 0::BIGINT AS n_lost, md5(coalesce(string_agg('urn:uuid:' || id, ',' ORDER BY chrom::INT, pos, id), '')) AS urls FROM (SELECT DISTINCT l_orderkey AS sample_id FROM lineitem) LEFT JOIN i USING (sample_id) GROUP BY 1
""")
def resource_bundles(spark, sf_dir):
    """A document a sample, read back: entries, references, those that no entry answers, and the entries in order."""
    line, k = F.col("l_linenumber"), F.col("l_partkey")
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), (k % 22 + 1).cast("string").alias("chrom"), k.alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), F.concat(F.lit("rs"), k).alias("rsid"),
        F.when(k % 3 != 0, F.concat(F.lit("GENE"), k % 9)).alias("gene_symbol"), F.when(line % 3 == 0, "het").when(line % 3 == 1, "hom_alt").otherwise("hom_ref").alias("zygosity"),
    )
    made = sinks.resource_documents(rows)
    doc = F.from_json("document", "entry array<struct<fullUrl: string, resource: struct<resourceType: string, id: string, result: array<struct<reference: string>>>>>")
    read_back = made.select("sample_id", doc["entry"].alias("entry"))
    urls = F.transform(F.filter("entry", lambda e: e["resource"]["resourceType"] == "Observation"), lambda e: e["fullUrl"])
    asked = F.transform(F.flatten(F.transform(F.filter("entry", lambda e: e["resource"]["result"].isNotNull()), lambda e: e["resource"]["result"])), lambda r: r["reference"])
    return read_back.select("sample_id", F.size("entry").cast("long").alias("n_entries"), F.size(asked).cast("long").alias("n_references"), F.size(F.array_except(asked, urls)).cast("long").alias("n_lost"), F.md5(F.array_join(urls, ",").cast("binary")).alias("urls"))


# --- the whole wide table -----------------------------------------------------------------------------------------

REF, ALT = (f"substr('ACGT', ({x}) % 4 + 1, 1)" for x in ("k", "k + 1 + p % 3"))
TURN = "translate({}, 'ACGT', 'TGCA')"
WIDE_SQL = f"""
WITH b AS (SELECT o_orderkey * 4 + i AS k, o_custkey AS p FROM orders, range(4) r(i)), q AS (SELECT k, p, {REF} || substr('ACGT', (k + p % 4) % 4 + 1, 1) AS genotype, {REF} AS r, {ALT} AS a FROM b),
f AS (SELECT *, k % 3 < 2 AS v, k % 4 < 2 AS c, k % 6 < 4 AS d, k % 2 = 0 AND k % 3 = 0 AS am, CASE k % 8 WHEN 1 THEN 'Pathogenic' WHEN 4 THEN 'Uncertain significance' ELSE 'Benign' END AS s FROM q),
h AS (SELECT *, k % 5 < 3 AND NOT ((v OR c) AND k % 25 = 0) AS g, CASE WHEN v OR c THEN r END AS ref, CASE WHEN v OR c THEN a END AS alt, CASE WHEN v OR c THEN k % 11 END AS gene FROM f),
j AS (SELECT *, gene IS NOT NULL AND NOT (c AND s = 'Benign') AS gp, CASE WHEN d AND k % 2 = 0 THEN k % 10 / 100.0 END AS sift, CASE WHEN d AND k % 5 = 0 THEN k % 100 / 100.0 END AS poly, CASE WHEN d THEN k % 40 END AS cadd FROM h),
w AS (SELECT *, CASE WHEN d THEN [CASE WHEN sift IS NOT NULL THEN sift < 0.05 ELSE k % 3 = 0 END, CASE WHEN poly IS NOT NULL THEN poly > 0.909 WHEN k % 7 < 5 THEN k % 7 < 2 END, cadd >= 20, 2 * ((k % 10 >= 5)::INT + (k % 3 > 1)::INT + (k % 10 > 5)::INT) > 3] ELSE [NULL::BOOLEAN] END AS votes FROM j),
x AS (SELECT *, len(list_filter(votes, lambda z: z))::INT AS deleterious_count, len(list_filter(votes, lambda z: z IS NOT NULL))::INT AS assessed, CASE WHEN g THEN k % 40 / 1000.0 END AS af, CASE WHEN g AND k % 7 = 0 THEN k % 90 / 1000.0 END AS afr FROM w)
SELECT k, 'rs' || k AS rsid, (k % 97 % 22 + 1)::VARCHAR AS chrom, k AS pos, genotype, ref, alt, CASE WHEN k % 9 = 0 THEN 'm' || k END AS dbsnp_rsid_current,
  CASE WHEN genotype[1] IN (ref, alt) AND genotype[2] IN (ref, alt) THEN CASE WHEN genotype[1] <> genotype[2] THEN 'het' WHEN genotype[1] = alt THEN 'hom_alt' ELSE 'hom_ref' END
    WHEN genotype[1] <> genotype[2] AND genotype[1] IN ({TURN.format('ref')}, {TURN.format('alt')}) AND genotype[2] IN ({TURN.format('ref')}, {TURN.format('alt')}) THEN 'het' END AS zygosity,
  'G' || gene AS gene_symbol, CASE WHEN v THEN 't' || k END AS transcript_id, CASE WHEN v THEN CASE WHEN k % 3 = 0 THEN 'missense_variant' ELSE 'intron_variant' END END AS consequence, CASE WHEN v THEN 'c.' || k END AS hgvs_coding, CASE WHEN v AND k % 3 = 0 THEN 'p.' || k END AS hgvs_protein, v AND k % 2 = 1 AS mane_select,
  CASE WHEN c THEN s END AS clinvar_significance, CASE WHEN c THEN (k % 5)::INT END AS clinvar_review_stars, CASE WHEN c THEN 'V' || k END AS clinvar_accession, CASE WHEN c THEN 'c' || k % 13 END AS clinvar_conditions,
  af AS gnomad_af_global, afr AS gnomad_af_afr, greatest(af, afr) AS gnomad_af_popmax, CASE WHEN g THEN k % 6 END AS gnomad_homozygous_count, coalesce(greatest(af, afr) > 0 AND greatest(af, afr) < 0.01, false) AS rare_flag, coalesce(greatest(af, afr) > 0 AND greatest(af, afr) < 0.001, false) AS ultra_rare_flag, CASE WHEN g THEN 'matched' END AS gnomad_source_status,
  cadd::DOUBLE AS cadd_phred, sift AS sift_score, CASE WHEN d THEN CASE WHEN k % 3 = 0 THEN 'D' ELSE 'T' END END AS sift_pred, poly AS polyphen2_hsvar_score, CASE WHEN d AND k % 7 < 5 THEN CASE WHEN k % 7 < 2 THEN 'D' ELSE 'B' END END AS polyphen2_hsvar_pred, CASE WHEN d THEN k % 10 / 10.0 END AS revel, CASE WHEN d THEN (k % 3 - 1)::DOUBLE END AS metasvm, CASE WHEN d THEN k % 10 / 10.0 END AS metalr,
  CASE WHEN am THEN k % 50 / 50.0 END AS am_pathogenicity, CASE WHEN am THEN 'x' || k % 3 END AS am_class, CASE WHEN gp THEN 'd' || gene END AS disease_name, CASE WHEN gp THEN 'D' || gene END AS disease_id, CASE WHEN gp AND gene % 2 = 0 THEN 'h' END AS hpo_terms, CASE WHEN gp AND gene % 3 = 0 THEN 'AD' END AS inheritance,
  v::INT + 2 * c::INT + 4 * g::INT + 8 * d::INT + 16 * gp::INT + 128 * am::INT AS annotation_coverage, CASE WHEN v THEN false END AS vep_ambiguous, deleterious_count, assessed AS deleterious_total_assessed, assessed >= 2 AND 2 * deleterious_count > assessed AS ensemble_pathogenic,
  coalesce(c AND s <> 'Pathogenic' AND deleterious_count >= 3 AND cadd >= 20, false) AS evidence_conflict FROM x
"""


@query(WIDE_SQL)
def annotate_columns(spark, sf_dir):
    """Every column of the wide table for all calls, with merged ids, six sources, gene phenotypes, damage votes and conflicts."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("p"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("i"))
    k, p = F.col("k"), F.col("p")
    calls = o.select((F.col("o_orderkey") * 4 + F.col("i")).alias("k"), "p")
    calls = calls.select("k", "p", F.concat(F.lit("rs"), k).alias("rsid"), (k % 97 % 22 + 1).cast("string").alias("chrom"), k.alias("pos"), F.concat(letter(k), letter(k + p % 4)).alias("genotype"))
    merged = k % 9 == 0
    named = F.concat(F.when(merged, "m").otherwise("rs"), k)
    site = [named.alias("rsid"), "chrom", "pos", letter(k).alias("ref")]
    alt, gene = letter(k + 1 + p % 3).alias("alt"), F.concat(F.lit("G"), k % 11).alias("gene_symbol")
    text_of = lambda head, c=k: F.concat(F.lit(head), c)
    number = lambda c: c.cast("double")
    genes = spark.range(11)
    i = F.col("id")
    phenotypes = genes.select(text_of("G", i).alias("gene_symbol"), text_of("d", i).alias("disease_name"), text_of("D", i).alias("disease_id"), F.when(i % 2 == 0, "h").alias("hpo_terms"), F.when(i % 3 == 0, "AD").alias("inheritance"))
    phenotypes = phenotypes.unionByName(phenotypes.withColumns({"disease_name": F.lit("Obsolete one"), "disease_id": F.lit("A"), "hpo_terms": F.lit("x"), "inheritance": F.lit("AR")}))
    sources = enrich.Sources(
        merges=calls.filter(merged).select(text_of("rs").alias("old_rsid"), text_of("m").alias("current_rsid")),
        vep=calls.filter(k % 3 < 2).select(*site, alt, gene, text_of("t").alias("transcript_id"), F.when(k % 3 == 0, "missense_variant").otherwise("intron_variant").alias("consequence"), text_of("c.").alias("hgvs_coding"), F.when(k % 3 == 0, text_of("p.")).alias("hgvs_protein"), (k % 2).cast("int").alias("mane_select")),
        clinvar=calls.filter(k % 4 < 2).select(*site, alt, F.when(k % 8 == 1, "Pathogenic").when(k % 8 == 4, "Uncertain significance").otherwise("Benign").alias("significance"), (k % 5).cast("int").alias("review_stars"), text_of("V").alias("accession"), text_of("c", k % 13).alias("conditions"), gene),
        gnomad=calls.filter(k % 5 < 3).select(*site, F.when(k % 25 == 0, F.concat(letter(k), F.lit("T"))).otherwise(letter(k + 1 + p % 3)).alias("alt"), (k % 40 / 1000).alias("af_global"), F.when(k % 7 == 0, k % 90 / 1000).alias("af_afr"), (k % 6).alias("homozygous_count")),
        dbnsfp=calls.filter(k % 6 < 4).select(*site, alt, number(k % 40).alias("cadd_phred"), F.when(k % 2 == 0, k % 10 / 100).alias("sift_score"), F.when(k % 3 == 0, "D").otherwise("T").alias("sift_pred"), F.when(k % 5 == 0, k % 100 / 100).alias("polyphen2_hsvar_score"), F.when(k % 7 < 5, F.when(k % 7 < 2, "D").otherwise("B")).alias("polyphen2_hsvar_pred"), (k % 10 / 10).alias("revel"), number(k % 3 - 1).alias("metasvm"), (k % 10 / 10).alias("metalr")),
        alphamissense=calls.filter(k % 2 == 0).select(*site[1:], alt, (k % 50 / 50).alias("am_pathogenicity"), text_of("x", k % 3).alias("am_class")),
        gene_phenotype=phenotypes,
    )
    return enrich.annotate(calls.drop("p"), sources).drop(*[f"gnomad_af_{x}" for x in ("amr", "eas", "eur", "fin", "sas", "asj")])


@query("""
WITH e AS (SELECT user_id, event_id, ts, coalesce(value, 0) AS value, coalesce(event_type = 'purchase', false) AS closes FROM events WHERE ts IS NOT NULL),
l AS (SELECT *, row_number() OVER w AS i, CASE WHEN lag(ts) OVER w IS NULL OR lag(closes) OVER w OR epoch_ms(ts) - epoch_ms(lag(ts) OVER w) > 86400000 THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY i) AS run FROM l), g AS (SELECT user_id, run, min(ts) AS first, max(ts) AS last, count(*) AS n, sum(value) AS total, arg_max(closes, i) AS closed FROM r GROUP BY 1, 2)
SELECT user_id, first, last, n, round(total, 6) AS total, CASE WHEN closed THEN 'closed' WHEN run < max(run) OVER (PARTITION BY user_id) THEN 'gap' ELSE 'open' END AS ended FROM g
""")
def event_episodes(spark, sf_dir):
    """Episodes of each user's events, ended by a purchase or by a day without any."""
    return episodes.episodes(read(spark, sf_dir, "events"), F.col("event_type") == "purchase", 86400).withColumn("total", F.round("total", 6))


# --- special callers of panels ------------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT p_partkey AS k, CASE WHEN p_size % 6 = 0 THEN '--' ELSE substr('ACGT', p_partkey % 4 + 1, 1) || substr('ACGT', p_size % 4 + 1, 1) END AS g, CASE WHEN p_size % 7 <> 0 THEN p_size % 3 END AS a, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 3 END AS b, p_size % 2 AS c FROM part),
s AS (SELECT *, CASE WHEN g[1] <= g[2] THEN g ELSE g[2] || g[1] END AS o, translate(g, 'ACGT', 'TGCA') AS r FROM t), u AS (SELECT *, CASE WHEN r[1] <= r[2] THEN r ELSE r[2] || r[1] END AS q FROM s)
SELECT k, CASE WHEN g = '--' THEN NULL WHEN o IN ('CC', 'CT', 'TT') THEN CASE o WHEN 'CC' THEN 'RR' WHEN 'CT' THEN 'RX' ELSE 'XX' END WHEN q IN ('CC', 'CT', 'TT') THEN CASE q WHEN 'CC' THEN 'RR' WHEN 'CT' THEN 'RX' ELSE 'XX' END END AS state,
  CASE a + b + c WHEN 0 THEN 'none' WHEN 1 THEN 'one' WHEN 2 THEN 'several' WHEN 3 THEN 'several' END AS carried FROM u
""")
def special_callers(spark, sf_dir):
    """A three-state label of one marker and a label by the copies at three."""
    g = F.when(size() % 6 == 0, "--").otherwise(F.concat(letter(key()), letter(size())))
    states = F.create_map(*[F.lit(x) for x in ("CC", "RR", "CT", "RX", "TT", "XX")])
    counts = F.create_map(*[F.lit(x) for pair in ((0, "none"), (1, "one"), (2, "several"), (3, "several")) for x in pair])
    copies = [F.when(size() % 7 != 0, size() % 3), F.when(key() % 5 != 0, key() % 3), size() % 2]
    return read(spark, sf_dir, "part").select(key().alias("k"), panels.state_label(states, g).alias("state"), panels.counted_label(copies, counts).alias("carried"))


@query("""
WITH r AS (SELECT l_suppkey % 60 AS sample_id, 'G' || l_partkey % 4 AS gene_symbol, CASE l_linenumber % 3 WHEN 0 THEN 'het' WHEN 1 THEN 'hom_alt' ELSE 'hom_ref' END AS zygosity, l_linenumber % 4 AS evidence_level, l_partkey % 2 = 0 OR l_suppkey % 4 = 0 AS weak FROM lineitem),
f AS (SELECT sample_id, list_sort(list_distinct(list(gene_symbol))) AS g, count(*) AS n, bool_or(zygosity = 'hom_alt') AS h, max(evidence_level) AS l FROM r WHERE zygosity <> 'hom_ref' AND NOT weak GROUP BY 1)
SELECT s.sample_id, CASE WHEN n > 0 THEN 'Positive' ELSE 'Negative' END AS status, coalesce(g, []) AS genes, coalesce(n, 0) AS n_rows, coalesce(h, false) AS has_homozygous, coalesce(l, 0) AS highest_level FROM (SELECT DISTINCT l_suppkey % 60 AS sample_id FROM lineitem) s LEFT JOIN f USING (sample_id)
""")
def family_outcomes(spark, sf_dir):
    """The outcome of a family of genes for every sample, from its carried rows that aren't weak."""
    li = read(spark, sf_dir, "lineitem")
    line, k, sample = F.col("l_linenumber"), F.col("l_partkey"), (F.col("l_suppkey") % 60).alias("sample_id")
    rows = li.select(sample, F.concat(F.lit("G"), k % 4).alias("gene_symbol"), F.when(line % 3 == 0, "het").when(line % 3 == 1, "hom_alt").otherwise("hom_ref").alias("zygosity"), (line % 4).alias("evidence_level"), ((k % 2 == 0) | (F.col("l_suppkey") % 4 == 0)).alias("weak"))
    return panels.family_outcome(rows, li.select(sample), weak=F.col("weak"))
