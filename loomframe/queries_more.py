"""More registered queries with their SQL: text scans over lines made from parts, enrichment source by source, column rules.

As in queries.py, lines and calls are made from keys by arithmetic, so that both engines see the same invented values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions import genotype as G
from loomframe.functions import scalar as S
from loomframe.operators import callers, facets, intervals, lookup, merge, paging, panels, rules, scores, selection, sequence, vectors
from loomframe.plans import ancestry, console
from loomframe.plans import annotate as enrich
from loomframe.sources import sinks, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def key() -> Column:
    return F.col("p_partkey")


def size() -> Column:
    return F.col("p_size")


def parts(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def lines(spark, sf_dir, *fields: Column | str, sep: str = "\t", head: tuple[str, ...] = ()) -> DataFrame:
    """A line for each part, behind some that have to be skipped."""
    own = parts(spark, sf_dir).select(F.concat_ws(sep, *[f if isinstance(f, Column) else F.lit(f) for f in fields]).alias("value"))
    return spark.createDataFrame([(x,) for x in ("# comment", "", *head)], "value string").unionByName(own)


def letter(c: Column) -> Column:
    return F.substring(F.lit("ACGT"), (c % 4 + 1).cast("int"), F.lit(1))


def text_of(c: Column) -> Column:
    return c.cast("string")


LETTER = "substr('ACGT', ({}) % 4 + 1, 1)"
COMP = "translate({}, 'ACGT', 'TGCA')"


# --- text scans ---------------------------------------------------------------------------------------------------


@query("""
SELECT * FROM (VALUES ('a', 'a v4 GRCh37'), ('a old', 'a v3 GRCh36'), ('a long', 'a v5 GRCh37'), ('b', 'b v2.0'), ('b array', 'b v1.5'), ('vcf', 'a VCF file; genotype exports are tab-separated'), ('csv', 'a CSV file; genotype exports are tab-separated'),
  ('zip', 'a ZIP archive; unpack it first'), ('binary', 'a binary file'), ('other', 'unknown format')) t(name, found)
""")
def file_heads(spark, sf_dir):
    """Formats, versions and rejections by the first lines of files."""
    a, b = "# rsid\tchromosome\tposition\tgenotype", "rsid\tchromosome\tposition\tallele1\tallele2"
    heads = {
        "a": (["# build 37", a], b""), "a old": (["# build 36", a], b""), "a long": (["# build 37"] + ["# x"] * 15 + [a], b""), "b": (["#AncestryDNA raw data", b], b""),
        "b array": (["#AncestryDNA raw data", "#This file has array version: V1.5", b], b""), "vcf": (["##fileformat=VCFv4.2"], b""), "csv": (["a,b", "1,2", "3,4"], b""), "zip": ([], b"PK\x03\x04"), "binary": ([], b"a\0b"), "other": (["hello"], b""),
    }

    def found(own, raw):
        try:
            kind = text.sniff(own, raw)
            return " ".join((kind, *(text.version_a(own) if kind == "a" else (text.version_b(own),))))
        except text.FormatError as e:
            return str(e)

    return spark.createDataFrame([(n, found(*h)) for n, h in heads.items()], "name string, found string")


@query("""
WITH t AS (SELECT p_partkey AS k, CASE p_partkey % 31 WHEN 27 THEN ' x ' WHEN 28 THEN 'mt' WHEN 29 THEN 'M' WHEN 30 THEN 'GL1' ELSE (p_partkey % 31)::VARCHAR END AS c FROM part), u AS (SELECT *, upper(trim(c)) AS u FROM t),
v AS (SELECT k, CASE u WHEN '23' THEN 'X' WHEN '24' THEN 'Y' WHEN '25' THEN 'MT' WHEN '26' THEN 'MT' WHEN 'M' THEN 'MT' ELSE u END AS a, CASE u WHEN '23' THEN 'X' WHEN '24' THEN 'Y' WHEN '25' THEN 'X' WHEN '26' THEN 'MT' WHEN 'M' THEN 'MT' ELSE u END AS b FROM u),
ok AS (SELECT i::VARCHAR AS c, i AS o FROM range(1, 23) t(i) UNION ALL VALUES ('X', 23), ('Y', 24), ('MT', 25))
SELECT k, x.c AS chrom_a, y.c AS chrom_b, coalesce(x.o, 99)::INT AS place FROM v LEFT JOIN ok x ON v.a = x.c LEFT JOIN ok y ON v.b = y.c
""")
def chromosome_codes(spark, sf_dir):
    code = F.when(key() % 31 == 27, " x ").when(key() % 31 == 28, "mt").when(key() % 31 == 29, "M").when(key() % 31 == 30, "GL1").otherwise(text_of(key() % 31))
    rows = parts(spark, sf_dir).select(key().alias("k"), text.chromosome(code, "a").alias("chrom_a"), text.chromosome(code, "b").alias("chrom_b"))
    return rows.withColumn("place", S.chromosome_order(F.col("chrom_a"), G.CHROMOSOMES))


@query(f"""
WITH t AS (SELECT p_partkey AS k, {LETTER.format('p_partkey')} AS a, CASE WHEN p_size % 7 = 0 THEN '0' ELSE {LETTER.format('p_size')} END AS b FROM part)
SELECT 'rs' || k AS rsid, (k % 22 + 1)::VARCHAR AS chrom, k AS pos, CASE WHEN b = '0' THEN '--' WHEN a <= b THEN a || b ELSE b || a END AS genotype FROM t
""")
def parse_allele_pairs(spark, sf_dir):
    """Five-column lines; a missing allele makes a no-call."""
    b = F.when(size() % 7 == 0, "0").otherwise(F.lower(letter(size())))
    own = lines(spark, sf_dir, F.concat(F.lit("rs"), key()), text_of(key() % 22 + 1), text_of(key()), letter(key()), b, head=("rsid\tchromosome\tposition\tallele1\tallele2",))
    return text.strict(text.genotypes(own, "b"))


@query("""
WITH t AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT CASE WHEN s % 9 > 1 AND k > 0 THEN 'rs' || k END AS rsid, CASE WHEN k % 25 = 0 THEN 'MT' WHEN k % 25 = 24 THEN 'GL7' ELSE (k % 25)::VARCHAR END AS chrom, CASE WHEN s % 13 <> 0 THEN k END AS pos, 'A' AS ref, 'G' AS alt,
  CASE WHEN s % 17 = 5 THEN NULL WHEN s % 4 = 0 THEN 'Likely pathogenic' WHEN s % 4 = 1 THEN 'Pathogenic' WHEN s % 4 = 2 THEN 'Pathogenic/Pathogenic, low penetrance|Established risk allele' ELSE 'Benign' END AS significance,
  CASE WHEN s % 17 = 5 THEN 0 WHEN s % 3 = 0 THEN 3 WHEN s % 3 = 1 THEN 2 ELSE 0 END AS review_stars, CASE WHEN s % 17 = 5 THEN NULL WHEN s % 4 = 0 THEN 'VCV' || lpad(k::VARCHAR, 9, '0') WHEN s % 4 = 1 THEN 'RCV' || k END AS accession, CASE WHEN s % 17 <> 5 THEN 'some thing|x' END AS conditions,
  CASE WHEN s % 17 <> 5 AND s % 5 > 1 THEN 'GENE' || k % 10 END AS gene_symbol, CASE WHEN s % 2 = 0 THEN k END AS variation_id, CASE WHEN s % 7 <> 0 THEN 'SO:1|x' END AS molecular_consequence,
  CASE WHEN k % 25 = 0 OR k % 25 > 22 THEN 'chromosome' WHEN s % 13 = 0 THEN 'position' WHEN s % 9 = 1 OR s % 9 > 1 AND k = 0 THEN 'rsid' WHEN s % 9 = 0 AND s % 17 = 5 THEN 'no_info' END AS reason FROM t
""")
def parse_clinical(spark, sf_dir):
    """Clinical VCF lines with reasons for those that are left out; records without an id stay."""
    sig = F.when(size() % 4 == 0, "Likely_pathogenic").when(size() % 4 == 1, "Pathogenic/Likely_pathogenic").when(size() % 4 == 2, "Pathogenic/Pathogenic,_low_penetrance|Established_risk_allele").otherwise("Benign")
    status = F.when(size() % 3 == 0, "reviewed_by_expert_panel").when(size() % 3 == 1, "criteria_provided,_multiple_submitters,_no_conflicts").otherwise("something_else")
    rs = F.when(size() % 9 == 0, "").when(size() % 9 == 1, "RS=abc;").otherwise(F.concat(F.lit("RS="), key(), F.lit(";")))
    gene = F.when(size() % 5 == 0, "").when(size() % 5 == 1, F.concat(F.lit("GENEINFO=GENE"), key() % 10, F.lit(":12|OTHER:13;"))).otherwise(F.concat(F.lit("GENEINFO=GENE"), key() % 10, F.lit(":12;")))
    ident = F.when(size() % 4 == 0, F.concat(F.lit("CLNVCID="), key(), F.lit(";"))).when(size() % 4 == 1, F.concat(F.lit("CLNACC=RCV"), key(), F.lit("|RCV2;"))).otherwise("")
    known = F.when(size() % 17 == 5, "").otherwise(F.concat(F.lit("CLNSIG="), sig, F.lit(";CLNREVSTAT="), status, F.lit(";CLNDN=some_thing|x;"), gene, ident))
    chrom = F.when(key() % 25 == 0, "chrM").when(key() % 25 == 24, "GL7").otherwise(F.concat(F.lit("chr"), key() % 25))
    own = lines(spark, sf_dir, chrom, F.when(size() % 13 == 0, "?").otherwise(text_of(key())), F.when(size() % 2 == 0, text_of(key())).otherwise("."), "A", F.when(size() % 7 == 0, "G,T").otherwise("G"), ".", ".", F.concat(rs, known, F.lit("MC=SO:1|x")))
    return text.clinical(own)


@query("""
WITH t AS (SELECT p_partkey AS k, p_size AS s FROM part), e AS (SELECT k, s, unnest([0, 1, 2]) AS i FROM t)
SELECT (k % 22 + 1)::VARCHAR AS chrom, k AS pos, 'A' AS ref, CASE i WHEN 0 THEN 'G' ELSE 'T' END AS alt, 'G' || k % 7 AS gene, CASE i WHEN 0 THEN s / 100.0 ELSE 0.01 END AS ds_ag, CASE i WHEN 0 THEN 0.25 ELSE 0.02 END AS ds_al, 0.1 AS ds_dg, 0.0 AS ds_dl,
  CASE i WHEN 0 THEN greatest(s / 100.0, 0.25) ELSE 0.1 END AS ds_max FROM e WHERE i < 2
""")
def parse_nested_scores(spark, sf_dir):
    """Entries of a nested INFO value; one without scores goes."""
    one = F.concat(F.lit("G|G"), key() % 7, F.lit("|"), text_of(size() / 100.0), F.lit("|0.25|0.1|0.0|1|2|3|4"))
    info = F.concat(F.lit("SpliceAI="), one, F.lit(",T|G"), key() % 7, F.lit("|0.01|0.02|0.1|0.0|1|2|3|4,C|G|.|.|.|.|.|.|.|."))
    return text.nested_scores(lines(spark, sf_dir, text_of(key() % 22 + 1), text_of(key()), ".", "A", "G,T", ".", ".", info))


@query("""
WITH t AS (SELECT p_partkey AS k, p_size AS s FROM part), e AS (SELECT k, s, unnest(['G', 'T']) AS alt, unnest([1, 2]) AS i FROM t)
SELECT (k % 22 + 1)::VARCHAR AS chrom, k AS pos, 'A' AS ref, alt, CASE i WHEN 1 THEN s / 100.0 ELSE 0.5 END AS dosage, CASE s % 3 WHEN 0 THEN (i = 1)::INT WHEN 1 THEN CASE i WHEN 1 THEN 2 ELSE 0 END ELSE 1 END AS copies,
  CASE WHEN s % 2 = 0 THEN CASE i WHEN 1 THEN 0.9 ELSE 0.4 END ELSE CASE i WHEN 1 THEN 0.7 ELSE 0.6 END END AS quality, CASE i WHEN 1 THEN 0.1 ELSE 0.2 END AS af, s % 2 = 0 AS is_imputed FROM e
""")
def parse_imputed(spark, sf_dir):
    """A row for each ALT of imputed lines."""
    gt = F.when(size() % 3 == 0, "0|1").when(size() % 3 == 1, "1|1").otherwise("1|2")
    info = F.when(size() % 2 == 0, "DR2=0.9,0.4;AF=0.1,0.2;IMP").otherwise("R2=0.7,0.6;AF=0.1,0.2")
    return text.imputed(lines(spark, sf_dir, text_of(key() % 22 + 1), text_of(key()), ".", "A", "G,T", ".", ".", info, "GT:DS:XX", F.concat(gt, F.lit(":"), text_of(size() / 100.0), F.lit(",0.5"))))


@query("""
WITH t AS (SELECT p_partkey AS k, [CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size / 100.0 END, 0.3] AS low, [p_size / 50.0, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 0.4 END] AS high, CASE p_size % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'D' ELSE 'B' END AS worst FROM part)
SELECT k, list_min(low) AS least, list_max(high) AS greatest, worst FROM t
""")
def parse_transcript_scores(spark, sf_dir):
    """Scores of several transcripts reduced to one."""
    low = F.concat(F.when(size() % 4 == 0, ".").otherwise(text_of(size() / 100.0)), F.lit(";0.3"))
    high = F.concat(text_of(size() / 50.0), F.lit(","), F.when(size() % 3 == 0, "-").otherwise("0.4"))
    bad = F.when(size() % 3 == 0, "B;P;B").when(size() % 3 == 1, "B;D;P").otherwise(".;B")
    rows = parts(spark, sf_dir).select(key().alias("k"), low.alias("a"), high.alias("b"), bad.alias("c"))
    return text.transcript_scores(rows, {"a": "least"}, {"b": "greatest"}, {"c": ("worst", {"D": 2, "P": 1, "B": 0})}).select("k", "least", "greatest", "worst")


@query("""
WITH t AS (SELECT p_partkey AS k, p_size AS s FROM part), u AS (SELECT s, CASE WHEN s % 11 = 0 THEN NULL ELSE 'rs' || k END AS old_rsid, CASE WHEN s % 2 = 0 THEN 'rs' || (k + 1) WHEN s % 7 = 0 THEN NULL ELSE 'rs' || (k + s % 3) END AS current_rsid FROM t)
SELECT old_rsid, current_rsid, CASE WHEN s % 5 <> 0 THEN s END AS build_id FROM u WHERE old_rsid <> current_rsid
""")
def parse_merge_history(spark, sf_dir):
    """Merged ids; some lines lack an id, some ids have their prefix already."""
    now = F.when(size() % 2 == 0, F.concat(F.when(size() % 4 == 0, "rs").otherwise(""), key() + 1)).otherwise("")
    old = F.when(size() % 11 == 0, " ").when(size() % 3 == 0, F.concat(F.lit("rs"), key())).otherwise(text_of(key()))
    low = F.when(size() % 7 == 0, "").otherwise(text_of(key() + size() % 3))
    return text.merge_history(lines(spark, sf_dir, old, low, F.when(size() % 5 == 0, "b1").otherwise(text_of(size())), "0", "x", "y", now, "0", "", head=("7\t8",)))


@query("""
SELECT 'EH' || p_partkey AS accession, CASE WHEN p_partkey % 25 = 24 THEN 'Un' ELSE (p_partkey % 22 + 1)::VARCHAR END AS chrom, p_partkey AS start_pos, CASE WHEN p_size % 11 <> 0 THEN p_partkey + p_size END AS end_pos,
  CASE p_size % 4 WHEN 0 THEN 'PLS' WHEN 1 THEN 'dELS' WHEN 2 THEN 'CA' END AS ccre_class, CASE WHEN p_size % 11 = 0 THEN 'malformed' WHEN p_partkey % 25 = 24 THEN 'invalid_chrom' WHEN p_size % 4 = 3 THEN 'unknown_class' END AS reason FROM part
""")
def parse_regulatory(spark, sf_dir):
    """Regulatory elements, with the class in one of several columns."""
    chrom = F.when(key() % 25 == 24, "chrUn").otherwise(F.concat(F.lit("chr"), key() % 22 + 1))
    end = F.when(size() % 11 == 0, "x").otherwise(text_of(key() + size()))
    name = F.when(size() % 4 == 2, F.concat(F.lit("EH"), key(), F.lit(",CA"))).otherwise(F.concat(F.lit("EH"), key()))
    return text.regulatory_bed(lines(spark, sf_dir, chrom, text_of(key()), end, name, F.when(size() % 4 == 1, "dELS,CTCF-bound").otherwise("0"), F.when(size() % 4 == 0, "PLS").otherwise("."), ".", ".", ".", ".", head=("track name=x",)))


@query("SELECT (p_partkey % 22 + 1)::VARCHAR AS chrom, CASE WHEN p_size % 9 <> 0 THEN p_partkey END AS start, p_partkey + p_size % 5 AS \"end\", 'n' || p_size AS name, CASE WHEN p_size % 9 = 0 THEN 'number' WHEN p_size % 5 = 0 THEN 'range' END AS reason FROM part")
def parse_bed(spark, sf_dir):
    own = lines(spark, sf_dir, F.concat(F.lit("chr"), key() % 22 + 1), F.when(size() % 9 == 0, "?").otherwise(text_of(key())), text_of(key() + size() % 5), F.concat(F.lit("n"), size()), sep="  ", head=("browser position x",))
    return text.bed(own).drop("record")


@query("""
SELECT 'rs' || p_partkey AS rsid, CASE WHEN p_size % 2 = 0 THEN 'body height' ELSE 'Type 2 diabetes' END AS trait, 5e-9 AS p_value, CASE WHEN p_size % 5 <> 0 THEN p_size / 10.0 END AS effect,
  CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 3 = 0 THEN false WHEN p_size % 3 = 1 THEN true ELSE p_size / 10.0 >= 0.1 AND p_size / 10.0 <= 20 END AS is_odds_ratio, 1000 * p_size + 500 AS sample_size FROM part WHERE p_size % 7 <> 0
""")
def parse_associations(spark, sf_dir):
    """Trait associations: kind of effect by its interval, sample sizes out of text."""
    ci = F.when(size() % 3 == 0, "[0.1-0.2] unit increase").when(size() % 3 == 1, "[1.1-1.3]").otherwise("")
    rows = parts(spark, sf_dir).select(
        F.when(size() % 7 == 0, "chr1:5").otherwise(F.concat(F.lit("rs"), key(), F.lit("; x"))).alias("SNPS"), F.when(size() % 2 == 0, "body height").otherwise(" ").alias("MAPPED_TRAIT"), F.lit("Type 2 diabetes").alias("DISEASE/TRAIT"), F.lit("5E-9").alias("P-VALUE"),
        F.when(size() % 5 == 0, "NR").otherwise(text_of(size() / 10.0)).alias("OR or BETA"), ci.alias("95% CI (TEXT)"), F.concat(F.lit("about "), size(), F.lit(",000 cases, 500 controls")).alias("INITIAL SAMPLE SIZE"),
    )
    return text.associations(rows, ["height", "diabetes"])


@query("""
SELECT CASE WHEN p_size % 2 = 0 THEN 'rs' || p_partkey END AS rsid, CASE WHEN p_size % 7 <> 0 THEN CASE WHEN p_size % 3 = 0 THEN (p_partkey % 22 + 1)::VARCHAR ELSE '1' END END AS chrom, p_partkey AS pos, 'A' AS effect_allele, 'G' AS other_allele, CASE WHEN p_size % 11 <> 0 THEN p_size / 8.0 END AS weight,
  CASE WHEN p_size % 11 = 0 THEN 'weight' WHEN p_size % 7 = 0 AND p_size % 2 <> 0 THEN 'place' END AS reason FROM part
""")
def parse_score_weights(spark, sf_dir):
    """Rows of a scoring file, harmonised columns first."""
    rows = parts(spark, sf_dir).select(
        F.when(size() % 2 == 0, F.concat(F.lit("rs"), key())).otherwise("").alias("rsID"), F.when(size() % 7 == 0, "").otherwise("1").alias("chr_name"), text_of(key()).alias("chr_position"), F.when((size() % 3 == 0) & (size() % 7 != 0), text_of(key() % 22 + 1)).otherwise("").alias("hm_chr"),
        F.lit("a").alias("effect_allele"), F.lit("g").alias("other_allele"), F.when(size() % 11 == 0, "x").otherwise(text_of(size() / 8.0)).alias("effect_weight"),
    )
    return text.score_weights(rows)


@query("""
SELECT 'GENE' || p_partkey AS gene, CASE WHEN p_size % 2 = 0 THEN 'Some disease, early onset' ELSE 'Other trait' END AS phenotype, '1234' || lpad((p_size % 100)::VARCHAR, 2, '0') AS mim, 3 AS mapping_key, CASE WHEN p_size % 2 = 0 THEN 'Autosomal dominant' END AS inheritance FROM part
""")
def parse_phenotypes(spark, sf_dir):
    """Phenotypes of a gene map's last field."""
    mim = F.concat(F.lit("1234"), F.lpad(text_of(size() % 100), 2, "0"), F.lit(" (3)"))
    last = F.when(size() % 2 == 0, F.concat(F.lit("{Some disease, early onset}, "), mim, F.lit(", Autosomal dominant"))).otherwise(F.concat(F.lit("?Other trait, "), mim, F.lit("; ")))
    return text.phenotypes(lines(spark, sf_dir, *["x"] * 6, F.concat(F.lit("GENE"), key(), F.lit(", OLD")), "x", F.when(size() % 3 == 0, F.concat(F.lit("GENE"), key())).otherwise(""), "x", "x", "x", last))


@query("SELECT classification, count(*)::BIGINT AS n FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'Definitive' WHEN 1 THEN 'Strong' WHEN 2 THEN 'Unheard of' ELSE 'Limited' END AS classification, p_brand FROM part WHERE p_partkey % 50 <> 0) WHERE classification <> 'Unheard of' GROUP BY 1")
def parse_curations(spark, sf_dir):
    kind = F.when(size() % 4 == 0, " Definitive").when(size() % 4 == 1, "Strong").when(size() % 4 == 2, "Unheard of").otherwise("Limited")
    rows = parts(spark, sf_dir).select(F.when(key() % 50 == 0, "+++++").otherwise(F.col("p_brand")).alias("GENE SYMBOL"), F.col("p_type").alias("DISEASE LABEL"), kind.alias("CLASS"))
    return text.curations(rows, ["Definitive", "Strong", "Limited"])[1]


@query("SELECT 'G' || p_partkey AS gene, '*' || p_size AS allele_name, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN p_size % 2 = 0 THEN 'rs' || p_partkey END AS first_rsid FROM part WHERE p_size % 9 <> 0")
def parse_allele_table(spark, sf_dir):
    json = F.when(size() % 2 == 0, F.concat(F.lit('[{"rsid":"rs'), key(), F.lit('","ref":"A","alt":"G"}]'))).otherwise("[broken")
    rows = parts(spark, sf_dir).select(F.concat(F.lit(" G"), key()).alias("gene"), F.when(size() % 9 == 0, " ").otherwise(F.concat(F.lit("*"), size())).alias("allele_name"), json.alias("defining_variants"))
    return text.allele_table(rows).select("gene", "allele_name", F.size("defining_variants").alias("n"), F.get("defining_variants", F.lit(0))["rsid"].alias("first_rsid"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'float' ELSE 'string' END AS kind, CASE p_size % 3 WHEN 0 THEN '-' || p_size WHEN 1 THEN p_size || '.5' ELSE p_type END AS value FROM part")
def overlay_values(spark, sf_dir):
    raw = F.when(size() % 3 == 0, F.concat(F.lit("-"), size())).when(size() % 3 == 1, F.concat(size(), F.lit(".5"))).otherwise(F.col("p_type"))
    return parts(spark, sf_dir).select("p_partkey", text.overlay_values(raw).alias("v")).select("p_partkey", "v.*")


@query("""
WITH d AS (SELECT p_brand AS gene, 'D' || p_size AS disease_id, min(p_type) AS disease_name FROM part GROUP BY 1, 2), t AS (SELECT p_brand AS gene, 'D' || p_size AS disease_id, p_partkey % 6 AS i, p_partkey % 3 = 0 AS inh FROM part WHERE p_partkey % 4 < 2),
n AS (SELECT gene, disease_id, count(DISTINCT i) FILTER (NOT inh) AS n, count(DISTINCT i) FILTER (inh) AS m, min(i) FILTER (inh) AS one FROM t GROUP BY 1, 2)
SELECT gene, disease_id, disease_name, coalesce(n, 0)::BIGINT AS n_terms, CASE WHEN m = 1 THEN 'mode ' || one END AS inheritance FROM d LEFT JOIN n USING (gene, disease_id)
""")
def gene_disease_terms(spark, sf_dir):
    """Ontology terms of each gene and disease, by a table of cross references."""
    p = parts(spark, sf_dir)
    ident = F.concat(F.lit("D"), size())
    i = key() % 6
    terms = p.filter(key() % 4 < 2).select(F.col("p_brand").alias("gene"), F.concat(F.lit("S"), size()).alias("source_id"), F.concat(F.lit("T"), i).alias("term_id"), F.concat(F.lit("mode "), i).alias("term_name"), (key() % 3 == 0).alias("is_inheritance"))
    out = text.gene_phenotypes(p.select(F.col("p_brand").alias("gene"), ident.alias("disease_id"), F.col("p_type").alias("disease_name")), terms, p.select(F.concat(F.lit("S"), size()).alias("source_id"), ident.alias("disease_id")).distinct())
    n = F.size(F.from_json("hpo_terms", "array<struct<term_id:string>>"))
    return out.select("gene", "disease_id", "disease_name", F.coalesce(F.when(F.col("hpo_terms").isNotNull(), n), F.lit(0)).cast("long").alias("n_terms"), "inheritance")


# --- enrichment, source by source ---------------------------------------------------------------------------------

#: Calls: k, place and a pair of letters; every 53rd is an indel call. Sources have up to three alleles a call (j).
CALL_SQL = f"""base AS (SELECT o_orderkey * 4 + i AS k, o_custkey AS p FROM orders, range(4) r(i)),
calls AS (SELECT k, p, (k % 97 % 22 + 1)::VARCHAR AS chrom, CASE WHEN k % 53 = 0 THEN 'II' ELSE {LETTER.format('k')} || {LETTER.format('k + p % 4')} END AS gt FROM base),
alleles AS (SELECT k, p, chrom, gt, j, {LETTER.format('k')} AS ref, CASE WHEN k % 53 = 0 THEN {LETTER.format('k')} || 'CC' ELSE {LETTER.format('k + 1 + (p + j) % 3')} END AS alt, k % 7 <> 0 AS by_id FROM calls, range(3) t(j)),
hits AS (SELECT *, CASE WHEN gt = 'II' THEN false ELSE ((gt[1] IN (ref, alt) AND gt[2] IN (ref, alt) AND contains(gt, alt)) OR (gt[1] <> gt[2] AND gt[1] IN ({COMP.format('ref')}, {COMP.format('alt')}) AND gt[2] IN ({COMP.format('ref')}, {COMP.format('alt')}))) END AS hit FROM alleles)"""


def _calls(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("p"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("i"))
    k = F.col("k")
    rows = o.select((F.col("o_orderkey") * 4 + F.col("i")).alias("k"), "p")
    rows = rows.select("k", "p", text_of(k % 97 % 22 + 1).alias("chrom"), F.when(k % 53 == 0, "II").otherwise(F.concat(letter(k), letter(k + F.col("p") % 4))).alias("genotype"))
    return rows.withColumns({"rsid": F.concat(F.lit("rs"), "k"), "pos": F.col("k")})


def _alleles(spark, sf_dir) -> DataFrame:
    """Rows of a source: found by id, or (every seventh call) by place alone, as their id is another."""
    k, p, j = F.col("k"), F.col("p"), F.col("j")
    rows = _calls(spark, sf_dir).withColumn("j", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    alt = F.when(k % 53 == 0, F.concat(letter(k), F.lit("CC"))).otherwise(letter(k + 1 + (p + j) % 3))
    return rows.withColumns({"rsid": F.when(k % 7 == 0, F.concat(F.lit("n"), k)).otherwise(F.col("rsid")), "ref": letter(k), "alt": alt})


def _keyed(spark, sf_dir) -> DataFrame:
    return _calls(spark, sf_dir).withColumns({"_row": enrich.row_key(), "lookup_id": F.col("rsid")})


TERM_SQL = "CASE (k + j) % 4 WHEN 0 THEN 'missense_variant' WHEN 1 THEN 'intron_variant&splice_region_variant' WHEN 2 THEN 'stop_gained' ELSE 'synonymous_variant' END"
RANK_SQL = "CASE (k + j) % 4 WHEN 0 THEN 23 WHEN 1 THEN 20 WHEN 2 THEN 32 ELSE 14 END"


@query(f"""
WITH {CALL_SQL}, v AS (SELECT *, 't' || (k * 3 + j) AS tx, {TERM_SQL} AS term, {RANK_SQL} AS rank, ((k + p) % 2 * (j % 2)) AS mane FROM hits WHERE (k + p + j) % 5 < 3),
g AS (SELECT k, count(DISTINCT ref || alt) AS n, count(DISTINCT ref || alt) FILTER (hit) AS h FROM v GROUP BY 1),
o AS (SELECT v.*, n, h, row_number() OVER (PARTITION BY v.k ORDER BY (n > 1 AND NOT hit)::INT, mane DESC, rank DESC, tx, alt) AS r FROM v JOIN g USING (k))
SELECT k, CASE WHEN n <= 1 OR h = 1 THEN tx END AS transcript_id, CASE WHEN n <= 1 OR h = 1 THEN term END AS consequence, n > 1 AND h <> 1 AS ambiguous FROM o WHERE r = 1
""")
def annotate_transcripts(spark, sf_dir):
    """The transcript of each call: by id, else by place; of several alleles the only carried one; MANE, severity, id."""
    k, p, j = F.col("k"), F.col("p"), F.col("j")
    term = F.when((k + j) % 4 == 0, "missense_variant").when((k + j) % 4 == 1, "intron_variant&splice_region_variant").when((k + j) % 4 == 2, "stop_gained").otherwise("synonymous_variant")
    none = F.lit(None).cast("string")
    vep = _alleles(spark, sf_dir).filter((k + p + j) % 5 < 3).select(
        "rsid", "chrom", "pos", "ref", "alt", F.concat(F.lit("G"), p % 500).alias("gene_symbol"), F.concat(F.lit("t"), k * 3 + j).alias("transcript_id"), term.alias("consequence"), none.alias("hgvs_coding"), none.alias("hgvs_protein"),
        ((k + p) % 2 * (j % 2)).cast("int").alias("mane_select"),
    )
    calls = _keyed(spark, sf_dir)
    found = enrich.again(enrich.picked(enrich.once(calls), enrich.vep_pick(vep)).filter("_vep IS NOT NULL"))
    return found.select("k", F.col("_vep.vep.s.transcript_id").alias("transcript_id"), F.col("_vep.vep.s.consequence").alias("consequence"), F.col("_vep.ambiguous").alias("ambiguous"))


@query(f"""
WITH {CALL_SQL}, c AS (SELECT *, 'V' || (k * 3 + j) AS acc, (k * 5 + j) % 5 AS stars FROM hits WHERE (k + p + j) % 4 < 2 AND NOT ((k + j) % 11 = 0 AND by_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY (NOT hit)::INT, stars DESC, acc, alt) AS r FROM c)
SELECT k, acc AS accession, stars::INT AS review_stars, by_id::INT AS by_id FROM o WHERE r = 1
""")
def annotate_assertions(spark, sf_dir):
    """The clinical assertion of each call: a carried allele, then stars; a record that stands elsewhere doesn't count."""
    k, p, j = F.col("k"), F.col("p"), F.col("j")
    moved = F.when(((k + j) % 11 == 0) & (k % 7 != 0), k + 500_000_000).otherwise(k)
    none = F.lit(None).cast("string")
    clinvar = _alleles(spark, sf_dir).filter((k + p + j) % 4 < 2).select(
        "rsid", "chrom", moved.alias("pos"), "ref", "alt", F.lit("Pathogenic").alias("significance"), ((k * 5 + j) % 5).cast("int").alias("review_stars"), F.concat(F.lit("V"), k * 3 + j).alias("accession"), none.alias("conditions"), none.alias("gene_symbol")
    )
    calls = _keyed(spark, sf_dir)
    found = enrich.again(enrich.picked(enrich.once(calls), enrich.clinvar_pick(clinvar)).filter("clinvar IS NOT NULL"))
    return found.select("k", F.col("clinvar.s.accession").alias("accession"), F.col("clinvar.s.review_stars").alias("review_stars"), (F.col("clinvar.way") == 0).cast("int").alias("by_id"))


@query(f"""
WITH {CALL_SQL}, q AS (SELECT k, p, chrom, gt, {LETTER.format('k')} AS ref, {LETTER.format('k + 1 + p % 3')} AS alt, p % 2 = 0 AND k % 53 <> 0 AS known FROM calls), g AS (SELECT * FROM hits WHERE (k + p + j) % 5 < 3),
e AS (SELECT q.k, 'matched' AS status, g.alt FROM q JOIN g ON q.k = g.k AND q.ref = g.ref AND q.alt = g.alt WHERE known),
l AS (SELECT q.k, count(DISTINCT g.alt) AS n, count(DISTINCT g.alt) FILTER (hit) AS h, min(g.alt) AS one, min(g.alt) FILTER (hit) AS own FROM q JOIN g ON q.k = g.k AND by_id WHERE NOT known GROUP BY 1)
SELECT * FROM e UNION ALL SELECT k, CASE WHEN n = 1 OR h = 1 THEN 'matched' ELSE 'allele_ambiguous' END, CASE WHEN n = 1 THEN one WHEN h = 1 THEN own END FROM l
""")
def annotate_frequencies(spark, sf_dir):
    """Frequencies by place and alleles where they are known, else by id if one allele is left."""
    k, p, j = F.col("k"), F.col("p"), F.col("j")
    gnomad = _alleles(spark, sf_dir).filter((k + p + j) % 5 < 3).select("rsid", "chrom", "pos", "ref", "alt", (j / 10).alias("af_global"), F.lit(0).cast("long").alias("homozygous_count"))
    known = (p % 2 == 0) & (k % 53 != 0)
    calls = _keyed(spark, sf_dir).withColumns({"ref": F.when(known, letter(k)), "alt": F.when(known, letter(k + 1 + p % 3))})
    found = enrich.gnomad_by_place(enrich.gnomad_by_id(enrich.once(calls), gnomad), gnomad)
    return enrich.again(found.filter("status IS NOT NULL")).select("k", "status", F.col("gnomad.alt").alias("alt"))


@query(f"""
WITH {CALL_SQL}, o AS (SELECT k, alt, j, row_number() OVER (PARTITION BY k ORDER BY (NOT hit)::INT, alt, ref) AS r FROM hits WHERE (k + p + j) % 3 < 2)
SELECT k, alt, (j * 10)::DOUBLE AS cadd_phred FROM o WHERE r = 1 AND k % 53 <> 0
""")
def annotate_scores(spark, sf_dir):
    """Scores of each call: a carried allele first, then the least."""
    k, p, j = F.col("k"), F.col("p"), F.col("j")
    source = _alleles(spark, sf_dir).filter((k + p + j) % 3 < 2).select("rsid", "chrom", "pos", "ref", "alt", (j * 10).cast("double").alias("cadd_phred"))
    calls = _keyed(spark, sf_dir)
    found = enrich.again(enrich.picked(enrich.once(calls.filter(k % 53 != 0)), enrich.dbnsfp_pick(source)).filter("dbnsfp IS NOT NULL"))
    return found.select("k", F.col("dbnsfp.s.alt").alias("alt"), F.col("dbnsfp.s.cadd_phred").alias("cadd_phred"))


@query(f"""
WITH {CALL_SQL}, q AS (SELECT k, p, gt, {LETTER.format('k')} AS ref, {LETTER.format('k + 1 + p % 3')} AS alt FROM calls WHERE k % 53 <> 0)
SELECT annotation_coverage, zygosity, count(*)::BIGINT AS n FROM (SELECT (k % 3 < 2)::INT * 1 + (k % 4 < 2)::INT * 2 + (k % 5 < 3)::INT * 4 + (k % 2 = 0 AND k % 3 = 0)::INT * 128 AS annotation_coverage,
  CASE WHEN k % 3 < 2 OR k % 4 < 2 THEN CASE WHEN gt[1] IN (ref, alt) AND gt[2] IN (ref, alt) THEN CASE WHEN gt[1] <> gt[2] THEN 'het' WHEN gt[1] = alt THEN 'hom_alt' ELSE 'hom_ref' END
    WHEN gt[1] <> gt[2] AND gt[1] IN ({COMP.format('ref')}, {COMP.format('alt')}) AND gt[2] IN ({COMP.format('ref')}, {COMP.format('alt')}) THEN 'het' END END AS zygosity FROM q) GROUP BY 1, 2
""")
def annotate_wide(spark, sf_dir):
    """The whole enrichment with one allele a call in each source: coverage mask and zygosity of the merged table."""
    k, p = F.col("k"), F.col("p")
    calls = _calls(spark, sf_dir).filter(k % 53 != 0)
    site = ["rsid", "chrom", "pos", letter(k).alias("ref"), letter(k + 1 + p % 3).alias("alt")]
    none = F.lit(None).cast("string")
    sources = enrich.Sources(
        vep=calls.filter(k % 3 < 2).select(*site, none.alias("gene_symbol"), F.concat(F.lit("t"), k).alias("transcript_id"), F.when(k % 3 == 0, "missense_variant").otherwise("intron_variant").alias("consequence"), none.alias("hgvs_coding"), none.alias("hgvs_protein"), F.lit(1).alias("mane_select")),
        clinvar=calls.filter(k % 4 < 2).select(*site, F.lit("Benign").alias("significance"), F.lit(1).alias("review_stars"), F.concat(F.lit("V"), k).alias("accession"), none.alias("conditions"), none.alias("gene_symbol")),
        gnomad=calls.filter(k % 5 < 3).select(*site, F.lit(0.2).alias("af_global"), F.lit(0).cast("long").alias("homozygous_count")),
        alphamissense=calls.filter(k % 2 == 0).select(*site[1:], F.lit(0.5).alias("am_pathogenicity"), F.lit("x").alias("am_class")),
    )
    wide = enrich.annotate(calls.select("k", "rsid", "chrom", "pos", "genotype"), sources)
    return wide.groupBy("annotation_coverage", "zygosity").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT p_partkey AS k, p_size AS s FROM part), q AS (SELECT k, CASE WHEN s % 5 = 0 THEN NULL ELSE s / 50.0 END AS quality, s / 100.0 AS af, s % 3 AS copies FROM r)
SELECT '1' AS chrom, k AS pos, 'V' || k || CASE WHEN k % 4 = 0 THEN 'b' ELSE 'a' END AS accession, copies::INT AS copies, CASE WHEN k % 4 = 0 THEN 3 ELSE 2 END AS evidence_level
FROM q WHERE quality >= 0.8 AND least(af, 1 - af) >= 0.01 AND copies > 0 AND k % 10 <> 0 AND k % 2 = 0
""")
def imputed_findings(spark, sf_dir):
    """Imputed rows past the quality gate, not typed, with a pathogenic assertion."""
    p = parts(spark, sf_dir)
    place = [F.lit("1").alias("chrom"), key().alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt")]
    rows = p.select(*place, (size() % 3).cast("int").alias("copies"), (size() % 3).cast("double").alias("dosage"), F.when(size() % 5 != 0, size() / 50.0).alias("quality"), (size() / 100.0).alias("af"))
    both = p.filter(key() % 2 == 0).select(*place, F.explode(F.array(F.struct(F.concat(F.lit("V"), key(), F.lit("a")).alias("accession"), F.lit(0).alias("review_stars")), F.struct(F.concat(F.lit("V"), key(), F.lit("b")).alias("accession"), F.when(key() % 4 == 0, 2).otherwise(-1).alias("review_stars")))).alias("c"))
    clinvar = both.select("chrom", "pos", "ref", "alt", "c.*", F.lit("Pathogenic|x").alias("significance"))
    return enrich.imputed_findings(rows, p.filter(key() % 10 == 0).select(*place), clinvar).select("chrom", "pos", "accession", "copies", "evidence_level")


# --- column rules -------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'stop_gained&missense_variant' WHEN 1 THEN 'intron_variant' END AS terms, CASE p_size % 4 WHEN 0 THEN 32 WHEN 1 THEN 8 ELSE -1 END AS rank FROM part
""")
def consequence_terms(spark, sf_dir):
    """Terms of an item list and the highest rank among them; a malformed list gives none."""
    mc = F.when(size() % 4 == 0, "SO:0001587|stop_gained,SO:0001583|missense_variant,SO:0001587|stop_gained").when(size() % 4 == 1, "SO:0001627|intron_variant").when(size() % 4 == 2, "SO:1|bad")
    rows = parts(spark, sf_dir).select("p_partkey", S.consequence_terms(mc).alias("terms"))
    return rows.withColumn("rank", S.max_term_rank(F.col("terms"), enrich.SEVERITY))


@query("SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'high' WHEN p_size >= 20 THEN 'middle' ELSE 'low' END AS band, CASE WHEN p_size % 7 >= 2 THEN 4 WHEN p_size % 7 = 1 THEN 3 ELSE 2 END AS clinical, CASE p_size % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS letter, CASE WHEN p_size % 2 = 1 THEN 1 WHEN p_size > 25 THEN 4 WHEN p_size % 4 = 0 THEN 3 ELSE 2 END AS association, least(CASE WHEN p_size % 7 >= 2 THEN 4 WHEN p_size % 7 = 1 THEN 3 ELSE 2 END, 3) AS capped FROM part")
def evidence_levels(spark, sf_dir):
    stars = size() % 7
    p = F.when(size() % 2 == 1, 1e-6).otherwise(1e-9)
    code = F.when(size() % 5 == 0, "a").when(size() % 5 == 1, "B").when(size() % 5 == 2, "c").when(size() % 5 == 3, "D").otherwise("?")
    level = S.clinical_level(stars, F.lit(5))
    return parts(spark, sf_dir).select(
        "p_partkey", S.band(size(), [(40, "high"), (20, "middle")], "low").alias("band"), level.alias("clinical"), S.letter_level(code).alias("letter"), S.association_level(p, size() / 5.0, size() % 4 == 0).alias("association"), S.capped(level, 3).alias("capped")
    )


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN p_size / 10.0 WHEN p_size % 3 = 0 THEN 0.5 END AS af, NOT (p_size % 2 = 0) AND (CASE WHEN p_size <= 10 THEN p_size / 10.0 WHEN p_size % 3 = 0 THEN 0.5 END IS NULL) AS implausible, p_size > 0 AND p_size / 1000.0 < 0.01 AS rare, p_size / 1000.0 < 0.001 AND p_size > 0 AS ultra FROM part")
def frequency_rules(spark, sf_dir):
    af = S.effective_af(size() / 10.0, F.when(size() % 3 == 0, 0.5))
    rare, ultra = S.rare_flags(size() / 1000.0)
    return parts(spark, sf_dir).select("p_partkey", af.alias("af"), S.implausible_homozygote(af, (size() % 2 == 0).cast("long")).alias("implausible"), rare.alias("rare"), ultra.alias("ultra"))


@query(f"""
WITH t AS (SELECT p_partkey AS k, {LETTER.format('p_partkey')} || {LETTER.format('p_size')} AS g, {LETTER.format('p_partkey // 4')} AS r, {LETTER.format('p_size // 4')} AS o FROM part),
u AS (SELECT *, {COMP.format('r')} AS cr, {COMP.format('o')} AS co, g[1] AS a, g[2] AS b FROM t)
SELECT k, CASE WHEN o = cr THEN CASE WHEN a <> b AND a IN (r, o) AND b IN (r, o) THEN 1 END WHEN a IN (r, o) AND b IN (r, o) THEN (a = r)::INT + (b = r)::INT WHEN a IN (cr, co) AND b IN (cr, co) THEN (a = cr)::INT + (b = cr)::INT END AS copies,
  CASE WHEN a IN (r, o) AND b IN (r, o) THEN (a = r)::INT + (b = r)::INT END AS trusted FROM u
""")
def risk_copies(spark, sf_dir):
    g = F.concat(letter(key()), letter(size()))
    risk, ref = letter(F.floor(key() / 4)), letter(F.floor(size() / 4))
    return parts(spark, sf_dir).select(key().alias("k"), G.risk_dosage(g, risk, ref).alias("copies"), G.risk_dosage(g, risk, ref, allow_complement=False).alias("trusted"))


@query(f"""
WITH t AS (SELECT p_partkey AS k, p_size / 20.0 AS d, {LETTER.format('p_partkey')} AS r, {LETTER.format('p_size')} AS t, {LETTER.format('p_partkey // 4')} AS e, {LETTER.format('p_size // 4')} AS o FROM part)
SELECT k, CASE WHEN r <> t AND o <> {COMP.format('e')} AND d <= 2 THEN CASE WHEN e = t AND o = r THEN d WHEN e = r AND o = t THEN 2 - d WHEN e = {COMP.format('t')} AND o = {COMP.format('r')} THEN d WHEN e = {COMP.format('r')} AND o = {COMP.format('t')} THEN 2 - d END END AS dose FROM t
""")
def imputed_doses(spark, sf_dir):
    return parts(spark, sf_dir).select(key().alias("k"), G.imputed_dosage(letter(key()), letter(size()), size() / 20.0, letter(F.floor(key() / 4)), letter(F.floor(size() / 4))).alias("dose"))


@query(f"""
WITH t AS (SELECT p_partkey AS k, {LETTER.format('p_partkey')} || {LETTER.format('p_size')} AS g FROM part)
SELECT k, CASE WHEN g IN ('AA', 'TT') THEN 'low' WHEN g IN ('AG', 'GA', 'TC', 'CT') THEN 'mid' WHEN g IN ('GG') THEN 'high' WHEN g = 'CC' THEN 'high' END AS level, g IN ('GG', 'CC') AS ambiguous, g IN ('AG', 'GA') AS pair FROM t
""")
def map_lookup(spark, sf_dir):
    """A call looked up in any spelling, and whether its strand decides."""
    g = F.concat(letter(key()), letter(size()))
    table = S.as_map({"AA": "low", "AG": "mid", "GG": "high"})
    both = S.as_map({"GG": "x", "CC": "y"})
    return parts(spark, sf_dir).select(key().alias("k"), G.lookup(table, g).alias("level"), G.strand_ambiguous(both, g).alias("ambiguous"), (G.canonical(g) == "AG").alias("pair"))


@query("""
SELECT p_partkey AS k, '["' || (p_size % 3 + 1) || '",' || p_partkey || ',"A","G\\"T"]' AS identity, CASE p_size % 4 WHEN 0 THEN 'snv' WHEN 1 THEN 'indel' END AS probe, CASE p_size % 3 WHEN 0 THEN 'snv' WHEN 1 THEN 'indel' END AS site FROM part
""")
def allele_identity(spark, sf_dir):
    probe = F.when(size() % 4 == 0, "ag").when(size() % 4 == 1, "DI").when(size() % 4 == 2, "--")
    alt = F.when(size() % 3 == 0, "g").when(size() % 3 == 1, "GT").otherwise("<DEL>")
    return parts(spark, sf_dir).select(key().alias("k"), G.allele_identity(text_of(size() % 3 + 1), key(), F.lit("A"), F.lit('G"T')).alias("identity"), G.probe_class(probe).alias("probe"), G.row_class(F.lit("A"), alt).alias("site"))


@query("""
WITH t AS (SELECT p_partkey AS k, CASE p_size % 5 WHEN 0 THEN 'chrX' WHEN 1 THEN 'Y' WHEN 2 THEN 'MT' WHEN 3 THEN 'chrM' ELSE '7' END AS c, CASE p_partkey % 3 WHEN 0 THEN 'het' WHEN 1 THEN 'hom_alt' ELSE 'hom_ref' END AS z, CASE WHEN p_partkey % 2 = 0 THEN 'XY' ELSE 'XX' END AS x, CASE WHEN p_partkey % 4 < 2 THEN 100000 ELSE 5000000 END AS pos FROM part)
SELECT k, CASE WHEN c IN ('MT', 'chrM') AND z = 'hom_alt' THEN 'homoplasmic' WHEN c IN ('MT', 'chrM') AND z = 'het' THEN 'heteroplasmic' WHEN x = 'XY' AND z = 'hom_alt' AND (c = 'Y' OR (c = 'chrX' AND pos > 2699520)) THEN 'hemizygous'
  WHEN z = 'het' THEN 'heterozygous' WHEN z = 'hom_alt' THEN 'homozygous' ELSE 'reference' END AS state, NOT (c = 'Y' AND x = 'XX') AS surfaced FROM t
""")
def allelic_state(spark, sf_dir):
    c = F.when(size() % 5 == 0, "chrX").when(size() % 5 == 1, "Y").when(size() % 5 == 2, "MT").when(size() % 5 == 3, "chrM").otherwise("7")
    z = F.when(key() % 3 == 0, "het").when(key() % 3 == 1, "hom_alt").otherwise("hom_ref")
    sex = F.when(key() % 2 == 0, "XY").otherwise("XX")
    return parts(spark, sf_dir).select(key().alias("k"), G.allelic_state(c, F.when(key() % 4 < 2, 100000).otherwise(5000000), z, sex).alias("state"), rules.surfaceable(c, sex).alias("surfaced"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 4 THEN NULL WHEN 3 THEN 'unknown' ELSE ['none', 'one', 'two'][p_size % 5 + 1] END AS label, coalesce(CASE WHEN p_size % 3 <> 0 THEN p_size END, 0) | 64 AS mask FROM part")
def count_labels(spark, sf_dir):
    """A label by a count, where null is no zero, and a bit set in a mask that may be null."""
    n = F.when(size() % 5 < 4, size() % 5)
    label = F.when(n.isNull(), F.lit(None)).otherwise(selection.by_count(n, {0: "none", 1: "one", 2: "two"}, "unknown"))
    return parts(spark, sf_dir).select("p_partkey", label.alias("label"), S.with_bit(F.when(size() % 3 != 0, size()), 64).alias("mask"))


@query("SELECT p_partkey, p_size >= 25 AS sufficient, p_size % 10 < 7 AS top_warning, p_size % 2 = 0 AS ancestry_mismatch, p_size >= 25 AND p_size % 3 = 0 AS show_percentile FROM part")
def score_flags(spark, sf_dir):
    flags = scores.qualified(size() / 50.0, size() % 3 == 0, size() % 2 == 0, size() % 10 / 10.0)
    return parts(spark, sf_dir).select("p_partkey", *[c.alias(n) for n, c in flags.items()])


@query("""
WITH t AS (SELECT p_partkey AS k, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '--' WHEN 2 THEN 'GA' WHEN 3 THEN 'AA' ELSE 'CC' END AS a, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'TC' ELSE 'CC' END AS b FROM part)
SELECT k, CASE WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN a = '--' THEN 'no_call' WHEN a IN ('GA', 'AA') AND b = 'CC' OR a = 'GA' AND b = 'TC' THEN 'called' ELSE 'ambiguous' END AS status,
  CASE WHEN a = 'GA' AND b = 'CC' THEN 'e1' WHEN a = 'AA' AND b = 'CC' THEN 'e2' WHEN a = 'GA' AND b = 'TC' THEN 'e3' END AS label FROM t
""")
def two_locus_calls(spark, sf_dir):
    a = F.when(size() % 5 == 1, "--").when(size() % 5 == 2, "GA").when(size() % 5 == 3, "AA").when(size() % 5 == 4, "CC")
    b = F.when(key() % 4 == 0, F.lit(None)).when(key() % 4 == 1, "TC").otherwise("CC")
    pair = panels.diplotype_pair(a, b, S.as_map({"AG/CC": "e1", "AA/CC": "e2", "AG/CT": "e3"}))
    return parts(spark, sf_dir).select(key().alias("k"), pair.alias("d")).select("k", "d.*")


@query("SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS copies FROM part")
def allele_carriage(spark, sf_dir):
    """Copies of an allele named by its first fields."""
    none = F.lit(None).cast("string")
    alleles = F.when(size() % 4 == 0, F.array(F.lit("B*57:01"), F.lit("B*57:01:01"))).when(size() % 4 == 1, F.array(F.lit("B*57:01:02"), F.lit("B*07:02"))).when(size() % 4 == 2, F.array(F.lit("B*57:011"), none)).otherwise(F.array(none, none))
    return parts(spark, sf_dir).select(key().alias("k"), panels.allele_copies(alleles, "B*57:01").alias("copies"))


# --- rows chosen, joined and counted ------------------------------------------------------------------------------


@query("SELECT p_brand, arg_min(p_partkey, (CASE p_type WHEN 'PROMO' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END, p_partkey)) AS p_partkey FROM part GROUP BY 1")
def preferred_rows(spark, sf_dir):
    """One row a group by an order of categories."""
    return selection.preferred(parts(spark, sf_dir).select("p_brand", "p_type", "p_partkey"), ["p_brand"], "p_type", ["PROMO", "STANDARD"], [key()]).select("p_brand", "p_partkey")


@query("SELECT p_partkey, p_type FROM part WHERE NOT (lower(p_type) = 'promo' AND lower(p_brand) = 'brand#12')")
def held_pairs(spark, sf_dir):
    """Rows of a held pair of names stay hidden."""
    return selection.without_held(parts(spark, sf_dir), [("PROMO", "brand#12")], "p_type", "p_brand").select("p_partkey", "p_type")


@query("SELECT p_brand, list_sort(list(DISTINCT p_type)) AS items, min(p_size) AS p_size FROM part GROUP BY 1")
def grouped_items(spark, sf_dir):
    return selection.grouped_list(parts(spark, sf_dir), "p_brand", "p_type", "p_size")


@query("""
WITH s AS (SELECT p_size AS score_id, p_brand AS gene FROM part WHERE p_partkey % 3 = 0), f AS (SELECT DISTINCT p_brand AS gene FROM part WHERE p_type = 'PROMO' AND p_brand <> 'Brand#11')
SELECT score_id, list_sort(list(DISTINCT gene)) AS genes FROM s SEMI JOIN f USING (gene) GROUP BY 1
""")
def listed_carriers(spark, sf_dir):
    p = parts(spark, sf_dir)
    return selection.carriers_among(p.filter("p_type = 'PROMO'").select(F.col("p_brand").alias("gene_symbol")), p.filter(key() % 3 == 0).select(size().alias("score_id"), F.col("p_brand").alias("gene_symbol")), ["Brand#11"])


@query("SELECT DISTINCT o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def distinct_members(spark, sf_dir):
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    return lookup.members(o, c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_pairs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct()


@query("SELECT p_brand, count(DISTINCT (p_type, p_size % 2))::BIGINT AS n FROM part GROUP BY 1 HAVING count(DISTINCT (p_type, p_size % 2)) > 1 ORDER BY 1 LIMIT 5")
def places_per_key(spark, sf_dir):
    """Keys that stand at several places; at most five are shown, which is the feature."""
    return lookup.one_place_each(parts(spark, sf_dir).withColumn("odd", size() % 2), "p_brand", ["p_type", "odd"])


@query("SELECT a.c_custkey, a.c_nationkey AS old_value, (a.c_nationkey + a.c_custkey % 2)::INT AS new_value FROM customer a WHERE a.c_custkey % 2 = 1 AND a.c_custkey % 5 <> 0")
def changed_values(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    new = c.filter("c_custkey % 5 <> 0").select("c_custkey", (F.col("c_nationkey") + F.col("c_custkey") % 2).cast("int").alias("c_nationkey"))
    return lookup.changed_values(c, new, "c_custkey", "c_nationkey")


@query("SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def ordered_counts(spark, sf_dir):
    return facets.counts(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", F.substring("o_orderpriority", 1, 1))


@query("SELECT count(*) FILTER (o_orderstatus = 'F')::BIGINT AS done, max(o_totalprice) AS most, count(DISTINCT o_custkey)::BIGINT AS customers FROM orders")
def single_row_metrics(spark, sf_dir):
    return facets.single_row(spark.read.parquet(f"{sf_dir}/orders.parquet"), done=F.count_if(F.col("o_orderstatus") == "F"), most=F.max("o_totalprice"), customers=F.count_distinct("o_custkey"))


@query(f"""
WITH t AS (SELECT CASE WHEN p_size % 7 <> 0 THEN {LETTER.format('p_partkey')} || {LETTER.format('p_size')} END AS g, p_partkey % 5 <> 0 AS autosome, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ti FROM part)
SELECT round(count(g) / count(*), 5) AS call_rate, round(count(*) FILTER (autosome AND g[1] <> g[2]) / count(*) FILTER (autosome AND g IS NOT NULL), 5) AS het_rate, round(count(*) FILTER (ti) / count(*) FILTER (NOT ti), 3) AS titv FROM t
""")
def genotype_metrics(spark, sf_dir):
    g = F.when(size() % 7 != 0, F.concat(letter(key()), letter(size())))
    return facets.genotype_metrics(parts(spark, sf_dir), g, key() % 5 != 0, F.when(size() % 3 == 0, True).when(size() % 3 == 1, False))


@query("""
WITH t AS (SELECT user_id AS u, epoch(date_trunc('second', ts))::BIGINT AS t FROM events), d AS (SELECT *, t - lag(t) OVER (PARTITION BY u ORDER BY t) AS g FROM t), i AS (SELECT *, sum((g IS NULL OR g > 86400)::INT) OVER (PARTITION BY u ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM d),
b AS (SELECT u, i, count(*) AS n, min(t) AS lo, max(t) AS hi FROM i GROUP BY 1, 2)
SELECT u, bool_or(n >= 3 AND hi - lo >= 3600) AS eligible FROM b GROUP BY 1
""")
def eligible_groups(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("u"), S.since_epoch(F.col("ts")).alias("t"))
    return sequence.eligible(e, ["u"], "t", 86400, 3, 3600)


@query("SELECT p_partkey, p_size FROM part WHERE p_brand = 'Brand#12' AND p_partkey + p_size >= 50 AND p_partkey <= 150000")
def region_rows(spark, sf_dir):
    """Intervals of one group that touch a region."""
    rows = parts(spark, sf_dir).withColumn("e", key() + size())
    return intervals.region(rows, "p_brand", "Brand#12", "p_partkey", "e", 50, 150000).select("p_partkey", "p_size")


@query("""
SELECT count(*)::BIGINT AS total, count(*) FILTER (p_size % 4 <> 0 AND p_partkey > 0 AND (p_partkey - 1) % 1000 < 600)::BIGINT AS converted, count(*) FILTER (p_size % 4 <> 0 AND (p_partkey = 0 OR (p_partkey - 1) % 1000 >= 600))::BIGINT AS failed, count(*) FILTER (p_size % 4 = 0)::BIGINT AS already_lifted FROM part
""")
def lift_missing_places(spark, sf_dir):
    """New places for rows without one, and how many there were."""
    p = parts(spark, sf_dir)
    rows = p.select(F.lit("1").alias("chrom"), key().alias("pos"), F.when(size() % 4 == 0, "1").alias("new_chrom"), F.when(size() % 4 == 0, key()).alias("new_pos"))
    at = F.col("b") * 1000
    chain = p.select(F.floor(key() / 1000).alias("b")).distinct().select(F.lit("chr1").alias("t_chrom"), at.alias("t_start"), (at + 600).alias("t_end"), F.lit("chr1").alias("q_chrom"), (at + 7).alias("q_start"), F.lit("+").alias("strand"), F.lit(10**9).cast("long").alias("q_size"), F.col("b").cast("int").alias("block"))
    return intervals.lift_missing(rows, chain)[1]


@query(f"SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) >= (TIMESTAMP '1996-06-01', 0) ORDER BY o_orderdate, o_orderkey LIMIT 26")
def seek_page(spark, sf_dir):
    """The page from a place on, that place included."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    return paging.page(o, [F.col("o_orderdate"), F.col("o_orderkey")], 25, [F.lit("1996-06-01").cast("timestamp")])


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(lower(c_name), 'customer#00000') OR starts_with(lower(c_mktsegment), 'customer#00000') ORDER BY c_name, c_custkey LIMIT 10")
def palette_search(spark, sf_dir):
    """The first ten hits of a prefix in any of two columns."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return paging.ranked_page(rules.prefix(c, "CUSTOMER#00000", ["c_name", "c_mktsegment"]), [F.col("c_name"), F.col("c_custkey")], 10).select("c_custkey", "c_name")


@query("SELECT o_orderkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY o_orderkey LIMIT 51")
def joined_page(spark, sf_dir):
    """A page of a left join, planned as a top-k."""
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    rows = lookup.exact(o.select("o_orderkey", "o_custkey"), c.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal"), ["o_custkey"], ["c_name", "c_acctbal"])
    return paging.page(rows.select("o_orderkey", "c_name", "c_acctbal"), [F.col("o_orderkey")], 50)


@query("SELECT 'n' AS module, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'r', count(*) FROM region")
def isolated_modules(spark, sf_dir):
    """Results of modules in order; one that fails is left out."""
    def broken(*_):
        raise ValueError("no")

    count = lambda t: lambda s, d: s.read.parquet(f"{d}/{t}.parquet").agg(F.count("*").alias("n"))
    return console.run_modules([("n", count("nation")), ("x", broken), ("r", count("region"))], spark, sf_dir)[0]


@query("""
WITH g AS (SELECT * FROM (VALUES ('Normal', 'd1', NULL, 'A'), ('Poor', 'd1', NULL, 'B'), ('Poor', 'd1', 1.0, 'C'), ('Poor', 'd2', NULL, 'D')) t(phenotype, drug, g, cls)), c AS (SELECT p_partkey AS s, CASE p_size % 3 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Poor' END AS phenotype, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 2.0 END AS a, p_size % 5 = 0 AS thin FROM part),
h AS (SELECT c.s, g.drug, g.cls, row_number() OVER (PARTITION BY s, drug ORDER BY (g.g IS NULL)::INT, cls) AS r FROM c JOIN g ON c.phenotype = g.phenotype AND (g.g IS NULL OR g.g = c.a) WHERE NOT thin)
SELECT s AS sample_id, drug, cls AS classification FROM h WHERE r = 1
""")
def guidelines(spark, sf_dir):
    """Guideline rows of calls: the row for a score before the generic one."""
    pheno = F.when(size() % 3 == 0, "Normal").when(size() % 3 == 1, "Poor")
    calls = parts(spark, sf_dir).select(key().alias("sample_id"), F.lit("G").alias("gene"), pheno.alias("phenotype"), F.when(size() % 5 == 0, "Insufficient").otherwise("Complete").alias("confidence"), F.when(key() % 2 == 0, 1.0).otherwise(2.0).alias("activity_score"))
    g = spark.createDataFrame([("G", "Normal", None, "d1", "A"), ("G", "Poor", None, "d1", "B"), ("G", "Poor", 1.0, "d1", "C"), ("G", "Poor", None, "d2", "D")], "gene string, phenotype string, activity_score double, drug string, classification string")
    return callers.guideline_rows(calls, g).select("sample_id", "drug", "classification")


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.v IS NULL THEN b.v ELSE coalesce(b.v, a.v) END AS v, CASE WHEN a.k IS NULL OR b.k IS NULL THEN 'unique' WHEN a.v = b.v THEN 'match' ELSE 'discordant' END AS concordance FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 4 <> 0) b ON a.k = b.k")
def reconcile_by_vendor(spark, sf_dir):
    """A merge in which the right side's vendor is preferred."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.lit("n").alias("nm"), F.col("o_orderstatus").alias("v"))
    a, b = o.filter("k % 3 <> 0"), o.filter("k % 4 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, "Z").otherwise(F.col("v")))
    return merge.reconcile(a, b, ["k"], "v", "nm", strategy="prefer_vendor_b", vendors=("a", "b")).select("k", "v", "concordance")


@query("""
WITH t AS (SELECT p_partkey AS k, CASE p_size % 5 WHEN 0 THEN ' Transcript_Ablation ' WHEN 1 THEN 'STOP_GAINED&intron_variant' WHEN 2 THEN 'splice_donor_variant' WHEN 3 THEN 'start_lost' ELSE 'intron_variant' END AS c, p_partkey % 2 = 0 AS lof FROM part)
SELECT k, CASE WHEN lof THEN CASE trim(lower(c)) WHEN 'transcript_ablation' THEN 8 WHEN 'stop_gained&intron_variant' THEN 8 WHEN 'splice_donor_variant' THEN 4 WHEN 'start_lost' THEN 2 ELSE 0 END ELSE 0 END AS points FROM t
""")
def loss_of_function_points(spark, sf_dir):
    """Points of loss-of-function terms in any letter case."""
    term = F.when(size() % 5 == 0, " Transcript_Ablation ").when(size() % 5 == 1, "STOP_GAINED&intron_variant").when(size() % 5 == 2, "splice_donor_variant").when(size() % 5 == 3, "start_lost").otherwise("intron_variant")
    none = F.lit(None).cast("double")
    rows = parts(spark, sf_dir).select(key().alias("k"), term.alias("consequence"), (key() % 2 == 0).alias("gene_lof"), F.lit(False).alias("gene_missense"), none.alias("missense_z"), none.alias("popmax_af"), none.alias("af_alleles"), none.alias("revel"))
    return scores.classify_points(rows, scores.variant_criteria()).select("k", "points")


@query("""
WITH t AS (SELECT p_partkey, p_brand, p_size % 4 AS z FROM part)
SELECT p_brand AS snp, string_agg(CASE z WHEN 0 THEN '0' WHEN 1 THEN '2' WHEN 2 THEN '3' ELSE '1' END, '' ORDER BY p_partkey) AS codes FROM t GROUP BY 1
""")
def packed_genotypes(spark, sf_dir):
    """Two-bit codes of all samples of a marker, unpacked again."""
    z = F.when(size() % 4 == 0, "hom_alt").when(size() % 4 == 1, "het").when(size() % 4 == 2, "hom_ref")
    rows = parts(spark, sf_dir).select(F.col("p_brand").alias("snp"), key().alias("sample_id"), z.alias("zygosity"))
    block = sinks.plink_codes(rows).join(rows.groupBy("snp").agg(F.count("*").alias("n")), "snp")
    at = lambda i: F.conv(F.substring(F.hex("block"), (F.floor(i / 4) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    code = lambda i: F.shiftright(at(i), 0).bitwiseAND(F.lit(255))
    digit = lambda i: F.pmod(F.floor(code(i) / F.pow(F.lit(4.0), i % 4)).cast("int"), F.lit(4))
    return block.select("snp", F.array_join(F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: digit(i).cast("string")), "").alias("codes"))


@query(f"""
WITH t AS (SELECT p_partkey AS k, {LETTER.format('p_partkey')} AS a, {LETTER.format('p_size')} AS b FROM part WHERE p_partkey % 2 = 0 AND p_partkey > 10 AND p_partkey <= 1000)
SELECT '1' || chr(9) || k || chr(9) || 'rs' || k || chr(9) || 'N' || chr(9) || CASE WHEN a = b THEN a ELSE a || ',' || b END || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || '.' || chr(9) || 'GT' || chr(9) || CASE WHEN a = b THEN '1/1' ELSE '1/2' END AS value FROM t
""")
def region_vcf(spark, sf_dir):
    """VCF lines of one half-open region."""
    rows = parts(spark, sf_dir).select(F.concat(F.lit("rs"), key()).alias("rsid"), F.when(key() % 2 == 0, "1").otherwise("2").alias("chrom"), key().alias("pos"), F.concat(letter(key()), letter(size())).alias("genotype"))
    none = F.lit(None).cast("string")
    alleles = rows.limit(0).select("rsid", "chrom", "pos", none.alias("ref"), none.alias("alt"), none.alias("zygosity"))
    return sinks.region_lines(rows, alleles, "1", 10, 1000)


# --- composed plans -----------------------------------------------------------------------------------------------


@query(f"""
WITH c AS (SELECT l_suppkey % 40 AS sample_id, l_partkey AS k, min(CASE l_orderkey % 4 WHEN 0 THEN 'AA' WHEN 1 THEN 'AG' WHEN 2 THEN 'GG' ELSE '--' END) AS g FROM lineitem GROUP BY 1, 2),
b AS (SELECT p_partkey AS k, p_size / 50.0 AS mean, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE 0.5 END AS sd, p_size / 1000.0 AS l1, (p_partkey % 10) / 1000.0 AS l2 FROM part),
d AS (SELECT sample_id, CASE WHEN sd > 0 THEN ((g[1] = 'G')::INT + (g[2] = 'G')::INT - mean) / sd ELSE 0 END AS z, l1, l2 FROM c JOIN b USING (k) WHERE g <> '--'),
p AS (SELECT sample_id, sum(z * l1) AS x, sum(z * l2) AS y, count(*) / (SELECT count(*) FROM b) AS coverage FROM d GROUP BY 1),
m AS (SELECT * FROM (VALUES ('P', 0.0, 0.0), ('Q', 5.0, 1.0), ('R', -5.0, 1.0)) t(label, cx, cy)),
r AS (SELECT p.*, label, (x - cx) ** 2 + (y - cy) ** 2 AS d, row_number() OVER (PARTITION BY sample_id ORDER BY (x - cx) ** 2 + (y - cy) ** 2, label) AS r FROM p, m)
SELECT a.sample_id, round(a.coverage, 6) AS coverage, a.label AS nearest, round(a.d, 5) AS distance, CASE WHEN a.coverage < 0.05 THEN 'UNCERTAIN' WHEN sqrt(b.d) / sqrt(a.d) < 2 THEN 'ADMIXED' ELSE a.label END AS verdict, 3::INT AS n_fractions FROM r a JOIN r b ON a.sample_id = b.sample_id AND a.r = 1 AND b.r = 2
""")
def ancestry_plan(spark, sf_dir):
    """Calls to dosages, projection, nearest centroid and mixture in one plan; the mixture itself is held by tests."""
    code = F.col("l_orderkey") % 4
    g = F.when(code == 0, "AA").when(code == 1, "AG").when(code == 2, "GG").otherwise("--")
    calls = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") % 40).alias("sample_id"), text_of(F.col("l_partkey")).alias("rsid"), g.alias("genotype"))
    load = F.array(size() / 1000.0, key() % 10 / 1000.0)
    bundle = parts(spark, sf_dir).select(text_of(key()).alias("rsid"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), (size() / 50.0).alias("mean"), F.when(size() % 7 == 0, 0.0).otherwise(0.5).alias("sd"), load.alias("load"))
    out = ancestry.infer(calls, bundle, {"P": (0, 0), "Q": (5, 1), "R": (-5, 1)}, least=0.05, margin=2.0)
    return out.select("sample_id", F.round("coverage", 6).alias("coverage"), "nearest", F.round("distance", 5).alias("distance"), "verdict", F.size("fractions").alias("n_fractions"))


RESAMPLES = 20
DRAWN = " + ".join(f"(u >= {d})::INT" for d in vectors.DRAWS)


@query(f"""
WITH c AS (SELECT l_suppkey % 40 AS sample_id, l_partkey AS k, min(CASE l_orderkey % 4 WHEN 0 THEN 'AA' WHEN 1 THEN 'AG' WHEN 2 THEN 'GG' ELSE '--' END) AS g FROM lineitem GROUP BY 1, 2),
b AS (SELECT p_partkey AS k, p_size / 50.0 AS mean, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE 0.5 END AS sd, p_size / 1000.0 AS l1, (p_partkey % 10) / 1000.0 AS l2 FROM part),
u AS (SELECT k, r, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(md5(k || ':' || r), 1, 8), ''), lambda x: instr('0123456789abcdef', x) - 1)), lambda x, y: x * 16 + y) AS u FROM b, range({RESAMPLES}) t(r)),
w AS (SELECT k, r, {DRAWN} AS w FROM u), t AS (SELECT r, count(*) / sum(w) AS scale FROM w GROUP BY r),
d AS (SELECT sample_id, k, CASE WHEN sd > 0 THEN ((g[1] = 'G')::INT + (g[2] = 'G')::INT - mean) / sd ELSE 0 END AS z, l1, l2 FROM c JOIN b USING (k) WHERE g <> '--'),
p AS (SELECT sample_id, sum(z * l1) AS x, sum(z * l2) AS y, count(*) / (SELECT count(*) FROM b) AS coverage FROM d GROUP BY 1),
f AS (SELECT *, greatest(0, least(1, (x * 5 + y) / 26)) AS e, x ** 2 + y ** 2 AS da, (x - 5) ** 2 + (y - 1) ** 2 AS de FROM p),
q AS (SELECT sample_id, r, sum(w * z * l1) * any_value(scale) AS x, sum(w * z * l2) * any_value(scale) AS y FROM d JOIN w USING (k) JOIN t USING (r) GROUP BY 1, 2),
i AS (SELECT sample_id, round(quantile_cont(e, 0.025), 4) AS low, round(quantile_cont(e, 0.975), 4) AS high FROM (SELECT sample_id, greatest(0, least(1, (x * 5 + y) / 26)) AS e FROM q) GROUP BY 1),
n AS (SELECT sample_id, CASE WHEN vec_id % 3 = 0 THEN 'AFR' ELSE 'EUR' END AS label, row_number() OVER (PARTITION BY sample_id ORDER BY (x - 20 * embedding[1]::DOUBLE) ** 2 + (y - 2 * embedding[2]::DOUBLE) ** 2, vec_id) AS n FROM p, embeddings),
v AS (SELECT sample_id, round(count(*) FILTER (label = 'EUR') / 15, 4) AS knn FROM n WHERE n <= 15 GROUP BY 1)
SELECT sample_id, round(1 - coverage, 4) AS missing_rate, round(e, 4) AS eur, low, high, knn, round(greatest(0, least(1, ((1 - e4) * (1 - knn) + e4 * knn) / (sqrt((1 - e4) ** 2 + e4 ** 2) * sqrt((1 - knn) ** 2 + knn ** 2)))), 4) AS confidence,
  CASE WHEN coverage < 0.05 OR sqrt(greatest(da, de)) / sqrt(least(da, de)) < 2 THEN 'gnomad_af_global' WHEN da <= de THEN 'gnomad_af_afr' ELSE 'gnomad_af_eur' END AS frequency_column
FROM (SELECT *, round(e, 4) AS e4 FROM f) JOIN i USING (sample_id) JOIN v USING (sample_id)
""")
def ancestry_bounds(spark, sf_dir):
    """Fractions with bounds by resampled markers, a neighbour vote over a reference, agreement of both and the frequency column."""
    code = F.col("l_orderkey") % 4
    g = F.when(code == 0, "AA").when(code == 1, "AG").when(code == 2, "GG").otherwise("--")
    calls = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") % 40).alias("sample_id"), text_of(F.col("l_partkey")).alias("rsid"), g.alias("genotype"))
    load = F.array(size() / 1000.0, key() % 10 / 1000.0)
    bundle = parts(spark, sf_dir).select(text_of(key()).alias("rsid"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), (size() / 50.0).alias("mean"), F.when(size() % 7 == 0, 0.0).otherwise(0.5).alias("sd"), load.alias("load"))
    at = lambda i, by: F.get("embedding", F.lit(i)).cast("double") * by
    reference = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("ref_id"), F.array(at(0, 20), at(1, 2)).alias("point"), F.when(F.col("vec_id") % 3 == 0, "AFR").otherwise("EUR").alias("label"))
    out = ancestry.infer(calls, bundle, {"AFR": (0, 0), "EUR": (5, 1)}, least=0.05, margin=2.0, resamples=RESAMPLES, reference=reference)
    eur = lambda c: F.coalesce(F.try_element_at(c, F.lit("EUR")), F.lit(0.0))
    return out.select("sample_id", "missing_rate", eur("fractions").alias("eur"), eur("low").alias("low"), eur("high").alias("high"), eur("knn_fractions").alias("knn"), "confidence", "frequency_column")


@query("""
WITH t AS (SELECT p_partkey, p_type AS trait, CASE p_size % 3 WHEN 0 THEN 'XX' WHEN 1 THEN 'XY' END AS sex, p_retailprice AS score FROM part)
SELECT p_partkey, trait, CASE WHEN trait = 'PROMO' AND sex IS DISTINCT FROM 'XX' THEN 'XX' WHEN trait = 'ECONOMY' AND sex IS DISTINCT FROM 'XY' THEN 'XY' END AS gate,
  CASE WHEN (trait = 'PROMO' AND sex IS DISTINCT FROM 'XX') OR (trait = 'ECONOMY' AND sex IS DISTINCT FROM 'XY') THEN NULL ELSE score END AS score FROM t
""")
def sex_gated_scores(spark, sf_dir):
    """Scores of sex-specific traits are shown for the sex they are for only."""
    sex = F.when(size() % 3 == 0, "XX").when(size() % 3 == 1, "XY")
    rows = parts(spark, sf_dir).select("p_partkey", F.col("p_type").alias("trait"), sex.alias("sex"), F.col("p_retailprice").alias("score"))
    return scores.sex_gated(rows, "trait", F.col("sex"), {"PROMO": "XX", "ECONOMY": "XY"}, ["score"]).select("p_partkey", "trait", "gate", "score")
