"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

Genotype-like columns are made from keys by arithmetic, so that both engines see the same invented calls; they stand for
nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions import genotype as G
from loomframe.functions import scalar as S
from loomframe.operators import callers, cohort, facets, intervals, lookup, merge, paging, panels, rules, scores, sequence, vectors
from loomframe.plans import annotate as enrich
from loomframe.plans import console
from loomframe.sources import sinks, text
from loomframe.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RANKS = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}
RANK_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 ELSE 99 END"


# --- enrichment ---------------------------------------------------------------------------------------------------

ANNOTATE_TREE = {
    "combinator": "and",
    "rules": [
        {"field": "l_quantity", "operator": ">", "value": "10"},
        {"combinator": "or", "rules": [{"field": "l_returnflag", "operator": "in", "value": ["A", "R"]}, {"field": "l_discount", "operator": "between", "value": [0.02, 0.06]}]},
        {"combinator": "or", "not": True, "rules": [{"field": "l_linestatus", "operator": "=", "value": "O"}, {"field": "l_tax", "operator": "<", "value": 0.01}]},
    ],
}


@query("""
WITH l AS (SELECT * FROM lineitem WHERE l_quantity > 10 AND (l_returnflag IN ('A', 'R') OR l_discount BETWEEN 0.02 AND 0.06) AND NOT (l_linestatus = 'O' OR l_tax < 0.01)),
e AS (SELECT l.*, p_type, CASE WHEN s_acctbal > 0 THEN s_nationkey END AS nation, p_partkey IS NOT NULL AS has_p, coalesce(s_acctbal > 0, false) AS has_s
  FROM l LEFT JOIN part ON l_partkey = p_partkey AND p_size <= 25 LEFT JOIN supplier ON l_suppkey = s_suppkey)
SELECT coalesce(p_type, 'unknown') AS part_type, has_p::INT + 2 * has_s::INT AS coverage, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS quantity FROM e GROUP BY 1, 2
""")
def annotate(spark, sf_dir):
    """Flagship: rule-tree filter, two enrichment joins, coverage mask, facet counts."""
    rows = rules.filter_tree(read(spark, sf_dir, "lineitem"), ANNOTATE_TREE)
    part = read(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    supplier = read(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = lookup.exact(lookup.exact(rows, part, ["l_partkey"], ["p_type"]), supplier, ["l_suppkey"], ["s_nationkey"])
    mask = S.mask_of({1: F.col("p_type").isNotNull(), 2: F.col("s_nationkey").isNotNull()})
    return rows.groupBy(F.coalesce("p_type", F.lit("unknown")).alias("part_type"), mask.alias("coverage")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query()
def annotate_calls(spark, sf_dir):
    """The whole enrichment pipeline over four invented calls an order (600,000 at scale 0.1), with all seven sources; counts by coverage."""
    letter = lambda c: F.substring(F.lit("ACGT"), (c % 4 + 1).cast("int"), F.lit(1))
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("l_partkey"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("i"))
    k = F.col("o_orderkey") * 4 + F.col("i")
    share = lambda m: (k * 7919 % m) / (m * 10)
    base = o.select(k.alias("k"), "l_partkey", (k % 97).alias("l_suppkey"), share(101).alias("l_discount"), share(89).alias("l_tax"), (k % 50).cast("double").alias("l_quantity"))
    site = [F.concat(F.lit("rs"), "k").alias("rsid"), (F.col("l_suppkey") % 22 + 1).cast("string").alias("chrom"), F.col("k").alias("pos")]
    ref, alt = letter(F.col("k")).alias("ref"), letter(F.col("k") + 1 + F.col("l_partkey") % 3).alias("alt")
    calls = base.select(*site, F.concat(letter(F.col("k")), letter(F.col("k") + F.col("l_partkey") % 2)).alias("genotype"))
    gene = F.concat(F.lit("G"), F.col("l_partkey") % 500).alias("gene_symbol")
    term = F.when(F.col("k") % 3 == 0, "missense_variant").when(F.col("k") % 3 == 1, "intron_variant").otherwise("stop_gained&splice_region_variant")
    none = F.lit(None).cast("string")
    sources = enrich.Sources(
        merges=base.filter("k % 50 = 0").select(F.concat(F.lit("rs"), "k").alias("old_rsid"), F.concat(F.lit("rs"), F.col("k") + 1).alias("current_rsid")),
        vep=base.filter("k % 10 < 8").select(*site, ref, alt, gene, F.concat(F.lit("t"), "k").alias("transcript_id"), term.alias("consequence"), none.alias("hgvs_coding"), none.alias("hgvs_protein"), (F.col("k") % 2).cast("int").alias("mane_select")),
        clinvar=base.filter("k % 10 < 3").select(*site, ref, alt, F.when(F.col("k") % 4 == 0, "Pathogenic").otherwise("Uncertain significance").alias("significance"), (F.col("k") % 5).cast("int").alias("review_stars"), F.concat(F.lit("V"), "k").alias("accession"), none.alias("conditions"), gene),
        gnomad=base.filter("k % 10 < 7").select(*site, ref, alt, F.col("l_discount").alias("af_global"), F.col("l_tax").alias("af_afr"), F.lit(0).cast("long").alias("homozygous_count")),
        dbnsfp=base.filter("k % 10 < 5").select(*site, ref, alt, F.col("l_quantity").alias("cadd_phred"), F.col("l_tax").alias("sift_score"), F.col("l_discount").alias("revel")),
        alphamissense=base.filter("k % 10 < 4").select(*site[1:], ref, alt, F.col("l_tax").alias("am_pathogenicity"), F.lit("x").alias("am_class")),
        gene_phenotype=spark.range(300).select(F.concat(F.lit("G"), "id").alias("gene_symbol"), F.concat(F.lit("d"), "id").alias("disease_name"), F.concat(F.lit("M"), "id").alias("disease_id"), none.alias("hpo_terms"), F.lit("AD").alias("inheritance")),
    )
    wide = enrich.annotate(calls, sources)
    return wide.groupBy("annotation_coverage", "zygosity", "evidence_conflict").agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem)
SELECT p_partkey, p_brand, l_orderkey AS best_order, l_extendedprice AS best_price FROM part LEFT JOIN b ON p_partkey = l_partkey AND r = 1
""")
def best_candidate(spark, sf_dir):
    """Top-1 enrichment by key."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "l_extendedprice", F.col("l_orderkey").alias("best_order"), F.col("l_extendedprice").alias("best_price"))
    out = lookup.join_best(read(spark, sf_dir, "part"), li, ["p_partkey"], [-F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], ["best_order", "best_price"])
    return out.select("p_partkey", "p_brand", "best_order", "best_price")


@query("""
WITH c AS (SELECT p.p_partkey, l_orderkey, l_quantity, row_number() OVER (PARTITION BY p.p_partkey ORDER BY (coalesce(l_quantity >= p_size, false))::INT DESC, l_orderkey, l_linenumber) AS r, coalesce(l_quantity >= p_size, false) AS ok
  FROM part p LEFT JOIN lineitem ON p.p_partkey = l_partkey)
SELECT p_partkey, CASE WHEN ok THEN l_orderkey END AS order_key, CASE WHEN ok THEN l_quantity END AS quantity FROM c WHERE r = 1
""")
def best_candidate_residual(spark, sf_dir):
    """Top-1 among candidates that meet a condition on the row."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("order_key"), "l_linenumber", F.col("l_quantity").alias("quantity"))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    return lookup.join_best(part, li, ["p_partkey"], [F.col("order_key"), F.col("l_linenumber")], ["order_key", "quantity"], F.col("_r.quantity") >= F.col("p_size")).select("p_partkey", "order_key", "quantity")


@query("""
WITH q AS (SELECT o_orderkey, o_custkey + (o_orderkey % 3 = 0)::INT * 1000000 AS ck, o_orderkey % 25 AS nk FROM orders),
k AS (SELECT c_custkey, max(c_name) AS c_name FROM customer GROUP BY 1),
f AS (SELECT c_nationkey, CASE WHEN min(c_mktsegment) = max(c_mktsegment) THEN min_by(c_name, c_custkey) END AS c_name FROM customer WHERE c_custkey % 50 = 0 GROUP BY 1)
SELECT o_orderkey, coalesce(k.c_name, f.c_name) AS c_name, CASE WHEN k.c_custkey IS NOT NULL THEN 'key' WHEN f.c_name IS NOT NULL THEN 'fallback' END AS matched_by
FROM q LEFT JOIN k ON ck = k.c_custkey LEFT JOIN f ON nk = f.c_nationkey
""")
def key_then_fallback(spark, sf_dir):
    """Lookup by key, else by a place at which candidates agree."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    q = o.select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 1000000).otherwise(0)).alias("c_custkey"), (F.col("o_orderkey") % 25).alias("nk"))
    # a row of the reference table has a place only if its key is divisible by 50
    table = c.select("c_custkey", F.when(F.col("c_custkey") % 50 == 0, F.col("c_nationkey").cast("long")).alias("nk"), "c_mktsegment", "c_name")
    return lookup.key_then_fallback(q, table, ["c_custkey"], ["nk"], [F.col("c_custkey")], ["c_name"], F.col("c_mktsegment")).select("o_orderkey", "c_name", "matched_by")


@query("""
WITH c AS (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem WHERE l_linenumber = 1),
j AS (SELECT p_partkey, l_returnflag AS v, l_returnflag IS NOT NULL AS s, coalesce(l_returnflag = CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END, false) AS hit FROM part LEFT JOIN c ON p_partkey = l_partkey),
g AS (SELECT p_partkey, count(*) FILTER (s) AS n, count(*) FILTER (hit) AS h, min(v) AS a, min(v) FILTER (hit) AS b FROM j GROUP BY 1)
SELECT p_partkey, CASE WHEN n = 1 THEN a WHEN h = 1 THEN b END AS l_returnflag, CASE WHEN n = 0 THEN 'absent' WHEN n = 1 OR h = 1 THEN 'matched' ELSE 'allele_ambiguous' END AS match_status FROM g
""")
def strict_unique(spark, sf_dir):
    """Lookup that only takes the one candidate left."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    c = read(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    want = F.when(F.col("p_size") % 3 == 0, "A").when(F.col("p_size") % 3 == 1, "N").otherwise("R")
    return lookup.strict_unique(part, c, ["p_partkey"], ["l_returnflag"], F.col("l_returnflag") == want, ["l_returnflag"], "p_partkey").drop("p_size")


@query("""
WITH a AS (SELECT 'rs' || p_partkey AS o, max('rs' || (p_partkey + 1)) AS n FROM part WHERE p_size % 5 = 0 GROUP BY 1),
k AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'i' || p_partkey WHEN p_partkey % 11 = 0 THEN 'x' || p_partkey ELSE 'rs' || p_partkey END AS name FROM part)
SELECT p_partkey, name, coalesce(n, name) AS resolved, CASE WHEN n IS NOT NULL THEN 'merged' WHEN regexp_full_match(name, 'rs[0-9]+') THEN 'valid' WHEN regexp_full_match(name, 'i[0-9]+') THEN 'i_prefix' ELSE 'invalid' END AS alias_status FROM k LEFT JOIN a ON name = o
""")
def resolve_alias(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    names = p.select("p_partkey", F.when(k % 7 == 0, F.concat(F.lit("i"), k)).when(k % 11 == 0, F.concat(F.lit("x"), k)).otherwise(F.concat(F.lit("rs"), k)).alias("name"))
    old = p.filter("p_size % 5 = 0").select(F.concat(F.lit("rs"), k).alias("old"), F.concat(F.lit("rs"), k + 1).alias("new"))
    return lookup.resolve_alias(names, old, "name", "old", "new")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(o_totalprice) AS total FROM lineitem LEFT JOIN (SELECT o_orderkey, o_custkey % 7 + 1 AS n, o_totalprice FROM orders) ON l_orderkey = o_orderkey AND l_linenumber = n GROUP BY ALL")
def exact_keys(spark, sf_dir):
    """Equi-join on several keys without fallback."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 7 + 1).cast("int").alias("l_linenumber"), F.col("o_totalprice").alias("total"))
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return lookup.exact(li, o, ["l_orderkey", "l_linenumber"], ["total"])


@query("SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice, o_orderkey), '') AS order_list FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def list_join(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").cast("string").alias("k"), "o_totalprice", "o_orderkey")
    out = lookup.list_join(read(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"], ["k"], "l", [F.col("o_totalprice"), F.col("o_orderkey")])
    return out.select("c_custkey", F.array_join(F.transform("l", lambda x: x["k"]), ",").alias("order_list"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_acctbal <= 5000)::INT, s_suppkey) AS r FROM supplier)
SELECT n_nationkey, s_suppkey, s_acctbal FROM nation LEFT JOIN r ON n_nationkey = s_nationkey AND r = 1
""")
def primary_pick(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return lookup.primary(read(spark, sf_dir, "nation").select("n_nationkey"), s, ["n_nationkey"], F.col("s_acctbal") > 5000, [F.col("s_suppkey")], ["s_suppkey", "s_acctbal"])


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_orderstatus <> 'O' THEN o_orderstatus ELSE o_orderpriority END AS label,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 5 END AS coverage FROM orders
""")
def priority_merge(spark, sf_dir):
    """Later sources win; a source that disagrees is cleared with its bit."""
    o = read(spark, sf_dir, "orders").withColumns({"a": F.when(F.col("o_totalprice") > 300000, "big"), "b": F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")), "coverage": F.lit(5), "price": F.col("o_totalprice")})
    o = lookup.merged(o, {"label": ["a", "b", "o_orderpriority"]})
    return lookup.cleared(o, F.col("o_orderstatus") == "P", ["price"], "coverage", 4).select("o_orderkey", "label", "price", "coverage")


@query("SELECT c_custkey, 'with' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) UNION ALL SELECT c_custkey, 'without' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def semi_and_anti(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    a = lookup.semi(c, o.filter("o_totalprice > 400000"), ["c_custkey"]).withColumn("kind", F.lit("with"))
    return a.unionByName(lookup.semi(c, o, ["c_custkey"], keep=False).withColumn("kind", F.lit("without")))


@query("SELECT count(*) FILTER (o_orderkey % 10 = 0)::BIGINT AS added, count(*) FILTER (o_orderkey % 10 <> 0 AND o_custkey % 3 = 0 AND o_orderstatus <> 'X')::BIGINT AS reclassified FROM orders")
def reclassified(spark, sf_dir):
    new = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("v"), "o_custkey")
    old = new.filter("o_orderkey % 10 <> 0").withColumn("v", F.when(F.col("o_custkey") % 3 == 0, "X").otherwise(F.col("v")))
    return lookup.reclassified(old, new, "o_orderkey", "v")


# --- filters ------------------------------------------------------------------------------------------------------

@query("SELECT p_partkey, p_name FROM part WHERE (p_name ILIKE '%RED%' OR p_name ILIKE 'sm_ll%' OR p_name ILIKE '%bolt') AND NOT (p_type = 'PROMO' AND p_size >= 40) AND p_brand NOT IN ('Brand#1', 'Brand#2')")
def rule_tree(spark, sf_dir):
    """All kinds of text rules, a negated group, a disabled rule and an empty group."""
    tree = {"combinator": "and", "rules": [
        {"combinator": "or", "rules": [{"field": "p_name", "operator": "contains", "value": "RED"}, {"field": "p_name", "operator": "beginsWith", "value": "sm_ll"}, {"field": "p_name", "operator": "endsWith", "value": "bolt"}]},
        {"combinator": "and", "not": True, "rules": [{"field": "p_type", "operator": "=", "value": "PROMO"}, {"field": "p_size", "operator": ">=", "value": "40"}]},
        {"field": "p_brand", "operator": "notIn", "value": ["Brand#1", "Brand#2"]}, {"field": "p_size", "operator": "in", "value": [], "disabled": True}, {"combinator": "or", "rules": []},
    ]}
    return rules.filter_tree(read(spark, sf_dir, "part"), tree).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 77")
def pair_filter(spark, sf_dir):
    return rules.filter_pairs(read(spark, sf_dir, "orders"), "status:F,cust:77,bad,nokey:1,priority:WRONG", {"status": "o_orderstatus", "cust": "o_custkey", "priority": "o_orderpriority"}, {"priority": list(RANKS)}).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000 AND o_totalprice <= 200000 AND lower(o_orderpriority) LIKE '%specified%' AND lower(o_orderpriority) NOT LIKE '%conflicting%'")
def named_filter(spark, sf_dir):
    return rules.filter_named(read(spark, sf_dir, "orders"), {"o_orderstatus": "O", "o_custkey": None}, {"o_totalprice": 100000.0}, {"o_totalprice": 200000.0}, ("o_orderpriority", "Specified")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE starts_with(lower(p_name), 'blue') OR starts_with(lower(p_brand), 'blue') OR starts_with(lower(p_type), 'blue')")
def prefix_search(spark, sf_dir):
    return rules.prefix(read(spark, sf_dir, "part"), "BLUE", ["p_name", "p_brand", "p_type"]).select("p_partkey")


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer WHERE CASE WHEN c_nationkey < 5 THEN NULL ELSE c_acctbal END > 9000")
def masked_filter(spark, sf_dir):
    c = rules.masked(read(spark, sf_dir, "customer"), F.col("c_nationkey") < 5, ["c_acctbal"])
    return rules.filter_tree(c, {"rules": [{"field": "c_acctbal", "operator": ">", "value": 9000}]}).select("c_custkey", "c_acctbal")


@query("SELECT CASE WHEN o_totalprice < 0.8 * 100000 THEN 'low_price' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'pass' END AS reason, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def quality_gate(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.groupBy(rules.gate([("low_price", F.col("o_totalprice") >= 80000), ("pending", F.col("o_orderstatus") != "P")]).alias("reason")).agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT p_partkey, p_type || CASE p_size % 4 WHEN 0 THEN '|other' WHEN 1 THEN ', low penetrance' ELSE '' END AS s FROM part) SELECT p_partkey FROM t WHERE (s = 'PROMO' OR starts_with(s, 'PROMO|') OR starts_with(s, 'PROMO,')) AND s NOT ILIKE '%low penetrance%' AND s NOT ILIKE '%risk allele%'")
def compound_label(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    s = F.concat("p_type", F.when(F.col("p_size") % 4 == 0, "|other").when(F.col("p_size") % 4 == 1, ", low penetrance").otherwise(""))
    return p.filter(rules.primary_term(s, "PROMO")).select("p_partkey")


@query("SELECT n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name ORDER BY n DESC, n_name")
def sql_console(spark, sf_dir):
    """Read-only SQL over allowed views."""
    for t in ("customer", "nation"):
        read(spark, sf_dir, t).createOrReplaceTempView(t)
    sql = "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name ORDER BY n DESC, n_name"
    console.check_read_only(spark, sql, ["customer", "nation"])
    return spark.sql(sql)


@query("SELECT p_partkey, p_brand FROM part WHERE p_size BETWEEN 10 AND 20")
def saved_rules_and_preset(spark, sf_dir):
    saved = console.Registry()
    saved.add("mid", {"rules": [{"field": "p_size", "operator": "between", "value": [10, 20]}]})
    columns = console.Registry('{"short": ["p_partkey", "p_brand"]}')
    return console.preset(console.saved_filter(read(spark, sf_dir, "part"), saved, "mid"), columns, "short")


@query("SELECT * FROM (VALUES ('s_suppkey', 'integer'), ('s_name', 'text'), ('s_nationkey', 'integer'), ('s_acctbal', 'number')) t(name, type)")
def query_fields(spark, sf_dir):
    return console.field_types(read(spark, sf_dir, "supplier"))


# --- pages --------------------------------------------------------------------------------------------------------

@query(f"SELECT o_orderkey, o_orderdate, {RANK_SQL} AS rank FROM orders WHERE ({RANK_SQL}, o_orderdate, o_orderkey) > (2, TIMESTAMP '1996-06-01', 100) ORDER BY {RANK_SQL}, o_orderdate, o_orderkey LIMIT 51")
def keyset_page(spark, sf_dir):
    """The page behind a cursor, and one row more."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", S.ranked(F.col("o_orderpriority"), RANKS, 99).alias("rank"))
    rows, _ = console.rule_query(o, {"rules": []}, [F.col("rank"), F.col("o_orderdate"), F.col("o_orderkey")], 50, [2, F.lit("1996-06-01").cast("timestamp"), 100])
    return rows


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def ranked_page(spark, sf_dir):
    return paging.ranked_page(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20, 40)


@query("SELECT o_orderkey, (SELECT count(*)::BIGINT FROM orders WHERE o_orderstatus = 'F') AS total, (SELECT count(*) > 2000 FROM orders WHERE o_orderstatus = 'F') AS truncated FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 2000")
def capped_scan(spark, sf_dir):
    """The first rows of a scan with their total; the cap is the feature."""
    rows, total = paging.capped(read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), [F.col("o_orderkey")], 2000)
    return rows.select("o_orderkey").join(F.broadcast(total), F.lit(True))


# --- counts -------------------------------------------------------------------------------------------------------

@query("SELECT coalesce(CASE WHEN p_size > 5 THEN p_type END, 'unknown') AS kind, count(*)::BIGINT AS n FROM part GROUP BY 1")
def facet_counts(spark, sf_dir):
    return facets.facet(read(spark, sf_dir, "part").withColumn("kind", F.when(F.col("p_size") > 5, F.col("p_type"))), "kind")


@query("SELECT l_returnflag, (floor(l_extendedprice / 10000) * 10000)::BIGINT AS bin, count(*) FILTER (l_linestatus = 'O')::BIGINT AS \"O\", count(*) FILTER (l_linestatus = 'F')::BIGINT AS \"F\", count(*)::BIGINT AS total FROM lineitem GROUP BY 1, 2")
def histogram_by_status(spark, sf_dir):
    return facets.histogram(read(spark, sf_dir, "lineitem"), "l_extendedprice", 10000, F.col("l_linestatus"), ["O", "F"], ["l_returnflag"])


@query("""
WITH s AS (SELECT l_returnflag, CASE WHEN l_quantity < 5 THEN 'nocall' WHEN l_tax > 0.04 THEN 'het' ELSE 'hom' END AS s, l_linenumber < 4 AS i FROM lineitem),
g AS (SELECT l_returnflag, false AS is_total, count(*) AS total, count(*) FILTER (s = 'hom') AS hom, count(*) FILTER (s = 'het') AS het, count(*) FILTER (s = 'nocall') AS nocall, count(*) FILTER (s = 'het') AS h, count(*) FILTER (s <> 'nocall') AS c FROM s GROUP BY 1
  UNION ALL SELECT NULL, true, count(*), count(*) FILTER (s = 'hom'), count(*) FILTER (s = 'het'), count(*) FILTER (s = 'nocall'), count(*) FILTER (s = 'het' AND i), count(*) FILTER (s <> 'nocall' AND i) FROM s)
SELECT l_returnflag, is_total, total::BIGINT AS total, hom::BIGINT AS hom, het::BIGINT AS het, nocall::BIGINT AS nocall, round((het + hom) / total, 6) AS call_rate, round(h / c, 6) AS het_rate FROM g
""")
def two_level_rates(spark, sf_dir):
    state = F.when(F.col("l_quantity") < 5, "nocall").when(F.col("l_tax") > 0.04, "het").otherwise("hom")
    return facets.rates(read(spark, sf_dir, "lineitem"), "l_returnflag", state, {"hom": ["hom"], "het": ["het"], "nocall": ["nocall"]}, F.col("l_linenumber") < 4)


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def zero_counts(spark, sf_dir):
    return facets.with_zero_counts(read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


@query("""
WITH f AS (SELECT c_mktsegment AS module, c_custkey % 4 + 1 AS level, c_name, c_custkey FROM customer WHERE c_acctbal > 0)
SELECT module, count(*)::BIGINT AS n, max(level) AS max_level, count(*) FILTER (level = 1)::BIGINT AS level_1, count(*) FILTER (level = 2)::BIGINT AS level_2, count(*) FILTER (level = 3)::BIGINT AS level_3, count(*) FILTER (level = 4)::BIGINT AS level_4, min_by(c_name, c_custkey) AS first_text FROM f GROUP BY 1
""")
def module_summary(spark, sf_dir):
    f = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_mktsegment").alias("module"), (F.col("c_custkey") % 4 + 1).alias("level"), "c_name", "c_custkey")
    return facets.module_summary(f, "module", "level", "c_name", "c_custkey")


@query("""
WITH b AS (SELECT b FROM (VALUES ('S1'), ('S2'), ('both'), ('none')) t(b)),
g AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 'S1' WHEN 1 THEN 'S2' ELSE 'both' END AS s, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) FILTER (o_orderstatus = 'P') AS f, count(*) FILTER (o_totalprice > 490000 AND o_orderstatus = 'O') AS a, count(*) AS n FROM orders GROUP BY 1)
SELECT b AS source, coalesce(k, 0)::BIGINT AS key_hits, coalesce(f, 0)::BIGINT AS fallback_hits, coalesce(a, 0)::BIGINT AS ambiguous, coalesce(n - k - f - a, 0)::BIGINT AS misses FROM b LEFT JOIN g ON b = s
""")
def source_hits(spark, sf_dir):
    s = F.when(F.col("o_custkey") % 3 == 0, "S1").when(F.col("o_custkey") % 3 == 1, "S2").otherwise("both")
    status = F.col("o_orderstatus")
    return facets.source_hits(read(spark, sf_dir, "orders"), s, status == "F", status == "P", (F.col("o_totalprice") > 490000) & (status == "O"), ["S1", "S2", "both", "none"])


@query("SELECT p_type, count(*) FILTER (p_size < 10)::BIGINT AS carried, count(*) FILTER (p_size BETWEEN 10 AND 19)::BIGINT AS hom_ref, count(*) FILTER (p_size >= 20)::BIGINT AS undetermined FROM part GROUP BY 1")
def cross_counts(spark, sf_dir):
    c = F.when(F.col("p_size") < 10, "carried").when(F.col("p_size") < 20, "hom_ref")
    return facets.cross_counts(read(spark, sf_dir, "part"), "p_type", c, ["carried", "hom_ref"], "undetermined")


@query("WITH d AS (SELECT DISTINCT user_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM events), g AS (SELECT user_id, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS gap FROM d) SELECT user_id, count(*)::BIGINT AS n, round(median(gap))::BIGINT AS median_gap FROM g GROUP BY 1")
def median_gap(spark, sf_dir):
    return facets.median_gap(read(spark, sf_dir, "events").select("user_id", S.since_epoch(F.col("ts")).alias("s")), "user_id", "s")


@query("SELECT (count(DISTINCT CASE WHEN o_custkey % 2 = 0 THEN o_custkey END) + count(*) FILTER (o_custkey % 2 <> 0))::BIGINT AS n FROM orders WHERE o_totalprice > 250000")
def distinct_or_each(spark, sf_dir):
    return facets.distinct_or_each(read(spark, sf_dir, "orders").filter("o_totalprice > 250000"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(""))


# --- intervals ----------------------------------------------------------------------------------------------------

WINDOWS_SQL = "SELECT o_orderkey AS w, o_custkey % 150 AS g, 1704067200 + (o_orderkey * 7919) % 2592000 AS s, 1704067200 + (o_orderkey * 7919) % 2592000 + 600 + o_custkey % 20000 AS e FROM orders"


def _windows(spark, sf_dir, group=None):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = 1704067200 + (k * 7919) % 2592000
    return read(spark, sf_dir, "orders").select(k.alias("w"), (c % 150 if group is None else group).alias("g"), s.alias("s"), (s + 600 + c % 20000).alias("e"))


def _points(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("g"), S.since_epoch(F.col("ts")).alias("t"))


@query(f"WITH w AS ({WINDOWS_SQL}) SELECT event_id, w FROM events JOIN w ON user_id = g AND epoch(date_trunc('second', ts))::BIGINT > s AND epoch(date_trunc('second', ts))::BIGINT <= e")
def points_in_intervals(spark, sf_dir):
    return intervals.points_in(_points(spark, sf_dir), _windows(spark, sf_dir), "g", "t", "s", "e", 7200).select("event_id", "w")


@query(f"WITH w AS ({WINDOWS_SQL.replace('o_custkey % 150 AS g', 'o_custkey AS g')}) SELECT a.w, b.w AS b_w FROM w a JOIN w b ON a.g = b.g AND a.w < b.w AND a.s <= b.e AND b.s <= a.e")
def interval_overlaps(spark, sf_dir):
    w = _windows(spark, sf_dir, F.col("o_custkey"))
    return intervals.overlaps(w, w, "g", "s", "e", 7200).filter("w < b_w").select("w", "b_w")


MERGED_SQL = f"WITH w AS ({WINDOWS_SQL}), m AS (SELECT *, max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM w), k AS (SELECT *, sum((r IS NULL OR s > r)::INT) OVER (PARTITION BY g ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m), merged AS (SELECT g, min(s) AS s, max(e) AS e, count(*)::BIGINT AS n FROM k GROUP BY g, i)"


@query(MERGED_SQL + " SELECT * FROM merged")
def merged_intervals(spark, sf_dir):
    return intervals.merge(_windows(spark, sf_dir), "g", "s", "e")


@query(MERGED_SQL + " SELECT event_id FROM events WHERE EXISTS (SELECT 1 FROM merged WHERE user_id = g AND epoch(date_trunc('second', ts))::BIGINT - 1 < e AND s < epoch(date_trunc('second', ts))::BIGINT - 1 + 3)")
def interval_membership(spark, sf_dir):
    return intervals.within(_points(spark, sf_dir), _windows(spark, sf_dir), "g", "t", F.lit(3), "s", "e", 7200).select("event_id")


@query(f"WITH w AS ({WINDOWS_SQL}) SELECT event_id, min_by(s, w) AS s FROM events JOIN w ON user_id = g AND epoch(date_trunc('second', ts))::BIGINT > s AND epoch(date_trunc('second', ts))::BIGINT <= e GROUP BY 1")
def first_overlay(spark, sf_dir):
    w = _windows(spark, sf_dir).withColumn("v", F.col("s"))
    return intervals.overlay(_points(spark, sf_dir), w, "event_id", "g", "t", "s", "e", "w", ["v"], 7200).withColumnRenamed("v", "s")


@query("""
WITH p AS (SELECT o_orderkey, o_custkey % 5 AS c, (o_orderkey * 37) % 1000000 + 1 AS pos FROM orders),
b AS (SELECT i AS block, i % 5 AS c, i * 20000 AS ts, i * 20000 + 15000 AS te, CASE WHEN i % 2 = 0 THEN '+' ELSE '-' END AS st, i * 1000 AS qs FROM range(50) t(i))
SELECT o_orderkey, CASE WHEN b.block IS NULL THEN NULL WHEN st = '+' THEN qs + pos - 1 - ts + 1 ELSE 5000000 - (qs + pos - 1 - ts) END AS new_pos FROM p LEFT JOIN b ON p.c = b.c AND pos - 1 >= ts AND pos - 1 < te
""")
def lift_positions(spark, sf_dir):
    p = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).cast("string").alias("chrom"), ((F.col("o_orderkey") * 37) % 1000000 + 1).alias("pos"))
    i = F.col("id")
    chain = spark.range(50).select(i.alias("block"), (i % 5).cast("string").alias("t_chrom"), (i * 20000).alias("t_start"), (i * 20000 + 15000).alias("t_end"), F.lit("q").alias("q_chrom"), (i * 1000).alias("q_start"), F.when(i % 2 == 0, "+").otherwise("-").alias("strand"), F.lit(5000000).alias("q_size"))
    return intervals.lift(p, chain, width=100000).select("o_orderkey", F.col("new_pos").cast("long").alias("new_pos"))


# --- merges -------------------------------------------------------------------------------------------------------

SIDES_SQL = """WITH a AS (SELECT o_orderkey AS k, max_by(v, nm) AS v, max(nm) AS nm FROM (SELECT o_orderkey, 'n' || o_orderkey AS nm, CASE WHEN o_custkey % 9 = 0 THEN '--' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 3 <> 0) GROUP BY 1),
b AS (SELECT o_orderkey AS k, max_by(v, nm) AS v, max(nm) AS nm FROM (SELECT o_orderkey, 'n' || (o_orderkey + o_custkey % 2) AS nm, CASE WHEN o_custkey % 7 = 0 THEN '--' WHEN o_custkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 4 <> 0) GROUP BY 1)"""


@query(SIDES_SQL + """
SELECT coalesce(a.k, b.k) AS k, coalesce(a.nm, b.nm) AS nm,
  CASE WHEN b.k IS NULL THEN a.v WHEN a.k IS NULL THEN b.v WHEN a.v <> '--' AND b.v <> '--' AND a.v <> b.v THEN '??' WHEN a.v = '--' THEN b.v ELSE a.v END AS v,
  CASE WHEN b.k IS NULL THEN 'S1' WHEN a.k IS NULL THEN 'S2' WHEN (a.v = '--') <> (b.v = '--') THEN CASE WHEN a.v = '--' THEN 'S2' ELSE 'S1' END ELSE 'both' END AS source,
  CASE WHEN b.k IS NULL OR a.k IS NULL THEN 'unique' WHEN a.v = '--' AND b.v = '--' THEN 'match' WHEN a.v = '--' OR b.v = '--' THEN 'filled_nocall' WHEN a.v = b.v THEN 'match' ELSE 'discordant' END AS concordance,
  CASE WHEN a.v <> '--' AND b.v <> '--' AND a.v <> b.v THEN 'S1=' || a.v || ';S2=' || b.v ELSE '' END AS other_value,
  CASE WHEN a.nm <> b.nm THEN b.nm ELSE '' END AS other_name FROM a FULL JOIN b ON a.k = b.k
""")
def reconcile_samples(spark, sf_dir):
    """Full outer merge of two slices with no-calls, clashes and differing names."""
    o = read(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a = o.filter(k % 3 != 0).select(k.alias("k"), F.concat(F.lit("n"), k).alias("nm"), F.when(c % 9 == 0, "--").otherwise(F.col("o_orderstatus")).alias("v"))
    b = o.filter(k % 4 != 0).select(k.alias("k"), F.concat(F.lit("n"), k + c % 2).alias("nm"), F.when(c % 7 == 0, "--").when(c % 5 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("v"))
    return merge.reconcile(a, b, ["k"], "v", "nm", missing=G.is_no_call(F.col("v"), G.MERGE_NO_CALLS))


@query("""
WITH a AS (SELECT c_mktsegment AS i, c_nationkey % 3 AS m, c_name AS t FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_mktsegment AS i, (c_nationkey + (c_custkey % 11 = 0)::INT) % 3 AS m, c_name AS t FROM customer WHERE c_custkey % 7 <> 0),
an AS (SELECT *, row_number() OVER (PARTITION BY i, m ORDER BY t) AS n FROM a), bn AS (SELECT *, row_number() OVER (PARTITION BY i, m ORDER BY t) AS n FROM b),
x AS (SELECT i, m, t, row_number() OVER (PARTITION BY i ORDER BY t, m) AS n FROM an LEFT JOIN (SELECT i AS bi, m AS bm, count(*) AS c FROM b GROUP BY 1, 2) ON i = bi AND m = bm WHERE n > coalesce(c, 0)),
y AS (SELECT i, m, t, row_number() OVER (PARTITION BY i ORDER BY t, m) AS n FROM bn LEFT JOIN (SELECT i AS ai, m AS am, count(*) AS c FROM a GROUP BY 1, 2) ON i = ai AND m = am WHERE n > coalesce(c, 0))
SELECT CASE WHEN x.i IS NULL THEN 'added' WHEN y.i IS NULL THEN 'removed' ELSE 'changed' END AS state, coalesce(y.i, x.i) AS i, CASE WHEN y.i IS NULL THEN x.m ELSE y.m END AS m, CASE WHEN y.i IS NULL THEN x.t ELSE y.t END AS t, CASE WHEN x.i IS NOT NULL AND y.i IS NOT NULL THEN x.m END AS old_m FROM x FULL JOIN y ON x.i = y.i AND x.n = y.n
""")
def multiset_diff(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    a = c.filter("c_custkey % 5 <> 0").select(F.col("c_mktsegment").alias("i"), (F.col("c_nationkey") % 3).alias("m"), F.col("c_name").alias("t"))
    b = c.filter("c_custkey % 7 <> 0").select(F.col("c_mktsegment").alias("i"), ((F.col("c_nationkey") + (F.col("c_custkey") % 11 == 0).cast("int")) % 3).alias("m"), F.col("c_name").alias("t"))
    return merge.multiset_diff(a, b, ["i"], ["m"], "t")


@query("""
WITH t AS (SELECT s_suppkey, s_name, s_acctbal, 1 AS mask FROM supplier WHERE s_suppkey % 3 <> 0), r AS (SELECT s_suppkey, max(s_name || '!') AS s_name, max(s_acctbal) AS s_acctbal, 4 AS mask FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1)
SELECT coalesce(t.s_suppkey, r.s_suppkey) AS s_suppkey, coalesce(r.s_name, t.s_name) AS s_name, coalesce(t.s_acctbal, r.s_acctbal) AS s_acctbal, coalesce(t.mask, 0) | coalesce(r.mask, 0) AS mask FROM t FULL JOIN r ON t.s_suppkey = r.s_suppkey
""")
def upsert_rows(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = s.filter("s_suppkey % 2 = 0").withColumns({"s_name": F.concat("s_name", F.lit("!")), "mask": F.lit(4)})
    return merge.upsert(s.filter("s_suppkey % 3 <> 0").withColumn("mask", F.lit(1)), new, ["s_suppkey"], ["s_name"], ["mask"])


@query("SELECT l_orderkey, arg_max(l_quantity, l_linenumber) AS last_q, arg_min(l_quantity, l_linenumber) AS first_q FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity) GROUP BY 1")
def first_and_last_wins(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    last = merge.last_wins(li, ["l_orderkey"], "l_linenumber").select("l_orderkey", F.col("q").alias("last_q"))
    return last.join(merge.first_wins(li, ["l_orderkey"], "l_linenumber").select("l_orderkey", F.col("q").alias("first_q")), "l_orderkey")


@query("SELECT c_custkey, 'customer' AS kind FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT o_orderkey, 'order' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def cascade_delete(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    left, kids = merge.cascade_delete(c, {"orders": (o, "o_custkey")}, c.filter("c_nationkey = 3"), "c_custkey")
    return left.select("c_custkey", F.lit("customer").alias("kind")).unionByName(kids["orders"].select(F.col("o_orderkey").alias("c_custkey"), F.lit("order").alias("kind")))


@query("SELECT n_name, r AS recorded_version, c AS current_version FROM (SELECT n_name, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey % 3 END AS r, n_nationkey % 2 AS c FROM nation) WHERE r IS DISTINCT FROM c")
def stale_versions(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    was = n.select("n_name", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey") % 3).alias("v"))
    return merge.stale(was, n.select("n_name", (F.col("n_nationkey") % 2).alias("v")), "n_name", "v")


# --- sequences ----------------------------------------------------------------------------------------------------

@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM g)
SELECT user_id, island::BIGINT AS island, count(*)::BIGINT AS n, min(ts) AS first, max(ts) AS last FROM i GROUP BY 1, 2
""")
def islands(spark, sf_dir):
    return sequence.island_summary(read(spark, sf_dir, "events"), ["user_id"], "ts", 6 * 3600 * 1_000_000, S.since_epoch(F.col("ts"), "MICROSECOND"))


@query("""
WITH e AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS p, event_type = 'error' AS h FROM events),
a AS (SELECT *, row_number() OVER w AS n, p - lag(p) OVER w AS step FROM e WINDOW w AS (PARTITION BY user_id ORDER BY p, h)),
b AS (SELECT *, max(CASE WHEN step IS NULL OR step > 86400 THEN n END) OVER (PARTITION BY user_id ORDER BY n) AS stretch, max(CASE WHEN h THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS het FROM a),
c AS (SELECT *, max(CASE WHEN n = stretch OR h AND n - het < 20 AND het >= stretch THEN n END) OVER (PARTITION BY user_id ORDER BY n) AS run FROM b),
r AS (SELECT user_id, min(p) FILTER (NOT h) AS "start", max(p) FILTER (NOT h) AS "end", count(*) FILTER (NOT h) AS n_hom FROM c GROUP BY user_id, run)
SELECT user_id, "start", "end", printf('%.1f', ("end" - "start") / 1000.0)::DOUBLE AS length_kb, n_hom FROM r WHERE n_hom >= 4 AND "end" - "start" >= 20000
""")
def homozygous_runs(spark, sf_dir):
    """Runs over the events of a user, an error for a heterozygous site."""
    e = read(spark, sf_dir, "events")
    return sequence.homozygous_runs(e.withColumn("pos", S.since_epoch(F.col("ts"))), ["user_id"], "pos", F.col("event_type") == "error", 86400, 20, 1, 20000, 4)


# --- scores -------------------------------------------------------------------------------------------------------

CALLS_SQL = "SELECT l_suppkey % 6 AS sample_id, l_partkey AS k, substr('ACGT', (min(l_quantity)::BIGINT % 2 * 2 + 1), 1) || substr('ACGT', (max(l_linenumber) % 2 * 2 + 1), 1) AS gt FROM lineitem GROUP BY 1, 2"


def _calls(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 6).alias("sample_id"), F.col("l_partkey").alias("k"))
    letter = lambda c: F.substring(F.lit("ACGT"), c, F.lit(1))
    return li.agg(F.concat(letter((F.min("l_quantity").cast("long") % 2 * 2 + 1).cast("int")), letter((F.max("l_linenumber") % 2 * 2 + 1).cast("int"))).alias("gt"))


@query(f"""
WITH c AS ({CALLS_SQL}), p AS (SELECT a.sample_id AS s, b.sample_id AS s2, a.gt AS x, b.gt AS y FROM c a JOIN c b ON a.k = b.k AND a.sample_id < b.sample_id),
g AS (SELECT s, s2, count(*)::BIGINT AS n_shared, count(*) FILTER (x[1] <> x[2])::BIGINT AS het_i, count(*) FILTER (y[1] <> y[2])::BIGINT AS het_j, count(*) FILTER (x[1] <> x[2] AND y[1] <> y[2])::BIGINT AS hethet, count(*) FILTER (x[1] = x[2] AND y[1] = y[2] AND x[1] <> y[1])::BIGINT AS ibs0 FROM p GROUP BY 1, 2)
SELECT *, round((hethet - 2 * ibs0) / (het_i + het_j), 4) AS phi, round(ibs0 / n_shared, 5) AS ibs0_proportion,
  CASE WHEN het_i + het_j = 0 OR n_shared < 100 THEN 'indeterminate' WHEN (hethet - 2 * ibs0) / (het_i + het_j) > 0.354 THEN 'duplicate_or_mz_twin' WHEN (hethet - 2 * ibs0) / (het_i + het_j) >= 0.177 THEN CASE WHEN ibs0 / n_shared < 0.0012 THEN 'parent_offspring' ELSE 'full_sibling' END
  WHEN (hethet - 2 * ibs0) / (het_i + het_j) >= 0.0884 THEN 'second_degree' WHEN (hethet - 2 * ibs0) / (het_i + het_j) >= 0.0442 THEN 'third_degree' ELSE 'unrelated' END AS relationship,
  CASE WHEN het_i + het_j = 0 THEN 'no_heterozygous_information' WHEN n_shared < 100 THEN 'insufficient_shared_snps' END AS indeterminate_reason FROM g
""")
def pair_kinship(spark, sf_dir):
    return cohort.pair_statistic(_calls(spark, sf_dir), "sample_id", "k", F.substring("gt", 1, 1), F.substring("gt", 2, 1), least=100)


@query(f"""
WITH c AS ({CALLS_SQL}), w AS (SELECT p_partkey AS k, substr('ACGT', p_size % 2 * 2 + 1, 1) AS e, substr('ACGT', (p_size + 1) % 2 * 2 + 1, 1) AS o, p_size / 10.0 AS w FROM part),
j AS (SELECT s.sample_id, w.w, CASE WHEN gt IS NOT NULL THEN (gt[1] = e)::INT + (gt[2] = e)::INT END AS d FROM (SELECT DISTINCT sample_id FROM c) s CROSS JOIN w LEFT JOIN c ON c.sample_id = s.sample_id AND c.k = w.k)
SELECT sample_id, round(coalesce(sum(d * w), 0), 4) AS score, count(*)::BIGINT AS n_total, count(d)::BIGINT AS n_used, round(count(d) / count(*), 6) AS coverage FROM j GROUP BY 1
""")
def weighted_scores(spark, sf_dir):
    """Weighted score of each sample; alleles are A and G, so both strands stay apart."""
    calls = _calls(spark, sf_dir).select("sample_id", F.col("k").cast("string").alias("rsid"), F.lit(None).cast("string").alias("chrom"), F.lit(None).cast("long").alias("pos"), F.col("gt").alias("genotype"))
    letter = lambda c: F.substring(F.lit("ACGT"), (c % 2 * 2 + 1).cast("int"), F.lit(1))
    w = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("weight_id"), F.col("p_partkey").cast("string").alias("rsid"), F.lit(None).cast("string").alias("chrom"), F.lit(None).cast("long").alias("pos"), letter(F.col("p_size")).alias("effect_allele"), letter(F.col("p_size") + 1).alias("other_allele"), (F.col("p_size") / 10.0).alias("weight"))
    out = scores.weighted_score(calls, w)
    return out.select("sample_id", F.round("score", 4).alias("score"), "n_total", "n_used", F.round("coverage", 6).alias("coverage"))


LETTER = "substr('ACGT', {} % 4 + 1, 1)"


@query(f"""
WITH t AS (SELECT p_partkey, {LETTER.format('p_partkey')} AS a, {LETTER.format('p_size')} AS b, {LETTER.format('(p_partkey // 4)')} AS r, {LETTER.format('(p_size // 4)')} AS t FROM part)
SELECT p_partkey, CASE WHEN a IN (r, t) AND b IN (r, t) THEN CASE WHEN a <> b OR r = t THEN 'het' WHEN a = t THEN 'hom_alt' ELSE 'hom_ref' END
  WHEN a <> b AND a IN (translate(r, 'ACGT', 'TGCA'), translate(t, 'ACGT', 'TGCA')) AND b IN (translate(r, 'ACGT', 'TGCA'), translate(t, 'ACGT', 'TGCA')) THEN 'het' END AS zygosity FROM t
""")
def zygosity(spark, sf_dir):
    letter = lambda c: F.substring(F.lit("ACGT"), (c % 4 + 1).cast("int"), F.lit(1))
    k, s = F.col("p_partkey"), F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", G.zygosity(F.concat(letter(k), letter(s)), letter(F.floor(k / 4)), letter(F.floor(s / 4))).alias("zygosity"))


@query(f"""
WITH t AS (SELECT p_partkey, {LETTER.format('p_partkey')} AS a, {LETTER.format('p_size')} AS b, {LETTER.format('(p_partkey // 4)')} AS e, {LETTER.format('(p_partkey // 16)')} AS o FROM part WHERE {LETTER.format('(p_partkey // 4)')} <> {LETTER.format('(p_partkey // 16)')}),
c AS (SELECT *, translate(e, 'ACGT', 'TGCA') AS ce, translate(o, 'ACGT', 'TGCA') AS co FROM t)
SELECT p_partkey, CASE WHEN o = ce THEN CASE WHEN a IN (e, o) AND b IN (e, o) AND a <> b THEN 1 END WHEN a IN (e, o) AND b IN (e, o) THEN (a = e)::INT + (b = e)::INT WHEN a IN (ce, co) AND b IN (ce, co) THEN (a = ce)::INT + (b = ce)::INT END AS dosage,
  CASE WHEN o = ce THEN CASE WHEN NOT (a IN (e, o) AND b IN (e, o)) THEN 'unresolved' WHEN a <> b THEN 'matched_ref' ELSE 'ambiguous_dropped' END WHEN a IN (e, o) AND b IN (e, o) THEN 'matched_ref' WHEN a IN (ce, co) AND b IN (ce, co) THEN 'matched_flip' ELSE 'unresolved' END AS status FROM c
""")
def effect_dosage(spark, sf_dir):
    letter = lambda c: F.substring(F.lit("ACGT"), (c % 4 + 1).cast("int"), F.lit(1))
    k = F.col("p_partkey")
    t = read(spark, sf_dir, "part").select("p_partkey", F.concat(letter(k), letter(F.col("p_size"))).alias("g"), letter(F.floor(k / 4)).alias("e"), letter(F.floor(k / 16)).alias("o")).filter("e <> o")
    d = G.effect_dosage(F.col("g"), F.col("e"), F.col("o"), F.lit(0.3))
    return t.select("p_partkey", d["dosage"].alias("dosage"), d["status"].alias("status"))


@query("""
WITH c AS (SELECT c_nationkey, c_custkey, c_acctbal AS x, count(*) OVER w - 1 AS m, sum(c_acctbal) OVER w AS s, sum(c_acctbal * c_acctbal) OVER w AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey))
SELECT c_custkey, round(CASE WHEN m >= 3 THEN (x - (s - x) / m) / sqrt(((q - x * x) - m * ((s - x) / m) * ((s - x) / m)) / (m - 1)) END, 6) AS z FROM c
""")
def outlier_z(spark, sf_dir):
    return scores.z_score(read(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal").select("c_custkey", F.round("z", 6).alias("z"))


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS sift_score, l_tax * 15 AS polyphen, CASE WHEN l_quantity > 3 THEN l_quantity END AS cadd, CASE WHEN l_linenumber < 5 THEN l_discount * 8 END AS revel, l_tax - 0.04 AS metasvm, CASE WHEN l_linenumber > 2 THEN l_tax * 10 END AS metalr FROM lineitem),
a AS (SELECT *, sift_score < 0.05 AS s1, polyphen > 0.909 AS s2, cadd >= 20 AS s3, ((coalesce((revel >= 0.5)::INT, 0) + coalesce((metasvm > 0)::INT, 0) + coalesce((metalr > 0.5)::INT, 0)) * 2 > (revel IS NOT NULL)::INT + (metasvm IS NOT NULL)::INT + (metalr IS NOT NULL)::INT) AS s4 FROM v)
SELECT d AS deleterious_count, n AS deleterious_total_assessed, n >= 2 AND d * 2 > n AS ensemble_pathogenic, count(*)::BIGINT AS rows FROM (SELECT coalesce(s1::INT, 0) + coalesce(s2::INT, 0) + coalesce(s3::INT, 0) + coalesce(s4::INT, 0) AS d, (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT + (s4 IS NOT NULL)::INT AS n FROM a) GROUP BY ALL
""")
def damage_votes(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    none = F.lit(None).cast("string")
    v = li.select(F.when(n % 2 == 0, F.col("l_discount")).alias("sift_score"), none.alias("sift_pred"), (F.col("l_tax") * 15).alias("polyphen2_hsvar_score"), none.alias("polyphen2_hsvar_pred"), F.when(F.col("l_quantity") > 3, F.col("l_quantity")).alias("cadd_phred"), F.when(n < 5, F.col("l_discount") * 8).alias("revel"), (F.col("l_tax") - 0.04).alias("metasvm"), F.when(n > 2, F.col("l_tax") * 10).alias("metalr"))
    return scores.damage(v).groupBy("deleterious_count", "deleterious_total_assessed", "ensemble_pathogenic").agg(F.count("*").alias("rows"))


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, l_discount AS a, CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END AS b, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 500 END AS c FROM lineitem)
SELECT name, rare, ultra, count(*)::BIGINT AS n FROM (SELECT CASE WHEN a >= coalesce(b, -1) AND a >= coalesce(c, -1) THEN 'a' WHEN coalesce(b, -1) >= coalesce(c, -1) THEN 'b' ELSE 'c' END AS name, greatest(a, b, c) > 0 AND greatest(a, b, c) < 0.05 AS rare, greatest(a, b, c) > 0 AND greatest(a, b, c) < 0.02 AS ultra FROM v) GROUP BY ALL
""")
def arg_max_columns(spark, sf_dir):
    n = F.col("l_linenumber")
    best = S.arg_max({"a": F.col("l_discount"), "b": F.when(n % 3 != 0, F.col("l_tax")), "c": F.when(n % 2 == 0, F.col("l_quantity") / 500)})
    rows = read(spark, sf_dir, "lineitem").select(best.alias("m"))
    rare, ultra = S.rare_flags(F.col("m.value"), 0.05, 0.02)
    return rows.groupBy(F.col("m.name").alias("name"), rare.alias("rare"), ultra.alias("ultra")).agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT p_partkey, (CASE WHEN p_size > 45 THEN 8 ELSE 0 END) + (CASE WHEN p_type = 'PROMO' THEN 2 ELSE 0 END) + (CASE WHEN p_retailprice < 950 THEN 1 ELSE 0 END) - (CASE WHEN p_size < 5 THEN 4 ELSE 0 END) - (CASE WHEN p_brand = 'Brand#7' THEN 1 ELSE 0 END) AS s, p_brand = 'Brand#9' AS ba FROM part)
SELECT p_partkey, (s - 8 * ba::INT)::INT AS points, CASE WHEN ba THEN 'Benign' WHEN s >= 10 THEN 'Pathogenic' WHEN s >= 6 THEN 'Likely pathogenic' WHEN s <= -7 THEN 'Benign' WHEN s <= -1 THEN 'Likely benign' ELSE 'Uncertain significance' END AS classification FROM p
""")
def point_classifier(spark, sf_dir):
    c = scores.criterion
    own = [c("PVS1", F.col("p_size") > 45, 8), c("PM4", F.col("p_type") == "PROMO", 2), c("PM2", F.col("p_retailprice") < 950, 1), c("BS1", F.col("p_size") < 5, -4), c("BP7", F.col("p_brand") == "Brand#7", -1), c("BA1", F.col("p_brand") == "Brand#9", -8)]
    return scores.classify_points(read(spark, sf_dir, "part"), own).select("p_partkey", "points", "classification")


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 'hom' WHEN p_size % 3 = 1 AND p_partkey % 3 = 1 THEN 'compound' WHEN p_size % 3 = 1 AND p_partkey % 3 <> 2 THEN 'het' WHEN p_size % 3 + p_partkey % 3 >= 2 THEN 'burden' ELSE '' END AS call FROM part
""")
def rule_engine(spark, sf_dir):
    models = [
        {"name": "hom", "match": {"x": 2}}, {"name": "compound", "match": {"x": 1, "y": 1}}, {"name": "het", "match": {"x": {"min": 1, "max": 1}}, "veto": {"y": 2}},
        {"name": "burden", "match": {"total": {"rsids": ["x", "y"], "min": 2}}},
    ]
    p = read(spark, sf_dir, "part")
    out = scores.classify_rules(p, {"x": F.col("p_size") % 3, "y": F.col("p_partkey") % 3}, models)
    return out.select("p_partkey", F.array_join("calls", ",").alias("call"))


@query("SELECT CASE WHEN c_acctbal >= 8000 THEN 'strong' WHEN c_acctbal >= 4000 THEN 'moderate' WHEN c_acctbal >= 0 THEN 'supporting' ELSE 'none' END AS band, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def score_bands(spark, sf_dir):
    c = S.band(F.col("c_acctbal"), [(8000, "strong"), (4000, "moderate"), (0, "supporting")], "none")
    return read(spark, sf_dir, "customer").groupBy(c.alias("band")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size & 1 <> 0 THEN 'vep' END, CASE WHEN p_size & 2 <> 0 THEN 'clinvar' END, CASE WHEN p_size & 4 <> 0 THEN 'gnomad' END, CASE WHEN p_size & 8 <> 0 THEN 'dbnsfp' END, CASE WHEN p_size & 16 <> 0 THEN 'gene_phenotype' END, CASE WHEN p_size & 32 <> 0 THEN 'cpic' END], lambda x: x IS NOT NULL), ',') AS names FROM part")
def decode_mask(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(S.mask_names(F.col("p_size"), S.COVERAGE_BITS), ",").alias("names"))


@query("""
WITH g AS (SELECT c_nationkey AS gene, c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'hom_alt' WHEN 1 THEN 'het' WHEN 2 THEN 'hom_ref' ELSE 'het' END AS z, CASE WHEN c_nationkey % 2 = 0 THEN 'AD' ELSE 'AR' END AS m FROM customer WHERE c_acctbal > 8000),
h AS (SELECT *, count(CASE WHEN z = 'het' THEN c_custkey END) OVER (PARTITION BY gene) AS n FROM g)
SELECT c_custkey, CASE WHEN z = 'hom_ref' THEN NULL WHEN m = 'AD' OR z = 'hom_alt' THEN 'affected' WHEN n >= 2 THEN 'possible_biallelic' ELSE 'carrier' END AS status FROM h
""")
def group_status(spark, sf_dir):
    z = F.when(F.col("c_custkey") % 4 == 0, "hom_alt").when(F.col("c_custkey") % 4 == 2, "hom_ref").otherwise("het")
    g = read(spark, sf_dir, "customer").filter("c_acctbal > 8000").withColumns({"z": z, "m": F.when(F.col("c_nationkey") % 2 == 0, "AD").otherwise("AR")})
    return scores.disease_status(g, "c_nationkey", "m", "z", ["c_custkey"]).select("c_custkey", "status")


def _poly_sql(terms) -> str:
    out = repr(terms[0])
    for t in terms[1:]:
        out = f"({out} * x + {t!r})"
    return out


@query(f"""
WITH z AS (SELECT c_custkey, (c_acctbal - 4500) / 3000 AS z FROM customer), t AS (SELECT *, abs(z) AS x FROM z),
p AS (SELECT *, exp(-x * x / 2) * {_poly_sql(S.TAIL_OVER)} / {_poly_sql(S.TAIL_UNDER)} AS tail FROM t)
SELECT c_custkey, round(CASE WHEN z > 0 THEN 1 - tail ELSE tail END, 8) AS share FROM p
""")
def score_percentile(spark, sf_dir):
    """Share of a normal distribution below each balance, to eight digits; a percentile rounds the deviation and the share to
    four, where two engines' last bits can fall on either side. No balance is beyond the range of the rational function."""
    z = (F.col("c_acctbal") - 4500.0) / 3000.0
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(S.normal_cdf(z), 8).alias("share"))


@query("""
WITH w AS (SELECT p_size / 10.0 AS w, substr('ACGT', p_size % 4 + 1, 1) AS e, substr('ACGT', p_partkey % 4 + 1, 1) AS o, CASE WHEN p_size % 6 <> 0 THEN p_size / 60.0 END AS x, p_size / 80.0 AS y FROM part),
p AS (SELECT *, CASE WHEN x IS NOT NULL THEN (x * 0.7 + y * 0.3) / 1.0 END AS p FROM w),
k AS (SELECT *, p IS NOT NULL AND NOT (o = translate(e, 'ACGT', 'TGCA') AND p BETWEEN 0.4 AND 0.6) AS ok FROM p)
SELECT round(sum(2 * w * p) FILTER (ok), 4) AS mean, round(sqrt(sum(2 * w * w * p * (1 - p)) FILTER (ok)), 4) AS sd, count(*) FILTER (ok)::BIGINT AS n_used, count(*)::BIGINT AS n_total FROM k
""")
def expected_score(spark, sf_dir):
    letter = lambda c: F.substring(F.lit("ACGT"), (c % 4 + 1).cast("int"), F.lit(1))
    s = F.col("p_size")
    w = read(spark, sf_dir, "part").select((s / 10.0).alias("weight"), letter(s).alias("effect_allele"), letter(F.col("p_partkey")).alias("other_allele"), F.when(s % 6 != 0, s / 60.0).alias("af_x"), (s / 80.0).alias("af_y"))
    return scores.expected_score(w, {"x": 0.7, "y": 0.3}).select(F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "n_used", "n_total")


# --- vectors ------------------------------------------------------------------------------------------------------

CENTROID_SQL = "u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS c FROM u GROUP BY 1, 2)"


@query(f"""
WITH {CENTROID_SQL}, d AS (SELECT vec_id, m.label, sum((x - c) * (x - c)) AS d FROM u JOIN m USING (i) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS r FROM d)
SELECT a.vec_id, a.label AS nearest, round(a.d, 6) AS distance, round(b.d, 6) AS second_distance, CASE WHEN sqrt(b.d) / sqrt(a.d) < 1.05 THEN 'ADMIXED' ELSE a.label::VARCHAR END AS verdict FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2
""")
def nearest_centroid(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    out = vectors.nearest_centroid(e, vectors.centroids(e, "label", "embedding", 64), "vec_id", "embedding", "label", margin=1.05)
    return out.select("vec_id", "nearest", F.round("distance", 6).alias("distance"), F.round("second_distance", 6).alias("second_distance"), "verdict")


@query("""
WITH d AS (SELECT q.vec_id, r.vec_id AS r, r.label, list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS d FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, r) AS k FROM d)
SELECT vec_id, label, count(*) / 15 AS share FROM n WHERE k <= 15 GROUP BY 1, 2
""")
def knn_vote(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return vectors.knn_vote(e.filter("vec_id % 50 = 0"), e, "vec_id", "vec_id", "embedding", "label")


@query("WITH a AS (SELECT embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(greatest(0, least(1, list_cosine_similarity(embedding::DOUBLE[], a))), 6) AS similarity FROM embeddings, a")
def cosine_similarity(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    first = e.filter("vec_id = 0").select(F.col("embedding").cast("array<double>").alias("a"), F.lit(1).alias("_k"))
    rows = e.withColumn("_k", F.lit(1)).join(F.broadcast(first), "_k")
    return rows.select("vec_id", F.round(vectors.cosine(F.col("embedding").cast("array<double>"), F.col("a")), 6).alias("similarity"))


@query("""
WITH l AS (SELECT p_partkey, p_size / 50.0 AS mean, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE 0.5 END AS sd, p_size / 100.0 AS l1, p_retailprice / 1000 AS l2 FROM part),
d AS (SELECT l_suppkey % 40 AS s, l_partkey AS p_partkey, min(l_orderkey % 3) AS dosage FROM lineitem GROUP BY 1, 2),
z AS (SELECT s, CASE WHEN sd > 0 THEN (dosage - mean) / sd ELSE 0 END AS z, l1, l2 FROM d JOIN l USING (p_partkey))
SELECT s, round(sum(z * l1), 4) AS x, round(sum(z * l2), 4) AS y, round(count(*) / (SELECT count(*) FROM l), 6) AS coverage FROM z GROUP BY 1
""")
def projection(spark, sf_dir):
    s = F.col("p_size")
    load = read(spark, sf_dir, "part").select("p_partkey", (s / 50.0).alias("mean"), F.when(s % 7 == 0, 0.0).otherwise(0.5).alias("sd"), F.array(s / 100.0, F.col("p_retailprice") / 1000).alias("load"))
    d = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("s"), F.col("l_partkey").alias("p_partkey")).agg(F.min(F.col("l_orderkey") % 3).alias("dosage"))
    out = vectors.project(d, load, "s", "p_partkey", 2)
    return out.select("s", F.round(F.get("point", F.lit(0)), 4).alias("x"), F.round(F.get("point", F.lit(1)), 4).alias("y"), F.round("coverage", 6).alias("coverage"))


# The fit over each set of corners that are not zero has a closed form, as corners don't overlap; the best feasible set counts.
SETS = [[c for c in range(3) if m >> c & 1] for m in range(1, 8)]


def _fit_sql(own: list[int]) -> str:
    level = f"(({' + '.join(f'h[{c + 1}] / w[{c + 1}]' for c in own)} - 1) / ({' + '.join(f'1 / w[{c + 1}]' for c in own)}))"
    x = [f"(h[{c + 1}] - {level}) / w[{c + 1}]" if c in own else "0.0" for c in range(3)]
    loss = " + ".join(f"w[{c + 1}] * ({x[c]}) ** 2 - 2 * h[{c + 1}] * ({x[c]})" for c in own)
    return f"CASE WHEN least({', '.join(x)}) >= 0 THEN {{'loss': {loss}, 'x': [{', '.join(x)}]}} END"


@query(f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), g AS (SELECT vec_id, [{', '.join(f"list_sum(list_transform(range({c}, 64, 3), lambda i: v[i + 1])) / 4" for c in range(3))}] AS h, [22 / 16, 21 / 16, 21 / 16] AS w FROM e),
b AS (SELECT vec_id, list_sort(list_filter([{', '.join(_fit_sql(s) for s in SETS)}], lambda z: z IS NOT NULL))[1].x AS x FROM g),
r AS (SELECT vec_id, list_transform(x, lambda z: round(z, 4)) AS x FROM b), t AS (SELECT vec_id, x, list_position(x, list_max(x)) AS top FROM r)
SELECT vec_id, ['a', 'b', 'c'][i] AS label, CASE WHEN i = top THEN round(x[i] + 1 - list_sum(x), 4) ELSE x[i] END AS fraction FROM t, range(1, 4) s(i)
""")
def mixture_fractions(spark, sf_dir):
    """Simplex fit of every vector to three corner vectors."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    corners = [[float(i % 3 == c) / 4 for i in range(64)] for c in range(3)]
    return vectors.mixture(e, ["vec_id"], "embedding", corners, ["a", "b", "c"])


# --- panels -------------------------------------------------------------------------------------------------------

EFFECTS = {"AA": "Standard", "AG": "Moderate", "GG": "Elevated"}


@query(f"""
WITH c AS ({CALLS_SQL}), p AS (SELECT p_partkey AS k, p_type AS pathway, p_size % 3 AS stars FROM part),
g AS (SELECT s.sample_id, p.pathway, p.stars, CASE WHEN p.stars = 0 AND gt[1] = 'G' THEN '--' ELSE gt END AS gt FROM (SELECT DISTINCT sample_id FROM c) s CROSS JOIN p LEFT JOIN c ON c.sample_id = s.sample_id AND c.k = p.k),
x AS (SELECT *, CASE WHEN gt IS NULL THEN 'not_on_array' WHEN gt = '--' THEN 'no_call' ELSE 'called' END AS st, CASE WHEN gt IN ('AA') THEN 1 WHEN gt IN ('AG', 'GA') THEN 2 WHEN gt = 'GG' THEN CASE WHEN stars < 2 THEN 2 ELSE 3 END END AS r FROM g)
SELECT sample_id, pathway, CASE coalesce(max(r) FILTER (st = 'called'), 1) WHEN 1 THEN 'Standard' WHEN 2 THEN 'Moderate' ELSE 'Elevated' END AS level, count(*) FILTER (st = 'called')::BIGINT AS n_called, count(*) FILTER (st = 'no_call')::BIGINT AS n_no_call, count(*) FILTER (st = 'not_on_array')::BIGINT AS n_not_on_array FROM x GROUP BY 1, 2
""")
def panel_pathways(spark, sf_dir):
    """Categorical panel scored and rolled up to pathways."""
    panel = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("pathway"), (F.col("p_size") % 3).alias("stars"), S.as_map(EFFECTS).alias("effects"))
    calls = _calls(spark, sf_dir)
    held = panel.filter("stars = 0").select("k").withColumn("_h", F.lit(True))
    calls = calls.join(held, "k", "left").withColumn("gt", F.when(F.col("_h") & (F.substring("gt", 1, 1) == "G"), "--").otherwise(F.col("gt"))).drop("_h")
    return panels.panel_levels(calls, panel, key="k", genotype="gt")


@query(f"""
WITH c AS ({CALLS_SQL}), p AS (SELECT p_partkey // 10 AS locus, p_partkey AS k, p_partkey % 10 AS rank FROM part),
j AS (SELECT s.sample_id, locus, rank, CASE WHEN gt = 'GG' THEN '--' ELSE gt END AS gt FROM (SELECT DISTINCT sample_id FROM c) s CROSS JOIN p LEFT JOIN c ON c.sample_id = s.sample_id AND c.k = p.k)
SELECT sample_id, locus, arg_min(gt, rank) FILTER (gt IS NOT NULL AND gt <> '--') AS gt, CASE WHEN count(*) FILTER (gt <> '--') > 0 THEN 'typed' WHEN count(gt) > 0 THEN 'no_call' ELSE 'absent' END AS status FROM j GROUP BY 1, 2
""")
def probe_reads(spark, sf_dir):
    probes = read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).alias("locus"), F.col("p_partkey").alias("k"), (F.col("p_partkey") % 10).alias("rank"), F.lit(False).alias("positional"))
    calls = _calls(spark, sf_dir).withColumn("gt", F.when(F.col("gt") == "GG", "--").otherwise(F.col("gt")))
    return panels.read_probe(calls, probes, key="k", genotype="gt")


@query("""
WITH r AS (SELECT p_brand AS gene, CASE WHEN p_partkey % 2 = 0 THEN 'rs' ELSE 'i' END || p_partkey AS rsid, '1' AS chrom, p_partkey // 2 AS pos, CASE p_size % 3 WHEN 0 THEN 'het' WHEN 1 THEN 'hom_alt' ELSE 'hom_ref' END AS zygosity FROM part WHERE p_type = 'PROMO'),
k AS (SELECT r.*, CASE WHEN right(gene, 1) IN ('1', '3', '5', '7', '9') THEN 'AR' ELSE 'AD' END AS inh FROM r WHERE zygosity <> 'hom_ref' AND gene <> 'Brand#10'),
o AS (SELECT *, row_number() OVER (PARTITION BY gene, pos ORDER BY (NOT starts_with(rsid, 'rs'))::INT, rsid) AS n FROM k)
SELECT gene, pos, rsid, zygosity, CASE WHEN inh = 'AD' OR zygosity = 'hom_alt' THEN 'affected' ELSE 'carrier' END AS status, inh = 'AR' AND count(*) FILTER (zygosity = 'het') OVER (PARTITION BY gene) >= 2 AS possible_compound FROM o WHERE n = 1
""")
def gene_panel(spark, sf_dir):
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part")
    z = F.when(F.col("p_size") % 3 == 0, "het").when(F.col("p_size") % 3 == 1, "hom_alt").otherwise("hom_ref")
    rows = p.filter("p_type = 'PROMO'").select(F.col("p_brand").alias("gene"), F.concat(F.when(k % 2 == 0, "rs").otherwise("i"), k).alias("rsid"), F.lit("1").alias("chrom"), F.floor(k / 2).alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), z.alias("zygosity"))
    panel = p.select(F.col("p_brand").alias("gene"), F.when(F.right("p_brand", F.lit(1)).isin("1", "3", "5", "7", "9"), "AR").otherwise("AD").alias("inheritance")).distinct()
    return panels.gene_panel(rows, panel, "gene", F.lit(True), ["Brand#10"]).select("gene", "pos", "rsid", "zygosity", "status", "possible_compound")


@query(f"""
WITH c AS ({CALLS_SQL}), x AS (SELECT sample_id, k, CASE k % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE '1' END AS chrom, CASE WHEN k % 8 = 4 THEN substr(gt, 1, 1) WHEN k % 9 = 1 THEN '--' ELSE gt END AS gt FROM c),
g AS (SELECT sample_id, count(*) FILTER (chrom = 'X' AND gt <> '--' AND length(gt) = 2 AND gt[1] <> gt[2])::BIGINT AS x_het, count(*) FILTER (chrom = 'X' AND gt <> '--' AND length(gt) = 2 AND gt[1] = gt[2])::BIGINT AS x_hom, count(*) FILTER (chrom = 'X' AND length(gt) = 1)::BIGINT AS x_hemizygous, count(*) FILTER (chrom = 'Y')::BIGINT AS y_total, count(*) FILTER (chrom = 'Y' AND gt <> '--')::BIGINT AS y_typed FROM x GROUP BY 1)
SELECT sample_id, x_het, x_hom, x_hemizygous, y_total, y_typed, CASE WHEN t < 100 OR y_total < 50 THEN 'unknown' WHEN x_het / t <= 0.05 THEN CASE WHEN y > 0.3 THEN 'XY' WHEN y > 0.1 THEN 'manual_review' ELSE 'unknown' END WHEN x_het / t >= 0.15 THEN CASE WHEN y > 0.1 THEN 'manual_review' ELSE 'XX' END ELSE 'manual_review' END AS sex FROM (SELECT *, x_het + x_hom + x_hemizygous AS t, y_typed / y_total AS y FROM g)
""")
def sex_signals(spark, sf_dir):
    k = F.col("k")
    g = F.when(k % 8 == 4, F.substring("gt", 1, 1)).when(k % 9 == 1, "--").otherwise(F.col("gt"))
    calls = _calls(spark, sf_dir).select("sample_id", F.when(k % 4 == 0, "X").when(k % 4 == 1, "Y").otherwise("1").alias("chrom"), (F.lit(5_000_000) + k).alias("pos"), g.alias("genotype"))
    out = cohort.infer_sex(cohort.sex_signals(calls, "sample_id"))
    return out.select("sample_id", "x_het", "x_hom", "x_hemizygous", "y_total", "y_typed", "sex")


@query(f"""
WITH c AS ({CALLS_SQL}), d AS (SELECT sample_id, k, (gt[1] = 'G')::INT + (gt[2] = 'G')::INT AS n FROM c),
g AS (SELECT s.sample_id, p.g AS g FROM (SELECT DISTINCT sample_id FROM c) s CROSS JOIN (SELECT DISTINCT p_partkey // 10 AS g FROM part) p),
x AS (SELECT g.sample_id, g, a.n AS a, b.n AS b, e.n AS e FROM g LEFT JOIN d a ON a.sample_id = g.sample_id AND a.k = 10 * g + 1 LEFT JOIN d b ON b.sample_id = g.sample_id AND b.k = 10 * g + 2 LEFT JOIN d e ON e.sample_id = g.sample_id AND e.k = 10 * g + 3),
n4 AS (SELECT *, least(2, coalesce(a, 0), coalesce(b, 0)) AS n4 FROM x),
n10 AS (SELECT *, least(2 - n4, coalesce(e, 0)) AS n10 FROM n4), n2 AS (SELECT *, least(2 - n4 - n10, coalesce(a, 0) - n4) AS n2 FROM n10), n3 AS (SELECT *, least(2 - n4 - n10 - n2, coalesce(b, 0) - n4) AS n3 FROM n2),
r AS (SELECT *, repeat('*1 ', 2 - n2 - n3 - n4 - n10) || repeat('*2 ', n2) || repeat('*3 ', n3) || repeat('*4 ', n4) || repeat('*10 ', n10) AS t, coalesce(a, 0) - n4 - n2 AS ra, coalesce(b, 0) - n4 - n3 AS rb, coalesce(e, 0) - n10 AS re FROM n3),
y AS (SELECT *, replace(trim(t), ' ', '/') AS diplotype, n2 + n3 + n4 + n10 = 2 AND (ra > 0 OR rb > 0 OR re > 0) AS crowded_out, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (e IS NOT NULL)::INT AS seen FROM r)
SELECT sample_id, 'G' || g AS gene, diplotype, CASE WHEN crowded_out OR seen = 0 THEN 'Insufficient' WHEN seen = 3 THEN 'Complete' ELSE 'Partial' END AS confidence,
  CASE diplotype WHEN '*1/*2' THEN 'Intermediate' WHEN '*2/*2' THEN 'Poor' WHEN '*1/*1' THEN 'Normal' END AS phenotype, (ra > 0)::INT + (rb > 0)::INT + (re > 0)::INT AS residual_variants, crowded_out FROM y
""")
def star_alleles(spark, sf_dir):
    """Greedy allele calls in a gene for every ten parts, with what the calls leave over."""
    calls = _calls(spark, sf_dir).select("sample_id", F.concat(F.lit("rs"), "k").alias("rsid"), F.col("gt").alias("genotype"))
    g = read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).alias("g")).distinct()
    v = lambda *places: F.array(*[F.struct(F.concat(F.lit("rs"), (F.col("g") * 10 + i).cast("string")).alias("rsid"), F.lit("A").alias("ref"), F.lit("G").alias("alt")) for i in places])
    none = F.array().cast("array<struct<rsid:string,ref:string,alt:string>>")
    named = [("*1", none), ("*2", v(1)), ("*3", v(2)), ("*4", v(1, 2)), ("*10", v(3))]
    alleles = g.select(F.concat(F.lit("G"), "g").alias("gene"), "g", F.explode(F.array(*[F.struct(F.lit(n).alias("allele_name"), x.alias("defining_variants")) for n, x in named])).alias("a")).select("gene", "a.*")
    pheno = alleles.select("gene").distinct().select("gene", F.explode(F.array(*[F.struct(F.lit(d).alias("diplotype"), F.lit(p).alias("phenotype")) for d, p in (("*1/*2", "Intermediate"), ("*2/*2", "Poor"), ("*1/*1", "Normal"))])).alias("p")).select("gene", "p.*")
    return callers.star_alleles(calls, alleles, pheno)


def _node_sql(name: str, *markers: tuple[int, str], guard: tuple[int, str] | None = None) -> str:
    """Present, conflicting and total of a node's markers, and whether its guard is typed otherwise."""
    seen = " + ".join(f"coalesce(contains(r{k}, '{a}'), false)::INT" for k, a in markers)
    typed = " + ".join(f"(r{k} IS NOT NULL)::INT" for k, _ in markers)
    bad = f"coalesce(r{guard[0]} <> '{guard[1] * 2}', false)" if guard else "false"
    return f"{seen} AS {name}_n, {typed} - ({seen}) AS {name}_bad, {len(markers)} AS {name}_t, {bad} AS {name}_g"


def _rank_sql(name: str) -> str:
    return f"CASE WHEN {name}_bad = 0 AND {name}_n >= 1 AND {name}_n / {name}_t >= 0.5 THEN {name}_n / {name}_t * 1000 + {name}_n END"


@query(f"""
WITH c AS ({CALLS_SQL}), x AS (SELECT sample_id, {', '.join(f"min(gt) FILTER (k = {k}) AS r{k}" for k in range(1, 10))} FROM c GROUP BY 1),
n AS (SELECT sample_id, {_node_sql('l', (1, 'G'), (2, 'G'))}, {_node_sql('l1', (3, 'A'))}, {_node_sql('l2', (4, 'G'), (5, 'A'), guard=(9, 'G'))}, {_node_sql('m', (6, 'A'), (7, 'A'))}, {_node_sql('m1', (8, 'G'))} FROM x),
k AS (SELECT *, {_rank_sql('l')} AS l, {_rank_sql('l1')} AS l1, {_rank_sql('l2')} AS l2, {_rank_sql('m')} AS m, {_rank_sql('m1')} AS m1 FROM n),
via AS (SELECT *, CASE WHEN l1 IS NULL AND l2 IS NULL THEN NULL WHEN l2 IS NULL OR l1 >= l2 THEN 'L1' WHEN NOT l2_g THEN 'L2' END AS below_l, CASE WHEN m1 IS NOT NULL THEN 'M1' END AS below_m FROM k),
s AS (SELECT *, l AS sl, m AS sm FROM via),
t AS (SELECT *, CASE WHEN sl IS NULL AND sm IS NULL THEN '' WHEN sm IS NULL OR sl >= sm THEN 'L' ELSE 'M' END AS top FROM s),
p AS (SELECT *, CASE top WHEN 'L' THEN below_l WHEN 'M' THEN below_m END AS leaf FROM t)
SELECT sample_id, coalesce(leaf, nullif(top, ''), 'root') AS haplogroup, concat_ws('>', 'root', nullif(top, ''), leaf) AS path,
  round((CASE top WHEN 'L' THEN l_n WHEN 'M' THEN m_n ELSE 0 END + CASE coalesce(leaf, '') WHEN 'L1' THEN l1_n WHEN 'L2' THEN l2_n WHEN 'M1' THEN m1_n ELSE 0 END)
  / nullif(CASE top WHEN 'L' THEN l_t WHEN 'M' THEN m_t ELSE 0 END + CASE coalesce(leaf, '') WHEN 'L1' THEN l1_t WHEN 'L2' THEN l2_t WHEN 'M1' THEN m1_t ELSE 0 END, 0), 6) AS confidence FROM p
""")
def tree_descent(spark, sf_dir):
    """Descent of an invented marker tree with a guard on one node, for every sample."""
    node = callers.Node
    tree = node("root", (), [node("L", (("rs1", "G"), ("rs2", "G")), [node("L1", (("rs3", "A"),)), node("L2", (("rs4", "G"), ("rs5", "A")), guards=(("rs9", "G"),))]), node("M", (("rs6", "A"), ("rs7", "A")), [node("M1", (("rs8", "G"),))])])
    calls = _calls(spark, sf_dir).select("sample_id", F.concat(F.lit("rs"), "k").alias("rsid"), F.col("gt").alias("genotype"))
    return callers.descend(calls, tree).select("sample_id", "haplogroup", F.array_join("path", ">").alias("path"), F.round("confidence", 6).alias("confidence"))


@query(f"""
WITH c AS ({CALLS_SQL}), x AS (SELECT sample_id, {', '.join(f"min(gt) FILTER (k = {k}) AS r{k}" for k in range(1, 10))} FROM c GROUP BY 1),
n AS (SELECT sample_id, {_node_sql('l', (1, 'G'), (2, 'G'))}, {_node_sql('l1', (3, 'A'))}, {_node_sql('l2', (4, 'G'), (5, 'A'), guard=(9, 'G'))}, {_node_sql('m', (6, 'A'))}, {_node_sql('m1', (7, 'A'), (8, 'G'))} FROM x),
k AS (SELECT *, {_rank_sql('l')} AS l, {_rank_sql('l1')} AS l1, {_rank_sql('l2')} AS l2, {_rank_sql('m1')} AS m1 FROM n),
b AS (SELECT *, CASE WHEN l1 IS NULL AND l2 IS NULL THEN NULL WHEN l2 IS NULL OR l1 >= l2 THEN 'L1' WHEN NOT l2_g THEN 'L2' END AS below FROM k),
u AS (SELECT *, CASE below WHEN 'L1' THEN l1_n WHEN 'L2' THEN l2_n ELSE 0 END AS bn, CASE below WHEN 'L1' THEN l1_t WHEN 'L2' THEN l2_t ELSE 0 END AS bt FROM b),
w AS (SELECT *, CASE WHEN l IS NOT NULL OR l_bad = 0 AND l_n = 0 AND below IS NOT NULL THEN (l_n + bn) * 1000000 + (l_n + bn) / (l_t + bt) * 1000 + 1 + (below IS NOT NULL)::INT END AS ls,
  CASE WHEN m_bad = 0 AND m_n = 1 AND m1 IS NOT NULL THEN (m_n + m1_n) * 1000000 + (m_n + m1_n) / (m_t + m1_t) * 1000 + 2 END AS ms FROM u),
t AS (SELECT *, CASE WHEN ls IS NULL AND ms IS NULL THEN '' WHEN ms IS NULL OR ls >= ms THEN 'L' ELSE 'M' END AS top FROM w)
SELECT sample_id, CASE top WHEN 'L' THEN concat_ws('>', 'root', 'L', below) WHEN 'M' THEN 'root>M>M1' ELSE 'root' END AS path, CASE top WHEN 'L' THEN round((l_n + bn) / (l_t + bt), 6) WHEN 'M' THEN round((m_n + m1_n) / (m_t + m1_t), 6) END AS confidence FROM t
""")
def sparse_descent(spark, sf_dir):
    """Descent where an inner node of one marker and one that isn't typed may be passed through and are no result."""
    node = callers.Node
    tree = node("root", (), [node("L", (("rs1", "G"), ("rs2", "G")), [node("L1", (("rs3", "A"),)), node("L2", (("rs4", "G"), ("rs5", "A")), guards=(("rs9", "G"),))]), node("M", (("rs6", "A"),), [node("M1", (("rs7", "A"), ("rs8", "G")))])])
    calls = _calls(spark, sf_dir).select("sample_id", F.concat(F.lit("rs"), "k").alias("rsid"), F.col("gt").alias("genotype"))
    rules = callers.Descent(floor=2, passable=frozenset({"rs1"}))
    return callers.descend(calls, tree, rules=rules).select("sample_id", F.array_join("path", ">").alias("path"), F.round("confidence", 6).alias("confidence"))


# --- text in and out ----------------------------------------------------------------------------------------------

@query("""
WITH t AS (SELECT p_partkey, CASE p_partkey % 30 WHEN 23 THEN 'X' WHEN 24 THEN 'Y' WHEN 25 THEN 'MT' WHEN 26 THEN 'MT' ELSE (p_partkey % 30)::VARCHAR END AS c, substr('TGCA', p_size % 4 + 1, 1) AS a, substr('ACGT', p_partkey % 4 + 1, 1) AS b FROM part)
SELECT 'rs' || p_partkey AS rsid, CASE WHEN c NOT IN ('0', '27', '28', '29') THEN c END AS chrom, p_partkey - 5 AS pos, CASE WHEN a <= b THEN a || b ELSE b || a END AS genotype, CASE WHEN c IN ('0', '27', '28', '29') THEN 'chromosome' WHEN p_partkey < 5 THEN 'position' END AS reason FROM t
""")
def parse_genotypes(spark, sf_dir):
    """Lines made from parts, parsed as a four-column file."""
    k = F.col("p_partkey")
    letter = lambda s, c: F.substring(F.lit(s), (c % 4 + 1).cast("int"), F.lit(1))
    line = F.concat_ws("\t", F.concat(F.lit("rs"), k), (k % 30).cast("string"), (k - 5).cast("string"), F.concat(F.lower(letter("TGCA", F.col("p_size"))), letter("ACGT", k)))
    head = spark.createDataFrame([("# rsid\tchromosome\tposition\tgenotype",), ("",)], "value string")
    return text.genotypes(head.unionByName(read(spark, sf_dir, "part").select(line.alias("value"))), "a").drop("value")


@query("""
WITH t AS (SELECT p_partkey AS pos, CASE WHEN p_size % 3 = 0 THEN ['A', 'C'] ELSE ['T'] END AS alts, CASE WHEN p_size % 4 = 0 THEN '0.1' ELSE '0.1,0.' || p_size END AS af FROM part),
u AS (SELECT pos, unnest(alts) AS alt, generate_subscripts(alts, 1) AS i, len(alts) AS n, af, string_split(af, ',') AS p FROM t)
SELECT pos, alt, CASE WHEN n = 1 THEN TRY_CAST(af AS DOUBLE) WHEN len(p) = n THEN p[i]::DOUBLE END AS af FROM u
""")
def parse_frequencies(spark, sf_dir):
    """Multi-allelic lines with value lists that fit or don't."""
    s = F.col("p_size")
    alt, af = F.when(s % 3 == 0, "A,C").otherwise("T"), F.when(s % 4 == 0, "0.1").otherwise(F.concat(F.lit("0.1,0."), s))
    line = F.concat_ws("\t", F.lit("chr1"), F.col("p_partkey").cast("string"), F.lit("."), F.lit("G"), alt, F.lit("."), F.lit("PASS"), F.concat(F.lit("FLAG;AF="), af))
    return text.frequencies(read(spark, sf_dir, "part").select(line.alias("value")), {"AF": "af"}).select("pos", "alt", "af")


@query("""
WITH t AS (SELECT p_partkey, substr('ACGT', p_partkey % 4 + 1, 1) AS a, substr('ACGT', p_size % 4 + 1, 1) AS b FROM part WHERE p_size % 6 <> 0)
SELECT '1' || chr(9) || p_partkey || chr(9) || 'rs' || p_partkey || chr(9) || 'N' || chr(9) || CASE WHEN a = b THEN a ELSE a || ',' || b END || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || '.' || chr(9) || 'GT' || chr(9) || CASE WHEN a = b THEN '1/1' ELSE '1/2' END AS value FROM t
""")
def export_vcf_lines(spark, sf_dir):
    letter = lambda c: F.substring(F.lit("ACGT"), (c % 4 + 1).cast("int"), F.lit(1))
    k, s = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "part").select(F.concat(F.lit("rs"), k).alias("rsid"), F.lit("1").alias("chrom"), k.alias("pos"), F.when(s % 6 == 0, "--").otherwise(F.concat(letter(k), letter(s))).alias("genotype"), none.alias("ref"), none.alias("alt"), none.alias("zygosity"))
    return sinks.vcf_lines(rows).select("value")


# --- events -------------------------------------------------------------------------------------------------------

@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return stream.tumbling(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("WITH w AS (SELECT date_trunc('hour', ts) - INTERVAL (i) HOUR AS window_start, event_type FROM events, range(2) t(i)) SELECT window_start, event_type, count(*)::BIGINT AS n FROM w GROUP BY 1, 2")
def event_sliding(spark, sf_dir):
    return stream.sliding(read(spark, sf_dir, "events"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*)::BIGINT AS n FROM s GROUP BY user_id, i
""")
def event_sessions(spark, sf_dir):
    return stream.sessions(read(spark, sf_dir, "events"))


@query("SELECT DISTINCT event_id FROM events")
def event_first_seen(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return stream.first_seen(e.unionByName(e)).select("event_id")
