"""Operators on small frames made by hand: nulls, ties, empty tables, boundaries."""

import hashlib
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import genotype as G
from loomframe.functions import scalar as S
from loomframe.operators import callers, cohort, facets, intervals, lookup, merge, ordered, paging, panels, rules, scores, sequence, vectors

COMP = str.maketrans("ACGT", "TGCA")


def one(spark, column, rows, kind):
    return [r[0] for r in spark.createDataFrame(rows, kind).select(column).collect()]


# --- genotype functions -------------------------------------------------------------------------------------------

CALLS = ["AA", "AG", "GA", "GG", "TT", "CT", "CC", "AT", "CG", "A", "T", "--", "-", "??", "0", "00", "II", "DI", None, "", " ", "NN", "AGT", "ag"]


def plain_called(g):
    return g is not None and g.strip() not in G.NO_CALLS and 1 <= len(g.strip()) <= 2 and set(g.strip().upper()) <= set("ACGT")


def test_zygosity(spark):
    rows = [(g, r, a) for g in CALLS for r, a in (("A", "G"), ("A", "T"), ("C", "T"), ("A", "A"), ("AC", "A"), (None, "A"), ("A", ""))]
    got = one(spark, G.zygosity(F.col("g"), F.col("r"), F.col("a")), rows, "g string, r string, a string")
    for (g, r, a), z in zip(rows, got, strict=True):
        want = None
        if plain_called(g) and r and a and len(r) == len(a) == 1:
            s = set(g.strip().upper())
            if s <= {r, a}:
                want = "het" if {r, a} <= s else "hom_alt" if a in s else "hom_ref"
            elif len(s) == 2 and s <= {r.translate(COMP), a.translate(COMP)}:
                want = "het"
        assert z == want, (g, r, a)


def test_effect_dosage(spark):
    rows = [(g, e, o, m) for g in CALLS for e, o in (("A", "G"), ("G", "A"), ("A", "T"), ("C", "G"), ("A", None), ("N", "A"), ("A", "AC")) for m in (None, 0.5)]
    d = G.effect_dosage(F.col("g"), F.col("e"), F.col("o"), F.col("m"))
    got = [tuple(x) for x in one(spark, d, rows, "g string, e string, o string, m double")]
    for (g, e, o, m), x in zip(rows, got, strict=True):
        if g is None or g.strip() in G.NO_CALLS:
            want = (None, "no_call")
        elif not plain_called(g) or e not in "ACGT":
            want = (None, "unresolved")
        else:
            u = g.strip().upper()
            if o not in ("A", "C", "G", "T"):
                want = (u.count(e) if len(u) == 2 else 0, "matched_ref")
            elif o == e.translate(COMP):
                want = (None, "missing_freq") if m is None else (None, "unresolved") if not set(u) <= {e, o} else (1, "matched_ref") if len(set(u)) == 2 else (None, "ambiguous_dropped")
            elif set(u) <= {e, o}:
                want = (u.count(e), "matched_ref")
            elif set(u) <= {e.translate(COMP), o.translate(COMP)}:
                want = (u.count(e.translate(COMP)), "matched_flip")
            else:
                want = (None, "unresolved")
        assert x == want, (g, e, o, m)


def test_imputed_and_risk_dosage(spark):
    rows = [("A", "G", 0.4, "G", "A", 0.4), ("A", "G", 0.4, "A", "G", 1.6), ("A", "G", 0.4, "C", "T", 0.4), ("A", "T", 0.4, "A", "T", None), ("A", "G", 2.5, "G", "A", None), ("A", "A", 1.0, "G", "A", None), ("A", "C", 1.0, "G", "A", None), ("A", "G", 1.0, "G", None, None)]
    got = one(spark, G.imputed_dosage(*[F.col(c) for c in "radeo"]), [r[:5] for r in rows], "r string, a string, d double, e string, o string")
    assert got == pytest.approx([r[5] for r in rows], nan_ok=True)
    rows = [("AG", "A", "G", 1, 1), ("TC", "A", "G", 1, None), ("AA", "A", "T", None, 2), ("AT", "A", "T", 1, 1), ("A", "A", "G", 1, 1), ("--", "A", "G", None, None), ("CC", "A", "G", 0, None)]
    kind = "g string, k string, r string"
    for i, strict in ((3, True), (4, False)):
        assert one(spark, G.risk_dosage(F.col("g"), F.col("k"), F.col("r"), strict), [r[:3] for r in rows], kind) == [r[i] for r in rows]


def test_lookup_by_any_spelling(spark):
    m = S.as_map({"AG": "x", "CC": "y", "delG/G": "z", "AA": "p", "TT": "q"})
    rows = [("AG",), ("GA",), ("TC",), ("CT",), ("gg",), ("G/delG",), ("AA",), ("--",), (None,), ("AC",)]
    assert one(spark, G.lookup(m, F.col("g")), rows, "g string") == ["x", "x", "x", "x", "y", "z", "p", None, None, None]
    assert one(spark, G.strand_ambiguous(m, F.col("g")), rows, "g string") == [False] * 6 + [True, False, False, False]


def test_small_functions(spark):
    assert one(spark, G.canonical(F.col("g")), [("ga",), ("AG",), ("T",), ("--",)], "g string") == ["AG", "AG", "T", "--"]
    assert one(spark, G.allele_identity(F.col("c"), F.col("p"), F.col("r"), F.col("a")), [("1", 5, "A", 'x"y\\')], "c string, p long, r string, a string") == ['["1",5,"A","x\\"y\\\\"]']
    state = G.allelic_state(F.col("c"), F.col("p"), F.col("z"), F.col("s"))
    rows = [("MT", 1, "hom_alt", None), ("M", 1, "het", "XX"), ("X", 5_000_000, "hom_alt", "XY"), ("X", 100_000, "hom_alt", "XY"), ("X", 5_000_000, "hom_alt", None), ("1", 1, "het", "XY")]
    assert one(spark, state, rows, "c string, p long, z string, s string") == ["homoplasmic", "heteroplasmic", "hemizygous", "homozygous", "homozygous", "heterozygous"]
    mc = [("SO:0001583|missense_variant,SO:0001627|intron_variant",), ("SO:0001583|missense_variant,bad",), (None,), ("SO:0001583|a,SO:0001584|a",)]
    assert one(spark, S.consequence_terms(F.col("m")), mc, "m string") == ["missense_variant&intron_variant", None, None, "a"]
    assert one(spark, S.max_term_rank(F.col("m"), {"a": 3, "b": 5}), [("a&b",), ("zz",), (None,)], "m string") == [5, 0, -1]
    assert one(spark, S.percentile(F.col("s"), F.lit(0.0), F.col("d")), [(0.0, 1.0), (1.96, 1.0), (5.0, 0.0)], "s double, d double") == [50.0, 97.5, 50.0]
    assert one(spark, S.implausible_homozygote(F.col("a"), F.col("n")), [(None, None), (0.01, 0), (0.02, 0), (0.001, 3)], "a double, n long") == [True, True, False, False]
    tie = S.arg_max({"x": F.col("a"), "y": F.col("b")}, {"x": F.lit(1), "y": F.lit(2)})
    assert [None if v is None else tuple(v) for v in one(spark, tie, [(0.5, 0.5), (None, 0.1), (None, None)], "a double, b double")] == [(0.5, "x", 1), (0.1, "y", 2), None]


# --- rules and pages ----------------------------------------------------------------------------------------------

def rows_for_rules(spark):
    return spark.createDataFrame([(1, "Abc", 1.5, True), (2, "a%c", None, False), (3, None, 2.5, None), (4, "xyz", 0.0, True)], "i int, s string, d double, b boolean")


@pytest.mark.parametrize(
    "rule, want",
    [
        ({"field": "s", "operator": "contains", "value": "B"}, [1]), ({"field": "s", "operator": "contains", "value": "a%c"}, [1, 2]), ({"field": "s", "operator": "beginsWith", "value": "_"}, [1, 2, 4]),
        ({"field": "s", "operator": "!=", "value": "xyz"}, [1, 2]), ({"field": "s", "operator": "in", "value": []}, []), ({"field": "s", "operator": "notIn", "value": []}, [1, 2, 3, 4]),
        ({"field": "s", "operator": "notIn", "value": ["xyz"]}, [1, 2]), ({"field": "d", "operator": "null"}, [2]), ({"field": "d", "operator": "notNull"}, [1, 3, 4]), ({"field": "d", "operator": "between", "value": ["1", "2.5"]}, [1, 3]),
        ({"field": "b", "operator": "=", "value": "yes"}, [1, 4]), ({"field": "i", "operator": "<=", "value": "2"}, [1, 2]), ({"combinator": "or", "rules": [], "not": True}, []),
        ({"combinator": "and", "not": True, "rules": [{"field": "d", "operator": ">", "value": 1}]}, [4]), ({"field": "i", "operator": "=", "value": 1, "disabled": True}, [1, 2, 3, 4]),
    ],
)
def test_rules(spark, rule, want):
    got = rules.filter_tree(rows_for_rules(spark), {"combinator": "and", "rules": [rule, "not a rule"]})
    assert sorted(r["i"] for r in got.collect()) == want


@pytest.mark.parametrize(
    "rule",
    [
        {"field": "nope", "operator": "=", "value": 1}, {"field": "s; drop", "operator": "=", "value": 1}, {"field": "s", "operator": "~", "value": 1}, {"field": "d", "operator": "contains", "value": "1"},
        {"field": "d", "operator": "=", "value": True}, {"field": "d", "operator": "=", "value": "x"}, {"field": "b", "operator": "=", "value": "maybe"}, {"field": "d", "operator": "between", "value": [1]},
        {"field": "d", "operator": "in", "value": "1"}, {"operator": "="}, {"combinator": "xor", "rules": []},
    ],
)
def test_bad_rules(spark, rule):
    with pytest.raises(rules.RuleError):
        rules.compile_tree({"rules": [rule]}, rows_for_rules(spark).schema)


def test_rule_limits(spark):
    schema = rows_for_rules(spark).schema
    leaf = {"field": "i", "operator": "=", "value": 1}
    deep = {"rules": [leaf]}
    for _ in range(20):
        deep = {"rules": [deep]}
    rules.compile_tree(deep, schema)
    with pytest.raises(rules.RuleError):
        rules.compile_tree({"rules": [deep]}, schema)
    rules.compile_tree({"rules": [leaf] * 200}, schema)
    with pytest.raises(rules.RuleError):
        rules.compile_tree({"rules": [leaf | {"disabled": True}] * 201}, schema)


def test_pages_cover_all_rows_once(spark):
    df = spark.createDataFrame([(i % 3, i % 5, i) for i in range(40)], "a int, b int, c int")
    keys, cursor, seen = [F.col("a"), F.col("b"), F.col("c")], None, []
    while True:
        got, more = paging.split_page([tuple(r) for r in paging.page(df, keys, 7, cursor).collect()], 7)
        seen += got
        if not more:
            break
        cursor = got[-1]
    assert seen == sorted((i % 3, i % 5, i) for i in range(40))
    assert [r["c"] for r in df.filter(paging.after(keys, [2, 4])).orderBy("c").collect()] == [14, 29]
    with pytest.raises(ValueError):
        paging.after(keys, [1])


def test_gate_and_terms(spark):
    c = rules.gate([("low", F.col("x") >= 0.8), ("rare", F.col("y") >= 0.01)], passed=F.col("t"))
    assert one(spark, c, [(None, 1.0, False), (0.9, None, False), (0.9, 0.5, False), (0.0, 0.0, True)], "x double, y double, t boolean") == ["low", "rare", "pass", "pass"]
    assert one(spark, rules.surfaceable(F.col("c"), F.col("s")), [("Y", "XX"), ("Y", None), ("chrY", "XX"), ("X", "XX")], "c string, s string") == [False, True, False, True]


# --- lookups, merges ----------------------------------------------------------------------------------------------

def test_lookups_with_empty_and_null(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "i int, k string")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 5, "w"), ("c", None, "v"), (None, 1, "n")], "k string, r int, v string")
    got = lookup.join_best(left, right, ["k"], [F.col("r"), F.col("v")], ["v"])
    assert rows(got.select("i", "v")) == [(1, "w"), (2, None), (3, "v")]
    got = lookup.join_best(left, right, ["k"], [F.col("r"), F.col("v")], ["v"], F.col("_r.v") > "w")
    assert rows(got.select("i", "v")) == [(1, "x"), (2, None), (3, None)]
    assert rows(lookup.exact(left, right.limit(0), ["k"], ["v"]).select("v")) == [(None,)] * 3
    got = lookup.list_join(left, right, ["k"], ["v"], "l", [F.col("v")])
    assert {r["i"]: [x["v"] for x in r["l"]] for r in got.collect()} == {1: ["w", "x"], 2: [], 3: ["v"]}


def test_reconcile_strategies(spark):
    a = spark.createDataFrame([(1, "AG", "r1"), (2, "--", "r2"), (3, "AA", "r3"), (4, "CC", "r4"), (5, "--", "r5"), (6, "TT", "r6"), (8, "AA", "r8"), (8, "GG", "r9")], "p int, g string, n string")
    b = spark.createDataFrame([(1, "AG", "r1"), (2, "GG", "r2"), (3, "AC", "r3"), (4, "--", "x4"), (5, "??", "r5"), (7, "DD", "r7")], "p int, g string, n string")
    known = spark.createDataFrame([("x4",)], "n string")
    for strategy, three in (("flag_only", ("??", "S1=AA;S2=AC")), ("prefer_left", ("AA", "S2=AC")), ("prefer_right", ("AC", "S1=AA"))):
        got = {r["p"]: r for r in merge.reconcile(a, b, ["p"], "g", "n", strategy, G.is_no_call(F.col("g"), G.MERGE_NO_CALLS), known).collect()}
        assert {p: (r["g"], r["source"], r["concordance"]) for p, r in got.items()} == {
            1: ("AG", "both", "match"), 2: ("GG", "S2", "filled_nocall"), 3: (three[0], "both", "discordant"), 4: ("CC", "S1", "filled_nocall"), 5: ("--", "both", "match"),
            6: ("TT", "S1", "unique"), 7: ("DD", "S2", "unique"), 8: ("GG", "S1", "unique"),
        }
        assert got[3]["other_value"] == three[1] and got[4]["n"] == "x4" and got[4]["other_name"] == "r4"
    with pytest.raises(ValueError):
        merge.reconcile(a, b, ["p"], "g", "n", "coin")


def test_multiset_diff(spark, rows):
    kind = "i string, m string, t string"
    old = spark.createDataFrame([("a", "1", "x"), ("a", "1", "x"), ("a", "2", "y"), (None, "1", "z"), ("b", "1", "q")], kind)
    new = spark.createDataFrame([("a", "1", "x"), ("a", "3", "y"), (None, "1", "z"), ("c", "1", "n")], kind)
    got = rows(merge.multiset_diff(old, new, ["i"], ["m"], "t").select("state", "i", "m", "old_m"))
    assert got == sorted([("changed", "a", "3", "1"), ("removed", "a", "2", None), ("removed", "b", "1", None), ("added", "c", "1", None)], key=repr)
    assert merge.multiset_diff(old, old, ["i"], ["m"], "t").count() == 0
    assert merge.multiset_diff(old.limit(0), new, ["i"], ["m"], "t").filter("state <> 'added'").count() == 0


def test_generations(spark, tmp_path):
    root = str(tmp_path)
    merge.staged_swap(spark.range(3).toDF("x"), root, "g1")
    assert merge.current(spark, root).count() == 3
    merge.staged_swap(spark.range(5).toDF("x"), root, "g2")
    assert merge.current(spark, root).count() == 5


# --- intervals ----------------------------------------------------------------------------------------------------

def test_intervals_against_loops(spark):
    r = random.Random(3)
    ivs = [(r.choice("ab"), s := r.randrange(0, 400), s + r.randrange(0, 60), i) for i in range(60)] + [("a", 10, 10, 98), ("a", 20, 10, 99)]
    pts = [(r.choice("abc"), r.randrange(0, 470), i) for i in range(120)]
    i = spark.createDataFrame(ivs, "g string, s long, e long, w long")
    p = spark.createDataFrame(pts, "g string, t long, id long")
    got = sorted((x["id"], x["w"]) for x in intervals.points_in(p, i, "g", "t", "s", "e", 25).collect())
    assert got == sorted((n, w) for (g, t, n), (h, s, e, w) in itertools.product(pts, ivs) if g == h and s < t <= e)
    good = [x for x in ivs if x[1] <= x[2]]
    j = spark.createDataFrame(good, "g string, s long, e long, w long")
    got = sorted((x["w"], x["b_w"]) for x in intervals.overlaps(j, j, "g", "s", "e", 25).collect())
    assert got == sorted((a[3], b[3]) for a, b in itertools.product(good, good) if a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2])
    held = {(g, x) for g, s, e, _ in good for x in range(s, e)}
    got = sorted(x["id"] for x in intervals.within(p, j, "g", "t", F.lit(4), "s", "e", 25).collect())
    assert got == sorted(n for g, t, n in pts if any((g, x) in held for x in range(t - 1, t + 3)))
    flat = intervals.merge(j, "g", "s", "e").collect()
    for a, b in itertools.combinations(flat, 2):
        assert a["g"] != b["g"] or a["e"] < b["s"] or b["e"] < a["s"]


def test_lift(spark):
    chain = spark.createDataFrame([("chr1", 100, 200, "chr1", 1000, "+", 5000, 0), ("chr1", 300, 400, "chr2", 50, "-", 5000, 1)], "t_chrom string, t_start long, t_end long, q_chrom string, q_start long, strand string, q_size long, block int")
    calls = [("1", 101, "AG"), ("chr1", 200, "AG"), ("1", 201, "AG"), ("1", 301, "AC"), ("MT", 150, "A"), ("1", 301, "--")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(calls)], "i int, chrom string, pos long, genotype string")
    got = [(r["new_chrom"], r["new_pos"], r["genotype"]) for r in intervals.lift(rows, chain, genotype="genotype").orderBy("i").collect()]
    assert got[:3] == [("1", 1001, "AG"), ("1", 1100, "AG"), (None, None, "AG")]
    assert got[3] == ("2", 4950, "GT") and got[4] == (None, None, "A") and got[5] == ("2", 4950, "--")


def test_lift_only_what_is_missing(spark):
    chain = spark.createDataFrame([("1", 100, 200, "1", 1000, "+", 5000, 0)], "t_chrom string, t_start long, t_end long, q_chrom string, q_start long, strand string, q_size long, block int")
    rows = spark.createDataFrame([("1", 150, "1", 7), ("1", 150, None, None), ("2", 1, None, None)], "chrom string, pos long, new_chrom string, new_pos long")
    done, n = intervals.lift_missing(rows, chain)
    assert sorted((r["new_pos"] or 0) for r in done.collect()) == [0, 7, 1050] and tuple(n.first()) == (3, 1, 1, 1)


# --- sequences ----------------------------------------------------------------------------------------------------

def plain_runs(pos, het, gap, window, tolerance, span, least):
    out, i, n = [], 0, len(pos)
    while i < n:
        k = i + 1
        seen = [i] if het[i] else []
        while k < n and pos[k] - pos[k - 1] <= gap:
            if het[k]:
                if sum(1 for h in seen if h > k - window) >= tolerance:
                    break
                seen.append(k)
            k += 1
        hom = [j for j in range(i, k) if not het[j]]
        if len(hom) >= least and pos[hom[-1]] - pos[hom[0]] >= span:
            out.append((pos[hom[0]], pos[hom[-1]], len(hom)))
        i = k
    return out


@pytest.mark.parametrize("tolerance", [1, 2, 3])
def test_runs_against_a_plain_scan(tolerance):
    r = random.Random(tolerance)
    for _ in range(300):
        n = r.randint(0, 60)
        pos = np.cumsum([r.choice([1, 2, 3, 12]) for _ in range(n)]) if n else np.array([], int)
        het = np.array([r.random() < 0.3 for _ in range(n)], bool)
        args = (10, r.choice([2, 5, 50]), tolerance, r.choice([0, 6]), r.choice([1, 3]))
        assert sequence.scan_runs(pos, het, *args) == plain_runs(list(map(int, pos)), list(het), *args)


def test_runs_and_islands(spark):
    df = spark.createDataFrame([("1", i * 10, "AA" if i != 7 else "AG") for i in range(20)] + [("2", 5, "AA"), ("2", None, "AA")], "c string, p long, g string")
    het = F.substring("g", 1, 1) != F.substring("g", 2, 1)
    got = [tuple(r) for r in sequence.homozygous_runs(df, ["c"], "p", het, 15, 50, 1, 100, 5).collect()]
    assert got == [("1", 0, 190, 0.2, 19)]
    assert {r["c"]: r["eligible"] for r in sequence.eligible(df.filter("p is not null"), ["c"], "p", 15, 5, 100).collect()} == {"1": True, "2": False}


# --- scores -------------------------------------------------------------------------------------------------------

def test_weighted_score_paths(spark):
    g = spark.createDataFrame([(1, "r1", "1", 10, "AG"), (1, "r2", "1", 20, "--"), (1, "r9", "2", 5, "CC"), (2, "r1", "1", 10, "TC")], "sample_id int, rsid string, chrom string, pos long, genotype string")
    w = spark.createDataFrame([(1, "r1", None, None, "A", "G", 1.0), (2, "r2", "1", 20, "C", "T", 2.0), (3, None, "2", 5, "C", "A", 3.0), (4, "r7", "3", 1, "G", "A", 10.0)], "weight_id int, rsid string, chrom string, pos long, effect_allele string, other_allele string, weight double")
    i = spark.createDataFrame([(1, "3", 1, "A", "G", 0.5), (1, "1", 20, "C", "T", 1.5)], "sample_id int, chrom string, pos long, ref string, alt string, dosage double")
    got = {r["sample_id"]: r for r in scores.weighted_score(g, w).collect()}
    assert (got[1]["score"], got[1]["n_used"], got[1]["n_no_call"], got[1]["n_absent"]) == (7.0, 2, 1, 1) and (got[2]["score"], got[2]["n_matched_flip"]) == (1.0, 1)
    got = {r["sample_id"]: r for r in scores.weighted_score(g, w, imputed=i).collect()}
    assert got[1]["score"] == pytest.approx(7 + 0.5 * 10 + 0.5 * 2) and got[1]["n_imputed"] == 2 and got[1]["coverage"] == 1


def test_points(spark):
    kind = "consequence string, gene_lof boolean, gene_missense boolean, missense_z double, popmax_af double, af_alleles long, revel double"
    rows = [
        ("stop_gained", True, None, None, 1e-5, 5000, None), ("missense_variant", False, True, 3.5, None, None, 0.95), ("missense_variant", False, None, 9.0, 0.2, 5000, 0.001), ("synonymous_variant", False, None, None, 0.02, 5000, None),
        ("synonymous_variant&splice_region_variant", False, None, None, 0.02, 100, None), (None, None, None, None, None, None, None), ("splice_donor_variant", True, None, None, None, None, None),
    ]
    got = scores.classify_points(spark.createDataFrame(rows, kind), scores.variant_criteria()).collect()
    assert [(r["points"], r["classification"]) for r in got] == [
        (9, "Likely pathogenic"), (5, "Uncertain significance"), (-16, "Benign"), (-5, "Likely benign"), (0, "Uncertain significance"), (0, "Uncertain significance"), (4, "Uncertain significance")
    ]


def test_rules_of_dosage(spark):
    df = spark.createDataFrame([(2, 0), (1, 1), (1, None), (None, None), (0, 2)], "x int, y int")
    models = [{"name": "two", "match": {"x": 2}}, {"name": "both", "match": {"x": 1, "y": [1, 2]}}, {"name": "sum", "match": {"total": {"rsids": ["x", "y"], "min": 2}}, "veto": {"y": 2}}]
    d = {"x": F.col("x"), "y": F.col("y")}
    assert [r["calls"] for r in scores.classify_rules(df, d, models).collect()] == [["two"], ["both"], [], [], []]
    assert [r["calls"] for r in scores.classify_rules(df, d, models, "collect_all").collect()] == [["two", "sum"], ["both", "sum"], [], [], []]


def test_simplex_fit():
    r = np.random.default_rng(2)
    for _ in range(50):
        a, x = r.random((12, 4)), r.dirichlet([0.4] * 4)
        got = vectors.simplex_fit(a, a @ x)
        assert np.allclose(got, x, atol=1e-4)
        b = r.random(12)
        got = vectors.simplex_fit(a, b)
        best = min(np.sum((a @ p - b) ** 2) for p in r.dirichlet([1] * 4, 400))
        assert got.min() >= 0 and math.isclose(got.sum(), 1) and np.sum((a @ got - b) ** 2) <= best + 1e-6


def test_mixture_and_bounds_by_markers(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.5, 0.2]), (2, [0.5, 0.5, 0.5, 0.5])], "i int, v array<double>")
    got = vectors.mixture(df, ["i"], "v", [[1.0, 0.0, 0.5, 0.2], [0.0, 1.0, 0.5, 0.8]], ["a", "b"]).collect()
    assert {(r["i"], r["label"]): r["fraction"] for r in got} == {(1, "a"): 1.0, (1, "b"): 0.0, (2, "a"): 0.5, (2, "b"): 0.5}
    r = random.Random(6)
    n, resamples, middles = 120, 30, [[0.0, 0.0], [30.0, 5.0], [-10.0, 25.0]]
    load = [(f"m{i}", r.random() * 2, 0.0 if i % 11 == 0 else 0.5, [r.random(), r.random()]) for i in range(n)]
    dosages = [(s, f"m{i}", r.choice([0, 1, 2, None])) for s in ("x", "y") for i in range(n) if s == "x" or i % 3] + [("y", "other", 2)]
    loadings = spark.createDataFrame(load, "rsid string, mean double, sd double, load array<double>")
    points = vectors.resampled_points(spark.createDataFrame(dosages, "s string, rsid string, dosage int"), loadings, "s", "rsid", 2, resamples)
    times = np.array([[sum(int(hashlib.md5(f"{m}:{k}".encode()).hexdigest()[:8], 16) >= d for d in vectors.DRAWS) for k in range(resamples)] for m, *_ in load])
    assert abs(times.mean() - 1) < 0.05 and times.max() >= 4
    known = {(s, m): d for s, m, d in dosages}
    for s in "xy":
        z = np.array([(known[s, m] - mean) / sd if sd > 0 and known.get((s, m)) is not None else 0.0 for m, mean, sd, _ in load])
        want = (times * z[:, None]).T @ np.array([x[3] for x in load]) * (n / times.sum(0))[:, None]
        got = {r["resample"]: r["point"] for r in points.filter(F.col("s") == s).collect()}
        assert len(got) == resamples and np.allclose([got[k] for k in range(resamples)], want)
        parts = np.array([vectors.simplex_fit(np.array(middles).T, p) for p in want])
        ends = {x["label"]: (x["low"], x["high"]) for x in vectors.mixture_bounds(points.filter(F.col("s") == s), "s", middles, ["a", "b", "c"]).collect()}
        assert np.allclose([ends[c] for c in "abc"], np.percentile(parts, [2.5, 97.5], axis=0).T, atol=6e-5)


# --- panels, cohorts, callers -------------------------------------------------------------------------------------

def test_panel_status(spark):
    calls = spark.createDataFrame([(1, "r1", "GA"), (1, "r2", "--"), (2, "r1", "TT"), (2, "r4", "AA")], "sample_id int, rsid string, genotype string")
    m = "map<string,string>"
    panel = spark.createDataFrame([("p", "r1", {"AG": "Elevated", "AA": "Standard"}, 1), ("p", "r2", {"AA": "Moderate"}, 3), ("q", "r3", {}, 3), ("q", "r4", {"AA": "Elevated", "TT": "Standard"}, 3)], f"pathway string, rsid string, effects {m}, stars int")
    scored = panels.score_panel(calls, panel)
    got = {(r["sample_id"], r["rsid"]): (r["category"], r["coverage_status"]) for r in scored.collect()}
    assert got == {
        (1, "r1"): ("Moderate", "called"), (1, "r2"): (None, "no_call"), (1, "r3"): (None, "not_on_array"), (1, "r4"): (None, "not_on_array"),
        (2, "r1"): ("Standard", "called"), (2, "r2"): (None, "not_on_array"), (2, "r3"): (None, "not_on_array"), (2, "r4"): ("Indeterminate", "called"),
    }
    levels = {(r["sample_id"], r["pathway"]): r["level"] for r in panels.pathway_levels(scored).collect()}
    assert levels == {(1, "p"): "Moderate", (1, "q"): "Standard", (2, "p"): "Standard", (2, "q"): "Standard"}
    assert sorted(map(tuple, panels.panel_levels(calls, panel).collect())) == sorted(map(tuple, panels.pathway_levels(scored).collect()))


def test_two_locus_table(spark):
    t = S.as_map({"CT/CC": "e3/e4"})
    rows = [("TC", "CC"), (None, "CC"), ("--", "CC"), ("TT", "TT")]
    got = [tuple(x) for x in one(spark, panels.diplotype_pair(F.col("a"), F.col("b"), t), rows, "a string, b string")]
    assert got == [("called", "e3/e4"), ("missing", None), ("no_call", None), ("ambiguous", None)]
    assert one(spark, panels.allele_copies(F.col("x"), "A*02:01"), [(["A*02:01:01", "A*02:01"],), (["A*02:011", "A*01:01"],), ([None, None],), (None,)], "x array<string>") == [2, 0, None, None]


def test_kinship_and_sex(spark):
    r = random.Random(4)
    geno = [r.choice(["AA", "AG", "GG"]) for _ in range(600)]
    rows = [("a", i, g) for i, g in enumerate(geno)] + [("b", i, g) for i, g in enumerate(geno)] + [("c", i, r.choice(["AA", "AG", "GG"])) for i in range(600)] + [("d", 1, "AA")]
    df = spark.createDataFrame(rows, "s string, k int, g string")
    got = {(x["s"], x["s2"]): x["relationship"] for x in cohort.pair_statistic(df, "s", "k", F.substring("g", 1, 1), F.substring("g", 2, 1), least=500).collect()}
    assert got["a", "b"] == "duplicate_or_mz_twin" and got["a", "c"] == "unrelated" and got["a", "d"] == "indeterminate"
    calls = []
    for s, xs, y in (("xx", ["AG"] * 40 + ["AA"] * 80, "--"), ("xy", ["A"] * 120, "A"), ("xxy", ["AG"] * 40 + ["AA"] * 80, "A"), ("thin", ["A"] * 99, "A"), ("grey", ["AG"] * 12 + ["AA"] * 108, "--")):
        calls += [(s, "X", 5_000_000 + i, g) for i, g in enumerate(xs)] + [(s, "X", 100_000, "AG")] * 30 + [(s, "Y", i, y) for i in range(60)]
    got = {x["s"]: (x["sex"], x["aneuploidy"]) for x in cohort.infer_sex(cohort.sex_signals(spark.createDataFrame(calls, "s string, chrom string, pos long, genotype string"), "s")).collect()}
    assert got == {"xx": ("XX", "no_aneuploidy_signal"), "xy": ("XY", "no_aneuploidy_signal"), "xxy": ("manual_review", "possible_xxy"), "thin": ("unknown", "indeterminate"), "grey": ("manual_review", "manual_review")}


def test_greedy_alleles(spark):
    """One gene; each case is the calls of a sample as copies of G at r1, r2, r3."""
    v = lambda *k: [{"rsid": f"r{x}", "ref": "A", "alt": "G"} for x in k]
    named = [("*1", []), ("*2", v(1)), ("*3", v(1, 2)), ("*10", v(3)), ("*20", v(4))]
    alleles = spark.createDataFrame([("G", n, x) for n, x in named], "gene string, allele_name string, defining_variants array<struct<rsid:string,ref:string,alt:string>>")
    spelled = {0: "AA", 1: "AG", 2: "GG", None: "--"}
    cases = {
        "both": ((1, 1, 0, 0), ("*1/*3", "Complete", 0, False)), "two": ((2, 1, 0, 0), ("*2/*3", "Complete", 0, False)), "other": ((1, 0, 1, 0), ("*2/*10", "Complete", 0, False)),
        "part": ((1, None, None, None), ("*1/*2", "Partial", 0, False)), "none": ((None,) * 4, ("*1/*1", "Insufficient", 0, False)),
        "crowded": ((2, 0, 1, 0), ("*2/*10", "Insufficient", 1, True)), "poor": ((2, 0, 0, 0), ("*2/*2", "Complete", 0, False)), "leftover": ((0, 1, 0, 0), ("*1/*1", "Complete", 1, False)), "uncallable": ((1, 0, 0, 1), ("*1/*2", "Complete", 1, False)),
    }
    calls = [(c, f"r{i}", spelled[n]) for c, (copies, _) in cases.items() for i, n in enumerate(copies, 1)]
    rows = spark.createDataFrame(calls, "sample_id string, rsid string, genotype string")
    pheno = spark.createDataFrame([("G", "*2/*2", "Poor")], "gene string, diplotype string, phenotype string")
    got = {r["sample_id"]: r for r in callers.star_alleles(rows, alleles, pheno, uncallable=["*20"]).collect()}
    assert {c: tuple(got[c][k] for k in ("diplotype", "confidence", "residual_variants", "crowded_out")) for c in cases} == {c: want for c, (_, want) in cases.items()}
    assert got["poor"]["phenotype"] == "Poor" and got["both"]["phenotype"] is None


def test_guards_withhold_a_node():
    n = callers.Node
    tree = n("r", (), [n("A", (("1", "G"),), [n("A1", (("3", "G"),), guards=(("9", "T"),))]), n("B", (("6", "G"), ("7", "G")))])
    a, b = {"A": (1, 0, 1, False)}, {"B": (1, 0, 2, False)}
    assert callers.walk(tree, a | {"A1": (1, 0, 1, True)}) == ["r", "A"] and callers.walk(tree, a | {"A1": (1, 0, 1, False)}) == ["r", "A", "A1"]
    assert callers.walk(tree, {"A": (1, 0, 1, True)} | b) == ["r"]  # the guarded child would have come first
    assert callers.walk(tree, {"A": (1, 0, 1, False), "B": (1, 0, 2, True)}) == ["r", "A"]  # a guarded child that loses


def test_runs_in_linear_time_as_by_the_rule():
    """The scan against the rule read literally, and ten times the sites in about ten times the time."""
    def plain(pos, het, gap, window, tolerance, span, least):
        out, at = [], 0
        while at < len(pos):
            stop, seen = at, []
            while stop < len(pos) and not (stop > at and pos[stop] - pos[stop - 1] > gap):
                if het[stop]:
                    seen = [x for x in seen if stop - x < window] + [stop]
                    if len(seen) > tolerance:
                        break
                stop += 1
            stop = max(stop, at + 1)
            hom = [i for i in range(at, stop) if not het[i]]
            if len(hom) >= least and pos[hom[-1]] - pos[hom[0]] >= span:
                out.append((int(pos[hom[0]]), int(pos[hom[-1]]), len(hom)))
            at = stop
        return out

    r = np.random.default_rng(2)
    for tolerance in (0, 1, 2):
        for _ in range(40):
            pos, het = np.cumsum(r.integers(1, 30, 200)), r.random(200) < r.choice([0.02, 0.1, 0.4])
            assert sequence.scan_runs(pos, het, 25, 12, tolerance, 60, 5) == plain(pos, het, 25, 12, tolerance, 60, 5)
    took = []
    for n in (20_000, 200_000):
        pos, het = np.arange(n) * 10, np.arange(n) % 7 == 0
        began = time.perf_counter()
        sequence.scan_runs(pos, het, 1000, 50, 1, 100, 5)
        took.append(time.perf_counter() - began)
    assert took[1] < 25 * took[0] + 0.2


def test_normal_cdf(spark):
    z = [x / 8 for x in range(-320, 321)] + [None, float("nan"), float("inf"), float("-inf")]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", S.normal_cdf(F.col("z")).alias("p")).collect()
    for r in got:
        if r["z"] is None or r["z"] != r["z"]:
            assert r["p"] is None
        else:
            assert abs(r["p"] - 0.5 * math.erfc(-r["z"] / math.sqrt(2))) < 1e-14


def test_z_score_far_from_zero(spark):
    rows = [("a", 1e9 + x) for x in (1.0, 2.0, 4.0, 7.0)] + [("b", 1.0), (None, 3.0), (None, 4.0), (None, 5.0), (None, 5.5), ("a", None)]
    got = {r["v"]: r["z"] for r in scores.z_score(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    others = [2.0, 4.0, 7.0]
    mean = sum(others) / 3
    assert abs(got[1e9 + 1] - (1 - mean) / math.sqrt(sum((x - mean) ** 2 for x in others) / 2)) < 1e-6
    assert got[1.0] is None and got[None] is None and got[3.0] < -1


def test_tree_walk():
    n = callers.Node
    tree = n("r", (), [n("A", (("1", "G"), ("2", "G")), [n("A1", (("3", "G"),)), n("A2", (("4", "G"), ("5", "G")))]), n("B", (("6", "G"),)), n("P", (("9", "G"),), [n("P1", (("7", "G"), ("8", "G"), ("10", "G")))])])
    assert callers.walk(tree, {"A": (2, 0, 2), "A1": (1, 0, 1), "A2": (2, 0, 2)}) == ["r", "A", "A2"]
    assert callers.walk(tree, {"A": (1, 1, 2), "B": (1, 0, 1)}) == ["r", "B"]
    untyped = {"P": (0, 0, 1), "P1": (3, 0, 3)}
    assert callers.walk(tree, untyped) == ["r"] and callers.walk(tree, untyped, callers.Descent(passable=frozenset({"9"}))) == ["r", "P", "P1"]
    assert callers.walk(tree, {}) == ["r"]


def plain_walk(node, counts, rules, seen=frozenset()):
    """The rules read literally, each child's way walked anew: (names, [(present, own markers)])."""
    seen = seen | {m for m, _ in node.markers}
    value = lambda s: (sum(a for a, _ in s), sum(a for a, _ in s) / sum(b for _, b in s) if sum(b for _, b in s) else 0.0, sum(b > 0 for _, b in s))

    def pick(children):
        direct, passed = None, []
        for c in children:
            own = [m for m, _ in c.markers if m not in seen]
            n, bad, *_ = counts.get(c.name, (0, 0, 0))
            if not own:
                passed.append((c, 0, 0))
            elif not bad and not n and c.children and set(own) & rules.passable:
                passed.append((c, 0, len(own)))
            elif not bad and n and n / len(own) >= rules.fraction:
                if c.children and len(own) < rules.floor and not (len(own) == 1 and own[0] in rules.trusted):
                    passed.append((c, n, len(own)))
                elif direct is None or (n / len(own), n) > direct[0]:
                    direct = ((n / len(own), n), c, len(own))
        out = (None, [], [])
        if direct:
            names, support = plain_walk(direct[1], counts, rules, seen)
            out = (direct[1].name, [direct[1].name, *names], [(direct[0][1], direct[2]), *support])
        for c, n, total in passed:
            names, support = plain_walk(c, counts, rules, seen)
            way = [(n, total), *support]
            if names and not (counts[c.name][4] if c.name in counts else 0) and (out[0] is None or value(way) > value(out[2])):
                out = (c.name, [c.name, *names], way)
        return out

    guarded = {c.name for c in node.children if c.name in counts and counts[c.name][3]}
    first = pick(node.children)
    if first[0] in guarded:
        return [], []
    return pick([c for c in node.children if c.name not in guarded])[1:]


def test_support_ranked_descent():
    r = random.Random(12)
    for _ in range(400):
        names = iter(range(1000))
        marks = [f"m{i}" for i in range(12)]

        def grow(depth):
            own = tuple((m, "G") for m in r.sample(marks, r.choice([0, 1, 1, 2, 3])))  # noqa: B023
            return callers.Node(f"n{next(names)}", own, [grow(depth - 1) for _ in range(r.choice([0, 1, 2, 3]) if depth else 0)])  # noqa: B023

        root = grow(4)
        typed = {m: r.choice([True, True, True, False, None]) for m in marks}
        rules = callers.Descent(floor=r.choice([1, 2]), trusted=frozenset(r.sample(marks, 2)), passable=frozenset(r.sample(marks, 4)))
        counts, stack = {}, [(root, frozenset())]
        while stack:
            node, above = stack.pop()
            own = [m for m, _ in node.markers if m not in above]
            state = lambda ms, x: sum(typed[m] is x for m in ms)  # noqa: B023, E731
            counts[node.name] = (state(own, True), state(own, False), len(own), r.random() < 0.1, state([m for m, _ in node.markers], False))
            stack += [(c, above | {m for m, _ in node.markers}) for c in node.children]
        assert callers.walk(root, counts, rules) == [root.name, *plain_walk(root, counts, rules)[0]]


def test_facets_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert facets.facet(empty, "k").count() == 0 and facets.histogram(empty, "v", 1.0, F.col("k"), ["a"]).count() == 0
    m = facets.genotype_metrics(spark.createDataFrame([], "g string"), F.col("g"), F.lit(True), F.lit(True)).first()
    assert tuple(m) == (None, None, None)
    two = spark.createDataFrame([("a", 1.0), (None, 2.0), ("a", None)], "k string, v double")
    assert [tuple(r) for r in facets.facet(two, "k").collect()] == [("a", 2), ("unknown", 1)] and facets.facet(two, "k", None).count() == 1


# --- ordered scans ------------------------------------------------------------------------------------------------

def test_one_group_of_all_rows_is_dealt_to_many_pieces(spark):
    df = spark.createDataFrame([("g", i) for i in range(4000)], "g string, i long")
    rows = ordered.pieces(df, ["g"], ["i"])
    sizes = [r["count"] for r in rows.groupBy(ordered.PIECE).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    got = ordered.before(rows, most=(F.max, F.col("i")), total=(F.sum, F.lit(1)), least=(F.min, -F.col("i"))).orderBy("i").collect()
    assert [r["most"] for r in got] == [None, *range(3999)] and [r["total"] for r in got] == [None, *range(1, 4000)] and [r["least"] for r in got] == [None, *range(0, -3999, -1)]
    assert all(r["i"] == r["_n"] for r in ordered.numbered(rows).collect())
    same = spark.createDataFrame([(None, 1)] * 400 + [("a", None)] * 7, "g string, i long")
    assert ordered.pieces(same, ["g"], ["i"], salted=True).select(f"{ordered.PIECE}.number").distinct().count() > 1
    numbers = ordered.numbered(ordered.pieces(same, ["g"], ["i"], salted=True)).groupBy("g").agg(F.sort_array(F.collect_list("_n")).alias("n")).collect()
    assert {r["g"]: r["n"] for r in numbers} == {None: list(range(400)), "a": list(range(7))}
    assert ordered.numbered(ordered.pieces(df.limit(0), ["g"], ["i"])).count() == 0


def plain_merge(rows):
    out = []
    for g, s, e in sorted(rows, key=lambda r: (r[0] is not None, r)):
        if out and out[-1][0] == g and s <= out[-1][2]:
            out[-1] = (g, out[-1][1], max(e, out[-1][2]), out[-1][3] + 1)
        else:
            out.append((g, s, e, 1))
    return sorted(out, key=repr)


def test_merge_islands_and_runs_over_pieces(spark, rows):
    r = random.Random(2)
    data = [("a", s, s + r.choice([1, 5, 40])) for s in (r.randrange(9000) for _ in range(900))] + [("a", 0, 9500)] * 2 + [(None, i * 3, i * 3 + 3) for i in range(300)] + [("b", 5, 5)]
    df = spark.createDataFrame(data, "g string, s long, e long")
    assert rows(intervals.merge(df, "g", "s", "e").select("g", "s", "e", "n")) == plain_merge(data)
    assert rows(intervals.merge(df.filter("e < 9500"), "g", "s", "e").select("g", "s", "e", "n")) == plain_merge([x for x in data if x[2] < 9500])
    pos = sorted({r.randrange(20000) for _ in range(3000)})
    sites = [("x", p, r.random() < 0.1) for p in pos]
    df = spark.createDataFrame(sites, "c string, p long, h boolean")
    for gap, window, span, least in ((30, 20, 50, 3), (1000, 10, 0, 1), (5, 50, 0, 2)):
        want = [("x", s, e, round((e - s) / 1000, 1), n) for s, e, n in sequence.scan_runs(np.array(pos), np.array([h for *_, h in sites]), gap, window, 1, span, least)]
        assert rows(sequence.homozygous_runs(df, ["c"], "p", F.col("h"), gap, window, 1, span, least)) == sorted(want, key=repr)
        want = [("x", s, e, round((e - s) / 1000, 1), n) for s, e, n in sequence.scan_runs(np.array(pos), np.array([h for *_, h in sites]), gap, window, 2, span, least)]
        assert rows(sequence.homozygous_runs(df, ["c"], "p", F.col("h"), gap, window, 2, span, least)) == sorted(want, key=repr)
    got = sequence.islands(df, ["c"], "p", 9).orderBy("p").collect()
    assert [r["island"] for r in got] == list(1 + np.cumsum([0, *(b - a > 9 for a, b in zip(pos, pos[1:]))]))


def test_multiset_diff_with_many_copies(spark, rows):
    old = [("i", "a", "t")] * 50 + [("i", "b", f"u{k}") for k in range(60)]
    new = [("i", "a", "t")] * 20 + [("i", "c", f"v{k}") for k in range(70)] + [("i", "b", "u0")]
    kind = "i string, m string, t string"
    got = merge.multiset_diff(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), ["i"], ["m"], "t")
    assert {r["state"]: r["count"] for r in got.groupBy("state").count().collect()} == {"changed": 70, "removed": 19}
    pairs = sorted((r["t"], r["old_m"]) for r in got.filter("state = 'changed'").collect())
    left = [("t", "a")] * 30 + [(f"u{k}", "b") for k in sorted(range(60), key=lambda k: f"u{k}")[1:]]
    assert pairs == sorted(zip((f"v{k}" for k in sorted(range(70), key=lambda k: f"v{k}")), (m for _, m in left[:70])))


def test_kinship_by_bit_planes(spark):
    """Many groups of samples and several blocks of markers against plain counts."""
    r = random.Random(7)
    letters = [r.sample("ACGT", r.choice([2, 2, 2, 3])) for _ in range(300)]
    calls = {s: {m: "".join(r.choice(letters[m]) for _ in "xy") for m in range(300) if r.random() < 0.8} for s in range(9)}
    calls[9] = {1: "--", 2: "A", 400: "AA"}
    data = [(s, f"m{m}", g) for s, own in calls.items() for m, g in own.items()] + [(0, "m1", "ZZ"), (3, None, "AA")]
    df = spark.createDataFrame(data, "s long, k string, g string")
    got = {(x["s"], x["s2"]): tuple(x[c] for c in ("n_shared", "het_i", "het_j", "hethet", "ibs0")) for x in cohort.pair_statistic(df, "s", "k", F.substring("g", 1, 1), F.substring("g", 2, 1), group_size=3).collect()}
    want = {}
    for a, b in itertools.combinations(range(9), 2):
        both = [(calls[a][m], calls[b][m]) for m in calls[a].keys() & calls[b].keys()]
        het = lambda g: g[0] != g[1]
        want[a, b] = (len(both), sum(het(x) for x, _ in both), sum(het(y) for _, y in both), sum(het(x) and het(y) for x, y in both), sum(not het(x) and not het(y) and x != y for x, y in both))
    assert got == want


def test_a_draw_takes_one_digest(spark):
    """The digest of a marker and a resample is taken once, not for each place of the distribution it is compared with."""
    plan = spark.range(3).select(vectors.draws(F.col("id"), 4).alias("d"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1


def test_nearest_neighbours_of_odd_vectors(spark):
    """Against all pairs: copies, ties, repeated ids, NaN, infinity, null vectors and components, other lengths; no distance comes last."""
    r = random.Random(4)
    base = [[float(r.randint(-3, 3)) for _ in range(3)] for _ in range(25)]
    odd = [None, [1.0, None, 2.0], [float("nan"), 0.0, 1.0], [float("inf"), 0.0, 0.0], [1.0], [], [1e200, 0.0, 0.0], [1e-9, 0.0, 0.0]]
    vectors_ = base + base[:3] * 8 + odd * 2
    table = [(i if i % 17 else 5, v, i % 4) for i, v in enumerate(vectors_)] + [(None, base[0], 9)]
    df = spark.createDataFrame(table, "id long, v array<double>, label int")

    def far(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return (2, 0.0)
        d = 0.0
        for x, y in zip(a, b, strict=True):
            d += (x - y) * (x - y)
        return (1, 0.0) if d != d else (0, d)

    for k, parts in ((1, 1), (4, 3), (200, 2)):
        want = {}
        for q in {t[0] for t in table if t[0] is not None}:
            all_of = sorted((far(v, w), i, label) for j, v, _ in table if j == q for i, w, label in table if i is not None and i != q)[:k]
            for *_, label in all_of:
                want[q, label] = want.get((q, label), 0) + 1 / len(all_of)
        got = {(x["id"], x["label"]): x["share"] for x in vectors.knn_vote(df, df, "id", "id", "v", "label", k, parts).collect()}
        assert got == pytest.approx(want), (k, parts)


def test_grid_deals_both_sides(spark):
    """One row of left met all of right in one task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        right = spark.range(2000).select(F.col("id").alias("r"), F.create_map(F.lit("k"), "id").alias("m"))
        for n, least in ((1, 2), (7, 4)):
            got = lookup.grid(spark.range(n), right, 16).select("id", "r", F.spark_partition_id().alias("p")).collect()
            assert sorted((x["id"], x["r"]) for x in got) == [(i, j) for i in range(n) for j in range(2000)]
            assert len({x["p"] for x in got}) >= least
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
