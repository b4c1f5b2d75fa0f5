"""Callers with state along a group: greedy star alleles and descent of a marker tree."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions import genotype as G
from loomframe.operators import lookup


def _star_order(name: Column) -> Column:
    """Numeric order of star alleles, others behind them by name."""
    number = F.regexp_extract(name, r"^\*(\d+)", 1)
    return F.struct((number == "").alias("a"), number.try_cast("int").alias("b"), name.alias("c"))


def gene_tables(alleles: DataFrame, uncallable: Sequence[str] = ()) -> DataFrame:
    """A row a gene: variants (the different defining ones), reference (the first allele without any, else *1) and marked: the
    others with the places of their variants, most variants first, and whether the array can call them."""
    own = alleles.withColumn("_callable", ~F.col("allele_name").isin(*uncallable) if uncallable else F.lit(True))
    entry = F.struct((-F.size("defining_variants")).alias("order"), F.col("allele_name").alias("name"), F.col("_callable").alias("callable"), F.col("defining_variants").alias("v"))
    plain = F.min(F.when((F.size("defining_variants") == 0) & F.col("_callable"), F.struct(_star_order(F.col("allele_name")).alias("o"), F.col("allele_name").alias("name"))))
    found = own.groupBy("gene").agg(F.sort_array(F.collect_list(F.when(F.size("defining_variants") > 0, entry))).alias("m"), F.coalesce(plain["name"], F.lit("*1")).alias("reference"))
    found = found.withColumn("variants", F.array_sort(F.array_distinct(F.flatten(F.transform("m", lambda a: a["v"])))))
    places = lambda a: F.transform(a["v"], lambda v: F.array_position(F.col("variants"), v).cast("int") - 1)
    return found.select("gene", "reference", "variants", F.transform("m", lambda a: F.struct(a["name"].alias("name"), a["callable"].alias("callable"), places(a).alias("at"))).alias("marked"))


def star_alleles(genotypes: DataFrame, alleles: DataFrame, diplotypes: DataFrame, sample: str = "sample_id", uncallable: Sequence[str] = ()) -> DataFrame:
    """sample, gene, diplotype, confidence, phenotype, residual_variants, crowded_out.

    genotypes: sample, rsid, genotype; alleles: gene, allele_name, defining_variants; diplotypes: gene, diplotype,
    phenotype; uncallable: alleles that an array cannot call. Alleles with most defining variants take ALT copies first,
    two alleles at most, and the reference fills the rest. residual_variants counts the variants of which a copy is left
    that no allele took. If both places are taken and an allele still has a copy of each of its variants, it was crowded
    out: no pair of alleles accounts for the copies, and the confidence is Insufficient.

    One gene of one sample is a row with arrays as long as the gene's variants; the greedy pass is a fold over its alleles.
    """
    genes = gene_tables(alleles, uncallable)
    v = alleles.select("gene", F.explode("defining_variants").alias("v")).distinct()
    calls = genotypes.groupBy(sample, "rsid").agg(F.min("genotype").alias("_g"))
    n = G.risk_dosage(F.col("_g"), F.col("v.alt"), F.col("v.ref"))
    own = calls.join(v.withColumn("rsid", F.col("v.rsid")), "rsid").select(sample, "gene", F.struct("v", n.alias("n")).alias("c"))
    own = own.groupBy(sample, "gene").agg(F.map_from_entries(F.collect_list("c")).alias("_copies"))
    rows = lookup.grid(genotypes.select(sample).distinct(), genes).join(own, [sample, "gene"], "left")
    known = F.transform("variants", lambda x: F.try_element_at("_copies", x))
    rows = rows.withColumn("_known", F.coalesce(known, F.transform("variants", lambda x: F.lit(None).cast("int"))))
    left = F.transform("_known", lambda x: F.coalesce(x, F.lit(0)))
    start = F.struct(left.alias("left"), F.array().cast("array<string>").alias("called"))

    def take(state: Column, a: Column) -> Column:
        held = F.array_min(F.transform(a["at"], lambda i: F.get(state["left"], i)))
        n = F.when(a["callable"], F.greatest(F.lit(0), F.least(2 - F.size(state["called"]), held))).otherwise(F.lit(0))
        rest = F.transform(state["left"], lambda x, i: F.when(F.array_contains(a["at"], i), x - n).otherwise(x))
        return F.struct(rest.alias("left"), F.concat(state["called"], F.array_repeat(a["name"], n)).alias("called"))

    rows = rows.withColumn("_s", F.aggregate("marked", start, take))
    whole = lambda a: a["callable"] & F.forall(a["at"], lambda i: F.get(F.col("_s.left"), i) > 0)
    rows = rows.withColumns({"residual_variants": F.size(F.filter("_s.left", lambda x: x > 0)), "crowded_out": (F.size("_s.called") == 2) & F.exists("marked", whole)})
    pair = F.slice(F.concat("_s.called", F.array_repeat("reference", 2)), 1, 2)
    pair = F.transform(F.array_sort(F.transform(pair, lambda x: F.struct(_star_order(x).alias("o"), x.alias("name")))), lambda x: x["name"])
    seen = F.size(F.filter("_known", lambda x: x.isNotNull()))
    confidence = F.when(F.col("crowded_out") | ((seen == 0) & (F.size("variants") > 0)), "Insufficient").when(seen == F.size("variants"), "Complete").otherwise("Partial")
    called = rows.select(sample, "gene", F.array_join(pair, "/").alias("diplotype"), confidence.alias("confidence"), "residual_variants", "crowded_out")
    out = called.join(diplotypes.select("gene", "diplotype", "phenotype"), ["gene", "diplotype"], "left")
    return out.select(sample, "gene", "diplotype", "confidence", "phenotype", "residual_variants", "crowded_out")


def guideline_rows(calls: DataFrame, guidelines: DataFrame, sample: str = "sample_id") -> DataFrame:
    """calls joined to guidelines (gene, phenotype, activity_score or null, drug, classification); a row for the score replaces the generic one of its drug."""
    own = calls.filter("phenotype is not null and confidence <> 'Insufficient'")
    score = F.col("activity_score") if "activity_score" in calls.columns else F.lit(None).cast("double")
    own = own.withColumn("_score", score).drop("activity_score")
    g = guidelines.withColumnRenamed("activity_score", "_g")
    hit = own.join(g, ["gene", "phenotype"]).filter(F.col("_g").isNull() | (F.col("_g") == F.col("_score")))
    rest = [c for c in hit.columns if c not in (sample, "gene", "drug")]
    best = hit.groupBy(sample, "gene", "drug").agg(F.min_by(F.struct(*rest), F.struct(F.col("_g").isNull(), F.col("classification"))).alias("_r"))
    return best.select(sample, "gene", "drug", *[F.col(f"_r.{c}").alias(c) for c in rest if not c.startswith("_")])


@dataclass
class Node:
    """markers: (marker, derived allele) that lead to the node; guards: such that veto it where they are typed and not derived."""

    name: str
    markers: tuple[tuple[str, str], ...] = ()
    children: list[Node] = field(default_factory=list)
    guards: tuple[tuple[str, str], ...] = ()


def flatten(root: Node) -> list[tuple[str, str, str, bool, bool]]:
    """node, marker, derived allele, whether the marker is the node's own and not an ancestor's, whether it is a guard."""
    out, stack = [], [(root, frozenset())]
    while stack:
        node, above = stack.pop()
        out += [(node.name, m, a, m not in above, False) for m, a in node.markers]
        out += [(node.name, m, a, True, True) for m, a in node.guards]
        stack += [(c, above | {m for m, _ in node.markers}) for c in node.children]
    return out


def marker_counts(genotypes: DataFrame, root: Node, sample: str = "sample_id") -> DataFrame:
    """sample, node and counts: present (derived allele seen) and conflicting of the node's own markers, all_present and
    all_conflicting of those that it repeats of its ancestors too; guarded: a guard is typed and not purely derived.

    Only nodes of which the sample has a marker. The tree's markers go to the genotypes, which are broadcast if Spark finds
    them small.
    """
    kinds = "node string, rsid string, allele string, own boolean, guard boolean"
    rows = genotypes.sparkSession.createDataFrame(flatten(root), kinds)
    called = genotypes.groupBy(sample, "rsid").agg(F.min("genotype").alias("g"))
    x = called.join(rows, "rsid")
    typed = ~G.is_no_call(F.col("g"))
    seen = F.contains(F.upper("g"), F.upper("allele"))
    pure = F.replace(F.upper("g"), F.upper("allele"), F.lit("")) == ""
    marker = typed & ~F.col("guard")
    counts = {"present": marker & F.col("own") & seen, "conflicting": marker & F.col("own") & ~seen, "all_present": marker & seen, "all_conflicting": marker & ~seen}
    return x.groupBy(sample, "node").agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.bool_or(typed & F.col("guard") & ~pure).alias("guarded"))


@dataclass(frozen=True)
class Descent:
    """Rules of a descent. fraction: of a node's own markers that have to be present. floor: own markers without which an inner
    node is no result but may be passed through, unless its only marker is in trusted. passable: markers whose node may be
    passed through where none of its own is typed."""

    fraction: float = 0.5
    floor: int = 1
    trusted: frozenset[str] = frozenset()
    passable: frozenset[str] = frozenset()


@dataclass(frozen=True)
class _Plan:
    """A tree in order from the leaves up: name, children, number of own and all markers, and whether it is trusted or passable."""

    steps: list[tuple[str, list[str], int, int, bool, bool]]

    @classmethod
    def of(cls, root: Node, rules: Descent) -> _Plan:
        own, every = Counter(), Counter()
        special: dict[str, set[str]] = {}
        for node, marker, _, is_own, guard in flatten(root):
            if not guard:
                every[node] += 1
                own[node] += is_own
                if is_own:
                    special.setdefault(node, set()).add(marker)
        steps, stack = [], [root]
        while stack:
            node = stack.pop()
            marks = special.get(node.name, set())
            steps.append((node.name, [c.name for c in node.children], own[node.name], every[node.name], bool(marks & rules.trusted), bool(marks & rules.passable)))
            stack += node.children
        return cls(steps[::-1])


Way = tuple[list[str], int, int, int]  # names below a node, and over them: own markers present, own markers, nodes that have some


def _score(way: Way) -> tuple[int, float, int]:
    _, present, total, depth = way
    return present, present / total if total else 0.0, depth


def walk(root: Node, counts: Mapping[str, tuple], rules: Descent = Descent(), plan: _Plan | None = None) -> list[str]:
    """Names from the root down the best supported way.

    counts: node -> present and conflicting own markers, own markers, and perhaps whether a guard speaks against the node, and
    conflicting markers with repeated ones.

    One pass from the leaves up keeps each node's best way below it. Among a node's children that nothing contradicts, the
    one with the greatest share of own markers (then the most, then the first) is the direct candidate. Children that
    only repeat markers of their ancestors, sparse inner nodes and passable ones count if their way goes on below them.
    Candidates are compared by present markers, their share and the number of nodes that have some. A guard withholds its
    node: if that node would come first, the way ends above it; if it would not, it is left out.
    """
    plan = plan or _Plan.of(root, rules)
    below: dict[str, Way | None] = {}
    static = {name: (bool(inner), total, trusted, passable) for name, inner, total, _, trusted, passable in plan.steps}

    def best(children: list[str]) -> tuple[str | None, Way | None]:
        direct, passed = None, []
        for c in children:
            n, bad, _, *more = counts.get(c, (0, 0, 0))
            inner, total, trusted, passable = static[c]
            if not total:
                passed.append((c, 0, 0))
            elif bad:
                continue
            elif not n:
                if inner and passable:
                    passed.append((c, 0, total))
            elif n / total >= rules.fraction:
                if inner and total < rules.floor and not (trusted and total == 1):
                    passed.append((c, n, total))
                elif direct is None or (n / total, n) > direct[0]:
                    direct = ((n / total, n), c, n, total)
        found: tuple[str | None, Way | None] = (None, None)
        if direct:
            _, c, n, total = direct
            names, p, t, d = below[c] or ([], 0, 0, 0)
            found = c, ([c, *names], n + p, total + t, 1 + d)
        for c, n, total in passed:
            _, bad, _, *more = counts.get(c, (0, 0, 0))
            if below[c] is None or (more[1] if len(more) > 1 else bad):
                continue
            names, p, t, d = below[c]
            way = [c, *names], n + p, total + t, d + (total > 0)
            if found[1] is None or _score(way) > _score(found[1]):
                found = c, way
        return found

    guarded = lambda c: bool(len(counts.get(c, ())) > 3 and counts[c][3])
    for name, children, *_ in plan.steps:
        first, way = best(children)
        if first is not None and guarded(first):
            way = None
        elif any(guarded(c) for c in children):
            _, way = best([c for c in children if not guarded(c)])
        below[name] = way
    return [root.name, *(below[root.name] or ([],))[0]]


def descend(genotypes: DataFrame, root: Node, sample: str = "sample_id", rules: Descent = Descent()) -> DataFrame:
    """sample, haplogroup, path and confidence (present of all markers of the path's nodes; null without one). The walk runs per sample over its node counts."""
    plan = _Plan.of(root, rules)
    own, every = {n: t for n, _, t, *_ in plan.steps}, {n: t for n, _, _, t, *_ in plan.steps}
    names = ("node", "present", "conflicting", "guarded", "all_present", "all_conflicting")
    met = marker_counts(genotypes, root, sample).groupBy(sample).agg(F.collect_list(F.struct(*names)).alias("c"))
    counts = genotypes.select(sample).distinct().join(met, sample, "left")
    kind = counts.schema[sample].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for s, c in zip(pdf[sample], pdf["c"], strict=True):
                rows = {x["node"]: x for x in (c if c is not None else ())}
                path = walk(root, {n: (int(x["present"]), int(x["conflicting"]), own[n], bool(x["guarded"]), int(x["all_conflicting"])) for n, x in rows.items()}, rules, plan)
                n, total = sum(int(rows[p]["all_present"]) for p in path if p in rows), sum(every[p] for p in path)
                out.append((s, path[-1], path, n / total if total else None))
            yield pd.DataFrame(out, columns=[sample, "haplogroup", "path", "confidence"])

    return counts.mapInPandas(run, f"`{sample}` {kind}, haplogroup string, path array<string>, confidence double")
