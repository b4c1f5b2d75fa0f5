"""Panels: categories looked up by genotype, probe and alias reads, gene panels and cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions import genotype as G
from loomframe.operators import lookup

#: Categories from low to high.
LEVELS = ("Standard", "Moderate", "Elevated")


def _rank(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), c).cast("int"), F.lit(0))


def _category(star_least: int) -> Column:
    """The category of a called entry from _g, effects and stars."""
    hit = G.lookup(F.col("effects"), F.col("_g"))
    category = F.when(G.strand_ambiguous(F.col("effects"), F.col("_g")), "Indeterminate").when(hit.isNull(), "Indeterminate")
    return category.when((hit == "Elevated") & (F.col("stars") < star_least), "Moderate").otherwise(hit)


def score_panel(samples: DataFrame, panel: DataFrame, sample: str = "sample_id", key: str = "rsid", genotype: str = "genotype", star_least: int = 2) -> DataFrame:
    """A row for each sample and panel entry: category and coverage_status. For counts alone panel_levels makes far fewer rows.

    panel: pathway, key, effects (map of genotype to category), stars. category is Indeterminate for a strand-ambiguous
    call and for a call that the map has in no spelling; Elevated is capped to Moderate below star_least stars.
    """
    grid = lookup.grid(samples.select(sample).distinct(), panel)
    own = samples.groupBy(sample, key).agg(F.min(genotype).alias("_g"), F.lit(True).alias("_on"))
    rows = grid.join(own, [sample, key], "left")
    called = ~G.is_no_call(F.col("_g"))
    status = F.when(F.col("_on").isNull(), "not_on_array").when(~called, "no_call").otherwise("called")
    return rows.select(sample, "pathway", key, F.col("_g").alias(genotype), F.when(called & F.col("_on"), _category(star_least)).alias("category"), status.alias("coverage_status"))


def pathway_levels(scored: DataFrame, sample: str = "sample_id") -> DataFrame:
    """The highest category among a pathway's called entries (Standard if none stands out) and counts a status."""
    rank = F.max(F.when(F.col("coverage_status") == "called", _rank(F.col("category"))))
    level = F.get(F.array(*[F.lit(x) for x in LEVELS]), F.greatest(F.coalesce(rank, F.lit(1)), F.lit(1)) - 1)
    return scored.groupBy(sample, "pathway").agg(level.alias("level"), *[F.count_if(F.col("coverage_status") == s).alias(f"n_{s}") for s in ("called", "no_call", "not_on_array")])


def panel_levels(samples: DataFrame, panel: DataFrame, sample: str = "sample_id", key: str = "rsid", genotype: str = "genotype", star_least: int = 2) -> DataFrame:
    """pathway_levels(score_panel(...)), from the calls that samples have: what they lack is counted from a pathway's total."""
    own = samples.groupBy(sample, key).agg(F.min(genotype).alias("_g")).join(panel, key)
    called = ~G.is_no_call(F.col("_g"))
    met = own.groupBy(sample, "pathway").agg(F.max(F.when(called, _rank(_category(star_least)))).alias("_r"), F.count_if(called).alias("_called"), F.count("*").alias("_on"))
    every = lookup.grid(samples.select(sample).distinct(), panel.groupBy("pathway").agg(F.count("*").alias("_all")))
    rows = every.join(met, [sample, "pathway"], "left").na.fill(0, ["_called", "_on"])
    level = F.get(F.array(*[F.lit(x) for x in LEVELS]), F.greatest(F.coalesce("_r", F.lit(1)), F.lit(1)) - 1)
    return rows.select(sample, "pathway", level.alias("level"), F.col("_called").alias("n_called"), (F.col("_on") - F.col("_called")).alias("n_no_call"), (F.col("_all") - F.col("_on")).alias("n_not_on_array"))


def read_probe(samples: DataFrame, probes: DataFrame, sample: str = "sample_id", key: str = "rsid", genotype: str = "genotype") -> DataFrame:
    """For each sample and locus: the first typed call in order of the probe's rank, else no_call if any probe is there, else absent.

    probes: locus, key, rank (0 for the primary, then aliases), positional (a probe that only counts if all typed
    positional probes of the locus agree). Only probes that a sample has are read; a row for each sample and locus is made at the end.
    """
    rows = samples.groupBy(sample, key).agg(F.min(genotype).alias("_g")).join(probes, key)
    typed = ~G.is_no_call(F.col("_g"))
    named, placed = typed & ~F.col("positional"), typed & F.col("positional")
    met = rows.groupBy(sample, "locus").agg(
        F.min(F.when(named, F.struct("rank", "_g"))).alias("_n"), F.min(F.when(placed, F.struct("rank", "_g"))).alias("_p"), F.count_distinct(F.when(placed, F.col("_g"))).alias("_d"), F.lit(True).alias("_any")
    )
    out = lookup.grid(samples.select(sample).distinct(), probes.select("locus").distinct()).join(met, [sample, "locus"], "left")
    call = F.when(F.col("_n").isNotNull(), F.col("_n._g")).when(F.col("_d") == 1, F.col("_p._g"))
    status = F.when(call.isNotNull(), "typed").when(F.col("_any"), "no_call").otherwise("absent")
    return out.select(sample, "locus", call.alias(genotype), status.alias("status"))


def gene_panel(rows: DataFrame, panel: DataFrame, gene: str, keep: Column, unreliable: Sequence[str] = ()) -> DataFrame:
    """Carried rows of the panel's genes that keep holds for, one per allele, public ids first, with status and a note of a second hit.

    rows: gene, rsid, chrom, pos, ref, alt, zygosity; panel: gene, inheritance (AR or AD).
    """
    own = rows.filter(keep & F.col("zygosity").isin("het", "hom_alt") & ~F.col(gene).isin(*unreliable)) if unreliable else rows.filter(keep & F.col("zygosity").isin("het", "hom_alt"))
    own = own.join(panel.select(gene, "inheritance").distinct(), gene)
    allele = ["chrom", "pos", "ref", "alt"]
    public = F.when(F.startswith("rsid", F.lit("rs")), 0).otherwise(1)
    rest = [c for c in own.columns if c not in (gene, *allele)]
    one = own.groupBy(gene, *allele).agg(F.min_by(F.struct(*rest), F.struct(public, F.col("rsid"))).alias("_r")).select(gene, *allele, *[F.col(f"_r.{c}").alias(c) for c in rest])
    hets = F.count_if(F.col("zygosity") == "het").over(Window.partitionBy(gene))
    recessive = F.col("inheritance") == "AR"
    status = F.when(~recessive | (F.col("zygosity") == "hom_alt"), "affected").otherwise("carrier")
    return one.withColumns({"status": status, "possible_compound": recessive & (hets >= 2)})


def diplotype_pair(a: Column, b: Column, table: Column) -> Column:
    """struct(status, label) of two loci by a table of "xx/yy"; missing before no_call before lookup of the sorted calls."""
    key = F.concat_ws("/", G.canonical(a), G.canonical(b))
    return (
        F.when(a.isNull() | b.isNull(), F.struct(F.lit("missing").alias("status"), F.lit(None).cast("string").alias("label")))
        .when(G.is_no_call(a) | G.is_no_call(b), F.struct(F.lit("no_call").alias("status"), F.lit(None).cast("string").alias("label")))
        .when(F.map_contains_key(table, key), F.struct(F.lit("called").alias("status"), F.try_element_at(table, key).alias("label")))
        .otherwise(F.struct(F.lit("ambiguous").alias("status"), F.lit(None).cast("string").alias("label")))
    )


def allele_copies(alleles: Column, wanted: str) -> Column:
    """Copies of an allele named by field prefix ("A*02:01" has "A*02:01:01"); null for a locus without calls."""
    hit = lambda x: (x == wanted) | F.startswith(x, F.lit(wanted + ":"))
    called = F.filter(alleles, lambda x: x.isNotNull())
    return F.when(F.size(called) > 0, F.size(F.filter(called, hit)))


def state_label(labels: Column, call: Column) -> Column:
    """The label of a call in a map of genotypes to states, in any spelling; null for no call and for one whose strand isn't told."""
    return F.when(~G.is_no_call(call) & ~F.coalesce(G.strand_ambiguous(labels, call), F.lit(False)), G.lookup(labels, call))


def counted_label(copies: Sequence[Column], labels: Column) -> Column:
    """A label by the copies at several loci together; null if one of them is unknown or the map has no such number."""
    total = F.lit(0)
    for c in copies:
        total = total + c
    return F.try_element_at(labels, total.cast("int"))


def family_outcome(rows: DataFrame, samples: DataFrame, sample: str = "sample_id", gene: str = "gene_symbol", level: str = "evidence_level", weak: Column | None = None) -> DataFrame:
    """For each sample: Positive if a row of the family's genes that isn't weak is carried, else Negative, with its genes, number
    of rows, whether one is homozygous and the highest level."""
    own = rows.filter(F.col("zygosity").isin("het", "hom_alt"))
    own = own if weak is None else own.filter(~F.coalesce(weak, F.lit(False)))
    met = own.groupBy(sample).agg(F.array_sort(F.collect_set(gene)).alias("_g"), F.count("*").alias("_n"), F.bool_or(F.col("zygosity") == "hom_alt").alias("_h"), F.max(level).alias("_l"))
    out = samples.select(sample).distinct().join(met, sample, "left")
    return out.select(
        sample, F.when(F.col("_n") > 0, "Positive").otherwise("Negative").alias("status"), F.coalesce("_g", F.array().cast("array<string>")).alias("genes"), F.coalesce("_n", F.lit(0)).alias("n_rows"),
        F.coalesce("_h", F.lit(False)).alias("has_homozygous"), F.coalesce("_l", F.lit(0)).alias("highest_level"),
    )
