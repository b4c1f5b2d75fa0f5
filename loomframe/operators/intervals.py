"""Point-in-interval, overlap and membership joins by bins, merging of intervals, and coordinate lifting.

A range condition alone would be planned as a nested loop. Here each interval is listed under every bin it touches and
each point under its own, so the join is an equi-join on (group, bin) with a residual check; bins cut a hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators import ordered


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def points_in(points: DataFrame, intervals: DataFrame, group: str, pos: str, start: str, end: str, width: int = 1_000_000, open_start: bool = True) -> DataFrame:
    """Pairs of a point and an interval of its group that holds it: start < pos <= end, or start <= pos <= end."""
    p = points.withColumn("_bin", F.floor(F.col(pos) / width))
    i = intervals.filter(F.col(start) <= F.col(end)).withColumn("_bin", _bins(F.col(start), F.col(end), width)).withColumnRenamed(group, "_g")
    lower = F.col(pos) > F.col(start) if open_start else F.col(pos) >= F.col(start)
    return p.join(i, (F.col(group) == F.col("_g")) & (p["_bin"] == i["_bin"]) & lower & (F.col(pos) <= F.col(end))).drop("_bin", "_g")


def overlaps(a: DataFrame, b: DataFrame, group: str, start: str, end: str, width: int = 1_000_000) -> DataFrame:
    """Pairs of intervals of one group with a common point, ends included; b's columns have the prefix b_. Each pair once."""
    x = a.withColumn("_bin", _bins(F.col(start), F.col(end), width))
    y = b.select([F.col(c).alias(f"b_{c}") for c in b.columns]).withColumn("_bbin", _bins(F.col(f"b_{start}"), F.col(f"b_{end}"), width))
    first = F.floor(F.greatest(F.col(start), F.col(f"b_{start}")) / width)  # the bin in which the common part begins
    on = (F.col(group) == F.col(f"b_{group}")) & (F.col("_bin") == F.col("_bbin")) & (F.col(start) <= F.col(f"b_{end}")) & (F.col(f"b_{start}") <= F.col(end)) & (F.col("_bin") == first)
    return x.join(y, on).drop("_bin", "_bbin")


def region(df: DataFrame, group: str, value: str, start: str, end: str, lo: int, hi: int) -> DataFrame:
    """Rows of a group that touch lo..hi, ends included, by start. Both bounds reach the scan."""
    return df.filter((F.col(group) == value) & (F.col(end) >= lo) & (F.col(start) <= hi)).orderBy(start, end)


def half_open(df: DataFrame, group: str, value: str, pos: str, lo: int, hi: int) -> DataFrame:
    return df.filter((F.col(group) == value) & (F.col(pos) > lo) & (F.col(pos) <= hi)).orderBy(pos)


def merge(intervals: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Disjoint intervals with the number n of those in each: one that begins at or before the furthest end so far joins the run.

    The furthest end, and then the run that is open, are carried along the group's pieces (see ordered.py).
    """
    own = intervals.groupBy(group, start, end).agg(F.count("*").alias("_n"))
    rows = ordered.before(ordered.pieces(own, [group], [start, end]), _reach=(F.max, F.col(end)))
    fresh = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), F.col(ordered.AT))
    rows = ordered.before(rows.withColumn("_fresh", fresh), _open=(F.max, F.col("_fresh")))
    runs = rows.withColumn("_run", F.coalesce("_fresh", "_open"))
    return runs.groupBy(group, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("_n").alias("n")).drop("_run")


def within(rows: DataFrame, intervals: DataFrame, group: str, pos: str, span: Column, start: str, end: str, width: int = 1_000_000) -> DataFrame:
    """Rows whose stretch [pos - 1, pos - 1 + span) meets a half-open interval of their group. No row twice, whatever overlaps."""
    flat = merge(intervals, group, start, end).select(F.col(group).alias("_g"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    marked = rows.withColumn("_from", F.col(pos) - 1).withColumn("_to", F.col(pos) - 1 + F.greatest(span, F.lit(1)))
    places = [group, "_from", "_to"]
    x = marked.select(*places).distinct().withColumn("_bin", _bins(F.col("_from"), F.col("_to") - 1, width))
    y = flat.filter("_s < _e").withColumn("_b", _bins(F.col("_s"), F.col("_e") - 1, width))
    hit = x.join(y, (F.col(group) == F.col("_g")) & (F.col("_bin") == F.col("_b")) & (F.col("_from") < F.col("_e")) & (F.col("_s") < F.col("_to")), "left_semi")
    return marked.join(hit.select(*places).distinct(), places, "left_semi").select(*rows.columns)


def overlay(points: DataFrame, intervals: DataFrame, key: str, group: str, pos: str, start: str, end: str, record: str, take: Sequence[str], width: int = 1_000_000) -> DataFrame:
    """For each key, take from the first interval record (by record) that holds one of its points."""
    pairs = points_in(points.select(key, group, pos), intervals.select(group, start, end, record, *take), group, pos, start, end, width)
    return pairs.groupBy(key).agg(F.min_by(F.struct(*take), record).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in take])


def overlay_alleles(rows: DataFrame, records: DataFrame, key: str, place: Sequence[str], alleles: Sequence[str], record: str, take: Sequence[str]) -> DataFrame:
    """For each key, take from the first record with its place and alleles; rows without alleles match by place alone."""
    known = F.lit(True)
    for a in alleles:
        known = known & F.col(a).isNotNull()
    value = F.struct(record, *take)
    full = rows.filter(known).join(records.select(*place, *alleles, value.alias("_v")), [*place, *alleles]).select(key, "_v")
    bare = rows.filter(~known).join(records.select(*place, value.alias("_v")), list(place)).select(key, "_v")
    best = full.unionByName(bare).groupBy(key).agg(F.min("_v").alias("_v"))
    return best.select(key, *[F.col(f"_v.{c}").alias(c) for c in take])


def lift(rows: DataFrame, chain: DataFrame, chrom: str = "chrom", pos: str = "pos", genotype: str | None = None, width: int = 1_000_000) -> DataFrame:
    """rows with new_chrom and new_pos (1-based) by chain blocks, null where none holds the place.

    chain: t_chrom, t_start, t_end (0-based, half-open), q_chrom, q_start, strand, q_size and block (its order). The
    first block counts. On the minus strand places count from the target's end and genotypes are complemented.
    """
    name = F.regexp_replace(F.col(chrom), "(?i)^chr", "")
    marked = rows.withColumns({"_c": name, "_p": F.col(pos) - 1})
    x = marked.filter(~F.upper("_c").isin("MT", "M")).select("_c", "_p", F.floor(F.col("_p") / width).alias("_bin")).distinct()
    blocks = chain.withColumn("_tc", F.regexp_replace("t_chrom", "(?i)^chr", "")).withColumn("_b", _bins(F.col("t_start"), F.col("t_end") - 1, width))
    hit = x.join(blocks, (F.col("_c") == F.col("_tc")) & (F.col("_bin") == F.col("_b")) & (F.col("_p") >= F.col("t_start")) & (F.col("_p") < F.col("t_end")))
    at = F.col("q_start") + F.col("_p") - F.col("t_start")
    place = F.struct(F.regexp_replace("q_chrom", "(?i)^chr", "").alias("chrom"), F.when(F.col("strand") == "-", F.col("q_size") - at).otherwise(at + 1).alias("pos"), F.col("strand"))
    first = hit.groupBy("_c", "_p").agg(F.min_by(place, "block").alias("_q"))
    out = marked.join(first, ["_c", "_p"], "left").withColumns({"new_chrom": F.col("_q.chrom"), "new_pos": F.col("_q.pos")})
    if genotype:
        from loomframe.functions.genotype import canonical, complement

        turned = F.when(F.upper(F.col(genotype)).rlike("^[ACGT]{1,2}$"), canonical(complement(F.upper(F.col(genotype))))).otherwise(F.col(genotype))
        out = out.withColumn(genotype, F.when(F.col("_q.strand") == "-", turned).otherwise(F.col(genotype)))
    return out.select(*rows.columns, "new_chrom", "new_pos")


def lift_missing(rows: DataFrame, chain: DataFrame, chrom: str = "chrom", pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """rows with new places where they had none yet, and one row: total, converted, failed, already_lifted."""
    had = F.col("new_pos").isNotNull()
    todo = lift(rows.filter(~had).drop("new_chrom", "new_pos"), chain, chrom, pos)
    done = rows.filter(had).unionByName(todo)
    n = rows.agg(F.count("*").alias("total"), F.count_if(had).alias("already_lifted"))
    made = todo.agg(F.count_if(F.col("new_pos").isNotNull()).alias("converted"), F.count_if(F.col("new_pos").isNull()).alias("failed"))
    return done, n.withColumn("_k", F.lit(1)).join(made.withColumn("_k", F.lit(1)), "_k").select("total", "converted", "failed", "already_lifted")
