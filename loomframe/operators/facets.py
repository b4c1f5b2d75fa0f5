"""Counts, histograms, quality metrics and summaries. All aggregate before they shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(df: DataFrame, by: str, order: Column | None = None) -> DataFrame:
    out = df.groupBy(by).agg(F.count("*").alias("n"))
    return out.orderBy(order, by) if order is not None else out


def facet(df: DataFrame, by: str, missing: str | None = "unknown") -> DataFrame:
    """by and n, most frequent first; null as missing, or left out if that is None."""
    rows = df.filter(F.col(by).isNotNull()) if missing is None else df.withColumn(by, F.coalesce(by, F.lit(missing)))
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), by)


def histogram(df: DataFrame, value: str, width: float, category: Column, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, bin (its lower edge), a count for each of the category's values and total, for bins with rows."""
    bin_ = (F.floor(F.col(value) / width) * width).cast("long")
    rows = df.filter(F.col(value).isNotNull()).select(*by, bin_.alias("bin"), category.alias("_c"))
    out = rows.groupBy(*by, "bin").agg(*[F.count_if(F.col("_c") == v).alias(v) for v in values], F.count("*").alias("total"))
    return out.orderBy(*by, "bin")


def rates(df: DataFrame, by: str, state: Column, parts: Mapping[str, Sequence[str]], among: Column | None = None) -> DataFrame:
    """Two-level counts: rows first counted by (by, state), then summed to buckets, with a row for all (by is null).

    parts: bucket -> states. call_rate and het_rate follow if there are buckets hom, het and nocall; het_rate of the
    total only counts rows where among holds.
    """
    base = df.select(F.col(by).alias(by), state.alias("_s"), (among if among is not None else F.lit(True)).alias("_in"))
    small = base.groupBy(by, "_s", "_in").agg(F.count("*").alias("_n"))
    sums = [F.coalesce(F.sum(F.when(F.col("_s").isin(*states), F.col("_n"))), F.lit(0)).alias(name) for name, states in parts.items()]
    extra = [
        F.coalesce(F.sum(F.when(F.col("_in") & F.col("_s").isin(*parts["het"]), F.col("_n"))), F.lit(0)).alias("_het"),
        F.coalesce(F.sum(F.when(F.col("_in") & F.col("_s").isin(*parts["het"], *parts["hom"]), F.col("_n"))), F.lit(0)).alias("_called"),
    ]
    out = small.groupingSets([[by], []], by).agg(F.sum("_n").alias("total"), *sums, *extra, F.grouping(by).alias("_all"))
    called = F.col("het") + F.col("hom")
    rate = lambda a, b: F.round(F.try_divide(a, b), 6)
    het = F.when(F.col("_all") == 1, rate(F.col("_het"), F.col("_called"))).otherwise(rate(F.col("het"), called))
    return out.select(by, (F.col("_all") == 1).alias("is_total"), "total", *parts, rate(called, F.col("total")).alias("call_rate"), het.alias("het_rate"))


def with_zero_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """parents with n, the number of children; parents without any keep 0. Children are counted before the join."""
    n = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias("n"))
    return parents.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def module_summary(df: DataFrame, module: str, level: str, text: str, order: str) -> DataFrame:
    """For each module: rows, highest level, rows of each level 1 to 4 and the text of the first row; highest first."""
    out = df.groupBy(module).agg(
        F.count("*").alias("n"), F.max(level).alias("max_level"),
        *[F.count_if(F.col(level) == k).alias(f"level_{k}") for k in (1, 2, 3, 4)],
        F.min_by(text, order).alias("first_text"),
    )
    return out.orderBy(F.col("max_level").desc(), module)


def top_rows(df: DataFrame, level: str, least: int, order: Sequence[Column], n: int = 5) -> DataFrame:
    return df.filter(F.col(level) >= least).orderBy(F.col(level).desc(), *order).limit(n)


def single_row(df: DataFrame, **metrics: Column) -> DataFrame:
    return df.agg(*[c.alias(k) for k, c in metrics.items()])


def genotype_metrics(df: DataFrame, genotype: Column, autosome: Column, transition: Column) -> DataFrame:
    """call_rate, het_rate (autosomes) and titv, null where nothing divides. transition: true, false, or null for neither."""
    called = genotype.isNotNull()
    het = called & (F.substring(genotype, 1, 1) != F.substring(genotype, 2, 1))
    some = called & autosome & (F.length(genotype) == 2)
    return df.agg(
        F.round(F.try_divide(F.count_if(called), F.count("*")), 5).alias("call_rate"),
        F.round(F.try_divide(F.count_if(some & het), F.count_if(some)), 5).alias("het_rate"),
        F.round(F.try_divide(F.count_if(transition), F.count_if(~transition)), 3).alias("titv"),
    )


def source_hits(df: DataFrame, source: Column, hit: Column, fallback: Column, ambiguous: Column, buckets: Sequence[str]) -> DataFrame:
    """For each bucket, also empty ones: key hits, fallback hits, ambiguous and the rest."""
    b = F.explode(F.array(*[F.lit(x) for x in buckets])).alias("source")
    keys = df.sparkSession.range(1).select(b)
    found = df.groupBy(source.alias("source")).agg(F.count_if(hit).alias("key_hits"), F.count_if(fallback).alias("fallback_hits"), F.count_if(ambiguous).alias("ambiguous"), F.count("*").alias("_n"))
    names = ("key_hits", "fallback_hits", "ambiguous")
    out = keys.join(found, "source", "left").na.fill(0)
    return out.select("source", *names, F.greatest(F.lit(0), F.col("_n") - sum((F.col(x) for x in names), F.lit(0))).alias("misses"))


def cross_counts(df: DataFrame, row: str, column: Column, values: Sequence[str], otherwise: str) -> DataFrame:
    """Counts of row by the column's values; all other values, null too, are under otherwise."""
    c = F.when(column.isin(*values), column).otherwise(otherwise)
    return df.groupBy(row).agg(*[F.count_if(c == v).alias(v) for v in (*values, otherwise)])


def median_gap(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, n different values and the median gap between neighbours, rounded; null for one value."""
    rows = df.select(by, value).filter(F.col(value).isNotNull()).distinct()
    gap = F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(value))
    return rows.withColumn("_gap", gap).groupBy(by).agg(F.count("*").alias("n"), F.round(F.median("_gap")).cast("long").alias("median_gap"))


def distinct_or_each(df: DataFrame, key: Column) -> DataFrame:
    """One row with n: different keys that are not empty, plus every row without one."""
    some = F.when(F.length(F.trim(key)) > 0, key)
    return df.agg((F.count_distinct(some) + F.count_if(some.isNull())).alias("n"))
