"""Choosing rows and labels: preferred rows, registry entries, labels by count, held pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.scalar import as_map

#: Letters of other scripts that look like Latin ones, and what they look like.
LOOKALIKES = ("АВЕКМНОРСТХасеорхуіјѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ", "ABEKMHOPCTXaceopxyijsABEZHIKMNOPTYXovp")
INVISIBLE = "​‌‍⁠﻿­"


def preferred(df: DataFrame, by: Sequence[str], category: str, order: Sequence[str], tie: Sequence[Column], unlisted: bool = True) -> DataFrame:
    """One row a group: the category that comes first in order (others behind them, or left out), then by tie."""
    rank = F.coalesce(F.try_element_at(as_map({c: i for i, c in enumerate(order)}), F.col(category)), F.lit(len(order)))
    rows = df if unlisted else df.filter(F.col(category).isin(*order))
    rest = [c for c in df.columns if c not in by]
    best = rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(rank.alias("_r"), *[t.alias(f"_t{i}") for i, t in enumerate(tie)])).alias("_b"))
    return best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in rest])


def first_covering(registry: Sequence[Mapping], group: str | None) -> Mapping | None:
    """The first registry entry whose groups include group; entries for "any" cover all. None if there is none."""
    return next((e for e in registry if group in e["groups"] or "any" in e["groups"]), None)


def by_count(n: Column, labels: Mapping[int, str], unknown: str | None = None) -> Column:
    """A label by a count; a null count is unknown, never zero."""
    return F.when(n.isNull(), F.lit(unknown)).otherwise(F.coalesce(F.try_element_at(as_map(labels), n.cast("int")), F.lit(unknown)))


def folded(text: Column) -> Column:
    """text in lower case, look-alike letters as Latin ones, without invisible characters, runs of other signs as one space."""
    plain = F.translate(F.translate(text, *LOOKALIKES), INVISIBLE, "")
    return F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]+", " "))


def without_held(df: DataFrame, pairs: Sequence[tuple[str, str]], first: str, second: str, texts: Sequence[str] = ()) -> DataFrame:
    """df without rows of a held pair, by its two columns or by both names standing as words in one of the texts."""
    hidden = F.lit(False)
    for a, b in pairs:
        a, b = a.lower(), b.lower()
        hidden = hidden | ((F.lower(first) == a) & (F.lower(second) == b))
        for t in texts:
            words = F.concat(F.lit(" "), folded(F.col(t)), F.lit(" "))
            hidden = hidden | (F.contains(words, F.lit(f" {a} ")) & F.contains(words, F.lit(f" {b} ")))
    return df.filter(~F.coalesce(hidden, F.lit(False)))


def grouped_list(df: DataFrame, by: str, item: str, value: str) -> DataFrame:
    """by, the sorted list of its items and the least value among them (null if none has one)."""
    return df.groupBy(by).agg(F.array_sort(F.collect_set(item)).alias("items"), F.min(value).alias(value))


def carriers_among(findings: DataFrame, listed: DataFrame, gated: Sequence[str], gene: str = "gene_symbol") -> DataFrame:
    """score_id and the sorted carrier genes that it lists; gated genes are never looked at. A note: scores stay as they are."""
    own = findings.filter(~F.col(gene).isin(*gated)) if gated else findings
    hit = listed.join(own.select(gene).distinct(), gene, "left_semi")
    return hit.groupBy("score_id").agg(F.array_sort(F.collect_set(gene)).alias("genes"))


def covering(groups: DataFrame, registry: DataFrame, group: str, covers: str, order: str, take: Sequence[str]) -> DataFrame:
    """groups with take of the first registry entry (by order) whose list covers the row's group, or "any"; null without one.

    The registry is reduced to an entry a name before it meets the rows.
    """
    entry = F.struct(F.col(order).alias("o"), F.struct(*take).alias("v"))
    first = registry.select(F.explode(covers).alias("_g"), entry.alias("_e")).groupBy("_g").agg(F.min("_e").alias("_e"))
    own = first.select(F.col("_g").alias(group), F.col("_e").alias("_own"))
    rest = first.filter("_g = 'any'").select(F.lit("any").alias("_k"), F.col("_e").alias("_any"))
    rows = groups.join(own, group, "left").withColumn("_k", F.lit("any")).join(F.broadcast(rest), "_k", "left")  # one row
    return rows.select(*groups.columns, *[F.least("_own", "_any")["v"][c].alias(c) for c in take])
