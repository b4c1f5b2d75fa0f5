"""Enrichment by lookup: a left join on a key with one chosen candidate a row, fallbacks, merges and coverage masks.

A candidate is chosen with one aggregate of the joined rows by the row's id (max_by / min_by), so a hot key costs a
partial aggregate and no sort of its group. Small reference tables are broadcast by Spark's own measured sizes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_best(left: DataFrame, right: DataFrame, on: Sequence[str], order: Sequence[Column], take: Sequence[str], residual: Column | None = None) -> DataFrame:
    """left with take from the first candidate of right by order (columns of right), null without one.

    If no residual condition on left's columns is needed, right is reduced to a row a key before the join. Otherwise
    residual filters candidates of left's different rows, and the best is one aggregate by the row itself.
    """
    if residual is None:
        best = right.groupBy(*on).agg(F.min_by(F.struct(*take), F.struct(*order)).alias("_best"))
        return left.join(best, list(on), "left").select(*left.columns, *[F.col(f"_best.{c}").alias(c) for c in take])
    rows = left.groupBy(*left.columns).agg(F.count("*").alias("_copies"))
    packed = right.select(*on, F.struct(*right.columns, *[o.alias(f"_o{i}") for i, o in enumerate(order)]).alias("_r"))
    ok = F.col("_r").isNotNull() & F.coalesce(residual, F.lit(False))
    rank = F.struct(*[F.col(f"_r._o{i}") for i in range(len(order))])
    value = F.struct(*[F.col(f"_r.{c}").alias(c) for c in take])
    chosen = rows.join(packed, list(on), "left").groupBy(*left.columns, "_copies").agg(F.min_by(value, F.when(ok, rank)).alias("_best"))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")
    return chosen.select("*", again).select(*left.columns, *[F.col(f"_best.{c}").alias(c) for c in take])


def grid(left: DataFrame, right: DataFrame, parts: int | None = None) -> DataFrame:
    """Each row of left with each row of right, such as a panel. Both are dealt to shares, about parts pairs of them (by default
    as many as a shuffle has partitions), and each pair of shares meets once: a task holds a share of right, not all of it, few
    rows of left are spread by right's shares, and nothing is broadcast. A row is repeated about sqrt(parts) times."""
    parts = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = math.isqrt(max(0, parts - 1)) + 1
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hashed = lambda df: F.xxhash64(F.lit(0), *[c for c, kind in df.dtypes if "map<" not in kind])
    share = lambda df: F.pmod(hashed(df), F.lit(n)).cast("int")
    held = right.withColumn("_col", share(right)).withColumn("_row", every)
    dealt = left.withColumn("_row", share(left)).withColumn("_col", every)
    return dealt.join(held.hint("merge"), ["_row", "_col"]).drop("_row", "_col")


def resolve_alias(df: DataFrame, aliases: DataFrame, key: str, old: str, current: str, to: str = "resolved") -> DataFrame:
    """df with the current name of its key and a status: merged, valid, i_prefix or invalid."""
    names = aliases.groupBy(F.col(old).alias("_old")).agg(F.max(current).alias("_new"))
    k = F.col(key)
    status = F.when(F.col("_new").isNotNull(), "merged").when(k.rlike("^rs[0-9]+$"), "valid").when(k.rlike("^i[0-9]+$"), "i_prefix").otherwise("invalid")
    return df.join(names, k == F.col("_old"), "left").withColumns({to: F.coalesce("_new", k), "alias_status": status}).drop("_old", "_new")


def key_then_fallback(left: DataFrame, right: DataFrame, key: Sequence[str], fallback: Sequence[str], order: Sequence[Column], take: Sequence[str], unique: Column | None = None) -> DataFrame:
    """left with take by key, else by fallback, and matched_by (key, fallback or null).

    unique: an expression of right; a fallback place at which it has several values gives nothing.
    """
    by_key = right.groupBy(*key).agg(F.min_by(F.struct(*take), F.struct(*order)).alias("_k"))
    chosen = F.min_by(F.struct(*take), F.struct(*order))
    if unique is not None:
        chosen = F.when(F.min(unique) == F.max(unique), chosen)
    by_place = right.groupBy(*fallback).agg(chosen.alias("_f"))
    out = left.join(by_key, list(key), "left").join(by_place, list(fallback), "left")
    how = F.when(F.col("_k").isNotNull(), "key").when(F.col("_f").isNotNull(), "fallback")
    return out.select(*left.columns, *[F.when(F.col("_k").isNotNull(), F.col(f"_k.{c}")).otherwise(F.col(f"_f.{c}")).alias(c) for c in take], how.alias("matched_by"))


def strict_unique(left: DataFrame, right: DataFrame, on: Sequence[str], variant: Sequence[str], carried: Column, take: Sequence[str], id_col: str) -> DataFrame:
    """left with take if exactly one candidate is left: the only one, or the only carried one; status says why not.

    carried: whether the row (columns of left) carries the candidate (columns of right). Candidates that agree in
    variant are one. id_col identifies rows of left.
    """
    packed = right.groupBy(*on, *variant).agg(F.count("*").alias("_copies"), *[F.min(c).alias(c) for c in take if c not in variant])
    joined = left.join(packed, list(on), "left")
    some = F.coalesce(*[F.col(v).isNotNull() for v in variant])
    value = F.struct(*take)
    hit = some & F.coalesce(carried, F.lit(False))
    found = joined.groupBy(id_col).agg(F.count_if(some).alias("_n"), F.count_if(hit).alias("_h"), F.min(F.when(some, value)).alias("_any"), F.min(F.when(hit, value)).alias("_hit"))
    pick = F.when(F.col("_n") == 1, F.col("_any")).when(F.col("_h") == 1, F.col("_hit"))
    status = F.when(F.col("_n") == 0, "absent").when((F.col("_n") == 1) | (F.col("_h") == 1), "matched").otherwise("allele_ambiguous")
    found = found.select(id_col, pick.alias("_p"), status.alias("match_status"))
    return left.join(found, id_col).select(*left.columns, *[F.col(f"_p.{c}").alias(c) for c in take], "match_status")


def exact(left: DataFrame, right: DataFrame, on: Sequence[str], take: Sequence[str]) -> DataFrame:
    """left with take of the row with equal keys; right has one row a key after taking the least of each column set."""
    one = right.groupBy(*on).agg(F.min(F.struct(*take)).alias("_r"))
    return left.join(one, list(on), "left").select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in take])


def concordant(chrom: Column, pos: Column, other_chrom: Column, other_pos: Column, anchored: Column) -> Column:
    """Whether two places agree: equal, one base upstream for an anchored indel, or one of them is unknown."""
    unknown = chrom.isNull() | pos.isNull() | other_chrom.isNull() | other_pos.isNull()
    same = (chrom == other_chrom) & ((pos == other_pos) | (F.coalesce(anchored, F.lit(False)) & (other_pos == pos - 1)))
    return unknown | F.coalesce(same, F.lit(False))


def list_join(left: DataFrame, right: DataFrame, on: Sequence[str], item: Sequence[str], to: str, order: Sequence[Column] = ()) -> DataFrame:
    """left with an ordered list of matching rows, empty without any."""
    entry = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *item)
    lists = right.groupBy(*on).agg(F.sort_array(F.collect_list(entry)).alias("_l"))
    clean = F.transform("_l", lambda x: F.struct(*[x[c].alias(c) for c in item]))
    joined = left.join(lists, list(on), "left").withColumn(to, clean)
    kind = joined.schema[to].dataType.simpleString()
    return joined.withColumn(to, F.coalesce(F.col(to), F.array().cast(kind))).select(*left.columns, to)


def primary(left: DataFrame, right: DataFrame, on: Sequence[str], detailed: Column, order: Sequence[Column], take: Sequence[str]) -> DataFrame:
    """left with take of the first matching row that is detailed, else of the first."""
    return join_best(left, right, on, [F.when(detailed, 0).otherwise(1), *order], take)


def merged(df: DataFrame, priority: Mapping[str, Sequence[str]]) -> DataFrame:
    """df with each column set to the first non-null of its sources, which go from later (stronger) to earlier."""
    return df.withColumns({to: F.coalesce(*sources) for to, sources in priority.items()})


def cleared(df: DataFrame, disagrees: Column, columns: Sequence[str], mask: str, bit: int) -> DataFrame:
    """Where a source's alleles disagree with the row's: its columns nulled and its bit cleared."""
    d = F.coalesce(disagrees, F.lit(False))
    out = df.withColumns({c: F.when(d, F.lit(None)).otherwise(F.col(c)) for c in columns})
    return out.withColumn(mask, F.when(d, F.col(mask).bitwiseAND(F.lit(~bit))).otherwise(F.col(mask)))


def semi(left: DataFrame, right: DataFrame, on: Sequence[str], keep: bool = True) -> DataFrame:
    return left.join(right.select(*on).distinct(), list(on), "left_semi" if keep else "left_anti")


def members(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Different keys of left that right has."""
    return semi(left.select(key).distinct(), right, [key])


def changed_values(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose two values are both known and differ."""
    o, n = old.select(key, F.col(value).alias("old_value")), new.select(key, F.col(value).alias("new_value"))
    return o.join(n, key).filter((F.col("old_value") != F.col("new_value")))


def reclassified(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys that are new, and keys in both whose values differ, null-safe."""
    o = old.select(F.col(key).alias("_k"), F.col(value).alias("_o"), F.lit(True).alias("_had"))
    both = new.select(F.col(key).alias("_k"), F.col(value).alias("_n")).join(o, "_k", "left")
    return both.agg(F.count_if(F.col("_had").isNull()).alias("added"), F.count_if(F.col("_had") & ~F.col("_n").eqNullSafe(F.col("_o"))).alias("reclassified"))


def one_place_each(df: DataFrame, key: str, place: Sequence[str], show: int = 5) -> DataFrame:
    """Keys that stand at several places, at most show of them; empty if the table is clean."""
    return df.groupBy(key).agg(F.count_distinct(*place).alias("n")).filter("n > 1").orderBy(key).limit(show)


def by_context(df: DataFrame, figures: DataFrame, key: str, context: Column, take: Sequence[str]) -> DataFrame:
    """df with take of the figures (key, context, take) for its key and context, else of the context's row without a key."""
    own = figures.select(F.struct(F.col(key).alias("k"), F.col("context").alias("c")).alias("_at"), F.struct(*take).alias("_v"))
    one = own.groupBy("_at").agg(F.min("_v").alias("_v"))
    rows = df.withColumn("_c", context)
    rows = rows.withColumns({"_at": F.struct(F.col(key).alias("k"), F.col("_c").alias("c")), "_any": F.struct(F.lit(None).cast(df.schema[key].dataType).alias("k"), F.col("_c").alias("c"))})
    first = rows.join(one, "_at", "left").withColumnRenamed("_v", "_own")
    both = first.join(one.select(F.col("_at").alias("_any"), F.col("_v").alias("_rest")), "_any", "left")
    return both.select(*df.columns, *[F.when(F.col("_own").isNotNull(), F.col(f"_own.{c}")).otherwise(F.col(f"_rest.{c}")).alias(c) for c in take])
