"""Reconciling tables: full outer merges, multiset differences, upserts and first- or last-wins loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators import ordered

STRATEGIES = ("flag_only", "prefer_left", "prefer_right", "prefer_vendor_a", "prefer_vendor_b")


def reconcile(
    left: DataFrame, right: DataFrame, key: Sequence[str], value: str, name: str, strategy: str = "flag_only",
    missing: Column | None = None, known: DataFrame | None = None, flag: str = "??", vendors: tuple[str, str] = ("", ""),
) -> DataFrame:
    """One row a key of either side: name, value, source (S1, S2, both), concordance, other_value and other_name.

    concordance is unique, match, filled_nocall (one side had no value) or discordant; a discordance is settled by strategy. Of
    two names, the one that known (a table with column name) has is taken, else the left one. missing: from column
    `value`, whether it is no value. vendors: of the two sides, for the strategies that prefer one. Of several rows of one side at a key, the last by name counts.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy.startswith("prefer_vendor_"):  # the side of that vendor; the left one if both are or neither is
        wanted = strategy[-1]
        strategy = "prefer_right" if vendors[1] == wanted != vendors[0] else "prefer_left"
    missing = missing if missing is not None else F.col(value).isNull()
    sides = []
    for df, p in ((left, "a"), (right, "b")):
        side = df.select(*key, F.struct(F.col(name).alias("name"), F.col(value).alias("value"), missing.alias("missing")).alias("s"))
        side = side.groupBy(*key).agg(F.max_by("s", "s.name").alias(p))
        if known is not None:
            names = known.select(F.col(name).alias("_n")).distinct().withColumn(f"{p}_known", F.lit(True))
            side = side.join(names, F.col(f"{p}.name") == F.col("_n"), "left").drop("_n")
        else:
            side = side.withColumn(f"{p}_known", F.lit(None).cast("boolean"))
        sides.append(side)
    both = sides[0].join(sides[1], list(key), "full_outer")
    a, b = F.col("a"), F.col("b")
    only_a, only_b = b.isNull(), a.isNull()
    take_b = ~F.coalesce("a_known", F.lit(False)) & F.coalesce("b_known", F.lit(False))
    own = F.when(only_a, a["name"]).when(only_b, b["name"]).when(take_b, b["name"]).otherwise(a["name"])
    other_name = F.when(a["name"] != b["name"], F.when(take_b, a["name"]).otherwise(b["name"])).otherwise(F.lit(""))
    va, vb, ma, mb = a["value"], b["value"], a["missing"], b["missing"]
    kind = F.when(only_a | only_b, "unique").when(ma & mb, "match").when(ma | mb, "filled_nocall").when(va == vb, "match").otherwise("discordant")
    clash = kind == "discordant"
    settled = {"flag_only": F.lit(flag), "prefer_left": va, "prefer_right": vb}[strategy]
    from_a, from_b = F.concat(F.lit("S1="), va), F.concat(F.lit("S2="), vb)
    spare = {"flag_only": F.concat_ws(";", from_a, from_b), "prefer_left": from_b, "prefer_right": from_a}[strategy]
    source = F.when(only_a, "S1").when(only_b, "S2").when(kind == "filled_nocall", F.when(ma, "S2").otherwise("S1")).otherwise("both")
    out = F.when(only_a, va).when(only_b, vb).when(clash, settled).when(ma & ~mb, vb).otherwise(va)
    return both.select(
        *key, own.alias(name), out.alias(value), source.alias("source"), kind.alias("concordance"),
        F.when(clash, spare).otherwise(F.lit("")).alias("other_value"), F.coalesce(F.when(only_a | only_b, F.lit("")).otherwise(other_name), F.lit("")).alias("other_name"),
    )


def reconcile_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("concordance", "source").agg(F.count("*").alias("n"))


def multiset_diff(old: DataFrame, new: DataFrame, identity: Sequence[str], meaning: Sequence[str], text: str) -> DataFrame:
    """Rows added, removed or changed: state, identity, meaning (of the new row if changed), text and old_meaning.

    Rows equal in identity and meaning cancel out as often as both sides have them. Of what is left under one identity,
    the n-th rows by text are pairs of a change; what has no partner was added or removed. Null equals null.
    """
    key, order = [*identity, *meaning], F.coalesce(F.col(text), F.lit(""))

    def left_over(a: DataFrame, b: DataFrame) -> DataFrame:
        # Equal rows are a row with their number; places along a key, and then along an identity, are carried (ordered.py).
        own = a.groupBy(*key, text).agg(F.count("*").alias("_rows"))
        own = ordered.before(ordered.pieces(own, key, [order, text]), _earlier=(F.sum, F.col("_rows")))
        twins = b.groupBy(F.struct(*key).alias("_key")).agg(F.count("*").alias("_twins"))
        both = own.withColumn("_key", F.struct(*key)).join(twins.hint("merge"), "_key", "left")
        spare = F.least(F.col("_rows"), F.coalesce("_earlier", F.lit(0)) + F.col("_rows") - F.coalesce("_twins", F.lit(0)))
        rest = both.select(*key, text, spare.alias("_rows")).filter("_rows > 0")
        rest = ordered.before(ordered.pieces(rest, identity, [order, *meaning, text]), _earlier=(F.sum, F.col("_rows")))
        first = F.coalesce("_earlier", F.lit(0)) + 1
        return rest.select(*key, text, F.explode(F.sequence(first, first + F.col("_rows") - 1)).alias("_n"))

    before, after = left_over(old, new), left_over(new, old)
    place = F.struct("_n", *identity).alias("_place")
    x = before.select(place, F.struct(*before.columns).alias("x"))
    y = after.select(place, F.struct(*after.columns).alias("y"))
    state = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed")
    pick = lambda c: F.when(F.col("y").isNull(), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(c)
    olds = [F.when(state == "changed", F.col(f"x.{c}")).alias(f"old_{c}") for c in meaning]
    return x.join(y, "_place", "full_outer").select(state.alias("state"), *[pick(c) for c in (*identity, *meaning, text)], *olds)


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str], update: Sequence[str], ored: Sequence[str] = ()) -> DataFrame:
    """table with rows inserted by key, or their update columns set and ored columns or-ed. Of equal keys in rows the greatest row counts."""
    fresh = rows.groupBy(*key).agg(F.max(F.struct(*[c for c in table.columns if c not in key])).alias("_r"))
    own = table.select(*key, F.struct(*[c for c in table.columns if c not in key]).alias("_t"))
    out = own.join(fresh, list(key), "full_outer")
    cols = []
    for c in table.columns:
        if c in key:
            cols.append(F.col(c))
        elif c in ored:
            cols.append(F.when(F.col(f"_t.{c}").isNull() & F.col(f"_r.{c}").isNull(), F.lit(None)).otherwise(F.coalesce(F.col(f"_t.{c}"), F.lit(0)).bitwiseOR(F.coalesce(F.col(f"_r.{c}"), F.lit(0)))).alias(c))
        elif c in update:
            cols.append(F.when(F.col("_r").isNotNull(), F.col(f"_r.{c}")).otherwise(F.col(f"_t.{c}")).alias(c))
        else:
            cols.append(F.when(F.col("_t").isNotNull(), F.col(f"_t.{c}")).otherwise(F.col(f"_r.{c}")).alias(c))
    return out.select(*cols)


def last_wins(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def insert_ignore(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """table and those of rows whose key it lacks, one a key."""
    return table.unionByName(rows.dropDuplicates(list(key)).join(table.select(*key), list(key), "left_anti").select(*table.columns))


def delete_keys(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return table.join(rows.select(*key).distinct(), list(key), "left_anti")


def cascade_delete(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """parents and every child table without the keys in gone; children: name -> (table, its column with the key)."""
    keys = gone.select(F.col(key).alias("_k")).distinct()
    drop = lambda df, c: df.join(keys, F.col(c) == F.col("_k"), "left_anti")
    return drop(parents, key), {n: drop(df, c) for n, (df, c) in children.items()}


def staged_swap(df: DataFrame, root: str, generation: str) -> str:
    """df written below root as a new generation, and a pointer file moved over the old one last: a single rename, so that
    readers see the old generation or the new one (where the file system renames atomically, as HDFS does)."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{root}/data/{generation}")
    fs_api = spark._jvm.org.apache.hadoop.fs
    aside, place = (fs_api.Path(f"{root}/{name}") for name in (f"aside-{generation}", "current"))
    fs = aside.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    out.write(bytearray(generation.encode()))
    out.close()
    options = getattr(fs_api, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    fs_api.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(place), over)
    return f"{root}/data/{generation}"


def current(spark, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/data/{spark.read.text(f'{root}/current').first()[0]}")


def stale(recorded: DataFrame, now: DataFrame, name: str, version: str) -> DataFrame:
    """Names whose recorded version is not the current one (null is a version of its own); no names if nothing was recorded."""
    r = recorded.select(name, F.col(version).alias("recorded_version"))
    n = now.select(name, F.col(version).alias("current_version"), F.lit(1).alias("_k"))
    any_ = recorded.agg((F.count("*") > 0).alias("_any")).withColumn("_k", F.lit(1))
    out = n.join(r, name, "left").join(any_, "_k").filter(F.col("_any") & ~F.col("recorded_version").eqNullSafe(F.col("current_version")))
    return out.select(name, "recorded_version", "current_version")


def still_declared(stored: DataFrame, declared: DataFrame, key: Sequence[str], take: Sequence[str], withheld: Column, kept: Column, caveat: str, text: str = "text") -> DataFrame:
    """Stored rows that the declarations loaded now still have, with take of these in place of their own.

    Rows of a withheld call go, unless they are to be kept: then their text ends with the caveat, once.
    """
    now = declared.groupBy(*key).agg(F.min(F.struct(*take)).alias("_now"))
    rows = stored.drop(*take).join(now, list(key))
    gone = F.coalesce(withheld, F.lit(False))
    rows = rows.filter(~gone | F.coalesce(kept, F.lit(False)))
    told = F.when(gone & ~F.contains(text, F.lit(caveat)), F.concat_ws(" ", text, F.lit(caveat))).otherwise(F.col(text))
    return rows.withColumn(text, told).select(*[c for c in stored.columns if c not in take], *[F.col(f"_now.{c}").alias(c) for c in take])
