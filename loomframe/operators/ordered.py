"""Ordered scans with carried state, for groups of any size.

A window over a group holds the group in one task. Here rows are dealt by ranges of (group, order), so that a large group
spans many pieces; each piece is folded on its own, the folds of a group's pieces (a row each) are carried from one
piece to the next, and a second local pass adds what was carried. A task holds a piece, never a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.durable import cut

PIECE, AT = "_piece", "_at"


def pieces(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], salted: bool = False) -> DataFrame:
    """df sorted by group and order (nulls first), with _piece (the group and the number of its piece) and _at (a number
    that grows with the order).

    Rows that agree in group and order stand in one piece. salted deals such rows too, in the order in which df's own
    partitions give them; df is then to be a scan or a written table, whose partitions are the same when they are run again.
    """
    spark = df.sparkSession
    keys = [F.col(c) if isinstance(c, str) else c for c in (*by, *order)]
    rows = df
    if salted:
        rows = df.withColumn("_salt", F.monotonically_increasing_id())
        keys.append(F.col("_salt"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # The group's name is a field, so that a join finds groups whose name is null.
    piece = F.struct(F.struct(*by).alias("of"), F.spark_partition_id().alias("number"))
    return cut(dealt.select(*[c for c in df.columns if c not in (PIECE, AT)], piece.alias(PIECE), F.monotonically_increasing_id().alias(AT)))


def _along() -> Window:
    """The pieces of a group before a piece: a row each, so that this window is as small as the number of tasks."""
    return Window.partitionBy(F.col(f"{PIECE}.of")).orderBy(F.col(f"{PIECE}.number")).rowsBetween(Window.unboundedPreceding, -1)


def before(rows: DataFrame, **folds: tuple[Callable[[Column], Column], Column]) -> DataFrame:
    """rows of pieces() with a column for each fold (F.max, F.min or F.sum, of an expression) over all earlier rows of the group.

    Null where there is no earlier row with a value.
    """
    carried = {c: f"_{c}_carried" for c in folds}
    sums = rows.groupBy(PIECE).agg(*[f(x).alias(carried[c]) for c, (f, x) in folds.items()])
    sums = sums.select(PIECE, *[f(carried[c]).over(_along()).alias(carried[c]) for c, (f, _) in folds.items()])
    earlier = Window.partitionBy(PIECE).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    both = rows.withColumns({c: f(x).over(earlier) for c, (f, x) in folds.items()}).join(sums.hint("merge"), PIECE)
    two = {F.max: F.greatest, F.min: F.least}
    out = {c: two[f](c, carried[c]) if f in two else F.coalesce(F.col(c) + F.col(carried[c]), c, carried[c]) for c, (f, _) in folds.items()}
    return both.withColumns(out).select(*rows.columns, *folds)


def numbered(rows: DataFrame, name: str = "_n") -> DataFrame:
    """rows of pieces() with their number in the group, from 0, in place of _piece and _at.

    A group's rows lie side by side in a piece, so one row for each group and piece says by how much a place has to be moved.
    """
    sums = rows.groupBy(PIECE).agg(F.min(AT).alias("_first"), F.count("*").alias("_rows"))
    shifts = sums.select(PIECE, (F.coalesce(F.sum("_rows").over(_along()), F.lit(0)) - F.col("_first")).alias("_shift"))
    kept = [c for c in rows.columns if c not in (PIECE, AT)]
    return rows.join(shifts, PIECE).select(*kept, (F.col(AT) + F.col("_shift")).alias(name))
