"""Order keys, keyset pages and ranked pages. Every order is total, so pages repeat and don't overlap."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def after(keys: Sequence[Column], values: Sequence[Any]) -> Column:
    """Rows whose key comes after values. With one value less than keys, the rows of that prefix are included (a seek)."""
    if len(values) not in (len(keys), len(keys) - 1) or not values:
        raise ValueError("a cursor names all keys, or all but the last")
    strict = len(values) == len(keys)
    out = None
    for i in reversed(range(len(values))):
        here = keys[i] > values[i]
        if i == len(values) - 1 and not strict:
            here = keys[i] >= values[i]
        out = here if out is None else here | ((keys[i] == values[i]) & out)
    return out


def page(df: DataFrame, keys: Sequence[Column], limit: int, cursor: Sequence[Any] | None = None) -> DataFrame:
    """The next limit + 1 rows: the one too many says that there is more. Planned as a top-k, not a sort of everything."""
    rows = df if cursor is None else df.filter(after(keys, cursor))
    return rows.orderBy(*keys).limit(limit + 1)


def split_page(rows: list, limit: int) -> tuple[list, bool]:
    return rows[:limit], len(rows) > limit


def ranked_page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def capped(df: DataFrame, order: Sequence[Column], most: int) -> tuple[DataFrame, DataFrame]:
    """The first most rows, and one row with total and truncated."""
    total = df.agg(F.count("*").alias("total")).withColumn("truncated", F.col("total") > most)
    return df.orderBy(*order).limit(most), total
