"""Reference tables from delimited files whose columns are found by the names in the header line.

A file is read by Spark's CSV reader in many tasks. A header that lacks a wanted column, or has it twice, is refused before
anything is read; values that don't parse are null, and a row without its key or, if asked for, without any value is left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.operators import merge
from loomframe.sources.text import FormatError


def headed(spark: SparkSession, path: str, columns: Mapping[str, tuple[str, str]], sep: str = ",", comment: str | None = None, missing: Sequence[str] = ("", ".", "-")) -> DataFrame:
    """Typed columns of a file with a header, and record, which orders its rows. columns: name -> (name in the header, type)."""
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
    raw = (reader.option("comment", comment) if comment else reader).csv(path)
    names = [c.strip().lstrip("﻿#").lower() for c in raw.columns]
    absent = [h for h, _ in columns.values() if names.count(h.lower()) != 1]
    if absent:
        raise FormatError(f"no single column {', '.join(absent)} in {path}")
    at = lambda h: F.trim(F.col(f"`{raw.columns[names.index(h.lower())]}`"))
    value = lambda h: F.when(~at(h).isin(*missing), at(h))
    record = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    return raw.select(*[value(h).try_cast(kind).alias(n) for n, (h, kind) in columns.items()], record.alias("record"))


def load(spark: SparkSession, path: str, columns: Mapping[str, tuple[str, str]], key: Sequence[str], sep: str = ",", comment: str | None = None, some: Sequence[str] = ()) -> DataFrame:
    """A row a key, of several the last in the file. some: columns of which one has to have a value."""
    rows = headed(spark, path, columns, sep, comment)
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    if some:
        whole = whole & F.coalesce(*[F.col(c).cast("string") for c in some]).isNotNull()
    return merge.last_wins(rows.filter(whole), key, "record").drop("record")
