"""What several operators of this subpackage share: words, stable row keys and lineage cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe import durable
from loomframe.durable import shared_folder

__all__ = ["BATCH_BYTES", "BLANKS", "PACKED_ROWS", "cut", "let", "n_words", "packed", "shared_folder", "spaced", "table", "to_python", "words"]

#: White space of the word definition [^\x20\x09-\x0D]+.
BLANKS = "\t\n\x0b\x0c\r"


#: Bytes of an Arrow batch on its way to Python, so that a worker's memory doesn't follow the length of texts.
BATCH_BYTES = 4 << 20


def to_python(rows: DataFrame, run, schema: str) -> DataFrame:
    """rows.mapInArrow(run, schema) in batches of about BATCH_BYTES."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def spaced(text: Column) -> Column:
    """The text with every blank turned into a space, trimmed; null counts as empty."""
    return F.trim(F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS)))


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ in order."""
    return let(spaced(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " +")))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


#: Narrow rows (some keys and numbers) in a partition, at least, where there are so many.
PACKED_ROWS = 50_000


def packed(df: DataFrame) -> DataFrame:
    """A cut table of narrow rows with so few partitions that each has about PACKED_ROWS of them: what shrinks in a job
    else keeps all partitions of its first shuffle, and each later shuffle writes files for each of them."""
    return df.coalesce(df.count() // PACKED_ROWS + 1)


def cut(df: DataFrame, forget_size: bool = False) -> DataFrame:
    """df written to the shared folder and read again, so that lost executors cost no recomputation of what is above.

    A checkpoint keeps the size that the optimizer estimated, a product over all joins above. In a loop that product
    grows doubly exponentially, as do the time and memory that its digits take on the driver; forget_size drops it.
    """
    out = durable.cut(df)
    if not forget_size:
        return out
    spark, rows = df.sparkSession, out._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(rows.toJavaRDD(), rows.schema()), spark)
