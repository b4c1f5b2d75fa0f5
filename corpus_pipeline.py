"""A corpus pipeline of five stages over documents; each stage's result is written as Parquet and read by the next.

Every stage carries all columns of its rows, whatever their names. Defined results: quality_rules rejects null, empty and
blank texts and judges repeated rows alike. simhash_near_dedup keeps one of rows that repeat a text, the one with the
least id (null before others), then by hashes of the other columns. substring_dedup leaves a null text null and treats
rows that agree in id and text alike. mix_sources takes no pieces of texts without words; a null source is one of its
own. sentence_pieces gives a null text null pieces. Texts of any length are taken whole, and an empty table passes every
stage as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import mixing, pieces, quality, repeats, simhash
from loomframe.llm.common import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy keeps."""
    # The row is packed, so that the ledger's columns can't replace any of its own.
    packed = docs.select("text", F.struct(*docs.columns).alias("row"))
    judged = quality.apply_policy(quality.ledger(packed), quality.STANDARD).filter("kept")
    return judged.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the units of text that stand in an earlier place of the corpus."""
    return repeats.clean(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that a mix at weights 1, 2, 3 takes, a row for each time a piece is taken."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    packed = docs.select("doc_id", "text", "source", F.struct(*others).alias("row"))
    rows = mixing.Mix(packed, carry=["row"]).rows(with_text=True)
    fresh = {"doc_id": F.col("doc_id"), "text": F.col("piece_text"), "source": F.col("source"), "n_chars": F.length("piece_text").cast("long")}
    return rows.select(*[(fresh[c] if c in fresh else F.col("_c_row")[c]).alias(c) for c in docs.columns])


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled SentencePiece ids of every row in place of its text; a column named as one of the stage's own gives way to it."""
    others = [c for c in docs.columns if c not in ("text", "piece_ids", "n_pieces", "round_trip")]
    packed = docs.select("doc_id", "text", F.struct(*others).alias("row"))
    out = pieces.encode(packed, keep=("row",), key=("doc_id", "text"), check=True)
    return out.select(*[F.col("row")[c].alias(c) for c in others], "piece_ids", "n_pieces", "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("sentence_pieces", sentence_pieces),
]

#: Fingerprints, digests, permutations and sampling are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
