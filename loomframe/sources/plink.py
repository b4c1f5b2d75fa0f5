"""Writer of PLINK 1 filesets: genotypes of many samples as two-bit codes, variant by variant.

Variants are dealt by ranges of place. Each task writes the .bed and .bim of its range; at commit they get the names
part-00000, part-00001 ... in order of place, beside one .fam for all of them and a merge list that names the three
files of each part. Nothing goes through the driver but a message a task; what a failed attempt wrote is removed at
commit. The path has to be one that all tasks can write: a shared folder, or a store that pyarrow knows.

A1 is the reference allele and A2 the alternative: two bits are 00 for two references, 10 for one, 11 for none and 01 for missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from loomframe.durable import cut
from loomframe.functions import genotype as G
from loomframe.functions.scalar import chromosome_order
from loomframe.operators import ordered
from loomframe.sources.files import opened

#: Fixed values of the format: how a .bed that is ordered by variant begins, and the code of a missing call.
MAGIC, MISSING = b"\x6c\x1b\x01", 1


def packed(codes: np.ndarray) -> bytes:
    """Codes of the samples at one variant, four to a byte, the first in the lowest bits."""
    fours = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    fours[: len(codes)] = codes
    return (fours.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()


@dataclass
class Written(WriterCommitMessage):
    part: int
    prefix: str
    variants: int


class PlinkWriter(DataSourceArrowWriter):
    def __init__(self, path: str, samples: int):
        self.path, self.samples = path, samples

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        prefix, n = f"_attempt-{task.partitionId()}-{task.taskAttemptId()}", 0
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{prefix}.bed") as bed, fs.open_output_stream(f"{path}/{prefix}.bim") as bim:
            bed.write(MAGIC)
            for batch in iterator:
                for row in batch.to_pylist():
                    codes = np.full(self.samples, MISSING, np.uint8)
                    codes[[c["i"] for c in row["calls"]]] = [c["code"] for c in row["calls"]]
                    bed.write(packed(codes))
                    bim.write(f"{row['chrom']}\t{row['id']}\t0\t{row['pos']}\t{row['ref']}\t{row['alt']}\n".encode())
                    n += 1
        return Written(task.partitionId(), prefix, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = opened(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        names = []
        for m in parts:
            if m.variants:
                name = f"part-{len(names):05}"
                names.append(name)
                for end in ("bed", "bim"):
                    fs.move(f"{path}/{m.prefix}.{end}", f"{path}/{name}.{end}")
        for file in fs.get_file_info(FileSelector(path)):
            if file.base_name.startswith("_attempt-"):
                fs.delete_file(file.path)
        with fs.open_output_stream(f"{path}/merge-list.txt") as out:
            out.write("".join(f"{n}.bed {n}.bim all.fam\n" for n in names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = opened(self.path)
        for m in messages:
            if m is not None:
                for end in ("bed", "bim"):
                    fs.delete_file(f"{path}/{m.prefix}.{end}")


class FamWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/all.fam") as fam:
            for batch in iterator:
                for name in batch.column(0).to_pylist():
                    fam.write(f"{name}\t{name}\t0\t0\t0\t-9\n".encode())
        return WriterCommitMessage()


class PlinkSource(DataSource):
    """df.write.format("plink").option("samples", n).save(path): columns chrom, id, pos, ref, alt, calls (i, code); or one column of names with option("fam", True)."""

    @classmethod
    def name(cls) -> str:
        return "plink"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FamWriter(self.options["path"]) if "fam" in self.options else PlinkWriter(self.options["path"], int(self.options["samples"]))


def variants(rows: DataFrame, samples: DataFrame, sample: str = "sample_id") -> DataFrame:
    """chrom, id, pos, ref, alt and calls: single-letter variants with resolved calls, in any order.

    rows: sample, rsid, chrom, pos, ref, alt, zygosity. samples: sample and its number n. Rows that say the same of a
    sample's place are one; a place at which a sample's rows or samples' alleles disagree is left out.
    """
    base = lambda c: F.upper(c).isin(*"ACGT")
    code = F.when(F.col("zygosity") == "hom_ref", 0).when(F.col("zygosity") == "het", 2).when(F.col("zygosity") == "hom_alt", 3)
    chrom = F.upper(F.regexp_replace(F.trim("chrom"), "(?i)^chr", ""))
    own = rows.select(sample, chrom.alias("chrom"), "pos", F.upper("ref").alias("ref"), F.upper("alt").alias("alt"), code.alias("code"), F.trim(F.coalesce("rsid", F.lit(""))).alias("id"))
    own = own.filter(base("ref") & base("alt") & (F.col("ref") != F.col("alt")) & F.col("code").isNotNull() & F.col("pos").isNotNull() & F.col("chrom").isNotNull())
    own = own.withColumn("id", F.when(F.col("id") == "", F.concat_ws(":", "chrom", F.col("pos").cast("string"))).otherwise(F.col("id")))
    row = F.struct("id", "ref", "alt", "code")
    one = own.groupBy(sample, "chrom", "pos").agg(F.min(row).alias("a"), F.max(row).alias("b"))
    allele = F.struct("a.id", "a.ref", "a.alt")
    met = one.join(samples.select(sample, F.col("n").cast("int").alias("i")), sample).groupBy("chrom", "pos")
    met = met.agg(F.min(allele).alias("v"), F.max(allele).alias("w"), F.bool_and(F.col("a") == F.col("b")).alias("clear"), F.collect_list(F.struct("i", F.col("a.code").alias("code"))).alias("calls"))
    return met.filter(F.col("clear") & (F.col("v") == F.col("w"))).select("chrom", "v.id", "pos", "v.ref", "v.alt", "calls")


def write(rows: DataFrame, path: str, sample: str = "sample_id") -> None:
    """Filesets of all samples of rows (see variants), which are ordered by name; white space and control characters in names become _."""
    spark = rows.sparkSession
    spark.dataSource.register(PlinkSource)
    named = rows.select(sample).distinct().withColumn("_all", F.lit(0))
    samples = cut(ordered.numbered(ordered.pieces(named, ["_all"], [sample]), "n"))
    name = F.regexp_replace(F.col(sample).cast("string"), r"[\s\p{Cntrl}]", "_")
    fam = samples.select("n", F.when(name == "", "SAMPLE").otherwise(name).alias("name")).repartition(1).sortWithinPartitions("n").select("name")
    fam.write.format("plink").option("fam", True).mode("append").save(path)
    place = [chromosome_order(F.col("chrom"), G.CHROMOSOMES), F.col("chrom"), F.col("pos")]
    dealt = _by_range(variants(rows, samples, sample), place)
    dealt.write.format("plink").option("samples", samples.count()).mode("append").save(path)


def _by_range(df: DataFrame, keys: list[Column]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
