"""Uploads as users have them: plain text or a ZIP archive of one text file, inflated within a bound, with odd bytes replaced.

Files come through Spark's binaryFile source, so they can be in any store that Spark reads, and one that is over the bound
isn't read. A file is inflated and decoded in pieces as its lines leave the task: the digest of the text's bytes, its
number of bytes and why it is refused, if it is, follow behind the last of them. Lines of a refused file don't count, and
Spark's scans skip a file without a byte.
"""

from __future__ import annotations

import codecs
import hashlib
import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.durable import cut, discard, exists, publish
from loomframe.functions import genotype as G
from loomframe.sources import text

MAX_BYTES, PIECE, LINES = 256 << 20, 64 << 10, 4096


class Refused(ValueError):
    """An upload that is not taken."""


def _member(content: bytes, name: str, most: int) -> tuple[str, io.BufferedIOBase]:
    """The name of the text and a stream of it."""
    if not content.startswith(b"PK\x03\x04"):
        return name, io.BytesIO(content)
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        files = [i for i in archive.infolist() if not i.is_dir()]
        if len(files) != 1:
            raise Refused("the archive has to hold one file")
        own = PurePosixPath(files[0].filename.replace("\\", "/")).name
        if not own.lower().endswith(".txt"):
            raise Refused("the archive has to hold a .txt file")
        if files[0].file_size > most:
            raise Refused("too large")
        return own, archive.open(files[0])
    except (zipfile.BadZipFile, zipfile.LargeZipFile, NotImplementedError, RuntimeError, OSError):
        raise Refused("not a readable archive") from None


def _pieces(stream: io.BufferedIOBase, most: int) -> Iterator[bytes]:
    """The stream in pieces; one byte more than `most` is read at the most, whatever the archive says of its size."""
    left = most + 1
    while left:
        try:
            piece = stream.read(min(PIECE, left))
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, EOFError):
            raise Refused("not a readable archive") from None
        if not piece:
            return
        left -= len(piece)
        if not left:
            raise Refused("too large")
        yield piece


def unpacked(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """Lines (path, record, value) of all uploads, and one more row for each: record null, name, vendor, version, build, file_hash, n_bytes, reason."""
    schema = "path string, record long, value string, name string, vendor string, version string, build string, file_hash string, n_bytes long, reason string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in schema.split(", ")]

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        name, digest, size, head, n = PurePosixPath(path).name, hashlib.sha256(), 0, [], 0
        vendor = version = build = reason = None
        decoder, begun = codecs.getincrementaldecoder("utf-8")("replace"), []

        def line(value: str) -> tuple:
            if len(head) < text.SNIFF_LINES:
                head.append(value)
            return path, n, value, *[None] * 7

        try:
            name, stream = _member(content, name, most)
            for piece in _pieces(stream, most):
                if not size:
                    text.refuse_binary(piece)
                digest.update(piece)
                size += len(piece)
                *ended, last = decoder.decode(piece).split("\n")
                for value in ended:
                    yield line(("".join(begun) + value).rstrip("\r"))
                    begun = []
                    n += 1
                begun.append(last)
            begun.append(decoder.decode(b"", True))
            if rest := "".join(begun).rstrip("\r"):
                yield line(rest)
            vendor = text.sniff(head)
            version, build = text.version_a(head) if vendor == "a" else (text.version_b(head), "GRCh37")
        except (Refused, text.FormatError) as e:
            reason = str(e)
        yield path, None, None, name, vendor, version, build, digest.hexdigest(), size, reason

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in rows(path, content.as_py()):
                    held.append(row)
                    if len(held) >= LINES:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held = []
        if held:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    small = files.filter(F.col("length") <= most).select("path", "content").mapInArrow(run, schema)
    null = lambda c: F.lit(None).cast(c)
    base = F.substring_index("path", "/", -1)
    large = files.filter(F.col("length") > most).select("path", null("long").alias("record"), null("string").alias("value"), base.alias("name"), *[null("string").alias(c) for c in ("vendor", "version", "build", "file_hash")], F.col("length").alias("n_bytes"), F.lit("too large").alias("reason"))
    return small.unionByName(large)


def ingest(spark: SparkSession, path: str, root: str, batch: str, most: int = MAX_BYTES, chain: DataFrame | None = None) -> DataFrame:
    """Takes all uploads below path and gives a row for each: path, name, vendor, version, build, file_hash, n_bytes, n_variants,
    n_nocalls and reason (why it was refused, or "known" for a text that an earlier batch or upload holds).

    Calls are written below root under file_hash, with the file's row last: committed() reads what has such a row, so a
    batch that was broken off leaves nothing, and one that is run again gives nothing twice. A file with a line that
    doesn't parse is refused as a whole. Build 36 is lifted if a chain is given, else refused.
    """
    from loomframe.operators.intervals import lift

    everything = cut(unpacked(spark, path, most))
    files = everything.filter("record is null").drop("record", "value")
    earlier = known_files(spark, root).select("file_hash").distinct().withColumn("_known", F.lit(True))
    first = F.min("path").alias("_first")
    same = files.filter("reason is null").groupBy("file_hash").agg(first)
    files = files.join(same, "file_hash", "left").join(earlier, "file_hash", "left")
    again = F.col("_known").isNotNull() | (F.col("path") != F.col("_first"))
    old = (F.col("build") == "GRCh36") & F.lit(chain is None)
    files = cut(files.withColumn("reason", F.coalesce("reason", F.when(again, "known").when(old, "a build 36 file needs a chain"))).drop("_known", "_first"))
    good = files.filter("reason is null").select("path", "file_hash", F.col("vendor").alias("_vendor"), F.col("build").alias("_build"))
    lines = everything.filter("record is not null").select("path", "record", "value").join(good, "path").select("value", "file_hash", "_vendor", "_build", "record")
    parsed = [text.genotypes(lines.filter(F.col("_vendor") == v), v, keep=("file_hash", "_build", "record")) for v in "ab"]
    calls = cut(parsed[0].unionByName(parsed[1]))
    bad = calls.filter("reason is not null").groupBy("file_hash").agg(F.min_by("reason", "record").alias("_bad"))
    rows = calls.join(bad, "file_hash", "left_anti").select("file_hash", "rsid", "chrom", "pos", "genotype", "_build")
    if chain is not None:
        lifted = lift(rows.filter("_build = 'GRCh36'"), chain, genotype="genotype").filter("new_pos is not null")
        lifted = lifted.withColumns({"chrom": F.col("new_chrom"), "pos": F.col("new_pos")}).select(*rows.columns)
        rows = rows.filter("_build <> 'GRCh36'").unionByName(lifted)
    rows = cut(rows.drop("_build"))
    counts = rows.groupBy("file_hash").agg(F.count("*").alias("n_variants"), F.count_if(G.is_no_call(F.col("genotype"))).alias("n_nocalls"))
    out = files.join(bad, "file_hash", "left").join(counts, "file_hash", "left")
    reason = F.coalesce("reason", "_bad", F.when(F.col("n_variants").isNull(), "no calls"))
    out = cut(out.select("path", "name", "vendor", "version", "build", "file_hash", "n_bytes", F.when(reason.isNull(), F.col("n_variants")).alias("n_variants"), F.when(reason.isNull(), F.col("n_nocalls")).alias("n_nocalls"), reason.alias("reason")))
    if not exists(spark, f"{root}/files/batch={batch}"):
        discard(spark, f"{root}/calls/batch={batch}")  # what a run that was broken off has left
        publish(rows.repartitionByRange("file_hash", "chrom", "pos").sortWithinPartitions("file_hash", "chrom", "pos"), f"{root}/calls", f"batch={batch}")
        publish(out.filter("reason is null"), f"{root}/files", f"batch={batch}")
    return out


def _published(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    schema = f"{schema}, batch string"
    return spark.read.schema(schema).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], schema)


def known_files(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all files that were taken, with their batch; of batches that took a text at the same time the first by name counts."""
    files = _published(spark, f"{root}/files", "path string, name string, vendor string, version string, build string, file_hash string, n_bytes long, n_variants long, n_nocalls long")
    rest = [c for c in files.columns if c not in ("file_hash", "batch")]
    return files.groupBy("file_hash").agg(F.min_by(F.struct("batch", *rest), "batch").alias("_f")).select("file_hash", "_f.*")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """Calls of all files that were taken: batch, file_hash, rsid, chrom, pos, genotype."""
    calls = _published(spark, f"{root}/calls", "file_hash string, rsid string, chrom string, pos long, genotype string")
    return calls.join(known_files(spark, root).select("batch", "file_hash"), ["batch", "file_hash"], "left_semi")
