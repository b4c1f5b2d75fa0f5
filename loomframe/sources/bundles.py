"""Bundles of reference data: arrays in an .npz archive as rows, marker trees from JSON. What a bundle may hold is stated, and
anything else is refused.

    spark.dataSource.register(NpzSource)
    spark.read.format("npz").option("path", p).option("members", "loadings,means").load()

reads members of one first dimension as a table: row (its number) and a column a member; further dimensions are arrays.
"""

from __future__ import annotations

import ast
import json
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomframe.operators.callers import Node
from loomframe.sources.files import opened


class BundleError(ValueError):
    """A bundle that is not what it should be."""


@dataclass(frozen=True)
class Member:
    """An array of an archive, by its header: type, shape, and whether its values are stored column by column."""

    dtype: np.dtype
    shape: tuple[int, ...]
    by_column: bool
    offset: int


def members(path: str) -> dict[str, Member]:
    """The arrays of an archive, from their headers only; Python objects are refused."""
    fs, at = opened(path)
    out = {}
    with fs.open_input_file(at) as file, zipfile.ZipFile(file) as archive:
        for info in archive.infolist():
            name = info.filename.removesuffix(".npy")
            if name == info.filename or name in out:
                raise BundleError(f"not an array: {info.filename}")
            with archive.open(info) as raw:
                magic = raw.read(8)
                if magic[:6] != b"\x93NUMPY" or magic[6] not in (1, 2, 3):
                    raise BundleError(f"not an array: {info.filename}")
                size = int.from_bytes(raw.read(2 if magic[6] == 1 else 4), "little")
                head = ast.literal_eval(raw.read(size).decode("latin-1"))
            kind = np.dtype(head["descr"])
            if kind.hasobject:
                raise BundleError(f"{name} holds Python objects")
            out[name] = Member(kind, tuple(head["shape"]), bool(head["fortran_order"]) and len(head["shape"]) > 1, 8 + (2 if magic[6] == 1 else 4) + size)
    return out


def _spark_type(kind: np.dtype) -> T.DataType:
    if kind.kind in "US":
        return T.StringType()
    if kind.kind == "b":
        return T.BooleanType()
    if kind.kind in "iu":
        return T.LongType()
    if kind.kind == "f":
        return T.DoubleType()
    raise BundleError(f"no column type for {kind}")


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class NpzReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, per_task: int):
        self.path, self.schema, self.per_task = path, schema, per_task
        self.names = [f.name for f in schema if f.name != "row"]

    def partitions(self) -> Sequence[Rows]:
        n = members(self.path)[self.names[0]].shape[0]
        return [Rows(i, min(n, i + self.per_task)) for i in range(0, n, self.per_task)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        found = members(self.path)
        fs, at = opened(self.path)
        with fs.open_input_file(at) as file, zipfile.ZipFile(file) as archive:
            arrays = {name: _part(archive, name, found[name], partition) for name in self.names}
        kinds = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64()}
        columns = []
        for f in self.schema:
            x = np.arange(partition.first, partition.last) if f.name == "row" else arrays[f.name]
            kind, depth = f.dataType, 0
            while isinstance(kind, T.ArrayType):
                kind, depth = kind.elementType, depth + 1
            arrow = kinds[kind.simpleString()]
            values = x.astype(str) if arrow == pa.string() else x.astype({pa.bool_(): bool, pa.int64(): np.int64, pa.float64(): np.float64}[arrow])
            for _ in range(depth):
                arrow = pa.list_(arrow)
            columns.append(pa.array(values.tolist(), arrow))
        yield pa.record_batch(columns, [f.name for f in self.schema])


def _part(archive: zipfile.ZipFile, name: str, m: Member, rows: Rows) -> np.ndarray:
    """Rows of an array. Those before are inflated and dropped; an array stored by columns is read whole."""
    width = m.dtype.itemsize * int(np.prod(m.shape[1:], dtype=np.int64))
    with archive.open(f"{name}.npy") as raw:
        if m.by_column:
            raw.seek(m.offset)
            return np.frombuffer(raw.read(), m.dtype).reshape(m.shape, order="F")[rows.first : rows.last]
        raw.seek(m.offset + rows.first * width)
        data = raw.read((rows.last - rows.first) * width)
    if len(data) != (rows.last - rows.first) * width:
        raise BundleError(f"{name} is cut off")
    return np.frombuffer(data, m.dtype).reshape((rows.last - rows.first, *m.shape[1:]))


class NpzSource(DataSource):
    """Options: path; members (a list by commas); rows (of a task, 65,536)."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> T.StructType:
        found = members(self.options["path"])
        names = [x.strip() for x in self.options["members"].split(",")]
        missing = [n for n in names if n not in found]
        if missing:
            raise BundleError(f"no such array: {', '.join(missing)}")
        shapes = {n: found[n].shape for n in names}
        if any(not s for s in shapes.values()) or len({s[0] for s in shapes.values()}) != 1:
            raise BundleError(f"arrays of different lengths: {shapes}")
        fields = [T.StructField("row", T.LongType(), False)]
        for n in names:
            kind = _spark_type(found[n].dtype)
            for _ in shapes[n][1:]:
                kind = T.ArrayType(kind, False)
            fields.append(T.StructField(n, kind, False))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> NpzReader:
        return NpzReader(self.options["path"], schema, int(self.options.get("rows", 65536)))


def check(found: Mapping[str, Member], stated: Mapping[str, Sequence[str | int]]) -> dict[str, int]:
    """Sizes of named dimensions. stated: member -> its dimensions, a name (the same size wherever it stands) or a number."""
    odd = sorted(set(found) ^ set(stated))
    if odd:
        raise BundleError("; ".join(f"{'unknown' if n in found else 'missing'} array: {n}" for n in odd))
    sizes: dict[str, int] = {}
    for name, dims in stated.items():
        shape = found[name].shape
        if len(shape) != len(dims):
            raise BundleError(f"{name} has shape {shape}, not {len(dims)} dimensions")
        for d, n in zip(dims, shape, strict=True):
            if n != (d if isinstance(d, int) else sizes.setdefault(d, n)):
                raise BundleError(f"{name} has shape {shape}: {d} is {d if isinstance(d, int) else sizes[d]}")
    return sizes


#: The arrays of a projection bundle and their dimensions.
PROJECTION = {
    "loadings": ("markers", "components"), "means": ("markers",), "stds": ("markers",), "eigenvalues": ("components",), "tw_pvalues": (20,),
    "aim_rsids": ("markers",), "aim_rsids_23andme": ("markers",), "aim_chroms": ("markers",), "aim_positions_grch38": ("markers",), "aim_a1": ("markers",), "aim_a2": ("markers",),
    "populations": ("populations",), "population_centroids": ("populations", "components"), "ref_pca_coords": ("samples", "components"), "ref_labels": ("samples",), "ref_sample_ids": ("samples",),
    "n_significant_pcs": (), "n_total_snps": (), "n_selected_aims": (),
}


@dataclass(frozen=True)
class Projection:
    """markers: rsid, chrom, pos, ref, alt, mean, sd, load. reference: ref_id, label, point. centroids: label -> point."""

    markers: DataFrame
    reference: DataFrame
    centroids: dict[str, list[float]]


def projection(spark: SparkSession, path: str) -> Projection:
    """A projection bundle, whose arrays, shapes, marker names and labels are checked."""
    sizes = check(members(path), PROJECTION)
    spark.dataSource.register(NpzSource)
    table = lambda *names: spark.read.format("npz").option("path", path).option("members", ",".join(names)).load()
    rows = table("aim_rsids_23andme", "aim_chroms", "aim_positions_grch38", "aim_a1", "aim_a2", "means", "stds", "loadings")
    markers = rows.select(
        F.col("aim_rsids_23andme").alias("rsid"), F.col("aim_chroms").alias("chrom"), F.col("aim_positions_grch38").alias("pos"), F.col("aim_a2").alias("ref"), F.col("aim_a1").alias("alt"),
        F.col("means").alias("mean"), F.col("stds").alias("sd"), F.col("loadings").alias("load"),
    )
    bad = markers.agg(F.count_distinct("rsid").alias("n"), F.count_if(F.trim("rsid") == "").alias("empty"), F.count_if(F.isnan("mean") | F.isnan("sd")).alias("nan")).first()
    if bad["n"] != sizes["markers"] or bad["empty"] or bad["nan"]:
        raise BundleError("marker names have to be different and means and deviations numbers")
    centroids = {r["populations"]: list(r["population_centroids"]) for r in table("populations", "population_centroids").collect()}  # a row a population
    if len(centroids) != sizes["populations"]:
        raise BundleError("populations have to be different")
    reference = table("ref_sample_ids", "ref_labels", "ref_pca_coords").select(F.col("ref_sample_ids").alias("ref_id"), F.col("ref_labels").alias("label"), F.col("ref_pca_coords").alias("point"))
    strange = reference.filter(~F.col("label").isin(*centroids)).select("label").first()
    if strange:
        raise BundleError(f"a reference sample of no population: {strange[0]}")
    return Projection(markers, reference, centroids)


def tree(document: Mapping, where: str = "root") -> Node:
    """A marker tree: haplogroup, and perhaps defining_snps (rsid, allele), children and optional_conflict_snps (guards)."""
    if "haplogroup" not in document:
        raise BundleError(f"{where}: no haplogroup")
    pairs = lambda key: tuple((str(m["rsid"]), str(m["allele"])) for m in document.get(key) or ())
    name = document["haplogroup"]
    try:
        return Node(name, pairs("defining_snps"), [tree(c, f"{where}/{name}") for c in document.get("children") or ()], pairs("optional_conflict_snps"))
    except KeyError as e:
        raise BundleError(f"{where}/{name}: a marker without {e}") from None


def trees(path: str, names: Sequence[str] = ("mt", "Y")) -> dict[str, Node]:
    """Trees of a JSON bundle by name; a bundle without one of them is refused."""
    fs, at = opened(path)
    with fs.open_input_stream(at) as raw:
        try:
            document = json.loads(raw.read().decode("utf-8"))
        except ValueError as e:
            raise BundleError(f"not JSON: {e}") from None
    own = document.get("trees", {}) if isinstance(document, dict) else {}
    if missing := [n for n in names if n not in own]:
        raise BundleError(f"no tree: {', '.join(missing)}")
    return {n: tree(own[n]) for n in names}
