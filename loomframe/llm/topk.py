"""Exact top-k search by inner product with a vector-approximation file.

Components become integers floor(scale * x). Different vectors are kept once, with the k + 1 least ids that have them. The
approximation file holds a cell number of a few bits for each component, packed; edges lie evenly between quantiles of a
bounded sample (fit_rows vectors of a length), and a component's outer cells reach to its least and greatest value in the
whole table, so every vector has certain lower and upper bounds of its score. Vectors that stand far off in a component
would make those bounds loose for all; they have no cell and are read exactly, as are those of all but the 256 most
frequent lengths.

1. Queries and cells are dealt into a grid of query blocks and slices. Each place scans its cells and passes on the
   2k + 1 vectors with the greatest lower bounds of each query.
2. The exact vectors of the best 2k + 1 of all places are read. The k-th exact score is the bar.
3. A second scan passes on all vectors whose upper bound reaches the bar, the only ones that can still be among the k
   best. Their exact vectors are read, scored and ranked.

This is the distributed form of reading vectors in the order of their bounds until the k-th is certain: what a sequential
reader would still read behind the bar's first guess, the second scan reads for all queries at once.

Only cells and queries go through the grid; exact vectors are read by key for what is left, so their traffic follows the
number of queries, not that of grid places.

Defined results: a vector that is null, empty or holds a null or non-finite component takes no part, nor does a row without id.
Only vectors of equal length are compared. Rows that repeat id and vector are candidates each; a query's own rows are
those of its id, and an id that has several vectors asks with each of them. Ties go to the smaller id. An empty table
gives an empty result; extra columns are ignored. A long vector is packed as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import cut, to_python

AT_ONCE = 1 << 21


def _rows(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of lists of dim integers as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


#: Lengths of vectors that have cells of their own; vectors of further lengths are read exactly.
LENGTHS = 256


def usual(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of each component that cells divide evenly, between quantiles of a sample."""
    low, high = np.quantile(sample, [0.005, 0.995], axis=0, method="nearest")
    return low.astype(np.int64), np.maximum(high, low + 1).astype(np.int64)


def far(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Vectors with a component more than twice the usual range beyond it."""
    span = 2 * (high - low)
    return ((v < low - span) | (v > high + span)).any(1)


class Cells:
    """Bounds of the cells of vectors of one length: cell c of component d holds low[d, c] .. high[d, c].

    first, last: the usual range of each component. The outer cells reach to its least and greatest value, those of far vectors left out.
    """

    def __init__(self, first: np.ndarray, last: np.ndarray, least: np.ndarray, greatest: np.ndarray, bits: int):
        n = 1 << bits
        self.bits, self.step, self.base = bits, np.maximum(1, -(-(last - first + 1) // n)), first
        self.low = first[:, None] + np.arange(n)[None, :] * self.step[:, None]
        self.high = self.low + self.step[:, None] - 1
        self.low[:, 0], self.high[:, -1] = np.minimum(least, self.low[:, 0]), np.maximum(greatest, self.high[:, -1])
        self.most = max(abs(int(self.low.min())), abs(int(self.high.max())))

    def pack(self, v: np.ndarray) -> list[bytes]:
        c = np.clip((v - self.base) // self.step, 0, (1 << self.bits) - 1).astype(np.uint8)
        marks = np.unpackbits(c[:, :, None], axis=2)[:, :, 8 - self.bits :].reshape(len(v), -1)
        return [x.tobytes() for x in np.packbits(marks, axis=1)]

    def unpack(self, packed: list[bytes]) -> np.ndarray:
        dim = len(self.base)
        raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        marks = np.unpackbits(raw, axis=1)[:, : dim * self.bits].reshape(-1, self.bits)
        return (marks @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.uint8))).reshape(-1, dim)

    def bounds(self, q: np.ndarray, cells: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """place, lower and upper bounds of the scores of q[place:] with all cells, some queries at a time."""
        top = self.most * int(np.abs(q).max(initial=0)) * max(1, q.shape[1])
        kind, slack = (np.float32, 0.0) if top < 1 << 24 else (np.float64, 0.0 if top < 1 << 53 else 1e-12 * top * q.shape[1])
        at = np.arange(cells.shape[1])[None, :]
        low, high = self.low[at, cells].astype(kind).T, self.high[at, cells].astype(kind).T
        step = max(1, AT_ONCE // max(1, len(cells)))
        for i in range(0, len(q), step):
            plus, minus = np.maximum(q[i : i + step], 0).astype(kind), np.minimum(q[i : i + step], 0).astype(kind)
            yield i, plus @ low + minus @ high - slack, plus @ high + minus @ low + slack


def _scored(pairs: DataFrame, exact: DataFrame, asked: DataFrame) -> DataFrame:
    """pairs (query_id, qh, id, vh) with the exact score."""
    both = pairs.join(exact.select("id", "vh", "v").hint("merge"), ["id", "vh"]).join(asked.select("query_id", "qh", F.col("v").alias("q")).hint("merge"), ["query_id", "qh"])

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, v = batch.column(4), batch.column(5)
            flat = q.flatten().to_numpy(zero_copy_only=False) * v.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(pa.compute.list_value_length(q).to_numpy(zero_copy_only=False))
            sums = np.add.reduceat(flat, np.concatenate([[0], ends[:-1]])) if len(ends) else flat
            yield pa.record_batch([*batch.columns[:4], pa.array(sums, pa.int64())], ["query_id", "qh", "id", "vh", "score"])

    return to_python(both.select("query_id", "qh", "id", "vh", "q", "v"), dot, "query_id long, qh long, id long, vh long, score long")


def top_k(
    vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", scale: int = 64,
    cell_bits: int = 5, query_block: int = 2048, slice_rows: int = 32768, fit_rows: int = 2000,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. queries: which rows of vectors (by their columns) are queries.

    fit_rows: about how many vectors of each length, drawn by hash, cell edges are fitted on; all vectors are in the file.
    """
    if not 1 <= cell_bits <= 8:
        raise ValueError("a cell number has 1 to 8 bits")
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("_v") > 0)).filter(~bad)
    rows = rows.select("vec_id", "is_query", F.transform("_v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v"))
    held = rows.groupBy("v", "vec_id").agg(F.count("*").alias("n"), F.bool_or("is_query").alias("is_query"))
    held = cut(held.withColumns({"vh": F.xxhash64("v"), "dim": F.size("v")}))
    asked = held.filter("is_query").select("dim", F.col("vec_id").alias("query_id"), F.col("vh").alias("qh"), "v")
    by_id = Window.partitionBy("v").orderBy("vec_id")
    kept = held.withColumn("_i", F.row_number().over(by_id)).filter(F.col("_i") <= k + 1)
    kept = cut(kept.withColumn("id", F.min("vec_id").over(Window.partitionBy("v"))))
    exact = kept.filter("_i = 1").select("id", "vh", "dim", "v")
    members = kept.select("id", "vh", "vec_id", "n")
    many = lambda df: {r["dim"]: r["n"] for r in df.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").limit(LENGTHS).collect()}
    sizes, n_asked = many(exact), many(asked)
    share = F.coalesce(*[F.when(F.col("dim") == d, F.lit(min(1.0, fit_rows / n))) for d, n in sizes.items()], F.lit(0.0))
    sample = exact.filter(F.pmod(F.xxhash64("vh", "id"), F.lit(1 << 30)) < share * (1 << 30)).select("dim", "v").toArrow()
    dims = sample.column("dim").to_numpy()
    ranges = {int(d): usual(_rows(sample.filter(pa.array(dims == d)).column("v"), int(d))) for d in np.unique(dims)}

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            own = batch.column(0).to_numpy()
            for d in np.unique(own):
                v = _rows(batch.filter(pa.array(own == d)).column(1), int(d)) if int(d) in ranges else np.zeros((0, 1), np.int64)
                v = v[~far(v, *ranges[int(d)])] if len(v) else v
                if len(v):
                    old = seen.get(int(d), (v[0], v[0]))
                    seen[int(d)] = np.minimum(old[0], v.min(0)), np.maximum(old[1], v.max(0))
        for d, (least, greatest) in seen.items():
            yield pa.record_batch([pa.array([d], pa.int32()), pa.array([least], pa.list_(pa.int64())), pa.array([greatest], pa.list_(pa.int64()))], ["dim", "least", "greatest"])

    ends = to_python(exact.select("dim", "v"), extremes, "dim int, least array<long>, greatest array<long>")
    ends = ends.select("dim", F.posexplode(F.arrays_zip("least", "greatest")).alias("i", "e")).groupBy("dim", "i").agg(F.min("e.least").alias("least"), F.max("e.greatest").alias("greatest"))
    found_ends = ends.orderBy("dim", "i").toArrow().to_pydict()  # a row a component of a length
    grid: dict[int, Cells] = {}
    for d, (first, last) in ranges.items():
        at = [i for i, x in enumerate(found_ends["dim"]) if x == d]
        if at:
            grid[d] = Cells(first, last, np.array([found_ends["least"][i] for i in at]), np.array([found_ends["greatest"][i] for i in at]), cell_bits)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2).to_numpy()
            for d in map(int, np.unique(own)):
                part = batch.filter(pa.array(own == d))
                packed = [None] * len(part)
                if d in grid:
                    v = _rows(part.column(3), d)
                    packed = [None if odd else x for x, odd in zip(grid[d].pack(v), far(v, *ranges[d]), strict=True)]
                yield pa.record_batch([*part.columns[:3], pa.array(packed, pa.binary())], ["id", "vh", "dim", "cell"])

    # A far vector has no cell: nothing bounds its scores, so it is read for each query.
    cells = cut(to_python(exact, approximate, "id long, vh long, dim int, cell binary"))
    # A grid of its own for each length.
    count = lambda n, per: F.coalesce(*[F.when(F.col("dim") == d, F.lit(math.ceil(x / per))) for d, x in n.items()], F.lit(1)) if n else F.lit(1)
    n_blocks, n_slices = count(n_asked, query_block), count(sizes, slice_rows)
    places = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    scanned = cells.select("*", F.pmod("vh", n_slices).cast("int").alias("vs"), places(n_blocks).alias("qb")).groupBy("dim", "qb", "vs")
    kind = pa.schema([(c, pa.int64()) for c in ("query_id", "qh", "id", "vh", "low")])

    def scan(left: pa.Table, right: pa.Table, dim: int, pick) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        known = pa.compute.is_valid(right.column("cell"))
        near, odd = right.filter(known), right.filter(pa.compute.invert(known))
        ids = np.concatenate([near.column("id").to_numpy(), odd.column("id").to_numpy()])
        vh = np.concatenate([near.column("vh").to_numpy(), odd.column("vh").to_numpy()])
        q, v = _rows(left.column("v"), dim), len(odd)
        bounds = grid[dim].bounds(q, grid[dim].unpack(near.column("cell").to_pylist())) if len(near) else ((i, np.zeros((1, 0)), np.zeros((1, 0))) for i in range(len(q)))
        out = []
        for at, low, high in bounds:
            for i in range(len(low)):
                picked = pick(at + i, np.append(low[i], np.full(v, -np.inf)), np.append(high[i], np.full(v, np.inf)))
                out.append((np.full(len(picked), at + i), picked, np.append(low[i], np.full(v, -np.inf))[picked]))
        at, picked, low = (np.concatenate(x) for x in zip(*out, strict=True))
        low = np.where(np.isfinite(low), np.floor(low), -(2.0**62)).astype(np.int64)
        return pa.table([left.column("query_id").to_numpy()[at], left.column("qh").to_numpy()[at], ids[picked], vh[picked], low], schema=kind)

    def best_bounds(at: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        m = 2 * k + 1
        return scan(left, right, at[0].as_py(), lambda _, low, high: np.argpartition(-low, m - 1)[:m] if len(low) > m else np.arange(len(low)))

    def reaching(at: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        bar = left.column("bar").to_numpy()
        return scan(left, right, at[0].as_py(), lambda i, low, high: np.flatnonzero(high >= bar[i]))

    blocked = asked.select("*", F.pmod("qh", n_blocks).cast("int").alias("qb"))
    dealt = blocked.select("*", places(n_slices).alias("vs")).groupBy("dim", "qb", "vs")
    names = "query_id long, qh long, id long, vh long, low long"
    started = dealt.cogroup(scanned).applyInArrow(best_bounds, names)
    order = Window.partitionBy("query_id", "qh").orderBy(F.col("low").desc(), "id", "vh")
    started = started.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= 2 * k + 1).select("query_id", "qh", "id", "vh")
    read = _scored(started, exact, asked).filter("query_id <> id")
    worst = read.withColumn("_i", F.row_number().over(Window.partitionBy("query_id", "qh").orderBy(F.col("score").desc()))).filter(F.col("_i") == k)
    bars = blocked.join(worst.select("query_id", "qh", F.col("score").alias("bar")).hint("merge"), ["query_id", "qh"], "left").withColumn("bar", F.coalesce("bar", F.lit(-(1 << 63))))
    left = bars.select("*", places(n_slices).alias("vs")).groupBy("dim", "qb", "vs").cogroup(scanned).applyInArrow(reaching, names).drop("low")
    found = _scored(left, exact, asked).join(members.hint("merge"), ["id", "vh"]).filter("query_id <> vec_id")
    # Of rows that repeat id and vector no more than k can be among the best.
    found = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("_copy"))
    ranks = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
