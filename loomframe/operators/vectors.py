"""Projection, nearest centroid, nearest neighbours and mixture fractions over dosage rows or vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Labels whose centroids are sent to every executor, at most.
MAX_LABELS = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity clipped to 0..1; 0 for a zero vector."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))))


def project(dosages: DataFrame, loadings: DataFrame, by: str, marker: str, n_components: int) -> DataFrame:
    """by, point (components) and coverage: the share of markers with a dosage.

    loadings: marker, mean, sd, load (array). A missing marker stands at its mean and adds nothing; a marker without
    spread neither.
    """
    total = loadings.agg(F.count("*").alias("_total"))
    z = F.when(F.col("sd") > 0, (F.col("dosage") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    rows = dosages.filter("dosage is not null").join(loadings, marker)
    sums = [F.sum(z * F.get("load", F.lit(i))).alias(f"_{i}") for i in range(n_components)]
    out = rows.groupBy(by).agg(*sums, F.count("*").alias("_n")).withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k")
    return out.select(by, F.array(*[F.col(f"_{i}") for i in range(n_components)]).alias("point"), (F.col("_n") / F.col("_total")).alias("coverage"))


def centroids(df: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """label and its mean vector: one aggregate a dimension, so no explode."""
    means = [F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"_{i}") for i in range(dims)]
    return df.groupBy(label).agg(*means).select(label, F.array(*[F.col(f"_{i}") for i in range(dims)]).alias("centroid"))


def nearest_centroid(points: DataFrame, means: DataFrame, id_col: str, vector: str, label: str, coverage: Column | None = None, least: float = 0.55, margin: float = 3.0) -> DataFrame:
    """id, nearest label, both distances and the verdict: UNCERTAIN below the coverage, ADMIXED if the second is within margin times the first.

    means is a row a label, of at most MAX_LABELS, else the job stops; it is gathered into one array row and sent along, so points are not multiplied.
    """
    all_of = F.collect_list(F.struct(F.col(label).alias("label"), F.col("centroid")))
    packed = means.agg(F.count("*").alias("_n"), all_of.alias("_c")).withColumn("_k", F.lit(1))
    packed = packed.filter(F.when(F.col("_n") <= MAX_LABELS, True).otherwise(F.raise_error(F.lit(f"more than {MAX_LABELS} labels")).cast("boolean"))).drop("_n")
    rows = points.withColumn("_k", F.lit(1)).join(F.broadcast(packed), "_k")
    d = F.array_sort(F.transform("_c", lambda c: F.struct(squared_distance(F.col(vector).cast("array<double>"), c["centroid"]).alias("d"), c["label"].alias("label"))))
    rows = rows.withColumn("_d", d)
    first, second = F.get("_d", F.lit(0)), F.get("_d", F.lit(1))
    ratio = F.try_divide(F.sqrt(second["d"]), F.sqrt(first["d"]))
    verdict = F.when(ratio < margin, "ADMIXED").otherwise(first["label"].cast("string"))
    if coverage is not None:
        verdict = F.when(coverage < least, "UNCERTAIN").otherwise(verdict)
    return rows.select(id_col, first["label"].alias("nearest"), first["d"].alias("distance"), second["d"].alias("second_distance"), verdict.alias("verdict"))


#: Reference rows that a task of knn_vote compares at a time, about, and distances that it holds at most.
SHARE_ROWS, AT_ONCE = 1 << 16, 1 << 22


@dataclass
class Share:
    """Rows of a share in order of id, those of one length as a matrix by component (length -1: no vector)."""

    ids: pa.Array
    labels: pa.Array
    at: dict[int, np.ndarray]
    columns: dict[int, np.ndarray]
    places: dict[object, list[int]]


def _lengths(vectors: pa.Array) -> np.ndarray:
    """The length of each vector, -1 for one that is null or holds a null."""
    n = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1))
    if vectors.values.null_count:
        n = n.copy()
        n[np.asarray(pc.list_parent_indices(vectors))[np.asarray(pc.is_null(vectors.flatten()))]] = -1
    return n


def _matrix(vectors: pa.Array, rows: np.ndarray, length: int) -> np.ndarray:
    return np.asarray(vectors.take(pa.array(rows)).flatten()).astype(float).reshape(len(rows), length)


def _share(ids: pa.Array, vectors: pa.Array, labels: pa.Array, k: int, same_ids: bool) -> Share:
    """Of equal vectors only those that can be among k nearest stay: the first k of an id, and of k + 1 ids."""
    n, own = _lengths(vectors), np.asarray(ids.dictionary_encode().indices.fill_null(-1))
    at, columns = {}, {}
    for length in np.unique(n):
        rows = np.flatnonzero((n == length) & ((own >= 0) | (not same_ids)))
        m = _matrix(vectors, rows, length) if length > 0 else np.zeros((len(rows), 0))
        same = np.unique(np.ascontiguousarray(m).view(f"V{8 * length}").ravel(), return_inverse=True)[1] if length > 0 else np.zeros(len(rows), int)
        order = np.lexsort((np.arange(len(rows)), same))
        s, o = same[order], own[rows][order]
        place, new = np.arange(len(order)), np.diff(s, prepend=-1) != 0
        new_id = new | (np.diff(o, prepend=-1) != 0)
        start = lambda flags: np.maximum.accumulate(np.where(flags, place, 0))  # noqa: B023,E731
        ids_before = np.cumsum(new_id)
        stay = np.sort(order[(place - start(new_id) < k) & (ids_before - ids_before[start(new)] <= k)])
        at[int(length)], columns[int(length)] = rows[stay], np.ascontiguousarray(m[stay].T)
    places: dict[object, list[int]] = {}
    for i, x in enumerate(ids.to_pylist()):
        places.setdefault(x, []).append(i)
    return Share(ids, labels, at, columns, places)


def _nearest(share: Share, q_ids: list, vectors: pa.Array, k: int, same_ids: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of the share and their distances (masked: null) for every query: the k first by distance and id.

    A matrix product bounds the distances; those that may be among the first are summed again component by component.
    """
    n, out = _lengths(vectors), [None] * len(q_ids)
    for length in np.unique(n):
        rows, known = np.flatnonzero(n == length), share.at.get(int(length), np.zeros(0, int)) if length >= 0 else np.zeros(0, int)
        c = share.columns[int(length)] if len(known) else np.zeros((max(0, length), 0))
        unknown = np.sort(np.concatenate([np.zeros(0, int), *[r for x, r in share.at.items() if x != length or length < 0]]))
        squares = (c * c).sum(0)
        for begin in range(0, len(rows), step := max(1, AT_ONCE // max(1, len(known)))):
            part = rows[begin : begin + step]
            q = _matrix(vectors, part, length) if length > 0 else np.zeros((len(part), 0))
            own = (q * q).sum(1)
            with np.errstate(all="ignore"):
                near = own[:, None] + squares - 2 * (q @ c)
                slack = 1e-12 * (length + 4) * (own[:, None] + squares)
            for i, row in enumerate(part):
                gone = np.array(share.places.get(q_ids[row], []), int) if same_ids else np.zeros(0, int)
                least, most = near[i] - slack[i], near[i] + slack[i]
                may = np.ones(len(known), bool)
                if len(gone):
                    may = ~np.isin(known, gone)
                if may.sum() > k:
                    bar = np.partition(np.where(may & ~np.isnan(most), most, np.inf), k - 1)[k - 1]
                    may &= ~(least > bar)
                some = np.flatnonzero(may)
                d = np.zeros(len(some))
                with np.errstate(all="ignore"):
                    for j in range(length):
                        d += (q[i, j] - c[j, some]) ** 2
                first = np.lexsort((known[some], d))[:k]
                got, far = known[some[first]], np.ma.array(d[first])
                if len(got) < k:
                    more = unknown[~np.isin(unknown, gone)][: k - len(got)]
                    got, far = np.concatenate([got, more]), np.ma.concatenate([far, np.ma.masked_all(len(more))])
                out[row] = (got, far)
    return out


def knn_vote(queries: DataFrame, reference: DataFrame, id_col: str, ref_id: str, vector: str, label: str, k: int = 15, parts: int | None = None, same_ids: bool = True) -> DataFrame:
    """id, label, share: proportions among the k nearest rows (of another id, if both tables have the same ids), ties by id.

    A row without a distance (a null vector or component, another length) comes behind all others. All queries meet each
    of parts shares of the reference, of about SHARE_ROWS rows; a task holds one share and streams the queries past it. A
    share keeps k rows a query, and the best of those are merged, so that a query's candidates never meet in one group.
    The work grows with the product of both tables, as every query is compared with every row.
    """
    spark = reference.sparkSession
    parts = parts or max(spark.sparkContext.defaultParallelism, reference.count() // SHARE_ROWS + 1)
    kind, id_kind, label_kind = (reference.schema[c].dataType.simpleString() for c in (vector, ref_id, label))
    none = lambda t: F.lit(None).cast(t)
    q_kind = queries.schema[id_col].dataType.simpleString()
    r = reference.select(F.pmod(F.xxhash64(ref_id), F.lit(parts)).cast("int").alias("_part"), F.lit(False).alias("_is_q"), none(q_kind).alias("_q"), F.col(ref_id).alias("_r"), F.col(vector).alias("_v"), F.col(label).alias("label"))
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), F.lit(True).alias("_is_q"), F.col(id_col).alias("_q"), none(id_kind).alias("_r"), F.col(vector).cast(kind).alias("_v"), none(label_kind).alias("label"))
    if same_ids:
        q = q.filter(F.col("_q").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        share = None
        for batch in batches:
            is_q = batch.column(1)
            if (mine := batch.filter(pc.invert(is_q))).num_rows:
                held.append(mine)
            asked = batch.filter(is_q)
            if not asked.num_rows or not held:
                continue
            if share is None:
                t = pa.Table.from_batches(held).combine_chunks()
                share = _share(*(t.column(c).chunk(0) for c in (3, 4, 5)), k, same_ids)
            found = _nearest(share, asked.column(2).to_pylist(), asked.column(4), k, same_ids)
            at = pa.array(np.concatenate([x for x, _ in found]))
            far = np.ma.concatenate([d for _, d in found])
            who = pa.array(np.repeat(np.arange(len(found)), [len(x) for x, _ in found]))
            yield pa.record_batch([asked.column(2).take(who), share.ids.take(at), share.labels.take(at), pa.array(far.filled(0.0), pa.float64(), mask=np.ma.getmaskarray(far))], ["_q", "_r", "label", "d"])

    dealt = r.unionByName(q).repartitionById(parts, F.col("_part")).sortWithinPartitions("_is_q", "_r")
    d = dealt.mapInArrow(run, f"_q {q_kind}, _r {id_kind}, label {label_kind}, d double")
    order = [F.col("d").asc_nulls_last(), "_r"]
    near = d.withColumn("_n", F.row_number().over(Window.partitionBy("_q").orderBy(*order))).filter(F.col("_n") <= k)
    out = near.groupBy(F.col("_q").alias(id_col), "label").agg(F.count("*").alias("_c"))
    return out.withColumn("share", F.col("_c") / F.sum("_c").over(Window.partitionBy(id_col))).drop("_c")


def simplex_fit(a: np.ndarray, b: np.ndarray, weight: float = 1e4, steps: int = 200) -> np.ndarray:
    """x >= 0 that sums to 1 and minimises |a x - b|, by active sets on the system with a heavy row for the sum."""
    m = np.vstack([a, np.full(a.shape[1], weight)])
    y = np.append(b, weight)
    free, x = np.zeros(m.shape[1], bool), np.zeros(m.shape[1])
    for _ in range(steps):
        slope = m.T @ (y - m @ x)
        if free.all() or slope[~free].max() <= 1e-9 * weight:
            break
        free[np.flatnonzero(~free)[slope[~free].argmax()]] = True
        while True:
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(m[:, free], y, rcond=None)[0]
            low = free & (s <= 0)
            if not low.any():
                x = s
                break
            x = x + (x[low] / (x[low] - s[low])).min() * (s - x)
            free &= x > 1e-12
            x[~free] = 0
    return x / x.sum() if x.sum() > 0 else np.full(len(x), 1 / len(x))


def mixture(points: DataFrame, id_cols: Sequence[str], vector: str, means: Sequence[Sequence[float]], labels: Sequence[str], rounded: bool = True) -> DataFrame:
    """id columns, label, fraction of a mixture of the means; rounded to 4, what that leaves put on the largest (ties: the first label)."""
    a = np.array(means, float).T
    names, ids = list(labels), list(id_cols)
    kinds = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in ids)

    def fit(batches):
        for pdf in batches:
            out = []
            for *key, v in zip(*(pdf[c] for c in ids), pdf[vector], strict=True):
                x = simplex_fit(a, np.array(v, float))
                if rounded:
                    x = np.round(x, 4)
                    x[x.argmax()] = round(x[x.argmax()] + round(1 - x.sum(), 8), 4)
                out += [(*key, n, float(f)) for n, f in zip(names, x, strict=True)]
            yield pd.DataFrame(out, columns=[*ids, "label", "fraction"])

    return points.select(*ids, vector).mapInPandas(fit, f"{kinds}, label string, fraction double")


#: The distribution of a Poisson variable of mean 1, in units of 2^-32: a uniform number's place among these is how often a marker is drawn.
DRAWS = [int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def draws(marker: Column, resamples: int) -> Column:
    """How often each of `resamples` resamples of the markers draws a marker: an array, from digests of marker and number."""
    number = lambda r: F.conv(F.substring(F.md5(F.concat_ws(":", marker.cast("string"), r.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    times = lambda u: reduce(lambda x, y: x + y, [(u >= d).cast("int") for d in DRAWS])
    # Numbers first: the digest would else be taken again for each of DRAWS.
    return F.transform(F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), number), times)


def resampled_points(dosages: DataFrame, loadings: DataFrame, by: str, marker: str, n_components: int, resamples: int = 100) -> DataFrame:
    """by, resample, point: the projection (see project) over markers drawn with replacement, as often as there are markers.

    Draws of a marker are Poisson numbers, scaled by a resample's total, so they need no order of markers; all resamples
    are sums of one aggregate, in which each map task adds up its rows first.
    """
    drawn = loadings.withColumn("_draws", draws(F.col(marker), resamples))
    total = drawn.select(F.posexplode("_draws").alias("resample", "_d")).groupBy("resample").agg(F.sum("_d").alias("_sum"), F.count("*").alias("_markers"))
    z = F.when(F.col("sd") > 0, (F.col("dosage") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    rows = dosages.filter("dosage is not null").join(drawn, marker).select(by, z.alias("_z"), "load", F.posexplode("_draws").alias("resample", "_d"))
    # A draw of 0 stays, so that a sample has all its resamples.
    sums = rows.groupBy(by, "resample").agg(*[F.sum(F.col("_d") * F.col("_z") * F.get("load", F.lit(i))).alias(f"_{i}") for i in range(n_components)])
    scale = F.coalesce(F.try_divide("_markers", "_sum"), F.lit(0.0))
    return sums.join(total, "resample").select(by, "resample", F.array(*[F.col(f"_{i}") * scale for i in range(n_components)]).alias("point"))


def mixture_bounds(points: DataFrame, id_col: str, means: Sequence[Sequence[float]], labels: Sequence[str], width: float = 0.95) -> DataFrame:
    """id, label, low and high: percentiles of the fractions of resampled points (id, resample, point), rounded to 4."""
    parts = mixture(points, [id_col, "resample"], "point", means, labels, rounded=False)
    ends = [(1 - width) / 2, (1 + width) / 2]
    return parts.groupBy(id_col, "label").agg(*[F.round(F.percentile("fraction", F.lit(e)), 4).alias(n) for e, n in zip(ends, ("low", "high"), strict=True)])


def inverse_distance_fractions(df: DataFrame, id_col: str, label: str, distance: str) -> DataFrame:
    w = F.try_divide(F.lit(1.0), F.col(distance))
    return df.withColumn("_w", w).withColumn("fraction", F.round(F.col("_w") / F.sum("_w").over(Window.partitionBy(id_col)), 4)).select(id_col, label, "fraction")
