"""Top-k search against all exact scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import topk

KIND = "vec_id long, embedding array<float>"


def plain(vectors, k, scale=64):
    own = {i: [int(np.floor(scale * float(np.float32(x)))) for x in v] for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(own):
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(own[q], v)), i) for i, v in own.items() if i != q and len(v) == len(own[q]))
            out += [(q, n, i, -x) for n, (x, i) in enumerate(s[:k], 1)]
    return out


@pytest.mark.parametrize("bits", [1, 3, 8])  # bits kept of a component
def test_exact_with_ties_and_bad_rows(spark, rows, bits):
    r = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in r.normal(0, 0.3, 8).round(1)]) for i in range(230)]
    vectors += [(1000, None), (1001, [0.1, None] * 4), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (1004, []), (None, [0.1] * 8), (1005, [0.5] * 3), (1020, [0.25] * 3), (1040, [9e4] * 8)]
    df = spark.createDataFrame(vectors, KIND)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=20, cell_bits=bits, query_block=5, slice_rows=60)
    assert rows(got.select("query_id", "rank", "vec_id", "score")) == sorted(plain(vectors, 20), key=repr)


def test_few_candidates_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], KIND).withColumns({"v": F.lit(1), "dim": F.lit(2), "rank": F.lit(3)})
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()]
    assert got == [(0, 1, 1, 2048), (0, 2, 1, 2048), (0, 3, 2, 2048)]
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=2).collect()] == got[:2]
    assert topk.top_k(spark.createDataFrame([], KIND), F.col("vec_id") % 20 == 0).count() == 0


def test_one_very_common_vector_and_outliers(spark, rows):
    r = np.random.default_rng(8)
    vectors = [(i, [0.5] * 6 if i % 3 else [float(x) for x in r.normal(0, 0.4, 6)]) for i in range(300)] + [(301, [3e6] * 6), (302, [-3e6] + [0.0] * 5), (340, [0.5] * 6)]
    got = topk.top_k(spark.createDataFrame(vectors, KIND), F.col("vec_id") % 20 == 0, k=20, cell_bits=4, fit_rows=30)
    assert rows(got) == sorted(plain(vectors, 20), key=repr)


def test_an_id_with_two_vectors_and_a_long_one(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (20, [0.01] * 40_000), (21, [0.02] * 40_000)], KIND)
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got[:4] == [(0, 1, 2, 64 * 192), (0, 2, 1, 64 * 128), (0, 3, 1, 0), (0, 4, 2, 0)] and len(got) == 5 and got[4][2] == 21


def packed_cells(v, bits=5):
    low, high = topk.usual(v[:300])
    odd = topk.far(v, low, high)
    return topk.Cells(low, high, v[~odd].min(0), v[~odd].max(0), bits), odd


def reads(v, n=40):
    """Exact reads of n queries: vectors whose upper bound reaches the 20th score, and far ones."""
    cells, odd = packed_cells(v)
    own, total = cells.unpack(cells.pack(v[~odd])), 0
    for i, (_, _, high) in ((i, b) for i in range(n) for b in cells.bounds(v[i : i + 1], own)):
        total += (high[0] >= np.sort(v @ v[i])[-21]).sum() + odd.sum()
    return total


def test_cells_hold_their_vectors_and_spare_most_exact_reads():
    r = np.random.default_rng(1)
    v = np.floor(64 * r.normal(0, 0.125, (5000, 64))).astype(np.int64)
    cells, odd = packed_cells(v)
    assert not odd.any()
    packed = cells.pack(v)
    assert {len(x) for x in packed} == {40}
    own, at = cells.unpack(packed), np.arange(64)[None, :]
    assert (cells.low[at, own] <= v).all() and (v <= cells.high[at, own]).all()
    (_, low, high), = cells.bounds(v[7:8], own)
    s = v @ v[7]
    assert (low[0] <= s).all() and (s <= high[0]).all()
    assert (high[0] >= np.sort(s)[-21]).sum() < 250
    plain_reads = reads(v)
    v[4000, 3], v[4001, 60] = 6400, -70000
    assert packed_cells(v)[1].sum() == 2 and reads(v) < 1.1 * plain_reads


def test_many_lengths(spark, rows, monkeypatch):
    monkeypatch.setattr(topk, "LENGTHS", 3)
    r = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in r.normal(0, 1, 1 + i % 7)]) for i in range(200)]
    got = topk.top_k(spark.createDataFrame(vectors, KIND), F.col("vec_id") % 20 == 0, k=4)
    assert rows(got) == sorted(plain(vectors, 4), key=repr)
