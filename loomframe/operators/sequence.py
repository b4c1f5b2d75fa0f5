"""Ordered sequences: islands, eligible blocks and the greedy scan for homozygous runs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomframe.durable import cut
from loomframe.operators import ordered

MAX_GAP_BP, HET_WINDOW, HET_TOLERANCE, MIN_SPAN_BP, MIN_HOM = 1_000_000, 50, 1, 1_500_000, 100


def islands(df: DataFrame, by: Sequence[str], order: str, gap: float, value: Column | None = None) -> DataFrame:
    """df with island (from 1 in each group): a step over gap, in the units of order or of value, begins a new one.

    value has to grow with order. The value before a row and the number of islands are carried along the group's pieces.
    """
    rows = ordered.pieces(df.withColumn("_value", value if value is not None else F.col(order)), by, [order])
    rows = ordered.before(rows, _previous=(F.max, F.col("_value")))
    step = F.col("_value") - F.col("_previous")
    rows = ordered.before(rows.withColumn("_new", F.when(step.isNull() | (step > gap), 1).otherwise(0)), _islands=(F.sum, F.col("_new")))
    return rows.select(*df.columns, (F.coalesce("_islands", F.lit(0)) + F.col("_new")).cast("long").alias("island"))


def island_summary(df: DataFrame, by: Sequence[str], order: str, gap: float, value: Column | None = None) -> DataFrame:
    at = (value if value is not None else F.col(order)).alias("_at_value")
    rows = islands(df.select(*by, order, at), by, order, gap, F.col("_at_value"))
    return rows.groupBy(*by, "island").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def eligible(df: DataFrame, by: Sequence[str], pos: str, gap: int = MAX_GAP_BP, least: int = MIN_HOM, span: int = MIN_SPAN_BP) -> DataFrame:
    """by and whether some gap-free block has enough markers and span for any run."""
    blocks = island_summary(df, by, pos, gap)
    return blocks.groupBy(*by).agg(F.bool_or((F.col("n") >= least) & (F.col("last") - F.col("first") >= span)).alias("eligible"))


def scan_runs(pos: np.ndarray, het: np.ndarray, gap: int, window: int, tolerance: int, span: int, least: int) -> list[tuple[int, int, int]]:
    """start, end, homozygous sites of each run. A run is extended until a gap, or until a heterozygous site would be one too
    many among the last `window` sites of the run; the next begins where it broke. Runs are trimmed to homozygous ends."""
    n, out, at = len(pos), [], 0
    breaks = np.append(np.flatnonzero(np.diff(pos) > gap) + 1, n)
    hets, homs = np.flatnonzero(het), np.flatnonzero(~het)
    # Heterozygous sites that are one too many with the `tolerance` before them.
    last = np.arange(tolerance, len(hets))
    excess = last[hets[last] - hets[last - tolerance] < window]
    while at < n:
        stop = int(breaks[np.searchsorted(breaks, at, "right")])
        first = np.searchsorted(excess, np.searchsorted(hets, at) + tolerance)
        if first < len(excess) and hets[excess[first]] < stop:
            stop = max(int(hets[excess[first]]), at + 1)
        lo, hi = np.searchsorted(homs, (at, stop))
        if hi > lo and hi - lo >= least and pos[homs[hi - 1]] - pos[homs[lo]] >= span:
            out.append((int(pos[homs[lo]]), int(pos[homs[hi - 1]]), int(hi - lo)))
        at = stop
    return out


def homozygous_runs(df: DataFrame, by: Sequence[str], pos: str, het: Column, gap: int = MAX_GAP_BP, window: int = HET_WINDOW, tolerance: int = HET_TOLERANCE, span: int = MIN_SPAN_BP, least: int = MIN_HOM) -> DataFrame:
    """by, start, end, length_kb, n_hom. het: true, false, or null for sites that take no part. Of sites at one place homozygous ones come first.

    A tolerance of 1 means that a run breaks at each heterozygous site with another less than `window` sites before it on
    its side of the last gap. So breaks follow from the last place, the last such site and the last gap, which are carried
    along a group's pieces, and a stretch of any length is spread over tasks. With another tolerance the scan depends on
    where it restarted; then stretches between gaps are scanned, those first left out that are too short for a run.
    """
    rows = df.select(*by, F.col(pos).cast("long").alias("_p"), het.alias("_h")).filter("_p is not null and _h is not null")
    if tolerance != 1:
        return _scanned(rows, by, gap, window, tolerance, span, least)
    rows = ordered.before(ordered.pieces(rows, by, ["_p", "_h"]), _previous=(F.max, F.col("_p")), _n=(F.sum, F.lit(1)))
    far = F.col("_previous").isNull() | (F.col("_p") - F.col("_previous") > gap)
    rows = rows.withColumns({"_n": F.coalesce("_n", F.lit(0)), "_far": far})
    rows = ordered.before(rows, _stretch=(F.max, F.when(F.col("_far"), F.col("_n"))), _het=(F.max, F.when(F.col("_h"), F.col("_n"))))
    one_too_many = F.col("_h") & (F.col("_n") - F.col("_het") < window) & (F.col("_het") >= F.col("_stretch"))
    rows = rows.withColumn("_broken", F.when(F.col("_far") | F.coalesce(one_too_many, F.lit(False)), F.col("_n")))
    rows = ordered.before(rows, _run=(F.max, F.col("_broken"))).withColumn("_run", F.coalesce("_broken", "_run"))
    hom = F.when(~F.col("_h"), F.col("_p"))
    runs = rows.groupBy(*by, "_run").agg(F.min(hom).alias("start"), F.max(hom).alias("end"), F.count(hom).alias("n_hom"))
    runs = runs.filter((F.col("n_hom") > 0) & (F.col("n_hom") >= least) & (F.col("end") - F.col("start") >= span))
    return runs.select(*by, "start", "end", _kilobases(F.col("end") - F.col("start")).alias("length_kb"), "n_hom")


@F.pandas_udf(DoubleType())
def _kilobases(bases: pd.Series) -> pd.Series:
    """Thousands to one place, the binary value rounded to even, which no column function does; for whole runs only."""
    return pd.Series([round(x / 1000, 1) for x in bases], dtype=float)


def _scanned(rows: DataFrame, by: Sequence[str], gap: int, window: int, tolerance: int, span: int, least: int) -> DataFrame:
    rows = cut(islands(rows, by, "_p", gap))
    fit = rows.groupBy(*by, "island").agg(F.count_if(~F.col("_h")).alias("n"), (F.max("_p") - F.min("_p")).alias("d")).filter((F.col("n") >= least) & (F.col("d") >= span))
    rows = rows.join(fit.drop("n", "d"), [*by, "island"], "left_semi").withColumn("_share", F.floor(F.col("island") / 64))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema)

    def scan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_p", "_h"], kind="stable")
        found = scan_runs(pdf["_p"].to_numpy(), pdf["_h"].to_numpy(bool), gap, window, tolerance, span, least)
        return pd.DataFrame([(*key[:-1], s, e, round((e - s) / 1000, 1), n) for s, e, n in found], columns=[*by, "start", "end", "length_kb", "n_hom"])

    return rows.groupBy(*by, "_share").applyInPandas(scan, f"{kinds}, start long, end long, length_kb double, n_hom long")
