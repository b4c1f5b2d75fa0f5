"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

The model is P(grade <= k) = sigmoid(threshold_k - w . x): one weight a feature, shared by all ordered thresholds. x marks
which of the selected words, and 4-letter beginnings of words, a text has. A text's severity is its expected grade.

Grades come from the labels alone: by default 0 for a text that is not toxic, 1 for a toxic one and 2 for one that is
labelled as of low quality as well; any ordered whole numbers can be given. Without a grade above 1 in the labels there is
one threshold. Features are selected by their counts in a sample of labelled texts of bounded size (max_rows different
texts, by a hash of id and text); selected presence lists of that sample, at most max_rows times max_features bits, are
all that reaches the driver.

Defined results: a null or empty text has no features and gets the model's base rate. Repeated rows each get the same
result. An id with several labels has the greatest grade; an id with several texts labels each of them, and a text that
an id repeats counts once. Labels that are null, or of no document, take no part. Without labels of both kinds every text
has severity 0. An empty table gives an empty result; extra columns are ignored. A very long text is read as a whole, one
at a time in a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import cut, to_python

WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str | None) -> set[str]:
    words = set(WORD.findall((text or "").lower()))
    return words | {f"{w[:4]}-" for w in words if len(w) > 5}


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]
    levels: list[int] = field(default_factory=lambda: [0])

    def chances(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= level) of each level but the first."""
        return 1 / (1 + np.exp(np.array(self.thresholds)[None, :] - score[:, None])) if self.thresholds else np.zeros((len(score), 0))

    def severity(self, score: np.ndarray) -> np.ndarray:
        """Expected grade: the sum over levels of their steps times the chance of reaching them."""
        return self.chances(score) @ np.diff(np.array(self.levels, float)) + self.levels[0]

    def grade(self, score: np.ndarray, at_least: float) -> np.ndarray:
        """The highest level that is reached with a chance over at_least."""
        return np.array(self.levels)[(self.chances(score) > at_least).sum(1)]


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_features: int, n_grades: int, steps: int = 300, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from marks (row, feature) and grades y, by Adam on the likelihood. Threshold gaps stay positive."""
    n = len(y)
    share = np.clip(np.array([(y <= k).mean() for k in range(n_grades - 1)]), 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    p = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for t in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        th = p[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(rows, weights=w[cols], minlength=n)
        edge = np.concatenate([[-np.inf], th, [np.inf]])
        hi, lo = sigmoid(edge[y + 1] - score), sigmoid(edge[y] - score)
        hi, lo = np.where(y == n_grades - 1, 1.0, hi), np.where(y == 0, 0.0, lo)
        mass = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / mass, lo * (1 - lo) / mass  # of the log-likelihood by the edges
        g_score = (d_hi - d_lo) / n
        g = np.zeros_like(p)
        g[:n_features] = np.bincount(cols, weights=g_score[rows], minlength=n_features) + l2 * w
        g_th = np.array([-(d_hi[y == k].sum() - d_lo[y == k + 1].sum()) / n for k in range(n_grades - 1)])
        g[n_features] = g_th.sum()
        g[n_features + 1 :] = np.cumsum(g_th[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])


def graded(labels: DataFrame, toxic: str = "toxic", quality: str = "quality") -> Column:
    """0 if not toxic, 1 if toxic, 2 if toxic and of low quality."""
    low = F.coalesce(F.col(quality) == 0, F.lit(False)) if quality in labels.columns else F.lit(False)
    return F.when(F.col(toxic) <= 0, 0).when(F.col(toxic) > 0, F.when(low, 2).otherwise(1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", grade: Column | None = None, max_rows: int = 20_000, max_features: int = 2000, min_rows: int = 5) -> Model:
    """A model from at most max_rows labelled texts. grade: of columns of labels."""
    grade = graded(labels) if grade is None else grade
    own = labels.select(F.col(id_col).alias("_id"), grade.cast("int").alias("y")).filter("_id is not null and y >= 0").groupBy("_id").agg(F.max("y").alias("y"))
    own = _sampled(own, ["_id"], max_rows)
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text")).withColumn("_th", F.xxhash64("_text"))
    picked = cut(_sampled(keyed.select("_id", "_th").join(F.broadcast(own), "_id").distinct(), ["_id", "_th"], max_rows))
    rows = cut(keyed.join(F.broadcast(picked), ["_id", "_th"]).dropDuplicates(["_id", "_th"]).select("y", "_text"))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.record_batch([part.column(0), pa.array([list(features_of(x.as_py())) for x in part.column(1)], pa.list_(pa.string()))], ["y", "f"])

    marked = to_python(rows, marks, "y int, f array<string>")
    counts = marked.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.count_if(F.col("y") > 0).alias("a"), F.count_if(F.col("y") == 0).alias("b")).filter(F.col("a") + F.col("b") >= min_rows)
    n = {r["t"]: r["n"] for r in rows.groupBy((F.col("y") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    if not (n.get(True) and n.get(False)):
        return Model({}, [])
    odds = F.log((F.col("a") + 0.5) / (n[True] - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n[False] - F.col("b") + 0.5))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = counts.select("f", F.abs(odds / error).alias("z")).orderBy(F.col("z").desc(), "f").limit(max_features).collect()
    names = {r["f"]: i for i, r in enumerate(best)}

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[names[f] for f in features_of(x.as_py()) if f in names] for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["y", "at"])

    # sorted, as rows come in the order of tasks and sums of floats depend on it
    sample = sorted(zip(*to_python(rows, chosen, "y int, at array<int>").toArrow().to_pydict().values(), strict=True), key=lambda r: (r[0], sorted(r[1])))
    lists, levels = [sorted(at) for _, at in sample], sorted({y for y, _ in sample})
    y = np.searchsorted(levels, [y for y, _ in sample])
    w, th = fit_ordinal(np.repeat(np.arange(len(lists)), list(map(len, lists))), np.array([c for at in lists for c in at], np.int64), y, len(names), len(levels))
    return Model({f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3}, [float(x) for x in th], levels)


def _sampled(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """At most `most` of rows, by a hash of key: first a cut that leaves about 1.1 times as many, so that each task sends its share only."""
    n, cells = rows.count(), 1 << 30
    place = F.pmod(F.xxhash64(*key), F.lit(cells))
    if n > most:
        rows = rows.filter(place < int(cells * min(1.0, 1.1 * most / n))).orderBy(place, *key).limit(most)
    return rows


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", at_least: float = 0.2) -> DataFrame:
    """doc_id, severity (expected grade), grade (the highest that is reached with a chance over at_least) and toxic (grade above the lowest)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights
        for batch in batches:
            # a sum in a fixed order, as that of a set differs from run to run
            sums = np.array([sum(sorted(weights[f] for f in features_of(x.as_py()) if f in weights)) for x in batch.column(1)], float)
            grade = model.grade(sums, at_least)
            yield pa.record_batch([batch.column(0), pa.array(model.severity(sums)), pa.array(grade.astype(np.int32)), pa.array(grade > model.levels[0])], ["doc_id", "severity", "grade", "toxic"])

    return to_python(rows, run, "doc_id long, severity double, grade int, toxic boolean")
