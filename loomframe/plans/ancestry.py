"""The composed ancestry plan: calls to dosages, a projection, the nearest centroid with its verdict, and mixture fractions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions import genotype as G
from loomframe.operators import vectors

#: The frequency column that matches a population; any other has the global one.
FREQUENCY_COLUMNS = {
    "AFR": "gnomad_af_afr", "AMR": "gnomad_af_amr", "ASJ": "gnomad_af_asj", "CSA": "gnomad_af_sas", "EAS": "gnomad_af_eas", "EUR": "gnomad_af_eur",
    "MID": "gnomad_af_global", "OCE": "gnomad_af_global",
}


def frequency_column(population: Column) -> Column:
    """The name of the frequency column for a population, case ignored."""
    names = F.create_map(*[F.lit(x) for pair in FREQUENCY_COLUMNS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.upper(population)), F.lit("gnomad_af_global"))


def agreement(one: DataFrame, other: DataFrame, by: str) -> DataFrame:
    """by and confidence: the cosine similarity of two tables of label and fraction, clipped to 0..1, rounded to 4; 0 where one has no direction."""
    both = one.select(by, "label", F.col("fraction").alias("x")).join(other.select(by, "label", F.col("fraction").alias("y")), [by, "label"], "full_outer")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    sums = both.groupBy(by).agg(F.sum(x * y).alias("xy"), F.sqrt(F.sum(x * x)).alias("nx"), F.sqrt(F.sum(y * y)).alias("ny"))
    cosine = F.when((F.col("nx") >= 1e-10) & (F.col("ny") >= 1e-10), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("xy") / (F.col("nx") * F.col("ny"))))).otherwise(0.0)
    return sums.select(by, F.round(cosine, 4).alias("confidence"))


def infer(
    calls: DataFrame, bundle: DataFrame, centroids: Mapping[str, Sequence[float]], by: str = "sample_id", least: float = 0.55, margin: float = 3.0,
    resamples: int = 0, reference: DataFrame | None = None, neighbours: int = 15,
) -> DataFrame:
    """by, point, coverage, missing_rate, nearest, distance, second_distance, verdict, frequency_column and fractions (label -> share of
    a mixture of the centroids); with resamples of the markers low and high (label -> bound of 95 %); with a reference
    (ref_id, point, label) knn_fractions and confidence, the agreement of both.

    calls: by, rsid, genotype; bundle: rsid, ref, alt, mean, sd, load (array of the components). A call whose alleles
    don't decide, or that is missing, stands at its marker's mean. A sample with no marker of the bundle gives no row.
    """
    one = calls.groupBy(by, "rsid").agg(F.min("genotype").alias("_g"))
    dosages = one.join(bundle.select("rsid", "ref", "alt"), "rsid").select(by, "rsid", G.risk_dosage(F.col("_g"), F.col("alt"), F.col("ref")).alias("dosage"))
    names = sorted(centroids)
    middles = [list(centroids[n]) for n in names]
    loadings = bundle.select("rsid", "mean", "sd", "load")
    points = vectors.project(dosages, loadings, by, "rsid", len(middles[0]))
    means = calls.sparkSession.createDataFrame([(n, [float(x) for x in v]) for n, v in centroids.items()], "label string, centroid array<double>")
    near = vectors.nearest_centroid(points.select(by, "point", "coverage"), means, by, "point", "label", coverage=F.col("coverage"), least=least, margin=margin)
    as_map = lambda df, value, to: df.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", value)))).alias(to))
    parts = vectors.mixture(points, [by], "point", middles, names)
    out = points.withColumn("missing_rate", F.round(1 - F.col("coverage"), 4)).join(near, by).withColumn("frequency_column", frequency_column(F.col("verdict"))).join(as_map(parts, "fraction", "fractions"), by)
    if resamples:
        drawn = vectors.resampled_points(dosages, loadings, by, "rsid", len(middles[0]), resamples)
        bounds = vectors.mixture_bounds(drawn, by, middles, names)
        out = out.join(as_map(bounds, "low", "low"), by).join(as_map(bounds, "high", "high"), by)
    if reference is not None:
        votes = vectors.knn_vote(points.select(by, "point"), reference, by, "ref_id", "point", "label", neighbours, same_ids=False).withColumn("fraction", F.round("share", 4))
        # What rounding leaves goes to the largest share.
        top = votes.groupBy(by).agg(F.sum("fraction").alias("_sum"), F.min_by("label", F.struct(-F.col("fraction"), F.col("label"))).alias("_top"))
        rest = F.when(F.col("label") == F.col("_top"), F.round(F.col("fraction") + 1 - F.col("_sum"), 4)).otherwise(F.col("fraction"))
        votes = votes.join(top, by).select(by, "label", rest.alias("fraction"))
        out = out.join(as_map(votes, "fraction", "knn_fractions"), by).join(agreement(parts, votes, by), by)
    return out
