"""Scores: weighted sums with status counts, calibration, votes, points and generated rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions import genotype as G


def weighted_score(genotypes: DataFrame, weights: DataFrame, by: Sequence[str] = ("sample_id",), imputed: DataFrame | None = None) -> DataFrame:
    """by, score, n_total, n_used, coverage and a count a status.

    genotypes: by, rsid, chrom, pos, genotype (maf if known); weights: rsid (or chrom, pos), effect_allele, other_allele,
    weight, and weight_id. A weight counts 0 where no dosage is found. imputed: by, chrom, pos, ref, alt, dosage, used
    where nothing typed decides. Only weights that a sample has are joined to it; how many are absent follows from their
    total, so no row is made for a weight that a sample lacks.
    """
    keyed = weights.filter("rsid is not null")
    placed = weights.filter("rsid is null")
    samples = genotypes.select(*by).distinct()
    maf = F.col("maf") if "maf" in genotypes.columns else F.lit(None).cast("double")
    call = F.struct("genotype", maf.alias("maf"))
    g = genotypes.select(*by, "rsid", "chrom", "pos", call.alias("_g"))
    hits = g.drop("chrom", "pos").join(keyed.select("weight_id", "rsid"), "rsid").select(*by, "weight_id", "_g")
    hits = hits.unionByName(g.drop("rsid").join(placed.select("weight_id", "chrom", "pos"), ["chrom", "pos"]).select(*by, "weight_id", "_g"))
    one = hits.groupBy(*by, "weight_id").agg(F.min("_g").alias("_g"))
    rows, total = one, weights.count()
    if imputed is not None:
        doses = imputed.select(*by, "chrom", "pos", F.struct("ref", "alt", "dosage").alias("_i")).groupBy(*by, "chrom", "pos").agg(F.min("_i").alias("_i"))
        rows = rows.join(doses.join(weights.select("weight_id", "chrom", "pos"), ["chrom", "pos"]).drop("chrom", "pos"), [*by, "weight_id"], "full_outer")
    rows = rows.join(weights.select("weight_id", "effect_allele", "other_allele", "weight"), "weight_id")
    d = G.effect_dosage(F.col("_g.genotype"), F.col("effect_allele"), F.col("other_allele"), F.col("_g.maf"))
    rows = rows.withColumn("_d", F.when(F.col("_g").isNotNull(), d))
    typed = F.col("_d.dosage").cast("double")
    if imputed is not None:
        rows = rows.withColumn("_x", G.imputed_dosage(F.col("_i.ref"), F.col("_i.alt"), F.col("_i.dosage"), F.col("effect_allele"), F.col("other_allele")))
    else:
        rows = rows.withColumn("_x", F.lit(None).cast("double"))
    dose = F.coalesce(typed, "_x")
    status = F.when(typed.isNotNull(), F.col("_d.status")).when(F.col("_x").isNotNull(), "imputed").otherwise(F.coalesce(F.col("_d.status"), F.lit("absent")))
    names = ("matched_ref", "matched_flip", "imputed", "no_call", "unresolved", "missing_freq", "ambiguous_dropped", "absent")
    met = rows.groupBy(*by).agg(F.sum(dose * F.col("weight")).alias("score"), F.count("*").alias("_met"), F.count(dose).alias("n_used"), *[F.count_if(status == s).alias(f"n_{s}") for s in names])
    zero = F.lit(0).cast("long")
    out = samples.join(met, list(by), "left").select(
        *by, F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(total).cast("long").alias("n_total"), F.coalesce("n_used", zero).alias("n_used"),
        *[(F.coalesce(f"n_{s}", zero) + (total - F.coalesce("_met", zero) if s == "absent" else 0)).alias(f"n_{s}") for s in names],
    )
    return out.withColumn("coverage", F.try_divide("n_used", "n_total"))


def expected_score(weights: DataFrame, fractions: Mapping[str, float], least_share: float = 0.5, band: tuple[float, float] = (0.4, 0.6)) -> DataFrame:
    """One row: mean and sd of a score over a population mixed by fractions (group -> share), n_used and n_total.

    weights has weight, effect_allele, other_allele and af_<group>. A row's frequency is the mean over the groups that
    have one, shares rescaled; rows with less than least_share of the shares, and palindromes near one half, are left
    out. mean and sd are null if fewer than half of the rows are left or the deviation is not positive.
    """
    share = sum((F.when(F.col(f"af_{g}").isNotNull(), F.lit(float(f))).otherwise(0.0) for g, f in fractions.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(f"af_{g}") * float(f), F.lit(0.0)) for g, f in fractions.items()), F.lit(0.0))
    p = F.when(share >= least_share, total / share)
    near = (F.upper("other_allele") == G.complement(F.upper("effect_allele"))) & p.between(*band)
    ok = p.isNotNull() & ~F.coalesce(near, F.lit(False))
    w = F.col("weight")
    out = weights.agg(
        F.sum(F.when(ok, 2 * w * p)).alias("mean"), F.sqrt(F.sum(F.when(ok, 2 * w * w * p * (1 - p)))).alias("sd"), F.count_if(ok).alias("n_used"), F.count("*").alias("n_total")
    )
    enough = (F.col("n_used") >= F.ceil(F.col("n_total") * 0.5)) & (F.col("sd") > 0)
    return out.withColumns({"mean": F.when(enough, F.col("mean")), "sd": F.when(enough, F.col("sd"))})


def qualified(coverage: Column, calibrated: Column, mismatch: Column, top_fraction: Column) -> dict[str, Column]:
    """Flags of a score: sufficient coverage, warning of few top weights, and whether a percentile is shown."""
    enough = coverage >= 0.5
    return {"sufficient": enough, "top_warning": top_fraction < 0.70, "ancestry_mismatch": mismatch, "show_percentile": enough & calibrated}


def sex_gated(df: DataFrame, trait: str, sex: Column, required: Mapping[str, str], numbers: Sequence[str]) -> DataFrame:
    """df with gate (the sex that a sex-specific trait requires where the sample's is not known to be that one, else null);
    a gated row keeps its trait and loses its numbers. An unknown sex is no match."""
    needs = F.create_map(*[F.lit(x) for pair in required.items() for x in pair])[F.col(trait)] if required else F.lit(None).cast("string")
    gate = F.when(needs.isNotNull() & ~F.coalesce(sex == needs, F.lit(False)), needs)
    out = df.withColumn("gate", gate)
    return out.withColumns({c: F.when(F.col("gate").isNull(), F.col(c)) for c in numbers})


def z_score(df: DataFrame, by: Sequence[str], value: str, least: int = 3) -> DataFrame:
    """df with z: distance from the mean of the *other* rows of its group in their sample deviations; null below least others or without spread."""
    x = F.col(value).cast("double")
    stats = df.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.count(x).alias("_n"), F.avg(x).alias("_mean"), F.var_pop(x).alias("_var"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    n, mean = F.col("_n"), F.col("_mean")
    m, off = n - 1, x - F.col("_mean")
    # What x adds to the sum of squares about the mean is taken away, so no large squares are subtracted.
    var = (n * F.col("_var") - off * off * n / m) / (m - 1)
    z = F.when((m >= least) & x.isNotNull(), F.when(var > 1e-12, (off + off / m) / F.sqrt(var)))
    return df.join(stats, same, "left").select(*df.columns, z.alias("z"))


def axis_votes() -> list[Column]:
    """The four votes on damage; each is null without its scores."""
    from loomframe.functions.scalar import majority

    score_or = lambda score, test, letter, bad: F.when(F.col(score).isNotNull(), test).otherwise(F.when(F.col(letter).isNotNull(), F.col(letter).isin(*bad)))
    sift = score_or("sift_score", F.col("sift_score") < 0.05, "sift_pred", ("D",))
    polyphen = score_or("polyphen2_hsvar_score", F.col("polyphen2_hsvar_score") > 0.909, "polyphen2_hsvar_pred", ("D",))
    cadd = F.col("cadd_phred") >= 20
    meta = majority(F.col("revel") >= 0.5, F.col("metasvm") > 0, F.col("metalr") > 0.5)
    return [sift, polyphen, cadd, meta]


def damage(df: DataFrame) -> DataFrame:
    """df with deleterious_count, deleterious_total_assessed and ensemble_pathogenic (two or more assessed, most of them damaging)."""
    from loomframe.functions.scalar import votes

    yes, given = votes(*axis_votes())
    out = df.withColumns({"deleterious_count": yes, "deleterious_total_assessed": given})
    return out.withColumn("ensemble_pathogenic", (F.col("deleterious_total_assessed") >= 2) & (F.col("deleterious_count") * 2 > F.col("deleterious_total_assessed")))


#: Points of each strength.
STRENGTH = {"Very Strong": 8, "Strong": 4, "Moderate": 2, "Supporting": 1, "Standalone": 8}


def criterion(code: str, when: Column, points: Column | int) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), (F.lit(points) if isinstance(points, int) else points).cast("int").alias("points")))


def classify_points(df: DataFrame, criteria: Sequence[Column], standalone: str = "BA1") -> DataFrame:
    """df with criteria (those met), points and classification; the standalone code decides by itself."""
    met = F.filter(F.array(*criteria), lambda x: x.isNotNull())
    out = df.withColumn("criteria", met).withColumn("points", F.aggregate("criteria", F.lit(0), lambda a, x: a + x["points"]))
    p = F.col("points")
    label = F.when(F.exists("criteria", lambda x: x["code"] == standalone), "Benign").when(p >= 10, "Pathogenic").when(p >= 6, "Likely pathogenic").when(p <= -7, "Benign").when(p <= -1, "Likely benign")
    return out.withColumn("classification", label.otherwise("Uncertain significance"))


def variant_criteria() -> list[Column]:
    """Criteria over consequence, gene_lof, gene_missense (may be null), missense_z, popmax_af, af_alleles, revel."""
    terms = F.transform(F.split(F.lower(F.coalesce("consequence", F.lit(""))), "[&,;]"), lambda t: F.trim(t))
    has = lambda *names: F.arrays_overlap(terms, F.array(*[F.lit(n) for n in names]))
    af, n, revel, missense = F.col("popmax_af"), F.col("af_alleles"), F.col("revel"), has("missense_variant")
    nonsense, splice = has("transcript_ablation", "stop_gained", "frameshift_variant"), has("splice_donor_variant", "splice_acceptor_variant")
    high = F.when(revel >= 0.932, 4).when(revel >= 0.773, 2).when(revel >= 0.644, 1)
    low = F.when(revel <= 0.003, -8).when(revel <= 0.016, -4).when(revel <= 0.183, -2).when(revel <= 0.290, -1)
    return [
        criterion("PVS1", F.col("gene_lof") & (nonsense | splice | has("start_lost")), F.when(nonsense, 8).when(splice, 4).otherwise(2)),
        criterion("PM2", af < 1e-4, 1),
        criterion("PM4", has("inframe_insertion", "inframe_deletion", "stop_lost"), 2),
        criterion("PP2", missense & F.col("gene_missense") & (F.col("missense_z") >= 3.09), 1),
        criterion("PP3", missense & high.isNotNull(), high),
        criterion("BP4", missense & high.isNull() & low.isNotNull(), low),
        criterion("BA1", (af > 0.05) & (n >= 2000), -8),
        criterion("BS1", (af > 0.01) & (af <= 0.05) & (n >= 2000), -4),
        criterion("BP7", has("synonymous_variant") & ~has("splice_region_variant"), -1),
    ]


def condition(dosages: Mapping[str, Column], spec: Any, key: str) -> Column:
    """Whether a locus' dosage meets a spec: a number, a list of numbers, or min and max; an unknown dosage never does."""
    if key == "total":
        parts = [dosages[r] for r in spec["rsids"]]
        d = parts[0]
        for p in parts[1:]:
            d = d + p  # null if one is unknown
    else:
        d = dosages.get(key, F.lit(None).cast("int"))
    if isinstance(spec, int):
        out = d == spec
    elif isinstance(spec, list | tuple):
        out = d.isin(*spec)
    else:
        out = d.isNotNull()
        out = out & (d >= spec["min"]) if "min" in spec else out
        out = out & (d <= spec["max"]) if "max" in spec else out
    return F.coalesce(out, F.lit(False))


def concordant_dosages(dosages: Mapping[str, Column], partners: Mapping[str, Sequence[str]]) -> tuple[dict[str, Column], Column]:
    """dosages in which that of a tag is unknown where a known partner has fewer copies, and the array of such tags.

    A partner that has more, or that isn't known, says nothing against the tag. Partners' own dosages are read as they were.
    """
    below = {}
    for tag, others in partners.items():
        less = [F.coalesce(dosages[p] < dosages[tag], F.lit(False)) for p in others if p in dosages]
        below[tag] = reduce(lambda x, y: x | y, less, F.lit(False))
    adjusted = {n: F.when(~below[n], d) if n in below else d for n, d in dosages.items()}
    discordant = F.filter(F.array(*[F.when(b, F.lit(n)) for n, b in below.items()]), lambda x: x.isNotNull()) if below else F.array().cast("array<string>")
    return adjusted, discordant


def classify_rules(
    df: DataFrame, dosages: Mapping[str, Column], models: Sequence[Mapping[str, Any]], mode: str = "first_match", suppressed: Column | None = None,
    partners: Mapping[str, Sequence[str]] | None = None, caveat: Column | None = None,
) -> DataFrame:
    """df with calls, names of the matching models in order: the first only, or all. A model has name, match and perhaps veto, another match that must not hold.

    With partners (tag -> markers that have to have as many copies) dosages are made concordant first, and discordant
    lists the tags that were not. caveat is a text beside calls that stand, as of another ancestry; suppressed takes them away.
    """
    if partners is not None:
        dosages, discordant = concordant_dosages(dosages, partners)
        df = df.withColumn("discordant", discordant)
    items = []
    for m in models:
        ok = F.lit(True)
        for key, spec in m["match"].items():
            ok = ok & condition(dosages, spec, key)
        if "veto" in m:
            bad = F.lit(True)
            for key, spec in m["veto"].items():
                bad = bad & condition(dosages, spec, key)
            ok = ok & ~bad
        items.append(F.when(ok, F.lit(m["name"])))
    calls = F.filter(F.array(*items), lambda x: x.isNotNull())
    if mode == "first_match":
        calls = F.slice(calls, 1, 1)
    elif mode != "collect_all":
        raise ValueError(f"unknown mode: {mode}")
    if suppressed is not None:
        calls = F.when(F.coalesce(suppressed, F.lit(False)), F.array().cast("array<string>")).otherwise(calls)
    out = df.withColumn("calls", calls)
    return out if caveat is None else out.withColumn("caveat", F.when(F.size("calls") > 0, caveat))


def disease_status(df: DataFrame, gene: str, mode: str, zygosity: str, locus: Sequence[str]) -> DataFrame:
    """df with status: dominant het or hom is affected; recessive hom is affected, two different het loci of a gene possible_biallelic, else carrier."""
    key = F.struct(*locus)
    het = F.size(F.collect_set(F.when(F.col(zygosity) == "het", key)).over(Window.partitionBy(gene)))
    m, z = F.upper(F.col(mode)), F.col(zygosity)
    known = F.when(m.isin("AD", "AR"), m).otherwise(F.raise_error(F.concat(F.lit("unknown mode: "), F.coalesce(m, F.lit("null")))))
    carried = z.isin("het", "hom_alt")
    recessive = F.when(z == "hom_alt", "affected").when(het >= 2, "possible_biallelic").otherwise("carrier")
    return df.withColumn("status", F.when(carried, F.when(known == "AD", "affected").otherwise(recessive)))
