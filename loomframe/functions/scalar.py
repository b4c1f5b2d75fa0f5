"""Column functions for ranks, bands, votes, flags and bit masks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Review statuses and their stars.
REVIEW_STARS = {
    "practice guideline": 4, "reviewed by expert panel": 3, "criteria provided, multiple submitters, no conflicts": 2, "criteria provided, conflicting classifications": 1,
    "criteria provided, conflicting interpretations": 1, "criteria provided, single submitter": 1, "no assertion for the individual variant": 0, "no assertion criteria provided": 0,
    "no assertion provided": 0, "no classification provided": 0,
}
#: Bits of the sources in a coverage mask.
COVERAGE_BITS = {"vep": 1, "clinvar": 2, "gnomad": 4, "dbnsfp": 8, "gene_phenotype": 16, "cpic": 32, "gwas": 64, "alphamissense": 128}


def as_map(values: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def ranked(c: Column, ranks: Mapping[str, int], unknown: int = 0) -> Column:
    """A code's rank by a fixed table."""
    return F.coalesce(F.try_element_at(as_map(ranks), c), F.lit(unknown))


def max_term_rank(c: Column, ranks: Mapping[str, int], sep: str = "&", unknown: int = 0, missing: int = -1) -> Column:
    """The highest rank among the terms of a compound label; missing for null."""
    table = as_map(ranks)
    return F.when(c.isNull(), F.lit(missing)).otherwise(F.array_max(F.transform(F.split(c, f"[{sep}]"), lambda t: F.coalesce(F.try_element_at(table, t), F.lit(unknown)))))


def significance_label(c: Column) -> Column:
    """Underscores as spaces; what stands before the first slash, unless it is a risk-allele term."""
    spaced = F.replace(c, F.lit("_"), F.lit(" "))
    return F.when(F.contains(F.lower(spaced), F.lit("risk allele")), spaced).otherwise(F.trim(F.substring_index(spaced, "/", 1)))


def band(c: Column, cuts: Sequence[tuple[float, str]], otherwise: str, missing: str | None = None) -> Column:
    """The label of the first cut that c reaches; cuts go down."""
    out = F.when(c.isNull(), F.lit(missing))
    for least, label in cuts:
        out = out.when(c >= least, label)
    return out.otherwise(otherwise)


def votes(*axes: Column) -> tuple[Column, Column]:
    """How many nullable votes are true, and how many are not null."""
    yes = sum((F.coalesce(a.cast("int"), F.lit(0)) for a in axes), F.lit(0))
    given = sum((a.isNotNull().cast("int") for a in axes), F.lit(0))
    return yes, given


def majority(*axes: Column) -> Column:
    """Strict majority of the votes given; null without any."""
    yes, given = votes(*axes)
    return F.when(given > 0, yes * 2 > given)


def arg_max(columns: Mapping[str, Column], paired: Mapping[str, Column] | None = None) -> Column:
    """struct(value, name, paired) of the largest non-null column, the first of equal ones; null if all are null."""
    entries = [
        F.when(c.isNotNull(), F.struct(c.alias("value"), F.lit(-i).alias("i"), F.lit(name).alias("name"), (paired[name] if paired else F.lit(None).cast("long")).alias("paired")))
        for i, (name, c) in enumerate(columns.items())
    ]
    best = F.array_max(F.array(*entries))
    return F.when(best.isNotNull(), F.struct(best["value"].alias("value"), best["name"].alias("name"), best["paired"].alias("paired")))


def rare_flags(af: Column, rare: float = 0.01, ultra: float = 0.001) -> tuple[Column, Column]:
    some = af.isNotNull() & (af > 0)
    return F.coalesce(some & (af < rare), F.lit(False)), F.coalesce(some & (af < ultra), F.lit(False))


def effective_af(*afs: Column) -> Column:
    """The first frequency that lies in 0..1."""
    return F.coalesce(*[F.when(a.between(0.0, 1.0), a) for a in afs])


def implausible_homozygote(af: Column, hom_count: Column, most: float = 1e-4) -> Column:
    """No homozygote was seen and none is expected: the frequency is unknown or its square is at most `most`."""
    return ~F.coalesce(hom_count > 0, F.lit(False)) & (af.isNull() | (af * af <= most))


def mask_of(present: Mapping[int, Column]) -> Column:
    """A mask with each bit whose condition holds."""
    out = F.lit(0)
    for bit, c in present.items():
        out = out.bitwiseOR(F.when(c, F.lit(bit)).otherwise(F.lit(0)))
    return out


def with_bit(mask: Column, bit: int) -> Column:
    return F.coalesce(mask, F.lit(0)).bitwiseOR(F.lit(bit))


def mask_names(mask: Column, bits: Mapping[str, int]) -> Column:
    """Names of the bits that are set, in the order given; an empty list for null."""
    items = F.array(*[F.when(F.coalesce(mask, F.lit(0)).bitwiseAND(F.lit(b)) != 0, F.lit(n)) for n, b in bits.items()])
    return F.filter(items, lambda x: x.isNotNull())


def clinical_level(stars: Column, baseline: Column) -> Column:
    """Evidence level 1 to 4 by review stars."""
    return F.when(stars >= 2, 4).when(stars == 1, 3).otherwise(F.least(baseline, F.lit(2)))


def letter_level(letter: Column) -> Column:
    return ranked(F.upper(letter), {"A": 4, "B": 3, "C": 2, "D": 1}, 1)


def association_level(p: Column, ratio: Column, replicated: Column) -> Column:
    hit = p < 5e-8
    return F.when(hit & (ratio > 5), 4).when(hit & F.coalesce(replicated, F.lit(False)), 3).when(hit, 2).otherwise(1)


def capped(level: Column, most: int) -> Column:
    return F.least(level, F.lit(most))


def chromosome_order(c: Column, order: Sequence[str], unknown: int = 99) -> Column:
    return F.coalesce(F.try_element_at(as_map({name: i for i, name in enumerate(order, 1)}), c), F.lit(unknown))


def consequence_terms(mc: Column) -> Column:
    """Terms of "SO:ddddddd|term" items in order, joined by &; null if any item is malformed."""
    good = mc.rlike(r"^SO:\d{7}\|[^|,]+(,SO:\d{7}\|[^|,]+)*$")
    return F.when(good, F.array_join(F.array_distinct(F.regexp_extract_all(mc, F.lit(r"SO:\d{7}\|([^|,]+)"), F.lit(1))), "&"))


#: A published rational approximation of the normal tail, highest power first.
TAIL_OVER = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_UNDER = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by column functions, with an error below 1e-14: a rational function up to 7.07, a continued fraction beyond."""
    x = F.abs(z)

    def power_sum(terms: Sequence[float]) -> Column:
        out = F.lit(terms[0])
        for t in terms[1:]:
            out = out * x + F.lit(t)
        return out

    density = F.exp(-x * x / 2)
    far = x + 0.65
    for k in (4, 3, 2, 1):
        far = x + F.lit(float(k)) / far
    tail = F.when(x > 37, 0.0).when(x < 7.07106781186547, density * power_sum(TAIL_OVER) / power_sum(TAIL_UNDER)).otherwise(density / far / 2.506628274631)
    return F.when(z.isNull() | F.isnan(z), F.lit(None).cast("double")).when(z > 0, 1 - tail).otherwise(tail)


def percentile(score: Column, mean: Column, sd: Column) -> Column:
    """Rounded percentile of a score; 50 if the deviation is not positive."""
    z = F.when(sd > 0, (score - mean) / sd).otherwise(F.lit(0.0))
    return F.round(normal_cdf(F.round(z, 4)) * 100, 2)


def since_epoch(ts: Column, unit: str = "SECOND") -> Column:
    """Whole units since 1970 of a timestamp with or without zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff(unit, start, ts)
