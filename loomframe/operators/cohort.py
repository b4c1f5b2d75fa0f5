"""Statistics of pairs of samples and of samples as a whole."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.durable import cut
from loomframe.functions import genotype as G
from loomframe.operators import ordered


WORD, BLOCK_WORDS = 64, 1024  # markers of a word, and words of a block of markers


def bit_planes(df: DataFrame, sample: str, key: str, first: Column, second: Column) -> DataFrame:
    """s, block and words (an array of word and planes: typed, het, and two bits of the first letter) for each sample and block of
    markers. Calls that aren't two of A, C, G, T take no part; of several calls of a sample at a marker the least counts.

    Markers are numbered by their order; a word has 64 of them, a block 65,536, so a sample's calls of a block are 32 kB.
    """
    calls = df.select(F.col(sample).alias("s"), F.col(key).alias("k"), first.alias("x"), second.alias("y")).filter(F.col("k").isNotNull() & F.col("x").isin(*"ACGT") & F.col("y").isin(*"ACGT"))
    calls = calls.groupBy("s", "k").agg(F.min(F.struct("x", "y")).alias("c")).select("s", "k", "c.x", "c.y")
    markers = calls.select("k").distinct().withColumn("_all", F.lit(0))
    markers = ordered.numbered(ordered.pieces(markers, ["_all"], ["k"]), "m").select("k", "m")
    bit = F.expr(f"shiftleft(1L, cast(m % {WORD} as int))")
    code = F.instr(F.lit("ACGT"), F.col("x")) - 1
    plane = lambda on, name: F.bit_or(F.when(on, bit).otherwise(F.lit(0).cast("long"))).alias(name)
    het = F.col("x") != F.col("y")
    words = calls.join(markers, "k").groupBy("s", F.floor(F.col("m") / WORD).alias("w")).agg(plane(F.lit(True), "t"), plane(het, "h"), plane(code % 2 == 1, "a"), plane(code >= 2, "b"))
    entry = F.struct((F.col("w") % BLOCK_WORDS).cast("int").alias("w"), "t", "h", "a", "b")
    return words.groupBy("s", F.floor(F.col("w") / BLOCK_WORDS).alias("block")).agg(F.collect_list(entry).alias("words"))


def _pair_counts(table: pa.Table) -> pa.Table:
    """Counts of all pairs of samples of two groups of samples (or of one) over one block of markers, by popcounts."""
    ids, group = table.column("s").to_pylist(), np.array(table.column("g"))
    planes = np.zeros((len(ids), 4, BLOCK_WORDS), np.uint64)
    for i, words in enumerate(table.column("words").combine_chunks()):
        flat = words.values
        for p, name in enumerate("thab"):
            planes[i, p, flat.field("w").to_numpy()] = flat.field(name).to_numpy().view(np.uint64)
    typed, het, low, high = planes.transpose(1, 0, 2)
    hom = typed & ~het
    order = {i: n for n, i in enumerate(sorted(range(len(ids)), key=lambda i: ids[i]))}
    one = len(set(group)) == 1 and table.column("i")[0] == table.column("j")[0]
    left = np.arange(len(ids)) if one else np.flatnonzero(group == table.column("i")[0].as_py())
    right = left if one else np.flatnonzero(group == table.column("j")[0].as_py())
    rank = np.array([order[i] for i in range(len(ids))])
    count = lambda x: np.bitwise_count(x).sum(1, dtype=np.int64)
    out = []
    for i in left:
        for later in (True, False):  # a pair stands under its lesser sample
            j = right[rank[right] > rank[i]] if later else right[rank[right] < rank[i]]
            if (one and not later) or not len(j):
                continue
            shared = count(typed[i] & typed[j])
            hets = count(het[i] & typed[j]), count(typed[i] & het[j])
            opposed = count(hom[i] & hom[j] & ((low[i] ^ low[j]) | (high[i] ^ high[j])))
            both = count(het[i] & het[j])
            pairs = [(ids[i], ids[x]) if later else (ids[x], ids[i]) for x in j]
            out += [(*p, *map(int, n)) for p, *n in zip(pairs, shared, *(hets if later else hets[::-1]), both, opposed, strict=True) if n[0]]
    kind = table.schema.field("s").type
    names = [pa.field("s", kind), pa.field("s2", kind), *(pa.field(n, pa.int64()) for n in ("n_shared", "het_i", "het_j", "hethet", "ibs0"))]
    columns = zip(*out, strict=True) if out else [()] * len(names)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, names, strict=True)], schema=pa.schema(names))


def pair_statistic(df: DataFrame, sample: str, key: str, first: Column, second: Column, least: int = 2000, group_size: int = 128) -> DataFrame:
    """Relationship of each pair of samples that share keys: counts, phi, ibs0_proportion, label and why it is indeterminate.

    first, second: the two letters of a call. phi = (het in both - 2 * opposite homozygotes) / (het of one + het of the other).
    Samples are dealt to groups of about group_size; each pair of groups meets once for each block of markers, with 32 kB of
    bits a sample, so what is shuffled grows with samples times groups, not with markers times pairs.
    """
    planes = cut(bit_planes(df, sample, key, first, second))
    n = math.ceil(planes.select("s").distinct().count() / group_size) or 1
    own = planes.withColumn("g", F.pmod(F.xxhash64("s"), F.lit(n)).cast("int"))
    met = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("block", F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), "g", "s", "words")
    kind = planes.schema["s"].dataType.simpleString()
    counted = met.groupBy("block", "i", "j").applyInArrow(_pair_counts, f"s {kind}, s2 {kind}, n_shared long, het_i long, het_j long, hethet long, ibs0 long")
    out = counted.groupBy("s", "s2").agg(*[F.sum(c).alias(c) for c in ("n_shared", "het_i", "het_j", "hethet", "ibs0")])
    phi = F.try_divide(F.col("hethet") - 2 * F.col("ibs0"), F.col("het_i") + F.col("het_j"))
    share = F.col("ibs0") / F.col("n_shared")
    reason = F.when(phi.isNull(), "no_heterozygous_information").when(F.col("n_shared") < least, "insufficient_shared_snps")
    label = (
        F.when(reason.isNotNull(), "indeterminate")
        .when(phi > 0.354, "duplicate_or_mz_twin")
        .when(phi >= 0.177, F.when(share < 0.0012, "parent_offspring").otherwise("full_sibling"))
        .when(phi >= 0.0884, "second_degree")
        .when(phi >= 0.0442, "third_degree")
        .otherwise("unrelated")
    )
    return out.withColumns({"phi": F.round(phi, 4), "ibs0_proportion": F.round(share, 5), "relationship": label, "indeterminate_reason": reason})


def sex_signals(df: DataFrame, by: str, chrom: str = "chrom", pos: str = "pos", genotype: str = "genotype") -> DataFrame:
    """A row a sample: counts on X outside its pseudoautosomal parts and on Y, in one aggregate."""
    g, c = F.col(genotype), F.col(chrom)
    called = ~G.is_no_call(g)
    x = (c == "X") & ~G.in_x_par(F.col(pos)) & called
    a, b = F.substring(g, 1, 1), F.substring(g, 2, 1)
    pair, single = F.length(g) == 2, F.length(g) == 1
    out = df.groupBy(by).agg(
        F.count_if(x & pair & (a != b)).alias("x_het"), F.count_if(x & pair & (a == b)).alias("x_hom"), F.count_if(x & single).alias("x_hemizygous"),
        F.count_if(c == "Y").alias("y_total"), F.count_if((c == "Y") & called).alias("y_typed"),
    )
    typed = F.col("x_het") + F.col("x_hom") + F.col("x_hemizygous")
    return out.withColumns({"x_typed": typed, "y_rate": F.coalesce(F.try_divide("y_typed", "y_total"), F.lit(0.0))})


def infer_sex(signals: DataFrame) -> DataFrame:
    """signals with sex (XX, XY, manual_review, unknown) and aneuploidy (possible_xxy, no_aneuploidy_signal, manual_review, indeterminate)."""
    thin = (F.col("x_typed") < 100) | (F.col("y_total") < 50)
    rate, y = F.try_divide("x_het", "x_typed"), F.col("y_rate")
    one, two = rate <= 0.05, rate >= 0.15
    sex = (
        F.when(thin, "unknown")
        .when(one, F.when(y > 0.30, "XY").when(y > 0.10, "manual_review").otherwise("unknown"))
        .when(two, F.when(y > 0.10, "manual_review").otherwise("XX"))
        .otherwise("manual_review")
    )
    screen = F.when(thin, "indeterminate").when(two & (y > 0.30), "possible_xxy").when(two & (y > 0.10), "manual_review").when(~one & ~two, "manual_review").otherwise("no_aneuploidy_signal")
    return signals.withColumns({"sex": sex, "aneuploidy": screen})
