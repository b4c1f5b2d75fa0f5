"""The enrichment pipeline: calls joined to every reference source, merged into one wide table, and queried.

A record is met by id or by place. Where all records of an id stand at the place of its calls, those at the place are all there
are, so records are shuffled by place only, once, and a call meets a place's records as arrays. The other ids (scattered())
are met by id before: a left join, then an aggregate of the candidates by the call's row, which takes the best with min_by.

picked() does both for single sources, by joins. There calls are dealt by id once and by place once; all joins of a kind and
their aggregates stay in that partitioning, so candidates are never shuffled.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.durable import cut, forget
from loomframe.functions import genotype as G
from loomframe.functions import scalar as S
from loomframe.operators import rules, scores
from loomframe.operators.intervals import lift
from loomframe.operators.lookup import concordant
from loomframe.sources import text

#: Consequence terms by severity.
SEVERITY = {
    "transcript_ablation": 35, "splice_acceptor_variant": 34, "splice_donor_variant": 33, "stop_gained": 32, "frameshift_variant": 31, "stop_lost": 30, "start_lost": 29, "transcript_amplification": 28,
    "feature_elongation": 27, "feature_truncation": 26, "inframe_insertion": 25, "inframe_deletion": 24, "missense_variant": 23, "protein_altering_variant": 22, "splice_donor_5th_base_variant": 21,
    "splice_region_variant": 20, "splice_donor_region_variant": 19, "splice_polypyrimidine_tract_variant": 18, "incomplete_terminal_codon_variant": 17, "start_retained_variant": 16, "stop_retained_variant": 15,
    "synonymous_variant": 14, "coding_sequence_variant": 13, "mature_miRNA_variant": 12, "5_prime_UTR_variant": 11, "3_prime_UTR_variant": 10, "non_coding_transcript_exon_variant": 9, "intron_variant": 8,
    "NMD_transcript_variant": 7, "non_coding_transcript_variant": 6, "upstream_gene_variant": 5, "downstream_gene_variant": 4, "TFBS_ablation": 3, "TFBS_amplification": 2, "TF_binding_site_variant": 1,
    "regulatory_region_ablation": 1, "regulatory_region_amplification": 1, "regulatory_region_variant": 1, "intergenic_variant": 0,
}
#: Significances that computed evidence may contradict.
CONTESTABLE = ("Uncertain significance", "Benign", "Likely benign", "Uncertain_significance", "Likely_benign", "VUS")
BENIGN = ("Benign", "Likely benign", "Benign/Likely benign", "Likely_benign")
POPULATIONS = ("global", "afr", "amr", "eas", "eur", "fin", "sas", "asj")


@dataclass
class Sources:
    """Reference tables; None leaves a source out. Columns are those of the table schemas in FIXTURES.md."""

    merges: DataFrame | None = None
    vep: DataFrame | None = None
    clinvar: DataFrame | None = None
    gnomad: DataFrame | None = None
    dbnsfp: DataFrame | None = None
    alphamissense: DataFrame | None = None
    gene_phenotype: DataFrame | None = None


def carried(g: Column, ref: Column, alt: Column) -> Column:
    return F.coalesce(G.zygosity(g, ref, alt).isin("het", "hom_alt"), F.lit(False))


def row_key() -> Column:
    """What an annotation depends on, as one key: equal calls share it, and it is the same in every branch of the plan."""
    return F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in ("rsid", "chrom", "pos", "genotype")])


#: Rows without an id or a place are spread over this many keys, which no record has.
SPREAD = 1024


def spread(known: Column, by: Sequence[str] = ("_row",)) -> Column:
    return F.when(known, -1).otherwise(F.pmod(F.xxhash64(*by), F.lit(SPREAD)).cast("int"))


def some_key(name: str) -> Column:
    """-1 of every record; a plain literal would be taken out of the join's keys, and with it the spreading."""
    return F.least(F.length(F.col(name).cast("string")), F.lit(-1))


def once(calls: DataFrame) -> DataFrame:
    """A row for equal calls, with _copies, dealt by lookup_id: all joins by id and their aggregates stay in this partitioning."""
    known = F.col("chrom").isNotNull() & F.col("pos").isNotNull()
    rows = calls.withColumns({"_by_id": spread(F.col("lookup_id").isNotNull()), "_by_place": spread(known)})
    return rows.repartition("lookup_id", "_by_id").groupBy(*rows.columns).agg(F.count("*").alias("_copies"))


def again(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")).drop("_copy", "_copies", "_by_id", "_by_place")


@dataclass
class Pick:
    """What is chosen among a call's candidates s (columns of source): to, by an aggregate that is null without any.

    same: whether a record met by id counts. Records met by place are for calls without a choice by id.
    listed: the same choice, out of an array of candidates; alone: of a single one (null way: it doesn't count).
    """

    to: str
    source: DataFrame
    columns: Sequence[str]
    choose: Callable[[int], Column]
    same: Column | None = None
    listed: Callable[[Column, int], Column] | None = None
    alone: Callable[[Column, Column], Column] | None = None


def by_id(calls: DataFrame, pick: Pick) -> DataFrame:
    """once() with pick.to of the candidates by id; the aggregate needs no shuffle behind the join's."""
    packed = pick.source.select(F.col("rsid").alias("_id"), some_key("rsid").alias("_none"), F.struct(*pick.columns).alias("s"))
    on = (F.col("lookup_id") == F.col("_id")) & (F.col("_by_id") == F.col("_none"))
    found = calls.join(packed, on if pick.same is None else on & pick.same, "left")
    return found.groupBy(*calls.columns).agg(pick.choose(0).alias(pick.to))


def by_place(calls: DataFrame, pick: Pick) -> DataFrame:
    """calls with pick.to, by place for those that have none; all such joins and aggregates share one partitioning."""
    packed = pick.source.select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), some_key("chrom").alias("_none"), F.struct(*pick.columns).alias("s"))
    probe, row = G.probe_class(F.col("genotype")), G.row_class(F.col("s.ref"), F.col("s.alt"))
    on = (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p")) & (F.col("_by_place") == F.col("_none"))
    found = calls.join(packed, on & F.col(pick.to).isNull() & (probe.isNull() | row.isNull() | (probe == row)), "left")
    return found.groupBy(*calls.columns).agg(pick.choose(1).alias("_by")).withColumn(pick.to, F.coalesce(pick.to, "_by")).drop("_by")


def picked(calls: DataFrame, *picks: Pick) -> DataFrame:
    """once(calls) with the choice of every pick: first by id, then by place."""
    for p in picks:
        calls = by_id(calls, p)
    for p in picks:
        calls = by_place(calls, p)
    return calls


def single(s: Column, way: Column) -> Column:
    return F.when(way.isNotNull(), F.struct(s.alias("s"), way.alias("way")))


def best(order: Callable[[Column], Sequence[Column]]) -> tuple[Callable[[int], Column], Callable[[Column, int], Column]]:
    """The first candidate by order, as an aggregate and out of an array."""
    s = F.col("s")
    rank = F.when(s.isNotNull(), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order(s))]))
    listed = lambda found, way: F.when(F.size(found) > 0, F.struct(least(found, order).alias("s"), F.lit(way).alias("way")))
    return lambda way: F.min_by(F.when(s.isNotNull(), F.struct("s", F.lit(way).alias("way"))), rank), listed


def least(found: Column, order: Callable[[Column], Sequence[Column]]) -> Column:
    """The first of an array by order; null if it is empty."""
    ranked = F.transform(found, lambda s: F.struct(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order(s))]).alias("o"), s.alias("s")))
    # of one record there is nothing to rank
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(F.array_min(ranked)["s"])


def hit(s: Column) -> Column:
    return carried(F.col("genotype"), s["ref"], s["alt"])


def kinds(found: Column) -> Column:
    """The number of alleles in an array of records."""
    return F.when(F.size(found) < 2, F.size(found)).otherwise(F.size(F.array_distinct(F.transform(found, lambda s: F.struct(s["ref"], s["alt"])))))


def vep_pick(vep: DataFrame) -> Pick:
    """The transcript of a call: MANE first, then severity, then id; several alleles only if the call carries exactly one of them.

    A choice is a struct: vep (s and way; null if ambiguous), ambiguous and single (one allele).
    """

    def order(s: Column) -> list[Column]:
        mane = F.coalesce(s["mane_select"].cast("int"), F.lit(0)) > 0
        return [F.when(mane, 0).otherwise(1), -S.max_term_rank(s["consequence"], SEVERITY), s["transcript_id"], s["alt"]]

    s = F.col("s")
    some, allele = s.isNotNull(), F.struct("s.ref", "s.alt")
    rank = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order(s))])

    def choice(n: Column, h: Column, any_: Column, own: Column) -> Column:
        one = F.when(n <= 1, any_).when(h == 1, own)
        return F.when(n > 0, F.struct(one.alias("vep"), ((n > 1) & (h != 1)).alias("ambiguous"), (n == 1).alias("single")))

    def choose(way: int) -> Column:
        n, h = F.size(F.collect_set(F.when(some, allele))), F.size(F.collect_set(F.when(some & hit(s), allele)))
        value = F.struct("s", F.lit(way).alias("way"))
        return choice(n, h, F.min_by(value, F.when(some, rank)), F.min_by(value, F.when(some & hit(s), rank)))

    def listed(found: Column, way: int) -> Column:
        hits = F.filter(found, hit)
        value = lambda x: F.struct(least(x, order).alias("s"), F.lit(way).alias("way"))
        return F.when(F.size(found) > 0, choice(kinds(found), kinds(hits), value(found), value(hits)))

    def alone(s: Column, way: Column) -> Column:
        return F.when(way.isNotNull(), F.struct(single(s, way).alias("vep"), F.lit(False).alias("ambiguous"), F.lit(True).alias("single")))

    return Pick("_vep", vep, ["ref", "alt", "gene_symbol", "transcript_id", "consequence", "hgvs_coding", "hgvs_protein", "mane_select"], choose, None, listed, alone)


def clinvar_pick(clinvar: DataFrame) -> Pick:
    """The assertion of a call: one it carries, then most stars; an id's record must stand at the call's place (an indel one base before it)."""
    anchored = (G.probe_class(F.col("genotype")) == "indel") & (G.row_class(F.col("s.ref"), F.col("s.alt")) == "indel") & (F.col("rsid") == F.col("lookup_id"))
    same = concordant(F.col("chrom"), F.col("pos"), F.col("s.chrom"), F.col("s.pos"), anchored)
    choose, listed = best(lambda s: [~hit(s), -F.coalesce(s["review_stars"], F.lit(0)), s["accession"], s["alt"]])
    return Pick("clinvar", clinvar, ["ref", "alt", "significance", "review_stars", "accession", "conditions", "gene_symbol", "chrom", "pos"], choose, same, listed, single)


def dbnsfp_pick(dbnsfp: DataFrame) -> Pick:
    """Scores of a call: a carried allele first, then the least ALT and REF."""
    columns = ["ref", "alt", "cadd_phred", "sift_score", "sift_pred", "polyphen2_hsvar_score", "polyphen2_hsvar_pred", "revel", "metasvm", "metalr"]
    source = dbnsfp.select("rsid", "chrom", "pos", *[F.col(c) if c in dbnsfp.columns else F.lit(None).cast("string" if c.endswith("pred") else "double").alias(c) for c in columns])
    choose, listed = best(lambda s: [~hit(s), s["alt"], s["ref"]])
    return Pick("dbnsfp", source, columns, choose, None, listed, single)


def gnomad_by_id(calls: DataFrame, gnomad: DataFrame) -> DataFrame:
    """once() with _loose: frequencies (gnomad, status) by id, if one allele is left; for calls whose alleles aren't known."""
    here = (F.col("chrom") == F.col("s._c")) & (F.col("pos") == F.col("s._p"))
    # places and alleles of one id are few, so their sets are small
    value = F.col("s.v")
    own = carried(F.col("genotype"), value["ref"], value["alt"])
    alleles = lambda c: F.array_sort(F.collect_set(F.when(c, value)))
    places = F.size(F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s._c", "s._p"))))
    sets = F.struct(F.count("s").alias("n"), places.alias("places"), alleles(F.lit(True)).alias("all"), alleles(here).alias("here"), alleles(own).alias("hits"), alleles(here & own).alias("here_hits"))
    source = gnomad.select("rsid", F.col("chrom").alias("_c"), F.col("pos").alias("_p"), F.struct(*frequencies(gnomad)).alias("v"))
    n = by_id(calls, Pick("_n", source, ["_c", "_p", "v"], lambda way: sets))
    several = F.col("_n.places") > 1
    pool, own = F.when(several, F.col("_n.here")).otherwise(F.col("_n.all")), F.when(several, F.col("_n.here_hits")).otherwise(F.col("_n.hits"))
    return n.withColumn("_loose", F.when(F.col("_n.n") > 0, loose(pool, own))).drop("_n")


def loose(pool: Column, own: Column) -> Column:
    """The frequencies of the one allele in a pool of different records, else of the one that the call carries, with a status."""
    one = F.when(kinds(pool) == 1, F.get(pool, F.lit(0))).when(kinds(own) == 1, F.get(own, F.lit(0)))
    status = F.when(F.size(pool) == 0, "locus_unresolved").when((kinds(pool) == 1) | (kinds(own) == 1), "matched").otherwise("allele_ambiguous")
    return F.struct(one.alias("gnomad"), status.alias("status"))


def gnomad_by_place(calls: DataFrame, gnomad: DataFrame) -> DataFrame:
    """calls (ref, alt, _loose) with gnomad and status: by exact place and alleles where both are known, with no way back after a miss."""
    return exact_or_loose(at_alleles(calls, gnomad, frequencies(gnomad), "_exact", F.min))


def exact_or_loose(calls: DataFrame) -> DataFrame:
    known = F.col("ref").isNotNull() & F.col("alt").isNotNull()
    status = F.when(F.col("_exact").isNotNull(), "matched")
    return calls.withColumns({"gnomad": F.when(known, F.col("_exact")).otherwise(F.col("_loose.gnomad")), "status": F.when(known, status).otherwise(F.col("_loose.status"))}).drop("_exact", "_loose")


def frequencies(gnomad: DataFrame) -> list[Column]:
    columns = ["ref", "alt", *[f"af_{p}" for p in POPULATIONS], "homozygous_count"]
    return [F.col(c) if c in gnomad.columns else F.lit(None).cast("double").alias(c) for c in columns]


def at_alleles(calls: DataFrame, source: DataFrame, columns: Sequence[Column], to: str, least: Callable[[Column], Column]) -> DataFrame:
    """calls with the least (or another aggregate) of the records at their place with their alleles; in the partitioning of by_place()."""
    packed = source.select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), some_key("chrom").alias("_none"), F.struct("ref", "alt").alias("_a"), F.struct(*columns).alias("s"))
    on = (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p")) & (F.col("_by_place") == F.col("_none"))
    found = calls.join(packed, on, "left")
    exact = (F.col("ref") == F.col("_a.ref")) & (F.col("alt") == F.col("_a.alt"))
    return found.groupBy(*calls.columns).agg(least(F.when(exact, F.col("s"))).alias(to))


def lookup_id() -> Column:
    """The id by which a call's records are met."""
    return some_id(F.coalesce("dbsnp_rsid_current", "rsid"))


def some_id(c: Column) -> Column:
    """What stands for no id is none, else all such calls and records would meet."""
    return F.when(~F.trim(c).isin("", "."), c)


def finer(df: DataFrame) -> int:
    return FINER * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Scattered ids up to this number (8 bytes each) are broadcast; more are joined by a shuffle.
FEW_IDS = 5_000_000
#: Partitions by place and of the ids' places, in those of a shuffle: a task sorts its records and calls in memory.
FINER = 8


def id_key(name: str) -> Column:
    """An id in 8 bytes. Ids that share one are scattered together, which changes no result."""
    return F.when(F.col(name).isNotNull(), F.xxhash64(name))


def scattered(calls: DataFrame, tables: Sequence[DataFrame]) -> tuple[DataFrame, int]:
    """Ids (_key) with a call and a record at different places, or with one whose place isn't known; and their number."""
    unknown = F.col("chrom").isNull() | F.col("pos").isNull()
    place = [F.xxhash64("chrom").alias("c"), F.col("pos").cast("long").alias("p")]
    seen = lambda df, name, bit: df.withColumn("_id", some_id(F.col(name))).select(id_key("_id").alias("_key"), *place, F.when(unknown, bit | 4).otherwise(bit).alias("bits")).filter("_key IS NOT NULL")
    rows = seen(calls, "lookup_id", 1)
    for table in tables:
        rows = rows.union(seen(table, "rsid", 2))
    # Few rows share an id in a scan, so they are not aggregated before the shuffle.
    ids = rows.repartition(finer(calls), "_key").groupBy("_key").agg(*[f(x).alias(f"{x}{i}") for x in ("c", "p") for i, f in enumerate((F.min, F.max))], F.bit_or("bits").alias("bits"))
    out = cut(ids.filter("bits = 7 OR (bits = 3 AND (c0 <> c1 OR p0 <> p1))").select("_key"))
    return out, out.count()


def met_by_id(calls: DataFrame, picks: Sequence[Pick], gnomad: DataFrame | None, ids: DataFrame) -> DataFrame:
    """calls (of scattered ids) with the choices by id: those of picks and _loose."""
    own = lambda df: df.join(ids, id_key("rsid") == F.col("_key"), "left_semi")
    out = once(calls.withColumn("_row", row_key()))
    if gnomad is not None:
        out = gnomad_by_id(out, own(gnomad))
    for p in picks:
        out = by_id(out, Pick(p.to, own(p.source), p.columns, p.choose, p.same))
        if "chrom" in p.columns:
            kept = F.struct(*[F.col(f"{p.to}.s.{c}") for c in off_place(p)])
            out = out.withColumn(p.to, F.when(F.col(p.to).isNotNull(), F.struct(kept.alias("s"), F.col(f"{p.to}.way").alias("way"))))
    return again(out).drop("_row")


def off_place(p: Pick) -> list[str]:
    """The columns of a pick's records that its place doesn't tell."""
    return [c for c in p.columns if c not in ("chrom", "pos")]


def at_places(sources: Sequence[tuple[str, DataFrame, Column]], parts: int) -> DataFrame:
    """A row for each place (_c, _p, _none) with an array of records for every source (name, table, record)."""
    rows = None
    for name, table, record in sources:
        own = table.filter("chrom IS NOT NULL AND pos IS NOT NULL").select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), some_key("chrom").alias("_none"), record.alias(name))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    return rows.repartition(parts, "_c", "_p", "_none").groupBy("_c", "_p", "_none").agg(*[F.collect_list(name).alias(name) for name, _, _ in sources])


def met_at_place(calls: DataFrame, picks: Sequence[Pick], gnomad: DataFrame | None, alphamissense: DataFrame | None) -> DataFrame:
    """calls with the choices of picks, _loose, and the place's records of the two other sources as arrays (_gnomad, _am).

    Choices that are there (met_by_id) stay, and _here says whether records at the place are to be met by id.
    """
    sources = [(f"{p.to}_at", p.source, F.struct("rsid", F.struct(*off_place(p)).alias("s"))) for p in picks]
    if gnomad is not None:
        sources.append(("_gnomad", gnomad, F.struct("rsid", F.struct(*frequencies(gnomad)).alias("s"))))
    if alphamissense is not None:
        sources.append(("_am", alphamissense, F.struct(F.struct("am_pathogenicity", "am_class", "ref", "alt").alias("s"))))
    if not sources:
        return calls
    parts = finer(calls)
    known = F.col("chrom").isNotNull() & F.col("pos").isNotNull()
    dealt = calls.drop("lookup_id").withColumn("_by_place", spread(known, ("rsid", "genotype"))).repartition(parts, "chrom", "pos", "_by_place")
    on = (F.col("chrom") == F.col("_c")) & (F.col("pos") == F.col("_p")) & (F.col("_by_place") == F.col("_none"))
    out = dealt.join(at_places(sources, parts).hint("merge"), on, "left").drop("_c", "_p", "_none", "_by_place")
    # Arrays are null where nothing stands. One record, the common case, is taken without a pass over an array.
    out = out.withColumns({"_id": F.when(F.col("_here"), lookup_id()), "_probe": G.probe_class(F.col("genotype"))})
    same_id = lambda x: x["rsid"] == F.col("_id")
    values = lambda found: F.transform(found, lambda x: x["s"])
    only = lambda name: F.get(name, F.lit(0))

    def alike(x: Column) -> Column:
        row = G.row_class(x["s"]["ref"], x["s"]["alt"])
        return F.col("_probe").isNull() | row.isNull() | (F.col("_probe") == row)

    several = {}
    for p in picks:
        near = f"{p.to}_at"
        many = F.size(near) > 1
        several[f"{p.to}_ids"] = F.when(many, values(F.filter(near, same_id)))
        several[f"{p.to}_places"] = F.when(many & ~F.coalesce(F.exists(near, same_id), F.lit(False)), values(F.filter(near, alike)))
    if gnomad is not None:
        several["_pool"] = F.when(F.size("_gnomad") > 1, F.array_sort(F.array_distinct(values(F.filter("_gnomad", same_id)))))
    out = out.withColumns(several)
    chosen = {}
    for p in picks:
        one = only(f"{p.to}_at")
        way = F.when(same_id(one), 0).when(alike(one), 1)
        found = F.when(F.size(f"{p.to}_at") == 1, p.alone(one["s"], way)).otherwise(F.coalesce(p.listed(F.col(f"{p.to}_ids"), 0), p.listed(F.col(f"{p.to}_places"), 1)))
        chosen[p.to] = F.coalesce(p.to, found) if p.to in calls.columns else found
    if gnomad is not None:
        one = only("_gnomad")
        found = F.when(F.size("_gnomad") == 1, F.when(same_id(one), F.struct(one["s"].alias("gnomad"), F.lit("matched").alias("status"))))
        found = found.otherwise(F.when(F.size("_pool") > 0, loose(F.col("_pool"), F.filter("_pool", hit))))
        chosen["_loose"] = F.coalesce("_loose", found) if "_loose" in calls.columns else found
    return out.withColumns(chosen).drop("_id", "_probe", *several, *[f"{p.to}_at" for p in picks])


def with_alleles(name: str, take: Callable[[Column], Column]) -> Column:
    """The least or greatest (take) of a place's records with the alleles ref and alt."""
    own = lambda x: (x["s"]["ref"] == F.col("ref")) & (x["s"]["alt"] == F.col("alt"))
    one = F.get(name, F.lit(0))
    return F.when(F.size(name) == 1, F.when(own(one), one["s"])).otherwise(take(F.transform(F.filter(name, own), lambda x: x["s"])))


def annotate(raw: DataFrame, sources: Sources) -> DataFrame:
    """raw (rsid, chrom, pos, genotype, any other columns) as the wide table of annotated variants, one row a row of raw."""
    if sources.merges is not None:
        now = sources.merges.groupBy(F.col("old_rsid").alias("rsid")).agg(F.max("current_rsid").alias("_now"))
        calls = raw.join(now, "rsid", "left").withColumn("dbsnp_rsid_current", F.col("_now")).drop("_now")
    else:
        calls = raw.withColumn("dbsnp_rsid_current", F.lit(None).cast("string"))
    calls = calls.withColumn("lookup_id", lookup_id())
    tables = (("vep", sources.vep, vep_pick), ("clinvar", sources.clinvar, clinvar_pick), ("dbnsfp", sources.dbnsfp, dbnsfp_pick))
    picks = [pick(table) for _, table, pick in tables if table is not None]
    out = calls.withColumn("_here", F.lit(True))
    with_ids = [table for table in (sources.vep, sources.clinvar, sources.gnomad, sources.dbnsfp) if table is not None]
    if with_ids:
        ids, n = scattered(calls, with_ids)
        gc.collect()  # Python holds the plan that found them, and that the files of its shuffles
        if n:
            ids = F.broadcast(ids) if n <= FEW_IDS else ids
            # Calls without an id are spread, if the ids are many.
            of_them = F.coalesce(id_key("lookup_id"), F.xxhash64("rsid", "chrom", "pos", "genotype")) == F.col("_key")
            apart = met_by_id(calls.join(ids, of_them, "left_semi"), picks, sources.gnomad, ids).withColumn("_here", F.lit(False))
            out = out.join(ids, of_them, "left_anti").unionByName(apart, allowMissingColumns=True)
    out = met_at_place(out, picks, sources.gnomad, sources.alphamissense)
    if sources.vep is not None:
        out = out.withColumns({"vep": F.col("_vep.vep"), "vep_ambiguous": F.col("_vep.ambiguous"), "vep_single": F.col("_vep.single")}).drop("_vep")
    for name, table, _ in tables:
        if table is None:
            kinds = {"vep": "ref string, alt string, gene_symbol string, transcript_id string, consequence string, hgvs_coding string, hgvs_protein string, mane_select int", "clinvar": "ref string, alt string, significance string, review_stars int, accession string, conditions string, gene_symbol string",
                     "dbnsfp": "ref string, alt string, cadd_phred double, sift_score double, sift_pred string, polyphen2_hsvar_score double, polyphen2_hsvar_pred string, revel double, metasvm double, metalr double"}[name]
            inner = ", ".join(f"{n}: {k}" for n, k in (x.strip().split() for x in kinds.split(",")))
            out = out.withColumn(name, F.lit(None).cast(f"struct<s: struct<{inner}>, way: int>"))
            if name == "vep":
                out = out.withColumns({"vep_ambiguous": F.lit(False), "vep_single": F.lit(False)})
    v, c, d = F.col("vep.s"), F.col("clinvar.s"), F.col("dbnsfp.s")
    # The later source wins: clinical alleles before those of an undisputed transcript.
    both = c["ref"].isNotNull() & c["alt"].isNotNull()
    from_vep = F.coalesce("vep_single", F.lit(False)) & v["ref"].isNotNull() & v["alt"].isNotNull()
    out = out.withColumns({"ref": F.when(both, c["ref"]).when(from_vep, v["ref"]), "alt": F.when(both, c["alt"]).when(from_vep, v["alt"])})
    if sources.gnomad is not None:
        out = exact_or_loose(out.withColumn("_exact", with_alleles("_gnomad", F.array_min)))
    else:
        out = out.withColumns({"gnomad": F.lit(None).cast("struct<ref: string, alt: string, " + ", ".join(f"af_{p}: double" for p in POPULATIONS) + ", homozygous_count: double>"), "status": F.lit(None).cast("string")})
    if sources.alphamissense is not None:
        missense = F.contains(F.coalesce(v["consequence"], F.lit("")), F.lit("missense"))
        out = out.withColumn("am", F.when(missense, with_alleles("_am", F.array_max)))
    else:
        out = out.withColumn("am", F.lit(None).cast("struct<am_pathogenicity: double, am_class: string>"))
    gene = F.coalesce(v["gene_symbol"], F.when(~F.coalesce("vep_ambiguous", F.lit(False)), c["gene_symbol"]))
    out = out.withColumn("gene_symbol", gene)
    if sources.gene_phenotype is not None:
        p = sources.gene_phenotype.filter(~F.coalesce(F.lower("disease_name").startswith("obsolete"), F.lit(False)))
        detailed = F.col("hpo_terms").isNotNull() | F.col("inheritance").isNotNull()
        first = p.groupBy("gene_symbol").agg(F.min_by(F.struct("disease_name", "disease_id", "hpo_terms", "inheritance"), F.struct(~detailed, F.col("disease_id"))).alias("gp"))
        out = out.join(first, "gene_symbol", "left").withColumn("gp", F.when(~F.coalesce(c["significance"].isin(*BENIGN), F.lit(False)), F.col("gp")))
    else:
        out = out.withColumn("gp", F.lit(None).cast("struct<disease_name: string, disease_id: string, hpo_terms: string, inheritance: string>"))
    g = F.col("gnomad")
    clash = F.coalesce((g["ref"] != F.col("ref")) | (g["alt"] != F.col("alt")), F.lit(False))
    out = out.withColumns({"gnomad": F.when(~clash, g), "gnomad_source_status": F.when(clash, "allele_mismatch").otherwise(F.col("status"))})
    out = out.withColumn("_max", F.greatest(*[F.col(f"gnomad.af_{p}") for p in POPULATIONS]))
    rare, ultra = S.rare_flags(F.col("_max"))
    bits = S.COVERAGE_BITS
    mask = S.mask_of({bits["vep"]: F.col("vep").isNotNull(), bits["clinvar"]: F.col("clinvar").isNotNull(), bits["gnomad"]: F.col("gnomad").isNotNull(), bits["dbnsfp"]: F.col("dbnsfp").isNotNull(), bits["gene_phenotype"]: F.col("gp").isNotNull(), bits["alphamissense"]: F.col("am").isNotNull()})
    own = [x for x in raw.columns if x not in ("ref", "alt")]
    wide = out.select(
        *own, "ref", "alt", "dbsnp_rsid_current", G.zygosity(F.col("genotype"), F.col("ref"), F.col("alt")).alias("zygosity"), "gene_symbol", v["transcript_id"].alias("transcript_id"), v["consequence"].alias("consequence"),
        v["hgvs_coding"].alias("hgvs_coding"), v["hgvs_protein"].alias("hgvs_protein"), (F.coalesce(v["mane_select"].cast("int"), F.lit(0)) > 0).alias("mane_select"), c["significance"].alias("clinvar_significance"),
        c["review_stars"].alias("clinvar_review_stars"), c["accession"].alias("clinvar_accession"), c["conditions"].alias("clinvar_conditions"), *[F.col(f"gnomad.af_{p}").alias(f"gnomad_af_{p}") for p in POPULATIONS],
        F.col("_max").alias("gnomad_af_popmax"), F.col("gnomad.homozygous_count").alias("gnomad_homozygous_count"), rare.alias("rare_flag"), ultra.alias("ultra_rare_flag"), "gnomad_source_status",
        *[d[x].alias(x) for x in ("cadd_phred", "sift_score", "sift_pred", "polyphen2_hsvar_score", "polyphen2_hsvar_pred", "revel", "metasvm", "metalr")], F.col("am.am_pathogenicity").alias("am_pathogenicity"), F.col("am.am_class").alias("am_class"),
        F.col("gp.disease_name").alias("disease_name"), F.col("gp.disease_id").alias("disease_id"), F.col("gp.hpo_terms").alias("hpo_terms"), F.col("gp.inheritance").alias("inheritance"), mask.alias("annotation_coverage"), "vep_ambiguous",
    )
    wide = scores.damage(wide)
    conflict = F.trim("clinvar_significance").isin(*CONTESTABLE) & (F.col("deleterious_count") >= 3) & (F.col("cadd_phred") >= 20)
    wide = wide.withColumn("evidence_conflict", F.coalesce(conflict, F.lit(False)))
    if with_ids:
        forget(raw.sparkSession)
    return wide


def coverage_stats(wide: DataFrame, source: Column, buckets: Sequence[str]) -> DataFrame:
    """For each bucket of calls, hits of each source and rows without any."""
    has = lambda name: F.col("annotation_coverage").bitwiseAND(F.lit(S.COVERAGE_BITS[name])) != 0
    names = ("vep", "clinvar", "gnomad", "dbnsfp", "gene_phenotype", "alphamissense")
    keys = wide.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b) for b in buckets])).alias("source"))
    n = wide.groupBy(source.alias("source")).agg(F.count("*").alias("n"), *[F.count_if(has(x)).alias(f"n_{x}") for x in names], F.count_if(F.col("annotation_coverage") == 0).alias("n_none"))
    return keys.join(n, "source", "left").na.fill(0)


def rare_variants(
    wide: DataFrame, af: float = 0.01, genes: Sequence[str] | None = None, consequences: Sequence[str] = (), significances: Sequence[str] = (), zygosity: str | None = None, carried_only: bool = True, include_novel: bool = True,
) -> DataFrame:
    """Rare calls, most telling first: pathogenic, then weaker assertions, then the rest; frequency with unknown last; place. Homozygotes that no population supports are left out."""
    level = F.coalesce("gnomad_af_popmax", "gnomad_af_global")
    known = F.col("gnomad_af_global").isNotNull()
    out = wide.filter((level < af) | ~known if include_novel else (level < af) & known)
    if genes:
        out = out.filter(F.upper("gene_symbol").isin(*[g.upper() for g in genes]))
    if consequences:
        hit = F.lit(False)
        for x in consequences:
            hit = hit | F.contains("consequence", F.lit(x))
        out = out.filter(hit)
    if significances:
        out = out.filter(F.col("clinvar_significance").isin(*significances))
    if zygosity:
        out = out.filter(F.col("zygosity") == zygosity)
    if carried_only:
        out = out.filter(F.col("zygosity").isin("het", "hom_alt"))
    s = F.col("clinvar_significance")
    strong, weak = (rules.primary_term(s, "Pathogenic") | rules.primary_term(s, "Likely pathogenic") | rules.primary_term(s, "Pathogenic/Likely pathogenic")), s.ilike("%low penetrance%") | s.ilike("%risk allele%")
    implausible = (F.col("zygosity") == "hom_alt") & (F.col("inheritance") == "AD") & S.implausible_homozygote(S.effective_af(F.col("gnomad_af_popmax"), F.col("gnomad_af_global")), F.col("gnomad_homozygous_count"))
    out = out.filter(~F.coalesce(implausible, F.lit(False)))
    return out.orderBy(F.when(F.coalesce(strong, F.lit(False)), 0).when(F.coalesce(weak, F.lit(False)), 1).otherwise(2), F.when(known, 0).otherwise(1), F.col("gnomad_af_global"), "chrom", "pos", "rsid")


def imputed_findings(imputed: DataFrame, typed: DataFrame, clinvar: DataFrame) -> DataFrame:
    """Carried imputed rows that pass the quality gate, are not typed, and have a pathogenic assertion for their allele; the best a row, by place."""
    maf = F.least("af", 1 - F.col("af"))
    reason = rules.gate([("missing_dr2", F.col("quality").isNotNull()), ("low_dr2", F.col("quality") >= 0.8), ("missing_af", F.col("af").isNotNull()), ("rare", maf >= 0.01)])
    key = ["chrom", "pos", "ref", "alt"]
    rows = imputed.filter((reason == "pass") & (F.col("copies") > 0)).join(typed.select(*key).distinct(), key, "left_anti")
    s = F.col("significance")
    strong = rules.primary_term(s, "Pathogenic") | rules.primary_term(s, "Likely pathogenic") | rules.primary_term(s, "Pathogenic/Likely pathogenic")
    one = clinvar.filter(strong).groupBy(*key).agg(F.min_by(F.struct("accession", "significance", "review_stars"), F.struct(-F.col("review_stars"), F.col("accession"))).alias("c"))
    level = S.capped(S.clinical_level(F.col("c.review_stars"), F.lit(2)), 3)
    return rows.join(one, key).select(*key, "copies", "dosage", "quality", "c.accession", "c.significance", level.alias("evidence_level")).orderBy("chrom", "pos", "alt")


def ingest(spark, path: str, root: str, sample_id: str, chain: DataFrame | None = None) -> str:
    """A genotype file parsed, lifted from build 36 if need be (what can't be lifted goes), and written as the partition of its sample. Returns the build read."""
    head = text.head(spark, path)
    vendor = text.sniff(head)
    build = text.version_a(head)[1] if vendor == "a" else "GRCh37"
    rows = text.strict(text.genotypes(spark.read.text(path), vendor))
    if build == "GRCh36":
        if chain is None:
            raise ValueError("a build 36 file needs a chain")
        rows = lift(rows, chain, genotype="genotype").filter(F.col("new_pos").isNotNull()).select("rsid", F.col("new_chrom").alias("chrom"), F.col("new_pos").alias("pos"), "genotype")
    rows = rows.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")
    rows.write.mode("overwrite").parquet(f"{root}/sample_id={sample_id}")
    return build
