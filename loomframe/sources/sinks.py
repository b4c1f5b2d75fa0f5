"""Text sinks. A file is a column of lines; order within a file is kept by a sort key, and only single-file exports use one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions import genotype as G
from loomframe.functions.scalar import chromosome_order

HEADER = ("##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE")


def vcf_fields(df: DataFrame) -> DataFrame:
    """df with vcf_ref, vcf_alt and gt: by zygosity where ref and alt are known, else REF N and the observed bases as ALT."""
    g = F.upper(F.trim("genotype"))
    a, b = F.substring(g, 1, 1), F.substring(g, -1, 1)
    single = F.length(g) == 1
    known = F.col("ref").isNotNull() & F.col("alt").isNotNull() & F.col("zygosity").isNotNull()
    z = F.col("zygosity")
    typed = F.when(z == "het", "0/1").when(z == "hom_alt", F.when(single, "1").otherwise("1/1")).otherwise(F.when(single, "0").otherwise("0/0"))
    seen = ~G.is_no_call(F.col("genotype")) & g.rlike("^[ACGT]{1,2}$")
    loose = F.when(seen, F.when(single, "1").when(a == b, "1/1").otherwise("1/2")).otherwise("./.")
    alts = F.when(seen, F.when(a == b, a).otherwise(F.concat_ws(",", a, b))).otherwise(".")
    return df.withColumns({"vcf_ref": F.when(known, F.col("ref")).otherwise("N"), "vcf_alt": F.when(known, F.col("alt")).otherwise(alts), "gt": F.when(known, typed).otherwise(loose)})


def vcf_lines(df: DataFrame, keep_no_calls: bool = False) -> DataFrame:
    """Lines of a VCF with order (chromosome order, pos, rsid)."""
    rows = vcf_fields(df)
    if not keep_no_calls:
        rows = rows.filter("gt <> './.'")
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.coalesce("rsid", F.lit(".")), "vcf_ref", "vcf_alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), "gt")
    return rows.select(F.struct(chromosome_order(F.col("chrom"), G.CHROMOSOMES).alias("o"), "pos", "rsid").alias("k"), line.alias("value"))


RESOLVED = ("hom_ref", "het", "hom_alt")


def refuse_unresolved(df: DataFrame) -> DataFrame:
    """df as it is; a VCF of all positions stops the job if a row's zygosity is unresolved, as it would leave the row out or guess."""
    known = F.coalesce(F.col("zygosity").isin(*RESOLVED), F.lit(False))
    return df.filter(F.when(known, True).otherwise(F.raise_error(F.lit("unresolved zygosity: export CSV, TSV or JSON, or filter to resolved positions")).cast("boolean")))


def export(df: DataFrame, path: str, kind: str, all_positions: bool = False) -> None:
    """Rows of a query in order of place as csv, tsv, json or vcf; only what the sample carries, unless all positions are asked for."""
    rows = df if all_positions else df.filter(F.col("zygosity").isin("het", "hom_alt"))
    if kind == "vcf":
        write_vcf(refuse_unresolved(rows), path)
    else:
        place = [chromosome_order(F.col("chrom"), G.CHROMOSOMES), F.col("pos")]
        write_table(rows.repartitionByRange(*place).sortWithinPartitions(*place), path, kind)


def write_vcf(df: DataFrame, path: str, header: Sequence[str] = HEADER, single: bool = False) -> None:
    """Lines in order of place over part files, the header at the top of the first; joined in order of name they are one VCF.
    single: one file, which one task writes."""
    head = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(header)], "i int, value string")
    body = vcf_lines(df).select(F.lit(len(header)).alias("i"), "k", "value")
    both = head.select("i", F.lit(None).cast(body.schema["k"].dataType).alias("k"), "value").unionByName(body)
    dealt = both.coalesce(1) if single else both.repartitionByRange("i", "k")
    dealt.sortWithinPartitions("i", "k").select("value").write.mode("overwrite").text(path)


def write_vcf_by_chromosome(df: DataFrame, path: str) -> None:
    """A folder a chromosome, with part files in order of place and sorted lines in each."""
    lines = vcf_fields(df).filter("gt <> './.'")
    text = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.coalesce("rsid", F.lit(".")), "vcf_ref", "vcf_alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), "gt")
    lines.select(F.col("chrom").alias("unit"), "pos", text.alias("value")).repartitionByRange("unit", "pos").sortWithinPartitions("unit", "pos").select("unit", "value").write.mode("overwrite").partitionBy("unit").text(path)


def region_lines(rows: DataFrame, alleles: DataFrame, chrom: str, lo: int, hi: int) -> DataFrame:
    """Lines of one half-open region (lo, hi], by pos; alleles are left-joined on (rsid, chrom, pos)."""
    own = rows.filter((F.col("chrom") == chrom) & (F.col("pos") > lo) & (F.col("pos") <= hi))
    return vcf_lines(own.join(alleles, ["rsid", "chrom", "pos"], "left"), keep_no_calls=True).orderBy("k").select("value")


def delimited(df: DataFrame, sep: str = ",", order: Sequence[Column] = ()) -> Iterator[str]:
    """A CSV or TSV line by line, header first, fetched a partition at a time."""
    import csv
    import io

    def text(values) -> str:
        out = io.StringIO()
        csv.writer(out, delimiter=sep, lineterminator="\n").writerow(values)
        return out.getvalue()

    yield text(df.columns)
    for row in (df.orderBy(*order) if order else df).toLocalIterator():
        yield text(["" if v is None else v for v in row])


def json_array(df: DataFrame, order: Sequence[Column] = ()) -> Iterator[str]:
    """A JSON array in pieces."""
    rows = (df.orderBy(*order) if order else df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    yield "["
    for i, row in enumerate(rows.toLocalIterator()):
        yield ("," if i else "") + row["j"]
    yield "]"


def write_table(df: DataFrame, path: str, kind: str) -> None:
    """Parallel export to csv, tsv or json; an empty table still has its header."""
    out = df.write.mode("overwrite")
    if kind == "json":
        out.json(path)
    else:
        out.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)


def _uuid(*parts: Column) -> Column:
    """A version 5 style name from content, so that a document that is made again has the same ids."""
    h = F.sha1(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


#: Codes of the components of an observation and of allelic states.
COMPONENTS = (("gene_symbol", "48018-6", "Gene studied"), ("rsid", "81255-2", "dbSNP ID"), ("ref", "69547-8", "Genomic ref allele"), ("alt", "69551-0", "Genomic alt allele"))
STATES = {"het": ("LA6706-1", "Heterozygous"), "hom_alt": ("LA6705-3", "Homozygous"), "hemi": ("LA6707-9", "Hemizygous")}
MAX_OBSERVATIONS = 10_000


def resource_documents(df: DataFrame, sample: str = "sample_id", most: int = MAX_OBSERVATIONS) -> DataFrame:
    """sample and document: a bundle of a report and an observation for each carried row, in order of place. The report refers to
    the observations by ids that follow from their content; equal rows of a sample are one. More than `most` stop the job.

    df: sample, chrom, pos, ref, alt, rsid, gene_symbol, zygosity (het, hom_alt or hemi).
    """
    system = "http://loinc.org"
    coded = lambda code, shown: F.struct(F.array(F.struct(F.lit(system).alias("system"), F.lit(code).alias("code"), F.lit(shown).alias("display"))).alias("coding"))
    part = lambda value, code, shown: F.when(value.isNotNull(), F.struct(coded(code, shown).alias("code"), value.alias("valueString")))

    def body(x: Column) -> Column:
        state = F.coalesce(*[F.when(x["zygosity"] == z, F.struct(coded("53034-5", "Allelic state").alias("code"), F.lit(shown).alias("valueString"))) for z, (_, shown) in STATES.items()])
        place = F.struct(coded("81254-5", "Genomic allele start-end").alias("code"), F.concat_ws(":", x["order"]["chrom"], x["order"]["pos"].cast("string")).alias("valueString"))
        parts = F.filter(F.array(*[part(x[column], code, shown) for column, code, shown in COMPONENTS], place, state), lambda y: y.isNotNull())
        return F.struct(F.lit("Observation").alias("resourceType"), x["order"]["_id"].alias("id"), F.lit("preliminary").alias("status"), coded("69548-6", "Genetic variant assessment").alias("code"), coded("LA9633-4", "Present").alias("valueCodeableConcept"), parts.alias("component"))

    names = ["chrom", "pos", "ref", "alt", "rsid", "gene_symbol", "zygosity"]
    # Only these columns are shuffled, and once; resources, ten times as long, are made where a sample's rows lie.
    carried = F.when(F.col("zygosity").isin(*STATES) & F.col(sample).isNotNull(), F.struct(*names))
    rows = df.select(F.col(sample).alias("_s"), carried.alias("_r")).repartition("_s").distinct()
    rows = rows.withColumn("_n", F.count("_r").over(Window.partitionBy("_s")))
    rows = rows.filter(F.when(F.col("_n") <= most, True).otherwise(F.raise_error(F.lit(f"more than {most} observations")).cast("boolean")))
    rows = rows.select("_s", F.col("_r").isNotNull().alias("_any"), *[F.col(f"_r.{c}").alias(c) for c in names])
    order = F.struct(chromosome_order(F.col("chrom"), G.CHROMOSOMES).alias("o"), F.col("chrom"), F.col("pos"), _uuid(F.lit("observation"), F.col("_s"), *[F.col(c) for c in names]).alias("_id"))
    packed = rows.groupBy(F.col("_s").alias(sample)).agg(F.sort_array(F.collect_list(F.when(F.col("_any"), F.struct(order.alias("order"), *[F.col(c) for c in names if c not in ("chrom", "pos")])))).alias("_c"))
    url = lambda x: F.concat(F.lit("urn:uuid:"), x["order"]["_id"])
    urls = F.transform("_c", lambda x: F.struct(url(x).alias("reference")))
    report_id = _uuid(F.lit("report"), F.col(sample), F.array_join(F.transform(urls, lambda x: x["reference"]), ","))
    report = F.struct(F.lit("DiagnosticReport").alias("resourceType"), report_id.alias("id"), F.lit("preliminary").alias("status"), coded("51969-4", "Genetic analysis report").alias("code"), urls.alias("result"))
    text = lambda at, x: F.concat(F.lit('{"fullUrl":"'), at, F.lit('","resource":'), F.to_json(x), F.lit("}"))
    entries = F.concat(F.array(text(F.concat(F.lit("urn:uuid:"), report_id), report)), F.transform("_c", lambda x: text(url(x), body(x))))
    return packed.select(sample, F.concat(F.lit('{"resourceType":"Bundle","type":"collection","entry":['), F.array_join(entries, ","), F.lit("]}")).alias("document"))


def bundle(df: DataFrame, resource: Column, entries: Sequence[str]) -> DataFrame:
    """A JSON document a row: resource type and its entries."""
    return df.select(F.to_json(F.struct(resource.alias("resourceType"), *entries)).alias("value"))


def plink_codes(df: DataFrame, sample: str = "sample_id", snp: str = "snp") -> DataFrame:
    """snp and block: two bits a sample in order of sample, four to a byte, lowest first; hom_alt 0, missing 1, het 2, hom_ref 3."""
    code = F.when(F.col("zygosity") == "hom_alt", 0).when(F.col("zygosity") == "het", 2).when(F.col("zygosity") == "hom_ref", 3).otherwise(1)
    rows = df.groupBy(snp).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(sample).alias("s"), code.alias("c")))), lambda x: x["c"]).alias("c"))
    at = lambda i, k: F.coalesce(F.get("c", i * 4 + k), F.lit(0))
    byte = lambda i: at(i, 0) + at(i, 1) * 4 + at(i, 2) * 16 + at(i, 3) * 64
    n = F.ceil(F.size("c") / 4).cast("int")
    return rows.select(snp, F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "")).alias("block"))
