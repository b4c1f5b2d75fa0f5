"""Line-based scans. Each turns text lines into typed rows with a skip reason, so good and bad lines come from one pass.

Lines are read with their place in the file only where a rule needs it; everything else is column functions.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions import genotype as G
from loomframe.functions.scalar import REVIEW_STARS, as_map, ranked, significance_label

SNIFF_LINES, SNIFF_BYTES = 50, 512
#: Chromosome codes by vendor.
CODES = {"a": {"23": "X", "24": "Y", "25": "MT", "26": "MT", "M": "MT"}, "b": {"23": "X", "24": "Y", "25": "X", "26": "MT", "M": "MT"}}
MISSING = (".", "-", "")


class FormatError(ValueError):
    """A file that no parser takes."""


def head(spark: SparkSession, path: str, n: int = SNIFF_LINES) -> list[str]:
    """The first lines of a file, by Spark's reader so that any store works."""
    return [r["value"] for r in spark.read.text(path).limit(n).collect()]


def refuse_binary(raw: bytes) -> None:
    """Raises FormatError if a file's first bytes are no text."""
    first = raw[:SNIFF_BYTES]
    if first.startswith(b"PK\x03\x04"):
        raise FormatError("a ZIP archive; unpack it first")
    if b"\0" in first:
        raise FormatError("a binary file")


def sniff(lines: Sequence[str], raw: bytes = b"") -> str:
    """The vendor of a genotype file: "a" (four columns) or "b" (five). Raises FormatError with what the file looks like."""
    refuse_binary(raw)
    own = [x.rstrip("\r\n") for x in lines[:SNIFF_LINES]]
    low = [x.lower() for x in own]
    if any("23andme" in x for x in low) or any(x.lstrip("# ").split("\t") == ["rsid", "chromosome", "position", "genotype"] for x in low):
        return "a"
    if any("ancestrydna" in x for x in low) or any(x.split("\t") == ["rsid", "chromosome", "position", "allele1", "allele2"] for x in low):
        return "b"
    if any(x.startswith("##fileformat=VCF") or x.startswith("#CHROM\t") for x in own):
        raise FormatError("a VCF file; genotype exports are tab-separated")
    data = [x for x in own if x.strip() and not x.startswith("#")]
    if data and sum("," in x for x in data) * 2 > len(data):
        raise FormatError("a CSV file; genotype exports are tab-separated")
    raise FormatError("unknown format")


def version_a(lines: Sequence[str]) -> tuple[str, str]:
    """Version and build of a four-column file by its comments."""
    comments = [x for x in lines if x.startswith("#")]
    text = "\n".join(comments).lower()
    if "build 36" in text:
        return "v3", "GRCh36"
    if "build 37" in text or "grch37" in text:
        return ("v5" if len(comments) >= 15 else "v4"), "GRCh37"
    raise FormatError("the comments name no build")


def version_b(lines: Sequence[str]) -> str:
    import re

    for x in lines:
        if m := re.search(r"array version: V([0-9.]+)", x):
            return f"v{m[1]}"
    if any("ancestrydna" in x.lower() for x in lines) and any(x.lower().startswith("rsid\tchromosome") for x in lines):
        return "v2.0"
    raise FormatError("unknown array version")


def formats(lines: DataFrame, file: str = "file", record: str = "record") -> DataFrame:
    """file, vendor, version, build and reason (why it is no genotype file) of each file, by its first SNIFF_LINES lines.

    lines: file, record (order) and value. A file's first lines are gathered, never the file.
    """
    early = lines.filter(F.col(record) < SNIFF_LINES).groupBy(file).agg(F.sort_array(F.collect_list(F.struct(F.col(record).alias("r"), "value"))).alias("h"))
    kind = lines.schema[file].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for name, head in zip(pdf[file], pdf["h"], strict=True):
                own = [x["value"] for x in head]
                vendor = version = build = reason = None
                try:
                    refuse_binary("\n".join(own).encode())
                    vendor = sniff(own)
                    version, build = version_a(own) if vendor == "a" else (version_b(own), "GRCh37")
                except FormatError as e:
                    reason = str(e)
                out.append((name, vendor, version, build, reason))
            yield pd.DataFrame(out, columns=[file, "vendor", "version", "build", "reason"])

    return early.mapInPandas(run, f"`{file}` {kind}, vendor string, version string, build string, reason string")


def chromosome(c: Column, vendor: str) -> Column:
    """The chromosome's name; null for what is none."""
    u = F.upper(F.trim(c))
    name = F.coalesce(F.try_element_at(as_map(CODES[vendor]), u), u)
    return F.when(name.isin(*G.CHROMOSOMES), name)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and record of text files: record orders lines by file, split and place in the split, whichever task reads them."""
    raw = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    return raw.select("value", F.struct("file_path", "file_block_start", "at").alias("record"))


def _lines(df: DataFrame) -> DataFrame:
    return df.filter((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))


def genotypes(lines: DataFrame, vendor: str, keep: Sequence[str] = ()) -> DataFrame:
    """rsid, chrom, pos, genotype, reason (null for a good row), value and the columns in keep of the data lines (column value)."""
    f = F.split(F.rtrim("value"), "\t")
    n = 4 if vendor == "a" else 5
    at = lambda i: F.trim(F.get(f, F.lit(i)))
    rows = _lines(lines)
    if vendor == "b":
        rows = rows.filter(~(F.lower(at(0)) == "rsid"))
        a, b = F.upper(at(3)), F.upper(at(4))
        gt = F.when(a.isin("", "0") | b.isin("", "0"), "--").otherwise(F.array_join(F.array_sort(F.array(a, b)), ""))
    else:
        gt = G.canonical(at(3))
    pos, chrom = at(2).try_cast("long"), chromosome(at(1), vendor)
    reason = (
        F.when(F.size(f) != n, "arity").when(at(0) == "", "rsid").when(chrom.isNull(), "chromosome").when(pos.isNull() | (pos < 0), "position").when(gt == "", "genotype")
    )
    return rows.select(at(0).alias("rsid"), chrom.alias("chrom"), pos.alias("pos"), gt.alias("genotype"), reason.alias("reason"), "value", *keep)


def strict(parsed: DataFrame) -> DataFrame:
    """The rows of a scan; the first bad line met stops the job."""
    fail = F.raise_error(F.concat(F.lit("bad line ("), F.col("reason"), F.lit("): "), F.col("value")))
    return parsed.filter(F.when(F.col("reason").isNull(), True).otherwise(fail.cast("boolean"))).drop("reason", "value")


def scan_metrics(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row: total lines, skipped (comments, blanks), and calls that are no call."""
    n = lines.agg(F.count("*").alias("total_lines"), F.count_if((F.trim("value") == "") | F.startswith("value", F.lit("#"))).alias("skipped_lines")).withColumn("_k", F.lit(1))
    c = parsed.agg(F.count_if(F.col("reason").isNull()).alias("variants"), F.count_if(F.col("reason").isNull() & G.is_no_call(F.col("genotype"))).alias("nocalls")).withColumn("_k", F.lit(1))
    return n.join(c, "_k").drop("_k")


def reasons(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def info_map(c: Column) -> Column:
    """An INFO field as a map; a flag has a null value."""
    return F.when(c.isin("", "."), F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(c, F.lit(";"), F.lit("=")))


def vcf(lines: DataFrame) -> DataFrame:
    """chrom, pos, id, ref, alt (as written), info, format, sample of VCF data lines; short lines are left out."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    rows = _lines(lines).filter(F.size(f) >= 8)
    chrom = F.regexp_replace(at(0), "(?i)^chr", "")
    chrom = F.when(F.upper(chrom) == "M", "MT").otherwise(chrom)
    return rows.select(chrom.alias("chrom"), at(1).try_cast("long").alias("pos"), at(2).alias("id"), at(3).alias("ref"), at(4).alias("alt"), at(6).alias("filter"), info_map(at(7)).alias("info"), at(8).alias("format"), at(9).alias("sample"), F.size(f).alias("n_fields"), at(0).alias("written"))


def _for_alt(values: Column, n_alts: Column, i: Column) -> Column:
    """The i-th of a value for each ALT: a single ALT takes the value as it is, a list of another length gives null."""
    parts = F.split(values, ",")
    return F.when(n_alts == 1, values).when(F.size(parts) == n_alts, F.get(parts, i))


def frequencies(lines: DataFrame, numbers: Mapping[str, str]) -> DataFrame:
    """A row for each ALT: rsid, chrom, pos, ref, alt and a double for each INFO key of numbers (key -> column)."""
    v = vcf(lines).filter("alt <> '' and pos is not null")
    alts, ids = F.split("alt", ","), F.split("id", ";")
    rows = v.select("*", F.posexplode(alts).alias("i", "one"), F.size(alts).alias("n"))
    rsid = F.when(F.size(ids) == F.col("n"), F.get(ids, F.col("i"))).otherwise(F.get(ids, F.lit(0)))
    number = lambda k: F.when(~F.coalesce(_for_alt(F.try_element_at("info", F.lit(k)), F.col("n"), F.col("i")), F.lit(".")).isin(*MISSING), _for_alt(F.try_element_at("info", F.lit(k)), F.col("n"), F.col("i"))).try_cast("double")
    return rows.filter("one <> ''").select(F.when(rsid != ".", rsid).alias("rsid"), "chrom", "pos", "ref", F.col("one").alias("alt"), *[number(k).alias(c) for k, c in numbers.items()])


CLINICAL_KEYS = ("RS", "CLNSIG", "CLNREVSTAT", "CLNDN", "GENEINFO", "CLNVCID", "CLNACC")


def clinical(lines: DataFrame) -> DataFrame:
    """Clinical assertions: rsid, chrom, pos, ref, alt (the first), significance, review_stars, accession, conditions, gene_symbol,
    variation_id, molecular_consequence and reason.

    A record without RS stays, to be found by its place; an RS that isn't a positive number makes the line malformed. A
    gene counts if it is the only one; the consequence counts if there is one ALT.
    """
    v = vcf(lines)
    get = lambda k: F.try_element_at("info", F.lit(k))
    filled = lambda k: F.nullif(get(k), F.lit(""))
    rs = filled("RS")
    some = reduce(lambda x, y: x | y, [filled(k).isNotNull() for k in CLINICAL_KEYS])
    status = F.replace(get("CLNREVSTAT"), F.lit("_"), F.lit(" "))
    chrom = F.upper(F.regexp_replace("written", "^chr", ""))
    bad_rs = rs.isNotNull() & ~F.coalesce(rs.rlike("^[0-9]+$") & rs.rlike("[1-9]"), F.lit(False))
    reason = F.when(~chrom.isin(*G.CHROMOSOMES), "chromosome").when(F.col("pos").isNull(), "position").when(bad_rs, "rsid").when(~some, "no_info")
    ident = filled("CLNVCID")
    accession = F.when(ident.isNotNull(), F.concat(F.lit("VCV"), F.repeat(F.lit("0"), F.greatest(F.lit(0), 9 - F.length(ident))), ident)).otherwise(F.substring_index(get("CLNACC"), "|", 1))
    gene = F.nullif(F.regexp_extract(F.coalesce(get("GENEINFO"), F.lit("")), "^([A-Za-z0-9][A-Za-z0-9_.-]*):[1-9][0-9]*$", 1), F.lit(""))
    return v.select(
        F.when(~bad_rs, F.concat(F.lit("rs"), rs)).alias("rsid"), "chrom", "pos", "ref", F.substring_index("alt", ",", 1).alias("alt"), significance_label(get("CLNSIG")).alias("significance"),
        ranked(status, REVIEW_STARS).alias("review_stars"), accession.alias("accession"), F.replace(filled("CLNDN"), F.lit("_"), F.lit(" ")).alias("conditions"), gene.alias("gene_symbol"),
        F.col("id").try_cast("long").alias("variation_id"), F.when(~F.contains("alt", F.lit(",")), get("MC")).alias("molecular_consequence"), reason.alias("reason"),
    )


def nested_scores(lines: DataFrame, key: str = "SpliceAI") -> DataFrame:
    """A row for each entry of a nested INFO value: alt, gene, four delta scores and their maximum; entries without scores are left out."""
    e = F.explode(F.split(F.try_element_at("info", F.lit(key)), ",")).alias("e")
    f = F.split("e", r"\|")
    ds = [F.get(f, F.lit(i)).try_cast("double") for i in (2, 3, 4, 5)]
    rows = vcf(lines).select("chrom", "pos", "ref", e).filter(F.size(f) >= 10)
    return rows.select("chrom", "pos", "ref", F.get(f, F.lit(0)).alias("alt"), F.get(f, F.lit(1)).alias("gene"), *[d.alias(n) for d, n in zip(ds, ("ds_ag", "ds_al", "ds_dg", "ds_dl"), strict=True)], F.greatest(*ds).alias("ds_max")).filter("ds_max is not null")


def imputed(lines: DataFrame) -> DataFrame:
    """A row for each ALT of a single-sample imputed VCF: dosage, best-guess copies, quality, frequency and whether it was imputed. Several samples stop the job."""
    many = F.raise_error(F.lit("more than one sample")).cast("boolean")
    v = vcf(lines).filter(F.when(F.col("n_fields") <= 10, True).otherwise(many))
    sample = F.map_from_arrays(F.split("format", ":"), F.slice(F.concat(F.split("sample", ":"), F.array_repeat(F.lit(None).cast("string"), F.size(F.split("format", ":")))), F.lit(1), F.size(F.split("format", ":"))))
    rows = v.withColumn("_s", sample).select("*", F.posexplode(F.split("alt", ",")).alias("i", "one"), F.size(F.split("alt", ",")).alias("n"))
    item = lambda c: F.get(F.split(c, ","), F.col("i"))
    gt = F.regexp_extract_all(F.try_element_at("_s", F.lit("GT")), F.lit(r"(\d+)"), F.lit(1))
    get = lambda k: F.try_element_at("info", F.lit(k))
    return rows.select(
        "chrom", "pos", "ref", F.col("one").alias("alt"), item(F.try_element_at("_s", F.lit("DS"))).try_cast("double").alias("dosage"),
        F.size(F.filter(gt, lambda x: x == (F.col("i") + 1).cast("string"))).alias("copies"), item(F.coalesce(get("DR2"), get("R2"))).try_cast("double").alias("quality"),
        item(get("AF")).try_cast("double").alias("af"), F.map_contains_key("info", F.lit("IMP")).alias("is_imputed"),
    )


def transcript_scores(df: DataFrame, low: Mapping[str, str], high: Mapping[str, str], worst: Mapping[str, tuple[str, Mapping[str, int]]]) -> DataFrame:
    """df with values of several transcripts (split on ; or ,) reduced: least, greatest, and worst by a severity table. Rows without any score go."""
    parts = lambda c: F.filter(F.split(F.col(c), "[;,]"), lambda x: ~F.trim(x).isin(*MISSING))
    nums = lambda c: F.filter(F.transform(parts(c), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    cols = {to: F.array_min(nums(c)) for c, to in low.items()} | {to: F.array_max(nums(c)) for c, to in high.items()}
    for c, (to, severity) in worst.items():
        table = as_map(severity)
        by_rank = F.array_max(F.transform(parts(c), lambda x, i: F.struct(F.coalesce(F.try_element_at(table, x), F.lit(-1)).alias("r"), (-i).alias("i"), x.alias("v"))))  # noqa: B023
        cols[to] = by_rank["v"]
    out = df.withColumns(cols)
    return out.filter(F.coalesce(*[F.col(c).cast("string") for c in (*low.values(), *high.values())]).isNotNull())


def merge_history(lines: DataFrame) -> DataFrame:
    """old_rsid, current_rsid and build_id of an id history: field 7 is the current id, else field 2.

    Lines without an old or a current id, short ones and merges into themselves are left out; an id may have its prefix.
    """
    f = F.split("value", "\t")
    at = lambda i: F.nullif(F.trim(F.get(f, F.lit(i))), F.lit(""))
    named = lambda c: F.when(F.startswith(c, F.lit("rs")), c).otherwise(F.concat(F.lit("rs"), c))
    rows = _lines(lines).filter(F.size(f) >= 7).select(named(at(0)).alias("old_rsid"), named(F.coalesce(at(6), at(1))).alias("current_rsid"), at(2).try_cast("int").alias("build_id"))
    return rows.filter("old_rsid <> current_rsid")


#: Classes of regulatory elements.
ELEMENT_CLASSES = ("PLS", "pELS", "dELS", "CA-CTCF", "CA-H3K4me3", "CA-TF", "CA", "TF", "DNase-H3K4me3", "CTCF-only")


def regulatory_bed(lines: DataFrame) -> DataFrame:
    """accession, chrom, start, end, class and reason of a BED of regulatory elements; the class is looked for in columns 9, 5, 4 and behind the accession's comma."""
    f = F.split("value", "\t")
    at = lambda i: F.trim(F.get(f, F.lit(i)))
    known = lambda c: F.when(F.substring_index(c, ",", 1).isin(*ELEMENT_CLASSES), F.substring_index(c, ",", 1))
    cls = F.coalesce(known(at(9)), known(at(5)), known(at(4)), known(F.substring_index(at(3), ",", -1)))
    chrom = F.regexp_replace(at(0), "(?i)^chr", "")
    start, end = at(1).try_cast("long"), at(2).try_cast("long")
    v3 = (F.size(f) == 6) & at(4).rlike("^EH")
    reason = F.when((F.size(f) < 5) | start.isNull() | end.isNull(), "malformed").when(~chrom.isin(*G.CHROMOSOMES), "invalid_chrom").when(cls.isNull(), "unknown_class")
    return _lines(lines).filter(~F.col("value").rlike("^(track|browser)")).select(F.when(v3, at(4)).otherwise(F.substring_index(at(3), ",", 1)).alias("accession"), chrom.alias("chrom"), start.alias("start_pos"), end.alias("end_pos"), cls.alias("ccre_class"), reason.alias("reason"))


def bed(lines: DataFrame) -> DataFrame:
    """chrom, start, end, name, record (order) and reason of a BED panel: 0 <= start < end.

    record is that of lines, if it has one (see numbered_lines), so that a task that is run again gives the same; else rows
    are numbered as they come.
    """
    f = F.split("value", r"\s+")
    at = lambda i: F.get(f, F.lit(i))
    start, end = at(1).try_cast("long"), at(2).try_cast("long")
    reason = F.when(F.size(f) < 3, "arity").when(start.isNull() | end.isNull(), "number").when((start < 0) | (start >= end), "range")
    rows = lines if "record" in lines.columns else lines.withColumn("record", F.monotonically_increasing_id())
    rows = _lines(rows).filter(~F.col("value").rlike("^(track|browser)"))
    return rows.select(F.regexp_replace(at(0), "(?i)^chr", "").alias("chrom"), start.alias("start"), end.alias("end"), at(3).alias("name"), "record", reason.alias("reason"))


def gene_list(text: str, most: int = 5000) -> tuple[list[str], list[str]]:
    """Gene symbols of a list in order, each once, and warnings. A list without a symbol or with more than `most` is refused."""
    seen: dict[str, None] = {}
    warnings = []
    for line in text.splitlines():
        for token in re.split(r"[,;\t\s]+", line.split("#", 1)[0].strip()):
            name = token.upper()
            if not name:
                continue
            if not re.fullmatch(r"[A-Z][A-Z0-9\-.]{0,29}", name):
                warnings.append(f"not a gene symbol: {token}")
            else:
                seen.setdefault(name)
    if not seen:
        raise FormatError("no gene symbol in the list")
    if len(seen) > most:
        raise FormatError(f"a panel has at most {most} genes; the list has {len(seen)}")
    return list(seen), warnings


def associations(df: DataFrame, whitelist: Sequence[str]) -> DataFrame:
    """Trait associations (columns as in the catalogue's TSV): rsid, trait, p_value, effect, is_odds_ratio, sample_size. Rows without id or a listed trait go."""
    c = lambda name: F.col(f"`{name}`")
    trait = F.coalesce(F.when(F.trim(c("MAPPED_TRAIT")) != "", c("MAPPED_TRAIT")), F.when(F.trim(c("DISEASE/TRAIT")) != "", c("DISEASE/TRAIT")))
    listed = F.lit(False)
    for w in whitelist:
        listed = listed | F.contains(F.lower(trait), F.lit(w.lower()))
    numbers = F.regexp_extract_all(F.regexp_replace(c("INITIAL SAMPLE SIZE"), ",", ""), F.lit(r"(\d+)"), F.lit(1))
    effect, ci = c("OR or BETA").try_cast("double"), F.lower(F.coalesce(c("95% CI (TEXT)"), F.lit("")))
    ratio = F.when(effect.isNull(), F.lit(None).cast("boolean")).when(ci.rlike(r"increase|decrease|unit|\bsd\b"), False).when(F.contains(ci, F.lit("[")), True).otherwise((effect >= 0.1) & (effect <= 20))
    rsid = F.regexp_extract(F.coalesce(c("SNPS"), F.lit("")), r"(rs\d+)", 1)
    size = F.aggregate(F.transform(numbers, lambda x: x.try_cast("long")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    out = df.select(rsid.alias("rsid"), trait.alias("trait"), c("P-VALUE").try_cast("double").alias("p_value"), effect.alias("effect"), ratio.alias("is_odds_ratio"), F.when(F.size(numbers) > 0, size).alias("sample_size"), F.coalesce(listed, F.lit(False)).alias("_l"))
    return out.filter("rsid <> '' and trait is not null and _l").drop("_l")


def phenotypes(lines: DataFrame) -> DataFrame:
    """gene, phenotype, mim, mapping_key and inheritance of a gene map's 13-column lines."""
    f = F.split("value", "\t")
    at = lambda i: F.trim(F.get(f, F.lit(i)))
    gene = F.when(F.coalesce(at(8), F.lit("")) != "", at(8)).otherwise(F.trim(F.substring_index(at(6), ",", 1)))
    rows = _lines(lines).filter(F.size(f) >= 13).select(gene.alias("gene"), F.explode(F.split(at(12), ";")).alias("e")).withColumn("e", F.trim("e")).filter("e <> '' and gene <> ''")
    mode = F.regexp_extract("e", r",\s*((?:Autosomal|X-linked|Y-linked|Mitochondrial|Digenic|Multifactorial|Somatic)[^,]*)$", 1)
    bare = F.regexp_replace("e", r",\s*(?:Autosomal|X-linked|Y-linked|Mitochondrial|Digenic|Multifactorial|Somatic)[^,]*$", "")
    mim, key = F.regexp_extract(bare, r"(\d{6})\s*\(\d\)\s*$", 1), F.regexp_extract(bare, r"\((\d)\)\s*$", 1)
    name = F.trim(F.regexp_replace(F.regexp_replace(bare, r",?\s*(\d{6})?\s*\(\d\)\s*$", ""), r"^[?{\[]+|[}\]]+$", ""))
    empty = lambda c: F.when(c != "", c)
    return rows.select("gene", name.alias("phenotype"), empty(mim).alias("mim"), empty(key).cast("int").alias("mapping_key"), empty(mode).alias("inheritance"))


def score_header(lines: Sequence[str]) -> dict[str, str]:
    """#key=value pairs of a scoring file."""
    return dict(x[1:].strip().split("=", 1) for x in lines if x.startswith("#") and "=" in x)


def score_weights(df: DataFrame) -> DataFrame:
    """rsid, chrom, pos, effect_allele, other_allele, weight and reason of a scoring file's rows; harmonised columns before original ones."""
    pick = lambda *names: F.coalesce(*[F.when(F.trim(F.col(n)) != "", F.trim(F.col(n))) for n in names if n in df.columns], F.lit(None).cast("string"))
    chrom, pos = pick("hm_chr", "chr_name"), pick("hm_pos", "chr_position").try_cast("long")
    rsid, weight = pick("hm_rsID", "rsID"), pick("effect_weight").try_cast("double")
    ea = F.upper(pick("effect_allele"))
    reason = F.when(weight.isNull(), "weight").when(ea.isNull(), "effect_allele").when(rsid.isNull() & (chrom.isNull() | pos.isNull()), "place")
    return df.select(F.when(rsid.rlike("^rs[0-9]+$"), rsid).alias("rsid"), chrom.alias("chrom"), pos.alias("pos"), ea.alias("effect_allele"), F.upper(pick("hm_inferOtherAllele", "other_allele")).alias("other_allele"), weight.alias("weight"), reason.alias("reason"))


def curations(df: DataFrame, valid: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Curation rows (first three columns: gene, disease, classification) with a valid classification, and counts a class. Rule lines (+++) are skipped."""
    g, d, k = (F.trim(F.col(f"`{c}`")) for c in df.columns[:3])
    rows = df.select(g.alias("gene"), d.alias("disease"), k.alias("classification")).filter(~F.startswith("gene", F.lit("+++")) & F.col("classification").isin(*valid) & (F.col("gene") != ""))
    return rows, rows.groupBy("classification").agg(F.count("*").alias("n"))


def allele_table(df: DataFrame) -> DataFrame:
    """Allele definitions: gene and allele_name required; defining_variants from JSON, an empty list if invalid."""
    kind = "array<struct<rsid:string,ref:string,alt:string>>"
    v = F.coalesce(F.from_json("defining_variants", kind), F.array().cast(kind))
    return df.filter("trim(gene) <> '' and trim(allele_name) <> ''").select(F.trim("gene").alias("gene"), F.trim("allele_name").alias("allele_name"), v.alias("defining_variants"))


def tissue_files(spark: SparkSession, path: str, variants: DataFrame) -> DataFrame:
    """Per-tissue TSVs of a folder: tissue (from the file's name), rsid, gene_id, slope, p; rows are matched by variant_id."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path).withColumn("_f", F.input_file_name())
    tissue = F.regexp_extract("_f", r"([^/]+?)(?:\.[^/.]+)+$", 1)
    return raw.join(variants.select("variant_id", "rsid"), "variant_id").select(tissue.alias("tissue"), "rsid", "gene_id", F.col("slope").try_cast("double").alias("slope"), F.col("pval_nominal").try_cast("double").alias("p"))


def overlay_values(c: Column) -> Column:
    """A value as a variant-typed string: whole number, number or text, told by kind."""
    return F.struct(F.when(c.try_cast("long").isNotNull() & c.rlike(r"^[+-]?\d+$"), "int").when(c.try_cast("double").isNotNull(), "float").otherwise("string").alias("kind"), c.alias("value"))


def gene_phenotypes(diseases: DataFrame, terms: DataFrame, cross: DataFrame) -> DataFrame:
    """A row for each gene and disease with its terms (sorted, null if none) and its only inheritance.

    diseases: gene, disease_id, disease_name; terms: gene, source_id, term_id, term_name, is_inheritance; cross: source_id, disease_id.
    """
    base = diseases.groupBy("gene", "disease_id").agg(F.min("disease_name").alias("disease_name"))
    own = terms.join(cross, "source_id")
    named = own.groupBy("gene", "disease_id").agg(
        F.array_sort(F.collect_set(F.when(~F.col("is_inheritance"), F.struct("term_id", "term_name")))).alias("t"), F.collect_set(F.when(F.col("is_inheritance"), F.col("term_name"))).alias("i")
    )
    out = base.join(named, ["gene", "disease_id"], "left")
    return out.select("gene", "disease_id", "disease_name", F.when(F.size("t") > 0, F.to_json("t")).alias("hpo_terms"), F.when(F.size("i") == 1, F.get("i", F.lit(0))).alias("inheritance"))
