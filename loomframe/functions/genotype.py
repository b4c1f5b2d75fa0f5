"""Column functions on genotype strings. All run inside code generation; none needs Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that are not a call when scoring. The test is case-sensitive.
NO_CALLS = ("", "--", "??", "-", "0", "00", "II", "DD", "DI", "ID")
#: Tokens that are not a call when merging; indels count as calls there.
MERGE_NO_CALLS = ("", "--", "??", "-", "0", "00")
#: Pseudoautosomal intervals of chromosome X on GRCh37, both ends included.
X_PAR = ((60001, 2699520), (154931044, 155260560))
#: Chromosomes in display order.
CHROMOSOMES = (*(str(i) for i in range(1, 23)), "X", "Y", "MT")


def is_no_call(g: Column, tokens: tuple[str, ...] = NO_CALLS) -> Column:
    return g.isNull() | F.trim(g).isin(*tokens)


def canonical(g: Column) -> Column:
    """Upper case, the two letters of a pair sorted."""
    u = F.upper(F.trim(g))
    first, second = F.substring(u, 1, 1), F.substring(u, 2, 1)
    return F.when((F.length(u) == 2) & (first > second), F.concat(second, first)).otherwise(u)


def complement(c: Column) -> Column:
    return F.translate(c, "ACGT", "TGCA")


def _base(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("^[ACGT]$")


def _ends(g: Column) -> tuple[Column, Column, Column]:
    """Upper-case call, its first and last letter (the same for one letter)."""
    u = F.upper(F.trim(g))
    return u, F.substring(u, 1, 1), F.substring(u, -1, 1)


def _called(g: Column) -> Column:
    return ~is_no_call(g) & F.upper(F.trim(g)).rlike("^[ACGT]{1,2}$")


def zygosity(g: Column, ref: Column, alt: Column) -> Column:
    """hom_ref, het or hom_alt; null if the call or the alleles don't decide. Only a pair of two letters may match the other strand."""
    _, a, b = _ends(g)
    r, t = F.upper(ref), F.upper(alt)
    known = _called(g) & _base(r) & _base(t)
    within = a.isin(r, t) & b.isin(r, t)
    flipped = (a != b) & a.isin(complement(r), complement(t)) & b.isin(complement(r), complement(t))
    return F.when(
        known,
        F.when(within, F.when((a != b) | (r == t), "het").when(a == t, "hom_alt").otherwise("hom_ref")).when(flipped, "het"),
    )


def _copies(g: Column, allele: Column) -> Column:
    u = F.upper(F.trim(g))
    return (F.length(u) - F.length(F.replace(u, allele))).cast("int")


def effect_dosage(g: Column, effect: Column, other: Column, maf: Column) -> Column:
    """struct(dosage int, status): copies of the effect allele, tried on both strands.

    A palindromic pair is decided by zygosity alone and needs a frequency to be taken at all; without a usable other
    allele, copies are counted as written and a single letter counts 0.
    """
    u, a, b = _ends(g)
    e = F.upper(F.trim(effect))
    o = F.upper(F.trim(other))
    o = F.when(_base(o), o)
    answer = lambda dose, status: F.struct((F.lit(dose) if isinstance(dose, int | None) else dose).cast("int").alias("dosage"), F.lit(status).alias("status"))
    in_pair = a.isin(e, o) & b.isin(e, o)
    in_other = a.isin(complement(e), complement(o)) & b.isin(complement(e), complement(o))
    return (
        F.when(is_no_call(g), answer(None, "no_call"))
        .when(~_called(g) | ~_base(e), answer(None, "unresolved"))
        .when(o.isNull(), answer(F.when(F.length(u) == 2, _copies(g, e)).otherwise(F.lit(0)), "matched_ref"))
        .when(
            o == complement(e),
            F.when(maf.isNull(), answer(None, "missing_freq"))
            .when(~in_pair, answer(None, "unresolved"))
            .when(a != b, answer(1, "matched_ref"))
            .otherwise(answer(None, "ambiguous_dropped")),
        )
        .when(in_pair, answer(_copies(g, e), "matched_ref"))
        .when(in_other, answer(_copies(g, complement(e)), "matched_flip"))
        .otherwise(answer(None, "unresolved"))
    )


def imputed_dosage(ref: Column, alt: Column, dose: Column, effect: Column, other: Column) -> Column:
    """A continuous ALT dose as a dose of the effect allele; null for palindromes, doses outside 0..2 and pairs that fit neither strand."""
    e, o, r, t = (F.upper(F.trim(c)) for c in (effect, other, ref, alt))
    fits = _base(e) & _base(o) & _base(r) & _base(t) & (r != t) & (o != complement(e)) & dose.between(0.0, 2.0)
    same = ((e == t) & (o == r)) | ((e == r) & (o == t))
    turned = ((e == complement(t)) & (o == complement(r))) | ((e == complement(r)) & (o == complement(t)))
    return F.when(fits & same, F.when(e == t, dose).otherwise(2.0 - dose)).when(fits & turned, F.when(e == complement(t), dose).otherwise(2.0 - dose))


def risk_dosage(g: Column, risk: Column, ref: Column, allow_complement: bool = True) -> Column:
    """Copies of the risk allele, null if undecided: a palindromic homozygote is, unless the strand is trusted."""
    _, a, b = _ends(g)
    k, r = F.upper(F.trim(risk)), F.upper(F.trim(ref))
    known = _called(g) & _base(k) & _base(r)
    within = a.isin(k, r) & b.isin(k, r)
    out = F.when(known & within, _copies(g, k))
    if allow_complement:
        turned = a.isin(complement(k), complement(r)) & b.isin(complement(k), complement(r))
        palindrome = r == complement(k)
        out = F.when(known & palindrome, F.when(within & (a != b), F.lit(1))).when(known & within, _copies(g, k)).when(known & turned, _copies(g, complement(k)))
    return out


def candidates(g: Column) -> Column:
    """The spellings under which a call is looked up, in order: as written, reversed, then on the other strand."""
    u = F.upper(g)
    slash = F.contains(g, F.lit("/"))
    swapped = F.concat(F.substring_index(g, "/", -1), F.lit("/"), F.substring_index(g, "/", 1))
    turn = lambda c: F.when(F.length(c) == 2, F.reverse(c)).otherwise(c)
    pure = u.rlike("^[ACGT]+$")
    return F.array_distinct(F.when(pure, F.array(u, turn(u), complement(u), turn(complement(u)))).when(slash, F.array(g, swapped)).otherwise(F.array(g, turn(g))))


def lookup(mapping: Column, g: Column) -> Column:
    """The value of the first candidate that the map has, also if that value is null."""
    hit = F.filter(candidates(g), lambda c: F.map_contains_key(mapping, c))
    return F.when(F.size(hit) > 0, F.try_element_at(mapping, F.get(hit, 0)))


def strand_ambiguous(mapping: Column, g: Column) -> Column:
    """Whether a homozygote and its complement have different values in the map."""
    u = F.upper(g)
    homozygote = u.rlike("^(AA|CC|GG|TT)$")
    both = F.map_contains_key(mapping, u) & F.map_contains_key(mapping, complement(u))
    return F.coalesce(homozygote & both & ~F.try_element_at(mapping, u).eqNullSafe(F.try_element_at(mapping, complement(u))), F.lit(False))


def in_x_par(pos: Column) -> Column:
    out = F.lit(False)
    for lo, hi in X_PAR:
        out = out | pos.between(lo, hi)
    return out


def probe_class(g: Column) -> Column:
    """snv, indel or null for a call."""
    u = F.upper(F.trim(g))
    return F.when(u.rlike("^[ACGT]{1,2}$"), "snv").when(u.rlike("^[ID]{1,2}$"), "indel")


def row_class(ref: Column, alt: Column) -> Column:
    """snv, indel or null for a pair of alleles."""
    r, t = F.upper(ref), F.upper(alt)
    spelled = r.rlike("^[ACGT]+$") & t.rlike("^[ACGT]+$")
    return F.when(spelled & (F.length(r) == 1) & (F.length(t) == 1), "snv").when(spelled & (F.length(r) != F.length(t)), "indel")


def allele_identity(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """Compact JSON ["chrom",pos,"ref","alt"]."""
    text = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat(F.lit("["), F.concat_ws(",", text(chrom), pos.cast("string"), text(ref), text(alt)), F.lit("]"))


def allelic_state(chrom: Column, pos: Column, zyg: Column, sex: Column) -> Column:
    """Label of a call by chromosome, place, zygosity and sex."""
    c = F.regexp_replace(F.upper(chrom), "^CHR", "")
    mito = c.isin("MT", "M")
    single = (sex == "XY") & (zyg == "hom_alt") & (((c == "X") & ~in_x_par(pos)) | (c == "Y"))
    plain = F.when(zyg == "het", "heterozygous").when(zyg == "hom_alt", "homozygous").when(zyg == "hom_ref", "reference")
    return F.when(mito & (zyg == "hom_alt"), "homoplasmic").when(mito & (zyg == "het"), "heteroplasmic").when(F.coalesce(single, F.lit(False)), "hemizygous").otherwise(plain)


def anchor_dosage(g: Column, effect: Column, other: Column) -> Column:
    """struct(dosage int, status) of one directly typed marker: resolved, untyped, palindrome (a homozygote whose strand nothing tells) or unresolved.

    A heterozygote of a palindromic pair has one copy on either strand.
    """
    found = effect_dosage(g, effect, other, F.lit(None).cast("double"))
    u, a, b = _ends(g)
    e, o = F.upper(F.trim(effect)), F.upper(F.trim(other))
    inside = a.isin(e, o) & b.isin(e, o)
    answer = lambda dose, status: F.struct(F.lit(dose).cast("int").alias("dosage"), F.lit(status).alias("status"))
    known = F.struct(found["dosage"].alias("dosage"), F.lit("resolved").alias("status"))
    pair = F.coalesce((found["status"] == "missing_freq") & inside, F.lit(False))
    return F.when(is_no_call(g), answer(None, "untyped")).when(found["dosage"].isNotNull(), known).when(pair & (a != b), answer(1, "resolved")).when(pair, answer(None, "palindrome")).otherwise(answer(None, "unresolved"))
