"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document. The ledger keeps the measurements and one failure bit a rule; policies are
versioned bit masks applied to the ledger afterwards, and ablations are aggregates over the stored bits, so neither
reads a text again. Only DataFrame functions run here.

Null or empty text: all measurements are 0 and the word minimum fails. Repeated rows and ties: each row is judged by
itself. Texts of any length are measured whole. Empty table: empty ledger. Extra columns pass through; a column that clashes with one of the ledger's own is
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import let, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: Column


@dataclass(frozen=True)
class Policy:
    """version names it; rules are those whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BITS[r] for r in self.rules)


#: The bit of each rule. A bit is never given to another rule, so that old ledgers stay readable.
BITS = {"few_words": 0, "repeats": 1, "symbols": 2, "duplicate_lines": 3, "shouting": 4, "word_length": 5}
BASE = Policy("base-1", ("few_words", "repeats"))
STANDARD = Policy("standard-1", tuple(BITS))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims")


def _dropped(text: Column, chars: str) -> Column:
    """How many of chars are in text."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _next(items: Column) -> Column:
    return F.slice(items, F.lit(2), F.greatest(F.size(items), F.lit(1)))


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: sort the windows, pair equal neighbours, measure the union."""
    two = F.zip_with(w, _next(w), lambda a, b: F.concat(a, F.lit(" "), b))
    three = F.zip_with(two, F.slice(w, F.lit(3), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    windows = F.transform(F.slice(three, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda k, p: F.struct(k.alias("k"), p.alias("p")))
    twins = let(
        F.sort_array(windows),
        lambda s: F.filter(F.zip_with(s, _next(s), lambda a, b: F.when(a["k"] == b["k"], F.array(a["p"], b["p"]))), lambda x: x.isNotNull()),
    )
    return let(
        F.sort_array(F.array_distinct(F.flatten(twins))),
        lambda at: F.aggregate(
            F.zip_with(at, _next(at), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda total, x: total + x
        ),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with MEASURES (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    found = let(
        words(F.col(text)),
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.when(F.size(w) < 4, F.lit(0)).otherwise(_repeat_words(w)).alias("n_repeat_words"),
        ),
    )
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    out = docs.withColumns({"__quality_words": found, "__quality_lines": line_counts})
    values = {
        "n_words": F.col("__quality_words.n_words"),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")),
        "n_symbols": _dropped(t, SYMBOLS),
        "n_lines": F.col("__quality_lines.n"),
        "n_dup_lines": F.col("__quality_lines.n") - F.col("__quality_lines.d"),
        "n_repeat_words": F.col("__quality_words.n_repeat_words"),
        "n_exclaims": _dropped(t, "!"),
    }
    return out.withColumns({k: v.cast("long") for k, v in values.items()}).drop("__quality_words", "__quality_lines")


def rules() -> list[Rule]:
    """Every rule over the measurements. The thresholds are integers, so no rounding decides."""
    n = F.col("n_words")
    checks = {
        "few_words": n < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "duplicate_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "shouting": 2 * F.col("n_exclaims") > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }
    return [Rule(name, BITS[name], c) for name, c in checks.items()]


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and fail_bits (long): bit i is set if the rule with bit i fails."""
    bits = F.lit(0).cast("long")
    for rule in rules():
        bits = bits.bitwiseOR(F.when(rule.fails, F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(docs, text).withColumn("fail_bits", bits)


def failed(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(of: DataFrame, policy: Policy) -> DataFrame:
    """A ledger with kept (boolean) and policy (its version)."""
    return of.withColumns({"kept": ~failed(policy), "policy": F.lit(policy.version)})


def ablation(of: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: rows that fail it, rows only it rejects, and rows kept with and without it.

    The rows are first counted by their masked bits (at most 2**rules groups), so the shuffle doesn't grow with them.
    """
    groups = of.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    listed = groups.agg(F.collect_list(F.struct("bits", "n")).alias("groups"))
    total = lambda keep: F.aggregate(F.filter(F.col("groups"), keep), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    rows = listed.select("groups", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("long").alias("bit")) for r in policy.rules])).alias("r"))
    return rows.select(
        F.lit(policy.version).alias("policy"),
        F.col("r.rule").alias("rule"),
        total(lambda x: x["bits"].bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
        total(lambda x: x["bits"] == F.col("r.bit")).alias("n_only"),
        total(lambda x: x["bits"] == 0).alias("n_kept"),
        total(lambda x: (x["bits"] == 0) | (x["bits"] == F.col("r.bit"))).alias("n_kept_without"),
    )
