"""Filters from data: rule trees, a key:value mini-language, named parameters and prefix search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DEPTH, MAX_RULES = 20, 200
OPERATORS = ("=", "!=", "<", ">", "<=", ">=", "contains", "beginsWith", "endsWith", "in", "notIn", "between", "null", "notNull")
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")


class RuleError(ValueError):
    """A rule tree that can't be compiled."""


def coerce(value: Any, kind: T.DataType) -> Any:
    """A JSON value as a literal of a column's type."""
    if isinstance(kind, T.BooleanType):
        word = str(value).strip().lower()
        if word in TRUE or word in FALSE:
            return word in TRUE
        raise RuleError(f"not a boolean: {value!r}")
    if isinstance(kind, T.NumericType):
        if isinstance(value, bool) or value is None:
            raise RuleError(f"not a number: {value!r}")
        try:
            text = str(value).strip()
            return float(text) if any(x in text.lower() for x in (".", "e")) else int(text)
        except ValueError:
            raise RuleError(f"not a number: {value!r}") from None
    if value is None:
        raise RuleError("a value is missing")
    return str(value)


def leaf(rule: Mapping[str, Any], schema: T.StructType, overrides: Mapping[str, Column]) -> Column:
    name, op, value = rule.get("field"), rule.get("operator"), rule.get("value")
    if not isinstance(name, str) or name not in schema.fieldNames():
        raise RuleError(f"unknown field: {name!r}")
    if op not in OPERATORS:
        raise RuleError(f"unknown operator: {op!r}")
    kind = schema[name].dataType
    c = overrides.get(name, F.col(f"`{name}`"))
    if op == "null":
        return c.isNull()
    if op == "notNull":
        return c.isNotNull()
    if op in ("in", "notIn", "between"):
        if not isinstance(value, list | tuple) or (op == "between" and len(value) != 2):
            raise RuleError(f"{op} takes a list" + " of two" * (op == "between"))
        items = [coerce(v, kind) for v in value]
        if op == "between":
            return c.between(*items)
        if not items:
            return F.lit(op == "notIn")
        return c.isin(items) if op == "in" else ~c.isin(items)
    if op in ("contains", "beginsWith", "endsWith"):
        if not isinstance(kind, T.StringType):
            raise RuleError(f"{op} is for text fields")
        # as LIKE in the source system: case is ignored, % and _ keep their meaning
        return c.ilike(f"{'' if op == 'beginsWith' else '%'}{value}{'' if op == 'endsWith' else '%'}")
    v = coerce(value, kind)
    return {"=": c == v, "!=": c != v, "<": c < v, ">": c > v, "<=": c <= v, ">=": c >= v}[op]


def _size(node: Mapping[str, Any]) -> int:
    if "rules" in node:
        return sum(_size(x) for x in node["rules"] if isinstance(x, Mapping))
    return int("field" in node)


def compile_tree(tree: Mapping[str, Any], schema: T.StructType, overrides: Mapping[str, Column] | None = None) -> Column:
    """The predicate of a rule tree. Disabled rules count against the limit but are left out; a group without rules is true."""
    if not isinstance(tree, Mapping) or not isinstance(tree.get("rules", []), list):
        raise RuleError("a group has a list of rules")
    if _size(tree) > MAX_RULES:
        raise RuleError(f"more than {MAX_RULES} rules")

    def group(node: Mapping[str, Any], depth: int) -> Column:
        if depth > MAX_DEPTH:
            raise RuleError(f"deeper than {MAX_DEPTH}")
        combinator = str(node.get("combinator", "and")).lower()
        if combinator not in ("and", "or"):
            raise RuleError(f"unknown combinator: {combinator}")
        parts = []
        for child in node.get("rules", []):
            if not isinstance(child, Mapping) or child.get("disabled"):
                continue
            parts.append(group(child, depth + 1) if "rules" in child else leaf(child, schema, overrides or {}))
        out = parts[0] if parts else F.lit(True)
        for p in parts[1:]:
            out = (out & p) if combinator == "and" else (out | p)
        return ~out if node.get("not") else out

    return group(tree, 0)


def filter_tree(df: DataFrame, tree: Mapping[str, Any], overrides: Mapping[str, Column] | None = None) -> DataFrame:
    return df.filter(compile_tree(tree, df.schema, overrides))


def masked(df: DataFrame, condition: Column, columns: Sequence[str]) -> DataFrame:
    """df with columns nulled where condition holds, in output and in later predicates."""
    return df.withColumns({c: F.when(condition, F.lit(None)).otherwise(F.col(c)) for c in columns})


def parse_pairs(text: str | None, schema: T.StructType, keys: Mapping[str, str], enums: Mapping[str, Sequence[str]] | None = None) -> list[Column]:
    """Predicates of "key:value,key:value". keys maps a key to its column; unknown keys, malformed parts and invalid values are skipped."""
    out = []
    for part in (text or "").split(","):
        key, colon, value = (x.strip() for x in part.partition(":"))
        if not colon or key not in keys or not value:
            continue
        name = keys[key]
        if value in ("null", "notnull"):
            out.append(F.col(name).isNull() if value == "null" else F.col(name).isNotNull())
            continue
        if enums and key in enums and value not in enums[key]:
            continue
        try:
            out.append(F.col(name) == F.lit(coerce(value, schema[name].dataType)))
        except RuleError:
            continue
    return out


def filter_pairs(df: DataFrame, text: str | None, keys: Mapping[str, str], enums: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    for c in parse_pairs(text, df.schema, keys, enums):
        df = df.filter(c)
    return df


def filter_named(df: DataFrame, equal: Mapping[str, Any] | None = None, at_least: Mapping[str, float] | None = None, at_most: Mapping[str, float] | None = None, label: tuple[str, str] | None = None, conflicting: bool = False) -> DataFrame:
    """Equality, bounds, and a case-insensitive part of a label, without labels that say "conflicting" unless asked for. None is no filter."""
    for name, v in (equal or {}).items():
        df = df if v is None else df.filter(F.col(name) == v)
    for name, v in (at_least or {}).items():
        df = df if v is None else df.filter(F.col(name) >= v)
    for name, v in (at_most or {}).items():
        df = df if v is None else df.filter(F.col(name) <= v)
    if label and label[1]:
        low = F.lower(F.col(label[0]))
        df = df.filter(F.contains(low, F.lit(label[1].lower())))
        if not conflicting:
            df = df.filter(~F.contains(low, F.lit("conflicting")))
    return df


def prefix(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows in which one of the columns begins with text, whatever its case. One pass; % and _ are letters."""
    out = F.lit(False)
    for c in columns:
        out = out | F.startswith(F.lower(F.col(c)), F.lit(text.lower()))
    return df.filter(out)


def primary_term(c: Column, term: str, without: Sequence[str] = ("low penetrance", "risk allele")) -> Column:
    """Whether term is the first of a compound label (term, term|..., term,...) that has none of the phrases in without."""
    hit = (c == term) | F.startswith(c, F.lit(term + "|")) | F.startswith(c, F.lit(term + ","))
    for phrase in without:
        hit = hit & ~c.ilike(f"%{phrase}%")
    return hit


def only_terms(c: Column, allowed: Sequence[str]) -> Column:
    """Whether all terms of a label separated by / | , are among allowed."""
    terms = F.transform(F.split(c, r"[/|,]"), lambda t: F.trim(F.lower(t)))
    return F.size(F.array_except(terms, F.array(*[F.lit(a.lower()) for a in allowed]))) == 0


def gate(checks: Sequence[tuple[str, Column]], passed: Column | None = None, ok: str = "pass") -> Column:
    """The name of the first check that fails (is not true), else ok; passed skips the checks."""
    out = F.when(passed, ok) if passed is not None else None
    for name, c in checks:
        fails = ~F.coalesce(c, F.lit(False))
        out = out.when(fails, name) if out is not None else F.when(fails, name)
    return out.otherwise(ok) if out is not None else F.lit(ok)


def surfaceable(chrom: Column, sex: Column) -> Column:
    """All but chromosome Y of samples that are known to be XX."""
    return ~(F.upper(chrom).isin("Y", "CHRY") & F.coalesce(sex == "XX", F.lit(False)))


def consented(df: DataFrame, consent: Column, numbers: Sequence[str]) -> DataFrame:
    """df with opt_in_required; the numbers of a row without consent are null. An unknown consent is none."""
    given = F.coalesce(consent, F.lit(False))
    return df.withColumns({"opt_in_required": ~given} | {c: F.when(given, F.col(c)) for c in numbers})


def sex_context(recorded: Column, inferred: Column) -> Column:
    """female, male or unresolved: the recorded sex counts before the inferred one."""
    sex = F.coalesce(F.when(recorded.isin("XX", "XY"), recorded), inferred)
    return F.when(sex == "XX", "female").when(sex == "XY", "male").otherwise("unresolved")
