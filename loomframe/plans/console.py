"""The query surface: rule-tree queries with pages, read-only SQL, saved rules and column presets."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Mapping, Sequence
from functools import cache
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.operators.paging import page
from loomframe.operators.rules import RuleError, compile_tree

MAX_ROWS, DEADLINE_S = 1000, 30


class QueryError(ValueError):
    """A query that is not run."""


def field_types(df: DataFrame) -> DataFrame:
    """name and type (boolean, integer, number or text) of each column."""
    kind = lambda t: "boolean" if isinstance(t, T.BooleanType) else "integer" if isinstance(t, T.IntegralType) else "number" if isinstance(t, T.NumericType) else "text"
    return df.sparkSession.createDataFrame([(f.name, kind(f.dataType)) for f in df.schema], "name string, type string")


def rule_query(df: DataFrame, tree: Mapping[str, Any], keys: Sequence[Column], limit: int, cursor: Sequence[Any] | None = None, default: Column | None = None, overrides: Mapping[str, Column] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """One page (limit + 1 rows) of the rows that the tree and the default predicate keep and, for the first page, their count."""
    rows = df.filter(compile_tree(tree, df.schema, overrides))
    rows = rows if default is None else rows.filter(default)
    return page(rows, keys, limit, cursor), None if cursor is not None else rows.agg(F.count("*").alias("total"))


#: Logical operators of a query that only reads. What isn't here (commands, writes, scripts, names made at run time) is refused.
READS = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Join LateralJoin SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith Union Except Intersect UnresolvedHaving WithWindowDefinition Window Generate OneRowRelation UnresolvedInlineTable Pivot Unpivot UnresolvedTableValuedFunction UnresolvedHint UnresolvedTVFAliases Sample LocalRelation".split()
)
#: Built-in functions that run other code, or tell of files and users.
REFUSED = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user user session_user raise_error assert_true".split())


@cache
def _builtin(spark: SparkSession) -> frozenset[str]:
    return frozenset(r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect())


def _seq(items: Any) -> list[Any]:
    return [items.apply(i) for i in range(items.size())]


def check_read_only(spark: SparkSession, sql: str, allowed: Sequence[str | Sequence[str]]) -> None:
    """Raises unless the text parses to one plan that only reads, only allowed tables (names, or lists of their parts), by built-in functions.

    The parsed plan decides, not the words in the text: every operator of it, of its common table expressions and of the
    subqueries in its expressions. A common table expression hides a table only where it is in scope.
    """
    text = sql.strip().rstrip(";")
    if not text:
        raise QueryError("one statement, please")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise QueryError(str(e).split("\n")[0]) from None
    # Names are compared part by part: a part may hold a dot, and only a name of one part can be a common table expression.
    tables = {tuple(x.lower() for x in (a.split(".") if isinstance(a, str) else a)) for a in allowed}
    holds_plan = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")

    def function(parts: Sequence[str]) -> None:
        name = ".".join(parts).lower()
        if name in REFUSED or name not in _builtin(spark):
            raise QueryError(f"not allowed: {name}()")

    def expression(e: Any, scope: frozenset[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            function(_seq(e.nameParts()))
        elif kind == "UnresolvedGenerator":
            function([e.name().funcName()] if e.name().database().isEmpty() else ["", e.name().funcName()])
        elif "Identifier" in kind and kind.startswith(("Expression", "Plan")):
            raise QueryError(f"not allowed: {kind}")
        if holds_plan.isInstance(e):
            relation(e.plan(), scope)
        for child in _seq(e.children()):
            expression(child, scope)

    def relation(node: Any, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in READS:
            raise QueryError(f"not a query: {kind}")
        if kind == "UnresolvedRelation":
            name = tuple(x.lower() for x in _seq(node.multipartIdentifier()))
            if name not in tables and not (len(name) == 1 and name[0] in scope):
                raise QueryError(f"not allowed: {'.'.join(name)}")
        if kind == "UnresolvedTableValuedFunction":
            function(_seq(node.name()))
        if kind == "UnresolvedWith":
            for item in _seq(node.cteRelations()):
                name = item._1().lower()
                relation(item._2(), scope | {name} if node.allowRecursion() else scope)
                scope = scope | {name}
        for e in _seq(node.expressions()):
            expression(e, scope)
        for child in _seq(node.children()):
            relation(child, scope)

    relation(plan, frozenset())


def run_sql(spark: SparkSession, sql: str, allowed: Sequence[str], limit: int = MAX_ROWS, deadline_s: float = DEADLINE_S) -> tuple[list[str], list[tuple], bool]:
    """Columns, rows and whether there were more. Jobs still running at the deadline are cancelled."""
    check_read_only(spark, sql, allowed)
    group = f"console-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    sc.setJobGroup(group, "console", interruptOnCancel=True)
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(deadline_s, stop)
    timer.start()
    try:
        df = spark.sql(sql.strip().rstrip(";"))
        rows = [tuple(r) for r in df.limit(limit + 1).collect()]
        return df.columns, rows[:limit], len(rows) > limit
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"stopped after {deadline_s} s") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.interruptOnCancel", None)


class Registry:
    """Named rule trees or column presets in one JSON object; names are unique."""

    def __init__(self, text: str = "{}"):
        self.items: dict[str, Any] = json.loads(text)

    def add(self, name: str, value: Any) -> None:
        if name in self.items:
            raise KeyError(f"{name} exists")
        self.items[name] = value

    def replace(self, name: str, value: Any) -> None:
        if name not in self.items:
            raise KeyError(name)
        self.items[name] = value

    def remove(self, name: str) -> None:
        del self.items[name]

    def text(self) -> str:
        return json.dumps(self.items, sort_keys=True)


def saved_filter(df: DataFrame, registry: Registry, name: str) -> DataFrame:
    return df.filter(compile_tree(registry.items[name], df.schema))


def preset(df: DataFrame, registry: Registry, name: str) -> DataFrame:
    missing = [c for c in registry.items[name] if c not in df.columns]
    if missing:
        raise RuleError(f"unknown columns: {', '.join(missing)}")
    return df.select(*registry.items[name])


def run_modules(modules: Sequence[tuple[str, Any]], *args: Any) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of what the modules return, in order, and the errors of those that fail; one that fails doesn't stop the others."""
    out, errors = None, {}
    for name, f in modules:
        try:
            df = f(*args).withColumn("module", F.lit(name))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        except Exception as e:  # isolation of modules is the feature
            errors[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return out, errors


def tag(links: DataFrame, tags: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """rows with the sorted list of their tag names; a page's rows are few, so links are reduced by them first."""
    named = links.join(rows.select(key).distinct(), key, "left_semi").join(tags, "tag_id").groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("tags"))
    return rows.join(named, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
