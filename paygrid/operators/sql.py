"""SQL surface: run query text over named tables with bound parameters, and
turn failures, at analysis or at run time, into three classes.

What a query may do is decided by its plan, not by its wording: it holds no
command or insert, it calls only functions of groups that compute values, and
after analysis every leaf is one of the tables it may read (or a constant or a
range), so neither a path nor a class of the JVM can be reached."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

MISSING_TABLE = "missing_table"
SYNTAX = "syntax"
OTHER = "other"
MESSAGES = {
    MISSING_TABLE: "unknown table or view: {detail}",
    SYNTAX: "not a valid read-only query: {detail}",
    OTHER: "the query failed: {detail}",
}
_PLANS = "org.apache.spark.sql.catalyst.plans.logical."
# A parsed plan with any of these nodes does more than read.
_WRITERS = tuple(_PLANS + c for c in ("Command", "ParsedStatement", "InsertIntoStatement"))
# --- fixed values: groups of built-in functions that compute values from their arguments
FUNCTION_GROUPS = (
    "agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs "
    "generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs "
    "url_funcs variant_funcs window_funcs xml_funcs"
).split()
# Of the group of everything else, those without reach beyond the query.
PLAIN_FUNCTIONS = ("typeof", "raise_error", "assert_true", "monotonically_increasing_id", "uuid")
TABLE_FUNCTIONS = ("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack")
PLAIN_LEAVES = ("OneRowRelation", "Range", "LocalRelation")
# -----------------------------------------------------------------------------------------


class QueryError(Exception):
    def __init__(self, kind: str, detail: str):
        self.kind = kind
        super().__init__(MESSAGES[kind].format(detail=detail))


def classify(exc: BaseException) -> str:
    """Error class from Spark's error condition (not from message wording)."""
    cond = exc.getCondition() if isinstance(exc, PySparkException) else None
    cond = cond or ""
    if cond.startswith("TABLE_OR_VIEW_NOT_FOUND"):
        return MISSING_TABLE
    if cond.startswith("PARSE_SYNTAX_ERROR") or cond.startswith("PARSE_"):
        return SYNTAX
    return OTHER


def run_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None = None,
            args: Mapping[str, Any] | None = None) -> DataFrame:
    """Run a read-only query over ``tables`` (registered as temporary views)
    with named parameters (``:name``) bound by Spark, never pasted into the
    text.  It reads these tables and no others; without ``tables``, the views
    and tables of the session's current database.  The parsed plan is checked
    for commands and functions, the analysed plan for what it reads, before
    anything runs.  Views of the caller that have a table's name are put back
    afterwards."""
    refuse_calls(spark, refuse_writes(spark, text or ""))
    given = tables or {}
    before = {n: spark.table(n) for n in given if _is_temp_view(spark, n)}
    for name, df in given.items():
        df.createOrReplaceTempView(name)
    try:
        out = spark.sql(text, args=dict(args) if args else None)
        known = list(given.values()) if tables is not None else [spark.table(t.name) for t in spark.catalog.listTables()]
        refuse_foreign_leaves(spark, out, known)
        return out
    except PySparkException as e:
        raise _error(e) from e
    finally:
        for name in given:
            before[name].createOrReplaceTempView(name) if name in before else spark.catalog.dropTempView(name)


def _is_temp_view(spark: SparkSession, name: str) -> bool:
    return any(t.isTemporary and t.name.lower() == name.lower() for t in spark.catalog.listTables())


def query_rows(spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None = None,
               args: Mapping[str, Any] | None = None, limit: int = 1000) -> list:
    """Run a query and return at most ``limit`` rows; what fails while it runs is
    classified like what fails before."""
    df = run_sql(spark, text, tables, args)
    try:
        return df.take(limit)
    except PySparkException as e:
        raise _error(e) from e


def refuse_writes(spark: SparkSession, text: str):
    """The parsed plan of ``text``; raises :class:`QueryError` unless it only reads."""
    java = spark.sparkContext._jvm.java.lang.Class
    loader = spark._jsparkSession.getClass().getClassLoader()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except PySparkException as e:
        raise _error(e) from e
    kinds = [java.forName(c, False, loader) for c in _WRITERS]
    for node in _nodes(plan):
        if any(k.isInstance(node) for k in kinds):
            raise QueryError(SYNTAX, f"{node.nodeName()} is not a query")
    return plan


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _nodes(plan):
    """Every node of a plan, with those of its WITH parts and of subqueries in expressions."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        todo += _items(node.children()) + [c for c in _items(node.innerChildren()) if hasattr(c, "expressions")]
        todo += [p for e in _expressions(node) if e.getClass().getSimpleName() in _SUBQUERIES for p in [e.plan()]]


_SUBQUERIES = ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression")


def _expressions(node):
    todo = _items(node.expressions())
    while todo:
        e = todo.pop()
        yield e
        todo += _items(e.children())


def refuse_calls(spark: SparkSession, plan) -> None:
    """Raise :class:`QueryError` if a parsed plan calls a function that does more than compute a value."""
    jvm = spark.sparkContext._jvm
    registry = spark._jsparkSession.sessionState().functionRegistry()

    def check(name: str) -> None:
        found = registry.lookupFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
        if found.isEmpty():
            return                                            # unknown: analysis says so, in its own words
        info = found.get()
        builtin = info.getClassName().startswith("org.apache.spark.sql.")
        if not builtin or (info.getGroup() not in FUNCTION_GROUPS and name not in PLAIN_FUNCTIONS):
            raise QueryError(SYNTAX, f"{name} may not be called")

    for node in _nodes(plan):
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedTableValuedFunction" and _items(node.name())[-1].lower() not in TABLE_FUNCTIONS:
            raise QueryError(SYNTAX, f"{_items(node.name())[-1]} may not be called")
        if kind == "ScriptTransformation":
            raise QueryError(SYNTAX, "TRANSFORM is not a query")
        for e in _expressions(node):
            if e.getClass().getSimpleName() == "UnresolvedFunction":
                check(_items(e.nameParts())[-1].lower())


def refuse_foreign_leaves(spark: SparkSession, df: DataFrame, known: list[DataFrame]) -> None:
    """Raise :class:`QueryError` if an analysed query reads anything but the leaves of ``known``."""
    allowed = [leaf.canonicalized() for t in known for leaf in _leaves(t)]
    for leaf in _leaves(df):
        if leaf.getClass().getSimpleName() in PLAIN_LEAVES:
            continue
        mine = leaf.canonicalized()
        if not any(mine.equals(a) for a in allowed):
            raise QueryError(MISSING_TABLE, "the query reads something that is not one of its tables")


def _leaves(df: DataFrame) -> list:
    plan = df._jdf.queryExecution().analyzed()
    return [n for n in _nodes(plan) if not _items(n.children()) and n.getClass().getSimpleName() not in ("CTERelationRef",)]


def _error(e: PySparkException) -> QueryError:
    return QueryError(classify(e), str(e).splitlines()[0] if str(e) else type(e).__name__)
