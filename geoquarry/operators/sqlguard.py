"""Read-only SQL: one query over the session's views, judged by the plan that Spark parses and resolves, capped in rows.

The text is never searched for words: Spark's own parser says what the statement is. Before anything is resolved, every
node of the parsed plan (subqueries included) has to be one of a query's, so commands and writes are refused, and every
relation has to be a plain name, so no path, catalog or file reader is reached. After resolution, which runs nothing, no
expression may call foreign code. A query begins with SELECT or WITH, and functions named like statements are barred.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000
# What a parsed query is made of, expressions that leave Spark's own functions, and names that no function may have.
NODES = frozenset(
    "Project Filter Aggregate Distinct Sort Join Union Intersect Except SubqueryAlias Limit GlobalLimit LocalLimit Offset Generate Window WithWindowDefinition UnresolvedWith UnresolvedRelation UnresolvedHaving UnresolvedSubqueryColumnAliases "
    "UnresolvedInlineTable UnresolvedOrdinal OneRowRelation LocalRelation Pivot Unpivot LateralJoin Deduplicate Sample ResolvedInlineTable Expand BaseGroupingSets CTERelationDef WithCTE AsOfJoin".split()
)
FOREIGN = frozenset("CallMethodViaReflection ReflectWithMessage TryReflect ScalaUDF PythonUDF PythonUDAF PythonUDTF ScalaAggregator ScalaUDAF HiveSimpleUDF HiveGenericUDF HiveUDAFFunction ApplyFunctionExpression UserDefinedPythonFunction".split())
NAMES = frozenset("reflect try_reflect java_method read_files insert update delete drop create alter truncate replace merge grant revoke attach detach copy export import install load pragma call set reset vacuum checkpoint".split())
_BEGIN = re.compile(r"(?:\s|--[^\n]*\n|/\*.*?\*/)*(?:select|with)\b", re.I | re.S)


class QueryRejected(ValueError):
    """The text is not a plain read-only query."""


def _items(seq: JavaObject) -> Iterator[JavaObject]:
    for i in range(seq.length()):
        yield seq.apply(i)


def _inner(expression: JavaObject) -> JavaObject | None:
    """The plan of a subquery expression."""
    try:
        return expression.plan()
    except Py4JError:
        return None


def _walk(plan: JavaObject) -> Iterator[tuple[str, JavaObject]]:
    """("node" or "expression", object) of a plan, with all its expressions, subqueries and common table expressions."""
    todo = [("node", plan)]
    while todo:
        kind, at = todo.pop()
        yield kind, at
        todo.extend((kind, x) for x in _items(at.children()))
        if kind == "node":
            todo.extend(("expression", x) for x in _items(at.expressions()))
            # plans that a node holds without being their parent: the definitions of WITH
            todo.extend(("node", x) for x in _items(at.innerChildren().toSeq()) if hasattr(x, "children") and _is_plan(x))
        elif (own := _inner(at)) is not None:
            todo.append(("node", own))


def _is_plan(x: JavaObject) -> bool:
    return "plans.logical" in x.getClass().getName() or x.getClass().getSimpleName().startswith("Unresolved")


def validate(spark: SparkSession, query: str) -> str:
    """The query, or ``QueryRejected``; nothing is resolved or run."""
    if not _BEGIN.match(query):
        raise QueryRejected("a query begins with SELECT or WITH")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except PySparkException as e:
        raise QueryRejected(f"not one SQL query: {str(e).splitlines()[0] if str(e) else type(e).__name__}") from e
    for kind, at in _walk(plan):
        name = at.getClass().getSimpleName()
        if kind == "node" and name not in NODES:
            raise QueryRejected(f"{name} is not part of a read-only query")
        if name == "UnresolvedRelation" and at.multipartIdentifier().length() != 1:
            raise QueryRejected("only views of the session can be read")
        if name == "UnresolvedFunction" and (at.nameParts().length() != 1 or at.nameParts().apply(0).lower() in NAMES):
            raise QueryRejected(f"the function {at.nameParts().mkString('.')} is not allowed")
    return query


def run(spark: SparkSession, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The first rows of a validated query over the session's views."""
    out = spark.sql(validate(spark, query))
    for kind, at in _walk(out._jdf.queryExecution().analyzed()):
        if kind == "expression" and at.getClass().getSimpleName() in FOREIGN:
            raise QueryRejected(f"{at.getClass().getSimpleName()} is not allowed")
    return out.limit(max(1, min(limit, MAX_LIMIT)))


def run_trusted(spark: SparkSession, query: str, **args: object) -> DataFrame:
    """A query of our own with bound values (``:name``)."""
    return spark.sql(query, args=args)
