"""Free SQL over named tables, checked on Spark's own parse tree before anything runs.

The text is parsed, not executed, so that commands cannot act while they are being judged.
Every node of the tree and of its subqueries must be a plain query step, every relation one of
the named tables or a table expression of the query itself, and every function built in and
harmless.  The checked text then runs with the names bound to the given frames, whatever the
session's catalog holds under them, and never returns more than ``max_rows`` rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

# Steps of a query.  What is not here is refused: commands, files, table functions, scripts,
# generators, hints, values.
STEPS = frozenset(
    "Project Filter Join Aggregate Sort GlobalLimit LocalLimit Limit Offset Distinct Union Except "
    "Intersect SubqueryAlias UnresolvedWith UnresolvedRelation UnresolvedHaving Window "
    "WithWindowDefinition UnresolvedSubqueryColumnAliases OneRowRelation LateralJoin Pivot "
    "UnresolvedOrderBy".split()
)
# Built-in functions that reach outside the rows or make them grow without bound.
REFUSED = frozenset(
    "java_method reflect try_reflect raise_error assert_true input_file_name "
    "input_file_block_start input_file_block_length spark_partition_id version user current_user "
    "session_user current_catalog current_database current_schema sequence repeat array_repeat "
    "space lpad rpad explode explode_outer posexplode posexplode_outer inline inline_outer stack "
    "json_tuple read_files sleep".split()
)


class Refused(ValueError):
    """A query that may not run, and why."""


def _each(sequence) -> Iterator:
    steps = sequence.iterator()
    while steps.hasNext():
        yield steps.next()


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _expressions(node) -> Iterator:
    waiting = list(_each(node.expressions()))
    while waiting:
        expression = waiting.pop()
        yield expression
        waiting += _each(expression.children())


def _walk(plan) -> Iterator:
    """A plan's nodes with those of its table expressions and subqueries."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        yield node
        inner = [n for n in _each(node.innerChildren()) if hasattr(n, "expressions")]
        waiting += [*_each(node.children()), *_each(node.subqueries()), *inner]


def _parsed(spark: SparkSession, query: str):
    if not isinstance(query, str) or not query.strip(" ;\n\t"):
        raise Refused("an empty query")
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except ParseException as error:
        raise Refused(f"not a query: {str(error).splitlines()[0]}") from None


def check(
    spark: SparkSession, query: str, tables: frozenset[str], database: str | None = None
) -> str:
    """The query with names of ``database`` made plain; anything not allowed raises ``Refused``."""
    plan = _parsed(spark, query)
    nodes = list(_walk(plan))
    for node in nodes:
        if _name(node) not in STEPS:
            raise Refused(f"{_name(node)} is not allowed in a query")
    own = {
        relation._1().lower()
        for node in nodes if _name(node) == "UnresolvedWith" for relation in _each(node.cteRelations())
    }
    taken = own & tables
    if taken:
        raise Refused(f"a table expression may not be called {sorted(taken)[0]!r}")
    read, prefixed = set(), []
    for node in nodes:
        if _name(node) == "UnresolvedRelation":
            parts = [p.lower() for p in _each(node.multipartIdentifier())]
            name = parts[-1]
            if len(parts) == 2 and database and parts[0] == database.lower() and name in tables:
                prefixed.append(_span(node))
            elif len(parts) > 1 or name not in tables | own:
                raise Refused(f"no table is called {'.'.join(parts)!r}")
            read.add(name)
        for expression in _expressions(node):
            kind = _name(expression)
            if kind == "UnresolvedFunction":
                _check_function(spark, expression)
    if not read & tables:
        raise Refused(f"a query must read one of {', '.join(sorted(tables))}")
    for start, end in sorted(set(prefixed), reverse=True):
        part = query[start:end]
        query = query[:start] + part[part.index(".") + 1 :] + query[end:]
    return query


def _span(node) -> tuple[int, int]:
    """Where a relation's name stands in the text."""
    origin = node.origin()
    return origin.startIndex().get(), origin.stopIndex().get() + 1


def _check_function(spark: SparkSession, expression) -> None:
    parts = [p.lower() for p in _each(expression.nameParts())]
    jvm = spark.sparkContext._jvm
    if len(parts) == 1 and parts[0] not in REFUSED:
        registry = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        if registry.functionExists(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(parts[0])):
            return
    raise Refused(f"the function {'.'.join(parts)!r} is not allowed")


def run_sql(
    tables: Mapping[str, DataFrame], query: str, max_rows: int, database: str | None = None
) -> DataFrame:
    """The rows of a checked query over ``tables``, never more than ``max_rows``.

    Joins without a condition to hash or sort by are refused too, from the physical plan.
    """
    if max_rows < 1:
        raise ValueError("max_rows must be positive")
    frames = {name.lower(): frame for name, frame in tables.items()}
    spark = next(iter(frames.values())).sparkSession
    clean = check(spark, query, frozenset(frames), database).rstrip().rstrip(";")
    views = {name: f"_guarded_{uuid.uuid4().hex}" for name in frames}
    try:
        for name, frame in frames.items():
            frame.createOrReplaceTempView(views[name])
        bound = ", ".join(f"`{n}` AS (SELECT * FROM `{v}`)" for n, v in views.items())
        # The views are only names: a frame keeps its plan when they are gone.
        result = spark.sql(f"WITH {bound} SELECT * FROM (\n{clean}\n) LIMIT {int(max_rows)}")
    except AnalysisException as error:
        raise Refused(f"not a query over these tables: {str(error).splitlines()[0]}") from None
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    physical = result._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in physical or "NestedLoopJoin" in physical:
        raise Refused("a join needs an equality between its sides")
    return result
