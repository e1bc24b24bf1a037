"""Guarded SQL over registered views: one query, reading only, bounded rows.

The text goes to Spark's parser and what the parser makes of it is looked through, subqueries too: only
nodes of reading queries, only named views (and the query's own WITH names) and only Spark's built-in
functions without those that reach outside SQL. The text itself is never changed.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

MOST_ROWS = 200
#: What a reading query may consist of, by the parser's names, beside expressions.
READING = frozenset(
    """Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias Window
    WithWindowDefinition Generate Pivot Unpivot Sample LocalRelation OneRowRelation LateralJoin Expand PipeOperator
    UnresolvedWith UnresolvedRelation UnresolvedAttribute UnresolvedStar UnresolvedAlias UnresolvedFunction UnresolvedOrdinal
    UnresolvedGenerator UnresolvedHaving UnresolvedSubqueryColumnAliases UnresolvedInlineTable UnresolvedNamedLambdaVariable
    UnresolvedExtractValue UnresolvedTableValuedFunction""".split()
)
EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
#: Built-in functions that run code, or tell of the machine and the files.
DENIED = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user session_user user version spark_partition_id".split())


class SqlRefused(ValueError):
    pass


def _nodes(tree) -> Iterator[dict]:
    if isinstance(tree, dict):
        if "class" in tree:
            yield tree
        for part in tree.values():
            yield from _nodes(part)
    elif isinstance(tree, list):
        for part in tree:
            yield from _nodes(part)


def _parts(name) -> list[str]:
    """'[a, b]', a parsed name as the parser prints it."""
    return [p.strip().lower() for p in str(name).strip("[]").split(",")]


def _built_in(spark: SparkSession) -> frozenset:
    return frozenset(r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()) - DENIED


def checked(spark: SparkSession, sql: str, views: Collection[str] | None = None) -> str:
    """The query as it stands, or SqlRefused. views: what may be read; None: all temporary views."""
    try:
        tree = json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toJSON())
    except PySparkException as e:
        raise SqlRefused(f"one SELECT or WITH statement only: {str(e).splitlines()[0][:200]}") from e
    if views is None:
        views = [t.name for t in spark.catalog.listTables() if t.isTemporary]
    views, functions, own, read = {v.lower() for v in views}, _built_in(spark), set(), set()
    for node in _nodes(tree):
        kind = node["class"].rsplit(".", 1)[-1].removesuffix("$")
        if not node["class"].startswith(EXPRESSIONS) and kind not in READING:
            raise SqlRefused(f"{kind} is not allowed: only SELECT and WITH")
        if kind == "SubqueryAlias":
            own.add(str(node["identifier"]["name"]).lower())
        elif kind == "UnresolvedRelation":
            read.add(tuple(_parts(node["multipartIdentifier"])))
        elif kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction", "UnresolvedGenerator"):
            name = [node["name"]["funcName"].lower()] if kind == "UnresolvedGenerator" else _parts(node.get("nameParts") or node.get("name"))
            if len(name) != 1 or name[0] not in functions:
                raise SqlRefused(f"function {'.'.join(name)} is not allowed")
    for name in read:
        if len(name) != 1 or not (name[0] in views or (name[0] in own and not spark.catalog.tableExists(name[0]))):
            raise SqlRefused(f"{'.'.join(name)}: only registered tables can be read: {', '.join(sorted(views))}")
    return sql


def run_sql(spark: SparkSession, sql: str, limit: int = MOST_ROWS, views: Collection[str] | None = None) -> DataFrame:
    return spark.sql(checked(spark, sql, views)).limit(min(limit, MOST_ROWS))


def listing(spark: SparkSession, views: list[str]) -> DataFrame:
    """table, rows, column, type of the views."""
    rows = [(v, spark.table(v).count(), f.name, f.dataType.simpleString()) for v in views for f in spark.table(v).schema]
    return spark.createDataFrame(rows, "table string, rows long, column string, type string")
