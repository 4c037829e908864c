"""Read-only SQL over registered views: one SELECT, its parsed plan checked before it is analysed, with a cap on rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: Functions that run code outside the query, and table functions that are harmless.
BLOCKED_FUNCTIONS = frozenset(("java_method", "reflect", "try_reflect"))
TABLE_FUNCTIONS = frozenset(("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack"))
MAX_ROWS = 500
_COMMENTS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


def _items(sequence) -> Iterator:
    it = sequence.iterator()
    while it.hasNext():
        yield it.next()


def _nodes(node) -> Iterator[tuple[str, object]]:
    """(class name, node) of a parsed plan, its expressions, common tables and subqueries."""
    stack = [node]
    while stack:
        at = stack.pop()
        name = at.getClass().getSimpleName()
        yield name, at
        stack += _items(at.children())
        stack += _items(at.innerChildren())
        if hasattr_java(at, "expressions"):
            stack += _items(at.expressions())
        if hasattr_java(at, "plan") and name.endswith(("Subquery", "Exists", "ListQuery", "ScalarSubquery", "LateralSubquery", "InSubquery")):
            stack.append(at.plan())


def hasattr_java(node, method: str) -> bool:
    """Whether a JVM object has a method without arguments of that name."""
    return any(m.getName() == method and m.getParameterCount() == 0 for m in node.getClass().getMethods())


def check(spark: SparkSession, sql: str, views: Iterable[str] | None = None) -> str:
    """The statement, or ValueError if it is not a single query over ``views`` (all temporary views if None).

    The parsed plan is walked, subqueries included: every relation must be a permitted view or a common table of the
    query itself, so paths and other catalogs are out of reach, commands are refused and so are functions that call
    into the JVM. Words in literals, comments and column names do not matter.
    """
    bare = _COMMENTS.sub(" ", sql).strip()
    if not re.match(r"(?i)(select|with)\b", bare):
        raise ValueError("only SELECT statements are allowed")
    if ";" in bare:
        raise ValueError("semicolons are not allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise ValueError(f"not a statement: {str(error).splitlines()[0]}") from error
    permitted = {v.lower() for v in views} if views is not None else {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    nodes = list(_nodes(plan))
    permitted |= {n.alias().lower() for name, w in nodes if name == "UnresolvedWith" for n in _items(w.innerChildren())}
    for name, node in nodes:
        if name.endswith(("Command", "Statement")) or name.startswith(("InsertInto", "Create", "Drop", "Alter", "MergeInto", "SetCatalog")):
            raise ValueError(f"not a query: {name}")
        if name == "UnresolvedRelation":
            parts = list(_items(node.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in permitted:
                raise ValueError(f"not a permitted view: {'.'.join(parts)}")
        if name == "UnresolvedTableValuedFunction" and list(_items(node.name()))[-1].lower() not in TABLE_FUNCTIONS:
            raise ValueError("not a permitted table function")
        if name == "UnresolvedFunction" and list(_items(node.nameParts()))[-1].lower() in BLOCKED_FUNCTIONS:
            raise ValueError("not a permitted function")
    return sql


def run(spark: SparkSession, sql: str, max_rows: int = MAX_ROWS, views: Iterable[str] | None = None) -> DataFrame:
    return spark.sql(check(spark, sql, views)).limit(max_rows)


def as_json(spark: SparkSession, sql: str, max_rows: int = MAX_ROWS, views: Iterable[str] | None = None) -> str:
    """Rows of a guarded query as one JSON object, or ``{"error": ...}`` for whatever is refused or fails; rows are capped."""
    try:
        rows = run(spark, sql, max_rows, views).toJSON().collect()
    except (ValueError, PySparkException) as error:
        return json.dumps({"error": str(error).splitlines()[0]})
    return json.dumps({"rows": [json.loads(r) for r in rows], "count": len(rows)})
