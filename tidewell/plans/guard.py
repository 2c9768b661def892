"""What a pipeline's SQL may do: queries, and writes to tables that are declared read_write.

Statements are judged by the nodes of the plan that Spark's parser makes of them: all but queries, statements that only show
something, and INSERT, UPDATE and DELETE are refused, so that what is not known is not allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

from tidewell.functions.dialect import translate
from tidewell.plans.text import PLACEHOLDER, parts, statements


class GuardError(ValueError):
    """A statement that is not allowed, or cannot be read."""


_EMPTY_CLAUSE = re.compile(r"(?i)\b(select\s+(from|where)|from\s+(where|group\s+by|order\s+by)|(where|from|join)\s*$)\b")
_NAME = r"((?:[\w$]+|\"[^\"]+\"|`[^`]+`)(?:\.(?:[\w$]+|\"[^\"]+\"|`[^`]+`))*)"
_WRITE = re.compile(rf"(?is)^\s*(?:(insert)\s+(?:into|overwrite)\s+(?:table\s+)?|(update)\s+|(delete)\s+from\s+|(copy)\s+){_NAME}")
_WRITES = {"InsertIntoStatement": "INSERT", "UpdateTable": "UPDATE", "DeleteFromTable": "DELETE"}
_SHOWS = re.compile(r"(Show|Describe|Explain)\w*")
#: Nodes that act but are no commands to Spark.
_ACTS = re.compile(r"(Insert|Replace|Overwrite|Append|Write)\w*")


def target(statement: str) -> tuple[str, str] | None:
    """(verb, table) of a write; the table is its last name in lower case."""
    code = "".join(t for k, t in parts(statement) if k != "comment")
    after_with = re.sub(r"(?is)^\s*with\b.*?\)\s*(?=insert\b|update\b|delete\b)", "", code)
    m = _WRITE.match(after_with)
    if not m:
        return None
    verb = next(v for v in m.groups()[:4] if v).lower()
    return verb, m[5].split(".")[-1].strip('"`').lower()


def _nodes(plan: JavaObject) -> Iterator[JavaObject]:
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        for below in (node.children(), node.innerChildren()):
            it = below.iterator()
            while it.hasNext():
                todo.append(it.next())


def _table(node: JavaObject) -> str:
    relation = node.table()
    while relation.getClass().getSimpleName() == "SubqueryAlias":
        relation = relation.child()
    names = relation.multipartIdentifier()
    return names.apply(names.size() - 1).lower()


def check(spark: SparkSession, sql: str, access: dict[str, str]) -> None:
    """Raise GuardError unless every statement of sql is allowed. access: table -> read_only or read_write.

    Tables that are not declared may be written. COPY writes files and is refused. Empty SQL is allowed.
    """
    modes = {k.lower(): v for k, v in access.items()}
    session = spark._jsparkSession.sessionState()
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command", True, spark._jvm.Thread.currentThread().getContextClassLoader())
    for statement in statements(sql):
        plain = "".join(t for k, t in parts(statement) if k != "comment")
        if not plain.strip():
            continue
        if _EMPTY_CLAUSE.search("".join(t for k, t in parts(plain) if k == "code")):
            raise GuardError("cannot be parsed: a clause is empty")  # Spark takes these keywords as names
        probe = re.sub(r"(?i)\b(limit|offset)\s+'p'", r"\1 1", PLACEHOLDER.sub("'p'", plain))
        try:
            plan = session.sqlParser().parsePlan(translate(probe))
        except Exception as e:
            raise GuardError(f"cannot be parsed: {str(e).splitlines()[0]}") from e
        for node in _nodes(plan):
            name = node.getClass().getSimpleName()
            if name in _WRITES:
                table = _table(node)
                if modes.get(table, "read_write") == "read_only":
                    raise GuardError(f"{_WRITES[name]} into read_only table {table!r}")
            elif (command.isInstance(node) and not _SHOWS.fullmatch(name)) or _ACTS.fullmatch(name) or name.endswith("Statement"):
                raise GuardError(f"not allowed: {' '.join(plain.split()[:3])}")
