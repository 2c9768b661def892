"""Named parameters of a query: where they stand, what column each is compared with, and its type.

``{name}`` in code becomes a Spark named parameter marker, so values are bound by Catalyst and never
pasted into text. Columns come from the parsed plan, by name; heuristics on the name come last.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tidewell.functions.dialect import calls
from tidewell.plans.text import PLACEHOLDER, in_code, parts

_LIMIT = re.compile(r"(?i)\b(limit|offset)\s+\{([a-zA-Z_]\w*)\}")
_COMMA_LIMIT = re.compile(r"(?i)\blimit\s+(\{\w+\}|\d+)\s*,\s*(\{\w+\}|\d+)")
_OPERAND = r"((?:[A-Za-z_]\w*|\"[^\"]+\"|`[^`]+`)(?:\.(?:[A-Za-z_]\w*|\"[^\"]+\"|`[^`]+`))*)"
_COMPARED = re.compile(
    rf"(?is){_OPERAND}\s*(?:=|!=|<>|<=|>=|<|>|(?:not\s+)?i?like|(?:not\s+)?between|(?:not\s+)?in\s*\((?:[^()]*,)?)\s*\{{(\w+)\}}"
)
_COMPARES = re.compile(rf"(?is)\{{(\w+)\}}\s*(?:=|!=|<>|<=|>=|<|>)\s*{_OPERAND}")
_IN_LIST = re.compile(rf"(?is){_OPERAND}\s+(?:not\s+)?in\s*\(([^()]*)\)")
_NUMBER_NEAR = re.compile(r"(?is)\{(\w+)\}\s*(?:=|<|>|<=|>=|!=|<>)\s*-?\d|-?\d+(?:\.\d+)?\s*(?:=|<|>|<=|>=|!=|<>)\s*\{(\w+)\}")
#: The table functions that search vectors, and what their number of neighbours counts as being compared with.
KNN, NEIGHBOURS = ("knn", "vector_knn", "lance_knn"), "number of neighbours"
_VALUES = re.compile(r"(?is)^\s*insert\s+into\s+[^()]+\(([^()]*)\)\s*values\s*(.*)$")
_KEYWORDS = {"and", "or", "not", "where", "on", "having", "when", "then", "else", "null", "select", "set", "values", "in", "like", "between", "is"}


@dataclass(frozen=True)
class Parameter:
    name: str
    column: str | None
    type: T.DataType
    nullable: bool = True


def names(sql: str) -> list[str]:
    """Distinct parameters in order of first occurrence, those in literals and comments left out."""
    return list(dict.fromkeys(m for kind, text in parts(sql) if kind == "code" for m in PLACEHOLDER.findall(text)))


def misplaced(sql: str) -> list[str]:
    """Parameters inside a literal, where no value can be bound."""
    return [m for kind, text in parts(sql) if kind == "literal" for m in PLACEHOLDER.findall(text)]


def by_affix(name: str) -> str:
    """The column a name hints at: min_price, price_max -> price."""
    for affix in ("min_", "max_"):
        if name.startswith(affix):
            return name[len(affix) :]
    for affix in ("_min", "_max"):
        if name.endswith(affix):
            return name[: -len(affix)]
    return name


def columns(sql: str) -> dict[str, str]:
    """Parameter -> the column it is compared with, or limit, offset or NEIGHBOURS."""
    code = "".join("''" if kind == "literal" else "" if kind == "comment" else text for kind, text in parts(sql))
    found: dict[str, str] = {}

    def note(name: str, operand: str) -> None:
        column = operand.split(".")[-1].strip('"`')
        if column.lower() not in _KEYWORDS:
            found.setdefault(name, column)

    for m in _LIMIT.finditer(code):
        found.setdefault(m[2], m[1].lower())
    for _, _, args in calls(code, KNN):
        if len(args) > 3 and (p := PLACEHOLDER.fullmatch(args[3])):
            found.setdefault(p[1], NEIGHBOURS)
    if m := _VALUES.search(code):
        targets = [c.strip() for c in m[1].split(",")]
        for row in re.findall(r"\(([^()]*)\)", m[2]):
            for target, value in zip(targets, row.split(","), strict=False):
                if p := PLACEHOLDER.fullmatch(value.strip()):
                    note(p[1], target)
    for m in _COMPARED.finditer(code):
        note(m[2], m[1])
    for m in _COMPARES.finditer(code):
        note(m[1], m[2])
    for m in _IN_LIST.finditer(code):
        for name in PLACEHOLDER.findall(m[2]):
            note(name, m[1])
    return found


def _tables(spark: SparkSession, sql: str) -> list[str]:
    """Registered tables, those that the query names first."""
    every = [t.name for t in spark.catalog.listTables()]
    words = set(re.findall(r"\w+", sql.lower()))
    return sorted(every, key=lambda t: (t.lower() not in words, t))


def infer(spark: SparkSession, sql: str) -> list[Parameter]:
    """Each parameter with its column and type: of the column, else bigint for limits, double beside a number, string."""
    if not names(sql):
        return []
    compared, kinds, named = columns(sql), {}, {}
    words = set(re.findall(r"\w+", sql.lower()))
    for table in _tables(spark, sql):
        try:
            for f in spark.table(table).schema:
                kinds.setdefault(f.name, f.dataType)
                if table.lower() in words:
                    named.setdefault(f.name, f.dataType)
        except AnalysisException:
            continue
    numeric = {n for m in _NUMBER_NEAR.finditer(sql) for n in m.groups() if n}
    out = []
    for name in names(sql):
        column = compared.get(name)
        # a name alone says something about the query's own tables only
        hinted = column if column is not None else by_affix(name) if by_affix(name) in (named or kinds) else None
        if column in ("limit", "offset", NEIGHBOURS) or (hinted is None and name in ("limit", "offset", "count")):
            kind: T.DataType = T.LongType()
        elif hinted in kinds:
            kind = _widened(kinds[hinted])
        else:
            kind = T.DoubleType() if name in numeric else T.StringType()
        out.append(Parameter(name, column or hinted, kind))
    return out


def _widened(kind: T.DataType) -> T.DataType:
    return T.LongType() if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType) else kind


def marked(sql: str, types: dict[str, T.DataType] | None = None, values: dict | None = None) -> str:
    """sql with markers for parameters, cast to their types; a null limit becomes LIMIT ALL, a null offset 0."""
    values = values or {}

    def change(code: str) -> str:
        code = _COMMA_LIMIT.sub(r"LIMIT \2 OFFSET \1", code)

        def limited(m: re.Match) -> str:
            if values.get(m[2]) is None:
                return "LIMIT ALL" if m[1].lower() == "limit" else "OFFSET 0"
            return f"{m[1]} :{m[2]}"

        def cast(m: re.Match) -> str:
            kind = (types or {}).get(m[1])
            return f":{m[1]}" if kind is None or isinstance(kind, T.NullType) else f"CAST(:{m[1]} AS {kind.simpleString()})"

        return PLACEHOLDER.sub(cast, _LIMIT.sub(limited, code))

    return in_code(sql, change)


@dataclass
class Report:
    valid: bool
    errors: list[str]
    warnings: list[str]
    parameters: list[Parameter]
    fields: list[str]


def validate(spark: SparkSession, sql: str) -> Report:
    """Syntax errors make a query invalid; that it cannot be planned is a warning."""
    errors, warnings, fields = [], [], []
    found = infer(spark, sql)
    if bad := misplaced(sql):
        errors.append(f"parameters inside a literal: {', '.join(bad)}")
    text = marked(sql, {p.name: p.type for p in found})
    try:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        errors.append(str(e).splitlines()[0])
    if not errors:
        try:
            fields = spark.sql(text, args={p.name: None for p in found if f":{p.name}" in text}).schema.names
        except (AnalysisException, ParseException) as e:
            warnings.append(f"cannot be planned: {str(e).splitlines()[0]}")
    if not found:
        warnings.append("no parameters")
    if not fields:
        warnings.append("no output fields")
    warnings += [f"{f!r} is not a plain identifier" for f in fields if not re.fullmatch(r"[A-Za-z_]\w*", f, re.A)]
    return Report(not errors, errors, warnings, found, fields)
