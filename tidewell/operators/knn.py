"""Nearest neighbours: a DataFrame function, and its table function for SQL.

The distance is computed per row inside the scan's stage; the k nearest come from a top-k per partition that is merged
(TakeOrderedAndProject), so no more than k rows of a partition ever move. The filter goes before the top-k.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.dialect import array_literals, calls

if TYPE_CHECKING:
    from tidewell.operators.vector_index import VectorIndex

METRICS = ("l2", "cosine", "dot")


class KnnError(ValueError):
    """A call that cannot be planned."""


def distance(vector: Column | str, query: Column, metric: str) -> Column:
    """l2: squared Euclidean; cosine: 1 - cosine; dot: 1 - dot product. In double precision."""
    v = F.col(vector) if isinstance(vector, str) else vector
    v, q = v.cast("array<double>"), query.cast("array<double>")

    def total(pairs: Column) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)

    if metric == "l2":
        return total(F.zip_with(v, q, lambda a, b: (a - b) * (a - b)))
    dot = total(F.zip_with(v, q, lambda a, b: a * b))
    if metric == "dot":
        return 1 - dot
    if metric == "cosine":
        norms = F.sqrt(total(F.transform(v, lambda a: a * a))) * F.sqrt(total(F.transform(q, lambda a: a * a)))
        return 1 - dot / F.nullif(norms, F.lit(0.0))
    raise KnnError(f"unknown metric {metric!r}")


def knn(df: DataFrame, vector_col: str, query: Sequence[float] | DataFrame, k: int, filter: str | None = None, metric: str = "l2", tie: str | None = None) -> DataFrame:
    """The k rows nearest to query, nearest first: all columns but the vector, then _distance (float).

    query is a literal, or a DataFrame whose first row's first column is the vector; without a row the
    result is empty. Null vectors and those of another dimension are passed over. Equal distances are
    ordered by tie (the first column by default).
    """
    if k < 0:
        raise KnnError("k must not be negative")
    near = df.filter(filter) if filter else df
    others = [c for c in df.columns if c != vector_col]
    if isinstance(query, DataFrame):
        one = query.select(F.col(query.columns[0]).alias("__q")).limit(1)
        near = near.crossJoin(F.broadcast(one)).filter("__q is not null")
        q = F.col("__q")
    else:
        if not len(query):
            raise KnnError("the query vector is empty")
        q = F.lit([float(x) for x in query])
    d = distance(vector_col, q, metric)
    near = near.filter(F.size(vector_col) == F.size(q)).withColumn("__d", d)
    # null distances go after the top-k, where they stand last: a filter before it would compute each distance twice
    near = near.orderBy(F.col("__d").asc_nulls_last(), tie or others[0]).limit(k).filter("__d is not null")
    return near.select(*others, F.col("__d").cast("float").alias("_distance"))


@dataclass
class VectorTables:
    """Tables that the table function can search: name -> metric, and name -> index where there is one."""

    metrics: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, VectorIndex] = field(default_factory=dict)

    def register(self, name: str, metric: str = "l2", index: VectorIndex | None = None) -> None:
        if metric not in METRICS:
            raise KnnError(f"unknown metric {metric!r}")
        if index is not None and index.metric != metric:
            raise KnnError(f"the index of {name!r} is for {index.metric}, not for {metric}")
        self.metrics[name] = metric
        self.indexes.pop(name, None)
        if index is not None:
            self.indexes[name] = index


def _text(argument: str, what: str) -> str:
    m = re.fullmatch(r"'((?:[^']|'')*)'", argument)
    if not m:
        raise KnnError(f"{what} must be a string literal")
    return m[1].replace("''", "'")


_SUMS = {
    "l2": "aggregate(zip_with({v}, {q}, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x)",
    "dot": "1 - aggregate(zip_with({v}, {q}, (a, b) -> a * b), 0D, (s, x) -> s + x)",
    "cosine": "1 - aggregate(zip_with({v}, {q}, (a, b) -> a * b), 0D, (s, x) -> s + x) / nullif("
    "sqrt(aggregate({v}, 0D, (s, x) -> s + x * x)) * sqrt(aggregate({q}, 0D, (s, x) -> s + x * x)), 0D)",
}


def _derived(columns: list[str], relation: str, column: str, vector: str, k: str, where: str | None, metric: str) -> str:
    """The call as a derived table: the table's columns without the vector, and _distance."""
    others = [f"`{c}`" for c in columns if c != column]
    distance_ = _SUMS[metric].format(v="v_", q="q_")
    near = f"SELECT {', '.join(others)}, CAST(`{column}` AS ARRAY<DOUBLE>) AS v_ FROM {relation}" + (f" WHERE ({where})" if where else "")
    scored = f"SELECT {', '.join(others)}, {distance_} AS d_ FROM ({near}) CROSS JOIN ({vector}) WHERE size(v_) = size(q_)"
    nearest = f"SELECT * FROM ({scored}) ORDER BY d_ NULLS LAST, {others[0]} LIMIT {k}"
    return f"(SELECT {', '.join(others)}, CAST(d_ AS FLOAT) AS _distance FROM ({nearest}) WHERE d_ IS NOT NULL)"


def rewrite(spark: SparkSession, sql: str, tables: VectorTables, names: tuple[str, ...] = ("knn", "vector_knn", "lance_knn")) -> str:
    """Calls knn('table', 'column', vector, k [, 'filter']) in sql as derived tables, for Catalyst to resolve and bind.

    vector is an array literal or a scalar subquery in parentheses, which may name the query's parameters and common table
    expressions; k is an integer literal or a parameter. A table's index is used where vector and k are literals and there is
    no filter, as the cells to read are known then; all other calls are exact.
    """
    for start, end, args in calls(sql, names):
        if not 4 <= len(args) <= 5:
            raise KnnError("knn takes 4 or 5 arguments")
        table, column = _text(args[0], "the table"), _text(args[1], "the column")
        if table not in tables.metrics:
            raise KnnError(f"{table!r} is not a vector table")
        k = re.fullmatch(r"(?i)\d+|:\w+|CAST\((:\w+) AS \w+\)", args[3])
        if not k:
            raise KnnError("k must be an integer literal or a parameter")
        where = _text(args[4], "the filter") if len(args) == 5 else None
        columns = spark.table(table).columns
        if column not in columns:
            raise KnnError(f"{table!r} has no column {column!r}")
        subquery = re.fullmatch(r"(?is)\(\s*((?:select|with)\b.*)\)", args[2])
        if subquery:
            vector = f"SELECT CAST(q_ AS ARRAY<DOUBLE>) AS q_ FROM ({subquery[1]}) AS t_(q_) WHERE q_ IS NOT NULL LIMIT 1"
        else:
            row = spark.sql(f"SELECT {array_literals(args[2])} AS q").first()
            if not isinstance(row["q"], list) or not row["q"] or not all(isinstance(x, (int, float)) or hasattr(x, "as_tuple") for x in row["q"]):
                raise KnnError("the vector must be an array of numbers")
            vector = f"SELECT CAST({args[2]} AS ARRAY<DOUBLE>) AS q_"
        relation, index = f"`{table}`", tables.indexes.get(table)
        if index and not subquery and not where and args[3].isdigit() and index.vector_col == column:
            cells = index.probed([float(x) for x in row["q"]], int(args[3]))
            relation = f"parquet.`{index.pattern(cells)}`" if cells else relation
        sql = sql[:start] + _derived(columns, relation, column, vector, k[1] or k[0], where, tables.metrics[table]) + sql[end:]
    return sql
