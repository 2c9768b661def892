"""Pipelines: a YAML with metadata and one parameterised query, checked, typed and run."""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewell.functions.dialect import path_tables, remote_urls, translate
from tidewell.functions.models import register_onnx
from tidewell.operators.knn import VectorTables, rewrite
from tidewell.plans import guard, params
from tidewell.plans.analysis import typed
from tidewell.plans.text import parts
from tidewell.sources import context, docstore, jdbc, kvstore


class PipelineError(ValueError):
    """A pipeline that cannot be loaded."""


class RequestError(ValueError):
    """A request whose parameters do not fit; details says how."""

    def __init__(self, message: str, details: dict):
        super().__init__(message)
        self.details = details


@dataclass
class Metadata:
    name: str
    version: str
    description: str | None = None
    created_at: str | None = None
    updated_at: str | None = None


class _Loader(yaml.SafeLoader):
    """Tags such as !Metadata and !Query mark plain mappings and texts."""


def _tagged(loader: _Loader, suffix: str, node: yaml.Node):
    return loader.construct_mapping(node, deep=True) if isinstance(node, yaml.MappingNode) else loader.construct_scalar(node)


_Loader.add_multi_constructor("!", _tagged)


@dataclass
class Pipeline:
    metadata: Metadata
    query: str
    request: list[params.Parameter] = field(default_factory=list)
    response: T.StructType | None = None

    @classmethod
    def parse(cls, text: str) -> Pipeline:
        data = yaml.load(text, Loader=_Loader) or {}
        meta, query = data.get("metadata") or {}, data.get("query")
        if "name" not in meta or "version" not in meta:
            raise PipelineError("metadata needs a name and a version")
        if not isinstance(query, str) or not query.strip():
            raise PipelineError("a pipeline needs a query")
        known = {k: str(meta[k]) for k in ("name", "version", "description", "created_at", "updated_at") if meta.get(k) is not None}
        return cls(Metadata(**known), query)

    def to_yaml(self) -> str:
        meta = {k: v for k, v in vars(self.metadata).items() if v is not None}
        return yaml.safe_dump({"metadata": meta, "query": self.query}, sort_keys=False)


def load_all(path: str) -> list[Pipeline]:
    """The pipeline of a file, or those of a folder's .yaml and .yml files by name. Names must differ."""
    at = Path(path)
    if not at.exists():
        raise PipelineError(f"no such file or folder: {path}")
    files = sorted(p for p in at.iterdir() if p.suffix in (".yaml", ".yml")) if at.is_dir() else [at]
    if not files:
        raise PipelineError(f"no pipeline in {path}")
    found = [Pipeline.parse(f.read_text()) for f in files]
    names = [p.metadata.name for p in found]
    if len(set(names)) < len(names):
        raise PipelineError(f"duplicate pipeline names: {sorted({n for n in names if names.count(n) > 1})}")
    return found


_INSERT = re.compile(r"(?is)^\s*insert\s+(into|overwrite)\s+(?:table\s+)?([\w.`\"]+)\s*(\([^()]*\))?\s*(.*)$")
_COPY = re.compile(r"(?is)^\s*copy\s+(.+?)\s+to\s+'([^']+)'\s*(?:stored\s+as\s+(\w+)|\(\s*format\s+'?(\w+)'?\s*\))?\s*;?\s*$")
_CREATED = re.compile(r"(?is)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view)\s+([\w\"`]+)\s+as\s+(.*)$")
_EXTERNAL = re.compile(r"(?is)^\s*create\s+external\s+table\s+([\w\"`]+)\s+stored\s+as\s+(\w+)(.*?)\blocation\s+'([^']+)'(.*)$")
_OPTION = re.compile(r"(?i)'?([\w.]+)'?\s+'?([^',()]+)'?")


class Engine:
    """A session with a context's tables, vector tables and model functions, running SQL in the users' dialect."""

    def __init__(self, spark: SparkSession, sources: list[context.Source] | None = None):
        self.spark, self.vectors = spark, VectorTables()
        self.sources = list(sources or [])
        self.access = context.register(spark, self.sources, self.vectors)
        register_onnx(spark)

    def _with_paths(self, sql: str) -> tuple[str, list[str]]:
        """sql with its quoted paths as views, and these views, which go once the query has been analysed."""
        context.settings_of_urls(self.spark, remote_urls(sql))
        views = []
        for start, end, path in reversed(path_tables(sql)):
            df = context.read_path(self.spark, path)
            views.append(f"path_{uuid.uuid4().hex}")
            df.createOrReplaceTempView(views[-1])
            if path.rstrip("/").endswith(".lance"):
                stem = Path(path.rstrip("/")).stem
                df.createOrReplaceTempView(stem)
                self.vectors.register(stem)
            sql = sql[:start] + views[-1] + sql[end:]
        return sql, views

    def sql(self, sql: str, values: dict | None = None, types: dict[str, T.DataType] | None = None) -> DataFrame:
        """A query, a write or a definition. values binds {name} parameters; a write returns one row, count."""
        values = values or {}
        if types is None:
            types = {p.name: p.type for p in params.infer(self.spark, sql)}
        plain = "".join(t for k, t in parts(sql) if k != "comment")
        if m := _COPY.match(plain):
            query = m[1].strip()
            rows = self.sql(query[1:-1] if query.startswith("(") else f"SELECT * FROM {query}", values, types)
            return self._count(context.write_file(rows, m[2], m[3] or m[4]))
        if m := _EXTERNAL.match(plain):
            options = {k.split(".")[-1].lower(): v for k, v in _OPTION.findall(re.sub(r"(?i)\boptions\b|with\s+header\s+row", "", m[3] + m[5]))}
            context.read_path(self.spark, m[4], m[2], options).createOrReplaceTempView(m[1].strip('"`'))
            return self._count(0)
        if m := _CREATED.match(plain):
            rows = self.sql(m[2], values, types).cache()
            rows.createOrReplaceTempView(m[1].strip('"`'))
            return self._count(rows.count())
        write = guard.target(sql)
        if write and write[0] in ("insert", "update", "delete") and self._source(write[1]):
            return self._write(sql, *write, values, types)
        self._renew(plain)
        text, views = self._with_paths(params.marked(sql, types, values))
        try:
            text = translate(rewrite(self.spark, text, self.vectors))
            return typed(self.spark, text, {k: v for k, v in values.items() if f":{k}" in text})
        finally:
            for view in views:
                self.spark.catalog.dropTempView(view)

    def _count(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "count long")

    def _renew(self, sql: str) -> None:
        """Read anew what a query names and views only hold copies of; names in other places do no harm."""
        for s in self.sources:
            if re.search(rf"(?i)(?<!\w){re.escape(s.name)}(?!\w)", sql) and context.copied(self.spark, s):
                context.read(self.spark, s).createOrReplaceTempView(s.name)

    def _source(self, name: str) -> context.Source | None:
        return next((s for s in self.sources if s.name.lower() == name and s.type in context.WRITABLE), None)

    def _write(self, sql: str, verb: str, name: str, values: dict, types: dict) -> DataFrame:
        source = self._source(name)
        if verb == "insert":
            m = _INSERT.match("".join(t for k, t in parts(sql) if k != "comment"))
            overwrite = m[1].lower() == "overwrite"
            rows = self.sql(m[4], values, {**types})
            columns = [c.strip().strip('"`') for c in m[3][1:-1].split(",")] if m[3] else None
            if columns:
                rows = rows.toDF(*columns)
            o = source.options
            if source.type == "mongo":
                if overwrite:
                    raise docstore.DocumentError("INSERT OVERWRITE is not supported for document collections")
                count = docstore.upsert(rows, source.connection_string, o.get("collection") or o["table"], o["primary_key"])
            elif source.type == "redis":
                count = kvstore.write(rows, source.connection_string, o["table"], o.get("key_column"), o.get("key_space"), overwrite)
            else:
                count = self._database(source).insert(jdbc.table_of(o, source.type), rows, overwrite)
        elif source.type in ("mongo", "redis"):
            raise docstore.DocumentError(f"{verb.upper()} is not supported for documents and hashes; insert replaces by key")
        else:
            text, bound = jdbc.positional(params.marked(sql), values)
            text = re.sub(rf"(?is)^(\s*(?:update|delete\s+from)\s+)[\w.`\"]+", lambda m: m[1] + jdbc.table_of(source.options, source.type), text)
            count = self._database(source).execute(text, bound)
        return self._count(count)

    def _database(self, source: context.Source) -> jdbc.Database:
        url, props = jdbc.jdbc_url(source.type, source.connection_string, source.options)
        return jdbc.Database(self.spark, url, props, source.type)

    def prepare(self, pipeline: Pipeline) -> Pipeline:
        """Check a pipeline against the guard and infer its request and response."""
        guard.check(self.spark, pipeline.query, self.access)
        if bad := params.misplaced(pipeline.query):
            raise PipelineError(f"{pipeline.metadata.name}: parameters inside a literal: {', '.join(bad)}")
        pipeline.request = params.infer(self.spark, pipeline.query)
        write = guard.target(pipeline.query)
        if write:
            pipeline.response = T.StructType([T.StructField("count", T.LongType(), False)])
        else:
            nothing = {p.name: 1 if p.column == params.NEIGHBOURS else None for p in pipeline.request}
            pipeline.response = self.sql(pipeline.query, nothing, {p.name: p.type for p in pipeline.request}).schema
        return pipeline

    def execute(self, pipeline: Pipeline, request: dict) -> DataFrame:
        """Run a prepared pipeline. Every parameter must be given, null if need be; others are passed over."""
        expected = [p.name for p in pipeline.request]
        missing = [n for n in expected if n not in request]
        unsupported = [n for n in expected if isinstance(request.get(n), (list, dict))]
        details = {"expected_parameters": expected, "received_parameters": list(request), "missing_parameters": missing, "unsupported_parameters": unsupported}
        if missing:
            raise RequestError(f"missing parameters: {', '.join(missing)}", details)
        if unsupported:
            raise RequestError(f"parameters must be text, number, truth value or null: {', '.join(unsupported)}", details)
        return self.sql(pipeline.query, {n: request[n] for n in expected}, {p.name: p.type for p in pipeline.request})


def rows_to_json(df: DataFrame) -> list[dict]:
    """The rows as JSON objects, nulls spelled out."""
    return [json.loads(r) for r in (x[0] for x in df.selectExpr("to_json(struct(*), map('ignoreNullFields', 'false'))").collect())] if df.columns else []


def now() -> str:
    return datetime.now(UTC).isoformat()


def success(df: DataFrame, started: float) -> dict:
    data = rows_to_json(df)
    return {"success": True, "data": data, "rows": len(data), "execution_time_ms": int((time.time() - started) * 1000), "timestamp": now()}


def failure(kind: str, message: str, details: dict | None = None) -> dict:
    return {"success": False, "error": {"type": kind, "message": message, "details": details}, "timestamp": now()}
