"""A context: named data sources, checked and registered as views."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from enum import StrEnum
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.dialect import hadoop_path
from tidewell.operators.knn import VectorTables
from tidewell.operators.vector_index import open_index


class Access(StrEnum):
    READ_ONLY = "read_only"
    READ_WRITE = "read_write"


class ContextError(ValueError):
    """A context that cannot be used as it is."""


FILES = ("csv", "parquet", "json", "ndjson")
DATABASES = ("postgres", "mysql", "jdbc", "mongo")
TYPES = (*FILES, *DATABASES, "iceberg", "lance", "vectors", "redis")
WRITABLE = ("postgres", "mysql", "jdbc", "mongo", "redis")


@dataclass
class Source:
    name: str
    type: str
    path: str | None = None
    connection_string: str | None = None
    schema: dict[str, str] | None = None
    options: dict[str, str] = field(default_factory=dict)
    access_mode: Access = Access.READ_ONLY
    enable_cache: bool = False


def parse(text: str) -> list[Source]:
    """Sources of a context YAML; unknown keys are passed over."""
    data = yaml.safe_load(text) or {}
    out = []
    for entry in data.get("data_sources") or []:
        if "name" not in entry or "type" not in entry:
            raise ContextError("a data source needs a name and a type")
        known = {k: entry[k] for k in ("name", "path", "connection_string", "schema") if entry.get(k) is not None}
        options = {str(k): str(v).lower() if isinstance(v, bool) else str(v) for k, v in (entry.get("options") or {}).items()}
        try:
            mode = Access(entry.get("access_mode", "read_only"))
        except ValueError:
            raise ContextError(f"{entry['name']}: unknown access mode {entry['access_mode']!r}") from None
        out.append(Source(type=str(entry["type"]).lower(), options=options, access_mode=mode, enable_cache=bool(entry.get("enable_cache")), **known))
    return out


def load(path: str) -> list[Source]:
    if not os.path.exists(path):
        raise ContextError(f"no context file {path}")
    return parse(Path(path).read_text())


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def check(sources: list[Source]) -> None:
    """Raise ContextError for duplicates, unknown types, missing paths or connections and modes that a type has not."""
    seen = set()
    for s in sources:
        if s.name in seen:
            raise ContextError(f"duplicate data source {s.name!r}")
        seen.add(s.name)
        if s.type not in TYPES:
            raise ContextError(f"{s.name}: unknown type {s.type!r}")
        if s.type in DATABASES or s.type == "redis":
            if not s.connection_string:
                raise ContextError(f"{s.name}: a connection_string is required")
            if s.type != "mongo" and "table" not in s.options and "dbtable" not in s.options:
                raise ContextError(f"{s.name}: option table is required")
        elif not s.path:
            raise ContextError(f"{s.name}: a path is required")
        elif not is_remote(s.path) and not os.path.exists(s.path.removeprefix("file://")):
            raise ContextError(f"{s.name}: no such file {s.path}")
        if s.access_mode is Access.READ_WRITE and s.type not in WRITABLE:
            raise ContextError(f"{s.name}: type {s.type} is read_only")
        if s.path and s.path.startswith(("s3://", "s3a://")):
            check_s3(s)


def check_s3(source: Source, env: dict[str, str] | None = None) -> dict[str, str]:
    """Settings of the S3 file system from the environment; credentials in options are refused."""
    env = dict(os.environ) if env is None else env
    if bad := [k for k in source.options if k.lower().startswith("aws_")]:
        raise ContextError(f"{source.name}: {', '.join(bad)} must come from the environment")
    region = env.get("AWS_REGION") or env.get("AWS_DEFAULT_REGION")
    if not region:
        raise ContextError(f"{source.name}: AWS_REGION or AWS_DEFAULT_REGION is required")
    settings = {"fs.s3a.endpoint.region": region}
    if env.get("AWS_ACCESS_KEY_ID") and env.get("AWS_SECRET_ACCESS_KEY"):
        settings |= {"fs.s3a.access.key": env["AWS_ACCESS_KEY_ID"], "fs.s3a.secret.key": env["AWS_SECRET_ACCESS_KEY"]}
    elif not env.get("AWS_PROFILE"):
        raise ContextError(f"{source.name}: access keys or AWS_PROFILE are required")
    if env.get("AWS_ENDPOINT_URL"):
        settings["fs.s3a.endpoint"] = env["AWS_ENDPOINT_URL"]
    return settings


def widened(schema: T.StructType) -> T.StructType:
    """Inferred integers as bigint."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, small) else f.dataType, f.nullable) for f in schema])


def read_csv(spark: SparkSession, path: str, options: dict[str, str] | None = None, schema: dict[str, str] | None = None) -> DataFrame:
    """Options has_header (true unless it reads 'false'), delimiter (its first character), schema_infer_max_records."""
    options = options or {}
    header = options.get("has_header", "true").strip().lower() != "false"
    settings = {"header": header, "sep": (options.get("delimiter") or ",")[0]}
    path = hadoop_path(path)
    if schema:
        ddl = ", ".join(f"`{k}` {_ddl(v)}" for k, v in schema.items())
        return spark.read.options(**settings).schema(ddl).csv(path)
    most = options.get("schema_infer_max_records")
    if most and most.isdigit():
        lines = spark.read.text(path).limit(int(most) + header)
        kinds = spark.read.options(inferSchema=True, **settings).csv(lines.rdd.map(lambda r: r[0])).schema
    else:
        kinds = spark.read.options(inferSchema=True, **settings).csv(path).schema
    return spark.read.options(**settings).schema(widened(kinds)).csv(path)


_DDL = {
    "int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint", "uint64": "decimal(20,0)", "uint32": "bigint",
    "float64": "double", "float32": "float", "utf8": "string", "string": "string", "str": "string", "bool": "boolean",
    "date32": "date", "timestamp": "timestamp_ntz",
}


def _ddl(kind: str) -> str:
    return _DDL.get(kind.lower(), kind)


def read(spark: SparkSession, s: Source) -> DataFrame:
    from tidewell.sources import docstore, iceberg, jdbc, kvstore

    if s.type == "csv":
        return read_csv(spark, s.path, s.options, s.schema)
    if s.type in ("parquet", "lance", "vectors"):
        return spark.read.parquet(hadoop_path(s.path))
    if s.type in ("json", "ndjson"):
        raw = spark.read.json(hadoop_path(s.path))
        return spark.read.schema(widened(raw.schema)).json(hadoop_path(s.path))
    if s.type == "iceberg":
        return iceberg.read(spark, s.path, s.options)
    if s.type == "mongo":
        return docstore.read(spark, s.connection_string, s.options)
    if s.type == "redis":
        return kvstore.read(spark, s.connection_string, s.options)
    return jdbc.read(spark, s.type, s.connection_string, s.options)


def read_path(spark: SparkSession, path: str, kind: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """A file named in SQL, by its kind or extension. A directory of Parquet can end in .lance."""
    plain, options = path.split("?")[0].rstrip("/").lower(), options or {}
    kind = (kind or "").lower() or next((k for k, ends in _EXTENSIONS.items() if plain.endswith(ends)), "parquet" if ".lance/" in path else "")
    if kind in ("csv", "tsv"):
        return read_csv(spark, path, ({"delimiter": "\t"} if kind == "tsv" else {}) | options)
    if kind in ("json", "ndjson"):
        return spark.read.json(hadoop_path(path))
    if kind in ("avro", "parquet"):
        return spark.read.format(kind).load(hadoop_path(path))
    raise ContextError(f"cannot tell the format of {path}")


_EXTENSIONS = {"csv": ".csv", "tsv": ".tsv", "json": (".json", ".ndjson", ".jsonl"), "avro": ".avro", "parquet": (".parquet", ".lance")}


def write_file(df: DataFrame, path: str, kind: str | None = None) -> int:
    """Write df as a folder of files in the format, or that of the path's extension; the number of rows. What is there is an error."""
    kind = (kind or "").lower() or next((k for k, ends in _EXTENSIONS.items() if path.lower().rstrip("/").endswith(ends)), "parquet")
    written = Observation()
    writer = df.observe(written, F.count(F.lit(1)).alias("n")).write.mode("errorifexists")
    at = hadoop_path(path)
    if kind in ("csv", "tsv"):
        writer.options(header=True, sep="\t" if kind == "tsv" else ",").csv(at)
    elif kind in ("json", "ndjson", "parquet", "avro"):
        writer.format({"ndjson": "json"}.get(kind, kind)).save(at)
    else:
        raise ContextError(f"cannot write the format {kind!r}")
    return written.get["n"]


def url_settings(url: str, env: dict[str, str]) -> dict[str, str]:
    """Settings of the file system of a URL in SQL, from the usual variables of the environment; none if they are unset."""
    scheme, account = url.partition("://")[0], env.get("AZURE_STORAGE_ACCOUNT_NAME")
    if scheme == "s3":
        names = {"AWS_ACCESS_KEY_ID": "access.key", "AWS_SECRET_ACCESS_KEY": "secret.key", "AWS_SESSION_TOKEN": "session.token", "AWS_ENDPOINT_URL": "endpoint", "AWS_REGION": "endpoint.region", "AWS_DEFAULT_REGION": "endpoint.region"}
        return {f"fs.s3a.{v}": env[k] for k, v in reversed(names.items()) if env.get(k)}
    if scheme in ("gs", "gcs") and env.get("GOOGLE_APPLICATION_CREDENTIALS"):
        return {"fs.gs.auth.type": "SERVICE_ACCOUNT_JSON_KEYFILE", "fs.gs.auth.service.account.json.keyfile": env["GOOGLE_APPLICATION_CREDENTIALS"]}
    if scheme in ("az", "azure", "abfs", "abfss") and account and env.get("AZURE_STORAGE_ACCOUNT_KEY"):
        return {f"fs.azure.account.key.{account}.dfs.core.windows.net": env["AZURE_STORAGE_ACCOUNT_KEY"]}
    if scheme in ("oss", "cos"):
        names = {"ACCESS_KEY_ID": "accessKeyId", "ACCESS_KEY_SECRET": "accessKeySecret", "ENDPOINT": "endpoint"}
        begin = {"oss": ("OSS_", "fs.oss."), "cos": ("COS_", "fs.cosn.userinfo.")}[scheme]
        return {begin[1] + v: env[begin[0] + k] for k, v in names.items() if env.get(begin[0] + k)}
    return {}


def settings_of_urls(spark: SparkSession, urls: list[str]) -> None:
    """Give Hadoop what the environment has for the stores that a text names."""
    for url in urls:
        for k, v in url_settings(url, dict(os.environ)).items():
            spark.sparkContext._jsc.hadoopConfiguration().set(k, v)


def check_reachable(spark: SparkSession, path: str) -> None:
    """Raise ContextError unless the file system of a remote path answers that the path is there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(hadoop_path(path))
    try:
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    except Exception as e:
        raise ContextError(f"cannot reach {path}: {str(e).splitlines()[0]}") from e
    if not there:
        raise ContextError(f"nothing at {path}")


def copied(spark: SparkSession, s: Source) -> bool:
    """Whether the view of a source is a copy that shows no later change: its database is embedded in another JVM than the executors'."""
    from tidewell.sources import jdbc

    return s.type in ("postgres", "mysql", "jdbc") and jdbc.held_by_driver(spark, jdbc.jdbc_url(s.type, s.connection_string, s.options)[0])


def register(spark: SparkSession, sources: list[Source], vectors: VectorTables | None = None) -> dict[str, str]:
    """Register every source as a view of its name; table -> access mode. Vector tables become searchable."""
    check(sources)
    for s in sources:
        if s.path and s.path.startswith(("s3://", "s3a://")):
            hadoop = spark.sparkContext._jsc.hadoopConfiguration()
            for k, v in check_s3(s).items():
                hadoop.set(k, v)
            check_reachable(spark, s.path)
        df = read(spark, s)
        if s.enable_cache and s.type in ("csv", "parquet", "iceberg"):
            df = df.cache()
            df.count()
        df.createOrReplaceTempView(s.name)
        if vectors is not None and s.type in ("lance", "vectors"):
            index = open_index(spark, s.options["index"]) if "index" in s.options else None
            vectors.register(s.name, s.options.get("metric", "l2"), index)
    return {s.name.lower(): str(s.access_mode) for s in sources}
