"""Iceberg tables from their metadata files: which version is current, and the data files of its snapshot.

With the Iceberg runtime on the class path the table is read through it; without, manifests are read by the
Avro library that Spark ships, and the data files as Parquet. Snapshots with delete files are refused.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class IcebergError(ValueError):
    """A table whose metadata cannot be resolved or read."""


_VERSION = re.compile(r"v(\d+)\.metadata\.json")
_SEQUENCED = re.compile(r"(\d+)-([0-9a-fA-F-]{36})\.metadata\.json")


def metadata_file(table: str) -> str:
    """The current metadata: by version-hint.text (1 if it cannot be read as a number), else the highest
    v{n}.metadata.json, else the highest {sequence}-{uuid}.metadata.json."""
    folder = os.path.join(table.removeprefix("file://"), "metadata")
    if not os.path.isdir(folder):
        raise IcebergError(f"no metadata folder in {table}")
    hint = os.path.join(folder, "version-hint.text")
    if os.path.exists(hint):
        with open(hint) as f:
            text = f.read().strip()
        path = os.path.join(folder, f"v{int(text) if text.isdigit() else 1}.metadata.json")
        if os.path.exists(path):
            return path
    versions = [(int(m[1]), name) for name in os.listdir(folder) if (m := _VERSION.fullmatch(name))]
    if versions:
        return os.path.join(folder, max(versions)[1])
    found = [(int(m[1]), name) for name in os.listdir(folder) if (m := _SEQUENCED.fullmatch(name))]
    if not found:
        raise IcebergError(f"no metadata file in {folder}")
    return os.path.join(folder, max(found)[1])


def table_path(warehouse: str, options: dict[str, str]) -> str:
    if "namespace" not in options or "table" not in options:
        raise IcebergError("options namespace and table are required")
    return os.path.join(warehouse, *options["namespace"].split("."), options["table"])


def _avro(spark: SparkSession, path: str) -> list[dict]:
    jvm = spark.sparkContext._jvm
    file = jvm.java.io.File(path.removeprefix("file://"))
    reader = jvm.org.apache.avro.file.DataFileReader(file, jvm.org.apache.avro.generic.GenericDatumReader())
    rows = []
    while reader.hasNext():
        rows.append(json.loads(reader.next().toString()))
    reader.close()
    return rows


def data_files(spark: SparkSession, metadata: dict, snapshot_id: int | None = None) -> list[str]:
    wanted = snapshot_id if snapshot_id is not None else metadata.get("current-snapshot-id", -1)
    snapshot = next((s for s in metadata.get("snapshots", []) if s["snapshot-id"] == wanted), None)
    if snapshot is None:
        return []
    files = []
    for manifest in _avro(spark, snapshot["manifest-list"]):
        if manifest.get("content", 0):
            raise IcebergError("the snapshot has delete files; reading it needs the Iceberg runtime")
        for entry in _avro(spark, manifest["manifest_path"]):
            if entry["status"] != 2:
                files.append(entry["data_file"]["file_path"])
    return files


_KINDS = {"boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "date": "date", "string": "string", "uuid": "string",
          "binary": "binary", "timestamp": "timestamp_ntz", "timestamptz": "timestamp"}


def _kind(of: str | dict) -> T.DataType:
    if isinstance(of, str):
        return T.BinaryType() if of.startswith("fixed") else T.DataType.fromDDL(_KINDS.get(of, of.replace(" ", "")))
    if of["type"] == "list":
        return T.ArrayType(_kind(of["element"]))
    if of["type"] == "map":
        return T.MapType(_kind(of["key"]), _kind(of["value"]))
    return _fields(of["fields"])


def _fields(fields: list[dict]) -> T.StructType:
    return T.StructType([T.StructField(f["name"], _kind(f["type"]), True, {"parquet.field.id": f["id"]}) for f in fields])


def schema_of(metadata: dict) -> T.StructType:
    """The current schema; data files are matched by field ids, so that renamed and added columns are right."""
    if "schemas" in metadata:
        return _fields(next(s for s in metadata["schemas"] if s["schema-id"] == metadata.get("current-schema-id", 0))["fields"])
    return _fields(metadata["schema"]["fields"])


def read(spark: SparkSession, warehouse: str, options: dict[str, str]) -> DataFrame:
    path = table_path(warehouse, options)
    snapshot = int(options["snapshot_id"]) if "snapshot_id" in options else None
    try:
        spark.sparkContext._jvm.java.lang.Class.forName("org.apache.iceberg.spark.source.IcebergSource")
    except Exception:
        with open(metadata_file(path)) as f:
            metadata = json.load(f)
        files = data_files(spark, metadata, snapshot)
        if not files:
            raise IcebergError(f"{path} has no snapshot to read") from None
        spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
        return spark.read.schema(schema_of(metadata)).parquet(*files)
    reader = spark.read.format("iceberg")
    return (reader.option("snapshot-id", snapshot) if snapshot is not None else reader).load(path)
