"""A table in Iceberg's format, version 1: data files, Avro manifests and metadata, written without its runtime.

One append of a DataFrame to a local or shared folder, for tests and small exports. The Avro container is written here: a
header with the schema, and one uncompressed block.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_KINDS = {"bigint": "long", "int": "int", "smallint": "int", "tinyint": "int", "string": "string", "double": "double", "float": "float", "boolean": "boolean", "date": "date", "timestamp_ntz": "timestamp", "binary": "binary"}

_DATA_FILE = {"type": "record", "name": "r2", "fields": [
    {"name": "file_path", "type": "string", "field-id": 100}, {"name": "file_format", "type": "string", "field-id": 101},
    {"name": "record_count", "type": "long", "field-id": 103}, {"name": "file_size_in_bytes", "type": "long", "field-id": 104},
]}
_ENTRY = {"type": "record", "name": "manifest_entry", "fields": [
    {"name": "status", "type": "int", "field-id": 0}, {"name": "snapshot_id", "type": "long", "field-id": 1}, {"name": "data_file", "type": _DATA_FILE, "field-id": 2},
]}
_LIST = {"type": "record", "name": "manifest_file", "fields": [
    {"name": "manifest_path", "type": "string", "field-id": 500}, {"name": "manifest_length", "type": "long", "field-id": 501},
    {"name": "partition_spec_id", "type": "int", "field-id": 502}, {"name": "added_snapshot_id", "type": "long", "field-id": 503},
]}


def _long(n: int) -> bytes:
    n, out = n << 1 ^ n >> 63, b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _encoded(value, kind) -> bytes:
    if isinstance(kind, dict):
        return b"".join(_encoded(value[f["name"]], f["type"]) for f in kind["fields"])
    if kind in ("int", "long"):
        return _long(value)
    raw = value.encode()
    return _long(len(raw)) + raw


def _avro(schema: dict, rows: list[dict]) -> bytes:
    sync = uuid.uuid4().bytes
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": b"null"}
    head = b"Obj\x01" + _long(len(meta)) + b"".join(_long(len(k)) + k.encode() + _long(len(v)) + v for k, v in meta.items()) + _long(0) + sync
    body = b"".join(_encoded(r, schema) for r in rows)
    return head + _long(len(rows)) + _long(len(body)) + body + sync


def write(df: DataFrame, table: str, renamed: dict[str, str] | None = None, version: int = 1) -> None:
    """Write df as the only snapshot of a table. renamed gives columns another name in the metadata than in the files."""
    folder = table.removeprefix("file://")
    fields = [T.StructField(f.name, f.dataType, True, {"parquet.field.id": i}) for i, f in enumerate(df.schema, 1)]
    spark = df.sparkSession
    spark.conf.set("spark.sql.parquet.fieldId.write.enabled", "true")
    df.select([df[f.name].alias(f.name, metadata=f.metadata) for f in fields]).write.parquet(f"{table}/data")
    os.makedirs(f"{folder}/metadata", exist_ok=True)
    names = sorted(n for n in os.listdir(f"{folder}/data") if n.endswith(".parquet"))
    files = [{"file_path": f"{folder}/data/{n}", "file_format": "PARQUET", "record_count": 0, "file_size_in_bytes": os.path.getsize(f"{folder}/data/{n}")} for n in names]
    manifest, listing = (f"{folder}/metadata/{uuid.uuid4()}-m0.avro", f"{folder}/metadata/snap-1-{uuid.uuid4()}.avro")
    for path, schema, rows in (
        (manifest, _ENTRY, [{"status": 1, "snapshot_id": 1, "data_file": f} for f in files]),
        (listing, _LIST, [{"manifest_path": manifest, "manifest_length": 0, "partition_spec_id": 0, "added_snapshot_id": 1}]),
    ):
        with open(path, "wb") as out:
            out.write(_avro(schema, rows))
    columns = [{"id": f.metadata["parquet.field.id"], "name": (renamed or {}).get(f.name, f.name), "required": False, "type": _KINDS[f.dataType.simpleString()]} for f in fields]
    metadata = {
        "format-version": 1, "table-uuid": str(uuid.uuid4()), "location": table, "schema": {"type": "struct", "fields": columns}, "partition-spec": [],
        "current-snapshot-id": 1, "snapshots": [{"snapshot-id": 1, "manifest-list": listing}],
    }
    with open(f"{folder}/metadata/v{version}.metadata.json", "w") as out:
        json.dump(metadata, out)
