"""Tables of hashes in a key-value store: `{key_space}:{table}:{id}` -> field -> text.

The backend is a folder of JSON files, one for each hash; a class with the same methods reaches another store.
"""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class KeyValueError(ValueError):
    """A table that cannot be read as it is."""


class FolderHashes:
    def __init__(self, root: str):
        self.root = Path(root.removeprefix("file://"))

    def scan(self, prefix: str) -> list[str]:
        found = (unquote(p.name.removesuffix(".json")) for p in self.root.glob("*.json")) if self.root.is_dir() else ()
        return sorted(k for k in found if k.startswith(prefix))

    def get(self, key: str) -> dict[str, str]:
        return json.loads((self.root / f"{quote(key, safe='')}.json").read_text())

    def put(self, key: str, fields: dict[str, str]) -> None:
        self.root.mkdir(parents=True, exist_ok=True)
        path = self.root / f"{quote(key, safe='')}.json"
        new = path.with_suffix(f".{os.getpid()}.new")
        new.write_text(json.dumps(fields))
        new.replace(path)

    def delete(self, keys: list[str]) -> None:
        for key in keys:
            (self.root / f"{quote(key, safe='')}.json").unlink(missing_ok=True)


def prefix(table: str, key_space: str | None = None) -> str:
    return f"{key_space}:{table}:" if key_space else f"{table}:"


def schema_key(table: str) -> str:
    return f"_spark:{table}:schema"


def data_key(table: str, id_: str) -> str:
    return f"{table}:{id_}"


def id_of(key: str, table: str, key_space: str | None = None) -> str:
    return key.removeprefix(prefix(table, key_space))


def infer(store: FolderHashes, table: str, key_column: str, key_space: str | None = None) -> T.StructType:
    """The key column, then the fields of the first hash by name, all strings. Without a hash there is no schema."""
    keys = store.scan(prefix(table, key_space))
    if not keys:
        raise KeyValueError(f"no data for table {table!r}")
    names = sorted(f for f in store.get(keys[0]) if f != key_column)
    return T.StructType([T.StructField(n, T.StringType()) for n in (key_column, *names)])


class _Reader(DataSourceReader):
    SLICE = 1000

    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        keys = FolderHashes(self.options["root"]).scan(prefix(self.options["table"], self.options.get("key_space")))
        return [InputPartition(keys[i : i + self.SLICE]) for i in range(0, max(1, len(keys)), self.SLICE)]

    def read(self, partition: InputPartition):
        store, o = FolderHashes(self.options["root"]), self.options
        for key in partition.value:
            fields = store.get(key) | {o["key_column"]: id_of(key, o["table"], o.get("key_space"))}
            yield tuple(fields.get(f.name, "") for f in self.schema)


class HashSource(DataSource):
    """spark.read.format("hashes") with options root, table, key_column, key_space."""

    @classmethod
    def name(cls) -> str:
        return "hashes"

    def schema(self) -> T.StructType:
        o = self.options
        return infer(FolderHashes(o["root"]), o["table"], o["key_column"], o.get("key_space"))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def read(spark: SparkSession, connection: str, options: dict[str, str]) -> DataFrame:
    spark.dataSource.register(HashSource)
    o = {"key_column": "id"} | options
    return spark.read.format("hashes").options(root=connection, **{k: o[k] for k in ("table", "key_column", "key_space") if k in o}).load()


_IDS = uuid.UUID("6f1b7d0e-5d0a-4c59-9f0e-0f3f6f1f2a10")


def text_of(value) -> str:
    """A value as stored: null is empty, binary is lower-case hex, truth values are lower case."""
    if value is None:
        return ""
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value).lower() if isinstance(value, bool) else str(value)


def write(df: DataFrame, root: str, table: str, key_column: str | None = None, key_space: str | None = None, overwrite: bool = False) -> int:
    """One hash for each row; the key column names it and is not a field, without one it is a UUID. Overwrite deletes first.

    UUIDs are of the run, the partition and the place in it, so that a task that runs again writes its rows once.
    """
    if not key_column:
        df = df.withColumn("__row", F.concat(F.lit(str(uuid.uuid4())), F.lit(":"), F.monotonically_increasing_id()))
    if overwrite:
        store = FolderHashes(root)
        store.delete(store.scan(prefix(table, key_space)))

    def put(batches):
        import pyarrow as pa

        store, n = FolderHashes(root), 0
        for batch in batches:
            for row in batch.to_pylist():
                id_ = text_of(row[key_column]) if key_column else str(uuid.uuid5(_IDS, row.pop("__row")))
                store.put(prefix(table, key_space) + id_, {k: text_of(v) for k, v in row.items() if k != key_column})
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return df.mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0
