"""Document collections: schema inference, scans with point lookups by key, and upserts.

A collection is a folder of documents, one JSON object for each, in a file named by its key: a backend that
needs no server. A backend class with the same methods reaches another store.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from decimal import Decimal
from pathlib import Path
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition


class DocumentError(ValueError):
    """A document or collection that cannot be read or written as asked."""


_KINDS = {
    "string": T.StringType(), "objectId": T.StringType(), "date": T.StringType(), "null": T.StringType(), "int": T.IntegerType(),
    "long": T.LongType(), "double": T.DoubleType(), "decimal": T.DoubleType(), "number": T.DoubleType(), "bool": T.BooleanType(), "boolean": T.BooleanType(),
}


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def uri(connection: str, user: str | None = None, password: str | None = None) -> str:
    """A connection string with encoded credentials; port 27017 unless the scheme looks its hosts up."""
    u = urlsplit(connection)
    host = u.netloc.rsplit("@", 1)[-1]
    if u.scheme == "mongodb" and ":" not in host.split(",")[-1]:
        host += ":27017"
    auth = f"{quote(user, safe='')}:{quote(password or '', safe='')}@" if user else ""
    return f"{u.scheme}://{auth}{host}{u.path}" + (f"?{u.query}" if u.query else "")


class FolderStore:
    """Documents in <root>/<collection>/<key>.json; the validator, if any, in <root>/<collection>.schema.json."""

    def __init__(self, root: str):
        self.root = Path(root.removeprefix("file://"))

    def _file(self, collection: str, key: str) -> Path:
        return self.root / collection / f"{quote(key, safe='')}.json"

    def validator(self, collection: str) -> dict | None:
        path = self.root / f"{collection}.schema.json"
        return json.loads(path.read_text()) if path.exists() else None

    def keys(self, collection: str) -> list[str]:
        folder = self.root / collection
        return sorted(p.name for p in folder.glob("*.json")) if folder.is_dir() else []

    def read(self, collection: str, names: list[str]) -> Iterator[dict]:
        for name in names:
            yield json.loads((self.root / collection / name).read_text())

    def find(self, collection: str, key: str) -> dict | None:
        path = self._file(collection, key)
        return json.loads(path.read_text()) if path.exists() else None

    def replace(self, collection: str, key: str, document: dict) -> None:
        """Write the document whole, whether it was there or not."""
        path = self._file(collection, key)
        path.parent.mkdir(parents=True, exist_ok=True)
        new = path.with_suffix(f".{os.getpid()}.new")
        new.write_text(json.dumps(document, default=lambda v: float(v) if isinstance(v, Decimal) else str(v)))
        new.replace(path)


def infer(store: FolderStore, collection: str, key: str) -> T.StructType:
    """The key first, as a string; then the validator's properties, or those of one document; `_id` hidden."""
    validator = store.validator(collection)
    if validator:
        schema = validator.get("$jsonSchema", validator)
        fields = []
        for name, spec in schema.get("properties", {}).items():
            kind = spec.get("bsonType") or spec.get("type")
            kind = next((k for k in kind if k != "null"), "null") if isinstance(kind, list) else kind
            # a document older than the validator can lack what is required, and Spark trusts a schema
            fields.append(T.StructField(name, _KINDS.get(kind, T.StringType())))
    else:
        one = next(store.read(collection, store.keys(collection)[:1]), None)
        if one is None:
            raise DocumentError(f"collection {collection!r} has neither a validator nor a document")
        guess = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}
        fields = [T.StructField(n, guess.get(type(v), T.StringType())) for n, v in one.items()]
    others = [f for f in fields if f.name not in (key, "_id")]
    return T.StructType([T.StructField(key, T.StringType(), False), *others])


def coerced(value, kind: T.DataType, present: bool = True):
    """A stored value as a column's: a null in a string column is empty, a wrong type is null, integers wrap, doubles are cut."""
    if isinstance(kind, T.StringType):
        if value is None:
            return "" if present else None
        return value if isinstance(value, str) else json.dumps(value) if isinstance(value, (dict, list)) else str(value)
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    if isinstance(kind, (T.IntegerType, T.LongType)):
        bits = 32 if isinstance(kind, T.IntegerType) else 64
        return (int(value) + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)
    return float(value)


class _Slice(InputPartition):
    def __init__(self, names: list[str] | None, key: str | None = None):
        super().__init__(names)
        self.names, self.key = names, key


class _Reader(DataSourceReader):
    SLICE = 1000

    def __init__(self, root: str, collection: str, key: str, schema: T.StructType):
        self.root, self.collection, self.key, self.schema, self.point = root, collection, key, schema, None

    def partitions(self) -> list[InputPartition]:
        if self.point is not None:
            return [_Slice(None, self.point)]
        names = FolderStore(self.root).keys(self.collection)
        return [_Slice(names[i : i + self.SLICE]) for i in range(0, max(1, len(names)), self.SLICE)]

    def read(self, partition: _Slice):
        store = FolderStore(self.root)
        if partition.names is None:
            one = store.find(self.collection, partition.key)
            documents = iter([one] if one is not None else [])
        else:
            documents = store.read(self.collection, partition.names)
        for d in documents:
            key = d.get("_id", d.get(self.key))
            yield tuple(str(key) if f.name == self.key else coerced(d.get(f.name), f.dataType, f.name in d) for f in self.schema)


class _PointReader(_Reader):
    """Finds one document by its key. Spark refuses a reader that takes filters in a session that pushes none."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (self.key,) and self.point is None:
                self.point = str(f.value)
            else:
                yield f


class DocumentSource(DataSource):
    """spark.read.format("documents") with options root, collection, primary_key, and pushdown if the session pushes filters."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> T.StructType:
        return infer(FolderStore(self.options["root"]), self.options["collection"], self.options["primary_key"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kind = _PointReader if self.options.get("pushdown") == "true" else _Reader
        return kind(self.options["root"], self.options["collection"], self.options["primary_key"], schema)


def read(spark: SparkSession, connection: str, options: dict[str, str]) -> DataFrame:
    """Options collection (or table) and primary_key are required.

    In a session that leaves open whether filters go to Python sources they do from now on, so that a key is looked up.
    """
    collection, key = options.get("collection") or options.get("table"), options.get("primary_key")
    if not collection or not key:
        raise DocumentError("options collection and primary_key are required")
    if spark.conf.get(PUSHDOWN, None) is None:
        spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(DocumentSource)
    return spark.read.format("documents").options(root=connection, collection=collection, primary_key=key, pushdown=spark.conf.get(PUSHDOWN)).load()


def upsert(df: DataFrame, root: str, collection: str, key: str) -> int:
    """Write every row as the document of its key, null columns left out; the number of rows. A null key is an error."""
    if key not in df.columns:
        raise DocumentError(f"no column {key!r}")

    def write(batches):
        import pyarrow as pa

        store, n = FolderStore(root), 0
        for batch in batches:
            for row in batch.to_pylist():
                if row[key] is None:
                    raise DocumentError(f"a row without {key!r}")
                store.replace(collection, str(row[key]), {"_id": str(row[key])} | {k: v for k, v in row.items() if v is not None})
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return df.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
