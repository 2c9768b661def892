"""A coarse index of vectors: rows in the cells of their nearest centroids, of which a search reads a few.

The centroids come from a bounded sample; every row is indexed. A search takes the exact distances of knn() in
the cells that are nearest to the query, so what it finds is right, and what it misses lies in cells that it
did not read. With probes = all cells it equals knn() on the whole table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidewell.operators.knn import KnnError, knn

#: The most vectors that centroids are learned from: the driver holds these.
TRAIN_VECTORS = 32_768

#: The most cells unless others are asked for: every worker holds their centroids.
MOST_CELLS = 2048

#: A search reads as many cells as hold this share of the nearest vectors of the sample, for so many queries of it.
RECALL, QUERIES, NEIGHBOURS = 0.95, 256, 10

_CELL, _SALT, _NO_CELL, _ROUNDS, _BLOCK = "__cell", "__salt", -1, 10, 4096


def _matrix(vectors: pa.Array, dim: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a place in a cell, their vectors): dim finite components; for cosine not all zero, and scaled to 1."""
    sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, int)
    fits = (sizes == dim) & ~np.asarray(vectors.is_null())
    if not fits.any():
        return fits, np.zeros((0, dim), np.float32)
    of = vectors.filter(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    norms = np.linalg.norm(of, axis=1)
    good = np.isfinite(norms) & ((norms > 0) if metric == "cosine" else True)
    fits[np.nonzero(fits)[0][~good]] = False
    of = of[good]
    return fits, (of / norms[good, None] if metric == "cosine" else of).astype(np.float32)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(axis=1) / 2
    parts = [np.argmax(x[i : i + _BLOCK] @ centroids.T - half, axis=1) for i in range(0, len(x), _BLOCK)]
    return np.concatenate(parts) if parts else np.zeros(0, int)


def centroids_of(x: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """At most cells centroids of the vectors x, by rounds of k-means; no two start from equal vectors."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:cells]]
    for _ in range(_ROUNDS):
        of = _nearest(x, c)
        n = np.bincount(of, minlength=len(c))
        order = np.argsort(of, kind="stable")
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        full = n > 0
        sums = np.add.reduceat(x[order].astype(np.float64), starts[full], axis=0)
        c = c.copy()
        c[full] = (sums / n[full, None]).astype(np.float32)
    return c


def probes_for(x: np.ndarray, centroids: np.ndarray, recall: float, seed: int) -> int:
    """The fewest cells that hold the share recall of the nearest other vectors of the vectors x, by brute force over x.

    In the whole table the nearest vectors are nearer than those of the sample, so they share cells more often.
    """
    drawn = np.random.default_rng(seed + 1).permutation(len(x))[:QUERIES]
    near = min(NEIGHBOURS, len(x) - 1)
    if near < 1:
        return 1
    of, half, ranks = _nearest(x, centroids), (x.astype(np.float64) ** 2).sum(axis=1) / 2, []
    for i in drawn:
        far = half - x @ x[i]
        far[i] = np.inf
        cells = np.argsort(((centroids - x[i]) ** 2).sum(axis=1), kind="stable")
        rank = np.empty(len(cells), int)
        rank[cells] = np.arange(len(cells))
        ranks.append(rank[of[np.argpartition(far, near - 1)[:near]]])
    return int(np.quantile(np.concatenate(ranks), recall, method="higher")) + 1


@dataclass
class VectorIndex:
    """An index in a folder that all machines share."""

    spark: SparkSession
    folder: str
    vector_col: str
    metric: str
    dim: int
    #: the cells that a search reads unless another number is asked for
    probes: int
    schema: StructType
    #: cell, its number of rows, its centroid (none for the cell of rows without a place)
    cells: np.ndarray
    rows: np.ndarray
    centroids: np.ndarray

    def _order(self, query: Sequence[float]) -> list[int] | None:
        """Cells from the nearest to the farthest; None if all have to be read, those without a place included."""
        q = np.asarray(query, np.float64)
        norm = np.linalg.norm(q)
        if not np.isfinite(norm) or (self.metric == "cosine" and norm == 0):
            return None
        if len(q) != self.dim:
            return [_NO_CELL] if _NO_CELL in self.cells else []
        q = q / norm if self.metric == "cosine" else q
        placed = self.cells != _NO_CELL
        far = ((self.centroids[placed].astype(np.float64) - q) ** 2).sum(axis=1)
        return [int(c) for c in self.cells[placed][np.argsort(far, kind="stable")]]

    def probed(self, query: Sequence[float], k: int, probes: int | None = None) -> list[int]:
        """The cells that a search reads: the probes nearest ones, and more until they hold k rows; all where it needs them."""
        order = self._order(query)
        if order is None:
            return [int(c) for c in self.cells]
        if order in ([], [_NO_CELL]):
            return order
        size = dict(zip(self.cells.tolist(), self.rows.tolist()))
        n = max(1, self.probes if probes is None else probes)
        while n < len(order) and sum(size[c] for c in order[:n]) < k:
            n += 1
        return order[:n] if n < len(order) else [int(c) for c in self.cells]

    def paths(self, cells: Sequence[int]) -> list[str]:
        return [f"{self.folder}/rows/{_CELL}={c}" for c in cells]

    def pattern(self, cells: Sequence[int]) -> str:
        """The folders of cells as one path, for Spark's SQL."""
        return f"{self.folder}/rows/{_CELL}={{{','.join(map(str, cells))}}}"

    def table(self, cells: Sequence[int]) -> DataFrame:
        """The rows of cells; no other folder is listed or read."""
        if not cells:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self.paths(cells))

    def search(self, query: Sequence[float], k: int, filter: str | None = None, probes: int | None = None, tie: str | None = None) -> DataFrame:
        """What knn() returns, from the probed cells. With a filter more cells are read until k rows pass it."""
        cells = self.probed(query, k, probes)
        while filter and len(cells) < len(self.cells) and self.table(cells).filter(filter).limit(k).count() < k:
            cells = self.probed(query, k, 2 * len(cells))
            if cells in ([], [_NO_CELL]):
                break
        return knn(self.table(cells), self.vector_col, query, k, filter, self.metric, tie)


def build(
    df: DataFrame,
    vector_col: str,
    folder: str,
    metric: str = "l2",
    cells: int | None = None,
    train_vectors: int = TRAIN_VECTORS,
    recall: float = RECALL,
    seed: int = 42,
) -> VectorIndex:
    """Index every row of df in folder, which must be new.

    The dimension is that of most vectors of the sample. Rows whose vector is null, of another dimension, not finite or
    (cosine) zero have a cell of their own, which a search reads only where knn() could return them. cells
    is the square root of the number of rows by default, 2048 at most. Cells of many rows are written by several tasks.
    Searches read as many cells as are needed for recall in the sample: few where vectors lie in groups, half
    of them or more where they lie evenly in many dimensions.
    """
    if metric not in ("l2", "cosine"):
        raise KnnError(f"no index for metric {metric!r}")
    clash = {_CELL, _SALT} & set(df.columns)
    if clash:
        raise KnnError(f"a column is named {clash.pop()!r}")
    spark, schema = df.sparkSession, df.schema
    some = df.select(F.col(vector_col).cast("array<double>").alias("v")).filter(F.size("v") > 0)
    total = df.count()
    sample = some.sample(min(1.0, 1.2 * train_vectors / max(total, 1)), seed).limit(train_vectors).toArrow()["v"].combine_chunks()
    if isinstance(sample, pa.ChunkedArray):
        sample = pa.array([], pa.list_(pa.float64()))
    sizes = np.diff(sample.offsets.to_numpy()) if len(sample) else np.zeros(0, int)
    dim = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    x = _matrix(sample, dim, metric)[1]
    wanted = min(MOST_CELLS, max(1, round(total**0.5))) if cells is None else cells
    centroids = centroids_of(x, wanted, seed) if len(x) else np.zeros((0, dim), np.float32)

    probes = probes_for(x, centroids, recall, seed)

    # by the sample, no (cell, salt) holds more than half of an even task's share of rows
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = np.bincount(_nearest(x, centroids), minlength=len(centroids)) / max(len(x), 1) if len(x) else np.zeros(0)
    salts = np.append(np.maximum(1, np.ceil(share * 2 * tasks)).astype(int), 2 * tasks)
    sent = spark.sparkContext.broadcast((centroids, salts))
    at = df.columns.index(vector_col)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, salts = sent.value
        first = 0
        for batch in batches:
            fits, v = _matrix(batch.column(at).cast(pa.list_(pa.float64())), dim, metric)
            cell = np.full(batch.num_rows, _NO_CELL, np.int32)
            if len(v) and len(centroids):
                cell[fits] = _nearest(v, centroids)
            salt = ((np.arange(batch.num_rows) + first) % salts[cell]).astype(np.int32)
            first += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(salt)], names=[*batch.schema.names, _CELL, _SALT])

    placed = df.mapInArrow(place, StructType([*schema.fields, StructField(_CELL, IntegerType()), StructField(_SALT, IntegerType())]))
    placed.repartition(_CELL, _SALT).drop(_SALT).write.partitionBy(_CELL).parquet(f"{folder}/rows")
    # one row for each cell
    sizes_of = {r[_CELL]: r["n"] for r in _sizes(spark, f"{folder}/rows", schema).collect()}
    listed = [(int(c), int(n), None if c == _NO_CELL else [float(y) for y in centroids[c]]) for c, n in sorted(sizes_of.items())]
    spark.createDataFrame(listed, "cell int, n long, centroid array<float>").coalesce(1).write.parquet(f"{folder}/cells")
    # written last: a folder without it is no index
    spark.createDataFrame([(vector_col, metric, dim, probes, schema.json())], "vector string, metric string, dim int, probes int, schema string").write.parquet(f"{folder}/about")
    return open_index(spark, folder)


def _sizes(spark: SparkSession, rows: str, schema: StructType) -> DataFrame:
    whole = StructType([*schema.fields, StructField(_CELL, IntegerType())])
    return spark.read.schema(whole).parquet(rows).groupBy(_CELL).agg(F.count("*").alias("n"))


def open_index(spark: SparkSession, folder: str) -> VectorIndex:
    """The index that build() has written to folder."""
    folder = folder.rstrip("/")
    about = spark.read.parquet(f"{folder}/about").first()
    listed = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()
    no_place = [0.0] * about["dim"]
    return VectorIndex(
        spark,
        folder,
        about["vector"],
        about["metric"],
        about["dim"],
        about["probes"],
        StructType.fromJson(json.loads(about["schema"])),
        np.array([r["cell"] for r in listed], int),
        np.array([r["n"] for r in listed], int),
        np.array([r["centroid"] or no_place for r in listed], np.float32).reshape(len(listed), about["dim"]),
    )
