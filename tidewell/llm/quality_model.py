"""Quality classifier: naive Bayes support vectors (Wang and Manning 2012).

A document's n-gram indicators are hashed into 2^BITS features: words and word pairs (A-Z lower-cased),
runs of up to SHAPE_N character classes, and runs of REPEAT_N marks "same word as one to four words before".
Each indicator is scaled by its log-count ratio between the classes, rows have length 1, and a
linear model with hinge loss is fitted by dual coordinate descent (Hsieh et al. 2008) on a bounded sample.
Features in fewer than LEAST_DOCS sample documents have ratio 0. Scoring adds up one weight for each feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.words import frugal, lower_word_list, mix, window_hashes, word_hashes

BITS, SHAPE_N, REPEAT_N, LEAST_DOCS = 18, 5, 4, 5
#: Labelled documents the model is fitted on: all up to this many, else about this many by hash.
TRAIN_DOCS = 12_000
#: How steeply the score rises with the margin.
SLOPE = 3.0


def _classes() -> np.ndarray:
    """Code points below 256 to classes: white space, line feed, lower, upper, digit, and each mark by itself."""
    out = np.full(257, 2, np.uint64)
    for c in range(256):
        ch = chr(c)
        if ch == "\n":
            out[c] = 1
        elif ch.isspace():
            out[c] = 0
        elif ch.isupper():
            out[c] = 3
        elif ch.isdigit():
            out[c] = 4
        elif not ch.isalnum():
            out[c] = 5 + c
    return out


_CLASS = _classes()


def _space(h: np.ndarray, name: int) -> np.ndarray:
    return (mix(h + np.uint64(name)) >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    """The sorted distinct features of a text; a null or empty one has none."""
    if not text:
        return np.empty(0, np.int32)
    h = word_hashes(lower_word_list(text))
    out = [_space(h, 1), _space(window_hashes(h, 2), 2)]
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    shape = _CLASS[np.minimum(points, 256)]
    shape = shape[np.concatenate([[True], shape[1:] != shape[:-1]])]
    for n in range(1, SHAPE_N + 1):
        m = max(0, len(shape) - n + 1)
        run = np.zeros(m, np.uint64)
        for i in range(n):
            run = run * np.uint64(521) + shape[i : i + m]
        out.append(_space(np.unique(run), 10 + n))
    for back in (1, 2, 3, 4):
        same = (h[back:] == h[:-back]).astype(np.uint64)
        m = max(0, len(same) - REPEAT_N + 1)
        run = np.zeros(m, np.uint64)
        for i in range(REPEAT_N):
            run = run * np.uint64(2) + same[i : i + m]
        out.append(_space(np.unique(run), 20 + back))
    return np.unique(np.concatenate(out))


@dataclass
class QualityModel:
    weight: np.ndarray
    square: np.ndarray
    bias: float

    def margin(self, own: np.ndarray) -> float:
        length = float(self.square[own].sum()) ** 0.5
        return (float(self.weight[own].sum()) / length if length else 0.0) + self.bias

    def score(self, text: str | None) -> float:
        """0 to 1; 0.5 and more means class 1 is likelier."""
        return float(1 / (1 + np.exp(-SLOPE * self.margin(features(text)))))


def fit(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, cost: float = 1.0, turns: int = 12, seed: int = 7) -> QualityModel:
    """A model of feature rows and labels 0 or 1. With one class only, the bias decides; with no rows it is 0."""
    d = 1 << BITS
    seen = np.zeros((2, d))
    for own, y in zip(rows, labels, strict=True):
        seen[int(y), own] += 1
    p, q = alpha + seen[1], alpha + seen[0]
    ratio = np.where(seen.sum(0) >= LEAST_DOCS, np.log(p / (alpha + (labels == 1).sum())) - np.log(q / (alpha + (labels == 0).sum())), 0.0)
    # values of a row are ratio[row] / its length; only the lengths are held
    lengths = np.array([np.sqrt((ratio[own] ** 2).sum()) for own in rows])
    norms = np.where(lengths > 0, 2.0, 1.0)
    lengths = np.where(lengths > 0, lengths, 1.0)
    y, w, bias, dual = np.where(labels == 1, 1.0, -1.0), np.zeros(d), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(turns):
        moved = 0.0
        for i in order.permutation(len(rows)):
            own = rows[i]
            v = ratio[own] / lengths[i]
            g = y[i] * (w[own] @ v + bias) - 1
            new = min(max(dual[i] - g / norms[i], 0.0), cost)
            step = (new - dual[i]) * y[i]
            if step:
                dual[i] = new
                w[own] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return QualityModel((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), float(bias))


@frugal
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.int32()))], names=["y", "key", "features"])


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS
) -> QualityModel:
    """A model of the documents whose label is 0 or 1; other labels and null are passed over.

    An id counts once: one with both labels is passed over, and of rows of docs that repeat an id the least text is read.
    Of more than train_docs such ids, about train_docs are drawn by the hash of the id, before the texts are looked up:
    what is broadcast and what the driver gets is bounded by that. Null texts have no features.
    """
    marked = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and key is not null")
    drawn = marked.groupBy("key").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").select("key", "y")
    many = drawn.count()
    if many > train_docs:
        drawn = drawn.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * train_docs / many))
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(drawn), "key").groupBy("key", "y").agg(F.min("text").alias("text")).select("y", "text", F.xxhash64("key").alias("key"))
    found = rows.mapInArrow(_extract, "y int, key long, features array<int>").toArrow()
    sample = found.sort_by([("key", "ascending"), ("y", "ascending")])
    del found
    features_, y = sample.column("features").combine_chunks(), sample.column("y").to_numpy()
    del sample
    at, values = features_.offsets.to_numpy(), features_.values.to_numpy()
    model = fit([values[a:b] for a, b in zip(at, at[1:], strict=False)], y)
    del features_, at, values
    pa.default_memory_pool().release_unused()
    return model


def _scorer(shared, id_name: str):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_name, "score"])

    return run


def classify(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row, from its whole text alone. A null or empty text is scored by the bias.

    Null or repeated ids are rows like any other; further columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(_scorer(shared, id_col), f"`{id_col}` {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs that are predicted 1; all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([shared.value.score(t) >= 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
