"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and read as code points; every n-gram of 1 to MAX_N code points is hashed
to one of 2^BITS buckets. Counts are gathered per language in the cluster, the matrix of
log-probabilities (buckets x languages, float32) is broadcast, and a batch is scored as one sparse product:
the (texts x distinct buckets) counts of the batch, as compressed rows, times the matrix' rows for these buckets.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, MAX_N = 16, 3
#: Labelled documents of each language that counts are taken from: all of them up to this many, else about this many by hash.
#: The matrix has 256 KB for each language, however many there are.
TRAIN_DOCS = 5_000
#: Languages whose shares are sent to every executor; those of more are joined by a shuffle.
BROADCAST_LANGUAGES = 1 << 16
_TURN = 0x9E3779B1
#: Code points of which n-grams are made at once, and products that are held at once.
_SLICE, _PRODUCTS = 1 << 20, 1 << 24


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)


def grams(points: np.ndarray, bits: int = BITS, max_n: int = MAX_N, starts: int | None = None) -> np.ndarray:
    """The buckets of the n-grams of one text that begin at its first `starts` points (all if None), n from 1 to max_n."""
    out, h = [], np.zeros(len(points), np.uint32)
    for n in range(1, max_n + 1):
        if len(points) < n:
            break
        m = len(points) - n + 1
        h = (h[:m] * np.uint32(0x01000193)) ^ (points[n - 1 :] + np.uint32(n))
        mixed = h[:starts] * np.uint32(_TURN)
        out.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(_TURN) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def _sliced(points: np.ndarray, bits: int = BITS) -> Iterator[np.ndarray]:
    """The buckets of a text, slice by slice: each n-gram in the slice that it begins in."""
    for at in range(0, len(points), _SLICE):
        yield grams(points[at : at + _SLICE + MAX_N - 1], bits, starts=_SLICE)


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = held.setdefault(lang, np.zeros(1 << bits, np.int64))
                for buckets in _sliced(_points(text), bits):
                    counts += np.bincount(buckets, minlength=1 << bits)
        for lang, counts in held.items():
            at = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])

    return run


class LanguageModel:
    """Names in ascending order, log priors, and log-probabilities as (buckets, languages)."""

    def __init__(self, names: list[str], docs: np.ndarray, counts: np.ndarray, smoothing: float = 0.5):
        self.names = names
        self.prior = np.log(np.maximum(docs, 1) / max(1, docs.sum())) if len(names) else np.empty(0)
        self.logp = np.empty((counts.shape[1], len(names)), np.float32)
        for i, own in enumerate(counts):
            p = own.astype(np.float64) + smoothing
            self.logp[:, i] = np.log(p / p.sum())

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Log joint probabilities (texts, languages)."""
        out = np.tile(self.prior, (len(texts), 1))
        rows, cells, held = [], [], 0
        for i, text in enumerate(texts):
            for buckets in _sliced(_points(text)) if text else ():
                rows.append(i)
                cells.append(buckets)
                held += len(buckets)
                if held > _SLICE:
                    self._add(out, rows, cells)
                    rows, cells, held = [], [], 0
        self._add(out, rows, cells)
        return out

    def _add(self, out: np.ndarray, rows: list[int], cells: list[np.ndarray]) -> None:
        """Add the product of compressed rows, given by their buckets (one for each count), with the matrix."""
        if not rows:
            return
        starts = np.cumsum([0, *map(len, cells)])[:-1]
        every = np.concatenate(cells)
        seen = np.zeros(1 << BITS, bool)
        seen[every] = True
        distinct = np.flatnonzero(seen)
        if len(rows) == 1:  # of one long text, the counts
            np.add.at(out, rows, np.bincount(every, minlength=1 << BITS)[distinct].astype(np.float64) @ self.logp[distinct])
            return
        place = (np.cumsum(seen) - 1)[every]
        width = max(1, _PRODUCTS // len(every))
        for at in range(0, len(self.names), width):
            own = np.ascontiguousarray(self.logp[distinct, at : at + width].T, dtype=np.float64)
            sums = np.stack([np.add.reduceat(column[place], starts) for column in own], 1)
            np.add.at(out, (np.array(rows)[:, None], np.arange(at, at + sums.shape[1])), sums)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A name and its posterior for each text; ('und', 0) without a letter or without a model."""
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        joint = self.scores(texts)
        best = joint.argmax(1)
        post = 1 / np.exp(joint - joint.max(1, keepdims=True)).sum(1)
        lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        return (
            [self.names[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)],
            [float(p) if ok else 0.0 for p, ok in zip(post, lettered, strict=True)],
        )


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """A model of the rows whose text and language are not null, with every language that has such a row.

    Of a language with more rows than train_docs, about train_docs are drawn by the hash of key_col and text, one at
    least; rows alike in both are drawn together. What the driver gets are counts, no more than the matrix has cells. Priors are of all rows.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(key_col).alias("key"))
    rows = rows.filter("lang is not null and text is not null")
    drawn = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30))
    # the least hash of each language is drawn whatever its share
    many = rows.groupBy("lang").agg(F.count("*").alias("docs"), F.min(drawn).alias("first"))
    of_lang = many.collect()  # a row for each language, as in the model
    docs_of = {r["lang"]: r["docs"] for r in of_lang}
    below = [(r["lang"], max(r["first"] + 1, (train_docs << 30) // r["docs"])) for r in of_lang]
    shares = labelled.sparkSession.createDataFrame(below, "lang string, below long")
    if len(below) <= BROADCAST_LANGUAGES:
        shares = F.broadcast(shares)
    sampled = rows.withColumn("drawn", drawn).join(shares, "lang").filter("drawn < below")
    counted = sampled.select("lang", "text").mapInArrow(_count(BITS), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(docs_of)
    counts = np.zeros((len(names), 1 << BITS), np.float32 if len(names) > 64 else np.float64)
    if names:
        table = counted.toArrow()  # no more cells than the matrix has
        lang = table.column("lang").combine_chunks().dictionary_encode()
        place = np.array([bisect_left(names, x) for x in lang.dictionary.to_pylist()], np.int64)
        counts[place[lang.indices.to_numpy()], table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return LanguageModel(names, np.array([docs_of[x] for x in names], np.float64), counts)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row: the likeliest language and its posterior probability.

    'und' and 0 for a null text or one without a letter, or if no language has been learned. Texts are scored whole.
    Null or repeated ids are rows like any other; further columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                names, scores = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
