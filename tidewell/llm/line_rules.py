"""Quality rules: counts within a document, and lines that many documents of a host share.

A line's normal form is its words, A-Z lower-cased, joined by one space. Per host, the distinct documents
(texts, so that exact copies count once) of each normal line are counted. Lines in more than most_docs of
them are removed, whatever the size of the host, and a document that loses more than `depleted` percent
of its words is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewell.llm.scratch import Scratch
from tidewell.llm.words import window_hashes, word_hashes, word_list

MOST_DOCS, DEPLETED_PERCENT = 10, 80

#: Up to so many common lines (8 bytes each) are sent to all workers; more are joined. The results are the same.
SENT_LINES = 1 << 22

LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 20, 30, 8
_SYMBOLS, _WHITE = "#*$%&|<>", " \t\n\x0b\x0c\r"


def repeated_words(h: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that are found twice or more, the first included."""
    w = window_hashes(h, window)
    if len(w) < 2:
        return 0
    _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
    twice = np.nonzero(counts[inverse] > 1)[0]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def normal_line(line: str) -> bytes:
    return b" ".join(line.encode().lower().split())


def measures(text: str | None) -> tuple[int, int, int, int, int, set[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the normal lines (by hash)."""
    text = text or ""
    words = word_list(text)
    lines = [x for x in text.split("\n") if x.strip(_WHITE)]
    return (
        len(words),
        len(text) - sum(map(text.count, _WHITE)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(word_hashes(words)),
        {line_hash(normal_line(x)) for x in lines},
    )


def line_hash(normal: bytes) -> int:
    return xxhash.xxh3_64_intdigest(normal) - (1 << 63)


def without_lines(text: str, common: set[int]) -> str:
    """text without the lines whose normal form is common; blank lines stay."""
    return "\n".join(x for x in text.split("\n") if not x.strip(_WHITE) or line_hash(normal_line(x)) not in common)


_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, fa long, fb long, lines array<long>"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _MEASURES.split(", ")]
    for batch in batches:
        for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
            texts = part.column(2).to_pylist()
            rows = [measures(t) for t in texts]
            prints = [None if t is None else np.frombuffer(xxhash.xxh3_128_digest(t), np.int64) for t in texts]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            columns += [pa.array([None if p is None else int(p[i]) for p in prints], pa.int64()) for i in range(2)]
            columns += [pa.array([list(r[5]) for r in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *columns], names=["id", "host", "text", *names])


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def line_keys(hosts: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """One number for a line of a host; both are hashes of 64 bits."""
    return hosts ^ lines


def _look_up(keys: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In the place of h and lines, those of the lines that are common: their keys are among keys, which are sorted."""
    for batch in batches:
        lists = batch.column("lines")
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
        of = line_keys(np.repeat(batch.column("h").to_numpy(zero_copy_only=False), sizes), flat)
        at = np.searchsorted(keys, of)
        found = keys[np.minimum(at, len(keys) - 1)] == of if len(keys) else np.zeros(len(of), bool)
        ends = np.concatenate([[0], np.cumsum(found)])[np.concatenate([[0], np.cumsum(sizes)])]
        common = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[found], pa.int64()))
        names = ["id", *_COUNTS, "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), common], names=[*names, "common"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text without its common lines, and how many words fewer it has."""
    for batch in batches:
        texts, lost = batch.column("text").to_pylist(), []
        for i, common in enumerate(batch.column("common").to_pylist()):
            if common:
                whole = texts[i]
                texts[i] = without_lines(whole, set(common))
                lost.append(len(word_list(whole)) - len(word_list(texts[i])))
            else:
                lost.append(0)
        kept = [batch.column(c) for c in ("id", *_COUNTS)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(lost, pa.int64())], names=["id", *_COUNTS, "text", "words_removed"])


def _typed(id_field: StructField, rest: str) -> StructType:
    return StructType([StructField("id", id_field.dataType), *StructType.fromDDL(rest).fields])


def _cut_rows(scratch: Scratch, docs: DataFrame, ident: Column, text_col: str, host_col: str, most_docs: int, depleted_percent: int, sent_lines: int) -> DataFrame:
    """(id, the counts, text without common lines, words_removed, base_failed, kept) of every row; id is ident."""
    plain = docs.select(ident.alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    of_id = plain.schema["id"]
    rows = scratch.keep(plain.mapInArrow(_measure, _typed(of_id, f"host string, text string, {_MEASURES}")), "measures")

    # one row for each distinct text of a host, so that copies neither count twice nor are looked up twice
    texts = rows.filter("fa is not null").groupBy("host", "fa", "fb").agg(F.max("lines").alias("lines"))
    h = F.xxhash64("host", F.col("host").isNull()).alias("h")
    texts = scratch.keep(texts.select(h, "fa", "fb", "lines"), "texts")
    pairs = texts.select("h", "fa", "fb", F.explode("lines").alias("line"))
    common = pairs.groupBy("h", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") > most_docs)
    common = scratch.keep(common.select("h", "line"), "common")
    if common.count() <= sent_lines:
        # no text is shuffled: each worker has the keys of all common lines
        table = common.toArrow()
        keys = docs.sparkSession.sparkContext.broadcast(np.sort(line_keys(table["h"].to_numpy(), table["line"].to_numpy())))
        look = rows.select("id", *_COUNTS, "text", h, "lines")

        def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _cut(_look_up(keys.value, batches))

    else:
        of_text = pairs.join(common, ["h", "line"], "left_semi").groupBy("h", "fa", "fb").agg(F.collect_list("line").alias("common"))
        of_text = scratch.keep(of_text, "common-of-texts")
        look = rows.select("id", *_COUNTS, "text", h, "fa", "fb").join(of_text, ["h", "fa", "fb"], "left").select("id", *_COUNTS, "text", "common")
        cut_rows = _cut
    cut = look.mapInArrow(cut_rows, _typed(of_id, ", ".join(f"{c} long" for c in _COUNTS) + ", text string, words_removed long"))
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return cut.withColumn("base_failed", base_failed).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("words_removed") <= depleted_percent * F.col("n_words"))
    )


def clean_documents(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    most_docs: int = MOST_DOCS,
    depleted_percent: int = DEPLETED_PERCENT,
    sent_lines: int = SENT_LINES,
) -> DataFrame:
    """The documents that quality_rules keeps, with all their columns, and common lines cut from the text.

    Up to sent_lines common lines are sent to all workers, more are joined; the results are the same.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    rows = _cut_rows(Scratch(docs.sparkSession, "clean-documents"), docs, whole, text_col, host_col, most_docs, depleted_percent, sent_lines).filter("kept")
    return rows.select(*[F.col("text").alias(c) if c == text_col else F.col("id")[c].alias(c) for c in docs.columns])


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    most_docs: int = MOST_DOCS,
    depleted_percent: int = DEPLETED_PERCENT,
    sent_lines: int = SENT_LINES,
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_removed, kept) of every row.

    base_failed: under 20 words, or over 30 percent of them in repeated 8-word windows. kept: not base_failed, and the
    removed lines hold no more than depleted_percent of the words. A null text has no words and fails; a
    null host is a host. Null or repeated ids are rows like any other. Further columns are not read.
    words_removed is counted on the text that clean_documents gives.
    """
    scratch = Scratch(docs.sparkSession, "quality-rules")
    rows = _cut_rows(scratch, docs, F.col(id_col), text_col, host_col, most_docs, depleted_percent, sent_lines)
    return scratch.only(rows.select(F.col("id").alias(id_col), *_COUNTS, "base_failed", "words_removed", "kept"), "verdict")


#: DuckDB: the same table of documents.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT source, text, lower_line, sum(n) AS n FROM (
    SELECT source, text, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS lower_line,
           len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
    FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL)))
  WHERE n > 0 GROUP BY source, text, lower_line),
common AS (
  SELECT source, lower_line FROM lines GROUP BY source, lower_line HAVING count(*) > 10),
removed AS (
  SELECT l.source, l.text, sum(l.n) AS n FROM lines l JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.lower_line = c.lower_line
  GROUP BY l.source, l.text),
windows AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 8], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, g FROM windows GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM windows SEMI JOIN twice USING (doc_id, g)) GROUP BY doc_id),
dup AS (
  SELECT doc_id, sum(c - 1) AS n FROM (
    SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 0 GROUP BY doc_id, line) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, d.source, d.text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT b.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce(r.n, 0)::BIGINT AS words_removed
  FROM base b LEFT JOIN removed r ON b.source IS NOT DISTINCT FROM r.source AND b.text = r.text)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_removed,
       NOT base_failed AND 100 * words_removed <= 80 * n_words AS kept FROM judged
"""
