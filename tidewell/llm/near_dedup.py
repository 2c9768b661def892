"""Near-duplicate documents by MinHash.

One-permutation hashing: the shingle hashes of a document are cut into equal ranges (bins) and
the smallest of each bin is kept, so that a document is hashed once. Empty bins copy a
bin chosen by a universal hash of (bin, attempt), tried until it is not empty ("optimal
densification", Shrivastava 2017). Bins are joined into bands; documents that agree on a
band share a bucket. Each bucket gives a star of candidate edges around one centre, never all its
pairs. Candidates are confirmed on full shingle sets.

Equal shingle sets are one class and only its smallest id is compared. A star can miss a link
between two members when one of them fails against the centre. The members of buckets that still
hold several components are therefore joined on their rarest shingles (prefix and positional
filtering), which loses no link; where most of them have links already, further stars around other
centres go first, as long as they join something. No bucket is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.classes import of_class
from tidewell.llm.components import components
from tidewell.llm.scratch import Scratch
from tidewell.llm.words import frugal, mix, shingle_set

#: Members that share a shingle are paired in blocks of about so many.
PAIR_BLOCK = 512
#: 40 bands of 6 bins miss a pair of similarity 0.85 once in 10^8, one of 0.8 once in 3 * 10^5.
BANDS, ROWS = 40, 6


class Sketcher:
    """Densified one-permutation signatures and their band keys."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 1):
        self.bands, self.rows, self.k = bands, rows, bands * rows
        self.seed = np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        step = (1 << 64) // self.k
        self.starts = np.array([i * step for i in range(self.k)], np.uint64)
        self.ends = np.concatenate([self.starts[1:], [np.uint64(0xFFFFFFFFFFFFFFFF)]])
        self._donors: list[np.ndarray] = []

    def _donor(self, attempt: int) -> np.ndarray:
        while len(self._donors) <= attempt:
            t = np.uint64(len(self._donors) + 1) << np.uint64(20)
            self._donors.append((mix(np.arange(self.k, dtype=np.uint64) + t + self.seed) % np.uint64(self.k)).astype(np.int64))
        return self._donors[attempt]

    def one_permutation(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The least hash of each bin, and which bins have one. No set may be empty."""
        sig, full = np.empty((len(sets), self.k), np.uint64), np.empty((len(sets), self.k), bool)
        for i, s in enumerate(sets):
            s = np.sort(mix(s ^ self.seed))
            at = np.searchsorted(s, self.starts)
            sig[i] = s[np.minimum(at, len(s) - 1)]
            full[i] = (at < len(s)) & (sig[i] < self.ends)
        return sig, full

    def densified(self, sig: np.ndarray, full: np.ndarray) -> np.ndarray:
        out, (row, col), attempt = sig.copy(), np.nonzero(~full), 0
        while len(row):
            donor = self._donor(attempt)[col]
            hit = full[row, donor]
            out[row[hit], col[hit]] = sig[row[hit], donor[hit]]
            row, col, attempt = row[~hit], col[~hit], attempt + 1
        return out

    def band_keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """One int64 for each set and band."""
        if not sets:
            return np.empty((0, self.bands), np.int64)
        sig = self.densified(*self.one_permutation(sets)).reshape(len(sets), self.bands, self.rows)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), sig.shape[:2])
        for j in range(self.rows):
            key = mix(key + sig[:, :, j])
        return key.view(np.int64)


def needs_bands(n: int, percent: int) -> bool:
    """Whether a set of n shingles can link with a set that is not equal to it."""
    return 100 * n >= percent * (n + 1) or 100 * (n - 1) >= percent * n


def _sketch(words: int, percent: int, sketcher: Sketcher):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64()), ("bands", pa.list_(pa.int64()))])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                sets = [shingle_set(t, words) for t in part.column(1).to_pylist()]
                prints = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]
                banded = [i for i, s in enumerate(sets) if len(s) and needs_bands(len(s), percent)]
                bands: list = [[]] * len(sets)
                for i, keys in zip(banded, sketcher.band_keys([sets[i] for i in banded]), strict=True):
                    bands[i] = keys
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([int(p[0]) if len(s) else None for p, s in zip(prints, sets, strict=True)], pa.int64()),
                        pa.array([int(p[1]) if len(s) else None for p, s in zip(prints, sets, strict=True)], pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    schema=schema,
                )

    return run


def _full_sets(words: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                sets = [shingle_set(t, words).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return run


def _sized(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The distinct (a, b), a the greater, of pairs (a, n, b) whose sizes let them reach the similarity. Only ids are moved."""
    near = pairs.join(sizes, "b").filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    n, m = F.size("sa"), F.size("sb")
    both = pairs.join(left, "a").join(right, "b").filter(100 * F.least(n, m) >= percent * F.greatest(n, m))
    common = both.select("a", "b", (n + m).alias("t"), F.size(F.array_intersect("sa", "sb")).alias("c"))
    return common.filter(F.expr(f"100L * c >= {percent}L * (t - c)")).select("a", "b")


def _prefixes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(token, id, label, n, place): the shingles that a link of a member with another label must share one of.

    With shingles in one order, rarest first, two sets that reach the similarity have one of the first
    n - ceil(percent * n / 100) + 1 of either in common; place counts from 1. Shingles of one member only
    are counted, not kept.
    """
    tokens = members.join(sets, "id").select("id", "label", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("f"), F.min("label").alias("x"), F.max("label").alias("y")).filter("f > 1")
    own = Window.partitionBy("id")
    ranked = of_class(tokens, common.withColumn("shared", F.col("f")), ["token"], "f", ["id"]).filter("shared is not null").withColumnRenamed("shared", "f").select(
        "*", (F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("f", "token"))).alias("place")
    )
    return ranked.filter(f"x < y and place <= n - ({percent}L * n + 99) div 100 + 1").select("token", "id", "label", "n", "place")


def _sharing(prefix: DataFrame, percent: int) -> DataFrame:
    """The distinct (a, b) of rows with other labels that share a token and can reach the similarity by its places.

    A token's rows are dealt over blocks, and each pair of blocks is a group of its own, however many rows have the token.
    """
    blocks = prefix.groupBy("token").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / PAIR_BLOCK).cast("int"))
    dealt = of_class(prefix, blocks.filter("m > 1"), ["token"], "m", ["id"]).filter("blocks is not null").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "label", "n", "place")
    x, y = dealt.alias("x"), dealt.alias("y")
    close = f"{100 + percent} * (1 + least(x.n - x.place, y.n - y.place)) >= {percent} * (x.n + y.n)"
    near = x.join(y, F.expr(f"x.token = y.token and x.i = y.i and x.j = y.j and (x.i = x.j or x.block <> y.block) and x.label < y.label and {close}"))
    return near.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs; kept marks the smallest id of each component.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct
    ``words``-word shingles (lower-cased A-Z). Null or wordless texts have empty sets and link with
    nothing. A row with a null id is a component of its own: component_id is null and kept is true.
    Rows that repeat an id give a row each; what links any of them is reached through that id.
    Further columns of docs, whatever their names, are not read. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = scratch.keep(
        plain.mapInArrow(_sketch(words, percent, Sketcher(bands, rows)), "id long, n long, fa long, fb long, bands array<long>"),
        "sketches",
    )
    named = sketches.filter("id is not null and fa is not null")
    classes = scratch.keep(named.groupBy("fa", "fb").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "classes")

    first = named.join(classes.select("fa", "fb", F.col("rep").alias("id")), ["fa", "fb", "id"], "left_semi")
    members = first.select(F.col("id").alias("rep"), "n", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("rep").alias("centre"), F.max("rep").alias("other")).filter("centre < other")
    shared = scratch.keep(members.join(buckets.select("band", "centre"), "band"), "buckets")

    wanted = shared.select(F.col("rep").alias("id")).distinct()
    sets = scratch.keep(
        plain.join(wanted, "id", "left_semi").mapInArrow(_full_sets(words), "id long, shingles array<long>"), "sets"
    )
    sizes = scratch.keep(shared.select(F.col("rep").alias("b"), F.col("n").alias("m")).distinct(), "sizes")
    pairs = shared.filter("rep <> centre").select(F.col("rep").alias("a"), "n", F.col("centre").alias("b")).distinct()
    tried = scratch.keep(_sized(pairs, sizes, percent), "tried")
    links = scratch.keep(_confirmed(tried, sets, percent), "confirmed")
    found = components(links, scratch)
    scratch.drop(links)

    turn, gained = 0, True
    while True:
        label = found.select(F.col("id").alias("rep"), "component_id")
        marked = shared.select("band", "rep", "n").join(label, "rep", "left").select("band", "rep", "n", F.coalesce("component_id", "rep").alias("label"))
        of = marked.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min(F.xxhash64("rep", F.lit(turn), "band")).alias("pick"))
        left = scratch.keep(marked.join(of.filter("x < y").select("band", "pick"), "band"), "open")
        ids = left.select(F.col("rep").alias("id"), "label").distinct()
        many, linked = ids.join(found.select("id"), "id", "left").agg(F.count("*"), F.count(found["id"])).first()
        if not many:
            break
        every = 2 * linked < many or not gained
        if every:
            new = _sharing(scratch.keep(_prefixes(ids, sets, percent), "prefixes"), percent)
        else:
            centre = left.filter(F.xxhash64("rep", F.lit(turn), "band") == F.col("pick")).select("band", F.col("rep").alias("b"), F.col("label").alias("l"))
            new = _sized(left.join(centre, "band").filter("label <> l").select(F.col("rep").alias("a"), "n", "b").distinct(), sizes, percent)
        new = scratch.keep(new.join(tried, ["a", "b"], "left_anti"), "new")
        more = scratch.keep(_confirmed(new, sets, percent), "confirmed")
        gained = not more.isEmpty()
        if gained:
            # what is known already is as many links as there are linked ids
            known = found
            found = components(known.select(F.col("id").alias("a"), F.col("component_id").alias("b")).union(more), scratch)
            scratch.drop(known)
        scratch.drop(left, more)
        if every:
            break
        tried = tried.union(new)
        turn += 1

    labelled = classes.join(found.select(F.col("id").alias("rep"), "component_id"), "rep", "left").select(
        "fa", "fb", "m", F.coalesce("component_id", "rep").alias("component_id")
    )
    verdict = of_class(sketches.select("id", "n", "fa", "fb"), labelled, ["fa", "fb"], "m", ["id", "n"]).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )
    return scratch.only(verdict, "verdict")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that near_duplicates() does not keep; all columns as they were.

    Of rows that repeat an id all stay or go together with that id; null ids stay.
    """
    verdict = near_duplicates(docs, id_col, text_col, words, percent)
    gone = verdict.filter("not kept").select(F.col(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")


#: DuckDB: documents by 3-word shingles at 85 percent, by a join on shingles.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (shingle) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l ON l.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
