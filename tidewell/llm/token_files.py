"""Token ids in directly addressable codes.

An id is cut into chunks of CHUNK_BITS, lowest first. Level 0 has the lowest chunk of every id; a
bitmap says which ids continue, and level 1 has the next chunk of those only, and so on. A rank
directory (set bits before each block of RANK_BLOCK bits) turns a position in one level into the
position in the next, so any id is read from as many places as it has chunks, without decoding others.

A file is a shard: the documents of one run of ascending (id, text), as many as make SHARD_TOKENS ids,
one document at least. Shards are rows of a Parquet table (part, shard, n_docs, n_tokens, within, doc_ids,
lengths, payload), within being the ids of the part's shards before; Spark's commit protocol drops what
lost executors left half written.

Payload, little-endian: uint32 number of ids, uint32 number of levels, then for each level uint32 number
of chunks, the chunks (uint8), and but for the last level the rank directory (uint32) and the
bitmap (bit 0 first), each padded to whole bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.scratch import Scratch
from tidewell.llm.tokens import encoder, release, slices

CHUNK_BITS, RANK_BLOCK = 8, 512
#: Ids of a shard at which it is closed; about 2 MB, and ten times that while it is packed.
SHARD_TOKENS = 1 << 20
#: Ids that one task of the sort by document is meant to have.
TASK_TOKENS = 12 << 20
#: Tasks of the sort whose ids are added up in one group.
PARTS = 4096
#: Tasks whose offsets (16 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_PARTS = 1 << 21


def pack_codes(ids: np.ndarray) -> bytes:
    """A payload from uint32 ids."""
    ids = ids.astype(np.uint32)
    levels, rest = [], ids
    while True:
        chunk = (rest & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8)
        more = rest >> np.uint32(CHUNK_BITS)
        on = more > 0
        if not on.any():
            levels.append(struct.pack("<I", len(chunk)) + chunk.tobytes())
            break
        pad = np.zeros(-len(on) % RANK_BLOCK, bool)
        ranks = np.cumsum(np.concatenate([on, pad]).reshape(-1, RANK_BLOCK).sum(1)).astype("<u4")
        ranks = np.concatenate([np.zeros(1, "<u4"), ranks[:-1]]).astype("<u4")
        levels.append(struct.pack("<I", len(chunk)) + chunk.tobytes() + ranks.tobytes() + np.packbits(on, bitorder="little").tobytes())
        rest = more[on]
    return struct.pack("<II", len(ids), len(levels)) + b"".join(levels)


class Codes:
    """Read access to a payload."""

    def __init__(self, payload: bytes):
        self.n, levels = struct.unpack_from("<II", payload, 0)
        at, self.levels = 8, []
        for k in range(levels):
            (n,) = struct.unpack_from("<I", payload, at)
            chunks = np.frombuffer(payload, np.uint8, n, at + 4)
            at += 4 + n
            ranks = bits = None
            if k < levels - 1:
                blocks, size = -(-n // RANK_BLOCK), -(-n // 8)
                ranks = np.frombuffer(payload, "<u4", blocks, at)
                bits = np.frombuffer(payload, np.uint8, size, at + 4 * blocks)
                at += 4 * blocks + size
            self.levels.append((chunks, ranks, bits))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The id at i, from its own chunks only."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, ranks, bits) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * k)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BLOCK
            before = np.unpackbits(bits[block * RANK_BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BLOCK]
            i = int(ranks[block]) + int(before.sum())
        return value

    def all(self) -> np.ndarray:
        """Every id, in order."""
        out, where = self.levels[0][0].astype(np.uint32), None
        for k, (chunks, _, bits) in enumerate(self.levels):
            if k:
                out[where] |= chunks.astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            if bits is not None:
                on = np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)
                where = np.flatnonzero(on) if where is None else where[on]
        return out


_SHARDS = "part int, shard int, n_docs long, n_tokens long, within long, doc_ids array<long>, lengths array<long>, payload binary"


#: Ids hardly repeat as bytes, and zstd gets out what there is; small row groups bound what a writing task holds.
_WRITER = {"compression": "zstd", "parquet.block.size": 16 << 20}
_ENCODED = "id long, n long, wide boolean, ids binary"


def _encode(path: str, end_id: int):
    """The ids of each document with end_id, in two bytes each if they fit, else wide in four."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                ids, wide, counts = [], [], []
                for own in encoder(path).encode(part.column(1).to_pylist()):
                    raw = np.frombuffer(own + end, "<u4")
                    wide.append(bool(raw.max() >> 16))
                    ids.append(raw.tobytes() if wide[-1] else raw.astype("<u2").tobytes())
                    counts.append(len(raw))
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(wide, pa.bool_()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "wide", "ids"])

    return run


def _write_shards(shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()  # the worker may have encoded before
        part, shard, within, held, ids, lengths = TaskContext.get().partitionId(), 0, 0, [], [], []

        def shut() -> pa.RecordBatch:
            row = [[part], [shard], [len(ids)], [size], [within], [ids], [lengths], [pack_codes(np.concatenate(held))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "shard", "n_docs", "n_tokens", "within", "doc_ids", "lengths", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=names)

        size = 0
        for batch in batches:
            for doc_id, wide, own in zip(*(batch.column(c).to_pylist() for c in ("id", "wide", "ids")), strict=True):
                held.append(np.frombuffer(own, "<u4" if wide else "<u2").astype(np.uint32))
                ids.append(doc_id)
                lengths.append(len(held[-1]))
                size += lengths[-1]
                if size >= shard_tokens:
                    yield shut()
                    shard, within, size, held, ids, lengths = shard + 1, within + size, 0, [], [], []
        if ids:
            yield shut()

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Write the ids of docs below path, each document followed by end_id, and return the shard table.

    Documents are in ascending order of id, nulls first; rows that repeat an id by their ids. A null text is
    empty and gives end_id only. Texts are encoded where they are read; only their ids are sorted, and rows alike
    in all are dealt over tasks too. Further columns are not read. An empty table gives no shard.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-ids")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    encoded = plain.mapInArrow(_encode(tokenizer_path, end_id), _ENCODED).withColumn("print", F.xxhash64("ids")).withColumn("row", F.monotonically_increasing_id())
    encoded = scratch.keep(encoded, "encoded", **_WRITER)
    total = encoded.agg(F.sum("n")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, total // TASK_TOKENS + 1)
    order = [F.col("id").asc_nulls_first(), "print", "ids", "row"]
    lined_up = encoded.repartitionByRange(tasks, order[0], "print", "row").sortWithinPartitions(*order)
    lined_up.select("id", "wide", "ids").mapInArrow(_write_shards(shard_tokens), _SHARDS).write.options(**_WRITER).parquet(f"{path}/shards")
    scratch.drop(encoded)
    # ids before each part, by sums within runs of PARTS parts and over the runs, so that no task has all parts
    parts = spark.read.schema(_SHARDS).parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("run", F.expr(f"part div {PARTS}"))
    runs = parts.groupBy("run").agg(F.sum("n").alias("of_run"))
    runs = runs.select("run", (F.sum("of_run").over(Window.orderBy("run")) - F.col("of_run")).alias("run_base"))
    within = F.sum("n").over(Window.partitionBy("run").orderBy("part")) - F.col("n")
    parts.withColumn("within_run", within).join(runs, "run").select("part", (F.col("run_base") + F.col("within_run")).alias("part_base")).write.parquet(f"{path}/parts")
    return read_shards(spark, path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shard table, with base: the number of ids in all shards before."""
    shards = spark.read.schema(_SHARDS).parquet(f"{path}/shards")
    parts = spark.read.schema("part int, part_base long").parquet(f"{path}/parts")
    if parts.count() <= BROADCAST_PARTS:
        parts = F.broadcast(parts)
    return shards.join(parts, "part").withColumn("base", F.col("part_base") + F.col("within")).drop("part_base", "within")


_INDEX = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()  # the worker may have encoded before
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            raw = memoryview(Codes(row["payload"]).all().astype("<u4").tobytes())
            ends = np.cumsum(np.array(row["lengths"], np.int64))
            starts = ends - row["lengths"]
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            columns = [row["doc_ids"], starts + row["base"], row["lengths"], crc]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_index(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the payloads."""
    return shards.select("payload", "doc_ids", "lengths", "base").mapInArrow(_decode, _INDEX)


def read_tokens(shards: DataFrame, at: int, n: int) -> np.ndarray:
    """ids at..at+n of the whole corpus, from the shards that hold them and from no other position in them."""
    found = shards.filter((F.col("base") < at + n) & (F.col("base") + F.col("n_tokens") > at)).select("base", "payload").orderBy("base")
    out: list[int] = []
    for row in found.toLocalIterator():
        codes = Codes(bytes(row["payload"]))
        out += [codes[i] for i in range(max(0, at - row["base"]), min(len(codes), at + n - row["base"]))]
    return np.array(out, np.uint32)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write docs as token files in the shared folder and return read_index() of them."""
    return read_index(write_token_files(docs, Scratch(docs.sparkSession, "token-files").path, tokenizer_path, end_id))
