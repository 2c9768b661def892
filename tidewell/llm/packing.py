"""Packing documents into sequences of a fixed length.

A document longer than a sequence is cut: whole sequences at its end, the remainder first.
Every other piece stays whole. Pieces of one length are interchangeable, so the plan is made
on the number of pieces of each length (at most `capacity` numbers, whatever the corpus), by bin
completion (Korf): take the largest length left, enumerate undominated fillings around it, the fullest
first, use one as often as the counts allow, then once less and so on, go on. Fillings around one length
are taken in their order only, so none is tried in two orders. Best-fit decreasing is the first incumbent;
a node is pruned when the waste so far already forces as many sequences as the incumbent has. The search
is whole unless it runs out of NODES or LOOKED; what it has found by then is no worse than best-fit.
The plan is a table of runs (length, ranks from, to) -> (sequence, offset), and each piece finds
its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.scratch import Scratch
from tidewell.llm.tokens import encoder, slices

#: A filling: its lengths with how often each occurs, largest first.
Filling = tuple[tuple[int, int], ...]
#: Nodes of a search for a better plan, and fillings looked at in all its nodes. The plan is whole when they run out.
NODES, LOOKED = 4_000, 96_000


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: Martello and Toth's L2 over all thresholds."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    lengths = sorted(counts)
    for k in {0, *(n for n in lengths if n <= capacity // 2)}:
        alone = sum(c for n, c in counts.items() if n > capacity - k)
        large = sum(c for n, c in counts.items() if capacity // 2 < n <= capacity - k)
        room = large * capacity - sum(n * c for n, c in counts.items() if capacity // 2 < n <= capacity - k)
        small = sum(n * c for n, c in counts.items() if k <= n <= capacity // 2)
        best = max(best, alone + large + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on counts: the same sequences as item by item, in steps of whole runs."""
    open_: dict[int, list[tuple[tuple, int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling: tuple, times: int) -> None:
        if times:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((filling, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each, room, filling, times = capacity // length, capacity, (), -(-left // (capacity // length))
            else:
                room = rooms[i]
                filling, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
                each = room // length
            full, rest = min(times, left // each), 0
            put(room - each * length, (*filling, (length, each)), full)
            left -= full * each
            if full < times and left:
                rest = left
                put(room - rest * length, (*filling, (length, rest)), 1)
                left = 0
            if filling:
                put(room, filling, times - full - bool(rest))
    return [x for kept in open_.values() for x in kept]


def _sums(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """For each number of lengths, the sums up to room that these can have, as bits."""
    sums, all_ = [1], (1 << (room + 1)) - 1
    for n in lengths:
        now, left, step = sums[-1], min(counts[n], room // n), 1
        while left:
            take = min(step, left)
            now |= (now << (take * n)) & all_
            left, step = left - take, 2 * step
        sums.append(now)
    return sums


def fillings(counts: dict[int, int], room: int, most_gap: int, look: Iterator, after: tuple[int, Filling] | None = None) -> Iterator[tuple[int, Filling]]:
    """(gap, filling) for every undominated way to fill room from what counts has, by gap, then the largest lengths first.

    A way is dominated if a length still there fits into its gap, or fits in place of one or two of its
    pieces without being shorter. Ways up to and with after are left out. One is taken from look for each way looked at.
    """
    lengths = sorted(n for n, c in counts.items() if c and n <= room)
    sums = _sums(counts, lengths, room)
    there = sum(1 << n for n, c in counts.items() if c)

    def go(i: int, left: int) -> Iterator[Filling]:
        if not left:
            yield ()
            return
        for k in range(min(i, bisect.bisect_right(lengths, left) - 1), -1, -1):
            if not sums[k + 1] >> left & 1:
                return
            n = lengths[k]
            for m in range(min(counts[n], left // n), 0, -1):
                if sums[k] >> (left - m * n) & 1:
                    for rest in go(k - 1, left - m * n):
                        yield ((n, m), *rest)

    def dominated(gap: int, way: Filling) -> bool:
        rest = there
        for n, m in way:
            if m == counts[n]:
                rest ^= 1 << n
        if rest & ((1 << (gap + 1)) - 1):
            return True
        for at, (n, m) in enumerate(way):
            if (rest >> (n + 1)) & ((1 << gap) - 1) or (m > 1 and (rest >> 2 * n) & ((1 << (gap + 1)) - 1)):
                return True
            if any((rest >> (n + o)) & ((1 << (gap + 1)) - 1) for o, _ in way[at + 1 :]):
                return True
        return False

    forced = 0
    for gap in range(min(most_gap, room) + 1):
        forced += gap * counts.get(gap, 0)
        if forced > room - gap:  # what fits into the gap does not all fit beside it
            return
        if after and gap < after[0] or not sums[-1] >> (room - gap) & 1:
            continue
        for way in go(len(lengths) - 1, room - gap):
            if next(look, None) is None:
                return
            if not (after and gap == after[0] and way >= after[1]) and not dominated(gap, way):
                yield gap, way


def _completions(counts: dict[int, int], capacity: int, incumbent: int) -> list[tuple[Filling, int]] | None:
    """A packing with fewer sequences than incumbent, if the search finds one."""
    total = sum(n * c for n, c in counts.items())
    allowed = (incumbent - 1) * capacity - total
    if allowed < 0:
        return None
    left, remaining, made, nodes = dict(counts), sum(counts.values()), [], 0
    lengths, look = sorted(counts, reverse=True), iter(range(LOOKED))

    def following(waste: int, before: tuple[int, int, Filling] | None, last: tuple | None) -> tuple[Filling, int, int, tuple] | None:
        """The next (filling, times, waste, which) around the largest length left: once less of the last, or the next one.

        The first comes after the one before, if that was around the same length. What has been tried is known by the
        last alone, so that a deep search holds no more than its path.
        """
        if last and last[1] > 1:
            filling, times, wasted, which = last
            return filling, times - 1, wasted - which[1], which
        top = next(n for n in lengths if left[n])
        own = {n: c for n, c in left.items() if c}
        own[top] -= 1
        after = last[3][1:] if last else before[1:] if before and before[0] == top else None
        step = next(fillings(own, capacity - top, allowed - waste, look, after), None)
        if step is None:
            return None
        gap, way = step
        use = dict(way)
        use[top] = use.get(top, 0) + 1
        times = min(left[n] // c for n, c in use.items())
        if gap:
            times = min(times, (allowed - waste) // gap)
        return tuple(sorted(use.items(), reverse=True)), times, waste + times * gap, (top, gap, way)

    path: list[tuple[int, tuple | None, tuple | None]] = [(0, None, None)]
    while path and nodes < NODES:
        nodes += 1
        waste, before, last = path[-1]
        step = following(waste, before, last)
        if step is None:
            path.pop()
            if made:
                filling, times = made.pop()
                for n, c in filling:
                    left[n] += c * times
                    remaining += c * times
            continue
        path[-1] = (waste, before, step)
        filling, times, wasted, which = step
        for n, c in filling:
            left[n] -= c * times
            remaining -= c * times
        made.append((filling, times))
        if not remaining:
            return made
        path.append((wasted, which, None))
    return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Fillings with how many sequences have each; every piece of counts is in exactly one."""
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return []
    best = best_fit(counts, capacity)
    size, least = sum(t for _, t in best), lower_bound(counts, capacity)
    while size > least:
        better = _completions(counts, capacity, size)
        if better is None:
            break
        best, size = better, sum(t for _, t in better)
    return best


class Places:
    """(length, rank) -> (sequence, offset), from a plan."""

    def __init__(self, made: list[tuple[Filling, int]]):
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for filling, times in made:
            offset = 0
            for length, each in filling:
                first = used.get(length, 0)
                runs.setdefault(length, []).append((first, times, sequence, offset))
                used[length] = first + each * times
                offset += each * length
            sequence += times
        self.runs = {n: np.array(r, np.int64) for n, r in runs.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length).tolist():
            at, runs = np.nonzero(length == n)[0], self.runs[n]
            run = runs[np.searchsorted(runs[:, 0], rank[at], side="right") - 1]
            j = rank[at] - run[:, 0]
            sequence[at] = run[:, 2] + j % run[:, 1]
            offset[at] = run[:, 3] + j // run[:, 1] * n
        return sequence, offset


_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def _cut(path: str, end_id: int, capacity: int, with_ids: bool):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows: list[tuple] = []
                for doc_id, own in zip(part.column(0).to_pylist(), encoder(path).encode(part.column(1).to_pylist()), strict=True):
                    raw = own + end
                    n = len(raw) // 4
                    at, piece = 0, 0
                    while at < n:
                        size = capacity if piece or n % capacity == 0 else n % capacity
                        ids = raw[4 * at : 4 * (at + size)]
                        rows.append((doc_id, piece, at, size, zlib.crc32(ids), ids))
                        at, piece = at + size, piece + 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()][: 6 if with_ids else 5]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)],
                )

    return run


def _placed(places: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = places.find(length.astype(np.int64), rank)
            kept = [c for c in batch.schema.names if c != "rank"]
            arrays = [batch.column(c).cast(pa.int64()) if c == "length" else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece of every document.

    with_ids adds the piece's ids as little-endian unsigned 32-bit integers. A null text is empty and
    gives a piece of end_id alone; null ids and rows that repeat an id are documents like any other.
    Further columns are not read. An empty table gives no piece.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = _PIECES + (", ids binary" if with_ids else "")
    pieces = scratch.keep(plain.mapInArrow(_cut(tokenizer_path, end_id, capacity, with_ids), schema), "pieces")

    # ranks within a length in two steps, so that a length of a third of all pieces is many groups
    total = pieces.count()
    salts = max(64, total >> 18)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(salts)))
    groups = scratch.keep(salted.groupBy("length", "salt").count(), "groups")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = groups.select(
        "length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before")
    )
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = (
        salted.withColumn("place", F.row_number().over(order))
        .join(before, ["length", "salt"])
        .withColumn("rank", (F.col("before") + F.col("place") - 1).cast("long"))
    )
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return scratch.only(ranked.select(*columns, "rank").mapInArrow(_placed(Places(plan(counts, capacity))), out), "placed")
