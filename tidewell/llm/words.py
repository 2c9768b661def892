"""Words, shingles and their 64-bit hashes, in numpy.

A word is a run of code points other than space and U+0009..U+000D; in UTF-8 those
are single bytes, which is what bytes.split() splits on. bytes.lower() changes A-Z
and nothing else.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
_STEPS = [np.uint64(0x9E3779B97F4A7C15 * i & 0xFFFFFFFFFFFFFFFF) for i in range(1, 65)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> _SHIFT)
    x = x * _M1
    x = x ^ (x >> _SHIFT)
    x = x * _M2
    return x ^ (x >> _SHIFT)


def spare_memory() -> None:
    """Let go of the encoders that an earlier stage may have left in this worker."""
    if tokens := sys.modules.get("tidewell.llm.tokens"):
        tokens.release()


def give_back() -> None:
    """Hand what nothing uses any more back to the system, from Arrow's pool and from the C library's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, without what an earlier stage left in its worker; a worker outlives its tasks, and idle it holds no more than it needs."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def word_list(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def lower_word_list(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n consecutive word hashes, in order; none if there are fewer. n is 64 at most."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = mix(out + h[i : i + m] + _STEPS[i])
    return out


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of n-word shingles of the lower-cased text.

    With fewer than n words the whole sequence is the only shingle; without words the set is empty.
    """
    h = word_hashes(lower_word_list(text))
    if not len(h):
        return h
    return np.unique(window_hashes(h, min(n, len(h))) + np.uint64(max(0, n - len(h))))
