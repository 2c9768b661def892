"""Token ids of whole texts, by the tokenizers library.

A byte-level BPE that splits its input by the GPT-2 pattern, with no normaliser and no prefix
space, never joins characters across a space that stands between two other than white
characters: the pattern starts a new piece at such a space whatever came before. The pieces
between those spaces are therefore encoded once and remembered, up to a number of bytes; any other tokenizer gets the
whole text each time. Unknown pieces go to the library as texts of many, joined by such spaces, and
the ids of each are found again by the number of bytes that every id stands for.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import os
import re
from array import array
from collections.abc import Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: Bytes of pieces and ids that a worker remembers; a look-up takes about as much again while it runs.
REMEMBERED_BYTES = 24 << 20
#: Code points that are looked up at once. A longer text is cut at a gap.
GROUP_POINTS = 1 << 22
#: Unknown pieces that are joined into one text.
JOINED = 128
_GAP = re.compile(r"(?<=\S) (?=\S)")
_OPEN: dict[str, "Encoder"] = {}


class _Memory:
    """Pieces and their ids in flat arrays. Beyond the limit, those go that were not asked for the longest."""

    def __init__(self, limit: int):
        self.limit, self.turn = limit, 0
        self.words = pa.array([], pa.large_string())
        self.lengths, self.used = np.empty(0, np.int64), np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint32)

    def find(self, pieces: pa.LargeStringArray) -> np.ndarray:
        """The place of each piece, -1 for an unknown one."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.words), -1).to_numpy()
        self.turn += 1
        self.used[at[at >= 0]] = self.turn
        return at

    def learn(self, words: pa.LargeStringArray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Add distinct unknown pieces; ids has those of each, one after the other."""
        self.words = pa.concat_arrays([self.words, words])
        self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
        self.used = np.concatenate([self.used, np.full(len(words), self.turn, np.int32)])
        if self.words.nbytes + self.ids.nbytes + 12 * len(self.used) > self.limit:
            keep = np.zeros(len(self.used), bool)
            keep[np.argsort(self.used, kind="stable")[len(self.used) // 2 :]] = True
            self.ids = self.ids[np.repeat(keep, self.lengths)]
            self.words, self.lengths, self.used = self.words.filter(pa.array(keep)), self.lengths[keep], self.used[keep]


def _cut(text: str, most: int) -> list[str]:
    """text in parts of about `most` code points that begin at a gap; a part without one is longer."""
    out, at = [], 0
    while len(text) - at > most and (m := _GAP.search(text, at + most)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class Encoder:
    """Texts to little-endian unsigned 32-bit ids. Strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        split = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            spec.get("normalizer") is None
            and spec["model"].get("type") == "BPE"
            and split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space")
            and split.get("use_regex", True)
        )
        if self.by_piece:
            self.tokenizer.model._resize_cache(0)  # it would be asked for no piece twice
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each id; in a byte-level vocabulary every letter is one byte.
        self.n_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        self.memory = _Memory(REMEMBERED_BYTES)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has with a space before it, and these ids. Every piece starts with a character that is not white."""
        ids = np.frombuffer(b"".join(self._ids([" " + " ".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)])), np.uint32)
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)) + 1)
        upto = np.cumsum(self.n_bytes[ids])
        last = np.searchsorted(upto, ends)
        if len(pieces) and not np.array_equal(upto.take(last, mode="clip"), ends):  # ids that do not stand for their bytes
            each = self._ids([" " + p for p in pieces])
            return np.array([len(e) // 4 for e in each]), np.frombuffer(b"".join(each), np.uint32)
        return np.diff(last, prepend=-1), ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null is empty."""
        if not self.by_piece:
            return self._ids([t or "" for t in texts])
        return self._by_group(texts)

    def _by_group(self, texts: list[str | None]) -> list[bytes]:
        """Groups of about GROUP_POINTS code points, whatever the texts' lengths."""
        out: list[bytes] = []
        group, points = [], 0
        for text in texts:
            if text and len(text) > GROUP_POINTS:
                out += self._by_piece(group)
                out.append(b"".join(self._by_piece([part])[0] for part in _cut(text, GROUP_POINTS)))
                group, points = [], 0
                continue
            group.append(text)
            points += len(text or "")
            if points > GROUP_POINTS:
                out += self._by_piece(group)
                group, points = [], 0
        return out + self._by_piece(group)

    def _laid_out(self, pieces: pa.LargeStringArray, bounds: np.ndarray, certain: bool) -> tuple[list[bytes], np.ndarray]:
        """The ids of the pieces, each with a space before it, from each bound to the next, and where this is not sure.

        A space beside white space is no gap: pieces that are empty, or begin or end with white space, make
        their part unsure, unless the pieces are certain to stand between gaps.
        """
        at = self.memory.find(pieces)
        missing = at < 0
        new = pieces.filter(pa.array(missing)).dictionary_encode()
        names = new.dictionary.to_numpy(zero_copy_only=False).tolist()
        sound = np.fromiter((certain or bool(p) and not (p[0].isspace() or p[-1].isspace()) for p in names), bool, len(names))
        lengths = np.zeros(len(names), np.int64)
        lengths[sound], ids = self._spaced_ids([p for p, ok in zip(names, sound, strict=True) if ok])
        which = at.astype(np.int64)
        which[missing] = len(self.memory.lengths) + new.indices.to_numpy()
        unsure = np.concatenate([[0], np.cumsum((~sound)[new.indices.to_numpy()])])[np.concatenate([[0], np.cumsum(missing)])[bounds]]

        all_lengths, all_ids = np.concatenate([self.memory.lengths, lengths]), np.concatenate([self.memory.ids, ids])
        starts, each = np.cumsum(all_lengths) - all_lengths, all_lengths[which]
        upto = np.concatenate([[0], np.cumsum(each)])
        laid = all_ids[np.repeat(starts[which] - upto[:-1], each) + np.arange(upto[-1])].tobytes()
        cuts = (4 * upto[bounds]).tolist()
        self.memory.learn(new.dictionary.filter(pa.array(sound)), lengths[sound], ids)
        return [laid[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], np.diff(unsure) > 0

    def _by_piece(self, texts: list[str | None]) -> list[bytes]:
        """Each piece is looked up, and their ids are laid out for all texts at once."""
        if not texts:
            return []
        split = pc.split_pattern(pa.array([t or "" for t in texts], pa.large_string()), " ")
        ends = split.offsets.to_numpy()  # the first piece of a text, its head, has no space before it
        inner = np.ones(len(split.values), bool)
        inner[ends[:-1]] = False
        heads = split.values.take(pa.array(ends[:-1])).to_pylist()
        own, unsure = self._laid_out(split.values.filter(pa.array(inner)), ends - np.arange(len(ends)), certain=False)
        out = [head + ids for head, ids in zip(self._ids(heads), own, strict=True)]
        ragged = np.flatnonzero(unsure | np.array([h[-1:].isspace() for h in heads])).tolist()
        if ragged:
            for i, ids in zip(ragged, self._at_gaps([texts[i] for i in ragged]), strict=True):
                out[i] = ids
        return out

    def _at_gaps(self, texts: list[str]) -> list[bytes]:
        """Texts in which some space may be beside other white space."""
        pieces = [_GAP.split(t) for t in texts]
        # what follows the last gap may end with white space
        ends = self._ids([p[0] for p in pieces] + [" " + p[-1] if len(p) > 1 else "" for p in pieces])
        inner = [p[1:-1] for p in pieces]
        bounds = np.cumsum([0, *map(len, inner)])
        own, _ = self._laid_out(pa.array([x for p in inner for x in p], pa.large_string()), bounds, certain=True)
        return [a + b + c for a, b, c in zip(ends[: len(texts)], own, ends[len(texts) :], strict=True)]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """batch in parts whose texts have about GROUP_POINTS bytes, one row at least."""
    upto, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + GROUP_POINTS, side="right")))
        yield batch.slice(at, to - at)
        at = to


def encoder(path: str) -> Encoder:
    """One for each path and Python worker."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def release() -> None:
    """Forget the encoders of this worker, with all that they remember."""
    if _OPEN:
        _OPEN.clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has it
            ctypes.CDLL(None).malloc_trim(0)
