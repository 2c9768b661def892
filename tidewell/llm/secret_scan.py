"""Secret scans: fixed patterns, and automata inferred from labelled credentials.

For each format, the labelled credentials make a prefix tree over character classes, whose states are
merged where their outgoing and ending frequencies agree within the Hoeffding bound (ALERGIA,
Carrasco and Oncina 1994), red states against blue ones, folding the subtrees together. The result is
a probabilistic automaton, whose classes spread their probability evenly over their characters; the letters that all
credentials of a format begin with are classes of their own. Strings that are no credentials (words, identifiers, slugs,
paths, dates, UUIDs, encoded data and so on) make automata in the same way, one for each kind.

A candidate is a run of credential characters outside the fixed patterns' spans, and each of its parts between "=", "/"
and ".". Its score is its run's log-likelihood with it in the best format and the rest in the best other kinds, less that of the
whole run in the best other kind, in nats.
Of overlapping candidates the one with the best score is taken. The least score that counts is calibrated on other strings
that the automata were not inferred from.

All labelled strings are made here by a seeded generator from public descriptions of the formats.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Callable, Iterator
from functools import cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.words import frugal

Span = tuple[str, int, int]

#: Kinds in the order that ties in start are listed.
KINDS = ("assign", "access", "hex", "grammar")
_ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Characters of the shortest candidate.
LEAST = 16
#: Of the calibration strings that are no credentials, the share that may score above the margin; nats added to it.
FALSE_SHARE, SLACK = 0.001, 2.0
UNREADABLE = -8.0
_ALPHA = 0.05

_LOW, _UP, _DIGITS, _HEXA = string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdef"
_ALNUM = _LOW + _UP + _DIGITS
#: Letters by how usual they are in words of Latin script: random strings have too many of the last.
_USUAL = ["aeiou", "tnshrdlcm", "bfgpvwyjkqxz"]
#: Classes that tell words from random characters, and those that do not tell letters and digits apart.
FINE = [*_USUAL, *map(str.upper, _USUAL), _DIGITS, *"+/_.=-"]
COARSE = [_ALNUM, *"+/_.=-"]


class Automaton:
    """A deterministic automaton with log-probabilities of characters and of ending."""

    def __init__(self, words: list[str], classes: list[str], alpha: float = _ALPHA):
        begin = set(commonprefix(words))
        classes = [c for c in ("".join(x for x in cs if x not in begin) for cs in classes) if c] + sorted(begin)
        class_of = {c: k for k, cs in enumerate(classes) for c in cs}
        count, final, child = [0], [0], [{}]
        for word in words:
            at = 0
            count[0] += 1
            for c in word:
                k = class_of[c]
                if k not in child[at]:
                    child[at][k] = len(count)
                    count.append(0)
                    final.append(0)
                    child.append({})
                at = child[at][k]
                count[at] += 1
            final[at] += 1
        arrivals = {(s, k): count[t] for s, ks in enumerate(child) for k, t in ks.items()}
        bound = math.sqrt(0.5 * math.log(2 / alpha))

        def differ(a: int, n: int, b: int, m: int) -> bool:
            return bool(n and m) and abs(a / n - b / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

        def compatible(a: int, b: int) -> bool:
            todo = [(a, b)]
            while todo:
                x, y = todo.pop()
                if differ(final[x], count[x], final[y], count[y]):
                    return False
                for k in child[x].keys() | child[y].keys():
                    if differ(arrivals.get((x, k), 0), count[x], arrivals.get((y, k), 0), count[y]):
                        return False
                    if k in child[x] and k in child[y]:
                        todo.append((child[x][k], child[y][k]))
            return True

        def fold(a: int, b: int) -> None:
            todo = [(a, b)]
            while todo:
                x, y = todo.pop()
                count[x] += count[y]
                final[x] += final[y]
                for k, t in child[y].items():
                    arrivals[x, k] = arrivals.get((x, k), 0) + arrivals[y, k]
                    if k in child[x]:
                        if child[x][k] != t:
                            todo.append((child[x][k], t))
                    else:
                        child[x][k] = t

        red = [0]
        while True:
            blue = next(((s, k, t) for s in red for k, t in sorted(child[s].items()) if t not in red), None)
            if blue is None:
                break
            source, k, t = blue
            for r in red:
                if compatible(r, t):
                    child[source][k] = r
                    fold(r, t)
                    break
            else:
                red.append(t)
        number = {s: i for i, s in enumerate(red)}
        self.least = min(map(len, words))
        self.width = math.log(max(len(cs) for cs in classes))
        self.steps = [
            {c: (number[t], math.log(arrivals[s, k] / count[s]) - math.log(len(classes[k]))) for k, t in child[s].items() for c in classes[k]} for s in red
        ]
        self.ends = [max(math.log(final[s] / count[s]), UNREADABLE) if final[s] else UNREADABLE for s in red]

    def log_likelihood(self, word: str, whole: bool = True) -> float:
        """A character or an end that a state has no way for costs UNREADABLE and leaves the state as it is.

        So does each character that a whole word is short of the shortest labelled one. What is not whole may end anywhere.
        """
        steps, at, lost = self.steps, 0, UNREADABLE - self.width
        total = UNREADABLE * max(0, self.least - len(word)) if whole else 0.0
        for c in word:
            step = steps[at].get(c)
            if step is None:
                total += lost
            else:
                at = step[0]
                total += step[1]
        return total + self.ends[at] if whole else total


#: Everyday words that identifiers, slugs and paths are made of.
WORDS = """about access account action address admin after agent alert all api app apply archive array article asset async audit auth author
back base batch best block board body book branch build button cache call campaign case category change chapter check child city class clean client
cloud code color column comment common company config connect content context control copy core count country course create custom customer daily data
date day debug default delete demo deploy design detail dev device docs document domain down download draft edit editor element email empty end engine
entry error event every example export factory family feature field file filter final find first flow folder food form format from full function
game garden get global good great group guide handler have head health help history home host house how html http image import index info init input
""".split()


def _words(r: random.Random) -> Callable[[], str]:
    """Everyday words, and others of syllables."""

    def syllable() -> str:
        return r.choice("b c d f g h k l m n p r s t v w tr st ch sh pl gr qu".split()) + r.choice("a e i o u ea ou io a e i o".split()) + r.choice(["", "", "n", "r", "s", "l", "t", "nd", "x"])

    return lambda: r.choice(WORDS) if r.random() < 0.6 else "".join(syllable() for _ in range(r.randint(1, 4)))


def labelled_credentials(seed: int = 11, each: int = 400) -> dict[str, tuple[list[str], list[str]]]:
    """Made-up credentials by format, and the format's classes."""
    r = random.Random(seed)

    def some(chars: str, n: int) -> str:
        return "".join(r.choices(chars, k=n))

    coarse_digits = [_LOW + _UP, _DIGITS, *"+/_.=-"]
    made: dict[str, tuple[Callable[[], str], list[str]]] = {
        "access key": (lambda: "AKIA" + some(_UP + "234567", 16), [_UP + _DIGITS]),
        "chat token": (lambda: "xox" + r.choice("bpas") + "-" + some(_DIGITS, 12) + "-" + some(_DIGITS, 12) + "-" + some(_ALNUM, 24), coarse_digits),
        "map key": (lambda: "AIza" + some(_ALNUM + "_-", 35), [_ALNUM + "_-"]),
        "web token": (lambda: "eyJ" + some(_ALNUM, r.randint(20, 40)) + ".eyJ" + some(_ALNUM, r.randint(30, 80)) + "." + some(_ALNUM + "_-", 43), [_ALNUM + "_-", "."]),
        "base64 secret": (lambda: some(_ALNUM + "+/", 40), [_ALNUM, "+/"]),
        "mixed letters": (lambda: some(_LOW + _UP, r.randint(20, 64)), FINE),
        "small letters": (lambda: some(_LOW, r.randint(24, 64)), FINE),
        "capital letters": (lambda: some(_UP, r.randint(24, 64)), FINE),
        "letters and digits": (lambda: some(_ALNUM, r.randint(20, 64)), FINE),
        "small letters and digits": (lambda: some(_LOW + _DIGITS, r.randint(20, 64)), FINE),
        "capital letters and digits": (lambda: some(_UP + _DIGITS, r.randint(20, 48)), FINE),
        "letters, digits and marks": (lambda: some(_ALNUM + "_-", r.randint(24, 64)), FINE),
    }
    for begin in ("ghp_", "gho_", "ghs_"):
        made[f"repository token {begin}"] = (lambda begin=begin: begin + some(_ALNUM, 36), COARSE)
    for begin in ("sk_live_", "rk_live_", "sk_test_"):
        made[f"payment key {begin}"] = (lambda begin=begin: begin + some(_ALNUM, r.choice([24, 32])), COARSE)
    return {name: ([make() for _ in range(each)], classes) for name, (make, classes) in made.items()}


def other_strings(seed: int = 12, each: int = 1000) -> dict[str, tuple[list[str], list[str]]]:
    """Strings that are no credentials, by kind, and the kind's classes. All have LEAST characters or more."""
    r = random.Random(seed)
    word = _words(r)

    def some(chars: str, n: int) -> str:
        return "".join(r.choices(chars, k=n))

    def number(n: int = 4) -> str:
        return some(_DIGITS, r.randint(1, n))

    def several(least: int, most: int) -> list[str]:
        return [word() for _ in range(r.randint(least, most))]

    def spelled(parts: list[str]) -> str:
        joined = r.choice(["", "", "_", "-"]).join(parts)
        return r.choice([joined, joined.upper(), joined.capitalize()])

    def identifier() -> str:
        parts = [p.capitalize() if r.random() < 0.93 else p[:3].upper() for p in several(2, 6)]
        if r.random() < 0.5:
            parts[0] = parts[0].lower()
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            parts.insert(r.randint(1, len(parts)), number(3))
        return r.choice(["", "", "", "", "."]).join(parts)

    def slug() -> str:
        parts = several(3, 9)
        if r.random() < 0.5:
            parts.insert(r.randint(0, len(parts)), number())
        return "-".join(p.capitalize() if r.random() < 0.1 else p for p in parts)

    def host() -> str:
        return ".".join([*r.choice([["www"], ["www"], [], [word()]]), "-".join(several(1, 2)), r.choice("com org net io gov edu co.uk de fr es".split())])

    def date() -> str:
        return f"{r.randint(1990, 2035)}{(m := r.choice('-/._') if r.random() < 0.9 else '')}{r.randint(1, 12):02d}{m}{r.randint(1, 28):02d}"

    def part() -> str:
        return r.choice([word, word, slug, identifier, date, number, lambda: "_".join(several(1, 4)), lambda: f"v{number(1)}"])()

    def path() -> str:
        ending = r.choice(["", "", *(f".{e}" for e in "py js html txt csv json png jpg pdf tar.gz parquet java cpp md php".split())])
        return r.choice(["/", "/", "", host() + "/", "//" + host() + "/"]) + "/".join(part() for _ in range(r.randint(2, 7))) + ending + r.choice(["", "", "", "/"])

    def stamp() -> str:
        return date() + r.choice(["T", "-", "_", "."]) + r.choice([f"{some(_DIGITS, 6)}Z", some(_DIGITS, 6), f"{some(_DIGITS, 2)}-{some(_DIGITS, 2)}-{some(_DIGITS, 2)}.{some(_DIGITS, 3)}"])

    def padded(raw: str) -> str:
        return raw + r.choice(["", "=", "=="])

    made: dict[str, tuple[Callable[[], str], list[str]]] = {
        "words": (lambda: spelled(several(2, 5)), FINE),
        "identifiers": (identifier, FINE),
        "names with underscores": (lambda: r.choice([str, str.upper])("_".join([*several(2, 6), *r.choice([[], [], [number()]])])), FINE),
        "slugs": (slug, FINE),
        "hosts": (host, FINE),
        "paths": (path, FINE),
        "files": (lambda: r.choice(["-", "_", "."]).join([*several(1, 4), r.choice([date(), number(8), word()])]) + "." + word()[:4], FINE),
        "assignments": (lambda: "=".join(["_".join(several(1, 2)), r.choice([word, identifier, number, path])()]), FINE),
        "dates": (stamp, FINE),
        "numbers": (lambda: r.choice(["", "", ".", "-", "/", "_", "="]).join(some(_DIGITS, r.randint(1, 12)) for _ in range(r.randint(2, 8))), [_DIGITS, *"./-_=+"]),
        "versions": (lambda: "-".join(several(1, 3)) + r.choice("-_") + ".".join(number(2) for _ in range(r.randint(2, 4))) + r.choice(["", "-beta" + number(1), "." + number(5)]), FINE),
        "rules": (lambda: r.choice("=-_./+") * r.randint(LEAST, 100), [_ALNUM, *"=-_./+"]),
        "UUIDs": (lambda: "-".join(some(_HEXA, n) for n in (8, 4, 4, 4, 12)), [_HEXA, "-"]),
        "capital UUIDs": (lambda: "-".join(some(_HEXA.upper(), n) for n in (8, 4, 4, 4, 12)), [_HEXA.upper(), "-"]),
        "labelled UUIDs": (lambda: word() + r.choice("-_/=.") + "-".join(some(_HEXA, n) for n in (8, 4, 4, 4, 12)), [_HEXA, "ghijklmnopqrstuvwxyz", "-", *"_/=."]),
        "hexadecimal numbers": (lambda: r.choice(["", "0x", "x"]) + some(_HEXA, r.choice([16, 20, 24, 28, 31])), [_HEXA, "x"]),
        "integrity hashes": (lambda: r.choice(["sha256-", "sha512-"])[:7] + padded(some(_ALNUM + "+/", 43)), [_ALNUM + "+/", "-", "="]),
        "encoded data": (lambda: padded(some(_ALNUM + "+/", r.randint(120, 900))), [_ALNUM + "+/", "="]),
        "repeated characters": (lambda: r.choice(_ALNUM) * r.randint(LEAST, 64), list(_ALNUM)),
    }
    out: dict[str, tuple[list[str], list[str]]] = {}
    for name, (make, classes) in made.items():
        known, words = set("".join(classes)), []
        while len(words) < (each if classes is FINE or len(classes) > len(FINE) else each // 3):
            w = make()
            if len(w) >= LEAST and known.issuperset(w):
                words.append(w)
        out[name] = (words, classes)
    return out


class Formats:
    """The inferred automata, and the least score of a credential."""

    def __init__(self):
        self.formats = {name: Automaton(*labelled) for name, labelled in labelled_credentials().items()}
        self.others = {name: Automaton(*labelled) for name, labelled in other_strings().items()}
        unseen = [w for words, _ in other_strings(seed=13, each=400).values() for w in words]
        scores = sorted(max(self.score(w, a, b) for a, b in _parts(w)) for w in unseen)
        self.margin = scores[int(len(scores) * (1 - FALSE_SHARE))] + SLACK

    def _other(self, word: str, whole: bool) -> float:
        return max(a.log_likelihood(word, whole) for a in self.others.values()) if word else 0.0

    def score(self, run: str, start: int = 0, end: int | None = None) -> float:
        """How much likelier the run is with a credential from start to end and other strings around it than without."""
        end = len(run) if end is None else end
        own = max(a.log_likelihood(run[start:end]) for a in self.formats.values())
        return self._other(run[:start], False) + own + self._other(run[end:], False) - self._other(run, True)


@cache
def learned() -> Formats:
    """Inferred once for each process; the driver sends its own to the workers."""
    return Formats()


def _parts(run: str) -> list[tuple[int, int]]:
    """Where the parts of a run between marks are that are long enough, the run itself first."""
    found, now = {}, [(0, len(run))]
    for mark in ("", "=", "/", "."):
        after = []
        for a, b in now:
            at = a
            for piece in run[a:b].split(mark) if mark else [run[a:b]]:
                bare = piece.strip(".=/-_+")
                if len(bare) >= LEAST:
                    start = at + piece.index(bare)
                    found[start, start + len(bare)] = None
                    after.append((at, at + len(piece)))
                at += len(piece) + 1
        now = after
    return list(found) or [(0, len(run))]


def base_spans(text: str) -> list[Span]:
    low = text.lower()
    found: list[Span] = []
    if any(k in low for k in _KEYWORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def grammar_spans(text: str, known: list[Span], formats: Formats | None = None) -> list[Span]:
    """Candidates outside the known spans that read as a credential of some format."""
    formats = formats or learned()
    found: list[Span] = []
    for m in _CANDIDATE.finditer(text):
        at, runs = m.start(), []
        for x, y in sorted((x, y) for _, x, y in known if x < m.end() and y > m.start()):
            runs.append((at, x))
            at = max(at, y)
        for a, b in [*runs, (at, m.end())]:
            if b - a < LEAST:
                continue
            scored = sorted((-formats.score(text[a:b], i, j), a + i, a + j) for i, j in _parts(text[a:b]) if j - i >= LEAST)
            taken: list[Span] = []
            for score, i, j in scored:
                if -score >= formats.margin and all(j <= x or y <= i for _, x, y in taken):
                    taken.append(("grammar", i, j))
            found += sorted(taken)
    return found


def spans(text: str | None, formats: Formats | None = None) -> list[Span]:
    """All spans of a text by start, then kind; code points, end exclusive."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + grammar_spans(text, base, formats), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(id_name: str, formats: Formats):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t, formats)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW_SPANS)], names=[id_name, "spans"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row: the kind, start and end of each secret in the whole text.

    A null text has none. Null or repeated ids are rows like any other; further columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(_scan(id_col, learned()), f"`{id_col}` {kind}, spans {_SPANS}")


def redacted(text: str | None, mark: str = "<SECRET>", formats: Formats | None = None) -> str | None:
    """text with its secrets replaced; overlapping spans are replaced as one. An assignment keeps its name."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in spans(text, formats):
        if kind == "assign":
            a = a + _ASSIGN.match(text, a).start(2) - a
        if b <= at:
            continue
        out += [text[at : max(a, at)], mark if a >= at else ""]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the secrets in text replaced; other columns, rows and null texts as they were."""
    formats = learned()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            clean = pa.array([redacted(t, formats=formats) for t in batch.column(i).to_pylist()], pa.string())
            yield batch.set_column(i, text_col, clean)

    return docs.mapInArrow(run, docs.schema)
