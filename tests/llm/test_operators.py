"""Each operator against a brute-force version, a round trip or held-out accuracy, and on odd tables."""

import base64
import hashlib
import math
import random
import re
import string
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import catalog, chat_format, classes, embedding_dedup, language_id, line_rules, mixing, near_dedup, packing, quality_model, secret_scan, token_files, tokens, words
from tidewell.llm.components import components
from tidewell.llm.scratch import Scratch, ScratchError, collected, shared_root
from tidewell.llm.tokens import encoder
from tidewell.llm.words import lower_word_list, shingle_set

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, rep long, size long, token string, band long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30000))
ODD = [
    (1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", None, 3), (5, "one two", "fr", "a", 7), (5, "one two", "fr", "a", 7),
    (6, LONG, "en", "b", len(LONG)), (7, LONG + " more", "en", "b", 1), (None, "null id text here", "en", "b", 5), (None, None, None, None, None),
    (8, "same words in the same order again and again here now", "en", "a", 1), (9, "Same words in the same order again and again here now", "en", "c", 1), (5, "other text under one id", "fr", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 0, 0, "t", 0) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def reach(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_components(texts, words=3, percent=85):
    sets = {i: set(shingle_set(t, words).tolist()) for i, t in texts.items()}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return reach(sets, links)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150)] + [(300, 300 + i) for i in range(1, 50)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    want = reach({x for e in edges for x in e}, edges)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_near_dedup_against_all_pairs(spark, texts):
    rng = random.Random(5)
    some = dict(list(texts.items())[:60])
    base = [f"v{rng.randrange(10**6)}" for _ in range(150)]
    for i in range(60):  # a group around one text, whose members are just above or below the similarity
        own = list(base)
        for _ in range(rng.choice([1, 3, 4, 5, 8])):
            own[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        some[10_000 + i] = " ".join(own)
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    for words, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, words=words, percent=percent).collect()}
        assert got == brute_components(some, words, percent)


def test_near_dedup_in_small_blocks(spark, texts, monkeypatch):
    """Hot classes over salts and hot shingles in blocks give what all pairs give."""
    monkeypatch.setattr(classes, "HOT_ROWS", 3)
    monkeypatch.setattr(near_dedup, "PAIR_BLOCK", 4)
    rng = random.Random(9)
    base = [f"v{rng.randrange(10**6)}" for _ in range(60)]
    some = {i: " ".join(base[: 30 + i % 7]) for i in range(40)}
    for i in range(40, 90):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3, 9])):
            own[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        some[i] = " ".join(own)
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    rows = near_dedup.near_duplicates(df, words=3, percent=85, bands=6).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute_components(some)


def test_near_dedup_of_odd_rows(odd):
    rows = near_dedup.near_duplicates(odd, words=3, percent=85).collect()
    assert len(rows) == len(ODD)
    by = {(r.doc_id, r.n_shingles): r for r in rows}
    assert by[2, 0].kept and by[1, 0].kept and by[9, 9].component_id == 8 and not by[9, 9].kept and by[7, len(set(shingle_set(LONG + " more", 3)))].component_id == 6
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id is null").count() == 2
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    sketcher = near_dedup.Sketcher()
    sig = sketcher.densified(*sketcher.one_permutation([np.unique(pool[:300]), np.unique(pool[100:]), np.unique(pool[:7])]))
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.15 and set(sig[2]) <= set(sketcher.one_permutation([np.unique(pool[:7])])[0][0])


def test_language_of_held_out_documents(spark, docs):
    model = language_id.train(docs.filter(~catalog.held_out()))
    rows = language_id.identify(docs, model).join(docs.select("doc_id", "lang", catalog.held_out().alias("h")), "doc_id").filter("h").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, odd):
    model = language_id.train(odd)
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == len(ODD)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in language_id.identify(odd, language_id.train(odd.limit(0))).collect()} == {"und"}


def test_language_against_dictionaries(docs, texts):
    """The matrix product gives what naive Bayes with plain dictionaries gives."""
    rows = [(r.lang, r.text) for r in docs.filter("text is not null and lang is not null").limit(60).collect()]

    def buckets(text):
        out = Counter()
        points = [ord(c) for c in text.lower()]
        for i in range(len(points)):
            h = 0
            for n, c in enumerate(points[i : i + language_id.MAX_N], 1):
                h = (h * 0x01000193 ^ (c + n)) & 0xFFFFFFFF
                x = h * language_id._TURN & 0xFFFFFFFF
                out[((x ^ x >> 15) * language_id._TURN & 0xFFFFFFFF) >> 32 - language_id.BITS] += 1
        return out

    counts, many = {}, Counter(x for x, _ in rows)
    for x, t in rows:
        counts.setdefault(x, Counter()).update(buckets(t))
    spark = docs.sparkSession
    model = language_id.train(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string"))
    assert model.names == sorted(many)
    some = [t for _, t in rows[:8]] + ["Ab", "x", "  ", LONG]
    got = model.scores(some)
    for text, own in zip(some, got, strict=True):
        for name, score in zip(model.names, own, strict=True):
            total = sum(counts[name].values()) + 0.5 * (1 << language_id.BITS)
            want = math.log(many[name] / len(rows)) + sum(n * math.log((counts[name][b] + 0.5) / total) for b, n in buckets(text).items())
            assert math.isclose(score, want, rel_tol=1e-5)


def test_long_texts_are_sliced_exactly(monkeypatch):
    whole = Counter(language_id.grams(language_id._points(LONG)).tolist())
    monkeypatch.setattr(language_id, "_SLICE", 1000)
    assert sum((Counter(b.tolist()) for b in language_id._sliced(language_id._points(LONG))), Counter()) == whole


def test_every_language_is_learned(spark):
    """Three hundred languages of alphabets of their own, one with a single text, one with two thirds of all."""
    rng = random.Random(8)
    rows = []
    for k in range(300):
        letters = [chr(0x4E00 + 20 * k + i) for i in range(20)]
        rows += [(f"l{k:03d}", "".join(rng.choices(letters, k=30))) for _ in range(1 if k == 299 else 1000 if k == 0 else 2)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    model = language_id.train(df, train_docs=50)
    assert len(model.names) == 300
    got = language_id.identify(df, model).join(df, "doc_id").filter("lang <> lang_pred").count()
    assert got == 0


def sizes_of(texts):
    return {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}


def test_mix_comes_near_its_targets(spark, docs, texts):
    for shard_words in (mixing.SHARD_WORDS, 500):
        rows = mixing.mix(docs, shard_words=shard_words).join(docs.select("doc_id", "source"), "doc_id").collect()
        size = sizes_of(texts)
        assert {r.doc_id: r["size"] for r in rows} == size and all(0 <= r.taken <= 3 * r["size"] for r in rows)
        taken, target = Counter(), {}
        for r in rows:
            taken[r.source] += r.taken
            target[r.source] = r.target
        assert abs(sum(target.values()) - sum(size.values())) < 1e-3
        assert all(abs(taken[s] - t) <= 0.02 * t + 10 for s, t in target.items())


def test_mixed_documents_keep_the_quotas(spark, docs, texts):
    """Whole documents of a source hold its taken words but for about one document."""
    size = sizes_of(texts)
    taken = {r.source: r.taken for r in mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    got, copies, longest = Counter(), Counter(), Counter()
    of = {r.doc_id: r.source for r in docs.collect()}
    for r in mixing.mixed_documents(docs).collect():
        got[r.source] += size[r.doc_id]
        copies[r.doc_id] += 1
    for i, s in of.items():
        longest[s] = max(longest[s], size[i])
    assert max(copies.values()) <= 3
    assert all(abs(got[s] - t) <= longest[s] for s, t in taken.items())


def test_targets_against_water_filling(spark):
    rng = random.Random(6)
    for n in (1, 2, 7, 40):
        z = [rng.choice([0, 1, 30, 10**6, 10**9]) * rng.randint(1, 9) for _ in range(n)]
        df = spark.createDataFrame([(f"s{i:03d}", v) for i, v in enumerate(z)] + [(None, 5)], "source string, size long")
        z.append(5)
        got = [r.target for r in mixing.targets(df, (1, 2, 3), 3, Scratch(spark, "t")).orderBy("s").collect()]
        low, high = 0.0, 1e12
        for _ in range(300):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(3 * v, (i % 3 + 1) * mid) for i, v in enumerate(z)) < sum(z) else (low, mid)
        assert all(math.isclose(g, min(3 * v, (i % 3 + 1) * high), rel_tol=1e-6, abs_tol=1e-3) for i, (g, v) in enumerate(zip(got, z, strict=True)))


def test_sainte_lague_against_highest_quotients(spark):
    rng = random.Random(2)
    for seats in (0, 7, 100, 1003):
        votes = [rng.choice([0, 1, 5, 40, 1000]) * rng.random() for _ in range(30)]
        caps = [rng.choice([5, 60, 10**6]) for _ in votes]
        df = spark.createDataFrame([(0, i, v, seats, c) for i, (v, c) in enumerate(zip(votes, caps, strict=True))], "g int, p int, v double, seats long, cap long")
        free = df.withColumn("cap", df.cap * 0 + 10**6)
        got = [r.quota for r in mixing.sainte_lague(free, "g", "p", "v", "seats", "cap", 2, Scratch(spark, "t")).orderBy("p").collect()]
        quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(seats)))[:seats]
        assert got == [Counter(i for _, i in quotients)[i] for i in range(30)]


def test_mix_of_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 3 * r["size"] for r in rows)
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and 0 < mixed.count() <= 3 * len(ODD)
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mix(odd.filter("text is null")).filter("taken > 0").count() == 0


def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16))
    x[300:420] = x[0] + 0.05 * rng.standard_normal((120, 16))
    x[420:560] = x[5] + 0.35 * rng.standard_normal((140, 16))
    x[600:620] = x[1]
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None]), (1004, [1.0, 2.0]), (1005, [2.0, 4.0]), (1006, [])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, rep string")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    n = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.outer(n, n) >= 0.9
    np.fill_diagonal(near, False)
    want = reach(range(900), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    assert len(got) == len(rows)
    assert sum(got[i].n_links for i in range(900)) == near.sum() and {i: got[i].component_id for i in range(900)} == want
    assert all(got[i].n_links == 0 and got[i].kept for i in (1000, 1001, 1002, 1003, 1006)) and got[1005].component_id == 1004
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def dense_cone(n=24000, in_cone=8000, dim=64, planted=400):
    """A third of all vectors mutually at about 0.85, and pairs at 0.902 within it with far apart ids."""
    rng = np.random.default_rng(11)

    def unit(v):
        return v / np.linalg.norm(v, axis=-1, keepdims=True)

    x = unit(rng.standard_normal((n, dim)))
    axis = unit(rng.standard_normal(dim))
    side = rng.standard_normal((in_cone, dim))
    side = unit(side - (side @ axis)[:, None] * axis)
    x[:in_cone] = math.sqrt(0.8) * axis + math.sqrt(0.2) * side
    for i in range(planted):
        a, b = x[i], rng.standard_normal(dim)
        b = unit(b - (b @ a) * a)
        x[in_cone - 1 - i] = 0.902 * a + math.sqrt(1 - 0.902**2) * b
    return x


@pytest.mark.parametrize("window", [embedding_dedup.WINDOW, 64])
def test_near_vectors_in_a_dense_cone(spark, window):
    x = dense_cone()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df, window=window).collect()}
    near = np.triu(embedding_dedup.cosines(x, x) >= 0.9, 1)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)]
    assert len(links) >= 400
    assert {i: r.component_id for i, r in got.items()} == reach(range(len(x)), links)
    assert sum(r.n_links for r in got.values()) == 2 * len(links)


def test_passes_follow_measured_runs():
    together = embedding_dedup.kept_together(64, 0.9)
    spread, cone = [128.0**-k for k in range(9)], [0.9 * 128.0**-k + 0.1 * 0.4**k for k in range(9)]
    assert embedding_dedup.least_work(5000, spread, together) == (1, 0)
    many, few = embedding_dedup.least_work(10**7, cone, together), embedding_dedup.least_work(10**7, spread, together)
    assert many[1] > few[1] > 0 and many[0] > few[0]
    assert all(1 - (1 - together**k) ** t >= 0.9999 for t, k in (many, few))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500))
def test_codes_round_trip(ids):
    codes = token_files.Codes(token_files.pack_codes(np.array(ids, np.uint32)))
    assert codes.all().tolist() == ids
    for i in range(0, len(ids), 97):
        assert codes[i] == ids[i]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab'sé中1 \n\t\r.,!<|>\x1c\x85 ", max_size=60), max_size=4))
def test_encoder_equals_the_whole_text(some):
    e = encoder(PATH)
    assert e.encode(some) == e._ids(some)


def test_encoder_forgets_and_cuts(texts, monkeypatch):
    """Whatever is remembered, and wherever long texts are cut, the ids are those of the whole text."""
    whole = [t for t in texts.values() if t] + [LONG, "x" * 5000, " a  b \n c " * 500, "é " * 3000]
    want = encoder(PATH)._ids(whole)
    monkeypatch.setattr(tokens, "GROUP_POINTS", 700)
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 20_000)
    small = tokens.Encoder(PATH)
    assert small.encode(whole) == want and small.encode(whole[::-1]) == want[::-1]
    assert small.memory.words.nbytes + small.memory.ids.nbytes <= 20_000


def test_slices_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "GROUP_POINTS", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 4, None, "b" * 6, "c" * 30, "", "d"])], names=["i", "t"])
    assert [b.num_rows for b in tokens.slices(batch, 1)] == [3, 1, 2]
    assert list(tokens.slices(batch.slice(0, 0), 1)) == []


def expected_ids(texts, end):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, end] for i, x in texts.items()}


def crc(ids):
    return zlib.crc32(b"".join(struct.pack("<I", i) for i in ids))


def test_token_files_read_back(spark, docs, texts):
    ids, at, want = expected_ids(texts, 2), 0, {}
    path = Scratch(spark, "files").path
    shards = token_files.write_token_files(docs, path, PATH, 2, shard_tokens=5000)
    flat = []
    for i in sorted(ids):
        want[i] = (at, len(ids[i]), crc(ids[i]))
        at += len(ids[i])
        flat += ids[i]
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_index(shards).collect()} == want
    assert shards.count() > 3 and token_files.read_tokens(shards, 4000, 3000).tolist() == flat[4000:7000]


def test_token_files_of_odd_rows(spark, odd):
    rows = token_files.token_files(odd, PATH, 2).orderBy("start").collect()
    assert len(rows) == len(ODD) and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert [r.doc_id for r in rows] == sorted((r[0] for r in ODD), key=lambda x: (x is not None, x))
    assert token_files.token_files(odd.limit(0), PATH, 2).count() == 0


def packed_well(rows, texts, capacity=2048):
    ids = expected_ids(texts, 0)
    sequences = {}
    for r in rows:
        assert crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    return len(sequences)


def test_packing(spark, docs, texts):
    rows = packing.pack(docs, PATH).collect()
    total = sum(r.length for r in rows)
    assert packed_well(rows, texts) <= -(-total // 2048) + 1
    with_ids = packing.pack(docs.limit(5), PATH, with_ids=True).first()
    assert len(with_ids.ids) == 4 * with_ids.length


def test_packing_of_odd_rows(odd):
    rows = packing.pack(odd, PATH).collect()
    assert sum(r.piece == 0 for r in rows) == len(ODD) and packing.pack(odd.limit(0), PATH).count() == 0
    long = sorted((r.piece, r.length) for r in rows if r.doc_id == 6)
    assert all(n == 2048 for _, n in long[1:]) and long[0][1] <= 2048


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plans_are_whole_and_no_worse_than_best_fit(counts):
    made = packing.plan(counts, 30)
    used = Counter()
    for filling, times in made:
        assert sum(n * c for n, c in filling) <= 30
        for n, c in filling:
            used[n] += c * times
    assert used == counts
    n = sum(t for _, t in made)
    assert packing.lower_bound(counts, 30) <= n <= sum(t for _, t in packing.best_fit(counts, 30))
    items, rooms = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True), []
    for x in items:
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((30 if fit is None else fit) - x)
    assert sum(t for _, t in packing.best_fit(counts, 30)) == len(rooms)


def test_plans_take_lengths_less_often_than_they_fit():
    counts = {818: 4, 615: 12, 409: 4}
    assert packing.lower_bound(counts, 2048) == 6 == sum(t for _, t in packing.plan(counts, 2048))


def brute_fillings(counts, room, most_gap):
    """All undominated ways, as sets of (length, times) with their gaps, from all ways."""
    lengths = sorted(n for n, c in counts.items() if c and n <= room)

    def ways(i, left):
        if i < 0:
            yield ()
            return
        for m in range(min(counts[lengths[i]], left // lengths[i]) + 1):
            for rest in ways(i - 1, left - m * lengths[i]):
                yield (((lengths[i], m), *rest) if m else rest)

    out = set()
    for way in ways(len(lengths) - 1, room):
        use = Counter(dict(way))
        gap = room - sum(n * m for n, m in way)
        rest = [n for n in lengths if counts[n] > use[n]]
        pieces = sorted(use.elements())
        pairs = {a + b for i, a in enumerate(pieces) for b in pieces[i + 1 :]}
        swaps = any(n < r <= n + gap for n in use for r in rest) or any(p <= r <= p + gap for p in pairs for r in rest)
        if gap <= most_gap and not any(r <= gap for r in rest) and not swaps:
            out.add((gap, way))
    return out


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 14), st.integers(1, 4), max_size=6), st.integers(0, 24), st.integers(0, 24))
def test_fillings_against_all_ways(counts, room, most_gap):
    got = list(packing.fillings(counts, room, most_gap, iter(range(10**6))))
    assert len(got) == len(set(got)) and got == sorted(got, key=lambda g: g[0])
    assert set(got) == brute_fillings(counts, room, most_gap)


def fewest_sequences(pieces, capacity):
    """By all ways to put each piece, the largest first, into a sequence or a new one."""
    now = {()}
    for n in sorted(pieces, reverse=True):
        now = {tuple(sorted(x)) for rooms in now for x in [(*rooms, capacity - n), *((*rooms[:i], r - n, *rooms[i + 1 :]) for i, r in enumerate(rooms) if r >= n)]}
    return min(map(len, now))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(4, 30), min_size=1, max_size=9))
def test_small_plans_have_the_fewest_sequences(pieces):
    assert sum(t for _, t in packing.plan(dict(Counter(pieces)), 40)) == fewest_sequences(pieces, 40)


def brute_base(text):
    found = []
    assign = re.compile("(?ai)(?:password|passwd|secret|token|api_?key)")
    at = 0
    while m := assign.search(text, at):
        tail = re.compile("[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)").match(text, m.end())
        if not tail:
            at = m.start() + 1
            continue
        if len(tail[1]) >= 8:
            found.append(("assign", m.start(), tail.end()))
        at = tail.end()
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)):
        found += [(kind, *m.span()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_spans(spark, docs, texts):
    made = ['x password = "token" = "abcdefgh1234" y', "api_key='" + "f" * 40 + "'", "AKIA" + "B" * 11, "AKIA" + "B" * 12 + " TOKEN: ab.cd-ef=g", "ſecret=abcdefghijk", "ghp_" + "aB3dE6gH9j" * 3 + "kL2mN5"]
    for t in [*made, *list(texts.values())]:
        assert [s for s in secret_scan.spans(t) if s[0] != "grammar"] == brute_base(t)
    assert [s[0] for s in secret_scan.spans(made[-1])] == ["grammar"]
    for row in catalog.op7_secret_scan(spark, SF).collect():
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_base(texts[row.doc_id]))
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()


def everyday_strings(r):
    """Strings that are no secrets, by a generator that shares nothing with the operator's own."""
    vocabulary = "Harbour quietly window Elephant seventeen marble observation Kitchen protocol gravel lantern Meridian opposite tuesday Velvet workshop yellow zebra quartz jumping".split()

    def few(n):
        return [r.choice(vocabulary) for _ in range(n)]

    def hexa(n):
        return "".join(r.choices("0123456789abcdef", k=n))

    return {
        "uuid": lambda: "-".join(map(hexa, (8, 4, 4, 4, 12))),
        "slug": lambda: f"www.example.com/{r.randint(1999, 2030)}/{r.randint(1, 12):02d}/how-to-" + "-".join(few(4)).lower(),
        "camel": lambda: "".join(w.capitalize() for w in few(4)) + str(r.randint(1, 99)),
        "snake": lambda: "_".join(few(4)).lower() + f"_{r.randint(1, 9)}",
        "constant": lambda: "_".join(few(3)).upper(),
        "path": lambda: "/usr/local/share/" + "/".join(few(3)).lower() + f"/{r.choice(vocabulary).lower()}_{r.randint(1, 300)}.tar.gz",
        "stamp": lambda: f"{r.randint(1999, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}-{r.randint(0, 59):02d}-{r.randint(0, 59):02d}Z",
        "number": lambda: str(r.randrange(10**15, 10**24)),
        "long word": lambda: "".join(few(4)).lower(),
        "blob": lambda: base64.b64encode(r.randbytes(r.randint(150, 600))).decode(),
        "rule": lambda: r.choice("=-_.") * r.randint(20, 80),
    }


def test_everyday_strings_are_left_alone():
    r = random.Random(404)
    for name, make in everyday_strings(r).items():
        some = [make() for _ in range(200)]
        assert sum(any(k == "grammar" for k, _, _ in secret_scan.spans(f"see {w} there")) for w in some) <= 2, name
    assert secret_scan.redacted("see https://www.example.com/2024/05/how-to-bake-bread-at-home there") == "see https://www.example.com/2024/05/how-to-bake-bread-at-home there"


def test_automata_know_held_out_credentials():
    held = {n: words for n, (words, _) in secret_scan.labelled_credentials(seed=77, each=100).items()}
    r = random.Random(31)
    held["40 letters"] = ["".join(r.choices(string.ascii_letters, k=40)) for _ in range(200)]
    for name, words in held.items():
        least = 0.9 if name.split()[0] in ("access", "chat", "map", "web", "base64", "repository", "payment", "40") else 0.5
        for around in ("{}", "api.example.com/v1/{}/items", "key={}", "(x {} y)"):
            texts = [around.format(w) for w in words]
            hits = [any(k == "access" or k == "grammar" and t.index(w) <= a and b <= t.index(w) + len(w) for k, a, b in secret_scan.spans(t)) for w, t in zip(words, texts, strict=True)]
            assert sum(hits) >= least * len(hits), (name, around)


def test_candidates_beside_fixed_patterns():
    token = "ghp_" + "aB3dE6gH9j" * 3 + "kL2mN5"
    text = f"x {'0123456789abcdef' * 2}/{token} y"
    assert [k for k, _, _ in secret_scan.spans(text)] == ["hex", "grammar"]
    assert token not in secret_scan.redacted(text)


def test_redaction(odd):
    assert secret_scan.redacted('a token = "0123456789" b') == 'a token = "<SECRET>" b'
    assert secret_scan.redacted(None) is None and secret_scan.redacted("") == ""
    out = secret_scan.redact(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert secret_scan.scan(odd).filter("size(spans) > 0").count() == 0 and secret_scan.scan(odd.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="userUAsistan:\\ \n=#</>t", max_size=8), st.text(alphabet="#\\ </turn>\nU:=a;u0", max_size=30)), max_size=4))
def test_conversations_read_back(turns):
    rendered = "".join(chat_format.round_trip(r, t)[0] for r, t in turns)
    assert [(p.role, p.text) for p in chat_format.parse(rendered)] == turns


def test_chat_digests(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    held = {}
    for r in sorted([*((r.conv_id, r.turn, r.role, r.text) for r in rows), *catalog.PROBE]):
        held.setdefault(r[0], []).append(r)
    got = {r.conv_id: r for r in catalog.op8_chat_format(spark, SF).collect()}
    assert got.keys() == held.keys()
    for c, turns in held.items():
        loss = "".join(t or "" for _, _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t or ''}\n" for _, _, role, t in turns)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    odd = spark.createDataFrame([(None, None, None, None, 1), (1, 0, "user", None, 1), (1, 0, "user", None, 1), (1, None, "tool: x", LONG, 2)], "conv_id long, turn long, role string, text string, rendered int")
    assert sorted((r.conv_id or 0, r.n_turns) for r in chat_format.read_back(chat_format.format_conversations(odd)).collect()) == [(0, 1), (1, 3)]
    assert chat_format.format_conversations(odd.limit(0)).count() == 0


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in catalog.op9_quality_model(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(labels[r.doc_id] == r.predicted for r in rows) >= 0.95 * len(rows)


def test_quality_model_against_dense_rows():
    """Naive Bayes support vectors on dense rows, each with its own copy of the bias feature, by the textbook's update."""
    rng = random.Random(3)
    rows = [np.array(sorted(rng.sample(range(40), 12) if i % 2 else rng.sample(range(25, 60), 12)), np.int32) for i in range(60)]
    labels = np.array([i % 2 for i in range(60)])
    seen = [[sum(j in set(r.tolist()) for r, y in zip(rows, labels, strict=True) if y == k) for j in range(60)] for k in (0, 1)]
    ratio = [math.log((1 + seen[1][j]) / (1 + 30)) - math.log((1 + seen[0][j]) / (1 + 30)) if seen[0][j] + seen[1][j] >= quality_model.LEAST_DOCS else 0.0 for j in range(60)]
    dense = []
    for r in rows:
        x = [ratio[j] if j in set(r.tolist()) else 0.0 for j in range(60)]
        n = math.sqrt(sum(v * v for v in x)) or 1.0
        dense.append([v / n for v in x] + [1.0])
    w, dual, order = [0.0] * 61, [0.0] * 60, np.random.default_rng(7)
    for _ in range(12):
        moved = 0.0
        for i in order.permutation(60):
            y, x = 2 * labels[i] - 1, dense[i]
            g = y * sum(a * b for a, b in zip(w, x, strict=True)) - 1
            new = min(max(dual[i] - g / sum(v * v for v in x), 0.0), 1.0)
            step, dual[i] = (new - dual[i]) * y, new
            w = [a + step * b for a, b in zip(w, x, strict=True)]
            moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    model = quality_model.fit(rows, labels)
    for r, x in zip(rows, dense, strict=True):
        assert math.isclose(model.margin(r), sum(a * b for a, b in zip(w, x, strict=True)), abs_tol=1e-4)


def test_repeated_labels_count_once(spark):
    docs = spark.createDataFrame([(i, f"good words {i} here" if i % 2 else f"bad stuff {i} there") for i in range(40)] * 3, "doc_id long, text string")
    once = [(i, i % 2) for i in range(38)]
    labels = spark.createDataFrame(once, "doc_id long, quality int")
    many = spark.createDataFrame(once + [(3, 1)] * 5000 + [(38, 0), (38, 1)], "doc_id long, quality int")
    a, b = quality_model.train(docs, labels), quality_model.train(docs, many)
    assert (a.weight == b.weight).all() and a.bias == b.bias


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(6, 1, "x"), (5, 0, "x"), (4, None, "x"), (None, 1, "x"), (8, 7, "x")], "doc_id long, quality int, text string")
    for model in (quality_model.train(odd, labels), quality_model.train(odd, labels.limit(0)), quality_model.train(odd.limit(0), labels)):
        rows = quality_model.classify(odd, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert quality_model.accepted(odd, model).columns == odd.columns


@pytest.mark.parametrize("sent", [0, line_rules.SENT_LINES])
def test_rules_of_odd_rows(spark, odd, sent):
    rows = line_rules.quality_rules(odd, sent_lines=sent).collect()
    assert len(rows) == len(ODD) and all(r.base_failed for r in rows if r.n_words < 20)
    assert line_rules.quality_rules(odd.limit(0)).count() == 0


def test_shared_lines_deplete(spark):
    own = [" ".join(f"u{i}x{j}" for j in range(30)) for i in range(40)]
    shared = " ".join(f"Common{j}" for j in range(200))
    rows = [(i, "h", own[i] + "\n" + (shared.upper() if i % 2 else "  " + shared) if i < 20 else own[i]) for i in range(40)]
    got = {r.doc_id: r for r in line_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert all((not got[i].kept and got[i].words_removed == 200) if i < 20 else got[i].kept for i in got)


@pytest.mark.parametrize("sent", [0, line_rules.SENT_LINES])
def test_the_limit_of_shared_lines_is_that_of_any_host(spark, sent):
    def text(i):
        return " ".join(f"u{i}x{j}" for j in range(6)) + (f"\n{eleven}" if i < 11 else f"\n{ten}" if i < 21 else " " + " ".join(f"v{i}y{j}" for j in range(24)))

    eleven, ten = (" ".join(f"{c}{j}" for j in range(60)) for c in "ab")
    df = spark.createDataFrame([(i, "hot", text(i)) for i in range(4000)], "doc_id long, source string, text string")
    copies = spark.createDataFrame([(5000 + i, "hot", text(11)) for i in range(30)], df.schema)
    got = {r.doc_id: r for r in line_rules.quality_rules(df.unionByName(copies), sent_lines=sent).collect()}
    assert len(got) == 4030 and all((r.words_removed, r.kept) == ((60, False) if i < 11 else (0, True)) for i, r in got.items())


def test_shared_lines_are_cut_from_the_text(spark):
    own = [" ".join(f"u{i}x{j}" for j in range(30)) for i in range(40)]
    rows = [(i, "h", own[i] + "\n\n  Common LINE of\tmany \n" + "end" + str(i) if i < 20 else own[i], i / 2) for i in range(40)]
    rows += [(40, "h", "too short", 0.0), (41, "h", None, 0.0), (42, None, own[0] + "\ncommon line of many", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, extra double")
    clean = line_rules.clean_documents(df)
    assert clean.columns == df.columns
    want = {i: (own[i] + "\n\n" + "end" + str(i) if i < 20 else own[i], i / 2) for i in range(40)} | {42: (rows[42][2], 0.0)}
    assert {r.doc_id: (r.text, r.extra) for r in clean.collect()} == want


def left_behind(spark):
    return sorted(str(p) for p in Path(shared_root(spark).removeprefix("file://")).glob("*/*") if p.is_dir() and any(p.iterdir()))


def test_operators_leave_their_result_only(spark, docs):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    for run in (
        lambda: near_dedup.near_duplicates(docs), lambda: mixing.mix(docs), lambda: embedding_dedup.near_vectors(vectors),
        lambda: packing.pack(docs, PATH), lambda: line_rules.quality_rules(docs),
    ):
        before = left_behind(spark)
        run().count()
        assert len(left_behind(spark)) == len(before) + 1
        with collected():
            run().count()
        assert len(left_behind(spark)) == len(before) + 1


def test_scratch_needs_a_shared_folder(monkeypatch):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ScratchError):
        shared_root(Elsewhere())


def test_pipeline_on_odd_and_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(6, 1, 0, "x"), (8, 1, 0, "x"), (5, 0, 0, "x"), (None, 1, 0, "x"), (4, None, 0, "x")], "doc_id long, quality int, toxic int, text string")
    more = odd.unionByName(odd.filter("doc_id = 8").withColumn("text", F.lit("api_key = 0123456789abcdef " + "real words of a text " * 9)))
    for name, docs in (("odd", more), ("empty", odd.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        at = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, at, f"{tmp_path}/{name}").columns == at.columns
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in rows} <= {r[0] for r in ODD} and (bool(rows) == (name == "odd"))


def test_pipeline(spark, texts):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [f(spark, docs, SF).columns for _, f in corpus_pipeline.STAGES[:-1]] == [docs.columns] * 4
    kept = near_dedup.drop_near_duplicates(docs)
    want = brute_components(texts, 5, 80)
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r.doc_id for r in rows} <= set(texts)
    assert len(lower_word_list("A b")) == 2


def test_tasks_give_memory_back(monkeypatch):
    """What a Python task has used is not kept by its worker, which idles while later stages run in the JVM."""
    given = []
    monkeypatch.setattr(words, "give_back", lambda: given.append(1))
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array(["one two three four five six", None])], names=["doc_id", "text"])
    marked = pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), rows.column(1), rows.column(0)], names=["y", "text", "key"])
    tasks = [(near_dedup._sketch(5, 80, near_dedup.Sketcher(40, 6)), rows), (near_dedup._full_sets(5), rows), (secret_scan._scan("doc_id", secret_scan.learned()), rows), (quality_model._extract, marked)]
    for n, (task, batch) in enumerate(tasks):
        out = task(iter([batch, batch]))
        assert next(out).num_rows == 2 and len(given) == n
        assert sum(x.num_rows for x in out) == 2 and len(given) == n + 1
    monkeypatch.undo()
    words.give_back()


def test_stages_of_the_pipeline_start_on_collected_heaps(spark):
    import corpus_pipeline

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = [b for b in beans if b.getName() in ("G1 Old Generation", "MarkSweepCompact", "PS MarkSweep")]
    for name, stage in corpus_pipeline.STAGES:
        began = sum(b.getCollectionCount() for b in whole)
        with pytest.raises((AttributeError, AnalysisException)):  # there is nothing to read
            stage(spark, None, "/nowhere")
        assert sum(b.getCollectionCount() for b in whole) > began, name
