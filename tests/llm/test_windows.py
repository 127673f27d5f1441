"""Lexical search, periodic runs and packing against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import LONG, by_id
from tokenizers import Tokenizer

from tarmac.llm import lexical, packing, runs

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# lexical search


def ranked(docs, items, top=lexical.TOP):
    """The ranking as it is defined, document by document."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))

    held = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    big_n, big_l = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(split(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * big_n) // big_l
            score = sum(
                int(np.floor(1000 * np.log((2 * big_n + 2) / (2 * df[t] + 1)))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                for t in wanted & c.keys()
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:top], start=1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def test_search_equals_brute_force(spark, sample, benchmark):
    documents = [(r.doc_id, r.text) for r in sample.collect()]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    want = ranked(documents, items)
    assert found(lexical.search(sample, benchmark)) == want
    # several passes over fewer terms each, small trees over several tasks
    assert found(lexical.search(sample.repartition(3), benchmark, terms_at_once=500, block=40)) == want


def test_search_ties_repeats_and_odd_rows(spark, docs):
    rows = [(i, "alpha beta") for i in range(90, 0, -1)] + [(None, "alpha beta"), (7, "alpha beta"), (200, None), (201, ""), (202, "… --"), (203, "ALPHA É alpha" + " x" * 50)]
    items = [(1, "Beta, alpha!"), (1, "gamma"), (2, ""), (None, "é É"), (3, None), (4, "nowhere")]
    table = spark.createDataFrame([(*item, "alpha", 9) for item in items], "item_id bigint, text string, TEXT string, rank int")
    got = found(lexical.search(docs(rows).repartition(7), table, block=10))
    assert got == ranked(rows, items)
    first = [r for r in got if r[0] == 1]
    assert sorted(r[1] for r in first) == list(range(1, 51)) and sum(r[2] == 7 for r in first) == 2
    assert len(found(lexical.search(docs([(1, None)]), table))) == 0


def test_search_of_empty_tables(spark, empty, docs, benchmark):
    assert lexical.search(empty, benchmark).count() == 0
    none = lexical.search(docs([(1, "a")]), benchmark.limit(0))
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = "Émile! " * 3000 + "x" * 500 + " end"
    whole = list(lexical.terms(text))
    monkeypatch.setattr(lexical, "PART", 97)
    assert [t for part in lexical._term_lists(text) for t in part] == whole


@pytest.mark.parametrize("rows, leaf", [(1, 4), (5, 4), (300, 8), (300, 1000)])
def test_balls_hold_every_product_and_prune(rows, leaf):
    draw = np.random.default_rng(rows + leaf)
    counts = draw.integers(1, 9, rows)
    columns = np.concatenate([np.sort(draw.choice(40, c, replace=False)) for c in counts]) + 1
    values = draw.integers(0, 10**10, len(columns))
    dense = np.zeros((rows, 42), dtype=np.int64)
    dense[np.repeat(np.arange(rows), counts), columns] = values
    for _ in range(30):
        query = np.sort(draw.choice(41, draw.integers(1, 12), replace=False))
        exact = dense[:, query].sum(axis=1)
        best = [lexical.Best(5)]
        lexical.search_block(np.arange(rows), counts, columns, values, [query], best, leaf)
        order = sorted((-s, i) for i, s in enumerate(exact.tolist()) if s > 0)[:5]
        assert list(zip((-best[0].scores).tolist(), best[0].ids.tolist())) == order


def test_far_leaves_stay_closed():
    counts, columns = np.ones(4000, dtype=np.int64), np.repeat(np.arange(1, 41), 100)
    values = np.tile(np.arange(1, 101), 40) * 1000
    best = [lexical.Best(3)]
    opened = lexical.search_block(np.arange(4000), counts, columns, values, [np.array([7])], best)
    assert opened < 40 and best[0].scores.tolist() == [100_000, 99_000, 98_000]


# periodic runs


def brute_runs(words, exponent=4, least=6):
    n, out = len(words), {}
    for p in range(1, n // exponent + 1):
        i = p
        while i < n:
            j = i
            while j < n and words[j] == words[j - p]:
                j += 1
            if j - i + p >= max(least, exponent * p):
                out[i - p, j] = min(p, out.get((i - p, j), p))
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


REPEATS = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 9)), max_size=8).map(
    lambda parts: [w for block, times in parts for w in block * times]
)


@settings(max_examples=300, deadline=None)
@given(REPEATS, st.sampled_from([(4, 6), (2, 2), (3, 5), (6, 1)]), st.lists(st.integers(1, 9), min_size=1, max_size=5))
def test_runs_equal_brute_force_however_words_arrive(words, bounds, sizes):
    numbers = np.array(words, dtype=np.int64)
    want = brute_runs(words, *bounds)
    assert runs.find_runs(numbers, *bounds) == want
    online, at, turn = runs.Catchers(*bounds), 0, 0
    while at < len(words):
        step = sizes[turn % len(sizes)]
        online.append(numbers[at : at + step])
        at, turn = at + step, turn + 1
        assert online.found() == brute_runs(words[:at], *bounds)  # right after every word


def test_periods_beyond_one_part(monkeypatch):
    monkeypatch.setattr(runs, "PART", 16)
    for start, period, length in [(0, 16, 64), (3, 17, 68), (5, 33, 140), (0, 40, 160), (9, 63, 252)]:
        words = [*range(1000, 1000 + start), *(i % period for i in range(length)), 2000, 2001]
        assert runs.find_runs(np.array(words)) == [(start, length, period)]


def test_squares_are_reported_once_as_they_appear():
    catchers = runs.Catchers(2, 2)
    told = [catchers.append(np.array([w])) for w in [5, 1, 2, 1, 2, 1, 2, 9, 9]]
    assert [(i, s) for i, squares in enumerate(told) for s in squares] == [(4, (1, 2)), (8, (7, 1))]


def test_long_repetitive_sequences_take_near_linear_time():
    for words in ([0] * 300_000, list(range(7000)) * 40, [bin(i).count("1") % 2 for i in range(1 << 16)]):
        got = runs.find_runs(np.array(words))
        assert len(got) == (0 if len(words) == 1 << 16 else 1)


def test_periodic_runs_of_documents(docs, odd, empty):
    rows = [(i, t) for i, t in enumerate(["a b " * 9, "x " * 7 + "y", "one two three", None, " \t\n", ("p q r\n" * 5).replace("q", "é")])]
    got = by_id(runs.periodic_runs(docs(rows)))
    assert (got[0]["start"], got[0]["length"], got[0]["period"], got[0]["exponent_milli"]) == (0, 18, 2, 9000)
    assert got[1]["collapsed_sha256"] == hashlib.sha256(b"x y").hexdigest()
    assert got[5]["collapsed_sha256"] == hashlib.sha256("p é r".encode()).hexdigest()
    assert got[0]["runs_sha256"] == hashlib.sha256(b"0,18,2\n").hexdigest()
    nothing = hashlib.sha256(b"").hexdigest()
    for i in (3, 4):
        assert (got[i]["n_runs"], got[i]["start"], got[i]["runs_sha256"], got[i]["collapsed_sha256"]) == (0, None, nothing, nothing)
    assert runs.periodic_runs(odd).count() == odd.count()
    assert runs.periodic_runs(empty).count() == 0


def test_periodic_runs_of_rewritten_documents(sample):
    got = by_id(runs.periodic_runs(sample, rewrite=True))
    hit = 0
    for doc_id, text in [(r.doc_id, r.text) for r in sample.collect()]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found_ = brute_runs(words)
        hit += bool(found_)
        drop = {i for s, length, q in found_ for i in range(s + q, s + length)}
        row = got[doc_id]
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n_},{q}\n" for s, n_, q in found_).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest()
        best = min(found_, key=lambda r: (-r[1], r[0], r[2])) if found_ else (None,) * 3
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(found_), *best)
    assert hit


def test_words_of_long_texts_are_cut_at_white_space(monkeypatch):
    text = "añb cd\t" * 500 + "z" * 300 + " q \x1c r"
    numbers, words = runs.word_numbers(text)
    want = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert [words[i].decode() for i in numbers] == want
    monkeypatch.setattr(runs, "PART_BYTES", 31)
    again, words = runs.word_numbers(text)
    assert [words[i].decode() for i in again] == want


# packing


LIBRARY = Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


ODD_PARTS = st.sampled_from(
    ["word", " word", "  two", "\n", "\n\n", " \n", "\t", " ", " ", "<|endoftext|>", "<|end", "é", "é", "😀", "漢字", "'s", "'S", "12", "½", "\x1c", "\u0000", "-", "…", "ǆ", "ɐ", "͸"]
)


@settings(max_examples=200, deadline=None)
@given(st.lists(ODD_PARTS, max_size=12).map("".join))
def test_ids_equal_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids if text else []
    assert packing.encoder(VOCABULARY).ids(text).tolist() == want


def test_ids_of_long_texts_by_parts(library, monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)
    for text in (LONG[:20_000], "a b.  c\n d" * 300, "x" * 4000, " " * 4000, "\n " * 900, "é ö ß" * 200):
        assert packing.encoder(VOCABULARY).ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_combinations_fill_the_window():
    ways = {tuple(w) for w in packing.combinations(12).tolist()}
    want = {(a, b, 12 - a - b) for a in range(13) for b in range(a + 1) if 0 <= 12 - a - b <= b}
    assert ways == want and (4, 4, 4) in ways and (12, 0, 0) in ways
    assert len(packing.combinations(12, 2)) == 7 and len(packing.combinations(12, 1)) == 1


@pytest.mark.parametrize("seed", range(4))
def test_repeat_counts_are_least_squares(seed):
    """At the least, the gradient is zero where a count is positive and nowhere negative."""
    window = 24
    histogram = np.random.default_rng(seed).integers(0, 400, window + 1).astype(float)
    histogram[0] = 0
    ways = packing.combinations(window)
    x = packing.repeat_counts(histogram, ways, steps=6000)
    matrix = np.zeros((window + 1, len(ways)))
    for i, way in enumerate(ways):
        np.add.at(matrix[:, i], way, 1)
    matrix[0] = 0
    gradient = matrix.T @ (matrix @ x - histogram)
    assert (x >= 0).all() and gradient.min() > -0.5 and np.abs(gradient[x > 0.01]).max() < 0.5


def padding(pieces, window):
    used = Counter()
    for p in pieces:
        used[p["sequence_id"]] += p["length"]
    return sum(0 if n & (n - 1) == 0 else window - n for n in used.values())


def check(pieces, documents, library, window):
    """Every id in exactly one piece, every sequence gapless and within the window, nothing padded."""
    ids = sorted((np.append(library.encode(t or "", add_special_tokens=False).ids, 0).astype("<u4") for _, t in documents), key=len)
    spans = {}
    for p in pieces:
        assert p["length"] > 0 and p["offset"] + p["length"] <= window
        spans.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    assert sum(p["length"] for p in pieces) == sum(map(len, ids))
    assert padding(pieces, window) == 0


@pytest.mark.parametrize("window", [1024, 64])
def test_packing_of_the_sample(spark, sample, library, window):
    documents = [(r.doc_id, r.text) for r in sample.collect()]
    pieces = packing.pack(sample.repartition(6), VOCABULARY, window).collect()
    check(pieces, documents, library, window)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    for doc_id, text in documents:
        ids = np.append(library.encode(text or "", add_special_tokens=False).ids, 0).astype("<u4")
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)


def test_packing_of_hot_lengths_both_ways_of_joining(docs, library, monkeypatch):
    rows = [(i, "the same words again " * 20 if i % 3 else f"text {i} " * (i % 50)) for i in range(400)]
    first = packing.pack(docs(rows).repartition(5), VOCABULARY).collect()
    check(first, rows, library, 1024)
    monkeypatch.setattr(packing, "FEW_COUNTS", 0)
    again = packing.pack(docs(rows).repartition(5), VOCABULARY).collect()
    check(again, rows, library, 1024)


def test_packing_of_odd_rows(odd, empty, library):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    pieces = packing.pack(odd, VOCABULARY).collect()
    check(pieces, rows, library, 1024)
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter(i for i, _ in rows)
    assert [(p["length"], p["ids_crc32"]) for p in pieces if p["doc_id"] == 1] == [(1, zlib.crc32(bytes(4)))]
    assert packing.pack(empty, VOCABULARY).count() == 0
