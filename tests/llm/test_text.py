"""Operators that look at one text at a time: secrets, fingerprints, token counts, sentence pieces."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import LONG, ODD_ROWS, by_id
from tokenizers import Tokenizer

from tarmac.llm import common, credentials, digest, pieces, tokens

BPE = public_tokenizers.path("word_bpe_49k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# secrets


def base_spans(text):
    """The three patterns as they are stated, matches that fail dropped afterwards."""
    out = []
    for kind, pattern, group, least in (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ):
        flags = re.A | (re.I if kind == "assign" else 0)
        out += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PASSWD", "api_key", "token", "=", ":", " ", '"', "abc", "abcdef12", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ff", "K", "ſecret", "é", "\n"]), max_size=14))
def test_base_spans_equal_the_plain_patterns(parts):
    text = "".join(parts)
    assert [s for s in credentials.scan(text) if s[2] != "guess"] == base_spans(text)


def cheapest(value):
    """Least cost over every way to cut a value, tried out one by one, with words and brute force only."""

    def cut(rest, brute):
        if not rest:
            return 0.0
        first = rest == value
        best = (0.0 if brute or first else 0.3) + credentials._char_cost(rest[0]) + cut(rest[1:], True)
        for n in range(3, len(rest) + 1):
            if rest[:n] in credentials.WORD_RANK:
                price = np.log10(credentials.WORD_RANK[rest[:n]] + 1)
                best = min(best, price + (0.0 if first else 0.3) + cut(rest[n:], False))
        return best

    return cut(value, False)


@pytest.mark.parametrize("value", ["adminhello", "pmaster", "helloxhello", "zqvkw", "thekeyq", "theman"])
def test_guess_cost_is_the_least_of_all_cuts(value):
    assert credentials.log_guesses(value) == pytest.approx(cheapest(value), abs=1e-9)


def cheapest_of_all(value):
    """Least cost by trying every span at every place as every kind."""
    n, low = len(value), value.lower()
    price = {}

    def offer(i, j, x):
        price[i, j] = min(x, price.get((i, j), np.inf))

    for i in range(n):
        for j in range(i + 1, n + 1):
            part = low[i:j]
            offer(i, j, sum(map(credentials._char_cost, value[i:j])))
            for spelt, extra in ((part, 0.0), (part.translate(credentials._LEET), 0.5)):
                if spelt in credentials.WORD_RANK:
                    case = 0.0 if value[i:j].islower() or not any(map(str.isalpha, part)) else 0.3
                    offer(i, j, np.log10(credentials.WORD_RANK[spelt] + 1) + extra + case)
                    break
            if credentials._DATE.fullmatch(value[i:j]):
                offer(i, j, np.log10(36500) + 0.3 if j - i > 4 else 2.0)
            for u in range(1, 17):
                if j - i >= 3 and j - i > u and (j - i) % u == 0 and value[i : i + u] * ((j - i) // u) == value[i:j]:
                    offer(i, j, sum(map(credentials._char_cost, value[i : i + u])) + np.log10((j - i) // u))
            steps = [credentials._step(a, b) for a, b in zip(part, part[1:])]
            if j - i >= 3 and None not in steps:
                turns = 1 + sum(a != b for a, b in zip(steps, steps[1:]))
                offer(i, j, np.log10(47) + np.log10(j - i) + turns * np.log10(6))
    best = [0.0] + [np.inf] * n
    for j in range(1, n + 1):
        best[j] = min(best[i] + (0.3 if i else 0.0) + price[i, j] for i in range(j) if (i, j) in price)
    return best[n]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text("abA1", max_size=14), st.text("qwertasdf12", max_size=14), st.text("0129-/", max_size=12), st.text("pas@word5$ 2019", max_size=14)))
def test_guess_cost_is_least_over_all_kinds(value):
    assert credentials.log_guesses(value) == pytest.approx(cheapest_of_all(value), abs=1e-9)


def test_a_shifted_repeat_is_as_cheap_and_many_values_are_swept():
    assert credentials.log_guesses("a" + "ab" * 7) < credentials.log_guesses("ab" * 7) + 2.5
    text = "password=abc123$Tr0ub4dor&3 " * 4000
    assert len(credentials.scan(text)) == 8000


def test_guess_cost_ranks_values():
    costs = [credentials.log_guesses(v) for v in ("changeme", "qwertyuiop", "aaaaaaaaaaaa", "2019-12-31", "password123")]
    assert max(costs) < 7
    assert credentials.log_guesses("Xk9$mQ2!vb") > credentials.LOG_GUESSES
    assert credentials.log_guesses("q" * 50_000) < 10  # linear in the length


def test_added_spans_leave_base_ones(docs):
    rows = by_id(credentials.secrets(docs([(1, 'pwd: "Xk9$mQ2!vbT" token=abcdef'), (2, "passphrase: changeme"), (3, "bearer: hello")])))
    assert rows[1]["spans"] == "guess:6:17,assign:19:31"
    assert rows[1]["base_sha256"] == hashlib.sha256(b"assign:19:31").hexdigest()
    assert (rows[1]["n_assign"], rows[1]["n_guess"], rows[1]["n_weak"]) == (1, 1, 1)
    assert rows[2]["spans"] == rows[3]["spans"] == ""


def test_values_are_scored_whole():
    """A base span ends at the first character outside its set; the value does not."""
    assert credentials.scan("password=abc123$Tr0ub4dor&3") == [(0, 15, "assign"), (9, 27, "guess")]
    assert credentials.scan("password=Zq81kkWm20xv") == [(0, 21, "assign")]


@pytest.mark.parametrize("sign", [" " * 12 + "= ", "\t=\t", ":" + " " * 40, " \t => \t"])
def test_any_run_of_spaces_and_tabs_around_the_sign(sign):
    text = f"pwd{sign}Xk9$mQ2!vbT"
    assert credentials.scan(text) == [(3 + len(sign), len(text), "guess")]


def test_known_words_are_counted_in_the_documents(docs):
    rows = [(i, f"Einreichung, (required) {'überaus' if i % 2 else 'selten'} key-part x7required {'often ' * 9}") for i in range(60)]
    rows += [(100, "authorization: required-einreichung"), (101, "authorization: Xk9$mQ2!vbT"), (102, "rare " * 40), (103, None)]
    ranks = credentials.word_ranks(docs(rows))
    counted = Counter(w for _, t in rows for w in set(re.findall(r"""(?<![^\s"'(])[a-zü]{3,20}(?![^\s.,;:!?"')])""", (t or "").lower())))
    own = [w for w, n in sorted(counted.items(), key=lambda x: (-x[1], x[0])) if n >= 20 and w not in credentials.WORD_RANK]
    assert ranks == {**credentials.WORD_RANK, **{w: len(credentials.WORD_RANK) + i for i, w in enumerate(own, 1)}}
    assert set(own) == {"einreichung", "required", "überaus", "selten", "often"}
    assert set(credentials.word_ranks(docs(rows), most=3)) - set(credentials.WORD_RANK) == {"einreichung", "required", "often"}
    spans = by_id(credentials.secrets(docs(rows)))
    assert (spans[100]["spans"], spans[101]["spans"]) == ("", "guess:15:26")


@pytest.mark.parametrize("name, found", [("compass", 0), ("dbPwd", 1), ("DB_PWD", 1), ("Pwd", 1), ("bypwd", 0), ("1pwd", 1)])
def test_names_of_credentials_begin_a_word(name, found):
    assert len(credentials.scan(f"{name}: Xk9$mQ2!vbT")) == found


def test_secrets_of_odd_rows(odd, empty):
    found = credentials.secrets(odd).collect()
    assert len(found) == len(ODD_ROWS) and all(r["spans"] == "" for r in found)
    assert {r["base_sha256"] for r in found} == {hashlib.sha256(b"").hexdigest()}
    assert credentials.secrets(empty).count() == 0


# fingerprints


def expected(rows):
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = {}
    for place, (i, text) in enumerate(order):
        following = order[(place + 1) % len(order)][1]
        half = len(text) // 2
        changed = (text[: len(text) - half] + following[:half]).encode()
        prints = [digest.fingerprint(x) for x in (text.encode(), changed, following.encode())]
        out[i] = (len(text), hashlib.sha256(changed).hexdigest(), *prints[:2], digest.likeness(*prints[:2]), digest.likeness(prints[0], prints[2]))
    return out


@pytest.mark.parametrize("ranges", [1, 2, 7, 60])
def test_fingerprints_equal_one_pass_in_order(sample, ranges):
    rows = by_id(digest.fingerprints(sample, ranges))
    want = expected([(r["doc_id"], r["text"]) for r in sample.collect()])
    assert {i: tuple(r)[1:] for i, r in rows.items()} == want


def test_fingerprints_tell_edits_from_other_documents(sample):
    rows = digest.fingerprints(sample).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.95 * len(rows)


def counted(data):
    """Buckets counted triplet by triplet."""
    out = [0] * digest.BUCKETS
    for at in range(len(data) - 4):
        for salt, places in enumerate(digest.TRIPLETS, 1):
            a, b, c = (data[at + p] for p in places)
            h = (a * 0x9E3779B1 + b * 0x85EBCA6B) & 0xFFFFFFFF
            h = ((h ^ (c * 0xC2B2AE35 & 0xFFFFFFFF)) + (salt * 0x27220A95)) & 0xFFFFFFFF
            h = ((h ^ h >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
            out[h >> 24] += 1
    return out


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=80), st.binary(max_size=80))
def test_digest(a, b):
    assert digest.bucket_counts(a).tolist() == counted(a)
    x, y = digest.fingerprint(a), digest.fingerprint(b)
    assert digest.difference(x, y) == digest.difference(y, x) and 0 <= digest.likeness(x, y) <= 1
    assert digest.likeness(x, x) == 1 and (a != b or x == y)


def test_fingerprints_of_odd_rows(odd, empty, docs):
    rows = digest.fingerprints(odd, 3).collect()
    assert len(rows) == len(ODD_ROWS)
    assert {r["n_chars"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    same = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert same[4] == same[5] and same[1] == same[2]
    assert digest.fingerprints(empty).count() == 0
    alone = digest.fingerprints(docs([(9, "one text alone")])).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"one tex" + b"one tex").hexdigest()


# token counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def test_counts_equal_the_library(sample, library):
    rows = by_id(tokens.token_counts(sample, BPE))
    texts = {r["doc_id"]: r["text"] for r in sample.collect()}
    assert {i: r["n_tokens"] for i, r in rows.items()} == {i: len(library.encode(t, add_special_tokens=False)) for i, t in texts.items()}
    assert all(r["n_bytes"] == len(texts[i].encode()) and r["over_limit"] == (r["n_tokens"] > 2048) for i, r in rows.items())


ODD_TEXTS = ["", "aaa aaaa aaaaa" * 5, " \x1c a\x1fb\x85c​d", "İIΣΑΣ ς", "<|startoftext|>hi<|endoftext|> <|END|>", "don't I'll 'S 'T", "123 ４５ ½ Ⅷ", "👩‍👩‍👧 ñ", "x" * 3000, "!?" * 500, "\xa0a　b", "日本語 한국어", "ß ² ª º µ ÿ !\x1c! a\x1db"]


def test_counts_of_odd_texts_equal_the_library(library):
    draw = random.Random(1)
    chars = lambda: chr(draw.choice([draw.randrange(32, 127), draw.randrange(1, 0x24F), draw.randrange(32, 0x2FFF), draw.randrange(0x1F000, 0x1FAFF)]))
    texts = ODD_TEXTS + ["".join(chars() for _ in range(draw.randrange(80))) for _ in range(500)]
    assert tokens.Counter(BPE).count(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]


def test_a_small_memory_counts_the_same(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    counter = tokens.Counter(BPE)
    for text in ("one two three four five", "five six one", "one " + "y" * 200, "two two"):
        assert counter.count([text]) == [len(library.encode(text, add_special_tokens=False))]


def test_token_counts_of_odd_rows(odd, empty, library):
    rows = tokens.token_counts(odd, BPE).collect()
    assert len(rows) == len(ODD_ROWS)
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(library.encode(t or "", add_special_tokens=False)) for _, t, *_ in ODD_ROWS)
    assert tokens.token_counts(empty, BPE).count() == 0


# sentence pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(MODEL)


def best_cut(model, text):
    """Viterbi over the whole text at once; ids of the best path."""
    text = " " + text
    best, back = [0.0] + [-np.inf] * len(text), [None] * (len(text) + 1)
    for at in range(len(text)):
        for end in range(at + 1, min(len(text), at + model.longest) + 1):
            found = model.pieces.get(text[at:end])
            if found and best[at] + found[0] > best[end]:
                best[end], back[end] = best[at] + found[0], (at, found[1])
        if text[at] not in model.pieces and best[at] + model.unknown > best[at + 1]:
            best[at + 1], back[at + 1] = best[at] + model.unknown, (at, tuple(model.byte[b] for b in text[at].encode()))
    parts, at = [], len(text)
    while at:
        at, ids = back[at]
        parts.append(ids)
    return [i for ids in reversed(parts) for i in ids]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abet hin ▁é😀\n0", max_size=60))
def test_ids_are_the_best_path_and_decode_to_the_text(text):
    model = pieces.model(MODEL)
    want = best_cut(model, text)
    assert model.encode([text])[0].tolist() == want
    for size in (1, 7):
        chunks = [(" " + text)[i : i + size] for i in range(0, len(text) + 1, size)]
        assert [i for part in model.stream(chunks) for i in part] == want
    assert model.decode(want) == text


def test_the_stream_forgets_what_is_settled(model):
    longest = 0
    for part in model.stream("international" * 20 for _ in range(50)):
        longest = max(longest, len(part))
    assert longest < 40  # ids of a few windows at a time, never of the whole text


def test_a_worker_keeps_a_model_for_its_stage_only():
    """At the end of a task words are forgotten; a model goes with the first task that does not ask for it. Nodes without
    children share a row of the tree."""
    model = pieces.model(MODEL)
    model.encode(["some words of a task"])
    assert model.next.nbytes < 20_000_000 and len(model.known)
    common.give_back()
    assert pieces.model(MODEL) is model and not model.known
    common.give_back()
    common.give_back()
    assert not pieces._MODELS


def test_long_texts_round_trip(model):
    for text in (LONG, "x" * 30_000, "日本語" * 2000):
        assert model.decode(model.encode([text])[0].tolist()) == text


def test_encode_and_decode_of_odd_rows(odd, empty, docs):
    rows = pieces.encode(odd, MODEL)
    assert rows.count() == len(ODD_ROWS)
    assert rows.filter("round_trip = false").count() == 0
    found = by_id(rows)
    assert found[1]["ids"] is None and found[1]["n_ids"] == 0 and found[1]["round_trip"] is None
    assert found[2]["n_ids"] == 1
    texts = {r["doc_id"]: r["text"] for r in pieces.decode(rows, MODEL).collect()}
    assert all(texts[i] == t for i, t, *_ in ODD_ROWS)
    assert pieces.encode(empty, MODEL).count() == 0 and pieces.decode(pieces.encode(empty, MODEL), MODEL).count() == 0
