"""Operators that compare documents with each other: lines, repeats, near duplicates, mixing."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import LONG, ODD_ROWS, by_id
from pyspark.sql import functions as F

from tarmac.llm import common, lines, mixing, neardup, repeats

# lines


def removed_by_force(rows, percent=80, least=1):
    """Every line against every earlier one."""
    seen, out = [], {}
    for i, text in sorted(rows):
        for number, line in enumerate((text or "").encode().split(b"\n")):
            words = {w.translate(lines._LOWER) for w in line.split()}
            if len(words) >= least:
                if any(100 * len(words & s) >= percent * len(words | s) for s in seen):
                    out.setdefault(i, []).append(number)
                seen.append(words)
    return out


def similar_lines(seed, n=60):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [[draw.choice(vocabulary) for _ in range(draw.randrange(1, 24))] for _ in range(12)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(draw.randrange(4)):
            line = list(draw.choice(base))
            for _ in range(draw.randrange(4)):
                line[draw.randrange(len(line))] = draw.choice(vocabulary + ["New", "new", f"x{i}"])
            own.append("  ".join(line))
        rows.append((i, "\n".join(own)))
    return rows


@pytest.mark.parametrize("seed, many, few, largest", [(1, 20_000, 50_000, 6), (2, 20_000, 0, 2**20 - 1), (3, 20, 50_000, 6), (4, 20, 0, 2**20 - 1)])
def test_removed_lines_equal_all_comparisons(docs, monkeypatch, seed, many, few, largest):
    """Also with common words dealt in parts, with the unsettled lines joined by shuffling, with lines too large for their key."""
    monkeypatch.setattr(lines, "LARGEST", largest)
    monkeypatch.setattr(lines, "MANY", many)
    monkeypatch.setattr(lines, "FEW_ASKED", few)
    rows = similar_lines(seed)
    got = {r["doc_id"]: r["removed"] for r in lines.removed_lines(docs(rows)).collect()}
    assert got == removed_by_force(rows)


@pytest.mark.parametrize("seed", range(4))
def test_first_matches_equal_all_pairs(seed):
    """Rows of a few words, in any order of documents and lines: the earliest that passes, and whether others do."""
    draw = np.random.default_rng(seed)
    n = np.sort(draw.integers(1, 9, 300))
    key = draw.integers(0, 12, 300)
    order = np.lexsort((n, key))
    key, n = key[order], n[order]
    doc, line = np.divmod(draw.permutation(300), 7)
    p = draw.integers(0, 2, 300)
    low, high = draw.integers(0, 4, (2, 300))
    want = {}
    for a in range(300):
        passing = []
        for b in range(300):
            small, both = sorted((n[a], n[b])), n[a] + n[b]
            apart = int(low[a] ^ low[b]).bit_count() + int(high[a] ^ high[b]).bit_count()
            needed = -(-both * 80 // 180)
            if key[a] == key[b] and (doc[b], line[b]) < (doc[a], line[a]) and 100 * small[0] >= 80 * small[1]:
                if min(n[a] - p[a], n[b] - p[b]) >= needed and both - apart >= 2 * needed:
                    passing.append((doc[b], line[b], b))
        if passing:
            want[a] = (min(passing)[2], len(passing) > 1)
    found, first, more = lines.first_matches(key, doc, line, n, p, low, high, 80)
    assert {a: (b, m) for a, b, m in zip(found.tolist(), first.tolist(), more.tolist())} == want and want


def test_rows_of_the_join_go_many_at_once(spark, docs, monkeypatch):
    """The join runs with a larger setting of its own; the session keeps its setting for texts."""
    monkeypatch.setattr(lines, "JOIN_ROWS", 7_000)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    seen = []
    real = lines.first_candidates
    monkeypatch.setattr(lines, "first_candidates", lambda *x: seen.append(spark.conf.get(key)) or real(*x))
    assert lines.removed_lines(docs(similar_lines(1))).count()
    assert seen == ["7000"] and spark.conf.get(key) == before


@pytest.mark.parametrize("texts", [[t for _, t, *_ in ODD_ROWS], [None], [], ["", "\n", " \n\tB b\x0bé É\n\n", None, "a\n"], [t for _, t in similar_lines(5)]])
def test_names_and_lines_of_words_equal_plain_ones(texts, monkeypatch):
    """Texts are joined as they lie in Arrow, no text becomes a Python string; lines, words and their order are as by plain Python."""
    whole = lines._joined(pa.array([None, *texts, None], pa.string()).slice(1, len(texts)))
    assert whole.tobytes() == "\n".join(t or "" for t in texts).encode()
    split = [row.translate(lines._LOWER).split() for t in texts for row in (t or "").encode().split(b"\n")]
    one = {w: int(lines.word_names(np.frombuffer(w, dtype=np.uint8))[0][0]) for row in split for w in row}
    places = np.random.default_rng(2).integers(0, 9, lines.BUCKETS).astype(np.uint16)
    for rarity, key in ((None, lambda x: x), (places, lambda x: (places[x % lines.BUCKETS], x))):
        made = lines.Lines(texts, rarity)
        got = [made.names[made.words[s : s + n]].tolist() for s, n in zip(made.start, made.size)]
        assert got == [sorted({one[w] for w in row}, key=key) for row in split]


def test_removed_lines_of_the_sample(sample):
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    assert {r["doc_id"]: r["removed"] for r in lines.removed_lines(sample).collect()} == removed_by_force(rows)


def test_line_texts(docs):
    line = "one two three four five six"
    rows = [(1, f"{line}\nshort line"), (2, f"Start here\n{line.upper()} \nshort line"), (3, line), (4, f"{line}\n{line} seven")]
    kept = by_id(lines.keep_lines(docs(rows)))
    assert {i: r["text"] for i, r in kept.items()} == {1: rows[0][1], 2: "Start here"}
    assert kept[2]["n_chars"] == len(kept[2]["text"])
    table = by_id(lines.dedup_lines(docs(rows)))
    assert (table[4]["n_lines"], table[4]["n_removed"], table[4]["kept_sha256"]) == (2, 2, hashlib.sha256(b"").hexdigest())


def test_short_lines_and_scripts_without_spaces(docs):
    """Lines of one to three words match equal sets only; four words match five at 80 %. Lines without a word stay."""
    rows = [(1, "End\n\na b c\n日本語の行です"), (2, "end\n\nc  b a\na b\n日本語の行です"), (3, "a b c d"), (4, "a b c d e\n \nx y z")]
    got = {r["doc_id"]: r["removed"] for r in lines.removed_lines(docs(rows)).collect()}
    assert got == removed_by_force(rows) == {2: [0, 2, 4], 4: [0]}


def test_no_bytes_have_no_words_after_a_task_forgot_its_tables():
    common.give_back()
    assert [len(x) for x in lines.word_names(np.zeros(0, dtype=np.uint8))] == [0, 0]


def test_lines_of_odd_rows(odd, empty):
    rows = lines.dedup_lines(odd).collect()
    assert len(rows) == len(ODD_ROWS)
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows if r["n_removed"]) == [(5, 1)]
    assert {r["n_lines"] for r in rows if r["doc_id"] == 1} == {0}
    assert {r["n_lines"] for r in rows if r["doc_id"] in (2, 4)} == {1}
    assert sorted(r["doc_id"] or 0 for r in lines.keep_lines(odd).collect()) == [0, 1, 2, 3, 4, 6, 6, 7, 8]
    assert lines.dedup_lines(empty).count() == 0 and lines.keep_lines(empty).columns == list(common.DOCUMENT_COLUMNS)


# repeats


def repeats_by_force(rows):
    """Every string of 100 bytes in order of place."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(bool(g and not (p and gone[p - 1])) for p, g in enumerate(gone))
        out[i] = (len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def overlapping(seed):
    draw = random.Random(seed)
    pool = "".join(draw.choice("abcdé \n") for _ in range(700))
    rows = []
    for i in draw.sample(range(1000), 50):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            at = draw.randrange(600)
            part = pool[at : at + draw.randrange(60, 260)]
            if draw.random() < 0.3:
                cut = draw.randrange(len(part))
                part = part[:cut] + "#" + part[cut + 1 :]
            parts.append(part + draw.choice(["", "-", f"{i}"]))
        rows.append((i, "".join(parts)))
    return rows + [(2000, "ab" * 300), (2001, "x" * 99), (2002, "y" * 100), (2003, "y" * 101), (2004, None), (2005, "")]


@pytest.mark.parametrize("seed, many, remembered", [(1, 4000, 200_000), (2, 3, 200_000), (3, 0, 7), (4, 4000, 7)])
def test_repeats_equal_all_strings(docs, monkeypatch, seed, many, remembered):
    """With hashes sorted, grouped string by string, and sent in small portions."""
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "REMEMBERED", remembered)
    rows = overlapping(seed)
    got = by_id(repeats.remove_repeats(docs(rows)))
    assert {i: tuple(r)[1:5] for i, r in got.items()} == repeats_by_force(rows)


def test_kept_bytes(docs):
    row = by_id(repeats.remove_repeats(docs([(1, "a" * 50 + "b" * 100), (2, "c" + "b" * 120)])))[2]
    assert bytes(row["kept"]) == b"c" and row["n_removed"] == 120


def test_repeats_of_odd_rows(odd, empty):
    rows = repeats.remove_repeats(odd).collect()
    assert len(rows) == len(ODD_ROWS)
    want = repeats_by_force({(i, t) for i, t, *_ in ODD_ROWS if i is not None})
    assert {r["doc_id"]: tuple(r)[1:5] for r in rows if r["doc_id"] is not None} == want
    assert want[5][1] == len(LONG) and [r["n_removed"] for r in rows if r["doc_id"] is None] == [0]
    assert repeats.remove_repeats(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text(alphabet="ab", min_size=44, max_size=44), st.booleans()), min_size=1, max_size=25))
def test_deep_shallow_order(items):
    """Long common prefixes, ties and several groups, against plain sorting."""
    strings = [(("a" * 36 + text[36:]) if long else text).encode() for _, text, long in items]
    group = np.array([g for g, _, _ in items])
    rows = np.frombuffer(b"".join(strings), dtype=np.uint8).reshape(len(items), 44)
    order, common = repeats.deep_shallow(rows, group)
    want = sorted(range(len(items)), key=lambda i: (group[i], strings[i], i))
    assert order.tolist() == want
    for a, b, n in zip(want, want[1:], common[1:].tolist()):
        same = next((k for k in range(44) if strings[a][k] != strings[b][k]), 44)
        assert n == (same if group[a] == group[b] else -1)


def test_smallest_of_neighbours():
    h = np.random.default_rng(3).integers(0, 9, 400, dtype=np.uint64)
    want = [at + int(np.argmin(h[at : at + repeats.CHOICE])) for at in range(len(h) - repeats.CHOICE + 1)]
    assert repeats.smallest(h).tolist() == want


# near duplicates


def components_by_force(rows, width, percent=80):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().translate(neardup._LOWER).split()
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    name = {i: i for i in sets}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                name[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def families(seed):
    draw = random.Random(seed)
    rows = []
    for f in range(6):
        base = [f"v{draw.randrange(300)}" for _ in range(draw.choice([2, 3, 12, 60, 120]))]
        for _ in range(12):
            words = list(base)
            for _ in range(draw.randrange(0, max(2, len(words) // 12))):
                words[draw.randrange(len(words))] = draw.choice(["NEW", "other", f"v{draw.randrange(300)}"])
            rows.append(" ".join(words))
    draw.shuffle(rows)
    return list(enumerate(rows + ["", None, " \n"], start=10))


@pytest.mark.parametrize("seed, width", [(1, 4), (2, 5)])
def test_components_equal_all_comparisons(docs, seed, width):
    rows = families(seed)
    got = by_id(neardup.near_duplicates(docs(rows), width))
    assert {i: tuple(r)[1:] for i, r in got.items()} == components_by_force(rows, width)


def test_links_beyond_the_smallest_of_a_bucket(docs):
    """A chain: the ends are unlike, and unlike the smallest; rare shingles find the links between."""
    words = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 100])) for i in range(12)]
    got = by_id(neardup.near_duplicates(docs(rows)))
    assert {i: tuple(r)[1:] for i, r in got.items()} == components_by_force(rows, 4)
    assert {r["component_id"] for r in got.values()} == {0}


def test_prefix_pairs_lose_no_link(spark):
    draw = random.Random(5)
    sets = {i: sorted({draw.randrange(60) for _ in range(draw.randrange(1, 40))}) for i in range(60)}
    sets |= {100 + i: [x for x in own if draw.random() < 0.93] for i, own in sets.items()}
    sets = {i: own for i, own in sets.items() if own}
    table = spark.createDataFrame([(i, own) for i, own in sets.items()], "doc_id bigint, names array<bigint>")
    groups = spark.createDataFrame([(i, i) for i in sets], "doc_id bigint, component bigint")
    got = {tuple(sorted(r)) for r in neardup.confirm(neardup.prefix_pairs(table, groups, 80), table, 80).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(2, 1), (3, 2), (9, 8)], [(i, i + 1) for i in range(1, 40)], [(50, i) for i in range(20, 49)] + [(49, 50)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {}
    for a, b in edges:
        if a != b:
            parts = {want.get(a, a), want.get(b, b)}
            want |= {a: a, b: b} | want
            want = {n: min(parts) if c in parts or n in (a, b) else c for n, c in want.items()}
    assert got == want


def test_min_max_values_estimate_likeness():
    draw = np.random.default_rng(1)
    a = draw.integers(0, 2**63, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2400], draw.integers(0, 2**63, 600, dtype=np.uint64)])
    agree = np.mean(neardup.signature(a) == neardup.signature(b))
    assert abs(agree - 2400 / 3600) < 0.1


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD_ROWS)
    by = {r["doc_id"]: (r["component_id"], r["kept"]) for r in rows}
    assert by[None] == (None, True) and by[1] == (1, True) and by[2] == (2, True) and by[3] == (3, True)
    assert by[4] == (4, True) and by[5] == (4, False) and by[6] == (6, True)
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == list(common.DOCUMENT_COLUMNS) and kept.count() == len(ODD_ROWS) - 1


# mixing


def poisson(rate, u):
    k, total = 0, math.exp(-rate)
    while total <= u:
        k += 1
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
    return k


def test_copies_invert_the_distribution(docs):
    rows = [(i, "x", "en", "abc"[min(2, i % 10 // 4)]) for i in range(600)]
    given = docs(rows)
    weights = given.sparkSession.createDataFrame([("a", 1.0), ("b", 3.0), ("z", 9.0), ("c", None)], "source string, weight double")
    mixed = mixing.mix(given, weights, expected=2.0)
    n = {s: sum(r[3] == s for r in rows) for s in "abc"}
    rate = {"a": 2 * 600 * 0.25 / n["a"], "b": 2 * 600 * 0.75 / n["b"]}
    want = {}
    for i, _, _, source in rows:
        u = (int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        if source in rate and poisson(rate[source], u):
            want[i] = poisson(rate[source], u)
    got = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == want
    shares = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(shares["b"] / sum(shares.values()) - 0.75) < 0.05


@pytest.mark.parametrize("rate", [0.01, 1.0, 30.0, 900.0])
def test_distribution_function(spark, rate):
    cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(rate)).alias("c")).first()["c"]
    assert cdf == sorted(cdf) and cdf[-1] == pytest.approx(1.0, abs=1e-9)
    assert cdf[int(rate)] == pytest.approx(sum(math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) for k in range(int(rate) + 1)), rel=1e-9)


def test_many_sources_are_joined_by_shuffling(sample, monkeypatch):
    rows = lambda: sorted(mixing.mix(sample).select("doc_id", "copy_no", "shuffle_key").collect())
    few = rows()
    monkeypatch.setattr(mixing, "FEW_NUMBERS", 0)
    assert rows() == few


def test_a_high_rate_counts_by_its_distribution(sample, monkeypatch):
    """Two sources only, but hundreds of numbers for a rate of some hundred copies: too many for a bound of 100."""
    monkeypatch.setattr(mixing, "FEW_NUMBERS", 100)
    pair = sample.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    plan = lambda times: mixing.mix(pair, expected=times)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(0.01) and "strategy=broadcast" not in plan(300.0)


def test_mixing_of_odd_rows(odd, empty):
    rows = mixing.mix(odd, expected=3.0).collect()
    assert rows and {r["doc_id"] for r in rows} <= {i for i, *_ in ODD_ROWS}
    assert sum(r["doc_id"] == 6 for r in rows) % 2 == 0  # equal rows have equal counts
    assert mixing.mix(empty).count() == 0


def test_ids_beyond_the_bound_are_joined_by_shuffling(sample, monkeypatch):
    whole = by_id(neardup.drop_near_duplicates(sample))
    monkeypatch.setattr(common, "FEW_IDS", 0)
    monkeypatch.setattr(lines, "FEW_LINES", 0)
    monkeypatch.setattr(repeats, "FEW_SPANS", 0)
    assert by_id(neardup.drop_near_duplicates(sample)) == whole
    assert lines.dedup_lines(sample).count() == repeats.remove_repeats(sample).count() == 200
