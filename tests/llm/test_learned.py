"""Operators that learn from labels, and the pipeline."""

import math
import random
from collections import Counter
from fractions import Fraction

import corpus_pipeline
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import ODD_ROWS
from pyspark.sql import functions as F

from tarmac.llm import common, quality, toxicity
from tarmac.session import scratch

# quality


def counts_by_force(text):
    text = text or ""
    spaces = " \t\n\r\x0b\x0c"
    words = "".join(" " if c in spaces else c for c in text).split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if x.strip(spaces)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "#x", "\x1c", "\xa0", "a b a b a b a b a b", "\n", "line of words\n", " ", "\t"]), max_size=60))
def test_counts(parts):
    text = "".join(p + (" " if i % 3 else "") for i, p in enumerate(parts))
    assert quality.measure(text)[:5] == counts_by_force(text)


def exact_tail(k, n, p):
    p = Fraction(p)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


@pytest.mark.parametrize("k, n, p", [(0, 10, 0.1), (3, 40, 0.1), (7, 300, 0.01), (300, 300, 0.5), (0, 1, 0.001), (60, 100, 0.25)])
def test_binomial_tail_is_exact(k, n, p):
    assert math.exp(quality.log_binomial_tail(k, n, p)) == pytest.approx(exact_tail(k, n, p), rel=1e-9)


def test_cutoffs_stop_at_the_first_that_is_not_proven():
    rules = list(quality.RULES)
    counts = {("en", r): [100_000] + [0] * len(quality.RULES[r]) for r in rules}
    counts["en", "symbol_ratio"] = [90_000, 0, 0, 10_000] + [0] * (len(quality.RULES["symbol_ratio"]) - 3)
    counts["en", "mean_word_length"] = [90_000, 0, 0, 9_900] + [100] * (len(quality.RULES["mean_word_length"]) - 3)
    counts["de", "symbol_ratio"] = [50] + [0] * len(quality.RULES["symbol_ratio"])
    chosen = quality.choose_cutoffs(counts)
    # 10,000 of 100,000 good documents exceed the three strictest cutoffs: the fourth from the end is the last that is proven
    assert chosen["en", "symbol_ratio"] == quality.RULES["symbol_ratio"][-4]
    assert chosen["en", "mean_word_length"] == quality.RULES["mean_word_length"][2]  # 300 are proven to be under 0.4 %, 400 are not
    assert chosen["en", "capital_ratio"] == quality.RULES["capital_ratio"][-1]
    assert ("de", "symbol_ratio") not in chosen  # fifty documents prove nothing


def test_chosen_cutoffs_keep_the_promise():
    """The chance that a rule rejects more good documents than allowed stays below delta, over many draws of holdouts."""
    draw = np.random.default_rng(1)
    rule, cutoffs = "symbol_ratio", quality.RULES["symbol_ratio"]
    bad = 0
    for _ in range(300):
        values = draw.exponential(0.06, 6000)
        step = np.searchsorted(-np.array(cutoffs), -values, side="right")
        exceeded = np.bincount(len(cutoffs) - step, minlength=len(cutoffs) + 1).tolist()
        by_hand = [sum(c < v for c in cutoffs) for v in values[:50]]
        assert by_hand == (len(cutoffs) - step[:50]).tolist()
        cutoff = quality.choose_cutoffs({("en", rule): exceeded}).get(("en", rule))
        bad += cutoff is not None and math.exp(-cutoff / 0.06) > quality.RISK / len(quality.RULES)
    assert bad <= 300 * quality.DELTA


def good_and_bad(n):
    draw = random.Random(3)
    rows, marks = [], []
    for i in range(n):
        words = [f"w{draw.randrange(500)}" for _ in range(40)]
        bad = i % 10 == 0
        rows.append((i, (" ".join(w.upper() + "!" if bad else w for w in words)), ("en", "de")[i % 12 == 0]))
        marks.append((i, 0 if bad else 1, None))
    return rows, marks


def test_learnt_rules_reject_shouting_and_keep_the_rest(docs, labels):
    rows, marks = good_and_bad(12_000)
    found = quality.quality(docs(rows), labels(marks + [(5, 0, None), (None, 1, None), (7, None, None)]))
    kept = {r["doc_id"]: r["kept"] for r in found.select("doc_id", "kept").collect()}
    good = [kept[i] for i, _, _ in rows if i % 10]
    assert sum(good) >= 0.99 * len(good)
    assert not any(kept[i] for i, _, lang in rows if i % 10 == 0 and lang == "en")
    assert all(kept[i] for i, _, lang in rows if lang == "de")  # 800 good documents are too few for a proof
    assert quality.keep_good(docs(rows), labels(marks)).count() == pytest.approx(sum(kept.values()), abs=2)


@pytest.mark.parametrize("each, proven", [(2500, True), (400, False)])
def test_every_language_is_proven_by_its_own_documents(spark, labels, each, proven):
    """Seventy languages: none is pooled with others, whose documents would prove or disprove its rules."""
    rows = spark.range(70 * each).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("l"), (F.col("id") % 70).cast("string")).alias("lang"),
        *[F.lit(40 if c == "n_words" else 0).cast("bigint").alias(c) for c in quality.COUNTS], *[F.lit(0.0).alias(r) for r in quality.RULES],
    )
    marks = spark.range(70 * each).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    cutoffs = quality.learn_cutoffs(rows, marks)
    assert {s for s, _ in cutoffs} == ({f"l{i}" for i in range(70)} if proven else set())
    shouting = rows.limit(1).withColumns({"capital_ratio": F.lit(1.0), "lang": F.explode(F.array(F.lit("new"), F.lit("l5"), F.lit(None)))})
    passed = {r["lang"]: r["_passes"] for r in quality.passing(shouting, cutoffs).collect()}
    assert passed == {"new": True, None: True, "l5": not proven}


def test_quality_of_odd_rows(odd, empty, labels):
    found = quality.quality(odd, labels([(4, 1, 0), (4, 0, 0), (None, None, None)])).collect()
    assert len(found) == len(ODD_ROWS)
    for r in found:
        text = next(t for i, t, *_ in ODD_ROWS if i == r["doc_id"])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counts_by_force(text)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])  # no rule can be proven from these labels
    assert quality.quality(empty, labels([])).count() == 0
    assert quality.keep_good(odd, labels([])).columns == list(common.DOCUMENT_COLUMNS)


# toxicity


def sparse(words, idf):
    """Ascending numbers of terms and weights of length one."""
    times = {w: words.count(w) for w in words}
    held = sorted(times)
    raw = np.array([(1 + np.log(times[w])) * idf[w] for w in held])
    return np.array(held, dtype=np.int64), raw / np.sqrt(raw @ raw) if held else raw


@pytest.fixture(scope="module")
def examples():
    """900 examples over 60 terms, the first ones much commoner; some are empty, many equal."""
    draw = random.Random(4)
    idf = {w: 1 + draw.random() * 5 for w in range(60)}
    rows = [sparse([min(59, int(draw.expovariate(0.12))) for _ in range(draw.randrange(0, 6))], idf) for _ in range(900)]
    rows = [rows[i // 3] if i % 3 else r for i, r in enumerate(rows)]
    ids = np.array(draw.sample(range(10_000), len(rows)))
    return idf, ids, rows


def make_index(ids, rows):
    sizes = np.array([len(w) for w, _ in rows])
    toxic = np.array([int(3 in w) for w, _ in rows])
    return toxicity.Index(ids, toxic, sizes, np.concatenate([w for w, _ in rows]), np.concatenate([x for _, x in rows]), 60)


def all_cosines(ids, rows, query, k):
    found = [(round(sum(dict(zip(*r)).get(w, 0.0) * x for w, x in zip(*query)), 9), i) for i, r in zip(ids.tolist(), rows)]
    return sorted((f for f in found if f[0] > 0), key=lambda f: (-f[0], f[1]))[:k]


@pytest.mark.parametrize("block,common,rare,first", [(128, 1024, 0.01, 2), (16, 4, 0.05, 1), (16, 0, 0.0, 1), (8, 10, 1.0, 3), (16, 0, 1.0, 2)])
def test_nearest_equal_all_cosines(examples, monkeypatch, block, common, rare, first):
    idf, ids, rows = examples
    for name, value in (("BLOCK", block), ("COMMON_TERMS", common), ("RARE", rare), ("FIRST", first), ("TOGETHER", 7)):
        monkeypatch.setattr(toxicity, name, value)
    index = make_index(ids, rows)
    draw = random.Random(5)
    queries = [sparse([draw.randrange(60) for _ in range(draw.randrange(0, 5))], idf) for _ in range(40)] + rows[:10]
    for k in (1, 7, 25, 2000):
        for query, near in zip(queries, index.nearest(queries, k)):
            want = all_cosines(ids, rows, query, k)
            assert [c for c, _ in near] == pytest.approx([c for c, _ in want], abs=2e-9)
            if [c for c, _ in near] == [c for c, _ in want]:
                assert [int(index.ids[p]) for _, p in near] == [i for _, i in want]


def test_blocks_are_skipped(examples, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    idf, ids, rows = examples
    index = make_index(ids, rows)
    index.nearest([sparse([1, 1, 1, 4], idf)], 3)
    assert 0 < index.opened < index.blocks


def test_matrices_hold_what_their_block_shares(monkeypatch):
    """Two languages without a common term: a text opens no block of the other, whose matrices hold no row of its terms."""
    for name, value in (("BLOCK", 16), ("RARE", 0.2), ("COMMON_TERMS", 60)):
        monkeypatch.setattr(toxicity, name, value)
    draw = random.Random(6)
    idf = {w: 1 + w / 60 for w in range(60)}
    rows = [sparse([2 * min(29, int(draw.expovariate(0.2))) + i % 2 for _ in range(6)], idf) for i in range(320)]
    ids = np.arange(320)
    index = make_index(ids, rows)
    back = {int(r): w for w, r in enumerate(index.row) if r >= 0}
    kinds = [{back[r] % 2 for r in found.tolist()} for found, _, _ in index.matrices]
    assert all(len(k) == 1 for k in kinds)
    # each entry is in a matrix or in a plain list
    assert sum(int((m > 0).sum()) for _, m, _ in index.matrices) + len(index.lists) == sum(len(w) for w, _ in rows)
    queries = rows[:20:2]
    for query, near in zip(queries, index.nearest(queries, 5)):
        assert [c for c, _ in near] == pytest.approx([c for c, _ in all_cosines(ids, rows, query, 5)], abs=2e-9)
    assert 0 < index.opened <= len(queries) * sum(k == {0} for k in kinds)


def test_examples_of_any_length_give_cosines(examples):
    """Weights of examples need not have length one, and entries of one term that weigh the same need a place each only."""
    idf, ids, rows = examples
    rows = [(w, x * (1 + i % 7)) for i, (w, x) in enumerate(rows)]
    index = make_index(ids, rows)
    assert index.lists.dtype == np.uint16
    unit = [(w, x / np.sqrt(x @ x)) if len(w) else (w, x) for w, x in rows]
    queries = unit[1:200:9]
    for query, near in zip(queries, index.nearest(queries, 25)):
        assert [c for c, _ in near] == pytest.approx([c for c, _ in all_cosines(ids, unit, query, 25)], abs=2e-9)


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_terms_of_many_texts_are_found_together(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    texts = ["Straße 12 abc_def", None, "Ünïted", "", "œuvre cœur’s Привет мир", "\xb2\xaa\xa0x\x85y", "one ones onesie", "a" * 40]
    text, found = toxicity.occurrences(texts)
    for i, t in enumerate(texts):
        want = Counter({int(toxicity.names([w])[0]): n for w, n in toxicity.terms(t).items()})
        assert Counter(found[text == i].tolist()) == want


@pytest.mark.parametrize("seen", [3, 1000])
def test_word_counts_equal_plain_counts(docs, labels, monkeypatch, seen):
    monkeypatch.setattr(toxicity, "SEEN", seen)
    texts = ["Straße straßen, STRASSE 12 abc_def", "", None, "one One ones oneself onesie", "ones again"]
    chosen = [True, True, False, False, True]
    rows = docs(list(enumerate(texts))).withColumn("chosen", F.col("doc_id").isin([i for i, c in enumerate(chosen) if c]))
    want = Counter(t for x in texts for t in toxicity.terms(x))
    own = {t for x, c in zip(texts, chosen) if c for t in toxicity.terms(x)}
    found = {r["name"]: r["n"] for r in toxicity.word_counts(rows).collect()}
    assert found == {int(toxicity.names([t])[0]): want[t] for t in own}


def test_known_terms_equal_plain_counts():
    texts = ["Straße straßen, STRASSE 12 abc_def", "", None, "one One ones oneself onesie", "unseen words only"]
    held = sorted({t for x in texts[:4] for t in toxicity.terms(x)})
    v = toxicity.Vocabulary.of_counts(toxicity.names(held), np.arange(len(held)), 50)
    back = {int(v.numbers[np.searchsorted(v.names, toxicity.names([t])[0])]): t for t in held}
    for x in texts * 2:
        words, times = v.counts(x)
        assert {back[w]: n for w, n in zip(words.tolist(), times.tolist())} == {t: n for t, n in toxicity.terms(x).items() if t in held}
        assert list(words) == sorted(words)


def toxic_rows(n, seed):
    draw = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        words = [f"w{draw.randrange(3000)}" for _ in range(50)]
        toxic = i % 8 == 0
        if toxic:
            words[draw.randrange(50)] = draw.choice(["Scoundrel,", "blackguard", "RASCAL!", "villainous"])
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    return rows, marks


def test_held_out_accuracy(docs, labels):
    rows, marks = toxic_rows(2400, 1)
    found = toxicity.toxicity(docs(rows), labels(marks))
    held = {r["doc_id"]: r for r in found.collect() if r["held_out"]}
    import zlib

    assert set(held) == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    right = sum(r["predicted"] == (i % 8 == 0) for i, r in held.items())
    assert right > 0.98 * len(held)
    assert all(r["evidence"] for i, r in held.items() if r["predicted"])


def test_held_out_labels_are_never_used(docs, labels):
    import zlib

    rows, marks = toxic_rows(800, 2)
    turned = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, q, t) for i, q, t in marks]
    scores = [{r["doc_id"]: r["score"] for r in toxicity.toxicity(docs(rows), labels(m)).collect()} for m in (marks, turned)]
    assert scores[0] == scores[1]


def test_sample_keeps_its_bound(docs, labels, monkeypatch):
    monkeypatch.setattr(toxicity, "EXAMPLES", 100)
    rows, marks = toxic_rows(800, 2)
    found = toxicity.build_examples(docs(rows), labels(marks))
    assert 0 < len(found.ids) <= 100


def test_a_rare_toxic_word_is_compared(docs, labels):
    """Three of forty toxic examples prove no feature (chi-square 20), but they hold the word."""
    import zlib

    ids = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 != 2][:300]
    plain = {i: " ".join(f"{chr(97 + (i * 7 + k) % 26)}{chr(97 + (i * 3 + k * k) % 26)}" for k in range(6)) for i in ids}
    own = {i: plain[i] + (" zaunkoenig" if i in ids[:3] else "") for i in ids}
    found = toxicity.build_examples(docs(list(own.items())), labels([(i, 1, int(i in ids[:40])) for i in ids]))
    ((score, evidence),) = found.scores(["zaunkoenig"])
    assert sorted(evidence) == ids[:3]
    assert score > 5 * found.index.rate


def test_toxicity_of_odd_rows(odd, empty, labels):
    for marks in ([], [(4, 1, 1)], [(4, 1, 1), (5, 1, 0), (4, 1, 1), (None, 1, 1), (6, 1, None), (2, 1, 0)]):
        found = toxicity.toxicity(odd, labels(marks)).collect()
        assert len(found) == len(ODD_ROWS)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
        assert not any(r["held_out"] for r in found if r["doc_id"] is None)
    assert toxicity.toxicity(empty, labels([])).count() == 0


# the pipeline


def test_stages_keep_their_contract(spark, sample):
    folder = "/root/testdata/sf0.001"
    docs = sample
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        if place < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == list(common.DOCUMENT_COLUMNS), name
        path = scratch(spark, "stage")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
    whole = corpus_pipeline.run(spark, folder)
    order = ["doc_id", "n_ids"]
    assert sorted(whole.select(*order).collect()) == sorted(docs.select(*order).collect())
    assert docs.filter("NOT round_trip").count() == 0


def test_stages_equal_brute_force(spark, sample):
    from llm.test_corpus import components_by_force, poisson, removed_by_force

    folder = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: (r["text"], r["source"]) for r in sample.collect()}
    kept = stages["quality rules"](spark, sample, folder)
    failed = {i for i, (t, _) in rows.items() if (c := counts_by_force(t))[0] < 20 or 100 * c[4] > 30 * c[0]}
    assert {r["doc_id"] for r in kept.collect()} == set(rows) - failed  # too few labels here for learnt rules
    rows = {i: r for i, r in rows.items() if i not in failed}

    kept = stages["line dedup"](spark, common.cut(kept, "test"), folder)
    gone = removed_by_force([(i, t) for i, (t, _) in rows.items()])
    left = {i: ("\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, [])), s) for i, (t, s) in rows.items()}
    left = {i: (t, s) for i, (t, s) in left.items() if i not in gone or t.split()}
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {i: t for i, (t, _) in left.items()}

    kept = stages["near dedup"](spark, common.cut(kept, "test"), folder)
    groups = components_by_force([(i, t) for i, (t, _) in left.items()], 5)
    left = {i: r for i, r in left.items() if groups[i][2]}
    assert {r["doc_id"] for r in kept.collect()} == set(left)

    mixed = stages["source mixing"](spark, common.cut(kept, "test"), folder)
    n = Counter(s for _, s in left.values())
    total = sum(map(math.sqrt, n.values()))
    import hashlib

    want = {}
    for i, (_, s) in left.items():
        u = (int(hashlib.md5(f"20:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        want[i] = poisson(len(left) * math.sqrt(n[s]) / total / n[s], u)
    got = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: k for i, k in want.items() if k}


def test_pipeline_of_odd_rows(spark, odd, empty, tmp_path):
    for name, docs in (("odd", odd), ("empty", empty)):
        path = str(tmp_path / name)
        common.documents(docs).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        rows = corpus_pipeline.run(spark, path).collect()
        assert {r["doc_id"] for r in rows} <= {4, 5}
