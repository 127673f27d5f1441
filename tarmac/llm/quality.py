"""Quality rules whose cutoffs are learnt from labelled holdouts with a bound on false rejections."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import cut, documents, map_rows, pick, with_ids

#: Share of good documents of one stratum that all rules together may reject, and the chance that this is missed.
RISK = 0.02
DELTA = 0.05
#: Languages with proven cutoffs are broadcast if there are no more than this.
FEW_STRATA = 100_000
#: The rules: a measure, and cutoffs from lenient to strict. A document that measures over the cutoff is rejected.
RULES = {
    "symbol_ratio": tuple(x / 100 for x in (200, 100, 75, 50, 40, 30, 25, 20, 15, 12, 10, 8, 6, 5, 4, 3)),
    "duplicate_line_ratio": tuple(x / 100 for x in (95, 90, 85, 80, 75, 70, 65, 60, 55, 50, 45, 40, 35, 30, 25, 20)),
    "repeated_neighbour_ratio": tuple(x / 100 for x in (95, 90, 80, 70, 60, 50, 45, 40, 35, 30, 25, 20, 15, 10)),
    "capital_ratio": tuple(x / 100 for x in (99, 95, 90, 85, 80, 75, 70, 65, 60, 55, 50, 45, 40)),
    "mean_word_length": (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.0),
}
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACES = b" \t\n\r\x0b\x0c"


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of ``width`` (a power of two) words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    span = 1
    while span < width:  # names of windows of twice the width
        pairs = ids[:-span] * len(words) + ids[span:]
        ids = np.unique(pairs, return_inverse=True)[1]
        span *= 2
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero((np.bincount(ids) > 1)[ids])
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: str | None) -> tuple:
    """The five counts and the measures of the rules for one text; null counts as empty."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    word_chars = len(text) - (len(data) - len(data.translate(None, _SPACES)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(_SPACES)]
    duplicates = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    neighbours = sum(a == b for a, b in zip(words, words[1:]))
    letters = len(data.translate(None, _NOT_LETTERS))
    capitals = len(data.translate(None, _NOT_CAPITALS))
    rules = (
        symbols / n if n else 0.0,
        duplicates / len(lines) if lines else 0.0,
        neighbours / (n - 1) if n > 1 else 0.0,
        capitals / letters if letters else 0.0,
        word_chars / n if n else 0.0,
    )
    return (n, word_chars, symbols, duplicates, repeats) + rules


_NOT_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))
_NOT_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)

_SCHEMA = ", ".join([f"{c} bigint" for c in COUNTS] + [f"{r} double" for r in RULES])


def measured(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Counts and measures of every document beside the columns to keep."""
    names = [*COUNTS, *RULES]
    rows = docs.select(*keep, F.col("text").alias("_text"))

    def run(batch: dict[str, list]) -> dict[str, list]:
        made = list(zip(*map(measure, batch["_text"]))) or [[]] * len(names)
        return dict(zip(names, made))

    return map_rows(rows, run, _SCHEMA, keep)


def base_failed() -> Column:
    """The fixed rules: under 20 words, or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """Logarithm of the chance of k or fewer out of n at rate p; exact, summed from the largest term."""
    if k >= n:
        return 0.0
    term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, ratio = 1.0, 1.0
    for i in range(k, 0, -1):
        ratio *= i * (1 - p) / ((n - i + 1) * p)
        total += ratio
        if ratio < 1e-17 * total:
            break
        if total > 1e250:  # far above the mean: the tail is as good as certain
            return 0.0
    return min(0.0, term + math.log(total))


def _level(strata: int, delta: float = DELTA) -> float:
    return math.log(delta / (len(RULES) * max(1, strata)))


def choose_cutoffs(counts: dict[tuple[str, str], list[int]], risk: float = RISK, delta: float = DELTA, strata: int | None = None) -> dict[tuple[str, str], float]:
    """Cutoff of each (stratum, rule): the strictest that is proven to reject few good documents.

    ``counts`` has for each stratum and rule the good documents by the number of cutoffs they exceed. A rule may reject
    ``risk`` over the number of rules; a cutoff is proven if so few rejections as seen had a chance of at most ``delta``
    over the number of (stratum, rule) pairs (Bonferroni) were its true rate higher. Within a pair cutoffs are tested from
    lenient to strict up to the first that fails, which needs no further correction. No proof, no rule. ``strata`` is
    their number where ``counts`` leaves some out.
    """
    level = _level(strata or len({s for s, _ in counts}), delta)
    chosen = {}
    for (stratum, rule), exceeded in sorted(counts.items()):
        n, rejected = sum(exceeded), 0
        for place, cutoff in enumerate(RULES[rule]):
            # a document that exceeds k cutoffs exceeds the k strictest
            rejected += exceeded[len(RULES[rule]) - place]
            if log_binomial_tail(rejected, n, risk / len(RULES)) > level:
                break
            chosen[stratum, rule] = cutoff
    return chosen


def learn_cutoffs(measures: DataFrame, labels: DataFrame) -> dict[tuple[str, str], float]:
    """Cutoffs from all labelled good documents that pass the fixed rules.

    Good is a doc_id whose labels say quality 1 at least once and never 0. Every language is a stratum. Only counts per
    stratum, rule and cutoff leave the cluster, and only of strata with so many documents that a proof is possible.
    """
    marks = pick(labels, "doc_id", "quality").filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("q"))
    good = measures.filter(~base_failed()).join(marks.filter("q = 1").select("_id"), F.col("doc_id") == F.col("_id"))
    steps = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), _exceeded(F.col(rule), cutoffs).alias("step"))
            for rule, cutoffs in RULES.items()
        ]
    )
    table = good.select(_stratum().alias("stratum"), F.explode(steps).alias("s")).groupBy("stratum", "s.rule", "s.step").count()
    table = cut(table.groupBy("stratum").agg(F.collect_list(F.struct("rule", "step", "count")).alias("steps"), F.sum("count").alias("n")), "strata")
    strata = table.count()
    least = _level(strata) / math.log1p(-RISK / len(RULES))  # fewer prove nothing, even if none is rejected
    counts: dict[tuple[str, str], list[int]] = {}
    for stratum, found in table.filter(F.col("n") >= int(least) * len(RULES)).select("stratum", "steps").toLocalIterator():
        for rule, step, n in found:
            counts.setdefault((stratum, rule), [0] * (len(RULES[rule]) + 1))[step] = n
    return choose_cutoffs(counts, strata=strata)


def _exceeded(value: Column, cutoffs: tuple[float, ...]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cutoffs)), lambda c: c < value))


def _stratum() -> Column:
    return F.coalesce("lang", F.lit(""))


def passing(rows: DataFrame, cutoffs: dict[tuple[str, str], float]) -> DataFrame:
    """The rows beside ``_passes``: whether no fixed rule and no learnt rule of the document's own stratum rejects it. A
    stratum without a proof has no learnt rules."""
    strata = sorted({s for s, _ in cutoffs})
    schema = ", ".join(["_stratum string"] + [f"_cut_{rule} double" for rule in RULES])
    table = rows.sparkSession.createDataFrame([(s, *(cutoffs.get((s, rule)) for rule in RULES)) for s in strata], schema)
    joined = rows.join(F.broadcast(table) if len(strata) <= FEW_STRATA else table, _stratum() == F.col("_stratum"), "left")
    rejected = base_failed()
    for rule in RULES:
        rejected = rejected | F.coalesce(F.col(rule) > F.col(f"_cut_{rule}"), F.lit(False))
    return joined.withColumn("_passes", ~rejected)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept, measures) of every document.

    Words are runs of other characters than the six ASCII white spaces. ``kept`` is false where the fixed rules or one of
    the learnt rules reject; see ``choose_cutoffs``. Strata are languages (null: as an empty name).

    Null text: empty, fails. Null doc_id: has no label. Repeated rows: each on its own; labels that contradict count as
    not good. Empty labels: the fixed rules alone. Empty table: empty result. Other columns are left out.
    """
    rows = cut(measured(documents(docs), ("doc_id", "lang")), "quality")
    rows = passing(rows, learn_cutoffs(rows, labels))
    return rows.select("doc_id", *COUNTS, base_failed().alias("base_failed"), F.col("_passes").alias("kept"), *RULES)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``quality`` keeps, with the columns of documents.

    Cutoffs hang on labelled documents alone, so only these are measured twice. Null, empty and repeated rows: as there; a
    kept row keeps its nulls.
    """
    docs = documents(docs)
    ids = cut(pick(labels, "doc_id").filter("doc_id IS NOT NULL").distinct(), "labelled")
    labelled = with_ids(docs, ids, "left_semi")
    cutoffs = learn_cutoffs(measured(labelled, ("doc_id", "lang")), labels)
    return passing(measured(docs, tuple(docs.columns)), cutoffs).filter("_passes").select(*docs.columns)
