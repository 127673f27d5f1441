"""Secret scan: fixed patterns, and the guess cost of values that stand where credentials stand."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import cut, map_rows, pick

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Names that announce a credential, then a sign or a quote, then the value. A name begins where a word does: not behind a
#: letter of its own case (``compass:``), but behind one of the other (``dbPassword:``).
CONTEXT = re.compile(
    r"""(?ai)(?<!(?-i:[a-z](?=[a-z])|[A-Z](?=[A-Z])))(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|signing)[_-]?key|auth(?:orization)?|credentials?|bearer)"""
    r"""["']?(?:[\x20\t]*+(?:=>|:=|[:=])[\x20\t]*+(?:bearer[\x20\t]++|basic[\x20\t]++)?["']?|\x20["'])([^\s"'<>,;]{6,})"""
)
_MARKS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer")
#: A value is a secret if guessing it takes this many tries or more, as a power of ten.
LOG_GUESSES = 10.0

# Words of passwords by rank (fixed values: the commonest, in everyday use).
COMMON_WORDS = (
    "password the and you that was for are with his they this have from one had word but not what all were when your can "
    "said there use each which she how their will other about out many then them these some her would make like him into "
    "time has look two more write see number way could people admin root user test login welcome letmein dragon monkey "
    "master shadow sunshine princess football baseball secret hello world love summer winter spring autumn example sample "
    "change changeme default guest server database token key pass temp demo dummy null none true false your here xxxx "
    "placeholder insert company public private"
).split()
WORD_RANK = {w: i for i, w in reversed(list(enumerate(COMMON_WORDS, 1)))}
#: Words of the documents that count as known: at most so many, in at least so many documents, of at most so many letters.
DICTIONARY = 50_000
LEAST_DOCUMENTS = 20
LONGEST_WORD = 20
#: A word stands between spaces, quotes, brackets and stops, so that parts of keys and paths are none.
PLAIN_WORD = r"""(?<![^\s"'(])\p{Ll}{3,20}+(?![^\s.,;:!?"')])"""
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_KEY_AT = {c: (r, i) for r, row in enumerate(KEY_ROWS) for i, c in enumerate(row)}
_LEET = str.maketrans("@4301$5!7", "aaeoissit")
_DATE = re.compile(r"(?a)(?:\d{1,2}([-/._]?)\d{1,2}\1(?:19|20)\d\d|(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])|(?:19|20)\d\d)")
#: Longest unit of a repeat.
LONGEST_UNIT = 16


def _char_cost(c: str) -> float:
    """Power of ten of the characters of the same sort."""
    if c.isascii():
        return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)
    return 2.0


def word_ranks(docs: DataFrame, most: int = DICTIONARY, least: int = LEAST_DOCUMENTS) -> dict[str, int]:
    """Ranks of words: the fixed ones first, then those of the documents by the number of documents they are in.

    Counts are over all whole texts. The driver gets at most ``most`` words: classes of like frequency (16 for each doubling) are
    taken from the commonest on, and the first that does not fit ends the list, so that no order of all words is needed.
    """
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(PLAIN_WORD), F.lit(0)))).alias("word")
    counts = docs.select(found).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    counts = cut(counts, "words")
    step = F.floor(F.log2("n") * 16).cast("int")
    total, lowest = 0, None
    for power, words in sorted(counts.groupBy(step.alias("power")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        total += words
        if total > most:
            break
        lowest = power
    ranks = dict(WORD_RANK)
    if lowest is not None:
        kept = counts.filter(step >= lowest).collect()
        for word, _ in sorted(kept, key=lambda r: (-r["n"], r["word"])):
            ranks.setdefault(word, len(ranks) + 1)
    return ranks


def log_guesses(value: str, ranks: dict[str, int] = WORD_RANK) -> float:
    """Least power of ten of the tries that find the value, over all ways to cut it into words, dates, repeats, keyboard
    walks and spans of brute force.

    ``cost[i]`` is the least cost of the first i characters. A span of brute force may end anywhere, so it is added
    character by character; a new piece of another sort costs the choice of its sort. Repeats and walks may start and end
    anywhere, too: their price grows with the logarithm of their length, so of two starts the earlier one, once cheaper,
    stays so, and a few starts are left. Words and dates are short, so time is linear in the length. ``ranks`` are the known words.
    """
    n = len(value)
    low = value.lower()
    if len(low) != n:
        low = value
    plain = low.translate(_LEET)
    spent = [0.0]
    for c in value:
        spent.append(spent[-1] + _char_cost(c))
    cost = [0.0] + [math.inf] * n
    brute = [math.inf] * (n + 1)
    equal = [0] * (LONGEST_UNIT + 1)
    starts: list[dict[int, list[int]]] = [{} for _ in range(LONGEST_UNIT + 1)]
    walks: list[int] = []
    turns = [0] * (n + 1)
    for i in range(n + 1):
        for unit in range(1, min(LONGEST_UNIT, i - 1) + 1):
            equal[unit] = equal[unit] + 1 if value[i - 1] == value[i - 1 - unit] else 0
            if equal[unit] < unit:
                starts[unit].pop(i % unit, None)
                continue
            held = starts[unit].setdefault(i % unit, [])
            held.append(i - 2 * unit)
            least = math.inf
            kept = []
            for s in held:
                price = cost[s] + (0.3 if s else 0.0) + math.log10((i - s) // unit)
                if price < least:
                    kept.append(s)
                    if i - s >= 3:
                        cost[i] = min(cost[i], price + spent[i] - spent[i - unit])
                    least = price
            starts[unit][i % unit] = kept
        if i >= 2:
            step = _step(low[i - 2], low[i - 1])
            turns[i - 1] = turns[i - 2] + (step is not None and i >= 3 and step != last)  # noqa: F821  (set by the step before)
            last = step  # noqa: F841
            walks = [*walks, i - 2] if step is not None else []
            least = math.inf
            kept = []
            for s in walks:
                price = cost[s] + (0.3 if s else 0.0) + math.log10(i - s) + (1 + turns[i - 1] - turns[s + 1]) * math.log10(6)
                if price < least:
                    kept.append(s)
                    if i - s >= 3:
                        cost[i] = min(cost[i], price + math.log10(47))
                    least = price
            walks = kept
        here = cost[i] = min(cost[i], brute[i])
        if i == n:
            break
        begun = here + (0.3 if i else 0.0)
        brute[i + 1] = min(brute[i], begun) + _char_cost(value[i])
        for end in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            for spelt, extra in ((low[i:end], 0.0), (plain[i:end], 0.5)):
                if spelt in ranks:
                    case = 0.0 if value[i:end].islower() or not any(map(str.isalpha, value[i:end])) else 0.3
                    cost[end] = min(cost[end], begun + math.log10(ranks[spelt] + 1) + extra + case)
                    break
        if low[i].isdigit():
            for end in range(i + 4, min(n, i + 10) + 1):
                if _DATE.fullmatch(value, i, end):
                    cost[end] = min(cost[end], begun + (math.log10(365 * 100) + 0.3 if end - i > 4 else 2.0))
    return cost[n]


def _step(a: str, b: str) -> tuple[int, int] | None:
    """The way from one key to a neighbouring one."""
    if a not in _KEY_AT or b not in _KEY_AT:
        return None
    (r, i), (s, j) = _KEY_AT[a], _KEY_AT[b]
    return (s - r, j - i) if abs(s - r) <= 1 and abs(j - i) <= 1 and (r, i) != (s, j) else None


def scan(text: str | None, ranks: dict[str, int] = WORD_RANK) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind. Code points, end exclusive."""
    if not text:
        return []
    spans = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    low = text.lower()
    if any(mark in low for mark in _MARKS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        taken = sorted(spans)
        first = [a for a, _, _ in taken]
        reach = list(accumulate((b for _, b, _ in taken), max))
        for m in CONTEXT.finditer(text):
            start, end = m.span(1)
            before = bisect_right(first, start)
            if not (before and end <= reach[before - 1]) and log_guesses(text[start:end], ranks) >= LOG_GUESSES:
                spans.append((start, end, "guess"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """Secrets of every document: counts by kind, the SHA-256 of the base spans, all spans, the cheapest guess.

    Base spans come from three patterns. The method adds a span of kind ``guess`` for a whole value behind the name of a
    credential that no base span covers in full and that takes 10^10 guesses or more; ``n_weak`` counts values of base
    assignments that take fewer. Known words are a fixed list and the commonest of the documents (``word_ranks``).

    Null or empty text: no spans, the hash of the empty string. Null doc_id and repeated rows: rows of their own. Empty
    table: empty result. Other columns are left out.
    """
    rows = pick(docs, "doc_id", "text")
    known = docs.sparkSession.sparkContext.broadcast(word_ranks(rows))

    def run(batch: dict[str, list]) -> dict[str, list]:
        out = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "n_weak")}
        for text in batch["text"]:
            spans = scan(text, known.value)
            base = [s for s in spans if s[2] != "guess"]
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(s[2] == kind for s in spans))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(spans))
            values = [ASSIGN.match(text, start)[2] for start, _, kind in base if kind == "assign"]
            out["n_weak"].append(sum(log_guesses(v, known.value) < LOG_GUESSES for v in values))
        return out

    schema = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint, n_weak bigint"
    return map_rows(rows, run, schema, ("doc_id",))
