"""Periodic runs of words, caught online by completed power-of-two blocks."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from tarmac.llm.common import map_rows, pick

#: A run holds at least so many periods and so many words.
EXPONENT, LEAST = 4, 6
#: Words appended at once, and bytes of text cut into words at once.
PART = 1 << 16
PART_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Catchers:
    """Runs in a sequence of word numbers that arrives part by part.

    Level j looks for periods from 2^j to 2^(j+1) - 1. Its catchers are the completed blocks of 2^k words that start at
    multiples of 2^k, with the largest k for which every long enough run of such a period holds a whole block and its copy
    one period later. Each appended word completes one window of 2^k words for each level, which is compared, by
    fingerprint, with the catchers in reach. Where they agree, suffixes are compared word by word, to the left at once and
    to the right as words arrive: from one period of equal words on, these are squares, which merge into one run.
    """

    def __init__(self, exponent: int = EXPONENT, least: int = LEAST):
        self.exponent, self.least = exponent, least
        self.n = 0
        self.words = np.zeros(64, dtype=np.int64)
        self.sums = np.zeros(65, dtype=np.uint64)  # running sums of word x base^place
        self.powers = np.ones(65, dtype=np.uint64)
        self.cover_end = np.zeros(64, dtype=np.int64)  # end and period of a known run over a word
        self.cover_period = np.ones(64, dtype=np.int64)
        self.open: dict[int, int] = {}  # period -> first place whose word equals the one a period before, so far to the end
        self.seen: dict[int, int] = {}  # period -> end of its last compared stretch
        self.caught: dict[int, int] = {}  # period -> the stretch whose square was reported last
        self.done: dict[int, int] = {}  # level -> words whose windows were compared; a level opens when a run fits
        self.runs: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
        self.squares: list[tuple[int, int]] = []

    def _grow(self, size: int) -> None:
        if size > len(self.words):
            more = max(size, 2 * len(self.words))
            for name, room, fill in (("words", more, 0), ("sums", more + 1, 0), ("powers", more + 1, 1), ("cover_end", more, 0), ("cover_period", more, 1)):
                old = getattr(self, name)
                new = np.full(room, fill, dtype=old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)

    def append(self, words: np.ndarray) -> list[tuple[int, int]]:
        """Take the next words; gives the first new square of each stretch as (start, period)."""
        old, n = self.n, self.n + len(words)
        if n == old:
            return []
        self._grow(n)
        self.words[old:n] = words
        steps = np.full(n - old, _BASE, dtype=np.uint64)
        self.powers[old + 1 : n + 1] = self.powers[old] * np.multiply.accumulate(steps)
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        self.sums[old + 1 : n + 1] = self.sums[old] + np.cumsum(mixed * self.powers[old:n], dtype=np.uint64)
        self.n, self.squares = n, []
        for period, first in list(self.open.items()):
            self._stretch(first, self._right(old, period), period)
        level = 0
        while self.exponent << level <= n:
            self._catch(level, self.done.get(level, 0), n)
            self.done[level] = n
            level += 1
        return self.squares

    def _catch(self, level: int, old: int, n: int) -> None:
        short = 1 << level
        k = ((self.exponent - 1) * short + 1).bit_length() - 2  # largest with 2^(k+1) - 1 <= (exponent - 1) 2^level
        size = 1 << k
        new = np.arange(max(short, old - size + 1), n - size + 1)  # windows that are complete now
        found = []
        for back in range(max(1, short >> k)):
            block = (new - short >> k << k) - (back << k)
            ok = (block >= 0) & (new - block < 2 * short)
            window, block = new[ok], block[ok]
            left = self.sums[block + size] - self.sums[block]
            right = self.sums[window + size] - self.sums[window]
            same = left * self.powers[window - block] == right
            found.append(np.stack([window[same], block[same]]))
        window, block = np.concatenate(found, axis=1)
        period = window - block
        # inside a known run, multiples of its period are nothing new
        fresh = (self.cover_end[block] < window + size) | (period % self.cover_period[block] != 0)
        window, period = window[fresh], period[fresh]
        order = np.lexsort((window, period))
        for at, p in zip(window[order].tolist(), period[order].tolist()):
            if at + size > self.seen.get(p, 0):
                self._stretch(self._left(at, p), self._right(at, p), p)

    def _stretch(self, first: int, end: int, period: int) -> None:
        """Words of [first, end) equal those a period before."""
        self.seen[period] = end
        start, length = first - period, end - first + period
        if end - first >= period and self.caught.get(period) != first:
            self.caught[period] = first
            self.squares.append((start, period))
        if length >= max(self.least, self.exponent * period):
            if end < self.n:
                self._run(start, end, period)
            longer = self.cover_end[start:end] < end
            self.cover_end[start:end][longer] = end
            self.cover_period[start:end][longer] = period
        if end == self.n:
            self.open[period] = first
        else:
            self.open.pop(period, None)

    def _run(self, start: int, end: int, period: int) -> None:
        self.runs[start, end] = min(period, self.runs.get((start, end), period))

    def _right(self, at: int, period: int) -> int:
        """First place from ``at`` on whose word differs from the one a period before."""
        step = 32
        while at < self.n:
            stop = min(at + step, self.n)
            same = self.words[at:stop] == self.words[at - period : stop - period]
            if not same.all():
                return at + int(same.argmin())
            at, step = stop, min(2 * step, PART)
        return at

    def _left(self, at: int, period: int) -> int:
        """Smallest place such that all words from it to ``at`` equal those a period before."""
        step = 32
        while at > period:
            stop = max(at - step, period)
            same = self.words[stop:at] == self.words[stop - period : at - period]
            if not same.all():
                return at - int(same[::-1].argmin())
            at, step = stop, min(2 * step, PART)
        return at

    def found(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs up to the last word, by start and period."""
        runs = dict(self.runs)
        for period, first in self.open.items():
            start, end = first - period, self.n
            if end - start >= max(self.least, self.exponent * period):
                runs[start, end] = min(period, runs.get((start, end), period))
        return sorted(((start, end - start, p) for (start, end), p in runs.items()), key=lambda r: (r[0], r[2]))


def word_numbers(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as places in a list of its different words."""
    data = (text or "").encode()
    place: dict[bytes, int] = {}
    parts = [np.zeros(0, dtype=np.int64)]
    start = 0
    while start < len(data):
        stop = len(data)
        if start + PART_BYTES < stop and (hit := _SPACE.search(data, start + PART_BYTES)):
            stop = hit.start()
        parts.append(np.array([place.setdefault(w, len(place)) for w in data[start:stop].split()], dtype=np.int64))
        start = stop
    return np.concatenate(parts), list(place)


def find_runs(numbers: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a sequence of word numbers."""
    catchers = Catchers(exponent, least)
    for start in range(0, len(numbers), PART):
        catchers.append(numbers[start : start + PART])
    return catchers.found()


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: in every run, the first period only."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def joined_sha256(numbers: np.ndarray, words: list[bytes]) -> str:
    digest = hashlib.sha256()
    for start in range(0, len(numbers), PART):
        digest.update(b" " * (start > 0) + b" ".join([words[i] for i in numbers[start : start + PART].tolist()]))
    return digest.hexdigest()


def rewritten(numbers: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The test rule of the query: every tenth document, by the checksum of its id, gets a tail that repeats."""
    n = len(numbers)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return numbers
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    return numbers[np.where(places >= a, a + (places - a) % p, places)]


def periodic_runs(docs: DataFrame, rewrite: bool = False, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_words, n_dropped) per document.

    A run is a longest stretch of words that repeats with a smallest period q, of at least ``exponent`` periods and ``least``
    words; words are runs of other characters than the six ASCII white spaces. The longest run is shown (ties: smallest
    start, then period); ``runs_sha256`` names all of them, ``collapsed_sha256`` the words that are left when each run keeps
    its first period only. ``rewrite`` makes the words of every tenth document repeat first.

    Null or empty text, white space only: no words, no run, four nulls, digests of nothing. Null doc_id: a row of its own,
    never rewritten. Repeated rows: a row each. Long texts: appended part by part; memory is some 50 bytes a word. Empty
    table: empty result. Other columns are left out.
    """
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words", "n_dropped")

    def run(batch: dict[str, list]) -> dict[str, list]:
        made = []
        for doc_id, text in zip(batch["id"], batch["text"]):
            numbers, words = word_numbers(text)
            if rewrite:
                numbers = rewritten(numbers, doc_id)
            runs = find_runs(numbers, exponent, least)
            kept = numbers[kept_words(len(numbers), runs)] if runs else numbers
            start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
            made.append(
                (
                    len(runs), start, length, period, 1000 * length // period if runs else None,
                    hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
                    joined_sha256(kept, words), len(numbers), len(numbers) - len(kept),
                )
            )
        return dict(zip(columns, map(list, zip(*made))))

    kinds = ", ".join(f"{c} {'string' if c.endswith('sha256') else 'bigint'}" for c in columns)
    rows = pick(docs, "doc_id", "text").selectExpr("doc_id", "doc_id AS id", "text")
    return map_rows(rows, run, kinds, ("doc_id",))
