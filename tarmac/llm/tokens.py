"""Token counts of byte-pair encoding by merging whole batches of pre-tokens at once."""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarmac.llm.common import map_rows, pick

LIMIT = 2048
#: A task remembers the counts of so many words, none longer than 64 characters, then begins anew.
REMEMBERED = 150_000
_SPACE = regex.compile(r"\p{White_Space}+")
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
_BEYOND = regex.compile(r"[^\x00-\u024f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else the next from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Counter:
    """Counts of tokens for a vocabulary with word ends, read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.byte = {c: b for b, c in enumerate(symbols)}
        self.inner = np.array([vocab[c] for c in symbols], dtype=np.int64)
        self.last = np.array([vocab[c + self.end] for c in symbols], dtype=np.int64)
        pairs = [(vocab[a] << 20 | vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])]
        # of a pair listed twice the later rank holds
        self.keys, self.ranks, self.made = (np.array(x, dtype=np.int64) for x in zip(*sorted({p[0]: p for p in pairs}.values())))
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.library = Tokenizer.from_file(path)
        self.known: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        """Words between white spaces of a piece without special tokens, composed and in lower case.

        No pre-token holds white space, so words can be counted one by one. Beyond Latin letters the library's own
        normalizer is asked, since the two know different editions of Unicode.
        """
        if _BEYOND.search(text):
            text = self.library.normalizer.normalize_str(text)
        else:
            text = unicodedata.normalize("NFC", text).lower()
        return _SPACE.split(text) if _SEPARATORS.search(text) else text.split()

    def pre_tokens(self, word: str) -> list[bytes]:
        if _BEYOND.search(word):
            return [bytes(map(self.byte.__getitem__, piece)) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(word)]
        return [piece.encode() for piece in self.split.findall(word)]

    def merged(self, data: list[bytes]) -> np.ndarray:
        """Number of symbols left of each pre-token: all are merged in step, each at its lowest rank."""
        if not data:
            return np.zeros(0, dtype=np.int64)
        lengths = np.array([len(d) for d in data], dtype=np.int64)
        flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        owner = np.repeat(np.arange(len(data)), lengths)
        counts = lengths.copy()
        while len(symbols) > 1:
            same = owner[1:] == owner[:-1]
            keys = symbols[:-1] << 20 | symbols[1:]
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = same & (self.keys[place] == keys)
            rank = np.where(found, self.ranks[place], np.iinfo(np.int64).max)
            starts = np.flatnonzero(np.concatenate([[True], ~same]))  # first symbol of each word
            rank = np.append(rank, np.iinfo(np.int64).max)
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            open_ = lowest < np.iinfo(np.int64).max
            if not open_.any():
                break
            hit = rank == np.repeat(lowest, sizes)
            hit &= np.repeat(open_, sizes)
            # of pairs that overlap (a a a) every second one from the left is merged
            runs = np.flatnonzero(hit[1:] & hit[:-1])
            if len(runs):
                at = np.flatnonzero(hit)
                new = np.concatenate([[True], np.diff(at) != 1])
                first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
                hit[at[(at - first) % 2 == 1]] = False
            at = np.flatnonzero(hit)
            symbols[at] = self.made[place[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            np.subtract.at(counts, owner[at], 1)
            keep &= np.repeat(open_, sizes)  # words without a pair to merge are done
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        parts = []
        for text in texts:
            specials = 0
            words: list[str] = []
            if "<|" in text:
                pieces = self.special.split(text)
                specials = len(pieces) - 1
                for piece in pieces:
                    words += self.words(piece)
            else:
                words = self.words(text)
            parts.append((specials, words))
        known = self.known
        new = {w for _, words in parts for w in words}.difference(known)
        if new and len(known) > REMEMBERED:
            known.clear()
            new = {w for _, words in parts for w in words}
        self._learn(new)
        out = [specials + sum(map(known.__getitem__, words)) for specials, words in parts]
        for w in new:
            if len(w) > 64:
                del known[w]
        return out

    def _learn(self, words: set[str]) -> None:
        """Count new words, so many at a time that their arrays stay small."""
        chunk, pieces, size = [], [], 0
        for word in words:
            own = self.pre_tokens(word)
            chunk.append((word, len(own)))
            pieces += own
            size += len(word)
            if size > 200_000:
                self._remember(chunk, pieces)
                chunk, pieces, size = [], [], 0
        self._remember(chunk, pieces)

    def _remember(self, chunk: list[tuple[str, int]], pieces: list[bytes]) -> None:
        ends = np.cumsum([n for _, n in chunk], dtype=np.int64)
        sums = np.concatenate([[0], np.cumsum(self.merged(pieces))])
        self.known.update(zip((w for w, _ in chunk), np.diff(np.concatenate([[0], sums[ends]])).tolist()))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for a worker process and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document for the vocabulary at ``path``.

    ``path`` is where the vocabulary lies on every executor. Special tokens in a text count as one token each.

    Null or empty text: no bytes, no tokens. Null doc_id and repeated rows: rows of their own. Empty table: empty result.
    Other columns are left out.
    """
    rows = pick(docs, "doc_id", "text")

    def run(batch: dict[str, list]) -> dict[str, list]:
        texts = [t or "" for t in batch["text"]]
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": counter(path).count(texts)}

    counted = map_rows(rows, run, "n_bytes bigint, n_tokens bigint", ("doc_id",))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
