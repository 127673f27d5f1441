"""Packing into windows: repeat counts of shallow length combinations by non-negative least squares."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarmac.llm.common import _arrow_schema, cut, give_back, map_rows, pick, slices
from tarmac.llm.tokens import byte_symbols

WINDOW, DEPTH = 1024, 3
#: Steps of the solver; its work depends on the window alone, not on the number of documents.
STEPS = 600
#: So many (task, length) counts are broadcast; more are joined by shuffling.
FEW_COUNTS = 1_000_000
END = 0
#: Characters of a text that are encoded at once.
PART = 1 << 20
#: How byte-level vocabularies of this kind cut a text (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BEYOND = regex.compile(r"[^\x00-ɏ]")
_CUT = regex.compile(r"(?<=[!-~]) (?=[A-Za-z])")
#: Bits for the rank of a piece among those of its length.
_BITS = 45


# ids


class Encoder:
    """Ids of texts for a byte-level vocabulary in a tokenizer's JSON file, as the library gives them.

    Texts of Latin letters are merged by a faster library with the same ranks; beyond them the two know different
    editions of Unicode, and the tokenizer's own library is asked. Texts are cut at a space between a printable ASCII
    character and an ASCII letter, where the pattern cuts them too, so that memory is bounded.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = {t["content"] for t in spec["added_tokens"]}
        byte = {c: b for b, c in enumerate(byte_symbols())}
        vocab = spec["model"]["vocab"]
        merged = [vocab[a + b] for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])]
        self.fast = None
        if merged == sorted(merged) and spec["normalizer"] is None:  # else ids are no ranks
            ranks = {bytes(map(byte.__getitem__, token)): i for token, i in vocab.items() if token not in added}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = sorted(added, key=len, reverse=True)

    def ids(self, text: str) -> np.ndarray:
        parts = [np.zeros(0, dtype="<u4")]
        start = 0
        while start < len(text):
            stop = len(text)
            if start + PART < stop and (hit := _CUT.search(text, start + PART)):
                stop = hit.start()
            parts.append(self._part(text[start:stop]))
            start = stop
        return np.concatenate(parts)

    def _part(self, text: str) -> np.ndarray:
        if self.fast is None or any(a in text for a in self.added) or _BEYOND.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for a worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# the plan


def combinations(window: int, depth: int = DEPTH) -> np.ndarray:
    """All ways to fill a window with one to ``depth`` lengths (at most three), longest first; zeros where there are fewer."""
    a, b = np.meshgrid(np.arange(window + 1), np.arange(window + 1), indexing="ij")
    c = window - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    if depth < 3:
        ok &= c == 0
    if depth < 2:
        ok &= b == 0
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def repeat_counts(histogram: np.ndarray, ways: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts x of the ways to fill a window, with least |A x - histogram|^2, where column i of A says
    how often way i uses each length. Accelerated projected gradient steps on the sparse A (three entries a column)."""
    size = len(histogram)
    scale = max(float(histogram.max()), 1.0)
    target = histogram / scale

    def apply(x: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for j in range(ways.shape[1]):
            out += np.bincount(ways[:, j], weights=x, minlength=size)
        out[0] = 0.0  # length 0 is no length
        return out

    def back(y: np.ndarray) -> np.ndarray:
        y = y.copy()
        y[0] = 0.0
        return sum(y[ways[:, j]] for j in range(ways.shape[1]))

    v = np.ones(len(ways))
    for _ in range(30):
        v = back(apply(v))
        bound = np.linalg.norm(v)
        v /= bound
    rate = 1.0 / (1.05 * bound)
    x = y = np.zeros(len(ways))
    t = 1.0
    for _ in range(steps):
        residual = apply(y) - target
        new = np.maximum(y - rate * back(residual), 0.0)
        if (residual @ apply(new - x)) > 0:  # momentum leads uphill: begin anew
            t = 1.0
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / later * (new - x)
        x, t = new, later
    return x * scale


@dataclass
class Plan:
    """Where each piece goes, by its length and its rank among the pieces of that length."""

    window: int
    keys: np.ndarray  # length << _BITS | first rank of a slot, ascending
    sequences: np.ndarray  # sequence of a slot's first piece; later ones go to the following sequences
    offsets: np.ndarray
    used: np.ndarray  # pieces of each length in slots; the rest is laid out in one line and cut
    line: np.ndarray  # place of the first piece of each length in that line
    base: int  # first sequence of the line
    whole: int  # places in the line that fill whole windows
    tail: np.ndarray  # ends of the last sequences, as distances from ``whole``: powers of two, falling

    def slots(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, whether it has a slot) of pieces."""
        inside = ranks < self.used[lengths]
        if not len(self.keys):
            return np.zeros_like(ranks), np.zeros_like(ranks), inside
        at = np.searchsorted(self.keys, (lengths << _BITS) | ranks, side="right") - 1
        return self.sequences[at] + ranks - (self.keys[at] & (1 << _BITS) - 1), self.offsets[at], inside

    def in_line(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start within the piece, length, sequence, offset) of the parts of a piece in the line."""
        place = int(self.line[length]) + (rank - int(self.used[length])) * length
        out, start = [], 0
        while start < length:
            if place < self.whole:
                sequence, first = divmod(place, self.window)
                begin, end = place - first, place - first + self.window
            else:
                i = int(np.searchsorted(self.tail, place - self.whole, side="right"))
                sequence = self.whole // self.window + i
                begin = self.whole + (int(self.tail[i - 1]) if i else 0)
                end = self.whole + int(self.tail[i])
            take = min(length - start, end - place)
            out.append((start, take, self.base + sequence, place - begin))
            start, place = start + take, place + take
        return out


def plan(histogram: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> Plan:
    """Ways to fill windows for pieces of ``histogram[length]`` pieces of each length up to the window.

    Repeat counts are solved, rounded and kept as far as there are pieces. Of what is left, greedy picks (longest first)
    that fill a window are repeated while they last; lengths that fill none are laid out in one line, which is cut at
    each window, so that nothing is padded. What the last window lacks is cut into powers of two.
    """
    left = histogram.astype(np.int64).copy()
    chosen: list[tuple[list[int], int]] = []
    ways = combinations(window, depth)
    counts = np.rint(repeat_counts(left.astype(float), ways)).astype(np.int64)
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] == 0:
            break
        parts = [int(n) for n in ways[i] if n]
        times = min(int(counts[i]), *(int(left[n]) // parts.count(n) for n in parts))
        if times > 0:
            chosen.append((parts, times))
            np.subtract.at(left, parts, times)
    line_counts = np.zeros_like(left)
    while left.any():
        room, parts = window, []
        supply = left.copy()
        while room and len(fits := np.flatnonzero(supply[: room + 1])):
            parts.append(int(fits[-1]))
            supply[fits[-1]] -= 1
            room -= int(fits[-1])
        if room:
            line_counts[parts[0]], left[parts[0]] = left[parts[0]], 0
        else:
            times = min(int(left[n]) // parts.count(n) for n in parts)
            chosen.append((parts, times))
            np.subtract.at(left, parts, times)
    used = np.zeros_like(left)
    slots = []
    sequence = 0
    for parts, times in chosen:
        offset = 0
        for n in parts:
            slots.append((n << _BITS | int(used[n]), sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    keys, sequences, offsets = (np.array(c, dtype=np.int64) for c in zip(*sorted(slots))) if slots else (np.zeros(0, dtype=np.int64),) * 3
    tokens = line_counts * np.arange(len(left))
    line = np.concatenate([[0], np.cumsum(tokens[::-1])])[:-1][::-1]  # longest first
    whole, rest = int(tokens.sum()) // window * window, int(tokens.sum()) % window
    tail = np.cumsum([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], dtype=np.int64)
    return Plan(window, keys, sequences, offsets, used, line, sequence, whole, tail)


# the job


_CUT_SCHEMA = "doc_id bigint, part int, doc_tokens bigint, full_rank bigint, full_crcs array<bigint>, tail_length int, tail_rank bigint, tail binary"


def cut_documents(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Each document's ids with the end id, cut into whole windows (their checksums) and a tail (its ids).

    ``part`` is the task that made the row; ranks count its whole windows, and its tails of each length.
    """
    rows = pick(docs, "doc_id", "text")
    target = _arrow_schema(rows.sparkSession, _CUT_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        full, tails = 0, np.zeros(window + 1, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole):
                out = []
                for text in batch.column("text").to_pylist():
                    ids = np.append(encoder(path).ids(text or ""), np.uint32(END)).astype("<u4")
                    n, crcs = len(ids), []
                    for start in range(0, n - window + 1, window):
                        crcs.append(zlib.crc32(ids[start : start + window].tobytes()))
                    rest = n % window
                    out.append((part, n, full, crcs, rest, int(tails[rest]), ids[n - rest :].tobytes()))
                    full += len(crcs)
                    tails[rest] += 1
                columns = [batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*out), list(target)[1:]))]
                yield pa.RecordBatch.from_arrays(columns, schema=target)
        give_back()

    return cut(rows.mapInArrow(run, _CUT_SCHEMA), "cut-documents")


def pack(docs: DataFrame, path: str, window: int = WINDOW, depth: int = DEPTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document.

    A document is its ids for the vocabulary at ``path`` (a place every executor can read) and the id 0. Whole windows
    are sequences of their own; tails of a length are numbered over all tasks, and the plan tells by number where each
    one goes, so that texts are read once and pieces never move. The driver sees one count for each length.

    Sequences are full, but for fewer than log2(window) last ones, whose lengths are powers of two. Null or empty text: the id 0
    alone. Null doc_id and repeated rows: documents of their own. Very long texts: encoded part by part. Empty table: empty
    result. Other columns are left out.
    """
    spark = docs.sparkSession
    table = cut_documents(docs, path, window)
    whole = table.groupBy("part").agg(F.lit(window).alias("length"), F.sum(F.size("full_crcs")).alias("n"))
    tails = table.filter("tail_length > 0").groupBy("part", F.col("tail_length").alias("length")).agg(F.count("*").alias("n"))
    counts = cut(whole.filter("n > 0").unionByName(tails), "counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "firsts")
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[length] = n
    made = spark.sparkContext.broadcast(plan(histogram, window, depth))
    if counts.count() <= FEW_COUNTS:
        firsts = F.broadcast(firsts)
    of_tails = firsts.select("part", F.col("length").alias("tail_length"), F.col("first").alias("tail_first"))
    of_whole = firsts.filter(F.col("length") == window).select("part", F.col("first").alias("full_first"))
    ranked = table.join(of_tails, ["part", "tail_length"], "left").join(of_whole, "part", "left")
    ranked = ranked.select(
        "doc_id", "doc_tokens", "full_crcs", "tail_length", "tail",
        (F.col("full_first") + F.col("full_rank")).alias("full_rank"), (F.col("tail_first") + F.col("tail_rank")).alias("tail_rank"),
    )

    def run(batch: dict[str, list]) -> dict[str, list]:
        target = made.value
        pieces = []  # row, start, length, rank, checksum
        for row, crcs in enumerate(batch["full_crcs"]):
            pieces += [(row, i * window, window, batch["full_rank"][row] + i, crc) for i, crc in enumerate(crcs)]
            if n := batch["tail_length"][row]:
                pieces.append((row, len(crcs) * window, n, batch["tail_rank"][row], zlib.crc32(batch["tail"][row])))
        row, start, length, rank, crc = (np.array(c, dtype=np.int64) for c in zip(*pieces))
        sequence, offset, inside = target.slots(length, rank)
        out = [np.stack([row, start, length, crc, sequence, offset], axis=1)[inside]]
        for i in np.flatnonzero(~inside).tolist():
            ids = batch["tail"][row[i]]
            for first, n, where, at in target.in_line(int(length[i]), int(rank[i])):
                part = ids[4 * first : 4 * (first + n)]
                out.append(np.array([[row[i], start[i] + first, n, zlib.crc32(part), where, at]]))
        row, start, length, crc, sequence, offset = np.concatenate(out).T
        return {
            "doc_id": [batch["doc_id"][r] for r in row.tolist()], "start": pa.array(start), "length": pa.array(length),
            "ids_crc32": pa.array(crc), "doc_tokens": [batch["doc_tokens"][r] for r in row.tolist()],
            "sequence_id": pa.array(sequence), "offset": pa.array(offset),
        }

    return map_rows(ranked, run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
