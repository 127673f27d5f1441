"""Toxicity by nearest labelled examples: exact TF-IDF cosines from a block-max inverted index, votes weighted by distance."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import FEW_IDS, cut, map_rows, pick, slices

#: At most so many labelled rows become examples, those whose ids have the smallest hashes.
EXAMPLES = 20_000
BEGINNINGS = (4, 5)
NEIGHBOURS = 25
THRESHOLD = 0.3
#: Weight of a vote is one over the square of the distance (one minus the cosine) plus this.
NEAREST = 0.05
#: The overall rate counts as one more vote of weight 1.
PRIOR = 1.0
BLOCK = 512
#: Examples are put in order by so many of the commonest terms. Entries of a list in a block are added in full where the
#: share of the block's examples that hold the term, times the share of those around them, is at most the square of RARE. All
#: four numbers set the speed, not results.
COMMON_TERMS = 256
RARE = 0.15
TOGETHER = 1024
#: Blocks that are opened first, for a floor.
FIRST = 2
#: Room for sums of floats in two lengths.
SLACK = 2e-5
REMEMBERED = 100_000
#: Rows of counts that a task holds before it hands them on.
SEEN = 300_000
#: Characters that are named at once, more where a word is longer.
PIECE = 1 << 16
_WORD = re.compile(r"[^\W\d_]+")
#: Entries of one list that weigh the same.
_RUN = np.dtype([("weight", "f8"), ("size", "i8")])
#: Of the first 256 characters, all but those of words are spaces.
_LETTERS = bytes(c if _WORD.match(chr(c)) else 32 for c in range(256))


def words_of(text: str | None) -> list[str]:
    """Words in lower case, in order."""
    low = (text or "").lower()
    try:
        return low.encode("latin-1").translate(_LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(low)


def terms(text: str | None) -> Counter:
    """How often each term occurs: words in lower case, and words' beginnings of four and five letters (``abcd*``)."""
    out = Counter(words_of(text))
    begun: dict[str, int] = {}
    for word, n in out.items():
        for start in _beginnings(word):
            begun[start] = begun.get(start, 0) + n
    out.update(begun)
    return out


def _beginnings(word: str) -> list[str]:
    return [word[:length] + "*" for length in BEGINNINGS if len(word) >= length]


def _spread(codes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each character."""
    out = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of a number modulo 2^64, and those of its inverse."""
    base = 0xD6E8FEB86659FD93
    out = []
    for number in (base, pow(base, -1, 1 << 64)):
        powers = np.full(n + 1, number, dtype=np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers))
    return out[0], out[1]


_SPREAD = _spread(np.arange(256))
_POWERS = _powers(PIECE)
#: What the star behind a beginning of each length adds to its name.
_STARS = _SPREAD[[ord("*")]] * _POWERS[0][: max(BEGINNINGS) + 1]


def _named(codes: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Where each word starts among these characters, all but spaces; for words and for beginnings of each length, which
    words have one, and its name: the sum of its characters' numbers times powers, so sums up to each character give all."""
    n = len(codes)
    up, down = _POWERS if n <= PIECE else _powers(n)
    edges = np.flatnonzero(np.diff((codes != 32).view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_SPREAD[codes] if codes.dtype == np.uint8 else _spread(codes)) * up[:n], out=sums[1:])
    made = [(np.ones(len(starts), dtype=bool), (sums[ends] - sums[starts]) * down[starts])]
    for length in BEGINNINGS:
        fits = ends - starts >= length
        first = starts[fits]
        made.append((fits, (sums[first + length] - sums[first]) * down[first] + _STARS[length]))
    return starts, [(fits, name.view(np.int64)) for fits, name in made]


def names(found: Iterable[str]) -> np.ndarray:
    """64-bit names of terms."""
    return _named(np.frombuffer(" ".join(found).encode("utf-32-le"), dtype=np.uint32))[1][0][1]


def occurrences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The terms of these texts, each as often as it occurs: numbers of the texts, names of the terms."""
    plain, other = [], []
    for i, text in enumerate(texts):
        low = (text or "").lower()
        try:
            plain.append((i, low.encode("latin-1")))
        except UnicodeEncodeError:
            other.append((i, " ".join(_WORD.findall(low))))
    buffers = [
        (plain, np.frombuffer(b" ".join(x for _, x in plain).translate(_LETTERS), dtype=np.uint8)),
        (other, np.frombuffer(" ".join(x for _, x in other).encode("utf-32-le"), dtype=np.uint32)),
    ]
    owners, found = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for group, codes in buffers:
        which = np.array([i for i, _ in group], dtype=np.int64)
        ends = np.cumsum([len(x) + 1 for _, x in group])
        start = 0
        while start < len(codes):
            end = start + PIECE
            if end < len(codes):
                gaps = np.flatnonzero(codes[start:end] == 32)
                if len(gaps):
                    end = start + int(gaps[-1]) + 1
                else:  # within a long word
                    gaps = np.flatnonzero(codes[end:] == 32)
                    end = end + int(gaps[0]) + 1 if len(gaps) else len(codes)
            places, made = _named(codes[start:end])
            owner = which[np.searchsorted(ends, places + start, side="right")]
            for fits, name in made:
                owners.append(owner[fits])
                found.append(name)
            start = end
    return np.concatenate(owners), np.concatenate(found)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) to learn from: labels 0 or 1 of rows that are not held out; several labels, the highest."""
    marks = pick(labels, "doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = marks.count() <= FEW_IDS
    return docs.join(F.broadcast(marks) if few else marks, "doc_id")


def word_counts(rows: DataFrame) -> DataFrame:
    """(name, n): in how many labelled rows each term occurs, for the terms of the examples (rows with ``chosen``)."""

    def merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        found, counts, own = (np.concatenate([h[i] for h in held]) for i in range(3))
        found, place = np.unique(found, return_inverse=True)
        return found, np.bincount(place, counts, len(found)).astype(np.int64), np.bincount(place, own, len(found)) > 0

    def counted(texts: list[str | None], chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        text, found = occurrences(texts)
        found, place = np.unique(found, return_inverse=True)
        key = np.sort(place * len(texts) + text)
        place, text = np.divmod(key[np.flatnonzero(np.diff(key, prepend=-1))], len(texts))
        return found, np.bincount(place, minlength=len(found)), np.bincount(place, chosen[text], len(found)) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for whole in batches:
            for part in slices(whole):
                held.append(counted(part.column("text").to_pylist(), np.array(part.column("chosen").to_pylist(), dtype=bool)))
                if sum(len(h[0]) for h in held) > SEEN:
                    held = [merged(held)]
                    if len(held[0][0]) > SEEN // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["name", "n", "own"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(held)], names=["name", "n", "own"])

    counts = rows.select("text", "chosen").mapInArrow(run, "name bigint, n bigint, own boolean").groupBy("name")
    return counts.agg(F.sum("n").alias("n"), F.max("own").alias("own")).filter("own").select("name", "n")


class Vocabulary:
    """The terms of the examples: their names and, as numbers from the commonest on, their places and weights."""

    def __init__(self, sorted_names: np.ndarray, numbers: np.ndarray, idf: np.ndarray):
        self.names, self.numbers, self.idf = sorted_names, numbers, idf

    @classmethod
    def of_counts(cls, found: np.ndarray, counts: np.ndarray, total: int) -> Vocabulary:
        order = np.argsort(found)
        found, counts = found[order], counts[order]
        commonest = np.argsort(-counts, kind="stable")
        numbers = np.empty(len(found), dtype=np.int32)
        numbers[commonest] = np.arange(len(found), dtype=np.int32)
        return cls(found, numbers, np.log((1 + total) / (1 + counts[commonest])) + 1)

    def counts_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many known terms each text holds; their numbers, ascending in each text, and how often each occurs there."""
        text, found = occurrences(texts)
        found, place = np.unique(found, return_inverse=True)
        at = np.searchsorted(self.names, found)
        known = np.zeros(len(found), dtype=bool)
        known[at < len(self.names)] = self.names[at[at < len(self.names)]] == found[at < len(self.names)]
        number = np.full(len(found), -1, dtype=np.int64)
        number[known] = self.numbers[at[known]]
        number = number[place]
        key = np.sort((text * len(self.names) + number)[number >= 0])
        first = np.flatnonzero(np.diff(key, prepend=-1))
        text, words = np.divmod(key[first], max(1, len(self.names)))
        return np.bincount(text, minlength=len(texts)), words, np.diff(first, append=len(key))

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known terms of a text, ascending, and how often each occurs."""
        return self.counts_of([text])[1:]

    def vectors(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms of every text and their TF-IDF, of length one."""
        sizes, words, times = self.counts_of(texts)
        raw = (1 + np.log(times)) * self.idf[words]
        norms = np.sqrt(np.bincount(np.repeat(np.arange(len(texts)), sizes), raw**2, len(texts)))
        raw /= np.repeat(norms, sizes)
        cuts = np.cumsum(sizes).tolist()
        return [(words[a:b], raw[a:b]) for a, b in zip([0, *cuts], cuts)]


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of these ranges, one range after the other, and the sizes of the ranges."""
    sizes = ends - starts
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes), sizes


def sliced(data: bytes, size: int, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """These ranges of items of so many bytes; slices of bytes cost less than slices of an array."""
    return [data[s:e] for s, e in zip((size * starts).tolist(), (size * ends).tolist())]


def alike(rows: np.ndarray) -> np.ndarray:
    """An order in which like rows lie together: halves along the direction of most spread, again and again."""
    order = np.arange(len(rows))
    todo = [(0, len(rows))]
    while todo:
        start, end = todo.pop()
        if end - start <= BLOCK:
            continue
        part = rows[order[start:end]]
        part = part - part.mean(axis=0)
        way = part[int(np.argmax((part**2).sum(axis=1)))]
        for _ in range(4):
            way = part.T @ (part @ way)
            way /= max(float(np.sqrt(way @ way)), 1e-30)
        order[start:end] = order[start:end][np.argsort(part @ way, kind="stable")]
        middle = start + -(-(end - start) // (2 * BLOCK)) * BLOCK
        todo += [(start, middle), (middle, end)]
    return order


class Index:
    """Inverted lists of the examples, which are kept in blocks of 512 like ones, each list with its maximum in every block.

    Where more than a few examples of a block hold a term, the list's entries there are a row of the block's matrix; all
    others, with little to bound, are plain lists that are added in full. A plain list is cut into runs of equal weight,
    since a term that occurs as often weighs the same before examples are brought to length one; so an entry is a place
    only, and sums are divided by the examples' lengths. What a row of a matrix adds to an example is at
    most the query's weight times the row's maximum; the sum of these products, or the product of the lengths of both
    vectors if that is less, and the largest sum of plain lists bound every cosine in a block. The blocks of the best bounds
    are opened first, the k-th cosine in them is a floor, and all other blocks whose bound reaches it are opened: their
    matrices are multiplied by the weights of all texts that open them, since texts are searched many at once. What comes
    near the k-th sum is added up again in doubles, so the result is exact.
    """

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, sizes: np.ndarray, words: np.ndarray, weights: np.ndarray, n_terms: int):
        """Terms of an example ascend; its weights may have any length."""
        starts = np.concatenate([[0], np.cumsum(sizes)])
        filled = np.flatnonzero(sizes)
        self.rate = float(toxic.mean()) if len(toxic) else 0.0
        empty = toxic[sizes == 0]
        self.rate_empty = (float(empty.sum()) + PRIOR * self.rate) / (len(empty) + PRIOR)
        n = len(filled)
        self.blocks = -(-n // BLOCK)
        self.opened = 0
        norms = np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights**2, len(sizes)))
        common = min(COMMON_TERMS, n_terms)
        often = np.flatnonzero(words < common)
        rows = np.zeros((len(sizes), common), dtype=np.float32)
        which = np.searchsorted(starts, often, side="right") - 1
        rows[which, words[often]] = weights[often] / norms[which]
        order = filled[alike(rows[filled])] if n else filled
        del rows, often, which
        self.ids, self.toxic = ids[order], toxic[order].astype(np.float64)
        self.first, self.last, self.norms = starts[:-1][order], starts[1:][order], norms[order]
        self.words, self.weights = words, weights
        self.shorten = np.zeros(self.blocks * BLOCK)
        self.shorten[:n] = 1 / self.norms
        #: of every block: its terms, its matrix (terms x examples), the largest of each row
        self.matrices: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.length = np.zeros(self.blocks, dtype=np.float32)
        place_type = np.min_scalar_type(self.blocks * BLOCK)
        rest = [(np.empty(0, np.int32), np.empty(0, place_type), np.empty(0))]
        total, squares = np.zeros(n_terms), np.zeros(n_terms)
        for b in range(self.blocks):
            times = np.bincount(words[ranges(self.first[b * BLOCK : (b + 1) * BLOCK], self.last[b * BLOCK : (b + 1) * BLOCK])[0]], minlength=n_terms)
            total += times
            squares += times**2
        #: share of the examples around an example with the term that hold it too, on average
        share = squares / np.maximum(total, 1) / BLOCK
        for b in range(self.blocks):
            span = slice(b * BLOCK, (b + 1) * BLOCK)
            at, held = ranges(self.first[span], self.last[span])
            place = np.repeat(np.arange(len(held), dtype=np.int32), held)
            found, row, times = np.unique(words[at], return_inverse=True, return_counts=True)
            dense = times * share[found] > RARE**2 * BLOCK
            inside = dense[row]
            matrix = np.zeros((int(dense.sum()), BLOCK), dtype=np.float32)
            matrix[(np.cumsum(dense) - 1)[row[inside]], place[inside]] = weights[at[inside]] / self.norms[span][place[inside]]
            self.matrices.append((found[dense], matrix, matrix.max(axis=1)))
            self.length[b] = math.sqrt(float(np.einsum("ij,ij->j", matrix, matrix).max())) * (1 + SLACK)
            left = at[~inside]
            rest.append((words[left].astype(np.int32), (place[~inside] + b * BLOCK).astype(place_type), weights[left]))
        term, places, values = (np.concatenate([r[i] for r in rest]) for i in range(3))
        del rest
        by_term = np.lexsort((values, term))
        term, values = term[by_term], values[by_term]
        #: places of examples, list by list
        self._bytes = places[by_term].tobytes()
        self.lists = np.frombuffer(self._bytes, place_type)
        del places, by_term
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n_terms))])
        cuts = np.flatnonzero((term[1:] != term[:-1]) | (values[1:] != values[:-1])) + 1
        cuts = np.concatenate([[0], cuts]) if len(term) else cuts
        runs = np.empty(len(cuts), dtype=_RUN)
        runs["weight"], runs["size"] = values[cuts], np.diff(np.append(cuts, len(term)))
        self._runs = runs.tobytes()
        #: the first run of every term
        self.runs = np.searchsorted(cuts, self.starts)
        del term, values, cuts
        # terms that are in a matrix, by the rows of the table of weights that a search makes
        used = np.unique(np.concatenate([np.empty(0, np.int32), *[m[0] for m in self.matrices]]))
        self.row = np.full(n_terms, -1, dtype=np.int32)
        self.row[used] = np.arange(len(used), dtype=np.int32)
        self.rows = len(used)
        self.matrices = [(self.row[found], matrix, most) for found, matrix, most in self.matrices]
        self.most = np.zeros((self.rows, self.blocks), dtype=np.float32)
        for b, (found, _, most) in enumerate(self.matrices):
            self.most[found, b] = most
        self._place = np.full(n_terms, -1, dtype=np.int32)  # of the terms that texts searched together hold

    def _add_lists(self, sums: np.ndarray, terms: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Put the sums of the plain lists into ``sums``. Queries hold places in ``terms``, each of which is read once."""
        lists = sliced(self._bytes, self.lists.itemsize, self.starts[terms], self.starts[terms + 1])
        many = self.runs[terms + 1] - self.runs[terms]
        cut_runs = sliced(self._runs, _RUN.itemsize, self.runs[terms], self.runs[terms + 1])
        for j, (at, weights) in enumerate(queries):
            held = at.tolist()
            taken = np.frombuffer(b"".join(map(lists.__getitem__, held)), self.lists.dtype)
            if len(taken):
                runs = np.frombuffer(b"".join(map(cut_runs.__getitem__, held)), _RUN)
                parts = np.repeat(runs["weight"] * np.repeat(weights, many[at]), runs["size"])
                sums[j] = np.bincount(taken.astype(np.int64), parts, sums.shape[1]) * self.shorten

    def _open(self, sums: np.ndarray, open_: np.ndarray, ask: np.ndarray) -> None:
        """Add the matrices of the open blocks, for many texts."""
        for b in np.flatnonzero(open_.any(axis=0)).tolist():
            which = np.flatnonzero(open_[:, b])
            start, end = int(which[0]), int(which[-1]) + 1
            rows, matrix, _ = self.matrices[b]
            span = slice(b * BLOCK, (b + 1) * BLOCK)
            if len(which) == end - start:
                sums[start:end, span] += ask[rows, start:end].T @ matrix
            elif len(which) < 0.7 * (end - start):
                sums[which, span] += ask[rows[:, None], which].T @ matrix
            else:
                sums[which, span] += (ask[rows, start:end].T @ matrix)[which - start]

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[list[tuple[float, int]]]:
        """For every query (ascending numbers of terms, weights) the k largest (cosine, place), ties by the example's id;
        examples without a common term are none."""
        out = []
        for start in range(0, len(queries), TOGETHER):
            out += self._nearest(queries[start : start + TOGETHER], k)
        return out

    def _nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        n = len(self.ids)
        if not n:
            return [[] for _ in queries]
        bound = np.zeros((len(queries), self.blocks), dtype=np.float32)
        inside = []
        for j, (words, weights) in enumerate(queries):
            rows = self.row[words]
            asked = weights[rows >= 0].astype(np.float32)
            rows = rows[rows >= 0]
            inside.append((rows, asked))
            bound[j] = np.minimum(asked @ self.most.take(rows, axis=0), math.sqrt(float(asked @ asked)) * self.length)
        # texts of one best block lie together, so that most blocks are opened by neighbours
        order = np.argsort(bound.argmax(axis=1), kind="stable")
        queries, bound = [queries[j] for j in order.tolist()], bound[order]
        sums = np.zeros((len(queries), self.blocks * BLOCK), dtype=np.float32)
        ask = np.zeros((self.rows, len(queries)), dtype=np.float32)
        for j, i in enumerate(order.tolist()):
            ask[inside[i][0], j] = inside[i][1]
        # from here on terms are numbered by their places among those of the texts
        held = np.zeros(len(self._place), dtype=bool)
        for words, _ in queries:
            held[words] = True
        terms = np.flatnonzero(held)
        self._place[terms] = np.arange(len(terms), dtype=np.int32)
        queries = [(self._place[words], weights) for words, weights in queries]
        self._add_lists(sums, terms, queries)
        bound += sums.reshape(len(queries), self.blocks, BLOCK).max(axis=2)
        # the blocks of the best bounds give a floor, below the k-th cosine
        best = np.argsort(-bound, axis=1, kind="stable")[:, : max(FIRST, -(-k // BLOCK))]
        tried = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(tried, best, True, axis=1)
        self._open(sums, tried, ask)
        held = np.take_along_axis(sums.reshape(len(queries), self.blocks, BLOCK), best[:, :, None], 1).reshape(len(queries), -1)
        floor = np.zeros(len(queries)) if held.shape[1] <= k else np.partition(held, -k, axis=1)[:, -k]
        reach = (bound + SLACK >= floor[:, None]) & (bound > 0) & ~tried
        self.opened += int(reach.sum()) + int(tried.sum())
        self._open(sums, reach, ask)
        # what is in closed blocks stays below the floor
        near = [self._near(sums[j, :n], float(floor[j]), k) for j in range(len(queries))]
        out: list[list[tuple[float, int]]] = [[] for _ in queries]
        exact = self._exact(queries, near, len(terms))
        self._place[terms] = -1
        for i, places, cosines in zip(order.tolist(), near, exact):
            by = np.lexsort((self.ids[places], -cosines))[:k]
            out[i] = [(c, p) for c, p in zip(cosines[by].tolist(), places[by].tolist()) if c > 0]
        return out

    def _near(self, sums: np.ndarray, floor: float, k: int) -> np.ndarray:
        """Places of the examples whose sums come near the k-th."""
        near = np.flatnonzero(sums >= floor - SLACK if floor > SLACK else sums > 0)
        if len(near) > k:
            held = sums[near]
            near = near[held >= np.partition(held, -k)[-k] - SLACK]
        return near

    def _exact(self, queries: list[tuple[np.ndarray, np.ndarray]], near: list[np.ndarray], n_terms: int) -> list[np.ndarray]:
        """Cosines of every query and these examples in doubles. An example is spread out once for all texts near it."""
        places = np.concatenate(near)
        asking = np.repeat(np.arange(len(near)), [len(x) for x in near])
        found = np.zeros(len(places))
        by_place = np.argsort(places, kind="stable")
        dense = np.zeros(n_terms + 1)  # the last is for terms that no text holds
        held = np.empty(0, dtype=np.int32)
        last = -1
        for at, p, j in zip(by_place.tolist(), places[by_place].tolist(), asking[by_place].tolist()):
            if p != last:
                dense[held] = 0.0
                last, span = p, slice(int(self.first[p]), int(self.last[p]))
                held = self._place.take(self.words[span])
                dense[held] = self.weights[span]
            words, weights = queries[j]
            found[at] = dense.take(words) @ weights
        found = np.round(found / self.norms[places], 9)  # so that ties don't hang on the order of sums
        return np.split(found, np.cumsum([len(x) for x in near])[:-1])


class Examples:
    """Labelled examples as packed arrays; the index over them is built where it is first asked."""

    def __init__(self, vocabulary: Vocabulary, ids: np.ndarray, toxic: np.ndarray, sizes: np.ndarray, words: np.ndarray, times: np.ndarray):
        self.vocabulary, self.ids, self.toxic, self.sizes = vocabulary, ids, toxic, sizes
        self.packed = [pa.compress(x.astype(np.int32).tobytes(), "zstd", asbytes=True) for x in (words, times)]
        self.total = len(words)
        self._index: Index | None = None
        self._known: dict[bytes, tuple[float, list[int]]] = {}

    def __getstate__(self):
        return {**self.__dict__, "_index": None, "_known": {}}

    @property
    def index(self) -> Index:
        if self._index is None:
            words, times = (np.frombuffer(pa.decompress(x, 4 * self.total, "zstd", asbytes=True), np.int32) for x in self.packed)
            weights = (1 + np.log(times)) * self.vocabulary.idf[words]
            self._index = Index(self.ids, self.toxic, self.sizes, words, weights, len(self.vocabulary.names))
        return self._index

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """Chance that each text is toxic, and the ids of its nearest examples; equal texts are searched once."""
        if len(self._known) > REMEMBERED:
            self._known.clear()
        keys = [hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in texts]
        new = {key: text for key, text in zip(keys, texts) if key not in self._known}
        for key, near in zip(new, self.index.nearest(self.vocabulary.vectors(list(new.values())))):
            self._known[key] = self._vote(near)
        return [self._known[key] for key in keys]

    def _vote(self, near: list[tuple[float, int]]) -> tuple[float, list[int]]:
        index = self.index
        if not near:
            return index.rate_empty, []
        weights = [1 / (NEAREST + max(0.0, 1 - c)) ** 2 for c, _ in near]
        votes = sum(w * index.toxic[p] for w, (_, p) in zip(weights, near))
        score = (votes + PRIOR * index.rate) / (sum(weights) + PRIOR)
        return float(min(1.0, max(0.0, score))), [int(index.ids[p]) for _, p in near[:5]]


def build_examples(docs: DataFrame, labels: DataFrame) -> Examples:
    """Examples are a bounded sample of the labelled rows, with all their terms; inverse document frequencies are over all
    labelled rows. The driver holds the numbers and counts of the terms of at most ``EXAMPLES`` texts."""
    rows = labelled(docs, labels)
    n = rows.count()
    share = EXAMPLES / max(1, n)
    drawn = F.lit(True)
    if share < 1:
        # a little fewer than wanted are drawn by hash, so that the bound holds
        drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(0.97 * share * 1_000_000)
    rows = rows.withColumn("chosen", drawn)
    counted = cut(word_counts(rows), "terms").toArrow()
    vocabulary = Vocabulary.of_counts(counted.column("name").to_numpy(), counted.column("n").to_numpy(), n)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batch: dict[str, list]) -> dict[str, list]:
        sizes, *found = known.value.counts_of(batch["text"])
        cuts = np.cumsum(sizes).tolist()
        return {
            c: [x[a:b].astype(np.int32).tobytes() for a, b in zip([0, *cuts], cuts)] for c, x in zip(("words", "times"), found)
        }

    made = map_rows(rows.filter("chosen").select("doc_id", "toxic", "text"), run, "words binary, times binary", ("doc_id", "toxic"))
    ids, toxic, sizes, words, times = [], [], [], [], []
    for r in cut(made, "examples").toLocalIterator():  # part by part, so that the driver never holds all rows at once
        ids.append(r["doc_id"])
        toxic.append(r["toxic"])
        sizes.append(len(r["words"]) // 4)
        words.append(r["words"])
        times.append(r["times"])
        if len(ids) == EXAMPLES:
            break
    known.unpersist()
    numbers = [np.frombuffer(b"".join(x), np.int32) for x in (words, times)]
    return Examples(vocabulary, np.array(ids, dtype=np.int64), np.array(toxic, dtype=np.int64), np.array(sizes, dtype=np.int64), *numbers)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every document; evidence are the ids of its nearest examples.

    The score is the weighted share of toxic ones among the 25 nearest examples by cosine, with the overall rate as one
    more vote. Cosines are over all terms that an example holds, which have 64-bit names; a text without any gets the rate of
    examples without any. Only texts are looked at; labels of rows whose crc32(doc_id) mod 4 is 2 are never read.

    Null or empty text: no terms. Null doc_id: not held out, not learnt from. Repeated rows: each scored, labels of one
    id count once by the highest. No labels, or of one kind only: every score is the overall rate. Empty table: empty
    result. Other columns are left out.
    """
    docs = pick(docs, "doc_id", "text")
    examples = docs.sparkSession.sparkContext.broadcast(build_examples(docs, labels))

    def run(batch: dict[str, list]) -> dict[str, list]:
        made = examples.value.scores(batch["text"])
        return {"score": [s for s, _ in made], "evidence": [e for _, e in made]}

    scored = map_rows(docs, run, "score double, evidence array<bigint>", ("doc_id",))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence"
    )
