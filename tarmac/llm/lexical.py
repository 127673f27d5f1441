"""Ranked lexical search: exact inner products of sparse vectors by ball trees."""

from __future__ import annotations

import heapq
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.llm.common import cut, give_back, map_rows, pick

TOP = 50
#: Terms of items that one pass over the documents looks for; more items take more passes.
PASS_TERMS = 100_000
#: Documents, and term weights, of one tree; documents of a leaf.
BLOCK_ROWS, BLOCK_WEIGHTS, LEAF = 8192, 1_000_000, 32
#: Partial rankings of an item are joined in so many groups before they meet.
GROUPS = 64
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: A text is read in parts of so many characters.
PART = 1 << 20
#: Relative room for rounding in bounds: far above what sums of a million doubles lose.
_SLACK = 1e-9


def terms(text: str | None) -> Iterator[str]:
    """Runs of digits, ASCII letters and other characters from U+0080 on, A-Z in lower case, in order."""
    for match in _TERM.finditer(text or ""):
        yield match[0].translate(_LOWER)


def _term_lists(text: str | None) -> Iterator[list[str]]:
    """The terms of a text by parts, so that a very long one is never a list of all its terms."""
    text, start = text or "", 0
    while start < len(text):
        stop = min(start + PART, len(text))
        if stop < len(text):  # end where no term is cut
            rest = _TERM.match(text, stop)
            stop = rest.end() if rest else stop
        yield _TERM.findall(text[start:stop].translate(_LOWER))
        start = stop


# the tree


class BallTree:
    """A balanced tree over sparse vectors of non-negative whole numbers; every node has its centroid and its radius.

    ``counts`` are the entries of each vector, ``columns`` and ``values`` theirs in order. Vectors are split at the median
    along the line between two far ones, in a projection to few dimensions; centroids and radii are those of the whole
    vectors. Nodes are numbered as in a heap, from 1.
    """

    def __init__(self, counts: np.ndarray, columns: np.ndarray, values: np.ndarray, leaf: int = LEAF):
        n = len(counts)
        self.depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
        self.used, columns = np.unique(columns, return_inverse=True)
        rows = np.repeat(np.arange(n), counts)
        self.order = np.arange(n)
        self._bounds = np.arange((1 << self.depth) + 1) * n >> self.depth  # first place of each leaf
        self._split(self._projected(rows, columns, values, n))
        place = np.empty(n, dtype=np.int64)
        place[self.order] = np.arange(n)
        rows = place[rows]
        by_row = np.argsort(rows, kind="stable")
        self.columns, self.values = columns[by_row], values[by_row]
        self.starts = np.concatenate([[0], np.cumsum(counts[self.order])])
        self._measure(rows, columns, values.astype(float), n)

    def _projected(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        signs = np.random.default_rng(11).choice(np.array([-1.0, 1.0]), (len(self.used), 8))
        return np.stack([np.bincount(rows, weights=values * signs[columns, d], minlength=n) for d in range(8)], axis=1)

    def _split(self, points: np.ndarray) -> None:
        for level in range(self.depth):
            step = 1 << self.depth - level
            for first in range(0, 1 << self.depth, step):
                lo, mid, hi = (int(self._bounds[first + i]) for i in (0, step // 2, step))
                own = points[self.order[lo:hi]]
                a = own[np.square(own - own.mean(axis=0)).sum(axis=1).argmax()]
                b = own[np.square(own - a).sum(axis=1).argmax()]
                halves = np.argpartition(own @ (b - a), min(mid - lo, hi - lo - 1))
                self.order[lo:hi] = self.order[lo:hi][halves]

    def _measure(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> None:
        by_column = np.lexsort((rows, columns))
        rows, columns, values = rows[by_column], columns[by_column], values[by_column]
        leaves = np.searchsorted(self._bounds, np.arange(n), side="right") - 1
        squares = np.bincount(rows, weights=values * values, minlength=n)
        self.radius = np.zeros(2 << self.depth)
        parts = []
        for level in range(self.depth + 1):
            node = (leaves >> self.depth - level) + (1 << level)
            of_entry = node[rows]
            new = np.concatenate([[True], (columns[1:] != columns[:-1]) | (of_entry[1:] != of_entry[:-1])])
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            sizes = np.bincount(node, minlength=2 << level)
            mean = np.add.reduceat(values, first) / sizes[of_entry[first]]
            parts.append((columns[first], of_entry[first], mean))
            centre = np.bincount(of_entry[first], weights=mean * mean, minlength=2 << level)[node]
            inner = np.bincount(rows, weights=values * mean[group], minlength=n)
            # rounding must not make a ball too small
            apart = np.sqrt(np.maximum(squares - 2 * inner + centre, 0) + _SLACK * (squares + centre))
            np.maximum.at(self.radius, node, apart)
        columns, self.nodes, self.means = (np.concatenate(x) for x in zip(*parts))
        by_column = np.argsort(columns, kind="stable")
        self.nodes, self.means = self.nodes[by_column], self.means[by_column]
        self.column_starts = np.searchsorted(columns[by_column], np.arange(len(self.used) + 1))

    def search(self, query: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(vectors, inner products) leaf by leaf, best bound first, for a query of ones in ascending columns.

        The receiver sends the least inner product that still counts; the search ends where no bound reaches it. Nodes
        without any of the query's columns hold products of zero and are left out.
        """
        at = np.searchsorted(self.used, query)
        at = at[(at < len(self.used)) & (self.used[np.minimum(at, len(self.used) - 1)] == query)]
        if not len(at):
            return
        spans = [slice(self.column_starts[c], self.column_starts[c + 1]) for c in at.tolist()]
        nodes = np.concatenate([self.nodes[s] for s in spans])
        inner = np.bincount(nodes, weights=np.concatenate([self.means[s] for s in spans]), minlength=2 << self.depth)
        bound = np.where(inner > 0, (inner + np.sqrt(len(at)) * self.radius) * (1 + _SLACK) + 1, 0).tolist()
        asked = np.zeros(len(self.used), dtype=np.int64)
        asked[at] = 1
        heap = [(-bound[1], 1)]
        while heap:
            best, node = heapq.heappop(heap)
            if -best < least or best == 0:
                return
            if node >= 1 << self.depth:
                lo, hi = (int(self._bounds[node - (1 << self.depth) + i]) for i in (0, 1))
                first, last = self.starts[lo], self.starts[hi]
                products = self.values[first:last] * asked[self.columns[first:last]]
                least = yield self.order[lo:hi], np.add.reduceat(products, self.starts[lo:hi] - first)
            else:
                for child in (2 * node, 2 * node + 1):
                    if bound[child] >= least and bound[child] > 0:
                        heapq.heappush(heap, (-bound[child], child))


class Best:
    """The ``top`` greatest scores above 0 and their ids; equal scores by id, no id last."""

    def __init__(self, top: int):
        self.top = top
        self.scores = self.ids = np.zeros(0, dtype=np.int64)
        self.least = 1.0

    def take(self, scores: np.ndarray, ids: np.ndarray) -> float:
        good = scores >= self.least
        if good.any():
            scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
            order = np.lexsort((ids, -scores))[: self.top]
            self.scores, self.ids = scores[order], ids[order]
            if len(order) == self.top:
                self.least = float(self.scores[-1])
        return self.least


_NO_ID = np.iinfo(np.int64).max


def search_block(ids: np.ndarray, counts: np.ndarray, columns: np.ndarray, values: np.ndarray, queries: list[np.ndarray], best: list[Best], leaf: int = LEAF) -> int:
    """Add the documents of one block to the best of every query; gives the number of leaves that were opened."""
    tree = BallTree(counts, columns, values, leaf)
    opened = 0
    for query, own in zip(queries, best):
        leaves = tree.search(query, own.least)
        found = next(leaves, None)
        while found is not None:
            opened += 1
            try:
                found = leaves.send(own.take(found[1], ids[found[0]]))
            except StopIteration:
                break
    return opened


# the job


def _passes(items: DataFrame, terms_at_once: int) -> Iterator[list]:
    """Items as rows (item_id, term), in groups of at most so many rows, or one item if it alone has more."""
    slices = 1
    while True:
        dealt = items.withColumn("_slice", F.pmod(F.xxhash64("item_id"), F.lit(slices)))
        sizes = dealt.groupBy("_slice").agg(F.count("*").alias("n"), F.min(F.hash("item_id")).alias("a"), F.max(F.hash("item_id")).alias("b"))
        if sizes.filter(f"n > {terms_at_once} AND a <> b").isEmpty():
            break
        slices *= 2
    for number in range(slices):
        rows = dealt.filter(F.col("_slice") == number).select("item_id", "term").collect()
        if rows:
            yield rows


def _vectors(docs: DataFrame, places: Broadcast) -> DataFrame:
    """(doc_id, n, columns, counts) of each document with a term: which of the asked terms it has, how often."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        place = places.value
        out = []
        for text in batch["text"]:
            n, held = 0, {}
            for part in _term_lists(text):
                n += len(part)
                for column in filter(None, map(place.get, part)):
                    held[column] = held.get(column, 0) + 1
            columns = sorted(held)
            out.append((n, columns, [held[c] for c in columns]))
        return dict(zip(("n", "columns", "counts"), map(list, zip(*out))))

    return cut(map_rows(docs, run, "n bigint, columns array<int>, counts array<bigint>", ("doc_id",)).filter("n > 0"), "vectors")


def _search(vectors: DataFrame, given: Broadcast, n_docs: int, n_terms: int, top: int, rows: int) -> DataFrame:
    """(item, doc_id, score): the best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = given.value
        best = [Best(top) for _ in queries]
        held: list[pa.RecordBatch] = []

        def finish() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column("doc_id").fill_null(_NO_ID).to_numpy()
            counts = table.column("columns").combine_chunks().value_lengths().to_numpy().astype(np.int64)
            columns = table.column("columns").combine_chunks().flatten().to_numpy()
            tf = table.column("counts").combine_chunks().flatten().to_numpy()
            m = 50 + (50 * table.column("n").to_numpy() * n_docs) // n_terms
            values = weights[columns] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, counts)))
            search_block(ids, counts, columns, values, queries, best)
            held.clear()

        count = entries = 0
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                held.append(batch)
                count += batch.num_rows
                entries += len(batch.column("columns").flatten())
                if count >= rows or entries >= BLOCK_WEIGHTS:
                    finish()
                    count = entries = 0
        if held:
            finish()
        for item, own in enumerate(best):
            if len(own.ids):
                ids = pa.array(own.ids, mask=own.ids == _NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item, dtype=np.int32)), ids, pa.array(own.scores)], ["item", "doc_id", "score"])
        give_back()

    return vectors.filter(F.size("columns") > 0).mapInArrow(run, "item int, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, terms_at_once: int = PASS_TERMS, block: int = BLOCK_ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with the highest score above 0, ties by doc_id.

    Documents are vectors of whole numbers over the items' terms, the weights of terms multiplied in, so that a score is
    the inner product with a vector of ones. Every task arranges its documents in ball trees, block by block, and searches
    each tree best bound first: a ball of centroid c and radius r holds no product above q c + |q| r. The best so far
    prune later leaves and blocks. Texts are read once for each group of items of ``terms_at_once`` terms.

    Null or empty text, no terms: a document that is not counted and never found; an item without terms has no rows. Null
    doc_id: last among equal scores. Repeated documents: a rank each. Items of one item_id are one item with the terms of
    all; null is an item_id too. Very long texts: read by parts. Empty tables: empty result. Other columns are left out.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text")
    split = map_rows(pick(items, "item_id", "text"), lambda b: {"term": [list(set(terms(t))) for t in b["text"]]}, "term array<string>", ("item_id",))
    asked = cut(split.select("item_id", F.explode("term").alias("term")).distinct(), "item-terms")
    parts = [_one_pass(spark, rows, group, top, block) for group in _passes(asked, terms_at_once)]
    if not parts:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("item_id", "_group").orderBy(*order)
    found = found.withColumn("_group", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)))
    found = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _one_pass(spark: SparkSession, docs: DataFrame, group: list, top: int, block: int) -> DataFrame:
    places: dict[str, int] = {}
    by_item: dict[int | None, list[int]] = {}
    for item, term in group:
        by_item.setdefault(item, []).append(places.setdefault(term, len(places) + 1))  # 0 is no term
    vectors = _vectors(docs, spark.sparkContext.broadcast(places))
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(places) + 1, dtype=np.int64)
    df = vectors.select(F.explode("columns").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for term, n in df.collect():  # at most one row for each asked term
        weights[term] = int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * n + 1))))
    item_ids = list(by_item)
    queries = [np.array(sorted(by_item[i]), dtype=np.int64) for i in item_ids]
    given = spark.sparkContext.broadcast((weights, queries))
    found = _search(vectors, given, n_docs, max(n_terms, 1), top, block)
    names = spark.createDataFrame(list(enumerate(item_ids)), "item int, item_id bigint")  # bounded as the group is
    return found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")


SEARCH_SQL = r"""
WITH params AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper),
words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, upper, lower(upper)), params.term)) AS term FROM documents, params
),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, upper, lower(upper)), params.term)) AS term FROM benchmark, params
),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM tf, whole WHERE term IN (SELECT term FROM asked) GROUP BY term, docs
),
products AS (
    SELECT tf.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))) AS product
    FROM tf JOIN weights USING (term) JOIN lengths USING (doc_id), whole
),
scores AS (
    SELECT item_id, doc_id, CAST(sum(product) AS BIGINT) AS score FROM asked JOIN products USING (term)
    GROUP BY item_id, doc_id HAVING sum(product) > 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 50
"""
