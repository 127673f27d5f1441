"""Line dedup: an exact similarity join of the lines' word sets; later matches go."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import FORGET, arrow_rows, cut, documents, give_back, map_rows, partitions, pick, slices, whole_groups

PERCENT = 80
#: Lines of fewer different words are neither removed nor compared: lines without a word stay.
LEAST_WORDS = 1
#: Words are counted in so many buckets by their hash: the order of rarity needs one table of fixed size, no dictionary.
BUCKETS = 1 << 16
#: Lists of lines with no more numbers than this in all are broadcast; more are joined by shuffling.
FEW_LINES = 2_000_000
#: Lines that are compared with all their candidates are broadcast if there are no more than this.
FEW_ASKED = 50_000
#: Lines of a word that occurs more often than this are dealt in parts, but not in more than the second number.
MANY = 20_000
MOST_PARTS = 4096
#: A key of the join is one number: 32 bits of the word, 12 of the part, 20 of the line's size, so that rows are sorted by one number.
SIZE_BITS = 20
LARGEST = (1 << SIZE_BITS) - 1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E6C63D0876A9A4B
_VALUE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)[np.frombuffer(_LOWER, dtype=np.uint8)]
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _ODD[k]
    return h ^ h >> np.uint64(29)


def word_names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the words of a text and where they begin. Letters A-Z count as lower case.

    A name is a polynomial in the bytes' table values, read off running sums and brought to the word's beginning by the
    inverse power, then mixed with the length.
    """
    n = len(data)
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    values = _VALUE[data]
    values *= power[:n]
    np.cumsum(values, out=sums[1:])
    edges = np.flatnonzero(np.diff(np.concatenate([[True], (data == 32) | (data - np.uint8(9) < 5), [True]])))
    start, end = edges[::2], edges[1::2]
    names = (sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _ODD[2]
    return _mix(_mix(names, 0), 1), start


_POWERS: dict[str, np.ndarray] = {}
FORGET.append(_POWERS.clear)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64, kept for the next text."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def _numbered(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different names, ascending, and the place of each name among them. Only the different ones are sorted."""
    found = pa.array(names).dictionary_encode()
    different = found.dictionary.to_numpy()
    order = np.argsort(different)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return different[order], place[found.indices.to_numpy()]


class Lines:
    """The lines of a batch of texts as ragged arrays.

    The different words of the batch have 64-bit names; ``words`` are their places, line by line, each line's words once
    and in order, by rarity and then by name, or by name alone; ``start`` and ``size`` say which are whose.
    """

    def __init__(self, texts: list[str | None], rarity: np.ndarray | None = None):
        lengths = np.array([(t or "").count("\n") + 1 for t in texts], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(texts)), lengths)
        self.number = np.arange(len(self.owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        data = np.frombuffer("\n".join(t or "" for t in texts).encode(), dtype=np.uint8)
        names, at = word_names(data)
        # words before each line break: there are fewer breaks than words
        before = np.concatenate([[0], np.searchsorted(at, np.flatnonzero(data == 10)), [len(at)]])
        line = np.repeat(np.arange(len(before) - 1), np.diff(before))
        self.names, place = _numbered(names)
        if rarity is not None:
            order = np.argsort(rarity[_bucket(self.names)], kind="stable")
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            self.names, place = self.names[order], rank[place]
        of = max(1, len(self.names))
        keys = line * of + place
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        line, self.words = np.divmod(keys, of)
        self.size = np.bincount(line, minlength=len(self.owner))
        self.start = np.cumsum(self.size) - self.size

    def _folded(self, of_name: np.ndarray, how: np.ufunc) -> np.ndarray:
        """One value for each line from those of its words."""
        out = np.zeros(len(self.owner), dtype=np.uint64)
        filled = np.flatnonzero(self.size)
        if len(filled):
            out[filled] = how.reduceat(of_name[self.words], self.start[filled])
        return out

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set, as two signed numbers: sums of two hashes of its words."""
        halves = [_mix(self._folded(_mix(_mix(self.names, k), 2), np.add), 1 - k) for k in (0, 1)]
        return halves[0].view(np.int64), halves[1].view(np.int64)

    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set: whether an odd number of its words falls on each. Two sets differ in as many words at
        least as their bits do."""
        bit = _mix(self.names, 1) >> np.uint64(57)
        one = np.uint64(1) << (bit & np.uint64(63))
        low = self._folded(np.where(bit < 64, one, np.uint64(0)), np.bitwise_xor)
        high = self._folded(np.where(bit >= 64, one, np.uint64(0)), np.bitwise_xor)
        return low.view(np.int64), high.view(np.int64)


def _bucket(names: np.ndarray) -> np.ndarray:
    return (names & np.uint64(BUCKETS - 1)).view(np.int64)


def _joined(texts: pa.Array) -> np.ndarray:
    """The bytes of all texts with line breaks between them; null counts as empty. No text becomes a Python string."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pc.fill_null(texts, ""))
    return np.frombuffer(pc.binary_join(whole, "\n")[0].as_buffer(), dtype=np.uint8)


def rarity(docs: DataFrame) -> np.ndarray:
    """How often words of each bucket occur in all texts: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                names, _ = word_names(_joined(part.column("text")))
                total += np.bincount(_bucket(names), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])
        give_back()

    counts = docs.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = np.zeros(BUCKETS, dtype=np.int64)
    for bucket, n in counts.collect():  # 65,536 rows at most
        table[bucket] = n
    return table


def _lists(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Stretches of ``values`` as one list array, null where told."""
    sizes = ends - starts if null is None else np.where(null, 0, ends - starts)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(edges[-1]) + np.repeat(starts - edges[:-1], sizes)
    offsets = pa.array(edges.astype(np.int32), mask=None if null is None else np.append(null, False))
    return pa.ListArray.from_arrays(offsets, pa.array(values[at]))


def _parts(table: np.ndarray) -> np.ndarray:
    """Into how many parts the lines of a word are dealt: one, unless its bucket holds far more than the usual one."""
    return np.clip((table - 2 * int(np.median(table))) // MANY + 1, 1, MOST_PARTS)


def sketched(docs: DataFrame, table: np.ndarray, percent: int, least: int) -> DataFrame:
    """(d1, d2, doc_id, line, n, low, high, prefix, parts) of every line with enough words.

    The likest other set of n words has one more, so where n / (n + 1) is too little (three words or fewer at 80 %) only equal
    sets match: these are one class already, and their prefix is empty. Else ``prefix`` are the rarest words of which a set must share one with any set that is alike enough, 32 bits of each;
    ``parts`` into how many parts the lines of each are dealt, null where none is split.
    """
    # places of the buckets' counts among all: 16 bits, which numpy sorts by radix
    places = np.unique(table, return_inverse=True)[1].astype(np.uint16)
    broadcast = docs.sparkSession.sparkContext.broadcast((places, _parts(table)))

    def run(batch: dict[str, list]) -> dict[str, list]:
        rarest, parts = broadcast.value
        lines = Lines(batch["text"], rarest)
        low, high = lines.parities()
        d1, d2 = lines.digests()
        used = np.flatnonzero(lines.size >= least)
        n = lines.size[used]
        ends = lines.start[used] + np.where(100 * n < percent * (n + 1), 0, n - (n * percent + 99) // 100 + 1)
        short = (lines.names >> np.uint64(32)).astype(np.uint32).view(np.int32)[lines.words]
        dealt = parts[_bucket(lines.names)][lines.words]
        split = np.concatenate([[0], np.cumsum(dealt > 1)])
        starts = lines.start[used]
        return {
            "d1": d1[used], "d2": d2[used],
            "doc_id": np.array(batch["doc_id"], dtype=np.int64)[lines.owner[used]], "line": lines.number[used],
            "n": n, "low": low[used], "high": high[used],
            "prefix": _lists(short, starts, ends),
            "parts": _lists(dealt, starts, ends, split[ends] == split[starts]),
        }

    return map_rows(docs, run, "d1 bigint, d2 bigint, doc_id bigint, line int, n int, low bigint, high bigint, prefix array<int>, parts array<int>")


def line_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, line, names) of the wanted lines (doc_id, line)."""
    lists = wanted.groupBy("doc_id").agg(F.collect_set("line").alias("wanted"))

    def run(batch: dict[str, list]) -> dict[str, list]:
        place = [(i, n) for i, own in enumerate(batch["wanted"]) for n in own]
        split = [(t or "").split("\n") for t in batch["text"]]
        place = [(i, n) for i, n in place if n < len(split[i])]
        lines = Lines([split[i][n] for i, n in place])
        names = lines.names.view(np.int64)[lines.words]
        return {
            "doc_id": [batch["doc_id"][i] for i, _ in place],
            "line": [n for _, n in place],
            "names": _lists(names, lines.start, lines.start + lines.size),
        }

    lists = cut(lists, "line-lists")
    total = lists.agg(F.sum(F.size("wanted") + 1)).first()[0] or 0
    rows = docs.join(F.broadcast(lists) if total <= FEW_LINES else lists, "doc_id")
    return map_rows(rows, run, "doc_id bigint, line int, names array<bigint>")


def _needed(total, percent: int):
    """Words that two sets must share whose sizes add up to this."""
    return -(-total * percent // (100 + percent))


def first_matches(key, doc, line, n, p, low, high, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lines with a word in common: which have an earlier match, the place of the earliest, whether there are more.

    Rows come by key and size (``ordered``). A row is compared with those before it, one step further away each time, while the length
    filter lets any pair through; the position and the parity filter decide. Which line is earlier is asked only of pairs that pass.
    """
    best = np.full(len(key), -1)
    count = np.zeros(len(key), dtype=np.int64)
    low, high = low.view(np.uint64), high.view(np.uint64)  # bits are counted of numbers without a sign

    def before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (doc[a] < doc[b]) | ((doc[a] == doc[b]) & (line[a] < line[b]))

    at, step = np.arange(len(key)), 0
    while True:
        step += 1
        at = at[at >= step]
        at = at[key[at] == key[at - step]]
        at = at[100 * n[at - step] >= percent * n[at]]
        if not len(at):
            break
        other = at - step
        total = n[at] + n[other]
        needed = _needed(total, percent)
        fits = np.flatnonzero(np.minimum(n[at] - p[at], n[other] - p[other]) >= needed)
        a, b, total, needed = at[fits], other[fits], total[fits], needed[fits]
        apart = np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b])
        fits = total - apart >= 2 * needed
        a, b = a[fits], b[fits]
        turned = before(a, b)
        # a line is in each of the two halves once at most
        for later, earlier in ((a[~turned], b[~turned]), (b[turned], a[turned])):
            new = (best[later] < 0) | before(earlier, best[later])
            best[later[new]] = earlier[new]
            count[later] += 1
    found = np.flatnonzero(count)
    return found, best[found], count[found] > 1


_MATCHES = pa.schema([("doc_a", pa.int64()), ("line_a", pa.int32()), ("doc_b", pa.int64()), ("line_b", pa.int32()), ("more", pa.bool_())])
#: Rows are compared so many at a time, in whole groups.
CHUNK = 200_000
#: Rows of the join that Spark hands to Python at once: they are short, and a batch has a price of its own.
JOIN_ROWS = 50_000


def word_rows(classes: DataFrame) -> DataFrame:
    """(key, doc_id, line, n, p, low, high): a row for each word of each prefix; lines of a very common word in parts. The key
    ends with the size of the line, or the largest that it holds."""
    rows = classes.select("d1", "doc_id", "line", "n", "low", "high", "parts", F.posexplode("prefix").alias("p", "word"))
    part = F.pmod("d1", F.coalesce(F.get("parts", F.col("p")), F.lit(1)).cast("bigint"))
    key = F.shiftleft(F.col("word").cast("bigint"), 32) + F.shiftleft(part, SIZE_BITS) + F.least("n", F.lit(LARGEST))
    return rows.select(key.alias("key"), "doc_id", "line", "n", "p", "low", "high")


def ordered(table: pa.Table, largest: int) -> list[np.ndarray]:
    """Key without the size, doc_id, line, n, p, low, high of rows that come by key; sizes beyond the key's are put in order."""
    key, doc, line, both, low, high = (table.column(c).to_numpy() for c in ("key", "doc_id", "line", "n_p", "low", "high"))
    key, n, p = key >> SIZE_BITS, both >> 32, both & 0xFFFFFFFF
    rows = [key, doc, line, n, p, low, high]
    if len(n) and n.max() > largest:
        order = np.lexsort((n, key))
        rows = [x[order] for x in rows]
    return rows


def first_candidates(words: DataFrame, percent: int) -> DataFrame:
    """(doc_a, line_a, doc_b, line_b, more): for each line and word the earliest line with that word that passes the
    length, position and parity filters; ``more`` tells whether it is not the only one. One row for each row at most."""

    largest = LARGEST

    def work(table: pa.Table) -> pa.RecordBatch:
        key, doc, line, n, p, low, high = ordered(table, largest)
        a, b, more = first_matches(key, doc, line, n, p, low, high, percent)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[a], line[a], doc[b], line[b], more)], schema=_MATCHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key", CHUNK, SIZE_BITS):
            yield work(table)
        give_back()

    # two numbers in one column: a row that moves has eight bytes for each column
    words = words.select("key", "doc_id", "line", F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("p").cast("bigint")).alias("n_p"), "low", "high")
    dealt = words.repartition(partitions(words.sparkSession), F.shiftright("key", SIZE_BITS)).sortWithinPartitions("key")
    return dealt.mapInArrow(run, "doc_a bigint, line_a int, doc_b bigint, line_b int, more boolean")


def all_candidates(asked: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (later, earlier) of all lines asked about that pass the filters, whatever part their words are dealt to."""
    word = F.shiftright("key", 32)
    names = ("doc_id", "line", "n", "p", "low", "high")
    sides = []
    for side, rows in (("a", asked), ("b", classes)):
        rows = word_rows(rows).select(word.alias("word"), *[F.col(c).alias(f"{c}_{side}") for c in names])
        sides.append(rows.withColumnsRenamed({f"doc_id_{side}": f"doc_{side}"}))
    n, m = F.col("n_a"), F.col("n_b")
    later = (F.col("doc_a") > F.col("doc_b")) | ((F.col("doc_a") == F.col("doc_b")) & (F.col("line_a") > F.col("line_b")))
    needed = F.ceil((n + m) * percent / F.lit(100.0 + percent)).cast("int")
    apart = F.bit_count(F.col("low_a").bitwiseXOR(F.col("low_b"))) + F.bit_count(F.col("high_a").bitwiseXOR(F.col("high_b")))
    fits = later & (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - F.col("p_a"), m - F.col("p_b")) >= needed)
    few = asked.count() <= FEW_ASKED
    left = F.broadcast(sides[0]) if few else sides[0]
    pairs = sides[1].join(left, "word").filter(fits & (n + m - apart >= 2 * needed))
    return pairs.select("doc_a", "line_a", "doc_b", "line_b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose word sets have the wanted Jaccard likeness."""
    left = sets.select(F.col("doc_id").alias("doc_a"), F.col("line").alias("line_a"), F.col("names").alias("x"))
    right = sets.select(F.col("doc_id").alias("doc_b"), F.col("line").alias("line_b"), F.col("names").alias("y"))
    both = pairs.join(left, ["doc_a", "line_a"]).join(right, ["doc_b", "line_b"])
    inter = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * inter >= percent * (F.size("x") + F.size("y") - inter)).select("doc_a", "line_a", "doc_b", "line_b")


def removed_lines(docs: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, removed) of every document that has lines to remove: their numbers from 0, ascending.

    A line is removed if an earlier one (smaller doc_id, or the same document and a smaller number) has a set of words
    that is alike enough, whether that one is removed or not. Lines with the same set are one class; the first line of
    each class enters the join. Lines of fewer than ``least`` different words stay.

    One earlier match settles a line, so of a group of lines that are all alike not all pairs are made: each line is first
    compared with its earliest candidate for each word of its prefix, and only lines that this leaves open with all others.
    """
    docs = pick(docs, "doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    all_ = cut(sketched(docs, rarity(docs), percent, least), "lines")
    first = F.min(F.struct("doc_id", "line", "n", "low", "high", "prefix", "parts"))
    classes = cut(all_.groupBy("d1", "d2").agg(first.alias("f"), F.count(F.lit(1)).alias("c")).select("d1", "d2", "f.*", "c"), "line-classes")
    place = ["doc_id", "line"]
    as_later = [F.col("doc_a").alias("doc_id"), F.col("line_a").alias("line")]

    with arrow_rows(docs.sparkSession, JOIN_ROWS):
        found = cut(first_candidates(word_rows(classes), percent), "first-candidates")
    pairs = found.drop("more").distinct()
    later = cut(confirm_lines(docs, pairs, percent).select(*as_later).distinct(), "later-lines")
    # lines whose earliest candidates are not alike enough, but that have others, or words that were dealt in parts
    unsure = found.filter("more").select(*as_later).union(classes.filter("parts IS NOT NULL").select(*place)).distinct()
    unsure = unsure.join(later, place, "left_anti")
    asked = cut(classes.join(unsure, place, "left_semi"), "unsettled-lines")
    rest = all_candidates(asked, classes, percent).join(found.drop("more").distinct(), ["doc_a", "line_a", "doc_b", "line_b"], "left_anti")
    later = later.union(confirm_lines(docs, rest, percent).select(*as_later).distinct())

    firsts = classes.select("d1", "d2", *place, "c").join(later.withColumn("_gone", F.lit(True)), place, "left")
    firsts = firsts.filter("c > 1 OR _gone").select("d1", "d2", F.struct(*place).alias("first"), F.coalesce("_gone", F.lit(False)).alias("gone"))
    gone = all_.select("d1", "d2", *place).join(cut(firsts, "line-verdicts"), ["d1", "d2"])
    gone = gone.filter(F.col("gone") | (F.struct(*place) != F.col("first")))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def confirm_lines(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose word sets, read from the texts, are alike enough."""
    pairs = cut(pairs, "line-pairs")
    ends = pairs.select(F.col("doc_a").alias("doc_id"), F.col("line_a").alias("line")).union(pairs.select("doc_b", "line_b")).distinct()
    return verified(pairs, cut(line_sets(docs, ends), "line-sets"), percent)


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """The documents without their removed lines, beside ``removed`` (null where none are); ``text`` and ``n_chars`` are
    new where lines are gone."""
    docs = documents(docs)
    lists = cut(removed, "removed-lines")
    total = lists.agg(F.sum(F.size("removed") + 1)).first()[0] or 0
    joined = docs.join(F.broadcast(lists) if total <= FEW_LINES else lists, "doc_id", "left")
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    chars = F.when(F.col("removed").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("bigint"))
    return joined.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"), "removed", F.col("text").alias("_before"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of every document: the hash is of its remaining lines.

    See ``removed_lines``. Null text: no lines, the hash of the empty string. Empty text: one empty line. Null doc_id:
    takes no part, nothing removed. Repeated rows (one doc_id): one document, so that they don't remove each other; rows
    that differ under one doc_id lose the same line numbers. Empty table: empty result. Other columns are left out.
    """
    rows = without_lines(docs, removed_lines(docs, percent, least))
    lines = F.when(F.col("_before").isNull(), 0).otherwise(F.size(F.split("_before", "\n", -1))).cast("bigint")
    hash_ = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return rows.select("doc_id", lines.alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"), hash_.alias("kept_sha256"))


def keep_lines(docs: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """The documents without later matches, with the columns of documents; those that lose all their words go."""
    rows = without_lines(docs, removed_lines(docs, percent, least))
    return rows.filter(F.col("removed").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("removed", "_before")


LINES_SQL = f"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line FROM documents
),
words AS (
  SELECT DISTINCT doc_id, line, w FROM (
    SELECT doc_id, line, unnest(regexp_extract_all(translate(l, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+')) AS w FROM lines
  )
),
counts AS (SELECT w, count(*) AS c FROM words GROUP BY w),
sizes AS (SELECT doc_id, line, count(*) AS n, list_sort(list(w)) AS ws FROM words GROUP BY doc_id, line HAVING count(*) >= {LEAST_WORDS}),
firsts AS (SELECT ws, any_value(n) AS n, min({{'d': doc_id, 'l': line}}) AS f FROM sizes GROUP BY ws),
ranked AS (
  SELECT f.f, f.n, w.w, row_number() OVER (PARTITION BY f.f ORDER BY c.c, w.w) AS p
  FROM firsts f JOIN words w ON w.doc_id = f.f.d AND w.line = f.f.l JOIN counts c ON c.w = w.w
),
prefix AS (SELECT f, n, w FROM ranked WHERE p <= n - (n * {PERCENT} + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.f AS a, b.f AS b FROM prefix a JOIN prefix b ON a.w = b.w AND b.f < a.f AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)),
alike AS (
  SELECT DISTINCT p.a FROM pairs p JOIN firsts x ON x.f = p.a JOIN firsts y ON y.f = p.b
  WHERE 100 * len(list_intersect(x.ws, y.ws)) >= {PERCENT} * (x.n + y.n - len(list_intersect(x.ws, y.ws)))
),
gone AS (
  SELECT s.doc_id, s.line FROM sizes s JOIN firsts f ON f.ws = s.ws LEFT JOIN alike a ON a.a = f.f
  WHERE a.a IS NOT NULL OR f.f <> {{'d': s.doc_id, 'l': s.line}}
)
SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
  sha256(coalesce(string_agg(l.l, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id
"""
