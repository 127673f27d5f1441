"""Removal of bytes that a long earlier string repeats: suffix sorting of what shares an anchor.

Every string of 100 bytes has one anchor: of its windows of 32 bytes the one with the smallest hash, the leftmost if there
are several. Equal strings have equal anchors at equal places, so they meet where anchors meet. Neighbouring strings mostly
share their anchor; the bytes they cover together are a region, about 140 bytes long, one for every 35 bytes of text.

1. Hashes of all anchors are counted. What occurs once can't repeat and goes no further.
2. Regions of the others are dealt by hash. Within a hash the bytes behind the anchor and those before it, backwards, are
   sorted by deep-shallow sorting; common prefixes of neighbours tell which of the regions' strings are equal.
3. A hash with very many regions is not dealt to one task: its strings are grouped one by one under their digests, which
   sums up before it shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import cut, map_rows, partitions, pick, whole_groups

LENGTH = 100
GRAM = 32
#: Anchors are chosen among so many windows.
CHOICE = LENGTH - GRAM + 1
#: Strings are told apart by multikey sorting up to this depth, beyond it by blind tries.
SHALLOW = 32
#: One bit for each hash that occurs more than once: a table of fixed size, 16 MB. Where bits are shared, regions that
#: repeat nothing are dealt in vain.
BITS = 27
#: A hash is grouped string by string if it has more regions than this, or more than one in 2^20 of all.
MANY = 4000
MOST_HOT = 1 << 20
#: A task remembers so many regions at once to send equal ones only once.
REMEMBERED = 200_000


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of each window of 32 bytes, doubled up from single bytes."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < GRAM:
        h = (h[:-step] ^ h[:-step] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + h[step:]
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def smallest(h: np.ndarray) -> np.ndarray:
    """Place of the leftmost smallest of each ``CHOICE`` neighbours."""
    n = len(h) - CHOICE + 1
    at = np.arange(len(h), dtype=np.int32)
    low = h
    step = 1
    while 2 * step <= CHOICE:
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, low[step:], low[:-step])
        step *= 2
    rest = CHOICE - step
    return np.where(low[rest : rest + n] < low[:n], at[rest : rest + n], at[:n])


def regions(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor, first string, last string) of each region of a text; places are byte numbers."""
    if len(data) < LENGTH:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    h = gram_hashes(np.frombuffer(data, dtype=np.uint8))
    at = smallest(h)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    anchors = at[first]
    return h[anchors].view(np.int64), anchors, first, last


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        if text is not None and doc_id is not None:
            yield doc_id, text.encode()


def anchor_hashes(docs: DataFrame) -> DataFrame:
    """(h) of every region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, dtype=np.int64)] + [regions(data)[0] for _, data in _texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["h"])

    return docs.mapInArrow(run, "h bigint")


REGION, STRING, SPAN = 0, 1, 2
_ROWS = pa.schema(
    [("kind", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("data", pa.binary())]
)
_ROWS_DDL = "kind int, k1 bigint, k2 bigint, doc_id bigint, start int, stop int, data binary"


def suspects(docs: DataFrame, repeated: np.ndarray, hot: np.ndarray) -> DataFrame:
    """Rows for what may repeat: regions by hash (``stop`` is the anchor's place within), strings of hot hashes by digest,
    and spans that repeat within the rows a task remembers at once."""
    sent = docs.sparkSession.sparkContext.broadcast((repeated, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, busy = sent.value
        seen: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        strings: dict[bytes, tuple[int, int]] = {}
        spans: list[tuple[int, int, int]] = []

        def flush() -> pa.RecordBatch:
            rows = [(REGION, h, 0, doc, start, anchor, data) for (h, data), (doc, start, anchor) in seen.items()]
            for data, (doc, start) in strings.items():
                digest = hashlib.blake2b(data, digest_size=16).digest()
                k1, k2 = np.frombuffer(digest, dtype=np.int64).tolist()
                rows.append((STRING, k1, k2, doc, start, 0, None))
            rows += [(SPAN, 0, 0, doc, start, stop, None) for doc, start, stop in _merged(spans)]
            seen.clear()
            strings.clear()
            spans.clear()
            columns = list(zip(*rows)) or [[] for _ in _ROWS]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS)], schema=_ROWS)

        for batch in batches:
            for doc, data in _texts(batch):
                h, anchors, first, last = regions(data)
                place = h & ((1 << BITS) - 1)
                maybe = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                is_hot = np.isin(h[maybe], busy)
                for i, warm in zip(maybe.tolist(), is_hot.tolist()):
                    a, b = int(first[i]), int(last[i])
                    if warm:
                        for s in range(a, b + 1):
                            _earliest(strings, data[s : s + LENGTH], (doc, s), LENGTH, spans)
                    else:
                        _earliest(seen, (int(h[i]), data[a : b + LENGTH]), (doc, a, int(anchors[i]) - a), b + LENGTH - a, spans)
                if len(seen) + len(strings) + len(spans) > REMEMBERED:
                    yield flush()
        yield flush()

    return docs.mapInArrow(run, _ROWS_DDL)


def _earliest(known: dict, key, place: tuple, length: int, spans: list[tuple[int, int, int]]) -> None:
    """Keep the earliest place of a key; the later one repeats it."""
    other = known.setdefault(key, place)
    if other is place or other[:2] == place[:2]:
        return
    if place[:2] < other[:2]:
        known[key], place = place, other
    spans.append((place[0], place[1], place[1] + length))


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of documents, those that touch or overlap as one."""
    out: list[tuple[int, int, int]] = []
    for doc, start, stop in sorted(spans):
        if out and out[-1][0] == doc and start <= out[-1][2]:
            out[-1] = (doc, out[-1][1], max(stop, out[-1][2]))
        else:
            out.append((doc, start, stop))
    return out


class BlindTrie:
    """Strings in order by the bytes in which they part: inner nodes are [depth, {byte: child}], leaves lists of numbers."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list = [0]
        for number in range(1, len(strings)):
            self._insert(number)

    def _insert(self, number: int) -> None:
        own = self.strings[number]
        node, path = self.root, []
        while isinstance(node[-1], dict):  # blindly down, any child where the byte is new
            path.append(node)
            node = node[1].get(own[node[0]]) or next(iter(node[1].values()))
        depth = _common(own, self.strings[node[0]])
        if depth == len(own):
            node.append(number)
            return
        above = None
        for node in path + [node]:
            if not isinstance(node[-1], dict) or node[0] >= depth:
                break
            above = node
        if isinstance(node[-1], dict) and node[0] == depth:
            node[1][own[depth]] = [number]
            return
        new = [depth, {self._any(node)[depth]: node, own[depth]: [number]}]
        if above is None:
            self.root = new
        else:
            above[1][own[above[0]]] = new

    def _any(self, node: list) -> bytes:
        while isinstance(node[-1], dict):
            node = next(iter(node[1].values()))
        return self.strings[node[0]]

    def order(self) -> list[int]:
        out, open_ = [], [self.root]
        while open_:
            node = open_.pop()
            if isinstance(node[-1], dict):
                open_ += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += sorted(node)
        return out


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings of equal length."""
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (differ.bit_length() + 7) // 8


def deep_shallow(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings of equal length within their groups, and how far each agrees with the one before (-1 where a
    group begins). Equal strings stay in the order given.

    Multikey sorting splits all strings that are still tied by their next eight bytes, down to the shallow depth. What is
    then still tied has a long common prefix; a blind trie orders each such class, looking only at bytes that part it.
    """
    n, width = rows.shape
    order = np.argsort(group, kind="stable")
    tie = np.cumsum(np.concatenate([[0], group[order][1:] != group[order][:-1]]))
    symbols = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    symbols[:, :width] = rows
    symbols = symbols.view(">u8").astype(np.uint64)
    for depth in range(min(SHALLOW // 8, symbols.shape[1])):
        size = np.bincount(tie)
        tied = np.flatnonzero(size[tie] > 1)  # places of strings that are not yet alone
        if not len(tied):
            break
        who = order[tied]
        again = np.lexsort((symbols[who, depth], tie[tied]))
        order[tied] = who[again]
        new = np.concatenate([[True], tie[1:] != tie[:-1]])
        new[1:] |= symbols[order[1:], depth] != symbols[order[:-1], depth]
        tie = np.cumsum(new) - 1
    if width > SHALLOW:
        starts = np.flatnonzero(np.concatenate([[True], tie[1:] != tie[:-1]]))
        sizes = np.diff(np.append(starts, n))
        for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            own = np.sort(order[start : start + size])
            trie = BlindTrie([rows[i, SHALLOW:].tobytes() for i in own])
            order[start : start + size] = own[trie.order()]
    common = np.full(n, -1, dtype=np.int64)
    if n > 1:
        differ = rows[order[1:]] != rows[order[:-1]]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, common


def _classes(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each depth and string the number of its class: the strings of its group that agree with it so far."""
    order, common = deep_shallow(rows, group)
    out = np.empty((rows.shape[1] + 1, len(rows)), dtype=np.int32)
    for depth in range(rows.shape[1] + 1):
        out[depth, order] = np.cumsum(common < depth)
    return out


def repeated_spans(group: np.ndarray, places: list[tuple[int, int]], anchors: np.ndarray, data: list[bytes]) -> list[tuple[int, int, int]]:
    """Spans of the regions' strings that an earlier region of the same group has too.

    ``places`` are (doc_id, start), ascending within a group; ``anchors`` the anchor's place within each region.
    """
    first: dict[tuple[int, bytes], int] = {}
    spans, kept = [], []
    for i, (g, text) in enumerate(zip(group.tolist(), data)):  # equal regions repeat as a whole
        if first.setdefault((g, text), i) == i:
            kept.append(i)
        else:
            spans.append((*places[i], places[i][1] + len(text)))
    own = np.array(kept, dtype=np.int64)
    own = own[np.bincount(group[own])[group[own]] > 1] if len(own) else own
    if not len(own):
        return spans
    n, group, anchors = len(own), group[own], anchors[own]
    right = np.zeros((n, LENGTH), dtype=np.uint8)
    left = np.zeros((n, CHOICE - 1), dtype=np.uint8)
    lengths = np.array([len(data[i]) for i in own])
    for row, (i, a) in enumerate(zip(own.tolist(), anchors.tolist())):
        whole = np.frombuffer(data[i], dtype=np.uint8)
        right[row, : len(whole) - a] = whole[a:]
        left[row, :a] = whole[:a][::-1]
    behind, before = _classes(right, group), _classes(left, group)
    # the string that begins j bytes before the anchor has j bytes before it and the rest behind
    gone = np.zeros((n, LENGTH + CHOICE), dtype=bool)  # by place of the string's start within the region
    for j in range(CHOICE):
        has = np.flatnonzero((j <= anchors) & (lengths - anchors + j >= LENGTH))
        if len(has) > 1:
            key = before[j, has].astype(np.int64) << 32 | behind[LENGTH - j, has]
            earliest = np.zeros(len(has), dtype=bool)
            earliest[np.unique(key, return_index=True)[1]] = True
            late = has[~earliest]
            gone[late, anchors[late] - j] = True
    edges = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    for (row, start), (_, stop) in zip(np.argwhere(edges == 1).tolist(), np.argwhere(edges == -1).tolist()):
        doc, at = places[own[row]]
        spans.append((doc, at + start, at + stop - 1 + LENGTH))
    return spans


_SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
#: Regions are sorted so many at a time, in whole groups.
CHUNK = 20_000


def _sort_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by hash and place."""

    def work(table: pa.Table) -> pa.RecordBatch:
        h = table.column("k1").to_numpy()
        group = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
        places = list(zip(table.column("doc_id").to_pylist(), table.column("start").to_pylist()))
        spans = _merged(repeated_spans(group, places, table.column("stop").to_numpy().astype(np.int64), table.column("data").to_pylist()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*spans)) or [[]] * 3, _SPANS)], schema=_SPANS)

    for table in whole_groups(batches, "k1", CHUNK):
        yield work(table)


def spans_of_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop): byte spans to remove, not yet merged."""
    spark = docs.sparkSession
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    counts = anchor_hashes(docs).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.filter("n > 1"), "repeated-anchors")
    word = F.shiftright(F.col("h").bitwiseAND(F.lit((1 << BITS) - 1)), 6).cast("int")
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    table = counts.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2^21 rows at most
    repeated = np.zeros(1 << BITS - 6, dtype=np.int64)
    repeated[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    total = counts.agg(F.sum("n")).first()[0] or 0
    busy = counts.filter(F.col("n") > max(MANY, total // MOST_HOT)).select("h").toArrow()  # 2^20 rows at most
    hot = np.sort(busy.column("h").to_numpy())
    rows = cut(suspects(docs, repeated.view(np.uint8), hot), "suspects")

    by_hash = rows.filter(F.col("kind") == REGION).select("k1", "doc_id", "start", "stop", "data")
    by_hash = by_hash.repartition(partitions(spark), "k1").sortWithinPartitions("k1", "doc_id", "start")
    sorted_ = by_hash.mapInArrow(_sort_regions, "doc_id bigint, start int, stop int")

    strings = rows.filter(F.col("kind") == STRING).select("k1", "k2", "doc_id", "start")
    place = F.struct("doc_id", "start")
    firsts = strings.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    again = strings.join(firsts.select("k1", "k2", "first"), ["k1", "k2"]).filter(place != F.col("first"))
    again = again.select("doc_id", "start", (F.col("start") + LENGTH).alias("stop"))
    local = rows.filter(F.col("kind") == SPAN).select("doc_id", "start", "stop")
    return sorted_.unionByName(again).unionByName(local)


def merged_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, starts, stops): the maximal spans of each document, ascending."""
    lists = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def run(batch: dict[str, list]) -> dict[str, list]:
        runs = [_merged([(0, s["start"], s["stop"]) for s in own]) for own in batch["spans"]]
        return {"starts": [[s for _, s, _ in r] for r in runs], "stops": [[e for _, _, e in r] for r in runs]}

    return map_rows(lists, run, "starts array<int>, stops array<int>", ("doc_id",))


#: Spans of no more documents and numbers than this are broadcast; more are joined by shuffling.
FEW_SPANS = 2_000_000


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document; ``kept`` are its remaining bytes.

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a document of smaller doc_id, or further
    to the front of its own; judged on the input, not on what is left. Strings don't cross documents.

    Null or empty text, texts under 100 bytes: nothing goes. Null doc_id: takes no part, nothing goes. Repeated rows (one
    doc_id): one document, which doesn't repeat itself; rows that differ under one doc_id should not occur, they lose the
    same byte numbers. Empty table: empty result. Other columns are left out.
    """
    docs = pick(docs, "doc_id", "text")
    spans = cut(merged_spans(spans_of_repeats(docs)), "repeat-spans")
    size = spans.agg(F.sum(F.size("starts") + 1)).first()[0] or 0
    joined = docs.join(F.broadcast(spans) if size <= FEW_SPANS else spans, "doc_id", "left")

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for text, starts, stops in zip(batch["text"], batch["starts"], batch["stops"]):
            data = (text or "").encode()
            at = [0, *(stops or [])]
            kept = b"".join(data[a:b] for a, b in zip(at, [*(starts or []), len(data)]))
            out["n_bytes"].append(len(data))
            out["n_removed"].append(len(data) - len(kept))
            out["n_spans"].append(len(starts or []))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        return out

    return map_rows(joined, run, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary", ("doc_id",))
