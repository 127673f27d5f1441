"""Document fingerprints: a digest of bucket quartiles over hashed byte triplets, and the likeness of two digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import partitions, pick

BUCKETS = 256
#: Places within a window of five bytes whose triplets are counted; each triplet has a salt of its own.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
WINDOW = 5
#: A difference of this much or more is no likeness at all. Two random digests differ by about 1.6 a bucket.
LARGEST_DIFFERENCE = 1.6 * BUCKETS
#: Difference of two quartile codes; opposite ends weigh double.
CODE_DIFFERENCE = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], dtype=np.int64)


def bucket_counts(data: bytes) -> np.ndarray:
    """How many triplets of all windows fall into each bucket. Texts of under five bytes have none."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    n = len(data) - WINDOW + 1
    if n <= 0:
        return counts
    mixed = [np.frombuffer(data, dtype=np.uint8).astype(np.uint32) * np.uint32(k) for k in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]
    for salt, (i, j, k) in enumerate(TRIPLETS, 1):
        h = mixed[0][i : i + n] + mixed[1][j : j + n]
        h ^= mixed[2][k : k + n]
        h += np.uint32(salt * 0x27220A95 & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return counts


def fingerprint(data: bytes) -> str:
    """Hex digits: length on a scale of eighths of a doubling (2), the two ratios of quartiles (1 each), quartile codes
    (2 bits a bucket). Equal bytes have equal fingerprints; the empty text's is all zeros."""
    counts = bucket_counts(data)
    q1, q2, q3 = (int(x) for x in np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]])
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = (codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]).astype(np.uint8)
    length = min(255, int(8 * np.log2(1 + len(data))))
    ratio = [15 * q // q3 if q3 else 0 for q in (q1, q2)]
    return f"{length:02x}{ratio[0]:x}{ratio[1]:x}{packed.tobytes().hex()}"


def difference(a: str, b: str) -> int:
    """Score of two fingerprints: code differences, plus length beyond half a doubling, plus ratios beyond one step."""
    score = max(0, abs(int(a[:2], 16) - int(b[:2], 16)) - 4)
    score += sum(max(0, abs(int(x, 16) - int(y, 16)) - 1) for x, y in zip(a[2:4], b[2:4]))
    return score + int(CODE_DIFFERENCE[_codes(a), _codes(b)].sum())


def _codes(digest: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(digest[4:]), dtype=np.uint8)
    return np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).ravel()


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, 0 for those that differ by the largest difference or more."""
    return max(0.0, 1.0 - difference(a, b) / LARGEST_DIFFERENCE)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range and descending id, the head of the next range last; only the row before is kept."""
    before = None
    for batch in batches:
        out = []
        for group, doc_id, text, guest in zip(*(batch.column(c).to_pylist() for c in ("_range", "doc_id", "text", "_guest"))):
            data = text.encode()
            print_ = fingerprint(data)
            if before is not None and before[0] == group:
                out.append(_row(before, text, print_))
            before = None if guest else (group, doc_id, text, print_)
        columns = list(zip(*out)) if out else [[] for _ in SCHEMA]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)


def _row(before: tuple, following: str, next_print: str) -> tuple:
    _, doc_id, text, own = before
    changed = edited(text, following).encode()
    other = fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), own, other, likeness(own, other), likeness(own, next_print)


def _ranked(docs: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Documents with the range of their id, -1 without one: a search in the bounds; texts pass untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            place = np.searchsorted(bounds, ids.fill_null(0).to_numpy(), side="right").astype(np.int32)
            place[ids.is_null().to_numpy(zero_copy_only=False)] = -1
            yield pa.RecordBatch.from_arrays([ids, batch.column("text"), pa.array(place)], names=["doc_id", "text", "_range"])

    return docs.mapInArrow(run, "doc_id bigint, text string, _range int")


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprint of every document, of its edited text, and their likenesses.

    Documents are ordered by descending doc_id, nulls last, ties by text; after the last comes the first, also if there is
    only one. They are dealt into ``ranges`` ranges of ids (as many as shuffle partitions, at most 2,000), so that no task
    orders all. The first document of a range is also sent to the end of the range above it: one row per range.

    Null text: empty. Repeated rows: rows of their own. Empty table: empty result. Other columns are left out.
    """
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    ranges = min(ranges or partitions(spark), 2000)
    steps = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, steps or [0.5])), F.lit(10_000)).alias("b")).first().b or []))
    ranked = _ranked(docs, np.array(bounds, dtype=np.int64))
    order = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.xxhash64("text"), F.md5(F.col("text").cast("binary")))
    heads = ranked.groupBy("_range").agg(F.max(order).alias("h")).orderBy(F.desc("_range")).collect()
    # one guest for each range: at most 2,001 rows of ids
    known = [r["_range"] for r in heads]
    follows = dict(zip(known, known[1:] + known[:1]))
    guests = []
    for target, origin in follows.items():
        head = next(r.h for r in heads if r["_range"] == origin)
        guests.append((target, origin, head["doc_id"], list(head)[-1]))
    if not guests:
        return spark.createDataFrame([], "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    wanted = F.broadcast(spark.createDataFrame(guests, "_target int, _origin int, _id bigint, _md5 string"))
    sent = (
        ranked.filter(F.col("doc_id").isin([g[2] for g in guests if g[2] is not None]) | F.col("doc_id").isNull())
        .join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.md5(F.col("text").cast("binary")) == F.col("_md5")))
        .dropDuplicates(["_target"])
        .select("doc_id", "text", F.col("_target").alias("_range"), F.lit(True).alias("_guest"))
    )
    rows = ranked.withColumn("_guest", F.lit(False)).unionByName(sent)
    dealt = rows.repartition(ranges, "_range").sortWithinPartitions(
        "_range", "_guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc(), F.md5(F.col("text").cast("binary")).desc()
    )
    return dealt.select("_range", "doc_id", "text", "_guest").mapInArrow(
        _compare, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
