"""Near duplicates by min-max hashing: bands of minima and maxima propose, whole sets confirm."""

from __future__ import annotations

import hashlib
import string

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import components, cut, documents, map_rows, pick, with_ids

WIDTH = 4
PERCENT = 80
#: 36 bands of 5 values: a pair of likeness 0.8 meets in none with a chance of 6 in 10 million, a likelier one less.
BANDS, ROWS = 36, 5
#: Each permutation gives its minimum and its maximum: 180 values from 90 permutations.
PERMUTATIONS = BANDS * ROWS // 2
_SEED = 7
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_draw = np.random.default_rng(_SEED)
_FACTORS = _draw.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draw.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_PLACES = _draw.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def shingles(text: str | None, width: int = WIDTH, known: dict[bytes, int] | None = None) -> np.ndarray:
    """The set of 64-bit names of the word windows, sorted; fewer words than a window are one; no words, none.

    Words are runs of other characters than the six ASCII white spaces, A-Z in lower case.
    """
    known = {} if known is None else known
    words = (text or "").encode().translate(_LOWER).split()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    names = np.array([known[w] for w in words], dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(names.tobytes(), seed=_SEED)] if len(words) else [], dtype=np.uint64)
    n = len(words) - width + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        h += names[i : i + n] * _PLACES[i]
    return np.unique(_mix(h))


def signature(names: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a set under each permutation, in turn."""
    out = np.empty((PERMUTATIONS, 2), dtype=np.uint64)
    out[:, 0], out[:, 1] = np.iinfo(np.uint64).max, 0
    for start in range(0, len(names), 4096):
        moved = names[None, start : start + 4096] * _FACTORS[:, None] + _SHIFTS[:, None]
        out[:, 0] = np.minimum(out[:, 0], moved.min(axis=1))
        out[:, 1] = np.maximum(out[:, 1], moved.max(axis=1))
    return out.ravel()


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    rows = values.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _PLACES[40]
    for i in range(ROWS):
        h = _mix(h + rows[:, i] * _PLACES[50 + i])
    return h.view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the whole set, band keys) of every row; without shingles no digest and no keys."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        known: dict[bytes, int] = {}
        out: dict[str, list] = {"n_shingles": [], "digest": [], "keys": []}
        for text in batch["text"]:
            names = shingles(text, width, known)
            out["n_shingles"].append(len(names))
            out["digest"].append(hashlib.blake2b(names.tobytes(), digest_size=16).digest() if len(names) else None)
            out["keys"].append(band_keys(signature(names)) if len(names) else None)
        return out

    return map_rows(docs.select("doc_id", "text"), run, "n_shingles bigint, digest binary, keys array<bigint>", ("doc_id",))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, names) of every row that has shingles."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        known: dict[bytes, int] = {}
        return {"names": [shingles(t, width, known).view(np.int64) for t in batch["text"]]}

    return map_rows(docs.select("doc_id", "text"), run, "names array<bigint>", ("doc_id",)).filter(F.size("names") > 0)


def _linked(inter: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * inter >= percent * (a + b - inter)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("names").alias("_x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("names").alias("_y"))
    n, m = F.size("_x"), F.size("_y")
    sized = pairs.join(left, "a").join(right, "b").filter((100 * F.least(n, m) >= percent * F.greatest(n, m)))
    return sized.filter(_linked(F.size(F.array_intersect("_x", "_y")), n, m, percent)).select("a", "b")


def prefix_pairs(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different groups that may be alike enough, found by their rarest members.

    Members are ordered from rare to common. Two sets that are alike enough share one among the first of each: the longer
    set's first ``n - needed + 1`` for the least partner, the shorter's for a partner as long as itself. At the first
    member they share, what is left of either must still suffice.
    """
    each = sets.select("doc_id", F.size("names").alias("n"), F.explode("names").alias("name"))
    counts = each.groupBy("name").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    # members of one set alone come first in the order, and no pair can meet there: their number is enough
    shared = each.join(counts, "name")
    ranked = shared.groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "name"))).alias("m"))
    lead = F.col("n") - F.size("m")
    probe = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0)).cast("int") + 1
    index = F.col("n") - F.ceil(F.col("n") * (2 * percent) / F.lit(100.0 + percent)).cast("int") + 1
    ranked = ranked.withColumns({"lead": lead, "probe": probe, "index": index}).join(groups, "doc_id")

    def firsts(length: str, side: str) -> DataFrame:
        kept = F.slice("m", F.lit(1), F.greatest(F.col(length) - F.col("lead"), F.lit(0)))
        return ranked.select(
            F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("component").alias(f"g_{side}"), "lead", F.posexplode(kept).alias("p", "x")
        ).select(side, f"n_{side}", f"g_{side}", (F.col("lead") + F.col("p")).alias(f"p_{side}"), F.col("x.name").alias("name"))

    long, short = firsts("probe", "a"), firsts("index", "b")
    needed = F.ceil((F.col("n_a") + F.col("n_b")) * percent / F.lit(100.0 + percent))
    rest = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    fits = (F.col("g_a") != F.col("g_b")) & ((F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
    fits &= 100 * F.col("n_b") >= percent * F.col("n_a")
    return long.join(short, "name").filter(fits & (rest >= needed)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Two documents are linked if their sets of word windows have a likeness of ``percent`` per cent or more; a component is
    what links connect, named by its smallest doc_id, which alone is kept.

    1. Documents with the same set (by a 128-bit digest) are one class, represented by the smallest doc_id.
    2. Representatives that share a band key are candidates. Each is compared with the smallest of each of its buckets, on
       whole sets. The links make first components.
    3. Buckets that still hold several components are settled without all their pairs: representatives in them are joined
       on their rarest shingles, across components, and compared on whole sets.

    Null or empty text: no shingles, linked with nothing. Null doc_id: takes no part, no component, kept. Rows that share
    a doc_id are one document, linked where any of their texts is. Empty table: empty result. Other columns are left out.
    """
    docs = pick(docs, "doc_id", "text")
    rows = cut(sketches(docs, width), "sketches")
    known = rows.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    # written, so that the join below reads plain shuffles, whose hot keys Spark can split
    classes = cut(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    member = cut(rows.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").drop("digest"), "members")

    keys = known.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "semi")
    keys = keys.select("doc_id", F.explode("keys").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    shared = cut(keys.join(cut(buckets.select("key", "first"), "bucket-keys"), "key"), "buckets")
    wanted = cut(shared.select("doc_id").distinct(), "candidates")
    sets = cut(shingle_sets(with_ids(docs, wanted, "semi"), width), "sets")

    stars = shared.filter("first < doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    first = components(confirm(stars, sets, percent))

    grouped = shared.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    grouped = cut(grouped.select("doc_id", "key", F.coalesce("component", "doc_id").alias("component")), "grouped")
    mixed = grouped.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    open_ = cut(grouped.join(mixed.select("key"), "key", "semi").select("doc_id", "component").distinct(), "unsettled")
    left = cut(sets.join(open_.select("doc_id").distinct(), "doc_id", "semi"), "unsettled-sets")
    more = confirm(prefix_pairs(left, open_, percent), left, percent)
    of = open_.select(F.col("doc_id").alias("a"), F.col("component").alias("_a"))
    to = open_.select(F.col("doc_id").alias("b"), F.col("component").alias("_b"))
    second = components(more.join(of, "a").join(to, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))

    # texts of one doc_id may be in several classes; identity links those
    found = member.join(first.select(F.col("node").alias("rep"), F.col("component").alias("_first")), "rep", "left")
    found = found.withColumn("_first", F.coalesce("_first", "rep", "doc_id"))
    found = found.join(second.select(F.col("node").alias("_first"), F.col("component").alias("_second")), "_first", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_second", "_first"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with the columns of documents."""
    docs = documents(docs)
    dropped = cut(near_duplicates(docs, width, percent).filter("NOT kept").select("doc_id").distinct(), "dropped")
    return with_ids(docs, dropped, "anti").select(*docs.columns)


NEAR_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS s
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {WIDTH - 1}, 1))) AS i FROM words WHERE len(w) > 0)
  )
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c.n >= {PERCENT} * (x.n + y.n - c.n)
),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
smallest AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN smallest m USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""
