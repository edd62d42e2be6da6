"""Substring deduplication: seed with winnowed anchors, extend both ways, keep maximal repeats.

A window is ``window`` consecutive words. Every window selects one anchor, the
smallest of its runs of ``seed`` words by hash (the rightmost of equal ones),
so equal windows select equal anchors at equal places, and each anchor
occurrence owns a contiguous range of windows around it.

1. Seed: anchors are counted by their documents. An anchor of one document
   only ends here.
2. Extend: ranges of anchors that may be shared are joined to the shared ones.
   Where all occurrences of an anchor reach alike, to the left and the right,
   one row stands for the range. Where they differ, the texts that have such
   ranges are opened, and each window of those ranges is a row, so the part of
   the extension that matches is found on either side.
3. A row whose words also stand in a document with a smaller doc_id marks its
   words; adjoining marks make maximal repeats, and those words go.

A range or window is known by a 128-bit BLAKE2b digest of its words
themselves, so no clash of word hashes removes a word. It is compared with the
smallest document that has it, never with all others, so a passage in a third
of all documents costs one row for each of them.

Shared anchors and opened texts are looked up in bit tables of fixed size
first, which spare rows from being moved; exact joins follow. The fuller a
table, the more rows are moved; results and path are the same.

Cases: words are runs of ``[^\\x20\\x09-\\x0D]``, unchanged; null texts and
texts of fewer than ``window`` words lose nothing; a very long text is read
whole, in one task, and costs memory in proportion to its length; a document
never matches itself, nor a row of equal doc_id; rows of one doc_id with
different texts are judged each by its own words, equal rows alike; rows with
a null doc_id lose nothing and take nothing from others, as their id is neither
smaller nor larger than any; further columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grams, has_bit, mix, packed_bits, perhaps, saved, table, texts, words

SEED, WINDOW = 25, 50
#: Bits of the table of shared anchors: 4 MB.
TABLE_BITS = 1 << 25


def selected(hashes: np.ndarray, window: int, seed: int) -> np.ndarray:
    """For each window of one text, the place of its anchor."""
    n, span = len(hashes) - window + 1, window - seed + 1
    runs = grams(hashes, seed)
    place = np.arange(len(runs), dtype=np.int64)
    best, at, width = runs, place, 1

    def less(x, px, y, py):  # the later of equal ones
        later = y <= x
        return np.where(later, y, x), np.where(later, py, px)

    while 2 * width <= span:
        best, at = less(best[:-width], at[:-width], best[width:], at[width:])
        width *= 2
    if width < span:
        gap = span - width
        best, at = less(best[:-gap], at[:-gap], best[gap:], at[gap:])
    return at[:n]


class Ranges:
    """The anchors of one text: hash, first and last window owned, and the hash of all words they reach."""

    def __init__(self, hashes: np.ndarray, window: int, seed: int):
        at = selected(hashes, window, seed)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        self.first, self.last = first, np.append(first[1:], len(at)) - 1
        self.windows = grams(hashes, window)
        self.anchor = grams(hashes, seed)[at[first]]
        self.offset = at[first] - self.first  # of the anchor in the first window
        # Windows at both ends reach all words between, as a range is shorter than a window.
        self.reach = mix(self.windows[self.first] * np.uint64(0x9E3779B97F4A7C15) + self.windows[self.last] + (self.last - self.first).astype(np.uint64) * np.uint64(64) + self.offset.astype(np.uint64))


def _ranges(batch: pa.RecordBatch, window: int, seed: int):
    """``(row, Ranges, Digests)`` of the texts that have a window."""
    for row, data, at in texts(batch):
        starts, ends, hashes, bounds = words(data, at)
        for i in np.flatnonzero(np.diff(bounds) >= window):
            mine = slice(bounds[i], bounds[i + 1])
            yield row + int(i), Ranges(hashes[mine], window, seed), Digests(data, starts[mine], ends[mine])


class Digests:
    """Digests of a text's runs of words, joined by one space."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Two longs for each run of words from ``first`` to before ``end``."""
        if not len(first):
            return np.zeros((0, 2), dtype=np.int64)
        body = memoryview(b" ".join(self.data[self.starts[0] : self.ends[-1]].tobytes().split()))
        size = self.ends - self.starts + 1
        after = np.cumsum(size)
        begin, stop = (after - size)[first].tolist(), (after[end - 1] - 1).tolist()
        found = b"".join([blake2b(body[s:e], digest_size=16).digest() for s, e in zip(begin, stop, strict=True)])
        return np.frombuffer(found, np.int64).reshape(-1, 2)


def _batches(rows, names, types, most=1 << 17):
    """Record batches of about ``most`` rows from tuples of arrays."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def anchors(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """anchor, reach, doc_id: one row for each in a document."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()

            def rows(batch=batch, ids=ids):
                for i, r, _ in _ranges(batch, window, seed):
                    both = np.unique(np.stack([r.anchor, r.reach], axis=1), axis=0) if len(r.anchor) > 1 else np.stack([r.anchor, r.reach], axis=1)
                    yield np.ascontiguousarray(both[:, 0]).view(np.int64), np.ascontiguousarray(both[:, 1]).view(np.int64), np.full(len(both), ids[i])

            yield from _batches(rows(), ["anchor", "reach", "doc_id"], [pa.int64()] * 3)

    return docs.select("doc_id", "text").mapInArrow(run, "anchor long, reach long, doc_id long")


_ROWS = "k1 long, k2 long, doc_id long, body long, first long, last long"
_NAMES = ["k1", "k2", "doc_id", "body", "first", "last"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and body, which tells rows of one doc_id apart by their texts."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("body"))


def spans(docs: DataFrame, window: int, seed: int, shared: DataFrame) -> DataFrame:
    """k1, k2, doc_id, body, first, last: the ranges of shared anchors, or their single windows where reaches differ."""
    at = F.expr(f"pmod(anchor, {TABLE_BITS}L)")
    held = docs.sparkSession.sparkContext.broadcast(packed_bits(shared.select(at.alias("at")), "at", TABLE_BITS))

    def run(batches):
        bits = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            ids, bodies = batch.column(0).to_numpy(), batch.column(2).to_numpy()

            def rows(batch=batch, ids=ids, bodies=bodies):
                for i, r, digests in _ranges(batch, window, seed):
                    on = has_bit(bits, r.anchor % np.uint64(TABLE_BITS))
                    first, last = r.first[on], r.last[on]
                    keys = digests.of(first, last + window)
                    yield keys[:, 0], keys[:, 1], np.full(len(first), ids[i]), np.full(len(first), bodies[i]), first, last, r.anchor[on].view(np.int64)

            yield from _batches(rows(), [*_NAMES, "anchor"], [pa.int64()] * 7)

    ranges = docs.select("doc_id", "text", "body").mapInArrow(run, f"{_ROWS}, anchor long")
    met = saved(ranges.join(shared, "anchor").select(*_NAMES, "differs"))
    places = F.collect_set(F.struct("first", "last")).alias("places")  # of one text, by its own words
    return met.filter("NOT differs").drop("differs").unionByName(saved(opened(docs, saved(met.filter("differs").groupBy("doc_id", "body").agg(places)), window)))


def opened(docs: DataFrame, ranges: DataFrame, window: int) -> DataFrame:
    """The single windows of the ``ranges`` (doc_id, body, places) of ``docs``."""
    maybe, _ = perhaps(docs.select("doc_id", "body", "text"), "body", ranges, "body")

    def run(batches):
        for batch in batches:
            ids, bodies, places = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)

            def rows(batch=batch, ids=ids, bodies=bodies, places=places):
                for row, data, at in texts(batch):
                    starts, ends, _, bounds = words(data, at)
                    for i in range(len(at) - 1):
                        pairs = places[row + i].values.flatten()
                        first, last = (np.asarray(x) for x in pairs)
                        size = last - first + 1
                        start = np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                        mine = slice(bounds[i], bounds[i + 1])
                        keys = Digests(data, starts[mine], ends[mine]).of(start, start + window)
                        yield keys[:, 0], keys[:, 1], np.full(len(start), ids[row + i]), np.full(len(start), bodies[row + i]), start, start

            yield from _batches(rows(), _NAMES, [pa.int64()] * 6)

    return maybe.join(ranges, ["doc_id", "body"]).select("doc_id", "body", "text", "places").mapInArrow(run, _ROWS)


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, body, spans: word ranges [first, end) of a text that stand in a row with a smaller doc_id.

    ``docs`` has doc_id, text and body. Spans of one text may adjoin or overlap; their union is its repeats.
    """
    if not 1 <= seed < window:
        raise ValueError("a seed is shorter than a window")
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    found = anchors(known, window, seed).groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("reach").alias("a"), F.max("reach").alias("b"))
    shared = saved(found.filter("low < high").select("anchor", (F.col("a") != F.col("b")).alias("differs")))
    rows = spans(known, window, seed, shared)
    least = saved(rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("k1", "k2", "low"))
    hit = rows.join(least, ["k1", "k2"]).filter("low < doc_id")
    return hit.groupBy("doc_id", "body").agg(F.collect_set(F.struct("first", (F.col("last") + window).alias("end"))).alias("spans"))


def cut(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the text of the words that stay, joined by one space)."""
    docs = _keyed(docs)
    found = saved(repeats(docs, window, seed))
    maybe, clean = perhaps(docs, "body", found, "body")
    none = F.lit(None).cast("array<struct<first:bigint,end:bigint>>")
    both = maybe.join(found, ["doc_id", "body"], "left").unionByName(clean.withColumn("spans", none)).select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            ids, marks = batch.column(0), batch.column(2)
            n_words, n_removed, kept = [], [], []
            for row, data, at in texts(batch):
                raw = data.tobytes()
                for i in range(len(at) - 1):
                    w = raw[at[i] : at[i + 1]].split()
                    gone = np.zeros(len(w) + 1, dtype=np.int64)
                    for x in marks[row + i].as_py() or ():
                        gone[x["first"]] += 1
                        gone[x["end"]] -= 1
                    gone = np.cumsum(gone)[:-1] > 0
                    n_words.append(len(w))
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join(x for x, g in zip(w, gone, strict=True) if not g) if n_removed[-1] else b" ".join(w))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-word windows that start in a smaller doc_id."""
    return cut(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT row, doc_id, i, array_to_string(w[i:i + 49], ' ') AS k
  FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT row, i + j.range AS p FROM win JOIN low USING (k), range(0, 50) j WHERE m < doc_id),
word AS (SELECT row, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT word.row, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS t
  FROM word LEFT JOIN gone ON gone.row = word.row AND gone.p = word.p GROUP BY word.row)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row)
"""
