"""Shared helpers: tables, checkpoints, and vectorised word hashing for Arrow batches."""

from __future__ import annotations

import hashlib
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of a word: space and the five ASCII controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch at most: batches of texts are held by the JVM and by its Python workers at once.
BATCH_ROWS = 2048


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by ``BATCH_ROWS``, unless the session asks for fewer rows itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of ``sf_dir``."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share: the session's ``spark.checkpoint.dir``.

    One is made only where none is set and all tasks run on this machine, as in
    tests; on a cluster a folder of one machine would lose data, so that is an
    error.
    """
    small_batches(spark)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and cut from its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor`` (null ids count as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(divisor)


def word_count(text: Column) -> Column:
    """Number of words in ``text``; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- vectorised words -----------------------------------------------------------

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD1B54A32D192ED03)
    return h ^ (h >> np.uint64(32))


_SIZE, _NEXT, _LEFT = np.uint64(0xA24BAED4963EE407), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
#: Masks of the first 0 to 8 bytes of eight.
_FIRST = np.array([0, *((1 << 8 * n) - 1 for n in range(1, 9))], dtype=np.uint64)
#: Words of more bytes are hashed by BLAKE2b.
_LANES = 64


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the words: eight bytes at a time, each scrambled into what came before, with the word's length."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix((eight[starts] & _FIRST[np.minimum(size, 8)]) + (size + (seed << 40)).astype(np.uint64) * _SIZE)
    left, at = np.flatnonzero(size > 8), 8
    while len(left) and at < _LANES:
        out[left] = mix(out[left] * _NEXT ^ (eight[starts[left] + at] & _FIRST[np.minimum(size[left] - at, 8)]))
        at += 8
        left = left[size[left] > at]
    for i in left.tolist():
        key = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=seed.to_bytes(8, "little"))
        out[i] = int.from_bytes(key.digest(), "little")
    return out


def hash_bytes(data: bytes) -> int:
    """The hash that :func:`words` gives to this word."""
    return int(words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[2][0])


def texts(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 20):
    """Slices of an Arrow batch as ``(first row, UTF-8 bytes, offsets)``.

    A slice holds whole texts and about ``most`` bytes, so working memory is
    bounded by the larger of that and one text. Null texts are empty.
    """
    pa.default_memory_pool().release_unused()  # of the batches before
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(data: np.ndarray, at: np.ndarray, lower: bool = False, seed: int = 0):
    """Words of the texts in ``data`` cut at ``at``: starts, ends, 64-bit hashes, and the first word of each text.

    The last array has one entry more than there are texts. Hashes of different
    seeds are unrelated.
    """
    if lower:
        data = _LOWER[data]
    inside = ~_BLANK[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[at] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | begins[1:-1]
    closes = inside
    closes[:-1] &= ~inside[1:] | begins[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, _word_hashes(data, starts, ends, seed), np.searchsorted(starts, at)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words (across text bounds too; callers mask those).

    A run's hash scrambles those of its two halves, so no pattern of repeated
    words makes different runs equal.
    """
    if len(hashes) < k:
        return np.zeros(0, dtype=np.uint64)
    out, width = mix(hashes + np.uint64(int(k) * int(_SIZE) % (1 << 64))), 1
    while width < k:
        step = min(width, k - width)  # the last halves overlap
        out = mix(out[:-step] * _LEFT + out[step:])
        width += step
    return out


# --- bounded bit tables ---------------------------------------------------------

#: Bits of a broadcast bit table: 1 MB, whatever the number of keys.
BITS = 1 << 23


def bit_rows(keys: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """A bit table of the long values in ``column``: at most bits / 64 rows of (word, mask)."""
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    return keys.select(F.call_function("div", at, F.lit(64)).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(`{column}`), {bits}L), 64) as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def perhaps(df: DataFrame, column: str, keys: DataFrame, key: str, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` that may be, and rows that can't be, among ``keys``, without moving ``df``.

    The broadcast is the bit table, bounded by ``bits``. It may let rows pass
    that aren't among the keys, never the reverse, so an exact join of the first
    part settles them; with many keys that part grows towards all of ``df``.
    """
    at, word, mask = (fresh(df, x) for x in ("at", "word", "mask"))
    table_ = F.broadcast(bit_rows(keys, key, bits).select(F.col("word").alias(word), F.col("mask").alias(mask)))
    marked = df.withColumn(at, F.pmod(F.xxhash64(column), F.lit(bits)))
    marked = marked.join(table_, F.call_function("div", F.col(at), F.lit(64)) == F.col(word), "left")
    hit = F.coalesce(F.expr(f"getbit(`{mask}`, cast(pmod(`{at}`, 64) as int))") == 1, F.lit(False))
    return marked.filter(hit).drop(at, word, mask), marked.filter(~hit).drop(at, word, mask)


def without(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """``df`` without the rows whose ``column`` is in ``ids`` (a distinct, non-null column of that name)."""
    maybe, no = perhaps(df, column, ids, column)
    return no.unionByName(maybe.join(ids.select(column), column, "left_anti").select(*df.columns))


def packed_bits(values: DataFrame, column: str, bits: int) -> bytes:
    """Bits at ``values`` (non-negative longs below ``bits``) as bytes; at most bits / 64 rows reach the driver."""
    rows = values.select(F.call_function("div", F.col(column), F.lit(64)).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(`{column}`, 64) as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return out.tobytes()


def has_bit(table_: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether bits ``at`` of a byte table are set."""
    return (table_[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


# --- blocks of texts ------------------------------------------------------------

#: The level of compressed pieces.
ZSTD = 6


def packed(*columns: np.ndarray) -> bytes:
    """Equally long arrays of numbers as compressed planes of bytes."""
    planes = np.concatenate([np.ascontiguousarray(x, np.uint64).view(np.uint8).reshape(-1, 8).T for x in columns])
    return planes.shape[1].to_bytes(8, "little") + pa.Codec("zstd", ZSTD).compress(planes.tobytes(), asbytes=True)


def unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    """The arrays that :func:`packed` packed, as unsigned numbers."""
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=8 * n * columns, codec="zstd", asbytes=True), np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in planes]


def blocks(batches, least: int):
    """``(number, slices)`` of runs of rows that have about ``least`` bytes of text; the number is a hash of the texts."""
    held, size, name = [], 0, hashlib.blake2b(digest_size=8)
    number = lambda: int.from_bytes(name.digest(), "little", signed=True)
    for batch in batches:
        for first, data, at in texts(batch):
            held.append(batch.slice(first, len(at) - 1))
            name.update(np.ascontiguousarray(at))
            name.update(np.ascontiguousarray(data))
            size += len(data)
            if size >= least:
                yield number(), held
                held, size, name = [], 0, hashlib.blake2b(digest_size=8)
    if held:
        yield number(), held


_MARKS = np.ones(256, dtype=bool)
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = False


def plain(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text bytes for loose comparison: A-Z and accented Latin-1 capitals in lower case, ASCII marks dropped."""
    data = _LOWER[data]
    after = np.zeros(len(data), dtype=bool)
    after[1:] = data[:-1] == 0xC3
    capital = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    data = data + capital.astype(np.uint8) * np.uint8(32)
    keep = _MARKS[data]
    return data[keep], np.append(0, np.cumsum(keep))[at]
