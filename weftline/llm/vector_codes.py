"""Product codes of integer vectors, with entries found by a VA-file filter.

A vector becomes integers, is cut into consecutive parts, and each part gets the
number of its nearest codebook entry. The codebooks start as the parts of the
first vectors and move to the means of their members, round by round; all of it
is integer arithmetic, so results are the same on any cluster.

The nearest entry is found as in a VA-file. Every coordinate of the entries is
quantised to ``2 ** BITS`` cells of about equally many entries. For one part a
table over its coordinates and their cells holds the least and the greatest
squared distance to a cell; sums over the coordinates bound the distance to each
entry from both sides. Only entries whose lower bound doesn't exceed the least
upper bound are compared by exact integers. The tables are scaled down, lower
bounds towards zero and upper bounds away from it, until their sums are exact in
32-bit floats, so no entry that may be nearest is ever passed over.

Each round reads the vectors once. A task sends the sums of its members, one row
for each part and entry (1,024 at most), and the driver holds the codebooks
alone: entries times vector length, whatever the number of vectors.

Cases: vectors that are null, empty, or hold null or non-finite components are
dropped. The length is that of the vector with the smallest id among the others;
a vector of another length stays as a row without code and error. Lengths that
don't divide have a shorter last part, and a part may be empty (its distances are zero). Integer components beyond
``2 ** 27`` are set to that bound, so that every distance fits 64 bits. Null ids
come after all others; rows that repeat, ids included, are rows of their own,
ordered by their vectors where ids are equal. With fewer vectors than entries
the codebooks have as many entries as there are vectors. An empty table gives an
empty result. Columns other than the id, the vector and the label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits of a coordinate's cell. Of 256 entries of 16 coordinates, 18 are left to compare at four bits and 106 at three.
BITS = 4
#: Integer components reach this far.
FARTHEST = 1 << 27


def whole_vectors(column: pa.ListArray, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and components (double) of the vectors of ``length`` without null or non-finite components."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros((0, length or 0))
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == length)
    x = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), length)
    good = np.isfinite(x).all(axis=1)
    return rows[good], x[good]


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """The components as integers."""
    return np.clip(np.floor(x * scale), -FARTHEST, FARTHEST).astype(np.int64)


class Codebook:
    """The entries of one part, with the cells of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        count, width = entries.shape
        cells = 1 << bits
        rank = np.empty_like(entries)
        np.put_along_axis(rank, np.argsort(entries, axis=0, kind="stable"), np.arange(count)[:, None], axis=0)
        cell = rank * cells // max(count, cells)
        self.low, self.high = np.full((width, cells), FARTHEST), np.full((width, cells), -FARTHEST)
        for j in range(width):
            np.minimum.at(self.low[j], cell[:, j], entries[:, j])
            np.maximum.at(self.high[j], cell[:, j], entries[:, j])
        # row j * cells + c marks the entries whose coordinate j is in cell c
        self.members = np.zeros((width * cells, count), np.float32)
        self.members[np.arange(width) * cells + cell, np.arange(count)[:, None]] = 1

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """For each row of ``x``, the entries whose lower bound doesn't exceed the least upper bound."""
        below, above = self.low - x[:, :, None], x[:, :, None] - self.high
        least = np.maximum(np.maximum(below, above), 0) ** 2
        most = np.where(self.low > self.high, 0, np.maximum(np.abs(below), np.abs(above)) ** 2)  # cells without entries are never looked up
        least[:, self.low > self.high] = 0
        shift = max(0, int(most.max(initial=0)).bit_length() + x.shape[1].bit_length() - 24)
        lower = (least >> shift).reshape(len(x), -1).astype(np.float32) @ self.members
        upper = (-(-most >> shift)).reshape(len(x), -1).astype(np.float32) @ self.members
        return lower <= upper.min(axis=1)[:, None]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x``, the nearest entry (the first of equally near ones) and its squared distance."""
        row, entry = np.nonzero(self.candidates(x))
        far = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        first = np.searchsorted(row, np.arange(len(x)))  # every row has a candidate
        best = np.minimum.reduceat(far, first) if len(x) else far
        hit = np.flatnonzero(far == best[row])
        return entry[hit[np.searchsorted(row[hit], np.arange(len(x)))]], best


def cuts(length: int, parts: int) -> list[slice]:
    """The consecutive parts of a vector."""
    width = -(-length // parts)
    return [slice(min(length, i * width), min(length, (i + 1) * width)) for i in range(parts)]


def _first(df: DataFrame, vec_id: str, vector: str, entries: int, scale: int, length: int | None = None) -> np.ndarray | None:
    """Integer vectors of the smallest ids."""
    v = F.col(vector)
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = df.filter(v.isNotNull() & (F.size(v) > 0)).filter(~odd)
    if length:
        whole = whole.filter(F.size(v) == length)
    rows = whole.select(F.col(vec_id).alias("i"), v.cast("array<double>").alias("v")).orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()
    if not rows:
        return None
    if any(len(r.v) != len(rows[0].v) for r in rows):
        return _first(df, vec_id, vector, entries, scale, len(rows[0].v))
    return integers(np.array([r.v for r in rows]), scale)


def _members(vector: str, books: np.ndarray, parts: int, scale: int):
    """Sums of the members of every entry over a task's vectors."""
    length = books.shape[1]
    where = cuts(length, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(books[:, s]) for s in where]
        sums, counts = np.zeros((parts, *books.shape), np.int64), np.zeros((parts, len(books)), np.int64)
        for batch in batches:
            x = integers(whole_vectors(batch.column(0), length)[1], scale)
            for p, (s, book) in enumerate(zip(where, made, strict=True)):
                code, _ = book.nearest(x[:, s])
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                if len(used):
                    sums[p, used, s] += np.add.reduceat(x[order, s], first, axis=0)
                    counts[p, used] += np.diff(np.append(first, len(order)))
        part, entry = np.nonzero(counts)
        if len(part):
            held = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * length, pa.int32()), pa.array(sums[part, entry].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), held], ["part", "entry", "members", "sums"])

    return run


def codebooks(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """The entries (integers, one row for each, its parts side by side) after all rounds; None without vectors."""
    books = _first(df, vec_id, vector, entries, scale)
    if books is None:
        return None
    length = books.shape[1]
    for _ in range(rounds):
        sent = df.select(vector).mapInArrow(_members(vector, books, parts, scale), "part int, entry int, members long, sums array<long>")
        total = sent.groupBy("part", "entry").agg(F.sum("members").alias("members"), F.array(*(F.sum(F.col("sums")[j]) for j in range(length))).alias("sums"))
        moved = books.copy()
        for r in total.collect():  # parts times entries rows
            s = cuts(length, parts)[r.part]
            moved[r.entry, s] = np.array(r.sums[s], np.int64) // r.members
        books = moved
    return books


def _codes(books: np.ndarray, parts: int, scale: int):
    """A task's rows with their codes and errors."""
    length = books.shape[1]
    where = cuts(length, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(books[:, s]) for s in where]
        for batch in batches:
            vectors = batch.column(1)
            rows, x = whole_vectors(vectors, length)
            x = integers(x, scale)
            found = [book.nearest(x[:, s]) for s, book in zip(where, made, strict=True)]
            code = np.stack([c for c, _ in found], axis=1).astype(np.uint8 if len(books) <= 256 else np.uint16)
            error = sum(far for _, far in found)
            digits = code.astype(code.dtype.newbyteorder(">")).tobytes().hex()
            step = 2 * code.dtype.itemsize * parts
            out, far = [None] * len(vectors), [None] * len(vectors)
            for k, r in enumerate(rows.tolist()):
                out[r], far[r] = digits[k * step : (k + 1) * step], int(error[k])
            # a whole vector of another length stays, without a code
            other = [r for r in range(len(vectors)) if out[r] is None and _whole(vectors[r].as_py())]
            kept = pa.array(np.sort(np.append(rows, np.array(other, np.int64))).astype(np.int64))
            columns = [batch.column(0), pa.array(out, pa.string()), pa.array(far, pa.int64()), batch.column(2)]
            yield pa.RecordBatch.from_arrays([c.take(kept) for c in columns], ["vec_id", "code", "error", "label"])

    return run


def _whole(v: list | None) -> bool:
    return bool(v) and all(c is not None and np.isfinite(c) for c in v)


def encoded(df: DataFrame, books: np.ndarray, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``code`` (hex digits of the parts' entries), ``error`` (squared distance) and ``label`` of every whole vector."""
    kinds = dict(df.dtypes)
    return df.select(F.col(vec_id).alias("vec_id"), vector, F.col(label).alias("label")).mapInArrow(_codes(books, parts, scale), f"vec_id {kinds[vec_id]}, code string, error long, label {kinds[label]}")


def digest(books: np.ndarray, parts: int = PARTS) -> str:
    """SHA-256 of all components, by part, entry and place."""
    ordered = np.concatenate([books[:, s].ravel() for s in cuts(books.shape[1], parts)])
    return hashlib.sha256(",".join(map(str, ordered.tolist())).encode()).hexdigest()


def op11_vector_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings in four parts of 256 entries, after four rounds."""
    vectors = table(spark, sf_dir, "embeddings")
    books = codebooks(vectors)
    if books is None:
        return spark.createDataFrame([], f"vec_id {dict(vectors.dtypes)['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    rows = saved(encoded(vectors, books))
    by_label = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same by DuckDB: every vector against every entry."""
    steps = [
        """WITH v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        p AS MATERIALIZED (SELECT r, part, x[16 * part + 1 : 16 * part + 16] AS y, list_sum(list_transform(x[16 * part + 1 : 16 * part + 16], lambda c: c * c)) AS yy FROM v, range(4) t(part)),
        b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, y AS e, yy AS ee FROM p WHERE r <= 256)"""
    ]
    for k in range(5):
        steps.append(f"a{k} AS MATERIALIZED (SELECT p.r, p.part, arg_min(b.entry, (p.yy + b.ee - 2 * list_inner_product(p.y, b.e), b.entry)) AS entry, min(p.yy + b.ee - 2 * list_inner_product(p.y, b.e)) AS far FROM p JOIN b{k} b ON p.part = b.part GROUP BY p.r, p.part)")
        if k < 4:
            steps.append(
                f"""m{k} AS (SELECT part, entry, list(c ORDER BY i) AS e FROM (SELECT a.part, a.entry, i, floor(sum(p.y[i]) / count(*)) AS c FROM a{k} a JOIN p ON a.r = p.r AND a.part = p.part, range(1, 17) t(i) GROUP BY a.part, a.entry, i) GROUP BY part, entry),
            b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e, list_sum(list_transform(coalesce(m.e, b.e), lambda c: c * c)) AS ee FROM b{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.entry = m.entry)"""
            )
    steps.append(
        """d AS (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda c: c::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b4),
        c AS (SELECT r, string_agg(lower(printf('%02x', entry::INTEGER)), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a4 GROUP BY r)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (r), d"""
    )
    return ",\n".join(steps)


OP11_SQL = _oracle()
