"""Nearest neighbours by cosine with collision-counting hashing.

Vectors are scaled to length one, where the nearest by cosine are the nearest by
distance. Each of ``DIRECTIONS`` random projections keeps its values in one
sorted array. A query opens a window around its own value in every array and
widens all of them together, radius by radius (virtual rehashing: a wider window
is the old one and what lies beside it, so nothing is hashed again). A vector
collides once for each window it lies in; those with enough collisions are
verified by their exact cosine. The search ends when the k-th best verified
vector is no farther than the radius: a vector at that distance has been
verified with a probability of ``1 - MISSED`` by the choice of the threshold,
nearer ones with a higher one. Beyond the greatest radius, two, whatever hasn't
been verified is, so there is no cap on windows or candidates, and a query finds
all candidates if there are no more than k.

Every row is indexed. Rows are dealt by the hash of their id to shards of
``SHARD`` components (65,536 vectors of 64), whose number depends on the data
alone, and every query visits every shard; with fewer shards than cores, the
queries of a shard are split over several tasks that index it alike, so results
don't depend on the cluster. In a task the vectors of a shard come first and are
indexed, then its queries stream by in batches. A shard answers with k rows for
each query, of which the k best stay.

Cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do rows with a null id. Vectors are compared with those of the
same length only. Rows with the query's id are its own row and no candidates;
rows that repeat count once for each id, with the best score. Very long vectors
make shards of fewer rows. Empty tables give an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

NEAREST, DIRECTIONS, SEED = 5, 80, 0
#: Width of a window as a multiple of the radius, growth of the radius, and the first one.
WIDTH, GROWTH, FIRST = 2.75, 1.25, 0.05
#: Probability that a vector at the final radius isn't verified.
MISSED = 0.05
#: Components of the vectors of one shard.
SHARD = 1 << 22
#: Room for the rounding of 32-bit cosines.
ROUNDING = 1e-5


def threshold(directions: int = DIRECTIONS, missed: float = MISSED) -> int:
    """Collisions that a vector at the radius reaches but with a probability of ``missed``."""
    normal = NormalDist()
    hit = 2 * normal.cdf(WIDTH / 2) - 1
    return max(1, math.floor(directions * hit + normal.inv_cdf(missed) * math.sqrt(directions * hit * (1 - hit))))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two of their largest component: exact, and no square of it overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


class Index:
    """Sorted projections of some vectors (ids, rows of components), none of them zero."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, directions: int = DIRECTIONS, seed: int = SEED):
        order = np.lexsort((ids,))
        self.ids, self.x = ids[order], scaled(x[order])
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.unit = (self.x / self.norm[:, None]).astype(np.float32)
        self.axes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], directions)).astype(np.float32)
        values = (self.unit @ self.axes).T
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        # one sorted array of all projections: each is moved beyond the one before
        self.step = 4 * float(np.abs(values).max(initial=1)) + 16 * float(np.sqrt((self.axes**2).sum(axis=0)).max())
        self.shift = np.arange(directions) * self.step
        self.values = (np.take_along_axis(values, self.order, axis=1).astype(np.float64) + self.shift[:, None]).ravel()
        self.least = threshold(directions)

    def search(self, query: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the nearest ``k``, nearest first."""
        n, q = len(self.ids), scaled(q[None])[0]
        unit = (q / np.sqrt((q * q).sum())).astype(np.float32)
        at = unit @ self.axes + self.shift
        low = high = np.searchsorted(self.values, at)
        order, ends = self.order.ravel(), np.arange(len(at)) * n
        counts, near = np.zeros(n, np.int32), np.full(n, -np.inf, np.float32)
        new = self.ids != query
        radius, kth = FIRST, np.inf
        while True:
            half = WIDTH * radius / 2
            left = np.maximum(np.searchsorted(self.values, at - half), ends)
            right = np.minimum(np.searchsorted(self.values, at + half, "right"), ends + n)
            left, right = np.minimum(left, low), np.maximum(right, high)
            beside = [order[a:b] for a, b in zip(left.tolist(), low.tolist(), strict=True)] + [order[a:b] for a, b in zip(high.tolist(), right.tolist(), strict=True)]
            counts += np.bincount(np.concatenate(beside), minlength=n).astype(np.int32)
            low, high = left, right
            over = np.flatnonzero((counts >= self.least) & new)
            if radius >= 2 and np.count_nonzero(near > -np.inf) + len(over) < k:
                over = np.flatnonzero(new)
            near[over], new[over] = self.unit[over] @ unit, False
            if np.count_nonzero(near > -np.inf) >= k:
                kth = math.sqrt(max(0.0, 2 - 2 * float(-np.partition(-near, k - 1)[k - 1])))
            if kth <= radius or radius >= 2:
                break
            radius = min(2.0, radius * GROWTH, max(kth, FIRST))
        found = np.flatnonzero(near > -np.inf)
        if len(found) > k:
            found = found[near[found] >= np.sort(near[found])[-k] - ROUNDING]
        score = (self.x[found] * q).sum(axis=1) / (self.norm[found] * math.sqrt((q * q).sum()))
        best = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found][best], score[best]


def _sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that take part; of equal rows in a batch, one."""
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero((sizes > 0) & ids.is_valid().to_numpy(zero_copy_only=False))
        if not len(rows):
            continue
        sizes, ids = sizes[rows], ids.take(pa.array(rows)).to_numpy()
        x = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        good = np.add.reduceat(~np.isfinite(x), starts) == 0
        good &= np.maximum.reduceat(np.abs(np.nan_to_num(x)), starts) > 0
        seen: set[tuple[int, bytes]] = set()
        keep = []
        for i in np.flatnonzero(good).tolist():
            row = (int(ids[i]), x[starts[i] : starts[i] + sizes[i]].tobytes())
            if row not in seen:
                seen.add(row)
                keep.append(rows[i])
        yield batch.take(pa.array(np.array(keep, np.int64)))


def _answers(k: int, directions: int, seed: int):
    """Reads (group, asks, vec_id, vector), sorted by group with its vectors before its queries; yields each query's nearest in the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, indexes = None, {}, None
        for batch in batches:
            groups, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            sizes = pc.list_value_length(batch.column(3)).to_numpy()
            x = batch.column(3).flatten().cast(pa.float64()).to_numpy()
            starts = np.cumsum(sizes) - sizes
            found: list[tuple[int, np.ndarray, np.ndarray]] = []
            cut = np.flatnonzero((np.diff(groups) != 0) | (np.diff(asks.astype(np.int8)) != 0) | (np.diff(sizes) != 0)) + 1
            for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(groups)).tolist(), strict=True):
                if groups[a] != group:
                    group, held, indexes = groups[a], {}, None
                size = int(sizes[a])
                rows = x[starts[a] : starts[a] + (b - a) * size].reshape(b - a, size)
                if not asks[a]:
                    held.setdefault(size, []).append((ids[a:b], rows))
                    continue
                if indexes is None:  # all vectors of the group have come
                    indexes = {d: Index(np.concatenate([i for i, _ in parts]), np.concatenate([r for _, r in parts]), directions, seed) for d, parts in held.items()}
                    held = {}
                if size in indexes:
                    found += [(int(i), *indexes[size].search(int(i), q, k)) for i, q in zip(ids[a:b], rows, strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([i for i, _, _ in found], [len(n) for _, n, _ in found]).astype(np.int64)), pa.array(np.concatenate([n for _, n, _ in found]).astype(np.int64)), pa.array(np.concatenate([s for _, _, s in found]).astype(np.float64))],
                    ["query_id", "vec_id", "score"],
                )

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, vec_id: str = "vec_id", vector: str = "embedding", directions: int = DIRECTIONS, seed: int = SEED, shard: int = SHARD) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (cosine) of the ``k`` vectors nearest to each query."""
    kind = dict(vectors.dtypes)[vector]
    sound = lambda df: df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).mapInArrow(_sound, f"vec_id long, vector {kind}")
    held, asked = sound(vectors), sound(queries)
    components = held.agg(F.sum(F.size("vector").cast("long"))).first()[0] or 0
    shards = max(1, -(-components // shard))
    pieces = max(1, -(-vectors.sparkSession.sparkContext.defaultParallelism // shards))
    of = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    group = lambda s, p: (s * pieces + p).alias("group")
    dealt = held.select(of(shards).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("p"), "vec_id", "vector").select(group(F.col("s"), F.col("p")), F.lit(False).alias("asks"), "vec_id", "vector")
    visits = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), of(pieces).alias("p"), "vec_id", "vector").select(group(F.col("s"), F.col("p")), F.lit(True).alias("asks"), "vec_id", "vector")
    met = dealt.unionByName(visits).repartition(shards * pieces, "group").sortWithinPartitions("group", "asks", F.size("vector"))
    found = met.mapInArrow(_answers(k, directions, seed), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all embeddings to each one whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
