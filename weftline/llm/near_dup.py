"""N-gram Jaccard join with token-combination prefixes.

Tokens are hashed shingles of ``k`` words; two documents link when their token
sets' Jaccard similarity is at least ``percent`` / 100. Sets are joined, not
documents: equal sets share a 64-bit key (with the set's size), so copies cost
one set.

1. Token frequencies are counted over all documents, packed (sorted, delta
   coded and compressed per task). Tokens in ``frequent`` documents or more are
   the frequent class, known to every task by a bit table that grows with their
   number up to ``BITS_MOST``. A clash in that table, or in the shortened
   counting keys, only makes a rare token frequent; as it does so for every
   document, no link is lost, and a full table only means that all tokens are
   indexed in combinations.
2. In the order rare, frequent, each class by hash, a set of n tokens with
   m = n - ceil(t n) + 1 indexes its first m rare tokens alone. If it has only
   R < m rare ones, its prefix goes on into the frequent class, where tokens
   fall into cells by hash and pairs of tokens of one cell are indexed: the
   prefix is extended until the cells' token counts, less one for each cell,
   sum to m - R. If two linked sets had no indexed item in common, each cell
   would hold at most one common token, so that more than n - ceil(t n) tokens
   of the prefix that ends first were not shared, a contradiction. The number
   of cells is one for the smallest sets and doubles with the size; sets near a
   bound index under both numbers, as linked sizes differ by 1/t.
3. A rare token's list is short (fewer than ``frequent`` documents): its pairs
   are candidates if their sizes, and the places of their common rare tokens,
   allow a link. A frequent item's list may hold
   a third of all sets: all of it is compared with one pivot, the set with
   fewest rare tokens. Members linked with the pivot need no pairs among
   themselves. The others are compared among themselves, and with linked
   members if they are near enough to the pivot for that (set differences obey
   the triangle inequality), unless rare tokens, which pairs met here don't
   share, or the sets' parity tables, whose differing bits never outnumber the
   differing tokens, rule the link out.
4. Candidates are verified on whole token sets, hashed anew from the words with
   another seed, and linked sets are grouped by star contraction.

Cases: words are runs of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased; fewer than
``k`` words make one token; a null, empty or blank text has no tokens and links
with nothing; a very long text is read whole, in one task, and its memory is
in proportion to its length; equal rows share a group; rows of one doc_id may
have different texts and groups; a null doc_id takes part and never is a
group's id unless all its ids are null; further columns are ignored by
:func:`groups` and kept by :func:`one_each`, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BITS, fresh, grams, has_bit, mix, packed_bits, perhaps, saved, table, texts, without, words
from .components import labels

#: Bits of a token that are counted, and tokens that one counting block holds.
COUNTED_BITS, BLOCK = 40, 1 << 21
#: Documents that make a token frequent.
FREQUENT = 16
#: Bits of the table of frequent tokens at most (32 MB); it has eight for each token up to there.
BITS_MOST = 1 << 28


def token_sets(batch: pa.RecordBatch, k: int, seed: int = 0):
    """``(row, sorted distinct tokens)`` of every text of a batch; the array is empty without words."""
    for first, data, at in texts(batch):
        _, _, hashes, bounds = words(data, at, lower=True, seed=seed)
        runs = grams(hashes, k)
        for i in range(len(at) - 1):
            s, e = bounds[i], bounds[i + 1]
            if e - s >= k:
                yield first + i, np.unique(runs[s : e - k + 1])
            elif e > s:
                yield first + i, grams(hashes[s:e], e - s)
            else:
                yield first + i, hashes[:0]


def set_key(tokens: np.ndarray) -> int:
    """The key of a token set."""
    return int(mix(np.add.reduce(mix(tokens ^ np.uint64(0x6A09E667F3BCC909)), keepdims=True) + np.uint64(len(tokens)))[0].astype(np.int64))


def needed(n, percent: int):
    """Smallest overlap that a set of n tokens has with any set it links with."""
    return -(-percent * n // 100)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8)[:, : COUNTED_BITS // 8].T.tobytes()
    return len(keys).to_bytes(8, "little") + pa.compress(planes + np.minimum(counts, 65535).astype(np.uint16).view(np.uint8).reshape(-1, 2).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = int.from_bytes(blob[:8], "little"), COUNTED_BITS // 8
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=n * (width + 2), codec="zstd", asbytes=True), np.uint8).reshape(-1, n)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = planes[:width].T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64), np.ascontiguousarray(planes[width:].T).view(np.uint16).ravel().astype(np.int64)


def frequent_tokens(docs: DataFrame, k: int, least: int = FREQUENT) -> DataFrame:
    """``token`` (shortened to COUNTED_BITS) and ``df`` of the tokens in ``least`` documents or more."""
    parts = max(64, 4 * docs.rdd.getNumPartitions())

    def emit(batches):
        held, size = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            at = np.searchsorted(keys, (np.arange(1, parts, dtype=np.float64) * (2.0**COUNTED_BITS / parts)).astype(np.uint64))
            cut = [0, *at.tolist(), len(keys)]
            full = [i for i in range(parts) if cut[i] < cut[i + 1]]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_pack(keys[cut[i] : cut[i + 1]], counts[cut[i] : cut[i + 1]]) for i in full], pa.binary())], names=["part", "blob"])

        for batch in batches:
            for _, tokens in token_sets(batch, k):
                held.append(tokens & np.uint64((1 << COUNTED_BITS) - 1))
                size += len(tokens)
                if size >= BLOCK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(batches):
        keys, counts = map(np.concatenate, zip(*(_unpack(x.as_py()) for b in batches for x in b.column("blob")), strict=True))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=keys[0] + np.uint64(1)))
        df = np.add.reduceat(counts, first)
        full = df >= least
        yield pa.RecordBatch.from_arrays([pa.array(keys[first][full].astype(np.int64)), pa.array(df[full])], names=["token", "df"])

    blobs = docs.select("text").mapInArrow(emit, "part int, blob binary")
    return blobs.groupBy("part").applyInArrow(_whole(count), "token long, df long")


def _whole(f):
    def run(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(f(group.to_batches())))

    return run


def frequent_bits(docs: DataFrame, k: int, least: int = FREQUENT, most: int = BITS_MOST) -> bytes:
    """The bit table of the frequent class."""
    counts = saved(frequent_tokens(docs, k, least))
    n, bits = counts.count(), min(BITS, most)
    while bits < min(8 * n, most):
        bits *= 2
    return packed_bits(counts.select(F.pmod("token", F.lit(bits)).alias("at")), "at", bits)


#: Bits of a set's parity table: bit b is the parity of the number of its tokens in cell b.
PARITY = 1024


def parity(tokens: np.ndarray) -> np.ndarray:
    """The parity table of a token set, as longs. Two sets differ in at least as many tokens as their tables in bits."""
    odd = np.bincount(((tokens >> np.uint64(8)) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def apart(x: str, y: str, longs: int):
    """Number of bits in which the arrays ``x`` and ``y`` of so many longs differ."""
    return F.expr(" + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(longs)))


def signatures(tokens: np.ndarray, bits: np.ndarray, percent: int):
    """Number of rare tokens, rare items and frequent items of a token set."""
    n = len(tokens)
    m = n - needed(n, percent) + 1
    common = has_bit(bits, tokens % np.uint64(8 * len(bits)))
    rare = tokens[~common]
    if len(rare) >= m:
        return len(rare), rare[:m], tokens[:0]
    often, need, out = tokens[common], m - len(rare), [tokens[:0]]
    cells, low = 1, 2  # a set of one token links with none but its like
    while n >= low:
        high = 6 * cells
        if n < -(-high * 100 // percent):
            cell = (often >> np.uint64(20)) % np.uint64(cells)
            again = np.ones(len(often), dtype=np.int64)
            again[np.unique(cell, return_index=True)[1]] = 0
            p = int(np.searchsorted(np.cumsum(again), need)) + 1
            part, cell = often[:p], cell[:p]
            order = np.argsort(cell, kind="stable")
            part, cell = part[order], cell[order]
            step = 1
            while step < p:  # the pairs of a cell stand 1, 2, ... apart
                same = cell[step:] == cell[:-step]
                if not same.any():
                    break
                out.append(mix(part[:-step][same] * np.uint64(0xBF58476D1CE4E5B9) + mix(part[step:][same]) + np.uint64(cells)))
                step += 1
        cells, low = 2 * cells, high
    return len(rare), rare, np.unique(np.concatenate(out))


def indexed(docs: DataFrame, k: int, percent: int, bits: bytes) -> DataFrame:
    """doc_id, row, n, key, r, rare and often (items of the index) and bits (parity table) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["doc_id", "row", "n", "key", "r", "rare", "often", "bits"]

    def lists(parts: list[np.ndarray]) -> pa.Array:
        at = np.zeros(len(parts) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in parts], out=at[1:])
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts).view(np.int64)))

    def run(batches):
        table_ = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, marks = (batch.column(batch.schema.get_field_index(c)).cast(pa.int64()) for c in ("doc_id", "row"))
            rows, size, first = [], 0, 0

            def flush(last, rows):
                n, key, r, rare, often, odd = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays([ids.slice(first, last - first), marks.slice(first, last - first), pa.array(n, types[1]), pa.array(key, types[2]), pa.array(r, types[3]), lists(rare), lists(often), lists(odd)], names=names)  # noqa: B023

            for i, tokens in token_sets(batch, k):
                if len(tokens):
                    r, rare, often = signatures(tokens, table_, percent)
                    rows.append((len(tokens), set_key(tokens), r, rare, often, parity(tokens)))
                    size += len(rare) + len(often) + PARITY // 64
                else:
                    rows.append((0, None, 0, tokens, tokens, tokens))
                if size > 1 << 19:
                    yield flush(i + 1, rows)
                    rows, size, first = [], 0, i + 1
            if rows:
                yield flush(len(batch), rows)

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, n int, key long, r int, rare array<long>, often array<long>, bits array<long>")


def rare_pairs(items: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a < b) from rare tokens.

    Rows come sorted by item, and equal items stand together. Of a pair, the
    common items and the places of the last one in both sets are known. The set
    whose prefix ends first has all its other tokens of it alone, and the other
    set those before the last common one; a pair with more of them than linked
    sets of these sizes can have is none.
    """

    def run(batches):
        left = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            item, key, at = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(left))
            last = int(np.searchsorted(item, item[-1])) if len(item) else 0
            left = [x[last:] for x in (item, key, at)]  # the last run may go on in the next batch
            yield from pairs(item[:last], key[:last], at[:last])
        yield from pairs(*left)

    def pairs(item, key, at):
        once = np.ones(len(item), dtype=bool)
        once[1:] = (np.diff(item) != 0) | (np.diff(key) != 0)  # copies of a set
        item, key, at = item[once], key[once], at[once]
        found, step = [], 1
        while step < len(item):
            same = np.flatnonzero(item[step:] == item[:-step])
            if not len(same):
                break
            a, b = same, same + step
            x, y = (at[a] >> 32) & 0x3FFFFFFF, (at[b] >> 32) & 0x3FFFFFFF
            fits = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
            found.append((key[a][fits], key[b][fits], at[a][fits], at[b][fits]))
            step += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b", "x", "y"])

    # The size, the place, and a mark of prefixes that go on into the frequent class.
    packed = F.expr("shiftleft(cast(size(often) > 0 as long), 62) + shiftleft(cast(n as long), 32) + place")
    rows = items.select(F.posexplode("rare").alias("place", "item"), "key", "n", "often").select("item", "key", packed.alias("at"))
    met = rows.repartition("item").sortWithinPartitions("item", "key").mapInArrow(run, "a long, b long, x long, y long")  # keys of an item ascend, so a < b
    found = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"), F.max("x").alias("x"), F.max("y").alias("y"))
    for c in ("x", "y"):
        n = F.expr(f"shiftright({c}, 32) & 1073741823L")
        place = F.expr(f"({c} & 4294967295L) + 1")
        found = found.withColumn(f"n{c}", n).withColumn(f"last{c}", place)
        full = F.col(f"n{c}") - F.ceil(F.col(f"n{c}") * percent / 100) + 1
        found = found.withColumn(f"full{c}", F.when(F.expr(f"{c} >= 4611686018427387904L"), F.col(f"last{c}")).otherwise(F.greatest(full, f"last{c}")))
    alone = F.least(F.col("fullx") + F.col("lasty"), F.col("lastx") + F.col("fully")) - 2 * F.col("both")
    return found.filter((100 + percent) * alone <= (100 - percent) * (F.col("nx") + F.col("ny"))).select("a", "b")


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parity tables differ in no more bits than linked sets of their sizes can."""
    a = nodes.select(F.col("key").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("bits1"))
    b = nodes.select(F.col("key").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    both = pairs.join(a, "a").join(b, "b")
    return both.filter((100 + percent) * apart("bits1", "bits2", PARITY // 64) <= (100 - percent) * (F.col("n1") + F.col("n2"))).select("a", "b")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs of ``pairs`` that link, on their whole token sets, hashed from the words with another seed.

    Only documents that stand for a set of some pair are read again.
    """
    ends = saved(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    first = ends.join(nodes.select("key", "first"), "key")
    maybe, _ = perhaps(docs.select("doc_id", "text"), "doc_id", first, "first")

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, sets, size = [], [], 0
            for (_, tokens), (_, anew) in zip(token_sets(batch, k), token_sets(batch, k, 1), strict=True):
                if len(tokens) and (key := set_key(tokens)) not in seen:
                    if len(seen) < 100_000:  # spares copies within a task; the grouping below settles the rest
                        seen.add(key)
                    keys.append(key)
                    sets.append(anew.view(np.int64))
                    size += len(tokens)
                if size > 1 << 19:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "tokens"])
                    keys, sets, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "tokens"])

    sets = saved(maybe.mapInArrow(run, "key long, tokens array<long>").join(ends, "key", "left_semi").groupBy("key").agg(F.first("tokens").alias("tokens")))
    a = sets.select(F.col("key").alias("a"), F.col("tokens").alias("x"))
    b = sets.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", F.size("x").alias("p"), F.size("y").alias("q"), F.size(F.array_intersect("x", "y")).alias("o"))
    return saved(both.filter(100 * F.col("o") >= percent * (F.col("p") + F.col("q") - F.col("o"))).select("a", "b"))


def linked(items: DataFrame, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, first) and enough of their links to connect every group of linked sets."""
    real = items.filter("n > 0")
    nodes = saved(real.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    often = saved(real.filter(F.size("often") > 0).select(F.explode("often").alias("item"), "key", "n", "r", "bits").dropDuplicates(["item", "key"]))
    # Written before the join, so that adaptive execution can split a hot item of the other side.
    pivots = saved(often.groupBy("item").agg(F.min(F.struct("r", "key", "n")).alias("p"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("item", F.col("p.key").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.r").alias("pr")))
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    member = often.join(pivots, "item").filter(F.col("key") != F.col("pivot"))
    could = lambda r, q, n, m: (100 + percent) * (r + q) <= (100 - percent) * (n + m)  # noqa: E731  as sets that meet here only share no rare token
    star = member.filter(fits(F.col("n"), F.col("pn")) & could(F.col("r"), F.col("pr"), F.col("n"), F.col("pn"))).select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()
    one = saved(plausible(saved(rare_pairs(real, percent).unionByName(star).distinct()), nodes, percent))
    links = verified(one, nodes, docs, k, percent)
    # Members that don't link with their item's pivot meet each other there, and the linked ones if near enough.
    sides = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    tied = (F.col("pivot") == F.col("a")) & (F.col("key") == F.col("b"))
    far = saved(member.join(sides, tied, "left_anti").select("item", "key", "n", "r", "bits", "pivot", "pn"))
    if far.isEmpty():
        return nodes, links
    differ = lambda x, y, total: (100 + percent) * apart(x, y, PARITY // 64) <= (100 - percent) * total
    other = lambda df: df.select("item", F.col("key").alias("key2"), F.col("n").alias("n2"), F.col("r").alias("r2"), F.col("bits").alias("bits2"))
    # A set that links with both x and the pivot has x.n * 100 / percent tokens at most.
    reach = F.col("n") + F.col("pn") + 2 * F.floor(F.col("n") * 100 / percent)
    close = far.join(nodes.select(F.col("key").alias("pivot"), F.col("bits").alias("pbits")), "pivot").filter(differ("bits", "pbits", reach))
    near = member.join(sides, tied, "left_semi")
    fit = fits(F.col("n"), F.col("n2")) & could(F.col("r"), F.col("r2"), F.col("n"), F.col("n2")) & differ("bits", "bits2", F.col("n") + F.col("n2"))
    met = [x.join(saved(other(y)), "item").filter((F.col("key") != F.col("key2")) & fit).select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")) for x, y in ((far, far), (close, near))]
    two = met[0].unionByName(met[1]).distinct().join(one, ["a", "b"], "left_anti")
    return nodes, links.unionByName(verified(saved(plausible(saved(two), nodes, percent)), nodes, docs, k, percent))


def _grouped(docs: DataFrame, k: int, percent: int, frequent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, row, n and key of the rows of ``docs`` (doc_id, row, text), and the label of each key's group (key, first, label)."""
    if percent < 60:
        raise ValueError("the cells of an extended prefix suit similarities of 0.6 or more")
    items = saved(indexed(docs, k, percent, frequent_bits(docs, k, frequent)))
    nodes, links = linked(items, docs, k, percent)
    marks = labels(links)
    named = nodes.join(marks, nodes["key"] == marks["node"], "left").select("key", "first", F.coalesce("label", "key").alias("label"))
    return items.select("doc_id", "row", "n", "key"), saved(named)  # written, so that a large group's rows can be split


def groups(docs: DataFrame, k: int = 5, percent: int = 80, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id of the group) of every document."""
    items, named = _grouped(docs.select("doc_id", F.lit(0).cast("long").alias("row"), "text"), k, percent, frequent)
    tops = saved(named.groupBy("label").agg(F.min("first").alias("component_id")))
    of = saved(named.join(tops, "label").select("key", "component_id"))
    rows = items.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "key")
    full = rows.filter("n_shingles > 0").join(of, "key").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_each(docs: DataFrame, k: int = 5, percent: int = 80, frequent: int = FREQUENT) -> DataFrame:
    """The rows of ``docs`` that stay when each group keeps one row, that of the smallest doc_id (null last).

    Of rows with that doc_id the one with the smallest hash of all columns
    stays, and of wholly equal rows one. Rows without words all stay.
    """
    row = fresh(docs, "row")
    keyed = docs.withColumn(row, F.xxhash64(*docs.columns))
    items, named = _grouped(keyed.select("doc_id", F.col(row).alias("row"), "text"), k, percent, frequent)
    rows = saved(items.filter("n > 0").join(named.select("key", "label"), "key").select("label", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("rank")))
    best = saved(rows.groupBy("label").agg(F.min("rank").alias("best")))
    told = rows.join(best, "label")
    drop = told.filter("rank <> best").select(F.col("rank.row").alias(row)).distinct()
    repeated = saved(told.filter("rank = best").groupBy(F.col("rank.row").alias(row)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(row))
    stay = without(keyed, saved(drop), row)
    if repeated.isEmpty():
        return stay.drop(row)
    maybe, no = perhaps(stay, row, repeated, row)
    once = maybe.join(repeated, row, "left_anti").unionByName(maybe.join(repeated, row, "left_semi").dropDuplicates(docs.columns))
    return no.unionByName(once).drop(row)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents at 4-word shingles and Jaccard 0.85."""
    return groups(table(spark, sf_dir, "documents"), k=4, percent=85)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w),
t AS (SELECT doc_id, unnest(sh) AS g FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM t a JOIN t b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * n >= 85 * (len(a.sh) + len(b.sh) - n)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS other FROM s UNION SELECT r.node, e.y FROM r JOIN e ON r.other = e.x)
SELECT doc_id, len(sh) AS n_shingles, (SELECT min(other) FROM r WHERE node = doc_id) AS component_id FROM s
"""
