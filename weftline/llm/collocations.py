"""Phrases that stand together more often than their parts would by chance.

Texts are cut into pieces and words, and a block of texts (about ``BLOCK``
bytes) becomes a table row for each of its groups (languages): a vertical
positional inverted list, that is its distinct words, and for each of them the
ascending places where it stands. Places leave a gap between pieces, so two
words are neighbours only if their places are.

Phrases grow from that. The list of a phrase of k words holds the places where
it starts. It is extended by merging the list with those of the phrases one
place on: where both the first k words and the last k words are frequent, the
merge gives the list of the phrase of k + 1 words, and the lengths of a phrase's
lists over all blocks add up to its exact frequency. What isn't frequent is
dropped before the next extension, as no longer phrase around it can be.

Which phrases are frequent is agreed by counts of keys (32 to 63 bits, by the
number of words), one row for each distinct phrase of a block, and sent to the tasks as a table of bits. Its size
follows the number of frequent phrases up to ``MOST_BITS`` (32 MB for each
length, whatever the corpus). Phrases that share a key or a bit only let more
pass: the counts that are returned come from a last pass that adds up the list
lengths by the phrases' own words.

Scores are whole numbers: products are taken as decimals of 38 digits, and
raise an error beyond. The lists are written once to the shared folder, and every pass reads that.

Cases: null texts are empty; a null group is called ``und`` and is the same as
a group of that name; repeated rows count as often as they stand; very long
texts are read whole, in a block of their own; texts without words give nothing.
An empty table gives an empty result. Ties are ordered by frequency, then by the
bytes of the phrase. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _LOWER, _word_hashes, blocks, has_bit, hash_bytes, mix, packed, packed_bits, saved, table, texts, unpacked

LONGEST, FREQUENT, TOP = 5, 100, 2000
#: Bytes of text in a block.
BLOCK = 1 << 24
#: Bits of a table of frequent phrases: 64 for each, between these bounds.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Phrases that a task holds before it sends them on.
HELD = 1 << 20
#: Ranges that a group's best phrases are first sought in.
RANGES = 64

_BLANK, _END = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[9, 32]] = True
_END[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = _BLANK | _END
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


# --- lists -----------------------------------------------------------------------


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and places of the words of the texts in ``data`` cut at ``at``; A-Z are in lower case already."""
    inside, begins = ~_GAP[data], np.zeros(len(data) + 1, bool)
    begins[at] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | begins[1:-1]
    closes[:-1] &= ~inside[1:] | begins[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    breaks = np.cumsum(_END[data] | begins[:-1], dtype=np.int32)[starts]
    # a gap of one for any number of breaks between two words
    return starts, ends, np.arange(len(starts)) + np.append(0, np.cumsum(np.diff(breaks) > 0))[: len(starts)]


class _Lists:
    """Words and their places, gathered text by text."""

    def __init__(self) -> None:
        self.hashes, self.checks, self.names, self.codes, self.places, self.distinct, self.end = [], [], [], [], [], 0, 0

    def add(self, data: np.ndarray, at: np.ndarray) -> None:
        data = _LOWER[data]
        starts, ends, places = _words(data, at)
        if not len(starts):
            return
        hashes, first, code = np.unique(_word_hashes(data, starts, ends, 0), return_index=True, return_inverse=True)
        check = _word_hashes(data, starts, ends, 1)
        if (check != check[first][code]).any():
            raise ValueError("two words have the same 64-bit hash")
        self.hashes.append(hashes)
        self.checks.append(check[first])
        self.names += [data[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        self.codes.append(code + self.distinct)
        self.places.append(places + self.end)
        self.distinct, self.end = self.distinct + len(hashes), self.end + int(places[-1]) + 2

    def row(self) -> tuple[int, list[bytes], bytes, bytes, bytes] | None:
        """The number of words, the distinct ones, then packed: their hashes, the lengths of their lists, and the lists' steps."""
        if not self.codes:
            return None
        hashes, first, code = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True)
        checks = np.concatenate(self.checks)
        if (checks != checks[first][code]).any():
            raise ValueError("two words have the same 64-bit hash")
        code, places = code[np.concatenate(self.codes)], np.concatenate(self.places)
        order = np.argsort(code, kind="stable")
        sizes, places = np.bincount(code, minlength=len(hashes)), places[order]
        steps = np.diff(places, prepend=0)
        heads = np.cumsum(sizes) - sizes
        steps[heads] = places[heads]
        return len(code), [self.names[i] for i in first.tolist()], packed(hashes), packed(sizes), packed(steps)


def _block_lists(column: str, group: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in blocks(batches, least):
            rows = pa.Table.from_batches(held)
            of = rows.column(group).cast(pa.large_string()).fill_null("und").combine_chunks()
            for name in of.unique().to_pylist():
                lists = _Lists()
                for batch in rows.filter(pa.compute.equal(of, name)).to_batches():
                    for _, data, at in texts(batch, column):
                        lists.add(data, at)
                row = lists.row()
                if row:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([row[0]]), pa.array([row[1]], pa.list_(pa.binary())), *(pa.array([x], pa.binary()) for x in row[2:])], ["lang", "total", "words", "hashes", "sizes", "steps"])

    return run


def posting_lists(df: DataFrame, column: str = "text", group: str = "lang", least: int = BLOCK) -> DataFrame:
    """One row for each block of texts and each of its groups: ``lang``, ``words``, and the packed hashes, lengths and steps of their lists."""
    return df.select(F.col(column).cast("string").alias("text"), F.col(group).cast("string").alias("lang")).mapInArrow(_block_lists("text", "lang", least), "lang string, total long, words array<binary>, hashes binary, sizes binary, steps binary")


# --- extension -------------------------------------------------------------------


def _salted(hashes: np.ndarray, lang: str) -> np.ndarray:
    """Keys of a group's words."""
    return mix(hashes ^ np.uint64(hash_bytes(lang.encode())))


def _frequent(keys: np.ndarray, bits: bytes) -> np.ndarray:
    known = np.frombuffer(bits, np.uint8)
    return has_bit(known, keys & np.uint64(8 * len(known) - 1))


def _placed(sizes: np.ndarray, steps: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places of the kept lists, and the list that each is from."""
    ends = np.cumsum(sizes)
    total = np.cumsum(steps)
    before = np.where(ends > sizes, total[ends - sizes - 1], 0)
    of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    places = total - before[of]
    at = np.full(int(places.max(initial=-1)) + 1, -1, np.int32)
    mine = keep[of]
    at[places[mine]] = of[mine]
    places = np.flatnonzero(at >= 0)
    return places, at[places]


def levels(lang: str, hashes: np.ndarray, sizes: np.ndarray, steps: np.ndarray, tables: list[bytes], longest: int):
    """The phrases of 1, 2, ... words that grow from the lists of a row.

    For each length: keys and frequencies of the phrases in this row, where
    their occurrences start, and which phrase each is. Phrases whose key isn't in
    the table of their length don't grow; the walk ends a length beyond the tables.
    """
    keys = _salted(hashes, lang)
    if not tables:
        yield keys, sizes, None, None
        return
    places, of = _placed(sizes, steps, _frequent(keys, tables[0]))
    yield keys, sizes, places, of
    for k in range(2, longest + 1):
        if k > 2:
            good = _frequent(keys, tables[k - 2])[of]
            places, of = places[good], of[good]
        # the list of a phrase merged with those of the phrases one place on
        next_to = np.flatnonzero(np.diff(places) == 1)
        pairs, first, of = np.unique(of[next_to].astype(np.int64) * len(keys) + of[next_to + 1], return_index=True, return_inverse=True)
        places = places[next_to]
        keys = mix(keys[pairs // max(1, len(keys))] * _PAIR + keys[pairs % max(1, len(keys))])
        yield keys, np.bincount(of, minlength=len(keys)), places, of
        if k > len(tables):
            return


def _row(batch: pa.RecordBatch, i: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    one = lambda name: batch.column(name)[i].as_py()
    return one("lang"), unpacked(one("hashes"), 1)[0], unpacked(one("sizes"), 1)[0].astype(np.int64), unpacked(one("steps"), 1)[0].astype(np.int64)


def _counts(tables: list[bytes], longest: int, width: int):
    """(key of ``width`` bits, occurrences) of a row's phrases that are one word longer than the tables know."""

    mask = np.uint64((1 << width) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                *_, (keys, sizes, _, _) = levels(*_row(batch, i), tables, longest)
                keys &= mask
                for a in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 16)].view(np.int64)), pa.array(sizes[a : a + (1 << 16)].astype(np.int64))], ["key", "n"])

    return run


def _phrases(tables: list[bytes], longest: int):
    """(lang, words in it, phrase, occurrences) of the phrases that the tables know, and with 0 words the number of all words.

    A task adds up the phrases of its rows, and sends them on whenever it holds ``HELD`` of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], Counter[bytes]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, k), counts in held.items():
                names, n = list(counts), list(counts.values())
                for a in range(0, len(names), 1 << 14):
                    part = [x.decode("utf-8", "replace") for x in names[a : a + (1 << 14)]]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([k] * len(part), pa.int32()), pa.array(part), pa.array(n[a : a + (1 << 14)], pa.int64())], ["lang", "k", "phrase", "n"])
            held.clear()

        for batch in batches:
            for i in range(len(batch)):
                lang, hashes, sizes, steps = _row(batch, i)
                names = batch.column("words")[i].as_py()
                held.setdefault((lang, 0), Counter())[b""] += int(sizes.sum())
                at = word = None
                for k, (keys, counts, places, of) in enumerate(levels(lang, hashes, sizes, steps, tables, longest), 1):
                    if k > len(tables):
                        break
                    known = np.flatnonzero(_frequent(keys, tables[k - 1]))
                    if k == 1:
                        at, word, phrases = places, of, [names[j] for j in known.tolist()]
                    else:  # the words of a phrase stand at its first place and after it
                        start = np.zeros(len(keys), np.int64)
                        start[of] = places
                        start = np.searchsorted(at, start[known])
                        phrases = [b" ".join([names[w] for w in word[a : a + k].tolist()]) for a in start.tolist()]
                    into = held.setdefault((lang, k), Counter())
                    for phrase, n in zip(phrases, counts[known].tolist(), strict=True):
                        into[phrase] += n
                if sum(map(len, held.values())) >= HELD:
                    yield from sent()
        yield from sent()

    return run


def _bits(keys: DataFrame) -> bytes:
    """A table of bits with the keys' places set."""
    count = keys.count()
    bits = LEAST_BITS
    while bits < min(64 * count, MOST_BITS):
        bits *= 2
    return packed_bits(keys.select(F.col("key").bitwiseAND(F.lit(bits - 1)).alias("at")), "at", bits)


def frequencies(df: DataFrame, column: str = "text", group: str = "lang", longest: int = LONGEST, frequent: int = FREQUENT, least: int = BLOCK) -> DataFrame:
    """``lang``, ``k``, ``phrase``, ``n``: every phrase of 1 to ``longest`` words that stands ``frequent`` times or more; with k = 0 the number of all words of the group."""
    lists = saved(posting_lists(df, column, group, least))
    # 16 keys or more for each word of the corpus: few phrases share one, and its upper bytes are zeros, which compress
    total = lists.agg(F.sum("total")).first()[0] or 1
    width = min(63, max(32, total.bit_length() + 4))
    tables: list[bytes] = []
    for _ in range(longest):
        counts = lists.select("lang", "hashes", "sizes", "steps").mapInArrow(_counts(tables, longest, width), "key long, n long")
        keys = saved(counts.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= frequent).select("key"))
        tables.append(_bits(keys))
    tasks = df.sparkSession.sparkContext.defaultParallelism  # few, so that each adds up the phrases of many blocks
    rows = lists.coalesce(tasks).mapInArrow(_phrases(tables, longest), "lang string, k int, phrase string, n long")
    return saved(rows.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).filter((F.col("k") == 0) | (F.col("n") >= frequent)))


# --- scores ----------------------------------------------------------------------


def _cut(phrase: str, first: int, last: int | None = None) -> Column:
    """Words ``first`` to ``last`` of a phrase, counted from one."""
    words = F.split(phrase, " ")
    return F.array_join(F.slice(words, first, F.size(words) if last is None else last - first + 1), " ")


def score(a: str, n: str, l: str, r: str) -> Column:
    """floor(1000 a n / (l r)) in decimals of 38 digits."""
    wide = lambda name: F.col(name).cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(n) * F.lit(1000).cast("decimal(4,0)"), wide(l) * wide(r))


def collocations(df: DataFrame, column: str = "text", group: str = "lang", longest: int = LONGEST, frequent: int = FREQUENT, top: int = TOP, covered: int = 100, least: int = BLOCK) -> DataFrame:
    """The ``top`` phrases of each group: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of the cut with the lowest
    score floor(1000 a n / (l r)), ``n`` the group's words. Phrases inside a
    longer one that stands in at least ``covered`` hundredths of their places
    are left out.
    """
    all_ = frequencies(df, column, group, longest, frequent, least)
    words = all_.filter("k = 0").select(F.col("lang").alias("_lang"), F.col("n").alias("_n"))
    known = all_.filter("k > 0")
    part = lambda name: known.filter(F.col("k") < longest).select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_phrase"), F.col("n").alias(name))
    candidates = known.filter("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"))
    cut = candidates.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumn("head", _cut("phrase", 1, F.col("at"))).withColumn("tail", _cut("phrase", F.col("at") + 1))
    cut = cut.join(part("l"), (F.col("lang") == F.col("l_lang")) & (F.col("head") == F.col("l_phrase"))).join(part("r"), (F.col("lang") == F.col("r_lang")) & (F.col("tail") == F.col("r_phrase")))
    cut = cut.join(words, F.col("lang") == F.col("_lang"))
    cut = cut.withColumn("score", score("a", "_n", "l", "r"))
    lowest = F.min(F.struct("score", "at", "l", "r", F.col("_n").alias("n")))
    scored = cut.groupBy("lang", "phrase", "k", "a").agg(lowest.alias("cut")).select("lang", "phrase", "k", "a", "cut.l", "cut.r", "cut.n", "cut.score")
    # what lies inside a phrase of any length lies inside one that is a word longer, and is no rarer than that
    longer = candidates.filter("k > 2").select(F.col("lang").alias("in_lang"), F.explode(F.array(_cut("phrase", 1, F.col("k") - 1), _cut("phrase", F.lit(2)))).alias("inner"), F.col("a").alias("longer"))
    longer = longer.groupBy("in_lang", "inner").agg(F.max("longer").alias("longer"))
    kept = scored.join(longer, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inner")) & (100 * F.col("longer") >= covered * F.col("a")), "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each range first, so that no task sorts a whole group
    near = kept.withColumn("_range", F.pmod(F.xxhash64("phrase"), F.lit(RANGES))).withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_range").orderBy(*order))).filter(F.col("_place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i : i + k - 1], ' '))) AS phrase FROM w, range(1, 6) t(k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
totals AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
q AS MATERIALIZED (SELECT lang, k, phrase, n FROM f WHERE n >= 100),
c AS MATERIALIZED (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS words FROM q WHERE k > 1),
h AS MATERIALIZED (SELECT c.*, j, array_to_string(words[1 : j], ' ') AS head, array_to_string(words[j + 1 : k], ' ') AS tail FROM c, range(1, 5) t(j) WHERE j < k),
cuts AS (SELECT h.lang, h.k, h.phrase, h.a, j, l.n AS l, r.n AS r, totals.n AS n, (1000 * h.a::HUGEINT * totals.n::HUGEINT) // (l.n::HUGEINT * r.n::HUGEINT) AS score
    FROM h JOIN q l ON l.lang = h.lang AND l.phrase = h.head JOIN q r ON r.lang = h.lang AND r.phrase = h.tail JOIN totals ON totals.lang = h.lang),
s AS (SELECT lang, phrase, k, a, l, r, n, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT c.lang, array_to_string(c.words[i : i + m - 1], ' ') AS phrase, max(c.a) AS longer FROM c, range(2, 5) t(m), range(1, 5) u(i) WHERE m < c.k AND i + m - 1 <= c.k GROUP BY ALL),
kept AS (SELECT s.* FROM s LEFT JOIN inner_ USING (lang, phrase) WHERE coalesce(100 * longer < 100 * a, true))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
