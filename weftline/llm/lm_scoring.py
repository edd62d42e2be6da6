"""Language-model scores by deleted interpolation.

Tokens are a text's words (A-Z lower-cased) and one end. The model mixes the
maximum-likelihood word trigram and word bigram estimates, a class n-gram and
the uniform estimate. The weights depend on how often the trigram's context of
two words was seen (buckets by powers of two). They are learned by expectation
maximisation on the counts of a deleted block, a seventh of the training
documents, against estimates from the others; the final estimates use all
training documents. Words never seen share one place, so the word n-grams'
probabilities of a context sum to one over known words and that place; the class
part has such a place in each class, whose shares add up to its own.

Word, bigram and trigram counts cover all training documents. A block of texts
sends its distinct n-grams, sorted, delta coded and compressed, to the ranges
that count them; each range answers a block with the totals of its n-grams in
the same order, and the block's texts meet the answers to be scored. The table
is read more than once and in one order; answers that don't belong to a
block's texts are an error.

The class n-gram serves contexts that are rare or unseen: the commonest words
are classes of their own, all others share classes by their last two bytes, and

    P(w | h) = P(class | h) * (c(w) + 1) / (c(class) + V(class) + 1)

where P(class | h) mixes class estimates of three orders and the uniform one,
by the count of a context of two coarse classes. Its tables have a fixed size.

Words are counted by 60-bit hashes and n-grams by 51-bit ones, so a clash can
add another n-gram's count to a score, and hardly ever a word's to the base.
Cases: a null text is an empty one and has just the end; a very long text is a
block of its own, held in memory with its n-grams; further columns are ignored;
 without training documents every word is
unseen; equal rows get equal scores; a null doc_id counts as the empty text for
the division into training and held-out rows; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ZSTD, blocks, id_remainder, mix, packed, saved, table, texts, unpacked, words

#: Classes: the end, words of their own, then classes by ending; and classes of a trigram's context.
CLASSES, OWN, CONTEXT = 1024, 512, 32
#: Slots of the table of common words; a word that loses its slot to a commoner one has the class of its ending.
SLOTS = 1 << 18
END = np.uint64(0x9C0FFEE5EED51DE5)
#: Levels of a logged probability in the counts that expectation maximisation reads, a quarter of an octave each (half a one for words).
LEVELS, STEP, WORD_STEP, BUCKETS = 64, 4, 2, 64
#: Bits of an n-gram's key, and bytes of text that a block holds at least.
KEY_BITS, BLOCK = 63, 1 << 23
#: Class counts that travel in one piece.
CELLS = 1 << 15


def _endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    last = data[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return (last * 40503 + before * 30011) % 7919 % (CLASSES - OWN)


def _tokens(batch: pa.RecordBatch):
    """``(first row, hashes, endings, places of the ends)`` of slices of a batch; the end has ending -1."""
    for first, data, at in texts(batch):
        starts, ends, hashes, bounds = words(data, at, lower=True)
        kinds = _endings(data, starts, ends)
        stops = bounds[1:] + np.arange(len(at) - 1)
        yield first, np.insert(hashes, bounds[1:], END), np.insert(kinds, bounds[1:], -1), stops


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (hash), ``ending`` and ``n`` over the texts of ``docs``."""

    def run(batches):
        held, size = [], 0

        def flush():
            keys, kinds = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, at, n = np.unique(keys, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(kinds[at].astype(np.int32)), pa.array(n)], names=["word", "ending", "n"])

        for batch in batches:
            for _, hashes, kinds, _ in _tokens(batch):
                held.append((hashes, kinds))
                size += len(hashes)
                if size >= 1 << 22:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select("text").mapInArrow(run, "word long, ending int, n long").groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"))


class Vocabulary:
    """Common words by slot, classes and their numbers of words: fixed size, built from exact counts."""

    def __init__(self, common: pa.Table, endings: list, total: int, distinct: int):
        self.total, self.distinct = total, distinct
        n, word, kind = (common.column(c).to_numpy() for c in ("n", "word", "ending"))
        order = np.lexsort((word, -n))
        word, n, kind = word[order].view(np.uint64), n[order], kind[order]
        slot = (word >> np.uint64(46)).astype(np.int64)
        first = np.sort(np.unique(slot, return_index=True)[1])
        word, n, kind, slot = word[first], n[first], kind[first], slot[first]
        self.word, self.own = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int16)
        self.word[slot] = word
        real = np.flatnonzero(kind >= 0)[: OWN - 1]
        self.own[slot[real]] = np.arange(1, len(real) + 1)
        self.types = np.zeros(CLASSES, np.int64)
        for e, _, types in endings:
            self.types[0 if e < 0 else OWN + e] = types
        np.subtract.at(self.types, OWN + kind[real], 1)
        self.types[1 : len(real) + 1] = 1

    def look(self, hashes: np.ndarray, kinds: np.ndarray):
        """Classes and context classes of tokens."""
        slot = (hashes >> np.uint64(46)).astype(np.int64)
        here = self.word[slot] == hashes
        own = np.where(here, self.own[slot], 0)
        classes = np.where(own > 0, own, OWN + kinds)
        classes[kinds < 0] = 0
        half = CONTEXT // 2
        return classes.astype(np.int64), np.where(classes < half, classes, half + kinds % half).astype(np.int64)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The bounded tables of ``counts``; at most SLOTS / 2 words are common."""
    bins = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.expr("shiftleft(1L, cast(floor(log2(n)) as int))"))
    rows = counts.groupBy(bins.alias("least")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("least")).collect()  # some 4,150 rows
    least, held = 1 << 62, 0
    for r in rows:
        if held + r.words > SLOTS // 2:
            break
        least, held = r.least, held + r.words
    common = counts.filter(F.col("n") >= least).toArrow()
    endings = [tuple(r) for r in counts.groupBy("ending").agg(F.sum("n"), F.count(F.lit(1))).collect()]
    return Vocabulary(common, endings, sum(e[1] for e in endings), sum(e[2] for e in endings))


def _contexts(classes: np.ndarray, coarse: np.ndarray, stops: np.ndarray):
    """The last class and the last two context classes before each token; a text begins after an end."""
    one = np.append(0, classes[:-1])
    near = np.append(0, coarse[:-1])
    far = np.append([0, 0], coarse[:-2])[: len(coarse)]
    far[np.append(0, stops[:-1] + 1)] = 0
    return one, far * CONTEXT + near


def class_counts(docs: DataFrame, held) -> DataFrame:
    """``cell`` and ``n``: of class pairs, then of context and class (shifted by CLASSES squared)."""
    pairs, cells = CLASSES * CLASSES, CLASSES * CLASSES + CONTEXT * CONTEXT * CLASSES

    def run(batches):
        sums, seen = np.zeros(cells, dtype=np.int64), False
        for batch in batches:
            for _, hashes, kinds, stops in _tokens(batch):
                classes, coarse = held.value.look(hashes, kinds)
                one, two = _contexts(classes, coarse, stops)
                np.add.at(sums, one * CLASSES + classes, 1)
                np.add.at(sums, pairs + two * CLASSES + classes, 1)
                seen = True
        if seen:
            parts = [packed(sums[i : i + CELLS]) for i in range(0, cells, CELLS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary())], names=["part", "blob"])

    def add(group: pa.Table) -> pa.Table:
        sums = sum(unpacked(x.as_py(), 1)[0] for x in group.column("blob")).astype(np.int64)
        full = np.flatnonzero(sums)
        return pa.table([pa.array((full + group.column("part")[0].as_py() * CELLS).astype(np.int32)), pa.array(sums[full])], names=["cell", "n"])

    return docs.select("text").mapInArrow(run, "part int, blob binary").groupBy("part").applyInArrow(add, "cell int, n long")


def _dense(counts: DataFrame) -> np.ndarray:
    out = np.zeros(CLASSES * CLASSES + CONTEXT * CONTEXT * CLASSES, dtype=np.int64)
    rows = counts.toArrow()  # at most 2 million cells
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out


class Estimates:
    """Maximum-likelihood class estimates of three orders and the bucket of a context."""

    def __init__(self, sums: np.ndarray):
        self.pair = sums[: CLASSES * CLASSES].reshape(CLASSES, CLASSES)
        self.triple = sums[CLASSES * CLASSES :].reshape(CONTEXT * CONTEXT, CLASSES)
        self.after_one, self.after_two = self.pair.sum(1), self.triple.sum(1)
        self.size, total = self.pair.sum(0), int(self.pair.sum())
        self.single = self.size / total if total else np.full(CLASSES, 1 / CLASSES)
        self.bucket = np.minimum(BUCKETS - 1, np.ceil(np.log2(self.after_two + 1))).astype(np.int64)

    def of(self, one: np.ndarray, two: np.ndarray, classes: np.ndarray):
        p1 = self.single[classes]
        n1, n2 = self.after_one[one], self.after_two[two]
        p2 = np.where(n1 > 0, self.pair[one, classes] / np.maximum(n1, 1), p1)
        p3 = np.where(n2 > 0, self.triple[two, classes] / np.maximum(n2, 1), p2)
        return self.bucket[two], p3, p2, p1


def _level(p: np.ndarray, step: int = STEP) -> np.ndarray:
    return np.where(p > 0, np.minimum(LEVELS - 2, np.round(-step * np.log2(np.maximum(p, 1e-12)))), LEVELS - 1).astype(np.int64)


def held_out_counts(docs: DataFrame, held, estimates) -> DataFrame:
    """Tokens of ``docs`` by context bucket and the levels of their three estimates."""

    def run(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            for _, hashes, kinds, stops in _tokens(batch):
                classes, coarse = held.value.look(hashes, kinds)
                bucket, p3, p2, p1 = estimates.value.of(*_contexts(classes, coarse, stops), classes)
                keys, n = np.unique(((bucket * LEVELS + _level(p3)) * LEVELS + _level(p2)) * LEVELS + _level(p1), return_counts=True)
                for k, c in zip(keys.tolist(), n.tolist(), strict=True):  # at most BUCKETS * LEVELS ** 3 keys
                    seen[k] = seen.get(k, 0) + c
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def mixture(counts: pa.Table, rounds: int = 40, uniform: float = 1 / CLASSES, step: int = STEP) -> np.ndarray:
    """Weights of the three estimates and the uniform one, for each bucket, by expectation maximisation."""
    key, n = counts.column("key").to_numpy(), counts.column("n").to_numpy().astype(float)
    levels = np.stack([key // LEVELS**2 % LEVELS, key // LEVELS % LEVELS, key % LEVELS], axis=1)
    p = np.where(levels < LEVELS - 1, 2.0 ** (-levels / step), 0.0)
    p = np.concatenate([p, np.full((len(p), 1), uniform)], axis=1)
    bucket, out = key // LEVELS**3, np.full((BUCKETS, 4), 0.25)
    for b in range(BUCKETS):
        mine = bucket == b
        # A bucket with few held-out tokens leans on the weights of the bucket before it.
        prior = out[b - 1] if b else np.full(4, 0.25)
        weights = prior.copy()
        for _ in range(rounds):
            share = p[mine] * weights
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
            weights = (n[mine] @ share if mine.any() else np.zeros(4)) + 20 * prior
            weights /= weights.sum()
        out[b] = weights
    return out


def _grams(hashes: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Keys of the words, then of the word pairs, then of the word triples that end at each token; a text begins after two ends.

    Words have the first eighth of the keys and 60 bits of their hashes, so neither another word nor an n-gram is
    taken for a word; pairs and triples have the rest and 51 bits, with zeros below that compress away.
    """
    near = np.append(END, hashes[:-1])
    far = np.append([END, END], hashes[:-2])[: len(hashes)]
    far[np.append(0, stops[:-1] + 1)] = END
    one = hashes * np.uint64(0x9E3779B97F4A7C15)
    two = one + near * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two + far * np.uint64(0x165667B19E3779F9)
    more = mix(np.concatenate([two + np.uint64(2), three + np.uint64(3)]))
    more = ((more & np.uint64(0xFFFF)) * np.uint64(7) >> np.uint64(16)) + np.uint64(1) << np.uint64(60) | more >> np.uint64(16) << np.uint64(12)
    return np.concatenate([mix(one + np.uint64(1)) >> np.uint64(4), more])


def gram_counts(rows: DataFrame) -> DataFrame:
    """``block``, ``deleted``, ``part`` and ``blob``: for each block of texts, part by part, the training counts of its sorted n-grams.

    A deleted block's answers hold the counts in all deleted blocks too.
    """
    parts = max(64, 4 * rows.rdd.getNumPartitions())
    bounds = (np.arange(1, parts, dtype=np.float64) * (2.0**KEY_BITS / parts)).astype(np.uint64)
    form = "block long, deleted boolean, part int, blob binary"
    names = ["block", "deleted", "part", "blob"]

    def emit(deleted):
        def run(batches):
            for number, held in blocks(batches, BLOCK):
                keys = []
                for piece in held:
                    train = ~piece.column(1).to_numpy(zero_copy_only=False)
                    for first, hashes, _, stops in _tokens(piece):
                        counted = np.repeat(train[first : first + len(stops)], np.diff(stops, prepend=-1))
                        keys.append(_grams(hashes, stops) << np.uint64(1) | np.tile(counted, 3).astype(np.uint64))
                keys = np.sort(np.concatenate(keys))
                counted, keys = keys & np.uint64(1), keys >> np.uint64(1)
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                n, keys = np.add.reduceat(counted, first), keys[first]
                cut = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                full = [i for i in range(parts) if cut[i] < cut[i + 1]]
                blobs = [packed(np.diff(keys[cut[i] : cut[i + 1]], prepend=np.uint64(0)), n[cut[i] : cut[i + 1]]) for i in full]
                m = len(full)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), pa.array(np.full(m, deleted)), pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=names)

        return run

    def count(group: pa.Table) -> pa.Table:
        blobs = [unpacked(x.as_py(), 2) for x in group.column("blob")]
        deleted = group.column("deleted").to_pylist()
        at = np.cumsum([0] + [len(n) for _, n in blobs])
        keys, n = np.concatenate([np.cumsum(steps, dtype=np.uint64) for steps, _ in blobs]), np.concatenate([n for _, n in blobs])
        order = np.argsort(keys)
        keys = keys[order]
        new = np.append(True, keys[1:] != keys[:-1])
        first, which = np.flatnonzero(new), np.cumsum(new) - 1
        total, part = np.empty_like(n), np.empty_like(n)
        total[order] = np.add.reduceat(n[order], first)[which]
        mine = np.where(np.repeat(deleted, np.diff(at)), n, np.uint64(0))
        part[order] = np.add.reduceat(mine[order], first)[which]
        answers = [packed(total[s:e], part[s:e]) if d else packed(total[s:e]) for s, e, d in zip(at[:-1], at[1:], deleted, strict=True)]
        return group.select(names[:-1]).append_column("blob", pa.array(answers, pa.binary()))

    sent = rows.filter("deleted").drop("deleted").mapInArrow(emit(True), form).unionByName(rows.filter("NOT deleted").drop("deleted").mapInArrow(emit(False), form))
    return sent.groupBy("part").applyInArrow(count, form)


def _met(rows: DataFrame, answers: DataFrame, columns: int, act, form: str) -> DataFrame:
    """``act(slice, counts)`` for slices of ``rows``; counts are a function from tokens to ``columns`` arrays of three rows (word, pair, triple)."""

    def pack(batches):
        for number, held in blocks(batches, BLOCK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", ZSTD))) as out:
                for piece in held:
                    out.write_batch(piece)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([-1], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "part", "blob"])

    def run(group: pa.Table) -> pa.Table:
        parts, blobs = group.column("part").to_pylist(), group.column("blob")
        packs, told = [i for i, p in enumerate(parts) if p < 0], {p: i for i, p in enumerate(parts) if p >= 0}  # equal blocks have equal answers
        if not packs or not told:
            raise RuntimeError("the documents were not read in the same order again")
        found = [np.concatenate(x) for x in zip(*(unpacked(blobs[told[p]].as_py(), columns) for p in sorted(told)), strict=True)]
        return pa.Table.from_batches([x for i in packs for x in one(list(pa.ipc.open_stream(blobs[i].as_py())), found)])

    def one(pieces, found):
        tokens = [t for piece in pieces for t in _tokens(piece)]
        keys = np.concatenate([_grams(hashes, stops) for _, hashes, _, stops in tokens])
        order = np.argsort(keys)
        keys = keys[order]
        new = np.append(True, keys[1:] != keys[:-1])
        which = np.empty(len(keys), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        if int(new.sum()) != len(found[0]):
            raise RuntimeError("the answers are not those of the block")
        out, at, each = [], 0, iter(tokens)
        for piece in pieces:
            done = 0
            while done < len(piece):
                first, hashes, kinds, stops = next(each)
                mine = which[at : at + 3 * len(hashes)].reshape(3, -1)
                at, done = at + mine.size, first + len(stops)
                out.append(act(piece.slice(first, len(stops)), (hashes, kinds, stops), [x[mine].astype(np.int64) for x in found]))
        return out

    packs = rows.mapInArrow(pack, "block long, part int, blob binary")
    return packs.unionByName(answers.select("block", "part", "blob")).groupBy("block").applyInArrow(run, form)


def word_terms(counts: np.ndarray, stops: np.ndarray, low: np.ndarray):
    """Bucket of each token's context of two words, and its trigram and bigram estimates, from the counts of words, pairs and triples.

    ``low`` is the estimate below them. Every word but an end is followed by a token, so its count, or its pair's, is
    that of the context; texts begin after ends, which are as many as the texts.
    """
    c1, c2, c3 = counts
    n1, n2 = np.append(c1[stops[0]], c1[:-1]), np.append(c1[stops[0]], c2[:-1])
    n2[np.append(0, stops[:-1] + 1)] = c1[stops[0]]
    p2 = np.where(n1 > 0, c2 / np.maximum(n1, 1), low)
    p3 = np.where(n2 > 0, c3 / np.maximum(n2, 1), p2)
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(n2 + 1))).astype(np.int64), p3, p2


def scored(rows: DataFrame) -> DataFrame:
    """Scores of ``rows`` (doc_id, held_out, deleted, text) by a model of those not held out; ``deleted`` marks its deleted part."""
    context = rows.sparkSession.sparkContext
    train, block = rows.filter("NOT held_out"), rows.filter("deleted")
    counts = saved(word_counts(train))
    known = vocabulary(counts)
    words_ = context.broadcast(known)
    full, part = _dense(class_counts(train, words_)), _dense(class_counts(block, words_))
    others = context.broadcast(Estimates(full - part))
    weights = mixture(held_out_counts(block, words_, others).toArrow())
    whole = context.broadcast(Estimates(full))
    answers, uniform = saved(gram_counts(rows)), 1 / (known.distinct + 1)

    def low(tokens, n, estimates):
        """The class n-gram's estimates of tokens that occur ``n`` times."""
        hashes, kinds, stops = tokens
        classes, coarse = words_.value.look(hashes, kinds)
        bucket, p3, p2, p1 = estimates.of(*_contexts(classes, coarse, stops), classes)
        w = weights[bucket]
        return (w[:, 0] * p3 + w[:, 1] * p2 + w[:, 2] * p1 + w[:, 3] / CLASSES) * (n + 1) / (estimates.size + words_.value.types + 1)[classes]

    def levels(piece, tokens, found):
        left = found[0] - found[1]
        p1 = low(tokens, left[0], others.value)
        bucket, p3, p2 = word_terms(left, tokens[2], p1)
        keys, n = np.unique(((bucket * LEVELS + _level(p3, WORD_STEP)) * LEVELS + _level(p2, WORD_STEP)) * LEVELS + _level(p1, WORD_STEP), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    seen = _met(block.drop("deleted"), answers.filter("deleted"), 2, levels, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS * LEVELS ** 3 keys
    mix_ = mixture(seen, uniform=uniform, step=WORD_STEP)
    base = float(np.log10(known.total + known.distinct + 1))

    def score(piece, tokens, found):
        stops = tokens[2]
        begins = np.append(0, stops[:-1] + 1)
        n = found[0][0]
        p1 = low(tokens, n, whole.value)
        bucket, p3, p2 = word_terms(found[0], stops, p1)
        w = mix_[bucket]
        size = stops - begins + 1
        logs = np.add.reduceat(np.log10(n + 1), begins) - size * base
        total = np.add.reduceat(np.log10(w[:, 0] * p3 + w[:, 1] * p2 + w[:, 2] * p1 + w[:, 3] * uniform), begins)
        return pa.RecordBatch.from_arrays([
            piece.column(0).cast(pa.int64()), piece.column(1), pa.array(size), pa.array(np.add.reduceat((n > 0).astype(np.int64), begins)), pa.array(np.full(len(size), known_total)), pa.array(logs), pa.array(total),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    known_total = int(known.total)
    form = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    first = lambda piece, tokens, found: score(piece, tokens, found[:1])
    rest = _met(rows.filter("NOT deleted").drop("deleted"), answers.filter("NOT deleted"), 1, score, form)
    return _met(block.drop("deleted"), answers.filter("deleted"), 2, first, form).unionByName(rest)


def scores(docs: DataFrame, folds: int = 7, held: int = 2, deleted: int = 3) -> DataFrame:
    """Scores of all ``docs``: training rows are those whose id's remainder isn't ``held``, and ``deleted`` is their block."""
    fold = id_remainder(F.col("doc_id"), folds)
    return scored(docs.select("doc_id", (fold == held).alias("held_out"), (fold == deleted).alias("deleted"), "text"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those with crc32 remainder (mod 7) other than 2."""
    return scores(table(spark, sf_dir, "documents"))
