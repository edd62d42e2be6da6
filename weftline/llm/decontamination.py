"""Benchmark decontamination: exact seeds, CGK embedding, bit-sampling LSH and exact edit verification.

Texts are compared by words (A-Z lower-cased, ASCII marks dropped). A document
holds an item when some run of its words is within ``tolerance`` times the
item's words in edit distance.

An item of fewer than ``SEEDED`` words that may have d edits is cut into d + 1
parts. One of them is unedited, so every text that holds the item has that run
of words, and no such item is missed. Longer items are found by embeddings.

The CGK embedding reads a window along a random walk: at each step it writes
the word under the pointer and moves on if that word's random bit for the step
is 1, so windows at small edit distance fall into step again and their
embeddings differ in few places. A table of the index samples some places;
windows that agree there with an item meet. Windows are ``SPAN`` words long; an
item has several, so edits that crowd in one part leave others. All windows of a text walk together, and leave a table as soon
as the places sampled so far agree with no item's. ``TABLES`` tables bring the
recall at the tolerance over 0.95 (tests measure it); every meeting is then
verified by the edit distance of the whole item to the text around it.

Windows are shorter than an item on purpose. At a fifth of the words edited,
walks over whole items fall out of step too often: with as many tables of as
many samples, item-sized windows found 0.45 to 0.65 of edited items, and 48
tables of 3 samples, whose meetings cost far more, 0.90 to 0.96.

The items are the query set: they go to every task in blocks of at most
``BLOCK_WORDS`` words, however many there are; the driver holds one block at a
time, and documents are not shuffled.

Cases: null, empty or blank texts and items never match; a very long text is
read whole, in one task; equal rows of documents give equal rows, equal items
each match; a null doc_id or item_id is carried; extra columns are ignored by
:func:`hits` and kept by :func:`clean`, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import grams, plain, table, texts, words

SPAN, STRIDE, TABLES, SAMPLES = 10, 3, 12, 6
#: Items below this number of words are found by exact runs.
SEEDED = 20
#: First steps that all tables share; each table samples one of them.
EARLY = 3
TOLERANCE = 0.2
BLOCK_WORDS = 1 << 18


def plain_words(text: str | None) -> np.ndarray:
    data, at = plain(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))
    return words(data, at)[2]


def _padded(parts: list[np.ndarray], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper halves of word hashes with ``span`` zeros after each part, and where the parts start."""
    at = np.cumsum([0] + [len(x) + span for x in parts], dtype=np.int64)
    out = np.zeros(int(at[-1]) + 1, dtype=np.uint32)
    for s, x in zip(at[:-1].tolist(), parts, strict=True):
        out[s : s + len(x)] = (x >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return out, at[:-1]


def _mixed(sums: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (sums * np.uint32(0x85EBCA6B)) ^ word
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
    return h ^ (h >> np.uint32(13))


def _embed(base: np.ndarray, starts: np.ndarray, span: int, steps: list[int], bits: np.ndarray):
    """Hashes of the sampled places so far, once for each sampled place, of all windows."""
    place, sums, k = starts.copy(), np.zeros(len(starts), dtype=np.uint32), 0
    for j in range(steps[-1] + 1):
        word = np.where(place < starts + span, base[np.minimum(place, len(base) - 1)], np.uint32(0))
        if j == steps[k]:
            sums = _mixed(sums, word)
            yield sums
            k += 1
        place = place + ((word * bits[j]) >> np.uint32(31)).astype(np.int64)


class Index:
    """Exact runs of a block's short items, and sampled CGK embeddings of the windows of the others."""

    def __init__(self, items: list[tuple[int, np.ndarray]], tolerance: float = TOLERANCE, tables: int = TABLES, seed: int = 1):
        self.items, self.tolerance = [x for x in items if len(x[1])], tolerance
        runs: dict[int, list] = {}
        for k, (_, w) in enumerate(self.items):
            if len(w) < SEEDED:
                cuts = min(int(tolerance * len(w)) + 1, len(w))
                size = len(w) // cuts
                runs.setdefault(size, []).extend((k, s, grams(w[s : s + size], size)[0]) for s in (j * len(w) // cuts for j in range(cuts)))
        self.seeds = []
        for size, found in sorted(runs.items()):
            found.sort(key=lambda x: x[2])
            keys = np.array([x[2] for x in found], dtype=np.uint64)
            mark = np.zeros(1 << 17, dtype=bool)
            mark[keys >> np.uint64(47)] = True
            self.seeds.append((size, mark, keys, [x[:2] for x in found]))
        rng = np.random.default_rng(seed)
        self.groups = []
        for span in sorted({min(SPAN, len(w)) for _, w in self.items if len(w) >= SEEDED}):
            where = [(k, s) for k, (_, w) in enumerate(self.items) if len(w) >= SEEDED and min(SPAN, len(w)) == span for s in sorted({*range(0, len(w) - span + 1, STRIDE), len(w) - span})]
            base, at = _padded([self.items[k][1][s : s + span] for k, s in where], span)
            bits = rng.integers(1, 1 << 31, size=(tables, 2 * span), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
            bits[:, :EARLY] = bits[0, :EARLY]  # the first steps are walked once for all tables
            drawn = []
            for t in range(tables):
                first = t % min(EARLY, 2 * span)
                rest = np.arange(first + 1, 2 * span)
                second = rest[: max(1, min(4, len(rest)))]
                steps = [first]
                if len(rest):
                    steps.append(int(rng.choice(second)))
                    later = rest[rest > steps[1]]
                    steps += sorted(rng.choice(later, min(SAMPLES - 2, len(later)), replace=False).tolist())
                marks, sums = [], None
                for sums in _embed(base, at, span, steps, bits[t]):
                    mark = np.zeros(1 << 17, dtype=bool)
                    mark[sums >> np.uint32(15)] = True
                    marks.append(mark)
                order = np.argsort(sums, kind="stable")
                drawn.append((steps, bits[t], marks, sums[order], order))
            self.groups.append((span, where, drawn))

    def meetings(self, base: np.ndarray, bounds: np.ndarray):
        """``(start, item number, place in the item)`` of runs of a short item, and of windows that agree with an item in a table."""
        for size, mark, keys, where in self.seeds:
            runs = grams(base, size)
            on = np.flatnonzero(mark[runs >> np.uint64(47)])
            low, high = np.searchsorted(keys, runs[on]), np.searchsorted(keys, runs[on], "right")
            met = np.flatnonzero((low < high) & (on + size <= bounds[np.searchsorted(bounds, on, "right")]))
            for b, x, y in zip(on[met].tolist(), low[met].tolist(), high[met].tolist(), strict=True):
                for i in range(x, y):
                    yield b, *where[i]
        for span, where, drawn in self.groups:
            few = max(1, span - int(span * self.tolerance))
            parts = [base[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            if not any(len(x) >= few for x in parts):
                continue
            padded, at = _padded(parts, span)
            size = np.maximum(np.diff(bounds) - few + 1, 0)
            real = np.zeros(len(padded), dtype=bool)
            for s, n in zip(at.tolist(), size.tolist(), strict=True):
                real[s : s + n] = True
            starts = np.flatnonzero(real).astype(np.int32)
            place, begun = starts, {}
            early = {steps[0] for steps, *_ in drawn}
            for j in range(max(early) + 1):
                word = padded[place]
                if j in early:
                    steps, _, marks, _, _ = next(d for d in drawn if d[0][0] == j)
                    sums = _mixed(np.zeros(1, dtype=np.uint32), word)
                    on = np.flatnonzero(marks[0][sums >> np.uint32(15)])
                    begun[j] = (starts[on], place[on], sums[on], word[on])
                place = place + ((word * drawn[0][1][j]) >> np.uint32(31)).astype(np.int32)
            shift = np.repeat(bounds[:-1] - at, np.append(np.diff(at), len(padded) - at[-1])) if len(at) else None
            for steps, bits, marks, keys, order in drawn:
                begin, place, sums, word = begun[steps[0]]
                place, k = place + ((word * bits[steps[0]]) >> np.uint32(31)).astype(np.int32), 1
                for j in range(steps[0] + 1, steps[-1] + 1):
                    word = padded[place]
                    if j >= span:
                        word = np.where(place < begin + span, word, np.uint32(0))
                    if j == steps[k]:
                        sums = _mixed(sums, word)
                        on = np.flatnonzero(marks[k][sums >> np.uint32(15)])
                        place, begin, sums, word = place[on], begin[on], sums[on], word[on]
                        k += 1
                        if not len(on):
                            break
                    place = place + ((word * bits[j]) >> np.uint32(31)).astype(np.int32)
                low, high = np.searchsorted(keys, sums), np.searchsorted(keys, sums, "right")
                met = np.flatnonzero(low < high)
                for b, x, y in zip((begin[met] + shift[begin[met]]).tolist(), low[met].tolist(), high[met].tolist(), strict=True):
                    for i in order[x:y].tolist():
                        yield b, *where[i]

    def matches(self, base: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], int]:
        """Least edit distance by ``(text, item number)`` of the items that texts hold."""
        tried, found = set(), {}
        for begin, k, s in self.meetings(base, bounds):
            text = int(np.searchsorted(bounds, begin, "right")) - 1
            item = self.items[k][1]
            most = int(self.tolerance * len(item))
            at = (begin - s) // (most + 1)
            if (text, k, at) in tried or found.get((text, k)) == 0:
                continue
            tried.add((text, k, at))
            low = max(int(bounds[text]), at * (most + 1) - most)
            high = min(int(bounds[text + 1]), at * (most + 1) + most + len(item) + most)
            near = base[low:high]
            if np.isin(item, near).sum() < len(item) - most:
                continue
            d = distance(item, near)
            if d <= most:
                found[text, k] = min(d, found.get((text, k), d))
        return found


def distance(item: np.ndarray, near: np.ndarray) -> int:
    """Least edit distance (insert, delete, replace a word) of ``item`` to any run of ``near``."""
    row, steps = np.zeros(len(near) + 1, dtype=np.int64), np.arange(len(near) + 1)
    for i, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (near != w), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items' words in blocks of bounded size, one after another; at least one block."""
    block, size, none = [], 0, True
    for r in items.select("item_id", "text").toLocalIterator():
        w = plain_words(r.text)
        if block and size + len(w) > BLOCK_WORDS:
            yield block
            block, size, none = [], 0, False
        block.append((r.item_id, w))
        size += len(w)
    if block or none:
        yield block


def hits(docs: DataFrame, items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, item_id, distance and n_words of the item for every item that a document holds."""
    context, out = docs.sparkSession.sparkContext, None
    for block in item_blocks(items):
        held = context.broadcast((block, tolerance))

        def run(batches, held=held):
            index = Index(*held.value)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for first, data, at in texts(batch):
                    _, _, base, bounds = words(*plain(data, at))
                    found = index.matches(base, bounds)
                    if found:
                        yield pa.RecordBatch.from_pylist([{"doc_id": ids[first + t], "item_id": index.items[k][0], "distance": d, "item_words": len(index.items[k][1])} for (t, k), d in sorted(found.items())], schema=schema)

        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("item_words", pa.int64())])
        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, distance long, item_words long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs`` that hold no item, columns and all."""
    context = docs.sparkSession.sparkContext
    for block in item_blocks(items):
        held = context.broadcast((block, tolerance))

        def run(batches, held=held):
            index = Index(*held.value)
            for batch in batches:
                keep = np.ones(len(batch), dtype=bool)
                for first, data, at in texts(batch):
                    _, _, base, bounds = words(*plain(data, at))
                    keep[[first + t for t, _ in index.matches(base, bounds)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items: one row for each document and item."""
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
