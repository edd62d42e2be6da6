"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon is learned from labelled training rows: words far commoner in
toxic texts than in others. It is kept as a trie, and the Levenshtein automata
of its words, intersected with that trie, make a table of states: a state is a set
of (trie node, errors so far), so one pass over a word's letters tells whether
it is within one error (two for long words) of a lexicon word, whatever the
lexicon's size; a stem takes any ending, but no error. States are worked out as
the words of the texts reach them, which most words of other subjects don't get
far in, and a worker keeps about ``PLACES`` such pairs at most. Every distinct word
of a slice runs through the table together.

How many errors a lexicon word may have is learned too: where words so near it
stand in clean texts more than in toxic ones, it may have fewer. A hit is
scored with its context window: hits between quotation marks or near words of
reporting count apart from the others, as do words and stems. A logistic regression on these counts gives the score; labels, language,
source and id are never inputs.

The lexicon and the regression are fitted on at most ``SAMPLE`` labelled
training rows, those with the smallest hashed ids; every document is scored on
its whole text.

Cases: null and empty texts have no hits and get the score of such texts; a
very long text is read whole and its counts are logarithms; a label of a
missing document is ignored, of several labels of a document the larger
counts, and of several texts under a labelled id the first in order is learned
from; null labels are ignored; without labelled rows, or without toxic
or clean ones, the score is the smoothed share of toxic rows; equal rows get
equal scores; extra columns are kept by :func:`accepted`; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, plain, saved, table, texts, words

#: Labelled rows that are fitted on at most; they bound the lexicon, which holds all words and stems that reach the values below.
SAMPLE = 10_000
#: A lexicon word follows this many different words in toxic texts, is this many times commoner there, and its log-likelihood ratio reaches the third.
SUPPORT, LIFT, RATIO = 5, 3.0, 25.0
#: A stem has so many letters, at least so many words, and is this many times commoner in toxic texts.
STEM_LETTERS, STEM_WORDS, STEM_LIFT = range(3, 9), 3, 10.0
#: Words on either side of a hit that make its context.
CONTEXT = 6
#: Words that introduce another's speech.
REPORTING = ("said", "says", "quote", "quoted", "quotes", "wrote", "writes", "called", "calls", "reported", "according", "word", "words", "term", "insult", "slur", "sagte", "zitat", "dijo", "dit")
FEATURES = 9
#: Places in the states of an automaton that a worker keeps (some 60 MB) before it starts over, and words that run through it at once.
PLACES, AT_ONCE = 1 << 19, 1 << 12


def _letters(word: bytes) -> bytes:
    return plain(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0].tobytes()


def allowed(word: bytes) -> int:
    """Errors that a word of the lexicon may have at most: none in short words, whose neighbours are often words."""
    return 0 if len(word) < 4 else 1 if len(word) < 9 else 2


#: The node of a stem with any letters after it.
PAST = -1


class Automaton:
    """All lexicon words within their allowed errors, as a transition table over bytes that grows as words need it."""

    def __init__(self, lexicon: list[bytes], stems: list[bytes] = (), errors: dict[bytes, int] | None = None, most_errors: int | None = None):
        """``errors`` lowers what words are allowed; ``most_errors`` takes its place for all words."""
        self.lexicon = sorted({w for w in map(_letters, lexicon) if w})
        limits = {_letters(w): e for w, e in (errors or {}).items()}
        allowed_ = lambda w: min(allowed(w), limits.get(w, 9)) if most_errors is None else most_errors
        self.stems = sorted({w for w in map(_letters, stems) if w})
        child: list[dict[int, int]] = [{}]
        ends: list[bytes | None] = [None]
        most = [0]  # errors that some word below may have
        for w in self.lexicon:
            node = 0
            most[0] = max(most[0], allowed_(w))
            for c in w:
                if c not in child[node]:
                    child[node][c] = len(child)
                    child.append({})
                    ends.append(None)
                    most.append(0)
                node = child[node][c]
                most[node] = max(most[node], allowed_(w))
            ends[node] = w
        stem_ends = set()
        for w in self.stems:
            node = 0
            for c in w:
                if c not in child[node]:
                    child[node][c] = len(child)
                    child.append({})
                    ends.append(None)
                    most.append(0)
                node = child[node][c]
            stem_ends.add(node)
        self.child, self.ends, self.most, self.stem_ends = child, ends, most, frozenset(stem_ends)
        self.limit = {w: allowed_(w) for w in self.lexicon}
        letters = sorted({c for w in [*self.lexicon, *self.stems] for c in w})
        self.letters = [None, *letters]
        self.column = np.zeros(256, dtype=np.int64)  # 0: any other letter
        self.column[letters] = np.arange(1, len(letters) + 1)
        self.longest = max([*(len(w) + allowed_(w) for w in self.lexicon), *(len(w) + 1 for w in self.stems)], default=0)
        self.shortest = min([*(len(w) - allowed_(w) for w in self.lexicon), *map(len, self.stems)], default=1)
        self._begin()

    def __getstate__(self) -> dict:
        """Without the states: every worker makes its own."""
        return {k: v for k, v in self.__dict__.items() if k not in ("states", "number", "held", "next", "accept", "beyond")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._begin()

    def _begin(self) -> None:
        self.states: list[frozenset] = []
        self.held = 0
        self.number: dict[frozenset, int] = {}
        self.next = np.full((1024, len(self.letters)), -1, dtype=np.int32)  # -1: not worked out yet
        # 0: no word, 1: a word with errors, 2: a word of the lexicon, 3: a stem with an ending.
        self.accept, self.beyond = np.zeros(1024, dtype=np.int8), np.zeros(1024, dtype=bool)
        self._state(frozenset())
        self.next[0] = 0
        self._state(self._closed({0: 0}))

    def _trim(self) -> None:
        if self.held > PLACES:
            self._begin()

    def _closed(self, state: dict[int, int]) -> frozenset:
        todo = list(state.items())
        while todo:  # letters left out
            node, e = todo.pop()
            for n in self.child[node].values() if node != PAST else ():
                if e + 1 <= self.most[n] and e + 1 < state.get(n, 99):
                    state[n] = e + 1
                    todo.append((n, e + 1))
        return frozenset(state.items())

    def _moved(self, state: frozenset, c: int | None) -> frozenset:
        new: dict[int, int] = {}
        for node, e in state:
            if node == PAST or (node in self.stem_ends and not e):
                new[PAST] = 0
            if node == PAST:
                continue
            for letter, n in self.child[node].items():
                cost = e + (letter != c)
                if cost <= self.most[n] and cost < new.get(n, 99):
                    new[n] = cost
            if e + 1 <= self.most[node] and e + 1 < new.get(node, 99):  # a letter put in
                new[node] = e + 1
        return self._closed(new)

    def _state(self, state: frozenset) -> int:
        if state in self.number:
            return self.number[state]
        i = self.number[state] = len(self.states)
        self.states.append(state)
        self.held += len(state)
        if i == len(self.next):
            self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
            self.accept, self.beyond = np.concatenate([self.accept, np.zeros_like(self.accept)]), np.concatenate([self.beyond, np.zeros_like(self.beyond)])
        errors = [e for node, e in state if node != PAST and self.ends[node] is not None and e <= self.limit[self.ends[node]]]
        stem = any(node == PAST or (node in self.stem_ends and not e) for node, e in state)
        self.accept[i] = 2 if errors and min(errors) == 0 else 3 if stem else 1 if errors else 0
        self.beyond[i] = any(node == PAST for node, _ in state)
        return i

    def _step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        to = self.next[state, column]
        new = np.flatnonzero(to < 0)
        if len(new):
            width = len(self.letters)
            for pair in np.unique(state[new].astype(np.int64) * width + column[new]).tolist():
                s, c = divmod(pair, width)
                i = self._state(self._moved(self.states[s], self.letters[c]))
                self.next[s, c] = i
            to = self.next[state, column]
        return to

    def _last(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The states after all letters, or the first ``longest``, of words in order of falling size."""
        state = np.ones(len(starts), dtype=np.int32)
        for j in range(self.longest):
            n = int(np.searchsorted(-size, -j, "left"))
            if not n:
                break
            state[:n] = self._step(state[:n], self.column[data[starts[:n] + j]])
        return state

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The kind (0 to 3) of every word of ``data``."""
        out, size = np.zeros(len(starts), dtype=np.int8), ends - starts
        every = np.flatnonzero((size <= self.longest if not self.stems else size > 0) & (size >= self.shortest))
        for a in range(0, len(every), AT_ONCE):
            at = every[a : a + AT_ONCE]
            at = at[np.argsort(-size[at], kind="stable")]  # long words first, so those still running are a prefix
            left = size[at]
            state = self._last(data, starts[at], left)
            out[at] = np.where(left <= self.longest, self.accept[state], np.where(self.beyond[state], 3, 0))
            self._trim()
        return out

    def near(self, word: bytes) -> list[tuple[bytes, int]]:
        """The lexicon words that ``word`` is within their allowed errors of, and how many errors that takes."""
        if not self.shortest <= len(word) <= self.longest:
            return []
        data = np.frombuffer(word, np.uint8)
        state = self.states[int(self._last(data, np.zeros(1, np.int64), np.array([len(word)]))[0])]
        self._trim()
        return [(self.ends[n], e) for n, e in state if n != PAST and self.ends[n] is not None and e <= self.limit[self.ends[n]]]


def _features(automaton: Automaton, reporting: np.ndarray, batch: pa.RecordBatch):
    """``(first row, features)`` of slices of a batch."""
    for first, data, at in texts(batch):
        loose, cut = plain(data, at)
        starts, ends, hashes, bounds = words(loose, cut)
        m = len(at) - 1
        out = np.zeros((m, FEATURES))
        out[:, 0] = 1
        # Each distinct word runs through the automaton once.
        distinct, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        kind = automaton.run(loose, starts[one], ends[one])[back]
        hit = np.flatnonzero(kind)
        if len(hit):
            text = np.searchsorted(bounds, hit, "right") - 1
            low, high = np.maximum(hit - CONTEXT, bounds[text]), np.minimum(hit + CONTEXT + 1, bounds[text + 1])
            told = np.append(0, np.cumsum(np.isin(hashes, reporting)))
            near = told[high] > told[low]
            quoted = _quoted(data, at, loose, cut, starts[hit], text)
            softened = near | quoted
            n = np.maximum(np.diff(bounds), 1)
            for column, mask in ((1, kind[hit] < 3), (4, kind[hit] == 3)):
                count = np.bincount(text[mask & ~softened], minlength=m)
                out[:, column], out[:, column + 1], out[:, column + 2] = np.log1p(count), np.log1p(100 * count / n), count > 0
                told_ = np.bincount(text[mask & softened], minlength=m)
                out[:, 7] += told_
            out[:, 8] = out[:, 7] > 0
            out[:, 7] = np.log1p(out[:, 7])
        yield first, out


def _quoted(data, at, loose, cut, places, text) -> np.ndarray:
    """Whether words of the loosened text stand between double quotation marks of their line."""
    from .common import _LOWER, _MARKS

    kept = np.flatnonzero(_MARKS[_LOWER[data]])  # where the loosened letters stood
    origin = kept[places]
    quote = data == 34
    if len(data) > 2:  # the typographic marks are E2 80 9C to 9E, the angled ones C2 AB and BB
        curly = (data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] >= 0x9C) & (data[2:] <= 0x9E)
        angled = (data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB))
        quote = quote.copy()
        quote[:-2] |= curly
        quote[:-1] |= angled
    if not quote.any():
        return np.zeros(len(places), dtype=bool)
    marks = np.append(0, np.cumsum(quote))
    lines = np.flatnonzero(np.append(data == 10, False))
    begin = np.append(-1, lines)[np.searchsorted(lines, origin)] + 1
    end = np.append(lines, len(data))[np.searchsorted(lines, origin)]
    begin, end = np.maximum(begin, at[text]), np.minimum(end, at[text + 1])
    before, after = marks[origin] - marks[begin], marks[end] - marks[origin]
    return (before % 2 == 1) & (after > 0)


class Model:
    """Lexicon, automaton and weights."""

    def __init__(self, lexicon: list[bytes], stems: list[bytes] = (), errors: dict[bytes, int] | None = None):
        self.automaton = Automaton(lexicon, stems, errors)
        self.reporting = np.unique(np.concatenate([words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[2] for w in REPORTING]))
        self.weights = np.zeros(FEATURES)

    def fit(self, x: np.ndarray, y: np.ndarray, penalty: float = 0.03) -> None:
        """Penalised logistic regression by Newton steps."""
        w = np.zeros(FEATURES)
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        w[0] = np.log(share / (1 - share))
        ridge = np.full(FEATURES, penalty)
        ridge[0] = 1e-6
        for _ in range(50 if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (p - y) + ridge * w * (np.arange(FEATURES) > 0))
            w -= np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(len(batch))
        for first, x in _features(self.automaton, self.reporting, batch):
            out[first : first + len(x)] = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
        return out


def sampled(docs: DataFrame, labels: DataFrame, folds: int = 5, most: int = SAMPLE) -> DataFrame:
    """text and toxic (0, 1) of at most ``most`` labelled training rows, by the smallest hashes of their ids."""
    train = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), folds) != 0))
    chosen = train.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` pairs
    # One text for each label, however often its id stands in the table.
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic")).select("text", "toxic")


def lexicon(rows: DataFrame) -> tuple[list[bytes], list[bytes], dict[bytes, int]]:
    """Words and stems that mark toxic texts among ``rows``, and the errors that words may have; a word that a stem covers is left out."""

    def run(batches):
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for first, data, at in texts(batch):
                loose, cut = plain(data, at)
                raw = loose.tobytes()
                _, _, hashes, bounds = words(loose, cut)
                for i in range(len(at) - 1):
                    s, e = bounds[i], bounds[i + 1]
                    if e > s:
                        before = np.append(0, hashes[s : e - 1].astype(np.int32))
                        one = np.unique(hashes[s:e], return_index=True)[1]
                        found = raw[cut[i] : cut[i + 1]].split()
                        yield pa.RecordBatch.from_arrays([pa.array([found[j] for j in one], pa.binary()), pa.array(before[one], pa.int32()), pa.array(np.full(len(one), toxic[first + i]), pa.int32())], names=["word", "before", "toxic"])

    # A word counts once in a text and once for each word it follows there first,
    # so that long texts, copies and shared passages weigh no more than others.
    seen = rows.select("text", "toxic").mapInArrow(run, "word binary, before int, toxic int").groupBy("word", "before").agg(F.max("toxic").alias("bad"), F.min("toxic").alias("good"))
    by_word = saved(seen.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("good")).alias("good")))
    bad, good = by_word.agg(F.sum("bad"), F.sum("good")).first()
    if not bad or not good:
        return [], [], {}
    both = F.col("bad") + F.col("good")
    part = lambda x, total: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) * F.lit(bad + good) / (both * F.lit(total)))).otherwise(F.lit(0.0))
    lift = (F.col("bad") / F.lit(bad)) / ((F.col("good") + 0.5) / F.lit(good))
    ratio = 2 * (part("bad", bad) + part("good", good))
    word = F.col("word").cast("string")
    stems = by_word.select(F.explode(F.array(*[F.when(F.length(word) > n, F.substring(word, 1, n)) for n in STEM_LETTERS])).alias("stem"), "bad", "good")
    stems = stems.filter("stem IS NOT NULL").groupBy(F.encode("stem", "UTF-8").alias("word")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count_if(F.col("bad") > F.col("good")).alias("words"))
    kept = lambda df, least: df.filter((F.col("bad") >= SUPPORT) & (lift >= least)).withColumn("ratio", ratio).filter(F.col("ratio") >= RATIO).orderBy(F.desc("ratio"), F.length("word"), "word")
    # The strongest stem of a family stands for the family; what it covers, or what it would only widen, is left out.
    found: list[bytes] = []
    for r in kept(stems.filter(F.col("words") >= STEM_WORDS), STEM_LIFT).collect():
        w = bytes(r.word)
        if not any(w.startswith(x) or x.startswith(w) for x in found):
            found.append(w)
    plain_ = [bytes(r.word) for r in kept(by_word.filter(F.octet_length("word") >= 3), LIFT).collect()]
    chosen = [w for w in plain_ if not any(w.startswith(x) for x in found)]
    return chosen, found, _errors(by_word, chosen)


def _errors(by_word: DataFrame, chosen: list[bytes]) -> dict[bytes, int]:
    """Errors that each chosen word may have: as many as keep to words that toxic texts have no less than clean ones."""
    open_ = [w for w in chosen if allowed(w)]
    if not open_:
        return {}
    held = by_word.sparkSession.sparkContext.broadcast(Automaton(open_, most_errors=2))

    def run(batches):
        for batch in batches:
            found = [(w, d, i) for i, word in enumerate(batch.column(0).to_pylist()) for w, d in held.value.near(bytes(word)) if d]
            at = pa.array([i for *_, i in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _, _ in found], pa.binary()), pa.array([d for _, d, _ in found], pa.int32()), batch.column(1).take(at), batch.column(2).take(at)], names=["w", "d", "bad", "good"])

    kinds = dict(by_word.dtypes)
    rows = by_word.select("word", "bad", "good").mapInArrow(run, f"w binary, d int, bad {kinds['bad']}, good {kinds['good']}").groupBy("w", "d").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()  # two rows for each chosen word at most
    seen = {(bytes(r.w), r.d): r.good > r.bad for r in rows}
    return {w: 0 if seen.get((w, 1)) else 1 if seen.get((w, 2)) else 2 for w in open_}


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the labelled training rows."""
    rows = saved(sampled(docs, labels))
    model = Model(*lexicon(rows))
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for first, x in _features(held.value.automaton, held.value.reporting, batch):
                y = batch.column(1).slice(first, len(x)).cast(pa.float64())
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x[:, i])) for i in range(FEATURES)), y], names=[*(f"x{i}" for i in range(FEATURES)), "y"])

    got = rows.select("text", "toxic").mapInArrow(run, ", ".join(f"x{i} double" for i in range(FEATURES)) + ", y double").toArrow()  # at most SAMPLE rows of ten numbers
    data = np.stack([c.to_numpy() for c in got.columns], axis=1) if got.num_rows else np.zeros((0, FEATURES + 1))
    data = data[np.lexsort(data.T)]  # the sum's order, hence the weights, don't depend on the rows' order
    model.fit(data[:, :-1], data[:, -1])
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(held.value.scores(batch))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, bound: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``bound``, columns and all."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(held.value.scores(batch) < bound))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labelled rows with crc32 remainder (mod 5) other than 0."""
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
