"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code-point order (null last) weigh 3, 1, 2 repeating and share a
budget of ``share`` times all words; what a source would get above ``most``
times its own words goes to the others by weight. A source's target is met by
whole passes over its documents plus a subset for the remaining budget. The
subset is fitted on counts of documents by exact length: every length first
gives its proportional part, rounded so that the words taken keep pace with
the budget from the longest length to the shortest. Then a bounded-knapsack
dynamic programme over the lengths, which may take more documents of a length
or give some back, brings the words taken as near the budget as it can. Which
documents of a length are taken follows a seeded hash.

The programme's sums reach ``SPREAD`` words, or four of the longest documents
if that is more, to either side of the proportional part. For a source of no
more words than that it tries every choice, so the result is the nearest there
is; for a larger one it is never farther than the proportional part.

The lengths of one source number at most the longest text's words, however
many documents share a length; the histogram of a source, not its documents,
is what one task holds. Rows are counted by their contents first, and ranked
in 1,024 hash cells for each length, so neither a repeated row nor a length
that a third of all rows have is a single group. The targets are worked out on
one row for each source.

Cases: a null or blank text has size 0 and takes 0 words; a very long text is
a document of its length; equal rows are separate rows, any so many of which
may be taken; an empty table gives an empty result; a null source is a source;
further columns are kept, and ones named like the result's are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, saved, table, word_count

WEIGHTS = (3.0, 1.0, 2.0)
CELLS = 1024
#: Words on either side of the proportional part that the dynamic programme's sums reach at least.
SPREAD = 1 << 20


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Per source: ``source_size`` and ``target`` (water-filled under ``most`` times the source's size).

    One row per source is ranked and summed; documents are not.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    number = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (number + 1).cast("int"))
    caps = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), F.encode("source", "UTF-8"))
    done, left = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(done), F.lit(0.0))) / F.sum("weight").over(left)
    # In order of cap per weight, the first source whose level is under its ratio sets the level of all from there.
    found = F.when(level <= F.col("ratio"), F.struct(F.row_number().over(order).alias("at"), level.alias("level")))
    line = F.col("line.level")
    return (
        caps.withColumn("found", found)
        .withColumn("line", F.min("found").over(every))
        .select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * line, F.col("cap"))).alias("target"))
    )


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, spread: int = SPREAD) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest ``budget``."""
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.astype(np.int64)
    due = done = 0  # words that all lengths so far should have and have, the first times total
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, n = int(lengths[i]), int(counts[i])
        due += size * n * budget
        take[i] = min(n, max(0, (2 * (due - done * total) + size * total) // (2 * size * total)))
        done += int(take[i]) * size
    return _adjusted(lengths, counts, take, budget - done, max(spread, 4 * int(lengths.max())))


def _adjusted(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, rest: int, reach: int) -> np.ndarray:
    """``take`` with documents added or given back so that the words change by ``rest``, or as nearly as can be.

    ``by[s]`` is the step that first reached a change of s - reach words. As a
    step starts from sums that were reached before it, following the steps back
    from a sum uses each once at most.
    """
    by = np.full(2 * reach + 1, -1, dtype=np.int32)
    by[reach] = 0
    steps = [(0, 0)]
    for i in np.argsort(lengths, kind="stable").tolist():
        if by[reach + rest] >= 0:
            break
        size = int(lengths[i])
        for sign, most in ((1, int(counts[i] - take[i])), (-1, int(take[i]))):
            most, part = min(most, 2 * reach // size), 1
            while most > 0 and by[reach + rest] < 0:
                n = min(part, most)
                shift = sign * n * size
                old, new = (by[:-shift], by[shift:]) if shift > 0 else (by[-shift:], by[:shift])
                fresh_ = (old >= 0) & (new < 0)
                steps.append((i, sign * n))
                new[fresh_] = len(steps) - 1
                most, part = most - n, part * 2
    found = np.flatnonzero(by >= 0) - reach
    change = int(found[np.argmin(np.abs(found - rest))])
    while by[reach + change]:
        i, n = steps[by[reach + change]]
        take[i] += n
        change -= n * int(lengths[i])
    return take


def _quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = min(2, int(target // total)) if total else 0
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["docs"].to_numpy(np.int64)
    real = lengths > 0
    extra = np.zeros(len(pdf), dtype=np.int64)
    if passes < 2:
        extra[real] = fit(lengths[real], counts[real], int(round(target)) - passes * total)
    return pd.DataFrame({"source": pdf["source"], "size": lengths, "source_size": total, "target": target, "passes": passes, "extra": extra})


def mixed(docs: DataFrame, size: str = "size", share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """``docs`` (with ``doc_id``, ``source`` and words in ``size``) plus ``source_size``, ``target`` and ``copies`` (0 to 2)."""
    docs = docs.drop("source_size", "target", "copies")
    key, of_key, before, times, of_source, of_size, n = (fresh(docs, x) for x in ("key", "of_key", "before", "times", "of_source", "of_size", "n"))
    keyed = docs.withColumn(key, F.xxhash64(*docs.columns))
    # One row for each distinct row from here on: its hash, and how often it stands in the table.
    rows = saved(keyed.groupBy("source", F.col(size).alias("size"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(CELLS)).cast("int"))
    bins = rows.groupBy("source", "size").agg(F.sum("n").alias("docs"))
    goal = targets(bins.select("source", (F.col("size") * F.col("docs")).alias("size")), share, most)
    quotas = bins.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").groupBy("source").applyInPandas(_quotas, "source string, size long, source_size long, target double, passes int, extra long")
    cells = rows.groupBy("source", "size", "cell").agg(F.sum("n").alias("docs"))
    lower = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "size", "cell", F.coalesce(F.sum("docs").over(lower), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "size", "cell").orderBy(F.xxhash64(F.lit(seed + 1), "key"), "key").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0)))
    same = lambda x, *names: [x[c].eqNullSafe(F.col(f"of_{c}")) for c in names]
    of = lambda df: df.select(*(F.col(c).alias(f"of_{c}" if c in ("source", "size", "cell") else c) for c in df.columns))
    ranked = ranked.join(of(cells), same(ranked, "source", "size", "cell")).drop("of_source", "of_size", "of_cell")
    ranked = ranked.join(of(quotas), same(ranked, "source", "size")).drop("of_source", "of_size")
    more = F.least(F.greatest(F.col("extra") - F.col("start") - F.col("ahead"), F.lit(0)), F.col("n"))
    plan = saved(ranked.select(F.col("key").alias(of_key), F.col("source").alias(of_source), F.col("size").alias(of_size), F.col("n").alias(n), more.alias(before), F.col("passes").alias(times), "source_size", "target"))
    theirs = (F.col(key) == F.col(of_key)) & F.col("source").eqNullSafe(F.col(of_source)) & F.col(size).eqNullSafe(F.col(of_size))
    alike = (F.col(before) == 0) | (F.col(before) == F.col(n))
    whole = keyed.join(plan.filter(alike).withColumn("copies", F.col(times) + (F.col(before) > 0).cast("int")), theirs)
    # Of a row that stands several times, some may be taken: one such row for each source and length at most.
    some = keyed.join(plan.filter(~alike), theirs)
    some = some.groupBy(*docs.columns, before, times, "source_size", "target").agg(F.count(F.lit(1)).alias(key))
    some = some.withColumn(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col(key)))).withColumn("copies", F.col(times) + (F.col(key) <= F.col(before)).cast("int"))
    columns = [*docs.columns, "source_size", "target", "copies"]
    return whole.select(*columns).unionByName(some.select(*columns))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their source's target and the words that the mix takes of each."""
    docs = saved(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))  # texts are read once
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
