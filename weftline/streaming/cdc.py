"""Change streams: the latest action of each key applied to a table, in batch and as a stream with a version for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from weftline.operators import stored
from weftline.operators.relational import quoted


def latest(changes: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last change of each key in ``order`` (later ones win)."""
    by = [F.desc(o) if isinstance(o, str) else o.desc() for o in order]
    return changes.withColumn("_n", F.row_number().over(Window.partitionBy(*map(quoted, keys)).orderBy(*by))).filter("_n = 1").drop("_n")


def applied(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column | str], action: str = "action") -> DataFrame:
    """``target`` after the changes: a last DELETE removes its key, any other action sets its row."""
    last = latest(changes, keys, order)
    kept = target.join(last.select(*map(quoted, keys)), list(keys), "left_anti").select(*target.columns)
    return kept.unionByName(last.filter(F.upper(action) != "DELETE").select(*target.columns))


def newest(stream: DataFrame, keys: Sequence[str], stamp: str, late: str, ties: Sequence[str] = ()) -> DataFrame:
    """The changes of a stream that are newer, by ``stamp`` and then ``ties``, than every change of their key that came before.

    The state store holds one version for each key, that of its newest change,
    deletions too, so an older change that comes in a later batch is passed
    over. Of several changes of a key in one batch the newest is left. A version
    goes once the watermark, ``late`` behind the newest stamp, has passed it:
    whatever is older is dropped as too late from then on. Rows without a stamp
    are passed over.
    """
    out = StructType(list(stream.schema.fields))
    marked = stream.filter(F.col(quoted(stamp)).isNotNull()).withColumn("_when", F.col(quoted(stamp)).cast("timestamp")).withWatermark("_when", late).withColumn("_at", F.unix_micros("_when"))
    order = ["_at", *ties]
    kinds = dict(marked.dtypes)
    version = ", ".join(f"v{i} {kinds[c]}" for i, c in enumerate(order))
    names = [f.name for f in out.fields]
    return marked.groupBy(*map(quoted, keys)).applyInPandasWithState(_newest(order, names), out, version, "append", GroupStateTimeout.EventTimeTimeout)


def _newest(order: list[str], names: list[str]):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, mark = None, None
        for frame in frames:
            stamps = frame[order[0]].to_numpy()
            top = frame.iloc[np.flatnonzero(stamps == stamps.max())]
            if len(top) > 1:  # sorting takes most of a key's time, so only ties are sorted
                top = top.sort_values(order, kind="stable").tail(1)
            here = tuple(x.item() if hasattr(x, "item") else x for x in (top[c].iloc[0] for c in order))
            if mark is None or here > mark:
                best, mark = top, here
        if mark is not None and (not state.exists or mark > tuple(state.get)):
            state.update(mark)
            yield best[names]
        if state.exists:
            state.setTimeoutTimestamp(max(state.get[0] // 1000, state.getCurrentWatermarkMs()) + 1)

    return run


def follow(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], keys: Sequence[str], stamp: str, checkpoint: str, action: str = "action", late: str = "1 day", ties: Sequence[str] = ()) -> StreamingQuery:
    """A query that applies each micro-batch to the table that ``read`` gives and hands the result to ``write``.

    Only the changes that :func:`newest` lets through are applied, so the order
    in which batches bring a key's changes doesn't matter. ``write`` gets the
    batch's number, so that a batch repeated after a failure can replace its own
    earlier result. A change is set once however often its batch is repeated.
    """

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write(applied(read(), batch, keys, [stamp, *ties], action), number)

    return _run(newest(stream, keys, stamp, late, ties), one, checkpoint)


def follow_stored(stream: DataFrame, path: str, keys: Sequence[str], stamp: str, checkpoint: str, action: str = "action", late: str = "1 day", ties: Sequence[str] = ()) -> StreamingQuery:
    """:func:`follow` on a target of :mod:`weftline.operators.stored`: each batch rewrites the buckets of its own keys alone."""

    def one(batch: DataFrame, number: int) -> None:
        batch.persist()
        stored.changed(batch.sparkSession, path, batch, keys, lambda old, rows: applied(old, rows, keys, [stamp, *ties], action))
        batch.unpersist()

    return _run(newest(stream, keys, stamp, late, ties), one, checkpoint)


def _run(stream: DataFrame, one: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(one).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, stamp: str, late: str, size: str, slide: str | None, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Windowed aggregates of a stream with a bound on lateness (also of a batch): an extension of the reference's surface."""
    window = F.window(stamp, size, slide) if slide else F.window(stamp, size)
    return events.withWatermark(stamp, late).groupBy(window, *keys).agg(*aggregates)
