"""Incremental refresh: new papers are indexed once, and repeated events are dropped within a watermark."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tessera.operators.store import Store, load
from tessera.schemas import Table


def unseen(incoming: DataFrame, indexed: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't indexed yet."""
    return incoming.join(indexed.select(*keys).distinct(), keys, "left_anti")


def deduplicated(events: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """A stream with each key once within `delay`; state beyond the watermark is forgotten."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def keep_fresh(papers: DataFrame, store: Store, table: Table, checkpoint: str):
    """A query that upserts each micro-batch of papers that aren't in the table yet. A batch that is run again finds its rows there, so it does nothing.

    Of the table, a batch reads and rewrites the parts that its keys fall in.
    """

    def write(batch: DataFrame, _: int) -> None:
        known = store.read(table, parts=store.touched(table, batch))
        new = unseen(batch, known, list(table.key)).dropDuplicates(list(table.key))
        if new.limit(1).count():
            load(store, table, new)

    return papers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Newest(StatefulProcessor):
    """Each key's newest version and its digest as state; what is new or has changed goes on, repeated and late versions don't."""

    def __init__(self, names: Sequence[str], forget: int):
        self.names, self.forget = list(names), forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "version long, digest long, due long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.newest.get() if self.newest.exists() else None
        best = max(rows, key=lambda r: (r["version__"], r["digest__"]), default=None)
        if best is None or held is not None and (best["version__"], best["digest__"]) <= (held[0], held[1]):
            return
        due = best["version__"] + self.forget
        if held is not None and held[2] != due:
            self.handle.deleteTimer(held[2])
        self.handle.registerTimer(due)
        self.newest.update((best["version__"], best["digest__"], due))
        if held is None or held[1] != best["digest__"]:
            yield Row(**{n: best[n] for n in self.names}, change="new" if held is None else "changed")

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.newest.clear()
        return iter(())


def newest(papers: DataFrame, time: str, keys: Sequence[str], delay: str = "1 day", forget: timedelta = timedelta(days=365)) -> DataFrame:
    """The rows of a stream that are new or differ from their key's newest version so far, with change (new or changed).

    time: when a version was made. A version older than the newest says nothing, whenever it comes; of several in a batch
    the last counts, of equally new ones that of the greatest digest. State is bounded by time, not by the table: a timer
    forgets a key `forget` after its newest version, by the watermark; what comes later is new again, which an upsert
    makes one row of. The state is in the stream's checkpoint, so no batch reads the table, and a stream that is
    restarted gives what it would have given. Needs the state store in RocksDB (`spark.sql.streaming.stateStore.providerClass`).
    """
    rest = [c for c in papers.columns if c not in (*keys, time)]
    told = papers.withColumns({"version__": F.unix_millis(F.col(time).cast("timestamp")), "digest__": F.xxhash64(*rest) if rest else F.lit(0).cast("long")})
    schema = T.StructType([*papers.schema, T.StructField("change", T.StringType())])
    grouped = told.where("version__ is not null").withWatermark(time, delay).groupBy(*keys)
    return grouped.transformWithState(Newest(papers.columns, int(forget.total_seconds() * 1000)), schema, "append", "EventTime")


def keep_newest(papers: DataFrame, store: Store, table: Table, checkpoint: str, time: str = "updated_at", **given):
    """A query that upserts each micro-batch of new and changed papers; a batch that is run again upserts the same rows."""

    def write(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            load(store, table, batch.drop("change"))

    return newest(papers, time, list(table.key), **given).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
