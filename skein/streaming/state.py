"""Keyed state of live feeds, kept by Structured Streaming between micro-batches and over restarts.

Each landed folder part is a micro-batch (a tick).  What a batch gives is written under its number, so a
batch that runs twice leaves one result.  Within a batch rows count in the order of ``seq``; a later batch
counts as later, as arrival decides.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skein.operators.storage import shared_path

#: Fixed value: messages that wait for a subscriber at most.
QUEUE = 500
#: Fixed value: seconds after which a game that nobody saw is dropped.
STALE_SECONDS = 600
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Inside, streams that start keep their state in RocksDB, which these processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _plain(v):
    """A pandas value as state takes it."""
    return None if pd.isna(v) else v.item() if isinstance(v, np.generic) else v


class Patches(StatefulProcessor):
    """The last value of each field that isn't null, by key; a row for each batch that has the key, or that changed it."""

    def __init__(self, key: T.StructType, seq: str, fields: T.StructType, changed_only: bool):
        self.key, self.seq, self.fields, self.changed_only = key, seq, fields, changed_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("fields", self.fields)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest: dict[str, tuple] = {}
        for part in rows:
            for f in self.fields.names:
                known = part[part[f].notna()]
                if len(known):
                    at = known[self.seq].idxmax()
                    if f not in newest or newest[f][0] < known[self.seq][at]:
                        newest[f] = (known[self.seq][at], _plain(known[f][at]))
        was = self.held.get() if self.held.exists() else None
        now = tuple(newest[f][1] if f in newest else (was[i] if was else None) for i, f in enumerate(self.fields.names))
        if was is None or tuple(was) != now:
            self.held.update(now)
        elif self.changed_only:
            return
        yield pd.DataFrame([(*key, *now)], columns=[*self.key.names, *self.fields.names]).astype(object)

    def close(self) -> None:
        pass


class FirstValues(StatefulProcessor):
    """The first value of each key that isn't null, once and for all."""

    def __init__(self, key: T.StructType, seq: str, field: T.StructField):
        self.key, self.seq, self.field = key, seq, field

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("first", T.StructType([self.field]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            return
        first = None
        for part in rows:
            known = part[part[self.field.name].notna()]
            if len(known):
                at = known[self.seq].idxmin()
                found = (known[self.seq][at], _plain(known[self.field.name][at]))
                first = found if first is None or found[0] < first[0] else first
        if first:
            self.held.update((first[1],))
            yield pd.DataFrame([(*key, first[1])], columns=[*self.key.names, self.field.name])

    def close(self) -> None:
        pass


QUEUED = "subscriber long, tick long, seq long, sent long, dropped long, waiting long"


class BoundedQueue(StatefulProcessor):
    """A subscriber's queue.  In each tick messages enter in order while there is room, the newest are dropped, then ``drained`` leave.

    ``rows``: subscriber, tick, seq (null for messages that a partition has dropped already) and n, the messages of the row.
    Gives a row for each message that enters, and one with the counts of the subscriber's tick.
    """

    def __init__(self, capacity: int, drained: int):
        self.capacity, self.drained = capacity, drained

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("queue", "tick long, waiting long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, n, tick = np.zeros(0, np.int64), 0, 0
        for part in rows:  # no more than the queue holds is kept in memory
            own = part["seq"].dropna().to_numpy(np.int64)
            first = np.sort(np.concatenate([first, own]))[: self.capacity]
            n += int(part["n"].sum())
            tick = max(tick, int(part["tick"].max()))
        before, waiting = self.held.get() if self.held.exists() else (tick, 0)
        waiting = max(0, waiting - self.drained * (tick - before - 1)) if before < tick else waiting  # ticks without messages drained too
        entered = first[: self.capacity - waiting]
        left = max(0, waiting + len(entered) - self.drained)
        self.held.update((tick, left))
        yield pd.DataFrame({"subscriber": key[0], "tick": tick, "seq": pd.array([*entered.tolist(), None], "Int64"), "sent": pd.array([None] * len(entered) + [len(entered)], "Int64"), "dropped": pd.array([None] * len(entered) + [n - len(entered)], "Int64"), "waiting": pd.array([None] * len(entered) + [left], "Int64")})

    def close(self) -> None:
        pass


def _early(capacity: int):
    """Before the shuffle: of a batch's messages for a subscriber the first stay, the others are a count."""

    def kept(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.sort_values("seq", kind="stable")
            place = part.groupby(["subscriber", "tick"]).cumcount()
            yield part[place < capacity].assign(n=1)
            rest = part[place >= capacity].groupby(["subscriber", "tick"], as_index=False).size().rename(columns={"size": "n"})
            if len(rest):
                yield rest.assign(seq=pd.array([None] * len(rest), "Int64"))[["subscriber", "tick", "seq", "n"]]

    return kept


def fan_out_queues(updates: DataFrame, subscriptions: DataFrame, key: str, drained: int, capacity: int = QUEUE) -> DataFrame:
    """What each subscriber's bounded queue takes of a stream of ``updates`` (``key``, seq, tick); subscriptions: ``key``, subscriber."""
    met = updates.join(subscriptions, key).select(F.col("subscriber").cast("long").alias("subscriber"), F.col("tick").cast("long").alias("tick"), F.col("seq").cast("long").alias("seq"))
    early = met.mapInPandas(_early(capacity), "subscriber long, tick long, seq long, n long")
    return early.groupBy("subscriber").transformWithStateInPandas(BoundedQueue(capacity, drained), QUEUED, "append", "none")


EVICTED = "game long, part string, last_seen long, value double"


class Sightings(StatefulProcessor):
    """Games that were last seen longer ago than ``seconds`` go, with all that depends on them.

    ``rows``: game, ts, at (ts in microseconds), part (null for a sighting, else the name of a dependant) and value.
    A dependant keeps its first value.  When event time passes, a timer gives a row for the game and one for each dependant, and both
    are forgotten; a row that is older than that time is late and revives nothing.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long")
        self.parts = handle.getMapState("parts", "part string", "value double")

    def _evict(self, key) -> Iterator[pd.DataFrame]:
        at = self.seen.get()[0]
        gone = [(key[0], None, at, None)] + [(key[0], p[0], at, v[0]) for p, v in self.parts.iterator()]
        self.seen.clear()
        self.parts.clear()
        yield pd.DataFrame(gone, columns=["game", "part", "last_seen", "value"])

    def _due(self, now_ms: int) -> bool:
        return self.seen.exists() and self.seen.get()[0] // 1000 + 1000 * self.seconds < now_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self._due(timerValues.getCurrentWatermarkInMs()):
            yield from self._evict(key)
        last, first = None, {}
        for part in rows:
            sighted = part[part["part"].isna()]
            if len(sighted):
                newest = int(sighted["at"].max())
                last = newest if last is None else max(last, newest)
            own = part[part["part"].notna()].sort_values("at", kind="stable").drop_duplicates("part")
            for name, at, value in zip(own["part"], own["at"], own["value"], strict=True):
                if name not in first or at < first[name][0]:
                    first[name] = (at, float(value))
        for name, (_, value) in first.items():
            if not self.parts.containsKey((name,)):
                self.parts.updateValue((name,), (value,))
        if last is not None:
            was = self.seen.get()[0] if self.seen.exists() else None
            if was is None or last > was:
                if was is not None:
                    self.handle.deleteTimer(was // 1000 + 1000 * self.seconds + 1)
                self.seen.update((last,))
                self.handle.registerTimer(last // 1000 + 1000 * self.seconds + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._due(timerValues.getCurrentWatermarkInMs()):
            yield from self._evict(key)

    def close(self) -> None:
        pass


def evicted(sightings: DataFrame, seconds: int = STALE_SECONDS) -> DataFrame:
    """A stream of evictions; ``sightings``: game, ts, part, value."""
    ts = F.col("ts").cast("timestamp")
    rows = sightings.select(F.col("game").cast("long").alias("game"), ts.alias("ts"), F.unix_micros(ts).alias("at"), "part", F.col("value").cast("double").alias("value"))
    gone = rows.withWatermark("ts", "0 seconds").groupBy("game").transformWithStateInPandas(Sightings(seconds), EVICTED, "append", "eventTime")
    return gone.withColumn("last_seen", F.timestamp_micros("last_seen"))


def patched(rows: DataFrame, keys: list[str], seq: str, fields: list[str], changed_only: bool = False) -> DataFrame:
    """T02 (T04 with ``changed_only``): a stream of the keys' rows after each patch."""
    of = lambda names: T.StructType([T.StructField(rows.schema[n].name, rows.schema[n].dataType) for n in names])
    return rows.groupBy(*keys).transformWithStateInPandas(Patches(of(keys), seq, of(fields), changed_only), of([*keys, *fields]), "update", "none")


def first_values(rows: DataFrame, keys: list[str], seq: str, field: str) -> DataFrame:
    """A stream of each key's first value that isn't null."""
    of = lambda names: T.StructType([T.StructField(rows.schema[n].name, rows.schema[n].dataType) for n in names])
    return rows.groupBy(*keys).transformWithStateInPandas(FirstValues(of(keys), seq, of([field])[0]), of([*keys, field]), "append", "none")


class Ticks:
    """A folder into which parts of a feed land one after another, and the stream over it.

    ``run`` starts the stream anew from its checkpoint for all that has landed since, so each call is a restart.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType):
        self.spark, self.schema = spark, schema
        self.folder, self.checkpoint, self.out = (shared_path(spark, x) for x in ("ticks", "state", "results"))
        self.result: T.StructType | None = None

    def land(self, part: DataFrame) -> None:
        part.write.mode("append").parquet(self.folder)

    def run(self, made: Callable[[DataFrame], DataFrame], mode: str, each: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
        """One start of the stream that ``made`` gives; ``each`` changes a batch before it is written."""
        with state_store(self.spark):
            stream = made(self.spark.readStream.schema(self.schema).parquet(self.folder))

            def written(batch: DataFrame, number: int) -> None:
                out = each(batch, number) if each else batch
                self.result = out.schema
                out.write.mode("overwrite").parquet(f"{self.out}/batch={number}")

            query = stream.writeStream.foreachBatch(written).outputMode(mode).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()

    def results(self) -> DataFrame:
        """What all batches gave, with their numbers as ``batch``."""
        return self.spark.read.schema(T.StructType([*self.result.fields, T.StructField("batch", T.LongType())])).option("basePath", self.out).parquet(self.out)


def replayed(rows: DataFrame, tick: str, ticks: int, made: Callable[[DataFrame], DataFrame], mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """``rows`` land tick by tick (0 to ``ticks`` - 1 of the column); the stream is started again for each."""
    feed = Ticks(rows.sparkSession, rows.schema)
    for i in range(ticks):
        feed.land(rows.filter(F.col(tick) == i))
        feed.run(made, mode, each)
    return feed.results()
