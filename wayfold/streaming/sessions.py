"""Sessions and staleness as streams: state of each route or device, with timers.

:func:`wayfold.operators.walks.session` defines the semantics; the stream gives the same rows for ticks that come out of order
within the watermark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.walks import BEGIN, tick
from ..sources.tables import ensure_checkpoints

#: State with timers is kept by this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: A route's session, the ticks that wait (a column of arrays for each field of a tick) and when its timer goes off: one value, as each call to the store is a round trip.
SESSION = "leg int, speed double, done double, entered double, last double, wake long, passed double, lengths array<double>, t array<double>, moving array<boolean>, still array<boolean>, answer array<string>"

TICK = ["t", "moving", "still", "answer"]
PACK = "route long, last double, t array<double>, moving array<boolean>, still array<boolean>, answer array<string>, lengths array<double>"


class _Session(StatefulProcessor):
    """Ticks wait until the watermark has passed them, and then go on in order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", SESSION)

    def _keep(self, state: tuple, passed: float, lengths: list[float], ticks: list[tuple], before: int | None) -> None:
        """One timer stands at the first tick that waits; before: when the one that stands now goes off."""
        # A timer goes off once the watermark has reached it.
        wake = max(int(-(-min(r[0] for r in ticks) * 1000 // 1)), 1) if ticks else None
        self.state.update((*state, wake, passed, list(lengths), *([r[i] for r in ticks] for i in range(4))))
        if before != wake:
            if before is not None:
                self.handle.deleteTimer(before)
            if wake is not None:
                self.handle.registerTimer(wake)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came, held = list(rows), self.state.get()
        *state, wake, passed, lengths, t, moving, still, answer = held or (*BEGIN, None, float("-inf"), came[0].lengths, [], [], [], [])
        if state[0] < len(lengths):
            # What comes behind a watermark that the session has passed is too late.
            fresh = [x for r in came for x in zip(r.t, r.moving, r.still, r.answer) if x[0] > passed]
            self._keep(tuple(state), passed, lengths, [*zip(t, moving, still, answer), *fresh], wake)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        *state, _, _, lengths, t, moving, still, answer = self.state.get()
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        ticks = sorted(zip(t, moving, still, answer), key=lambda r: (r[0], r[1], r[2], r[3] is not None, r[3] or ""))
        left = [r for r in ticks if r[0] > passed]
        for r in (r for r in ticks if r[0] <= passed):
            if state[0] >= len(lengths):
                left = []
                break
            state, event = tick(tuple(state), *r, lengths)
            if event:
                yield Row(route=key[0], t=r[0], event=event[0], leg=event[1], speed=event[2])
        # The timer that has gone off is removed by Spark.
        self._keep(tuple(state), passed, lengths, left, None)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ticks of a route in a batch as one row, with the time of the last."""
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.sort_by([("route", "ascending"), ("t", "ascending")])
        route = batch.column("route").to_numpy(zero_copy_only=False)
        head = np.flatnonzero(np.append(True, route[1:] != route[:-1]))
        edge = pa.array(np.append(head, len(route)).astype(np.int32))
        own = pa.array(head)
        last = batch.column("t").take(pa.array(np.append(head[1:], len(route)) - 1))
        lists = [pa.ListArray.from_arrays(edge, batch.column(c)) for c in TICK]
        yield pa.RecordBatch.from_arrays([batch.column("route").take(own), last, *lists, batch.column("lengths").take(own)], ["route", "last", *TICK, "lengths"])


def sessions(ticks: DataFrame, late: str = "1 minute") -> DataFrame:
    """(route, t, event, leg, speed) of a stream ``ticks(route, t, moving, still, answer, lengths)``, in append mode: each event once the watermark has passed it.

    Ticks without a time or a route are left out.  A route's ticks go to its state a batch at a time, not one by one.
    """
    known = ticks.where("t IS NOT NULL AND route IS NOT NULL").select(F.col("route").cast("long").alias("route"), *TICK, "lengths")
    packs = known.mapInArrow(_packed, PACK)
    df = packs.select("route", F.timestamp_seconds("last").alias("at"), *TICK, "lengths").withWatermark("at", late)
    return df.groupBy("route").transformWithState(_Session(), "route long, t double, event string, leg int, speed double", "Append", "EventTime")


class _Staleness(StatefulProcessor):
    """Says when a device's packets stop, by the clock, and when they come again."""

    def __init__(self, seconds: float, forget_s: float):
        self.most, self.forget = int(seconds * 1000), int(forget_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fresh = handle.getValueState("fresh", "fresh boolean, packets long", ttlDurationMs=self.forget)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n = sum(1 for _ in rows)
        before, packets = tuple(self.fresh.get()) if self.fresh.exists() else (False, 0)
        self.fresh.update((True, packets + n))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.most)
        if not before:
            yield Row(device_id=key[0], stale=False, packets=packets + n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        packets = self.fresh.get()[1] if self.fresh.exists() else 0
        self.fresh.update((False, packets))
        yield Row(device_id=key[0], stale=True, packets=packets)


def staleness(rows: DataFrame, seconds: float = 2.0, forget_s: float = 3600.0) -> DataFrame:
    """(device_id, stale, packets): a row when a device's first packet comes, when none has come for ``seconds``, and when one comes again.

    A timer of processing time says that packets have stopped, without a packet; a device that is not heard of for ``forget_s`` is forgotten.
    """
    return rows.select("device_id").groupBy("device_id").transformWithState(_Staleness(seconds, forget_s), "device_id long, stale boolean, packets long", "Append", "ProcessingTime")


def written(rows: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there, into Parquet in the shared folder, and read what it has written."""
    spark = rows.sparkSession
    folder = _folder(spark, name)
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        q = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def _folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
