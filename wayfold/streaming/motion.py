"""Live sensor rows: a UDP source, event-time counts, and per-device state.

The batch operators define the semantics; on the same ordered rows these give the same result.
"""

from __future__ import annotations

import json
import socket
import threading
import time
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import telemetry as te

ROW = "device_id long, event_id long, t double, mag double"


class _Datagrams(SimpleDataSourceStreamReader):
    """Datagrams kept in order of arrival; an offset is how many have come."""

    def __init__(self, host: str, port: int):
        self.rows: deque = deque()
        self.first = 0
        self.lock = threading.Lock()
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.bind((host, port))
        self.socket.settimeout(0.5)
        threading.Thread(target=self._listen, daemon=True).start()

    def _listen(self) -> None:
        while True:
            try:
                data, _ = self.socket.recvfrom(65_535)
            except TimeoutError:
                continue
            except OSError:
                return
            with self.lock:
                self.rows.append((time.time(), data.decode("utf-8", "replace")))

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator, dict]:
        with self.lock:
            out = list(self.rows)[start["n"] - self.first :]
        return iter(out), {"n": start["n"] + len(out)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator:
        with self.lock:
            return iter(list(self.rows)[start["n"] - self.first : end["n"] - self.first])

    def commit(self, end: dict) -> None:
        with self.lock:
            while self.first < end["n"]:
                self.rows.popleft()
                self.first += 1


class UdpSource(DataSource):
    """``spark.readStream.format("telemetry_udp").option("port", ...)``: (received double, body string) a datagram."""

    @classmethod
    def name(cls) -> str:
        return "telemetry_udp"

    def schema(self) -> str:
        return "received double, body string"

    def simpleStreamReader(self, schema) -> _Datagrams:
        return _Datagrams(self.options.get("host", "0.0.0.0"), int(self.options.get("port", "8000")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(UdpSource)


def send(rows: list[dict], host: str, port: int) -> int:
    """Send samples as JSON datagrams; how many went."""
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for r in rows:
            s.sendto(json.dumps(r).encode(), (host, port))
    return len(rows)


def stationary_stream(rows: DataFrame, settings: dict, window: int = te.WINDOW_ROWS) -> DataFrame:
    """(device_id, event_id, still) in append mode: the detector with its window and timers as state of each device."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values, below, above, still = state.get if state.exists else ([], None, None, False)
        values = list(values)
        out = []
        pdf = pd.concat(list(batches)).sort_values(["t", "event_id"])
        for r in pdf.itertuples():
            values = [*values, r.mag][-window:]
            mean = sum(values) / len(values)
            var = sum((v - mean) ** 2 for v in values) / len(values) if len(values) > 1 else 0.0
            below = (r.t if below is None else below) if var < settings["below"] else None
            above = (r.t if above is None else above) if var > settings["above"] else None
            if still and above is not None and r.t - above >= settings["moving_hold"]:
                still = False
            elif not still and below is not None and r.t - below >= settings["still_hold"]:
                still = True
            out.append((key[0], r.event_id, still))
        state.update((values, below, above, still))
        yield pd.DataFrame(out, columns=["device_id", "event_id", "still"])

    return rows.groupBy("device_id").applyInPandasWithState(step, "device_id long, event_id long, still boolean", "v array<double>, below double, above double, still boolean", "append", GroupStateTimeout.NoTimeout)


def counts(rows: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Rows and mean of each device and window of event time, with a watermark."""
    df = rows.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", late)
    return df.groupBy("device_id", F.window("at", width)).agg(F.count("*").alias("n"), F.avg("mag").alias("mean"))


def drain(rows: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote to memory."""
    q = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows.sparkSession.table(name)
