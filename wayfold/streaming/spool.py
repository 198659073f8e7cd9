"""Datagrams by way of a spool: receivers write files, executors read them.

A receiver runs wherever the phones' packets arrive, as many as there are ports; it keeps no more than the file it is writing.  The
stream is Spark's own file source over the folder: files are partitions on executors, offsets are in the checkpoint, and a
batch that failed reads the same files again.
"""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROW = "received double, body string"


def receive(folder: str, host: str, port: int, running: Callable[[], bool], roll_s: float = 1.0, roll_rows: int = 10_000) -> int:
    """Write datagrams to files of ``folder`` while ``running()``; how many came.  A file is seen whole or not at all."""
    os.makedirs(folder, exist_ok=True)
    rows: list[str] = []
    count, began = 0, time.monotonic()

    def roll() -> None:
        if rows:
            name = f"{time.time_ns()}-{uuid.uuid4().hex}.json"
            # Spark passes over names that begin with a dot.
            with open(f"{folder}/.{name}", "w", encoding="utf-8") as f:
                f.write("\n".join(rows) + "\n")
            os.replace(f"{folder}/.{name}", f"{folder}/{name}")
            rows.clear()

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind((host, port))
        s.settimeout(min(0.2, roll_s))
        while running():
            try:
                data, _ = s.recvfrom(65_535)
                rows.append(json.dumps({"received": time.time(), "body": data.decode("utf-8", "replace")}))
                count += 1
            except TimeoutError:
                pass
            if len(rows) >= roll_rows or time.monotonic() - began >= roll_s:
                roll()
                began = time.monotonic()
        roll()
    return count


def spooled(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """(received, body): a row for each datagram, in a stream; what a payload yields :func:`wayfold.sources.payloads.samples` says."""
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", files_a_batch).json(folder)
