"""Periodic runs of words, found on harmonic grids.

A run with period p and at least ``REPEATS`` periods has at least ``(REPEATS - 1) * p`` words in a row that equal the word p
further on, so one of them stands on the grid of every ``(REPEATS - 1) * p``-th word.  Over all periods the grids have about
``n log n / 3`` points.  In blocks of (period, point) pairs, over many texts together:

1. pairs whose two words differ are dropped at once;
2. how far the words from both places on, and before them, agree is found for all pairs together by binary
   search over prefix hashes, which gives the maximal stretch with period p around the point;
3. stretches found from several points, or under multiples of their period, are one: of equal bounds the smallest period
   stays (by Fine and Wilf's theorem it is the smallest period of the words);
4. the words themselves are compared.  A hash that said too much leaves the exact stretches inside.

Memory is bounded by a block of texts (or the longest text) and ``PAIRS`` pairs.  Nothing is shuffled.

Defined cases: null and empty texts have no words and no runs; a null doc_id keeps its row, and its words stay as they are; repeated rows
get a row each; runs of equal length are told apart by start, then period; texts of any length are taken whole; further columns
are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .store import table

#: A run has so many words and so many periods at least.
LEAST = 6
REPEATS = 4
#: So many (period, grid point) pairs are looked at together.
PAIRS = 1 << 20

Rewrite = Callable[[object, list[bytes]], list[bytes]]


def _agree(total: np.ndarray, back: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """For each pair of places, how many words agree from there on (step 1) or before (step -1); ``most`` at most."""
    low, high = np.zeros(len(x), np.int64), most.copy()
    while (low < high).any():
        mid = (low + high + 1) >> 1
        a, b = (x, y) if step > 0 else (x - mid, y - mid)
        same = (total[a + mid] - total[a]) * back[a] == (total[b + mid] - total[b]) * back[b]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _grids(size: np.ndarray, repeats: int, pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text, period, grid point); a single period's grid is never longer than its text."""
    for lo, hi in _spans(size // repeats, pairs):
        text = np.repeat(np.arange(lo, hi), size[lo:hi] // repeats)
        period = _ranks(size[lo:hi] // repeats) + 1
        points = -(-(size[text] - period) // ((repeats - 1) * period))
        for a, z in _spans(points, pairs):
            n = points[a:z]
            p = np.repeat(period[a:z], n)
            yield np.repeat(text[a:z], n), p, _ranks(n) * (repeats - 1) * p


def _ranks(count: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 for each count."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _spans(weight: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive spans of about ``most`` weight, of one element at least."""
    if len(weight):
        block = np.cumsum(weight) // most
        cut = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(weight)]
        yield from zip(cut, cut[1:])


def find(ids: np.ndarray, first: np.ndarray, least: int = LEAST, repeats: int = REPEATS, pairs: int = PAIRS) -> list[tuple[int, int, int, int]]:
    """Sorted (text, start, period, length) of all runs; ``ids`` numbers the words, ``first`` is each text's first word and the end."""
    power, back = tx.powers(len(ids) + 1)
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(tx.mix(ids.astype(np.uint64), 5) * power[:-1], out=total[1:])
    found = []
    for text, p, i in _grids(np.diff(first), repeats, pairs):
        x = first[text] + i
        live = ids[x] == ids[x + p]
        text, p, x = text[live], p[live], x[live]
        y = x + p
        end = y + _agree(total, back, x, y, first[text + 1] - y, 1)
        start = x - _agree(total, back, x, y, x - first[text], -1)
        long = end - start >= np.maximum(least, repeats * p)
        found.append(np.unique(np.stack([text[long], start[long], end[long], p[long]]), axis=1))
    return _verified(ids, first, np.unique(np.concatenate(found, axis=1), axis=1).T.tolist(), least, repeats) if found else []


def _verified(ids: np.ndarray, first: np.ndarray, claims: list[list[int]], least: int, repeats: int) -> list[tuple[int, int, int, int]]:
    """Claims (text, start, end, period) in order of bounds and period: the smallest period that the words have."""
    out: dict[tuple[int, int, int], int] = {}
    for text, start, end, p in claims:
        if (text, start, end) in out:
            continue
        same = ids[start : end - p] == ids[start + p : end]
        edge = [0, len(same)] if same.all() else [0, *(np.flatnonzero(np.diff(same)) + 1).tolist(), len(same)]
        for a, z in zip(edge, edge[1:]):
            if same[a] and z - a + p >= max(least, repeats * p):
                key = text, start + a, start + z + p
                out[key] = min(p, out.get(key, p))
    return sorted((t, s - int(first[t]), p, e - s) for (t, s, e), p in out.items())


def runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of ``docs(doc_id, text)``.

    ``runs`` lists start, length and period by start, then period; ``collapsed`` has the words that no run repeats, each run's
    first period kept, with one space between them.  ``rewrite`` is given each doc_id and its words and returns the words to look at.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text"):
            words = [t.split() for t in block.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()]
            if rewrite:
                words = [rewrite(i, w) for i, w in zip(block.column("doc_id").to_pylist(), words)]
            size = np.array([len(w) for w in words], np.int64)
            first = np.concatenate([[0], np.cumsum(size)])
            ids = pa.array([w for ws in words for w in ws], pa.large_binary()).dictionary_encode().indices.to_numpy()
            listed: list[list[dict]] = [[] for _ in words]
            for text, start, period, length in find(ids, first, least, repeats):
                listed[text].append({"start": start, "length": length, "period": period})
            left = [b" ".join(collapse(w, r)).decode() for w, r in zip(words, listed)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(size), pa.array(listed, pa.list_(run_type)), pa.array(left, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def collapse(words: list[bytes], found: list[dict]) -> Iterator[bytes] | list[bytes]:
    """The words without those that stand in a run after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for r in found:
        edge[r["start"] + r["period"]] += 1
        edge[r["start"] + r["length"]] -= 1
    return compress(words, (np.cumsum(edge[:-1]) == 0).tolist())


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The contract's words: of one document in ten, those from some word on go round in a cycle."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole document: their number, the longest, and digests of all runs and of what is left."""
    found = runs(table(spark, sf_dir, "documents"), rewrite=planted)
    # The greatest of (length, -start, -period).
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
