"""Mixing sources to target weights by Pfair scheduling (DataFrame operations only).

Each source's documents, in a hash order, form blocks of equal size.  A fluid mixture serves every source at
the rate of its weight among the sources that are not served up yet; block ``j`` of a source is released when
the fluid has served ``j`` of its blocks and due when it has served ``j + 1``, rounded outwards to whole slots.
The fluid itself shows that all blocks can meet their windows, so earliest deadline first among released
blocks does; after any slot each source is less than one block away from its target.  Releases and deadlines
are exact: weights are taken as the fractions that they are.

The driver computes the schedule from the sources' counts.  A block has one ``BLOCKS``-th of all rows, so there
are ``BLOCKS`` blocks and one for each source at most, whatever the number of rows.  Ranks come from counts of
(source, hash bucket) and a window inside a bucket, so a hot source is spread over ``BUCKETS`` tasks.

Defined cases: a null source is a source of its own; a null doc_id is ranked with the others; rows are ordered
by a hash of all columns, and rows that are equal in all take a place each; every source has a lane of its own;
sources of weight zero follow all others, each like any other; a negative weight, or one that is no number, is
an error; an empty table gives an empty result; the operator's columns replace further ones of their names.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from functools import cmp_to_key
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import spare, table

BLOCKS = 1 << 16
BUCKETS = 1024
#: Tables with a row for each source are broadcast up to this number of sources, those with one for each bucket up to fewer.
BROADCAST_SOURCES, BROADCAST_BUCKETS = 100_000, 64


def windows(blocks: dict[int, int], weights: dict[int, float]) -> dict[int, list[tuple[int, int]]]:
    """Release and deadline slot of every block of every source; weights are positive."""
    ratio = {k: float(weights[k]).as_integer_ratio() for k in blocks}
    unit = max((d for _, d in ratio.values()), default=1)
    # Whole numbers in the proportion of the weights: denominators are powers of two.
    whole = {k: n * (unit // d) for k, (n, d) in ratio.items()}
    # The fluid serves a source up when its virtual time is n / w.
    ends = sorted(((n / whole[k], n, whole[k]) for k, n in blocks.items()), key=cmp_to_key(lambda a, b: a[1] * b[2] - b[1] * a[2]))
    near = [e[0] for e in ends]
    served = [0, *accumulate(n for _, n, _ in ends)]
    rate = [0, *accumulate(w for _, _, w in reversed(ends))][::-1]
    out = {}
    for k, n in blocks.items():
        w, edge = whole[k], []
        for j in range(n + 1):
            i = bisect_right(near, j / w)
            while i < len(ends) and ends[i][1] * w <= j * ends[i][2]:
                i += 1
            while i and ends[i - 1][1] * w > j * ends[i - 1][2]:
                i -= 1
            edge.append(served[i] * w + j * rate[i])  # over w
        out[k] = [(x // w, -(-y // w)) for x, y in zip(edge, edge[1:])]
    return out


def schedule(blocks: dict[int, int], weights: dict[int, float]) -> dict[int, list[int]]:
    """The slot of every block: earliest deadline first among the released."""
    out: dict[int, list[int]] = {k: [] for k in blocks}
    base = 0
    for some in ({k: w for k, w in weights.items() if w > 0}, {k: 1.0 for k, w in weights.items() if w == 0}):
        window = windows({k: blocks[k] for k in some}, some)
        coming = [(w[0][0], w[0][1], k, 0) for k, w in window.items() if w]
        heapq.heapify(coming)
        ready: list[tuple[int, int, int]] = []
        slots = sum(map(len, window.values()))
        for slot in range(slots):
            while coming and coming[0][0] <= slot:
                heapq.heappush(ready, heapq.heappop(coming)[1:])
            deadline, k, j = heapq.heappop(ready)
            assert slot < deadline
            out[k].append(base + slot)
            if j + 1 < len(window[k]):
                heapq.heappush(coming, (*window[k][j + 1], k, j + 1))
        base += slots
    return out


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.5, block: int | None = None) -> DataFrame:
    """``docs`` with mix_slot (the block's place) and mix_order (a place of its own for each row).

    weights: target weight by source; a source that it does not name gets the mean of those named.
    Without weights a source's target is its number of rows to the power ``alpha``.
    block: rows of a block; by default a ``BLOCKS``-th of all rows.
    """
    spark = docs.sparkSession
    if weights and not all(0 <= w < float("inf") for w in weights.values()):
        raise ValueError("weights must be numbers of zero or more")
    own = [c for c in docs.columns if c.lower() not in ("mix_slot", "mix_order")]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    lanes = [(r["source"], k, r["count"]) for k, r in enumerate(docs.groupBy("source").count().orderBy(F.desc("count"), "source").collect())]
    if not lanes:
        return docs.withColumns({"mix_slot": F.lit(0).cast("long"), "mix_order": F.lit(0).cast("long")})
    block = block or -(-sum(n for _, _, n in lanes) // BLOCKS)
    if weights:
        rest = sum(weights.values()) / len(weights)
        target = {k: weights.get(source, rest) for source, k, _ in lanes}
    else:
        target = {k: n**alpha for _, k, n in lanes}
    places = schedule({k: -(-n // block) for _, k, n in lanes}, target)

    name, lane, hashed, bucket, before, rank, slot, number = spare(docs, "name", "lane", "hash", "bucket", "before", "rank", "slot", "number")
    few = F.broadcast if len(lanes) <= BROADCAST_SOURCES else (lambda x: x)
    kind = docs.schema["source"].dataType.simpleString()
    known = spark.createDataFrame([(source, k) for source, k, _ in lanes], f"`{name}` {kind}, `{lane}` int")
    spread = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    ranked = docs.join(few(known), F.col("source").eqNullSafe(F.col(name))).drop(name).withColumn(hashed, spread).withColumn(bucket, F.shiftrightunsigned(hashed, 65 - BUCKETS.bit_length()).cast("int"))
    # At most BUCKETS rows of three numbers for each source.
    sizes = ranked.groupBy(lane, bucket).agg(F.count("*").alias(number))
    earlier = Window.partitionBy(lane).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(lane, bucket, F.coalesce(F.sum(number).over(earlier), F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy(lane, bucket).orderBy(hashed, "doc_id")) - 1
    ranked = ranked.withColumn(rank, place).join(F.broadcast(base) if len(lanes) <= BROADCAST_BUCKETS else base, [lane, bucket])
    ranked = ranked.withColumn(rank, F.col(before) + F.col(rank)).withColumn(number, F.floor(F.col(rank) / block).cast("int"))
    # A row for each block: BLOCKS, and one for each source, at most.
    plan = spark.createDataFrame(list(places.items()), f"`{lane}` int, slots array<long>").select(lane, F.posexplode("slots").alias(number, slot))
    found = ranked.join(few(plan), [lane, number])
    return found.select(*[F.col(f"`{c}`") for c in own], F.col(slot).alias("mix_slot"), (F.col(slot) * block + F.col(rank) % block).alias("mix_order"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
