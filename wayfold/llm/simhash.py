"""SimHash near-duplicates, found through deletion-variant signatures.

The 64 bits are cut into ``most_bits // 2 + 1`` segments, so that of two fingerprints within
``most_bits`` one segment differs by at most one bit.  Every fingerprint is indexed under each
segment with each of its bits wildcarded; equal keys are joined and the pairs verified.

Only distinct fingerprints are indexed.  Rows (fingerprint, key) are dealt by key and sorted, and a worker
reads them as a stream: the members of a key are compared with each other, and links that join them are
kept, not all pairs.  A key held by more than ``CROWD`` fingerprints would cost the
square of their number, so their fingerprints go another, exact way: each lists the points
within ``most_bits // 2`` bits of it.  Two fingerprints within ``most_bits`` have such a point in
common, and all that list one point are within ``most_bits`` of each other, so each links to the
point's smallest: a row for each listed point, an aggregation with partial minima, no pairs.
``CROWD`` is about where both ways cost alike: 2,081 rows to shuffle, or comparing with half of a
key's members under 64 keys.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows get
a row each; a null doc_id keeps its row and is never the smallest of a component that has another;
texts of any length are hashed whole; further columns are left out; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .jaccard import similar
from .store import cut, discard, identity, lanes, table

SEED = 42
CROWD = 1024
#: Up to so many members of a key give their pairs; more give a tree.
FEW = 8
#: So many crowded fingerprints are spread to their points at once, and so many rows sent on.
PART, ROWS_OUT = 1024, 1 << 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints_of(column: pa.Array, n: int = 4) -> np.ndarray:
    """Fingerprint (uint64) of each text's n-word shingles."""
    texts = column.cast(pa.large_binary()).fill_null(b"").to_pylist()
    out = np.zeros(len(texts), np.uint64)
    hash_of = xxhash.xxh64_intdigest
    hashes: list[int] = []
    count = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.translate(_LOWER).split()
        if not words:
            continue
        whole = b" ".join(words)
        if len(words) <= n:
            hashes.append(hash_of(whole, SEED))
            count[i] = 1
            continue
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = end - size
        hashes += [hash_of(whole[a:z], SEED) for a, z in zip(start[: len(words) - n + 1].tolist(), end[n - 1 :].tolist())]
        count[i] = len(words) - n + 1
    if not hashes:
        return out
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    has = np.flatnonzero(count)
    end = np.cumsum(count[has])
    set_bits = np.stack([bits[z - n : z].sum(axis=0, dtype=np.int64) for n, z in zip(count[has].tolist(), end.tolist())])
    over = 2 * set_bits > count[has, None]
    out[has] = np.packbits(over, axis=1).reshape(-1, 8).copy().view(">u8").ravel()
    return out


def fingerprint(docs: DataFrame, *also: str, words: int = 4) -> DataFrame:
    """The columns named in ``also`` and ``fp`` (the fingerprint as a signed long), a row for each row."""
    kept = docs.select(*dict.fromkeys([*also, "text"]))
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in also) + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in also), pa.array(fingerprints_of(block.column("text"), words).view(np.int64))], [*also, "fp"])

    return kept.mapInArrow(run, schema)


def segments(most_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of each segment; two at least, so that a key has 32 bits at most."""
    n = max(2, most_bits // 2 + 1)
    edge = [64 * i // n for i in range(n + 1)]
    return [(a, z - a) for a, z in zip(edge, edge[1:])]


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def variants(fp: Column, most_bits: int) -> Column:
    """Array of keys: for each segment and each of its bits, the segment without that bit, tagged by segment and bit."""
    keys = []
    for low, size in segments(most_bits):
        for bit in range(low, low + size):
            mask = ((1 << size) - 1) << low & ~(1 << bit)
            part = F.shiftrightunsigned(fp.bitwiseAND(F.lit(_signed(mask))), low)
            # The tag stands above the part.
            keys.append(part.bitwiseOR(F.lit((bit + 1) << 48)))
    return F.array(*keys)


def near(fps: DataFrame, most_bits: int = 4, crowd: int = CROWD) -> DataFrame:
    """Links (src, dst) between distinct fingerprints ``fps(fp)`` whose components are those of all pairs within ``most_bits``."""
    dealt = fps.select("fp").repartition(lanes(fps.sparkSession), "fp")
    keyed = dealt.select("fp", F.explode(variants(F.col("fp"), most_bits)).alias("key"))
    keyed = keyed.repartition(lanes(fps.sparkSession), "key").sortWithinPartitions("key")
    links = cut(keyed.mapInArrow(lambda x: _meet(x, most_bits, crowd), "src long, dst long"), "met")
    # A link to itself says that one of the fingerprint's keys is crowded.
    crowded = links.where("src = dst").select(F.col("src").alias("fp")).distinct()
    return links.where("src <> dst").unionByName(midpoints(crowded, most_bits))


def _meet(batches: Iterator[pa.RecordBatch], most_bits: int, crowd: int) -> Iterator[pa.RecordBatch]:
    """The verified links of each key's members, from rows (fp, key) in order of keys; members of a key of more than ``crowd`` link to themselves."""
    fp, key = np.zeros(0, np.int64), np.zeros(0, np.int64)
    past: int | None = None  # the crowded key whose first members are gone

    def settle(fp: np.ndarray, key: np.ndarray, past: int | None) -> pa.RecordBatch:
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(key)))
        over = (size > crowd) | (key[head] == past if past is not None else False)
        own = np.repeat(over, size)
        src, dst = [fp[own]], [fp[own]]
        # Members of small keys meet at every distance in the order of the rows, others as a matrix of their key.
        run = np.repeat(np.arange(len(head)), size)
        small = np.flatnonzero(np.repeat(~over & (size > 1) & (size <= FEW), size))
        for step in range(1, FEW):
            a, b = small[:-step], small[step:]
            hit = (run[a] == run[b]) & (np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= most_bits)
            src.append(fp[a[hit]])
            dst.append(fp[b[hit]])
        for i in np.flatnonzero(~over & (size > FEW)):
            for a, b in _forest(fp[head[i] : head[i] + size[i]], most_bits):
                src.append(a)
                dst.append(b)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    for batch in batches:
        fp, key = np.concatenate([fp, batch.column("fp").to_numpy()]), np.concatenate([key, batch.column("key").to_numpy()])
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        if len(key) - last > crowd or key[-1] == past:
            # The last key is crowded already: what is here of it may go.
            now, last = int(key[-1]), len(key)
        else:
            now = None
        yield settle(fp[:last], key[:last], past)
        past = now
        fp, key = fp[last:], key[last:]
    if len(key):
        yield settle(fp, key, past)


def _forest(fp: np.ndarray, most_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A link from each member of a key to the smallest that it reaches by verified pairs."""
    bits = fp.view(np.uint64)
    near_by = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= most_bits
    label = np.arange(len(fp))
    while True:
        low = np.where(near_by, label[None, :], len(fp)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    on = np.flatnonzero(label != np.arange(len(fp)))
    yield fp[on], fp[label[on]]


def midpoints(fps: DataFrame, most_bits: int) -> DataFrame:
    """The links of crowded fingerprints, through the points within half the distance of each."""
    if most_bits % 2:
        raise ValueError("most_bits must be even")
    reach = most_bits // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.uint64(1) << np.arange(64, dtype=np.uint64)
        masks = [np.zeros(1, np.uint64)]
        for _ in range(reach):
            masks.append(np.unique((masks[-1][:, None] ^ one[None, :]).ravel()))
        ball = np.unique(np.concatenate(masks))
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for a in range(0, len(fp), PART):
                part = fp[a : a + PART]
                point = (part[:, None] ^ ball[None, :]).ravel()
                owner = np.repeat(part.view(np.int64), len(ball))
                order = np.argsort(point, kind="stable")
                point, owner = point[order], owner[order]
                head = np.append(True, point[1:] != point[:-1])
                low = np.minimum.reduceat(owner, np.flatnonzero(head))
                rows = pa.RecordBatch.from_arrays([pa.array(point.view(np.int64)), pa.array(owner), pa.array(low[np.cumsum(head) - 1])], ["point", "fp", "low"])
                for b in range(0, rows.num_rows, ROWS_OUT):
                    yield rows.slice(b, ROWS_OUT)

    listed = fps.mapInArrow(run, "point long, fp long, low long")
    # Within a block the smallest of a point is known: its own links, and one row of the block for the point.
    listed = cut(listed, "points")
    own = listed.where("fp <> low").select(F.col("fp").alias("src"), F.col("low").alias("dst")).distinct()
    heads = listed.where("fp = low").select("point", "fp").distinct()
    lowest = heads.groupBy("point").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("point", "low")
    cross = heads.join(lowest, "point").where("fp <> low").select(F.col("fp").alias("src"), F.col("low").alias("dst")).distinct()
    return own.unionByName(cross)


def near_duplicates(docs: DataFrame, *also: str, most_bits: int = 4, words: int = 4, similarity: float | None = None) -> DataFrame:
    """doc_id, ``also``, fp, root (one fingerprint of the component) and component_id (its smallest doc_id) of every row.

    similarity: texts whose five-word shingles have this Jaccard similarity or more are linked too.
    ``also`` may not name fp, root, component_id, low or xt.
    """
    if similarity is not None:
        docs = docs.select(*dict.fromkeys(["doc_id", *also, "text"]), F.struct(*(h.alias(n) for h, n in zip(identity("text"), "ab"))).alias("xt"))
        also = (*also, "xt")
    found = cut(fingerprint(docs, *dict.fromkeys(["doc_id", *also]), words=words), "fingerprints")
    fps = cut(found.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    pairs = near(fps, most_bits)
    if similarity is not None:
        alike = cut(similar(docs, similarity), "similar")
        fp_of = found.select("xt", "fp").distinct()
        for end in ("src", "dst"):
            alike = alike.join(fp_of.withColumnRenamed("xt", end), end).drop(end).withColumnRenamed("fp", f"{end}_fp")
        pairs = pairs.unionByName(alike.select(F.col("src_fp").alias("src"), F.col("dst_fp").alias("dst")))
    links = components(pairs)
    # Of each fingerprint its component's root, then of each root the smallest doc_id.
    rooted = fps.join(links, fps["fp"] == links["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    rooted = cut(rooted, "roots")
    discard(links)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = rooted.join(lowest, "root").select("fp", "root", "component_id")
    return found.join(by_fp, "fp")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
