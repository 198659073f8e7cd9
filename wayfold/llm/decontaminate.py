"""Benchmark decontamination: CGK embedding, bit sampling, exact edit verification.

Texts are folded (ASCII lower case, white space runs to one space).  A window begins at every word of every
item and of every document.  A CGK walk reads a window at its pointer and moves on by a random bit that
depends on the step and the byte read; the bytes read have small Hamming distance where the edit
distance was small, and differ in runs, until the pointers meet again.  A bit sample leaves out ``gap`` places that
follow each other; samples stand so close that any run of ``run`` places is left out by one: walks that differ
in one such run agree in some sample for certain.  Windows go by classes of items' lengths (``CLASSES``): short items are walked
in short windows, so that as many of their windows are free of all but one edit.  An item has a window at every
word, and one that agrees is enough; of walks over a whole item with edits in a fifth of its bytes no number
of samples would agree.

Keys of documents pass a Bloom filter of the items' keys; those that do become regions, which meet the items in
an equality join, and each (region, item) pair is verified by the exact edit distance between the item and its
best match about the places where windows agree.  Of so many items that the filter would let most keys on, the keys are
taken in parts, each with a filter and a pass of its own.

Items are also indexed by their runs of ``GRAM`` tokens (letters, digits and bytes beyond ASCII), all their
tokens where they have fewer: an exact copy that stands on token boundaries has them all, however short it is.

Defined cases: null and empty texts and items match nothing; a null doc_id or item_id is kept as null; repeated
rows count as one pair, the best; of items that share an id each counts; texts of any length are walked whole, and a
document full of hits is cut into regions of ``REGION`` reaches at most, which overlap; ties between matches do not
show, as the distance is all that is told; an empty table on either side gives an empty result; further
columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .store import cut, identity, table



class Walk(NamedTuple):
    """How items of up to ``most`` bytes are walked, and the number that tells its keys from others'."""

    most: float
    steps: int
    gap: int
    run: int
    number: int

    @property
    def out(self) -> list[int]:
        """Where samples leave places out."""
        return [*range(0, self.steps - self.gap, self.gap - self.run + 1), self.steps - self.gap]


#: For items within 0.8, so that nine copies of ten share a key at 20 % edits and nearly all at fewer.  Short walks meet
#: much ordinary text, so they are for items that are too short for the long one.
CLASSES = (Walk(50, 16, 5, 4, 2), Walk(80, 20, 6, 4, 1), Walk(float("inf"), 32, 8, 6, 0))
STEPS = max(w.steps for w in CLASSES)
GRAM = 4
SIMILARITY = 0.8
#: Bits of the Bloom filter for each key, its probes, and the most bits (as a power of two).
FILTER_SHARE, PROBES, MOST_FILTER_BITS, COARSE_BITS = 64, 4, 26, 21
#: With fewer bits for each key the keys are taken in parts.
LEAST_SHARE = 16
#: A region is so many times as long as the longest item may reach, at most.
REGION = 8
#: Item keys are broadcast up to this number of rows (counted first); beyond it the join shuffles.
BROADCAST_ROWS = 500_000

_RANDOM = np.random.default_rng(99)
_MOVE = _RANDOM.integers(0, 2, (STEPS, 256)).astype(np.int32)
#: A place's byte counts by this factor.
_FACTOR = _RANDOM.integers(1, 2**63, STEPS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 4096
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[tx.SPACE] = 32
_TOKEN = np.full(256, 32, np.uint8)
_TOKEN[128:] = np.arange(128, 256)
_TOKEN[48:58] = np.arange(48, 58)
_TOKEN[97:123] = np.arange(97, 123)


def fold(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded texts, end to end and then zero bytes for a walk, and where each begins (one more than texts)."""
    b = _FOLD[buf]
    space = b == 32
    twice = np.zeros(len(b), bool)
    twice[1:] = space[1:] & space[:-1]
    twice[at[:-1][np.diff(at) > 0]] = False
    if twice.any():
        at = np.concatenate([[0], np.cumsum(tx.per_text(~twice, at))])
        b = b[~twice]
    return np.concatenate([b, np.zeros(STEPS, np.uint8)]), at


def keys(buf: np.ndarray, at: np.ndarray, walk: Walk = CLASSES[-1]) -> np.ndarray:
    """Keys of the windows at ``at``: an array of (windows, samples of the walk)."""
    out = np.empty((len(at), len(walk.out)), np.uint64)
    for a in range(0, len(at), _CHUNK):
        part = at[a : a + _CHUNK]
        # Sums of the places before each step: a sample is the whole without the places it leaves out.
        before = np.zeros((walk.steps + 1, len(part)), np.uint64)
        byte, term, move = np.empty(len(part), np.uint8), np.empty(len(part), np.uint64), np.empty(len(part), np.int32)
        pos = part.astype(np.int32)
        for j in range(walk.steps):
            np.take(buf, pos, out=byte, mode="clip")
            np.multiply(byte, _FACTOR[j], out=term, casting="unsafe")
            np.add(before[j], term, out=before[j + 1])
            np.take(_MOVE[j], byte, out=move, mode="clip")
            pos += move
        for s, o in enumerate(walk.out):
            key = before[walk.steps] - before[o + walk.gap] + before[o]
            out[a : a + len(part), s] = tx.mix(key, walk.number * 100 + s + 1)
    return out


def grams(buf: np.ndarray, begin: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position and key of every run of so many tokens, its size, and each text's number of tokens."""
    start, end, first = tx.words(_TOKEN[buf[: begin[-1]]], begin)
    token = tx.span_hash(buf, start, end)
    pos, key, size = [], [], []
    for n in sizes:
        at = tx.within(first, n)[0]
        pos.append(start[at])
        key.append(tx.mix(tx.gram_hash(token, n)[at], 40 + n))
        size.append(np.full(len(at), n))
    return np.concatenate(pos), np.concatenate(key), np.concatenate(size), np.diff(first)


def item_keys(items: DataFrame) -> DataFrame:
    """(i1, i2, key, off, gram) of ``items(i1, i2, text)``: the keys of an item's windows and runs, and where in it these begin; gram is the tokens of a key of a run, or no more than 0, a walk's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text", 1 << 16):
            buf, begin = fold(*tx.raw(block.column("text")))
            at = tx.words(buf[: begin[-1]], begin)[0]
            if not len(at):
                continue
            length = np.array([len(buf[a:z].tobytes().strip()) for a, z in zip(begin[:-1], begin[1:])])[np.searchsorted(begin, at, side="right") - 1]
            least, some = 0, []
            for walk in CLASSES:
                own_at = at[(length > least) & (length <= walk.most)]
                least = walk.most
                found = keys(buf, own_at, walk)
                some.append((np.repeat(own_at, found.shape[1]), found.ravel(), np.full(found.size, -walk.number)))
            pos, run_key, size, tokens = grams(buf, begin, list(range(1, GRAM + 1)))
            own = size == np.minimum(tokens[np.searchsorted(begin, pos, side="right") - 1], GRAM)
            some.append((pos[own], run_key[own], size[own]))
            at, key, gram = (np.concatenate(x) for x in zip(*some))
            key, gram = key.view(np.int64), gram.astype(np.int32)
            row = np.searchsorted(begin, at, side="right") - 1
            head = np.array([len(x) - len(x.lstrip()) for x in (buf[a:z].tobytes() for a, z in zip(begin[:-1], begin[1:]))])
            off = (at - begin[row] - head[row]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(block.column(c).take(pa.array(row)) for c in ("i1", "i2")), pa.array(key), pa.array(off), pa.array(gram)], ["i1", "i2", "key", "off", "gram"])

    return items.select("i1", "i2", "text").mapInArrow(run, "i1 long, i2 long, key long, off int, gram int").dropDuplicates(["i1", "i2", "key", "off"])


def folded(items: DataFrame) -> DataFrame:
    """(i1, i2, item_id, item): every item's folded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text"):
            buf, begin = fold(*tx.raw(block.column("text")))
            text = [buf[a:z].tobytes().strip() for a, z in zip(begin[:-1], begin[1:])]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in ("i1", "i2", "item_id")), pa.array(text, pa.binary())], ["i1", "i2", "item_id", "item"])

    return items.select("i1", "i2", "item_id", "text").mapInArrow(run, f"i1 long, i2 long, item_id {items.schema['item_id'].dataType.simpleString()}, item binary")


def regions(docs: DataFrame, passes: tuple[np.ndarray, np.ndarray], bits: int, reach: int, sizes: list[int], walks: list[Walk], part: int = 0, parts: int = 1) -> DataFrame:
    """(doc_id, hits, region): stretches of documents about windows, and runs of ``sizes`` tokens, that pass the filter, with their keys and places."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, coarse = (np.unpackbits(x, bitorder="little").view(bool) for x in passes)
        for block in tx.blocks(batches, "text"):
            buf, begin = fold(*tx.raw(block.column("text")))
            at = tx.words(buf[: begin[-1]], begin)[0]
            listed = []
            for walk in walks:
                found = keys(buf, at, walk)
                listed.append((found.ravel(), np.repeat(at, found.shape[1])))
            if sizes:
                run_pos, run_key, _, _ = grams(buf, begin, sizes)
                listed.append((run_key, run_pos))
            passed = []
            for key, place in listed:
                # A small table of the keys' highest bits, which fits a core's cache, lets few others on to the filter.
                hit = np.flatnonzero(coarse[(key >> np.uint64(64 - COARSE_BITS)).view(np.int64)])
                if parts > 1:
                    hit = hit[key[hit].view(np.int64) % parts == part]
                for p in range(PROBES):
                    hit = hit[known[((key[hit] >> np.uint64(9 * p)) & np.uint64((1 << bits) - 1)).view(np.int64)]]
                passed.append((key[hit], place[hit]))
            key, place = (np.concatenate(x) for x in zip(*passed))
            if not len(key):
                continue
            order = np.argsort(place, kind="stable")
            key, place = key[order].view(np.int64), place[order]
            doc = np.searchsorted(begin, place, side="right") - 1
            # A region ends where the next hit is far, or after REGION reaches; what is cut overlaps by twice the reach.
            rows, lists, texts = [], [], []
            far = np.append(True, (doc[1:] != doc[:-1]) | (np.diff(place) > reach))
            cuts = np.append(np.flatnonzero(far), len(place))
            for a, z in zip(cuts[:-1], cuts[1:]):
                d = doc[a]
                while a < z:
                    stop = int(np.searchsorted(place[a:z], place[a] + REGION * reach)) + a
                    low, high = max(begin[d], place[a] - reach), min(begin[d + 1], place[stop - 1] + reach)
                    rows.append(d)
                    lists.append([{"key": k, "at": x} for k, x in zip(key[a:stop].tolist(), (place[a:stop] - low).tolist())])
                    texts.append(buf[low:high].tobytes())
                    a = stop
            kind = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32())]))
            yield pa.RecordBatch.from_arrays([block.column("doc_id").take(pa.array(rows)), pa.array(lists, kind), pa.array(texts, pa.binary())], ["doc_id", "hits", "region"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, hits array<struct<key:long,at:int>>, region binary")


def best_matches(items: list[bytes], regions_: list[bytes]) -> np.ndarray:
    """The least edit distance between each item and any stretch of its region: Myers' bit vectors in blocks of 64, all pairs of as many blocks step together."""
    out = np.array([len(i) for i in items])
    one, high = np.uint64(1), np.uint64(63)
    of: dict[int, list[int]] = {}
    for p, i in enumerate(items):
        if i:
            of.setdefault(-(-len(i) // 64), []).append(p)
    for blocks_, pairs in of.items():
        pairs.sort(key=lambda p: -len(regions_[p]))
        known = {t: k for k, t in enumerate(dict.fromkeys(items[p] for p in pairs))}
        places = np.zeros((len(known), 256, blocks_), np.uint64)
        for t, k in known.items():
            at, byte = np.arange(len(t)), np.frombuffer(t, np.uint8)
            np.bitwise_or.at(places[k], (byte, at // 64), one << (at % 64).astype(np.uint64))
        which = np.array([known[items[p]] for p in pairs])
        size = np.array([len(regions_[p]) for p in pairs])
        text = np.zeros((len(pairs), max(int(size[0]), 1)), np.uint8)
        for k, p in enumerate(pairs):
            text[k, : size[k]] = np.frombuffer(regions_[p], np.uint8)
        length = np.array([len(items[p]) for p in pairs])
        top = ((length - 1) % 64).astype(np.uint64)
        plus, minus = np.full((blocks_, len(pairs)), ~np.uint64(0)), np.zeros((blocks_, len(pairs)), np.uint64)
        score, best = length.copy(), length.copy()
        n = len(pairs)
        for j in range(text.shape[1]):
            n = int(np.searchsorted(-size[:n], -j, side="left"))
            eqs = places[which[:n], text[:n, j]]
            up, down = np.zeros(n, np.uint64), np.zeros(n, np.uint64)  # carried from the block below
            for b in range(blocks_):
                eq, p, m = eqs[:, b], plus[b, :n], minus[b, :n]
                x = eq | m
                eq = eq | down
                d = (((eq & p) + p) ^ p) | eq
                grow, fall = m | ~(d | p), p & d
                last = top[:n] if b == blocks_ - 1 else high
                next_up, next_down = (grow >> last) & one, (fall >> last) & one
                grow, fall = (grow << one) | up, (fall << one) | down
                plus[b, :n], minus[b, :n] = fall | ~(x | grow), grow & x
                up, down = next_up, next_down
            score[:n] += up.astype(np.int64) - down.astype(np.int64)
            np.minimum(best[:n], score[:n], out=best[:n])
        out[pairs] = best
    return out


def promising(items: list[bytes], regions_: list[bytes], first: np.ndarray, last: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Indexes of the pairs whose items may lie within ``most`` edits of their region, as far as blocks of 64 bytes tell.

    Of a match every block lies at most 2 * most from its place after ``first`` and ``last``, and the least edits of the blocks
    add up to those of the item or fewer: nothing that is within reach is lost.
    """
    size = np.array([len(i) for i in items], np.int64)
    total, left = np.zeros(len(items), np.int64), np.arange(len(items))
    for b in range(0, int(size.max(initial=0)), 64):
        some = left[(size[left] > b) & (size[left] > 64)]
        if not len(some):
            break
        low = np.maximum(first - most, first - 2 * most + b)[some]
        high = np.minimum(last + size + most, last + 2 * most + b + 64)[some]
        texts = [regions_[p][max(0, a) : max(0, z)] for p, a, z in zip(some.tolist(), low.tolist(), high.tolist())]
        total[some] += best_matches([items[p][b : b + 64] for p in some.tolist()], texts)
        left = left[total[left] <= most[left]]
    return left


def _packed(bit: Column, of: DataFrame, bits: int) -> np.ndarray:
    """A packed table of 2 ** ``bits`` bits with those of the column set; words of 64 bits come to the driver."""
    word = of.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("one"))
    got = word.groupBy("word").agg(F.bit_or("one").alias("ones")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got["word"].to_numpy()] = got["ones"].to_numpy()
    return out.view(np.uint8)


def bloom(listed: DataFrame, n: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """The filter of the keys of ``listed`` and the coarse table before it, packed, and the filter's bits as a power of two, MOST_FILTER_BITS at most."""
    bits = min(MOST_FILTER_BITS, max(16, (FILTER_SHARE * n).bit_length()))
    probe = F.explode(F.array(*[F.shiftrightunsigned("key", 9 * p).bitwiseAND(F.lit((1 << bits) - 1)) for p in range(PROBES)]))
    return (_packed(probe, listed, bits), _packed(F.shiftrightunsigned("key", 64 - COARSE_BITS), listed, COARSE_BITS)), bits


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, item_bytes, edits, similarity) of every document and item that it holds a near copy of."""
    spark = docs.sparkSession
    items = items.select("item_id", "text", *(h.alias(c) for h, c in zip(identity("item_id", "text"), ("i1", "i2")))).dropDuplicates(["i1", "i2"])
    listed = cut(item_keys(items), "item-keys")
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    known = cut(folded(items), "items")
    n = listed.count()
    if not n:
        return spark.createDataFrame([], f"doc_id {id_type}, item_id {item_type}, item_bytes int, edits int, similarity double")
    longest = known.agg(F.max(F.length("item"))).first()[0]
    kinds = sorted(r["gram"] for r in listed.select("gram").distinct().collect())
    sizes, walks = [k for k in kinds if k > 0], [w for w in CLASSES if -w.number in kinds]
    reach = longest + ceil((1 - similarity) * longest) + STEPS
    parts = -(-n * LEAST_SHARE >> MOST_FILTER_BITS)
    some = [regions(docs, *bloom(listed.where(F.pmod("key", F.lit(parts)) == k), -(-n // parts)), reach, sizes, walks, k, parts) for k in range(parts)]
    found = cut(reduce(DataFrame.unionByName, some).withColumn("rid", F.xxhash64("doc_id", "region")).withColumn("rid2", F.xxhash64(F.lit(1), "doc_id", "region")), "regions")
    few = F.broadcast if n <= BROADCAST_ROWS else (lambda x: x)
    rid = ["rid", "rid2"]
    met = found.select(*rid, F.inline("hits")).join(few(listed.select("key", "i1", "i2", "off")), "key")
    # Where the item would begin in the region, by the hits that agree.
    pairs = met.groupBy(*rid, "i1", "i2").agg(F.min(F.col("at") - F.col("off")).alias("first"), F.max(F.col("at") - F.col("off")).alias("last"))
    pairs = pairs.join(known, ["i1", "i2"])
    pairs = found.dropDuplicates(rid).select(*rid, "doc_id", "region").join(pairs, rid).select("doc_id", "i1", "i2", "item_id", "item", "region", "first", "last")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("item").to_pylist()
            most = ((1 - similarity) * np.array([len(t) for t in texts]) + 1e-9).astype(int)
            # Most pairs share little but a key: a block or two of the item leave them out.
            left = promising(texts, batch.column("region").to_pylist(), batch.column("first").to_numpy(), batch.column("last").to_numpy(), most)
            batch, most = batch.take(pa.array(left)), most[left]
            texts, parts = batch.column("item").to_pylist(), []
            size = np.array([len(t) for t in texts], int)
            for region, low, high in zip(batch.column("region").to_pylist(), (batch.column("first").to_numpy() - most).tolist(), (batch.column("last").to_numpy() + size + most).tolist()):
                parts.append(region[max(0, low) : max(0, high)])
            edits = best_matches(texts, parts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "i1", "i2", "item_id")), pa.array(size.astype(np.int32)), pa.array(edits.astype(np.int32))], ["doc_id", "i1", "i2", "item_id", "item_bytes", "edits"])

    checked = pairs.mapInArrow(verify, f"doc_id {id_type}, i1 long, i2 long, item_id {item_type}, item_bytes int, edits int")
    best = checked.groupBy("doc_id", "item_id", "item_bytes").agg(F.min("edits").alias("edits"))
    share = 1 - F.col("edits") / F.col("item_bytes")
    return best.where(F.col("edits") <= F.floor((1 - similarity) * F.col("item_bytes") + 1e-9)).withColumn("similarity", share)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold near copies of benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
