"""Texts whose sets of word shingles are alike, found through MinHash bands.

A text's signature is ``BANDS`` keys, each of the least values of ``ROWS`` hash functions over its
shingles; two texts of Jaccard similarity s share a key with probability 1 - (1 - s ** ROWS) ** BANDS
(0.99993 at 0.8).  Texts that share a key are compared by their whole shingle sets, but not all pairs are:

1. every text of a key is compared with the key's smallest one, its leader; a pair that shares several keys is
   compared once, and keys with the same texts count once;
2. texts that these links leave apart from their key's leader, over all keys, are odd.  They
   are joined with the texts of their keys by prefixes.  All shingles are put in one order, those of fewest odd texts
   first.  Of a pair that is alike, the first shingle in common stands in the first ``1 - s`` of the larger set, and in the first
   ``1 - 2 s / (1 + s)`` of the smaller one, so only these places are indexed and looked up, and only pairs of different components
   whose places leave room for enough in common are compared.  Texts that share a template but not
   enough of it have rarer shingles before it, and do not meet.

All other texts of a key are linked with its leader already, so these links have the components of all pairs.  No
key's texts meet in one task or one row, and what is shuffled is linear in the texts' shingles.

Defined cases: a text of fewer words than a shingle has one, of all its words; texts without words
have no signature; rows that share their identity are one text; of texts of a key the smallest identity leads;
texts of any length are taken whole; an empty table has no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .store import cut, discard, sifted

BANDS, ROWS = 24, 5
ROWS_OUT = 1 << 16
_FACTOR = np.random.default_rng(5).integers(1 << 62, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word shingles and the text of each, in order of texts."""
    buf, at = tx.raw(column)
    buf = _FOLD[buf]
    start, end, first = tx.words(buf, at)
    word = tx.span_hash(buf, start, end)
    begin, doc = tx.within(first, n)
    value = tx.gram_hash(word, n)[begin]
    size = np.diff(first)
    few = np.flatnonzero((size > 0) & (size < n))
    if len(few):
        # The number of words tells them from shingles of n.
        short = np.array([tx.mix(tx.gram_hash(word[first[d] : first[d + 1]], int(size[d])), int(size[d]))[0] for d in few], np.uint64)
        value, doc = np.concatenate([value, short]), np.concatenate([doc, few])
        order = np.argsort(doc, kind="stable")
        value, doc = value[order], doc[order]
    return value, doc


def signatures(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have a signature, and their keys: an array of (texts, BANDS)."""
    value, doc = shingles(column, n)
    if not len(value):
        return np.zeros(0, np.int64), np.zeros((0, BANDS), np.uint64)
    head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    out = np.empty((len(head), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(head), b + 1, np.uint64)
        for r in range(ROWS):
            key = tx.mix(key + np.minimum.reduceat(value * _FACTOR[b, r], head), r + 1)
        out[:, b] = key
    return doc[head], out


def alike(one: np.ndarray, other: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have this similarity; the rounding of the product is forgiven."""
    if min(len(one), len(other)) < least * max(len(one), len(other)) - 1e-9:
        return False
    shared = len(one) + len(other) - len(np.unique(np.concatenate([one, other])))
    return shared >= least * (len(one) + len(other) - shared) - 1e-9


def similar(docs: DataFrame, least: float, n: int = 5) -> DataFrame:
    """Links (src, dst) between texts ``docs(xt, text)``, xt the identity of the text, whose components are those of similar pairs."""
    kind = docs.schema["xt"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text"):
            doc, found = signatures(block.column("text"), n)
            # The keys of a text are one list.
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(doc) + 1, dtype=np.int32) * BANDS), pa.array(found.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.column("xt").take(pa.array(doc)), lists], ["xt", "keys"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text"):
            value, doc = shingles(block.column("text"), n)
            sets = [np.unique(v).tobytes() for v in np.split(value, np.searchsorted(doc, np.arange(1, block.num_rows)))]
            yield pa.RecordBatch.from_arrays([block.column("xt"), pa.array(sets, pa.binary())], ["xt", "set"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()))
            good = pa.array([alike(a, b, least) for a, b in sets], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("src").filter(good), batch.column("dst").filter(good)], ["src", "dst"])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(b, np.int64) for b in batch.column("set").to_pylist()]
            size = np.array([len(x) for x in sets], np.int32)
            every = np.concatenate([*sets, np.zeros(0, np.int64)])
            for at in range(0, len(every), ROWS_OUT):
                row = np.repeat(np.arange(len(sets)), size)[at : at + ROWS_OUT]
                yield pa.RecordBatch.from_arrays([batch.column("xt").take(pa.array(row)), pa.array(size[row]), pa.array(every[at : at + ROWS_OUT])], ["xt", "size", "token"])

    def compared(rows: DataFrame) -> DataFrame:
        """The links among ``rows(src, dst)`` whose sets are alike."""
        both = rows.join(sets.select(F.col("xt").alias("src"), F.col("set").alias("a")), "src").join(sets.select(F.col("xt").alias("dst"), F.col("set").alias("b")), "dst")
        return cut(both.select("src", "dst", "a", "b").mapInArrow(pairs, f"src {kind}, dst {kind}"), "links-of-sets")

    kept = docs.select("xt", "text")
    signed = cut(kept.mapInArrow(sign, f"xt {kind}, keys array<long>").dropDuplicates(["xt"]), "signatures")
    by_key = signed.select("xt", F.xxhash64("xt").alias("h"), F.explode("keys").alias("key"))
    told = F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("s")
    keys = by_key.groupBy("key").agg(F.min("xt").alias("leader"), F.count("*").alias("n"), *told).where("n > 1")
    keys = cut(keys.groupBy("leader", "n", "x", "s").agg(F.min("key").alias("key")).select("key", "leader", "n"), "shared-keys")
    # Most keys are no two texts', and most texts share none: neither is shuffled.
    members = cut(sifted(by_key.select("key", "xt"), keys, "key").join(keys, "key"), "key-members")
    discard(signed, keys)
    few = members.where("xt <> leader").select("xt", "leader").distinct()
    held = cut(members.select("xt").distinct(), "members")
    # An inner join, as a semi-join would be pushed below the sieve.
    texts = sifted(kept, held, "xt").join(held, "xt")
    sets = cut(texts.mapInArrow(collect, f"xt {kind}, set binary").dropDuplicates(["xt"]), "shingle-sets")
    links = compared(few.select(F.col("xt").alias("src"), F.col("leader").alias("dst")))
    # A text's link to the smallest of its component stands for all its links.
    group = cut(components(links).select(F.col("node").alias("xt"), F.col("component").alias("group")), "alike-so-far")
    star = group.select(F.col("xt").alias("src"), F.col("group").alias("dst"))
    head = group.select(F.col("xt").alias("leader"), F.col("group").alias("leader_group"))
    far = members.where("n > 2").join(group, "xt", "left").join(head, "leader", "left").where(F.coalesce("group", "xt") != F.coalesce("leader_group", "leader"))
    odd = cut(far.select("key", "xt"), "odd-members")
    discard(links)
    if odd.isEmpty():
        discard(members, sets, odd)
        return star
    strange = cut(odd.select("xt").distinct(), "odd-texts")
    around = members.join(odd.select("key").distinct(), "key", "left_semi").select("xt").distinct()
    token_types = f"xt {kind}, size int, token long"
    rare = cut(sets.join(strange, "xt", "left_semi").mapInArrow(tokens, token_types).groupBy("token").agg(F.count("*").alias("held")), "odd-shingles")
    # Shingles that no odd text has come first in the order; they only move the others on.
    known = sets.join(around, "xt", "left_semi").mapInArrow(tokens, token_types).join(rare, "token")
    ordered = known.groupBy("xt", "size").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("of"))
    ordered = ordered.join(strange.withColumn("odd", F.lit(True)), "xt", "left").join(group, "xt", "left").select("xt", "size", F.coalesce("odd", F.lit(False)).alias("odd"), F.coalesce("group", "xt").alias("group"), "of")
    reach = lambda share: F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1
    skipped = F.col("size") - F.size("of")
    first = F.filter(F.transform("of", lambda x, i: F.struct((skipped + i).alias("at"), x["token"].alias("token"))), lambda x: x["at"] < reach(least))
    places = cut(ordered.select("xt", "size", "odd", "group", reach(2 * least / (1 + least)).alias("indexed"), F.inline(first)), "prefixes")
    small, large = (places.select(*(F.col(c).alias(f"{c}_{k}") for c in ("xt", "size", "odd", "group", "at", "indexed")), "token") for k in "yx")
    common = F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y"))
    meets = (
        ((F.col("size_y") < F.col("size_x")) | ((F.col("size_y") == F.col("size_x")) & (F.col("xt_y") < F.col("xt_x")))) & (F.col("size_y") >= F.col("size_x") * least - 1e-9)
        & (F.col("odd_x") | F.col("odd_y")) & (F.col("group_x") != F.col("group_y")) & (common >= (F.col("size_x") + F.col("size_y")) * (least / (1 + least)) - 1e-9)
    )
    # Written first: what is few is broadcast then, and the sets stay where they are.
    met = small.where("at_y < indexed_y").join(large, "token").where(meets).select(F.col("xt_x").alias("src"), F.col("xt_y").alias("dst")).distinct()
    met = cut(met, "to-compare")
    found = star.unionByName(compared(met))
    discard(members, sets, odd, strange, rare, places, met)
    return found
