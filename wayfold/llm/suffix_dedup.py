"""Suffix-array dedup of long byte strings, bucket by bucket with a difference cover.

Bytes covered by a string of ``K`` bytes that also starts elsewhere are removed, so suffixes are
sorted to ``K`` bytes, and only those that can have an equal:

1. each window of ``K`` bytes is owned by its minimiser (the leftmost of the least-hashed ``GRAM``-byte
   strings in it).  Equal windows have equal minimisers: these are the suffix buckets, and a bucket
   with one occurrence holds nothing equal;
2. the windows that follow each other under one minimiser are shipped as one piece of text; equal pieces
   collapse to one with a count;
3. buckets are sorted a few at a time (about ``BLOCK_BYTES`` of text): by the first ``V`` bytes, then
   long ties by a difference cover of period ``V``.  The cover sample's ranks to ``DEPTH`` bytes are
   precomputed for the block by doubling; of two suffixes some shift below ``V`` puts both in the sample,
   so a tie takes a few look-ups whatever its length, and memory is bounded by the block;
4. suffixes that stay equal over ``K`` bytes form classes; those with a count of two or more are repeated.

A bucket of more than ``MOST_PIECES`` pieces would not fit a block and is cut by more of its windows:
those that begin at most ``WIDTHS[0]`` bytes apart, as counted from the minimiser, share a core; pieces are cut
to such stretches, the stretches with equal cores are a bucket of their own, equal stretches collapse, and
what has one kind is settled by its count.  Buckets that are still crowded are cut to the next width; at
width 1 the core is the window.  Rows are stretches, few for each piece, and runs, never windows.

Defined cases: null and empty texts have no bytes; texts shorter than ``K`` lose nothing; strings do not
cross documents; every row is a document of its own as to counts, rows that share doc_id and text get
the same result; a null doc_id is one like any other; texts of any length are taken whole; further columns
are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .store import cut, discard, identity, lanes, table

K = 400
GRAM = 48
V = 32
DEPTH = 256
BLOCK_BYTES = 1 << 18
MOST_PIECES = 2000
WIDTHS = (64, 8, 1)
#: A row is told by two hashes of its doc_id and text, a kind of pieces by 128 bits of XXH3.
DOC = ["d1", "d2"]
KIND = ["h1", "h2"]


def difference_cover(v: int) -> np.ndarray:
    """A small set of residues whose differences are all residues of v."""
    cover, seen = [0, 1], {0, 1, v - 1}
    while len(seen) < v:
        gain = {c: len({(c - x) % v for x in cover} | {(x - c) % v for x in cover} | seen) for c in range(v) if c not in cover}
        best = max(gain, key=lambda c: (gain[c], -c))
        seen |= {(best - x) % v for x in cover} | {(x - best) % v for x in cover}
        cover.append(best)
    return np.array(sorted(cover))


COVER = difference_cover(V)
_IN_COVER = np.isin(np.arange(V), COVER)
#: Of two residues, the least shift that puts both in the cover.
SHIFT = np.array([[next(d for d in range(V) if _IN_COVER[(a + d) % V] and _IN_COVER[(b + d) % V]) for b in range(V)] for a in range(V)])


def owners(buf: np.ndarray, at: np.ndarray, k: int, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of k bytes inside a text: its start, its text, where its minimiser begins; and the hash of the string at every byte."""
    start, doc = tx.within(at, k)
    if not len(start):
        return start, doc, start, np.zeros(0, np.uint64)
    begin = np.arange(len(buf) - g + 1)
    hashed = tx.rolling_hash(buf, g)
    value = (hashed >> np.uint64(32) << np.uint64(32)) | begin.astype(np.uint64)
    w = k - g + 1
    full = np.full(-(-len(value) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(value)] = value
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[start], ahead[start + w - 1])
    return start, doc, (least & np.uint64(0xFFFFFFFF)).astype(np.int64), hashed


def with_key(docs: DataFrame, *also: str) -> DataFrame:
    """(d1, d2, also ..., text): every row with what tells it apart."""
    return docs.select(*(h.alias(c) for h, c in zip(identity("doc_id", "text"), DOC)), *also, "text")


def anchors(docs: DataFrame, k: int = K, g: int = GRAM) -> DataFrame:
    """(d1, d2, pos, a): where minimisers begin, and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text"):
            buf, at = tx.raw(block.column("text"))
            _, doc, own, hashed = owners(buf, at, k, g)
            if not len(own):
                continue
            fresh = np.append(True, own[1:] != own[:-1])
            doc, own = doc[fresh], own[fresh]
            yield pa.RecordBatch.from_arrays([*(block.column(c).take(pa.array(doc)) for c in DOC), pa.array((own - at[doc]).astype(np.int32)), pa.array(hashed[own].view(np.int64))], [*DOC, "pos", "a"])

    return docs.select(*DOC, "text").mapInArrow(run, "d1 long, d2 long, pos int, a long")


def pieces(docs: DataFrame, k: int = K, g: int = GRAM) -> DataFrame:
    """(h1, h2, n, o, a, seen) of ``docs(d1, d2, own, text)``, own being positions of repeated minimisers: the kinds of the pieces whose windows these own.

    n: windows, o: the minimiser's place in the piece, a: its hash, seen: where the kind is found (d1, d2, start) in a block of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text"):
            buf, at = tx.raw(block.column("text"))
            start, doc, own, hashed = owners(buf, at, k, g)
            if not len(own):
                continue
            listed = block.column("own")
            count = pa.compute.list_value_length(listed).to_numpy(zero_copy_only=False)
            hot = np.zeros(len(buf), bool)
            hot[listed.flatten().to_numpy() + np.repeat(at[:-1], count)] = True
            head = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])))
            size = np.diff(np.append(head, len(own)))
            keep = hot[own[head]]
            head, size = head[keep], size[keep]
            if not len(head):
                continue
            begin, holder = start[head], doc[head]
            kind = tx.strong_hash(buf.tobytes(), begin, begin + size + k - 1)
            # A kind is one row of the block, however often it is found there.
            order = np.lexsort((kind[1], kind[0]))
            begin, holder, head, size = begin[order], holder[order], head[order], size[order]
            h1, h2 = (h[order] for h in kind)
            first = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            seen = pa.StructArray.from_arrays([*(block.column(c).take(pa.array(holder)) for c in DOC), pa.array((begin - at[holder]).astype(np.int32))], [*DOC, "start"])
            listed = pa.ListArray.from_arrays(pa.array(np.append(first, len(h1)).astype(np.int32)), seen)
            own_head = own[head[first]]
            cols = [h1[first], h2[first], size[first].astype(np.int32), (own_head - begin[first]).astype(np.int32), hashed[own_head].view(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), listed], [*KIND, "n", "o", "a", "seen"])

    return docs.select(*DOC, "own", "text").mapInArrow(run, "h1 long, h2 long, n int, o int, a long, seen array<struct<d1: long, d2: long, start: int>>")


def piece_texts(docs: DataFrame, k: int = K) -> DataFrame:
    """(a, o, h1, h2, times, piece) of ``docs(listed, text)``, listed being an array of (start, n, o, a, h1, h2, times)."""
    names = ["a", "o", *KIND, "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text"):
            buf, at = tx.raw(block.column("text"))
            listed = block.column("listed")
            row = np.repeat(at[:-1], pa.compute.list_value_length(listed).to_numpy(zero_copy_only=False))
            flat = listed.flatten()
            begin = row + flat.field("start").to_numpy()
            end = begin + flat.field("n").to_numpy() + k - 1
            texts = pa.array([buf[b:e].tobytes() for b, e in zip(begin.tolist(), end.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in names), texts], [*names, "piece"])

    return docs.select("listed", "text").mapInArrow(run, "a long, o int, h1 long, h2 long, times long, piece binary")


def repeated_suffixes(texts: list[bytes], times: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Piece and offset of every window of k bytes whose class of equals has a count of two or more, pieces counting ``times``."""
    size = np.array([len(t) for t in texts])
    at = np.concatenate([[0], np.cumsum(size)])
    t = np.frombuffer(b"".join(texts) + bytes(2 * V + 8), np.uint8)
    n = int(at[-1])
    word = np.zeros(n + V, np.uint64)  # the next eight bytes, the first the highest
    for b in range(8):
        word |= t[b : b + n + V].astype(np.uint64) << np.uint64(56 - 8 * b)

    # Ranks of the cover sample, to DEPTH bytes.
    sample = np.flatnonzero(_IN_COVER[np.arange(n) % V])
    rank = np.zeros(n + 2 * DEPTH + V, np.int64)
    order = np.lexsort([word[np.minimum(sample + 8 * j, n + V - 1)] for j in (3, 2, 1, 0)])
    ordered = sample[order]
    change = np.zeros(len(sample), bool)
    for j in range(4):
        w = word[np.minimum(ordered + 8 * j, n + V - 1)]
        change[1:] |= w[1:] != w[:-1]
    rank[ordered] = np.cumsum(change) + 1
    depth = V
    while depth < DEPTH:
        both = rank[sample] << 32 | rank[sample + depth]
        rank[sample] = np.unique(both, return_inverse=True)[1] + 1
        depth *= 2

    count = np.maximum(size - k + 1, 0)
    piece = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    i = at[:-1][piece] + offset
    weight = times[piece]
    far = k - DEPTH - V  # the second look-up's window ends at k at most

    def compare(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Order of suffixes with equal first V bytes, over k bytes."""
        d = SHIFT[x % V, y % V]
        out = np.sign(rank[x + d] - rank[y + d])
        tie = np.flatnonzero(out == 0)
        x, y = x[tie] + far, y[tie] + far
        d = SHIFT[x % V, y % V]
        out[tie] = np.sign(rank[x + d] - rank[y + d])
        for j in (32, 24, 16, 8):
            tie = tie[out[tie] == 0]
            u, v = word[i_of[tie] + k - j], word[p_of[tie] + k - j]
            out[tie] = np.where(u < v, -1, np.where(u > v, 1, 0))
        return out

    # Buckets of equal first V bytes, in order; then ternary quicksort of all buckets at once.
    order = np.lexsort([word[i + 8 * j] for j in (3, 2, 1, 0)])
    fresh = np.zeros(len(i), bool)
    for j in range(4):
        w = word[i[order] + 8 * j]
        fresh[1:] |= w[1:] != w[:-1]
    group = np.cumsum(fresh)
    found = np.zeros(len(i), bool)
    while len(order):
        sizes = np.bincount(group)
        active = sizes[group] > 1
        single = order[~active]
        found[single] = weight[single] > 1
        order, group = order[active], group[active]
        if not len(order):
            break
        group = np.cumsum(np.append(False, group[1:] != group[:-1]))
        begin = np.searchsorted(group, np.arange(group[-1] + 1))
        width = np.diff(np.append(begin, len(group)))
        pivot = order[begin + width // 2]
        i_of, p_of = i[order], i[pivot[group]]
        sign = compare(i_of, p_of)
        same = sign == 0
        total = np.bincount(group[same], weights=weight[order[same]], minlength=len(begin))
        found[order[same]] = total[group[same]] > 1
        order, group, sign = order[~same], group[~same], sign[~same]
        group = 2 * group + (sign > 0)
        turn = np.argsort(group, kind="stable")
        order, group = order[turn], group[turn]
        _, group = np.unique(group, return_inverse=True)
    hit = np.flatnonzero(found)
    return piece[hit], offset[hit]


def _runs(hit: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring offsets of one piece: piece, first offset, length."""
    head = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(hit) else np.zeros(0, np.int64)
    return hit[head], offset[head], np.diff(np.append(head, len(hit)))


def sort_buckets(kinds: DataFrame, k: int = K) -> DataFrame:
    """(h1, h2, i, n): runs of repeated windows of each piece, for ``kinds(a, h1, h2, times, piece)`` whose buckets fit a block."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        hit, offset = repeated_suffixes([r[3] for r in rows], np.array([r[2] for r in rows], np.int64), k)
        p, i, n = _runs(hit, offset)
        kind = [pa.array([rows[x][c] for x in p.tolist()], pa.int64()) for c in (0, 1)]
        return pa.RecordBatch.from_arrays([*kind, pa.array(i.astype(np.int32)), pa.array(n.astype(np.int32))], [*KIND, "i", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last, before = 0, None, None
        for batch in batches:
            for a, h1, h2, times, piece in zip(*(batch.column(c).to_pylist() for c in ("a", *KIND, "times", "piece"))):
                if (a, h1, h2) == before:
                    continue  # of a repeated row
                if a != last and held >= BLOCK_BYTES:
                    yield block(rows)
                    rows, held = [], 0
                last, before = a, (a, h1, h2)
                rows.append((h1, h2, times, piece))
                held += len(piece)
        if rows:
            yield block(rows)

    dealt = kinds.select("a", *KIND, "times", "piece").repartition(lanes(kinds.sparkSession), "a").sortWithinPartitions("a", *KIND)
    return dealt.mapInArrow(run, "h1 long, h2 long, i int, n int")


def stretches(kinds: DataFrame, width: int, k: int = K, whole: bool = False) -> DataFrame:
    """Pieces ``kinds(a, o, h1, h2, times, piece, todo)`` cut where the distance of their windows from the minimiser passes multiples of ``width``.

    todo: an array of (i, n), the runs of windows that are cut.  (h1, h2, i, n, a, s1, s2, times): a run of a piece's windows,
    the bucket of its core, and the kind of its bytes; ``whole``: with the bytes.
    """
    out = ["h1", "h2", "i", "n", "a", "s1", "s2", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "piece"):
            buf, at = tx.raw(block.column("piece"))
            data = buf.tobytes()
            listed = block.column("todo")
            row = np.repeat(np.arange(block.num_rows), pa.compute.list_value_length(listed).to_numpy(zero_copy_only=False))
            flat = listed.flatten()
            first, n = flat.field("i").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
            o = block.column("o").to_numpy().astype(np.int64)[row]
            # Windows i of a stretch have (o - i) // width in common.
            high, low = (o - first) // width, (o - first - n + 1) // width
            count = high - low + 1
            back = np.repeat(np.arange(len(row)), count)
            part = high[back] - (np.arange(len(back)) - np.repeat(np.cumsum(count) - count, count))
            i = np.maximum(first[back], o[back] - (part + 1) * width + 1)
            z = np.minimum(first[back] + n[back], o[back] - part * width + 1)
            row, o = row[back], o[back]
            base = at[:-1][row]
            core = base + o - part * width
            c1, c2 = tx.strong_hash(data, core, core + k - width + 1)
            bucket = tx.mix(c1.view(np.uint64) ^ tx.mix(c2.view(np.uint64) + part.astype(np.uint64), 3), 4).view(np.int64)
            kind = tx.strong_hash(data, base + i, base + z + k - 1)
            own = pa.array(row)
            cols = [*(block.column(c).take(own) for c in KIND), pa.array(i.astype(np.int32)), pa.array((z - i).astype(np.int32)), pa.array(bucket), *map(pa.array, kind), block.column("times").take(own)]
            if whole:
                cols.append(pa.array([data[x:y] for x, y in zip((base + i).tolist(), (base + z + k - 1).tolist())], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, [*out, "piece"] if whole else out)

    types = "h1 long, h2 long, i int, n int, a long, s1 long, s2 long, times long" + ", piece binary" * whole
    return kinds.select("o", *KIND, "times", "piece", "todo").mapInArrow(run, types)


def split_buckets(kinds: DataFrame, k: int = K, most: int = MOST_PIECES, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """The same as :func:`sort_buckets` for buckets of any size."""
    todo = kinds.select(*KIND, F.array(F.struct(F.lit(0).alias("i"), (F.length("piece") - k + 1).alias("n"))).alias("todo")).dropDuplicates(KIND)
    done = None
    for width in widths:
        open_ = kinds.join(todo, KIND)
        cuts = cut(stretches(open_, width, k), "stretches")
        alike = cut(cuts.groupBy("s1", "s2", "a").agg(F.sum("times").alias("all"), F.min(F.struct(*KIND, "i", "n")).alias("first")), "stretch-kinds")
        size = cut(alike.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1"), "stretch-buckets")
        # One kind in its bucket: its count decides.
        settled = cuts.join(alike.where("all > 1").join(size, "a", "left_anti").select("s1", "s2"), ["s1", "s2"]).select(*KIND, "i", "n")
        done = settled if done is None else done.unionByName(settled)
        # A few kinds: the bucket is sorted.  The kind's first stretch is read again with its bytes.
        few = alike.join(size.where(F.col("kinds") <= most), "a", "left_semi").select("s1", "s2", "all", "first.*")
        again = kinds.join(few.groupBy(*KIND).agg(F.collect_list(F.struct("i", "n")).alias("todo")), KIND)
        texts = stretches(again, width, k, whole=True).select("a", "s1", "s2", "piece").join(few.select("s1", "s2", F.col("all").alias("times")), ["s1", "s2"])
        runs = cut(sort_buckets(texts.select("a", F.col("s1").alias("h1"), F.col("s2").alias("h2"), "times", "piece"), k), "stretch-runs")
        listed = runs.groupBy(F.col("h1").alias("s1"), F.col("h2").alias("s2")).agg(F.collect_list(F.struct("i", F.col("n").alias("m"))).alias("runs"))
        back = cuts.select(*KIND, F.col("i").alias("base"), "s1", "s2").join(listed, ["s1", "s2"]).select(*KIND, "base", F.inline("runs"))
        done = done.unionByName(back.select(*KIND, (F.col("base") + F.col("i")).alias("i"), F.col("m").alias("n")))
        crowded = size.where(F.col("kinds") > most).select("a")
        todo = cut(cuts.join(crowded, "a", "left_semi").groupBy(*KIND).agg(F.collect_list(F.struct("i", "n")).alias("todo")), "crowded-stretches")
    return done


def spans(docs: DataFrame, k: int = K, g: int = GRAM, most_pieces: int = MOST_PIECES) -> DataFrame:
    """(d1, d2, gone): of ``docs(d1, d2, text)`` the runs (start, bytes) whose windows of k bytes all start elsewhere too; they may overlap."""
    every = cut(anchors(docs, k, g), "anchors")
    # Counts are cut so that a hot minimiser may be split in the join.
    twice = cut(every.groupBy("a").agg(F.count("*").alias("times")).where("times > 1").select("a"), "repeated-minimisers")
    own = every.join(twice.hint("shuffle_hash"), "a").groupBy(*DOC).agg(F.sort_array(F.collect_set("pos")).alias("own"))
    # Pieces are told apart by 128 bits; of each kind the first occurrence's text is sorted.
    found = cut(pieces(docs.join(own, DOC), k, g), "pieces")
    discard(every, twice)
    kinds = found.groupBy(*KIND).agg(F.sum(F.size("seen")).alias("times"), F.first("a").alias("a"), F.first("o").alias("o"), F.first("n").alias("n"), F.min(F.array_min("seen")).alias("at"))
    kinds = cut(kinds, "piece-kinds")
    # A kind whose minimiser owns no other is repeated as a whole, or not at all.
    several = cut(kinds.groupBy("a").agg(F.count("*").alias("c")).where("c > 1"), "mixed-buckets")
    alone = kinds.join(several, "a", "left_anti").where("times > 1").select(*KIND, F.lit(0).alias("i"), "n")
    mixed = kinds.join(several, "a", "left_semi")
    listed = mixed.groupBy("at.d1", "at.d2").agg(F.collect_list(F.struct("at.start", "n", "o", "a", *KIND, "times")).alias("listed"))
    # Repeated rows give their pieces twice, which are repeated anyhow.
    texts = piece_texts(docs.join(listed, DOC), k)
    crowded = several.where(F.col("c") > most_pieces).select("a")
    runs = alone.unionByName(sort_buckets(texts.join(crowded, "a", "left_anti"), k))
    if not crowded.isEmpty():
        runs = runs.unionByName(split_buckets(cut(texts.join(crowded, "a", "left_semi"), "crowded-pieces"), k, most_pieces))
    runs = cut(runs.groupBy(*KIND).agg(F.collect_set(F.struct("i", "n")).alias("runs")), "repeated-runs")
    discard(kinds, several)
    # Runs meet the lists of a kind's places, a row for each block, and only then the places.
    back = found.select("seen", *KIND).join(runs, KIND).select(F.inline("seen"), "runs")
    placed = F.transform("runs", lambda r: F.struct((F.col("start") + r["i"]).alias("start"), (r["n"] + k - 1).alias("bytes")))
    return back.select(*DOC, placed.alias("placed")).groupBy(*DOC).agg(F.flatten(F.collect_list("placed")).alias("gone"))


def remove(docs: DataFrame, gone: DataFrame, *also: str) -> DataFrame:
    """Of every row of ``docs(d1, d2, also ..., text)``: ``own``, a struct of the columns named in ``also``, n_bytes, n_removed, n_spans and the kept bytes."""
    both = docs.join(gone, DOC, "left").select(F.struct(*also).alias("own"), "text", "gone")
    types = both.schema["own"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text"):
            buf, at = tx.raw(block.column("text"))
            removed, runs, kept = [], [], []
            for d, listed in enumerate(block.column("gone")):
                t = buf[at[d] : at[d + 1]]
                if listed.is_valid:
                    edge = np.zeros(len(t) + 1, np.int64)
                    s = listed.values.field("start").to_numpy()
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + listed.values.field("bytes").to_numpy(), -1)
                    out = np.cumsum(edge[:-1]) > 0
                    removed.append(int(out.sum()))
                    runs.append(int((out & ~np.append(False, out[:-1])).sum()))
                    t = t[~out]
                else:
                    removed.append(0)
                    runs.append(0)
                kept.append(t.tobytes())
            yield pa.RecordBatch.from_arrays([block.column("own"), *(pa.array(x, pa.int64()) for x in (np.diff(at), removed, runs)), pa.array(kept, pa.binary())], ["own", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, f"own {types}, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and removed bytes of every document, and a digest of what is kept."""
    docs = with_key(table(spark, sf_dir, "documents"), "doc_id")
    found = remove(docs, spans(docs), "doc_id")
    return found.select("own.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
