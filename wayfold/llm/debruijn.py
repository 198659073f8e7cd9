"""Substring dedup by De Bruijn compaction over words.

Nodes are runs of ``K - 1`` words, edges are windows of ``K``.  Only edges that occur twice matter:

1. each window is owned by its minimiser (the leftmost of the least-hashed runs of ``GRAM`` words in it); equal
   windows have equal minimisers, so a window whose minimiser occurs once in the corpus is unique and
   its edge is never built;
2. the remaining windows of a text are cut where the owner changes.  Such a segment is a path of edges; equal
   segments (by 128 bits of XXH3 over their words) collapse to one with a count and its first source coordinate;
3. the graph: a segment whose minimiser owns no other kind is one long edge from its first node to its last, the
   segments of other minimisers are taken apart to their edges of one window.  An edge has the number of its
   occurrences and its first source coordinate; edges that occur once go;
4. nodes with one edge in and one out, as often, whose source coordinates go on, do not branch: edges there are linked,
   and one pass over each source's links in order compacts them to paths, each edge with its place in its path;
5. every occurrence joins its path; the edges of a path that follow each other in a text are one long repeated span with
   its source coordinate.  The source's words there are read and digested (SHA-256), and a span is removed
   only if its own words have that digest.

Words of windows that start earlier elsewhere are removed.  All keys are aggregated with partial sums
before they are shuffled, and joins on them have plain exchanges on both sides, so that a hot passage may be split.

Defined cases: null and empty texts have no words; texts shorter than a window lose nothing; rows that
share both doc_id and text are one document and give a row each; a null doc_id is smaller than any
other, and of documents that share a doc_id any is first, the same in every run; texts of any length are taken
whole; further columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as tx
from .store import cut, discard, identity, table

K = 20
GRAM = 7
#: A document is told by its id and two hashes of id and text, a kind of segments by 128 bits of XXH3.
DOC = ["doc_id", "d1", "d2"]
ROW = ["d1", "d2"]
KIND = ["h1", "h2"]
EDGE = ["x1", "x2"]


def owners(hashed: np.ndarray, first: np.ndarray, k: int, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of k words inside a text: its first word, its text, the word at which its minimiser begins; and the hash of the run at every word."""
    start, doc = tx.within(first, k)
    value = tx.gram_hash(hashed, g, 11)
    if not len(start):
        return start, doc, start, value
    every, at = value, np.arange(len(value))
    width, want = 1, k - g + 1
    while width < want:
        step = min(width, want - width)
        right = value[step:] < value[:-step]
        at = np.where(right, at[step:], at[:-step])
        value = np.where(right, value[step:], value[:-step])
        width += step
    return start, doc, at[start], every


def _words(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words, one space between them; where each begins and ends, its hash, and each text's first word."""
    texts = [b" ".join(t.split()) for t in column.cast(pa.large_binary()).fill_null(b"").to_pylist()]
    data = b"".join(texts)
    buf = np.frombuffer(data, np.uint8)
    start, end, first = tx.words(buf, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
    return data, start, end, tx.span_hash(buf, start, end), first


def with_key(docs: DataFrame) -> DataFrame:
    """(doc_id, d1, d2, text): rows with what tells documents apart."""
    return docs.select("doc_id", *(h.alias(c) for h, c in zip(identity("doc_id", "text"), ROW)), "text")


def anchors(docs: DataFrame, k: int = K, g: int = GRAM) -> DataFrame:
    """(d1, d2, pos, a): where minimisers begin, and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text"):
            buf, at = tx.raw(block.column("text"))
            begin, end, first = tx.words(buf, at)
            _, doc, own, value = owners(tx.span_hash(buf, begin, end), first, k, g)
            if not len(own):
                continue
            fresh = np.append(True, own[1:] != own[:-1])
            doc, own = doc[fresh], own[fresh]
            yield pa.RecordBatch.from_arrays([*(block.column(c).take(pa.array(doc)) for c in ROW), pa.array((own - first[doc]).astype(np.int32)), pa.array(value[own].view(np.int64))], [*ROW, "pos", "a"])

    return docs.select(*ROW, "text").mapInArrow(run, "d1 long, d2 long, pos int, a long")


def _nodes(data: bytes, start: np.ndarray, end: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The hash of the node (k - 1 words) at each word of ``at``."""
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    return np.array([digest(view[a:z]) for a, z in zip(start[at].tolist(), end[at + k - 2].tolist())], np.uint64).view(np.int64)


def segments(docs: DataFrame, k: int = K, g: int = GRAM) -> DataFrame:
    """Of ``docs(doc_id, d1, d2, own, text)``, own being positions of repeated minimisers: the segments that these own, and their kinds."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text"):
            data, start, end, hashed, first = _words(block.column("text"))
            window, doc, own, value = owners(hashed, first, k, g)
            if not len(own):
                continue
            listed = block.column("own")
            hot = np.zeros(len(hashed), bool)
            hot[listed.flatten().to_numpy() + np.repeat(first[:-1], pc.list_value_length(listed).to_numpy(zero_copy_only=False))] = True
            head = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])))
            size = np.diff(np.append(head, len(own)))
            keep = hot[own[head]]
            head, size = head[keep], size[keep]
            if not len(head):
                continue
            begin, holder = window[head], doc[head]
            kind = tx.strong_hash(data, start[begin], end[begin + size + k - 2])
            cols = [*(block.column(c).take(pa.array(holder)) for c in DOC), pa.array((begin - first[holder]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(value[own[head]].view(np.int64)), *map(pa.array, kind)]
            yield pa.RecordBatch.from_arrays(cols, [*DOC, "start", "n", "a", *KIND])

    return docs.select(*DOC, "own", "text").mapInArrow(run, f"doc_id {id_type}, d1 long, d2 long, start int, n int, a long, h1 long, h2 long")


def path_edges(docs: DataFrame, k: int = K) -> DataFrame:
    """Edges (u, v) of the segments of ``docs(doc_id, d1, d2, listed, text)``, listed being an array of (start, n, h1, h2, times, whole): one of n windows if it is whole, else n of one."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text"):
            data, begin, end, _, first = _words(block.column("text"))
            listed = block.column("listed")
            row = np.repeat(np.arange(block.num_rows), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
            flat = listed.flatten()
            n = flat.field("n").to_numpy()
            long = np.where(flat.field("whole").to_numpy(zero_copy_only=False), n, 1)
            count = n // long
            which = np.repeat(np.arange(len(n)), count)
            i = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            start = flat.field("start").to_numpy()[which] + i
            at = first[:-1][row][which] + start
            own = [block.column(c).take(pa.array(row[which])) for c in DOC]
            kind = [flat.field(c).take(pa.array(which)) for c in (*KIND, "times", "whole")]
            ends = [pa.array(_nodes(data, begin, end, x, k)) for x in (at, at + long[which])]
            yield pa.RecordBatch.from_arrays([*own, pa.array(start.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(long[which].astype(np.int32)), *kind, *ends], [*DOC, "start", "i", "n", *KIND, "times", "whole", "u", "v"])

    return docs.select(*DOC, "listed", "text").mapInArrow(run, f"doc_id {id_type}, d1 long, d2 long, start int, i int, n int, h1 long, h2 long, times long, whole boolean, u long, v long")


def compact(edges: DataFrame) -> DataFrame:
    """(x1, x2, off): of ``edges(x1, x2, u, v, n, times, d1, d2, start)`` those that are not the first of their path, and how many windows after its beginning they stand."""
    fields = [*EDGE, "n", "times", *ROW, "start"]
    ends = edges.select(F.col("v").alias("node"), F.lit(True).alias("into"), *fields).unionByName(edges.select(F.col("u").alias("node"), F.lit(False).alias("into"), *fields))
    # Degrees of every node; where one edge comes in and one goes out, the greatest values are theirs.
    side = {"in": F.col("into"), "out": ~F.col("into")}
    most = [F.max(F.when(c, F.col(f))).alias(f"{name}_{f}") for name, c in side.items() for f in fields]
    nodes = ends.groupBy("node").agg(*[F.count(F.when(c, 1)).alias(f"{name}s") for name, c in side.items()], *most).where("ins = 1 AND outs = 1")
    goes_on = (F.col("in_start") + F.col("in_n") == F.col("out_start")) & (F.col("in_times") == F.col("out_times")) & (F.col("in_d1") == F.col("out_d1")) & (F.col("in_d2") == F.col("out_d2"))
    # Along a link source coordinates go on, and a window of a text is of one edge: a path's edges follow each other in the source's order, with none between.
    links = nodes.where(goes_on).select(*(F.col(f"out_{c}").alias(c) for c in (*EDGE, *ROW, "start")), F.col("in_start").alias("before"))
    order = Window.partitionBy(*ROW).orderBy("start")
    fresh = F.coalesce(F.lag("start").over(order) != F.col("before"), F.lit(True))
    head = F.last(F.when(F.col("fresh"), F.col("before")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return cut(links.withColumn("fresh", fresh).select(*EDGE, (F.col("start") - head).alias("off")), "links")


def _runs(steps: str) -> str:
    """SQL: the runs (start, n) of an array of (start, n) in order, joined where one ends as the next begins."""
    heads = f"filter({steps}, (x, i) -> i = 0 OR get({steps}, i - 1).start + get({steps}, i - 1).n <> x.start)"
    tails = f"filter({steps}, (x, i) -> i = size({steps}) - 1 OR x.start + x.n <> get({steps}, i + 1).start)"
    return f"zip_with({heads}, {tails}, (h, t) -> named_struct('start', h.start, 'n', t.start + t.n - h.start))"


def digests(docs: DataFrame) -> DataFrame:
    """(d1, d2, start, words, digest) of the word spans of ``docs(d1, d2, listed, text)``, listed being an array of (start, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text"):
            rows, listed = [], block.column("listed")
            for t, spans_ in zip(block.column("text").cast(pa.large_binary()).to_pylist(), listed.to_pylist()):
                words = (t or b"").split()
                rows.append([sha256(b" ".join(words[s["start"] : s["start"] + s["words"]])).digest() for s in spans_])
            own = pa.array(np.repeat(np.arange(block.num_rows), [len(r) for r in rows]))
            flat = listed.flatten()
            yield pa.RecordBatch.from_arrays([*(block.column(c).take(own) for c in ROW), flat.field("start"), flat.field("words"), pa.array([d for r in rows for d in r], pa.binary())], [*ROW, "start", "words", "digest"])

    return docs.select(*ROW, "listed", "text").mapInArrow(run, "d1 long, d2 long, start int, words int, digest binary")


def spans(docs: DataFrame, k: int = K, g: int = GRAM) -> DataFrame:
    """(d1, d2, start, words, source, digest): stretches of compacted paths in ``docs(doc_id, d1, d2, text)`` that occur earlier, as words from a word on, with the source's (doc_id, d1, d2, start) and the digest of its words."""
    every = cut(anchors(docs, k, g), "anchors")
    # Counts are cut so that a hot minimiser may be split in the join.
    twice = cut(every.groupBy("a").agg(F.count("*").alias("times")).where("times > 1").select("a"), "repeated-minimisers")
    own = every.join(twice.hint("shuffle_hash"), "a").groupBy(*ROW).agg(F.sort_array(F.collect_set("pos")).alias("own"))
    found = cut(segments(docs.join(own, ROW), k, g), "segments")
    discard(every, twice)

    kinds = found.groupBy(*KIND).agg(F.count("*").alias("times"), F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct(*DOC, "start")).alias("source"))
    kinds = cut(kinds, "segment-kinds")
    several = cut(kinds.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a", F.lit(False).alias("whole")), "mixed-minimisers")
    taken = kinds.join(several, "a", "left").where("times > 1 OR NOT whole").select("source", F.struct("source.start", "n", *KIND, "times", F.coalesce("whole", F.lit(True)).alias("whole")).alias("one"))
    listed = taken.groupBy("source.d1", "source.d2").agg(F.collect_list("one").alias("listed"))
    walks = cut(path_edges(docs.join(listed, ROW), k), "walks")
    discard(kinds, several)
    # An edge is told by its nodes and its length.
    edges = walks.groupBy("u", "v", "n").agg(F.sum("times").alias("times"), F.min(F.struct(*DOC, "start")).alias("source")).where("times > 1")
    edges = cut(edges.select(F.col("u").alias("x1"), F.xxhash64("v", "n").alias("x2"), "u", "v", "n", "times", "source"), "edges")
    off = compact(edges.select(*EDGE, "u", "v", "n", "times", "source.d1", "source.d2", "source.start"))
    # Where the path of an edge begins in the source, and how far on the edge stands.
    head = F.struct("source.doc_id", "source.d1", "source.d2", (F.col("source.start") - F.coalesce("off", F.lit(0))).alias("start")).alias("head")
    placed = cut(edges.join(off, EDGE, "left").select("u", "v", "n", head, F.coalesce("off", F.lit(0)).alias("off")), "placed-edges")
    # Of each kind the stretches that lie on one path.
    walked = walks.select(*KIND, "i", "u", "v", "n").join(placed, ["u", "v", "n"]).groupBy(*KIND, "head", (F.col("i") - F.col("off")).alias("base")).agg(F.array_sort(F.collect_set(F.struct(F.col("i").alias("start"), "n"))).alias("walk"))
    steps = walked.select(*KIND, "head", "base", F.inline(F.expr(_runs("walk")))).groupBy(*KIND).agg(F.collect_list(F.struct("head", "base", F.col("start").alias("i"), "n")).alias("steps"))
    steps = cut(steps, "steps")
    discard(walks, edges, off, placed)

    # Occurrences by document, path and where the path would begin in the document.
    back = found.select(*ROW, F.col("start").alias("at"), *KIND).join(steps, KIND).select(*ROW, "at", F.inline("steps"))
    back = back.select(*ROW, "head", (F.col("at") + F.col("base")).alias("base"), F.struct((F.col("at") + F.col("i")).alias("start"), "n").alias("step"))
    itself = (F.col("d1") == F.col("head.d1")) & (F.col("d2") == F.col("head.d2")) & (F.col("base") == F.col("head.start"))
    whole = back.where(~itself).groupBy(*ROW, "head", "base").agg(F.array_sort(F.collect_set("step")).alias("walk"))
    runs = whole.select(*ROW, "head", "base", F.inline(F.expr(_runs("walk"))))
    runs = runs.select(*ROW, "start", (F.col("n") + k - 1).alias("words"), F.col("head").withField("start", F.col("head.start") + F.col("start") - F.col("base")).alias("source"))
    runs = cut(runs, "runs")
    discard(steps, found)
    asked = runs.groupBy("source.d1", "source.d2").agg(F.collect_set(F.struct("source.start", "words")).alias("listed"))
    read = digests(docs.join(asked, ROW)).distinct().select(*(F.col(c).alias(f"s_{c}") for c in (*ROW, "start", "words")), "digest")
    met = [F.col("source.d1") == F.col("s_d1"), F.col("source.d2") == F.col("s_d2"), F.col("source.start") == F.col("s_start"), F.col("words") == F.col("s_words")]
    return runs.join(read, met).select(*ROW, "start", "words", "source", "digest")


def remove(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (joined by one space, as bytes) of every row; spans whose words have another digest stay."""
    listed = gone.groupBy(*ROW).agg(F.collect_list(F.struct("start", "words", "digest")).alias("gone"))
    both = docs.join(listed, ROW, "left").select("doc_id", "text", "gone")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for t, listed in zip(batch.column("text"), batch.column("gone")):
                words = t.as_buffer().to_pybytes().split() if t.is_valid else []
                total.append(len(words))
                if listed.is_valid:
                    flat, stay = listed.values, []
                    start, size = (flat.field(c).to_numpy() for c in ("start", "words"))
                    alike = {(a, n) for a, n, d in zip(start.tolist(), size.tolist(), flat.field("digest").to_pylist()) if sha256(b" ".join(words[a : a + n])).digest() == d}
                    end = 0
                    for a, n in sorted(alike):
                        stay += words[end:a]
                        end = max(end, a + n)
                    words = stay + words[end:]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, kept binary")


def op8_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and removed words of every document, and a digest of what is kept."""
    docs = with_key(table(spark, sf_dir, "documents"))
    return remove(docs, spans(docs)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
