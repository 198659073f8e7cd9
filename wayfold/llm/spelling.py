"""Spelling variants: words that one edit separates, grouped under the commonest, by an even-partition pigeonhole join.

The vocabulary is counted over whole texts, with partial sums for each block of texts before anything is shuffled.

Two words are near if one inserted, deleted or replaced code point separates them.  A word of length l is cut into two even
segments.  One edit touches only one of them, so the other stands unchanged in the near word: at its own place, or one place
further on if the near word is longer and the edit came before it.  Words are indexed by (length, segment, its place)
and probe the index of their own length and of the length one less; the pairs that meet are verified and deduplicated.

Segments that more than ``CROWD`` words share are not joined, for their pairs would be as the square of the group.  There the same
principle is applied to the part that may differ: it is cut in two again, one half of it must be
unchanged too, and the key is all that is unchanged.  This goes on until a key is not crowded or leaves one
code point open, when a group is no larger than twice the alphabet.  So a key is a word's length and the block in which
the edit is, with the text before and after that block; no group is ever too large, and no pair is lost.

A word's form is its near word with the largest count, if that is ``TIMES`` the word's at least; counts grow along
forms, so these are chains, and pointer jumping by joins finds their ends.

Defined cases: null and empty texts have no words; occurrences in a row whose doc_id is null count as they are written (``derived`` leaves
them); repeated rows count each time; forms of equal count are told apart by code-point order; texts and words of any
length are taken whole; further columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .store import cut, discard, table

#: Runs of letters of Latin-1; in UTF-8 those from U+00C0 to U+00FF are C3 and one more byte.
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LETTERS = 6
TIMES = 5
#: A key of more words than this is cut further.
CROWD = 128

Derive = Callable[[object, bytes, bytes], bytes]


def derived(doc_id: object, start: int, run: bytes) -> bytes:
    """The contract's words: of one run in 199, told by doc_id and run, a code point goes.  ``start`` is the CRC-32 of the doc_id and a colon."""
    if doc_id is None:
        return run
    h = zlib.crc32(run, start)
    if h % 199:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def vocabulary(docs: DataFrame, derive: Derive | None = None, letters: int = LETTERS, least: int = 5) -> DataFrame:
    """(word, n, size): words of at least ``letters`` code points found ``least`` times or more in ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text"):
            total: Counter[bytes] = Counter()
            for i, t in zip(block.column("doc_id").to_pylist(), block.column("text").cast(pa.large_binary()).to_pylist()):
                found = Counter(RUN.findall(t.translate(_LOWER))) if t else {}
                start = zlib.crc32(f"{i}:".encode())
                for w, n in found.items():
                    total[derive(i, start, w) if derive else w] += n
            kept = {w: n for w, n in total.items() if len(w) >= letters}
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(kept.values(), pa.int64())], ["word", "n"])

    some = docs.select("doc_id", "text").mapInArrow(run, "word string, n long").where(F.char_length("word") >= letters)
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).withColumn("size", F.char_length("word"))


def _key(word: Column, size: Column, a: Column, z: Column, longer: Column) -> Column:
    """What is outside the block from a to z of a word of ``size``; in a word that is ``longer`` by one, the block is so too."""
    before, after = F.substring(word, F.lit(1), a), F.substring(word, z + longer + 1, size - z)
    return F.struct(size.alias("size"), a.alias("a"), z.alias("z"), F.concat_ws("\x00", before, after).alias("kept"))


def _halves(a: Column, z: Column) -> Column:
    """The two even parts of a block; a block of one code point is itself."""
    mid = a + F.floor((z - a) / 2).cast("int")
    part = lambda x, y: F.struct(x.alias("a"), y.alias("z"))
    return F.when(z - a > 1, F.array(part(a, mid), part(mid, z))).otherwise(F.array(part(a, z)))


def near(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, na, b, nb), once each and in one order, of the words of ``words(word, n, size)`` that are one edit apart."""
    whole = [F.lit(0).alias("lo"), F.col("size").alias("hi")]
    own = words.select("word", "n", "size", F.lit(0).alias("longer"), *whole)
    longer = words.where("size > 1").select("word", "n", (F.col("size") - 1).alias("size"), F.lit(1).alias("longer"), F.lit(0).alias("lo"), (F.col("size") - 1).alias("hi"))
    todo, met = own.unionByName(longer), []
    while True:
        keyed = todo.withColumn("part", F.explode(_halves(F.col("lo"), F.col("hi")))).select(
            "word", "n", "longer", _key(F.col("word"), F.col("size"), F.col("part.a"), F.col("part.z"), F.col("longer")).alias("key")
        )
        keyed = cut(keyed, "keyed")
        shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("longer").alias("least"))
        # A key that no word of its own length has, or one word alone, has no pairs.
        hot = F.col("members") > crowd
        open_ = F.col("key.z") - F.col("key.a") > 1
        shared = cut(shared.where("members > 1 and least = 0"), "shared")
        cold = keyed.join(shared.where(~(hot & open_)).select("key"), "key", "left_semi")
        met.append((keyed, shared, _verified(cold)))
        crowded = shared.where(hot & open_).select("key")
        if crowded.isEmpty():
            break
        todo = keyed.join(crowded, "key", "left_semi").select("word", "n", F.col("key.size").alias("size"), "longer", F.col("key.a").alias("lo"), F.col("key.z").alias("hi"))
    pairs = met[0][2]
    for _, _, more in met[1:]:
        pairs = pairs.unionByName(more)
    out = cut(pairs.distinct(), "near")
    discard(*(t for k, s, _ in met for t in (k, s)))
    return out


def _verified(keyed: DataFrame) -> DataFrame:
    """Of rows that share a key: the pairs of words one edit apart, one of them at least of the key's own length."""
    left = keyed.where("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    right = keyed.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("nb"))
    once = (F.col("longer") == 1) | (F.col("a") < F.col("b"))
    return left.join(right, (left["key"] == right["key"]) & once & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb")


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n): each word with its number of near words and its form."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m"))))
    sides = pairs.select(ends.alias("side")).select("side.*")
    # Of equal counts the smallest word: strings are ordered by bytes, and UTF-8 keeps code-point order.
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    had = words.join(best, "word", "left")
    takes = -F.col("best.m") >= times * F.col("n")
    return had.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.m")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) for the words of ``formed(word, form)`` that have a form: the end of the chain of forms."""
    jump = cut(formed.where("form is not null").select("word", F.col("form").alias("root")), "jump")
    while True:
        on = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = jump.join(on, "root", "left")
        step = cut(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "jump")
        discard(jump)
        jump = step
        if jump.where("moved").isEmpty():
            return jump.select("word", "root")


def variants(docs: DataFrame, derive: Derive | None = None, letters: int = LETTERS, least: int = 5, times: int = TIMES, crowd: int = CROWD) -> DataFrame:
    """The words of ``docs(doc_id, text)`` with their forms, the roots of these and their counts."""
    words = cut(vocabulary(docs, derive, letters, least), "words")
    formed = cut(forms(words, near(words, crowd), times), "forms")
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents' vocabulary with its near words counted, its form and its root."""
    return variants(table(spark, sf_dir, "documents"), derived)
