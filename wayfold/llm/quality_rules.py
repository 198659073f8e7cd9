"""Quality rules: a decision list learned by sequential covering.

``statistics`` measures whole texts.  ``learn`` grows threshold conjunctions that cover bad
documents on two thirds of a bounded labelled sample and prunes them on the rest; ``verdict``
turns the ordered list into one Spark conditional expression.

Defined cases: a null or empty text has zero of everything and fails the base rule; repeated
rows are judged one by one; documents with contradictory labels teach nothing; without labels (or with one class) the list is empty and only the
base rule rejects; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .store import table

#: Bound of the labelled sample that the list is learned from.
LABELLED_ROWS = 20_000
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_digits", "n_marks", "n_unique_words"]
#: Statistic -> what it is a share of.
SHARES = {
    "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"), "mark_share": ("n_marks", "n_words"),
    "unique_share": ("n_unique_words", "n_words"), "word_length": ("word_chars", "n_words"), "line_words": ("n_words", "n_lines"),
}
FEATURES = [*SHARES, "n_words"]


def _in(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


_SYMBOL, _UPPER, _DIGIT, _MARK = _in(SYMBOLS), _in(bytes(range(65, 91))), _in(bytes(range(48, 58))), _in(b"!?")


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of a block."""
    buf, at = tx.raw(column)
    start, end, first = tx.words(buf, at)
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    hashed = tx.span_hash(buf, start, end)
    out = {"n_words": np.diff(first), "word_chars": tx.per_text(~tx.SPACE[buf] & ((buf & 0xC0) != 0x80), at)}
    for name, which in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
        out[name] = tx.per_text(which[buf], at)
    own = lambda values, docs: tx.mix(values + docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 7)
    seen, where = np.unique(own(hashed, doc), return_index=True)
    out["n_unique_words"] = np.bincount(doc[where], minlength=n)

    out["n_lines"] = tx.per_text(buf == 10, at) + 1
    # Lines are compared as they are, not by a hash.
    whole = buf.tobytes()
    lines = ([x for x in whole[a:z].split(b"\n") if x and not x.isspace()] for a, z in zip(at[:-1].tolist(), at[1:].tolist()))
    out["n_dup_lines"] = np.fromiter((len(x) - len(set(x)) for x in lines), np.int64, n)

    begin, holder = tx.within(first, WINDOW)
    grams = own(tx.gram_hash(hashed, WINDOW)[begin], holder)
    _, back, times = np.unique(grams, return_inverse=True, return_counts=True)
    begin = begin[times[back] > 1]
    edge = np.zeros(len(start) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + WINDOW, -1)
    out["n_repeat_words"] = tx.per_text(np.cumsum(edge[:-1]) > 0, first)
    return out


def statistics(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, the columns named in ``also``, and the counts of each whole text; one row for each row."""
    keep = ["doc_id", *also]
    kept = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text"):
            found = measure(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column(c) for c in keep] + [pa.array(found[c].astype(np.int64)) for c in COUNTS + MORE], keep + COUNTS + MORE)

    return kept.mapInArrow(run, schema + "".join(f", {c} long" for c in COUNTS + MORE))


def features(stats: DataFrame) -> DataFrame:
    """The statistics with the shares that rules may test."""
    share = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))
    return stats.withColumns({name: share(*of) for name, of in SHARES.items()})


@dataclass(frozen=True)
class Rule:
    """A conjunction: (feature, whether above, threshold) each."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, limit in self.tests:
            out = out & (F.col(name) > limit if above else F.col(name) <= limit)
        return out

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, limit in self.tests:
            out &= x[name] > limit if above else x[name] <= limit
        return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_tests: int = 3, least_cover: int = 3) -> list[Rule]:
    """Sequential covering of the bad rows: grow on two of three rows, prune on the third, remove what is covered."""
    n = len(bad)
    grow_part = np.arange(n) % 3 != 2
    left, rules = np.ones(n, bool), []
    while len(rules) < most_rules and (bad & left & grow_part).sum() >= least_cover:
        rule = Rule(())
        now = left & grow_part
        while len(rule.tests) < most_tests and (now & ~bad).any():
            p0, n0 = (now & bad).sum(), (now & ~bad).sum()
            best = (1e-9, None, None)
            for name in FEATURES:
                values = x[name][now]
                for limit in np.unique(np.quantile(values, np.linspace(0.005, 0.995, 100), method="midpoint")):
                    for above in (True, False):
                        hit = values > limit if above else values <= limit
                        p = (hit & bad[now]).sum()
                        if p < least_cover or p + (m := (hit & ~bad[now]).sum()) == p0 + n0:
                            continue
                        gain = p * (np.log2(p / (p + m)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, (name, above, float(limit)), hit)
            if best[1] is None:
                break
            rule = Rule((*rule.tests, best[1]))
            at = np.flatnonzero(now)
            now[at[~best[2]]] = False
        held = left & ~grow_part

        def worth(r: Rule) -> float:
            hit = r.covers(x) & held
            p, m = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - m) / (p + m) if p + m else -1.0

        while len(rule.tests) > 1 and worth(Rule(rule.tests[:-1])) >= worth(rule):
            rule = Rule(rule.tests[:-1])
        if not rule.tests or worth(rule) < 0.8:
            break
        rules.append(rule)
        left &= ~rule.covers(x)
    return rules


def sample(labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, quality) of at most ``rows`` labelled documents, picked by a hash of the id; documents with contradictory labels are left out."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("most"))
    return known.where("quality = most").select("doc_id", "quality").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> list[Rule]:
    """Learn the list from the bounded labelled sample; of rows that share a doc_id the one with the least counts."""
    drawn = docs.select("doc_id", "text").join(F.broadcast(sample(labels, rows)), "doc_id")
    numbers = features(statistics(drawn, "quality")).groupBy("doc_id").agg(F.min(F.struct("quality", *FEATURES)).alias("x"))
    got = numbers.select("doc_id", "x.*").toPandas().sort_values("doc_id").reset_index(drop=True)
    if got.empty or got["quality"].nunique() < 2:
        return []
    return learn({c: got[c].to_numpy(float) for c in FEATURES}, got["quality"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """Kept or not, and the number of the first rule that fires (null if none), as ordered conditionals."""
    if not rules:
        return F.lit(True), F.lit(None).cast("int")
    which = F.when(rules[0].column(), F.lit(0))
    for k, rule in enumerate(rules[1:], 1):
        which = which.when(rule.column(), F.lit(k))
    which = which.cast("int")
    return which.isNull(), which


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Every row with its counts, base verdict, the rule that rejects it, and the whole verdict."""
    good, which = verdict(rules)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = features(statistics(docs)).withColumns({"base_failed": base, "rule": which})
    return found.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & good).alias("kept"), "rule")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
