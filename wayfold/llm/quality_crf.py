"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line that holds a word is labelled good or bad from its own features and those of the lines
before and after it.  Training (numpy, a bounded sample) takes each line of a labelled document as
labelled like the document.  A document's raw score is the mean of its lines' forward-backward
marginals weighted by their length; a logistic curve fitted on the training documents calibrates it.

Defined cases: a text without words (null, empty) has no line and gets score 0; without labels of
both kinds every score is 0.5; documents with contradictory labels are not trained on, of rows that share
a doc_id the least text is; a null doc_id is not held out; one very long line is one line;
repeated rows get a row each; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .language import held_out
from .store import table

#: Bounds of the sample of labelled documents that the field is trained on: rows, and bytes of each text.
TRAINING_ROWS, TRAINING_BYTES = 6_000, 16_384
THRESHOLD = 0.7
STEPS, RATE = 150, 0.1
OWN = ["log_words", "word_length", "symbols", "uppers", "digits", "marks", "repeated_line", "unique_words", "repeated_grams", "ends_sentence"]


def _in(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


_KINDS = {"symbols": _in(b"#*$%&|<>=_~^{}[]\\@+"), "uppers": _in(bytes(range(65, 91))), "digits": _in(bytes(range(48, 58))), "marks": _in(b"!?")}
_ENDS = _in(b".!?:;")


def line_features(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: its text's index, its length in bytes, and its features."""
    start, end, first = tx.words(buf, at)
    n = len(at) - 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(OWN)))
    breaks = np.cumsum(buf == 10)
    text_of = np.repeat(np.arange(n), np.diff(first))
    fresh = np.append(True, (breaks[start[1:]] != breaks[start[:-1]]) | (text_of[1:] != text_of[:-1]))
    line = np.append(np.flatnonzero(fresh), len(start))
    doc, begin, stop = text_of[line[:-1]], start[line[:-1]], end[line[1:] - 1]
    count = np.diff(line)
    hashed = tx.span_hash(buf, start, end)
    total = lambda which: (c := np.concatenate([[0], np.cumsum(which, dtype=np.int64)]))[stop] - c[begin]
    chars = np.maximum(total(~tx.SPACE[buf] & ((buf & 0xC0) != 0x80)), 1)
    x = np.zeros((len(doc), len(OWN)))
    x[:, 0] = np.log1p(count) / 3
    x[:, 1] = chars / count / 6
    for name, which in _KINDS.items():
        x[:, OWN.index(name)] = total(which[buf]) / (count if name == "marks" else chars)
    salt = lambda h, d: tx.mix(h + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 9)
    _, back, times = np.unique(salt(tx.span_hash(buf, begin, stop), doc), return_inverse=True, return_counts=True)
    x[:, 6] = times[back] > 1
    line_of = np.repeat(np.arange(len(doc)), count)
    _, where = np.unique(salt(hashed, line_of), return_index=True)
    x[:, 7] = np.bincount(line_of[where], minlength=len(doc)) / count
    at3, holder = tx.within(first, 3)
    _, back, times = np.unique(salt(tx.gram_hash(hashed, 3)[at3], holder), return_inverse=True, return_counts=True)
    x[:, 8] = np.bincount(line_of[at3[times[back] > 1]], minlength=len(doc)) / count
    x[:, 9] = _ENDS[buf[stop - 1]]
    return doc, stop - begin, x


@dataclass
class Field:
    """Standardisation, weights of the good label by feature, transition scores, and the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    move: np.ndarray
    slope: float = 4.0
    shift: float = 0.0


def with_neighbours(z: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after in its text, edges, squares, and a constant."""
    same = (doc[1:] == doc[:-1])[:, None]
    before, after = np.zeros_like(z), np.zeros_like(z)
    before[1:] = z[:-1] * same
    after[:-1] = z[1:] * same
    edge = np.ones((len(z), 3))
    edge[1:, 0] = ~same[:, 0]
    edge[:-1, 1] = ~same[:, 0]
    return np.concatenate([z, np.minimum(z * z, 9), before, after, edge], axis=1)


def marginals(score: np.ndarray, move: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected number of moves between labels, by forward-backward over all texts at once."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]]) if len(doc) else np.zeros(1, np.int64)
    begin, size = cuts[:-1], np.diff(cuts)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    emit = np.stack([np.zeros_like(score), score], 1)
    emit -= emit.max(axis=1, keepdims=True)
    emit = np.exp(emit)
    trans = np.exp(move - move.max())
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # texts with more than t lines
    for t in range(longest):
        i = begin[: active[t]] + t
        a = emit[i] if t == 0 else emit[i] * (alpha[i - 1] @ trans)
        alpha[i] = a / a.sum(axis=1, keepdims=True)
    moved = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        i = begin[: active[t + 1]] + t
        ahead = emit[i + 1] * beta[i + 1]
        b = ahead @ trans.T
        pair = alpha[i][:, :, None] * trans[None] * ahead[:, None, :]
        moved += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[i] = b / b.sum(axis=1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1), moved


def train(column: pa.Array, quality: np.ndarray) -> Field | None:
    """Maximum likelihood with Adam; classes weigh alike."""
    if len(set(quality.tolist())) < 2:
        return None
    parts, done = [], 0
    for block in tx.blocks(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text"):
        doc, length, x = line_features(*tx.raw(block.column("text")))
        parts.append((doc + done, length, x))
        done += block.num_rows
    doc, length, x = (np.concatenate(p) for p in zip(*parts))
    if not len(doc):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    f = with_neighbours(np.clip((x - mean) / scale, -5, 5), doc)
    y = quality[doc].astype(float)
    field = Field(mean, scale, np.zeros(f.shape[1]), np.zeros((2, 2)))
    stays = (doc[1:] == doc[:-1]).astype(float)
    seen = np.array([[((1 - y[1:]) * stays).sum(), 0], [0, (y[1:] * stays).sum()]])
    n, k = len(doc), f.shape[1]
    theta, m1, m2 = np.zeros(k + 4), np.zeros(k + 4), np.zeros(k + 4)
    for step in range(1, STEPS + 1):
        p, moved = marginals(f @ theta[:k], theta[k:].reshape(2, 2), doc)
        g = np.concatenate([f.T @ (p - y), (moved - seen).ravel()]) / n + 1e-3 * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta - RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    field.weight, field.move = theta[:k], theta[k:].reshape(2, 2)
    raw = document_logit(field, doc, length, x, len(quality))
    has = np.isfinite(raw)
    a, b = 1.0, 0.0
    t = quality[has].astype(float)
    weight = np.where(t == 1, 0.5 / max(t.mean(), 1e-6), 0.5 / max(1 - t.mean(), 1e-6))
    for _ in range(50):  # Newton's method
        q = 1 / (1 + np.exp(-(a * raw[has] + b)))
        r = np.stack([raw[has], np.ones(has.sum())])
        h = (r * weight * q * (1 - q)) @ r.T + 1e-2 * np.eye(2)
        a, b = np.array([a, b]) - np.linalg.solve(h, r @ (weight * (q - t)) + 1e-2 * np.array([a, b]))
    field.slope, field.shift = float(a), float(b)
    return field


def document_logit(field: Field, doc: np.ndarray, length: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Log-odds of the length-weighted mean marginal of each text; minus infinity if it has no line."""
    if not len(doc):
        return np.full(n, -np.inf)
    f = with_neighbours(np.clip((x - field.mean) / field.scale, -5, 5), doc)
    p, _ = marginals(f @ field.weight, field.move, doc)
    total = np.bincount(doc, weights=length, minlength=n)
    good = np.bincount(doc, weights=length * p, minlength=n)
    share = np.clip(good / np.maximum(total, 1), 1e-4, 1 - 1e-4)
    return np.where(total > 0, np.log(share / (1 - share)), -np.inf)


def score_texts(field: Field | None, column: pa.Array) -> np.ndarray:
    """Score of each text of a block."""
    if field is None:
        return np.full(len(column), 0.5)
    logit = document_logit(field, *line_features(*tx.raw(column)), len(column))
    slope = max(field.slope, 1e-3)
    return np.where(np.isfinite(logit), 1 / (1 + np.exp(-np.clip(slope * np.where(np.isfinite(logit), logit, 0) + field.shift, -50, 50))), 0.0)


def score(docs: DataFrame, field: Field | None, *also: str) -> DataFrame:
    """The columns named in ``also`` (but such as clash with ours), with held_out, score and predicted, of every row."""
    also = tuple(c for c in also if c not in ("held_out", "score", "predicted"))
    kept = docs.select(*dict.fromkeys([*also, "text"]), held_out().alias("held_out"))
    names = [*also, "held_out"]
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tx.blocks(batches, "text"):
            s = score_texts(field, block.column("text"))
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in names), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*names, "score", "predicted"])

    return kept.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, most_bytes: int = TRAINING_BYTES) -> Field | None:
    """Train on a bounded sample of labelled documents that are not held out, picked by a hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    picked = known.select("doc_id", "quality").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(rows)
    short = docs.select("doc_id", "text").where(F.octet_length("text") <= most_bytes)
    got = short.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("x")).select("doc_id", "x.*").toPandas().sort_values("doc_id")
    return train(pa.array(list(got["text"]), pa.string()), got["quality"].to_numpy(int)) if len(got) else None


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), "doc_id")
