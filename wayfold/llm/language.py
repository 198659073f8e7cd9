"""Language ID by a byte convolutional network.

Filters of several widths run over fixed windows of bytes; each filter's maximum over a window goes
through a softmax layer.  Training is numpy: since only a filter's best place gets a gradient, a
step scatters into few weights.  Applying it walks all windows of a block of texts at once with
tables of byte pairs, keeps running maxima, and averages the windows' probabilities by their bytes.

Defined cases: null text, or text without a letter, is ``und`` with score 0; if nothing is labelled,
every row is ``und``; a null doc_id is not held out; of rows that share a doc_id the least text
is trained on; repeated rows get a row each; texts of any
length are walked whole; an empty table gives an empty result; further columns are left out.
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

#: Bounds of the sample of labelled documents that the network is trained on: rows, and bytes of each text.
TRAINING_ROWS, TRAINING_BYTES = 3_000, 16_384
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
STEPS, BATCH, RATE = 300, 96, 0.02


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Network:
    """One-hot byte filters by width and offset, their biases, and the softmax layer."""

    langs: list[str]
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """For each width, tables by byte pair (index first * 256 + second) and where the pair begins."""
        out = {}
        for w, f in self.filters.items():
            parts = []
            for k in range(0, w, 2):
                second = f[k + 1][None, :, :] if k + 1 < w else 0
                pair = np.broadcast_to(f[k][:, None, :] + second, (256, 256, FILTERS)).reshape(65536, FILTERS)
                parts.append((k, np.ascontiguousarray(pair, np.float32)))
            out[w] = parts
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], langs: list[str], seed: int = 5) -> Network | None:
    """Adam on random windows; rare languages are drawn as often as frequent ones."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    of = [np.flatnonzero(y == c) for c in range(len(names))]
    p = {f"f{w}": rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        p[f"f{w}"][:, 0, :] = 0
    p |= {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}
    p |= {"d": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))).astype(np.float32), "c": np.zeros(len(names), np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    places = WINDOW
    for step in range(1, STEPS + 1):
        label = rng.integers(0, len(names), BATCH)
        x = np.zeros((BATCH, WINDOW + 3), np.uint8)
        for i, c in enumerate(label):
            t = texts[rng.choice(of[c])]
            a = rng.integers(0, max(1, len(t) - WINDOW // 2 + 1))
            piece = np.frombuffer(t[a : a + WINDOW], np.uint8)
            x[i, : len(piece)] = piece
        best, top = {}, []
        for w in WIDTHS:
            z = sum(p[f"f{w}"][k][x[:, k : k + places]] for k in range(w))
            best[w] = z.argmax(axis=1)
            top.append(np.take_along_axis(z, best[w][:, None, :], 1)[:, 0, :] + p[f"b{w}"])
        h = np.concatenate(top, 1)
        r = np.maximum(h, 0)
        q = softmax(r @ p["d"] + p["c"])
        q[np.arange(BATCH), label] -= 1
        q /= BATCH
        g = {"d": r.T @ q + 1e-4 * p["d"], "c": q.sum(0)}
        back = (q @ p["d"].T) * (h > 0)
        for n, w in enumerate(WIDTHS):
            b = back[:, n * FILTERS : (n + 1) * FILTERS]
            g[f"b{w}"] = b.sum(0)
            gf = np.zeros_like(p[f"f{w}"])
            for k in range(w):
                byte = np.take_along_axis(x, best[w] + k, 1)
                np.add.at(gf[k], (byte, np.arange(FILTERS)[None, :]), b)
            gf[:, 0, :] = 0
            g[f"f{w}"] = gf
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
            p[k] = p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return Network(names, {w: p[f"f{w}"] for w in WIDTHS}, {w: p[f"b{w}"] for w in WIDTHS}, p["d"], p["c"])


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_HIGH = np.arange(256) >= 128
PART = 1024


def predict(net: Network, tables: dict, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the likeliest language of each text (-1: no letter) and its probability."""
    n, size = len(at) - 1, np.diff(at)
    windows = -(-(size + 3) // WINDOW)
    base = np.concatenate([[0], np.cumsum(windows)])
    room = np.zeros(base[-1] * WINDOW + 4, np.uint8)
    room[np.arange(len(buf)) + np.repeat(base[:-1] * WINDOW - at[:-1], size)] = buf
    owner = np.repeat(np.arange(n), windows)
    letters = (_LETTER | _HIGH)[room[:-4]].reshape(-1, WINDOW).sum(axis=1)
    out = np.zeros((n, len(net.langs)))
    for a in range(0, len(owner), PART):
        z = min(a + PART, len(owner))
        flat = room[a * WINDOW : z * WINDOW + 4].astype(np.uint16)
        pair = ((flat[:-1] << 8) | flat[1:]).astype(np.int64)
        length = (z - a) * WINDOW
        shifted = {k: np.ascontiguousarray(pair[k : k + length].reshape(z - a, WINDOW).T) for k in (0, 2)}
        top = []
        for w, parts in tables.items():
            acc = np.full((z - a, FILTERS), -np.inf, np.float32)
            one, two = np.empty_like(acc), np.empty_like(acc)
            for i in range(WINDOW):
                np.take(parts[0][1], shifted[0][i], axis=0, out=one, mode="clip")
                if len(parts) > 1:
                    np.take(parts[1][1], shifted[2][i], axis=0, out=two, mode="clip")
                    one += two
                np.maximum(acc, one, out=acc)
            top.append(acc + net.bias[w])
        q = softmax(np.maximum(np.concatenate(top, 1), 0) @ net.dense + net.dense_bias)
        np.add.at(out, owner[a:z], q * (letters[a:z, None] + 1e-6))
    out /= out.sum(axis=1, keepdims=True)
    ascii_letters, high = tx.per_text(_LETTER[buf], at), tx.per_text(_HIGH[buf], at)
    best = out.argmax(axis=1)
    for i in np.flatnonzero(ascii_letters == 0):
        if not high[i] or not any(c.isalpha() for c in buf[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")):
            best[i] = -1
    return best, np.where(best < 0, 0.0, out.max(axis=1))


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    kept = docs.select("doc_id", held_out().alias("held_out"), "text")
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    made: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if net is not None and not made:
            made.append(net.tables())
        for block in tx.blocks(batches, "text"):
            if net is None:
                best, score = np.full(block.num_rows, -1), np.zeros(block.num_rows)
            else:
                best, score = predict(net, made[0], *tx.raw(block.column("text")))
            names = [*(net.langs if net else []), "und"]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("held_out"), pa.array([names[b] for b in best], pa.string()), pa.array(np.minimum(score, 1.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def fit(docs: DataFrame, rows: int = TRAINING_ROWS, most_bytes: int = TRAINING_BYTES) -> Network | None:
    """Train on a bounded sample of labelled documents, picked by a hash of the id."""
    known = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") <= most_bytes) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    picked = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(rows)
    got = known.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("x")).select("doc_id", "x.*").toPandas().sort_values("doc_id")
    return train([t.encode() for t in got["text"]], list(got["lang"]))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
