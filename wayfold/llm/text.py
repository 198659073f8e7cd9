"""Whole Arrow text columns as byte arrays: words, n-grams and their hashes in numpy.

Words are the maximal runs of bytes outside ``\\x20 \\x09-\\x0D``.  Texts are taken in
blocks of rows of about ``BLOCK_BYTES``, so a worker's memory is bounded by the block
or the longest single text; every text is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 18
LONG_SPAN = 128
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
_RANDOM = np.random.default_rng(20_240_607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ _U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    have = _POWERS.get("byte")
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = _POWERS["byte"] = tuple(made)
    return have[0][:n], have[1][:n]


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch in runs of rows whose texts hold about ``most`` bytes at most."""
    for batch in batches:
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(size) // most
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(size)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, end to end, and where each begins (one more than rows); null is empty."""
    column = pa.concat_arrays([column.cast(pa.large_binary()).fill_null(b"")])
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each text's first word (one more than texts)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[at] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | first[:-1]))
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(start, at)


def rolling_hash(buf: np.ndarray, g: int) -> np.ndarray:
    """A cheap hash of the g bytes from each byte on, for choosing places; equal strings agree, unequal ones may too."""
    power, back = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[:-1], out=total[1:])
    return mix((total[g:] - total[:-g]) * back[: max(len(buf) - g + 1, 0)])


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: eight at a time through the finaliser, XXH3 for spans of more than ``LONG_SPAN``."""
    size = end - start
    out = mix(size.astype(np.uint64), 1)
    if not len(size):
        return out
    room = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", room, strides=(1,))
    live = np.flatnonzero(size <= LONG_SPAN)
    at, left = start[live], size[live]
    while len(live):
        some = left > 0
        if not some.all():
            live, at, left = live[some], at[some], left[some]
        unused = np.maximum(8 - left, 0).astype(np.uint64) * _U(8)
        out[live] = mix(out[live] * _U(0x9FB21C651E98DF25) ^ (eight[at] << unused), 2)
        at, left = at + 8, left - 8
    for i in np.flatnonzero(size > LONG_SPAN):
        out[i] = xxhash.xxh3_64_intdigest(buf[start[i] : end[i]])
    return out


def strong_hash(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit XXH3 of each span's bytes, as two columns of int64."""
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    got = np.frombuffer(b"".join([digest(view[a:z]) for a, z in zip(start.tolist(), end.tolist())]), np.int64).reshape(-1, 2)
    return np.ascontiguousarray(got[:, 0]), np.ascontiguousarray(got[:, 1])


def gram_hash(word_hash: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A hash of the n words from each word on; shorter by n - 1, and it runs over text ends."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = mix(word_hash[:m], salt)
    for j in range(1, n):
        h = mix(h * _U(0xD6E8FEB86659FD93) + word_hash[j : m + j])
    return h


def within(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of words at which n words of one text begin, and the text of each."""
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), np.maximum(size - n + 1, 0))
    if not len(doc):
        return np.zeros(0, np.int64), doc
    count = np.maximum(size - n + 1, 0)
    base = np.repeat(np.cumsum(count) - count, count)
    return first[:-1][doc] + np.arange(len(doc)) - base, doc


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive ``at``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]
