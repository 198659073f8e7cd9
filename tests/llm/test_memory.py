"""A worker's memory is that of a small block, however much comes at once."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa

from wayfold.llm import suffix_dedup
from wayfold.llm import text as tx


def test_blocks_of_minimisers_take_little():
    rng = random.Random(1)
    texts = [rng.randbytes(1000).hex() for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tx.powers(1 << 22)
    tracemalloc.start()
    try:
        for block in tx.blocks(iter([batch]), "text"):
            suffix_dedup.owners(*tx.raw(block.column("text")), suffix_dedup.K, suffix_dedup.GRAM)
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
