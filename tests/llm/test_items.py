"""Benchmark items of all lengths in edited copies, against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from wayfold.llm import decontaminate

from .edits import best_match
from .test_operators import prose

DOCS = "doc_id long, text string"


def edited(rng, item, rate):
    copy = list(item)
    for _ in range(round(rate * len(item))):
        at, how = rng.randrange(len(copy)), rng.randrange(3)
        if how == 0:
            copy[at] = rng.choice("etaoin shrdlu")
        elif how == 1:
            copy.insert(at, rng.choice("etaoin shrdlu"))
        elif len(copy) > 1:
            del copy[at]
    return "".join(copy)


@pytest.mark.parametrize("words", [(5, 8), (8, 13), (14, 40)])
def test_recall_by_lengths_and_rates(spark, words):
    rng = random.Random(words[0])
    items = [re.sub(r"\s+", " ", prose(rng, rng.randint(*words))) for _ in range(60)]
    rows = [(len(items) * r + k, prose(rng, 30) + " " + edited(rng, item, rate) + " " + prose(rng, 30)) for r, rate in enumerate((0.05, 0.1, 0.15, 0.18, 0.2)) for k, item in enumerate(items)]
    found = decontaminate.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in found}
    fold = lambda t: re.sub(r"\s+", " ", t).strip().lower().encode()
    asked = {}
    for d, text in rows:
        for k, item in enumerate(items):
            near = best_match(fold(item), fold(text), 10**6)
            if near <= int(0.2 * len(fold(item)) + 1e-9):
                asked.setdefault(d // len(items), []).append((d, k))
                assert got.get((d, k), near) == near
    # Nothing is told that is not near, and of each rate nine of ten pairs are.
    assert got.keys() <= {x for v in asked.values() for x in v}
    assert all(len(v) >= 20 and sum(x in got for x in v) >= 0.9 * len(v) for v in asked.values()), [(r, len(v), sum(x in got for x in v)) for r, v in asked.items()]


def test_keys_in_parts_find_the_same(spark, monkeypatch):
    rng = random.Random(2)
    items = [re.sub(r"\s+", " ", prose(rng, rng.randint(5, 40))) for _ in range(60)]
    rows = [(k, prose(rng, 30) + " " + edited(rng, item, 0.08) + " " + prose(rng, 30)) for k, item in enumerate(items)] + [(100, None), (101, prose(rng, 300))]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    find = lambda: {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    whole = find()
    monkeypatch.setattr(decontaminate, "MOST_FILTER_BITS", 16)
    monkeypatch.setattr(decontaminate, "LEAST_SHARE", 20)
    assert find() == whole and len(whole) >= 55


def test_blocks_leave_out_most_pairs_and_none_within_reach():
    rng = random.Random(4)
    items, texts, first, last = [], [], [], []
    for k in range(300):
        item = prose(rng, rng.randint(5, 60))
        before = prose(rng, rng.randint(0, 40)) + " "
        copy = edited(rng, item, 0.2) if k % 3 == 0 else prose(rng, 60)
        at = len(before) + rng.randint(-9, 9)
        items.append(item.encode())
        texts.append((before + copy + " " + prose(rng, 30)).encode())
        first.append(at)
        last.append(at + rng.randint(0, 9))
    first, last = np.array(first), np.array(last)
    most = (0.2 * np.array([len(i) for i in items]) + 1e-9).astype(int)
    left = set(decontaminate.promising(items, texts, first, last, most).tolist())
    size = np.array([len(i) for i in items])
    cut = [t[max(0, a) : max(0, z)] for t, a, z in zip(texts, first - most, last + size + most)]
    near = set(np.flatnonzero(decontaminate.best_matches(items, cut) <= most).tolist())
    assert near <= left and len(near) > 50 and sum(size[p] > 64 for p in left - near) < 20
    assert decontaminate.promising([], [], first[:0], last[:0], most[:0]).tolist() == []
