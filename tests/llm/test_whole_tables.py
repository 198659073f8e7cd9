"""The queries' contracts over all documents of a table, against plain Python."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from wayfold.llm import debruijn, decontaminate, quality_crf, quality_rules, registry, simhash, suffix_dedup  # noqa: F401
from wayfold.llm.store import table

from .edits import best_match

from .test_operators import brute_fingerprint, brute_words, classes, count_words, edit

TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, TABLES, "documents").collect()}


def run(spark, name):
    return registry.queries()[name](spark, TABLES).collect()


def test_quality_rules(spark, texts):
    got = {r["doc_id"]: r for r in run(spark, "op2_quality_rules")}
    rules = quality_rules.fit(table(spark, TABLES, "documents"), table(spark, TABLES, "labels"))
    stats = {r["doc_id"]: r for r in quality_rules.features(quality_rules.statistics(table(spark, TABLES, "documents"))).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        want = count_words(t)
        r, base = got[i], want[0] < 10 or 100 * want[4] > 20 * want[0]
        covered = any(bool(rule.covers({c: np.array([stats[i][c]], float) for c in quality_rules.FEATURES})[0]) for rule in rules)
        assert tuple(r[c] for c in quality_rules.COUNTS) == want and r["base_failed"] == base and r["kept"] == (not base and not covered)


def test_fingerprints_and_components(spark, texts):
    ids = sorted(texts)
    fp = [brute_fingerprint(texts[i]) for i in ids]
    of = classes(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op3_simhash_dedup")}
    assert got == {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fp, of)}


def test_repeated_bytes(spark, texts):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    times: dict[bytes, int] = {}
    for w in raw.values():
        for s in range(len(w) - 399):
            k = xxhash.xxh3_128_digest(w[s : s + 400], 7)
            times[k] = times.get(k, 0) + 1
    got = {r["doc_id"]: r for r in run(spark, "op4_suffix_dedup")}
    assert got.keys() == raw.keys()
    for i, w in raw.items():
        edge = np.zeros(len(w) + 1, int)
        for s in range(len(w) - 399):
            if times[xxhash.xxh3_128_digest(w[s : s + 400], 7)] > 1:
                edge[s] += 1
                edge[s + 400] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        kept = np.frombuffer(w, np.uint8)[~gone].tobytes()
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(w), gone.sum(), (gone & ~np.append(False, gone[:-1])).sum() if len(w) else 0, hashlib.sha256(kept).hexdigest())


def test_repeated_words(spark, texts):
    ids = sorted(texts)
    want = brute_words([texts[i] for i in ids])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run(spark, "op8_debruijn_dedup")}
    assert got == {i: want[k] for k, i in enumerate(ids)}


def test_contaminated_documents_are_near_their_items(spark, texts):
    items = {r["item_id"]: r["text"] for r in table(spark, TABLES, "benchmark").collect()}
    fold = lambda t: " ".join((t or "").split()).encode().lower()
    got = {(r["doc_id"], r["item_id"]): r for r in run(spark, "op9_decontaminate")}
    held = {i: fold(t) for i, t in texts.items()}
    assert {(i, k) for i, t in held.items() for k, item in items.items() if fold(item) and fold(item) in t} <= got.keys()
    for (i, k), r in list(got.items())[:12]:
        assert r["edits"] == edit(fold(items[k]), held[i]) <= int(0.2 * len(fold(items[k])))
    for (i, k), r in got.items():
        assert r["edits"] == best_match(fold(items[k]), held[i], 10**6) and r["item_bytes"] == len(fold(items[k]))


def test_held_out_accuracy(spark, texts):
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 4 == 2}
    lang = {r["doc_id"]: r["lang"] for r in table(spark, TABLES, "documents").collect()}
    said = {r["doc_id"]: r for r in run(spark, "op7_language_id")}
    known = [i for i in held if lang[i] and said[i]["lang_pred"] != "und"]
    assert {i for i in said if said[i]["held_out"]} == held and sum(said[i]["lang_pred"] == lang[i] for i in known) >= 0.98 * len(known)
    quality = {r["doc_id"]: r["quality"] for r in table(spark, TABLES, "labels").collect()}
    judged = {r["doc_id"]: r for r in run(spark, "op10_quality_crf")}
    asked = [i for i in held if i in quality]
    assert sum(judged[i]["predicted"] == quality[i] for i in asked) >= 0.97 * len(asked)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in judged.values())


def test_document_scores_by_enumeration():
    rng = np.random.default_rng(3)
    texts = ["one two three.\nfour FIVE six!\nseven", "a b c d e f\n\n  \n#### $$$\nlast line here", "   ", ""]
    n = len(quality_crf.OWN)
    field = quality_crf.Field(np.zeros(n), np.ones(n), rng.normal(size=4 * n + 3), rng.normal(size=(2, 2)), 1.7, -0.2)
    got = quality_crf.score_texts(field, pa.array(texts))
    for text, score in zip(texts, got):
        doc, length, x = quality_crf.line_features(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        if not len(doc):
            assert score == 0
            continue
        f = quality_crf.with_neighbours(np.clip(x, -5, 5), doc) @ field.weight
        total, good = 0.0, np.zeros(len(doc))
        for y in np.ndindex(*[2] * len(doc)):
            w = np.exp(sum(v * s for v, s in zip(y, f)) + sum(field.move[a, b] for a, b in zip(y, y[1:])))
            total, good = total + w, good + w * np.array(y)
        share = np.clip((good / total * length).sum() / length.sum(), 1e-4, 1 - 1e-4)
        assert score == pytest.approx(1 / (1 + np.exp(-(1.7 * np.log(share / (1 - share)) - 0.2))))
