"""The pipeline's stages, each against brute force on its own input."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

import corpus_pipeline
from wayfold.llm.store import cut, table

TABLES = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, TABLES, "documents")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(cut(f(spark, out[-1], TABLES), "test"))
    return out


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_columns_and_rows(stages):
    for df in stages[1:5]:
        assert df.columns == COLUMNS
    for before, after in zip(stages, stages[1:]):
        assert set(ids(after)) <= set(ids(before)) and len(ids(after)) == len(set(ids(after)))


def test_quality_follows_labels(spark, stages):
    kept = set(ids(stages[1]))
    labels = {r["doc_id"]: r["quality"] for r in table(spark, TABLES, "labels").collect()}
    assert sum((i in kept) == (q == 1) for i, q in labels.items()) >= 0.97 * len(labels)


def near_copies(texts):
    """Class of each text by all pairs: sets of five-word shingles alike in 0.8, or five-word fingerprints within 4 bits."""
    from .test_operators import WORD, brute_fingerprint, classes

    shingles = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        shingles.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    fp = [brute_fingerprint(t, 5) for t in texts]
    alike = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    return classes(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 4 or alike(a, b)])


def test_one_of_each_group_stays(stages):
    # The stage's contract: five words and a similarity of 0.8, not the four-word radius of the op3 query.
    rows = sorted((r["doc_id"], r["text"]) for r in stages[1].collect())
    assert sorted(ids(stages[2])) == sorted({rows[c][0] for c in near_copies([t for _, t in rows])})


def test_passages(stages):
    from .test_operators import brute_bytes

    rows = sorted((r["doc_id"], r["text"]) for r in stages[2].collect())
    want = {i: b[3].decode("utf-8", "ignore") for (i, _), b in zip(rows, brute_bytes([t for _, t in rows], 400))}
    assert {r["doc_id"]: r["text"] for r in stages[3].collect()} == want


def test_benchmark_passages_are_gone(spark, stages):
    fold = lambda s: re.sub(r"\s+", " ", s.lower()).strip()
    items = [fold(r["text"]) for r in table(spark, TABLES, "benchmark").collect()]
    hit = {r["doc_id"] for r in stages[3].collect() if any(i in fold(r["text"]) for i in items)}
    left = set(ids(stages[4]))
    assert not hit & left and len(set(ids(stages[3])) - left) <= len(hit) + 2


def test_mixture_keeps_all(stages):
    assert sorted(ids(stages[5])) == sorted(ids(stages[4]))
    assert len({r["mix_order"] for r in stages[5].collect()}) == len(ids(stages[5]))


def test_entry_lists_the_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"


def test_near_copies_of_similarity_point_eight_go(spark):
    import random

    from .test_operators import DOCS, prose

    rng = random.Random(11)
    texts = []
    for _ in range(12):
        words = prose(rng, 150).split()
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 3, 4, 6):
            copy = list(words)
            for at in rng.sample(range(len(words)), edits):
                copy[at] = "edited"
            texts.append(" ".join(copy))
    wide = prose(rng, 150).split()
    for _ in range(14):  # more than a pair list takes
        copy = list(wide)
        copy[rng.randrange(150)] = "edited"
        texts.append(" ".join(copy))
    texts += ["", None, "two words", "Two  Words"]
    want = set(near_copies(texts))
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    assert sorted(ids(corpus_pipeline.near_dedup(spark, docs, TABLES))) == sorted(want)


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept binary, n_bytes int, d1 int, own int, name string, found int, score int, th int, _th int, row int"


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing columns."""
    import random

    from .test_operators import prose

    rng = random.Random(5)
    a, b = prose(rng, 200), prose(rng, 200)
    texts = [(1, a), (2, b), (2, b), (3, None), (None, None), (None, ""), (4, ""), (None, a + " x"), (None, prose(rng, 150)), (5, prose(rng, 30_000)), (6, "é" * 300), (7, prose(rng, 120)), (7, prose(rng, 120))]
    return [(i, t, None, None if k % 2 else "s", None, b"k", 1, 2, 3, "n", 4, 5, 6, 7, 8) for k, (i, t) in enumerate(texts)]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, stage):
    name, f = corpus_pipeline.STAGES[stage]
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD)
    out = f(spark, docs, TABLES)
    got = out.collect()
    pairs = [(r["doc_id"], r["text"]) for r in got]
    before = [(r[0], r[1]) for r in rows]
    assert all(set(docs.columns) <= set(out.columns) for _ in [0]) and all(r["_th"] == 7 and r["kept"] == b"k" and r["score"] == 5 for r in got)
    if stage == 1:
        of = sorted(set(before), key=lambda x: (x[0] is None, x[0] or 0))
        assert len(pairs) == len(set(near_copies([t for _, t in of]))) == len(set(pairs))
    elif stage == 2:
        from .test_operators import brute_bytes

        want = [(i, None if t is None else b[3].decode("utf-8", "ignore")) for (i, t), b in zip(before, brute_bytes([t for _, t in before], 400))]
        assert sorted(map(repr, pairs)) == sorted(map(repr, want))
    elif stage in (3, 4):
        assert sorted(map(repr, pairs)) == sorted(map(repr, before))
    else:
        assert set(pairs) <= set(before)
    none = f(spark, docs.limit(0), TABLES)
    assert none.count() == 0 and set(docs.columns) <= set(none.columns)


def test_rows_whose_short_hashes_are_equal_stay_apart(spark):
    from pyspark.sql import functions as F

    from wayfold.llm import suffix_dedup

    # Of so many texts some share a 32-bit hash; with null ids nothing but the text tells them apart.
    texts = spark.range(200_000).select(F.concat(F.lit("text "), F.col("id")).alias("text"))
    same = texts.withColumn("h", F.hash("text")).groupBy("h").agg(F.sort_array(F.collect_list("text")).alias("t")).where("size(t) > 1").first()["t"][:2]
    docs = spark.createDataFrame([(None, same[0]), (None, same[1])], "doc_id long, text string")
    assert suffix_dedup.with_key(docs).select("d1", "d2").distinct().count() == 2
    docs = spark.createDataFrame([(None, t, None, None, 0) for t in same], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["text"] for r in corpus_pipeline.near_dedup(spark, docs, TABLES).collect()} == set(same)


def test_without_labels_every_document_stays(spark, tmp_path):
    table(spark, TABLES, "labels").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    docs = table(spark, TABLES, "documents")
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == docs.count()
