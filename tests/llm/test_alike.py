"""Texts alike in their shingles, and components, against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wayfold.llm import components, jaccard, store

from .test_operators import classes

DOCS = "xt long, text string"


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def groups_of(spark, rows):
    links = jaccard.similar(spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit(1), "set": F.lit(2), "n": F.lit(3)}).repartition(5), 0.8)
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    return {i: found.get(i, i) for i, _ in rows}


def brute(rows):
    sets = [shingles(t or "") for _, t in rows]
    alike = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    ids = [i for i, _ in rows]
    of = classes(len(rows), alike)
    return {i: ids[c] for i, c in zip(ids, of)}


def template(rng, fill, k, words=90):
    """Texts that share a template and differ in a part of it, at its start."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    return [" ".join([f"x{rng.randrange(10**7)}" for _ in range(int(words * fill))] + base[int(words * fill) :]) for _ in range(k)]


@pytest.mark.parametrize("fill", [0.05, 0.1, 0.12, 0.2, 0.3])
def test_templates_are_linked_as_all_pairs_are(spark, fill):
    rng = random.Random(int(fill * 100))
    texts = template(rng, fill, 60)
    # Near copies of some, longer and shorter, so that the odd ones have likes of their own.
    texts += [t + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randint(1, 18))) for t in texts[:25]] + [" ".join(t.split()[: rng.randint(70, 88)]) for t in texts[10:40]]
    texts += ["", "a b", "A  b", "a b c d e", "only " * 3000, "only " * 2900, texts[0], texts[0]]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert groups_of(spark, rows) == brute(rows)


def test_rows_of_one_identity_and_none(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "")]
    assert groups_of(spark, rows)[2] == 1 and groups_of(spark, rows)[3] == 3
    assert jaccard.similar(spark.createDataFrame([], DOCS), 0.8).count() == 0


def test_templated_texts_deal_rows_in_proportion(spark, monkeypatch):
    rng, dealt = random.Random(3), {}
    real = jaccard.cut

    def counted(df, name):
        out = real(df, name)
        dealt[name] = dealt.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "cut", counted)
    texts = template(rng, 0.27, 8000)
    rows = {}
    for n in (2000, 8000):
        dealt.clear()
        assert set(groups_of(spark, list(enumerate(texts[:n]))).values()) == set(range(n))
        rows[n] = sum(v for k, v in dealt.items())
    assert rows[8000] < 4.5 * rows[2000]


def test_components_of_random_links(spark):
    rng = random.Random(8)
    for n, m in ((1, 0), (40, 25), (60, 90)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(100, 100 + n)]
        of = classes(300, links)
        got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame([*links, *links], "src long, dst long")).collect()}
        assert got == {k: c for k, c in enumerate(of) if k != c}
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_what_shares_no_key_is_sifted_out_before_a_join(spark, monkeypatch):
    every = spark.range(20_000).select(F.struct(F.col("id").alias("a"), (F.col("id") * 7).alias("b")).alias("xt"), F.lit("some text").alias("text"), F.lit(1).alias("word"))
    few = every.where("xt.a % 20 = 0").select("xt")
    left = store.sifted(every, few, "xt")
    assert left.columns == ["xt", "text", "word"] and left.join(few, "xt").count() == 1000 and left.count() < 3500
    # Of more keys than the bits are made for, more others pass, and no key goes.
    monkeypatch.setattr(store, "MOST_SIEVE_BITS", 4)
    assert store.sifted(every, few, "xt").join(few, "xt").count() == 1000
    assert store.sifted(every, few.limit(0), "xt").count() == 0
    # The sieve stands below the exchange of whole texts.
    plan = left.join(few, "xt")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ones") and plan.count("Join") == 2
