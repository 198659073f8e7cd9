"""Spelling variants, license scans and periodic runs against brute force, with nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import license_rules, license_scan, periodic, registry, spelling
from wayfold.llm.store import table

TABLES = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in table(spark, TABLES, "documents").collect()]


def frame(spark, rows):
    """With columns whose names are those of the results."""
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("n", "words", "keys", "found", "runs", "word", "key", "labels", "d1", "size")})


# 11


def brute_words(rows, derive=True, letters=6, least=5, times=5):
    total = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if derive and i is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    count = {w: n for w, n in total.items() if len(w) >= letters and n >= least}
    near, wild = defaultdict(set), defaultdict(set)
    for w in count:
        for k in range(len(w)):
            wild[w[:k], w[k + 1 :]].add(w)
            if (x := w[:k] + w[k + 1 :]) in count:
                near[w].add(x)
                near[x].add(w)
    for group in wild.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in count.items():
        if near[w] and count[b := min(near[w], key=lambda x: (-count[x], x))] >= times * n:
            form[w] = b
    out = {}
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), count.get(form.get(w)))
    return out


def forms_of(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def test_variants_of_all_documents(spark, texts):
    assert forms_of(registry.queries()["op11_spelling_variants"](spark, TABLES)) == brute_words(texts)


@pytest.mark.parametrize("crowd", [2, 7, 128])
def test_crowded_segments_lose_no_pair(spark, crowd):
    rng = random.Random(crowd)
    words = ["com" + "".join(rng.choices("abé", k=rng.randint(3, 6))) for _ in range(150)] + ["".join(rng.choices("xy", k=rng.randint(6, 8))) for _ in range(60)]
    # Chains of forms: each some times as common as the next.
    chain = ["abcdefgh", "abcdefg", "abcdefgx", "abcdefxx", "abcdexxx"]
    many = [w for w, n in zip(chain, (3125, 625, 125, 25, 5)) for _ in range(n)]
    rows = [(i, " ".join(words * 5)) for i in range(2)] + [(9, " ".join(many)), (9, None), (None, "COMMON" + " Éabbbba" * 6), (3, ""), (4, "zzzzzzz" * 3000 + " "), *[(5, "q" * 4000 + " ")] * 5, *[(5, "q" * 3999 + ";")] * 5]
    want = brute_words(rows)
    got = forms_of(spelling.variants(frame(spark, rows), spelling.derived, crowd=crowd))
    assert got == want and any(v[0] and v[1] != v[0] for v in want.values())


def test_segments_cut_where_the_edit_is(spark):
    words = spark.createDataFrame([("abcdef", 6), ("abcdefg", 7), ("xbcdef", 6), ("abdef", 5), ("abdcef", 6)], "word string, size int").withColumn("n", F.lit(5).cast("long"))
    pairs = {frozenset((r["a"], r["b"])) for r in spelling.near(words).collect()}
    assert pairs == {frozenset(x) for x in (("abcdef", "abcdefg"), ("abcdef", "xbcdef"), ("abcdef", "abdef"), ("abdef", "abdcef"))}


def test_no_words(spark):
    assert forms_of(spelling.variants(frame(spark, []))) == {} and forms_of(spelling.variants(frame(spark, [(1, "one two")]))) == {}


# 12


def expansions(pattern, most=4000):
    """Texts that a rule's pattern matches: its groups' alternatives, options both ways."""

    def parse(s, i):
        alternatives, now = [], [""]
        while i < len(s) and s[i] != ")":
            if s.startswith("(?:", i):
                inner, i = parse(s, i + 3)
                i += 1
            elif s[i] == "|":
                alternatives += now
                now, i = [""], i + 1
                continue
            elif s[i] == "[":
                z = s.index("]", i)
                inner, i = (["w"] if s[i + 1] == "^" else [s[i + 1]]), z + 1
            else:
                inner, i = [s[i]], i + 1
            if i < len(s) and s[i] == "?":
                inner, i = ["", *inner], i + 1
            elif i < len(s) and s[i] == "+":
                i += 1
            elif i < len(s) and s[i] == "{":
                n, i = int(s[i + 1 : s.index("}", i)].split(",")[0]), s.index("}", i) + 1
                inner = [x * n for x in inner]
            now = [a + b for a, b in product(now, inner)]
        return alternatives + now, i

    return parse(pattern, 0)[0]


def test_rules_are_whole():
    assert len(license_rules.RULES) >= 300 and [r.rank for r in license_rules.RULES] == list(range(len(license_rules.RULES)))
    for r in license_rules.RULES:
        texts = expansions(r.pattern.removeprefix(license_rules.GRANT))
        for t in texts:
            assert set(r.keyword.split("|")) & set(t.split()), (r, t)
        # No match is long: repetitions are bounded.
        assert "*" not in r.pattern and max(len(t.split()) for t in texts) < license_scan.STRETCH and re.fullmatch(r.pattern, expansions(r.pattern)[0])


def brute_labels(text, rules=license_rules.RULES):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    base, at = set(), []
    for phrase, label in license_scan.PHRASES:
        k = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(k)] == k]
        at += found
        base |= {label} if found else set()
    line = " ".join(words)
    places = []
    for r in rules:
        for m in re.finditer(rf"(?<![^ ])(?:{r.pattern})(?![^ ])", line) if any(k in words for k in r.keyword.split("|")) else ():
            a = line[: m.start()].count(" ")
            places.append((r.rank, a, a + m.group().count(" ")))
    kept = [rules[d[0]] for d in places if not any(e[0] < d[0] and e[1] <= d[1] and e[2] >= d[2] for e in places)]
    more = {r.label for r in kept if r.label}
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), max([license_scan.BASE_SCORE if base else 0.0, *(r.score for r in kept if r.label)])


LICENSED = [
    "Licensed under CC BY-NC 4.0, all rights reserved. cc by cc by cc-by",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense",
    "This work is licensed under the GNU General Public License, version 3 or later. GNU Lesser General Public License v2.1",
    "SPDX-License-Identifier: GPL-2.0-or-later // SPDX-License-Identifier: MIT\nhttps://opensource.org/licenses/MIT",
    "He lost his driving license at MIT Press; the license plate was new.", "http://creativecommons.org/licenses/by-sa/4.0/ and CC0 1.0", "released under the BSD 3-Clause License. Apache License, Version 2.0", "ÉCC BY É cc Éby general  public license",
]


def test_labels_of_texts(spark):
    far = " ".join(["word"] * 61) + " under the GNU General Public License version 2 " * 40
    rows = [(i, t) for i, t in enumerate([*LICENSED, far, None, "", " ... ", "x " * 30_000 + "mit license"])] + [(0, LICENSED[0]), (None, LICENSED[2]), (None, None)]
    got = license_scan.scan(frame(spark, rows)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((i, *brute_labels(t)) for i, t in rows), key=key)
    by_id = {r["doc_id"]: r["labels"] for r in got}
    assert "mit" in by_id[3].split(",")
    assert by_id[4] == "" and "cc-by-sa-4.0" in by_id[5] and {"bsd-3-clause", "apache-2.0"} <= set(by_id[6].split(","))
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_scan_equals_sql_and_brute_force(spark, texts):
    got = sorted(map(tuple, registry.queries()["op12_license_scan"](spark, TABLES).collect()))
    assert got == sorted((i, *brute_labels(t)) for i, t in texts)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{TABLES}/documents.parquet'")
    assert got == sorted(duck.execute(registry.oracle_sql()["op12_license_scan"]).fetchall())


def test_a_scan_is_native(spark):
    plan = license_scan.detections(table(spark, TABLES, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 13


def brute_runs(w, least=6, repeats=4):
    out = {}
    for p in range(1, len(w) // repeats + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, repeats * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def digest(i, words):
    words = periodic.planted(i, words)
    found = brute_runs(words)
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    longest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *longest, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))


@pytest.mark.parametrize("pairs", [5, 100, periodic.PAIRS])
def test_runs_on_grids(pairs):
    rng = random.Random(pairs)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(0, 6)):
            w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 80))]
            if w and rng.random() < 0.6:
                a = rng.randrange(len(w))
                p = 1 + (len(w) - a) // rng.randint(3, 10)
                w = w[:a] + [w[a + i % p] for i in range(len(w) - a)]
            texts.append(w)
        ids, first = np.array([x for w in texts for x in w], np.int64), np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        assert [(t, s, n, p) for t, s, p, n in periodic.find(ids, first, pairs=pairs)] == [(t, *r) for t, w in enumerate(texts) for r in brute_runs(w)]


def test_a_hash_that_says_too_much_is_found_out(monkeypatch):
    # Words of one remainder have one hash.
    monkeypatch.setattr(periodic.tx, "mix", lambda x, salt=0: x % np.uint64(2) + np.uint64(1))
    rng = random.Random(4)
    for _ in range(60):
        w = [rng.randrange(4) for _ in range(40)]
        w[10:30] = [w[10 + i % 3] for i in range(20)]
        assert [(s, n, p) for _, s, p, n in periodic.find(np.array(w), np.array([0, len(w)]))] == brute_runs(w)


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def test_runs_of_documents(spark, texts, tmp_path):
    rows = [*texts[:150], (None, "a b " * 9), (1, None), (2, ""), (3, "x"), (30, "a b a b a b a b a b a b"), (30, "a b a b a b a b a b a b"), (77, "la la la la la la\x0bé é é é é é é é end"), (78, "w " * 30_000), (79, "one two " * 4 + "three " * 3 + "one two " * 4)]
    df = frame(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["op13_periodic_runs"](spark, str(tmp_path)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(((i, *digest(i, words(t))) for i, t in rows), key=key)


def test_runs_of_all_documents(spark, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in registry.queries()["op13_periodic_runs"](spark, TABLES).collect()}
    assert got == {i: digest(i, words(t)) for i, t in texts} and sum(v[0] > 0 for v in got.values()) > 10
    assert periodic.runs(frame(spark, [])).count() == 0
