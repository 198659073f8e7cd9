"""The ten operators and the pipeline against brute force, with nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from wayfold.llm import chat, components, debruijn, decontaminate, html_extract, language, mixing, quality_crf, quality_rules, simhash, suffix_dedup

from .edits import best_match

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo zy".split()


def prose(rng, n):
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]
    return re.sub(r"((?:\S+ ){9}\S+) ", r"\1.\n", " ".join(words))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [prose(rng, rng.randint(30, 260)) for _ in range(30)]
    passage = prose(rng, 120)
    out = [*base, base[0], base[0], base[1].replace("a", "o", 2), base[2] + " " + passage, passage + "\n" + base[3], base[4][:300] + passage[:600], None, "", " \n\t ", "one", prose(rng, 6000), "é" * 500, "é" * 500 + "x", "12 !? %%"]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "xx", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1


def test_html_extract(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><script>var a="</p>";</script>
    <div class="ad">Buy this now, it is cheap and good.</div><article><h1>Big &amp; bold</h1><p>First  part <b>of</b> it&nbsp;all.<br><p>Second.</p><aside>Side</aside><form>Mail</form><p>&lt;Third&gt;</p></article>
    <div id="comments"><p>I disagree with all of the above, and at length.</p></div><footer>&copy; me</footer></body></html>"""
    want = "Big & bold\n\nFirst part of it all.\n\nSecond.\n\n<Third>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (None, "u", "just text " * 30), (5, "u", "<p>" + "word " * 200_000)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    by = {(r["page_id"], r["n_chars"]): r["text"] for r in got}
    assert len(got) == 6 and by[(1, len(want))] == want and by[(2, 0)] == "" and by[(3, 0)] == ""
    assert any(r["page_id"] is None and r["text"] == " ".join(["just text"] * 30) for r in got)
    assert any(r["page_id"] == 5 and r["n_chars"] == 999_999 for r in got)
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_without_a_marked_article():
    body = "".join(f"<p>Paragraph {i} with quite a lot of words in it, so that it weighs.</p>" for i in range(6))
    links = "".join(f"<li><a href=/{i}>Link number {i} to somewhere</a></li>" for i in range(30))
    text, n, surge, dive = html_extract.extract(f"<body><div><ul>{links}</ul></div><div>{body}<p>End.</p></div><div><ul>{links}</ul></div></body>")
    assert n == 7 and text.startswith("Paragraph 0") and text.endswith("End.") and surge < dive


# 2


def count_words(t):
    w = WORD.findall(t or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            cover.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


def test_quality_statistics(spark, docs, texts):
    more = ["a b c d e\na b c d e\nx\n\n  \nx", "a b c d e f a b c d e", "# $ [x] <y>"]
    df = docs.unionByName(spark.createDataFrame([(1000 + i, t, None, None, 0) for i, t in enumerate(more)], DOCS)).withColumn("n_words", F.lit("clash"))
    got = {r["doc_id"]: tuple(r[c] for c in quality_rules.COUNTS) for r in quality_rules.statistics(df).collect()}
    want = {i: count_words(t) for i, t in [*enumerate(texts), *enumerate(more, 1000)]}
    assert got == want


def test_quality_rules_learn_and_judge(spark):
    rng = random.Random(2)
    good = [prose(rng, 80) for _ in range(150)]
    bad = [re.sub(r" ", "$$ ", prose(rng, 80)) for _ in range(60)]
    rows = [(i, t, None, None, 0) for i, t in enumerate(good + bad)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(210)] + [(None, 1), (5, None)], "doc_id long, quality int")
    rules = quality_rules.fit(df, labels)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df, rules).collect()}
    assert rules and sum(got[i] for i in range(150)) >= 148 and sum(got[i] for i in range(150, 210)) <= 2
    assert quality_rules.fit(df, labels.limit(0)) == [] and quality_rules.judge(empty(spark), rules).count() == 0


# 3


def brute_fingerprint(t, n_words=4):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + n_words]) for i in range(max(1, len(w) - n_words + 1))]
    n = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(sh))


def classes(n, linked):
    label = list(range(n))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark, docs, texts):
    fp = [brute_fingerprint(t) for t in texts]
    want = classes(len(fp), [(a, b) for a in range(len(fp)) for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 4])
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs.withColumn("fp", F.lit(1)).drop("fp")).collect()}
    assert got == {i: (f, want[i]) for i, f in enumerate(fp)}
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("crowd", [1024, 10])
def test_near_fingerprints_crowded_or_not(spark, crowd):
    rng = random.Random(3)
    values = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            v = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    want = classes(len(values), [(a, b) for a in range(len(values)) for b in range(a) if bin(values[a] ^ values[b]).count("1") <= 4])
    fps = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    got = {r["node"]: r["component"] for r in components.components(simhash.near(fps, 4, crowd)).collect()}
    found = [got.get(simhash._signed(v), simhash._signed(v)) for v in values]
    assert len(set(zip(want, found))) == len(set(want)) == len(set(found))


# 4


def brute_bytes(texts, k):
    raw = [(t or "").encode() for t in texts]
    n = Counter(w[s : s + k] for w in raw for s in range(len(w) - k + 1))
    out = []
    for w in raw:
        gone = np.zeros(len(w) + 1, int)
        for s in range(len(w) - k + 1):
            if n[w[s : s + k]] > 1:
                gone[s] += 1
                gone[s + k] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(w, np.uint8)[~mask])
        out.append((len(w), int(mask.sum()), int((mask & ~np.append(False, mask[:-1])).sum()) if len(w) else 0, kept))
    return out


@pytest.mark.parametrize("most", [2000, 1])
def test_suffix_dedup(spark, docs, texts, most):
    keyed = suffix_dedup.with_key(docs, "doc_id")
    got = {r["own"]["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove(keyed, suffix_dedup.spans(keyed, most_pieces=most), "doc_id").collect()}
    assert got == dict(enumerate(brute_bytes(texts, 400)))


def test_difference_cover_sorts_long_ties():
    rng = random.Random(5)
    alphabet = [b"ab", b"a"]
    for letters in alphabet:
        body = bytes(rng.choices(letters, k=900))
        pieces = [body[:600], body[100:700], bytes(rng.choices(letters, k=650)), body[300:900], b"x" * 450]
        times = np.array([1, 1, 1, 1, 2])
        n = Counter()
        for p, t in zip(pieces, times):
            for s in range(len(p) - 399):
                n[p[s : s + 400]] += int(t)
        want = {(i, s) for i, p in enumerate(pieces) for s in range(len(p) - 399) if n[p[s : s + 400]] > 1}
        assert set(zip(*map(np.ndarray.tolist, suffix_dedup.repeated_suffixes(pieces, times)))) == want
    assert suffix_dedup._IN_COVER.sum() < 12


# 5


def test_chat(spark):
    call = lambda i, name, args: {"id": i, "name": name, "arguments": args}
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", json.dumps({"content": "ok", "tool_calls": [call("a", "search", {"query": "x", "limit": 3}), call("b", "search", {"limit": "no"}), call("c", "nope", {})]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": {"z": 1, "a": [2]}})), (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})),
        (2, 0, "tool", json.dumps({"tool_call_id": "a", "content": "early"})), (2, 1, "assistant", json.dumps({"tool_calls": [call("a", "calculate", '{"expression": "1+1"}')]})),
        (None, None, None, None), (3, 0, "assistant", "{not json"), (1, 0, "user", "hi"),
    ]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("json", F.lit("clash"))).collect()
    calls = {(r["conv_id"], r["call_id"]): (r["link"], r["arguments_valid"]) for r in got if r["kind"] == "call"}
    assert calls == {(1, "a"): ("unanswered", True), (1, "b"): ("linked", False), (1, "c"): ("unanswered", False), (2, "a"): ("linked", True)}
    results = {(r["conv_id"], r["call_id"]): r for r in got if r["kind"] == "result"}
    assert results[(1, "zz")]["link"] == "orphan" and results[(2, "a")]["order_turn"] == 1
    assert results[(1, "b")]["json"] == '{"content":{"a":[2],"z":1},"name":"search","role":"tool","tool_call_id":"b"}'
    assert sum(r["kind"] == "message" for r in got) == 6
    order = sorted((r["order_turn"], r["depth"], r["part"], r["kind"]) for r in got if r["conv_id"] == 2)
    assert [o[3] for o in order] == ["message", "call", "result"]
    for conv in {r["conv_id"] for r in got}:
        own = sorted((r["place"], (r["order_turn"] or 0, r["depth"], r["part"])) for r in got if r["conv_id"] == conv)
        assert [p for p, _ in own] == list(range(1, len(own) + 1)) and [o for _, o in own] == sorted(o for _, o in own)


def test_chat_odd_rows(spark):
    call = lambda i, name, args: {"id": i, "name": name, "arguments": args}
    long = "x" * 2_000_000
    twice = json.dumps({"tool_calls": [call("a", "search", {"query": long}), call("a", "fetch", {"url": "u"})]})
    rows = [(1, t, "user", f"turn {t}") for t in range(3000)] + [(2, 5, "assistant", twice), (2, 6, "tool", json.dumps({"tool_call_id": "a", "content": "one"})), (2, 7, "tool", json.dumps({"tool_call_id": "a", "content": "two"}))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("place", "k", "i", "stretch", "number", "before")})
    got = chat.link(df).collect()
    assert sorted(r["place"] for r in got if r["conv_id"] == 1) == list(range(1, 3001)) and all(r["place"] == r["turn"] + 1 for r in got if r["conv_id"] == 1)
    # An identifier that two calls use belongs to the first; both results are its own.
    assert [(r["kind"], r["tool"], r["link"]) for r in sorted((r for r in got if r["conv_id"] == 2), key=lambda r: r["place"])] == [
        ("message", None, None), ("call", "search", "linked"), ("call", "fetch", "linked"), ("result", "search", "linked"), ("result", "search", "linked")
    ]
    assert chat.link(df.limit(0)).count() == 0


# 6


def within_a_block(blocks, weights):
    """Every prefix of the schedule against the fluid mixture of the weights themselves."""
    places = mixing.schedule(blocks, weights)
    assert sorted(x for p in places.values() for x in p) == list(range(sum(blocks.values())))
    of = {x: k for k, p in places.items() for x in p}
    done, fluid = Counter(), dict.fromkeys(blocks, Fraction(0))
    exact = {k: Fraction(w) for k, w in weights.items()}
    for t in range(len(of)):
        done[of[t]] += 1
        left = Fraction(1)  # of this slot
        while left:
            live = [k for k in blocks if fluid[k] < blocks[k]]
            rate = sum(exact[k] for k in live)
            step = min(left, *((blocks[k] - fluid[k]) * rate / exact[k] for k in live))
            for k in live:
                fluid[k] += step * exact[k] / rate
            left -= step
        assert all(abs(done[k] - fluid[k]) < 1 for k in blocks)


def test_every_prefix_is_within_a_block():
    rng = random.Random(1)
    for _ in range(8):
        blocks = {k: rng.randint(1, 60) for k in range(rng.randint(1, 9))}
        within_a_block(blocks, {k: rng.randint(1, 1000) / 1024 for k in blocks})
    within_a_block(dict.fromkeys(range(20), 50), dict.fromkeys(range(20), 1.0))
    within_a_block({0: 300, 1: 3}, {0: 1.0, 1: 0.0001})
    within_a_block({k: 1 + k % 4 for k in range(100)}, {k: float(1 + k % 7) for k in range(100)})


def test_many_equal_sources_do_not_drift():
    # The target of equal weights is a turn for each source in every round.
    places = mixing.schedule(dict.fromkeys(range(20), 1000), dict.fromkeys(range(20), 1 / 3))
    assert all(20 * j <= slot < 20 * (j + 1) for p in places.values() for j, slot in enumerate(p))


def test_mixing_keeps_every_row(spark):
    rows = [(i, None if i % 7 == 0 else f"s{i % 3}") for i in range(400)] + [(None, "s1"), (5, "s2"), (5, "s2")]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("mix_slot", F.lit("clash"))
    got = mixing.mix(df, {"s1": 0.7, "s2": 0.2}, block=4).collect()
    assert len(got) == len(rows) and len({r["mix_order"] for r in got}) == len(rows)
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter(rows)
    assert all(len({r["source"] for r in got if r["mix_slot"] == s}) == 1 for s in {r["mix_slot"] for r in got})
    assert mixing.mix(df.limit(0)).count() == 0
    odd = df.withColumns({c: F.lit(k) for k, c in enumerate(["a", "s", "c", "o", "l", "lane", "rank", "slot", "number", "x.y"])})
    assert Counter((r["doc_id"], r["source"]) for r in mixing.mix(odd).collect()) == Counter(rows) and mixing.mix(odd).columns == [*[c for c in odd.columns if c != "mix_slot"], "mix_slot", "mix_order"]
    last = mixing.mix(df, {"s0": 0.0, "s1": 1.0, "s2": 2.0, None: 1.0}, block=4).groupBy("source").agg(F.min("mix_slot").alias("a"), F.max("mix_slot").alias("z")).collect()
    by = {r["source"]: r for r in last}
    assert by["s0"]["a"] > max(r["z"] for r in last if r["source"] != "s0")
    with pytest.raises(ValueError):
        mixing.mix(df, {"s0": -1.0})


# 7, 10


def test_language(spark):
    rng = random.Random(4)
    words = {"aa": ["the", "and", "thing", "other"], "bb": ["der", "und", "schön", "nicht"]}
    rows = [(i, " ".join(rng.choices(words[k], k=60)), k, None, 0) for i, k in enumerate(["aa", "bb"] * 80)] + [(900, None, "aa", None, 0), (901, "123 !!", "aa", None, 0), (None, "und nicht schön der und", None, None, 0), (902, "the thing and other " * 30_000, None, None, 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    net = language.fit(df)
    got = {r["doc_id"]: r for r in language.identify(df, net).collect()}
    for i, _, lang, _, _ in rows[:160]:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "aa"
    assert language.identify(empty(spark), net).count() == 0 and language.fit(empty(spark)) is None


def test_quality_field(spark):
    rng = random.Random(6)
    good, bad = [prose(rng, 90) for _ in range(120)], [prose(rng, 90).upper().replace(" ", "!! ") for _ in range(80)]
    rows = [(i, t, None, None, 0) for i, t in enumerate(good + bad)] + [(900, None, None, None, 0), (901, "  ", None, None, 0), (902, "word " * 100_000, None, None, 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(200)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_crf.score(df, quality_crf.fit(df, labels), *df.columns).collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == (i < 120) for i in held) >= 0.95 * len(held)
    assert got[900]["score"] == got[901]["score"] == 0 and 0 <= got[902]["score"] <= 1
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert quality_crf.score(empty(spark), None, "doc_id").count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    score, move, doc = rng.normal(size=5), rng.normal(size=(2, 2)), np.array([0, 0, 0, 1, 1])
    p, _ = quality_crf.marginals(score, move, doc)
    for d in (0, 1):
        at = np.flatnonzero(doc == d)
        total, good = 0.0, np.zeros(len(at))
        for y in np.ndindex(*[2] * len(at)):
            w = np.exp(sum(score[i] * v for i, v in zip(at, y)) + sum(move[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
        assert np.allclose(p[at], good / total)


# 8


def test_debruijn_dedup(spark, docs, texts):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = set()
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone.update(range(s, s + 20))
            seen.add(key)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    keyed = debruijn.with_key(docs)
    out = debruijn.remove(keyed, debruijn.spans(keyed)).select("*", F.sha2("kept", 256).alias("sha")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["sha"]) for r in out} == want and len(out) == len(texts)
    none = debruijn.with_key(empty(spark))
    assert debruijn.remove(none, debruijn.spans(none)).count() == 0


def test_repeats_inside_one_text_and_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(1, t + " x y z " + t), (1, t + " x y z " + t), (None, t)]
    keyed = debruijn.with_key(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in debruijn.remove(keyed, debruijn.spans(keyed)).collect())
    assert got == [(0, 0), (1, 80), (1, 80)]


# 9


def edit(a, b):
    row = [0] * (len(b) + 1)
    best = len(a)
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return min(best, *row)


def test_best_match_is_the_edit_distance():
    rng = random.Random(8)
    for _ in range(40):
        a, b = bytes(rng.choices(b"abc ", k=rng.randint(1, 30))), bytes(rng.choices(b"abc ", k=rng.randint(0, 60)))
        assert best_match(a, b, 1000) == edit(a, b)
    items = [bytes(rng.choices(b"abc ", k=rng.choice([1, 5, 63, 64, 65, 130, 200]))) for _ in range(60)]
    texts = [bytes(rng.choices(b"abc ", k=rng.randint(0, 90))) + (i[5:] if rng.random() < 0.5 else b"") for i in items]
    assert decontaminate.best_matches(items, texts).tolist() == [edit(a, b) for a, b in zip(items, texts)]


def test_decontamination(spark):
    rng = random.Random(9)
    items = [re.sub(r"\s+", " ", prose(rng, 40)) for _ in range(12)]
    rows, want = [], set()
    for i in range(60):
        k = i % 12
        copy = list(items[k])
        for _ in range((0, 3, 8)[i % 3]):
            copy[rng.randrange(len(copy))] = rng.choice("abcdef")
        rows.append((i, prose(rng, 50) + " " + "".join(copy).upper() + "\n\n" + prose(rng, 50)))
        want.add((i, k))
    rows += [(100 + i, prose(rng, 150)) for i in range(40)] + [(None, items[0]), (300, None), (301, ""), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "")], "item_id long, text string")
    out = decontaminate.contaminated(df, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in out}
    assert got <= want | {(None, 0)} and len(got & want) >= 0.95 * len(want) and (None, 0) in got and len(out) == len(got)
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_exact_copies_of_short_items_are_found(spark):
    rng = random.Random(12)
    items = []
    while len(items) < 60:
        item = " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 10)))
        if 20 <= len(item) <= 60:
            items.append(item + "?")
    rows = [(i, prose(rng, 60) + ' "' + t.title() + '" ' + prose(rng, 60)) for i, t in enumerate(items)] + [(100 + i, prose(rng, 120)) for i in range(20)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).where("edits = 0").collect()}
    assert got == {(i, i) for i in range(60)}


def test_prefixes_follow_the_weights_themselves():
    weights = {0: 1 / 5000, 1: 0.3, 2: 0.123456, 3: 1 - 0.3 - 0.123456 - 1 / 5000}
    blocks = {0: 20, 1: 30_000, 2: 12_300, 3: 57_000}
    places, total = mixing.schedule(blocks, weights), sum(map(Fraction, weights.values()))
    until = min(Fraction(n) * total / Fraction(weights[k]) for k, n in blocks.items())  # the first source is served up
    for k, p in places.items():
        for j, slot in enumerate(p):
            if slot + 1 <= until:
                # Before a block's slot so many are done, after it one more.
                assert abs(j - Fraction(weights[k]) / total * slot) < 1 and abs(j + 1 - Fraction(weights[k]) / total * (slot + 1)) < 1


def test_a_small_source_keeps_its_weight_among_many(spark):
    rows = [(k * 100 + i, f"s{k:02}") for k in range(70) for i in range(12)] + [(10_000 + i, "zz") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(df, {"zz": 0.5} | {f"s{k:02}": 0.5 / 70 for k in range(70)}, block=1).collect()
    assert len(got) == len(rows)
    slots = sorted(r["mix_slot"] for r in got if r["source"] == "zz")
    assert all(abs(i + 1 - 0.5 * (slot + 1)) < 1 + 1e-6 for i, slot in enumerate(slots))


def test_recall_of_edited_items_wherever_verification_accepts(spark):
    rng = random.Random(21)
    items = [re.sub(r"\s+", " ", prose(rng, rng.randint(14, 40))) for _ in range(40)]
    rows, rate_of, copies = [], {}, {}
    for rate in (0.05, 0.10, 0.15, 0.18):
        for k, item in enumerate(items):
            copy = list(item)
            for _ in range(round(rate * len(item))):
                at, how = rng.randrange(len(copy)), rng.randrange(3)
                if how == 0:
                    copy[at] = rng.choice("etaoin shrdlu")
                elif how == 1:
                    copy.insert(at, rng.choice("etaoin shrdlu"))
                elif len(copy) > 1:
                    del copy[at]
            rate_of[len(rows)], copies[len(rows)] = rate, (k, "".join(copy))
            rows.append((len(rows), prose(rng, 40) + " " + "".join(copy) + " " + prose(rng, 40)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    met = Counter()
    for d, (k, _) in copies.items():
        item, whole = items[k].encode(), re.sub(r"\s+", " ", rows[d][1]).lower().encode()
        if best_match(item, whole, 10**6) <= int(0.2 * len(item)):
            met[rate_of[d], (d, k) in got] += 1
    for rate in (0.05, 0.10, 0.15, 0.18):
        assert met[rate, True] >= 0.9 * (met[rate, True] + met[rate, False]) and met[rate, True] >= 30, (rate, met)


def test_decontamination_of_long_and_crowded_documents(spark):
    rng = random.Random(22)
    items = [re.sub(r"\s+", " ", prose(rng, 30)) for _ in range(10)]
    every = prose(rng, 4000) + " " + " ".join(items * 30) + " " + prose(rng, 4000)
    rows = [(1, every, 0, 0), (2, prose(rng, 9000), 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, rid int")
    bench = spark.createDataFrame([*enumerate(items), (0, items[0]), (20, items[1])], "item_id long, text string").withColumns({"i1": F.lit(1), "off": F.lit(2)})
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, k, 0) for k in [*range(10), 20]}


def test_line_blocks_decide_by_brute_force():
    rng = random.Random(31)
    for _ in range(300):
        weight = [rng.choice([0, 0, 0, 3, 10, 40, 300]) for _ in range(rng.randint(1, 25))]
        block = [sum(weight[max(0, i - 1) : i + 2]) for i in range(len(weight))]
        runs, now = [], []
        for i, b in enumerate([*block, 0]):
            if b > 0:
                now.append(i)
            elif now:
                runs.append(now)
                now = []
        want = []
        for r in runs:
            heavy = [i for i in r if weight[i]]
            want.append((heavy[0], heavy[-1] + 1))
        assert html_extract.stretches(np.array(weight)) == want


def test_html_parts_names_and_surges():
    get = lambda h: html_extract.extract(h)[0]
    kept = '<article><p>Intro here.</p><div class="social-history"><p>Social history.</p></div><section id="legal-notice-study">A study.</section><p>End.</p></article>'
    assert get(kept) == "Intro here.\n\nSocial history.\n\nA study.\n\nEnd."
    gone = '<article><header><p>By me</p></header><p>Text.</p><div class="comment-list"><p>I disagree.</p></div><div role="complementary">Side</div><p hidden>No</p><p>More.</p></article>'
    assert get(gone) == "Text.\n\nMore."
    links = "".join(f"<li><a href={k}>link {k}</a></li>" for k in range(5))
    body = f"<h1>Headline of it</h1><p>A short intro, not long.</p><ul>{links}</ul><p>{'many words ' * 200}</p><ul>{links}</ul><p>A short closing section.</p>"
    assert [len(x) for x in get(f"<body><div>{body}</div></body>").split("\n\n")] == [14, 24, 2199, 24]
    beside = f"<article><p>Short.</p></article><div><ul>{links}</ul></div><div><p>{'long text ' * 100}</p></div><div>tiny</div>"
    assert get(beside).startswith("Short.\n\nlong text") and "tiny" not in get(beside)
    assert get("<p>a &lt;b&gt; &amp;amp; c<p>5 < 6 and 7 > 3") == "a <b> &amp; c\n\n5 < 6 and 7 > 3"


def test_html_time_is_linear():
    import time

    began = time.perf_counter()
    for page in ("<script " * 130_000, '<a "' * 250_000, "<!--" * 250_000, "<p " * 300_000, "<div class='x" * 80_000):
        html_extract.extract(page)
    assert time.perf_counter() - began < 5
    assert html_extract.extract("<p>Before.</p>" + "<script " * 1000)[0] == "Before."


def brute_words(texts, k=20):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = set()
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            if key in seen:
                gone.update(range(s, s + k))
            seen.add(key)
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return want


def test_debruijn_with_branching_nodes(spark):
    rng = random.Random(33)
    core, left, right = prose(rng, 60), [prose(rng, 40) for _ in range(3)], [prose(rng, 40) for _ in range(3)]
    texts = [f"{left[a]} {core} {right[z]}" for a, z in [(0, 0), (1, 1), (0, 1), (2, 2), (1, 0), (0, 0)]]  # branches before and after the core
    texts += [core[: len(core) // 2] + " " + prose(rng, 30), " ".join(core.split()[20:]) + "\t" + core, "same " * 90, "same " * 50 + prose(rng, 30), "a b " * 40]
    texts += [" ".join(f"w{i % 7}" for i in range(80)), " ".join(f"w{i % 7}" for i in range(3, 60))]
    docs = debruijn.with_key(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("a", "start", "source", "times", "d1")}))
    out = debruijn.remove(docs, debruijn.spans(docs)).select("*", F.sha2("kept", 256).alias("sha")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["sha"]) for r in out} == brute_words(texts)


def test_paths_are_compacted_where_nodes_do_not_branch(spark):
    # 1 -> 2 -> 3 -> 4 in a row; 4 -> 5 and 4 -> 6 branch; 6 -> 7 occurs more often; 7 -> 8 goes on elsewhere.
    rows = [(1, 1, 2, 1, 2, 0), (2, 2, 3, 5, 2, 1), (3, 3, 4, 1, 2, 6), (4, 4, 5, 1, 2, 7), (5, 4, 6, 1, 2, 30), (6, 6, 7, 1, 3, 31), (7, 7, 8, 1, 3, 50)]
    edges = spark.createDataFrame([(x, x, u, v, n, t, 1, 1, s) for x, u, v, n, t, s in rows], "x1 long, x2 long, u long, v long, n int, times long, d1 long, d2 long, start int")
    assert {r["x1"]: r["off"] for r in debruijn.compact(edges).collect()} == {2: 1, 3: 6}


def test_long_paths_are_compacted_in_one_pass(spark, monkeypatch):
    # (x1, x2, u, v, n, times, d1, d2, start): a path of 300 edges of 1 to 3 windows, and one in another text that a gap in its source cuts in two.
    size = [1 + i % 3 for i in range(300)]
    start = [sum(size[:i]) for i in range(300)]
    rows = [(i, 0, i, i + 1, size[i], 2, 1, 1, start[i]) for i in range(300)] + [(1000 + i, 0, 1000 + i, 1001 + i, 1, 2, 1, 2, i + 5 * (i >= 4)) for i in range(8)]
    edges = spark.createDataFrame(rows, "x1 long, x2 long, u long, v long, n int, times long, d1 long, d2 long, start int").repartition(5)
    written = []
    monkeypatch.setattr(debruijn, "cut", lambda df, name: written.append(name) or df)
    found = {r["x1"]: r["off"] for r in debruijn.compact(edges).collect()}
    assert found == {i: start[i] for i in range(1, 300)} | {1000 + i: i % 4 for i in range(8) if i % 4} and len(written) == 1


def test_debruijn_keeps_spans_whose_words_differ(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = debruijn.with_key(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"))
    gone = debruijn.spans(docs)
    assert [r["words"] for r in gone.collect()] == [60]
    other = gone.withColumn("digest", F.unhex(F.sha2(F.lit("other words"), 256)))
    assert {r["n_removed"] for r in debruijn.remove(docs, other).collect()} == {0}


def test_thue_morse_lines_and_words_are_told_apart(spark):
    sign = [bin(i).count("1") & 1 for i in range(1024)]
    a, b = "".join("ab"[s] for s in sign), "".join("ba"[s] for s in sign)
    got = quality_rules.statistics(spark.createDataFrame([(1, f"{a}\n{b}")], "doc_id long, text string")).first()
    assert got["n_dup_lines"] == 0 and got["n_unique_words"] == 2
    texts = [a + "x" + a[:500], b + "y" + b[:500], " ".join(a[:60]), " ".join(b[:60])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = suffix_dedup.with_key(docs, "doc_id")
    found = {r["own"]["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove(keyed, suffix_dedup.spans(keyed), "doc_id").collect()}
    assert found == dict(enumerate(brute_bytes(texts, 400)))
    keyed = debruijn.with_key(docs)
    assert {r["doc_id"]: r["n_removed"] for r in debruijn.remove(keyed, debruijn.spans(keyed)).collect()} == {i: w[1] for i, w in brute_words(texts).items()}


def test_suffix_dedup_of_odd_rows(spark):
    rng = random.Random(35)
    passage = prose(rng, 150)
    rows = [(None, passage), (None, passage), (None, passage + "!"), (1, prose(rng, 20) + passage), (2, None), (2, ""), (3, prose(rng, 20_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("th", "kept", "n_bytes", "gone", "own", "a", "o", "h1", "piece")})
    want = sorted((repr(i), *b) for (i, _), b in zip(rows, brute_bytes([t for _, t in rows], 400)))
    for most in (2000, 1):
        keyed = suffix_dedup.with_key(docs, "doc_id")
        got = suffix_dedup.remove(keyed, suffix_dedup.spans(keyed, most_pieces=most), "doc_id").collect()
        assert sorted((repr(r["own"]["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want
    none = suffix_dedup.with_key(docs.limit(0), "doc_id")
    assert suffix_dedup.remove(none, suffix_dedup.spans(none), "doc_id").count() == 0


def test_simhash_takes_null_ids_and_clashing_columns(spark):
    rows = [(None, "one two three four five"), (7, "One two three four five"), (None, None), (3, ""), (9, "six seven eight nine ten")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("low", "root", "fp", "key", "component_id")})
    got = sorted((repr(r["doc_id"]), repr(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([("None", "7"), ("7", "7"), ("None", "3"), ("3", "3"), ("9", "9")])


def test_conflicting_labels_and_repeated_rows_fit_alike(spark):
    rng = random.Random(36)
    rows = [(i, prose(rng, 40) if i % 2 else prose(rng, 40).upper(), "xx", None, 0) for i in range(60)]
    docs = spark.createDataFrame([*rows, *rows[:20], (3, "other text", "yy", None, 0)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(8, 1), (8, 0), (8, 0)], "doc_id long, quality int")
    one, two = (quality_crf.fit(d, labels) for d in (docs.repartition(5, "text"), docs.repartition(2)))
    assert np.array_equal(one.weight, two.weight) and one.slope == two.slope
    assert quality_rules.fit(docs.repartition(5, "text"), labels) == quality_rules.fit(docs.repartition(2), labels)
    a, b = (language.fit(d) for d in (docs.repartition(5, "text"), docs.repartition(2)))
    assert a.langs == b.langs and np.array_equal(a.dense, b.dense)
