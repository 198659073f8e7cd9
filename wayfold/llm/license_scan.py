"""License scan by ordered signature rules, in column expressions only.

Texts become words.  Which keywords of the rules a text has is found in one pass; the rules of these keywords alone are tried, and
most texts have none.  For the others each word gets its number (``gnu#17 general#18``) and patterns are written over numbered words, so
that what a pattern matches tells where: a detection is a rule and an interval of words.

A detection that lies within the interval of one of higher priority is suppressed.  Detections of a
text are compared in stretches of ``STRETCH`` words: a containing one begins or goes on where the contained one begins, so
each is listed in its own stretches and no text's detections come together in one place.

Labels of three phrases always stay, with places in words counted over the whole text.

Defined cases: null and empty texts have no words and no labels (empty strings, score 0, null places); rows
that share both doc_id and text are scanned alike and give a row each, as do rows with a null doc_id; detections of equal interval
and rank are one; texts of any length are taken whole; further columns are left out, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_rules import RULES, Rule
from .store import cut, identity, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Phrases whose places are counted, with their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
BASE_SCORE = 0.5
STRETCH = 64


def numbered(pattern: str) -> str:
    """A rule's pattern over numbered words, each match with the space before it."""
    return " (?:" + pattern.replace(" ", "#\\d+ ") + ")#\\d+"


def _by_keyword(rules: list[Rule]) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in rules:
        for k in r.keyword.split("|"):
            out.setdefault(k, []).append({"rank": r.rank, "pattern": numbered(r.pattern)})
    return out


def spaced(text: Column) -> Column:
    """The words of a text with one space between them."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN, " "))


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _phrases(of: Column, n_words: Column) -> dict[str, Column]:
    """Count, first and last place of each phrase in words ``of`` with a space on either side of each."""
    out = {}
    for i, (phrase, _) in enumerate(PHRASES):
        k, held = phrase.count(" ") + 1, " " + phrase.replace(" ", "  ") + " "
        has = F.contains(of, F.lit(held))
        n = F.when(has, (F.char_length(of) - F.char_length(F.replace(of, F.lit(held), F.lit("")))) / len(held)).otherwise(0).cast("long")
        out[f"n{i}"] = n
        out[f"first{i}"] = F.when(has, _spaces(F.substring_index(of, held, 1)) / 2).cast("long")
        out[f"last{i}"] = F.when(has, n_words - _spaces(F.substring_index(of, held, -1)) / 2 - k).cast("long")
    return out


def detections(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, d1, d2, n_words, n0.., first0.., last0.., found): each row of ``docs(doc_id, text)`` with its phrases and its rules' places."""
    kinds = _by_keyword(rules)
    d1, d2 = identity("doc_id", "text")
    words = docs.select("doc_id", d1.alias("d1"), d2.alias("d2"), spaced(F.col("text")).alias("words"))
    words = words.withColumn("n_words", F.when(F.col("words") == "", 0).otherwise(_spaces(F.col("words")) + 1).cast("long"))
    words = words.withColumn("wide", F.concat(F.lit(" "), F.replace("words", F.lit(" "), F.lit("  ")), F.lit(" ")))
    words = words.withColumn("keys", F.array_intersect(F.split("words", " "), F.array(*map(F.lit, sorted(kinds)))))
    by_keyword = F.from_json(F.lit(json.dumps(kinds)), "map<string, array<struct<rank: int, pattern: string>>>")
    tried = F.array_distinct(F.flatten(F.transform("keys", lambda k: F.element_at(by_keyword, k))))
    # Each word with its number, a space before it.
    told = F.concat(F.lit(" "), F.array_join(F.transform(F.split("words", " "), lambda w, i: F.concat(w, F.lit("#"), i.cast("string"))), " "))

    def place(rank: Column, match: Column) -> Column:
        first = F.regexp_extract(match, "#(\\d+)", 1).cast("int")
        return F.struct(rank.alias("rank"), first.alias("a"), F.substring_index(match, "#", -1).cast("int").alias("z"))

    # Bound to a name, for the numbered words would be made again for each rule.
    each = lambda numbers: F.transform(tried, lambda r: F.transform(F.regexp_extract_all(numbers, r["pattern"], F.lit(0)), lambda m: place(r["rank"], m)))
    found = F.flatten(F.flatten(F.transform(F.array(told), each)))
    return words.select("doc_id", "d1", "d2", "n_words", *(c.alias(k) for k, c in _phrases(F.col("wide"), F.col("n_words")).items()), F.when(F.size("keys") > 0, found).alias("found"))


def unsuppressed(found: DataFrame) -> DataFrame:
    """(d1, d2, rank, a, z) of ``found(d1, d2, found)``: the detections that lie within none of higher priority."""
    each = found.select("d1", "d2", F.explode("found").alias("x")).select("d1", "d2", "x.*")
    listed = each.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("a") / STRETCH), F.floor(F.col("z") / STRETCH))))
    groups = listed.groupBy("d1", "d2", "stretch").agg(F.collect_set(F.struct("rank", "a", "z")).alias("all"))
    over = lambda e, d: (e["rank"] < d["rank"]) & (e["a"] <= d["a"]) & (e["z"] >= d["z"])
    home = F.filter("all", lambda d: F.floor(d["a"] / STRETCH) == F.col("stretch"))
    groups = groups.withColumn("kept", F.filter(home, lambda d: ~F.exists("all", lambda e: over(e, d))))
    return groups.select("d1", "d2", F.explode("kept").alias("x")).select("d1", "d2", "x.*")


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Each row of ``docs(doc_id, text)`` with its words, phrases, labels and score."""
    found = cut(detections(docs, rules), "licenses")
    meaning = F.from_json(F.lit(json.dumps({r.rank: {"label": r.label, "score": r.score} for r in rules})), "map<string, struct<label: string, score: double>>")
    said = unsuppressed(found).select("d1", "d2", F.element_at(meaning, F.col("rank").cast("string")).alias("m")).where("m.label is not null")
    labels = said.groupBy("d1", "d2").agg(F.collect_set("m.label").alias("more"), F.max("m.score").alias("top"))
    n = [F.col(f"n{i}") for i in range(len(PHRASES))]
    base = F.array_compact(F.array(*(F.when(n[i] > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES))))
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    total = sum(n[1:], n[0])
    none = F.array().cast("array<string>")
    return found.join(labels, ["d1", "d2"], "left").select(
        "doc_id", "n_words", total.alias("n_base"), F.least(*(f"first{i}" for i in range(len(n)))).alias("first_word"), F.greatest(*(f"last{i}" for i in range(len(n)))).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, F.coalesce("more", none))).alias("labels"), F.greatest(F.coalesce("top", F.lit(0.0)), F.when(total > 0, BASE_SCORE).otherwise(0.0)).alias("score"),
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license labels of every whole document."""
    return scan(table(spark, sf_dir, "documents"))


def _sql(rules: list[Rule] = RULES) -> str:
    quoted = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({r.rank}, {quoted(r.label)}, {r.score}::DOUBLE, {quoted(numbered(r.pattern))}, {quoted(k)})" for r in rules for k in r.keyword.split("|"))
    phrases = ", ".join(f"({quoted(p)}, {quoted(label)}, {p.count(' ') + 1})" for p, label in PHRASES)
    return f"""
WITH rules(rank, label, score, pattern, keyword) AS (VALUES {values}), phrases(phrase, label, k) AS (VALUES {phrases}),
words AS (SELECT row_number() OVER () AS row_id, doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
told AS (SELECT row_id, doc_id, w, ' ' || array_to_string(list_transform(w, lambda x, i: x || '#' || (i - 1)), ' ') AS t FROM words),
base AS (SELECT row_id, label, unnest(list_filter(range(0, len(w)), lambda i: array_to_string(list_slice(w, i + 1, i + k), ' ') = phrase)) AS pos FROM words, phrases WHERE contains(array_to_string(w, ' '), phrase)),
bases AS (SELECT row_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS l FROM base GROUP BY row_id),
hits AS (SELECT row_id, rank, label, score, unnest(regexp_extract_all(t, pattern)) AS m FROM told, rules WHERE contains(t, ' ' || keyword || '#')),
places AS (SELECT DISTINCT row_id, rank, label, score, regexp_extract(m, '#([0-9]+)', 1)::BIGINT AS a, regexp_extract(m, '#([0-9]+)$', 1)::BIGINT AS z FROM hits),
kept AS (SELECT * FROM places d WHERE NOT EXISTS (SELECT 1 FROM places e WHERE e.row_id = d.row_id AND e.rank < d.rank AND e.a <= d.a AND e.z >= d.z)),
labels AS (SELECT row_id, list(DISTINCT label) AS l, max(score) AS top FROM kept WHERE label IS NOT NULL GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(b.l), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.l, []), coalesce(s.l, [])))), ','), '') AS labels,
       greatest(coalesce(top, 0.0), CASE WHEN n_base > 0 THEN {BASE_SCORE} ELSE 0.0 END)::DOUBLE AS score
FROM words LEFT JOIN bases b USING (row_id) LEFT JOIN labels s USING (row_id)"""


ORACLE = {"op12_license_scan": _sql()}
