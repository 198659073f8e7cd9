"""From raw documents to a mixed training corpus.

``STAGES`` are applied one after the other; each stage's result is written as Parquet and read again as
the next one's documents.  All but the last return the columns of ``documents``.

Defined cases, of every stage: an empty table gives an empty table; further columns are kept, whatever their
names; a null doc_id, lang, source or n_chars is kept as it is; texts of any length are taken whole.  What a null
or empty text and a repeated row come to, and how ties are broken, each stage says itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import decontaminate, mixing, quality_crf, simhash, suffix_dedup
from wayfold.llm.store import cut, discard, identity, spare, table

#: Models, fingerprint components and edit distances are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None
#: Near copies have this Jaccard similarity of five-word shingles, or more.
SIMILARITY = 0.8


def _rest(docs: DataFrame) -> DataFrame:
    """(doc_id, rest, text): all columns but the text in one struct, so that none clashes with an operator's."""
    return docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"), "text")


def _back(df: DataFrame, rest: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("text") if c == "text" else F.col(f"{rest}.`{c}`").alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is trained on labelled documents that are not held out.

    A null or empty text scores 0 and goes; repeated rows are judged alike and stay repeated; a score equal to the
    threshold is accepted.  Without labels of both kinds there is no classifier, and every document stays.
    """
    field = quality_crf.fit(docs, table(spark, sf_dir, "labels"))
    if field is None:
        return docs
    return _back(quality_crf.score(_rest(docs), field, "rest", "text").where("predicted = 1"), "rest", docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: fingerprints of five-word shingles within 4 bits, or sets of them alike in SIMILARITY.

    That of the smallest doc_id stays, a null one last; of texts that share the doc_id any, the same in every run.  Null and
    empty texts are near copies of each other; of rows that share doc_id and text one stays.
    """
    d1, d2, n = spare(docs, "d1", "d2", "n")
    keyed = docs.withColumns(dict(zip((d1, d2), identity("doc_id", "text"))))
    slim = keyed.select("doc_id", F.col(d1).alias("d1"), F.col(d2).alias("d2"), "text")
    found = cut(simhash.near_duplicates(slim, "d1", "d2", words=5, similarity=SIMILARITY).select("doc_id", "d1", "d2", "root"), "groups-of-copies")
    # Most documents have no copy: only groups of several are looked at, and only what goes is taken out.
    first = found.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "d1", "d2")).alias("keep")).where("n > 1")
    first = cut(first, "copies")
    others = found.join(first, "root").where((F.col("d1") != F.col("keep.d1")) | (F.col("d2") != F.col("keep.d2"))).select("d1", "d2").distinct()
    twice = found.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").select("d1", "d2")
    out = cut(others.withColumn(n, F.lit(0)).unionByName(twice.withColumn(n, F.lit(1))).groupBy("d1", "d2").agg(F.min(n).alias(n)), "to-go")
    out = out.select(F.col("d1").alias(d1), F.col("d2").alias(d2), n)
    single = keyed.join(out, [d1, d2], "left_anti").select(*docs.columns)
    repeated = keyed.join(out.where(F.col(n) == 1), [d1, d2], "left_semi").dropDuplicates([d1, d2]).select(*docs.columns)
    return single.unionByName(repeated)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that occur more than once; characters cut in two go.

    Every document stays, a null text null, and one that is all repeated empty; n_chars is counted anew.  Repeated rows lose
    what they share, which is all if it is long enough.
    """
    keyed = suffix_dedup.with_key(_rest(docs).withColumn("none", F.col("text").isNull()), "rest", "none")
    found = suffix_dedup.remove(keyed, suffix_dedup.spans(keyed), "rest", "none")
    own = found.schema["own"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = batch.column("own").field("none").to_pylist()
            text = [None if gone else k.decode("utf-8", "ignore") for k, gone in zip(batch.column("kept").to_pylist(), none)]
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(text, pa.string())], ["own", "text"])

    kept = found.select("own", "kept").mapInArrow(decode, f"own {own}, text string")
    out = _back(kept, "own.rest", docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no near copy of a benchmark item.

    A null or empty text holds none and stays; repeated rows go or stay together.
    """
    (name,) = spare(docs, "name")
    keyed = docs.withColumn(name, F.struct(*(h.alias(c) for h, c in zip(identity("doc_id", "text"), "ab"))))
    found = decontaminate.contaminated(keyed.select(F.col(name).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(name)).distinct()
    # Its size is known once it is written, so that few rows are broadcast and many are not.
    found = cut(found, "contaminated")
    return keyed.join(found, name, "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mixture of sources; null and empty texts and repeated rows have a place each."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"stage-{k}")
        discard(before)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
