"""Reading tables and cutting lineage in storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's own removal of a finished execution's shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Arrow batches to and from Python, so that a worker holds a few MB of whole texts at a time.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by whatever path Spark itself can open."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Only a local session that names none gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wayfold-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Where the tables of :func:`cut` are.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Ends the lineage: a lost executor costs only the tasks that run, and a table that is
    read twice is computed once.  Once written, its shuffle files serve nobody and are removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    return found


def lanes(spark: SparkSession) -> int:
    """How many partitions a keyed exchange gets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def discard(*tables: DataFrame) -> None:
    """Empty the folders of tables of :func:`cut` that nothing reads any more."""
    for t in tables:
        path = _PATHS.pop(t, None)
        if path:
            # A range, as rows from Python would start its workers for none.
            t.sparkSession.range(0, 0, 1, 1).select(F.lit(0).alias("gone")).write.mode("overwrite").parquet(path)


#: Bits of a sieve for each key, and the most bits (as a power of two): 64 are a row of what is broadcast.
SIEVE_SHARE, MOST_SIEVE_BITS = 16, 24


def sifted(df: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``df`` without most rows whose ``key`` is not one of ``few``, so that what a join with ``few`` leaves out is not shuffled for it.

    A table of bits is broadcast, of a bounded size; rows that pass by chance, more where keys are more than the bits are made for, are left to the join.
    """
    bits = min(MOST_SIEVE_BITS, max(10, (SIEVE_SHARE * few.count()).bit_length()))
    place = F.xxhash64(F.lit(2), key).bitwiseAND(F.lit((1 << bits) - 1))
    word = F.shiftright(place, 6)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    w, o = spare(df, "word", "ones")
    table_ = few.select(word.alias(w), one.alias(o)).groupBy(w).agg(F.bit_or(o).alias(o))
    return df.withColumn(w, word).join(F.broadcast(table_), w).where(F.col(o).bitwiseAND(one) != 0).select(*df.columns)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever the case of their letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def identity(*columns: str) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the columns: together they tell rows apart."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
