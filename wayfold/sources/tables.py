"""Session details."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Only a local session that names no checkpoint folder gets a temporary one: on a cluster it must be shared."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wayfold-checkpoints-"))


def settled(df: DataFrame) -> DataFrame:
    """``df`` in the checkpoint folder: computed once, its lineage cut, whatever executor is lost."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, by: str) -> DataFrame:
    """``df`` in the checkpoint folder as Parquet, a folder for each value of ``by``: for wide rows, which take a fraction of a checkpoint."""
    spark = df.sparkSession
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    df.write.partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
