"""Frames whose columns, or whose lineage, are settled."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fenced(df: DataFrame) -> DataFrame:
    """``df`` through a generator of one row.

    What is built on its columns reads their values; without it the optimizer folds their expressions into every place that
    names them, so that a pattern over a page's text would run once for each rule.
    """
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("row")).select("row.*")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir, which all executors share; a temporary one where all runs in this process (tests)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one, if all runs in this process (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="crawlsmith-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
