"""Tables that cut lineage: written to the folder that the cluster names, read back, and dropped when they have served."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession


_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a temporary folder, if all runs in this one process (tests)."""
    global _own
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="crawlsmith-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again; survives lost executors, and is never dropped."""
    return _written(df, fresh_path(df.sparkSession, tag))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Tables of one job: all but those kept are dropped when the ``with`` block ends, also after an error.

    What leaves the block must read kept tables and inputs alone.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        self.paths.append(path := fresh_path(self.spark, tag))
        return _written(df, path)

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        return materialize(df, tag)

    def drop(self) -> None:
        """Drop what has been written so far."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.drop()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
