"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark drops a query's shuffle files when it ends, not when the driver next collects its garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's reliable checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset, as in tests, a folder of our own is made.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="hintloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_END) if before is None else spark.conf.set(SHUFFLES_END, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised by a reliable checkpoint, so that a lost executor costs no recomputation; its shuffle files are dropped."""
    checkpoint_dir(df.sparkSession)
    with _shuffles_end(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as compressed files in the same folder, for wide rows; they are deleted at the end of the block, so nothing lazy may leave it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark), f"stored-{uuid.uuid4()}")
    try:
        with _shuffles_end(spark):
            df.select("*").write.option("compression", "zstd").parquet(path.toString())
        yield spark.read.schema(df.schema).parquet(path.toString())
    finally:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
