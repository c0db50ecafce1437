"""Where intermediate results are kept."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.  Only where
    driver and executors are one machine it may be unset."""
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "canonry-checkpoints"))
    return jsc.getCheckpointDir().get()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store Spark reads it from."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df``, and the number ``rows`` of its rows, known as soon as it is written or
    cut.  Counted by the tasks that write, each of which counts once, however often it
    is tried; so nothing is read again to be counted."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own in the shared folder, which goes afterwards."""
    path = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete(spark, path)


def persist_cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once; what follows reads it back, also
    after executors are lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tabled(df: DataFrame) -> DataFrame:
    """Like ``persist_cut``, but as a table in the shared folder: what follows reads those
    columns and rows only that it needs."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
