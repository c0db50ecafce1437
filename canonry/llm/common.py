"""Session helpers that every operator of this subpackage uses."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every word-based operator: runs of anything but ASCII white space.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows, and bytes, of what passes to a Python worker at once; long texts make
#: Spark's own default of 10,000 rows too much for one.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that the functions
    run there need no shared folder with the code; and keep batches small, unless the
    session says how large they are to be."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "-1") == "-1":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = Path(tempfile.mkdtemp()) / "canonry_llm.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def release() -> None:
    """Give back what a worker remembered, for the next task may be another kind's."""
    if "canonry.llm.shingles" in sys.modules:
        sys.modules["canonry.llm.shingles"].forget()
    if "canonry.llm.bpe" in sys.modules:
        sys.modules["canonry.llm.bpe"].forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def task(run):
    """``run`` over a task's batches, then ``release``."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.  Only where
    driver and executors are one machine it may be unset."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if not named:
        named = os.path.join(tempfile.gettempdir(), "canonry-checkpoints")
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def persist_cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back.
    The files survive the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Like ``persist_cut`` but as Parquet, for results that are read more than
    once with different columns: later reads prune columns and push filters."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.parquet(path)
    made._written = path
    return made


def discard(*written_: DataFrame) -> None:
    """Delete what ``written`` has kept, once nothing reads it any more."""
    for df in written_:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def remove_work(spark: SparkSession) -> None:
    """Delete all that this application has written or checkpointed in the shared
    folder, once its results are stored elsewhere; DataFrames that still read from
    it fail afterwards.  Other applications have folders of their own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(path, True)
    files.mkdirs(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def sampled(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About nine tenths of ``rows`` rows of ``df`` at most, all if there are no
    more; of rows with equal ``keys`` one.  A hash of the keys decides, so nothing
    is sorted and the choice of keys is the same in any order."""
    h = F.xxhash64(*keys, F.lit(17))
    n = df.agg(F.approx_count_distinct(h, 0.02)).first()[0]
    some = df if n <= 0.9 * rows else df.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 0.85 * rows / n))
    return some.dropDuplicates(list(keys))
