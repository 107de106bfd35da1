"""Tables in the shared folder: they cut lineage, so the loss of an executor costs a read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, about (a row that is larger makes a batch of its own), and texts that a Python
#: worker reads at once.
BATCH_BYTES, TEXTS = 32 << 20, 1000


def shared_dir(spark: SparkSession) -> str:
    """A new folder that every executor sees, below ``spark.checkpoint.dir``.  Where that setting is
    missing, a local folder is made and set as such in local mode (tests); a cluster raises, since its
    executors share no local folder.  The folder is deleted when the application ends."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif re.fullmatch(r"local(\[.*\])?", context.master):
            base = f"file://{tempfile.mkdtemp(prefix='cairnlake-')}"
            context.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{base}/cairnlake-{uuid.uuid4().hex}"
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(context._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them again: the lineage ends there."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, path: str) -> None:
    """Delete a materialised table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame, key: str, rows: int = 2000) -> DataFrame:
    """The rows dealt by a key into tasks of about ``rows``: for work that takes long a row, where a table of few bytes
    would else be one task."""
    return df.repartition(max(1, -(-df.count() // rows)), key)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold TEXTS rows and about BATCH_BYTES at most: whole texts are wide rows, and a
    batch is held by the JVM outside its heap and by the Python worker at once.  The settings stay with
    the session, since the caller runs the plan later."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(re.match(r"-?\d+", spark.conf.get(key))[0]) <= most:
            spark.conf.set(key, str(most))
