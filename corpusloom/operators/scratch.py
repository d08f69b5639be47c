"""The folder that driver and executors share, from spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder, which also serves checkpoint(). Where the setting is absent and Spark runs in this process alone (tests, a
    laptop), a temporary one is made for the session; on a cluster that would be each machine's own, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("corpusloom.scratch", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("corpusloom.scratch", base)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Bytes of rows that a Python worker is sent, and gives back, at once, unless a single row is longer.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame, size: int = BATCH_BYTES) -> DataFrame:
    """Holds Arrow's batches in this session to `size` bytes, so that what Python makes of long texts does not fill the
    memory; a smaller setting stays."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)  # its default, where it was not set
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= size:
        spark.conf.set(key, str(size))
    return df


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """A table written to the shared folder and read back: it is computed once, and a lost executor costs a reread."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
