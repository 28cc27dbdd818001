"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, one of our own in local mode; on a cluster that is an error."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return own or f"{tempfile.gettempdir()}/checkpoints"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written and read again: its lineage ends here, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = where
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` has written, once nothing reads it any more."""
    for df in tables:
        df._written.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(df._written, True)
