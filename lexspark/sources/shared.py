"""Tables in the folder that the cluster shares: cut lineage, and indexes that outlive a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def top(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a local session may do without, and gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    files, path = _path(spark, folder)
    return files.exists(path)


def delete(spark: SparkSession, folder: str) -> None:
    files, path = _path(spark, folder)
    files.delete(path, True)


def written(df: DataFrame, folder: str, **options: str) -> DataFrame:
    """Write a table, over what an unfinished run has left, and read it back."""
    df.write.mode("overwrite").options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def saved(df: DataFrame, name: str) -> DataFrame:
    """A table under a new name in the shared folder: cuts the lineage as a checkpoint does, and its size is known to the planner."""
    return written(df, f"{top(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def state_of(table: DataFrame) -> str:
    """A name for what the files of a table hold now: their paths, sizes and times of change, without reading their rows."""
    files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*files.columns)), F.sum(F.hash(*files.columns).cast("long"))).first()
    return "-".join(f"{x & (1 << 64) - 1:x}" for x in row if x is not None)
