"""Helpers that all operators of this subpackage share: reading, cutting lineage, Arrow schemas."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate words in every contract: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a class for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _top(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a local session, as in tests, may do without: it gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-shared-")
    return named.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_top(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_top(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage like a checkpoint, but packed and by column."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    back = df.sparkSession.read.schema(df.schema).parquet(folder)
    back.saved_in = folder
    return back


def forget(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.saved_in)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Keys with more than one in so many of all rows are joined by broadcast: there are at most as many of these.
HOT_KEYS = 1000


def hot_join(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of rows with a table that has one row for each key, and in ``count`` how many rows ask for it.

    The table's rows of the hottest keys, at most HOT_KEYS, go to every task, so rows of these stay where they are;
    all others are joined by a shuffle. Both sides are read twice: give saved tables. ``count`` is dropped.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = table.where(F.col(count) * HOT_KEYS > total).drop(count)
    cold = table.where(F.col(count) * HOT_KEYS <= total).drop(count)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the cluster has set them for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*columns: str) -> F.Column:
    """A 64-bit key of a row's values; equal rows have equal keys."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns])


def emit(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch in the order of the schema."""
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema
    )


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_column_type(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The schema of df and one more column."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])
