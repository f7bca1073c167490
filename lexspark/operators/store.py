"""A keyed store in the shared folder: batches of puts, patches and deletes, merged as they are read.

A batch is a folder of rows and a commit file. Only committed batches are read, and a batch whose
commit file is there isn't written again, so a batch that is retried, as in ``foreachBatch``, does
no harm. ``compact`` writes what the batches come to as a snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, PATCH, DELETE = "put", "patch", "delete"


class KeyedStore:
    """Rows by ``key`` with the fields of ``schema`` (key and values), under ``folder``.

    Operations are rows of the schema with ``op`` and ``at``, a number that orders them within their
    batch and settles ties. A put gives all values, nulls too. A patch changes the values that it has
    and leaves those where it is null; without a row it makes one. A delete takes the row away. Later
    batches go before earlier ones, whatever their ``at``. A null key is a key like others.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: T.StructType) -> None:
        self.spark, self.folder, self.key, self.schema = spark, folder.rstrip("/"), key, schema
        self.values = [f.name for f in schema.fields if f.name != key]
        self._rows = T.StructType([*schema.fields, T.StructField("op", T.StringType()), T.StructField("at", T.LongType())])

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _commit(self, name: str) -> None:
        files, path = self._files(f"commits/{name}")
        files.create(path, True).close()

    def commits(self) -> tuple[int, list[int]]:
        """The batch up to which there is a snapshot (-1 without one), and the committed batches after it."""
        files, path = self._files("commits")
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        upto = max((int(n.split("-")[1]) for n in names if n.startswith("snapshot-")), default=-1)
        return upto, sorted(b for n in names if n.startswith("batch-") and (b := int(n.split("-")[1])) > upto)

    def write(self, operations: DataFrame, batch: int) -> bool:
        """Write a batch and commit it; False, and nothing is written, if it has been committed or is under the snapshot."""
        upto, done = self.commits()
        if batch <= upto or batch in done:
            return False
        names = [f.name for f in self._rows.fields]
        operations.select(*[F.col(n).cast(self._rows[n].dataType) for n in names]).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        self._commit(f"batch-{batch}")
        return True

    def _operations(self) -> DataFrame:
        upto, batches = self.commits()
        read = self.spark.read.schema(self._rows)
        parts = [read.parquet(f"{self.folder}/batch-{b}").withColumn("batch", F.lit(b).cast("long")) for b in batches]
        if upto >= 0:
            parts.append(read.parquet(f"{self.folder}/snapshot-{upto}").withColumn("batch", F.lit(-1).cast("long")))
        out = self.spark.createDataFrame([], T.StructType([*self._rows.fields, T.StructField("batch", T.LongType())]))
        for p in parts:
            out = out.unionByName(p)
        return out

    def read(self) -> DataFrame:
        """The rows as the committed batches leave them.

        Of each key the last put or delete is found, then of each value the last patch after it; both
        are sums within tasks before a shuffle, so a key may have any number of operations.
        """
        rows = self._operations().withColumn("_at", F.struct("batch", "at"))
        whole = rows.where(F.col("op") != PATCH).groupBy(F.col(self.key).alias("_k")).agg(
            F.max("_at").alias("_since"), F.max_by(F.struct("op", *self.values), "_at").alias("_base"), F.lit(True).alias("_known")
        )
        patched = rows.where(F.col("op") == PATCH).join(whole.select("_k", "_since"), rows[self.key].eqNullSafe(F.col("_k")), "left").where(
            F.col("_since").isNull() | (F.col("_at") > F.col("_since"))
        ).groupBy(F.col(self.key).alias("_p")).agg(F.lit(True).alias("_patched"), *[
            F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_at"))).alias(f"_new_{v}") for v in self.values
        ])
        both = whole.join(patched, F.col("_k").eqNullSafe(F.col("_p")), "full")
        stands = F.coalesce(F.col("_base.op") == PUT, F.lit(False))
        shown = both.where(stands | F.coalesce("_patched", F.lit(False)))
        return shown.select(
            F.when(F.col("_known"), F.col("_k")).otherwise(F.col("_p")).alias(self.key),
            *[F.coalesce(f"_new_{v}", F.when(stands, F.col(f"_base.{v}"))).alias(v) for v in self.values]
        ).select(*self.schema.names)

    def compact(self) -> int:
        """Write the rows as a snapshot in place of the batches so far; its number. Readers that have begun keep their files: nothing is deleted."""
        upto, batches = self.commits()
        if not batches:
            return upto
        last = batches[-1]
        self.read().withColumn("op", F.lit(PUT)).withColumn("at", F.lit(0).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/snapshot-{last}")
        self._commit(f"snapshot-{last}")
        return last
