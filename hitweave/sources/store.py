"""A stored table that is changed in place, source by source.

Rows lie in hash buckets of their key, one folder for each bucket. A change rewrites the buckets that it touches, by dynamic
partition overwrite, and leaves all other files as they are, so its cost follows the sources that change and not the table.
What a bucket is to hold is first written to the shared folder: the table is never read while it is overwritten, and a
change that failed half way can be given again, with the same result. One change at a time.

Within a bucket rows are dealt by Spark's rebalancing, which splits what a large source has, so a source with a third of all
rows is written by many tasks.

Defined cases: a null key is a key like others; a key without rows left disappears, and with the last one its bucket's
folder; a change without rows rewrites nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitweave.operators.catalog import catalog_rows, catalog_state, merge_catalog
from hitweave.session import write_table

BUCKET = "bucket"
BUCKETS = 256


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


class SourceStore:
    """A table below ``path`` in ``buckets`` folders, by hash of the columns ``key``; both are fixed when it is created."""

    def __init__(self, spark: SparkSession, path: str, key: list[str] | str = "source_name", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.key = [key] if isinstance(key, str) else list(key)

    def create(self, rows: DataFrame) -> None:
        """Write a new table; there must be none yet."""
        self._dealt(rows).write.partitionBy(BUCKET).parquet(self.path)

    def read(self) -> DataFrame:
        return self._all().drop(BUCKET)

    def replace(self, new: DataFrame) -> None:
        """All rows of the incoming keys are replaced by the incoming rows."""
        new = write_table(self._with_bucket(new), "incoming")
        touched = self._touched(new)
        self._rewrite(touched, lambda old: self._without(old, new).unionByName(new, allowMissingColumns=True))

    def delete(self, keys: DataFrame) -> None:
        """All rows of these keys go. ``keys`` has the key columns."""
        gone = write_table(self._with_bucket(keys.select(*self.key).distinct()), "gone")
        self._rewrite(self._touched(gone), lambda old: self._without(old, gone))

    def merge(self, new: DataFrame, combine: Callable[[DataFrame], DataFrame]) -> None:
        """Old and new rows of the incoming keys become ``combine`` of both; other rows of their buckets pass through it too."""
        new = write_table(self._with_bucket(new), "incoming")
        both = lambda old: self._with_bucket(combine(old.unionByName(new).drop(BUCKET)))
        self._rewrite(self._touched(new), both)

    def _all(self) -> DataFrame:
        # given, not inferred: the bucket's type must not depend on its folders
        seen = self.spark.read.parquet(self.path).drop(BUCKET).schema
        return self.spark.read.schema(T.StructType([*seen.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path)

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, bucket_of(self.key, self.buckets))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return self._with_bucket(rows).hint("rebalance", BUCKET)

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # one row for each bucket

    def _without(self, old: DataFrame, rows: DataFrame) -> DataFrame:
        names = {c: f"_{c}" for c in self.key}
        gone = rows.select(*[F.col(c).alias(n) for c, n in names.items()]).distinct()
        same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
        on = same[0]
        for s in same[1:]:
            on &= s
        return old.join(gone, on, "left_anti")

    def _rewrite(self, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
        if not touched:
            return
        old = self._all().where(F.col(BUCKET).isin(touched))
        rows = write_table(change(old).select(*old.columns), "buckets")
        out = rows.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy(BUCKET).parquet(self.path)
        # an overwrite leaves buckets alone of which nothing is left
        empty = set(touched) - set(self._touched(rows))
        if empty:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path
            fs = folder(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for b in empty:
                fs.delete(folder(f"{self.path}/{BUCKET}={b}"), True)


class Catalog:
    """The stored file catalog: what is known of each (file, user), changed by upload and finish events in any order."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.store = SourceStore(spark, path, ["filename", "user_id"], buckets)

    def create(self, events: DataFrame) -> None:
        self.store.create(catalog_state(events))

    def register(self, events: DataFrame) -> None:
        self.store.merge(catalog_state(events), merge_catalog)

    def rows(self) -> DataFrame:
        return catalog_rows(self.store.read())


def delete_stored(store: SourceStore, files: SourceStore, requests: DataFrame) -> None:
    """``delete_source`` on stored tables: by ``name`` all of a source, by ``file_id`` its chunks only if it is finished.

    ``files`` is kept by ``filename`` and has ``file_id, status``; ``store`` is kept by ``source_name``. Chunks go first: a
    request that failed half way finds the same files again.
    """
    names = requests.where(F.col("name").isNotNull()).select(F.col("name").alias("filename"))
    by_id = requests.where(F.col("file_id").isNotNull()).select("file_id").distinct()
    hit = write_table(files.read().join(by_id, "file_id", "left_semi"), "asked-files")
    gone = names.unionByName(hit.where("status = 2").select("filename")).distinct()
    store.delete(gone.withColumnRenamed("filename", "source_name"))
    left = files.read().join(by_id, "file_id", "left_anti").join(hit.select("filename").distinct(), "filename", "left_semi")
    left = write_table(left, "left-files")
    # files of a name that keeps some are replaced by those, the others go
    files.replace(left)
    lost = hit.select("filename").distinct().join(left.select("filename").distinct(), "filename", "left_anti")
    files.delete(names.unionByName(lost))
