"""Session helpers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import wraps
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    b = SparkSession.builder.appName("hitweave")
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    for k, v in CONF.items():
        b = b.config(k, v)
    if master and master.startswith("local"):
        # small tables: without this their shuffles collapse into one task
        b = b.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16KB")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that the session names in ``spark.checkpoint.dir``.

    Where that is unset on a local master, it is set to a folder of the warehouse; on a cluster that could be a folder of
    one machine, so the job stops.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"


def built_once(build: Callable) -> Callable:
    """Columns that ``build`` makes of plain values, kept while the Spark context lives: large ones take thousands of calls to the JVM."""
    kept = WeakKeyDictionary()

    @wraps(build)
    def get(*args):
        own = kept.setdefault(SparkContext.getOrCreate(), {})
        if args not in own:
            own[args] = build(*args)
        return own[args]

    return get


def clear_shared(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; frames that read them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back from there."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several passes read as a Parquet table in the shared folder, and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
