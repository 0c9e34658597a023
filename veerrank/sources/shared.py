"""Tables kept in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only where driver and executors are one process can a temporary folder stand in for it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{os.path.join(tempfile.gettempdir(), 'veerrank-shared')}"
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stash(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once and read it back: later uses neither repeat its work nor depend on lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shelve(df: DataFrame | Iterable[DataFrame], name: str, key: str, buckets: int, dealt: bool = False) -> DataFrame:
    """Write df once, bucketed by key, and read it back: tables of as many buckets meet by key without a shuffle. dealt: a task of df holds one bucket already. Several frames are written one after the other."""
    table, path = f"{name}_{uuid.uuid4().hex}", None
    for part in [df] if isinstance(df, DataFrame) else df:
        spark = part.sparkSession
        path = path or scratch(spark, name)
        (part if dealt else part.repartition(buckets, key)).write.mode("append").bucketBy(buckets, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay; the frame knows where they are
    return rows


def discard(df: DataFrame) -> None:
    """Delete the files under a table that is needed no more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files under df, all columns, as the reader knows them; 0 where it knows none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def buckets_for(df: DataFrame, bytes_each: int, least: int = 16) -> int:
    """So many buckets that each holds a bounded share of df, growing with it."""
    return max(least, -(-input_bytes(df) // bytes_each))
