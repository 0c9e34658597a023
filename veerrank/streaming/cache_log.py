"""The append-only log of split queries as a stream, resumable by its checkpoint.

A query may return to an earlier value, so records are ordered by the file and times that they come with. Two ways to read the log: `drain`
keeps every record, and readers take the last one of each (readers.dual_queries); `fold` holds the last record of each
query in the stream's state and writes only what changes, so readers need not go through the log again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ranking import last_wins
from ..sources.readers import DUAL, dual_queries

#: What orders the records of a query, the last being the one that holds.
ORDER = ("logged_at", "logged_in", "logged_from", "created_at", "q_plus", "q_minus")
LAST = "qid string, query_type string, q_plus string, q_minus string, place string"


def cache_stream(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.readStream.schema(DUAL).json(folder)
    return lines.withColumns({"logged_at": F.col("_metadata.file_modification_time"), "logged_in": F.col("_metadata.file_path"), "logged_from": F.col("_metadata.file_block_start")})


def latest(log: DataFrame) -> DataFrame:
    """The last record of each query of a drained log."""
    order = F.struct("logged_at", "logged_in", "logged_from", "created_at", "q_plus", "q_minus")
    return dual_queries(log, order).drop("logged_at", "logged_in", "logged_from")


def drain(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write all that is there now, then stop."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_records(stream: DataFrame) -> DataFrame:
    """The stream of changes of each query's last record (LAST): its state is one record, whatever the log's length.

    place writes the record's order as text that sorts alike. Late files change nothing; a record that returns to an
    earlier value is a change like any other.
    """
    number = lambda c: F.lpad(F.col(c).cast("long").cast("string"), 20, "0")
    text = lambda c: F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\x01"))
    place = F.concat(F.lpad(F.unix_micros("logged_at").cast("string"), 20, "0"), text("logged_in"), number("logged_from"), text("created_at"), text("q_plus"), text("q_minus"))
    kind = F.coalesce(F.col("query_type"), F.lit("og"))
    rows = stream.where("qid is not null").select("qid", kind.alias("query_type"), "q_plus", "q_minus", place.alias("place"))

    def fold(key: tuple[str, str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, None, "")
        best = held
        for part in parts:  # a batch's records of one query come in pieces; one is held at a time
            row = part.sort_values("place").iloc[-1]
            if row["place"] > best[2]:
                best = (row["q_plus"], row["q_minus"], row["place"])
        if best != held:
            state.update(best)
            yield pd.DataFrame([(*key, *best)], columns=["qid", "query_type", "q_plus", "q_minus", "place"])

    return rows.groupBy("qid", "query_type").applyInPandasWithState(fold, LAST, "q_plus string, q_minus string, place string", "update", GroupStateTimeout.NoTimeout)


def fold(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Take up all that is there now, then stop: each micro-batch's changes are one folder below out, written again as a whole if the batch is."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/changes/batch={batch}")

    return last_records(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the finished folders name=<number>."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}=*/_SUCCESS")
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(root)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def folded(spark: SparkSession, out: str) -> DataFrame:
    """The last record of each query that `fold` has written: the newest base and the changes behind it."""
    bases, batches = _batches(spark, f"{out}/base", "upto"), _batches(spark, f"{out}/changes", "batch")
    upto = bases[-1] if bases else -1
    paths = [f"{out}/base/upto={upto}"] * bool(bases) + [f"{out}/changes/batch={b}" for b in batches if b > upto]
    if not paths:
        return spark.createDataFrame([], LAST)
    return last_wins(spark.read.schema(LAST).parquet(*paths), ("qid", "query_type"), F.col("place"))


def compact(spark: SparkSession, out: str) -> None:
    """Write what holds as a new base; older bases and the changes in it go. Readers see the old state until the base is whole."""
    batches = _batches(spark, f"{out}/changes", "batch")
    if not batches:
        return
    upto, old = batches[-1], _batches(spark, f"{out}/base", "upto")
    if upto not in old:
        folded(spark, out).write.parquet(f"{out}/base/upto={upto}")
    gone = [f"{out}/base/upto={b}" for b in old if b < upto] + [f"{out}/changes/batch={b}" for b in batches if b <= upto]
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
