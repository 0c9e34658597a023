"""Documents and queries that a penalty harms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def victims(before: DataFrame, after: DataFrame, qrels: DataFrame, high: int = 10, low: int = 20) -> DataFrame:
    """Relevant documents (q, doc) that fell from the first `high` ranks to behind `low`."""
    both = before.select("q", "doc", F.col("rank").alias("rank_before")).where(F.col("rank") <= high).join(after.select("q", "doc", F.col("rank").alias("rank_after")), ["q", "doc"])
    return both.where(F.col("rank_after") > low).join(qrels.where("rel > 0").select("q", "doc", "rel"), ["q", "doc"])


def deviation_bands(per: DataFrame, measure: str) -> DataFrame:
    """Queries below mean - deviation (low) or above mean + deviation (high) of a measure."""
    stats = per.agg(F.avg(measure).alias("mean"), F.stddev_pop(measure).alias("dev"))
    marked = per.crossJoin(F.broadcast(stats)).withColumn("band", F.when(F.col(measure) < F.col("mean") - F.col("dev"), "low").when(F.col(measure) > F.col("mean") + F.col("dev"), "high"))
    return marked.where("band is not null")


def inversions(run: DataFrame, qrels: DataFrame, near: int = 10, far: int = 20) -> DataFrame:
    """First pair per query of a relevant document below an irrelevant one within the first ranks."""
    judged = run.where(F.col("rank") <= far).join(qrels, ["q", "doc"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    bad = judged.where((F.col("rel") <= 0) & (F.col("rank") <= near)).groupBy("q").agg(F.min(F.struct("rank", "doc")).alias("w"))
    good = judged.where("rel > 0").join(bad, "q").where(F.col("rank") > F.col("w.rank"))
    first = F.row_number().over(Window.partitionBy("q").orderBy("rank"))
    return good.withColumn("_n", first).where("_n = 1").select("q", F.col("w.doc").alias("irrelevant"), F.col("w.rank").alias("irrelevant_rank"), F.col("doc").alias("relevant"), F.col("rank").alias("relevant_rank"))
