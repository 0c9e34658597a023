"""Run, report and table writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trec_line(qid: Column, doc: Column, rank: Column, score: Column, run: str) -> Column:
    return F.format_string("%s Q0 %s %d %.6f %s", qid, doc, rank, score, F.lit(run))


def write_trec(run: DataFrame, path: str, name: str) -> None:
    """run: qid, doc_id, rank, score; lines in order of query and rank."""
    run.orderBy("qid", "rank").select(trec_line(F.col("qid"), F.col("doc_id"), F.col("rank"), F.col("score"), name).alias("value")).write.mode("overwrite").text(path)


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One line of text per row, numbers with four places."""
    cells = [F.format_string("%.4f", F.col(c)) if t == "double" else F.col(c).cast("string") for c, t in rows.select(*columns).dtypes]
    return rows.select(markdown_row(*cells).alias("value"))


def wide_metrics(per: DataFrame, ks: tuple[int, ...], measures: tuple[str, ...]) -> DataFrame:
    """One row per query type with a column for each measure and cut-off."""
    aggs = [F.avg(F.when(F.col("k") == k, F.col(m))).alias(f"{m}_{k}") for k in ks for m in measures]
    return per.groupBy("query_type").agg(*aggs)


def write_csv(rows: DataFrame, path: str, places: int = 6) -> None:
    rows.select(*(F.format_string(f"%.{places}f", c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes)).write.mode("overwrite").option("header", True).csv(path)


def append_results(results: DataFrame, path: str) -> None:
    """Sweep results are appended; readers take the last row of each point (operators.grid.completed)."""
    results.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)
