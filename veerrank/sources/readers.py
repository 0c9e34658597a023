"""Typed readers: aliases are resolved once here, and every table has a fixed schema afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.keys import base_qid, document_text, query_type, strip
from ..operators.ranking import first_wins, last_wins

DUAL = S.StructType([S.StructField(n, S.LongType() if n == "idx" else S.StringType()) for n in ("task_name", "qid", "idx", "query", "instruction", "query_type", "q_plus", "q_minus", "created_at")])


def alias(df: DataFrame, *names: str) -> Column:
    """The first of several names that a table has, row by row; null where it has none."""
    found = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None)


def split_of(df: DataFrame, preferred: str, ordinal: Column | None = None) -> DataFrame:
    """Rows of the named split if there are any, else of the split that comes first by ordinal (without one: by name)."""
    if "split" not in df.columns:
        return df
    place = F.lit(0) if ordinal is None else ordinal
    first = df.select(F.min(F.struct(F.col("split") != preferred, place.alias("o"), "split")).alias("s"))
    return df.join(F.broadcast(first), F.col("split") == F.col("s.split")).drop("s")


def corpus(df: DataFrame, with_title: bool = True) -> DataFrame:
    title, body = alias(df, "title").cast("string"), F.coalesce(alias(df, "text", "body").cast("string"), F.lit(""))
    return df.select(alias(df, "_id", "id", "doc_id").cast("string").alias("doc_id"), title.alias("title"), body.alias("body"), (document_text(title, body) if with_title else body).alias("text"))


def queries(df: DataFrame, instructions: DataFrame, ordinal: Column | None = None) -> DataFrame:
    """qid, base_qid, query_type, query, instruction; suffixes other than -og and -changed are dropped.

    Of several instructions of a query the last by ordinal holds (without one: the greatest)."""
    left = df.select(alias(df, "_id", "id", "qid").cast("string").alias("qid"), F.coalesce(alias(df, "text", "query").cast("string"), F.lit("")).alias("query"))
    right = instructions.select(alias(instructions, "query-id", "query_id", "qid").cast("string").alias("qid"), alias(instructions, "instruction").alias("instruction"), (F.lit(0) if ordinal is None else ordinal).alias("_o"))
    right = right.groupBy("qid").agg(F.max(F.struct("_o", "instruction")).alias("_last")).select("qid", F.col("_last.instruction").alias("instruction"))
    joined = left.join(right, "qid", "left").withColumn("query_type", query_type(F.col("qid"))).where("query_type is not null")
    return joined.select("qid", base_qid(F.col("qid")).alias("base_qid"), "query_type", "query", F.coalesce("instruction", F.lit("")).alias("instruction"))


def candidates(df: DataFrame, ordinal: Column) -> DataFrame:
    """base_qid, doc_id, pos: the first list of each query wins."""
    rows = df.select(base_qid(alias(df, "query-id", "query_id", "qid").cast("string")).alias("base_qid"), alias(df, "corpus-ids", "results", "doc_ids").alias("docs"), ordinal.alias("_o"))
    return first_wins(rows, ("base_qid",), F.col("_o")).select("base_qid", F.posexplode("docs").alias("pos", "doc_id"))


def qrels(df: DataFrame, ordinal: Column) -> DataFrame:
    """qid, doc_id, rel: the last judgement of a pair wins; a missing one is 1."""
    rows = df.select(alias(df, "query-id", "query_id", "qid").cast("string").alias("qid"), alias(df, "corpus-id", "doc_id").cast("string").alias("doc_id"), F.coalesce(alias(df, "score", "relevance").cast("int"), F.lit(1)).alias("rel"), ordinal.alias("_o"))
    return last_wins(rows, ("qid", "doc_id"), F.col("_o")).drop("_o")


def qrel_diff(df: DataFrame) -> DataFrame:
    rows = df.select(base_qid(alias(df, "query-id", "query_id", "qid").cast("string")).alias("base_qid"), alias(df, "corpus-ids", "doc_ids").alias("doc_ids"))
    return rows.where(F.size("doc_ids") > 0)


def jsonl(spark: SparkSession, path: str, schema: S.StructType, strict: bool = True) -> DataFrame:
    """JSON lines; strict: a bad line fails the read, else it is left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def dual_queries(df: DataFrame, ordinal: Column) -> DataFrame:
    """The last record of each (qid, query_type); the type defaults to og."""
    rows = df.withColumn("query_type", F.coalesce("query_type", F.lit("og"))).withColumn("_o", ordinal)
    return last_wins(rows, ("qid", "query_type"), F.col("_o")).drop("_o")


def trec_run(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, score of a run file; the last line of a pair wins."""
    lines = spark.read.text(path).withColumn("_o", F.monotonically_increasing_id())
    return parse_trec(lines, F.col("value"), F.col("_o"))


def parse_trec(lines: DataFrame, line: Column, ordinal: Column) -> DataFrame:
    parts = lines.select(F.split(strip(line), r"\s+").alias("p"), ordinal.alias("_o")).where(F.size("p") >= 6)
    rows = parts.select(F.get("p", F.lit(0)).alias("qid"), F.get("p", F.lit(2)).alias("doc_id"), F.get("p", F.lit(4)).cast("double").alias("score"), "_o")
    return last_wins(rows, ("qid", "doc_id"), F.col("_o")).drop("_o")


def missing_vectors(documents: DataFrame, cache: DataFrame) -> DataFrame:
    """Documents that a vector cache lacks (both with doc_id): those are what is left to encode."""
    return documents.join(cache.select("doc_id"), "doc_id", "left_anti")
