"""A training-corpus pipeline over `documents`: every stage works on what the stage before it kept.

Rows are told apart by a hash of id, text, language and source; rows alike in all four are one document to a stage.
Defined results: null and empty texts fail the quality rules; null ids, languages and sources pass like any other; an
empty table gives no rows. Extra columns of documents, whatever their names, are carried along inside one struct; of rows
alike in the four that become one, the row whose columns' hash is smallest stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veerrank.llm import decontaminate, mixing, quality_rules, simhash, token_files
from veerrank.llm.queries import END_ID, TOKENIZER
from veerrank.llm.store import stash

KEY, ROW = "_row_key", "_row"


def _keyed(docs: DataFrame) -> DataFrame:
    """A row's key, the four columns that operators read, and the row itself: no other name can clash."""
    read = ("doc_id", "text", "lang", "source")
    return docs.select(F.xxhash64(*read).alias(KEY), *read, F.struct("*").alias(ROW))


def _only(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of keyed whose key is in keys (a column doc_id of distinct keys)."""
    return keyed.join(keys.select(F.col("doc_id").alias(KEY)).hint("shuffle_hash"), KEY, "left_semi")


def _one(keyed: DataFrame) -> DataFrame:
    """One row of each key: of several the first by the hash of all its columns."""
    order = Window.partitionBy(KEY).orderBy(F.xxhash64(ROW))
    return keyed.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: null and empty texts go, repeated rows share their verdict and all stay or go; no rows give no rows."""
    keyed = _keyed(docs)
    return _only(keyed, quality_rules.judge(keyed, id_col=KEY).where("kept").select("doc_id").distinct()).select(f"{ROW}.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one with the smallest id, then the smallest
    key; null ids come last, texts without words are one group, repeated rows leave one; no rows give no rows."""
    keyed = _keyed(docs)
    groups = stash(simhash.near_duplicates(keyed, shingle=5, id_col=KEY, similarity=0.8), "groups").distinct()
    named = groups.withColumnRenamed("doc_id", KEY).join(keyed.select(KEY, "doc_id").distinct(), KEY)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", KEY)).alias("first"))
    return _one(_only(keyed, first.select(F.col(f"first.{KEY}").alias("doc_id")))).select(f"{ROW}.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; items without an id count, without items all stay, null texts stay, repeated rows stay or go together."""
    keyed = _keyed(docs)
    clean = decontaminate.contained_items(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, id_col=KEY).where("n_hit = 0")
    return _only(keyed, clean.select("doc_id").distinct()).select(f"{ROW}.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix of sources takes: texts without words have none, repeated rows get theirs
    as one document, null sources are one source; no rows give no rows."""
    keyed = _keyed(docs)
    copies = mixing.mix(keyed, weights=(5, 2, 1), factor=1.5, most=2.0, id_col=KEY).groupBy("doc_id").agg(F.sum("copies").alias("_copies"))
    copies = copies.where("_copies > 0").withColumnRenamed("doc_id", KEY).hint("shuffle_hash")
    taken = _one(keyed).join(copies, KEY)
    return taken.select(ROW, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select(f"{ROW}.*")


def token_file_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in files, and what the files hold for each document: null texts are one end id, null ids come first, repeated rows follow each other."""
    return token_files.read_token_files(spark, token_files.write_token_files(docs, TOKENIZER, END_ID))


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("token_files", token_file_stage),
]

#: Fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
