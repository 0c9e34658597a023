"""Caches that runs leave and take up again: vectors, split queries, sweep results, model weights."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.keys import NONE
from ..operators.ranking import last_wins
from .readers import DUAL, alias, dual_queries, jsonl
from .shared import stash

VECTORS = "id string, embedding array<float>"
#: Tasks that the texts of a bucket are spread over.
SPREAD = 64
#: Versioned files of split queries: dual_queries_v5_<task>.jsonl.
_VERSIONED = r"dual_queries_v(\d+)_(.+)\.jsonl$"


def absent(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds nothing to read at a path (or glob)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return found is None or not len(found)


def read_or_empty(spark: SparkSession, path: str, schema: str | S.StructType, kind: str = "parquet") -> DataFrame:
    """A table, or one without rows where there is none yet."""
    if absent(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(kind).load(path)


def write_vectors(rows: DataFrame, path: str, id_col: str = "id") -> None:
    """Append (id, embedding); readers take any one of an id."""
    rows.select(F.col(id_col).cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).write.mode("append").parquet(path)


def read_vectors(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame | None:
    """The cached vectors, or None where there are none or, with wanted (id), where they hold an id that is not wanted."""
    if absent(spark, path):
        return None
    cache = spark.read.schema(VECTORS).option("recursiveFileLookup", True).parquet(path).dropDuplicates(["id"])
    return cache if wanted is None or within(cache, wanted) else None


def within(a: DataFrame, b: DataFrame, key: str = "id") -> bool:
    """Every key of a is one of b's."""
    return a.join(b.select(key), key, "left_anti").isEmpty()


def same_keys(a: DataFrame, b: DataFrame, key: str = "id") -> bool:
    return within(a, b, key) and within(b, a, key)


def encode_missing(texts: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame], buckets: int = 64) -> DataFrame:
    """Vectors of texts (id, text): what the cache lacks is encoded bucket by bucket, each committed for itself, and the whole is read back.

    A bucket holds the ids of one hash value; its vectors are there when its write has ended, and then a line of the
    manifest says so. A job that is interrupted keeps the buckets it has finished, and the next one encodes only ids without
    a vector, so no bucket is counted on that is not whole and none is encoded twice. Texts that are left are dealt to their
    buckets once. A cache of other ids is no prefix of this job and raises.
    """
    spark = texts.sparkSession
    cache = read_vectors(spark, path)
    if cache is not None and not within(cache, texts):
        raise ValueError(f"the vectors at {path} are of other documents")
    left = texts if cache is None else texts.join(cache.select("id"), "id", "left_anti")
    dealt = left.withColumn("_bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    staged = stash(dealt.repartition("_bucket", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SPREAD))), "texts", ["_bucket"])
    waiting = [r._bucket for r in staged.groupBy("_bucket").count().orderBy("_bucket").collect()]
    for bucket in waiting:
        write_vectors(encode(staged.where(F.col("_bucket") == bucket).drop("_bucket")), f"{path}/bucket={bucket}")
        done = spark.read.schema(VECTORS).parquet(f"{path}/bucket={bucket}").agg(F.lit(bucket).alias("bucket"), F.count("*").alias("vectors"))
        done.withColumn("written_at", F.current_timestamp()).write.mode("append").json(manifest_of(path))
    found = read_vectors(spark, path)
    return found if found is not None else spark.createDataFrame([], VECTORS)


def manifest_of(path: str) -> str:
    return f"{path.rstrip('/')}-manifest"


def encoded_buckets(spark: SparkSession, path: str) -> DataFrame:
    """bucket, vectors and written_at of the buckets that are finished: the last line of each."""
    rows = read_or_empty(spark, manifest_of(path), "bucket int, vectors long, written_at timestamp", "json")
    return last_wins(rows, ("bucket",), F.col("written_at"))


def latest_files(files: DataFrame, name: str = "name") -> DataFrame:
    """task, version and name of the newest file of split queries of each task; other names are left out."""
    found = files.select(F.col(name).alias("name"), F.regexp_extract(name, _VERSIONED, 1).alias("v"), F.regexp_extract(name, _VERSIONED, 2).alias("task")).where("v <> ''")
    return last_wins(found.withColumn("version", F.col("v").cast("long")).drop("v"), ("task",), F.col("version"))


def task_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the files of a folder, of one directory level."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder).select(F.col("path").alias("name"))


def load_split_queries(spark: SparkSession, folder: str, task: str) -> DataFrame:
    """The last record of each (qid, query_type) in the task's newest file; no rows where there is no file."""
    if absent(spark, folder):
        return spark.createDataFrame([], DUAL)
    newest = latest_files(task_files(spark, folder)).where(F.col("task") == task).first()
    if newest is None:
        return spark.createDataFrame([], DUAL)
    rows = jsonl(spark, newest.name, DUAL, strict=False).where("qid is not null")
    return dual_queries(rows, F.struct("created_at", "idx"))


def append_split_queries(records: DataFrame, path: str) -> None:
    """Add records to the log as JSON lines, with the time where they have none."""
    stamped = records.withColumn("created_at", F.coalesce(alias(records, "created_at").cast("string"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")))
    stamped.select(*(f.name for f in DUAL)).write.mode("append").json(path)


def with_fallback(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (qid, query_type, query) with q_plus, q_minus and hit: the cached split, else the query itself and no constraint."""
    found = cache.select("qid", "query_type", F.col("q_plus").alias("_plus"), F.col("q_minus").alias("_minus"), F.lit(True).alias("_hit"))
    joined = requests.join(found, ["qid", "query_type"], "left")
    return joined.select(*requests.columns, F.coalesce("_plus", "query").alias("q_plus"), F.coalesce("_minus", F.lit(NONE)).alias("q_minus"), F.coalesce("_hit", F.lit(False)).alias("hit"))


def cache_counts(found: DataFrame) -> DataFrame:
    """Hits and misses, by type."""
    return found.groupBy("query_type").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def failures(found: DataFrame, attempts: int, error: Column | str = "no split in the cache") -> DataFrame:
    """The dead letters of requests without a split, as rows for append mode."""
    return found.where(~F.col("hit")).select("qid", "query_type", "query", F.lit(attempts).alias("attempts"), (F.lit(error) if isinstance(error, str) else error).alias("error"))


def tolerant_lines(lines: DataFrame, line: Column, schema: S.StructType) -> tuple[DataFrame, DataFrame]:
    """Parsed rows of JSON lines, and the lines that are none (blank ones are in neither)."""
    full = S.StructType([*schema.fields, S.StructField("_corrupt_record", S.StringType())])
    parsed = lines.where(F.trim(line) != "").select(F.from_json(line, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    return parsed.where(~bad).select(*(F.col(f"r.`{f.name}`").alias(f.name) for f in schema)), parsed.where(bad).select(F.col("r._corrupt_record").alias("line"))


def version_of(spark: SparkSession, path: str) -> dict:
    """What is noted of a cache's version; 1.0 without times where nothing is."""
    rows = read_or_empty(spark, path, "version string, created_at string, updated_at string", "json")
    row = rows.orderBy(F.desc("updated_at")).first()
    return row.asDict() if row else {"version": "1.0", "created_at": None, "updated_at": None}


def note_version(spark: SparkSession, path: str, version: str) -> None:
    """Add a note with the time; the first note's time of creation stays."""
    created = version_of(spark, path)["created_at"]
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    spark.range(1).select(F.lit(version).alias("version"), F.coalesce(F.lit(created), now).alias("created_at"), now.alias("updated_at")).write.mode("append").json(path)


def baseline_of(spark: SparkSession, path: str) -> dict[str, float]:
    """A task's earlier result; zeros where there is none."""
    try:
        row = spark.read.schema("p_mrr double, map double, ndcg double").json(path).first()
    except AnalysisException:
        row = None
    return {k: float((row and row[k]) or 0.0) for k in ("p_mrr", "map", "ndcg")}


def best_trial(spark: SparkSession, pattern: str, metric: str = "map") -> DataFrame:
    """The trial with the best metric among JSON files of a pattern: its file and the metric."""
    rows = spark.read.schema(f"{metric} double").option("multiLine", True).json(pattern).withColumn("file", F.input_file_name())
    return rows.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), "file").limit(1)


def training_lists(vectors: DataFrame, num_neg: int = 15) -> DataFrame:
    """idx, q_plus, q_minus, pos and neg (arrays of vectors in order) from rows (idx, role, sub_idx, embedding)."""

    def of(role: str) -> Column:
        rows = F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("sub_idx", "embedding"))))
        return F.transform(rows, lambda r: r.embedding)

    lists = vectors.groupBy("idx").agg(*(of(r).alias(r) for r in ("q_plus", "q_minus", "pos", "neg")))
    return lists.select("idx", F.get("q_plus", F.lit(0)).alias("q_plus"), F.get("q_minus", F.lit(0)).alias("q_minus"), "pos", F.slice("neg", 1, num_neg).alias("neg"))


def rows_at(rows: DataFrame, places: DataFrame, key: str = "idx") -> DataFrame:
    """Rows with place, their number from 0 in the order of a whole-number key, for the wanted places: a data set's items by index."""
    from ..operators.ranking import numbered

    placed = numbered(rows.withColumn("_all", F.lit(1)), "_all", key, key).drop("_all")
    return placed.join(places.select("place").distinct(), "place", "left_semi")


def index_of(placed: DataFrame, kind: str) -> DataFrame:
    """One row with a map from each type to the first and last of its places and their number; types are few."""
    ranges = placed.groupBy(kind).agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"))
    return ranges.agg(F.map_from_entries(F.collect_list(F.struct(kind, F.struct("first", "last", "n")))).alias("ranges"))


def training_rows(rows: DataFrame) -> DataFrame:
    """(idx, role, sub_idx, text) of each text of training rows (idx, q_plus, q_minus, pos, neg): what is to be encoded."""
    listed = {"q_plus": F.array("q_plus"), "q_minus": F.array("q_minus"), "pos": F.col("pos"), "neg": F.col("neg")}
    parts = [rows.select("idx", F.lit(role).alias("role"), F.posexplode(texts).alias("sub_idx", "text")) for role, texts in listed.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


WEIGHTS = "save string, name string, value string, score double, saved_at timestamp"


def write_weights(spark: SparkSession, weights: dict[str, list], path: str, score: float) -> None:
    """Model weights as rows (save, name, value as JSON, score, saved_at), appended: the best of all saves is the checkpoint."""
    save = uuid.uuid4().hex
    rows = spark.createDataFrame([(save, n, json.dumps(w), float(score)) for n, w in weights.items()], "save string, name string, value string, score double")
    rows.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def read_weights(spark: SparkSession, path: str) -> dict[str, list]:
    """The weights of the save with the lowest score, all of that one save; the later of equal ones."""
    rows = read_or_empty(spark, path, WEIGHTS)
    first = rows.orderBy("score", F.desc("saved_at"), "save").first()
    if first is None:
        return {}
    return {r.name: json.loads(r.value) for r in rows.where(F.col("save").eqNullSafe(first.save)).collect()}


def write_state(spark: SparkSession, name: str, epoch: int, data: bytes, path: str) -> None:
    """A trainer's whole state after an epoch as one row: a save is there or not, never in part."""
    spark.createDataFrame([(name, epoch, bytearray(data))], "name string, epoch int, data binary").coalesce(1).write.mode("append").parquet(path)


def read_state(spark: SparkSession, name: str, path: str) -> bytes | None:
    """The last state of a part, or None."""
    row = read_or_empty(spark, path, "name string, epoch int, data binary").where(F.col("name") == name).orderBy(F.desc("epoch")).first()
    return bytes(row.data) if row else None
