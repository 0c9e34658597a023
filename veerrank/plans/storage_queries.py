"""Queries that go through files, encoders and small models and come back, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import encoders, engine, grid, ranking, training
from ..sources import caches, readers, reports, sinks
from ..sources.shared import scratch, stash
from . import fixture as X
from .engine_queries import _Q_PLUS, _engine_sql, _run, _vectors
from .queries import query


def _file(rows: DataFrame, path: str) -> None:
    """Lines (value) as one file of that name; these are small tables of a cache, written once."""
    spark, folder = rows.sparkSession, scratch(rows.sparkSession, "one-file")
    rows.coalesce(1).write.text(folder)
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(jvm.Path(path).getParent())
    files.rename(files.globStatus(jvm.Path(f"{folder}/part-*"))[0].getPath(), jvm.Path(path))


def _split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = X.table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 2 == 0, "og").otherwise("changed")
    return turns.select(F.lit("t").alias("task_name"), F.concat(F.col("conv_id").cast("string"), F.lit("-"), kind).alias("qid"), F.col("turn").alias("idx"), F.col("text").alias("query"), F.lit("").alias("instruction"), kind.alias("query_type"), F.col("text").alias("q_plus"), F.col("role").alias("q_minus"), F.lpad(F.col("turn").cast("string"), 9, "0").alias("created_at"))


@query("SELECT conv_id || CASE WHEN turn % 2 = 0 THEN '-og' ELSE '-changed' END AS qid, max_by(text, turn) AS q_plus, max_by(role, turn) AS q_minus FROM conversations GROUP BY conv_id, turn % 2")
def split_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of a task's file of split queries, the last record of each; an older version says otherwise, and so does another task's."""
    records, folder = _split_records(spark, sf_dir), scratch(spark, "split")
    old = records.withColumn("q_plus", F.lit("old"))
    for name, rows in (("v4_task", old), ("v5_task", records), ("v6_other", old)):
        _file(reports.json_lines(rows), f"{folder}/dual_queries_{name}.jsonl")
    return caches.load_split_queries(spark, folder, "task").select("qid", "q_plus", "q_minus")


@query("SELECT q || '-og' AS qid, CAST(doc AS VARCHAR) AS doc_id, CAST(format('{:.6f}', so) AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY so DESC, doc) AS rank FROM scored) WHERE rank <= 20", fixture=True)
def run_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run written in the six-column format and read back."""
    path = scratch(spark, "run")
    run = X.first(spark, sf_dir, 20).select(F.concat(F.col("q").cast("string"), F.lit("-og")).alias("qid"), F.col("doc").cast("string").alias("doc_id"), "rank", F.col("so").alias("score"))
    sinks.write_trec(run, path, "base")
    return readers.trec_run(spark, path).select("qid", "doc_id", "score")


@query(_engine_sql("sb") + ", lines AS (SELECT query_type AS kind, count(*) AS n, sum(rank) AS ranks FROM run WHERE rank <= 30 GROUP BY query_type) SELECT * FROM lines UNION ALL SELECT 'report', count(DISTINCT qid), 30 FROM run", fixture=True)
def saved_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a run leaves in its folder, read back: both sides' ranks and the report."""
    folder = scratch(spark, "saved")
    run = _run(spark, sf_dir, _Q_PLUS, 30).select("qid", "base_qid", "query_type", "doc", "rank", "score")
    bundle = run.agg(F.countDistinct("qid").alias("queries"), F.max("rank").alias("most"))
    reports.save_run(run, bundle, folder, "t", "m")
    sides = [spark.read.text(f"{folder}/run_{k}").select(F.lit(k).alias("kind"), F.split("value", " ")[3].cast("long").alias("rank")) for k in ("og", "changed")]
    lines = sides[0].unionByName(sides[1]).groupBy("kind").agg(F.count("*").alias("n"), F.sum("rank").alias("ranks"))
    report = spark.read.json(f"{folder}/results_t").where("task = 't' and model = 'm'")
    return lines.unionByName(report.select(F.lit("report").alias("kind"), F.col("metrics.queries").alias("n"), F.col("metrics.most").alias("ranks")))


@query("SELECT CAST(label AS BIGINT) AS param_index, CASE WHEN label % 2 = 0 THEN 10e0 ELSE 1e0 END * count(*) AS p_mrr FROM embeddings GROUP BY label")
def sweep_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results appended twice, read as the last of each point; a label stands for a point."""
    path = scratch(spark, "results")
    counts = X.documents(spark, sf_dir).groupBy(F.col("label").cast("long").alias("param_index")).agg(F.count("*").cast("double").alias("p_mrr"))
    sinks.append_results(counts, path)
    sinks.append_results(counts.where("param_index % 2 = 0").withColumn("p_mrr", 10 * F.col("p_mrr")), path)
    return grid.completed(spark.read.parquet(path)).select("param_index", "p_mrr")


@query("SELECT CAST(count(*) AS VARCHAR) AS version, true AS kept, true AS ordered FROM documents")
def version_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two notes of a cache's version: the last one holds, and the first one's time of creation stays."""
    path, n = scratch(spark, "version"), X.table(spark, sf_dir, "documents").count()
    caches.note_version(spark, path, "1")
    first = caches.version_of(spark, path)
    caches.note_version(spark, path, str(n))
    now = caches.version_of(spark, path)
    return spark.createDataFrame([(now["version"], now["created_at"] == first["created_at"], now["created_at"] <= now["updated_at"])], "version string, kept boolean, ordered boolean")


@query("SELECT 'task' AS name, count(*) / 1e3 AS p_mrr, round(avg(label), 6) AS map, 0e0 AS ndcg FROM embeddings UNION ALL SELECT 'none', 0e0, 0e0, 0e0")
def earlier_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task's earlier result, with zeros for what is not there, and all zeros for a task without any."""
    folder = scratch(spark, "earlier")
    row = X.documents(spark, sf_dir).agg((F.count("*") / 1000).alias("p_mrr"), F.round(F.avg("label"), 6).alias("map"))
    row.write.json(f"{folder}/task.json")
    found = {name: caches.baseline_of(spark, f"{folder}/{name}.json") for name in ("task", "none")}
    return spark.createDataFrame([(n, r["p_mrr"], r["map"], r["ndcg"]) for n, r in found.items()], "name string, p_mrr double, map double, ndcg double")


@query("SELECT CAST(label AS BIGINT) AS trial, round(avg(embedding[1]), 5) AS map FROM embeddings GROUP BY label ORDER BY map DESC, trial LIMIT 1")
def best_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the trials' metric files; a label stands for a trial."""
    folder = scratch(spark, "trials")
    trials = X.documents(spark, sf_dir).groupBy("label").agg(F.round(F.avg(F.get("embedding", F.lit(0))), 5).alias("map"))
    trials.select(F.concat(F.lit("trial_"), F.col("label").cast("string")).alias("trial"), "map").write.partitionBy("trial").json(folder)
    best = caches.best_trial(spark, f"{folder}/trial=trial_*")
    return best.select(F.regexp_extract("file", r"trial_(\d+)", 1).cast("long").alias("trial"), "map")


class Letters:
    """Counts of four vowels, halved: an encoder that SQL can repeat."""

    dim = 4

    def encode(self, text: Column) -> Column:
        return F.array(*((F.length(F.coalesce(text, F.lit(""))) - F.length(F.replace(F.coalesce(text, F.lit("")), F.lit(c)))) / 2 for c in "aeio")).cast("array<float>")


encoders.register("letters", Letters)
_LETTERS = [f"(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{c}', ''))) / 2e0" for c in "aeio"]


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, {', '.join(f'{x} AS {c}' for c, x in zip('aeio', _LETTERS))} FROM documents")
def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through an encoder that is found by a part of its name, each distinct text once."""
    texts = X.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    vectors = encoders.encoded(texts, "org/Letters-v1")
    return vectors.select("id", *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("aeio")))


@query(f"""
  WITH v AS (SELECT conv_id AS idx, role, turn, {_LETTERS[1]} AS e FROM conversations),
  lists AS (SELECT idx, list(e ORDER BY turn) FILTER (role = 'user') AS pos, list(e ORDER BY turn) FILTER (role <> 'user') AS neg FROM v GROUP BY idx)
  SELECT idx, CAST(len(coalesce(pos, [])) AS BIGINT) AS n_pos, CAST(least(len(coalesce(neg, [])), 3) AS BIGINT) AS n_neg, pos[1] AS first_pos, neg[least(len(neg), 3)] AS last_neg FROM lists""")
def prepared_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training texts encoded, stored, and read back as lists by row: the turns of a conversation, with three negatives at most."""
    path, user = scratch(spark, "prepared"), F.col("role") == "user"
    turns = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("idx"), F.when(user, "pos").otherwise("neg").alias("role"), F.col("turn").alias("sub_idx"), "text")
    encoders.prepared(turns, "letters").write.parquet(path)
    lists = caches.training_lists(spark.read.parquet(path), 3)
    e = lambda v: F.get(v, F.lit(1)).cast("double")
    return lists.select("idx", F.size("pos").cast("long").alias("n_pos"), F.size("neg").cast("long").alias("n_neg"), e(F.get("pos", F.lit(0))).alias("first_pos"), e(F.try_element_at("neg", F.lit(-1))).alias("last_neg"))


_H = "greatest(4e0 * embedding[1] - embedding[2], 0e0)", "greatest(0.5e0 - 2e0 * embedding[3], 0e0)"


def _gate_sql(most: float, low: float, high: float) -> str:
    a, t = f"({_H[0]} - 0.5e0 * {_H[1]} + 0.1e0)", f"(2e0 * {_H[1]} - {_H[0]})"
    return f"round({most}e0 / (1e0 + exp(-{a})), 6) AS alpha, round({low}e0 + {round(high - low, 6)}e0 / (1e0 + exp(-{t})), 6) AS tau"


@query(" UNION ALL ".join(f"SELECT vec_id, '{n}' AS encoder, {_gate_sql(*b)} FROM embeddings" for n, b in (("repllama", (1.2, 0.45, 0.85)), ("mistral", (1.5, 0.4, 0.8)), ("bge", (2.0, 0.3, 0.7)))))
def gate_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength and threshold of every vector from a gate with given weights, within each encoder family's bounds."""
    rows = X.documents(spark, sf_dir)
    dim = rows.select(F.size("embedding")).first()[0]
    first = np.zeros((dim, 2))
    first[0, 0], first[1, 0], first[2, 1] = 4.0, -1.0, -2.0
    weights = (first, np.array([0.0, 0.5]), np.array([[1.0, -1.0], [-0.5, 2.0]]), np.array([0.1, 0.0]))
    parts = [rows.select(F.col("doc").alias("vec_id"), F.lit(n).alias("encoder"), training.gate(weights, *training.gate_bounds(n))("embedding").alias("g")) for n in training.GATE_BOUNDS]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("vec_id", "encoder", F.round("g.alpha", 6).alias("alpha"), F.round("g.tau", 6).alias("tau"))


@query("SELECT least(15, count(*)) AS n, true AS of_the_grid, true AS again, count(*) <= 15 AS same_for_all_seeds FROM embeddings")
def sampled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen points of a grid in a seeded order: vectors stand for points. A seed always gives the same ones, another seed others."""
    points = X.documents(spark, sf_dir).select(F.col("doc").alias("param_index"))
    once, again, other = (stash(grid.sampled(points, 15, seed), "sampled") for seed in (42, 42, 43))
    same = lambda a, b: caches.same_keys(a, b, "param_index")
    row = (once.select("param_index").distinct().count(), caches.within(once, points, "param_index"), same(once, again), same(once, other))
    return spark.createDataFrame([row], "n long, of_the_grid boolean, again boolean, same_for_all_seeds boolean")


@query("SELECT count(*) AS n, count(DISTINCT conv_id) AS keys, 0 AS keys_on_both_sides, 0 AS rows_on_both_sides, true AS shares_hold FROM conversations")
def training_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split by key keeps a conversation on one side, a split by row parts rows; both give away no row, and about a tenth is held out."""
    turns = X.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    by_key = stash(training.grouped_split(turns, "conv_id"), "split")
    train, held = (stash(s, "rows") for s in training.row_split(turns))
    sides = by_key.groupBy("conv_id").agg(F.countDistinct("validation").alias("sides"), F.count("*").alias("n"), F.max(F.col("validation").cast("int")).alias("v"))
    row = sides.agg(F.sum("n").alias("n"), F.count("*").alias("keys"), F.sum(F.col("sides") - 1).alias("both"), F.avg("v").alias("share")).first()
    rows = train.count() + held.count()
    near = lambda share, n: abs(share - 0.1) <= 4 * (0.09 / max(n, 1)) ** 0.5
    shared = train.join(held, ["conv_id", "turn"], "left_semi").count()
    return spark.createDataFrame([(row["n"], row["keys"], int(row["both"]), shared, rows == row["n"] and near(row["share"], row["keys"]) and near(held.count() / max(rows, 1), rows))], "n long, keys long, keys_on_both_sides int, rows_on_both_sides int, shares_hold boolean")


@query("""
  WITH asked AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '/' || turn || CASE WHEN turn % 2 = 0 THEN '-og' ELSE '-changed' END AS qid, CASE WHEN turn % 2 = 0 THEN 'og' ELSE 'changed' END AS query_type, text FROM conversations),
  split AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 3 = 1 THEN '[NONE]' ELSE text END AS minus, conv_id % 3 > 0 AS found FROM asked),
  known AS (SELECT DISTINCT text FROM conversations WHERE conv_id % 5 <> 0)
  SELECT s.qid, s.query_type, CASE WHEN query_type = 'og' OR minus IS NULL OR upper(trim(minus, {BLANKS})) IN ('', '[NONE]', 'NONE', 'NULL', 'N/A') OR m.text IS NULL THEN 0e0 ELSE 1e0 END AS mask
  FROM split s JOIN known k ON k.text = trim(s.text, {BLANKS}) JOIN known p ON p.text = CASE WHEN found AND s.text <> '' THEN s.text ELSE trim(s.text, {BLANKS}) END LEFT JOIN known m ON m.text = coalesce(minus, '[NONE]')""")
def prepared_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with their sides and vectors: what has no split stands for itself, what has no vector is left out (and never another text's vector)."""
    turns = X.table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 2 == 0, "og").otherwise("changed")
    qid = F.concat(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.lit("-"), kind)
    queries = turns.select(qid.alias("qid"), K.base_qid(qid).alias("base_qid"), kind.alias("query_type"), F.col("text").alias("query"), F.lit("").alias("instruction"), "conv_id")
    dual = queries.where("conv_id % 3 > 0").select("qid", "query_type", F.col("query").alias("q_plus"), F.when(F.col("conv_id") % 3 == 1, K.NONE).otherwise(F.col("query")).alias("q_minus"))
    texts = turns.where("conv_id % 5 <> 0").select("text").distinct().withColumn("embedding", F.array(F.lit(1.0)))
    return engine.with_vectors(engine.sides(queries.drop("conv_id"), dual), texts).select("qid", "query_type", "mask")


@query("SELECT doc_id, true AS iso, true AS near FROM documents")
def stamped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of writing are in their format and not far from now."""
    path = scratch(spark, "stamped")
    reports.write_json(X.table(spark, sf_dir, "documents").select("doc_id"), path)
    rows = spark.read.schema("doc_id long, timestamp string").json(path)
    near = F.abs(F.unix_timestamp(F.to_timestamp("timestamp", reports.STAMP)) - F.unix_timestamp(F.current_timestamp())) < 3600
    return rows.select("doc_id", F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$").alias("iso"), near.alias("near"))


@query("SELECT place, conv_id AS idx, n FROM (SELECT row_number() OVER (ORDER BY conv_id) - 1 AS place, conv_id, count(*) AS n FROM conversations GROUP BY conv_id) WHERE place IN (SELECT label * 3 FROM embeddings)")
def rows_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows by their place in the order of idx, as a data set's items are; three times a label stands for a wanted place."""
    turns = X.table(spark, sf_dir, "conversations")
    lists = turns.groupBy(F.col("conv_id").alias("idx")).agg(F.count("*").alias("n"))
    wanted = X.documents(spark, sf_dir).select((3 * F.col("label")).cast("long").alias("place")).distinct()
    return caches.rows_at(lists, wanted).select("place", "idx", "n")


@query("SELECT string_agg(role || ':' || first || '-' || last, ';' ORDER BY role) AS ranges FROM (SELECT role, min(p) AS first, max(p) AS last FROM (SELECT role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS p FROM conversations) GROUP BY role)")
def index_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One map from each type of text to the range of its places."""
    placed = ranking.numbered(X.table(spark, sf_dir, "conversations").select("role", "conv_id", "turn"), "role", "conv_id", "turn")
    found = caches.index_of(placed, "role")
    entries = F.array_sort(F.map_entries("ranges"))
    text = F.transform(entries, lambda e: F.concat(e.key, F.lit(":"), e.value.first.cast("string"), F.lit("-"), e.value.last.cast("string")))
    return found.select(F.array_join(text, ";").alias("ranges"))


@query("""SELECT CAST(q AS VARCHAR) AS base_qid, t AS query_type, length(coalesce(d.text, '')) AS query_length, d.source AS instruction, CASE WHEN t = 'og' THEN 0e0 ELSE round(tau_q, 6) END AS tau
  FROM taus CROSS JOIN (VALUES ('og'), ('changed')) AS x(t) LEFT JOIN documents d ON d.doc_id = q""", fixture=True)
def analysis_with_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds beside the whole text and instruction of their query, where there is one."""
    texts = X.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("base_qid"), F.col("text").alias("query"), F.col("source").alias("instruction"))
    vectors = _vectors(spark, sf_dir).select("base_qid", "query_type", F.lit(1.0).alias("alpha"), engine.threshold(_Q_PLUS).alias("tau"), F.lit("term").alias("q_minus"))
    rows = reports.parameter_analysis(vectors.join(texts, "base_qid", "left"))
    return rows.select("base_qid", "query_type", F.length(F.coalesce("query", F.lit(""))).cast("long").alias("query_length"), "instruction", F.round("tau", 6).alias("tau"))


@query("SELECT t.name, t.trains, count(*) AS constrained FROM (VALUES ('baseline', ''), ('mlp_only', 'gate'), ('lap_only', 'projection'), ('hybrid', 'projection,gate')) AS t(name, trains) CROSS JOIN dual WHERE mask > 0 GROUP BY ALL", fixture=True)
def trained_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a trainer changes under each setting, and how many queries have a side for it to work on."""
    parts = spark.createDataFrame([(n, ",".join(engine.trained_parts(c))) for n, c in engine.RETRIEVERS.items()], "name string, trains string")
    constrained = X.dual(spark, sf_dir).where("mask > 0").agg(F.count("*").alias("constrained"))
    return constrained.crossJoin(F.broadcast(parts)).select("name", "trains", "constrained")
