"""Queries of readers, caches and small relational operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from ..functions import keys as K
from ..functions.penalties import PENALTIES, Streams, gated, method
from ..operators import engine, ranking, training
from ..sources import caches, readers
from ..sources.shared import scratch
from . import fixture as X
from .queries import query


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text FROM documents")
def corpus_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their titles."""
    docs = X.table(spark, sf_dir, "documents").withColumn("title", F.col("source"))
    return readers.corpus(docs, with_title=False).select("doc_id", "text")


_TURNS_SQL = "turns AS (SELECT conv_id || CASE turn % 3 WHEN 0 THEN '-og' WHEN 1 THEN '-changed' ELSE '-other' END AS qid, conv_id, turn, role, text FROM conversations)"
_LAST_SQL = f"WITH {_TURNS_SQL}, firsts AS (SELECT qid, max_by(text, turn) AS query FROM turns GROUP BY qid), told AS (SELECT qid, max_by(role, turn) AS instruction FROM turns WHERE conv_id % 2 = 0 GROUP BY qid)"


def _turn_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = X.table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 3 == 0, "-og").when(F.col("turn") % 3 == 1, "-changed").otherwise("-other")
    turns = turns.withColumn("query-id", F.concat(F.col("conv_id").cast("string"), kind))
    texts = turns.groupBy(F.col("query-id").alias("_id")).agg(F.max_by("text", "turn").alias("text"))
    return readers.queries(texts, turns.where("conv_id % 2 = 0").withColumn("instruction", F.col("role")), F.col("turn"))


@query(_LAST_SQL + " SELECT qid, regexp_replace(qid, '-og|-changed', '') AS base_qid, coalesce(query, '') AS query, coalesce(instruction, '') AS instruction, trim(coalesce(query, '') || ' ' || coalesce(instruction, ''), {BLANKS}) AS whole FROM firsts LEFT JOIN told USING (qid) WHERE qid NOT LIKE '%-other'")
def instructed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with the last of their instructions, raw and joined; other suffixes are dropped."""
    return _turn_queries(spark, sf_dir).select("qid", "base_qid", "query", "instruction", K.query_text(F.col("query"), F.col("instruction")).alias("whole"))


@query(_LAST_SQL + ", kinds AS (SELECT CASE WHEN qid LIKE '%-og' THEN 'og' ELSE 'changed' END AS query_type FROM firsts WHERE qid NOT LIKE '%-other') SELECT query_type, count(*) AS n FROM kinds GROUP BY query_type UNION ALL SELECT 'total', count(*) FROM kinds")
def query_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turn_queries(spark, sf_dir)
    return rows.groupBy("query_type").agg(F.count("*").alias("n")).unionByName(rows.agg(F.lit("total").alias("query_type"), F.count("*").alias("n")))


@query("SELECT CAST(q AS VARCHAR) AS base_qid, CAST(p - 1 AS INTEGER) AS pos, CAST(docs[p] AS VARCHAR) AS doc_id FROM (SELECT *, unnest(range(1, len(docs) + 1)) AS p FROM (SELECT user_id AS q, arg_min(list_value(event_id, event_id + 1, event_id + 2), event_id) AS docs FROM events GROUP BY user_id))")
def candidate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first list of each query, exploded with places."""
    ids = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: (F.col("event_id") + i).cast("string"))
    rows = X.table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "-og").otherwise("-changed")).alias("qid"), ids.alias("doc_ids"), "event_id")
    return readers.candidates(rows, F.col("event_id"))


@query("SELECT CAST(conv_id AS VARCHAR) AS base_qid, len(docs) AS n FROM (SELECT conv_id, list(turn) FILTER (WHERE role <> 'user') AS docs FROM conversations GROUP BY conv_id) WHERE len(docs) > 0")
def changed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of changed judgements; empty ones are dropped."""
    lists = X.table(spark, sf_dir, "conversations").groupBy(F.concat(F.col("conv_id").cast("string"), F.lit("-changed")).alias("query_id")).agg(F.collect_list(F.when(F.col("role") != "user", F.col("turn"))).alias("doc_ids"))
    return readers.qrel_diff(lists).select("base_qid", F.size("doc_ids").cast("long").alias("n"))


@query("SELECT source, count(*) AS n FROM documents WHERE source = (SELECT source FROM documents ORDER BY doc_id LIMIT 1) GROUP BY source UNION ALL SELECT source, count(*) FROM documents WHERE source = 'src2' GROUP BY source")
def split_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split that the table lacks gives way to its first; one that it has is taken."""
    docs = X.table(spark, sf_dir, "documents").withColumn("split", F.col("source"))
    parts = [readers.split_of(docs, name, F.col("doc_id")) for name in ("test", "src2")]
    return parts[0].unionByName(parts[1]).groupBy("source").agg(F.count("*").alias("n"))


_LINES_SQL = "WITH lines AS (SELECT event_id, CASE event_id % 10 WHEN 0 THEN '{broken' WHEN 1 THEN '  ' ELSE props END AS line FROM events)"


@query(_LINES_SQL + " SELECT 'bad' AS kind, count(*) AS n, CAST(NULL AS BIGINT) AS k FROM lines WHERE line = '{broken' UNION ALL SELECT 'good', count(*), sum(coalesce(CAST(json_extract_string(line, '$.k') AS BIGINT), 0)) FROM lines WHERE line <> '{broken' AND trim(line) <> ''")
def tolerant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines that parse, and a count of those that do not; blank ones are neither."""
    i = F.col("event_id") % 10
    lines = X.table(spark, sf_dir, "events").select(F.when(i == 0, "{broken").when(i == 1, "  ").otherwise(F.col("props")).alias("line"))
    good, bad = caches.tolerant_lines(lines, F.col("line"), S.StructType([S.StructField("k", S.LongType())]))
    return bad.agg(F.lit("bad").alias("kind"), F.count("*").alias("n"), F.lit(None).cast("long").alias("k")).unionByName(good.agg(F.lit("good").alias("kind"), F.count("*").alias("n"), F.sum(F.coalesce("k", F.lit(0))).alias("k")))


@query("SELECT source AS task, max(doc_id % 7) AS version, 'dual_queries_v' || max(doc_id % 7) || '_' || source || '.jsonl' AS name FROM documents WHERE doc_id % 5 <> 0 GROUP BY source")
def latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of each task's file; other names are left out."""
    docs = X.table(spark, sf_dir, "documents")
    version = F.concat(F.lit("dual_queries_v"), (F.col("doc_id") % 7).cast("string"), F.lit("_"), F.col("source"), F.lit(".jsonl"))
    return caches.latest_files(docs.select(F.when(F.col("doc_id") % 5 == 0, "notes.txt").otherwise(version).alias("name"))).select("task", "version", "name")


_FALLBACK_SQL = "WITH found AS (SELECT c.conv_id, c.turn, c.role AS query_type, c.text AS query, l.quality FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id AND c.role = 'user')"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = X.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("conv_id").cast("string").alias("qid"), F.col("role").alias("query_type"), F.col("text").alias("query"))
    cache = X.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("qid"), F.lit("user").alias("query_type"), F.lit("plus").alias("q_plus"), F.col("quality").cast("string").alias("q_minus"))
    return caches.with_fallback(requests, cache)


@query(_FALLBACK_SQL + " SELECT conv_id, turn, CASE WHEN quality IS NULL THEN query ELSE 'plus' END AS q_plus, coalesce(CAST(quality AS VARCHAR), '[NONE]') AS q_minus, quality IS NOT NULL AS hit FROM found")
def split_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached splits; a request without one keeps its text and has no constraint."""
    return _found(spark, sf_dir).select("conv_id", "turn", "q_plus", "q_minus", "hit")


@query(_FALLBACK_SQL + " SELECT query_type, count(quality) AS hits, count(*) - count(quality) AS misses FROM found GROUP BY query_type")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caches.cache_counts(_found(spark, sf_dir))


@query(_FALLBACK_SQL + " SELECT CAST(conv_id AS VARCHAR) AS qid, query_type, CAST(3 AS INTEGER) AS attempts, 'no split in the cache' AS error, count(*) AS n FROM found WHERE quality IS NULL GROUP BY conv_id, query_type")
def failed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caches.failures(_found(spark, sf_dir), 3).groupBy("qid", "query_type", "attempts", "error").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, round(sum(embedding[1]), 4) AS total, true AS same FROM embeddings")
def resumed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are half cached: only the rest is encoded, and the whole is read back."""
    vectors = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    path = scratch(spark, "vectors")
    caches.write_vectors(vectors.where(F.col("id").cast("long") % 2 == 0), path)
    whole = caches.encode_missing(vectors.select("id", F.lit("").alias("text")), path, lambda left: left.join(vectors, "id"), buckets=4)
    same = caches.same_keys(whole, vectors)
    return whole.agg(F.count("*").alias("n"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 4).alias("total")).withColumn("same", F.lit(same))


_ROLES_SQL = "WITH rows AS (SELECT vec_id // 8 AS idx, vec_id % 8 AS i, embedding[1]::DOUBLE AS x FROM embeddings)"


@query(_ROLES_SQL + " SELECT idx, CAST(count(*) FILTER (WHERE i IN (2, 3)) AS INTEGER) AS n_pos, CAST(least(count(*) FILTER (WHERE i > 3), 3) AS INTEGER) AS n_neg, round(max(CASE WHEN i = 0 THEN x END), 6) AS plus, round(max(CASE WHEN i = 4 THEN x END), 6) AS first_neg FROM rows GROUP BY idx")
def training_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows back from their vectors: sides, positives, and the first negatives in order."""
    i = F.col("vec_id") % 8
    role = F.when(i == 0, "q_plus").when(i == 1, "q_minus").when(i < 4, "pos").otherwise("neg")
    rows = X.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("idx"), role.alias("role"), i.alias("sub_idx"), "embedding")
    lists = caches.training_lists(rows, 3)
    head = [F.round(F.get(c, F.lit(0)).cast("double"), 6) for c in (F.col("q_plus"), F.get("neg", F.lit(0)))]
    return lists.select("idx", F.size("pos").alias("n_pos"), F.size("neg").alias("n_neg"), head[0].alias("plus"), head[1].alias("first_neg"))


@query("""
  WITH lists AS (SELECT conv_id AS idx, list(text ORDER BY turn) FILTER (WHERE role = 'user') AS pos, list(text ORDER BY turn) FILTER (WHERE role <> 'user') AS neg FROM conversations GROUP BY conv_id)
  SELECT idx, 'q_plus' AS role, CAST(0 AS INTEGER) AS sub_idx, 'q' AS text FROM lists UNION ALL SELECT idx, 'q_minus', 0, '[NONE]' FROM lists
  UNION ALL SELECT idx, 'pos', CAST(i - 1 AS INTEGER), pos[i] FROM (SELECT idx, pos, unnest(range(1, len(pos) + 1)) AS i FROM lists) UNION ALL SELECT idx, 'neg', CAST(i - 1 AS INTEGER), neg[i] FROM (SELECT idx, neg, unnest(range(1, len(neg) + 1)) AS i FROM lists)""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of training rows that is to be encoded, with its role and place."""
    user = F.col("role") == "user"

    def side(when) -> F.Column:
        return F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("turn", "text")))), lambda r: r.text)

    lists = X.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("idx")).agg(F.lit("q").alias("q_plus"), F.lit(K.NONE).alias("q_minus"), side(user).alias("pos"), side(~user).alias("neg"))
    return caches.training_rows(lists)


@query("SELECT role AS doc_type, count(*) AS n, CAST(min(i) AS BIGINT) AS first, CAST(max(i) AS BIGINT) AS last FROM (SELECT role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS i FROM conversations) GROUP BY role")
def index_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which places each type of text holds, and how many."""
    placed = ranking.numbered(X.table(spark, sf_dir, "conversations").select("role", "conv_id", "turn"), "role", "conv_id", "turn")
    return placed.groupBy(F.col("role").alias("doc_type")).agg(F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))


@query("SELECT conv_id AS idx, count(*) AS n, min(turn) AS first, max(turn) AS last FROM conversations WHERE conv_id % 10 <> 0 GROUP BY conv_id")
def training_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by key as lists, without the keys set aside for validation."""
    turns = X.table(spark, sf_dir, "conversations")
    aside = turns.where("conv_id % 10 = 0").select(F.col("conv_id").alias("idx")).distinct()
    lists = turns.groupBy(F.col("conv_id").alias("idx")).agg(F.sort_array(F.collect_list("turn")).alias("rows"))
    return lists.join(aside, "idx", "left_anti").select("idx", F.size("rows").cast("long").alias("n"), F.get("rows", F.lit(0)).alias("first"), F.element_at("rows", -1).alias("last"))


@query("SELECT CAST(conv_id AS VARCHAR) || '-og' AS qid, conv_id AS number, row_number() OVER (ORDER BY conv_id) AS place FROM (SELECT DISTINCT conv_id FROM conversations)")
def numeric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries in the order of their number, not of their text."""
    rows = X.table(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("-og")).alias("qid")).distinct()
    placed = rows.select("qid", K.numeric_id(F.col("qid")).alias("number"), F.lit(1).alias("all"))
    return ranking.numbered(placed, "all", "number", "qid").select("qid", "number", (F.col("place") + 1).alias("place"))


@query("SELECT q, doc, rank FROM og WHERE rank <= 1000", fixture=True)
def first_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.first(spark, sf_dir, 1000).select("q", "doc", "rank")


@query("""
  SELECT page_id, CASE WHEN contains(lower(url), 'https') THEN 'repllama' WHEN page_id % 3 = 0 THEN 'mistral' ELSE 'bge' END AS family, CASE WHEN contains(lower(url), 'https') THEN 'RepLLaMA-x' WHEN page_id % 3 = 0 THEN 'e5-Mistral' ELSE 'other' END || '/' || replace(replace(url, '/', '_'), ':', '_') AS folder,
    page_id % 4 = 0 AS known, 'Query: ' || url || chr(10) || 'Instruction: ' || CASE WHEN page_id % 2 = 0 THEN 'do' ELSE '' END AS prompt
  FROM pages""")
def model_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's family and cache folder by its name, known tasks, and the request for a split."""
    i, url = F.col("page_id"), F.col("url")
    model = F.when(F.contains(F.lower(url), F.lit("https")), "org/RepLLaMA-x").when(i % 3 == 0, "org/e5-Mistral").otherwise("org/other")
    task = F.when(i % 4 == 0, engine.TASKS[0]).otherwise("unknown")
    rows = X.table(spark, sf_dir, "pages").withColumns({"model": model, "task": task})
    return rows.select("page_id", K.encoder_family(F.col("model")).alias("family"), K.cache_folder(F.col("model"), url).alias("folder"), engine.valid_task(F.col("task")).alias("known"), K.split_prompt(url, F.when(i % 2 == 0, "do")).alias("prompt"))


@query("SELECT q, doc, round(sb - 2e0 * ln(2e0) * greatest(sn - 0.5e0, 0e0) * mask, 6) AS gate, round(sb * (1e0 - 2e0 * (greatest(sn - sb + 0.1e0, 0e0) + ln(1e0 + exp(-abs(20e0 * (sn - sb + 0.1e0)))) / 20e0) * mask), 6) AS micro, round(sb - greatest(sn - tau_q, 0e0) * mask, 6) AS other FROM scored", fixture=True)
def method_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw gate (softplus strength, sigmoid threshold), and the plain scorer's methods; unknown ones are classic."""
    s = Streams(F.col("sb"), F.col("sn"), F.col("tau_q"), F.col("mask"))
    raw = F.log(F.lit(3.0))  # its softplus is twice the logarithm of two
    return X.scored(spark, sf_dir).select("q", "doc", F.round(gated(s, raw, F.lit(0.0)), 6).alias("gate"), F.round(method("micro")(s), 6).alias("micro"), F.round(method("any")(s), 6).alias("other"))


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 0e0 ELSE 1.5e0 END AS alpha FROM embeddings")
def empty_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A negative side without a vector has no strength."""
    zero = F.transform("embedding", lambda x: x * 0)
    return X.table(spark, sf_dir, "embeddings").select("vec_id", K.empty_gate(F.when(F.col("vec_id") % 5 == 0, zero).otherwise(F.col("embedding")), F.lit(1.5)).alias("alpha"))


@query("SELECT doc_id, list_sum(v) AS total, CAST(len(v) AS INTEGER) AS n, CAST(coalesce(list_position(v, 2e0), 0) AS BIGINT) AS place, len(v[2:3]) AS two FROM (SELECT doc_id, [CAST(doc_id % 3 AS DOUBLE), 2e0, 0.5e0] AS v FROM documents)")
def number_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a text; what is none is left out; parts and places of arrays."""
    text = F.concat((F.col("doc_id") % 3).cast("string"), F.lit(", 2.0,x,,0.5"))
    rows = X.table(spark, sf_dir, "documents").select("doc_id", K.number_list(text).alias("v"))
    return rows.select("doc_id", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"), F.size("v").alias("n"), F.array_position("v", 2.0).alias("place"), F.size(F.slice("v", 2, 2)).cast("long").alias("two"))


@query("SELECT d.doc_id, coalesce(m.n, 0) AS n FROM documents d LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE source < 'src5' GROUP BY source) m USING (source)")
def map_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups with a default: a table of few entries is joined, whatever its size."""
    docs = X.table(spark, sf_dir, "documents")
    sizes = docs.where("source < 'src5'").groupBy("source").agg(F.count("*").alias("n"))
    return docs.join(sizes, "source", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT d.doc_id, coalesce(l.quality, 0) AS quality, left(coalesce(d.text, ''), 150) AS snippet FROM labels l LEFT JOIN documents d USING (doc_id)")
def texts_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with their texts, empty where the corpus lacks them."""
    texts = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    return X.table(spark, sf_dir, "labels").join(texts, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.substring(F.coalesce("text", F.lit("")), 1, 150).alias("snippet"))


@query("SELECT count(*) AS n, sum(CASE WHEN doc_id % 4 IN (2, 3) THEN 1 ELSE 0 END) AS valid, count(DISTINCT source) AS sources FROM documents")
def valid_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many queries have a negative side."""
    i = F.col("doc_id") % 4
    minus = F.when(i == 0, K.NONE).when(i == 1, " ").otherwise(F.col("source"))
    return X.table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.sum(K.mask_strict(minus)).cast("long").alias("valid"), F.countDistinct("source").alias("sources"))


@query("grid AS (SELECT alpha, tau, count(q) AS reached FROM (VALUES (0.8e0), (1e0), (1.2e0)) AS a(alpha) CROSS JOIN (VALUES (0.45e0), (0.5e0), (0.55e0)) AS t(tau) LEFT JOIN taus ON 5 * abs(tau_q) > tau GROUP BY alpha, tau) SELECT alpha, tau, reached, row_number() OVER (ORDER BY reached DESC, tau DESC, alpha) AS place FROM grid", fixture=True)
def ordered_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid's table by how many queries reach a point, then in another order than its own; the grid is a handful of rows."""
    from ..operators import grid

    queries = X.with_tau(X.dual(spark, sf_dir)).select("q", "tau_q")
    rows = queries.join(F.broadcast(grid.preset(spark)), 5 * F.abs("tau_q") > F.col("tau"), "right").groupBy("alpha", "tau").agg(F.count("q").alias("reached"))
    order = F.row_number().over(Window.orderBy(F.desc("reached"), F.desc("tau"), "alpha"))
    return rows.withColumn("place", order.cast("long"))


@query("SELECT q, round(avg(greatest(0e0, 0.1e0 + sn)), 6) AS push, count(*) AS n FROM (SELECT q, sn, row_number() OVER (PARTITION BY q ORDER BY sn DESC, doc) AS i, count(*) OVER (PARTITION BY q) AS c FROM scored WHERE label = q_label) WHERE i <= greatest(1, floor(c * 0.3e0)) GROUP BY q", fixture=True)
def hard_mining_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean hinge of the hardest three tenths of each query's relevant documents."""
    rows = X.scored(spark, sf_dir).where("label = q_label")
    hard = training.hard_examples(rows, ("q",), "sn", 0.3, True, "doc")
    return hard.groupBy("q").agg(F.round(F.avg(F.greatest(F.lit(0.0), 0.1 + F.col("sn"))), 6).alias("push"), F.count("*").alias("n"))


_SOFT50 = "(greatest(sn - tau_q, 0e0) + ln(1e0 + exp(-abs(50e0 * (sn - tau_q)))) / 50e0)"


@query(f"SELECT q, doc, round(sb - CASE WHEN sb < 0.7e0 THEN {_SOFT50} ELSE 0e0 END * mask, 6) AS conditional, round(sb - (1e0 - 1e0 / (1e0 + exp(-10e0 * (sb - 0.7e0)))) * {_SOFT50} * mask, 6) AS gradual, round(sb - 1e0 / (1e0 + exp(-10e0 * (sn - sb + 0.1e0))) / (1e0 + exp(-10e0 * (0.5e0 - sb))) * {_SOFT50} * mask, 6) AS selective, round(sb - CASE WHEN sb < 0.5e0 AND sn > 0.3e0 AND sn > tau_q THEN {_SOFT50} ELSE 0e0 END * mask, 6) AS triple FROM scored", fixture=True)
def default_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional penalties with their own defaults."""
    s = Streams(F.col("sb"), F.col("sn"), F.col("tau_q"), F.col("mask"))
    return X.scored(spark, sf_dir).select("q", "doc", *(F.round(PENALTIES[n](s), 6).alias(n) for n in ("conditional", "gradual", "selective", "triple")))


@query("SELECT count(*) AS n, count(DISTINCT qid) AS queries FROM (SELECT conv_id AS qid, text FROM conversations WHERE role = 'user')")
def logged_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended to a log of JSON lines and read back with their fixed schema."""
    path = scratch(spark, "log")
    turns = X.table(spark, sf_dir, "conversations").where("role = 'user'")
    records = turns.select(F.lit("t").alias("task_name"), F.col("conv_id").cast("string").alias("qid"), F.col("turn").alias("idx"), F.col("text").alias("query"), F.lit("").alias("instruction"), F.lit("og").alias("query_type"), F.col("text").alias("q_plus"), F.lit(K.NONE).alias("q_minus"))
    caches.append_split_queries(records, path)
    return readers.jsonl(spark, path, readers.DUAL).agg(F.count("created_at").alias("n"), F.countDistinct("qid").alias("queries"))
