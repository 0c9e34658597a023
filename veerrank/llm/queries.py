"""The operators' queries over the whole tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hamerly, hard_negatives, knn_quality, mixing, quality_rules, secret_scan, simhash, substrings, token_counts, token_files, warc, word_pitman_yor

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), factor=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_pitman_yor.score(table(spark, sf_dir, "documents"), folds=10)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return rows.select("doc_id", "n_words", "n_hit", (F.size("item_ids") + F.col("unnamed").cast("int")).cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), TOKENIZER, limit=512)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), length=50, with_text=False)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)
    return token_files.read_token_files(spark, path)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=2, shingle=3)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label_col="quality")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archived(table(spark, sf_dir, "pages"), least=1000)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "place")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), every=50, positives=5, negatives=3, least=50, most=95, scale=256)


def op13_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed=3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mix_sources, op2_lm_score, op3_decontaminate, op4_quality_rules, op5_token_counts, op6_substring_dedup, op7_token_files, op8_secret_scan, op9_simhash, op10_quality_classifier, op11_warc, op12_hard_negatives, op13_cluster)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": DECONTAMINATE, "op4_quality_rules": QUALITY, "op6_substring_dedup": SUBSTRINGS, "op11_warc": WARC, "op12_hard_negatives": NEGATIVES, "op13_cluster": _clusters()}


#: Windows of ten words as text, found by their exact text; hit words are counted once.
DECONTAMINATE = r"""
WITH split_docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
split_items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM split_items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM split_docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, grams.n, i FROM grams JOIN windows ON grams.g = windows.g AND grams.n = windows.n),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items_hit AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split_docs d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""

#: Windows of fifty words as text; a window's smallest document decides for all the others.
SUBSTRINGS = r"""
WITH split_docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split_docs WHERE len(w) >= 50)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM grams) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM split_docs),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM words LEFT JOIN gone USING (doc_id, p) WHERE gone.doc_id IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split_docs d LEFT JOIN kept USING (doc_id)
"""

#: Counts by text functions; the sketches as counts by logarithmic bucket, merged by group, language and all, their quantiles shrunk upwards.
QUALITY = r"""
WITH split_docs AS (
  SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (SELECT row, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM split_docs WHERE len(w) >= 5)),
twice AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM grams) WHERE c > 1) GROUP BY row),
base AS (
  SELECT d.row, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(t.n, 0) AS n_repeat_words
  FROM split_docs d LEFT JOIN twice t USING (row)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
parts AS (
  SELECT lang, source, unnest([{'m': 'symbols', 'v': n_symbols / greatest(word_chars, 1)}, {'m': 'lines', 'v': n_dup_lines / greatest(n_lines, 1)}, {'m': 'repeats', 'v': n_repeat_words / greatest(n_words, 1)}, {'m': 'length', 'v': word_chars / greatest(n_words, 1)}], recursive := true)
  FROM failed WHERE NOT base_failed),
counts AS (SELECT lang, source, m, CASE WHEN v > 0 THEN CAST(ceil(ln(v) / ln(1.02e0)) AS BIGINT) END AS b, count(*) AS n FROM parts GROUP BY ALL),
levels AS (
  SELECT 'o' AS level, * FROM counts UNION ALL SELECT 'l', lang, NULL, m, b, sum(n) FROM counts GROUP BY lang, m, b UNION ALL SELECT 'w', NULL, NULL, m, b, sum(n) FROM counts GROUP BY m, b),
upto AS (
  SELECT *, CASE WHEN b IS NULL THEN 0e0 ELSE 2 * pow(1.02e0, b) / 2.02e0 END AS v, sum(n) OVER (PARTITION BY level, lang, source, m ORDER BY b NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY level, lang, source, m) AS total, sum(CASE WHEN b IS NULL THEN n ELSE 0 END) OVER (PARTITION BY level, lang, source, m) AS zeros
  FROM levels),
found AS (
  SELECT level, lang, source, m, min(CASE WHEN upto >= ceil(total * 0.25e0) THEN v END) AS q1, min(CASE WHEN upto >= ceil(total * 0.75e0) THEN v END) AS q3,
    coalesce(min(CASE WHEN b IS NOT NULL AND upto - zeros >= ceil((total - zeros) * 0.95e0) THEN v END), 0) AS upper, CAST(max(total) AS DOUBLE) AS total, CAST(max(total - zeros) AS DOUBLE) AS above
  FROM upto GROUP BY level, lang, source, m),
shrunk AS (
  SELECT o.lang, o.source, o.m,
    (o.total * o.q1 + 20 * (l.total * l.q1 + 20 * w.q1) / (l.total + 20)) / (o.total + 20) AS q1,
    (o.total * o.q3 + 20 * (l.total * l.q3 + 20 * w.q3) / (l.total + 20)) / (o.total + 20) AS q3,
    (o.above + 20 * (l.above + 20 * w.above / w.total) / (l.total + 20)) / (o.total + 20) AS often,
    (o.above * o.upper + 20 * (l.above * l.upper + 20 * w.upper) / (l.above + 20)) / (o.above + 20) AS upper
  FROM (SELECT * FROM found WHERE level = 'o') o JOIN (SELECT * FROM found WHERE level = 'l') l ON o.lang IS NOT DISTINCT FROM l.lang AND o.m = l.m JOIN (SELECT * FROM found WHERE level = 'w') w ON o.m = w.m),
fences AS (SELECT lang, source, m, q1 - 3 * (q3 - q1) AS low, greatest(q3 + 3 * (q3 - q1), upper * (often + 3 * sqrt(greatest(often * (1 - often), 0)))) AS high FROM shrunk),
wide AS (
  SELECT lang, source, max(CASE WHEN m = 'symbols' THEN high END) AS symbols, max(CASE WHEN m = 'lines' THEN high END) AS lines, max(CASE WHEN m = 'repeats' THEN high END) AS repeats, max(CASE WHEN m = 'length' THEN high END) AS most, max(CASE WHEN m = 'length' THEN low END) AS least
  FROM fences GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(greatest(n_symbols - 1, 0) / greatest(word_chars, 1) <= symbols AND greatest(n_dup_lines - 1, 0) / greatest(n_lines, 1) <= f.lines AND greatest(n_repeat_words - 10, 0) / greatest(n_words, 1) <= repeats AND word_chars / greatest(n_words, 1) BETWEEN least AND most, false) AS kept
FROM failed d LEFT JOIN wide f ON d.lang IS NOT DISTINCT FROM f.lang AND d.source IS NOT DISTINCT FROM f.source
"""

#: Digests of the payloads, the largest page of each, and the place in the order of URL key, date and id.
WARC = r"""
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS payload, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '#.*$', '', 's') AS rest FROM pages),
parts AS (SELECT *, regexp_extract(rest, '^([^/?]*)', 1) AS site FROM rows),
hosts AS (
  SELECT *, substr(rest, length(site) + 1) AS path, regexp_replace(lower(regexp_replace(regexp_replace(site, '^.*@', ''), ':(80|443)$', '')), '^www\d*\.', '') AS host FROM parts),
captures AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest, 1577836800 + coalesce(((page_id % 1000000000) + 1000000000) % 1000000000, 0) AS date,
    coalesce(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path LIKE '/%' THEN path ELSE '/' || path END, '') AS url_key
  FROM hosts),
tops AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM captures),
kinds AS (SELECT *, top IS NOT NULL AND page_id IS DISTINCT FROM top AS revisit FROM tops)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN top END AS refers_to, url_key,
  row_number() OVER (ORDER BY encode(url_key), date, page_id NULLS LAST) - 1 AS place
FROM kinds
"""

#: All products of anchors and rows, ranked twice.
NEGATIVES = r"""
WITH rows AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id AS id, CAST(coalesce(list_sum(list_transform(list_zip(a.x, b.x, true), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
positives AS (SELECT a, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) AS place FROM scores WHERE alike QUALIFY place <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.a, place ORDER BY score DESC, id NULLS LAST) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON p.a = s.a AND NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""


def _clusters(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """Rounds of assignment and floored means, one after the other, over all pairs of vector and centroid."""
    apart = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS j, x AS c FROM v WHERE vec_id IS NOT NULL QUALIFY j < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT row, min(struct_pack(d := {apart}, j := j)) AS best FROM v, c{r} GROUP BY row)")
        parts.append(f"""s{r} AS (SELECT best.j AS j, i, sum(x[i]) AS s, count(*) AS n FROM a{r} JOIN v USING (row), range(1, {dim + 1}) AS t(i) GROUP BY best.j, i),
c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{r} GROUP BY j) USING (j))""")
    parts.pop()
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(best.j AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (row) JOIN c{rounds} ON j = best.j"""
