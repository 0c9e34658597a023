"""Penalties, metrics, sources and sinks: hand-made cases, invariants, and every query against its SQL."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from veerrank.functions import keys as K
from veerrank.functions.penalties import PENALTIES, Streams, penalty
from veerrank.operators import grid, metrics, nearest, ranking, training
from veerrank.plans import queries as Q
from veerrank.sources import readers, sinks
from veerrank.streaming import cache_log

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, SF).toPandas(), con.sql(Q.ORACLES[name]).df()
    spark.catalog.clearCache()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(df):
        return sorted((tuple(None if x != x else x for x in r) for r in df[columns].astype(object).values.tolist()), key=str)

    assert rows(got) == rows(want)


def test_rank_score_signs(spark):
    row = spark.range(1).select(*(K.rank_score(F.lit(a), F.lit(b)).alias(f"c{i}") for i, (a, b) in enumerate(((10, 1), (1, 10), (5, 5))))).first()
    assert row.c0 < 0 < row.c1 and row.c2 == 0


def _streams(spark):
    rows = [(0.5, 0.4, 0.1, 1.0, 1), (0.2, 0.7, -0.1, 1.0, 7), (0.1, 0.3, 0.2, 0.0, 30)]
    return spark.createDataFrame(rows, "sb double, sn double, tau double, mask double, og_rank long")


def test_penalty_invariants(spark):
    df = _streams(spark)
    s = Streams(*(F.col(c) for c in ("sb", "sn", "tau", "mask", "og_rank")))
    out = df.select("sb", "mask", *(PENALTIES[n](s, alpha=0.0).alias(n) for n in PENALTIES if n != "pat_hybrid"), *(PENALTIES[n](s).alias(n + "_1") for n in PENALTIES if n not in ("pat_hybrid", "masked_score"))).collect()
    for r in out:
        for n in PENALTIES:
            if n != "pat_hybrid":
                assert math.isclose(r[n], r.sb, abs_tol=1e-12), n
            if r["mask"] == 0 and n not in ("pat_hybrid", "masked_score"):
                assert math.isclose(r[n + "_1"], r.sb, abs_tol=1e-12), n
    same = df.select((PENALTIES["pat"](s, tau0=0.1, lam=0.0) - PENALTIES["classic"](Streams(s.sb, s.sn, F.lit(0.1), s.mask))).alias("a"), (PENALTIES["pat_protected"](s, factor=1.0) - PENALTIES["pat"](s)).alias("b"), (PENALTIES["pat_hybrid"](s, boost=0.0) - PENALTIES["pat_protected"](s)).alias("c"))
    assert all(abs(x) < 1e-12 for r in same.collect() for x in r)
    with pytest.raises(ValueError):
        penalty("none")


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate((7, 8, 9))] + [(2, 7, 1)], "q long, doc long, rank long")
    rels = spark.createDataFrame([(1, 8, 2), (1, 5, 1)], "q long, doc long, rel int")
    got = {(r.q, r.k): r for r in metrics.per_query(run, rels, (1, 3)).collect()}
    assert got[1, 1].ndcg == 0 and got[1, 3].mrr == 0.5 and got[1, 3].map == 0.25 and got[1, 3].recall == 0.5
    assert math.isclose(got[1, 3].ndcg, (2 / math.log2(3)) / (2 + 1 / math.log2(3)))
    assert got[2, 3].ndcg == 0


def test_missing_document_ranks_behind_the_run(spark):
    og = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "q long, doc long, rank long")
    diff = spark.createDataFrame([(1, 99)], "q long, doc long")
    row = metrics.rank_changes(og, og, diff).first()
    assert (row.og_rank, row.new_rank, row.change) == (3, 3, 0)


def test_sources(spark, tmp_path):
    judged = spark.createDataFrame([("a-og", "d", 1, 0), ("a-og", "d", 3, 1), ("b-og", "d", None, 2)], "qid string, doc_id string, score int, o int")
    assert {(r.qid, r.rel) for r in readers.qrels(judged, F.col("o")).collect()} == {("a-og", 3), ("b-og", 1)}
    lists = spark.createDataFrame([("a-og", ["x", "y"], 0), ("a-changed", ["z"], 1)], ["qid", "results", "o"])
    assert [r.doc_id for r in readers.candidates(lists, F.col("o")).orderBy("pos").collect()] == ["x", "y"]
    texts = spark.createDataFrame([("1-og", "q"), ("1-other", "q")], ["_id", "text"])
    twice = spark.createDataFrame([("1-og", "first", 0), ("1-og", "last", 1)], ["query-id", "instruction", "o"])
    assert [r.instruction for r in readers.queries(texts, twice, F.col("o")).collect()] == ["last"]
    parts = spark.createDataFrame([("z", 1, 0), ("a", 2, 1)], "split string, v int, o int")
    assert readers.split_of(parts, "test", F.col("o")).first().v == 1 and readers.split_of(parts, "a", F.col("o")).first().v == 2
    told = spark.createDataFrame([("1-og", "only old")], ["query-id", "instruction"])
    assert [tuple(r) for r in readers.queries(texts, told).collect()] == [("1-og", "1", "og", "q", "only old")]
    (tmp_path / "d.jsonl").write_text('{"qid": "1", "q_plus": "a"}\nnot json\n{"qid": "1", "q_plus": "b"}\n')
    loose = readers.jsonl(spark, str(tmp_path / "d.jsonl"), readers.DUAL, strict=False)
    assert readers.dual_queries(loose, F.col("q_plus")).select("q_plus", "query_type").collect() == [Row(q_plus="b", query_type="og")]
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "d.jsonl"), readers.DUAL).collect()


def test_run_files_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("1-og", "d1", 1, 0.5), ("1-og", "d2", 2, 0.25)], "qid string, doc_id string, rank long, score double")
    sinks.write_trec(run, str(tmp_path / "run"), "x")
    assert {tuple(r) for r in readers.trec_run(spark, str(tmp_path / "run")).collect()} == {("1-og", "d1", 0.5), ("1-og", "d2", 0.25)}
    assert sinks.markdown(run, ["qid", "score"]).first().value == "| 1-og | 0.5000 |"


def test_resume_equals_one_run(spark, tmp_path):
    points = grid.preset(spark, "fine_grained")
    half = points.where("param_index < 5").withColumn("p_mrr", F.col("alpha"))
    sinks.append_results(half, str(tmp_path / "r"))
    sinks.append_results(grid.remaining(points, spark.read.parquet(str(tmp_path / "r"))).withColumn("p_mrr", F.col("alpha")), str(tmp_path / "r"))
    done = grid.completed(spark.read.parquet(str(tmp_path / "r")))
    assert done.count() == points.count() and grid.best(done, "p_mrr").first().param_index == 12
    with pytest.raises(ValueError):
        grid.preset(spark, "other")


def test_stream_keeps_the_last_value(spark, tmp_path):
    """Each line is drained once; a query that returns to an earlier value has it again."""
    folder = tmp_path / "log"
    folder.mkdir()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for i, value in enumerate("aba"):
        (folder / f"{i}.json").write_text(f'{{"qid": "1", "query_type": "og", "q_plus": "{value}"}}\n' * 2)
        os.utime(folder / f"{i}.json", (1_000_000 + i, 1_000_000 + i))
        cache_log.drain(cache_log.cache_stream(spark, str(folder)), out, mark).awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.count() == 6 and [r.q_plus for r in cache_log.latest(rows).collect()] == ["a"]


def test_ends_are_cleared_of_all_white_space(spark):
    row = spark.range(1).select(K.token_length(F.lit("\tfoo bar\n")).alias("n"), K.query_text(F.lit("q"), F.lit("do it\n\u3000")).alias("q"), K.mask_strict(F.lit("\n none\t")).alias("m"), K.token_length(F.lit("\n")).alias("z")).first()
    assert tuple(row) == (2, "q do it", 0.0, 0)


def test_defaults_of_conditional_penalties(spark):
    """Documents above the default thresholds stay as they are."""
    s = Streams(F.col("sb"), F.col("sn"), F.lit(0.1), F.lit(1.0))
    row = spark.createDataFrame([(0.75, 0.5), (0.65, 0.5), (0.4, 0.25), (0.4, 0.35)], "sb double, sn double").select("sb", PENALTIES["conditional"](s).alias("c"), PENALTIES["triple"](s).alias("t")).collect()
    assert [r.c == r.sb for r in row] == [True, False, False, False] and [r.t == r.sb for r in row] == [True, True, True, False]


def test_blocks_of_queries_score_each_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(50)] + [(99, None, 0)], "doc long, embedding array<float>, label int")
    queries = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(9)] + [(3, [1.0, 3.0]), (20, None)], "q long, v array<float>")
    whole = sorted(map(tuple, ranking.score_all(queries, docs, {"s": "v"}, ("label",)).collect()))
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 2)
    monkeypatch.setattr(ranking, "DOCUMENT_BLOCK", 3)
    assert whole == sorted(map(tuple, ranking.score_all(queries, docs, {"s": "v"}, ("label",)).collect())) and len(whole) == 500
    assert all(r[2] == r[1] % 2 for r in whole)
    few = ranking.first_by_product(queries.where("q <> 3"), docs, ("v",), 3)
    assert few.count() == 24
    assert sorted((r.q, r.doc, r.score, r["rank"]) for r in few.collect()) == sorted(map(tuple, ranking.top_k(ranking.score_all(queries.where("q <> 3"), docs, {"s": "v"}), "s", 3).collect()))


def test_certified_search_skips_and_finds_all(spark, monkeypatch):
    """Clustered vectors with exact copies: the rows of a whole scan from a small share of its products, penalised or not."""
    monkeypatch.setattr(nearest, "ROWS", 16)
    monkeypatch.setattr(nearest, "FIRST", 8)
    random = np.random.default_rng(2)
    centres = random.standard_normal((30, 16))
    points = centres[np.arange(1500) % 30] + random.standard_normal((1500, 16)) * 0.1
    points = [[float(np.float32(x)) for x in v / np.linalg.norm(v)] for v in points]
    points[300:330] = [points[0]] * 30
    docs = spark.createDataFrame([(i, p) for i, p in enumerate(points)] + [(7, points[9]), (None, points[3]), (1600, None), (1601, [float("nan")] * 16)], "doc long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, points[i], points[i + 1], 0.1 * (i % 3), float(i % 2)) for i in range(0, 40)], "q long, a array<float>, b array<float>, tau double, mask double")
    products = []
    found = ranking.first_by_product(queries, docs, ("a",), 12, products=products).collect()
    assert products[0] < 0.4 * 40 * 1502
    x = np.array([*points, points[9], points[3]])
    ids = [*range(1500), 7, None]

    def best(scores, k, skip=None):
        order = sorted((-s, d is None, d or 0) for s, d in zip(scores, ids) if skip is None or d != skip)
        return [(None if none else d, round(-s, 9)) for s, none, d in order[:k]]

    for q in range(40):
        assert [(r.doc, round(r.score, 9)) for r in sorted(found, key=lambda r: r["rank"]) if r.q == q] == best((x * x[q]).sum(1), 12)
    final = ranking.first_by_product(queries, docs, ("a", "b"), 5, ("tau", "mask"), lambda s, e: s[0] - np.maximum(s[1] - e[..., 0], 0) * e[..., 1], others=True).collect()
    for q in range(40):
        scores = (x * x[q]).sum(1) - np.maximum((x * x[q + 1]).sum(1) - 0.1 * (q % 3), 0) * (q % 2)
        assert [round(r.score, 6) for r in sorted(final, key=lambda r: r["rank"]) if r.q == q] == [round(s, 6) for _, s in best(scores, 5, skip=q)]
    assert ranking.first_by_product(queries, docs.limit(0), ("a",), 3).count() == 0 and ranking.first_by_product(queries.limit(0), docs, ("a",), 3).count() == 0


def test_ranks_of_large_groups(spark):
    """A group over many tasks, ties, null keys and one row of its own rank as one sort does."""
    random = np.random.default_rng(6)
    rows = [(0 if i % 3 else (None if i % 2 else i), float(random.integers(0, 9)), i) for i in range(900)]
    table = spark.createDataFrame(rows, "q long, s double, doc long").repartition(7)
    got = {r.doc: r["rank"] for r in ranking.ranked(table, "s").collect()}
    tiles = {r.doc: r.tile for r in ranking.tiles(table.where("q is not null"), "s", 7).collect()}
    for key in {q for q, _, _ in rows}:
        order = sorted((-s, d) for q, s, d in rows if q == key)
        assert [got[d] for _, d in order] == list(range(1, len(order) + 1))
        if key is not None:
            assert [tiles[d] for _, d in order] == [t + 1 for t, part in enumerate(np.array_split(np.arange(len(order)), 7)) for _ in part]
    wide = ranking.ranked(table, "s")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in wide or "_part" in wide


def test_places_run_through_spans(spark):
    rows = [(g, m, n) for g in "ab" for m in range(0, 50, 3) for n in (1, 2)]
    got = ranking.numbered(spark.createDataFrame(rows, "g string, m long, n int").repartition(5), "g", "m", "n", span=4)
    assert sorted((r.g, r.place, r.m, r.n) for r in got.collect()) == [(g, i, m, n) for g in "ab" for i, (m, n) in enumerate((m, n) for k, m, n in rows if k == g)]


def test_training_steps(spark):
    r = np.random.default_rng(3)
    rows = [([float(x) for x in q], [float(x) for x in q[::-1]], [float(x) for x in -q]) for q in r.standard_normal((40, 4))]
    pairs = spark.createDataFrame(rows, "q array<double>, pos array<double>, neg array<double>")
    weight, first = training.projection_step(np.eye(4), pairs)
    for _ in range(4):
        weight, loss = training.projection_step(weight, pairs)
    assert loss < first
    gate = training.gate((np.ones((4, 2)), np.zeros(2), np.ones((2, 2)), np.zeros(2)))
    out = pairs.select(gate("q").alias("g")).select("g.*").collect()
    assert all(0 < x.alpha < 2 and 0.3 < x.tau < 0.7 for x in out)
    even = spark.range(1).select(training.info_nce(F.array(F.lit(1.0), F.lit(1.0))).alias("l")).first().l
    assert math.isclose(even, math.log(2))
    split = training.grouped_split(spark.range(200).withColumn("idx", F.col("id") % 50))
    assert split.groupBy("idx").agg(F.countDistinct("validation").alias("n")).where("n > 1").isEmpty()


def test_scoring_paths_agree(spark):
    docs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "doc long, embedding array<float>")
    queries = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(3)], "q long, v array<float>")
    pairs = docs.select("doc").crossJoin(queries.select("q"))
    a = {tuple(r) for r in ranking.score_candidates(pairs, queries, docs, {"s": "v"}).select("q", "doc", "s").collect()}
    assert a == {tuple(r) for r in ranking.score_all(queries, docs, {"s": "v"}).collect()} and len(a) == 15
