"""Tiles: no row for a pair, several parts as one, equal scores, and the same results as the operators over lists of candidates."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veerrank.functions.penalties import ARRAYS, PENALTIES, Streams
from veerrank.operators import engine, grid, tiles
from veerrank.plans import fixture as X
from veerrank.plans import queries as Q

SF = "/root/testdata/sf0.001"
NO_PAIRS = ("p_mrr", "rank_change", "p_mrr_first", "reciprocal_change", "victims", "distribution_tau", "sweep_classic", "sweep_distribution", "sweep_pat", "engine_run", "gated_run", "engine_metrics", "membership_metrics", "engine_bundle", "tasks_summary", "engine_sweep", "experiment_results", "case_groups", "negative_hits", "saved_run", "interval_means", "victim_report", "lap_only_run", "hybrid_run", "task_tables", "distribution_report", "proportional_report")


@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_query_makes_a_row_for_each_pair(spark, monkeypatch, name):
    def refused(*args, **kwargs):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(X, "score_all", refused)
    Q.QUERIES[name](spark, SF).count()


@pytest.fixture()
def world(spark):
    """Whole numbers, so that many scores are equal; ids that are not in order, and a vector that is missing."""
    random = np.random.default_rng(5)
    x, labels = random.integers(-2, 3, (400, 6)), random.integers(0, 3, 400)
    rows = [(int(i * 7 % 400), [float(v) for v in x[i]] if i != 9 else None, int(labels[i])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc long, embedding array<float>, label long")
    asked = spark.createDataFrame([(q, q, [float(v) for v in random.integers(-2, 3, 6)], [float(v) for v in random.integers(-2, 3, 6)], float(q % 2), 1.0, 0.5, q % 3) for q in (0, 1, 35, 90)], "q long, own long, base array<double>, minus array<double>, mask double, alpha double, tau double, label long")
    return docs, asked, {d: (np.array(v), label) for d, v, label in rows if v is not None}, asked.collect()


#: Binary fractions, so that scores that should be equal are.
POINTS = {"classic": [{"param_index": 0, "alpha": 2.0}, {"param_index": 1, "delta": -0.25}], "pat_hybrid": [{"param_index": 0, "tau0": 0.125, "lam": 0.25}]}


@pytest.mark.parametrize("name", sorted(POINTS))
def test_parts_agree_with_brute_force(spark, world, monkeypatch, name):
    docs, asked, known, queries = world
    whole = {(r.q, r.param_index, r.query_type, r.k): r for r in tiles.measures(asked, docs, X.JUDGE, POINTS[name], (5, 50), name).collect()}
    firsts = {(r.q, r.rank): (r.doc, round(r.score, 9)) for r in tiles.first(asked, docs, 30, name, POINTS[name][-1]).collect()}
    monkeypatch.setattr(tiles, "PART", 90)
    for key, r in ((tuple(r[:4]), r) for r in tiles.measures(asked, docs, X.JUDGE, POINTS[name], (5, 50), name).collect()):
        assert all(a == b or math.isclose(a, b, rel_tol=1e-9) for a, b in zip(r[4:], whole.pop(key)[4:]))
    assert not whole
    assert {(r.q, r.rank): (r.doc, round(r.score, 9)) for r in tiles.first(asked, docs, 30, name, POINTS[name][-1]).collect()} == firsts
    moved = {(r.q, r.param_index): r.change for r in tiles.measures(asked, docs, X.JUDGE, POINTS[name], (5,), name).where("query_type = 'changed'").collect()}
    for q in queries:
        ids = np.array(sorted(d for d in known if d != q.q))
        sb, sn = (np.array([known[d][0] @ np.array(v) for d in ids]) for v in (q.base, q.minus))
        og = np.empty(len(ids), int)
        og[np.lexsort((ids, -sb))] = np.arange(1, len(ids) + 1)
        for p in POINTS[name]:
            tau = q.tau + p.get("delta", 0.0)
            extra = {k: v for k, v in p.items() if k in ("tau0", "lam")}
            score = ARRAYS[name](sb, sn, tau, q["mask"], og, alpha=p.get("alpha", 1.0), **extra)
            new = np.empty(len(ids), int)
            new[np.lexsort((ids, -score))] = np.arange(1, len(ids) + 1)
            at = np.array([known[d][1] == q.label and d % 4 == 0 for d in ids])
            a, b = og[at], new[at]
            assert math.isclose(moved[q.q, p["param_index"]], np.where(a >= b, b / a - 1, 1 - a / b).mean(), abs_tol=1e-9)
        if p is POINTS[name][-1]:
            want = np.lexsort((ids, -score))[:30]
            assert [firsts[q.q, i + 1][0] for i in range(30)] == ids[want].tolist()


def test_facts_add_up():
    random = np.random.default_rng(2)
    s = random.normal(size=(2, 300))
    ids = np.arange(300)
    judge = tiles.Judge(lambda row, ids, labels: ids % 3 == 0, X.grades, X.JUDGE.diff)
    whole, parts = tiles._facts({}, ids, ids, s, judge), tiles.merged([tiles._facts({}, ids[i::4], ids[i::4], s[:, i::4], judge) for i in range(4)])
    assert parts.n == 300 and math.isclose(parts.mean, s[1].mean(), abs_tol=1e-12) and math.isclose(parts.deviation, s[1].std(), abs_tol=1e-12)
    assert (parts.first == np.argsort(-s[0])[: tiles.PROTECTED]).all() and (parts.ids == whole.ids).all() and (parts.values == whole.values).all()


def test_arrays_are_the_same_penalties(spark):
    random = np.random.default_rng(1)
    sb, sn, rank = random.normal(size=40), random.normal(size=40), np.arange(1, 41)
    rows = spark.createDataFrame([(float(a), float(b), int(r)) for a, b, r in zip(sb, sn, rank)], "sb double, sn double, r long")
    for name, f in ARRAYS.items():
        s = Streams(F.col("sb"), F.col("sn"), F.lit(0.1), F.lit(1.0), F.col("r"))
        want = [r.s for r in rows.select(PENALTIES[name](s, alpha=1.5).alias("s")).collect()]
        assert np.allclose(f(sb, sn, 0.1, 1.0, rank, alpha=1.5), want, atol=1e-12)


def test_open_sweep_equals_the_sweep_over_lists(spark):
    """Lists of all documents, judgements and changed judgements as tables give what tiles give without them."""
    rows = X.scored(spark, SF).select("q", "doc", "label", "q_label")
    kinds = F.explode(F.array(F.lit("og"), F.lit("changed"))).alias("query_type")
    name = F.col("q").cast("string").alias("base_qid")
    vectors = X.dual(spark, SF).select(name, kinds, "mask", "orig", F.col("qp").alias("plus"), F.col("qm").alias("minus")).withColumn("qid", F.concat_ws("-", "base_qid", "query_type"))
    documents = X.documents(spark, SF)
    qrels = [X.qrels(rows, c).select(F.concat(F.col("q").cast("string"), F.lit(s)).alias("qid"), F.col("doc").alias("doc_id"), "rel") for c, s in ((False, "-og"), (True, "-changed"))]
    diff = X.qrel_diff(rows).select(name, F.array("doc").alias("doc_ids"))
    points, config = grid.points(spark, alpha=(0.5, 2.0), tau=(0.0, 0.1)), engine.Config(keep=100_000)
    scores = engine.dual_scores(vectors, rows.select(name, F.col("doc").alias("doc_id")), documents.select(F.col("doc").alias("doc_id"), "embedding"), config)
    listed = {r.param_index: r.asDict() for r in engine.sweep(scores, points, qrels[0].unionByName(qrels[1]), diff, config, (5, 10)).collect()}
    found = {r.param_index: r.asDict() for r in engine.open_sweep(X.asked(spark, SF), documents, X.JUDGE, points, config, (5, 10)).collect()}
    assert len(found) == 4 and found.keys() == listed.keys()
    for i, row in found.items():
        assert row.keys() == listed[i].keys() and all(math.isclose(v, listed[i][k], abs_tol=1e-9) for k, v in row.items()), i


def test_scores_of_pairs_are_made_once_and_never_shuffled(spark):
    """Pairs of one file's one row group take many tasks, and no join follows them."""
    out = Q.QUERIES["candidate_scores"](spark, SF)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow multiply")]
    assert "Join" not in above and "Repartition" not in above


def test_tenths_take_no_row_for_a_pair_in_one_part(spark, monkeypatch):
    whole = {(r.q, r.tenth): r["mean"] for r in Q.QUERIES["interval_means"](spark, SF).collect()}
    monkeypatch.setattr(tiles, "PART", 90)
    assert {(r.q, r.tenth): r["mean"] for r in Q.QUERIES["interval_means"](spark, SF).collect()} == whole
