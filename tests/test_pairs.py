"""Queries over all pairs: no row for a pair is stored, sorted or shuffled, and odd tables give what the SQL gives."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from veerrank.operators import ranking, tiles
from veerrank.plans import fixture as X
from veerrank.plans import queries as Q

SF = "/root/testdata/sf0.001"
INSIDE = ("composite_best", "metrics_macro", "penalty_pat_hybrid", "penalty_pat_protected", "metrics_og", "metrics_wide", "metrics_changed", "deviation_bands", "inversions", "ranking_losses")
EACH = ("default_thresholds", "method_scores")
HELD = ("penalty_triple", "penalty_double_threshold_cut", "penalty_smart", "returned_scores", "merged_runs")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Whole numbers, so that many scores are equal; a vector of no numbers, missing labels, and a row without an id."""
    folder, random = tmp_path_factory.mktemp("odd"), np.random.default_rng(11)
    x = random.integers(-2, 3, (700, 6)).astype(np.float32)
    x[47] = np.nan
    ids, labels = [int(i * 11 % 700) for i in range(700)], [int(v) for v in random.integers(0, 3, 700)]
    ids[13], labels[5], labels[ids.index(200)], labels[ids.index(301)] = None, None, None, 7
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}), folder / "embeddings.parquet")
    return str(folder)


def _rows(table, columns):
    # A zero has no sign here, and what is no number is missing.
    return sorted((tuple(None if x != x else x + 0.0 if isinstance(x, float) else x for x in r) for r in table[columns].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("part", [1 << 20, 150])
@pytest.mark.parametrize("name", INSIDE)
def test_odd_tables_equal_sql_without_a_row_for_a_pair(spark, monkeypatch, odd, name, part):
    def refused(*args, **kwargs):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(X, "score_all", refused)
    monkeypatch.setattr(tiles, "PART", part)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{odd}/embeddings.parquet'")
    got, want = Q.QUERIES[name](spark, odd).toPandas(), con.sql(Q.ORACLES[name]).df()
    assert len(want) and _rows(got, sorted(want.columns)) == _rows(want, sorted(want.columns))


@pytest.mark.parametrize("name", EACH)
def test_rows_of_pairs_are_never_joined_or_moved(spark, odd, name):
    """Queries whose contract is a row for each pair: what follows the products is a projection of them."""
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{odd}/embeddings.parquet'")
    out = Q.QUERIES[name](spark, odd)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow multiply")]
    assert not any(x in above for x in ("Join", "Repartition", "Window", "Aggregate", "Sort"))
    want = con.sql(Q.ORACLES[name]).df()
    assert len(want) and _rows(out.toPandas(), sorted(want.columns)) == _rows(want, sorted(want.columns))


@pytest.mark.parametrize("name", HELD)
def test_pairs_are_ranked_without_a_sort(spark, odd, name):
    """A task keeps the first rows of each query as pairs come, and odd tables give what the SQL gives."""
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{odd}/embeddings.parquet'")
    out, want = Q.QUERIES[name](spark, odd), con.sql(Q.ORACLES[name]).df()
    plan = out._jdf.queryExecution().executedPlan().toString()
    at = plan.index("MapInArrow multiply")
    assert "collect_top_k" in plan[:at] and "Sort" not in plan[:at] and "Window" not in plan[:at]
    assert len(want) and _rows(out.toPandas(), sorted(want.columns)) == _rows(want, sorted(want.columns))


def test_first_rows_held_are_the_first_rows_sorted(spark):
    """Missing keys, scores and ties, what is no number, zeros of both signs, repeated rows, the ends of whole numbers, and more keys than a task holds."""
    ends = [(None, 1, 2.0, "a"), (None, 2, None, "b"), (1, None, 0.0, "c"), (1, 9, 0.0, "d"), (1, -(1 << 63), -0.0, "e"), (1, (1 << 63) - 1, 0.0, "f"), (1, 4, float("nan"), "g"), (1, 5, float("inf"), "h"), (1, 6, float("-inf"), "i"), (1, 3, None, None), (2, 7, 1.5, "k"), (2, 7, 1.5, "k")]
    many = [(10 + i % 300, i, float(i % 7), str(i)) for i in range(3000)]
    rows = spark.createDataFrame(ends + many, "q long, doc long, score double, note string").repartition(3)
    plain = lambda df: (df.columns, df.dtypes, sorted(map(str, df.collect())))
    for k in (1, 4, 20):
        assert plain(ranking.top_k(rows, "score", k, held=True)) == plain(ranking.top_k(rows, "score", k))
    assert ranking.top_k(rows.where("q < 0"), "score", 3, held=True).isEmpty()


def test_a_task_meets_fewer_queries_than_an_aggregate_holds(spark):
    """Beyond 127 keys Spark's aggregates of objects would sort the pairs of a task."""
    queries = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(700)], "q long, v array<float>").repartition(5)
    docs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "doc long, embedding array<float>")
    held = ranking.score_all(queries, docs, {"s": "v"}).rdd.mapPartitions(lambda rows: [len({r.q for r in rows})]).collect()
    assert 0 < max(held) < 128


def test_documents_are_dealt_by_their_number_where_blocks_of_queries_make_tasks(spark, monkeypatch):
    """Blocks of queries times parts of documents are the tasks: no more parts than keep all cores busy, unless a part would grow with the table."""
    queries = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(700)], "q long, v array<float>")
    docs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1000)], "doc long, embedding array<float>")
    few = ranking.score_all(queries, docs, {"s": "v"})
    assert few.rdd.getNumPartitions() == 6 * -(-4 * spark.sparkContext.defaultParallelism // 6)
    monkeypatch.setattr(ranking, "TASK_DOCUMENTS", 50)
    monkeypatch.setattr(ranking, "DOCUMENT_BLOCK", 25)
    many = ranking.score_all(queries, docs, {"s": "v"})
    assert many.rdd.getNumPartitions() == 6 * 20
    assert many.count() == few.count() == 700_000 and many.exceptAll(few).isEmpty()


@pytest.mark.parametrize("kind,width", [("float", 4), ("double", 8)])
def test_blocks_hold_vectors_as_wide_as_they_come(spark, monkeypatch, kind, width):
    """Scores are the same double products, also of missing numbers, what is no number and missing vectors."""
    some = [(0, [1.0, 0.1]), (1, [None, 2.0]), (2, [float("nan"), 1.0]), (3, None), (None, [0.3, 0.7]), (4, [1e-30, 3.0]), (4, [1e-30, 3.0])]
    docs = spark.createDataFrame(some, f"doc long, embedding array<{kind}>")
    queries = spark.createDataFrame([(7, [0.1, 0.2]), (8, None), (9, [0.5, 1e30])], f"q long, v array<{kind}>")
    met, cross = [], type(docs).crossJoin
    monkeypatch.setattr(type(docs), "crossJoin", lambda self, other: met.extend((self, other)) or cross(self, other))
    out = ranking.score_all(queries, docs, {"s": "v"}).collect()
    assert met[0].agg(F.sum(F.length("v0"))).first()[0] == 6 * 2 * width and met[1].agg(F.sum(F.length("q_v0"))).first()[0] == 2 * 2 * width
    held = np.float32 if kind == "float" else np.float64
    number = lambda v: np.array([np.nan if x is None else x for x in v], held).astype(np.float64)
    want = [(q, d, float(number(e) @ number(v))) for q, v in ((7, [0.1, 0.2]), (9, [0.5, 1e30])) for d, e in some if e]
    assert sorted(map(str, out)) == sorted(f"Row(q={q}, doc={d}, s={s})" for q, d, s in want)


def test_queries_are_made_once(spark):
    """Blocks are counted and made from the same stored rows."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    queries = spark.createDataFrame([(q, [1.0, float(q)] if q else None) for q in range(20)], "q long, v array<float>").mapInArrow(counted, "q long, v array<float>")
    docs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "doc long, embedding array<float>")
    assert ranking.score_all(queries, docs, {"s": "v"}).count() == 19 * 30
    assert made.value == 20


def test_blocks_are_full_however_queries_are_dealt(spark):
    """Tasks grow with documents and full blocks of queries, not with the tasks that queries come in."""
    docs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "doc long, embedding array<float>")
    queries = spark.createDataFrame([(q, [1.0, float(q)], q % 2) for q in range(20)], "q long, v array<float>, kind int")
    out = ranking.score_all(queries.repartition(20), docs, {"s": "v"}, about=("kind",))
    assert out.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert sorted((r.q, r.doc, r.kind, r.s) for r in out.collect()) == [(q, d, q % 2, float(d + q)) for q in range(20) for d in range(30)]
