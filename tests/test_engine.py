"""The engine from files to reports, caches, trainers: hand-made cases and invariants."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veerrank import __main__ as cli
from veerrank.functions.vectors import dot
from veerrank.operators import cases, encoders, engine, experiments, grid, losses, training
from veerrank.sources import caches, readers, reports, requests, sinks
from veerrank.streaming import cache_log

DUAL = [
    {"qid": "1", "query_type": "og", "q_plus": "apples", "q_minus": "[NONE]", "created_at": "1"},
    {"qid": "1", "query_type": "changed", "q_plus": "old", "q_minus": "old", "created_at": "1"},
    {"qid": "1", "query_type": "changed", "q_plus": "apples", "q_minus": "pears", "created_at": "2"},
]


@pytest.fixture()
def tables(spark, tmp_path):
    """Two queries: the first has a split with a constraint, the second none at all."""
    folder = tmp_path / "tables"

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(folder / name))

    write("queries", [("1-og", "find fruit"), ("1-changed", "find fruit"), ("2-og", "cars"), ("2-changed", "cars"), ("3-none", "x")], "_id string, text string")
    write("instructions", [("1-changed", "no pears")], ["query-id", "instruction"])
    write("top_ranked", [("1-og", ["a", "p", "missing"]), ("2-og", ["a", "c"])], "`query-id` string, `corpus-ids` array<string>")
    write("qrels", [("1-og", "p", 2), ("1-og", "a", 1), ("1-changed", "a", 1), ("2-og", "c", 1), ("2-changed", "c", 1)], "`query-id` string, `corpus-id` string, score int")
    write("qrel_diff", [("1-og", ["p"]), ("2-og", [])], "`query-id` string, `corpus-ids` array<string>")
    write("corpus_vectors", [("a", [0.8, 0.6]), ("p", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, embedding array<float>")
    write("query_vectors", [("find fruit", [1.0, 0.0]), ("find fruit no pears", [1.0, 0.0]), ("apples", [1.0, 0.0]), ("pears", [1.0, 0.0]), ("cars", [0.0, 1.0])], "text string, embedding array<float>")
    (folder / "split_queries").mkdir()
    for version in (4, 5):
        lines = DUAL if version == 5 else [DUAL[0] | {"q_plus": "wrong"}]
        (folder / "split_queries" / f"dual_queries_v{version}_{engine.TASKS[0]}.jsonl").write_text("\n".join([*map(json.dumps, lines), "", "broken"]))
    return str(folder)


def test_evaluation_from_files(spark, tables, tmp_path):
    args = cli.parser().parse_args(["evaluate", "--tables", tables, "--out", str(tmp_path / "out"), "--alpha", "2"])
    row = cli.evaluate(spark, args).first()
    # Without a penalty p leads a for both; with it p falls behind a for the changed query: rank 1 to 2.
    assert row.p_mrr == 0.5 and row.n_queries == 1 and row.og_ndcg_5 == 1.0 and row.changed_ndcg_5 == 1.0
    runs = {(r.qid, r.doc_id): r.score for k in ("og", "changed") for r in readers.trec_run(spark, str(tmp_path / "out" / f"run_{k}")).collect()}
    assert runs["1-og", "p"] == 1.0 and runs["1-changed", "p"] == 0.0 and ("1-og", "missing") not in runs and runs["2-changed", "c"] == 1.0
    report = spark.read.json(str(tmp_path / "out" / f"results_{engine.TASKS[0]}")).first()
    assert report.metrics.p_mrr == 0.5 and report.task == engine.TASKS[0] and report.timestamp
    analysis = {(r.base_qid, r.query_type): (r.alpha, r.is_none) for r in spark.read.json(str(tmp_path / "out" / "alpha_tau_analysis")).collect()}
    assert analysis == {("1", "og"): (0.0, False), ("1", "changed"): (2.0, False), ("2", "og"): (0.0, False), ("2", "changed"): (2.0, True)}
    text = [r.value for r in spark.read.text(str(tmp_path / "out" / "report")).collect()]
    assert text[0] == "# Results" and text[-1] == "**Average p-MRR**: 0.5000" and f"| {engine.TASKS[0]} | 0.5000 | 1.0000 | 1.0000 |" in text


def test_sweeps_resume(spark, tables, tmp_path):
    out = str(tmp_path / "out")
    first = cli.sweep(spark, cli.parser().parse_args(["sweep", "--tables", tables, "--out", out, "--points", "0,0.5;bad;2,0.5"]))
    assert {(r.param_index, r.alpha, r.p_mrr) for r in first.collect()} == {(0, 0.0, 0.0), (2, 2.0, 0.5)}
    again = cli.sweep(spark, cli.parser().parse_args(["sweep", "--tables", tables, "--out", out, "--points", "0,0.5;1,0.5;2,0.5"]))
    rows = spark.read.parquet(f"{out}/results")
    assert again.count() == 3 and rows.count() == 3 and engine.best(done := grid.completed(rows)).first().param_index == 1  # the first of equals
    lines = spark.read.option("header", True).csv(f"{out}/all_params_summary").collect()
    assert len(lines) == 3 and len(lines[0]) == 19 and engine.progress(grid.preset(spark), done).first() == (3, 9)


def test_isolation_and_bases(spark, tables):
    loaded = cli.load(spark, tables, engine.TASKS[0])
    free = engine.Config(alpha=2.0, isolate_og=False, base="original")
    scores = engine.dual_scores(loaded["vectors"], loaded["candidates"], loaded["documents"], free)
    got = {(r.qid, r.doc): r.score for r in engine.final_scores(scores, free).collect()}
    assert got["1-og", "p"] == 1.0 and got["1-changed", "p"] == 0.0  # an original query has no mask either way
    gates = spark.createDataFrame([("1-changed", 0.5, 0.9)], "qid string, alpha double, tau double")
    gated = engine.dual_scores(loaded["vectors"], loaded["candidates"], loaded["documents"], engine.retriever("mlp_only"), gates)
    assert {(r.qid, r.alpha, r.tau) for r in gated.where("doc = 'p' or doc = 'c'").collect()} == {("1-og", 1.0, 0.5), ("1-changed", 0.5, 0.9), ("2-og", 1.0, 0.5), ("2-changed", 1.0, 0.5)}
    for bad in ({"base": "x"}, {"tau": "x"}, {"penalty": "x"}):
        with pytest.raises(ValueError):
            engine.final_scores(engine.dual_scores(loaded["vectors"], loaded["candidates"], loaded["documents"], engine.Config(**bad)), engine.Config(**bad)).collect()
    with pytest.raises(ValueError):
        engine.retriever("none")
    assert engine.trained_parts(engine.RETRIEVERS["hybrid"]) == ("projection", "gate")


def test_grids_are_sampled_in_a_fixed_order(spark):
    whole = grid.preset(spark, "repllama_25")
    a, b = (grid.sampled(whole, 15, 7).collect() for _ in range(2))
    assert a == b and len(set(a)) == 15 and {(r.alpha, r.tau) for r in a} < {(r.alpha, r.tau) for r in whole.collect()}
    assert a != grid.sampled(whole, 15, 8).collect()


def test_caches(spark, tmp_path):
    texts = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, text string")
    encoded = []

    def encode(left):
        encoded.append(sorted(r.id for r in left.collect()))
        return left.select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))

    path = str(tmp_path / "vectors")
    assert caches.read_vectors(spark, path) is None
    caches.write_vectors(encode(texts.limit(1)), path)
    assert caches.encode_missing(texts, path, encode).count() == 3 and caches.encode_missing(texts, path, encode).count() == 3
    assert encoded == [["a"], ["b"], ["c"]] and caches.read_vectors(spark, path, texts.where("id <> 'a'")) is None
    with pytest.raises(ValueError):
        caches.encode_missing(texts.limit(1), path, encode)
    assert caches.read_or_empty(spark, str(tmp_path / "none"), "a long").count() == 0
    assert caches.load_split_queries(spark, str(tmp_path / "none"), "t").count() == 0
    assert caches.baseline_of(spark, str(tmp_path / "none.json")) == {"p_mrr": 0.0, "map": 0.0, "ndcg": 0.0}
    (tmp_path / "base.json").write_text('{"p_mrr": 0.2, "map": 0.1}')
    assert caches.baseline_of(spark, str(tmp_path / "base.json")) == {"p_mrr": 0.2, "map": 0.1, "ndcg": 0.0}
    for i, m in enumerate((0.1, 0.4, 0.3)):
        (tmp_path / f"trial_{i}").mkdir()
        (tmp_path / f"trial_{i}" / "metrics.json").write_text(json.dumps({"map": m}, indent=1))
    assert "trial_1" in caches.best_trial(spark, str(tmp_path / "trial_*" / "metrics.json")).first().file
    version = str(tmp_path / "version")
    assert caches.version_of(spark, version) == {"version": "1.0", "created_at": None, "updated_at": None}
    caches.note_version(spark, version, "2.0")
    first = caches.version_of(spark, version)
    caches.note_version(spark, version, "3.0")
    last = caches.version_of(spark, version)
    assert last["version"] == "3.0" and last["created_at"] == first["created_at"] < last["updated_at"]
    caches.write_weights(spark, {"w": [[1.0]]}, str(tmp_path / "weights"), 0.5)
    caches.write_weights(spark, {"w": [[2.0]]}, str(tmp_path / "weights"), 0.3)
    caches.write_weights(spark, {"w": [[3.0]]}, str(tmp_path / "weights"), 0.4)
    assert caches.read_weights(spark, str(tmp_path / "weights")) == {"w": [[2.0]]}


def test_reports_keep_odd_names(spark, tmp_path):
    run = spark.createDataFrame([("1-og", "d1", 1, 0.5)], "qid string, doc_id string, rank long, score double")
    sinks.write_trec(run, str(tmp_path / "run"), "50%s")
    assert spark.read.text(str(tmp_path / "run")).first().value == "1-og Q0 d1 1 0.500000 50%s"
    odd = spark.createDataFrame([("é \"x\"", None)], "a string, b int")
    assert reports.json_lines(odd).first().value == '{"a":"é \\"x\\"","b":null}'
    assert reports.summary_report(spark.createDataFrame([], "task string, p_mrr double")).first().average_p_mrr == 0.0


def training_tables(spark, dim=6, n=60):
    r = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    q, pos, neg = (unit(r.standard_normal((n, dim))) for _ in range(3))
    pairs = [(i, q[i].tolist(), unit(q[i] + 0.3 * pos[i]).tolist(), neg[i].tolist()) for i in range(n)]
    rows = [(i, q[i].tolist(), 0.5, [0.4 + 0.4 * float(v) for v in r.random(5)]) for i in range(n)]
    return spark.createDataFrame(pairs, "idx long, q array<double>, pos array<double>, neg array<double>").repartition(3), spark.createDataFrame(rows, "idx long, q_minus array<double>, pos double, neg array<double>").repartition(3)


def test_trainers_lower_their_losses(spark):
    dim = 6
    pairs, rows = training_tables(spark, dim)
    recipe = training.Recipe(epochs=3, size=24, contrast_size=8, rate=0.02, held_out=20)
    for mode, parts in training.MODES.items():
        weight, gate, history = training.train(mode, pairs, lambda w: rows, dim, recipe=recipe)
        assert set(history) == set(parts) and (gate is not None) == ("gate" in parts)
        assert all(len(h) == 3 and h[-1]["train_loss"] < h[0]["train_loss"] and h[-1]["val_loss"] < h[0]["val_loss"] + 0.05 for h in history.values()), history
        assert all({"val_accuracy", "val_alpha_mean", "val_tau_std", "val_penalty_neg"} <= set(e) for e in history.get("gate", []))
        assert (weight != np.eye(dim)).any() == ("projection" in parts)
    with pytest.raises(ValueError):
        training.train("none", pairs, lambda w: rows, dim)
    # The analytic gradient against differences, with and without the regulariser.
    start = training.new_gate(dim, 3, 1)
    for regular in (0.0, 0.3):
        found, loss = training.gate_gradient(start, rows, regular=regular)
        for k, at in ((0, (2, 1)), (1, (0,)), (2, (1, 0)), (3, (1,))):
            moved = [w.copy() for w in start]
            moved[k][at] += 1e-5
            assert abs((training.gate_gradient(tuple(moved), rows, regular=regular)[1] - loss) / 1e-5 - found[k][at]) < 1e-3
    losses_seen = iter([3.0, 2.0, 2.5, 2.6, 2.7, 0.1])
    best, history = training.fit(lambda w: (w + 1, next(losses_seen)), 0, 10, patience=2)
    assert (best, history) == (1, [3.0, 2.0, 2.5, 2.6])
    assert training.gate_bounds("mistral") == (1.5, 0.4, 0.8) and training.gate_bounds("other") == training.gate_bounds("bge")


def test_contrastive_loss_and_gradient(spark):
    """Brute force over batches with their anchors, the table's loss, and the gradient against differences."""
    dim = 5
    pairs, _ = training_tables(spark, dim, 40)
    dealt = losses.anchors(pairs.withColumn("row", F.col("idx")), dim, 7, 3).withColumn("batch", F.col("idx") % 6).drop("row").cache()
    weight = np.random.default_rng(1).standard_normal((dim, dim))
    found, loss = training.contrast_gradient(weight, dealt, 3)
    by_hand = []
    for b in range(6):
        rows = dealt.where(F.col("batch") == b).orderBy("idx").collect()
        q, pos, neg = (np.array([r[c] for r in rows]) for c in ("q", "pos", "neg"))
        anchors = np.array([r.anchors for r in rows])
        u = q @ weight.T
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        gram = u @ u.T
        by_hand.append(1.4 * np.mean([max(u[i] @ pos[i] - 0.05, 0) for i in range(len(q))]) + 0.6 * np.mean([max(0.3 - u[i] @ neg[i], 0) for i in range(len(q))]) + 0.01 * np.mean((gram - np.eye(len(q))) ** 2) + 0.1 * np.mean([(u[i] @ a) ** 2 for i in range(len(q)) for a in anchors[i]]))
    assert abs(loss - np.mean(by_hand)) < 1e-12
    table = losses.contrast(dealt.withColumn("row", F.col("idx")).withColumn("q", F.col("q"))).agg(F.avg("total")).first()[0]
    assert abs(training.contrast_gradient(np.eye(dim), dealt, 3)[1] - table) < 1e-9
    for at in ((0, 0), (2, 3), (4, 1)):
        moved = weight.copy()
        moved[at] += 1e-6
        assert abs((training.contrast_gradient(moved, dealt, 3)[1] - loss) / 1e-6 - found[at]) < 1e-4
    dealt.unpersist()


def test_steps_and_resume(spark, tmp_path):
    """AdamW by hand; an interrupted run that goes on from its saved state ends where an unbroken one does; early stopping goes by held-out loss."""
    w, g = np.array([1.0, -2.0]), [np.array([0.5, 0.1]), np.array([-0.3, 0.2])]
    optimiser, m, v, want = training.AdamW(rate=0.1, decay=0.01), np.zeros(2), np.zeros(2), w.copy()
    got = [w.copy()]
    for t, x in enumerate(g, 1):
        got = optimiser.step(got, [x])
        m, v = 0.9 * m + 0.1 * x, 0.999 * v + 0.001 * x * x
        want = want - 0.1 * 0.01 * want - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(got[0], want, atol=1e-12)
    _, rows = training_tables(spark)
    recipe = training.Recipe(epochs=4, size=20, rate=0.01)
    whole = training.train_gate(rows, 6, recipe)
    path, saved = str(tmp_path / "states"), []

    def save(state):
        caches.write_state(spark, "gate", state.epoch, state.packed(), path)
        saved.append(state.epoch)
        if saved == [1, 2]:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        training.train_gate(rows, 6, recipe, save=save)
    state = training.State.unpacked(caches.read_state(spark, "gate", path))
    assert state.epoch == 2 and state.optimiser.count > 2 and caches.read_state(spark, "other", path) is None
    resumed = training.train_gate(rows, 6, recipe, state, save)
    assert saved == [1, 2, 3, 4] and all(np.allclose(a, b) for a, b in zip(whole.weights, resumed.weights))
    assert [h["epoch"] for h in resumed.history] == [1, 2, 3, 4] and np.isclose(whole.best_loss, resumed.best_loss)
    held = iter([0.5, 0.4, 0.6, 0.7, 0.1])
    state = training.fit_batches(lambda w, part: ([np.ones(1)], 1.0), rows, training.State([np.zeros(1)], training.AdamW(0.1)), lambda w: {"loss": next(held)}, 10, 30, 2)
    assert state.epoch == 4 and state.best_loss == 0.4 and state.best[0] != state.weights[0]
    with pytest.raises(ValueError):
        training.fit_batches(lambda w, part: ([np.ones(1)], float("nan")), rows, training.State([np.zeros(1)], training.AdamW()), lambda w: {"loss": 0.0}, 1)


def test_minibatches_are_whole_and_seeded(spark):
    _, rows = training_tables(spark)
    dealt, n = training.minibatches(rows, 20)
    sizes = {r._batch: r["count"] for r in dealt.groupBy("_batch").count().collect()}
    assert n == 3 and sum(sizes.values()) == 60 and max(sizes.values()) < 40
    assert "PartitionFilters: [isnotnull(_batch" in dealt.where("_batch = 1")._jdf.queryExecution().executedPlan().toString()


def test_anchors_are_unit_vectors_and_stay(spark):
    rows = losses.anchors(spark.range(50).withColumnRenamed("id", "row"), 16)
    a, b = (np.array([r.anchors for r in rows.orderBy("row").collect()]) for _ in range(2))
    assert (a == b).all() and a.shape == (50, 4, 16) and np.allclose(np.linalg.norm(a, axis=2), 1) and abs(a.mean()) < 0.02


def test_no_query_is_chosen_twice(spark):
    rows = spark.createDataFrame([(1, 0, "high_noise"), (1, 3, "logical_negation"), (2, 0, "high_noise"), (2, 2, "entity_entangled"), (3, 0, "high_noise")], "q long, place int, class string")
    assert sorted((r.q, r["class"]) for r in cases.chosen(rows).collect()) == [(1, "high_noise"), (1, "logical_negation"), (2, "entity_entangled"), (3, "high_noise")]


def test_training_data_from_texts_to_steps(spark):
    """Rows to texts, texts to vectors, vectors to lists, lists to scores and a gate's step."""
    rows = spark.createDataFrame([(i, f"fruit {i}", "pears" if i % 2 else "[NONE]", [f"fruit {i} apples"], ["cars", "pears", None]) for i in range(6)] + [(9, "x", "y", [], ["z"])], "idx long, q_plus string, q_minus string, pos array<string>, neg array<string>")
    texts = caches.training_rows(rows)
    vectors = encoders.prepared(texts, "hashed_words")
    assert vectors.count() == texts.count() == 6 * 6 + 3 and {len(r.embedding) for r in vectors.collect()} == {256}
    lists = caches.training_lists(vectors, 2).where("size(pos) > 0")
    scored = lists.select("q_minus", dot("q_plus", F.get("pos", F.lit(0))).alias("pos"), F.transform("neg", lambda v: dot("q_plus", v)).alias("neg"))
    gate, loss = training.gate_step(training.new_gate(256, 4), scored)
    assert loss > 0 and len(gate) == 4 and lists.count() == 6
    blank = spark.createDataFrame([("a", None), ("b", " "), ("c", "x x")], "id string, text string")
    assert {r.id: sum(abs(x) for x in r.embedding) for r in encoders.encoded(blank, "org/Hashed_Words-v2").collect()} == {"a": 0, "b": 0, "c": 1}
    with pytest.raises(ValueError):
        encoders.encoder("none")
    encoders.register("tiny", lambda: encoders.HashedWords(4))
    assert encoders.encoder("tiny").dim == 4


def test_random_split_by_row(spark):
    train, held = training.row_split(spark.range(2000), 0.1)
    assert train.count() + held.count() == 2000 and 120 < held.count() < 280 and train.join(held, "id").isEmpty()


@pytest.mark.parametrize("name", ["softplus_v2", "selective", "micro"])
def test_experiments_run_every_point(spark, tables, name):
    loaded = cli.load(spark, tables, engine.TASKS[0])
    config = engine.Config(tau="both")
    scores = engine.dual_scores(loaded["vectors"], loaded["candidates"], loaded["documents"], config)
    found = experiments.run(scores, name, loaded["qrels"], loaded["diff"]).cache()
    assert found.count() == experiments.points(spark, name).count() and found.where("map > 0 and p_mrr >= 0").count() == found.count()
    assert experiments.leaderboard(found, 3).count() == 3 and experiments.passing(found, 0.0, -1.0).count() == found.count()
    found.unpersist()
    with pytest.raises(ValueError):
        experiments.points(spark, "none")


def test_encoding_goes_on_where_it_was(spark, tmp_path):
    """A job that dies in its fourth bucket keeps three; the next one encodes only what is left, and a third one nothing."""
    texts = spark.createDataFrame([(str(i), f"text {i}") for i in range(80)], "id string, text string")
    path, seen = str(tmp_path / "vectors"), []

    def encode(some):
        if len(seen) == 3:
            seen.append(None)
            raise RuntimeError("lost")
        seen.append(some.count())
        return encoders.encoded(some, "hashed_words")

    with pytest.raises(RuntimeError):
        caches.encode_missing(texts, path, encode, buckets=8)
    first = sum(seen[:3])
    assert caches.read_vectors(spark, path).count() == first == caches.encoded_buckets(spark, path).agg(F.sum("vectors")).first()[0] and caches.encoded_buckets(spark, path).count() == 3
    done = caches.encode_missing(texts, path, encode, buckets=8)
    assert done.count() == 80 and sum(seen[4:]) == 80 - first and caches.encoded_buckets(spark, path).count() == 8
    before = len(seen)
    assert caches.encode_missing(texts, path, encode, buckets=8).count() == 80 and len(seen) == before
    more = texts.unionByName(spark.createDataFrame([("new", "one more")], "id string, text string"))
    assert caches.encode_missing(more, path, encode, buckets=8).count() == 81 and seen[-1] == 1
    with pytest.raises(ValueError):
        caches.encode_missing(texts, path, encode)
    assert caches.encode_missing(texts.limit(0), str(tmp_path / "none"), encode).count() == 0


def test_saves_do_not_mix(spark, tmp_path):
    path = str(tmp_path / "weights")
    assert caches.read_weights(spark, path) == {}
    for a in (1, 2):
        caches.write_weights(spark, {"projection": [[a]], "gate": [a]}, path, 0.5)
    caches.write_weights(spark, {"projection": [[3]]}, path, 0.7)
    found = caches.read_weights(spark, path)
    assert found in ({"projection": [[1]], "gate": [1]}, {"projection": [[2]], "gate": [2]}) and found["gate"] == [2]


def test_requests_are_tried_again(spark, tmp_path):
    def client(fails):
        """Fails so many times for each query; "never" always does."""
        count = {}

        def answer(query, instruction):
            count[query] = count.get(query, 0) + 1
            if query == "never" or count[query] <= fails:
                raise ConnectionError(f"down {count[query]}")
            return json.dumps({"Q_plus": query.upper(), "Q_minus": instruction}) if query != "list" else "[1]"

        return answer

    log, dead = str(tmp_path / "log"), str(tmp_path / "dead")
    rows = spark.createDataFrame([("1", "og", "a", "x"), ("2", "og", "never", "x"), ("3", "changed", "b", ""), ("4", "og", "list", None), ("5", "og", None, "y")], "qid string, query_type string, query string, instruction string")
    slept = []
    assert requests.Retry(5, 1.0, 2.0, 3.0).pauses() == [1.0, 2.0, 3.0, 3.0]
    assert requests.answered(client(2), "a", "x", requests.Retry(), slept.append) == ("A", "x", 3, 3.0, None) and slept == [1.0, 2.0]
    assert requests.answered(client(3), "a", "x", requests.Retry(), slept.append)[:3] == (None, None, 3)
    quick = requests.Retry(3, 0.0)
    found = {r.qid: r for r in requests.fill(rows, log, dead, lambda: client(2), quick).collect()}
    assert (found["1"].q_plus, found["1"].q_minus, found["1"].hit) == ("A", "x", True) and found["3"].q_minus == "[NONE]"
    assert (found["2"].q_plus, found["2"].q_minus, found["2"].hit) == ("never", "[NONE]", False) and not found["4"].hit
    letters = {r.qid: (r.attempts, r.error) for r in spark.read.json(dead).collect()}
    assert set(letters) == {"2", "4"} and letters["2"] == (3, "ConnectionError: down 3") and letters["4"][1].startswith("ValueError")
    again = {r.qid: r.hit for r in requests.fill(rows, log, dead, lambda: client(9), quick).collect()}
    assert again == {"1": True, "2": False, "3": True, "4": False, "5": True}


def test_one_bad_point_costs_no_other(spark, tmp_path):
    path, ran = str(tmp_path / "results"), []
    points = grid.preset(spark, "balanced")

    def run(some):
        listed = sorted(r.param_index for r in some.collect())
        ran.append(listed)
        if 4 in listed and len(ran) < 9:
            raise ArithmeticError("bad point")
        return some.withColumn("p_mrr", F.col("alpha"))

    done, failed = grid.run_resumable(points, run, path, 3)
    assert sorted(r.param_index for r in done.collect()) == [0, 1, 2, 3, 5, 6, 7, 8] and [(r.param_index, r.error) for r in failed.collect()] == [(4, "ArithmeticError: bad point")]
    assert ran == [[0, 1, 2], [3, 4, 5], [3], [4], [5], [6, 7, 8]]
    ran.extend([[]] * 3)
    done, failed = grid.run_resumable(points, run, path, 3)
    assert ran[-1] == [4] and done.count() == 9 and failed.count() == 0


def test_folded_log_survives_restarts(spark, tmp_path):
    """A, B, A: the state reads A back, after a restart and a compaction; a late file and a broken key change nothing."""
    import os

    folder, out, mark = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()

    def log(name, at, rows):
        (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(folder / name, (at, at))
        cache_log.fold(cache_log.cache_stream(spark, str(folder)), out, mark).awaitTermination()

    one = lambda value, qid="1", kind="og": {"qid": qid, "query_type": kind, "q_plus": value, "q_minus": "[NONE]"}
    read = lambda: {(r.qid, r.query_type): r.q_plus for r in cache_log.folded(spark, out).collect()}
    assert cache_log.folded(spark, out).count() == 0
    log("0.json", 1_000_000, [one("a"), one("x", "2", "changed"), {"query_type": "og", "q_plus": "no key"}])
    assert read() == {("1", "og"): "a", ("2", "changed"): "x"}
    log("1.json", 1_000_010, [one("b")])
    assert read()["1", "og"] == "b"
    cache_log.compact(spark, out)
    log("2.json", 1_000_020, [one("a")] * 2)
    assert read()["1", "og"] == "a"
    log("late.json", 1_000_005, [one("late")])
    assert read() == {("1", "og"): "a", ("2", "changed"): "x"}
    cache_log.compact(spark, out)
    cache_log.compact(spark, out)
    assert read() == {("1", "og"): "a", ("2", "changed"): "x"} and len(os.listdir(f"{out}/base")) == 1


def test_projection_needs_weights(spark, tables, tmp_path):
    """Settings that project raise without weights, and with them the negative side is the projected one."""
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="weights"):
        cli.evaluate(spark, cli.parser().parse_args(["evaluate", "--tables", tables, "--out", out, "--retriever", "lap_only"]))
    path = str(tmp_path / "weights")
    caches.write_weights(spark, {"projection": [[0.0, 1.0], [1.0, 0.0]]}, path, 0.1)
    with pytest.raises(ValueError, match="gate"):
        cli.evaluate(spark, cli.parser().parse_args(["evaluate", "--tables", tables, "--out", out, "--retriever", "hybrid", "--weights", path]))
    cli.evaluate(spark, cli.parser().parse_args(["evaluate", "--tables", tables, "--out", out, "--retriever", "lap_only", "--weights", path, "--alpha", "2"]))
    run = {(r.qid, r.doc_id): r.score for r in readers.trec_run(spark, f"{out}/run_changed").collect()}
    # pears turn from (1, 0) to (0, 1): a is penalised by 2 * (0.6 - 0.5), p is not.
    assert abs(run["1-changed", "a"] - 0.6) < 1e-6 and run["1-changed", "p"] == 1.0
    with pytest.raises(ValueError, match="fit"):
        loaded = cli.load(spark, tables, engine.TASKS[0])
        engine.with_projection(loaded["vectors"], np.eye(3))


def test_several_tasks_in_one_run(spark, tables, tmp_path):
    """Tasks that share ids: each has its own runs and reports, and the summary is the mean."""
    import shutil

    both = tmp_path / "both"
    for task in engine.TASKS[:2]:
        shutil.copytree(tables, both / task)
    file = both / engine.TASKS[1] / "split_queries" / f"dual_queries_v5_{engine.TASKS[0]}.jsonl"
    file.rename(file.with_name(f"dual_queries_v5_{engine.TASKS[1]}.jsonl"))
    shutil.rmtree(both / engine.TASKS[1] / "qrel_diff")
    spark.createDataFrame([("1-og", ["a"]), ("2-og", ["c"])], "`query-id` string, `corpus-ids` array<string>").write.parquet(str(both / engine.TASKS[1] / "qrel_diff"))
    out = str(tmp_path / "out")
    rows = {r.task: r for r in cli.evaluate(spark, cli.parser().parse_args(["evaluate", "--tables", str(both), "--out", out, "--alpha", "2", "--task", ",".join(engine.TASKS[:2])])).collect()}
    assert rows[engine.TASKS[0]].p_mrr == 0.5 and rows[engine.TASKS[0]].n_queries == 1 and rows[engine.TASKS[1]].n_queries == 2 and rows[engine.TASKS[1]].p_mrr == -0.25
    summary = spark.read.json(f"{out}/summary").first()
    assert summary.tasks == 2 and summary.average_p_mrr == 0.125
    assert {(r.qid, r.doc_id) for r in readers.trec_run(spark, f"{out}/{engine.TASKS[1]}/run_og").collect()} == {("1-og", "a"), ("1-og", "p"), ("2-og", "a"), ("2-og", "c")}


def test_prepare_and_train_from_the_command_line(spark, tmp_path):
    folder, out = str(tmp_path / "tables"), str(tmp_path / "out")
    rows = [(i, f"fruit {i} fresh", f"pears {i % 3}" if i % 2 else "old cars", [f"fruit {i} apples", "fresh fruit"], ["cars", f"pears {i % 3} old"]) for i in range(40)]
    spark.createDataFrame(rows, "idx long, q_plus string, q_minus string, pos array<string>, neg array<string>").write.parquet(f"{folder}/training_rows")
    encoders.register("tiny8", lambda: encoders.HashedWords(8))
    counts = {r.role: r.vectors for r in cli.prepare(spark, cli.parser().parse_args(["prepare", "--tables", folder, "--out", folder, "--encoder", "tiny8"])).collect()}
    assert counts == {"q_plus": 40, "q_minus": 40, "pos": 80, "neg": 80}
    args = ["train", "--tables", folder, "--out", out, "--mode", "hybrid", "--num-neg", "2", "--size", "32", "--contrast-size", "8", "--rate", "0.01"]
    first = cli.train(spark, cli.parser().parse_args([*args, "--epochs", "1"])).collect()
    assert {(r.part, r.epoch) for r in first} == {("projection", 1), ("gate", 1)}
    more = cli.train(spark, cli.parser().parse_args([*args, "--epochs", "2"])).collect()
    assert {(r.part, r.epoch) for r in more} == {(p, e) for p in ("projection", "gate") for e in (1, 2)}
    assert {r.train_loss for r in first} < {r.train_loss for r in more}
    weights = caches.read_weights(spark, f"{out}/weights")
    assert np.array(weights["projection"]).shape == (8, 8) and len(weights["gate"]) == 4
    texts = str(tmp_path / "texts")
    spark.createDataFrame([(i, f"text {i}") for i in range(30)], "id long, text string").write.parquet(texts)
    row = cli.encode(spark, cli.parser().parse_args(["encode", "--tables", texts, "--out", str(tmp_path / "vectors")])).first()
    assert row.vectors == 30 and row.buckets > 5


def test_search_records(spark, tmp_path):
    """The record of a search holds its best point, all points in order, and every query's measures beside it."""
    results = spark.createDataFrame([(i, 0.5 * i, 0.1, 0.2 + i % 2, 0.3, 0.4, 0.5, 0.6) for i in range(3)], "param_index long, alpha double, tau double, p_mrr double, og_ndcg_5 double, changed_ndcg_5 double, og_mrr_100 double, changed_mrr_100 double").repartition(2)
    per = spark.createDataFrame([("1-og", 5, 0.1)], "qid string, k long, ndcg double")
    reports.save_search(results, engine.best(results), per, ("alpha", "tau"), str(tmp_path), "pat", top_k=5)
    read = lambda name: "".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*")))
    record = json.loads(read("random_search_results"))
    assert record["best_params"] == {"alpha": 0.5, "tau": 0.1} and record["best_metrics"]["p_mrr"] == 1.2 and [r["alpha"] for r in record["all_results"]] == [0.0, 0.5, 1.0]
    grid_file = json.loads(read("pat_grid_search_results"))
    assert grid_file["alpha_list"] == [0.0, 0.5, 1.0] and grid_file["top_k"] == 5 and grid_file["results"][2]["changed_mrr"] == 0.6
    lines = read("pat_grid_search_results_csv").splitlines()
    assert lines == ["alpha,tau,p_mrr,og_ndcg@5,changed_ndcg@5,og_mrr,changed_mrr"] + [f"{0.5 * i:.4f},0.1000,{0.2 + i % 2:.4f},0.3000,0.4000,0.5000,0.6000" for i in range(3)]
    assert json.loads(read("all_query_metrics"))["qid"] == "1-og"
