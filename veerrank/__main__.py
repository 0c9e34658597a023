"""Command line: evaluate tasks, sweep a grid, encode texts, prepare training vectors, train, or list what is known.

    spark-submit -m veerrank evaluate --tables DIR --out DIR [--task NAME,NAME] [--model NAME] [--base q_plus|original] ...
    spark-submit -m veerrank encode --tables TEXTS --out VECTORS [--encoder NAME]
    spark-submit -m veerrank prepare --tables DIR --out DIR [--encoder NAME]
    spark-submit -m veerrank train --tables DIR --out DIR --mode hybrid [--epochs N] ...

DIR holds Parquet tables corpus_vectors (id, embedding), query_vectors (text, embedding), queries, instructions, top_ranked,
qrels and qrel_diff, and JSON-lines files dual_queries_v<N>_<task>.jsonl in split_queries; of several tasks each has its
own folder of that kind below DIR. TEXTS has id and text. prepare reads training_rows (idx, q_plus, q_minus, pos, neg) and
writes training_vectors, which train reads; train leaves weights, history and the states that the same command goes on from.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import grid_points
from .functions.penalties import PENALTIES
from .functions.vectors import dot, project
from .operators import encoders, engine, grid, training
from .sources import caches, readers, reports, sinks
from .sources.shared import stash


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="veerrank", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("evaluate", "sweep"):
        p = commands.add_parser(name)
        p.add_argument("--tables", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--task", default=engine.TASKS[0], help="one, or several with commas between" if name == "evaluate" else None)
        p.add_argument("--model", default="model")
        p.add_argument("--retriever", default="baseline", choices=sorted(engine.RETRIEVERS))
        p.add_argument("--weights", help="what train has written; settings that project or gate need it")
        p.add_argument("--encoder", default="bge", help="the family whose bounds the gate has")
        p.add_argument("--base", default="q_plus", choices=("q_plus", "original"))
        p.add_argument("--penalty", default="classic", choices=sorted(PENALTIES))
        p.add_argument("--alpha", type=float, default=1.0)
        p.add_argument("--tau", default="0.5", help="a number, or both, original or q_plus")
        p.add_argument("--delta", type=float, default=0.0)
        p.add_argument("--penalise-original", action="store_true", help="original queries are penalised like changed ones")
        p.add_argument("--preset", default="balanced", choices=sorted(grid.PRESETS))
        p.add_argument("--points", help="alpha,tau;alpha,tau instead of a preset")
        p.add_argument("--sample", type=int, help="at most so many points of the grid, in a fixed random order")
        p.add_argument("--chunk", type=int, default=8, help="points that are committed together")
        p.add_argument("--seed", type=int, default=42)
    for name in ("encode", "prepare"):
        p = commands.add_parser(name)
        p.add_argument("--tables", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--encoder", default="hashed_words")
    p = commands.add_parser("train")
    p.add_argument("--tables", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--mode", default="hybrid", choices=sorted(training.MODES))
    p.add_argument("--num-neg", type=int, default=15)
    for f in fields(training.Recipe):
        p.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default), default=f.default)
    commands.add_parser("list")
    return top


def config_of(args: argparse.Namespace) -> engine.Config:
    try:
        tau = float(args.tau)
    except ValueError:
        tau = args.tau
    return engine.retriever(args.retriever, base=args.base, penalty=args.penalty, alpha=args.alpha, tau=tau, delta=args.delta, isolate_og=not args.penalise_original)


def load(spark: SparkSession, folder: str, task: str) -> dict[str, DataFrame]:
    """The tables of a task, with their names and keys resolved."""
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}")

    def order(df: DataFrame) -> F.Column:
        return F.col("ordinal") if "ordinal" in df.columns else F.lit(0)

    queries, told, ranked, qrels = (table(n) for n in ("queries", "instructions", "top_ranked", "qrels"))
    split = engine.sides(readers.queries(queries, told, order(told)), caches.load_split_queries(spark, f"{folder}/split_queries", task).withColumn("qid", _with_type()))
    return {
        "sides": split, "vectors": engine.with_vectors(split, table("query_vectors")), "candidates": readers.candidates(ranked, order(ranked)),
        "documents": table("corpus_vectors").select(F.col("id").alias("doc_id"), "embedding"), "qrels": readers.qrels(qrels, order(qrels)), "diff": readers.qrel_diff(table("qrel_diff")),
    }


def _with_type() -> F.Column:
    """Keys of split queries may lack their type's suffix."""
    return F.when(F.col("qid").rlike("-(og|changed)$"), F.col("qid")).otherwise(F.concat_ws("-", "qid", "query_type"))


def load_tasks(spark: SparkSession, folder: str, tasks: list[str]) -> dict[str, DataFrame]:
    """The tables of several tasks as one, each with the key task."""
    parts = [{name: table.withColumn("task", F.lit(task)) for name, table in load(spark, f"{folder}/{task}", task).items()} for task in tasks]
    out = parts[0]
    for part in parts[1:]:
        out = {name: out[name].unionByName(part[name]) for name in out}
    return out


def trained(spark: SparkSession, args: argparse.Namespace, config: engine.Config) -> tuple[np.ndarray | None, training.Gate | None]:
    """The projection and the gate that a setting needs, from saved weights."""
    if not engine.trained_parts(config):
        return None, None
    if not args.weights:
        raise ValueError(f"{args.retriever} needs --weights, as train writes them")
    found = caches.read_weights(spark, args.weights)
    lacking = [p for p in engine.trained_parts(config) if p not in found]
    if lacking:
        raise ValueError(f"the weights at {args.weights} lack {', '.join(lacking)}")
    return (np.array(found["projection"]) if config.projection else None), (tuple(np.array(w) for w in found["gate"]) if config.gate else None)


def scored(spark: SparkSession, args: argparse.Namespace, config: engine.Config, tables: dict[str, DataFrame], keys: tuple[str, ...] = ()) -> DataFrame:
    """Both streams of every candidate under the setting; a table of gates beside the others comes before trained ones."""
    given = f"{args.tables}/gates"
    if config.gate and not keys and not args.weights and not caches.absent(spark, given):
        return stash(engine.dual_scores(tables["vectors"], tables["candidates"], tables["documents"], config, spark.read.parquet(given)), "streams")
    projection, gate = trained(spark, args, config)
    gates = None
    if gate is not None:
        vectors = engine.with_projection(tables["vectors"], projection) if projection is not None else tables["vectors"]
        gates = engine.gate_values(vectors, gate, args.encoder, keys)
    return stash(engine.dual_scores(tables["vectors"], tables["candidates"], tables["documents"], config, gates, projection, keys), "streams")


def evaluate(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Runs, metrics by query, the report and the analysis of strengths and thresholds; gives a row of results for each task."""
    config, tasks = config_of(args), args.task.split(",")
    many = len(tasks) > 1
    keys = ("task",) if many else ()
    tables = load_tasks(spark, args.tables, tasks) if many else load(spark, args.tables, args.task)
    scores = scored(spark, args, config, tables, keys)
    found = engine.results(scores, tables["qrels"], tables["diff"], config, keys=keys)
    bundle = stash(found.bundle if many else found.bundle.withColumn("task", F.lit(args.task)), "bundle")
    for task in tasks:
        folder = f"{args.out}/{task}" if many else args.out
        here = (F.col("task") == task) if many else F.lit(True)
        one, run, per = bundle.where(F.col("task") == task).drop("task"), found.run.where(here), found.per.where(here)
        reports.save_run(run, one, folder, task, args.model)
        reports.write_json(per, f"{folder}/measures")
        reports.write_json(reports.metric_summary(one), f"{folder}/metrics_summary")
    each = scores.groupBy(*keys, "qid").agg(F.first("alpha").alias("alpha"), F.first("tau").alias("tau")).join(tables["sides"], [*keys, "qid"])
    analysis = stash(reports.parameter_analysis(each), "analysis")
    reports.write_json(analysis, f"{args.out}/alpha_tau_analysis")
    sinks.write_csv(analysis, f"{args.out}/alpha_tau_analysis_csv")
    reports.write_markdown(reports.markdown_report(bundle.select("task", "p_mrr", "og_ndcg_5", "changed_ndcg_5"), args.model), f"{args.out}/report")
    if many:
        reports.write_json(engine.tasks_summary(bundle), f"{args.out}/summary")
    return bundle


def sweep(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The points of a grid that have no result yet, chunk by chunk; gives all results. Points that fail are listed beside them."""
    config, tables = config_of(args), load(spark, args.tables, args.task)
    if args.points:
        listed = spark.createDataFrame([(args.points,)], "t string").select(F.posexplode(F.split("t", ";")).alias("i", "p"))
        listed = listed.select(F.col("i").cast("long").alias("param_index"), F.get(grid_points(F.col("p")), F.lit(0)).alias("g"))
        points = listed.where("g is not null").select("param_index", "g.alpha", "g.tau")
    else:
        points = grid.preset(spark, args.preset)
    points = stash(grid.sampled(points, args.sample, args.seed) if args.sample else points, "points")
    held: list[DataFrame] = []

    def run(some: DataFrame) -> DataFrame:
        held[:] = held or [scored(spark, args, config, tables)]
        return engine.sweep(held[0], some, tables["qrels"], tables["diff"], config, (1, 5, 10, 100))

    results, failed = grid.run_resumable(points, run, f"{args.out}/results", args.chunk)
    done = stash(results, "done")
    reports.write_json(failed, f"{args.out}/failed_points")
    reports.write_json(reports.grid_report(done), f"{args.out}/report")
    sinks.write_csv(reports.parameter_summary(done), f"{args.out}/all_params_summary")
    if not done.isEmpty():
        first = engine.best(done).drop("written_at")
        reports.write_json(reports.full_record(done, first, ("alpha", "tau"), "trained_gate" if config.gate else None), f"{args.out}/search_results")
    return done


def encode(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Vectors of a table of texts; a job that was interrupted goes on with the buckets that are left."""
    texts = spark.read.parquet(args.tables).select(F.col("id").cast("string").alias("id"), "text")
    caches.encode_missing(texts, args.out, lambda some: encoders.encoded(some, args.encoder))
    return caches.encoded_buckets(spark, args.out).agg(F.count("*").alias("buckets"), F.sum("vectors").alias("vectors"))


def prepare(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The vectors of training rows' texts."""
    texts = caches.training_rows(spark.read.parquet(f"{args.tables}/training_rows"))
    encoders.prepared(texts, args.encoder).write.mode("overwrite").parquet(f"{args.out}/training_vectors")
    return spark.read.parquet(f"{args.out}/training_vectors").groupBy("role").agg(F.count("*").alias("vectors"))


def training_tables(vectors: DataFrame, num_neg: int) -> tuple[DataFrame, Callable[[np.ndarray], DataFrame], int]:
    """Pairs for the projection, the gate's rows for a projection, and the dimension; rows of the gate have as many negatives each."""
    lists = stash(caches.training_lists(vectors, num_neg).where("q_minus is not null and q_plus is not null and size(pos) > 0 and size(neg) > 0"), "lists")
    pairs = lists.select("idx", F.col("q_minus").alias("q"), F.explode("pos").alias("pos"), F.get("neg", F.lit(0)).alias("neg"))
    whole = lists.where(F.size("neg") == num_neg)

    def gate_rows(weight: np.ndarray) -> DataFrame:
        return whole.select("idx", project(weight)("q_minus").alias("q_minus"), dot("q_plus", F.get("pos", F.lit(0))).alias("pos"), F.transform("neg", lambda v: dot("q_plus", v)).alias("neg"))

    first = lists.select(F.size("q_minus")).first()
    if first is None:
        raise ValueError("there are no training rows with both sides, a positive and a negative")
    return pairs, gate_rows, first[0]


def train(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Train a mode's parts, or go on where an earlier run of the same command was; gives the history."""
    recipe = training.Recipe(**{f.name: getattr(args, f.name) for f in fields(training.Recipe)})
    pairs, gate_rows, dim = training_tables(spark.read.parquet(f"{args.tables}/training_vectors"), args.num_neg)
    states = f"{args.out}/states"
    found = {part: caches.read_state(spark, part, states) for part in training.MODES[args.mode]}
    resume = {part: training.State.unpacked(data) for part, data in found.items() if data}
    weight, gate, history = training.train(args.mode, pairs, gate_rows, dim, recipe=recipe, resume=resume, save=lambda part, state: caches.write_state(spark, part, state.epoch, state.packed(), states))
    score = min((h["val_loss"] for h in history.get("gate" if gate else "projection", [])), default=0.0)
    parts = {"projection": weight.tolist()} | ({"gate": [w.tolist() for w in gate]} if gate else {})
    caches.write_weights(spark, parts, f"{args.out}/weights", score)
    rows = [(part, int(h["epoch"]), float(h["train_loss"]), float(h["val_loss"]), {k: float(v) for k, v in h.items()}) for part, each in history.items() for h in each]
    table = spark.createDataFrame(rows, "part string, epoch int, train_loss double, val_loss double, measures map<string,double>")
    reports.write_json(table, f"{args.out}/training_history")
    return table.drop("measures")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("penalties:", *sorted(PENALTIES))
        print("grids:", *sorted(grid.PRESETS))
        print("encoders:", *sorted(encoders.ENCODERS))
        print("retrievers:", *(f"{n}({', '.join(f.name for f in fields(c) if getattr(c, f.name) is True)})" for n, c in engine.RETRIEVERS.items()))
        return
    spark = SparkSession.builder.appName("veerrank").getOrCreate()
    {"evaluate": evaluate, "sweep": sweep, "encode": encode, "prepare": prepare, "train": train}[args.command](spark, args).show(truncate=False)


if __name__ == "__main__":
    main()
