"""Dual-stream evaluation: from queries, candidates and vectors to scores, runs, metrics and rank changes.

Any table may have further key columns (a task): they are named once, as keys, and part the ids of all tables that have them.

Tables: queries (qid, base_qid, query_type, query, instruction), dual (qid, query_type, q_plus, q_minus), candidates
(base_qid, pos, doc_id), vectors of documents (doc_id, embedding) and of query texts (text, embedding), judgements (qid,
doc_id, rel) and changed judgements (base_qid, doc_ids).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import NONE, mask_strict, query_text
from ..functions.penalties import Streams, penalty
from ..functions.vectors import cosine, project
from ..sources.shared import stash
from . import grid, metrics, tiles
from .ranking import ranked, score_candidates, top_k, with_moments
from .training import Gate, gate, gate_bounds

#: Tasks that are known by name (fixed values).
TASKS = ("Core17InstructionRetrieval", "Robust04InstructionRetrieval", "News21InstructionRetrieval")
KS = (1, 3, 5, 10, 100, 1000)
#: Runs of up to so many ranks are cut while they are sorted; longer ones are ranked by ranges.
SHORT = 10_000


@dataclass(frozen=True)
class Config:
    """base: the text that the base stream scores, "original" or "q_plus"; tau: a number, or "both", "original" or
    "q_plus" for a threshold from the vectors (plus delta); isolate_og: original queries keep their base score; keep:
    ranks that a run holds; projection and gate: whether the negative side is projected and the gate's alpha and tau hold."""

    base: str = "q_plus"
    penalty: str = "classic"
    alpha: float = 1.0
    tau: float | str = 0.5
    delta: float = 0.0
    isolate_og: bool = True
    keep: int = 1000
    projection: bool = False
    gate: bool = False


#: The retriever's settings by name: whether it projects and gates; strength 1 and threshold 0.5 hold where it does not gate.
RETRIEVERS = {"baseline": Config(), "mlp_only": Config(gate=True), "lap_only": Config(projection=True), "hybrid": Config(projection=True, gate=True)}


def retriever(name: str, **changes) -> Config:
    if name not in RETRIEVERS:
        raise ValueError(f"unknown retriever {name!r}; known: {', '.join(RETRIEVERS)}")
    return replace(RETRIEVERS[name], **changes)


def trained_parts(config: Config) -> tuple[str, ...]:
    """What a trainer of this setting changes."""
    return tuple(name for name, used in (("projection", config.projection), ("gate", config.gate)) if used)


def valid_task(name: Column) -> Column:
    return name.isin(*TASKS)


def sides(queries: DataFrame, dual: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Queries with original, q_plus, q_minus and mask. Where the split is missing, the raw text stands for the positive
    side and there is no negative one; original queries never have one."""
    split = dual.select(*keys, "qid", "query_type", F.col("q_plus").alias("_plus"), F.col("q_minus").alias("_minus"))
    joined = queries.join(split, [*keys, "qid", "query_type"], "left").withColumn("original", query_text(F.col("query"), F.col("instruction")))
    minus = F.coalesce("_minus", F.lit(NONE))
    mask = F.when(F.col("query_type") == "og", 0.0).otherwise(mask_strict(minus))
    return joined.select(*keys, "qid", "base_qid", "query_type", "query", "instruction", "original", F.coalesce(F.when(F.col("_plus") != "", F.col("_plus")), "original").alias("q_plus"), minus.alias("q_minus"), mask.alias("mask"))


def with_vectors(split: DataFrame, texts: DataFrame) -> DataFrame:
    """Vectors orig, plus and minus of the sides; queries without one of the first two are left out, as is a missing minus masked."""
    out = split
    for text, vector, how in (("original", "orig", "inner"), ("q_plus", "plus", "inner"), ("q_minus", "minus", "left")):
        out = out.join(texts.select(F.col("text").alias(text), F.col("embedding").alias(vector)), text, how)
    mask = F.when(F.col("minus").isNull(), 0.0).otherwise(F.col("mask"))
    return out.withColumn("mask", mask).withColumn("minus", F.coalesce("minus", "plus"))


def threshold(config: Config) -> Column:
    """The query's threshold: fixed, or from the likeness of its sides."""
    if not isinstance(config.tau, str):
        return F.lit(float(config.tau))
    original, plus = cosine("orig", "minus"), cosine("plus", "minus")
    found = {"both": F.least(original, plus), "original": original, "q_plus": plus}
    if config.tau not in found:
        raise ValueError(f"unknown threshold {config.tau!r}; known: {', '.join(found)}")
    return found[config.tau] + config.delta


def with_projection(vectors: DataFrame, weight: np.ndarray) -> DataFrame:
    """Vectors whose negative side is projected by a trained matrix and normalised; queries without a negative side keep their place holder."""
    dim = vectors.select(F.size("minus")).first()
    if dim is not None and weight.shape != (dim[0], dim[0]):
        raise ValueError(f"a projection of {weight.shape} does not fit vectors of {dim[0]} numbers")
    projected = project(weight)("minus")
    return vectors.withColumn("minus", F.when(F.col("mask") > 0, projected).otherwise(F.col("minus").cast("array<double>")))


def gate_values(vectors: DataFrame, weights: Gate, encoder: str = "bge", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, qid, alpha and tau that a trained gate gives the negative sides (projected ones, where the setting projects)."""
    most, low, high = gate_bounds(encoder)
    found = gate(weights, most, low, high)("minus")
    return vectors.where("mask > 0").select(*keys, "qid", found.alias("g")).select(*keys, "qid", "g.alpha", "g.tau")


def dual_scores(vectors: DataFrame, candidates: DataFrame, documents: DataFrame, config: Config, gates: DataFrame | None = None, projection: np.ndarray | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, qid, base_qid, query_type, doc, mask, alpha, tau, s_base and s_neg of every candidate that has a vector.

    gates: qid, alpha, tau; the gate's values hold if the setting gates, and queries without any keep the fixed ones.
    projection: the matrix that a setting with projection needs; the threshold is that of the projected side too.
    """
    if config.base not in ("original", "q_plus"):
        raise ValueError(f"unknown base {config.base!r}; known: original, q_plus")
    if config.projection:
        if projection is None:
            raise ValueError("this setting projects the negative side and needs trained weights")
        vectors = with_projection(vectors, projection)
    base = F.col("orig" if config.base == "original" else "plus")
    queries = vectors.select(*keys, F.col("qid").alias("q"), "base_qid", "query_type", "mask", F.lit(config.alpha).alias("alpha"), threshold(config).alias("tau"), base.alias("_base"), F.col("minus").alias("_minus"))
    if config.gate and gates is not None:
        found = gates.select(*keys, F.col("qid").alias("q"), F.col("alpha").alias("_alpha"), F.col("tau").alias("_tau"))
        queries = queries.join(found, [*keys, "q"], "left").withColumns({"alpha": F.coalesce("_alpha", "alpha"), "tau": F.coalesce("_tau", "tau")}).drop("_alpha", "_tau")
    pairs = candidates.join(vectors.select(*keys, F.col("qid").alias("q"), "base_qid"), [*keys, "base_qid"]).select(*keys, "q", F.col("doc_id").alias("doc"))
    docs = documents.select(*(k for k in keys if k in documents.columns), F.col("doc_id").alias("doc"), "embedding")
    return score_candidates(pairs, queries, docs, {"s_base": "_base", "s_neg": "_minus"}, keys).withColumnRenamed("q", "qid")


def final_scores(scores: DataFrame, config: Config, **params) -> DataFrame:
    """Scores with score: the penalised base stream, or with isolate_og the base stream alone for original queries."""
    streams = Streams(F.col("s_base"), F.col("s_neg"), F.col("tau"), F.col("mask"), F.col("og_rank") if "og_rank" in scores.columns else F.lit(0))
    score = penalty(config.penalty)(streams, alpha=F.col("alpha"), **params)
    if config.isolate_og:
        score = F.when(F.col("query_type") == "og", F.col("s_base")).otherwise(score)
    return scores.withColumn("score", score)


def run_of(final: DataFrame, keep: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, qid, base_qid, query_type, doc, rank, score: the first `keep` of each query."""
    placed = top_k(final, "score", keep, (*keys, "qid")) if keep <= SHORT else ranked(final, "score", (*keys, "qid")).where(F.col("rank") <= keep)
    return placed.select(*keys, "qid", "base_qid", "query_type", "doc", "rank", "score")


def evaluate(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS, changed_against_og: bool = False, binary: str = "positive", keys: tuple[str, ...] = ()) -> DataFrame:
    """Measures by query and cut-off. changed_against_og: changed queries are held against their original's judgements."""
    judged = qrels.withColumnRenamed("doc_id", "doc")
    if changed_against_og:
        og = judged.where(F.col("qid").endswith("-og"))
        judged = og.unionByName(og.withColumn("qid", F.concat(F.regexp_replace("qid", "-og$", ""), F.lit("-changed"))))
    judged = processed(judged, run, keys)
    kinds = run.select(*keys, "qid", "query_type").distinct()
    return metrics.per_query(run, judged, ks, (*keys, "qid"), binary).join(kinds, [*keys, "qid"])


def processed(judged: DataFrame, run: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Judgements of the queries that a run holds; keys that the judgements lack (grid points) get all of theirs."""
    there = run.select(*keys, "qid").distinct()
    lacking = [k for k in keys if k not in judged.columns]
    on = [*(k for k in keys if k in judged.columns), "qid"]
    return judged.join(there, on) if lacking else judged.join(there, on, "left_semi")


def changes(run: DataFrame, diff: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, base_qid, doc, og_rank, new_rank, change of each document whose judgement changed."""
    return changes_between(*(run.where(F.col("query_type") == kind) for kind in ("og", "changed")), diff, keys)


def changes_between(before: DataFrame, after: DataFrame, diff: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The same of two runs; the first may lack the keys."""
    sides = [run.select(*(k for k in keys if k in run.columns), F.col("base_qid").alias("q"), "doc", "rank") for run in (before, after)]
    listed = diff.select(*(k for k in keys if k in diff.columns), F.col("base_qid").alias("q"), F.explode("doc_ids").alias("doc"))
    return metrics.rank_changes(*sides, listed, (*keys, "q")).withColumnRenamed("q", "base_qid")


def bundle(per: DataFrame, moved: DataFrame, keys: tuple[str, ...] = (), measures: tuple[str, ...] = ("ndcg", "map", "mrr", "recall")) -> DataFrame:
    """One row for each of keys: p_mrr, n_queries, and {type}_{measure}_{k} as means over queries (0 where there are none)."""
    ks = [r.k for r in per.select("k").distinct().orderBy("k").collect()]
    wide = per.groupBy(*keys).agg(*(F.coalesce(F.avg(F.when((F.col("query_type") == t) & (F.col("k") == k), F.col(m))), F.lit(0.0)).alias(f"{t}_{m}_{k}") for t in ("og", "changed") for m in measures for k in ks))
    change = metrics.p_mrr(moved, keys, "base_qid")
    return wide.join(change, list(keys)) if keys else wide.crossJoin(change)


@dataclass(frozen=True)
class Results:
    run: DataFrame
    per: DataFrame
    moved: DataFrame
    bundle: DataFrame


def results(scores: DataFrame, qrels: DataFrame, diff: DataFrame, config: Config, ks: tuple[int, ...] = KS, keys: tuple[str, ...] = ()) -> Results:
    """Run, measures by query, rank changes and the bundle of every value of keys (a task), in one plan each; run and measures are stored."""
    run = stash(run_of(final_scores(scores, config), config.keep, keys), "run")
    per = stash(evaluate(run, qrels, ks, keys=keys), "measures")
    moved = changes(run, diff, keys)
    return Results(run, per, moved, bundle(per, moved, keys))


def tasks_summary(bundles: DataFrame) -> DataFrame:
    """The mean p_mrr over tasks, 0 without any, and their number; bundles: a row for each task."""
    return bundles.agg(F.coalesce(F.avg("p_mrr"), F.lit(0.0)).alias("average_p_mrr"), F.count("*").alias("tasks"))


def sweep(scores: DataFrame, points: DataFrame, qrels: DataFrame, diff: DataFrame, config: Config, ks: tuple[int, ...] = (5,)) -> DataFrame:
    """The bundle of every grid point in one plan: scored once, crossed with the small grid (param_index and alpha, with tau,
    gamma, or tau_base and lam).

    gamma: the threshold is so many deviations above the mean of a query's negative stream; tau_base and lam are the
    proportional penalties' own. Where original queries keep their base score they are the same at every point: ranked and measured
    once, only changed queries are crossed."""
    keys, og = ("param_index",), F.col("query_type") == "og"
    if "gamma" in points.columns:
        scores = with_moments(scores, "s_neg", ("qid",))
    if config.penalty in ("pat_protected", "pat_hybrid"):  # these ask for the first ranks only
        first = top_k(scores, "s_base", 20, ("qid",), name="og_rank").select("qid", "doc", "og_rank")
        scores = scores.join(first, ["qid", "doc"], "left").withColumn("og_rank", F.coalesce("og_rank", F.lit(21)))
    crossed = (scores.where(~og) if config.isolate_og else scores).drop("alpha", *["tau"] * ("tau" in points.columns)).crossJoin(F.broadcast(points))
    if "gamma" in points.columns:
        crossed = crossed.withColumn("tau", F.when(F.col("_dev") < 1e-8, F.col("_mean")).otherwise(F.col("_mean") + F.col("gamma") * F.col("_dev")))
    params = {"tau0": F.col("tau_base"), "lam": F.col("lam")} if "tau_base" in points.columns else {}
    run = stash(run_of(final_scores(crossed, config, **params), config.keep, keys), "swept")
    per = evaluate(run, qrels, ks, keys=keys)
    if not config.isolate_og:
        return points.join(bundle(per, changes(run, diff, keys), keys), "param_index")
    before = stash(run_of(final_scores(scores.where(og).withColumn("alpha", F.lit(0.0)), replace(config, penalty="classic")), config.keep), "original")
    both = per.unionByName(evaluate(before, qrels, ks).crossJoin(F.broadcast(points.select(*keys))))
    return points.join(bundle(both, changes_between(before, run, diff, keys), keys), "param_index")


def asked(vectors: DataFrame, config: Config, gates: DataFrame | None = None, projection: np.ndarray | None = None) -> DataFrame:
    """Queries as tiles take them, where every document is a candidate: q (the qid), base_qid, base, minus, mask, alpha and tau."""
    if config.base not in ("original", "q_plus"):
        raise ValueError(f"unknown base {config.base!r}; known: original, q_plus")
    if config.projection:
        if projection is None:
            raise ValueError("this setting projects the negative side and needs trained weights")
        vectors = with_projection(vectors, projection)
    mask = F.when(F.col("query_type") == "og", 0.0).otherwise(F.col("mask")) if config.isolate_og else F.col("mask")
    queries = vectors.select(F.col("qid").alias("q"), "base_qid", F.col("orig" if config.base == "original" else "plus").alias("base"), "minus", mask.alias("mask"), F.lit(config.alpha).alias("alpha"), threshold(config).alias("tau"))
    if not config.gate or gates is None:
        return queries
    found = gates.select(F.col("qid").alias("q"), F.col("alpha").alias("_alpha"), F.col("tau").alias("_tau"))
    return queries.join(found, "q", "left").withColumns({"alpha": F.coalesce("_alpha", "alpha"), "tau": F.coalesce("_tau", "tau")}).drop("_alpha", "_tau")


def open_run(queries: DataFrame, documents: DataFrame, config: Config, keep: int) -> DataFrame:
    """qid, doc, label, rank and score of each query's first `keep` of all documents; no list of candidates is made."""
    return tiles.first(queries, documents, keep, config.penalty).withColumnRenamed("q", "qid")


def moved_of(per: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, base_qid and its mean rank change, once, from measures that hold it in all their rows."""
    return per.where("query_type = 'changed' and change is not null").groupBy(*keys, F.col("q").alias("base_qid")).agg(F.max("change").alias("change"))


def open_sweep(queries: DataFrame, documents: DataFrame, judge: tiles.Judge, points: DataFrame, config: Config, ks: tuple[int, ...] = (5,)) -> DataFrame:
    """The bundle of every grid point as sweep has it, where every document is a candidate and whole runs count."""
    per = stash(tiles.measures(queries, documents, judge, grid.values(points), ks, config.penalty), "measures")
    return points.join(bundle(per, moved_of(per, ("param_index",)), ("param_index",)), "param_index")


def best(results: DataFrame, k: int = 5) -> DataFrame:
    """The first point with the best sum of p_mrr and both sides' nDCG."""
    return results.withColumn("total", F.col("p_mrr") + F.col(f"og_ndcg_{k}") + F.col(f"changed_ndcg_{k}")).orderBy(F.desc("total"), "param_index").limit(1)


def progress(points: DataFrame, results: DataFrame) -> DataFrame:
    """How many points are done, and how many there are."""
    done = results.select("param_index").distinct().join(points, "param_index", "left_semi").agg(F.count("*").alias("completed"))
    return done.crossJoin(points.agg(F.count("*").alias("total")))
