"""The experiments on penalties: named grids of parameters, run in one plan each."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stash
from . import engine, grid, metrics, tiles
from .ranking import ranked

#: Experiments (fixed values): the penalty, and the values of each parameter, every combination of them. delta is added to
#: the query's own threshold.
EXPERIMENTS: dict[str, tuple[str, dict[str, tuple[float, ...]]]] = {
    "softplus": ("soft", {"alpha": (0.5, 1.0, 1.5, 2.0, 3.0, 5.0), "delta": (-0.3, -0.2, -0.15, -0.1, 0.0)}),
    "hybrid_v3": ("hybrid_v3", {"alpha": (0.5, 1.0, 1.5, 2.0), "margin": (-0.2, -0.15, -0.1, 0.0), "delta": (-0.2, -0.15, -0.1)}),
    "softplus_v2": ("soft", {"beta": (20, 50, 100, 200), "alpha": (1.0, 2.0), "delta": (0.0, -0.05, -0.1)}),
    "adaptive": ("adaptive", {"alpha": (0.5, 1.0, 1.5), "delta": (0.0, -0.05, -0.1), "beta": (50,)}),
    "double_threshold": ("double_threshold", {"alpha": (1.0, 2.0), "margin": (0.02, 0.05, 0.1), "delta": (0.0, -0.05), "beta": (50,)}),
    "hard": ("hard", {"alpha": (1.0, 2.0, 3.0), "delta": (0.0, -0.05, -0.1), "beta": (50, 100)}),
    "exponential": ("exponential", {"alpha": (0.5, 1.0, 2.0), "delta": (0.0, -0.05), "gamma": (3.0, 5.0, 10.0)}),
    "rank_aware": ("rank_aware", {"alpha": (0.5, 1.0, 1.5), "delta": (0.0, -0.05), "beta": (50,)}),
    "combined": ("combined", {"alpha": (1.0, 2.0), "share": (0.3, 0.5, 0.7, 0.9), "delta": (0.0, -0.05), "beta": (50,)}),
    "conditional": ("conditional", {"alpha": (1.0, 2.0, 3.0), "below": (0.5, 0.6, 0.7, 0.8), "delta": (0.0, -0.05), "beta": (50,)}),
    "gradual": ("gradual", {"alpha": (1.0, 2.0), "below": (0.5, 0.6, 0.7), "delta": (0.0, -0.05), "beta": (50,)}),
    "smart": ("smart", {"alpha": (1.0, 2.0, 3.0), "delta": (0.0, -0.05, -0.1), "beta": (50,)}),
    "selective": ("selective", {"alpha": (1.0, 2.0, 3.0), "below": (0.3, 0.4, 0.5, 0.6), "boost": (0.0, 0.1, 0.2), "delta": (0.0, -0.05), "beta": (50,)}),
    "harm_aware": ("harm_aware", {"alpha": (0.5, 1.0, 1.5), "gamma": (0.5, 1.0, 2.0, 3.0), "delta": (0.0, -0.05), "beta": (50,)}),
    "triple": ("triple", {"alpha": (1.0, 2.0, 3.0), "below": (0.3, 0.4, 0.5), "above": (0.2, 0.3, 0.4), "delta": (0.0, -0.05), "beta": (50,)}),
    "micro": ("micro", {"alpha": (2.0,), "margin": (0.0, 0.05, 0.1, 0.15)}),
}


def points(spark: SparkSession, name: str) -> DataFrame:
    """param_index and a column for each parameter of an experiment."""
    if name not in EXPERIMENTS:
        raise ValueError(f"unknown experiment {name!r}; known: {', '.join(EXPERIMENTS)}")
    axes = EXPERIMENTS[name][1]
    rows = [(i, *map(float, p)) for i, p in enumerate(product(*axes.values()))]
    return spark.createDataFrame(rows, "param_index long, " + ", ".join(f"{a} double" for a in axes))


def run(scores: DataFrame, name: str, qrels: DataFrame, diff: DataFrame, k: int = 1000) -> DataFrame:
    """The points of an experiment with p_mrr and the changed side's map and ndcg at k.

    scores: qid, base_qid, query_type, doc, mask, tau (the query's own), s_base, s_neg. Scored once, crossed with the grid."""
    penalty, axes = EXPERIMENTS[name]
    found = points(scores.sparkSession, name)
    og = F.col("query_type") == "og"  # original queries keep their base score: the same at every point
    crossed = scores.where(~og).drop("alpha").crossJoin(F.broadcast(found))
    if "delta" in axes:
        crossed = crossed.withColumn("tau", F.col("tau") + F.col("delta"))
    extra = {a: F.col(a) for a in axes if a not in ("alpha", "delta")}
    keys = ("param_index",)
    config = engine.Config(penalty=penalty)
    after = stash(ranked(engine.final_scores(crossed, config, **extra), "score", (*keys, "qid")), "experiment")
    before = ranked(engine.final_scores(scores.where(og).withColumn("alpha", F.lit(1.0)), config), "score", ("qid",))
    per = engine.evaluate(after, qrels, (k,), keys=keys)
    moved = metrics.p_mrr(engine.changes_between(before, after, diff, keys), keys, "base_qid")
    return found.join(metrics.macro(per, keys, ("map", "ndcg")), "param_index").join(moved, "param_index")


def open_run(queries: DataFrame, documents: DataFrame, name: str, judge: tiles.Judge, k: int = 1000) -> DataFrame:
    """The same where every document is a candidate and whole runs count."""
    penalty, _ = EXPERIMENTS[name]
    found = points(queries.sparkSession, name)
    per = stash(tiles.measures(queries, documents, judge, grid.values(found), (k,), penalty), "experiment")
    return found.join(metrics.macro(per.where("query_type = 'changed'"), ("param_index",), ("map", "ndcg")), "param_index").join(tiles.p_mrr(per), "param_index")


def leaderboard(results: DataFrame, n: int = 10, metric: str = "map") -> DataFrame:
    return results.orderBy(F.desc(metric), "param_index").limit(n)


def passing(results: DataFrame, map_above: float = 0.23, p_mrr_above: float = 0.154) -> DataFrame:
    """Points that beat both published figures (fixed values)."""
    return results.where((F.col("map") > map_above) & (F.col("p_mrr") > p_mrr_above))
