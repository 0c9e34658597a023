"""Retrieval metrics over ranked runs, all cut-offs in one aggregation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import rank_score


def _log2(rank: Column) -> Column:
    return F.log2(rank + 1)


def per_query(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...], keys: tuple[str, ...] = ("q",), binary: str = "positive") -> DataFrame:
    """keys, k, ndcg (linear gain), ndcg_binary, map (all relevant), map_cut (at most k relevant), mrr, recall.

    run: keys, doc, rank; qrels: keys, doc, rel. Relevant is rel > 0, or with binary="present" any judged document
    for the binary measures. Queries without relevant documents get zeros.
    """
    relevant = F.col("rel") > 0
    judged = F.col("rel").isNotNull() if binary == "present" else relevant
    # Everything below the largest cut-off is all that any measure needs, running sums included.
    joined = run.where(F.col("rank") <= max(ks)).join(qrels, [*keys, "doc"], "left").withColumn("gain", F.when(relevant, F.col("rel").cast("double")).otherwise(0.0)).withColumn("hit", F.when(judged, 1.0).otherwise(0.0))
    upto = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = joined.withColumn("precision", F.sum("hit").over(upto) / F.col("rank"))
    cut = F.explode(F.array(*map(F.lit, ks))).alias("k")
    rows = joined.select(*keys, "rank", "gain", "hit", "precision", cut).where(F.col("rank") <= F.col("k"))
    got = rows.groupBy(*keys, "k").agg(
        F.sum(F.col("gain") / _log2(F.col("rank"))).alias("dcg"),
        F.sum(F.col("hit") / _log2(F.col("rank"))).alias("dcg_binary"),
        F.sum(F.col("hit") * F.col("precision")).alias("precisions"),
        F.min(F.when(F.col("hit") > 0, F.col("rank"))).alias("first"),
        F.sum("hit").alias("hits"),
    )
    best = Window.partitionBy(*keys).orderBy(F.desc("rel"), F.asc("doc"))
    ideal_rows = qrels.where(judged).withColumn("place", F.row_number().over(best)).select(*keys, "place", F.greatest(F.col("rel"), F.lit(0)).cast("double").alias("rel"), cut)
    ideal = ideal_rows.groupBy(*keys, "k").agg(
        F.sum(F.when(F.col("place") <= F.col("k"), F.col("rel") / _log2(F.col("place"))).otherwise(0.0)).alias("idcg"),
        F.sum(F.when(F.col("place") <= F.col("k"), 1 / _log2(F.col("place"))).otherwise(0.0)).alias("idcg_binary"),
        F.count("*").alias("n_rel"),
    )
    both = got.join(ideal, [*keys, "k"], "left")

    def over(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return both.select(
        *keys, F.col("k").cast("long").alias("k"), over(F.col("dcg"), F.col("idcg")).alias("ndcg"), over(F.col("dcg_binary"), F.col("idcg_binary")).alias("ndcg_binary"),
        over(F.col("precisions"), F.col("n_rel")).alias("map"), over(F.col("precisions"), F.least(F.col("n_rel"), F.col("k"))).alias("map_cut"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), over(F.col("hits"), F.col("n_rel")).alias("recall"),
    )


def of_places(ranks: np.ndarray, rel: np.ndarray, ks: tuple[int, ...], binary: str = "positive") -> dict[int, dict[str, float]]:
    """The same measures by cut-off for one query, from the ranks and grades of all its judged documents."""
    hit = np.ones(len(rel), bool) if binary == "present" else rel > 0
    order = np.argsort(ranks[hit], kind="stable")
    at, gain = ranks[hit][order].astype(float), np.maximum(rel[hit], 0)[order].astype(float)
    best, place = -np.sort(-gain), np.arange(1.0, len(gain) + 1)
    sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (gain / np.log2(at + 1), 1 / np.log2(at + 1), place / at, best / np.log2(place + 1), 1 / np.log2(place + 1))]
    n, out = len(at), {}
    for k in ks:
        hits, ideal = int(np.searchsorted(at, k, "right")), min(n, k)
        dcg, dcg_binary, precisions = (float(s[hits]) for s in sums[:3])
        idcg, idcg_binary = (float(s[ideal]) for s in sums[3:])
        out[k] = {"ndcg": dcg / idcg if idcg > 0 else 0.0, "ndcg_binary": dcg_binary / idcg_binary if n else 0.0, "map": precisions / n if n else 0.0, "map_cut": precisions / ideal if n else 0.0, "mrr": float(1 / at[0]) if hits else 0.0, "recall": hits / n if n else 0.0}
    return out


def rank_changes(og_run: DataFrame, new_run: DataFrame, diff: DataFrame, keys: tuple[str, ...] = ("q",)) -> DataFrame:
    """keys, doc, og_rank, new_rank, change for each document of diff; a document outside a run ranks behind its last.

    A key that the original run or diff lacks (a grid point, where only the new run depends on it) holds for all its values."""

    def placed(run: DataFrame, name: str) -> DataFrame:
        own = [k for k in keys if k in run.columns]
        sizes = run.groupBy(*own).agg(F.max("rank").alias("n"))
        rows = diff.join(sizes, [k for k in own if k in diff.columns]).join(run.select(*own, "doc", "rank"), [*own, "doc"], "left")
        return rows.select(*own, "doc", F.coalesce(F.col("rank"), F.col("n") + 1).alias(name))

    before, after = placed(og_run, "og_rank"), placed(new_run, "new_rank")
    both = before.join(after, [c for c in (*keys, "doc") if c in before.columns and c in after.columns])
    return both.withColumn("change", rank_score(F.col("og_rank"), F.col("new_rank")))


def p_mrr(changes: DataFrame, group: tuple[str, ...] = (), query: str = "q") -> DataFrame:
    """Mean change by query, then over queries."""
    each = changes.groupBy(*group, query).agg(F.avg("change").alias("change"))
    return each.groupBy(*group).agg(F.avg("change").alias("p_mrr"), F.count("*").alias("n_queries"))


def macro(per: DataFrame, group: tuple[str, ...], measures: tuple[str, ...] = ("ndcg", "map", "mrr")) -> DataFrame:
    return per.groupBy(*group).agg(*(F.avg(m).alias(m) for m in measures))
