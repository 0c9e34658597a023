"""Reports of runs and sweeps: JSON, CSV, Markdown, each as rows first and then as a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sinks

STAMP = "yyyy-MM-dd HH:mm:ss"
#: Columns of the sweep summary after alpha, tau and pMRR (fixed values): measure and cut-off of each side.
SUMMARY = tuple((side, measure, k) for side in ("og", "changed") for measure in ("ndcg", "map") for k in (1, 5, 10, 100))
_NAMES = {"ndcg": "nDCG", "map": "MAP"}


def stamp() -> Column:
    return F.date_format(F.current_timestamp(), STAMP)


def json_lines(rows: DataFrame) -> DataFrame:
    """value: each row as a JSON text, nulls included; texts keep their characters."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def result_report(bundle: DataFrame, task: Column, model: Column, extra: Column | None = None) -> DataFrame:
    """task, model, metrics (a struct) and extra_info of each row of metrics."""
    columns = [task.alias("task"), model.alias("model"), F.struct(*bundle.columns).alias("metrics")]
    return bundle.select(*columns, *([extra.alias("extra_info")] if extra is not None else []))


def write_json(rows: DataFrame, path: str, stamped: bool = True) -> None:
    """Rows as JSON lines, with the time of writing."""
    (rows.withColumn("timestamp", stamp()) if stamped else rows).write.mode("overwrite").json(path)


def summary_report(bundles: DataFrame) -> DataFrame:
    """tasks (a map of each task's p_mrr) and average_p_mrr, 0 without tasks; bundles: task, p_mrr."""
    return bundles.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("task", "p_mrr")))).alias("tasks"), F.coalesce(F.avg("p_mrr"), F.lit(0.0)).alias("average_p_mrr"))


def markdown_report(bundles: DataFrame, model: str, title: str = "# Results") -> DataFrame:
    """place and value: the lines of a report over tasks; bundles: task, p_mrr, og_ndcg_5, changed_ndcg_5."""
    head = [title, "", f"**Model**: {model}", "", "| Task | p-MRR | og nDCG@5 | changed nDCG@5 |", "|------|-------|-----------|----------------|"]
    first = bundles.sparkSession.createDataFrame(list(enumerate(head)), "place long, value string")
    numbers = [F.format_string("%.4f", c) for c in ("p_mrr", "og_ndcg_5", "changed_ndcg_5")]
    body = bundles.select(F.lit(len(head)).cast("long").alias("place"), sinks.markdown_row(F.col("task"), *numbers).alias("value"))
    last = bundles.agg(F.lit(len(head) + 1).cast("long").alias("place"), F.format_string("**Average p-MRR**: %.4f", F.coalesce(F.avg("p_mrr"), F.lit(0.0))).alias("value"))
    return first.unionByName(body).unionByName(last)


def write_markdown(lines: DataFrame, path: str) -> None:
    lines.orderBy("place", "value").coalesce(1).select("value").write.mode("overwrite").text(path)


def grid_report(results: DataFrame, metric: str = "p_mrr") -> DataFrame:
    """Every point, whether it is the best, and its place by the metric."""
    best = results.orderBy(F.desc(metric), "param_index").limit(1).select(F.col("param_index").alias("_best"))
    return results.crossJoin(F.broadcast(best)).withColumn("best", F.col("param_index") == F.col("_best")).drop("_best")


def parameter_summary(results: DataFrame, places: int = 6) -> DataFrame:
    """The 19 columns of a sweep's summary as texts; measures that a point lacks are 0."""
    def text(name: str) -> Column:
        value = F.col(name) if name in results.columns else F.lit(0.0)
        return F.format_string(f"%.{places}f", F.coalesce(value.cast("double"), F.lit(0.0)))

    named = [text(f"{s}_{m}_{k}").alias(f"{s}_{_NAMES[m]}{k}") for s, m, k in SUMMARY]
    return results.select(F.col("alpha"), F.col("tau"), text("p_mrr").alias("pMRR"), *named)


#: What a parameter is called in a report where that is not its column's name (fixed value).
_AXIS = {"lam": "lambda"}
GRID_MEASURES = ("p_mrr", "og_ndcg@5", "changed_ndcg@5", "og_mrr", "changed_mrr")


def grid_rows(results: DataFrame, axes: tuple[str, ...], k: int = 5) -> DataFrame:
    """param_index, a grid's parameters and GRID_MEASURES by their report names; the reciprocal ranks are those at the largest cut-off there is."""
    cuts = {side: max((int(c.rsplit("_", 1)[1]) for c in results.columns if c.startswith(f"{side}_mrr_")), default=None) for side in ("og", "changed")}
    found = {"p_mrr": "p_mrr", "og_ndcg@5": f"og_ndcg_{k}", "changed_ndcg@5": f"changed_ndcg_{k}"} | {f"{s}_mrr": f"{s}_mrr_{c}" for s, c in cuts.items()}
    return results.select("param_index", *(F.col(a).alias(_AXIS.get(a, a)) for a in axes), *((F.col(found[m]) if found[m] in results.columns else F.lit(0.0)).alias(m) for m in GRID_MEASURES))


def grid_lines(results: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """param_index (-1: the heading) and line of a grid's CSV report, numbers with four places."""
    rows = grid_rows(results, axes)
    names = rows.columns[1:]
    head = results.sparkSession.createDataFrame([(-1, ",".join(names))], "param_index long, line string")
    return head.unionByName(rows.select("param_index", F.concat_ws(",", *(F.format_string("%.4f", F.col(f"`{n}`").cast("double")) for n in names)).alias("line")))


def grid_record(results: DataFrame, axes: tuple[str, ...], **fixed: float) -> DataFrame:
    """A grid's JSON report as one row: the values of each parameter, what was fixed, and all results in order. A grid is a handful of rows."""
    rows = grid_rows(results, axes)
    listed = F.sort_array(F.collect_list(F.struct("param_index", F.struct(*(F.col(f"`{n}`") for n in rows.columns[1:])).alias("r"))))
    lists = [F.sort_array(F.collect_set(F.col(_AXIS.get(a, a)))).alias(f"{_AXIS.get(a, a)}_list") for a in axes]
    return rows.agg(*lists, F.transform(listed, lambda x: x.r).alias("results")).select(*(f"{_AXIS.get(a, a)}_list" for a in axes), *(F.lit(v).alias(n) for n, v in fixed.items()), "results")


def full_record(results: DataFrame, best: DataFrame, axes: tuple[str, ...], mode: str | None = None) -> DataFrame:
    """The whole record of a search as one row: best_params, best_metrics, all_results, and the mode where a gate sets the parameters.

    The measures of every query go beside it, one line each (save_search): their number grows with the queries."""
    everything = grid_record(results, axes).select(F.col("results").alias("all_results"))
    measures = [c for c in best.columns if c not in ("param_index", "total", *axes)]
    chosen = best.select(F.struct(*axes).alias("best_params"), *([F.lit(mode).alias("mode")] if mode else []), F.struct(*measures).alias("best_metrics"))
    return chosen.crossJoin(everything)


def save_search(results: DataFrame, best: DataFrame, per: DataFrame, axes: tuple[str, ...], folder: str, name: str, mode: str | None = None, **fixed: float) -> None:
    """A search's files: the full record, every query's measures, and the grid's JSON and CSV reports."""
    write_json(full_record(results, best, axes, mode), f"{folder}/random_search_results")
    write_json(per, f"{folder}/all_query_metrics")
    write_json(grid_record(results, axes, **fixed), f"{folder}/{name}_grid_search_results")
    grid_lines(results, axes).coalesce(1).sortWithinPartitions("param_index").select("line").write.mode("overwrite").text(f"{folder}/{name}_grid_search_results_csv")


def metric_summary(bundle: DataFrame) -> DataFrame:
    """pMRR and the original queries' nDCG and MAP at each cut-off of the bundle, by their report names."""
    own = [c for c in bundle.columns if c.startswith(("og_ndcg_", "og_map_"))]
    return bundle.select(F.col("p_mrr").alias("pMRR"), *(F.col(c).alias(_NAMES[c.split("_")[1]] + c.split("_")[2]) for c in own))


def parameter_analysis(scores: DataFrame) -> DataFrame:
    """qid, query_type, query, instruction, alpha, tau, is_none: one row for each query; original queries have zeros."""
    og = F.col("query_type") == "og"
    return scores.select("base_qid", "query_type", "query", "instruction", *(F.when(og, 0.0).otherwise(F.col(c)).alias(c) for c in ("alpha", "tau")), (~og & (F.col("q_minus") == "[NONE]")).alias("is_none"))


def parameter_statistics(analysis: DataFrame) -> DataFrame:
    """Mean, population deviation, least and most of alpha and tau over changed queries with a constraint."""
    rows = analysis.where("query_type = 'changed' and not is_none")
    return rows.agg(*(f(c).alias(f"{c}_{n}") for c in ("alpha", "tau") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))))


def case_lines(cases: DataFrame) -> DataFrame:
    """place and value: Markdown of cases (case, q, doc, rank_before, rank_after), a heading for each group."""
    heads = cases.select("case").distinct().select(F.struct("case", F.lit(0).alias("n"), F.lit("").alias("q")).alias("place"), F.concat(F.lit("## Group "), "case").alias("value"))
    ranks = F.format_string("- query %s: document %s, rank %d to %d", F.col("q").cast("string"), F.col("doc").cast("string"), F.col("rank_before"), F.col("rank_after"))
    return heads.unionByName(cases.select(F.struct("case", F.lit(1).alias("n"), F.col("q").cast("string").alias("q")).alias("place"), ranks.alias("value")))


def victim_report(victims: DataFrame, scores: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """context, victim_doc and physics of each victim as nested structs.

    victims: q, doc, rank_before, rank_after; scores: q, doc, sb, sn, tau, alpha, mask; queries: q and texts; documents: doc, text.
    """
    joined = victims.join(scores, ["q", "doc"]).join(queries, "q").join(documents, "doc", "left")
    texts = [c for c in queries.columns if c != "q"]
    penalty = F.col("alpha") * F.greatest(F.col("sn") - F.col("tau"), F.lit(0.0)) * F.col("mask")
    return joined.select(
        F.struct(F.col("q").alias("query_id"), *texts).alias("context"), F.struct("doc", F.coalesce(F.substring("text", 1, 200), F.lit("")).alias("text")).alias("victim_doc"),
        F.struct("rank_before", "rank_after", F.col("sb").alias("score_base"), F.col("sn").alias("score_neg"), "tau", "alpha", penalty.alias("final_penalty")).alias("physics"),
    )


def save_run(run: DataFrame, bundle: DataFrame, folder: str, task: str, model: str) -> None:
    """A run's files: original and changed ranks, and the report."""
    for kind in ("og", "changed"):
        side = run.where(F.col("query_type") == kind).select("qid", F.col("doc").cast("string").alias("doc_id"), "rank", "score")
        sinks.write_trec(side, f"{folder}/run_{kind}", model)
    write_json(result_report(bundle, F.lit(task), F.lit(model)), f"{folder}/results_{task}")
