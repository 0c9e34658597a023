"""Parameter grids: points, sweeps in one plan, resume and choice of the best."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..sources.shared import stash
from ..sources.sinks import append_results
from .ranking import last_wins

#: Preset sweeps, fixed values: strengths and thresholds, every pair of them.
PRESETS = {
    "conservative": ((0.5, 0.8, 1.0), (0.50, 0.55, 0.60)),
    "balanced": ((0.8, 1.0, 1.2), (0.45, 0.50, 0.55)),
    "aggressive": ((1.0, 1.2, 1.5), (0.40, 0.45, 0.50)),
    "fine_grained": ((0.6, 0.8, 1.0, 1.2), (0.40, 0.45, 0.50, 0.55)),
    "repllama_25": ((0.5, 0.8, 1.2, 1.5, 2.0), (0.50, 0.60, 0.70, 0.80, 0.90)),
}


def points(spark: SparkSession, **axes: tuple[float, ...]) -> DataFrame:
    """param_index and one column per axis, the first axis slowest."""
    rows = [(i, *map(float, p)) for i, p in enumerate(product(*axes.values()))]
    return spark.createDataFrame(rows, "param_index long, " + ", ".join(f"{a} double" for a in axes))


def preset(spark: SparkSession, name: str = "balanced") -> DataFrame:
    if name not in PRESETS:
        raise ValueError(f"unknown grid {name!r}; known: {', '.join(PRESETS)}")
    alphas, taus = PRESETS[name]
    return points(spark, alpha=alphas, tau=taus)


def values(points: DataFrame) -> list[dict]:
    """A grid's points by the names that penalties take: a handful of rows. gamma without a threshold of its own is a number of deviations."""
    names = {"tau_base": "tau0"} | ({} if "delta" in points.columns else {"gamma": "spread"})
    return [{names.get(k, k): v for k, v in r.asDict().items()} for r in points.orderBy("param_index").collect()]


def sampled(grid: DataFrame, n: int, seed: int) -> DataFrame:
    """n points in a fixed random order."""
    return grid.orderBy(F.xxhash64(F.lit(seed), "param_index"), "param_index").limit(n)


def completed(results: DataFrame) -> DataFrame:
    return last_wins(results, ("param_index",), F.col("written_at"))


def remaining(grid: DataFrame, results: DataFrame) -> DataFrame:
    """Points without a result yet."""
    return grid.join(results.select("param_index").distinct(), "param_index", "left_anti")


def run_resumable(grid: DataFrame, run: Callable[[DataFrame], DataFrame], path: str, chunk: int = 8) -> tuple[DataFrame, DataFrame]:
    """Results and errors of a grid's points, run in chunks that are committed apart.

    run: points -> a row for each, with param_index. Points that have a result at path are skipped. A chunk that fails is run
    again point by point, so that one bad point keeps no other from its result; a point that fails alone is an error row (its
    own folder beside path), and is tried again next time. A grid is a handful of points, and these are what the driver holds.
    """
    spark, errors = grid.sparkSession, f"{path.rstrip('/')}-errors"
    schema = S.StructType([f for f in grid.schema.fields if f.name == "param_index"])
    done = spark.read.parquet(path) if _there(spark, path) else spark.createDataFrame([], schema)
    left = [r.param_index for r in remaining(grid, done).select("param_index").orderBy("param_index").collect()]
    queue = [left[i : i + chunk] for i in range(0, len(left), chunk)]
    while queue:
        some = queue.pop(0)
        try:
            append_results(stash(run(grid.where(F.col("param_index").isin(some))), "chunk"), path)
        except Exception as e:
            if len(some) > 1:
                queue = [[i] for i in some] + queue
                continue
            spark.createDataFrame([(some[0], f"{type(e).__name__}: {str(e)[:500]}")], "param_index long, error string").withColumn("failed_at", F.current_timestamp()).write.mode("append").parquet(errors)
    results = completed(spark.read.parquet(path)) if _there(spark, path) else spark.createDataFrame([], schema)
    failed = spark.read.parquet(errors) if _there(spark, errors) else spark.createDataFrame([], "param_index long, error string, failed_at timestamp")
    return results, last_wins(failed, ("param_index",), F.col("failed_at")).join(results.select("param_index"), "param_index", "left_anti")


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def best(results: DataFrame, metric: str, n: int = 1) -> DataFrame:
    """The first of the best points."""
    return results.orderBy(F.desc(metric), F.asc("param_index")).limit(n)
