"""Hard negatives of anchors, by exact search over one-dimensional distance keys.

Whole-number vectors are stored in the order of (pivot, distance to it). An anchor's positives are searched in annuli around the
pivots until the bound of what is left certifies the first of its own label. Then each positive opens a window of scores,
and the same scan, widening from the window's nearest distance, certifies the first rows of other labels inside it. One
visit serves all windows of an anchor.

Defined results: rows with a null label, a null vector or any null or non-finite component take no part; null ids are no
anchors and come last in ties; shorter vectors are as if zeros followed; repeated rows are rows of their own; an anchor
without positives, or a positive without negatives, gives no rows; an empty table gives none; other columns are ignored. Scores
are whole numbers below 2**53; vectors whose squared norm is not raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import nearest


def usable(vectors: DataFrame, scale: int, turned: int, labels: int, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label and x of the rows that take part; the label of every id divisible by `turned` is the next of `labels`."""
    x, number = F.col(vec_col).cast("array<double>"), F.col(id_col).cast("long")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.when(number % turned == 0, (F.col(label_col) + 1) % labels).otherwise(F.col(label_col)).cast("long")
    kept = vectors.where(F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    return kept.select(number.alias("id"), label.alias("label"), F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("x"))


def _share(score: Column, percent: int, up: bool) -> Column:
    """The floor or ceiling of so many hundredths of a whole score."""
    whole = F.lit(-percent if up else percent) * score
    floor = F.floor((whole - F.pmod(whole, F.lit(100))) / 100)
    return (-floor if up else floor).cast("double")


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256, turned: int = 7, labels: int = 10, products: list[int] | None = None, **columns: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor (ids divisible by
    `every`) and each of its first positives the first rows of other labels that score `least` to `most` hundredths of it."""
    index = nearest.build(usable(vectors, scale, turned, labels, **columns))
    if index.directory.largest >= 1 << 53:
        raise ValueError("the products of these vectors would not be exact")
    anchors = nearest.rows_of(index, lambda ids: ids % every == 0)
    alike = nearest.search(index, anchors, positives, same=True, products=products)
    score = F.col("score").cast("long")
    near = alike.select("uid", (F.col("rank") - 1).alias("window"), "anchor", F.col("id").alias("positive_id"), score.alias("positive_score"), _share(score, most, False).alias("high"), _share(score, least, True).alias("low"))
    windows = near.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("window", "high", "low"))).alias("w"))  # at most `positives` each
    opened = anchors.drop("high", "low").join(windows, "uid").withColumns({"high": F.col("w.high"), "low": F.col("w.low")}).drop("w")
    found = nearest.search(index, opened.select(anchors.columns), negatives, same=False, products=products)
    hits = found.select("uid", "window", "rank", F.col("id").alias("negative_id"), F.col("score").cast("long").alias("negative_score"))
    return near.join(hits, ["uid", "window"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
