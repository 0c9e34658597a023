"""Training scores and losses as Columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, relu
from .training import info_nce, margin_loss


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def training_scores(pos: Column, neg: Column, alpha: Column, tau: Column, mask: Column | float = 1.0) -> Column:
    """The positive's base score, then each negative's with its penalty; the penalty is of the negative's own base score."""
    mask = F.lit(mask) if isinstance(mask, float) else mask
    return F.concat(F.array(pos), F.transform(neg, lambda s: s - alpha * relu(s - tau) * mask))


def gate_loss(scores: Column, alpha: Column, penalty_pos: Column | float = 0.0, encoder: str = "bge", temperature: float = 0.1, weight: float = 0.0) -> Column:
    """Cross-entropy with the encoder's regulariser: tenfold penalty of positives for the large ones, else weight * alpha squared."""
    penalty_pos = F.lit(penalty_pos) if isinstance(penalty_pos, float) else penalty_pos
    extra = 10.0 * penalty_pos if encoder in ("repllama", "mistral") else weight * alpha * alpha
    return info_nce(scores, temperature) + extra


def pair_margins(scores: Column, margin: float = 0.2) -> Column:
    """Mean hinge of the first score against the others."""
    return _mean(F.transform(F.slice(scores, 2, F.size(scores) - 1), lambda s: margin_loss(F.get(scores, F.lit(0)), s, margin)))


def shield_loss(scores: Column, tau: Column, neg_of_pos: Column, margin: float = 0.2, epsilon: float = 0.05, weight: float = 2.0) -> Column:
    """Ranking hinge plus a charge where the positive's negative-side score comes near the threshold."""
    return pair_margins(scores, margin) + weight * relu(neg_of_pos - tau + epsilon)


def contrast(pairs: DataFrame, margin_pos: float = 0.05, margin_neg: float = 0.3, push: float = 1.4, pull: float = 0.6, orthogonal: float = 0.01, anchor: float = 0.1, keys: tuple[str, ...] = ("batch",)) -> DataFrame:
    """keys, loss_pos, loss_neg, reg_loss, ortho_loss, score_gap, sim_pos, sim_neg and total of each batch.

    pairs: keys, row, q, pos, neg (unit vectors) and, while training, anchors (an array of unit vectors, see anchors()): the
    mean square of the query's products with them is ortho_loss, 0 without any. The projected query is pushed from its own positive and pulled to its own
    negative; the batch's Gram matrix should be the identity. A batch is small by its making; its pairs meet by join.
    """
    square = F.lit(0.0)
    if "anchors" in pairs.columns:
        products = F.transform("anchors", lambda a: dot("q", a))
        square = F.aggregate(products, F.lit(0.0), lambda s, x: s + x * x) / F.size("anchors")
    left = pairs.select(*keys, "row", "q", "pos", "neg", square.alias("_angle"))
    right = pairs.select(*keys, F.col("row").alias("other"), F.col("q").alias("_q"), F.col("neg").alias("_neg"))
    square = left.join(right, list(keys)).select(*keys, "row", (F.col("row") == F.col("other")).alias("own"), dot("q", "_q").alias("gram"), dot("q", "_neg").alias("far"), "_angle", F.when(F.col("row") == F.col("other"), dot("q", "pos")).alias("near"))
    rows = square.groupBy(*keys, "row").agg(F.max("near").alias("sim_pos"), F.max(F.when(F.col("own"), F.col("far"))).alias("sim_neg"), F.max("far").alias("most"), F.avg(F.pow(F.col("gram") - F.col("own").cast("double"), F.lit(2.0))).alias("reg"), F.max("_angle").alias("_angle"))
    out = rows.groupBy(*keys).agg(
        F.avg(relu(F.col("sim_pos") - margin_pos)).alias("loss_pos"), F.avg(relu(margin_neg - F.col("sim_neg"))).alias("loss_neg"), F.avg("reg").alias("reg_loss"), F.avg("_angle").alias("ortho_loss"),
        F.avg(F.col("most") - F.col("sim_pos")).alias("score_gap"), F.avg("sim_pos").alias("sim_pos"), F.avg("sim_neg").alias("sim_neg"),
    )
    return out.withColumn("total", push * F.col("loss_pos") + pull * F.col("loss_neg") + orthogonal * F.col("reg_loss") + anchor * F.col("ortho_loss"))


def anchors(rows: DataFrame, dim: int, seed: int = 42, n: int = 4) -> DataFrame:
    """Rows with anchors: n random unit vectors each, from a hash of seed, row and place (uniform numbers made normal)."""

    def number(i: Column, j: Column, salt: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), "row", i, j), 11).cast("double") + 0.5) / float(1 << 53)

    def normal(i: Column, j: Column) -> Column:
        return F.sqrt(-2 * F.log(number(i, j, 0))) * F.cos(2 * F.lit(3.141592653589793) * number(i, j, 1))

    def unit(i: Column) -> Column:
        v = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda j: normal(i, j))
        size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(v, lambda x: x / size)

    return rows.withColumn("anchors", F.transform(F.sequence(F.lit(1), F.lit(n)), unit))


def interval_summary(rows: DataFrame, keys: tuple[str, ...], loss: str = "loss", penalty: str = "penalty") -> DataFrame:
    """Mean loss and penalty, and the share of rows that a penalty touches."""
    return rows.groupBy(*keys).agg(F.avg(loss).alias("loss"), F.avg(penalty).alias("penalty"), F.avg((F.col(penalty) > 0).cast("double")).alias("active"))


def validation(rows: DataFrame) -> DataFrame:
    """Loss, share of rows whose positive leads all negatives, mean and deviation of alpha and tau; rows: scores, alpha, tau."""
    first = F.get("scores", F.lit(0))
    led = F.forall(F.slice("scores", 2, F.size("scores") - 1), lambda s: s < first)
    return rows.agg(F.avg(info_nce(F.col("scores"))).alias("loss"), F.avg(led.cast("double")).alias("accuracy"), *(f(c).alias(f"{c}_{n}") for c in ("alpha", "tau") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))))
