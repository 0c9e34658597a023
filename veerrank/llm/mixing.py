"""Mixing sources to target weights by Pareto order sampling.

Each source gets a share of `factor` times all sizes by its weight, but no more than `most` times its own size; what is
over goes to the others by weight until none is above. Within a source, documents have unequal expected copies: in
proportion to their weight (by default size to the power of -length_power, so that a few long documents do not fill a
source), scaled so that they add up to the target, and `most` at the most. A document gets the whole part of its expected
copies for certain. The rest is sampled: documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), where p is the fractional part of the expected copies, and are taken in that order until
the source's remaining words are filled, each taken if that comes nearer to them: a sample of fixed size in words.

Nothing is sorted by source in one task: sources are numbered by prefix, the shares come from running sums over sources in the order in which they fill up, scales
from sums by weight class, and the order's cut from sums by fine buckets of rank, of which only the one that holds the cut
is sorted. u comes from a hash of seed, id and text, so reruns agree.

Defined results: null and empty texts have size 0, take nothing and come back; null sources are one source, last in
order; rows alike in id and text share their random number, and their number in the cut decides; an empty table gives
no rows; a null weight counts as 1, one of zero or below as never taken; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import stash

#: Rank buckets of a source.
BUCKETS = 65_536
#: Weight classes to a doubling of the weight.
CLASSES = 16
#: Most sources whose table is broadcast; with more, it is joined by a shuffle, where adaptive execution parts hot sources.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...], factor: float, most: float) -> DataFrame:
    """source, source_size, target; sizes: a row for each source."""
    prefix = F.coalesce(F.substring("source", 1, 2), F.lit(""))
    blocks = sizes.groupBy(F.col("source").isNull().alias("last"), prefix.alias("prefix")).agg(F.count("*").alias("n"))
    blocks = blocks.withColumn("before", F.sum("n").over(Window.orderBy("last", "prefix")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("last", "prefix").orderBy("source")) - 1
    numbered = sizes.withColumns({"last": F.col("source").isNull(), "prefix": prefix}).withColumn("place", place).join(blocks, ["last", "prefix"])
    weight = F.get(F.array(*map(F.lit, map(float, weights))), ((F.col("place") + F.col("before")) % len(weights)).cast("int"))
    table = stash(numbered.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("limit")), "sources")
    unit = _unit(table, factor)
    above = F.col("weight") * unit >= F.col("limit")
    return table.select("source", "source_size", F.when(above, F.col("limit")).otherwise(F.col("weight") * unit).alias("target"))


def _unit(table: DataFrame, factor: float) -> float:
    """Words for a weight of one, when sources that reach their limit get that and the others share the rest by weight.

    Sources fill up in the order of limit over weight. If the first so many of them are full, the others get
    (all - their limits) / (all weights - theirs); with too few or too many taken to be full that is too little, so the
    largest such share is the one that holds. Running sums go over range partitions, and over one row for each of those.
    """
    whole = table.agg(F.sum("source_size"), F.sum("weight")).first()
    if not whole[0]:
        return 0.0
    words, weights = factor * whole[0], float(whole[1])
    order = ("full", "source")
    sorted_ = table.select("source", "limit", "weight", (F.col("limit") / F.col("weight")).alias("full")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stash(sorted_.select("limit", "weight", F.monotonically_increasing_id().alias("at")), "filling").withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("part").agg(F.sum("limit").alias("l"), F.sum("weight").alias("w"))
    before = [(F.sum(c).over(Window.orderBy("part")) - F.col(c)).alias(f"{c}_before") for c in ("l", "w")]
    upto = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.select("part", F.sum("limit").over(upto).alias("l_upto"), F.sum("weight").over(upto).alias("w_upto")).join(parts.select("part", *before), "part")
    rest = weights - F.col("w_before") - F.col("w_upto")
    share = (words - F.col("l_before") - F.col("l_upto")) / rest
    best = running.where(rest > 0).agg(F.max(share)).first()[0]
    return max(words / weights, best) if best is not None else words / weights


def scales(rows: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """source, scale: expected copies are least(most, scale * weight), and with sizes they add up to the source's target."""
    kind = F.floor(F.log2("weight") * CLASSES)
    sums = rows.where("weight > 0 and size > 0").groupBy("source", kind.alias("class")).agg(F.sum("size").alias("n"), F.sum(F.col("size") * F.col("weight")).alias("weighted"), F.max("weight").alias("heaviest"))
    down = Window.partitionBy("source").orderBy(F.desc("class"))
    rest = down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sums = sums.withColumns({"capped": F.sum("n").over(down) - F.col("n"), "weighted": F.sum("weighted").over(rest)})
    sums = sums.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    # The heavier classes have `most` copies each; of the ways to part them, the first whose rest stays within it.
    scale = F.greatest(F.col("target") - most * F.col("capped"), F.lit(0.0)) / F.col("weighted")
    fits = sums.withColumn("scale", scale).withColumn("fits", F.col("scale") * F.col("heaviest") <= most * 2.0 ** (1 / CLASSES))
    return fits.groupBy("source").agg(F.coalesce(F.max_by("scale", F.when(F.col("fits"), F.col("class"))), F.max("scale")).alias("scale"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), factor: float = 1.5, most: float = 2.0, length_power: float = 0.25, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, expected (copies), u, copies, taken (copies * size) for every row; weight: a Column of docs that takes the place of size ** -length_power."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), text), 11).cast("double") + 0.5) / float(1 << 53)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), u.alias("u"), (F.lit(None) if weight is None else weight).cast("double").alias("weight"))
    by_size = F.pow(F.greatest("size", F.lit(1)).cast("double"), F.lit(-length_power)) if weight is None else F.lit(1.0)
    rows = stash(slim.withColumn("weight", F.coalesce("weight", by_size)), "mix")
    plan = stash(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, factor, most), "targets")
    small = F.broadcast if plan.count() <= BROADCAST_SOURCES else (lambda df: df)

    def by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        return left.join(small(right.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")), how).drop("of")

    scale = stash(scales(rows, plan, most), "scales")
    joined = by_source(by_source(rows, plan), scale, "left")
    expected = F.when((F.col("size") > 0) & (F.col("weight") > 0), F.least(F.lit(float(most)), F.coalesce("scale", F.lit(0.0)) * F.col("weight"))).otherwise(0.0)
    joined = joined.withColumn("expected", expected).withColumn("whole", F.floor(F.col("expected") + 1e-12)).withColumn("part", F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0)))
    # A rank's bucket: rank / (1 + rank) is even enough over the unit interval.
    rank = (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))
    joined = joined.withColumn("rank", F.when(F.col("part") > 0, rank)).withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS).cast("int"))
    sums = joined.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.sum(F.col("whole") * F.col("size")).alias("whole"))
    left = by_source(sums.groupBy("source").agg(F.sum("whole").alias("whole")), plan).select("source", F.greatest(F.col("target") - F.col("whole"), F.lit(0.0)).alias("left"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
    # Whole buckets below the cut are taken; the one that the cut falls into is sorted.
    cut = by_source(sums.where("bucket is not null").withColumn("upto", upto), left).where("upto > left").groupBy("source", "left").agg(F.min(F.struct("bucket", "upto", "n")).alias("c"))
    cut = stash(cut.select("source", "left", F.col("c.bucket").alias("cut"), (F.col("c.upto") - F.col("c.n")).alias("before")), "cuts")
    with_cut = by_source(joined, cut, "left")
    edge = F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
    running = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = with_cut.where(edge).withColumn("extra", (F.col("before") + running - F.col("size") / 2 <= F.col("left")).cast("long"))
    outer = with_cut.where(~edge).withColumn("extra", (F.col("bucket").isNotNull() & (F.col("cut").isNull() | (F.col("bucket") < F.col("cut")))).cast("long"))
    out = inner.unionByName(outer).withColumn("copies", F.col("whole").cast("long") + F.col("extra"))
    return out.select("doc_id", "source", "size", "source_size", "target", "expected", "u", "copies", (F.col("copies") * F.col("size")).alias("taken"))
