"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Four measures of a text (symbols per word character, repeated lines per line, repeated words per word, mean word
length) are sketched by logarithmic buckets: a sketch is a table of counts by (lang, source, measure, bucket), two
sketches merge by adding counts, and any quantile is known within GAMMA - 1 of its value. Texts that
pass the fixed base rule are sketched. A group's thresholds are fences FENCE quartile distances beyond its quartiles, or,
as many texts have none of a measure, the upper quantile of the values above zero times FENCE deviations of how often a
text has one (mean included), whichever is farther. A group's quantiles are means of its own and its language's, the
latter with the weight of PRIOR texts, and a language's of its own and those of all texts: a small group leans on its
language, a large one hardly, without a size at which that changes. One occurrence is never decisive: a measure that is
above its fence by one symbol, one line or one pair of windows only passes. Thresholds join the texts by language and
source, and texts outside them, or failing the fixed base rule, are not kept.

Defined results: null and empty texts have no words, fail the base rule and are not kept; null languages and sources
are groups of their own; repeated rows come back as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as T
from .store import stash

BATCH_BYTES = 4 << 20
GAMMA = 1.02
#: Texts that a group's language weighs in the group's quantiles, and all texts in a language's.
PRIOR = 20
#: Fence: quartile plus FENCE times the distance of the quartiles.
FENCE = 3.0
#: Quantile of the values above zero that fences of measures with many zeros come from.
UPPER = 0.95
MEASURES = ("symbols", "lines", "repeats", "length")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def repeated_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that are equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(lines), len(lines) - len(set(lines))


def measures(docs: DataFrame, window: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Base counts of every whole text, with its language and source."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text", BATCH_BYTES):
            data, byte_bounds = T.raw(batch["text"])
            words, bounds = T.split(data, byte_bounds)
            index, distinct = T.codes(words)
            chars = T.row_sums(T.SPACED[data] & ((data & 0xC0) != 0x80), byte_bounds)
            symbols = T.row_sums(_SYMBOL[data], byte_bounds)
            runs = T.Rolling(T.hashes(distinct)[index]).runs(window)
            starts = np.flatnonzero(T.starts_within(bounds, window)[: len(runs)])
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))[starts]
            value = T.mix(runs[starts] + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(value)
            ranked = value[order]
            same = np.zeros(len(ranked) + 1, bool)
            same[1:-1] = ranked[1:] == ranked[:-1]
            twice = np.zeros(len(words), bool)
            twice[starts[order]] = same[1:] | same[:-1]
            repeats = T.row_sums(T.covered(twice, window), bounds)
            lines = [repeated_lines(x or "") for x in batch["text"].to_pylist()]
            columns = [batch["doc_id"], batch["lang"], batch["source"], *map(pa.array, (np.diff(bounds), chars, symbols, [x[1] for x in lines], repeats, [x[0] for x in lines]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    return slim.mapInArrow(count, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")


def ratios(less: int = 0, window: int = 5) -> dict[str, F.Column]:
    """The measures; less=1 leaves out one occurrence of each that counts occurrences."""

    def of(a: str, b: str, one: int = 0) -> F.Column:
        return F.greatest(F.col(a) - less * one, F.lit(0)) / F.greatest(F.col(b), F.lit(1))

    return {"symbols": of("n_symbols", "word_chars", 1), "lines": of("n_dup_lines", "n_lines", 1), "repeats": of("n_repeat_words", "n_words", 2 * window), "length": of("word_chars", "n_words")}


def sketch(rows: DataFrame) -> DataFrame:
    """Counts by lang, source, measure and logarithmic bucket; sketches merge by adding n. Bucket null holds zeros."""
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in ratios().items()))).alias("m")
    bucket = F.when(F.col("m.value") > 0, F.ceil(F.log(F.col("m.value")) / math.log(GAMMA)))
    return rows.where("n_words > 0").select("lang", "source", long).groupBy("lang", "source", F.col("m.measure").alias("measure"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """q1, q2, q3, the number of values, those above zero and their upper quantile, of each sketch, merged by keys and measure."""
    merged = counts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = merged.withColumn("upto", F.sum("n").over(group.orderBy(F.col("bucket").asc_nulls_first()))).withColumn("total", F.sum("n").over(group))
    upto = upto.withColumn("zeros", F.sum(F.when(F.col("bucket").isNull(), F.col("n")).otherwise(0)).over(group))
    value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    q = [F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * p), value)).alias(f"q{i}") for i, p in ((1, 0.25), (2, 0.5), (3, 0.75))]
    above = F.col("bucket").isNotNull() & (F.col("upto") - F.col("zeros") >= F.ceil((F.col("total") - F.col("zeros")) * UPPER))
    return upto.groupBy(*keys, "measure").agg(*q, F.min(F.when(above, value)).alias("upper"), F.max("total").alias("total"), F.max(F.col("total") - F.col("zeros")).alias("above"))


def fences(counts: DataFrame) -> DataFrame:
    """lang, source, and low and high for each measure."""
    own, lang, whole = (quartiles(counts, k) for k in (["lang", "source"], ["lang"], []))
    best = own.alias("o").join(lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.measure") == F.col("l.measure"))).join(F.broadcast(whole.alias("w")), F.col("o.measure") == F.col("w.measure"))

    def of(side: str, q: str) -> F.Column:
        return F.col(f"{side}.above") / F.col(f"{side}.total") if q == "often" else F.coalesce(F.col(f"{side}.{q}"), F.lit(0.0))

    def shrunk(q: str, size: str = "total") -> F.Column:
        upper = (F.col(f"l.{size}") * of("l", q) + PRIOR * of("w", q)) / (F.col(f"l.{size}") + PRIOR)
        return ((F.col(f"o.{size}") * of("o", q) + PRIOR * upper) / (F.col(f"o.{size}") + PRIOR)).alias(q)

    picked = best.select("o.lang", "o.source", "o.measure", *map(shrunk, ("q1", "q3", "often")), shrunk("upper", "above"))
    reach = FENCE * (F.col("q3") - F.col("q1"))
    rare = F.col("upper") * (F.col("often") + FENCE * F.sqrt(F.greatest(F.col("often") * (1 - F.col("often")), F.lit(0.0))))
    picked = picked.withColumn("low", F.col("q1") - reach).withColumn("high", F.greatest(F.col("q3") + reach, rare))
    return picked.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("low", "high")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the thresholds that held, for every row of docs."""
    rows = stash(measures(docs, 5, id_col, text_col, lang_col, source_col), "measures")
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    limits = fences(stash(sketch(rows.where(~base_failed)), "sketch")).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    inside = F.lit(True)
    for m, v in ratios(less=1).items():
        inside = inside & (v <= F.col(f"{m}_high"))
    inside = inside & (ratios()["length"] >= F.col("length_low"))
    out = joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & F.coalesce(inside, F.lit(False))).alias("kept"), *(f"{m}_high" for m in MEASURES), "length_low")
    return out
