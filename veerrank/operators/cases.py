"""Extreme queries and the documents that show why: classes of queries, a choice of them, and groups of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import first_term_in, negative_terms, strip
from .ranking import first_wins

#: Words that negate, and words that name an entity (fixed values).
NEGATIONS = ("not", "no", "without", "except", "除了", "不要", "非", "无")
ENTITIES = ("病", "癌", "基因", "细胞", "蛋白", "病毒", "遗传", "突", "转基因", "cancer", "gene", "protein", "virus", "genetic", "mutant")
#: Classes in the order in which queries are chosen.
CLASSES = ("high_noise", "low_noise", "entity_entangled", "logical_negation")


def _holds_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))


def negates_only(terms: Column) -> Column:
    """All terms hold a negation; true without terms."""
    return F.forall(terms, lambda t: _holds_any(t, NEGATIONS))


def query_classes(queries: DataFrame, high: float = 0.65, low: float = 0.55) -> DataFrame:
    """q and class, a row for each class that a query is in. queries: q, noise (mean score), query, q_minus ([NONE] for none)."""
    terms = F.when(F.col("q_minus") == "[NONE]", F.array().cast("array<string>")).otherwise(negative_terms(F.col("q_minus")))
    rows = queries.withColumn("terms", F.coalesce(terms, F.array().cast("array<string>")))
    some = F.size("terms") > 0
    marks = {
        "high_noise": F.col("noise") > high, "low_noise": (F.col("noise") > 0) & (F.col("noise") < low),
        "entity_entangled": some & _holds_any(F.col("query"), ENTITIES), "logical_negation": some & negates_only(F.col("terms")),
    }
    named = F.array(*(F.when(m, F.struct(F.lit(i).alias("place"), F.lit(n).alias("class"))) for i, (n, m) in enumerate(marks.items())))
    return rows.select("q", F.explode(F.filter(named, lambda x: x.isNotNull())).alias("c")).select("q", "c.place", "c.class")


def chosen(classes: DataFrame, most: int = 8) -> DataFrame:
    """At most `most` (q, class): the first query of each class in the order of classes, then the rest, none twice."""
    first = F.row_number().over(Window.partitionBy("class").orderBy("q"))
    rows = classes.withColumn("turn", F.when(first == 1, 0).otherwise(1))
    heads = rows.where("turn = 0")
    rest = rows.where("turn = 1").join(heads.select("q").distinct(), "q", "left_anti")
    return heads.unionByName(rest).orderBy("turn", "place", "q").limit(most).select("q", "class")


def negative_hits(run: DataFrame, q_minus: DataFrame, documents: DataFrame, qrels: DataFrame, depth: int = 50, snippet: int = 200) -> DataFrame:
    """q, doc, rank, relevant, neg_word and snippet of returned documents that hold one of their query's negative terms."""
    terms = q_minus.where("q_minus <> '[NONE]'").select("q", negative_terms(F.col("q_minus")).alias("terms")).where(F.size("terms") > 0)
    joined = run.where(F.col("rank") <= depth).join(terms, "q").join(documents.select("doc", "text"), "doc").join(qrels.select("q", "doc", "rel"), ["q", "doc"], "left")
    found = joined.withColumn("neg_word", first_term_in(F.col("terms"), F.col("text"))).where("neg_word is not null")
    return found.select("q", "doc", "rank", (F.coalesce("rel", F.lit(0)) > 0).alias("relevant"), "neg_word", F.substring("text", 1, snippet).alias("snippet"))


def groups(hits: DataFrame, before: DataFrame, after: DataFrame, qrels: DataFrame, near: int = 10, far: int = 20) -> DataFrame:
    """case, q, doc, rank_before, rank_after.

    A: irrelevant documents with a negative term that fell behind `far`; B: such that stayed within `near`; C: relevant
    documents that fell from `near` behind `far`; D: relevant documents that rose into `near`. The first of each query.
    """
    ranks = before.select("q", "doc", F.col("rank").alias("rank_before")).join(after.select("q", "doc", F.col("rank").alias("rank_after")), ["q", "doc"])
    bad = ranks.join(hits.where("not relevant").select("q", "doc"), ["q", "doc"])
    good = ranks.join(qrels.where("rel > 0").select("q", "doc"), ["q", "doc"])
    fell, kept, rose = F.col("rank_after") > far, F.col("rank_after") <= near, (F.col("rank_before") > near) & (F.col("rank_after") <= near)
    high = F.col("rank_before") <= near
    rows = None
    for case, side, when in (("A", bad, high & fell), ("B", bad, high & kept), ("C", good, high & fell), ("D", good, rose)):
        part = side.where(when).withColumn("case", F.lit(case))
        rows = part if rows is None else rows.unionByName(part)
    return first_wins(rows, ("case", "q"), F.struct("rank_before", "doc")).select("case", "q", "doc", "rank_before", "rank_after")


def has_long_word(terms: Column, letters: int = 4) -> Column:
    """Some term has a word of that many letters."""
    return F.exists(terms, lambda t: F.exists(F.split(strip(t), r"\s+"), lambda w: F.length(w) >= letters))
