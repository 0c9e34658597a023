"""Keys, masks and texts of queries and documents as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import l2

NONE = "[NONE]"
#: White space that ends of texts are cleared of, as in Unicode's definition.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.trim(text, F.lit(_BLANKS))


def base_qid(qid: Column) -> Column:
    return F.regexp_replace(qid, "-og|-changed", "")


def query_type(qid: Column) -> Column:
    """og, changed, or null for any other suffix."""
    return F.when(qid.endswith("-og"), "og").when(qid.endswith("-changed"), "changed")


def numeric_id(qid: Column) -> Column:
    return F.coalesce(F.split(qid, "-")[0].try_cast("bigint"), F.lit(0))


def query_text(query: Column, instruction: Column) -> Column:
    return strip(F.concat_ws(" ", query, F.coalesce(instruction, F.lit(""))))


def document_text(title: Column, body: Column) -> Column:
    return F.when(title.isNotNull() & (title != "") & (title != "None"), F.concat_ws(" ", title, body)).otherwise(body)


def mask_strict(q: Column) -> Column:
    """0 where the negative text is null, blank or any spelling of none."""
    return F.when(q.isNull() | F.upper(strip(q)).isin("", "[NONE]", "NONE", "NULL", "N/A"), 0.0).otherwise(1.0)


def mask_marker(q: Column) -> Column:
    """0 for null or the marker in any case; a blank text counts as a constraint."""
    return F.when(q.isNull() | (F.upper(q) == NONE), 0.0).otherwise(1.0)


def mask_blank(q: Column) -> Column:
    return F.when(q.isNull() | (q == NONE) | (strip(q) == ""), 0.0).otherwise(1.0)


def mask_exact(q: Column) -> Column:
    return F.when(F.coalesce(q == NONE, F.lit(False)), 0.0).otherwise(1.0)


def mask_vector(v: Column) -> Column:
    """0 for a zero vector."""
    return F.when(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))) > 0, 1.0).otherwise(0.0)


def negative_terms(q: Column) -> Column:
    """Comma-separated terms, trimmed, blanks left out."""
    return F.filter(F.transform(F.split(q, ","), strip), lambda t: t != "")


def first_term_in(terms: Column, text: Column) -> Column:
    found = F.filter(terms, lambda t: F.contains(F.lower(text), F.lower(t)))
    return F.when(F.size(found) > 0, F.get(found, F.lit(0)))


def token_length(text: Column) -> Column:
    trimmed = F.coalesce(strip(text), F.lit(""))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, f"[{_BLANKS}]+")))


def file_name(name: Column) -> Column:
    return F.translate(name, "/:", "__")


def rank_score(og: Column, new: Column) -> Column:
    """Reciprocal-rank change: positive for a demotion."""
    return F.when(og >= new, new / og - 1).otherwise(1 - og / new)


def grid_points(text: Column) -> Column:
    """'a,t;a,t' as an array of (alpha, tau); pairs that are not two numbers are left out."""
    parts = F.transform(F.split(text, ";"), lambda p: F.split(p, ","))
    points = F.transform(parts, lambda p: F.struct(strip(F.get(p, F.lit(0))).try_cast("double").alias("alpha"), strip(F.get(p, F.lit(1))).try_cast("double").alias("tau"), F.size(p).alias("n")))
    return F.filter(points, lambda p: (p.n == 2) & p.alpha.isNotNull() & p.tau.isNotNull())


def marked_sides(text: Column) -> tuple[Column, Column]:
    """The positive and negative side of 'Q+: ... Q-: ...'; without a negative marker the negative side is NONE."""
    plus, minus = F.contains(text, F.lit("Q+:")), F.contains(text, F.lit("Q-:"))
    parts = F.split(text, "Q-:")
    positive = F.when(plus & minus, strip(F.replace(F.get(parts, F.lit(0)), F.lit("Q+:"), F.lit("")))).when(plus, strip(F.replace(text, F.lit("Q+:"), F.lit("")))).otherwise(text)
    return positive, F.when(plus & minus, strip(F.get(parts, F.lit(1)))).otherwise(NONE)


def prompt(text: Column, passage: Column) -> Column:
    """The encoder's prompt of a passage or a query."""
    return F.format_string("%s: %s</s>", F.when(passage, "passage").otherwise("query"), text)


def relative_change(before: Column, after: Column) -> Column:
    """Change relative to a positive value, else 0."""
    return F.when(before > 0, (after - before) / before).otherwise(0.0)


def empty_gate(vector: Column, alpha: Column) -> Column:
    """No strength where the negative side's vector is all but zero."""
    return F.when(l2(vector) < 1e-6, 0.0).otherwise(alpha)


def split_prompt(query: Column, instruction: Column) -> Column:
    """The request that asks for a query's two sides."""
    return F.format_string("Query: %s\nInstruction: %s", query, F.coalesce(instruction, F.lit("")))


def number_list(text: Column) -> Column:
    """Comma-separated numbers; what is none is left out."""
    return F.filter(F.transform(F.split(text, ","), lambda x: strip(x).try_cast("double")), lambda x: x.isNotNull())


#: Encoders by a part of their name (fixed values), and the family that any other belongs to.
ENCODERS = {"repllama": "repllama", "mistral": "mistral", "bge": "bge"}
DEFAULT_ENCODER = "bge"


def encoder_family(model: Column) -> Column:
    """The encoder family that a model's name tells."""
    chosen = F.lit(DEFAULT_ENCODER)
    for part, family in reversed(list(ENCODERS.items())):
        chosen = F.when(F.contains(F.lower(model), F.lit(part)), family).otherwise(chosen)
    return chosen


def cache_folder(model: Column, task: Column) -> Column:
    """Where a model keeps a task's vectors: the last part of its name, then the task."""
    return F.concat_ws("/", F.element_at(F.split(model, "/"), -1), file_name(task))
