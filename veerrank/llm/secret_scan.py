"""Secret scan: a random forest removes false positives among long tokens, on DataFrame functions only.

Candidates are all runs of MIN_LENGTH or more token characters, and those of SHORT or more that hold a digit, any number in
a word. Their features are length, shares of digits,
capitals and marks, changes of character class, mean log transition probability of neighbouring characters and
coverage by dictionary trigrams (both from all words of the documents, weighted by their counts), signs of a path, an
address or quotes, the name next to them, and the neighbouring words: the nearest plain ones on both sides, counted in NEAR
buckets by hash, and their mean length. Names of credentials and the marks of an assignment are no plain words, so that what makes a weak
label is masked. The forest is trained on labelled findings, at most SAMPLE of each
label in an order by hash.

Without labelled findings of their own, users can take `weak_findings`, whose evidence is not among the features that the
forest then sees (SHAPE): a finding is true if it is assigned to the name of a credential, whatever its value, and harmless
if it is neither named nor assigned and is, or has a word of LETTERS_TOLD letters that is, in several documents. The rest
(unnamed values of their own) is not learned from, but judged like all.

Defined results: null and empty texts have no candidates; null ids and repeated rows come back as they are; without
findings of both labels the probability is the share of positive findings (0 without any); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stash

MIN_LENGTH, SHORT = 16, 8
#: Letters of a word that tells a value to be harmless if several documents have it.
LETTERS_TOLD = 4
#: Buckets of neighbouring words; words looked at and taken on each side.
NEAR, REACH, TAKEN = 8, 8, 2
#: Most labelled findings of each label that the forest learns from.
SAMPLE = 5_000
TREES, DEPTH = 20, 6
#: Characters that transitions and trigrams are counted over.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: A trigram is in the dictionary from this share of all trigrams.
COMMON = 1e-6
#: Characters of a run, and the places in a word where a run of SHORT or more begins or ends.
RUN = "[A-Za-z0-9+/_=.@:~-]"
BORDER = f"(?<!{RUN})(?={RUN}{{{SHORT}}})|(?!{RUN})(?<={RUN}{{{SHORT}}})"
#: A part of a path: names and short numbers, unlike the parts of base64 text between its slashes.
PART = "^[._~-]*+(?:(?:[A-Z]?[a-z]{2,}+(?:[A-Z][a-z]{2,}+)*+|[A-Z]{2,}+|[A-Za-z])?[0-9]{0,8}+(?:[._~-]++|$))*+$"
NAMES = "(?i)token|secret|passw|passwd|pwd|api_?key|apikey|access_?key|private_?key|credential|auth"
FEATURES = ["length", "digits", "capitals", "marks", "changes", "transition", "coverage", "path", "address", "quoted", "assigned", "named", "near_length", "near_letters", *(f"near{i}" for i in range(NEAR))]
#: Features that weak labels are not made of: what the forest learns from when no findings are given.
SHAPE = [x for x in FEATURES if x not in ("assigned", "named", "quoted", "near_length")]


def _code(c: F.Column) -> F.Column:
    """Place of a character in LETTERS from 1, or 0."""
    return F.call_function("locate", c, F.lit(LETTERS))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, place (word number), nth (run number within the word), value, lead and tail (the word's text next to the run), the two words before and the one behind, and near, the plain words next to it."""
    words = F.split(F.col(text_col).cast("string"), r"[\x20\x09-\x0D]+")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words")).where("words is not null")

    def at(array: str, i: F.Column) -> F.Column:
        return F.coalesce(F.get(array, i), F.lit(""))

    def plain(some: F.Column) -> F.Column:
        """The first letters-only words of some that are no credential's name."""
        bare = F.transform(some, lambda w: F.lower(F.regexp_replace(w, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", "")))
        return F.slice(F.filter(bare, lambda w: (w != "") & (F.length(w) < 3 * SHORT) & ~w.rlike(NAMES)), 1, TAKEN)

    def word(w: F.Column, i: F.Column) -> F.Column:
        able = (F.length(w) >= SHORT) & (w.rlike(f"{RUN}{{{MIN_LENGTH}}}") | (w.rlike("[0-9]") & w.rlike(f"{RUN}{{{SHORT}}}")))  # others hold no run that counts
        left = F.reverse(F.slice("words", F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH))))
        near = F.concat(plain(left), plain(F.slice("words", i + 2, F.lit(REACH))))
        return F.when(able, F.struct((i + 1).cast("long").alias("place"), w.alias("word"), at("words", i - 2).alias("before2"), at("words", i - 1).alias("before"), at("words", i + 1).alias("behind"), near.alias("near")))

    def run(x: F.Column, i: F.Column) -> F.Column:
        last = at("parts", i - 1)
        lead = F.when(last.rlike("^[\"'`\\\\=:>]+$"), F.concat(at("parts", i - 2), last)).otherwise(last)
        return F.when(x.rlike(f"^{RUN}{{{MIN_LENGTH}}}|^(?=[^0-9]*[0-9]){RUN}{{{SHORT}}}"), F.struct(x.alias("value"), lead.alias("lead"), at("parts", i + 1).alias("tail"), (i < 2).alias("opens")))

    long = slim.select("doc_id", F.explode(F.filter(F.transform("words", word), lambda x: x.isNotNull())).alias("w")).select("doc_id", "w.*")
    around = ("doc_id", "place", "before2", "before", "behind", "near")
    parts = long.select(*around, F.split("word", BORDER).alias("parts"))
    runs = parts.select(*around, F.posexplode(F.filter(F.transform("parts", run), lambda x: x.isNotNull())).alias("nth", "r"))
    return runs.select("doc_id", "place", (F.col("nth") + 1).cast("long").alias("nth"), "before2", "before", "behind", "near", "r.*")


def character_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts of character trigrams over all words of docs (lower case letters and digits): a, b, c, n."""
    text = F.lower(F.col(text_col).cast("string"))
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit("[a-z0-9]{3,}"), 0)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    trigram = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substring("word", i, 3))).alias("t"))
    counts = trigram.groupBy("t").agg(F.sum("n").alias("n"))
    return counts.select(*(_code(F.substring("t", i, 1)).alias(x) for i, x in ((1, "a"), (2, "b"), (3, "c"))), "n")


def _tables(counts: DataFrame) -> tuple[list[float], bytes]:
    """Log transition probabilities (1,369 at most) and dictionary trigrams (46,656 at most)."""
    size = len(LETTERS) + 1
    pairs, trigrams, total = [[1.0] * size for _ in range(size)], [], 0
    for r in counts.toLocalIterator():
        pairs[r.a][r.b] += r.n
        total += r.n
        trigrams.append((r.a, r.b, r.c, r.n))
    logs = [math.log(x / sum(row)) for row in pairs for x in row]
    known = bytearray(size**3)
    for a, b, c, n in trigrams:
        if n >= max(2, COMMON * total):
            known[(a * size + b) * size + c] = 1
    return logs, bytes(known)


def features(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of candidates() with FEATURES."""
    logs, known = _tables(counts)
    size = len(LETTERS) + 1
    table, dictionary = F.lit(logs), F.lit(bytearray(known))
    value, n = F.col("value"), F.length("value")

    def share(pattern: str) -> F.Column:
        return F.length(F.regexp_replace(value, pattern, "")) / n

    classes = F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a" * 26)
    classes = F.regexp_replace(F.regexp_replace(classes, "[a-zA-Z]", "a"), "[0-9]", "0")
    kinds = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    codes = F.transform(F.split(F.lower(value), ""), _code)
    rows = rows.withColumn("codes", codes)
    steps = F.transform(F.sequence(F.lit(0), F.size("codes") - 2), lambda i: F.get(table, F.get("codes", i) * size + F.get("codes", i + 1)))
    triples = F.transform(F.sequence(F.lit(0), F.size("codes") - 3), lambda i: (F.substring(dictionary, (F.get("codes", i) * size + F.get("codes", i + 1)) * size + F.get("codes", i + 2) + 1, 1) == F.lit(bytearray(b"\x01"))).cast("double"))

    def mean(a: F.Column) -> F.Column:
        return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))

    def near_in(bucket: int) -> F.Column:
        return F.size(F.filter("near", lambda w: F.pmod(F.xxhash64(w), F.lit(NEAR)) == bucket)).cast("double")

    lead = F.col("lead")
    own, outer = F.regexp_extract(value, "^([A-Za-z0-9_.-]{1,64})[=:]+[^=:/]", 1), F.regexp_extract(lead, "([A-Za-z0-9_.-]+)[\"'`\\\\]*[=:]>?[\"'`\\\\]*$", 1)
    key = F.when(own != "", own).otherwise(outer)
    near = F.when(key != "", key).when(F.col("opens"), F.concat_ws(" ", "before2", "before", lead)).otherwise(lead)
    assigned = (key != "") | lead.rlike("[=:]>?[\"'`\\\\]*$") | (F.col("opens") & F.col("before").rlike("[=:]>?$"))
    steps_of_path = F.split(value, "/")
    path = F.forall(steps_of_path, lambda x: x.rlike(PART)) & ((F.size(steps_of_path) > 1) | value.rlike(r"^\.|\.[a-z]{2,4}$"))
    return rows.withColumns(
        {
            "length": n.cast("double"), "digits": share("[^0-9]"), "capitals": share("[^A-Z]"), "marks": share("[A-Za-z0-9]"), "changes": (kinds - 1) / n,
            "transition": mean(steps), "coverage": mean(triples), "path": path.cast("double"), "address": value.rlike("@|://").cast("double"),
            "quoted": (lead.rlike("[\"'`]$") & F.col("tail").rlike("^[\\\\]?[\"'`]")).cast("double"), "assigned": assigned.cast("double"),
            "named": (near.rlike(NAMES) | value.rlike(f"^({NAMES})")).cast("double"), "near_length": (F.length(near) + F.length("behind")).cast("double"),
            "near_letters": F.coalesce(mean(F.transform("near", lambda w: F.length(w).cast("double"))), F.lit(0.0)),
            **{f"near{b}": near_in(b) for b in range(NEAR)},
        }
    ).drop("codes")


def weak_findings(rows: DataFrame) -> DataFrame:
    """Rows of features() that their surroundings or other documents label, with label 0 or 1; the rest is left out."""
    told = (F.col("named") == 1) & (F.col("assigned") == 1)
    harmless = rows.where((F.col("named") == 0) & (F.col("assigned") == 0))
    words = F.transform(F.regexp_extract_all("value", F.lit(f"[A-Z]?[a-z]{{{LETTERS_TOLD},}}|[A-Z]{{{LETTERS_TOLD},}}"), 0), F.lower)
    pieces = harmless.select("doc_id", "value", F.explode(F.array_append(words, F.concat(F.lit("="), "value"))).alias("piece"))
    often = pieces.groupBy("piece").agg((F.min("doc_id") < F.max("doc_id")).alias("several"))
    known = pieces.select("value", "piece").distinct().join(often.where("several"), "piece", "left_semi").select("value").distinct()
    return rows.where(told).withColumn("label", F.lit(1)).unionByName(harmless.join(known.hint("shuffle_hash"), "value", "left_semi").withColumn("label", F.lit(0)).select(*rows.columns, "label"))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, place, nth, value, probability and kept (probability >= threshold) for every candidate.

    findings: labelled findings with the columns FEATURES and label; by default weak_findings of docs themselves.
    """
    counts = stash(character_counts(docs, text_col), "characters")
    rows = stash(features(candidates(docs, id_col, text_col), counts), "candidates")
    inputs = SHAPE if findings is None else FEATURES
    findings = weak_findings(rows) if findings is None else findings
    order = F.xxhash64(*FEATURES)
    parts = [findings.where(F.col("label") == k).select(*FEATURES, F.col("label").cast("double").alias("label")).orderBy(order, *FEATURES).limit(SAMPLE) for k in (0, 1)]
    sample = stash(parts[0].unionByName(parts[1]), "findings")
    seen = sample.groupBy().agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("positive")).first()
    if 0 < seen.positive < seen.n:
        assembler = VectorAssembler(inputCols=inputs, outputCol="_vector")
        forest = RandomForestClassifier(featuresCol="_vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=5, cacheNodeIds=False)
        model = forest.fit(assembler.transform(sample))
        rows = model.transform(assembler.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    else:
        rows = rows.withColumn("score", F.lit(seen.positive / seen.n if seen.n else 0.0))
    return rows.select("doc_id", "place", "nth", "value", F.round("score", 9).alias("probability"), (F.col("score") >= threshold).alias("kept"))
