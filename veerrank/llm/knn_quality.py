"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Texts become weighted counts of hashed byte trigrams (whole texts), of one length mark and of one mark for the share of
words that repeat the word before. A bounded, balanced sample
of labelled texts, SAMPLE rows of each label at most, gives the weights and, by a truncated singular value
decomposition, a latent space of RANK dimensions. After weighting by rarity no mark is longer than
the text's trigrams, so that none outweighs the text. The sample's vectors are broadcast (their size follows SAMPLE and
RANK, not the data). Every document's exact cosine with every labelled vector is computed in blocks; its NEIGHBOURS
nearest vote with their labels, weighted by similarity; of equal cosines the smaller labelled id votes first, and cosines are rounded to
single precision's last digits, so exact copies with different labels have a defined order.

Defined results: null and empty texts have their marks only and get a score like any text; without labels every
score is 0.5; null labels are left out; null ids are scored and never learned from; repeated rows get equal scores; of a labelled id with several texts the one
with the smallest vector is learned from, and of several labels the larger; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

BATCH_BYTES = 2 << 20
#: Most labelled rows of each label that are learned from.
SAMPLE = 1500
RANK, NEIGHBOURS, SHARPNESS = 48, 15, 8.0
TRIGRAMS, LENGTHS, REPEATS = 4096, 32, 16
#: Weights of the marks of length and of repeated words, before rarity, and their most length beside a text's trigrams.
MARKS, MOST = (0.2, 0.3), 1.0


def counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Log counts of hashed trigrams, normalised to length one, and a one at each mark of the row."""
    n = len(bounds) - 1
    out = np.zeros((n, TRIGRAMS + LENGTHS + REPEATS), np.float32)
    if len(data) >= 3:
        wide = data.astype(np.uint32)
        code = ((wide[:-2] * np.uint32(0x01000193) ^ wide[1:-1]) * np.uint32(0x01000193) ^ wide[2:]) * np.uint32(0x9E3779B1) >> np.uint32(20)
        for row in range(n):
            part = code[bounds[row] : max(bounds[row], bounds[row + 1] - 2)]
            if len(part):
                out[row, :TRIGRAMS] = np.bincount(part, minlength=TRIGRAMS)
    np.log1p(out, out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    mark = np.minimum(np.log2(np.diff(bounds) + 1).astype(np.int64), LENGTHS - 1)
    out[np.arange(n), TRIGRAMS + mark] = 1.0
    words, word_bounds = T.split(data, bounds, lower=True)
    index, _ = T.codes(words)
    again = np.zeros(len(index), bool)
    again[1:] = index[1:] == index[:-1]
    again[word_bounds[:-1][word_bounds[:-1] < len(index)]] = False
    share = T.row_sums(again, word_bounds) / np.maximum(np.diff(word_bounds), 1)
    out[np.arange(n), TRIGRAMS + LENGTHS + np.minimum(np.ceil(share * REPEATS), REPEATS - 1).astype(np.int64)] = 1.0
    return out


class Model:
    """Labelled latent vectors, in the order of their ids, and the way into their space."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        if not len(x):
            return
        self.weight = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.1).astype(np.float32)
        x = self._weighted(x)
        probe = np.random.default_rng(7).standard_normal((x.shape[1], RANK + 16)).astype(np.float32)
        for _ in range(4):  # randomised subspace iteration
            probe = np.linalg.qr(x.T @ (x @ probe))[0]
        _, _, basis = np.linalg.svd(x @ probe, full_matrices=False)
        self.basis = (probe @ basis.T[:, :RANK]).astype(np.float32)
        self.vectors = self._norm(x @ self.basis)

    @staticmethod
    def _norm(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def _weighted(self, x: np.ndarray) -> np.ndarray:
        """All parts by rarity; a mark is at most MOST times as long as the text's trigrams, so that it cannot overrule them alone. A text without trigrams has its marks."""
        out = x * self.weight
        size = np.linalg.norm(out[:, :TRIGRAMS], axis=1, keepdims=True)
        limit = np.where(size > 0, MOST * size, np.inf)
        for part, share in ((slice(TRIGRAMS, TRIGRAMS + LENGTHS), MARKS[0]), (slice(TRIGRAMS + LENGTHS, None), MARKS[1])):
            out[:, part] = np.minimum(out[:, part] * share, limit)
        return self._norm(out)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), 0.5)
        out = np.zeros(len(x))
        near = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(x), 512):
            latent = self._norm(self._weighted(x[at : at + 512]) @ self.basis)
            cosine = np.round((latent @ self.vectors.T).astype(np.float64), 6)
            # Equal cosines are told apart by the place of the labelled vector, so the order is whole.
            order = cosine - np.arange(cosine.shape[1]) * 1e-11
            nearest = np.argpartition(-order, near - 1, axis=1)[:, :near]
            weight = np.exp(SHARPNESS * (np.take_along_axis(cosine, nearest, 1) - 1))
            out[at : at + 512] = (weight * self.labels[nearest]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def held_out(id_col: str, folds: int) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str, folds: int = 5) -> Model:
    """Learn from labelled documents outside fold 0; docs: doc_id, text."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(~held_out("doc_id", folds))
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = None
    for label in (0, 1):
        part = usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        sample = part if sample is None else sample.unionByName(part)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text", BATCH_BYTES):
            x = counts(*T.raw(batch["text"])).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    joined = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    got = joined.mapInArrow(vectors, "doc_id long, label int, x binary").groupBy("doc_id", "label").agg(F.min("x").alias("x")).toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(-1, TRIGRAMS + LENGTHS + REPEATS).astype(np.float32)
    return Model(x, got["label"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    share = docs.sparkSession.sparkContext.broadcast(fit(slim, labels, label_col, folds))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = share.value
        for batch in T.slices(batches, "text", BATCH_BYTES):
            found = model.scores(counts(*T.raw(batch["text"])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found)], ["doc_id", "score"])

    rows = slim.mapInArrow(vote, "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id", folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
