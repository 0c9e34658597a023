"""Training data: pair expansion, splits and the small models' losses and steps."""

from __future__ import annotations

import io
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from ..sources.shared import stash

#: Pieces of a gradient, and the partial sums of each.
CHUNKS, SALTS = 256, 64
#: Files that a minibatch is spread over.
SPREAD = 8
_PIECE = S.StructType([S.StructField("at", S.IntegerType()), S.StructField("salt", S.IntegerType()), S.StructField("value", S.BinaryType()), S.StructField("loss", S.DoubleType()), S.StructField("n", S.LongType())])


def expand_pairs(rows: DataFrame, num_neg: int = 15) -> DataFrame:
    """idx, query, pos, neg: each positive with the first num_neg negatives; rows without either are left out."""
    usable = rows.where((F.size("pos") > 0) & (F.size("neg") > 0))
    return usable.select("idx", "query", F.posexplode("pos").alias("pos_at", "pos"), "neg").select("idx", "query", "pos_at", "pos", F.posexplode(F.slice("neg", 1, num_neg)).alias("neg_at", "neg"))


def grouped_split(rows: DataFrame, key: str = "idx", percent: int = 10, seed: int = 42) -> DataFrame:
    """Rows with a column validation; all rows of a key fall on one side."""
    return rows.withColumn("validation", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(100)) < percent)


def row_split(rows: DataFrame, share: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and held-out rows, each row by its own hash; rows alike in all columns stay together."""
    low = F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(1_000_000)) < int(share * 1_000_000)
    return rows.where(~low), rows.where(low)


def info_nce(scores: Column, temperature: float = 0.1) -> Column:
    """Cross-entropy of the first of an array of scores."""
    z = F.transform(scores, lambda s: s / temperature)
    top = F.array_max(z)
    return F.log(F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top - F.get(z, F.lit(0))


def margin_loss(positive: Column, negative: Column, margin: float = 0.2) -> Column:
    """Hinge of a positive score that should lead a negative one by the margin."""
    return F.greatest(F.lit(0.0), margin + negative - positive)


def hard_examples(rows: DataFrame, keys: tuple[str, ...], score: str, ratio: float, largest: bool, tie: str) -> DataFrame:
    """The hardest max(1, ratio * n) rows of each group: largest or smallest scores, ties by `tie`."""
    group = Window.partitionBy(*keys)
    order = F.col(score).desc() if largest else F.col(score).asc()
    marked = rows.withColumns({"_n": F.count("*").over(group), "_at": F.row_number().over(group.orderBy(order, tie))})
    return marked.where(F.col("_at") <= F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))).drop("_n", "_at")


#: Bounds of a gate by encoder family (fixed values): largest alpha, least and largest tau.
GATE_BOUNDS = {"repllama": (1.2, 0.45, 0.85), "mistral": (1.5, 0.4, 0.8), "bge": (2.0, 0.3, 0.7)}
Gate = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def gate_bounds(encoder: str) -> tuple[float, float, float]:
    return GATE_BOUNDS.get(encoder, GATE_BOUNDS["bge"])


def new_gate(dim: int, hidden: int = 128, seed: int = 42) -> Gate:
    random = np.random.default_rng(seed)
    return random.standard_normal((dim, hidden)) / np.sqrt(dim), np.zeros(hidden), random.standard_normal((hidden, 2)) / np.sqrt(hidden), np.zeros(2)


def gate(weights: Gate, most: float = 2.0, low: float = 0.3, high: float = 0.7):
    """Arrow UDF of a two-layer gate: vector -> struct(alpha in (0, most), tau in (low, high))."""

    @F.pandas_udf("alpha double, tau double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w1, b1, w2, b2 = weights
        for vectors in batches:
            x = np.stack(vectors.to_numpy()).astype(np.float64)
            z = 1 / (1 + np.exp(-(np.maximum(x @ w1 + b1, 0) @ w2 + b2)))
            yield pd.DataFrame({"alpha": z[:, 0] * most, "tau": low + z[:, 1] * (high - low)})

    return apply


def _summed(rows: DataFrame, columns: list[str], of: Callable[[pa.RecordBatch], tuple[np.ndarray, float, int]], length: int, by: str | None = None) -> tuple[np.ndarray, float]:
    """The mean gradient and loss over rows; of: a batch's summed gradient, summed loss and rows. by: rows come in runs of this column, and `of` gets whole runs.

    Each partition sends its sum in CHUNKS pieces; pieces are added in two steps, so that no task holds all partitions',
    and one gradient comes back.
    """
    cuts = np.linspace(0, length, min(CHUNKS, length) + 1).astype(int)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch[by].to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(key[1:] != key[:-1]) + 1
            for lo, hi in zip([0, *starts], [*starts, len(key)]):
                part = batch.slice(lo, hi - lo)
                if held and part.num_rows and held[0][by][0].as_py() != part[by][0].as_py():
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                held += [part] * bool(part.num_rows)
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros(length), 0.0, 0
        for batch in runs(batches) if by else batches:
            if batch.num_rows:
                value, l, m = of(batch)
                total, loss, n = total + value, loss + l, n + m
        at = range(len(cuts) - 1)
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([salt] * len(at), pa.int32()), pa.array([total[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array([loss] + [0.0] * (len(at) - 1)), pa.array([n] + [0] * (len(at) - 1), pa.int64())], _PIECE.names)

    def add(table: pa.Table) -> pa.Table:
        value = sum(np.frombuffer(x, np.float64) for x in table["value"].to_pylist())
        return pa.table({"at": table["at"][:1], "salt": pa.array([0], pa.int32()), "value": pa.array([value.tobytes()], pa.binary()), "loss": pa.array([sum(table["loss"].to_pylist())]), "n": pa.array([sum(table["n"].to_pylist())], pa.int64())})

    pieces = rows.select(*columns).mapInArrow(partial, _PIECE)
    got = pieces.groupBy("at", "salt").applyInArrow(add, _PIECE).groupBy("at").applyInArrow(add, _PIECE).toArrow().sort_by("at")
    n = max(1, sum(got["n"].to_pylist()))
    return np.frombuffer(b"".join(got["value"].to_pylist()) or bytes(8 * length), np.float64) / n, sum(got["loss"].to_pylist()) / n


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _projected(weight: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit projections and the lengths before."""
    z = q @ weight.T
    size = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    return z / size, size


def _back(u: np.ndarray, size: np.ndarray, g: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The gradient of a projection's matrix from that of its unit results."""
    return ((g - u * (g * u).sum(axis=1, keepdims=True)) / size).T @ q


def projection_gradient(weight: np.ndarray, pairs: DataFrame, margin: float = 0.1) -> tuple[np.ndarray, float]:
    """Gradient and loss of a projection that pulls q to pos and pushes it from neg by a hinge; pairs: q, pos, neg (arrays)."""

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, float, int]:
        q, p, m = (_matrix(batch[c], batch.num_rows) for c in ("q", "pos", "neg"))
        u, size = _projected(weight, q)
        gap = margin + (u * (m - p)).sum(axis=1)
        live = gap > 0
        return _back(u, size, (m - p) * live[:, None], q).ravel(), float(gap[live].sum()), len(q)

    gradient, loss = _summed(pairs, ["q", "pos", "neg"], of, weight.size)
    return gradient.reshape(weight.shape), loss


def projection_step(weight: np.ndarray, pairs: DataFrame, rate: float = 0.5, margin: float = 0.1) -> tuple[np.ndarray, float]:
    """One full gradient step of the same."""
    gradient, loss = projection_gradient(weight, pairs, margin)
    return weight - rate * gradient, loss


#: Margins and weights of the contrastive loss (fixed values): push, pull, Gram matrix, random anchors.
CONTRAST = {"margin_pos": 0.05, "margin_neg": 0.3, "push": 1.4, "pull": 0.6, "orthogonal": 0.01, "anchor": 0.1}


def contrast_terms(weight: np.ndarray, q: np.ndarray, pos: np.ndarray, neg: np.ndarray, anchors: np.ndarray | None = None, **terms: float) -> tuple[np.ndarray, float]:
    """Gradient and loss of one batch: projections are pushed from their own positive and pulled to their own negative by hinges,
    their Gram matrix should be the identity, and they should be at right angles to their anchors (rows x n x dim)."""
    c = CONTRAST | terms
    n = len(q)
    u, size = _projected(weight, q)
    near, far = (u * pos).sum(axis=1), (u * neg).sum(axis=1)
    apart = u @ u.T - np.eye(n)
    loss = c["push"] * np.maximum(near - c["margin_pos"], 0).mean() + c["pull"] * np.maximum(c["margin_neg"] - far, 0).mean() + c["orthogonal"] * (apart**2).mean()
    g = (c["push"] * (near > c["margin_pos"])[:, None] * pos - c["pull"] * (far < c["margin_neg"])[:, None] * neg) / n + c["orthogonal"] * 4 / n**2 * (apart @ u)
    if anchors is not None and anchors.shape[1]:
        angle = np.einsum("rd,rad->ra", u, anchors)
        loss += c["anchor"] * (angle**2).mean()
        g = g + c["anchor"] * 2 / angle.size * np.einsum("ra,rad->rd", angle, anchors)
    return _back(u, size, g, q), float(loss)


def contrast_gradient(weight: np.ndarray, pairs: DataFrame, anchors: int = 0, **terms: float) -> tuple[np.ndarray, float]:
    """The mean gradient and loss over the batches of pairs (batch, q, pos, neg and, with anchors, an array of so many vectors).

    A batch's rows meet in one task (a batch is small by its making); a task adds up its batches before it sends anything."""
    columns = ["batch", "q", "pos", "neg", *["anchors"] * bool(anchors)]

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, float, int]:
        n = batch.num_rows
        q, pos, neg = (_matrix(batch[c], n) for c in ("q", "pos", "neg"))
        unit = batch["anchors"].flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, anchors, -1) if anchors else None
        gradient, loss = contrast_terms(weight, q, pos, neg, unit, **terms)
        return gradient.ravel(), loss, 1

    gradient, loss = _summed(pairs.repartition("batch").sortWithinPartitions("batch"), columns, of, weight.size, by="batch")
    return gradient.reshape(weight.shape), loss


def gate_gradient(weights: Gate, rows: DataFrame, encoder: str = "bge", temperature: float = 0.1, regular: float = 0.0) -> tuple[list[np.ndarray], float]:
    """Gradient and loss of the gate under the cross-entropy of training scores and `regular` times the strength squared.

    rows: q_minus (vector), pos (the positive's base score), neg (the negatives' base scores, as many in every row). A zero
    q_minus is no constraint and gets no penalty.
    """
    most, low, high = gate_bounds(encoder)
    sizes = [w.size for w in weights]

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, float, int]:
        w1, b1, w2, b2 = weights
        n = batch.num_rows
        x, pos, neg = _matrix(batch["q_minus"], n), batch["pos"].to_numpy(zero_copy_only=False).astype(np.float64), _matrix(batch["neg"], n)
        hidden = np.maximum(x @ w1 + b1, 0)
        z = 1 / (1 + np.exp(-(hidden @ w2 + b2)))
        alpha, tau = z[:, :1] * most, low + z[:, 1:] * (high - low)
        over = np.maximum(neg - tau, 0) * (np.abs(x).sum(axis=1, keepdims=True) > 0)
        logits = np.column_stack([pos, neg - alpha * over]) / temperature
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
        share = p[:, 1:] / temperature
        strength = -(share * over).sum(axis=1) + 2 * regular * alpha[:, 0]
        slope = np.column_stack([strength * most, (share * (over > 0) * alpha).sum(axis=1) * (high - low)]) * z * (1 - z)
        back = (slope @ w2.T) * (hidden > 0)
        parts = (x.T @ back, back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0))
        return np.concatenate([g.ravel() for g in parts]), float(-np.log(np.maximum(p[:, 0], 1e-300)).sum() + regular * (alpha**2).sum()), n

    gradient, loss = _summed(rows, ["q_minus", "pos", "neg"], of, sum(sizes))
    return [g.reshape(w.shape) for g, w in zip(np.split(gradient, np.cumsum(sizes)[:-1]), weights)], loss


def gate_step(weights: Gate, rows: DataFrame, rate: float = 0.05, encoder: str = "bge", temperature: float = 0.1) -> tuple[Gate, float]:
    """One full gradient step of the same."""
    gradient, loss = gate_gradient(weights, rows, encoder, temperature)
    return tuple(w - rate * g for w, g in zip(weights, gradient)), loss


def gate_validation(weights: Gate, rows: DataFrame, encoder: str = "bge") -> dict[str, float]:
    """Held-out loss, accuracy, mean and deviation of alpha and tau, and mean penalty of negatives; rows as for gate_gradient, summed where they are."""
    from .losses import training_scores, validation

    found = rows.select("*", gate(weights, *gate_bounds(encoder))("q_minus").alias("_g"))
    mask = F.when(F.exists("q_minus", lambda x: x != 0), 1.0).otherwise(0.0)
    scored = found.select(training_scores(F.col("pos"), F.col("neg"), F.col("_g.alpha"), F.col("_g.tau"), mask).alias("scores"), F.col("_g.alpha").alias("alpha"), F.col("_g.tau").alias("tau"), F.col("neg"))
    drop = F.aggregate(F.zip_with("neg", F.slice("scores", 2, F.size("neg")), lambda a, b: a.cast("double") - b), F.lit(0.0), lambda s, x: s + x) / F.size("neg")
    row = validation(scored).crossJoin(scored.agg(F.avg(drop).alias("penalty_neg"))).first()
    return {k: float(v) if v is not None else float("nan") for k, v in row.asDict().items()}


@dataclass
class AdamW:
    """Steps with decoupled weight decay; its moments are part of what a save holds."""

    rate: float = 1e-3
    decay: float = 0.01
    betas: tuple[float, float] = (0.9, 0.999)
    epsilon: float = 1e-8
    count: int = 0
    first: list[np.ndarray] | None = None
    second: list[np.ndarray] | None = None

    def step(self, weights: list[np.ndarray], gradient: list[np.ndarray]) -> list[np.ndarray]:
        if self.first is None:
            self.first, self.second = ([np.zeros_like(w) for w in weights] for _ in range(2))
        self.count += 1
        a, b = self.betas
        self.first = [a * m + (1 - a) * g for m, g in zip(self.first, gradient)]
        self.second = [b * v + (1 - b) * g * g for v, g in zip(self.second, gradient)]
        unbiased = [(m / (1 - a**self.count), v / (1 - b**self.count)) for m, v in zip(self.first, self.second)]
        return [w * (1 - self.rate * self.decay) - self.rate * m / (np.sqrt(v) + self.epsilon) for w, (m, v) in zip(weights, unbiased)]


@dataclass
class State:
    """What training goes on from: weights, optimiser, finished epochs, the best weights with their held-out loss, and the history."""

    weights: list[np.ndarray]
    optimiser: AdamW
    epoch: int = 0
    waited: int = 0
    best: list[np.ndarray] | None = None
    best_loss: float = float("inf")
    history: list[dict[str, float]] = field(default_factory=list)

    def packed(self) -> bytes:
        arrays = {f"{name}{i}": w for name, group in (("weight", self.weights), ("best", self.best or []), ("first", self.optimiser.first or []), ("second", self.optimiser.second or [])) for i, w in enumerate(group)}
        about = {"epoch": self.epoch, "waited": self.waited, "best_loss": self.best_loss, "history": self.history, "count": self.optimiser.count, "rate": self.optimiser.rate, "decay": self.optimiser.decay, "betas": list(self.optimiser.betas), "epsilon": self.optimiser.epsilon}
        sink = io.BytesIO()
        np.savez_compressed(sink, about=np.frombuffer(json.dumps(about).encode(), np.uint8), **arrays)
        return sink.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> State:
        with np.load(io.BytesIO(data)) as saved:
            about = json.loads(saved["about"].tobytes())

            def group(name: str) -> list[np.ndarray] | None:
                return [saved[f"{name}{i}"] for i in range(len(saved.files)) if f"{name}{i}" in saved.files] or None

            optimiser = AdamW(about["rate"], about["decay"], tuple(about["betas"]), about["epsilon"], about["count"], group("first"), group("second"))
            return State(group("weight"), optimiser, about["epoch"], about["waited"], group("best"), about["best_loss"], about["history"])


def minibatches(rows: DataFrame, size: int, seed: int = 42, key: str = "idx") -> tuple[DataFrame, int]:
    """Rows dealt to batches of about `size` by a seeded hash of their key, stored one folder a batch, and the number of batches.

    A step reads its own batch's files only; rows are dealt once, and each epoch takes the batches in another order."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("_batch", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(n)).cast("int"))
    salt = F.floor(F.rand(seed) * SPREAD)  # a batch that one key fills is still several tasks'
    return stash(dealt.repartition("_batch", salt), "minibatches", ["_batch"]), n


def fit_batches(gradient: Callable, rows: DataFrame, state: State, validate: Callable[[list[np.ndarray]], dict[str, float]], epochs: int, size: int = 1024, patience: int = 3, seed: int = 42, key: str = "idx", save: Callable[[State], None] | None = None) -> State:
    """Train by minibatches until the held-out loss has not fallen for `patience` epochs; a state that was saved goes on where it was.

    gradient: (weights, rows of a batch) -> (gradient, loss); validate: weights -> measures with loss; save: called after
    each epoch. The order of an epoch's batches follows from seed and epoch alone, so a resumed run takes the same steps.
    """
    dealt, n = minibatches(rows, size, seed, key)
    while state.epoch < epochs and state.waited < patience:
        losses = []
        for b in np.random.default_rng([seed, state.epoch]).permutation(n):
            part = dealt.where(F.col("_batch") == int(b)).drop("_batch")
            found, loss = gradient(state.weights, part)
            if math.isnan(loss):
                raise ValueError(f"the loss of batch {b} in epoch {state.epoch} is no number")
            state.weights = state.optimiser.step(state.weights, found)
            losses.append(loss)
        measures = validate(state.weights)
        state.epoch += 1
        state.history.append({"epoch": state.epoch, "train_loss": float(np.mean(losses)), **{f"val_{k}": v for k, v in measures.items()}})
        if measures["loss"] < state.best_loss:
            state.best, state.best_loss, state.waited = [w.copy() for w in state.weights], measures["loss"], 0
        else:
            state.waited += 1
        if save:
            save(state)
    return state


def fit(step: Callable, start, epochs: int, patience: int = 3) -> tuple[object, list[float]]:
    """Full steps until the loss has not fallen for `patience` epochs; gives the best weights and the history of losses.

    step: weights -> (new weights, loss of the weights that it was given)."""
    weights, best, history = start, (start, float("inf")), []
    for _ in range(epochs):
        after, loss = step(weights)
        history.append(loss)
        if loss < best[1]:
            best = (weights, loss)
        elif len(history) - 1 - history.index(best[1]) >= patience:
            break
        weights = after
    return best[0], history


#: What each mode trains, in order; "lap_then_mlp" trains the gate on the trained projection, "hybrid" both in one epoch loop.
MODES = {"baseline": (), "lap_only": ("projection",), "mlp_only": ("gate",), "hybrid": ("projection", "gate"), "lap_then_mlp": ("projection", "gate")}


@dataclass(frozen=True)
class Recipe:
    """How a mode trains: epochs, rows of a minibatch, rows of a contrastive batch within it, rates, and what the losses weigh."""

    epochs: int = 5
    size: int = 1024
    contrast_size: int = 64
    rate: float = 1e-3
    decay: float = 0.01
    patience: int = 3
    seed: int = 42
    held_out: int = 10
    regular: float = 0.0
    anchors: int = 4
    encoder: str = "bge"


def contrast_rows(pairs: DataFrame, recipe: Recipe, dim: int) -> DataFrame:
    """Pairs (idx, q, pos, neg) with batch and anchors: batches by a seeded draw of each row, so that none outgrows its size, anchors from a hash of seed and idx."""
    from .losses import anchors

    n = max(1, -(-pairs.count() // recipe.contrast_size))
    dealt = pairs.withColumn("batch", F.floor(F.rand(recipe.seed + 1) * n))
    return anchors(dealt.withColumn("row", F.col("idx")), dim, recipe.seed, recipe.anchors).drop("row") if recipe.anchors else dealt


def train_projection(pairs: DataFrame, dim: int, recipe: Recipe = Recipe(), state: State | None = None, save: Callable[[State], None] | None = None) -> State:
    """The projection under the contrastive loss; pairs: idx, q, pos, neg. Rows of one idx are on one side of the split."""
    split = grouped_split(pairs, "idx", recipe.held_out, recipe.seed)
    train, held = (stash(contrast_rows(split.where(c).drop("validation"), recipe, dim), "contrast") for c in (~F.col("validation"), F.col("validation")))

    def gradient(weights: list[np.ndarray], rows: DataFrame) -> tuple[list[np.ndarray], float]:
        found, loss = contrast_gradient(weights[0], rows, recipe.anchors)
        return [found], loss

    def validate(weights: list[np.ndarray]) -> dict[str, float]:
        return {"loss": contrast_gradient(weights[0], held)[1]}

    state = state or State([np.eye(dim)], AdamW(recipe.rate, recipe.decay))
    # Whole contrastive batches go into a minibatch: they are what its key deals.
    return fit_batches(gradient, train, state, validate, recipe.epochs, recipe.size, recipe.patience, recipe.seed, "batch", save)


def train_gate(rows: DataFrame, dim: int, recipe: Recipe = Recipe(), state: State | None = None, save: Callable[[State], None] | None = None) -> State:
    """The gate under cross-entropy and regulariser; rows: idx, q_minus, pos, neg."""
    split = grouped_split(rows, "idx", recipe.held_out, recipe.seed)
    train, held = (stash(split.where(c).drop("validation"), "gate") for c in (~F.col("validation"), F.col("validation")))

    def gradient(weights: list[np.ndarray], part: DataFrame) -> tuple[list[np.ndarray], float]:
        return gate_gradient(tuple(weights), part, recipe.encoder, regular=recipe.regular)

    state = state or State(list(new_gate(dim, seed=recipe.seed)), AdamW(recipe.rate, recipe.decay))
    return fit_batches(gradient, train, state, lambda w: gate_validation(tuple(w), held, recipe.encoder), recipe.epochs, recipe.size, recipe.patience, recipe.seed, "idx", save)


def train(mode: str, pairs: DataFrame, gate_rows: Callable[[np.ndarray], DataFrame], dim: int, epochs: int = 5, encoder: str = "bge", recipe: Recipe | None = None, resume: dict[str, State] | None = None, save: Callable[[str, State], None] | None = None) -> tuple[np.ndarray, Gate | None, dict[str, list[dict[str, float]]]]:
    """The projection, the gate (None where the mode has none) and both histories by epoch.

    pairs: idx, q, pos, neg; gate_rows: the gate's rows (idx, q_minus, pos, neg) for a projection. "hybrid" trains the parts
    in turns, an epoch each, the gate always on the projection of that moment; the other modes finish one before the next.
    resume: states by part; save: called with the part's name after each of its epochs.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    recipe = recipe or Recipe(epochs=epochs, encoder=encoder)
    parts, states = MODES[mode], dict(resume or {})
    rounds = range(1, recipe.epochs + 1) if mode == "hybrid" else [recipe.epochs]
    for upto in rounds:
        step = replace(recipe, epochs=upto)
        for part in parts:
            kept = (lambda s, part=part: save(part, s)) if save else None
            if part == "projection":
                states[part] = train_projection(pairs, dim, step, states.get(part), kept)
            else:
                held = states.get("projection")
                states[part] = train_gate(gate_rows(best_weights(held)[0] if held else np.eye(dim)), dim, step, states.get(part), kept)
    weight = best_weights(states["projection"])[0] if "projection" in parts else np.eye(dim)
    return weight, tuple(best_weights(states["gate"])) if "gate" in parts else None, {part: states[part].history for part in parts}


def best_weights(state: State) -> list[np.ndarray]:
    return state.best or state.weights
