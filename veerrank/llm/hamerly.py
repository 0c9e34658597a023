"""Exact integer centroid clustering with Hamerly bounds.

Vectors are packed once into blocks of BLOCK rows, bucketed by block number. Each round keeps a second, small table in the
same buckets: a vector's cluster, one upper bound of the distance to its centroid and one lower bound of the distance to
the second nearest. Bounds are loosened by how far centroids moved; a vector whose upper bound stays below its lower bound (or
below half the way from its centroid to the next) keeps its cluster without any distance, the others get one exact
distance and, if that does not settle it, a full scan of exact integer distances. Vectors are read in place and never
written again; the two tables of a block meet in its bucket without a shuffle. A block's sums by cluster travel with
its bounds, so a round's centroids need the small table only. Centroids (k rows) are all that reaches the driver.

Bounds are doubles that rounding only ever loosens; they decide which distances are computed, never a result.

Defined results: rows whose vector is null, of another length, or holds a null or non-finite component take no part and are
not returned; null ids are clustered but start no centroid; repeated rows are vectors of their own; fewer usable rows than
k start as many centroids; an empty table gives no rows; other columns are ignored. A component whose scaled floor is beyond
MOST in size raises, as squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import buckets_for, discard, shelve, stash

#: Vectors of one block; bytes of input in one bucket.
BLOCK, BUCKET_BYTES = 4096, 64 << 20
#: Largest component: squared distances of 64 components stay below 2**63.
MOST = 1 << 27
#: Up to this size, products of doubles are exact integers.
_EXACT = 1 << 22
_LOOSE = 1e-13

BLOCKS = "block long, n int, ids binary, named binary, wide int, data binary"
STATE = "block long, cluster binary, upper binary, lower binary, sums binary, scans long"


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), of x as doubles."""
    found = np.floor(vectors * scale)
    if found.size and np.abs(found).max() > MOST:
        raise ValueError(f"a component times {scale} is beyond {MOST}; its squared distances would not fit 64 bits")
    return found.astype(np.int64)


def kept(vectors: DataFrame, dim: int, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and x (doubles) of the rows that take part."""
    x = F.col(vec_col).cast("array<double>")
    usable = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each of x."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= _EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def _up(x: np.ndarray) -> np.ndarray:
    return x + np.abs(x) * _LOOSE


def _down(x: np.ndarray) -> np.ndarray:
    return x - np.abs(x) * _LOOSE


class Round:
    """One assignment: the centroids, how far each came since the last one, and half its way to the next."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids, k = centroids, len(centroids)
        between = np.sqrt(distances(centroids, centroids).astype(np.float64))
        np.fill_diagonal(between, np.inf)
        self.half = _down(between.min(1, initial=np.inf) / 2)
        self.drift = np.zeros(k) if before is None else _up(np.sqrt(((centroids - before) ** 2).sum(1).astype(np.float64)))
        self.others = np.array([np.delete(self.drift, j).max(initial=0.0) for j in range(k)])

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, upper and lower bound from all distances; of equal ones the smaller number counts."""
        found = distances(x, self.centroids)
        cluster = found.argmin(1)
        own = found[np.arange(len(x)), cluster]
        second = np.partition(found, 1, axis=1)[:, 1].astype(np.float64) if len(self.centroids) > 1 else np.full(len(x), np.inf)
        return cluster, _up(np.sqrt(own.astype(np.float64))), _down(np.sqrt(second))

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from the bounds of the round before, and the number of vectors that were scanned."""
        cluster, upper, lower = cluster.copy(), _up(upper + self.drift[cluster]), _down(lower - self.others[cluster])
        safe = np.maximum(lower, self.half[cluster])
        at = np.flatnonzero(upper >= safe)
        upper[at] = _up(np.sqrt(((x[at] - self.centroids[cluster[at]]) ** 2).sum(1).astype(np.float64)))
        at = at[upper[at] >= safe[at]]
        cluster[at], upper[at], lower[at] = self.scan(x[at])
        return cluster, upper, lower, len(at)


def _vectors(row: dict, dim: int) -> np.ndarray:
    return np.frombuffer(row["data"], f"<i{row['wide']}").reshape(row["n"], dim).astype(np.int64)


def pack(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """Blocks of vectors; a block's number is its task and its place there."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = integers(part["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
                wide = 2 if np.abs(x).max(initial=0) < 1 << 15 else 4
                ids = part["vec_id"].fill_null(0).to_numpy()
                named = part["vec_id"].is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pylist([{"block": at, "n": len(x), "ids": ids.astype("<i8").tobytes(), "named": named.tobytes(), "wide": wide, "data": x.astype(f"<i{wide}").tobytes()}], pa.schema([("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("named", pa.binary()), ("wide", pa.int32()), ("data", pa.binary())]))
                at += 1

    return rows.mapInArrow(blocks, BLOCKS)


def _state(block: int, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scans: int, x: np.ndarray, k: int) -> pa.RecordBatch:
    sums = np.zeros((k, x.shape[1] + 1), np.int64)
    for j in range(k):
        own = cluster == j
        sums[j, :-1], sums[j, -1] = x[own].sum(0), np.count_nonzero(own)
    row = {"block": block, "cluster": cluster.astype("<i4").tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "sums": sums.tobytes(), "scans": scans}
    return pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("cluster", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("sums", pa.binary()), ("scans", pa.int64())]))


def _bounds(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["cluster"], "<i4").astype(np.int64), np.frombuffer(row["upper"]), np.frombuffer(row["lower"])


def _totals(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, int]:
    """Sums and counts by cluster as whole numbers (k rows of dim + 1), and the vectors scanned."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scans = np.zeros(k * (dim + 1), np.int64), 0
        for batch in batches:
            for sums, n in zip(batch["sums"].to_pylist(), batch["scans"].to_pylist()):
                total, scans = total + np.frombuffer(sums, np.int64), scans + n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int32()), pa.array(np.append(scans, total))], ["at", "value"])

    got = state.select("sums", "scans").mapInArrow(add, "at int, value long").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    flat = np.zeros(k * (dim + 1) + 1, object)
    for r in got:
        flat[r["at"]] = int(r["value"])
    return flat[:-1].reshape(k, dim + 1), int(flat[-1])


def moved(centroids: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Floors of the means; a cluster without vectors keeps its centroid."""
    out = centroids.copy()
    for j, row in enumerate(totals):
        if row[-1]:
            out[j] = [s // row[-1] for s in row[:-1]]
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", scans: list[int] | None = None) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every usable row.

    Centroids start at the k vectors whose sha256 of "seed:id" is smallest; after `rounds` rounds of assignment and
    floors of means the vectors are assigned once more. scans: gets the number of full scans of each round.
    """
    spark = vectors.sparkSession
    usable = kept(vectors, dim, id_col, vec_col)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = usable.where("vec_id is not null").orderBy(key, "x").limit(k).collect()
    centroids = integers(np.array([r.x for r in first], np.float64).reshape(-1, dim), scale)
    k = len(first)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    buckets = buckets_for(vectors, BUCKET_BYTES)
    blocks = shelve(pack(usable, dim, scale), "vectors", "block", buckets)
    state, before = None, None
    for _ in range(rounds):
        after = shelve(_assigned(blocks, state, Round(centroids, before), dim), "bounds", "block", buckets, dealt=state is not None)
        if state is not None:
            discard(state)
        state = after
        totals, n = _totals(state, k, dim)
        if scans is not None:
            scans.append(n)
        centroids, before = moved(centroids, totals), centroids
    rows = stash(_assigned(blocks, state, Round(centroids, before), dim, last=True), "assigned")
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(whole.alias("s")).collect()}
    about = spark.createDataFrame([(j, sums.get(j, 0), sum(sums.values()), digest(c)) for j, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _assigned(blocks: DataFrame, state: DataFrame | None, step: Round, dim: int, last: bool = False) -> DataFrame:
    """The next state, or with last the rows vec_id, cluster, distance."""
    share = blocks.sparkSession.sparkContext.broadcast(step)
    joined = blocks if state is None else blocks.join(state.select("block", "cluster", "upper", "lower").hint("shuffle_hash"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = share.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                x = _vectors(row, dim)
                if "cluster" in row:
                    own, upper, lower, n = step.assign(x, *_bounds(row))
                else:
                    (own, upper, lower), n = step.scan(x), len(x)
                if not last:
                    yield _state(row["block"], own, upper, lower, n, x, len(step.centroids))
                    continue
                ids = pa.array(np.frombuffer(row["ids"], "<i8"), pa.int64(), mask=~np.frombuffer(row["named"], bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array(((x - step.centroids[own]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])

    return joined.mapInArrow(run, "vec_id long, cluster int, distance long" if last else STATE)
