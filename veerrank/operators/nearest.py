"""Exact top-k search by inner product through one-dimensional distance keys.

Vectors get one more component, sqrt(M - |x|^2) with M the largest squared norm, and queries a zero: then the largest inner
products are the smallest distances, d^2 = |q|^2 + M - 2 score. The index keeps vectors in the order of (pivot, distance to
that pivot) in blocks that never leave a pivot, and a directory with each block's interval of distances. By the triangle
inequality no row of a block [a, b] is nearer to a query at distance d from the pivot than max(0, d - b, a - d), nor
farther than d + b. A query visits blocks in the order of that lower bound, annuli around every pivot that widen from
round to round, until the bound of what it has not visited is beyond its k-th best: then its result is certified.

Queries and rows stay distributed: a visit brings a block and the queries that need it together by a join on the block's number
and is one matrix product. The driver holds the pivots (PIVOTS at most, from a sample of SAMPLE rows, which only decides how
much is skipped) and the directory: a block holds at least a 1 << 17 th of all rows, up to MOST_ROWS rows, so it has about
1 << 17 entries of 32 bytes, until 8.6 billion rows. Products choose what may be among the first k; the scores that are compared and returned are summed
for each pair in the same order of components, so equal vectors have equal scores.

Defined results: shorter vectors are as if zeros followed; ties go to the smaller id, null ids last; repeated rows are rows of their own; with
fewer than k rows all are found; an empty table, or no queries, give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import buckets_for, shelve, stash

SAMPLE, PIVOTS = 4096, 256
#: Rows of a block, at least and at most; bytes of input of a range; queries of one visit; numbers in one table of bounds.
ROWS, MOST_ROWS, RANGE_BYTES, QUERIES, BOUNDS = 1024, 1 << 16, 32 << 20, 256, 1 << 22
#: Blocks that a query visits in its first round, and how much more in each next one.
FIRST, GROWTH = 32, 4
NULL_ID = np.iinfo(np.int64).max
_EPS = 1e-9

Final = Callable[[list[np.ndarray], np.ndarray], np.ndarray]
BLOCKS = "block long, pivot int, least double, most double, n int, ids binary, labels binary, wide int, data binary"
QUERY = "uid long, own long, anchor long, label long, x binary, extra binary, high array<double>, low array<double>"


@dataclass
class Directory:
    dim: int
    largest: float
    pivots: np.ndarray
    block: np.ndarray
    pivot: np.ndarray
    least: np.ndarray
    most: np.ndarray
    rows: np.ndarray

    def to_pivots(self, x: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Distances to all pivots of rows (own: their squared norms) or queries (their last component is zero)."""
        last = np.zeros(len(x)) if own is None else np.sqrt(np.maximum(self.largest - own, 0))
        square = (x * x).sum(1) + last * last
        return np.sqrt(np.maximum(square[:, None] + (self.pivots**2).sum(1) - 2 * (x @ self.pivots[:, :-1].T + np.outer(last, self.pivots[:, -1])), 0))


@dataclass
class Index:
    blocks: DataFrame
    directory: Directory


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of numbers as rows of `dim` doubles: zeros behind the shorter ones, what is longer has nothing to meet."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if dim and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), max(dim, sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out[:, :dim]


def _packed(x: np.ndarray) -> tuple[int, bytes]:
    small = x.astype(np.float32)
    return (4, small.tobytes()) if (small == x).all() else (8, x.tobytes())


def _centres(x: np.ndarray, k: int) -> np.ndarray:
    """Centres of a sample: spread starts, a few rounds of means."""
    random = np.random.default_rng(11)
    at = [int(random.integers(len(x)))]
    near = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < k and near.max() > 0:
        at.append(int(random.choice(len(x), p=near / near.sum())))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    centres = x[at]
    for _ in range(8):
        own = ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)
        centres = np.stack([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(len(centres))])
    return centres


def build(rows: DataFrame) -> Index:
    """The index of rows (id, label, x: finite numbers)."""
    spark = rows.sparkSession
    square = F.aggregate(F.col("x"), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    n, dim, largest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0)), F.coalesce(F.max(square), F.lit(0.0))).first()
    sample = rows.orderBy(F.xxhash64("id", "x")).limit(SAMPLE).select("x").toArrow()["x"].combine_chunks()
    found = matrix(sample, dim) if n else np.zeros((0, dim))
    lifted = np.column_stack([found, np.sqrt(np.maximum(largest - (found**2).sum(1), 0))])
    pivots = _centres(lifted, min(PIVOTS, max(1, int(n**0.5 / 4)))) if n else lifted
    directory = Directory(dim, largest, pivots, *(np.zeros(0, t) for t in (np.int64, np.int64, float, float, np.int64)))
    share = spark.sparkContext.broadcast(directory)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = share.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = matrix(part["x"], known.dim)
                far = known.to_pivots(x, (x * x).sum(1))
                own = far.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(far[np.arange(len(x)), own]), part["id"].fill_null(NULL_ID), part["label"], pa.array([v.tobytes() for v in x], pa.binary())], ["pivot", "distance", "id", "label", "x"])

    each = min(MOST_ROWS, max(ROWS, -(-n // (1 << 17))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 24, None

        def write(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            ids = rows["id"].to_numpy()
            order = np.argsort(ids, kind="stable")  # within a block by id, so that earlier is smaller
            wide, data = _packed(np.frombuffer(b"".join(rows["x"].to_pylist()), np.float64).reshape(-1, dim)[order])
            far = rows["distance"].to_numpy()
            out = {"block": block, "pivot": rows["pivot"][0].as_py(), "least": float(far.min()), "most": float(far.max()), "n": len(ids), "ids": ids[order].tobytes(), "labels": rows["label"].to_numpy()[order].tobytes(), "wide": wide, "data": data}
            return pa.RecordBatch.from_pylist([out], pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("least", pa.float64()), ("most", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("wide", pa.int32()), ("data", pa.binary())]))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while len(held):
                pivot = held["pivot"].to_numpy()
                end = int(np.searchsorted(pivot, pivot[0], "right"))
                if end == len(held) and end < each:
                    break  # more of this pivot may come
                size = min(end, each)
                yield write(held.slice(0, size))
                held, block = held.slice(size), block + 1
        if held is not None and len(held):
            yield write(held)

    keyed = rows.select("id", F.col("label").cast("long").alias("label"), "x").mapInArrow(keys, "pivot int, distance double, id long, label long, x binary")
    # The running number parts rows that are alike in all else.
    dealt = keyed.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(buckets_for(rows, RANGE_BYTES), "pivot", "distance", "id", "at").sortWithinPartitions("pivot", "distance", "id").drop("at")
    blocks = shelve(dealt.mapInArrow(cut, BLOCKS), "blocks", "block", buckets_for(rows, RANGE_BYTES))
    entries = blocks.select("block", "pivot", "least", "most", "n").toArrow()
    return Index(blocks, Directory(dim, largest, pivots, *(entries[c].to_numpy() for c in ("block", "pivot", "least", "most", "n"))))


def rows_of(index: Index, keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Indexed rows as queries, each without itself; keep: which ids (those of null are left out)."""
    dim = index.directory.dim

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, x = _block(row, dim)
                at = np.flatnonzero((ids != NULL_ID) & keep(ids))
                uid = pa.array((row["block"] << 16) + at)
                empty = pa.array([b""] * len(at), pa.binary())
                nothing = pa.array([[]] * len(at), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([uid, uid, pa.array(ids[at]), pa.array(labels[at]), pa.array([x[i].tobytes() for i in at], pa.binary()), empty, nothing, nothing], [c.split()[0] for c in QUERY.split(", ")])

    return index.blocks.mapInArrow(pick, QUERY)


def _block(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), np.frombuffer(row["data"], f"<f{row['wide']}").reshape(row["n"], dim).astype(np.float64)


def _limits(known: Directory, x: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest distance at which a row may still matter; high, low: of each window the largest score and the least that counts."""
    base = (x * x).sum(1) + known.largest
    with np.errstate(invalid="ignore"):
        near, far = (np.sqrt(np.maximum(base[:, None] - 2 * s, 0)) for s in (high, low))
    return near.min(1), far.max(1)


def _plan(known: Directory, x: np.ndarray, high: np.ndarray, low: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Which blocks each query visits as number begin to end of its order, and whether it is certified before."""
    far = known.to_pivots(x)[:, known.pivot]
    lower = np.maximum(np.maximum(far - known.most, known.least - far), 0)
    near, bound = _limits(known, x, high, low)
    slack = _EPS * (1 + np.sqrt(known.largest) + np.sqrt((x * x).sum(1)))
    order = np.argsort(lower, axis=1, kind="stable")
    # A query that no window is left for needs no block at all.
    done = (np.full(len(x), begin) >= len(known.block)) | (bound < near - slack)
    if begin < len(known.block):
        done |= np.take_along_axis(lower, order[:, begin : begin + 1], 1)[:, 0] - slack > bound
    visit = np.zeros(lower.shape, bool)
    np.put_along_axis(visit, order[:, begin:end], True, 1)
    visit &= (lower - slack[:, None] <= bound[:, None]) & (far + known.most + slack[:, None] >= near[:, None])
    return visit & ~done[:, None], done


def _first(keep: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Of candidates in order of (query, id): the first k of each query by score."""
    order = np.lexsort((np.arange(len(keep)), -scores, keep))
    place = np.arange(len(order)) - np.searchsorted(keep[order], keep[order])
    return order[place < k]


def _queries(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, and the windows as rows of equal length: what is missing is a window that nothing fits."""
    x = np.frombuffer(b"".join(batch["x"].to_pylist()), np.float64).reshape(batch.num_rows, -1)[:, :width]
    most = max(1, batch["high"].value_lengths().to_numpy(zero_copy_only=False).max(initial=0))
    windows = []
    for name, none in (("high", -np.inf), ("low", np.inf)):
        rows = batch[name].to_pylist()
        windows.append(np.array([r + [none] * (most - len(r)) for r in rows]).reshape(len(rows), most))
    return x, *windows


def _scores(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, dim: int, streams: int) -> list[np.ndarray]:
    """Products of pairs (query i, row j) by stream, each summed in the same way wherever it stands."""
    out = [np.empty(len(i)) for _ in range(streams)]
    for lo in range(0, len(i), 1 << 14):
        part = slice(lo, lo + (1 << 14))
        rows = x[j[part]]
        for s in range(streams):
            out[s][part] = (q[i[part], s * dim : (s + 1) * dim] * rows).sum(1)
    return out


def _scan(row: dict, dim: int, k: int, same: bool | None, final: Final | None, streams: int, extra: int, others: bool) -> pa.RecordBatch:
    """The first k of each query and window in one block."""
    ids, labels, x = _block(row, dim)
    m, n = row["m"], row["n"]
    uid, own, anchor, label = (np.frombuffer(row[c], np.int64) for c in ("uid", "own", "anchor", "label"))
    q, more = np.frombuffer(row["q"], np.float64).reshape(m, -1), np.frombuffer(row["extra"], np.float64).reshape(m, extra)
    high, low = (np.frombuffer(row[c], np.float64).reshape(m, -1) for c in ("high", "low"))
    parts: list[list[np.ndarray]] = []
    each = max(1, (1 << 21) // n)
    for lo in range(0, m, each):
        some = slice(lo, min(m, lo + each))
        products = [q[some, s * dim : (s + 1) * dim] @ x.T for s in range(streams)]
        score = final(products, more[some, None, :]) if final else products[0]
        hers = np.flatnonzero((own[some] >= 0) & (own[some] >> 16 == row["block"]))
        if same is not None:
            score = np.where((label[some, None] == labels) == same, score, -np.inf)
        score[hers, own[some][hers] & 0xFFFF] = -np.inf
        if others:
            score = np.where(anchor[some, None] == ids, -np.inf, score)
        slack = _EPS * (1 + np.abs(score, where=np.isfinite(score), out=np.zeros_like(score)).max(initial=0))
        for w in range(high.shape[1]):
            fits = np.where((score <= high[some, w, None] + slack) & (score >= low[some, w, None] - slack), score, -np.inf)
            if n > k:
                fits = np.where(fits >= np.partition(fits, n - k, axis=1)[:, n - k, None] - slack, fits, -np.inf)
            i, j = np.nonzero(fits > -np.inf)
            i += lo
            found = _scores(q, x, i, j, dim, streams)
            exact = final(found, more[i]) if final else found[0]
            right = (exact <= high[i, w]) & (exact >= low[i, w])
            i, j, exact = i[right], j[right], exact[right]
            first = _first(i, exact, k)
            i, j = i[first], j[first]
            parts.append([uid[i], anchor[i], np.full(len(i), w), exact[first], ids[j], labels[j]])
    columns = [np.concatenate(c) for c in zip(*parts)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["uid", "anchor", "window", "score", "id", "label"])


FOUND = "uid long, anchor long, window long, score double, id long, label long"
VISIT = "block long, m int, uid binary, own binary, anchor binary, label binary, q binary, extra binary, high binary, low binary"
_VISIT = pa.schema([("block", pa.int64()), ("m", pa.int32())] + [(c.split()[0], pa.binary()) for c in VISIT.split(", ")[2:]])


def _visit(known: Directory, j: int, queries: pa.RecordBatch, width: int) -> pa.RecordBatch:
    _, high, low = _queries(queries, width)
    row = {n: queries[n].to_numpy().tobytes() for n in ("uid", "own", "anchor", "label")} | {"q": b"".join(queries["x"].to_pylist()), "extra": b"".join(queries["extra"].to_pylist())}
    return pa.RecordBatch.from_pylist([row | {"block": int(known.block[j]), "m": queries.num_rows, "high": high.tobytes(), "low": low.tobytes()}], _VISIT)


def search(index: Index, queries: DataFrame, k: int, same: bool | None = None, final: Final | None = None, streams: int = 1, extra: int = 0, others: bool = False, products: list[int] | None = None) -> DataFrame:
    """uid, anchor, window, rank, score, id and label of each window's first k rows.

    queries: QUERY; x holds `streams` vectors one after the other, the first of which is searched by, and extra so many more
    doubles. high and low: each window's largest and least score; none is one window of all scores. own: the query's
    row in the index, which it does not find, or -1. same: only rows of its label, or only others, or all. others: a row of the query's own id (anchor) does not count.
    final: products of the streams and the extras -> the score that counts, never above the first product. Rows of queries
    whose windows hold nothing are missing. products: gets how many products were computed.
    """
    spark, known = queries.sparkSession, index.directory
    share, dim, blocks = spark.sparkContext.broadcast(known), known.dim, len(known.block)
    counter = spark.sparkContext.accumulator(0) if products is not None else None
    at = min(QUERIES, max(1, BOUNDS // max(1, blocks)))
    whole = F.size("high") == 0
    opened = queries.withColumns({"high": F.when(whole, F.array(F.lit(float("inf")))).otherwise(F.col("high")), "low": F.when(whole, F.array(F.lit(float("-inf")))).otherwise(F.col("low"))})
    state, found = stash(opened, "queries"), None
    begin, step = 0, FIRST

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if counter is not None:
                    counter.add(row["m"] * row["n"])
                yield _scan(row, dim, k, same, final, streams, extra, others)

    while begin < blocks and (found is None or not state.isEmpty()):
        end = min(blocks, begin + step)

        def visits(batches: Iterator[pa.RecordBatch], begin: int = begin, end: int = end) -> Iterator[pa.RecordBatch]:
            known = share.value
            for batch in batches:
                for lo in range(0, batch.num_rows, at):
                    part = batch.slice(lo, at)
                    need, _ = _plan(known, *_queries(part, dim), begin, end)
                    for j in np.flatnonzero(need.any(0)):
                        yield _visit(known, j, part.take(pa.array(np.flatnonzero(need[:, j]))), dim)

        def left(batches: Iterator[pa.RecordBatch], end: int = end) -> Iterator[pa.RecordBatch]:
            """Queries that are not certified, their windows closed to what they have found."""
            known = share.value
            for batch in batches:
                for lo in range(0, batch.num_rows, at):
                    part = batch.slice(lo, at)
                    x, high, low = _queries(part, dim)
                    for i, best in enumerate(part["best"].to_pylist()):
                        for b in best or []:
                            low[i, b["window"]] = max(low[i, b["window"]], b["score"])
                    _, done = _plan(known, x, high, low, end, end)
                    rows = pa.table([*part.columns[:-3], pa.array(list(high), pa.list_(pa.float64())), pa.array(list(low), pa.list_(pa.float64()))], [c.split()[0] for c in QUERY.split(", ")])
                    yield from rows.filter(pa.array(~done)).to_batches()

        joined = state.mapInArrow(visits, VISIT).join(index.blocks.drop("pivot", "least", "most").hint("shuffle_hash"), "block")  # a bucket's blocks fit a task, visits are many
        order = Window.partitionBy("uid", "window").orderBy(F.desc("score"), "id")
        fresh = joined.mapInArrow(scan, FOUND)
        both = fresh if found is None else found.drop("rank").unionByName(fresh)
        found = stash(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")
        if end < blocks:
            best = found.where(F.col("rank") == k).groupBy("uid").agg(F.collect_list(F.struct("window", "score")).alias("best"))
            state = stash(state.join(best, "uid", "left").mapInArrow(left, QUERY), "queries")
        begin, step = end, step * GROWTH
    if products is not None:
        products.append(counter.value)
    if found is None:
        return spark.createDataFrame([], f"{FOUND}, rank int")
    return found.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id")))
