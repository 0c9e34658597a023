"""Scoring of query and candidate pairs, rankings and top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.internal import InternalFunction
from pyspark.sql.window import Window

from ..functions.vectors import dot
from ..sources.shared import stash
from . import nearest

#: Queries and documents of one block of vectors. A task meets one block of queries: fewer than the 128 keys that Spark's aggregates of objects hold before they sort.
QUERY_BLOCK, DOCUMENT_BLOCK = 120, 2048
#: Documents that a task meets at most, in about even parts.
TASK_DOCUMENTS = 65_536


def score_candidates(pairs: DataFrame, queries: DataFrame, documents: DataFrame, streams: dict[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Join candidate pairs (keys, q, doc) to query and document vectors first, then score: streams name -> query vector column. keys that documents have part their ids too."""
    own = [k for k in keys if k in documents.columns]
    joined = pairs.join(documents.select(*own, "doc", F.col("embedding").alias("_d")), [*own, "doc"]).join(queries, [*keys, "q"])
    return joined.select(*[c for c in joined.columns if c != "_d" and c not in streams.values()], *(dot(v, "_d").alias(s) for s, v in streams.items()))


def _numbers(column: pa.Array, kind: type) -> bytes:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).tobytes()


def _kind(rows: DataFrame, vector: str) -> type:
    """The numbers that a vector's blocks hold: its own floats, else doubles."""
    return np.float32 if rows.schema[vector].dataType.simpleString() == "array<float>" else np.float64


def score_all(queries: DataFrame, documents: DataFrame, streams: dict[str, str], carry: tuple[str, ...] = (), about: tuple[str, ...] = ()) -> DataFrame:
    """q, doc, the carried columns of documents, those about queries, and one score per stream for every query and document.

    Both sides are packed into blocks of vectors where they are, as wide as they come, and blocks meet on the executors: a pair of
    blocks is one matrix product in double precision for each stream. The query side is a stated set; neither side passes the driver. Queries and documents without a
    vector have no scores.
    """
    carried = [*documents.select(*carry).schema.fields, *queries.select(*about).schema.fields]
    shape = S.StructType([S.StructField("q", S.LongType()), S.StructField("doc", S.LongType()), *carried, *(S.StructField(s, S.DoubleType()) for s in streams)])
    names, fields, sides = [f.name for f in shape], ["doc", *carry], list(streams.values())

    kind, kinds = _kind(documents, "embedding"), [_kind(queries, v) for v in sides]

    def packed(kept: list[str], vectors: list[str], kinds: list[type], size: int):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, size):
                    part = batch.slice(lo, size)
                    about = pa.RecordBatch.from_arrays([part[c] for c in kept], kept)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, about.schema) as out:
                        out.write_batch(about)
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (sink.getvalue().to_pybytes(), *(_numbers(part[v], n) for v, n in zip(vectors, kinds)))], ["about", *(f"v{i}" for i in range(len(vectors)))])

        return pack

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, who = (pa.ipc.open_stream(row[c]).read_next_batch() for c in ("about", "q_about"))
                vectors = np.frombuffer(row["v0"], kind).astype(np.float64).reshape(docs.num_rows, -1)
                scores = [vectors @ np.frombuffer(row[f"q_v{i}"], n).astype(np.float64).reshape(who.num_rows, -1).T for i, n in enumerate(kinds)]
                at, q = (pa.array(x) for x in np.indices(scores[0].shape).reshape(2, -1))
                yield pa.RecordBatch.from_arrays([who["q"].take(q), docs["doc"].take(at), *(docs[c].take(at) for c in carry), *(who[c].take(q) for c in about), *(pa.array(x.ravel()) for x in scores)], names)

    asked = stash(queries.select("q", *about, *sides).dropna(subset=sides), "asked")  # counted and packed
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    full = asked.repartition(parts)  # full blocks, however many tasks the queries come in
    tasks = max(-(-4 * documents.sparkSession.sparkContext.defaultParallelism // parts), -(-documents.count() // TASK_DOCUMENTS))  # a table may be one file's one row group
    d = documents.where("embedding is not null").select(*fields, "embedding").mapInArrow(packed(fields, ["embedding"], [kind], DOCUMENT_BLOCK), "about binary, v0 binary").repartition(tasks)
    blocks = full.mapInArrow(packed(["q", *about], sides, kinds, QUERY_BLOCK), ", ".join(f"{c} binary" for c in ("about", *(f"v{i}" for i in range(len(sides))))))
    sides_of = blocks.select(*(F.col(c).alias(f"q_{c}") for c in blocks.columns)).hint("shuffle_replicate_nl")  # neither side is broadcast, whatever its size
    return d.crossJoin(sides_of).mapInArrow(multiply, shape)


def first_by_product(queries: DataFrame, documents: DataFrame, vectors: tuple[str, ...], k: int, extra: tuple[str, ...] = (), final: nearest.Final | None = None, others: bool = False, products: list[int] | None = None) -> DataFrame:
    """q, doc, score and rank of each query's first k documents, by a certified search that skips what cannot be among them.

    The first of the query's vectors is searched by; final gives the score that counts from the products of all vectors and
    the extra columns, never above the first product. others: a document of the query's own id does not count. documents:
    doc and embedding; those without a finite vector, and queries without vectors, take no part.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    index = nearest.build(documents.where(F.coalesce(finite, F.lit(False))).select(F.col("doc").alias("id"), F.lit(0).cast("long").alias("label"), F.col("embedding").alias("x")))
    dim = index.directory.dim

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.column_stack([nearest.matrix(batch[v], dim) for v in vectors])
            more = np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in extra]).astype(np.float64) if extra else np.zeros((n, 0))
            whole, none = pa.array([[]] * n, pa.list_(pa.float64())), pa.array(np.full(n, -1))
            yield pa.RecordBatch.from_arrays([batch["uid"], none, batch["q"], pa.array(np.zeros(n, np.int64)), *(pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, more)), whole, whole], [c.split()[0] for c in nearest.QUERY.split(", ")])

    asked = queries.dropna(subset=list(vectors)).select(F.monotonically_increasing_id().alias("uid"), "q", *vectors, *extra).mapInArrow(pack, nearest.QUERY)
    found = nearest.search(index, asked, k, final=final, streams=len(vectors), extra=len(extra), others=others, products=products)
    return found.select(F.col("anchor").alias("q"), F.col("id").alias("doc"), "score", F.col("rank").cast("long").alias("rank"))


def ranked(scored: DataFrame, score: str, keys: tuple[str, ...] = ("q",), tie: str = "doc", name: str = "rank") -> DataFrame:
    """Rank within keys by score descending, then tie ascending, whatever the size of a key's group.

    Rows are dealt by ranges of (keys, score, tie) and sorted there, so a large group takes many tasks; a row's place in its task,
    and a row for each group and task with how many came before, give the rank.
    """
    order = [*(F.col(k) for k in keys), F.desc(score), F.asc(tie)]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = stash(dealt, "ranked").withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_size")
    starts = sizes.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_p"), (before - F.col("_first") + 1).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(starts, same).select(*scored.columns, (F.col("_at") + F.col("_shift")).alias(name))


def top_k(scored: DataFrame, score: str, k: int, keys: tuple[str, ...] = ("q",), tie: str = "doc", name: str = "rank", held: bool = False) -> DataFrame:
    """The first k rows of each key with their rank; a task sends no more than k of a key's rows on.

    held: a task holds a key's first k rows while it reads, and sorts none but these; for whole lists of few keys a task, where tie is a
    whole number and the other columns can be compared."""
    if held:
        rest = [c for c in scored.columns if c not in (*keys, score, tie)]
        row = F.struct(F.col(score), F.isnull(tie).alias("_no_tie"), F.bitwise_not(tie).alias("_tie"), *rest)  # its largest is the first: ~tie falls as tie grows
        lists = scored.groupBy(*keys).agg(InternalFunction.collect_top_k(row, k, False).alias("_rows"))
        rows = lists.select(*keys, F.posexplode("_rows").alias("_at", "_row")).withColumn(tie, F.bitwise_not("_row._tie"))
        return rows.select(*(F.col(c if c in (*keys, tie) else f"_row.{c}") for c in scored.columns), (F.col("_at") + 1).cast("long").alias(name))
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn(name, F.row_number().over(order).cast("long")).where(F.col(name) <= k)


def tiles(scored: DataFrame, score: str, n: int, keys: tuple[str, ...] = ("q",), tie: str = "doc", name: str = "tile") -> DataFrame:
    """Rows with the number of their tile from 1: n tiles a key, as even as can be, the first ones larger."""
    placed = ranked(scored, score, keys, tie, "_rank")
    sizes = placed.groupBy(*keys).agg(F.max("_rank").alias("_n"))
    at, each, more = F.col("_rank") - 1, F.floor(F.col("_n") / n), F.col("_n") % n
    inside = F.when(at < more * (each + 1), F.floor(at / (each + 1))).otherwise(more + F.floor((at - more * (each + 1)) / F.greatest(each, F.lit(1))))
    return placed.join(sizes, list(keys)).select(*scored.columns, (inside + 1).cast("long").alias(name))


def _one(rows: DataFrame, keys: tuple[str, ...], order: Column) -> DataFrame:
    """The first row of each key; rows of equal order are told apart by a hash of all they hold."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, F.xxhash64(*rows.columns)))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")


def first_wins(rows: DataFrame, keys: tuple[str, ...], ordinal: Column) -> DataFrame:
    return _one(rows, keys, ordinal.asc())


def last_wins(rows: DataFrame, keys: tuple[str, ...], ordinal: Column) -> DataFrame:
    return _one(rows, keys, ordinal.desc())


def numbered(rows: DataFrame, group: str, major: str, minor: str, span: int = 4096) -> DataFrame:
    """Rows with place: their number from 0 within group in the order of major (a whole number), then minor.

    Spans of `span` majors are numbered apart; only a row for each span meets in the running sum over a group.
    """
    block = F.floor(F.col(major) / span)
    inside = F.row_number().over(Window.partitionBy(group, "_block").orderBy(major, minor)) - 1
    marked = rows.withColumn("_block", block)
    sizes = marked.groupBy(group, "_block").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy(group).orderBy("_block")) - F.col("_size"))
    return marked.withColumn("_inside", inside).join(before.drop("_size"), [group, "_block"]).withColumn("place", F.col("_before") + F.col("_inside")).drop("_block", "_before", "_inside")


def query_statistics(scored: DataFrame, column: str, gamma: Column | float, keys: tuple[str, ...] = ("q",)) -> DataFrame:
    """Distribution-aware threshold tau = mean + gamma * population deviation over a query's candidates; an even distribution gives its mean.

    Two numbers a key are summed where the rows are and joined back."""
    gamma = F.lit(gamma) if isinstance(gamma, float) else gamma
    mean, deviation = F.col("_mean"), F.col("_dev")
    return with_moments(scored, column, keys).withColumn("tau", F.when(deviation < 1e-8, mean).otherwise(mean + gamma * deviation)).drop("_mean", "_dev")


def with_moments(scored: DataFrame, column: str, keys: tuple[str, ...] = ("q",)) -> DataFrame:
    """Rows with _mean and _dev (population) of a column over their key."""
    stats = scored.groupBy(*keys).agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_dev"))
    return scored.join(stats, list(keys))
