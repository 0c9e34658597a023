"""Token ids of whole texts in files of patched frame-of-reference blocks, and their reader.

File format: a Parquet dataset, one row per segment. A segment holds the ids of whole documents (about SEGMENT ids, or
one long document) in document order: doc_ids and doc_sizes; and per block of BLOCK ids its minimum, the bit width of
its packed differences, the byte at which its packed part starts (the index), and the number of its exceptions.
Differences that need more than the block's width are stored whole in the exception lists (place in the block,
difference), and their packed place holds their low bits. The width is that of a percentile of the block's
differences. Shards follow the range partitions of the document id, so (shard, segment) gives the global order; the
table of shards, a row each and MOST_SHARDS rows at most, gives the ids before a shard; segments add up within shards.

Defined results: null and empty texts are one end id; null ids come first; repeated ids follow each other, by text;
an empty table gives an empty dataset; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from . import text as T
from .store import input_bytes, scratch
from .token_counts import BATCH_BYTES, encoder

BLOCK = 128
SEGMENT = 1 << 18
#: Share of a block's differences that its width must hold.
PERCENTILE = 90
#: File bytes of one range partition, and the most partitions: a table of shards, and of their first ids, stays that small.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 50_000

SCHEMA = S.StructType(
    [S.StructField(n, S.LongType()) for n in ("shard", "segment", "n_ids")]
    + [S.StructField("doc_ids", S.ArrayType(S.LongType())), S.StructField("doc_sizes", S.ArrayType(S.LongType()))]
    + [S.StructField(n, S.BinaryType()) for n in ("minimum", "width", "block_start", "packed", "n_exceptions", "exception_at", "exception_value")]
)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack(values: np.ndarray) -> dict[str, bytes]:
    """Blocks of a run of unsigned 32-bit ids."""
    n = len(values)
    blocks = -(-n // BLOCK)
    square = np.concatenate([values, np.full(blocks * BLOCK - n, values[-1] if n else 0, np.uint32)]).reshape(blocks, BLOCK)
    minimum = square.min(axis=1) if blocks else np.zeros(0, np.uint32)
    deltas = square - minimum[:, None]
    ranked = np.partition(deltas, BLOCK * PERCENTILE // 100 - 1, axis=1)[:, BLOCK * PERCENTILE // 100 - 1] if blocks else minimum
    width = _bits(ranked)
    sizes = width * BLOCK // 8
    start = np.concatenate([[0], np.cumsum(sizes)])
    packed = np.zeros(int(start[-1]), np.uint8)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(deltas[rows].astype(">u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2)[:, :, 32 - w :]
        packed[start[rows][:, None] + np.arange(BLOCK * w // 8)] = np.packbits(bits.reshape(len(rows), -1), axis=1)
    over = deltas.astype(np.uint64) >> width[:, None].astype(np.uint64) > 0
    return {
        "minimum": minimum.astype("<u4").tobytes(), "width": width.astype(np.uint8).tobytes(), "block_start": start[:-1].astype("<u4").tobytes(), "packed": packed.tobytes(),
        "n_exceptions": over.sum(axis=1).astype(np.uint8).tobytes(), "exception_at": np.nonzero(over)[1].astype(np.uint8).tobytes(), "exception_value": deltas[over].astype("<u4").tobytes(),
    }


def unpack(part: dict[str, bytes], n: int) -> np.ndarray:
    """The ids that pack() was given."""
    minimum, width = np.frombuffer(part["minimum"], "<u4"), np.frombuffer(part["width"], np.uint8).astype(np.int64)
    start, packed = np.frombuffer(part["block_start"], "<u4").astype(np.int64), np.frombuffer(part["packed"], np.uint8)
    deltas = np.zeros((len(width), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        bits = np.zeros((len(rows), BLOCK, 32), np.uint8)
        bits[:, :, 32 - w :] = np.unpackbits(packed[start[rows][:, None] + np.arange(BLOCK * w // 8)], axis=1).reshape(len(rows), BLOCK, w)
        deltas[rows] = np.packbits(bits, axis=2).view(">u4").reshape(len(rows), BLOCK)
    which = np.repeat(np.arange(len(width)), np.frombuffer(part["n_exceptions"], np.uint8))
    deltas[which, np.frombuffer(part["exception_at"], np.uint8)] = np.frombuffer(part["exception_value"], "<u4")
    return (deltas + minimum[:, None]).ravel()[:n]


def write_token_files(docs: DataFrame, tokenizer_file: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text, append end_id, and write segments in ascending id order; gives the dataset's path."""
    path = path or scratch(docs.sparkSession, "token-files")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard, segment = encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        for batch in T.slices(batches, "text", BATCH_BYTES):
            doc_ids = batch["doc_id"]
            counts, flat = known.rows(*T.raw(batch["text"]), keep_ids=True)
            bounds = np.concatenate([[0], np.cumsum(counts + 1)])
            ids = np.full(bounds[-1], end_id, np.uint32)
            inside = np.ones(len(ids), bool)
            inside[bounds[1:] - 1] = False
            ids[inside] = flat
            row = 0
            while row < len(counts):
                last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + SEGMENT, "right")) - 1)
                part = ids[bounds[row] : bounds[last]]
                out = {"shard": shard, "segment": segment, "n_ids": len(part), "doc_ids": doc_ids.slice(row, last - row).to_pylist(), "doc_sizes": (counts[row:last] + 1).tolist()} | pack(part)
                yield pa.RecordBatch.from_pylist([out], schema=arrow)
                row, segment = last, segment + 1

    arrow = pa.schema([(n, pa.int64()) for n in ("shard", "segment", "n_ids")] + [(n, pa.list_(pa.int64())) for n in ("doc_ids", "doc_sizes")] + [(f.name, pa.binary()) for f in SCHEMA.fields[5:]])
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shards = min(MOST_SHARDS, max(12, -(-input_bytes(slim) // SHARD_BYTES)))
    ordered = slim.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(encode, SCHEMA).write.option("compression", "none").parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids, if asked for) of each document, decoded from the files."""
    files = spark.read.schema(SCHEMA).parquet(path)
    names = ["doc_id", "shard", "segment", "inside", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                ids = unpack(part, part["n_ids"])
                bounds = np.concatenate([[0], np.cumsum(part["doc_sizes"])]).astype(np.int64)
                lists = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
                n = len(lists)
                columns = [pa.array(part["doc_ids"], pa.int64()), pa.array([part["shard"]] * n, pa.int64()), pa.array([part["segment"]] * n, pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in lists], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([x.astype(np.int64) for x in lists], pa.list_(pa.int64()))] * with_ids, names)

    rows = files.mapInArrow(decode, "doc_id long, shard long, segment long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    # Two levels of running sums: over the few shards, and over the segments of each shard.
    segments = files.select("shard", "segment", "n_ids")
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    before = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")
    starts = segments.select("shard", "segment", before.alias("segment_start")).join(shards, "shard")
    start = (F.col("shard_start") + F.col("segment_start") + F.col("inside")).alias("start")
    return rows.join(starts, ["shard", "segment"]).select("doc_id", start, "n_tokens", "ids_crc32", *["ids"] * with_ids)
