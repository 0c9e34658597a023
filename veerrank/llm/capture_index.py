"""An index of captures in global order of URL key and time, by external merging of locally sorted runs.

A task sorts RUN captures at a time; such a run is written as blocks of BLOCK captures. Runs are then merged: splitters,
drawn from a sample of all keys, cut the order into parts of about PART captures; every block is cut at the splitters, and
a part's slices, one sequence for each run, go through a k-way loser tree. With more than FAN_IN runs, groups of runs are
merged into longer runs first, pass by pass. Splitters only decide how even parts are: the order is that of (url_key,
date, page_id, archive, offset), by code points, null ids last, whatever the splitters. Captures that agree up to the id
are ordered by a hash of archive and offset, so that a part can begin inside them: no URL, however often captured, is one
group.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from .store import stash

#: Captures of a run, of one of its blocks, of a part (on average); sequences that one merge takes; most parts of a pass.
RUN, BLOCK, PART, FAN_IN, MOST_PARTS = 1 << 16, 1024, 1 << 16, 256, 1 << 14
#: About as many keys are sampled for splitters.
SAMPLE = 40_000

FIELDS = [("url_key", "string"), ("date", "long"), ("page_id", "long"), ("tie", "long"), ("url", "string"), ("record_type", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("refers_to", "long"), ("archive", "string"), ("offset", "long"), ("length", "long")]
CAPTURE = "struct<" + ", ".join(f"{n}: {t}" for n, t in FIELDS) + ">"
_ARROW = pa.struct([(n, pa.string() if t == "string" else pa.int64()) for n, t in FIELDS])
_SLICE = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("seq", pa.int64()), ("captures", pa.list_(_ARROW))])
SLICE = f"part int, run long, seq long, captures array<{CAPTURE}>"
_NONE = np.iinfo(np.int64).max

Key = tuple[str, int, int, int]


def url_key(url: Column) -> Column:
    """The host's labels from last to first, then path and query: scheme, user, fragment, leading www and default ports go, the host is lower case; null is the empty key."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"(?s)#.*$", "")
    site = F.regexp_extract(rest, r"^([^/?]*)", 1)
    path = F.substring(rest, F.length(site) + 1, F.length(rest))
    host = F.lower(F.regexp_replace(F.regexp_replace(site, r"^.*@", ""), r":(80|443)$", ""))
    labels = F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www\d*\.", ""), r"\.")), ",")
    return F.coalesce(F.concat(labels, F.lit(")"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))), F.lit(""))


class LoserTree:
    """Merges sorted sequences of keys: inner nodes hold the loser of their match, so taking the winner replays one path."""

    def __init__(self, sequences: list[list[Key]]):
        self.sequences, self.k = sequences, len(sequences)
        self.at = [0] * self.k
        self.heads = [self._head(i) for i in range(self.k)]
        self.losers = [0] * self.k
        won = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = won[2 * node], won[2 * node + 1]
            won[node], self.losers[node] = (b, a) if self.heads[b] < self.heads[a] else (a, b)
        self.winner = won[1] if self.k else 0

    def _head(self, i: int) -> tuple:
        sequence, at = self.sequences[i], self.at[i]
        return (0, sequence[at]) if at < len(sequence) else (1,)  # an empty sequence loses to all

    def __iter__(self) -> Iterator[int]:
        """The sequences in the order in which their next keys come."""
        for _ in range(sum(map(len, self.sequences))):
            best = self.winner
            yield best
            self.at[best] += 1
            self.heads[best] = self._head(best)
            node, heads, losers = (best + self.k) >> 1, self.heads, self.losers
            while node:
                if heads[losers[node]] < heads[best]:
                    losers[node], best = best, losers[node]
                node >>= 1
            self.winner = best


def _keys(captures: pa.StructArray) -> list[Key]:
    columns = [captures.field(i) for i in range(4)]
    columns[2] = columns[2].fill_null(_NONE)
    return list(zip(*(c.to_pylist() for c in columns)))


def _slices(part: int, run: int, seq: int, captures: pa.StructArray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array([0, len(captures)], pa.int32()), captures)
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([run]), pa.array([seq]), lists.cast(_SLICE.field("captures").type)], schema=_SLICE)


def sorted_runs(captures: DataFrame) -> DataFrame:
    """Blocks of locally sorted runs (part 0, run, seq, captures)."""
    keyed = captures.select(*(F.col(n) if n not in ("url_key", "tie") else {"url_key": url_key(F.col("url")), "tie": F.xxhash64("archive", "offset")}[n].alias(n) for n, _ in FIELDS))

    run_size, block_size = RUN, BLOCK

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 32

        def write(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).sort_by([(n, "ascending") for n, _ in FIELDS[:4]]).combine_chunks()
            rows = pa.StructArray.from_arrays([c.combine_chunks().cast(f.type) if len(table) else pa.array([], f.type) for c, f in zip(table.columns, _ARROW)], fields=list(_ARROW))
            for seq, lo in enumerate(range(0, len(rows), block_size)):
                yield _slices(0, run, seq, rows.slice(lo, block_size))

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, run_size - n)
                held, n, batch = [*held, part], n + part.num_rows, batch.slice(part.num_rows)
                if n == run_size:
                    yield from write(held)
                    held, n, run = [], 0, run + 1
        if n:
            yield from write(held)

    return keyed.mapInArrow(cut, SLICE)


def _splitters(sample: list[Key], parts: int) -> list[Key]:
    return [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []


def _merge(runs: DataFrame, splitters: list[Key], groups: int, last: bool) -> DataFrame:
    """One pass: runs of a group become one, part by part; last: rows (part, place, capture)."""
    spark = runs.sparkSession
    share, block_size = spark.sparkContext.broadcast(splitters), BLOCK

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = share.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                captures, run, seq = row["captures"].flatten(), row["run"][0].as_py(), row["seq"][0].as_py()
                keys, lo = _keys(captures), 0
                part = bisect_left(splitters, keys[0])
                while lo < len(keys):
                    hi = bisect_left(keys, splitters[part], lo) if part < len(splitters) else len(keys)
                    if hi > lo:  # a part holds the keys from its splitter on
                        yield _slices(part, run, seq, captures.slice(lo, hi - lo))
                    lo, part = hi, part + 1

    out = f"part int, place long, c {CAPTURE}" if last else SLICE

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, group = (x.as_py() for x in key)
        table = table.sort_by([("run", "ascending"), ("seq", "ascending")]).combine_chunks()
        lists = table["captures"].combine_chunks()
        captures, sizes = lists.flatten(), lists.value_lengths().to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        runs = table["run"].to_numpy()
        first = np.flatnonzero(np.diff(runs, prepend=runs[0] - 1))
        bounds = starts[np.append(first, len(runs))]
        keys = _keys(captures)
        order, at = np.empty(len(keys), np.int64), bounds[:-1].tolist()
        for n, i in enumerate(LoserTree([keys[a:b] for a, b in zip(bounds, bounds[1:])])):
            order[n] = at[i]
            at[i] += 1
        merged = captures.take(pa.array(order))
        if last:
            return pa.table({"part": pa.array(np.full(len(merged), part, np.int32)), "place": pa.array(np.arange(len(merged))), "c": merged})
        blocks = [_slices(0, group, (part << 32) + seq, merged.slice(lo, block_size)) for seq, lo in enumerate(range(0, len(merged), block_size))]
        return pa.Table.from_batches(blocks, _SLICE)

    cuts = runs.mapInArrow(cut, SLICE).withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int"))
    return cuts.groupBy("part", "group").applyInArrow(lambda key, table: merge(key, table), out)


def merged(captures: DataFrame) -> DataFrame:
    """The captures with part and place: parts follow each other in order, and places number the captures of a part from 0. Stored."""
    runs = stash(sorted_runs(captures), "capture-runs")
    while True:
        n, n_runs = runs.agg(F.coalesce(F.sum(F.size("captures")), F.lit(0)), F.countDistinct("run")).first()
        groups = max(1, -(-n_runs // FAN_IN))
        drawn = runs.select(F.explode("captures").alias("c")).select("c.url_key", "c.date", F.coalesce("c.page_id", F.lit(_NONE)), "c.tie").where(F.rand(17) < SAMPLE / max(n, 1))
        sample = sorted(map(tuple, drawn.collect()))
        parts = max(1, min(MOST_PARTS, n // groups // PART))
        done = stash(_merge(runs, _splitters(sample, parts), groups, groups == 1), "captures")
        if groups == 1:
            return done.select("part", "place", "c.*")
        runs = done


def numbered(parts: DataFrame) -> DataFrame:
    """Captures with place as their number from 0 in the order of all; parts: as `merged` gives them."""
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))  # a row for each of at most MOST_PARTS parts
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return parts.join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("place")).drop("before", "part", "tie")
