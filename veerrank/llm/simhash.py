"""SimHash near-dedup by anchor-point covering.

Anchors are the words of a covering code: two copies of the perfect binary Golay code of length 23, which reach every
46-bit value within 3 flipped bits a half. A fingerprint's home is the anchor nearest to it; it also visits each
anchor that could be the home of a fingerprint within `distance` flipped bits, that is each anchor whose halves need no
more than `distance` flips beyond the covering radius in all. Two linked fingerprints therefore meet at the home of
either, and all 64 bits are compared there. Anchors that are home to many fingerprints, or are visited by very many, are cut into tiles of bounded
size, and a tile gives a spanning forest of its links instead of all pairs.

With `similarity`, texts whose sets of shingles are that alike (Jaccard) link as well. At 0.8 about ten of 64 bits
differ, far beyond what anchors reach at a bearable number of visits, so these pairs meet by bands of minima over their
shingles and are compared set by set (by 32 bits of each shingle's hash). A pair of similarity 0.8 shares none of the
BANDS bands of ROWS minima with probability 3e-5, a closer pair more seldom. Texts without words are left to the
fingerprint.

Defined results: texts without words (null, empty) have fingerprint zero and link like any other; null ids keep their
rows and never lend their id to a group unless the whole group has none; repeated rows come back as they are; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .components import components
from .store import discard, stash

BATCH_BYTES = 4 << 20
RADIUS, HALF, CHECKS = 3, 23, 11
#: Generator polynomial of the binary Golay code (fixed value): x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
#: Homes or visits at an anchor from which it is cut into tiles, and members of a tile's side.
HOT, VISITS, TILE = 256, 16_384, 2048
#: Bands of minima, minima in each, and the odd multipliers that order shingles anew for every minimum.
BANDS, ROWS = 20, 4
ORDERS = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Members of a band's tile side, and their shingles.
ALIKE_TILE, ALIKE_SHINGLES = 1024, 2_000_000


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of the lower-cased words, repeats included; fewer words are one shingle."""
    words = text.lower().split()
    size = min(shingle, len(words))
    n = len(words) - size + 1 if words else 0
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(size)))), repeat(42)), np.uint64, n)


def fingerprint(values: np.ndarray) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    n = len(values)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(values[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def bands(values: np.ndarray) -> list[int]:
    """A key of each band of minima over distinct shingle hashes."""
    least = np.full(len(ORDERS), np.iinfo(np.uint64).max)
    for at in range(0, len(values), 2048):
        np.minimum(least, (values[at : at + 2048, None] * ORDERS).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of every row; with sets also set (names the set of shingles), bands and shingles."""
    schema = "doc_id long, fp long" + (", set long, bands array<long>, shingles array<int>" if sets else "")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text", BATCH_BYTES):
            found, named, keys, members = [], [], [], []
            for x in batch["text"].to_pylist():
                values = shingle_hashes((x or "").encode(), shingle)
                found.append(fingerprint(values))
                if sets:
                    values = np.unique(values)
                    named.append(xxhash.xxh64_intdigest(values.tobytes(), 7) - (1 << 63) if len(values) else None)
                    keys.append(bands(values) if len(values) else None)
                    members.append(np.unique(values.astype(np.uint32).view(np.int32)) if len(values) else None)
            columns = [batch["doc_id"], pa.array(found, pa.int64())]
            if sets:
                columns += [pa.array(named, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(members, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "set", "bands", "shingles"][: len(columns)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(make, schema)


def _syndrome(values: np.ndarray) -> np.ndarray:
    left = values.astype(np.int64)
    for bit in range(HALF - 1, CHECKS - 1, -1):
        left = np.where(left >> bit & 1, left ^ (GOLAY << (bit - CHECKS)), left)
    return left


def flips(distance: int) -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: bit patterns that lead from a value to the anchors within radius + distance, and their flips beyond the radius (padded with 99)."""
    patterns = [0]
    for weight in range(1, RADIUS + distance + 1):
        patterns += [sum(1 << i for i in c) for c in combinations(range(HALF), weight)]
    patterns = np.array(patterns, np.int64)
    extra = np.maximum(np.bitwise_count(patterns).astype(np.int64) - RADIUS, 0)
    syndrome = _syndrome(patterns)
    order = np.lexsort((extra, syndrome))
    count = np.bincount(syndrome, minlength=1 << CHECKS)
    place = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
    table, beyond = np.zeros((1 << CHECKS, count.max()), np.int64), np.full((1 << CHECKS, count.max()), 99, np.int64)
    table[syndrome[order], place], beyond[syndrome[order], place] = patterns[order], extra[order]
    return table, beyond


def members(found: DataFrame, distance: int) -> DataFrame:
    """anchor, fp, home: every anchor that a distinct fingerprint visits."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, beyond = flips(distance)
        mask = (1 << HALF) - 1
        for batch in batches:
            values = batch["fp"].to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 1024):
                fp = values[at : at + 1024]
                halves = [fp & mask, fp >> HALF & mask]
                syndromes = [_syndrome(h) for h in halves]
                words = [(h[:, None] ^ table[s]) >> CHECKS for h, s in zip(halves, syndromes)]
                need = beyond[syndromes[0]][:, :, None] + beyond[syndromes[1]][:, None, :]
                who, i, j = np.nonzero(need <= distance)
                anchor = words[0][who, i] << (HALF - CHECKS) | words[1][who, j]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(fp[who]), pa.array(need[who, i, j] == 0)], ["anchor", "fp", "home"])

    return found.mapInArrow(visit, "anchor int, fp long, home boolean")


def _forest(distance: int):
    def forest(table: pa.Table) -> pa.Table:
        left = np.unique(table["fp"].to_numpy())
        parents, children = [], []
        front = left[:0]
        while len(left):
            if not len(front):
                front, left = left[:1], left[1:]
            new = []
            for at in range(0, len(front), 256):
                part = front[at : at + 256]
                near = np.bitwise_count(part[:, None] ^ left[None, :]) <= distance
                hit = near.any(axis=0)
                parents.append(part[near.argmax(axis=0)[hit]])
                children.append(left[hit])
                new.append(left[hit])
                left = left[~hit]
            front = np.concatenate(new)
        empty = np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.concatenate([empty, *parents])), "b": pa.array(np.concatenate([empty, *children]))})

    return forest


def links(found: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all that differ in `distance` bits or fewer."""
    met = members(found, distance)
    homes = met.where("home").select("anchor", F.col("fp").alias("a"))
    homes = stash(homes, "homes")
    visited = met.groupBy("anchor").agg(F.count("*").alias("visits"), F.count_if("home").alias("n"))
    hot = stash(visited.where((F.col("n") > HOT) | (F.col("n") > 0) & (F.col("visits") > VISITS)), "hot-anchors")
    few, many = homes.join(hot, "anchor", "left_anti"), homes.join(hot.select("anchor"), "anchor")
    pairs = met.select("anchor", F.col("fp").alias("b")).join(few.hint("shuffle_hash"), "anchor")
    pairs = pairs.where((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & (F.col("a") != F.col("b"))).select("a", "b")
    if hot.isEmpty():
        return pairs
    # A hot anchor's homes and visitors are cut into tiles; each tile of homes meets each tile of visitors.
    guests = met.join(hot.select("anchor"), "anchor").select("anchor", "fp")
    sides = hot.select("anchor", F.ceil(F.col("n") / TILE).cast("int").alias("rows"), F.ceil(F.col("visits") / TILE).cast("int").alias("columns"))

    def tile(side: str, other: str) -> tuple:
        own = F.pmod(F.xxhash64("fp"), F.col(side)).cast("int").alias(side)
        return own, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)

    left = many.select("anchor", F.col("a").alias("fp")).join(sides, "anchor").select("anchor", "fp", *tile("rows", "columns"))
    right = guests.join(sides, "anchor").select("anchor", "fp", *tile("columns", "rows"))
    tiles = left.unionByName(right).groupBy("anchor", "rows", "columns").applyInArrow(_forest(distance), "a long, b long")
    return pairs.unionByName(tiles)


def _alike_forest(similarity: float):
    def forest(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        fp, first = table["fp"].to_numpy(), np.unique(table["set"].to_numpy(), return_index=True)[1]
        lists = table["shingles"].combine_chunks().take(pa.array(first))
        fp, sizes = fp[first], np.diff(lists.offsets.to_numpy())
        codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        ends = np.cumsum(sizes)
        parents, children = [], []
        left = np.ones(len(fp), bool)
        flat, starts, rest = codes, ends - sizes, np.arange(len(fp))  # what is left, packed again when half has gone
        mark = np.zeros(len(codes), bool)
        front: list[int] = []
        while left.any():
            if not front:
                front.append(int(np.flatnonzero(left)[0]))
                left[front[0]] = False
            at = front.pop()
            if 2 * np.count_nonzero(left[rest]) < len(rest):
                keep = left[rest]
                flat, rest = flat[np.repeat(keep, sizes[rest])], rest[keep]
                starts = np.cumsum(sizes[rest]) - sizes[rest]
            if not len(rest):
                break
            own = codes[ends[at] - sizes[at] : ends[at]]
            mark[own] = True
            shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[own] = False
            new = rest[left[rest] & (shared >= similarity * (sizes[at] + sizes[rest] - shared) - 1e-9)]
            left[new] = False
            front += new.tolist()
            parents.append(np.repeat(fp[at], len(new)))
            children.append(fp[new])
        empty = np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.concatenate([empty, *parents])), "b": pa.array(np.concatenate([empty, *children]))})

    return forest


def alike(rows: DataFrame, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) of fingerprints of rows (as made with sets) that connect all texts alike enough, and the stored tables that they are read from."""
    rows = rows.where("set IS NOT NULL")
    # One set of shingles may come in several fingerprints, as these count repeats.
    named = stash(rows.select("set", "fp").distinct(), "sets")
    same = named.join(named.groupBy("set").agg(F.min("fp").alias("a")), "set").where("a <> fp").select("a", F.col("fp").alias("b"))
    met = stash(rows.select("set", F.size("shingles").alias("size"), F.explode("bands").alias("key")).distinct(), "bands")
    # A band's members are cut into tiles, each met by each; bands with the same members are one.
    shared = met.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.sum(F.xxhash64("set").cast("decimal(38,0)")).alias("mark")).where("n > 1")
    sides = F.ceil(F.greatest(F.col("n") / ALIKE_TILE, F.col("shingles") / ALIKE_SHINGLES)).cast("int").alias("sides")
    shared = shared.groupBy("n", "shingles", "mark").agg(F.min("key").alias("key")).select("key", sides)
    dealt = met.join(shared.hint("shuffle_hash"), "key").withColumn("own", F.pmod(F.xxhash64("set"), "sides").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    tiles = stash(dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "set"), "band-tiles")
    dealt = tiles.join(rows.select("set", "fp", "shingles").dropDuplicates(["set"]), "set")
    return same.unionByName(dealt.groupBy("key", "i", "j").applyInArrow(_alike_forest(similarity), "a long, b long")), [named, met, tiles]


def near_duplicates(docs: DataFrame, distance: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) for every row of docs.

    Links are fingerprints within `distance` bits and, given a similarity, sets of shingles that are that alike."""
    rows = stash(fingerprints(docs, shingle, id_col, text_col, sets=similarity is not None), "fingerprints")
    found = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    pairs, gone = links(found.select("fp"), distance), []
    slim = rows.select("doc_id", "fp")
    if similarity is not None:
        more, gone = alike(rows, similarity)
        pairs, gone, slim = pairs.unionByName(more), [*gone, rows], stash(slim, "fingerprints")
    groups = components(pairs, "a", "b")
    grouped = found.join(groups, found.fp == groups.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    grouped = stash(grouped, "grouped")
    for table in gone:  # the sets of shingles are what takes the room, and are needed no more
        discard(table)
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return slim.join(grouped.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
