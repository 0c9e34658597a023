"""Benchmark decontamination: a prefix-filtered set join of item windows with document words, verified exactly.

Each run of `window` words of an item is a record to be contained whole; an item with fewer words is one record. The
words of all records are ordered by their number in the documents, rarest first. A record that is contained whole
needs its rarest word in the document, so that one word is its necessary prefix and the join key; a match of the key
must leave room for the record's words before and behind it within the document (position and length bounds), and
then all words are compared. Items are read in blocks of bounded
words (a longer item lies in several, which overlap by a window less one word); each is one pass over the documents, whose
hits are stored before the next begins, so that neither the driver nor a task holds more than one block.

Defined results: null and empty texts have no words and no hits; an item without words has no windows; windows of
items without an id hit like any other, but name no item (unnamed says that a document has one); null ids and repeated rows come back as they are, a repeated item id counts once; empty tables give no rows (documents) or no
hits (items); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import stash

BATCH_BYTES = 4 << 20
#: Words of items in one broadcast block.
BLOCK_WORDS = 1 << 20


def _item_words(text: str | None) -> pa.BinaryArray:
    return T.split(*T.raw(pa.array([text], pa.string())), T.ALNUM, lower=True)[0]


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[list[tuple[str | None, pa.BinaryArray]]]:
    """Items with their words, block by block; the driver holds one block at a time."""
    block, size, most = [], 0, max(BLOCK_WORDS, 2 * window)
    for item, text in items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").toLocalIterator():
        words, at = _item_words(text), 0
        while at < len(words):
            part = words.slice(at, most - size)
            whole = len(part) == len(words)
            # A part has a buffer of its own: a slice would carry all of a long item along.
            block.append((item, words if whole else pa.array(part.to_pylist(), pa.binary())))
            size += len(part)
            at = len(words) if at + len(part) == len(words) else at + len(part) - window + 1
            if size + window > most:
                yield block
                block, size = [], 0
    if block:
        yield block


class _Records:
    """One block, ordered by rarity: records by their key word."""

    def __init__(self, block: list[tuple[str | None, pa.BinaryArray]], counts: dict[bytes, int], window: int):
        self.items = list(dict.fromkeys(item for item, _ in block))
        number = {item: i for i, item in enumerate(self.items)}
        coded = pa.concat_arrays([words for _, words in block]).dictionary_encode()
        self.vocabulary, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        rarity = np.array([counts.get(w, 0) for w in self.vocabulary.to_pylist()], np.int64)
        sizes = np.array([len(words) for _, words in block])
        starts, owner = np.concatenate([[0], np.cumsum(sizes)]), np.array([number[item] for item, _ in block])
        # Every window of the long items, and each short item as one record with nothing behind it.
        begin = [np.arange(starts[i], starts[i + 1] - window + 1) for i in np.flatnonzero(sizes >= window)]
        at = np.concatenate([*begin, starts[:-1][sizes < window]]).astype(np.int64)
        whose = np.concatenate([np.repeat(owner[sizes >= window], sizes[sizes >= window] - window + 1), owner[sizes < window]])
        length = np.concatenate([np.full(sum(map(len, begin)), window), sizes[sizes < window]])
        inside = np.arange(window) < length[:, None]
        words = np.where(inside, codes[np.minimum(at[:, None] + np.arange(window), len(codes) - 1)], -1).astype(np.int32)
        rows, record = np.unique(np.ascontiguousarray(words).view(np.dtype((np.void, 4 * window))).ravel(), return_inverse=True)
        self.words = rows.view(np.int32).reshape(-1, window)
        self.length = (self.words >= 0).sum(axis=1)
        rank = np.where(self.words >= 0, rarity[self.words] * len(rarity) + self.words, np.iinfo(np.int64).max)
        self.offset = rank.argmin(axis=1)
        key = self.words[np.arange(len(self.words)), self.offset]
        self.by_key = np.argsort(key, kind="stable")
        self.first = np.searchsorted(key[self.by_key], np.arange(len(rarity) + 1))
        pairs = np.unique(record.astype(np.int64) * len(self.items) + whose)
        self._owner = pairs % len(self.items)
        self._owned = np.searchsorted(pairs // len(self.items), np.arange(len(self.words) + 1))

    def owners(self, record: int) -> list[str | None]:
        """The items that hold a record."""
        return [self.items[i] for i in self._owner[self._owned[record] : self._owned[record + 1]]]

    def matches(self, words: pa.BinaryArray, row_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of records among the words of all rows, and the records."""
        coded = words.dictionary_encode()
        known = pc.index_in(coded.dictionary, self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
        ids = known[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        n_records = np.diff(self.first)
        places = np.flatnonzero((ids >= 0) & (n_records[ids] > 0))
        low = np.repeat(row_bounds[:-1], np.diff(row_bounds))
        high = np.repeat(row_bounds[1:], np.diff(row_bounds))
        for at in range(0, len(places), 20_000):  # bounded, however common the key words are
            place = places[at : at + 20_000]
            many = n_records[ids[place]]
            for lo in range(0, int(many.max()), 256):
                take = np.clip(many - lo, 0, 256)
                where = np.repeat(place, take)
                nth = np.arange(len(where)) - np.repeat(np.cumsum(take) - take, take) + lo
                record = self.by_key[self.first[ids[where]] + nth]
                start = where - self.offset[record]
                fits = (start >= low[where]) & (start + self.length[record] <= high[where])
                start, record = start[fits], record[fits]
                for k in range(self.words.shape[1]):
                    inside = k < self.length[record]
                    same = ~inside | (ids[np.minimum(start + k, len(ids) - 1)] == self.words[record, k])
                    start, record = start[same], record[same]
                found.append((start, record))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def word_counts(docs: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """How often each of the wanted words (those of one block of items) is in the documents."""
    share = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, total = pa.array(share.value, pa.binary()), np.zeros(len(share.value), np.int64)
        for batch in T.slices(batches, "text", BATCH_BYTES):
            words, _ = T.split(*T.raw(batch["text"]), T.ALNUM, lower=True)
            coded = words.dictionary_encode()
            at = pc.index_in(coded.dictionary, vocabulary).to_numpy(zero_copy_only=False)
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(at))
            known = ~np.isnan(at)
            total[at[known].astype(np.int64)] += n[known]
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["word", "n"])

    rows = docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {wanted[r.word]: r.n for r in rows.toLocalIterator()}


def _union_length(spans: Column) -> Column:
    """Words that lie in any of the spans."""
    seen = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def grow(seen: Column, x: Column) -> Column:
        end = x.start + x.length
        return F.struct(F.greatest(seen.end, end).alias("end"), (seen.n + F.greatest(end - F.greatest(seen.end, x.start), F.lit(0))).alias("n"))

    return F.aggregate(F.array_sort(spans), seen, grow, lambda seen: seen.n)


def contained_items(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (sorted strings), unnamed, spans (start, length in words).

    One block of items is one pass over the documents; of more blocks, each is a pass of its own, whose hits are stored and meet by document.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = slim.withColumn("key", F.xxhash64("doc_id", "text"))
    def against(share: Broadcast | None):
        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            records = _Records(*share.value, window) if share else None
            for batch in T.slices(batches, "text", BATCH_BYTES):
                words, bounds = T.split(*T.raw(batch["text"]), T.ALNUM, lower=True)
                hit = np.zeros(len(words) + 1, np.int64)
                owners: dict[int, set[str | None]] = {}
                spans: dict[int, set[tuple[int, int]]] = {}
                if records:
                    start, record = records.matches(words, bounds)
                    np.add.at(hit, start, 1)
                    np.add.at(hit, start + records.length[record], -1)
                    for row, s, r in zip(np.searchsorted(bounds, start, "right") - 1, start, record):
                        owners.setdefault(int(row), set()).update(records.owners(r))
                        spans.setdefault(int(row), set()).add((int(s - bounds[row]), int(records.length[r])))
                n_hit = T.row_sums(np.cumsum(hit)[:-1] > 0, bounds)
                rows = range(batch.num_rows)
                columns = [batch["doc_id"], batch["key"], pa.array(np.diff(bounds)), pa.array(n_hit), pa.array([sorted(x for x in owners.get(r, ()) if x is not None) for r in rows], pa.list_(pa.string())), pa.array([None in owners.get(r, ()) for r in rows]), pa.array([[{"start": a, "length": b} for a, b in sorted(spans.get(r, ()))] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_words", "n_hit", "item_ids", "unnamed", "spans"])

        return keyed.mapInArrow(join, "doc_id long, key long, n_words long, n_hit long, item_ids array<string>, unnamed boolean, spans array<struct<start: long, length: long>>")

    def shared(block: list[tuple[str | None, pa.BinaryArray]]) -> Broadcast:
        wanted = pa.concat_arrays([words for _, words in block]).unique().to_pylist()
        return spark.sparkContext.broadcast((block, word_counts(slim.select("text"), wanted)))

    blocks = _blocks(items, item_col, item_text_col, window)
    block, following = next(blocks, None), next(blocks, None)
    if following is None:
        return against(shared(block) if block else None).drop("key")
    parts = []
    while block is not None:
        share = shared(block)
        parts.append(stash(against(share).where("n_hit > 0").select("key", "item_ids", "unnamed", "spans"), "hits"))
        share.destroy()
        block, following = following, next(blocks, None)
    found = reduce(DataFrame.unionByName, parts)
    found = found.groupBy("key").agg(F.flatten(F.collect_set("item_ids")).alias("item_ids"), F.bool_or("unnamed").alias("unnamed"), F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"))
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    rows = keyed.select("doc_id", "key", n_words.alias("n_words")).join(found.hint("shuffle_hash"), "key", "left")
    none = F.array().cast("array<string>")
    spans = F.coalesce("spans", F.array().cast("array<struct<start: long, length: long>>"))
    return rows.select("doc_id", "n_words", _union_length(spans).alias("n_hit"), F.coalesce(F.array_sort(F.array_distinct("item_ids")), none).alias("item_ids"), F.coalesce("unnamed", F.lit(False)).alias("unnamed"), F.array_sort(spans).alias("spans"))
