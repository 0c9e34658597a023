"""Substring dedup: seed and extend over winnowed anchors, removing repeats of `length` words or more.

Seeds: of the SEED-word runs inside each window of `length` words the one with the smallest hash (leftmost on ties) is the
window's anchor, so equal windows always share their anchor, and an anchor stands for about (length - SEED) / 2 windows.
Only anchors move at first: documents are dealt into groups of bounded size by a hash of id and text, a group sends each of
its anchors once, with the smallest and largest document that has it, and learns which of them other documents have too.

Extension: around each shared anchor a group sends the words that its windows cover; an anchor's occurrences meet in one
bucket and are extended both ways as long as their words are equal to those of a smaller document, which gives maximal
repeats as ranges of starts. Windows are looked up by hash and compared word by word. Of equal windows a group sends only
its smallest document's, having decided its others itself, and anchors that very many groups have meet in salted parts
first, each of which passes on the smallest in the same way: a passage that all documents share is never one task's load.
Rows alike in id and text that would fill a group by themselves become one row with a number beforehand, and as many again
at the end.

Defined results: null and empty texts have no words; rows with a null id neither remove nor lose words; rows with the
same id and text share their result; an id is never smaller than itself; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import buckets_for, stash

BATCH_BYTES = 6 << 20
SEED = 12
#: Bytes of documents in a group.
GROUP_BYTES = 6 << 20
#: What a row takes besides its text; rows of a table that is broadcast, of 24 bytes each.
ROW_BYTES, BROADCAST_ROWS = 64, 1_000_000
#: Groups whose occurrences of one anchor meet in one salted part.
MEET = 4096
#: A run of windows on its way to a bucket, and the one it goes to after a salted part (-1: none). Spans travel as runs of
#: bucket -1 - owner whose text is the last start.
_RUN = "bucket int, after int, owner int, doc long, key long, first long, text binary"
_SPAN = "owner int, doc long, key long, first long, last long"


def anchors(seeds: np.ndarray, windows: int, span: int) -> np.ndarray:
    """For each of `windows` windows the place of the smallest of its `span` seed hashes, leftmost on ties."""

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(seeds[a] <= seeds[b], a, b)

    at, size = np.arange(len(seeds)), 1
    while size * 2 <= span:
        at, size = least(at[:-size], at[size:]), size * 2
    return least(at[:windows], at[span - size : span - size + windows])


def _first_of(values: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each place the place of the smallest document (then the smallest place) among places of the same value."""
    order = np.lexsort((docs, values))
    head = np.ones(len(order), bool)
    head[1:] = values[order[1:]] != values[order[:-1]]
    out = np.empty(len(values), np.int64)
    out[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1] if len(order) else order
    return out


def first_equal(codes: np.ndarray, starts: np.ndarray, hashes: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each window (starts in codes) the index of the smallest document's window of the same words."""
    first = _first_of(hashes, docs)
    far = np.flatnonzero(first != np.arange(len(first)))
    for k in range(length):  # word by word; a hash that two different windows share parts here
        same = codes[starts[far] + k] == codes[starts[first[far]] + k]
        if not same.all():
            clash = np.isin(hashes, hashes[far[~same]])
            which = np.flatnonzero(clash)
            names: dict[bytes, int] = {}
            exact = np.array([names.setdefault(codes[s : s + length].tobytes(), len(names)) for s in starts[which]])
            first[which] = which[_first_of(exact, docs[which])]
            far = far[~clash[far]]
    return first


def _runs(starts: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and sizes of runs of consecutive starts of one kind."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (kind[1:] != kind[:-1])]))
    return first, np.diff(np.append(first, len(starts)))


class _Words:
    """Words of a batch of documents, and the windows in them with their anchors."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, length: int):
        self.data, byte_bounds = T.raw(batch["text"])
        keep = T.SPACED[self.data]
        words, self.bounds = T.split(self.data, byte_bounds)
        self.codes, distinct = T.codes(words)
        self.docs = T.ids(batch["doc_id"])
        values = T.hashes(distinct)[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        rolling = T.Rolling(values)
        seeds, self.hashes = rolling.runs(SEED), rolling.runs(length)
        self.row = np.repeat(np.arange(len(self.docs)), np.diff(self.bounds))
        starts = np.flatnonzero(T.starts_within(self.bounds, length)[: len(self.hashes)])
        self.starts = starts[self.docs[self.row[starts]] != T.NULL_ID]
        self.at = anchors(seeds, len(self.hashes), length - SEED + 1)[self.starts] if len(self.starts) else self.starts
        self.anchors = seeds[self.at].view(np.int64)
        before = np.concatenate([[True], ~keep[:-1]])
        before[byte_bounds[:-1][byte_bounds[:-1] < len(keep)]] = True
        self.begins = np.append(np.flatnonzero(keep & before), len(self.data))

    def text(self, start: int, words: int) -> bytes:
        """The bytes from a word's begin to the end of the last of so many words (blanks of all kinds in between)."""
        last = int(self.begins[start + words - 1])
        stop = int(self.begins[start + words])
        return self.data[int(self.begins[start]) : max(stop, last + 1)].tobytes()


def _spans(owner: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray, kind: np.ndarray) -> list[np.ndarray]:
    head, size = _runs(start, kind)
    return [owner[head], doc[head], key[head], start[head], start[head] + size - 1]


def dealt(docs: DataFrame, groups: int) -> DataFrame:
    """doc_id, text, key (hash of the text) and owner, the group of each row; one shuffle that all steps read."""
    keyed = docs.withColumn("key", _key())
    return keyed.withColumn("owner", F.pmod(F.xxhash64("doc_id", "key"), F.lit(groups)).cast("int")).repartition(groups, "owner")


def repeat_spans(rows: DataFrame, length: int, groups: int) -> DataFrame:
    """Maximal repeats in rows (as dealt): owner, doc, key, and the first and last start of windows met in a smaller document."""

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text", BATCH_BYTES):
            words = _Words(batch, length)
            row = words.row[words.starts]
            owner, doc = batch["owner"].to_numpy()[row].astype(np.int32), words.docs[row]
            order = np.lexsort((doc, owner, words.anchors))
            a, o, d = words.anchors[order], owner[order], doc[order]
            head = np.ones(len(a), bool)
            head[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1])
            first = np.flatnonzero(head)
            last = np.append(first[1:], len(a)) - 1 if len(first) else first
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[first], o[first], d[first], d[last])], ["anchor", "owner", "least", "most"])

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        """One group's shared anchors: spans that it decides itself, and runs of windows for the buckets."""
        words = _Words(left.combine_chunks(), length)
        known, n = right["anchor"].to_numpy(), right["n"].to_numpy()
        order = np.argsort(known)
        known, n = known[order], n[order]
        at = np.searchsorted(known, words.anchors)
        shared = known[np.minimum(at, len(known) - 1)] == words.anchors if len(known) else np.zeros(len(words.anchors), bool)
        starts, anchor, place = words.starts[shared], words.anchors[shared], words.at[shared]
        parts = np.maximum(1, -(-n[at[shared]] // MEET))
        row = words.row[starts]
        doc, key = words.docs[row], left["key"].to_numpy()[row]
        later = doc > doc[first_equal(words.codes, starts, words.hashes[starts], doc, length)]
        owner = int(left["owner"][0].as_py())
        decided = _spans(np.full(len(starts), owner)[later], doc[later], key[later], (starts - words.bounds[row])[later], row[later])
        head, size = _runs(starts[~later], place[~later])
        rest = np.flatnonzero(~later)[head]
        after = np.mod(anchor[rest], groups)
        part = groups + np.mod(anchor[rest] // groups + owner % parts[rest], 1 << 30)
        hot = parts[rest] > 1
        texts = [words.text(int(s), int(c) + length - 1) for s, c in zip(starts[rest], size)]
        sent = [np.where(hot, part, after), np.where(hot, after, -1), np.full(len(rest), owner), doc[rest], key[rest], starts[rest] - words.bounds[row[rest]]]
        return _together(sent, texts, decided)

    def _together(sent: list[np.ndarray], texts: list[bytes], decided: list[np.ndarray]) -> pa.Table:
        owner = decided[0].astype(np.int64)
        whole = [np.concatenate([a, b]) for a, b in zip(sent, [-1 - owner, np.full(len(owner), -1), *decided[:4]])]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array(x.astype(np.int64), pa.int64()).cast(t) for x, t in zip(whole, types)] + [pa.array([*texts, *(b"%d" % x for x in decided[4])], pa.binary())]
        return pa.table(columns, names=["bucket", "after", "owner", "doc", "key", "first", "text"])

    def extended(table: pa.Table) -> tuple:
        """Windows of the runs of a bucket: all it takes to tell the smallest documents of each."""
        table = table.combine_chunks()
        words, bounds = T.split(*T.raw(table["text"]))
        codes, distinct = T.codes(words)
        hashes = T.Rolling(T.hashes(distinct)[codes]).runs(length)
        row = np.repeat(np.arange(table.num_rows), np.diff(bounds))
        starts = np.flatnonzero(T.starts_within(bounds, length)[: len(hashes)])
        row = row[starts]
        doc, key, owner, first = (table[c].to_numpy() for c in ("doc", "key", "owner", "first"))
        place = starts - bounds[row] + first[row]
        least = first_equal(codes, starts, hashes[starts], doc[row], length)
        later = doc[row] > doc[row][least]
        return table, row, starts, bounds, place, later, least == np.arange(len(least)), _spans(owner[row][later], doc[row][later], key[row][later], place[later], row[later])

    def meet(table: pa.Table) -> pa.Table:
        """A bucket's spans; of a salted part also the runs of the windows that were smallest here."""
        if table["bucket"][0].as_py() < 0:
            return table
        none = [np.zeros(0, np.int64)] * 6
        if table["bucket"][0].as_py() < groups:
            return _together(none, [], extended(table)[-1])
        table, row, starts, bounds, place, later, smallest, decided = extended(table)
        words = T.split(*T.raw(table["text"]))[0].to_pylist()
        kept = np.flatnonzero(smallest & ~later)
        head, size = _runs(starts[kept], row[kept])
        rest = kept[head]
        texts = [b" ".join(words[s : s + c + length - 1]) for s, c in zip(starts[rest], size)]
        after, owner, doc, key = (table[c].to_numpy()[row[rest]] for c in ("after", "owner", "doc", "key"))
        return _together([after, np.full(len(rest), -1), owner, doc, key, place[rest]], texts, decided)

    def finish(table: pa.Table) -> pa.Table:
        table = table if table["bucket"][0].as_py() < 0 else _together([np.zeros(0, np.int64)] * 6, [], extended(table)[-1])
        return pa.table({"owner": table["owner"], "doc": table["doc"], "key": table["key"], "first": table["first"], "last": pa.array([int(x) for x in table["text"].to_pylist()], pa.int64())})

    seen = rows.mapInArrow(seed, "anchor long, owner int, least long, most long").repartition(groups, "anchor")
    shared = seen.groupBy("anchor").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.count("*").alias("n")).where("least < most").select("anchor", "n")
    told = seen.select("anchor", "owner").join(shared.hint("shuffle_hash"), "anchor").distinct().repartition(groups, "owner")
    sent = rows.groupBy("owner").cogroup(told.groupBy("owner")).applyInArrow(send, _RUN)
    met = sent.repartition(groups, "bucket").groupBy("bucket").applyInArrow(meet, _RUN)
    return met.repartition(groups, "bucket").groupBy("bucket").applyInArrow(finish, _SPAN)


def remove_repeats(docs: DataFrame, length: int = 50, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with_text kept_text: the words left, joined by one space."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    groups = buckets_for(slim, GROUP_BYTES)
    heavy = stash(_heavy(slim), "heavy")
    n_heavy = heavy.count()
    rows = dealt(_once(slim, heavy, n_heavy) if n_heavy else slim, groups)
    spans = repeat_spans(rows, length, groups).repartition(groups, "owner")

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for doc, key, first, last in zip(*(right[c].to_pylist() for c in ("doc", "key", "first", "last"))):
            by.setdefault((doc, key), []).append((first, last))
        out = []
        for doc, key, text in zip(*(left[c].to_pylist() for c in ("doc_id", "key", "text"))):
            words = (text or "").encode().split()
            n = len(words)
            if found := by.get((doc, key)):
                change = np.zeros(n + 1, np.int64)
                first, last = np.array(found).T
                np.add.at(change, first, 1)
                np.add.at(change, last + length, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:n] == 0)]
            kept = b" ".join(words)
            out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
        columns = [left["doc_id"], *(pa.array(list(c)) for c in zip(*(x[: 3 + with_text] for x in out)))]
        return pa.table(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text])

    columns = "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    if not n_heavy:
        return rows.groupBy("owner").cogroup(spans.groupBy("owner")).applyInArrow(keep, f"doc_id long, {columns}")

    def keyed(left: pa.Table, right: pa.Table) -> pa.Table:
        return keep(left, right).append_column("key", left["key"])

    found = rows.groupBy("owner").cogroup(spans.groupBy("owner")).applyInArrow(keyed, f"doc_id long, {columns}, key long")
    again = found.join(_small(heavy, n_heavy).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "n"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    return again.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("n", F.lit(1).cast("long"))))).select("doc_id", *(c.split()[0] for c in columns.split(", ")))


def _key() -> F.Column:
    return F.coalesce(F.xxhash64("text"), F.lit(0))


def _heavy(docs: DataFrame) -> DataFrame:
    """doc_id, key and number of the rows that are repeated until they would fill a group: at most one for each GROUP_BYTES of input."""
    alike = docs.groupBy("doc_id", _key().alias("key")).agg(F.count("*").alias("n"), F.max(F.octet_length(F.coalesce("text", F.lit("")))).alias("size"))
    return alike.where(f"n > 1 and n * (size + {ROW_BYTES}) >= {GROUP_BYTES}").select("doc_id", "key", "n")


def _small(heavy: DataFrame, n: int) -> DataFrame:
    return F.broadcast(heavy) if n <= BROADCAST_ROWS else heavy


def _once(docs: DataFrame, heavy: DataFrame, n: int) -> DataFrame:
    """Rows with one of each heavy one."""
    known = _small(heavy, n).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (_key() == F.col("_k"))
    one = docs.join(known, same, "left_semi").withColumn("key", _key()).dropDuplicates(["doc_id", "key"]).drop("key")
    return docs.join(known, same, "left_anti").unionByName(one)
