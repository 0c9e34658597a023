"""Hierarchical Pitman-Yor model of word pairs: every word is a context of its own, however many there are.

Restaurants: a token's restaurant is the whole word before it (or the start of the text); the parent of all is the root,
whose base is even over the known tokens and one unknown. Their number grows with the corpus, so nothing of theirs
passes the driver but sums over all of them.

Seating is that of `pitman_yor.seat`: a sweep of Gibbs sampling takes all customers of a dish out of a restaurant and
seats them again, given the parent's predictive probability and the tables of all other dishes. Dishes lie in buckets by
word hash, so a dish's root customers (its tables in all contexts) are at hand; a context's dishes lie in many buckets.
Before each sweep the buckets send their tables of each context to the context's part, which adds them up and answers
every bucket that asked. Within a bucket tables are live (the dishes of a restaurant take turns in ROUNDS), other
buckets' are those of the sweep before. Parts also sum the likelihood of each strength over their restaurants;
discounts come from counts of counts. A sample's probabilities use the totals of that same sweep, so they sum to one in
every restaurant; scores average the samples after the burn-in.

Flow: batches of documents become blocks (a row each: token places, distinct pairs of word and context); pairs meet in
buckets, in packed columns, one share of the buckets after the other; each sweep's tables are stored in the buckets of the pairs; every block gets its pairs'
probabilities back and sums them by document. Words are told apart by 64-bit hashes, contexts by 48 bits of them.

Defined results: those of `pitman_yor`.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .pitman_yor import ROUNDS, START_POWER, STRENGTHS, Hyper, fits, seat, strength_by
from .store import buckets_for, discard, shelve, stash

BATCH_BYTES = 6 << 20
BUCKET_BYTES = 4 << 20
#: Buckets for each part of the contexts.
PER_PART = 16
#: Tables are stored after each step, so no later one reads its shuffles.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Buckets are made in so many shares, one after the other, so that not all pairs are on their way at once.
SHARES = 2
#: Bytes of a context's hash.
CONTEXT = 6


def packed(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte, in as many bytes as the largest needs (said by the first): small numbers stay small."""
    wide = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def length(data: bytes) -> int:
    return (len(data) - 1) // data[0]


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((length(data), 8), np.uint8)
    out[:, : data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1).T
    return out.view("<i8").ravel()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, as rows are large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _trained(doc_ids: np.ndarray, folds: int) -> np.ndarray:
    return np.array([i == T.NULL_ID or zlib.crc32(b"%d" % i) % folds != 0 for i in doc_ids.tolist()], bool)


def _blocks(docs: DataFrame, buckets: int, folds: int) -> DataFrame:
    """A row for each batch: where its tokens are among its pairs, and the pairs by bucket, word and context."""

    def one(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
        words, bounds = T.split(*T.raw(batch["text"]), lower=True)
        index, distinct = T.codes(words)
        del words
        n_docs, doc_ids = batch.num_rows, T.ids(batch["doc_id"])
        # The end is a token, and the start of the text a context, of the same code.
        hashed = T.hashes([*distinct, b" end"])
        bucket = (hashed % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        code = np.empty(len(order), np.int64)
        code[order] = np.arange(len(order))
        hashed, bucket = hashed[order], bucket[order]
        ends = bounds[1:] + np.arange(n_docs)
        token = np.full(len(index) + n_docs, code[-1], np.int64)
        inside = np.ones(len(token), bool)
        inside[ends] = False
        token[inside] = code[index]
        context = np.append(code[-1], token[:-1])
        pair, place = np.unique(token << 32 | context, return_inverse=True)
        trained = np.repeat(_trained(doc_ids, folds), np.diff(bounds) + 1)
        n = np.bincount(place, weights=trained, minlength=len(pair)).astype(np.int64)
        full, cuts = np.unique(bucket, return_index=True)
        columns = {"docs": doc_ids.tobytes(), "bounds": np.concatenate([[0], ends + 1]).astype(np.int64).tobytes(), "places": packed(place), "runs": packed(np.bincount(pair >> 32, minlength=len(hashed)))}
        columns |= {"full": full.astype(np.int32).tobytes(), "cuts": np.append(cuts, len(hashed)).astype(np.int32).tobytes(), "words": hashed.tobytes(), "contexts": packed(pair & 0xFFFFFFFF), "n": packed(n)}
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64())] + [pa.array([x], pa.binary()) for x in columns.values()], ["block", *columns])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(one, T.slices(batches, "text", BATCH_BYTES), itertools.count(TaskContext.get().partitionId() << 24))

    return docs.mapInArrow(block, "block long, docs binary, bounds binary, places binary, runs binary, full binary, cuts binary, words binary, contexts binary, n binary")


def _asked(share: int):
    """Each block's words and pairs, a row for each bucket of a share."""

    def one(r: dict) -> pa.RecordBatch:
        full, cuts, words = np.frombuffer(r["full"], np.int32), np.frombuffer(r["cuts"], np.int32), np.frombuffer(r["words"], np.uint64)
        runs, contexts, n = (unpacked(r[c]) for c in ("runs", "contexts", "n"))
        at = np.concatenate([[0], np.cumsum(runs)])[cuts]
        own = np.flatnonzero(full % SHARES == share)
        pieces = []
        for a, b, c, d in zip(cuts[own].tolist(), cuts[own + 1].tolist(), at[own].tolist(), at[own + 1].tolist()):
            pieces.append((words[a:b].tobytes(), packed(runs[a:b]), packed(words[contexts[c:d]] >> np.uint64(64 - 8 * CONTEXT)), packed(n[c:d])))
        columns = [[p[k] for p in pieces] for k in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(full[own]), pa.array([r["block"]] * len(own), pa.int64())] + [pa.array(x, pa.binary()) for x in columns], ["bucket", "block", "words", "runs", "contexts", "n"])

    return lambda batches: map(one, _rows(batches))


def _gathered(parts: int):
    """One bucket: its distinct words, contexts and pairs with counts, and which of them each block asked for."""

    def run(table: pa.Table) -> pa.Table:
        def all_of(column: str) -> np.ndarray:
            return np.concatenate([unpacked(x.as_py()) for x in table[column]])

        word = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["words"]])
        distinct, word = np.unique(word, return_inverse=True)
        key = all_of("contexts")
        # Contexts lie by part, then by hash.
        met, context = np.unique((key % parts) << 8 * CONTEXT | key, return_inverse=True)
        pair, place = np.unique(np.repeat(word, all_of("runs")) << 32 | context, return_inverse=True)
        count = np.bincount(place, weights=all_of("n"), minlength=len(pair)).astype(np.int64)
        of_word, of_context = pair >> 32, pair & 0xFFFFFFFF
        total = np.bincount(of_word, weights=count, minlength=len(distinct)).astype(np.int64)
        out = {"runs": packed(np.bincount(of_word, minlength=len(distinct))), "contexts": packed(of_context), "counts": packed(count), "totals": packed(total)}
        out |= {"keys": packed(met & (1 << 8 * CONTEXT) - 1), "cuts": np.searchsorted(met, np.arange(parts + 1) << 8 * CONTEXT).astype(np.int32).tobytes()}
        out |= {"sums": packed(np.bincount(of_context, weights=count, minlength=len(met)))}
        out |= {"blocks": table["block"].to_numpy().tobytes(), "sizes": np.array([[length(r.as_py()), length(n.as_py())] for r, n in zip(table["runs"], table["n"])], np.int64).tobytes()}
        out |= {"word_places": packed(word), "places": packed(place)}
        return pa.table({"bucket": table["bucket"].slice(0, 1), "n_tokens": pa.array([int(count.sum())]), "n_types": pa.array([int((total > 0).sum())])} | {k: pa.array([v], pa.binary()) for k, v in out.items()})

    return run


_GATHERED = "bucket int, n_tokens long, n_types long, runs binary, contexts binary, counts binary, totals binary, keys binary, cuts binary, sums binary, blocks binary, sizes binary, word_places binary, places binary"


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a bucket's contexts (and their keys, where given), a row for each part."""
    for r in _rows(batches):
        cuts, sums = np.frombuffer(r["cuts"], np.int32), unpacked(r["sums"])
        full = np.flatnonzero(np.diff(cuts))
        columns = [pa.array(full, pa.int32()), pa.array([r["bucket"]] * len(full), pa.int32()), pa.array([packed(sums[cuts[p] : cuts[p + 1]]) for p in full], pa.binary())]
        if "keys" in r:
            keys = unpacked(r["keys"])
            columns.append(pa.array([packed(keys[cuts[p] : cuts[p + 1]]) for p in full], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, ["part", "bucket", "sums", "keys"][: len(columns)])


def _met(table: pa.Table) -> pa.Table:
    """One part: its distinct contexts with customers, and which of them each bucket asked for."""
    keys = [unpacked(x.as_py()) for x in table["keys"]]
    met, place = np.unique(np.concatenate(keys), return_inverse=True)
    customers = np.bincount(place, weights=np.concatenate([unpacked(x.as_py()) for x in table["sums"]]), minlength=len(met))
    out = {"askers": table["bucket"].to_numpy().astype(np.int32).tobytes(), "sizes": np.array([len(k) for k in keys], np.int64).tobytes(), "places": packed(place), "customers": packed(customers)}
    return pa.table({"part": table["part"].slice(0, 1)} | {k: pa.array([v], pa.binary()) for k, v in out.items()})


def _added(rows: DataFrame, asks: DataFrame, n_buckets: int, discount: float) -> tuple[DataFrame, list[float]]:
    """Each bucket's contexts with sums over all buckets (bucket, got: values by part), and how well each strength fits them as tables of contexts."""
    sent = rows.mapInArrow(_dealt, "part int, bucket int, sums binary").groupBy("part").agg(F.collect_list(F.struct("bucket", "sums")).alias("sent"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            askers, upto = np.frombuffer(r["askers"], np.int32).tolist(), np.cumsum(np.frombuffer(r["sizes"], np.int64)).tolist()
            places, customers = unpacked(r["places"]), unpacked(r["customers"])
            came = {x["bucket"]: x["sums"] for x in r["sent"]}
            sums = np.bincount(places, weights=np.concatenate([unpacked(came[b]) for b in askers]), minlength=len(customers)).astype(np.int64)
            values = [packed(sums[places[lo:hi]]) for lo, hi in zip([0, *upto], upto)]
            fit = [[]] * len(askers) + [fits(customers, sums, discount).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([*askers, -1], pa.int32()), pa.array([r["part"]] * len(fit), pa.int32()), pa.array([*values, b""], pa.binary()), pa.array(fit, pa.list_(pa.float64()))], ["bucket", "part", "sums", "fit"])

    added = stash(asks.join(sent.hint("shuffle_hash"), "part").mapInArrow(add, "bucket int, part int, sums binary, fit array<double>"), "added")
    fit = added.where("bucket < 0").select(F.posexplode("fit").alias("at", "fit")).groupBy("at").agg(F.sum("fit").alias("fit")).collect()
    got = shelve(added.where("bucket >= 0").repartition(n_buckets, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("part", "sums")).alias("got")), "totals", "bucket", n_buckets, dealt=True)
    discard(added)
    return got, [r["fit"] for r in sorted(fit, key=lambda r: r["at"])] or [0.0] * len(STRENGTHS)


def _together(got: list[dict]) -> np.ndarray:
    return np.concatenate([unpacked(x["sums"]) for x in sorted(got, key=lambda x: x["part"])])


class Bucket:
    """The dishes of one bucket, in all contexts and at the root."""

    def __init__(self, row: dict):
        self.number = row["bucket"]
        runs, self.context, self.counts, self.totals = unpacked(row["runs"]), unpacked(row["contexts"]), unpacked(row["counts"]), unpacked(row["totals"])
        self.word = np.repeat(np.arange(len(runs)), runs)
        self.n_contexts = int(np.frombuffer(row["cuts"], np.int32)[-1])
        if row.get("tables") is not None:
            self.tables, self.root_tables = unpacked(row["tables"]), unpacked(row["root_tables"])
        else:
            self.tables = _start(self.counts)
            self.root_tables = _start(self.root_customers())

    def root_customers(self) -> np.ndarray:
        return np.bincount(self.word, weights=self.tables, minlength=len(self.totals)).astype(np.int64)

    def sums(self) -> np.ndarray:
        """Tables of each context in this bucket."""
        return np.bincount(self.context, weights=self.tables, minlength=self.n_contexts).astype(np.int64)

    def root(self, met: tuple[int, int], base: float, hyper: Hyper) -> np.ndarray:
        """The root's probability of each dish; met: customers and tables at the root."""
        d, strength = hyper.discounts[1], hyper.strengths[1]
        return (self.root_customers() - d * self.root_tables + (strength + d * met[1]) * base) / (strength + met[0])

    def predictive(self, customers: np.ndarray, tables: np.ndarray, met: tuple[int, int], base: float, hyper: Hyper) -> np.ndarray:
        """Probability of each pair's word after its context; customers, tables: of each context, over all buckets."""
        d, strength = hyper.discounts[0], hyper.strengths[0]
        parent, own = self.root(met, base, hyper)[self.word], self.context
        return (self.counts - d * self.tables + (strength + d * tables[own]) * parent) / (strength + customers[own])

    def sweep(self, number: int, tables: np.ndarray, met: tuple[int, int], base: float, hyper: Hyper, seed: int) -> None:
        """Seat all dishes anew; tables: of each context over all buckets, and met: at the root, after the sweep before."""
        random = np.random.default_rng([seed, number, self.number])
        came = self.root_customers()
        parent = self.root(met, base, hyper)[self.word]
        self.tables = _seated(self.counts, self.tables, self.context, tables, parent, hyper, 0, random)
        moved = (met[0] + int((self.root_customers() - came).sum()), met[1])
        self.root_tables = _seated(self.root_customers(), self.root_tables, np.zeros(len(self.totals), np.int64), np.array([moved[1]]), np.full(len(self.totals), base), hyper, 1, random)


def _start(customers: np.ndarray) -> np.ndarray:
    return np.where(customers > 0, np.maximum(1, customers**START_POWER), 0).astype(np.int64)


def _seated(customers: np.ndarray, old: np.ndarray, restaurant: np.ndarray, totals: np.ndarray, parent: np.ndarray, hyper: Hyper, level: int, random: np.random.Generator) -> np.ndarray:
    d, strength = hyper.discounts[level], hyper.strengths[level]
    totals, tables = totals.copy(), np.where(customers > 1, old, customers)
    many = np.flatnonzero(customers > 1)
    many = many[np.argsort(restaurant[many], kind="stable")]
    ranked = restaurant[many]
    turns = (np.arange(len(many)) - np.searchsorted(ranked, ranked)) % ROUNDS
    for turn in range(ROUNDS):
        now = many[turns == turn]
        r = restaurant[now]
        rate = (strength + d * np.maximum(totals[r] - old[now], 0)) * parent[now]
        tables[now] = seat(customers[now], rate, d, random, d * parent[now])
        np.add.at(totals, r, tables[now] - old[now])
    return tables


_STATE = "bucket int, tables binary, root_tables binary, cuts binary, sums binary, stats array<long>"


def _state(bucket: Bucket, cuts: bytes) -> pa.RecordBatch:
    root = bucket.root_customers()
    stats = [(bucket.counts == 1).sum(), (bucket.counts == 2).sum(), (root == 1).sum(), (root == 2).sum(), root.sum(), bucket.root_tables.sum()]
    columns = [packed(bucket.tables), packed(bucket.root_tables), cuts, packed(bucket.sums())]
    return pa.RecordBatch.from_arrays([pa.array([bucket.number], pa.int32()), *(pa.array([x], pa.binary()) for x in columns), pa.array([[int(x) for x in stats]], pa.list_(pa.int64()))], ["bucket", "tables", "root_tables", "cuts", "sums", "stats"])


class Sample:
    """One seating of all customers: its tables in the buckets, their sums by context, and what the driver knows of it."""

    def __init__(self, state: DataFrame, asks: DataFrame, n_buckets: int, random: np.random.Generator):
        stats = [int(r["n"]) for r in state.select(F.posexplode("stats").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).orderBy("at").collect()]
        discounts = [min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5 for a, b in (stats[:2], stats[2:4])]
        self.state, self.met = state, (stats[4], stats[5])
        self.totals, fit = _added(state.select("bucket", "cuts", "sums"), asks, n_buckets, discounts[0])
        root = fits(np.array(stats[4:5]), np.array(stats[5:6]), discounts[1])
        self.hyper = Hyper([strength_by(np.array(fit), random), strength_by(root, random)] if stats[4] else [1.0, 1.0], discounts)

    def beside(self, rows: DataFrame, name: str = "") -> DataFrame:
        """rows with this sample's tables and its contexts' totals, met in their buckets."""
        tables = self.state.select("bucket", F.col("tables").alias(f"tables{name}"), F.col("root_tables").alias(f"root_tables{name}"))
        return rows.join(tables.hint("shuffle_hash"), "bucket").join(self.totals.withColumnRenamed("got", f"got{name}").hint("shuffle_hash"), "bucket")

    def drop(self) -> None:
        discard(self.state)
        discard(self.totals)


def _first(parts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_state(Bucket(row), row["cuts"]) for row in _rows(batches))

    return parts.mapInArrow(run, _STATE)


def _next(parts: DataFrame, sample: Sample, number: int, base: float, seed: int) -> DataFrame:
    met, hyper = sample.met, sample.hyper

    def one(row: dict) -> pa.RecordBatch:
        bucket = Bucket(row)
        bucket.sweep(number, _together(row["got"]), met, base, hyper, seed)
        return _state(bucket, row["cuts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(one, _rows(batches))

    return sample.beside(parts).mapInArrow(run, _STATE)


def _answers(buckets: DataFrame, kept: list[Sample], customers: DataFrame, base: float) -> DataFrame:
    """block, bucket, log10 probability of each pair that the block asked for and training count of each word."""
    known = [(s.met, s.hyper) for s in kept]
    rows = buckets.select("bucket", "runs", "contexts", "counts", "totals", "cuts", "blocks", "sizes", "word_places", "places").join(customers.withColumnRenamed("got", "customers").hint("shuffle_hash"), "bucket")
    for k, sample in enumerate(kept):
        rows = sample.beside(rows, str(k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            total, own = 0.0, _together(row["customers"])
            for k, (met, hyper) in enumerate(known):
                bucket = Bucket(row | {"tables": row[f"tables{k}"], "root_tables": row[f"root_tables{k}"]})
                total = total + bucket.predictive(own, _together(row[f"got{k}"]), met, base, hyper)
            logs = np.log10(np.maximum(total / len(known), 1e-300)).astype(np.float32)
            places, words, sizes = unpacked(row["places"]), unpacked(row["word_places"]), np.frombuffer(row["sizes"], np.int64).reshape(-1, 2)
            upto = np.cumsum(sizes, 0)
            for (a, c), (b, d), number in zip((upto - sizes).tolist(), upto.tolist(), np.frombuffer(row["blocks"], np.int64).tolist()):
                sent = (logs[places[c:d]].tobytes(), packed(bucket.totals[words[a:b]]))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([row["bucket"]], pa.int32())] + [pa.array([x], pa.binary()) for x in sent], ["block", "bucket", "logs", "known"])

    return rows.mapInArrow(run, "block long, bucket int, logs binary, known binary")


def score(docs: DataFrame, folds: int = 10, burn_in: int = 3, samples: int = 2, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Rows whose crc32 of the id as text is 0 modulo folds are held out from training.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        return _scored(slim, folds, burn_in, samples, seed)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def _scored(slim: DataFrame, folds: int, burn_in: int, samples: int, seed: int) -> DataFrame:
    n_buckets, n_blocks = buckets_for(slim, BUCKET_BYTES), buckets_for(slim, BATCH_BYTES)
    n_parts = max(8, n_buckets // PER_PART)
    blocks = stash(_blocks(slim, n_buckets, folds), "blocks")
    pairs = blocks.select("block", "full", "cuts", "words", "runs", "contexts", "n")
    asked = (pairs.mapInArrow(_asked(share), "bucket int, block long, words binary, runs binary, contexts binary, n binary").repartition(n_buckets, "bucket") for share in range(SHARES))
    buckets = shelve((x.groupBy("bucket").applyInArrow(_gathered(n_parts), _GATHERED) for x in asked), "buckets", "bucket", n_buckets, dealt=True)
    places = shelve(blocks.select("block", "docs", "bounds", "places", "runs"), "places", "block", n_blocks, dealt=True)
    discard(blocks)
    sums = buckets.agg(F.sum("n_tokens").alias("n"), F.sum("n_types").alias("v")).first()
    n_train, n_types = int(sums.n or 0), int(sums.v or 0)
    base = 1.0 / (n_types + 1)
    asks = shelve(buckets.select("bucket", "cuts", "sums", "keys").mapInArrow(_dealt, "part int, bucket int, sums binary, keys binary").repartition(n_parts, "part").groupBy("part").applyInArrow(_met, "part int, askers binary, sizes binary, places binary, customers binary"), "contexts", "part", n_parts, dealt=True)
    parts = buckets.select("bucket", "runs", "contexts", "counts", "totals", "cuts")
    kept: list[Sample] = []
    if not buckets.isEmpty():
        sample = Sample(shelve(_first(parts), "tables", "bucket", n_buckets, dealt=True), asks, n_buckets, np.random.default_rng([seed, 0]))
        for number in range(burn_in + samples):
            after = Sample(shelve(_next(parts, sample, number, base, seed), "tables", "bucket", n_buckets, dealt=True), asks, n_buckets, np.random.default_rng([seed, number + 1]))
            if number <= burn_in:
                sample.drop()
            sample = after
            if number >= burn_in:
                kept.append(sample)
    if not kept:
        return slim.sparkSession.createDataFrame([], _SCORED)
    customers, _ = _added(buckets.select("bucket", "cuts", "sums"), asks, n_buckets, 0.5)
    answers = _answers(buckets, kept, customers, base)
    met = answers.repartition(n_blocks, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "logs", "known")).alias("answers"))

    def one(row: dict) -> pa.RecordBatch:
        doc_ids, bounds, places = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["bounds"], np.int64), unpacked(row["places"])
        came = sorted(row["answers"], key=lambda r: r["bucket"])
        logs = np.concatenate([np.frombuffer(r["logs"], np.float32) for r in came]).astype(np.float64)
        known = np.repeat(np.concatenate([unpacked(r["known"]) for r in came]), unpacked(row["runs"]))
        flat = np.log10((known + 0.1) / (n_train + 0.1 * (n_types + 1)))
        n = np.diff(bounds)
        columns = [T.id_column(doc_ids), pa.array(~_trained(doc_ids, folds)), pa.array(n), pa.array(np.add.reduceat((known > 0)[places].astype(np.int64), bounds[:-1])), pa.array(np.full(len(n), n_train))]
        columns += [pa.array(np.add.reduceat(x[places], bounds[:-1])) for x in (flat, logs)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return places.join(met.hint("shuffle_hash"), "block").mapInArrow(lambda batches: map(one, _rows(batches)), _SCORED)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
