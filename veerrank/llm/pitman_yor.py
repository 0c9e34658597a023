"""Hierarchical Pitman-Yor language model with endings of words as contexts, trained and scored on Spark.

A coarse model with a bounded number of restaurants; op2 takes whole words as contexts (`word_pitman_yor`), with the
law of seating, strengths and starting tables of this module.

Restaurants: a token's context is the end of the word before it. A leaf restaurant stands for the last two bytes of
that word (or the start of the text), its parent for the last byte, and all parents share the root; the root's base is
even over the known tokens and one unknown. Contexts are thus at most 65,536 whatever the corpus, so the restaurants'
totals are small; the customers (word, context, count) grow with the corpus and stay distributed by word.

Seating: a sweep of Gibbs sampling takes all customers of a dish out of a restaurant and seats them again by the Chinese
restaurant law, given the parent's predictive probability and the tables of all other dishes: those of the bucket's own
dishes as they are now (the dishes of a restaurant take turns in ROUNDS), those of other buckets as the sweep before left
them, which is what spreads the work. Customers come in groups of 1 / GROUP of those seated, so one by one at first; a
group opens a binomial number of tables. The tables of a restaurant are the customers of its parent. Draws come from
seeds by bucket and sweep, so that a sweep can be made again instead of being stored. After each sweep the restaurants'
totals are summed anew; from them come each level's strength (drawn from a grid by its likelihood) and, from counts of
counts, its discount. A sample's predictive probabilities use the totals of that same sweep, so that they sum to one in
every restaurant; scores average the samples after the burn-in.

Flow: batches of documents become blocks (a row each: token places, distinct pairs of word and context); pairs meet in
buckets by word hash, in packed columns; sweeps run over buckets; every block gets its pairs' probabilities back and
sums them by document. Words are told apart by 64-bit hashes.

Defined results: null and empty texts are one end token; null ids are trained on; repeated rows count as often as they
come; without training tokens every token is unknown; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import buckets_for, stash

BATCH_BYTES = 8 << 20
BUCKET_BYTES = 6 << 20
#: Customers come in groups of this share of those seated, at least one.
GROUP = 8
#: Turns in which the dishes of one restaurant are seated within a bucket.
ROUNDS = 2
#: Sampling starts from as many tables as customers to this power, near where it settles.
START_POWER = 0.9
#: Strengths that a level chooses from.
STRENGTHS = 2.0 ** np.arange(-4, 17)
#: Restaurants of each level: leaf, parent, root.
SIZES = (1 << 16, 1 << 8, 1)


def _blocks(docs: DataFrame, buckets: int, folds: int) -> DataFrame:
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in T.slices(batches, "text", BATCH_BYTES):
            words, bounds = T.split(*T.raw(batch["text"]), lower=True)
            index, distinct = T.codes(words)
            n_docs = batch.num_rows
            doc_ids = T.ids(batch["doc_id"])
            trained = np.array([i == T.NULL_ID or zlib.crc32(b"%d" % i) % folds != 0 for i in doc_ids.tolist()])
            # Each row's words, then one end (the last of the distinct tokens).
            ends = bounds[1:] + np.arange(n_docs)
            token = np.full(len(index) + n_docs, len(distinct), np.int64)
            inside = np.ones(len(token), bool)
            inside[ends] = False
            token[inside] = index
            context_of = np.array([w[-1] << 8 | (w[-2] if len(w) > 1 else 0) for w in distinct] + [0], np.int64)
            context = np.zeros(len(token), np.int64)
            context[1:] = context_of[token[:-1]]
            pair, place = np.unique(token << 16 | context, return_inverse=True)
            row = np.repeat(np.arange(n_docs), np.diff(bounds) + 1)
            n = np.bincount(place, weights=trained[row], minlength=len(pair)).astype(np.int32)
            word = np.append(T.hashes(distinct), T.hashes([b" end"]))[pair >> 16]
            bucket = (word % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at = np.empty(len(order), np.int32)
            at[order] = np.arange(len(order))
            full, cuts = np.unique(bucket[order], return_index=True)
            cuts = np.append(cuts, len(order)).astype(np.int32)
            number = (TaskContext.get().partitionId() << 24) + made
            made += 1
            parts = [doc_ids, np.concatenate([[0], ends + 1]), at[place], full.astype(np.int32), cuts, word[order], (pair & 0xFFFF)[order].astype(np.uint16), n[order]]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())] + [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts], ["block", "docs", "bounds", "places", "full", "cuts", "word", "context", "n"])

    return docs.mapInArrow(block, "block long, docs binary, bounds binary, places binary, full binary, cuts binary, word binary, context binary, n binary")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's pairs, a row for each bucket."""
    for batch in batches:
        for r in batch.to_pylist():
            full, cuts = np.frombuffer(r["full"], np.int32), np.frombuffer(r["cuts"], np.int32).tolist()
            columns = [pa.array(full), pa.array([r["block"]] * len(full), pa.int64())] + [pa.array([r[c][a * w : b * w] for a, b in zip(cuts, cuts[1:])], pa.binary()) for c, w in (("word", 8), ("context", 2), ("n", 4))]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "word", "context", "n"])


def _gathered(table: pa.Table) -> pa.Table:
    """One bucket: its distinct words and pairs with counts, and which pairs each block asked for."""
    word, context, n = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table[c]]) for c, t in (("word", np.uint64), ("context", np.uint16), ("n", np.int32)))
    sizes = [len(x.as_py()) // 4 for x in table["n"]]
    distinct, code = np.unique(word, return_inverse=True)
    pair, place = np.unique(code.astype(np.int64) << 16 | context, return_inverse=True)
    count = np.bincount(place, weights=n, minlength=len(pair)).astype(np.int64)
    total = np.bincount(pair >> 16, weights=count, minlength=len(distinct)).astype(np.int64)
    out = {"pairs": pair, "counts": count, "totals": total, "blocks": table["block"].to_numpy(), "sizes": np.array(sizes, np.int64), "places": place.astype(np.int32)}
    return pa.table({"bucket": table["bucket"].slice(0, 1), "n_tokens": pa.array([int(count.sum())]), "n_types": pa.array([int((total > 0).sum())])} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in out.items()})


def seat(customers: np.ndarray, rate: np.ndarray, discount: float, random: np.random.Generator, growth: np.ndarray | float = 0.0) -> np.ndarray:
    """Tables that customers of one dish take; rate: (strength + discount * the restaurant's other tables) * the parent's probability, growing by growth with every own table."""
    tables = np.minimum(customers, 1)
    growth = np.broadcast_to(growth, tables.shape)
    live, seated = np.flatnonzero(customers > 1), 1
    while len(live):
        group = max(1, seated // GROUP)
        own, many = tables[live], np.minimum(group, customers[live] - seated)
        new = rate[live] + growth[live] * own
        p = new / (new + np.maximum(seated + (many - 1) / 2 - discount * own, 1e-9))
        tables[live] += random.random(len(live)) < p if group == 1 else random.binomial(many, p)
        seated += group
        live = live[customers[live] > seated]
    return tables


class Hyper:
    """Strength and discount of each level."""

    def __init__(self, strengths: list[float], discounts: list[float]):
        self.strengths, self.discounts = strengths, discounts


class _Bucket:
    """The dishes of one bucket in all restaurants."""

    def __init__(self, row: dict):
        self.number = row["bucket"]
        pairs, counts = np.frombuffer(row["pairs"], np.int64), np.frombuffer(row["counts"], np.int64)
        self.words = np.frombuffer(row["totals"], np.int64)
        middle, self.up = np.unique(pairs >> 16 << 8 | (pairs & 0xFFFF) >> 8, return_inverse=True)
        self.root = middle >> 8
        self.restaurant = [pairs & 0xFFFF, middle & 0xFF, np.zeros(len(self.words), np.int64)]
        self.customers, self.tables, self.turns = [counts, None, None], [None] * 3, []
        for level in range(3):
            n = self.customers[level]
            self.tables[level] = np.where(n > 0, np.maximum(1, n**START_POWER), 0).astype(np.int64)
            if level < 2:
                self._pass_up(level)
            order = np.argsort(self.restaurant[level], kind="stable")
            ranked = self.restaurant[level][order]
            turn = np.empty(len(order), np.int64)
            turn[order] = (np.arange(len(order)) - np.searchsorted(ranked, ranked)) % ROUNDS
            self.turns.append(turn)

    def _pass_up(self, level: int) -> None:
        to, n = (self.up, len(self.root)) if level == 0 else (self.root, len(self.words))
        self.customers[level + 1] = np.bincount(to, weights=self.tables[level], minlength=n).astype(np.int64)

    def predictive(self, totals: list[np.ndarray], base: float, hyper: Hyper, level: int) -> np.ndarray:
        """Probability of each dish of a level."""
        if level > 2:
            return np.full(len(self.words), base)
        parent = self.parent(totals, base, hyper, level)
        customers, tables = (x[self.restaurant[level]] for x in totals[level])
        d, strength = hyper.discounts[level], hyper.strengths[level]
        return (self.customers[level] - d * self.tables[level] + (strength + d * tables) * parent) / (strength + customers)

    def parent(self, totals: list[np.ndarray], base: float, hyper: Hyper, level: int) -> np.ndarray:
        """The parent's probability of each dish of a level."""
        found = self.predictive(totals, base, hyper, level + 1)
        return found[self.up] if level == 0 else found[self.root] if level == 1 else found

    def _sums(self, level: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.restaurant[level], weights=values, minlength=SIZES[level]).astype(np.int64)

    def sweep(self, number: int, before: list[np.ndarray], base: float, hyper: Hyper, seed: int) -> None:
        """Seat all dishes anew; before: all restaurants' totals after the sweep before."""
        random = np.random.default_rng([seed, number, self.number])
        totals = [x.copy() for x in before]
        for level, (d, strength) in enumerate(zip(hyper.discounts, hyper.strengths)):
            parent, r = self.parent(totals, base, hyper, level), self.restaurant[level]
            old = self.tables[level]
            tables = np.where(self.customers[level] > 1, old, self.customers[level])
            for turn in range(ROUNDS):
                now = np.flatnonzero((self.turns[level] == turn) & (self.customers[level] > 1))
                others = totals[level][1][r[now]] - old[now]
                tables[now] = seat(self.customers[level][now], (strength + d * np.maximum(others, 0)) * parent[now], d, random, d * parent[now])
                totals[level][1] += np.bincount(r[now], weights=tables[now] - old[now], minlength=SIZES[level]).astype(np.int64)
            self.tables[level] = tables
            if level < 2:
                came = self.customers[level + 1]
                self._pass_up(level)
                totals[level + 1][0] += self._sums(level + 1, self.customers[level + 1] - came)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function by Stirling's series from x + 8 on."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return series - sum(np.log(x + i) for i in range(8))


def fits(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """The log likelihood of each of STRENGTHS, by the restaurants' numbers of customers and tables."""
    met, wide = customers > 0, int(tables.max(initial=0)) + 1
    both, times = np.unique(customers[met].astype(np.int64) * wide + tables[met].astype(np.int64), return_counts=True)
    n, t = (both // wide).astype(np.float64), (both % wide).astype(np.float64)
    return np.array([(times * (_lgamma(s / discount + t) - _lgamma(np.full(1, s / discount + 1)) + _lgamma(np.full(1, s + 1)) - _lgamma(s + n))).sum() for s in STRENGTHS])


def strength_by(fit: np.ndarray, random: np.random.Generator) -> float:
    weight = np.exp(fit - fit.max())
    return float(random.choice(STRENGTHS, p=weight / weight.sum()))


def strength_of(customers: np.ndarray, tables: np.ndarray, discount: float, random: np.random.Generator) -> float:
    """A level's strength, drawn by the likelihood of its restaurants' numbers of customers and tables."""
    return strength_by(fits(customers, tables, discount), random)


def _totals(buckets: DataFrame, history: list[tuple[list[np.ndarray], Hyper]], base: float, seed: int) -> tuple[list[np.ndarray], Hyper]:
    """Customers and tables of every restaurant after the sweeps of history, and what they make of strengths and discounts."""
    share = buckets.sparkSession.sparkContext.broadcast(history)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((4, size), np.int64) for size in SIZES]
        for batch in batches:
            for row in batch.to_pylist():
                bucket = _Bucket(row)
                for i, (totals, hyper) in enumerate(share.value):
                    bucket.sweep(i, totals, base, hyper, seed)
                for level in range(3):
                    c, t = bucket.customers[level], bucket.tables[level]
                    sums[level] += [bucket._sums(level, x) for x in (c, t, c == 1, c == 2)]
        for level, found in enumerate(sums):
            met = np.flatnonzero(found[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), level, np.int32)), pa.array(met), *(pa.array(x[met]) for x in found)], ["level", "restaurant", "customers", "tables", "ones", "twos"])

    rows = buckets.mapInArrow(run, "level int, restaurant long, customers long, tables long, ones long, twos long").groupBy("level", "restaurant").agg(*(F.sum(c).alias(c) for c in ("customers", "tables", "ones", "twos"))).toArrow()
    share.unpersist()
    random, level = np.random.default_rng([seed, len(history)]), rows["level"].to_numpy()
    out, strengths, discounts = [], [], []
    for k, size in enumerate(SIZES):
        own = {c: rows[c].to_numpy()[level == k] for c in ("restaurant", "customers", "tables", "ones", "twos")}
        both = np.zeros((2, size), np.int64)
        both[0, own["restaurant"]], both[1, own["restaurant"]] = own["customers"], own["tables"]
        out.append(both)
        ones, twos = int(own["ones"].sum()), int(own["twos"].sum())
        discounts.append(min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5)
        strengths.append(strength_of(*both, discounts[-1], random) if both[0].any() else 1.0)
    return out, Hyper(strengths, discounts)


def score(docs: DataFrame, folds: int = 10, burn_in: int = 3, samples: int = 2, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Rows whose crc32 of the id as text is 0 modulo folds are held out from training.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_buckets = buckets_for(slim, BUCKET_BYTES)
    blocks = stash(_blocks(slim, n_buckets, folds), "blocks")
    asked = blocks.select("block", "full", "cuts", "word", "context", "n").mapInArrow(_asked, "bucket int, block long, word binary, context binary, n binary").repartition(n_buckets, "bucket")
    buckets = stash(asked.groupBy("bucket").applyInArrow(_gathered, "bucket int, n_tokens long, n_types long, pairs binary, counts binary, totals binary, blocks binary, sizes binary, places binary"), "buckets")
    sums = buckets.agg(F.sum("n_tokens").alias("n"), F.sum("n_types").alias("v")).first()
    n_train, n_types = int(sums.n or 0), int(sums.v or 0)
    base = 1.0 / (n_types + 1)
    parts = buckets.select("bucket", "pairs", "counts", "totals")
    history: list[tuple[list[np.ndarray], Hyper]] = []
    for _ in range(burn_in + samples + 1):
        history.append(_totals(parts, history, base, seed))
    share = docs.sparkSession.sparkContext.broadcast(history)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bucket, total = _Bucket(row), 0.0
                for i, (before, after) in enumerate(zip(share.value, share.value[1:])):
                    bucket.sweep(i, before[0], base, before[1], seed)
                    if i >= burn_in:
                        total = total + bucket.predictive(after[0], base, after[1], 0)
                logs = np.log10(np.maximum(total / samples, 1e-300)).astype(np.float32)
                known = bucket.words[np.frombuffer(row["pairs"], np.int64) >> 16]
                places, upto = np.frombuffer(row["places"], np.int32), np.cumsum(np.frombuffer(row["sizes"], np.int64))
                numbers = np.frombuffer(row["blocks"], np.int64)
                for lo, hi, number in zip(np.append(0, upto[:-1]), upto, numbers):
                    at = places[lo:hi]
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([row["bucket"]], pa.int32())] + [pa.array([x], pa.binary()) for x in (logs[at].tobytes(), known[at].tobytes(), b"")], names)

    names = ["block", "bucket", "a", "b", "c"]
    shape = "block long, bucket int, a binary, b binary, c binary"
    answers = buckets.select("bucket", "pairs", "counts", "totals", "blocks", "sizes", "places").mapInArrow(answer, shape)
    asking = blocks.select("block", F.lit(-1).alias("bucket"), F.col("docs").alias("a"), F.col("bounds").alias("b"), F.col("places").alias("c"))

    def sums_of(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        own, rest = rows[0], rows[1:]
        doc_ids, bounds, places = (np.frombuffer(own[k], t) for k, t in (("a", np.int64), ("b", np.int64), ("c", np.int32)))
        logs = np.concatenate([np.frombuffer(r["a"], np.float32) for r in rest]).astype(np.float64)
        known = np.concatenate([np.frombuffer(r["b"], np.int64) for r in rest])
        flat = np.log10((known + 0.1) / (n_train + 0.1 * (n_types + 1)))
        n = np.diff(bounds)
        held = [i != T.NULL_ID and zlib.crc32(b"%d" % i) % folds == 0 for i in doc_ids.tolist()]
        columns = [T.id_column(doc_ids), pa.array(held), pa.array(n), pa.array(np.add.reduceat((known > 0)[places].astype(np.int64), bounds[:-1])), pa.array(np.full(len(n), n_train))]
        columns += [pa.array(np.add.reduceat(x[places], bounds[:-1])) for x in (flat, logs)]
        return pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return asking.unionByName(answers).repartition(buckets_for(slim, BATCH_BYTES), "block").groupBy("block").applyInArrow(sums_of, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
