"""Every operator against brute force on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from veerrank.llm import components, decontaminate, knn_quality, mixing, pitman_yor, quality_rules, secret_scan, simhash, substrings, token_counts, token_files, word_pitman_yor  # noqa: E402
from veerrank.llm import queries as llm_queries  # noqa: E402

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, first string, bucket string, score string, fp string, size string, label string, block string, rank string, place string"
rng = np.random.default_rng(5)
VOCABULARY = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 8))) for _ in range(300)]


@pytest.fixture(autouse=True)
def own_random(request):
    """Each test draws from a generator of its own, whatever ran before."""
    global rng
    rng = np.random.default_rng(zlib.crc32(request.node.name.encode()))


def words(n):
    return " ".join(VOCABULARY[i] for i in rng.integers(0, 300, n))


PASSAGE, ITEM = words(70), words(14)
TEXTS = [
    words(80), words(5), "", None, PASSAGE + " tail " + words(20), words(30) + " " + PASSAGE, words(20) + " " + ITEM.upper() + " " + words(20), words(9000),
    "a  b\n\n c <|endoftext|> d e　f it's o're.x,y", "same line\n" * 30, "Ö É " + words(40), "x# y$ z% " * 30, words(120), "\t\n ", words(60) + ' token = "a3f9c27be41d08c5f6a9" end', "mail some.name.01@mail1.example.com now " + words(12),
]
ROWS = [(i, t, ("en", None, "de")[i % 3], ("s1", "s2", None, "é")[i % 4]) for i, t in enumerate(TEXTS)]
ROWS += [(100, TEXTS[12], "en", "s1"), (101, TEXTS[12][:-1] + "q", "en", "s1"), (12, TEXTS[12], "en", "s1"), (None, TEXTS[12], "en", "s1"), (None, None, None, None), (7, TEXTS[7], "de", None)]
ITEMS = [(1, ITEM), (2, "shorter item"), (3, None), (4, ""), (None, "null id words"), (10, ITEM)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), *["x"] * 10) for i, t, lang, source in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def source_targets(sizes, weights, factor, most):
    """Targets by hand: sources in code point order with null last; sources that are over give to the others."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i][0] is None, (sizes[i][0] or "").encode()))
    weight = {i: weights[k % len(weights)] for k, i in enumerate(order)}
    left, open_, target = factor * sum(n for _, n in sizes), set(weight), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weight[i] for i in open_)
        full = {i for i in open_ if weight[i] * unit >= most * sizes[i][1]}
        for i in full or open_:
            target[i] = most * sizes[i][1] if full else weight[i] * unit
        if not full:
            break
        left, open_ = left - sum(target[i] for i in full), open_ - full
    return target


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and Counter(r.size for r in rows) == Counter(len(WORD.findall(t or "")) for _, t, _, _ in ROWS)
    total = sum(r.size for r in rows)
    target = {r.source: r.target for r in rows}
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 and all(r.target <= 2 * r.source_size + 1e-9 and r.taken <= 2 * r.size for r in rows)
    for s, t in target.items():
        assert abs(sum(r.taken for r in rows if r.source == s) - t) <= max(r.size for r in rows if r.source == s)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect())) and mixing.mix(empty).count() == 0
    assert source_targets([("b", 10), (None, 10), ("a", 10)], (5, 2, 1), 1.5, 2.0) == [25 * 2 / 3, 25 / 3, 20.0]
    sizes = sorted({(r.source, r.source_size) for r in rows}, key=str)
    assert [target[s] for s, _ in sizes] == pytest.approx(source_targets(sizes, (5, 2, 1), 1.5, 2.0))


@pytest.mark.parametrize("buckets", [65_536, 4])
def test_unequal_odds_are_calibrated_and_cut_by_rank(spark, monkeypatch, buckets):
    """Against a sort by hand: expected copies add up to the target, long documents have fewer, the cut follows the ranks."""
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    random = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(n)), "abcde"[i % 5] if i % 7 else None) for i, n in enumerate(random.integers(1, 400, 900))] + [(1000 + i, "w", "f") for i in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(table).collect()
    sizes = sorted({(r.source, r.source_size) for r in got}, key=str)
    want = dict(zip((s for s, _ in sizes), source_targets(sizes, (5, 2, 1), 1.5, 2.0)))
    for s, t in want.items():
        mine = [r for r in got if r.source == s]
        assert mine[0].target == pytest.approx(t) and sum(r.expected * r.size for r in mine) == pytest.approx(t, rel=0.01)
        free = [r for r in mine if r.expected < 2]
        assert len({round(r.expected * r.size**0.25, 6) for r in free}) <= 1 and all(r.expected <= 2 for r in mine)
        left = t - sum(int(r.expected + 1e-12) * r.size for r in mine)
        live = sorted((r for r in mine if r.expected % 1 > 1e-9), key=lambda r: (r.u / (1 - r.u) / ((r.expected % 1) / (1 - r.expected % 1)), r.doc_id))
        run, taken = 0, {}
        for r in live:
            run += r.size
            taken[r.doc_id] = run - r.size / 2 <= left
        assert {r.doc_id: r.copies - int(r.expected + 1e-12) for r in live} == taken
    assert any(len({r.copies for r in got if r.source == s}) > 1 for s in want)
    even = mixing.mix(table, weight=F.lit(1.0)).collect()
    assert all(len({round(r.expected, 9) for r in even if r.source == s}) == 1 for s in want)


def test_language_model(docs, empty):
    got = pitman_yor.score(docs).collect()
    tokens = [(i, WORD.findall(lower(t)) + ["\0end"]) for i, t, _, _ in ROWS]
    count = Counter(w for i, ws in tokens if i is None or zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((-1 if i is None else i, len(ws), sum(count[w] > 0 for w in ws), round(sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tokens)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert sorted(map(str, got)) == sorted(map(str, pitman_yor.score(docs).collect())) and pitman_yor.score(empty).count() == 0


def test_seating_follows_the_restaurant_law():
    random = np.random.default_rng(1)
    customers, discount = np.full(4000, 40), 0.5
    mean = pitman_yor.seat(customers, np.full(4000, 2.0), discount, random).mean()
    one_by_one = []
    for _ in range(4000):
        t = 1
        for i in range(1, 40):
            t += random.random() < 2.0 / (2.0 + i - discount * t)
        one_by_one.append(t)
    assert abs(mean - np.mean(one_by_one)) < 0.15


def test_predictive_probabilities_sum_to_one(docs, monkeypatch):
    """In every restaurant, over all dishes and the unknown one, after any number of sweeps, with dishes in many buckets."""
    seen = []
    own = pitman_yor._totals
    monkeypatch.setattr(pitman_yor, "_totals", lambda buckets, history, base, seed: seen.append((buckets, base)) or own(buckets, history, base, seed))
    pitman_yor.score(docs, burn_in=1, samples=1)
    parts, base = seen[0]
    history = []
    for _ in range(3):
        history.append(own(parts, history, base, 11))
    totals, hyper = history[-1]
    sums = [np.zeros(size) for size in pitman_yor.SIZES]
    dishes, words = [0, 0, 0], 0
    root = np.zeros(0)
    rows = [r.asDict() for r in parts.collect()]
    made = []
    for row in rows:
        bucket = pitman_yor._Bucket(row)
        for i, (before, h) in enumerate(history[:-1]):
            bucket.sweep(i, before, base, h, 11)
        made.append(bucket)
        root = np.append(root, bucket.predictive(totals, base, hyper, 2)[bucket.customers[2] > 0])
    strength, d = hyper.strengths[2], hyper.discounts[2]
    unknown = (strength + d * totals[2][1, 0]) / (strength + totals[2][0, 0]) * base
    n_types = round(1 / base) - 1
    assert len(root) == n_types and abs(root.sum() + unknown - 1) < 1e-9
    for level in (1, 0):
        c, t = totals[level]
        met = np.flatnonzero(c)
        for r in met[:: max(1, len(met) // 20)]:
            strength, d = hyper.strengths[level], hyper.discounts[level]
            own_part = sum((b.customers[level] - d * b.tables[level])[b.restaurant[level] == r].sum() for b in made) / (strength + c[r])
            assert abs(own_part + (strength + d * t[r]) / (strength + c[r]) - 1) < 1e-9


def test_words_of_one_ending_are_contexts_apart(spark, tmp_path):
    """Words that end alike have different followers: a model of word pairs knows which, one of endings does not."""
    random = np.random.default_rng(23)
    rows = [(i, " ".join(f"{w}ending x{w}" for w in random.choice(list("abcdefgh"), 30))) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = llm_queries.op2_lm_score(spark, str(tmp_path)).where("held_out").selectExpr("-sum(score) / sum(n_tokens) as x").first().x
    # Every second token is one of eight (or the end), the others follow for certain.
    assert 10 ** (2 * held) < 9.5


def test_language_model_of_word_pairs(docs, empty):
    got = word_pitman_yor.score(docs).collect()
    tokens = [(i, WORD.findall(lower(t)) + ["\0end"]) for i, t, _, _ in ROWS]
    count = Counter(w for i, ws in tokens if i is None or zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((-1 if i is None else i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(count[w] > 0 for w in ws), round(sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tokens)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert sorted(map(str, got)) == sorted(map(str, word_pitman_yor.score(docs).collect())) and word_pitman_yor.score(empty).count() == 0


def test_contexts_of_whole_words_sum_to_one(docs, monkeypatch):
    """Over all buckets every word's restaurant has the totals that its buckets were told, and probabilities that sum to one."""
    seen = []
    own = word_pitman_yor._answers
    monkeypatch.setattr(word_pitman_yor, "_answers", lambda *given: seen.append(given) or own(*given))
    monkeypatch.setattr(word_pitman_yor, "BATCH_BYTES", 2000)
    word_pitman_yor.score(docs, burn_in=1, samples=1)
    buckets, (sample,), customers, base = seen[0]
    told = {r.bucket: word_pitman_yor._together([x.asDict() for x in r.got]) for r in customers.collect()}
    (met, hyper), root = (sample.met, sample.hyper), 0.0
    mass, tables, customers_of, heard = Counter(), Counter(), {}, {}
    for r in sample.beside(buckets).collect():
        row = r.asDict(recursive=True)
        bucket = word_pitman_yor.Bucket(row)
        every = bucket.root(met, base, hyper)
        root += every[bucket.root_customers() > 0].sum()
        got, asked = word_pitman_yor._together(row["got"]), bucket.context
        shares = bucket.predictive(told[row["bucket"]], got, met, base, hyper)
        for u, w, c, t, p in zip(asked, bucket.word, bucket.counts, bucket.tables, shares):
            key = (int(told[row["bucket"]][u]), int(got[u]), row["bucket"], int(u))
            heard[key] = heard.get(key, 0.0) + p - every[w] * (hyper.strengths[0] + hyper.discounts[0] * got[u]) / (hyper.strengths[0] + told[row["bucket"]][u])
            mass[key[2:]] += int(c)
            tables[key[2:]] += int(t)
    unknown = (hyper.strengths[1] + hyper.discounts[1] * met[1]) / (hyper.strengths[1] + met[0]) * base
    assert abs(root + unknown - 1) < 1e-9
    keys = {r.bucket: word_pitman_yor.unpacked(r.keys) for r in buckets.select("bucket", "keys").collect()}
    for (n, t, b, u), p in heard.items():
        customers_of.setdefault(keys[b][u], []).append((n, t, mass[b, u], tables[b, u], p))
    assert len(customers_of) > 300
    for parts in customers_of.values():
        (n, t), *others = {x[:2] for x in parts}
        assert not others and n == sum(x[2] for x in parts) and t == sum(x[3] for x in parts)
        assert abs(sum(x[4] for x in parts) + (hyper.strengths[0] + hyper.discounts[0] * t) / (hyper.strengths[0] + n) - 1) < 1e-9


def test_sampler_agrees_with_one_customer_at_a_time(spark):
    """Held-out perplexity against a sampler that moves single customers between explicit tables, with live totals."""
    random = np.random.default_rng(17)
    names = ["".join(chr(97 + c) for c in random.integers(0, 26, 3)) for _ in range(60)]
    follow = {w: random.permutation(60)[:6] for w in names}
    rows = []
    for i in range(120):
        ws = [names[0]]
        for _ in range(40):
            ws.append(names[follow[ws[-1]][min(5, random.geometric(0.4) - 1)]])
        rows.append((i, " ".join(ws)))
    got = pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").selectExpr("-sum(score) / sum(n_tokens) as x").first().x
    train = [t.split() for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    held = [t.split() for i, t in rows if not zlib.crc32(str(i).encode()) % 10]

    def steps(ws):
        return [((0, p[-1:], p[-2:]), w) for p, w in zip(["", *ws], [*ws, "\0"])]

    tables: list[dict] = [{}, {}, {}]  # by level (root first), restaurant and dish: sizes of its tables
    size, n = [Counter(), Counter(), Counter()], [Counter(), Counter(), Counter()]
    base, strength, discount = 1 / (len({w for ws in train for w in ws}) + 2), (1.0, 1.0, 1.0), 0.5

    def p(level, context, w):
        if level < 0:
            return base
        r, dish = context[level], tables[level].get((context[level], w), ())
        s = strength[level]
        return (sum(dish) - discount * len(dish) + (s + discount * size[level][r]) * p(level - 1, context, w)) / (s + n[level][r])

    def add(level, context, w):
        if level < 0:
            return
        r, dish = context[level], tables[level].setdefault((context[level], w), [])
        weights = [c - discount for c in dish] + [(strength[level] + discount * size[level][r]) * p(level - 1, context, w)]
        k = random.choice(len(weights), p=np.array(weights) / sum(weights))
        n[level][r] += 1
        if k == len(dish):
            dish.append(0)
            size[level][r] += 1
            add(level - 1, context, w)
        dish[k] += 1

    def remove(level, context, w):
        if level < 0:
            return
        r, dish = context[level], tables[level][context[level], w]
        k = random.choice(len(dish), p=np.array(dish) / sum(dish))
        dish[k] -= 1
        n[level][r] -= 1
        if not dish[k]:
            dish.pop(k)
            size[level][r] -= 1
            remove(level - 1, context, w)

    tokens = [x for ws in train for x in steps(ws)]
    for context, w in tokens:
        add(2, context, w)
    for _ in range(3):
        for context, w in tokens:
            remove(2, context, w)
            add(2, context, w)
    logs = [np.log10(p(2, context, w)) for ws in held for context, w in steps(ws)]
    assert abs(got + np.mean(logs)) < 0.03, (got, -np.mean(logs))


@pytest.mark.parametrize("seed", range(4))
def test_targets_of_many_sources(spark, seed):
    """Any number of sources, many alike, some empty: the shares of a round-by-round reckoning."""
    random = np.random.default_rng(seed)
    sizes = [(f"s{i:03d}", int(random.choice([0, 1, 7, 7, 7, 50, 1000]))) for i in range(120)] + [(None, 40)]
    want = source_targets(sizes, (5, 2, 1), 1.5, 2.0)
    table = spark.createDataFrame(sizes, "source string, source_size long").repartition(3)
    got = {r.source: r.target for r in mixing.source_targets(table, (5, 2, 1), 1.5, 2.0).collect()}
    assert all(math.isclose(got[s], t, rel_tol=1e-9, abs_tol=1e-9) for (s, _), t in zip(sizes, want))
    full = {r.source: r.target for r in mixing.source_targets(table, (5, 2, 1), 3.0, 2.0).collect()}
    assert all(full[s] == 2.0 * n for s, n in sizes)
    assert mixing.source_targets(table.where("source_size = 0"), (5, 2, 1), 1.5, 2.0).agg(F.sum("target")).first()[0] == 0


def test_rows_that_would_fill_a_group(spark, monkeypatch):
    """Many rows alike in id and text, null ids too, are one row on the way and as many again in the result."""
    monkeypatch.setattr(substrings, "GROUP_BYTES", 4000)
    texts = [words(60), PASSAGE + " " + words(30), words(20) + " " + PASSAGE]
    rows = [(5, texts[2])] * 40 + [(None, texts[0])] * 30 + [(None, None)] * 200 + [(1, texts[1]), (1, texts[0]), (2, texts[0]), (7, "")]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == Counter({(5, 90, 70): 40, (None, 60, 0): 30, (None, 0, 0): 200, (1, 100, 0): 1, (1, 60, 0): 1, (2, 60, 60): 1, (7, 0, 0): 1})


def test_decontamination(spark, docs, empty, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids)) for r in decontaminate.contained_items(docs, items).collect())
    want = []
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t, _, _ in ROWS:
        ws, hit, owners = pattern.findall(lower(t)), set(), set()
        for item, text in ITEMS:
            iw = pattern.findall(lower(text))
            if item is None or not iw:
                continue
            k = min(10, len(iw))
            for a in range(len(iw) - k + 1):
                for b in range(len(ws) - k + 1):
                    if ws[b : b + k] == iw[a : a + k]:
                        hit.update(range(b, b + k))
                        owners.add(str(item))
        want.append((-1 if i is None else i, len(ws), len(hit), ",".join(sorted(owners))))
    assert got == sorted(want) and any(x[2] for x in got)
    assert decontaminate.contained_items(empty, items).count() == 0
    one = sorted(map(str, decontaminate.contained_items(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 1)  # blocks of twenty words: items share some and are cut into several
    assert sorted(map(str, decontaminate.contained_items(docs, items).collect())) == one
    assert decontaminate.contained_items(docs, items.limit(0)).where("n_hit > 0").count() == 0
    # An item of several blocks, found at its ends, in the middle and across a cut; beside it one of nine words.
    long, short = words(75).split(), words(9)
    texts = [" ".join(long[a : a + n]) for a, n in ((0, 10), (65, 10), (15, 30), (3, 9))] + [f"x {short} y", short]
    found = decontaminate.contained_items(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(1, " ".join(long)), (2, short)], "item_id long, text string"))
    assert sorted((r.doc_id, r.n_hit, r.item_ids) for r in found.collect()) == [(0, 10, ["1"]), (1, 10, ["1"]), (2, 30, ["1"]), (3, 0, []), (4, 9, ["2"]), (5, 9, ["2"])]


def test_items_without_an_id_hit(spark, tmp_path):
    texts = [(1, "a null id words b"), (2, "null id words and " + ITEM), (3, "nothing here"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = llm_queries.op3_decontaminate(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(llm_queries.DECONTAMINATE).select(", ".join(rows.columns)).fetchall()
    assert sorted(tuple(r) for r in rows.collect()) == sorted(want) and {r[0]: (r[2], r[3]) for r in want} == {1: (3, 1), 2: (17, 3), 3: (0, 0), 4: (0, 0)}
    kept = corpus_pipeline.decontamination_stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "'en' lang", "'s' source"), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {3, 4}


def test_quality_rules(docs, empty):
    got = quality_rules.judge(docs).collect()
    want = []
    for i, t, _, _ in ROWS:
        t = t or ""
        ws = WORD.findall(t)
        grams = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
        twice = {p for k, g in enumerate(grams) if Counter(grams)[g] > 1 for p in range(k, k + 5)} if len(grams) < 2000 else set()
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((-1 if i is None else i, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(want)
    assert all(not (r.kept and r.base_failed) for r in got) and next(r for r in got if r.doc_id == 0).kept
    assert quality_rules.judge(empty).count() == 0


def test_quality_fences_come_from_the_data(spark):
    random = np.random.default_rng(9)

    def text(lengths, symbols=0, dup=0):
        ws = ["".join(chr(97 + c) for c in random.integers(0, 26, n)) for n in lengths]
        lines = [" ".join(ws[k : k + 6]) for k in range(0, len(ws), 6)]
        return "\n".join(lines + [str(lines[0].split()[0])] * dup) + "#" * symbols

    rows = []
    for source, low, high, marks in (("a", 4, 6, 4), ("b", 2, 12, 90)):
        for i in range(240):
            mean = random.uniform(low, high)
            rows.append((text(np.maximum(1, random.normal(mean, 0.3, 60).round().astype(int))), source))
        rows += [(text([5] * 60, int(k)), source) for k in random.integers(1, marks, 120)]
        rows += [(text([5] * 60, 0, int(k)), source) for k in random.integers(1, 4, 10)]
    shared = [text([9] * 60), text([5] * 60, 60), text([5] * 60)]
    rows += [(x, source) for x in shared for source in ("a", "b")]
    docs = spark.createDataFrame([(i, x, "en", source) for i, (x, source) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert [got[len(rows) - 6 + k].kept for k in range(6)] == [False, True, False, True, True, True]

    def quantile(values, p):
        return sorted(values)[max(0, int(np.ceil(len(values) * p)) - 1)]

    def measured(rows, measure):
        values = [r.n_symbols / r.word_chars if measure == "symbols" else r.word_chars / r.n_words for r in rows]
        above = [x for x in values if x > 0]
        return len(values), len(above), quantile(values, 0.25), quantile(values, 0.75), quantile(above, 0.95), len(above) / len(values)

    def shrunk(own, above):
        n, k = own[:2], quality_rules.PRIOR
        return own[:2] + tuple((n[i == 4] * own[i] + k * above[i]) / (n[i == 4] + k) for i in range(2, 6))

    for source in ("a", "b"):
        mine = [got[i] for i, (_, s) in enumerate(rows) if s == source]
        for measure in ("symbols", "length"):
            everything = measured(list(got.values()), measure)  # one language, so its quantiles are those of all
            _, _, q1, q3, upper, often = shrunk(measured(mine, measure), everything)
            fence = max(q3 + 3 * (q3 - q1), upper * (often + 3 * (often * (1 - often)) ** 0.5))
            assert abs(mine[0][f"{measure}_high"] - fence) < 0.12 * fence, (source, measure)


def test_small_groups_lean_on_their_language(spark):
    """A group of one text takes nearly its language's fences, a large group its own, and no size changes the rule."""
    rows = [("en", "big", i % 5, 100) for i in range(2000)] + [("en", "one", 90, 100)] + [("de", "far", 50 + i % 5, 100) for i in range(400)]
    counts = quality_rules.sketch(spark.createDataFrame([(lang, source, 10, c, n, 0, 0, 1) for lang, source, n, c in rows], "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"))
    got = {r.source: r.symbols_high for r in quality_rules.fences(counts).collect()}
    assert abs(got["one"] - got["big"]) < abs(got["one"] - got["far"]) and got["big"] < 0.3 * got["far"]


def test_quality_verdicts_equal_sql(docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = llm_queries.op4_quality_rules(docs.sparkSession, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, con.sql(llm_queries.QUALITY).select(", ".join(rows.columns)).fetchall()))


def test_sketches_merge(docs):
    rows = quality_rules.measures(docs)
    whole = {(r.measure, r.q1, r.q2, r.q3) for r in quality_rules.quartiles(quality_rules.sketch(rows), []).collect()}
    parts = quality_rules.sketch(rows.where("doc_id % 2 = 0")).unionByName(quality_rules.sketch(rows.where("doc_id % 2 <> 0 or doc_id is null")))
    assert whole == {(r.measure, r.q1, r.q2, r.q3) for r in quality_rules.quartiles(parts, []).collect()}


def test_tokens(spark, docs, empty):
    library = Tokenizer.from_file(TOKENIZER)
    encoded = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t, _, _ in ROWS]
    got = token_counts.token_counts(docs, TOKENIZER, 512).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.over_limit) for r in got) == sorted((-1 if i is None else i, len(x), len(x) > 512) for i, x in encoded)
    assert token_counts.token_counts(empty, TOKENIZER, 512).count() == 0
    path = token_files.write_token_files(docs, TOKENIZER, 2)
    back = sorted(token_files.read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(r.ids)) for r in back) == Counter((i, (*x, 2)) for i, x in encoded)
    assert [r.doc_id for r in back] == sorted((r.doc_id for r in back), key=lambda i: -1 if i is None else i)
    start = 0
    for r in back:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert token_files.read_token_files(spark, token_files.write_token_files(empty, TOKENIZER, 2)).count() == 0


@pytest.mark.parametrize("values", [[], [5], [2**32 - 1, 0, 7], [9] * 300, list(range(1000)), [1, 2, 3] * 50 + [10**9]])
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    assert token_files.unpack(token_files.pack(ids), len(ids)).tolist() == values


def test_substring_dedup(docs, empty, monkeypatch):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs).collect())
    first: dict[tuple, int] = {}
    split = [(i, WORD.findall(t or "")) for i, t, _, _ in ROWS]
    for i, ws in split:
        for k in range(len(ws) - 49):
            if i is not None:
                g = tuple(ws[k : k + 50])
                first[g] = min(first.get(g, i), i)
    want = []
    for i, ws in split:
        gone = {p for k in range(len(ws) - 49) if i is not None and first[tuple(ws[k : k + 50])] < i for p in range(k, k + 50)}
        kept = [w for p, w in enumerate(ws) if p not in gone]
        want.append((-1 if i is None else i, len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    assert got == sorted(want) and any(x[2] for x in got) and substrings.remove_repeats(empty).count() == 0
    monkeypatch.setattr(substrings, "MEET", 1)  # every shared anchor meets in salted parts first
    rows = substrings.remove_repeats(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == got
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in rows)


def test_windows_are_told_apart_by_their_words():
    """Hashes that all windows share change nothing."""
    random = np.random.default_rng(8)
    codes = random.integers(0, 2, 400)
    starts, docs = np.arange(0, 396), random.integers(0, 30, 396)
    least: dict[bytes, int] = {}
    for s, d in zip(starts, docs):
        w = codes[s : s + 4].tobytes()
        least[w] = min(least.get(w, 99), d)
    for hashes in (np.zeros(396, np.uint64), random.integers(0, 3, 396).astype(np.uint64), np.array([hash(codes[s : s + 4].tobytes()) % 2**63 for s in starts], np.uint64)):
        same = hashes if len(set(hashes.tolist())) > 3 else None
        first = substrings.first_equal(codes, starts, hashes if same is not None else np.zeros(396, np.uint64), docs, 4)
        assert [docs[f] for f in first] == [least[codes[s : s + 4].tobytes()] for s in starts]


def test_near_duplicates(docs, empty):
    got = simhash.near_duplicates(docs).collect()

    def fingerprint(t):
        ws = WORD.findall(lower(t))
        shingles = [" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] * bool(ws)
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [(i, fingerprint(t)) for i, t, _, _ in ROWS]
    group = {f: {f} for _, f in prints}
    for a in group:
        for b in group:
            if (a ^ b).bit_count() <= 2 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[a]:
                    group[x] = group[a]
    want = Counter((i, f, min(j for j, g in prints if g in group[f] and j is not None)) for i, f in prints)
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want and simhash.near_duplicates(empty).count() == 0


def test_alike_texts_link(spark, docs, empty, monkeypatch):
    def edited(text, n):
        ws = text.split()
        for p in rng.integers(0, len(ws), n):
            ws[p] = VOCABULARY[rng.integers(0, 300)]
        return " ".join(ws)

    base = [words(n) for n in (100, 150, 300, 2500)]
    texts = [edited(b, n) for b in base for n in (0, 1, 1, 2, 3, 4, 5, 6, 8, 20, 60)] + ["ba " * 30, "ba " * 31, "four words are here", "", None, base[0], base[0].upper()]

    def shingles(t):
        ws = WORD.findall(lower(t))
        return {tuple(ws[k : k + 5]) for k in range(max(len(ws) - 4, 1))} if ws else set()

    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, fps = [shingles(t) for t in texts], {r.doc_id: r.fp for r in simhash.fingerprints(table, 5).collect()}
    root = list(range(len(texts)))
    for a in root:
        for b in range(a):
            union = len(sets[a] | sets[b])
            if bin((fps[a] ^ fps[b]) % 2**64).count("1") <= 2 or union and len(sets[a] & sets[b]) >= 0.8 * union:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    for tile in (1024, 3):
        monkeypatch.setattr(simhash, "ALIKE_TILE", tile)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table, shingle=5, similarity=0.8).collect()}
        assert got == dict(enumerate(root)) and 8 < len(set(root)) < len(texts) - 15
    assert simhash.near_duplicates(docs, shingle=5, similarity=0.8).count() == len(ROWS)
    assert simhash.near_duplicates(empty, shingle=5, similarity=0.8).count() == 0


def test_links_lose_nothing(spark, monkeypatch):
    centre = rng.integers(-(2**62), 2**62, 6)
    values = sorted({int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centre for a, b in rng.integers(0, 62, (60, 2))} | set(map(int, centre)))
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if bin((a ^ b) % 2**64).count("1") <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    for hot, visits, tile in ((256, 16_384, 2048), (2, 16_384, 4), (256, 5, 4)):
        monkeypatch.setattr(simhash, "HOT", hot)
        monkeypatch.setattr(simhash, "VISITS", visits)
        monkeypatch.setattr(simhash, "TILE", tile)
        got = {r.node: r.root for r in components.components(simhash.links(df), "a", "b").collect()}
        assert all(got.get(v, v) == find(v) for v in values)


def test_secret_scan(spark, docs, empty):
    plain = [(i, words(8) + " longlonglongplainword" + "x" * (i % 5) + f" some.name.{i}@mail1.example.com") for i in range(60)]
    secret = [(100 + i, words(6) + f' token = "{hashlib.sha1(str(i).encode()).hexdigest()}" ' + words(4)) for i in range(60)]
    rows = secret_scan.scan(spark.createDataFrame(plain + secret + [(None, None), (500, "")], "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows if r.kept} == set(range(100, 160)) and len(rows) == 180
    assert secret_scan.scan(empty).count() == 0 and secret_scan.scan(docs).count() > 0


def test_secret_scan_finds_every_run(spark):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(64)]
    base64 = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    rows = [(i, words(8) + f" longlonglongplainword{'x' * (i % 5)} some.name.{i}@mail1.example.com /var/lib/tables/part{i}/index.html") for i in range(60)]
    rows += [(100 + i, words(6) + f' token = "{h}" ' + words(4)) for i, h in enumerate(hexes[:60])]
    rows += [(200, f'{{"aws_secret_access_key":"{base64}","region":"x","api_key":"{hexes[60]}"}}'), (201, f"{words(4)} {hexes[61]} {words(4)}"), (202, f"https://host.example.com/path?token={hexes[62]}&next=/home")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.nth): r for r in secret_scan.scan(docs).where("doc_id >= 200").collect()}
    assert [got[200, n].value for n in (1, 2, 3)] == ["aws_secret_access_key", base64, hexes[60]]
    assert got[200, 3].kept and got[201, 1].value == hexes[61] and got[201, 1].kept
    assert got[202, 2].value == f"token={hexes[62]}" and not got[202, 1].kept
    found = secret_scan.features(secret_scan.candidates(docs), secret_scan.character_counts(docs))
    label = {(r.doc_id, r.value): r.label for r in secret_scan.weak_findings(found).collect()}
    path = {r.value: r.path for r in found.select("value", "path").collect()}
    assert label[200, base64] == label[200, hexes[60]] == label[202, f"token={hexes[62]}"] == 1 and label.get((201, hexes[61])) is None
    assert path[base64] == 0 and path["/var/lib/tables/part7/index.html"] == 1 and label[7, "/var/lib/tables/part7/index.html"] == 0


def test_features_of_candidates(spark):
    """Every feature by hand, neighbours with names and assignment marks masked, and a candidate of 100,000 characters."""
    long = "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, 100_000))
    texts = ['Der rote wagen: token = "a3F9c27bE41d08c5f6a9" ist für alle da', "a3f9c27be41d08c5f6a9", "x " + long + " y", "one two three secret_key a3f9c27be41d08c5f6a9, four", "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = secret_scan.character_counts(docs)
    rows = {r.doc_id: r for r in secret_scan.features(secret_scan.candidates(docs), counts).collect()}
    assert set(rows) == {0, 1, 2, 3}
    near = {0: ["wagen", "rote", "ist", "für"], 1: [], 2: ["x", "y"], 3: ["three", "two", "four"]}
    trigrams = Counter(w[i : i + 3] for t in texts for w in re.findall("[a-z0-9]{3,}", t.lower()) for i in range(len(w) - 2))
    pairs = Counter()
    for t, n in trigrams.items():
        pairs[t[:2]] += n
    place = lambda c: secret_scan.LETTERS.find(c) + 1
    total = {a: 37 + sum(n for p, n in pairs.items() if place(p[0]) == a) for a in range(37)}
    for i, r in rows.items():
        value, low = r.value, r.value.lower()
        assert r.near == near[i] and r.length == len(value)
        assert math.isclose(r.digits, sum(c.isdigit() for c in value) / len(value)) and math.isclose(r.capitals, sum(c.isupper() for c in value) / len(value))
        classes = ["0" if c.isdigit() else "a" if c.isalpha() else c for c in value]
        assert math.isclose(r.changes, sum(a != b for a, b in zip(classes, classes[1:])) / len(value))
        step = sum(math.log((1 + pairs[low[j : j + 2]]) / total[place(low[j])]) for j in range(len(low) - 1)) / (len(low) - 1)
        assert math.isclose(r.transition, step, rel_tol=1e-9)
        known = sum(trigrams[low[j : j + 3]] >= 2 for j in range(len(low) - 2)) / (len(low) - 2)
        assert math.isclose(r.coverage, known, rel_tol=1e-9, abs_tol=1e-12)
        buckets = Counter(xxhash.xxh64_intdigest(w.encode(), 42) % secret_scan.NEAR for w in near[i])
        assert [r[f"near{b}"] for b in range(secret_scan.NEAR)] == [buckets[b] for b in range(secret_scan.NEAR)]
        assert math.isclose(r.near_letters, np.mean([len(w) for w in near[i]]) if near[i] else 0)
    assert [(rows[i].named, rows[i].assigned) for i in range(4)] == [(1, 1), (0, 0), (0, 0), (1, 0)]
    assert {f"near{b}" for b in range(secret_scan.NEAR)} < set(secret_scan.SHAPE) and "named" not in secret_scan.SHAPE


def test_secret_scan_precision_and_recall(spark):
    """Kinds of keys that half are named and assigned; the unnamed half is held out, as its labels never reach the forest."""
    random = np.random.default_rng(23)

    def draw(alphabet, n):
        return "".join(alphabet[i] for i in random.integers(0, len(alphabet), n))

    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = [lambda: hashlib.sha1(random.bytes(8)).hexdigest(), lambda: draw(lower + lower.upper() + digits, 32), lambda: "AK" + draw(lower.upper() + digits, 18), lambda: "pk_" + draw(lower + lower.upper() + digits, 24), lambda: draw(lower + digits, 12)]
    name = ["token", "api_key", "password", "secret"]
    plain = [lambda: f"/srv/{VOCABULARY[random.integers(300)]}/index{random.integers(9)}.html", lambda: f"{draw(lower, 5)}.{random.integers(99)}@mail{random.integers(9)}.example.com", lambda: "".join(w.title() for w in words(4).split()), lambda: f"see-chapter-{random.integers(99)}-of-the-manual", lambda: "https://www.example.org/" + "/".join(words(3).split())]
    rows, secret = [], {}
    for i in range(600):
        value = kinds[i % 5]()
        secret[i] = value
        rows.append((i, f"{words(8)} {name[i % 4]} = \"{value}\" {words(4)}" if i % 2 else f"{words(8)} {value} {words(4)}"))
        rows.append((1000 + i, f"{words(6)} {plain[i % 5]()} {words(6)}"))
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").select("doc_id", "value").collect()
    hit = {r.doc_id for r in got if r.doc_id < 1000 and secret[r.doc_id] in r.value}
    unnamed = {i for i in secret if i % 2 == 0}
    assert len(hit & unnamed) >= 0.9 * len(unnamed) and len(hit) >= 0.9 * len(secret)
    assert sum(r.doc_id < 1000 for r in got) >= 0.9 * len(got), [r for r in got if r.doc_id >= 1000][:9]


def test_quality_classifier(spark, docs, empty):
    good = [(i, words(40), 1) for i in range(80)]
    bad = [(100 + i, " ".join(w + "&&&" for w in words(40).split()), 0) for i in range(80)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    got = {r.doc_id: r for r in knn_quality.score(table.drop("quality"), table.select("doc_id", "quality", F.lit("x").alias("text"))).collect()}
    assert all(got[i].predicted == q for i, _, q in good + bad) and any(r.held_out for r in got.values())
    labels = table.select("doc_id", "quality")
    assert knn_quality.score(docs, labels).count() == len(ROWS) and knn_quality.score(empty, labels).count() == 0
    assert all(r.score == 0.5 for r in knn_quality.score(docs, labels.limit(0)).collect())


def test_votes_by_hand(spark):
    """Scores of a whole table equal votes computed here; equal cosines with different labels go by the labelled id; null labels teach nothing."""
    copies = words(30)
    rows = [(i, words(25 + i % 7) + (" ###" if i % 3 else "") + (" the the" if i % 4 == 0 else ""), int(i % 3 == 0)) for i in range(60)] + [(100 + i, copies, i % 2) for i in range(30)] + [(200, "", 0), (201, None, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality").unionByName(spark.createDataFrame([(300, None), (None, 1)], "doc_id long, quality int"))
    got = {r.doc_id: r for r in knn_quality.score(table.drop("quality").repartition(3), labels).collect()}
    slim = table.select("doc_id", "text")
    model = knn_quality.fit(slim, labels, "quality")
    learned = sorted(i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5)
    assert len(model.labels) == len(learned) and [int(x) for x in model.labels] == [q for i in learned for j, _, q in rows if j == i]
    for i, text, _ in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        x = model._weighted(knn_quality.counts(data, np.array([0, len(data)]))) @ model.basis
        cosine = [round(float(c), 6) for c in (x / max(np.linalg.norm(x), 1e-9) @ model.vectors.T)[0]]
        nearest = sorted(range(len(cosine)), key=lambda j: (-cosine[j], j))[: knn_quality.NEIGHBOURS]
        weight = [math.exp(8 * (cosine[j] - 1)) for j in nearest]
        assert abs(got[i].score - sum(w * model.labels[j] for w, j in zip(weight, nearest)) / sum(weight)) < 1e-3
        assert got[i].held_out == (i not in learned)


@pytest.mark.parametrize("seed", range(12))
def test_marks_do_not_overrule_texts(seed):
    """Words that happen to repeat, on both sides: every held-out text is told right."""
    random = np.random.default_rng(seed)
    vocabulary = ["".join(chr(97 + c) for c in random.integers(0, 26, random.integers(2, 8))) for _ in range(300)]
    texts = [[vocabulary[j] for j in random.integers(0, 300, 40)] for _ in range(160)]
    for i in range(0, 160, 5):
        texts[i][7] = texts[i][6]
    texts = [" ".join(t if i < 80 else (w + "&&&" for w in t)) for i, t in enumerate(texts)]
    data, bounds = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    x, y = knn_quality.counts(data, bounds), np.repeat([1, 0], 80)
    held = np.arange(160) % 5 == seed % 5
    assert ((knn_quality.Model(x[~held], y[~held]).scores(x) >= 0.3) == (y == 1)).all()


def test_token_memory_is_bounded_by_bytes(monkeypatch):
    """Texts without blanks, and more distinct words than fit: the memo stays small, forgets, and counts stay right."""
    monkeypatch.setattr(token_counts, "MEMO_BYTES", 1 << 20)
    known, library = token_counts.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)

    def check(texts):
        data, bounds = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
        counts, ids = known.rows(data, bounds, keep_ids=True)
        want = library.encode_batch(texts, add_special_tokens=False)
        assert list(counts) == [len(e.ids) for e in want] and list(ids) == [i for e in want for i in e.ids]
        return known.bytes + known.flat.nbytes + sum(map(len, known.place))

    sizes = [check(["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 700))) for _ in range(20)]) for _ in range(50)]
    assert max(sizes) < 1 << 20 and sizes[-1] <= sizes[5] * 1.5 + 1000
    for _ in range(12):
        assert check([" ".join("".join(map(chr, rng.integers(97, 123, 7))) for _ in range(900)) for _ in range(2)]) < 3 << 20
    marks = "、。！，：；？"
    mixed = ["".join(marks[j % 7] if j > 6 and j % 5 == 0 else chr(int(c)) for j, c in enumerate(rng.integers(0x3041, 0x9FFF, 300))) for _ in range(30)]
    check([*mixed, "。's，'t", "ก" * 400, "ไทย ก่อน", "か゛。き゚、", "ー。々、ヶ，", "", " 、 。"])
    starts = token_counts.piece_starts(np.frombuffer("天地玄黃，宇宙洪荒。".encode(), np.uint8), np.array([0, 30]))
    assert list(starts) == [0, 12, 27]


def test_files_that_split_otherwise_encode_whole_texts(spark, tmp_path):
    """A file with a prefix space, and one whose special token a cut would part."""
    import json

    file = json.loads(Path(TOKENIZER).read_text())
    for name, change in (("prefix", {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}), ("special", {"added_tokens": [*file["added_tokens"], {"id": len(file["model"]["vocab"]) + 50, "content": "<a b>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(file | change))
        library = Tokenizer.from_file(str(path))
        assert not token_counts.Encoder(str(path)).safe
        texts = [words(30), "x <a b> y", "天地，玄黃", "", None]
        got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(path), 5).collect()}
        assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_pipeline(spark, docs, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, folder)
    judged = quality_rules.judge(docs).where("kept").count()
    assert kept.columns == docs.columns and kept.count() == judged
    single = corpus_pipeline.near_duplicate_stage(spark, kept, folder)
    groups = simhash.near_duplicates(kept, shingle=5, similarity=0.8).select("component_id").distinct().count()
    assert single.count() == groups
    clean = corpus_pipeline.decontamination_stage(spark, single, folder)
    assert {r.doc_id for r in single.collect()} - {r.doc_id for r in clean.collect()} == {6}
    mixed = corpus_pipeline.mixing_stage(spark, clean, folder)
    assert mixed.columns == docs.columns and mixed.count() == mixing.mix(clean).agg(F.sum("copies")).first()[0]
    out = corpus_pipeline.run(spark, folder)
    assert out.count() == mixed.count() and [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_files"]


def test_pipeline_keeps_columns_of_any_name(spark, docs, tmp_path):
    """Names that the stages use themselves stay with their values, and the row that stays of repeats is defined."""
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ("_copies", "_copy", "_row_key", "_row", "_n", "component_id", "kept", "copies", "item_id")
    odd = docs.select("doc_id", "text", "lang", "source", *(F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names))
    odd = odd.unionByName(odd.withColumn("_row", F.lit("other")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, str(tmp_path))
        rows = kept.collect()
        assert kept.columns == odd.columns and rows, name
        assert all(r["_copies"].split(":")[1] == (str(r.doc_id) if r.doc_id is not None else "none") for r in rows)
    again = [sorted(map(str, corpus_pipeline.near_duplicate_stage(spark, odd.repartition(n), str(tmp_path)).collect())) for n in (1, 6)]
    assert again[0] == again[1]


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_beyond_a_batch(spark, monkeypatch):
    """Batches smaller than every text: each text is a batch of its own, and none is cut."""
    for module in (token_counts, token_files, simhash, substrings, decontaminate, quality_rules, knn_quality, pitman_yor):
        monkeypatch.setattr(module, "BATCH_BYTES", 16)
    texts = [words(200), words(3) + " é " + words(400), PASSAGE + " " + words(30), words(10) + " " + PASSAGE, "", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    library = Tokenizer.from_file(TOKENIZER)
    n = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(table, TOKENIZER, 512).collect()} == n
    back = token_files.read_token_files(spark, token_files.write_token_files(table, TOKENIZER, 2))
    assert {r.doc_id: r.n_tokens - 1 for r in back.collect()} == n
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(table).collect()} == {0: 0, 1: 0, 2: 0, 3: 70, 4: 0, 5: 0}
    fps = {r.doc_id: r.fp for r in simhash.fingerprints(table, 3).collect()}
    assert fps == {i: simhash.fingerprint(simhash.shingle_hashes((t or "").encode(), 3)) for i, t in enumerate(texts)}
    assert pitman_yor.score(table).count() == 6 and quality_rules.measures(table.selectExpr("*", "'en' lang", "'s' source")).count() == 6


def test_hot_anchors_through_the_query(spark, tmp_path, monkeypatch):
    """Many fingerprints around one centre: tiles link what single anchors would, for every document."""
    monkeypatch.setattr(simhash, "HOT", 3)
    monkeypatch.setattr(simhash, "TILE", 4)
    base = words(400).split()
    texts = []
    for i in range(60):
        ws = list(base)
        ws[int(rng.integers(0, 400))] = VOCABULARY[i]
        texts.append(" ".join(ws))
    texts += [words(50) for _ in range(10)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.component_id for r in llm_queries.op9_simhash(spark, str(tmp_path)).collect()}
    fps = [simhash.fingerprint(simhash.shingle_hashes(t.encode(), 3)) for t in texts]
    root = list(range(len(texts)))
    for a in root:
        for b in range(a):
            if bin((fps[a] ^ fps[b]) % 2**64).count("1") <= 2:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    assert got == dict(enumerate(root)) and len(set(root)) < 50


def test_repeated_labelled_ids_have_one_result(spark):
    """A labelled id with several texts lends the same vector however the table is dealt."""
    rows = [(i, words(30), i % 2) for i in range(40)] + [(i, words(30) + " &&& ###", i % 2) for i in range(0, 40, 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 1) for i in range(10)], "doc_id long, quality int")
    found = [sorted((r.doc_id, r.score) for r in knn_quality.score(table.repartition(n).select("doc_id", "text"), labels.repartition(n)).collect()) for n in (1, 5)]
    assert [i for i, _ in found[0]] == [i for i, _ in found[1]] and np.allclose([x for _, x in found[0]], [x for _, x in found[1]], atol=1e-5)  # batches round alike but for single precision
