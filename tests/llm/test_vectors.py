"""Clustering, hard negatives and web archives against brute force on small tables of nulls, odd vectors, ties and repeated rows."""

import gzip
import hashlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veerrank.llm import capture_index, hamerly, hard_negatives, warc
from veerrank.llm import queries as llm_queries
from veerrank.operators import nearest

INF = float("inf")


def vector_rows(seed, n=150, dim=64):
    """Rows (vec_id, embedding, label, extra columns): near copies, exact copies, nulls, other lengths and non-finite parts."""
    random = np.random.default_rng(seed)
    base = random.standard_normal((12, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = []
    for i in range(n):
        x = base[i % 12] + random.standard_normal(dim) * (0.0 if i % 7 == 3 else 0.05)
        rows.append((i, [float(np.float32(v)) for v in x], int(i % 4)))
    rows += [(rows[5][0], rows[5][1], 1), (None, rows[9][1], 2), (900, None, 1), (901, [], 1), (902, rows[0][1][:-1], 2), (903, [None, *rows[0][1][1:]], 2), (904, [INF, *rows[0][1][1:]], 2), (905, [float("nan"), *rows[0][1][1:]], 2), (950, rows[3][1], None), (951, [0.0] * dim, 3)]
    return [(*r, "x", 1, "y") for r in rows]


VECTORS = "vec_id long, embedding array<float>, label int, block string, cluster int, x string"


def same_as_sql(spark, name, tables, folder):
    """A query's rows, checked against its SQL over the same files."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    got, want = llm_queries.queries()[name](spark, str(folder)), con.sql(llm_queries.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    found = got.collect()
    assert sorted((tuple(r[c] for c in columns) for r in found), key=str) == sorted(want.project(", ".join(columns)).fetchall(), key=str)
    return found


def test_clusters(spark, tmp_path):
    rows = vector_rows(3)
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = same_as_sql(spark, "op13_cluster", {"embeddings": table}, tmp_path)
    ok = [(r[0], np.floor(1024 * np.array(r[1], np.float64)).astype(int)) for r in rows if r[1] and len(r[1]) == 64 and all(v is not None and np.isfinite(v) for v in r[1])]
    x = np.stack([v for _, v in ok])
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), n) for n, (i, _) in enumerate(ok) if i is not None)[:8]
    centroids = x[[n for _, n in first]]
    for r in range(11):
        d = ((x[:, None] - centroids[None]) ** 2).sum(2)
        own = d.argmin(1)
        if r < 10:
            centroids = np.array([[int(s) // int((own == j).sum()) for s in x[own == j].sum(0)] if (own == j).any() else centroids[j] for j in range(8)])
    want = sorted((i is None, i or 0, int(c), int(e)) for (i, _), c, e in zip(ok, own, d.min(1)))
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in got) == want
    assert {r.inertia for r in got} == {int(d.min(1).sum())} and {r.centroid_sha256 for r in got} <= {hamerly.digest(c) for c in centroids}


def test_bounds_save_scans_and_change_nothing(spark):
    """Well parted clusters: most vectors keep their cluster without a scan, and any bounds give the rows of full scans."""
    random = np.random.default_rng(8)
    centres = random.standard_normal((8, 64)) * 4
    rows = [(i, [float(v) for v in centres[i % 8] + random.standard_normal(64) * 0.2]) for i in range(400)]
    scans = []
    got = hamerly.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scans=scans)
    assert len(scans) == 10 and scans[0] == 400 and scans[-1] < 40 and got.count() == 400
    x, c = random.integers(-9, 9, (300, 5)), random.integers(-9, 9, (6, 5))
    step = hamerly.Round(c)
    own, upper, lower = step.scan(x)
    assert (own == hamerly.distances(x, c).argmin(1)).all()
    for _ in range(6):
        after = c + random.integers(-2, 3, c.shape)
        own, upper, lower, _ = hamerly.Round(after, c).assign(x, own, upper, lower)
        c = after
        assert (own == hamerly.distances(x, c).argmin(1)).all()  # ties too: the grid is coarse


def test_cluster_edges(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hamerly.cluster(none).count() == 0
    few = spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    rows = hamerly.cluster(few).collect()
    assert len(rows) == 3 and {r.cluster for r in rows if r.vec_id} == {0, 1}
    with pytest.raises(Exception, match="64 bits"):
        hamerly.cluster(few.withColumn("embedding", F.transform("embedding", lambda x: x * 1e9))).count()
    big = spark.createDataFrame([(i, [float(1e3 * (i + j)) for j in range(64)]) for i in range(12)], "vec_id long, embedding array<double>")
    x = np.array([[1024 * 1000 * (i + j) for j in range(64)] for i in range(12)])
    assert (hamerly.distances(x, x[:3]) == ((x[:, None] - x[None, :3]) ** 2).sum(2)).all()
    assert hamerly.cluster(big, k=3, rounds=2).count() == 12


LONG = "<html>é " + "words " * 300
PAGES = [
    (1, "http://www.a.example/x", LONG), (2, "https://B.a.example:443/y?q=1#top", LONG), (3, "https://b.a.example/y?q=1", LONG), (4, None, LONG), (5, "http://c.example", "short"), (6, "http://c.example", "short"), (7, "http://c.example?z", None), (8, "http://c.example/", ""),
    (9, "http://d.example/a b\r\nWARC-Type: x", "\r\n\r\n\r\n" + LONG + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n"), (10, "http://d.example/é", "\r\n"), (11, "ftp://u@E.example:80/?", "x" * 999), (12, "http://e.example/", "x" * 999), (13, "http://e.example/", "x" * 1000), (14, "http://e.example/", "x" * 1000),
    (None, "http://e.example/", "x" * 1000), (None, "http://n.example/", "y" * 2000), (None, "http://n.example/", "y" * 2000), (20, "http://r.example/", "z" * 1500), (20, "http://r.example/", "z" * 1500), (15, "http://r.example/", "z" * 1500), (-3, "http://e.example/\n", "w" * 200000),
]
PAGE = "page_id long, url string, html string, digest string, top long, key string, value string, place long"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "k", "v", 2) for r in rows], PAGE)


def test_archives(spark, tmp_path):
    pages = pages_of(spark, PAGES).repartition(4)
    got = same_as_sql(spark, "op11_warc", {"pages": pages.where("page_id is null or page_id not in (9, -3)")}, tmp_path)
    assert len(got) == len(PAGES) - 2
    path = warc.write_archives(pages, str(tmp_path / "archives"))
    captures = warc.read_archives(spark, path).collect()
    payload = {}
    for r in captures:
        with gzip.open(tmp_path / "archives" / r.archive) as f:
            record = f.read()[r.offset : r.offset + r.length]
        head, http, body = record.split(b"\r\n\r\n", 2)
        assert head.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"Content-Length: {r.payload_bytes}".encode() in http
        payload.setdefault(r.page_id, []).append(body[:-4] if r.record_type == "response" else None)
    assert len(captures) == len(PAGES)
    size = lambda t: len((t or "").encode())
    for page_id, _, html in PAGES:
        alike = [i for i, _, h in PAGES if (h or "") == (html or "") and size(html) >= 1000]
        top = max((i for i in alike if i is not None), default=None)
        found = [(r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in captures if r.page_id == page_id and r.payload_digest == hashlib.sha1((html or "").encode()).hexdigest()]
        want = ("revisit", top) if alike and page_id != top else ("response", None)
        assert found and all(f == (*want, size(html), hashlib.sha1((html or "").encode()).hexdigest()) for f in found)
        assert ((html or "").encode() in payload[page_id]) == (want[0] == "response")
    assert {r.url for r in captures if r.page_id == 9} == {"http://d.example/a%20b%0D%0AWARC-Type:%20x"}
    assert warc.archived(pages_of(spark, [])).count() == 0
    broken = next((tmp_path / "archives").glob("*.gz"))
    broken.write_bytes(gzip.compress(gzip.decompress(broken.read_bytes()).replace(b"words words", b"words wordz", 1)[:-7]))
    Path(f"{broken.parent}/.{broken.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        warc.read_archives(spark, path).count()


def test_merge_in_passes(spark, monkeypatch):
    """Short runs, few at a time: several passes, many parts, and one URL in half of the rows, give the sorted order."""
    for name, value in (("RUN", 7), ("BLOCK", 3), ("PART", 9), ("FAN_IN", 4)):
        monkeypatch.setattr(capture_index, name, value)
    random = np.random.default_rng(4)
    rows = [("http://h.example/" if i % 2 else f"http://{random.integers(9)}.é.example/{random.integers(5)}", int(random.integers(4)), int(random.integers(50)) if i % 9 else None, "response", 1, "d", None, f"a{i % 5}", i, 1) for i in range(300)]
    table = spark.createDataFrame(rows, "url string, date long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long").repartition(6)
    parts = capture_index.merged(table)
    sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 60
    got = [(r.url_key, r.date, r.page_id if r.page_id is not None else 99, r.offset) for r in capture_index.numbered(parts).orderBy("place").collect()]
    assert [g[:3] for g in got] == sorted(g[:3] for g in got) and sorted(g[3] for g in got) == list(range(300))
    assert [r.place for r in capture_index.numbered(parts).orderBy("place").collect()] == list(range(300))
    again = [(r.url_key, r.date, r.page_id if r.page_id is not None else 99, r.offset) for r in capture_index.numbered(capture_index.merged(table.repartition(3))).orderBy("place").collect()]
    assert again == got


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    random = np.random.default_rng(k)
    lists = [sorted((str(x), 0, 0, i) for x in random.integers(0, 30, random.integers(0, 12))) for i in range(k)]
    at, got = [0] * k, []
    for i in capture_index.LoserTree(lists):
        got.append(lists[i][at[i]])
        at[i] += 1
    assert got == sorted(x for each in lists for x in each)


def test_hard_negatives(spark, tmp_path, monkeypatch):
    """Rows that score alike, nulls, other lengths and repeated rows, in small blocks and over several rounds; clusters cross labels, so that windows are full."""
    for name, value in (("ROWS", 7), ("FIRST", 2), ("GROWTH", 2), ("QUERIES", 3)):
        monkeypatch.setattr(nearest, name, value)
    rows = vector_rows(6, n=260) + vector_rows(6, n=51)
    random = np.random.default_rng(1)
    rows += [(1000 + i, [float(v * 0.8 + w * 0.1) for v, w in zip(rows[i % 40][1], random.standard_normal(64))], int(random.integers(10)), "x", 1, "y") for i in range(300)]
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = same_as_sql(spark, "op12_hard_negatives", {"embeddings": table}, tmp_path)
    assert len(got) > 100 and {r["rank"] for r in got} == {1, 2, 3}
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.mine(table.where("vec_id % 50 <> 0")).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(50, [1e9], 1), (51, [1e9], 2)], "vec_id long, embedding array<double>, label int"))
