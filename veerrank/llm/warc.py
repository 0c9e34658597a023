"""Web archives (WARC 1.1) of pages, written and read by Spark's text files, and their merged capture index.

Records of equal payloads of at least `least` bytes are one response, that of the largest page id, and revisits that
refer to it and hold the HTTP head only. Digests (a row for each payload, summed before they move) say which. The at
most 1,000 payloads that make up a thousandth or more of all repeated records are broadcast; only other pages meet their payload's
row by a shuffle, so a payload of a third of all pages is no single task's.

An archive is a gzip-compressed text file whose records end in an empty line, as the format has it. Reading goes by that
separator too, but a record ends where its Content-Length says: blocks that a payload's own empty lines have parted are
put together again. Payloads are hashed again while they are read, and a digest that differs raises.

Defined results: null texts are empty payloads; null ids have no Page-ID, come below all others and, where all of a group
are null, are all responses, as are repeated rows of the largest id; null URLs have no WARC-Target-URI and the empty key;
white space and control characters of a URL are percent-encoded; an empty table gives archives without records; other
columns are ignored. Dates are those of `date_col`, else so many seconds after START as the id says (modulo 1e9).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import capture_index
from .store import buckets_for, scratch, stash

#: Input bytes of an archive; 2020-01-01.
ARCHIVE_BYTES, START = 32 << 20, 1_577_836_800
#: Payloads that are broadcast make up at least this share of the repeated records, so there are at most its reciprocal.
HOT_SHARE = 0.001
END = "\r\n\r\n"
_END = END.encode()
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURES = "page_id long, url string, date long, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long"


def _record_id(page_id: Column, digest: Column) -> Column:
    name = F.md5(F.concat_ws("/", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _clean(url: Column) -> Column:
    """A URL that fits into a header line."""
    odd = F.regexp_extract_all(url, F.lit(r"([\x00-\x20\x7F])"), F.lit(1))
    return F.aggregate(F.array_distinct(odd), url, lambda u, c: F.replace(u, c, F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))))


def _pages(pages: DataFrame, id_col: str, url_col: str, payload_col: str, date_col: str | None) -> DataFrame:
    payload, page_id = F.coalesce(F.col(payload_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    date = F.unix_timestamp(F.col(date_col).cast("timestamp")) if date_col else F.lit(START) + F.coalesce(F.pmod(page_id, F.lit(1_000_000_000)), F.lit(0))
    return pages.select(page_id.alias("page_id"), _clean(F.col(url_col).cast("string")).alias("url"), date.alias("date"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload.cast("binary")).alias("digest"))


def _named(name: str, value: Column) -> Column:
    """A header line, null where the value is."""
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def _utc(seconds: Column) -> Column:
    """An ISO date of seconds since 1970, whatever the session's time zone."""
    day, second = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")), F.pmod(seconds, F.lit(86400))
    return F.format_string("%sT%02d:%02d:%02dZ", day.cast("string"), F.floor(second / 3600), F.floor(second % 3600 / 60), second % 60)


def _record(revisit: Column) -> Column:
    """A row's record without its last empty line."""
    head = F.concat_ws("\r\n", F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"), _named("Content-Length", F.col("bytes")))
    block = F.concat(head, F.lit(END), F.when(revisit, "").otherwise(F.col("payload")))
    return F.concat(
        F.concat_ws(
            "\r\n", F.lit("WARC/1.1"), _named("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _named("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
            _named("WARC-Date", _utc(F.col("date"))), _named("WARC-Target-URI", F.col("url")), _named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.when(revisit, _named("WARC-Profile", F.lit(_PROFILE))), F.when(revisit, _named("WARC-Refers-To", _record_id(F.col("top"), F.col("digest")))), F.when(revisit, _named("Refers-To-Page-ID", F.col("top"))),
            _named("Page-ID", F.col("page_id")), F.lit("Content-Type: application/http; msgtype=response"), _named("Content-Length", F.octet_length(block)),
        ),
        F.lit(END), block,
    )


def write_archives(pages: DataFrame, path: str | None = None, least: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None) -> str:
    """Write a record for every page; gives the folder of archives."""
    spark = pages.sparkSession
    path = path or scratch(spark, "archives")
    rows = _pages(pages, id_col, url_col, payload_col, date_col)
    tops = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    tops = stash(tops, "payloads")
    repeated = tops.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") >= max(2, HOT_SHARE * repeated)
    found = rows.join(F.broadcast(tops.where(hot).select("digest", F.col("top").alias("hot_top"), F.lit(True).alias("hot"))), "digest", "left")
    # Pages that need no lookup get keys of their own, so that they are dealt evenly.
    alone = F.col("hot").isNotNull() | (F.col("bytes") < least)
    keyed = found.withColumn("key", F.when(alone, F.concat_ws("/", "digest", F.monotonically_increasing_id().cast("string"))).otherwise(F.col("digest")))
    n = buckets_for(pages, ARCHIVE_BYTES)
    cold = tops.where(~hot).select(F.col("digest").alias("key"), F.col("top").alias("cold_top"))
    joined = keyed.repartition(n, "key").join(cold.repartition(n, "key").hint("shuffle_hash"), "key", "left").withColumn("top", F.coalesce("hot_top", "cold_top"))
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    joined.select(_record(revisit).alias("value")).write.option("compression", "gzip").option("lineSep", END).text(path)
    return path


def _headers(block: bytes) -> dict[str, str]:
    first, *lines = block.decode().split("\r\n")
    return dict(line.split(": ", 1) for line in lines) | {"": first}


def _capture(head: dict[str, str], block: bytes) -> dict:
    """What the index holds of a record."""
    cut = block.index(_END)
    http, payload, digest = _headers(block[:cut]), block[cut + 4 :], head["WARC-Payload-Digest"].removeprefix("sha1:")
    response = head["WARC-Type"] == "response"
    if response and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {head['WARC-Record-ID']} is not that of its digest")
    number = lambda name: int(head[name]) if name in head else None
    date = int(datetime.fromisoformat(head["WARC-Date"]).timestamp())
    return {"page_id": number("Page-ID"), "url": head.get("WARC-Target-URI"), "date": date, "record_type": head["WARC-Type"], "payload_bytes": len(payload) if response else int(http["Content-Length"]), "payload_digest": digest, "refers_to": number("Refers-To-Page-ID")}


class Archive:
    """Records from the blocks of one archive, in order."""

    def __init__(self, name: str):
        self.name, self.offset, self.held, self.head, self.need, self.between = name, 0, bytearray(), None, 0, b""

    def feed(self, block: bytes) -> Iterator[dict]:
        """The records that this block completes; what parts it from the next comes with the next, as the last one of a file may have nothing behind it."""
        self.held += self.between + block
        self.between = _END
        while True:
            if self.head is None:
                cut = self.held.find(_END)
                if cut < 0:
                    return
                self.head = _headers(bytes(self.held[:cut]))
                if not self.head[""].startswith("WARC/"):
                    raise ValueError(f"{self.name} holds no record at {self.offset}")
                self.begin = cut + 4
                self.need = self.begin + int(self.head["Content-Length"]) + 4
            if len(self.held) < self.need:
                return
            yield _capture(self.head, bytes(self.held[self.begin : self.need - 4])) | {"archive": self.name, "offset": self.offset, "length": self.need}
            self.offset += self.need
            del self.held[: self.need]
            self.head = None

    def close(self) -> Iterator[dict]:
        """The last record."""
        if self.held:
            yield from self.feed(b"")
        if self.held:
            raise ValueError(f"{self.name} ends inside a record")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A capture for every record: what its headers say, its archive, and offset and length there (before compression)."""
    blocks = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_name").alias("archive"))
    names = [c.split()[0] for c in CAPTURES.split(", ")]
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in CAPTURES.split(", ")])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None  # compressed files are not split: a task reads whole archives, one after the other
        for batch in batches:
            out = []
            for value, name in zip(batch["value"], batch["archive"]):
                if archive is None or archive.name != name.as_py():
                    if archive:
                        out += archive.close()
                    archive = Archive(name.as_py())
                out += archive.feed(value.as_buffer().to_pybytes())
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if archive:
            yield pa.RecordBatch.from_pylist(list(archive.close()), schema=schema)

    return blocks.mapInArrow(parse, CAPTURES).select(*names)


def archived(pages: DataFrame, least: int = 1000, **columns: str) -> DataFrame:
    """Write archives, read them back, and give their captures in global order: place, url_key, and what `read_archives` gives."""
    path = write_archives(pages, least=least, **columns)
    return capture_index.numbered(capture_index.merged(read_archives(pages.sparkSession, path)))
