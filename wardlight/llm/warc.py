"""Web archives: writing, reading back, and merging the indexes of capture runs.

Archives are written by Spark's text writer. A WARC record ends with two line
ends, so records are rows and the two line ends are the row separator; the
files are then plain WARC files, written with Spark's commit protocol to any
file system that Spark knows. They are read with the version line as separator,
and the declared length of each record, not the separator, says where it ends.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.graph import Shelf
from wardlight.session import work_folder

# Fixed values of the format.
VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Index rows that one merge task holds.
MERGE_ROWS = 500_000


# Digits of base 32, as conv() writes them and as digests do.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def url_key(url: Column) -> Column:
    """The sort key of a URL, lower-cased: host labels in reverse order, then the rest; without ``://`` the whole URL."""
    rest = F.regexp_replace(F.lower(url), "^.*?://", "")
    labels = F.split(F.regexp_extract(rest, "^[^/?#]*", 0), "\\.")
    key = F.concat(F.array_join(F.reverse(labels), ","), F.lit(")"), F.regexp_replace(rest, "^[^/?#]*", ""))
    return F.coalesce(F.when(url.contains("://"), key).otherwise(F.lower(url)), F.lit(""))


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of bytes in base 32: four groups of forty bits, eight digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def _named(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _uuid(*parts: Column) -> Column:
    text = F.md5(F.concat_ws("|", *parts).cast("binary"))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(text, a, n) for a, n in cuts]), F.lit(">"))


def records(pages: DataFrame, least_bytes: int, shelf: Shelf) -> DataFrame:
    """One record text for each row of (page_id, url, html, captured)."""
    body = F.coalesce(F.col("html"), F.lit(""))
    full = pages.withColumn("html", body).withColumn("size", F.octet_length("html").cast("long")).withColumn(
        "digest", base32_sha1(F.col("html").cast("binary")))
    # only payloads that occur more than once can make a revisit
    again = shelf.settled(full.filter(F.col("size") >= least_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first"))
    held = full.join(again, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _named("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    clean_url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    page, first = F.col("page_id").cast("string"), F.col("first").cast("string")
    header = F.concat(
        F.lit(VERSION), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        _named("WARC-Record-ID", _uuid(F.coalesce(page, F.lit("")), F.col("digest"))),
        _named("WARC-Date", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _named("WARC-Target-URI", clean_url), _named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(_named("WARC-Profile", F.lit(PROFILE)), _named("WARC-Refers-To", _uuid(first, F.col("digest"))),
                                 _named("X-Refers-To-Page", first))).otherwise(""),
        _named("X-Page", page), F.lit("Content-Type: application/http;msgtype=response\r\n"),
        _named("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    return held.select(F.concat(header, block).alias("value"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", captured: Column | None = None) -> None:
    """Write a record for each row below ``folder``, compressed as a whole by gzip.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with
    the smallest id is a response and the others are revisits of it; rows that
    repeat that id are responses too, as are all where no id is known. A null
    payload is empty, a null URL or id leaves its header line out. Without a
    capture time a row counts as captured id seconds into 2024.
    """
    since = F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"), (since if captured is None else captured).alias("captured"))
    shelf = Shelf()
    records(rows, least_bytes, shelf).write.option("lineSep", END).option("compression", "gzip").text(folder)
    shelf.clear(pages.sparkSession)


class Record:
    """One record as read: its header fields, where it lies, and its content."""

    def __init__(self, raw: bytes, file: str, offset: int):
        head, _, rest = raw.partition(END.encode())
        lines = head.decode().split("\r\n")[1:]
        self.fields = dict(line.split(": ", 1) for line in lines)
        self.block = rest[:int(self.fields["Content-Length"])]
        self.file, self.offset, self.length = file, offset, len(raw)

    def row(self) -> tuple:
        """page_id, payload_bytes, payload_digest, record_type, refers_to, url, captured, file, offset, length."""
        http, _, payload = self.block.partition(END.encode())
        size = int(http.decode().rpartition("Content-Length: ")[2])
        digest = self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = self.fields["WARC-Type"]
        if kind == "response":
            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if own != digest or len(payload) != size:
                raise ValueError(f"{self.file} at {self.offset}: the payload is not the one that was written")
        number = {k: int(v) if (v := self.fields.get(k)) is not None else None for k in ("X-Page", "X-Refers-To-Page")}
        return (number["X-Page"], size, digest, kind, number["X-Refers-To-Page"], self.fields.get("WARC-Target-URI"),
                self.fields["WARC-Date"], self.file, self.offset, self.length)


def parse(rows: Iterator[tuple[str, bytes]]) -> Iterator[Record]:
    """Records of files whose pieces between version lines come in order."""
    file, offset, pending, mark = None, 0, b"", VERSION.encode()
    for name, piece in rows:
        if name != file:
            if pending:
                raise ValueError(f"{file} ends within a record")
            file, offset = name, 0
            if not piece:  # what stands before the first version line
                continue
        pending += mark + piece
        head = pending.find(END.encode())
        if head < 0:
            continue
        fields = pending[:head].decode()
        wanted = head + len(END) * 2 + int(fields.rpartition("\r\nContent-Length: ")[2].partition("\r\n")[0])
        if len(pending) >= wanted:
            yield Record(pending, file, offset)
            offset += len(pending)
            pending = b""
    if pending:
        raise ValueError(f"{file} ends within a record")


_CAPTURES = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
             "url string, captured string, file string, offset long, length long")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of a folder of archives; payloads are checked against their digests."""
    schema = pa.schema([(f.split(" ")[0], pa.int64() if f.endswith("long") else pa.string()) for f in _CAPTURES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((f, v) for b in batches for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        rows: list[tuple] = []
        for record in parse(pieces):
            rows.append(record.row())
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    lines = spark.read.schema("value string").option("lineSep", VERSION).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary")).mapInArrow(run, _CAPTURES)


class LoserTree:
    """Merges sorted runs. Inner nodes hold the run that lost there; the winner's path alone is played again."""

    def __init__(self, runs: Sequence[Iterator[Any]], key):
        self.runs, self.key = runs, key
        self.heads: list[Any] = [next(r, None) for r in runs]
        self.losers = [-1] * len(runs)
        for i in range(len(runs)):
            self._play(i, building=True)

    def _less(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return (self.key(a), i) < (self.key(b), j)

    def _play(self, i: int, building: bool = False) -> None:
        node = (i + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = i  # waits for its opponent
                return
            if self._less(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[Any]:
        while self.runs and self.heads[self.losers[0]] is not None:
            i = self.losers[0]
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def merge_histories(captures: DataFrame, shelf: Shelf, rows_per_task: int = MERGE_ROWS) -> DataFrame:
    """Captures in global order of URL key, time and page: by (shard, place).

    Each task's captures, sorted, are a run, written to shared storage. Ranges
    of keys, drawn so that each holds a bounded number of rows even where one
    URL has very many captures, take their slice of every run and merge the slices.
    """
    order = ["url_key", "captured", "page_id"]
    keyed = captures.withColumn("url_key", url_key(F.col("url"))).withColumn("run", F.spark_partition_id())
    runs = shelf.settled(keyed.sortWithinPartitions(*order))
    tasks = max(1, -(-runs.count() // rows_per_task))
    slices = runs.repartitionByRange(tasks, *order).sortWithinPartitions("run", *order)
    schema = runs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        own = table.column("run").to_numpy()
        keys = list(zip(*[table.column(c).to_pylist() for c in order]))
        edges = [0, *[i for i in range(1, len(own)) if own[i] != own[i - 1]], len(own)]
        heads = [iter(range(a, b)) for a, b in zip(edges, edges[1:])]
        merged = list(LoserTree(heads, lambda i: (keys[i][0], keys[i][1] or "", keys[i][2] is not None, keys[i][2] or 0)))
        sorted_ = table.take(pa.array(merged)).append_column("place", pa.array(range(len(merged)), pa.int64()))
        yield from sorted_.to_batches()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return slices.mapInArrow(run, f"{kinds}, place long").withColumn("shard", F.spark_partition_id())


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages as archives, read them back and merge the captures into histories.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    captured, file, offset, length, url_key, run, place, shard) for every row; a
    null URL has an empty key. An empty table gives an empty result. The
    archives go below ``folder``, or into the shared work folder.
    """
    spark = pages.sparkSession
    folder = folder or work_folder(spark, "warc")
    write_archives(pages, folder)
    return merge_histories(read_archives(spark, folder), Shelf())
