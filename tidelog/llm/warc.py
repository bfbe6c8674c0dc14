"""WARC archives of pages, and a globally ordered index of their captures by external merge.

Writing. Each page becomes one record. Of pages with equal payloads of REVISIT_FROM bytes or more, the one with the
smallest page_id is a response; the others revisit it and carry no payload. Spark's text writer puts the records into
gzip files in the shared folder: header, block and the two line ends are text, so a file is a valid archive and executors
need no file system but Spark's. Records are written by classes of size, each with its number of records a file, so that
no file holds more than FILE_BYTES of pages, or one page that is larger by itself.

Reading. Every archive is read whole, cut by Content-Length, and its payload digests are checked; its captures, sorted by
URL key and time, are one run of the index.

Merging. Runs are dealt by ranges of (URL key, time, page_id); in each range Spark hands them over run by run, each in its
order, and a loser tree merges them. The tree holds a few decoded rows of each run; the rest waits in Arrow blocks. So the
index is ordered within and across its partitions. A hot URL key spreads over ranges by time and page_id.

Defined results: null html is an empty payload; a null url has URL key "" and no target line; a null page_id is no
response's id: such a page is a response unless another page has its payload; equal page_ids with equal payloads are all
responses. A url comes back as it was, whatever its characters: its target line has blanks and control characters
percent-encoded, a line of its own has it in full. Without capture times given, a page's is made from page_id, within
twenty years; times that are null or outside the years 1 to 9999 count as the start of 1970.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import deleted_at_exit, made, shared_dir, small_batches, stored

REVISIT_FROM, MERGE_ROWS, DECODED = 100, 100_000, 256
#: Bytes of pages that an archive holds, and the largest page of each class of sizes but the last.
FILE_BYTES, CLASSES = 32 << 20, (16 << 10, 256 << 10, 4 << 20)
#: Made-up capture times: the first, and the seconds that they spread over.
FIRST, SPAN = 1_704_067_200, 20 * 365 * 86_400
#: Fixed value: the profile that marks a record as a repeat of an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, LINE = "\r\n\r\n", "\r\n"
CAPTURE = "page_id long, url string, url_key string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, offset long, length long"


def url_key(url: str) -> str:
    """Host labels from the last to the first, then port, path and query, in lower case; no scheme, user or fragment."""
    rest = url.split("#", 1)[0]
    head, sep, tail = rest.partition("://")
    rest = tail if sep else head
    cut = min((i for c in "/?" if (i := rest.find(c)) >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2], rest[cut:]
    name, colon, port = host.partition(":")
    return f"{','.join(reversed(name.split('.')))}{colon}{port}){path or '/'}".lower() if url else ""


def line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(LINE))


def instant(pages: DataFrame, captured: Column | None) -> Column:
    made_up = F.timestamp_seconds(F.lit(FIRST) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(SPAN)))
    when = made_up if captured is None else F.when(F.year(captured).between(1, 9999), captured.cast("timestamp"))
    return F.date_format(F.coalesce(when, F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """size (bytes of page and url) and record, a string without its closing line ends.

    Pages meet their digest's first page_id in a join; a digest that very many pages share is counted before it, and the
    adaptive planner splits its side.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), instant(pages, captured).alias("at")
    ).withColumns({"digest": F.sha2(F.encode("html", "UTF-8"), 256), "size": F.octet_length("html")})
    few = rows.where(F.col("size") >= REVISIT_FROM).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    joined = rows.join(stored(few), F.col("digest") == F.col("d"), "left")
    repeat = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}"), line("Content-Length", F.col("size")), F.lit(LINE))
    block = F.when(repeat, F.lit("")).otherwise(F.concat(http, "html"))
    header = F.concat(
        F.lit(f"WARC/1.1{LINE}"),
        line("WARC-Type", F.when(repeat, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", F.col("at")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")), F.lit("")),
        F.coalesce(line("X-Page-URL", F.url_encode("url")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("WARC-Payload-Length", F.col("size")),
        F.when(repeat, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block)),
        F.lit(LINE),
    )
    return joined.select((F.col("size") + F.coalesce(F.octet_length("url"), F.lit(0))).alias("size"), F.concat(header, block).alias("record"))


def write(pages: DataFrame, path: str | None = None, captured: Column | None = None) -> str:
    """Writes the archives of pages (page_id, url, html) and returns their folder."""
    spark = pages.sparkSession
    if not path:
        path = shared_dir(spark)
        (made[-1].append if made else lambda p: deleted_at_exit(spark, p))(path)
    bytes_of = F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0))
    kind = F.lit(len(CLASSES))
    for i, most in reversed(list(enumerate(CLASSES))):
        kind = F.when(bytes_of <= most, i).otherwise(kind)
    found = sorted(r[0] for r in pages.select(kind.alias("kind")).distinct().collect())
    made_of = records(pages, captured)
    for i in found or [0]:
        low, high = (CLASSES[i - 1] if i else -1), (CLASSES[i] if i < len(CLASSES) else None)
        part = made_of.where((F.col("size") > low) & (F.col("size") <= high if high else F.lit(True))).select("record")
        part.write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, FILE_BYTES // high) if high else 1).text(path)
    return path


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(header, block, offset, length) of each record of an unpacked archive; ValueError if it is cut short or damaged."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        header = {}
        for row in data[at:end].decode("utf-8").split("\r\n")[1:]:
            name, _, value = row.partition(":")
            header[name.strip().lower()] = value.strip()
        size = int(header["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield header, block, at, end + 8 + size - at
        at = end + 8 + size


def page_of(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return int(name) if name.lstrip("-").isdigit() else None


def order(row: tuple) -> tuple:
    """Captures by URL key, time, page_id (none first), place."""
    return row[2], row[3], row[0] is not None, row[0] or 0, row[8], row[9]


def captures(data: bytes, run: str) -> list[tuple]:
    out = []
    for header, block, offset, length in parsed(data):
        kind, size = header["warc-type"], int(header["warc-payload-length"])
        digest = header["warc-payload-digest"].partition(":")[2]
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"{run}: the payload at byte {offset} does not have its digest")
        url = unquote_plus(header["x-page-url"]) if "x-page-url" in header else header.get("warc-target-uri", "")
        out.append((page_of(header["warc-record-id"]), url, url_key(url), header["warc-date"], size, digest, kind, page_of(header["warc-refers-to"]) if kind == "revisit" else None, run, offset, length))
    return sorted(out, key=order)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [c.split() for c in CAPTURE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(column, type=kinds[kind]) for column, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[name for name, _ in fields])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives in path, a sorted run for each archive."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows = captures(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content, name.rpartition("/")[2])
                if rows:
                    yield batch_of(rows)

    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(work, CAPTURE)


def decoded(blocks: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a run's blocks, of which a few are decoded at a time; a block is let go when it has been read."""
    blocks.reverse()
    while blocks:
        block = blocks.pop()
        for lo in range(0, block.num_rows, DECODED):
            yield from zip(*(c.to_pylist() for c in block.slice(lo, DECODED).columns), strict=True)


class LoserTree:
    """Merges sorted runs: inner nodes keep the losers of their matches, so the next row costs one path to the top."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.head: list[tuple | None] = [next(r, None) for r in self.runs]
        self.key = [None if h is None else order(h) for h in self.head]
        self.size = max(1, len(runs))
        self.loser = [-1] * self.size
        self.top = -1
        for i in range(len(runs)):
            self.play(i)

    def beats(self, i: int, j: int) -> bool:
        a, b = self.key[i], self.key[j]
        return b is None or (a is not None and (a, i) < (b, j))

    def play(self, i: int) -> None:
        node = (i + self.size) // 2
        while node:
            j = self.loser[node]
            if j < 0:  # no opponent yet: waits here
                self.loser[node] = i
                return
            if self.beats(j, i):
                self.loser[node], i = i, j
            node //= 2
        self.top = i

    def __iter__(self) -> Iterator[tuple]:
        while self.top >= 0 and self.head[self.top] is not None:
            i = self.top
            yield self.head[i]
            past, self.head[i] = self.key[i], next(self.runs[i], None)
            self.key[i] = None if self.head[i] is None else order(self.head[i])
            if self.key[i] is not None and self.key[i] < past:
                raise ValueError("a run is not in order")
            self.play(i)


def merged(captured: DataFrame) -> DataFrame:
    """The captures in global order: by URL key, time and page_id within a partition, and partitions one after another."""
    names = [c.split()[0] for c in CAPTURE.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:  # run by run
            run = batch.column(names.index("run")).dictionary_encode()
            at = run.indices.to_numpy()
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(edges, edges[1:], strict=False):
                runs.setdefault(run[lo].as_py(), []).append(batch.slice(lo, hi - lo))
        held: list[tuple] = []
        for row in LoserTree([decoded(runs.pop(k)) for k in sorted(runs)]):
            held.append(row)
            if len(held) == DECODED * 16:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    runs = stored(captured)
    small_batches(captured.sparkSession)
    parts = max(8, -(-runs.count() // MERGE_ROWS))
    place = ["url_key", "captured", "page_id", "run", "offset"]
    dealt = runs.repartitionByRange(parts, *place).sortWithinPartitions("run", *place)
    return dealt.mapInArrow(work, CAPTURE)


def index(pages: DataFrame, path: str | None = None, captured: Column | None = None) -> DataFrame:
    """Writes the pages' archives, reads them back, and gives their merged capture index."""
    return merged(read(pages.sparkSession, write(pages, path, captured)))
