"""WARC archives with revisit records, and an external merge of their capture indexes.

Writing: each page is one WARC/1.1 record around an HTTP response. Of records with equal payloads of at least
`min_bytes` bytes the one with the largest page id is the response; the others are revisits that refer to it and
keep only the HTTP headers. Records are written as gzipped text whose line separator is the empty line that ends a
record, so archives go through Spark's own writer to any store. A file holds at most RECORDS_PER_FILE records of at
most LARGE bytes, or one larger record.

Index: every archive is unpacked piece by piece and parsed into a run of index entries, sorted by URL key and capture
time. A response's length and digest are those of the bytes that were read; bytes that don't give the digest of the
record's header, and revisits whose response is not in the archives, raise ValueError.

Merge: entries are dealt out by ranges of (URL key, time, page id, place), of RANGE_ROWS entries on average, and arrive
sorted by (archive, key), that is as sorted runs one after the other. Within a range a loser tree merges the runs, so
that the ranges, one after the other, hold each URL's captures in order. Entries have no payload, and a URL with many
captures is cut into several ranges, as time and place are in the key.

Defined results: a null html is an empty payload; a null URL has the empty key; pages with equal payloads and the
largest id more than once are all responses; rows with a null page id are responses and revisit nothing; line
breaks in URLs are percent-encoded; offsets and lengths of entries are those in the unpacked archive; no rows give
no archive and no entries; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_join, new_path, small

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records in an archive file at most; payloads of more than LARGE bytes have files of their own.
RECORDS_PER_FILE, LARGE = 1000, 1 << 18
#: Bytes that a parser unpacks at once.
PIECE = 1 << 20
#: Index entries in a range of the merge, on average.
RANGE_ROWS = 50_000
#: Capture times are this instant plus the page id in seconds, as pages carry none.
EPOCH = "2024-01-01 00:00:00"
ID_PREFIX = "urn:shelfspark:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FIELDS = "url_key string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def base32(hexed: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: ten hex digits at a time are eight digits to the base of 32."""
    parts = [F.lpad(F.conv(F.substring(hexed, i + 1, 10), 16, 32), 8, "0") for i in range(0, 40, 10)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _digested(pages: DataFrame, *keep: str) -> DataFrame:
    """(page_id, *keep, digest, payload_bytes); the hash is made by a step of its own, once a row."""
    body = F.coalesce(F.col("html"), F.lit(""))
    given = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("body"), F.sha1(F.encode(body, "UTF-8")).alias("_hex"), F.octet_length(body).cast("long").alias("payload_bytes"))
    return given.select("page_id", *keep, base32(F.col("_hex")).alias("digest"), "payload_bytes")


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) as (page_id, url, body, digest, payload_bytes, refers_to, record_type).

    Payloads are not grouped: only their digests are, from one pass that keeps no body. The revisits that come of
    it are broadcast if they are few, so that bodies stay where they were read; else bodies are shuffled once.
    """
    slim = cut(_digested(pages))
    largest = slim.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
    older = hot_join(slim, largest.where("_n > 1"), ["digest", "payload_bytes"], "_n").where(F.col("page_id") < F.col("_last")).select("page_id", "digest", F.col("_last").alias("refers_to")).distinct()
    side, _ = small(cut(older))
    return _digested(pages, "url", "body").join(side, ["page_id", "digest"], "left").withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def record_text(spark: SparkSession) -> Column:
    """The record of a planned page, without the two line ends that close it."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    when = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.coalesce(F.col("page_id"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(F.col("record_type") == "response", F.col("body")).otherwise(F.lit("")))
    revisit = F.when(F.col("record_type") == "revisit", F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: <{ID_PREFIX}"), F.col("refers_to").cast("string"), F.lit(f">{CRLF}"))).otherwise(F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"), F.lit(f"{CRLF}WARC-Record-ID: <{ID_PREFIX}"), page, F.lit(f">{CRLF}WARC-Target-URI: "), url,
        F.lit(f"{CRLF}WARC-Date: "), when, F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF), revisit,
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block,
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE, large: int = LARGE) -> str:
    """Writes the pages' records under `path` and returns it."""
    planned, big = plan_records(pages, min_bytes), F.col("payload_bytes") > large

    def write(records: DataFrame, most: int) -> None:
        records.select(record_text(pages.sparkSession).alias("value")).write.mode("append").options(lineSep=CRLF * 2, maxRecordsPerFile=most, compression="gzip").text(path)

    write(planned.where(~big), records_per_file)
    if not pages.where(F.octet_length("html") > large).isEmpty():
        write(planned.where(big), 1)
    return path


def url_key(url: str) -> str:
    """A sort-friendly key: host labels reversed, then the path and query; scheme, user, port and fragment go."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    if "?" in host:
        host, _, query = rest.partition("?")
        slash, path = "?", query
    host = host.rsplit("@", 1)[-1].split(":", 1)[0].lower()
    return ",".join(reversed(host.split("."))) + ")" + slash + path if url else ""


class _Unpacked:
    """A gzipped archive as a stream: only what is asked for is unpacked."""

    def __init__(self, packed: memoryview) -> None:
        self.packed, self.fed, self.inflate, self.held, self.at = packed, 0, zlib.decompressobj(31), bytearray(), 0

    def _more(self) -> bool:
        if self.inflate.eof:  # members may follow one another
            rest = self.inflate.unused_data
            self.fed -= len(rest)
            self.inflate = zlib.decompressobj(31)
        tail = self.inflate.unconsumed_tail
        if not tail:
            tail, self.fed = self.packed[self.fed : self.fed + PIECE], min(len(self.packed), self.fed + PIECE)
            if not len(tail):
                return False
        self.held += self.inflate.decompress(tail, PIECE)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to and with the next mark; None at the end."""
        begin = 0
        while (end := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - len(mark))
            if not self._more():
                if self.held:
                    raise ValueError(f"a record without an end at byte {self.at}")
                return None
        return self.take(end + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError(f"a record without an end at byte {self.at}")
        out = bytes(self.held[:n])
        del self.held[:n]
        self.at += n
        return out


def parse_archive(name: str, packed: bytes | memoryview) -> Iterator[tuple[Any, ...]]:
    """Index entries of an archive's records, in the order of FIELDS; lengths and digests of responses are made from what was read."""
    raw, ends = _Unpacked(memoryview(packed)), CRLF.encode() * 2
    while True:
        at = raw.at
        if (head := raw.until(ends)) is None:
            return
        version, *lines = head[:-4].decode().split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"{name}: no record at byte {at}")
        said = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        block = raw.take(int(said["Content-Length"]))
        if raw.take(4) != ends:
            raise ValueError(f"{name}: the record at byte {at} doesn't end where its length says")
        http, _, body = block.partition(ends)
        size = next(int(x.split(": ")[1]) for x in http.decode().split(CRLF) if x.startswith("Content-Length: "))
        digest = said["WARC-Payload-Digest"].removeprefix("sha1:")
        if said["WARC-Type"] == "response":
            found = base64.b32encode(hashlib.sha1(body).digest()).decode()
            if (found, len(body)) != (digest, size):
                raise ValueError(f"{name}: the payload of the record at byte {at} is not the one that was written")
            digest, size = found, len(body)
        page, refers = said["WARC-Record-ID"][len(ID_PREFIX) + 1 : -1], said.get("WARC-Refers-To")
        yield url_key(said["WARC-Target-URI"]), said["WARC-Date"], int(page) if page else None, said["WARC-Target-URI"], said["WARC-Type"], int(refers[len(ID_PREFIX) + 1 : -1]) if refers else None, size, digest, name, at, raw.at - at


def _order(entry: tuple[Any, ...]) -> tuple[Any, ...]:
    """URL key, capture time, page id (null first), then the place of the record."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[8], entry[9]


class LoserTree:
    """Merges sorted runs: a tournament whose inner nodes hold the losers, so each entry costs one path to the root."""

    def __init__(self, runs: list[Iterable[Any]], key=_order) -> None:
        self.runs, self.key, self.k = [iter(r) for r in runs], key, len(runs)
        self.head = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, self.k)
        self.winner = self._build(1) if self.k else -1

    def _before(self, a: int, b: int) -> bool:
        if self.head[a] is None or self.head[b] is None:
            return self.head[b] is None and (self.head[a] is not None or a < b)
        x, y = self.key(self.head[a]), self.key(self.head[b])
        return x < y or x == y and a < b

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        first, second = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = second
        return first

    def __iter__(self) -> Iterator[Any]:
        while self.winner >= 0 and self.head[self.winner] is not None:
            run = self.winner
            yield self.head[run]
            self.head[run] = next(self.runs[run], None)
            node = (run + self.k) // 2
            while node:
                if self._before(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def index_runs(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all archives under `path`; those of one archive are a run, in order."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, raw in zip(part.column(0), part.column(1), strict=True):
                yield _batch(sorted(parse_archive(name.as_py().rsplit("/", 1)[-1], memoryview(raw.as_buffer())), key=_order))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(each, FIELDS)


def _batch(entries: list[tuple[Any, ...]]) -> pa.RecordBatch:
    kinds = [pa.int64() if f.endswith(" long") else pa.string() for f in FIELDS.split(", ")]
    columns = list(zip(*entries, strict=True)) if entries else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], NAMES)


def merge_runs(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """All entries in order of (URL key, time, page id, place): ranges in order, each merged from its parts of the runs."""
    keys = ["url_key", "captured", "page_id", "archive", "offset"]
    dealt = runs.repartitionByRange(ranges or 1 + runs.count() // RANGE_ROWS, *keys).sortWithinPartitions("archive", *keys)

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = (entry for part in parts for entry in zip(*(c.to_pylist() for c in part.columns), strict=True))
        tree = LoserTree([list(run) for _, run in groupby(entries, key=lambda entry: entry[8])])
        out: list[tuple[Any, ...]] = []
        for entry in tree:
            out.append(entry)
            if len(out) == 8192:
                yield _batch(out)
                out = []
        yield _batch(out)

    return dealt.mapInArrow(each, FIELDS)


def check_revisits(entries: DataFrame) -> None:
    """Raises ValueError if a revisit's response, with the same digest and length, is not among the entries."""
    same = ["page_id", "payload_digest", "payload_bytes"]
    responses = entries.where("record_type = 'response'").select(*same)
    # equal revisits are one before they meet their response
    if not entries.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), *same[1:]).distinct().join(responses, same, "left_anti").isEmpty():
        raise ValueError("a revisit refers to a response that is not in the archives")


def capture_histories(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes archives (under `path`, or a new folder of the shared ones) and returns their merged index."""
    spark = pages.sparkSession
    if pages.isEmpty():
        return spark.createDataFrame([], FIELDS)
    entries = cut(index_runs(spark, write_archives(pages, path or new_path(spark, "warc"), min_bytes)))
    check_revisits(entries)
    return merge_runs(entries)


OP5_SQL = f"""
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
b AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('{BASE32}',
           ((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31) + 1, 1)), '') AS d FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS last FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM m"""
