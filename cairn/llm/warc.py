"""WARC archives and their external index merge.

Writing: each page is one WARC/1.1 record. Of pages with equal payloads of at least ``MIN_REVISIT`` bytes the one with
the smallest page_id is a response, the others are revisits that refer to it; smaller payloads are all responses.
A file begins with a warcinfo record; each record is a gzip member of its own, so that it can be fetched by the offset
and length that the index gives; a response's block is an HTTP message with the payload as its body. Spark's text writer
puts the members down, so the files go to any store that Spark writes to: a member ends with the highest byte of its
size, which is 0 below 16 MiB, and that is the writer's line separator. A larger record has several members.

Reading: each archive file is read member by member, payload digests are checked, and the entries of the file are
sorted by URL key and timestamp: one capture run. Ranges of the key, of bounded size each, take their stretch of every
run, and a loser tree merges these k sorted stretches, which gives globally ordered capture histories.

Defined cases: a null html is an empty payload; a null url has an empty target and key; repeated rows of a page (same
page_id and html) are written one by one, the first of equal payloads being each row with the smallest page_id; a null
page_id is carried through as null and is never referred to; line ends within a url are percent-encoded; an empty
table gives archives without pages and an empty result; other columns are ignored. Repeated rows have record ids of their
own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import bounded_batches, join_counted, materialize, scratch_path

MIN_REVISIT = 100
#: Payload bytes of one archive file, about; a larger single payload has a file of its own.
FILE_BYTES = 16 << 20
#: What a record has besides its payload, about; bytes of one gzip member; and of one range of the merged index.
RECORD_BYTES = 1024
MEMBER_BYTES = (1 << 24) - 1
RANGE_BYTES = 16 << 20
CRLF = "\r\n"
INFO = f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <urn:cairn:info>{CRLF}WARC-Date: 2020-01-01T00:00:00Z{CRLF}Content-Type: application/warc-fields{CRLF}Content-Length: 28{CRLF}{CRLF}software: cairn{CRLF}format: 1{CRLF}".encode()
INDEX = "urlkey string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """Host labels in reverse, then path and query: captures of one site stand together."""
    rest = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"\A[^:/]*://", ""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    tail = F.regexp_extract(rest, r"\A[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT, files: int | None = None) -> DataFrame:
    """(id, record): the id and the text of each page's record.

    The first page of each payload is found without the payloads; these move once, by digest, to ``files`` partitions; a
    very common digest's pages are spread over all of them.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    own = own.withColumns({"n": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    groups = own.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("pages")).where("pages > 1 AND first IS NOT NULL")
    own = join_counted(own, materialize(groups, "digests"), "digest", "pages", [F.col("page_id"), F.col("url")], files)
    revisit = (F.col("n") >= min_revisit) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(":"), F.substring("digest", 1, 16))
    target = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", "%0D%0A")
    date = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(315360000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    message = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    head = lambda kind, size, more: F.concat(  # noqa: E731  the record's id comes after this text's first line
        F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Target-URI: "), target, F.lit(f"{CRLF}WARC-URL-Key: "), F.regexp_replace(url_key(F.col("url")), r"[\r\n]+", "%0D%0A"),
        F.lit(f"{CRLF}WARC-Date: "), date, F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(f"{CRLF}WARC-Payload-Length: "), F.col("n").cast("string"), more,
        F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF + CRLF),
    )
    refers = F.concat(F.lit(f"{CRLF}WARC-Refers-To: "), named(F.col("first")), F.lit(f">{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    text = F.when(revisit, head("revisit", F.lit(0), refers)).otherwise(F.concat(head("response", F.col("n") + F.octet_length(message), F.lit("")), message, F.col("payload")))
    return own.select(named(F.col("page_id")).alias("id"), text.alias("record"))


def compressed(record: bytes) -> list[bytes]:
    """The gzip members of one record; each ends with a zero byte."""
    out = []
    for at in range(0, len(record), MEMBER_BYTES):
        z = zlib.compressobj(wbits=31)
        out.append(z.compress(record[at : at + MEMBER_BYTES]) + z.flush())
    return out


def members(rows: DataFrame) -> DataFrame:
    """(value): the gzip members of the records without their last byte, which the text writer puts between them."""

    def batch(own):
        ends = np.cumsum([0, *(len(x) - 1 for x in own)], dtype=np.int64)
        data = pa.py_buffer(b"".join(x[:-1] for x in own))
        value = pa.Array.from_buffers(pa.large_string(), len(own), [None, pa.py_buffer(ends), data])  # bytes, not characters
        return pa.RecordBatch.from_arrays([value], ["value"])

    def run(batches):
        seen: Counter = Counter()  # of the ids of one file
        yield batch(compressed(INFO + b"\r\n\r\n"))
        for b in batches:
            out = []
            for name, record in zip(b.column(0).to_pylist(), b.column(1)):
                seen[name] += 1
                name += f":{seen[name]}>" if seen[name] > 1 else ">"
                raw = bytes(record.as_buffer())
                at = raw.index(b"\r\n") + 2
                out += compressed(b"".join([raw[:at], f"WARC-Record-ID: {name}{CRLF}".encode(), raw[at:], b"\r\n\r\n"]))
            yield batch(out)

    return rows.mapInArrow(run, "value string")


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> None:
    """Write the records of pages as WARC files of gzip members under path; their number follows the records' size."""
    size = F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)).cast("long") + RECORD_BYTES
    files = max(1, -(-(pages.agg(F.sum(size)).first()[0] or 0) // file_bytes))
    members(records(pages, min_revisit, files)).write.option("lineSep", "\0").text(path)


def gzip_members(raw: memoryview, chunk: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each member, reading on chunk by chunk."""
    at = 0
    while at < len(raw):
        z, parts, end = zlib.decompressobj(31), [], at
        while not z.eof:
            if end >= len(raw):
                raise ValueError(f"the member at offset {at} is cut short")
            parts.append(z.decompress(raw[end : end + chunk]))
            end = min(end + chunk, len(raw))
        end -= len(z.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def parse_record(data: bytes) -> tuple[dict, bytes] | None:
    """Headers and block of one record; None if it isn't whole yet. Framing by Content-Length alone."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record")
    headers = dict(line.split(b": ", 1) if b": " in line else (line.rstrip(b":"), b"") for line in lines[1:])
    size = int(headers[b"Content-Length"])
    if len(data) < end + 8 + size:
        return None
    if data[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where it says")
    return headers, data[end + 4 : end + 4 + size]


def parse(raw: memoryview) -> Iterator[tuple[int, int, dict, bytes]]:
    """(offset, length, headers, block) of each record of an archive, its warcinfo left out."""
    held, first = b"", 0
    for at, size, data in gzip_members(raw):
        first = first if held else at
        held += data
        if found := parse_record(held):
            held = b""
            if found[0][b"WARC-Type"] != b"warcinfo":
                yield first, at + size - first, *found
    if held:
        raise ValueError(f"the record at offset {first} is cut short")


def payload_of(block: bytes) -> bytes:
    """The body of a response's HTTP message."""
    return block[block.index(b"\r\n\r\n") + 4 :]


def _page(urn: bytes | None) -> int | None:
    own = urn.decode().removeprefix("<urn:page:").split(":")[0] if urn else "none"
    return None if own == "none" else int(own)


def entry(headers: dict, block: bytes, file: str, offset: int, length: int) -> tuple:
    """One index entry; a response's digest and length are those of the payload that was read."""
    kind = headers[b"WARC-Type"].decode()
    digest, size = headers[b"WARC-Payload-Digest"].decode().removeprefix("sha256:"), int(headers[b"WARC-Payload-Length"])
    if kind == "response":
        payload = payload_of(block)
        if (digest, size) != (found := (hashlib.sha256(payload).hexdigest(), len(payload))):
            raise ValueError(f"{file}, offset {offset}: payload {found} isn't {(digest, size)}")
    return headers[b"WARC-URL-Key"].decode(), headers[b"WARC-Date"].decode(), _page(headers[b"WARC-Record-ID"]), size, digest, kind, _page(headers.get(b"WARC-Refers-To")), file, offset, length


def order(row: tuple) -> tuple:
    """URL key, timestamp, then page (null first), file and offset."""
    return row[0], row[1], -1 if row[2] is None else 0, row[2] or 0, row[7], row[8]


class LoserTree:
    """Merges k sorted runs: inner nodes keep the losers of their matches, so the next winner costs log2 k matches."""

    def __init__(self, runs: list) -> None:
        self.runs = [iter(r) for r in runs]
        self.heads = [self._next(i) for i in range(len(runs))]
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        winners = [-1] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._first(a, b) else (b, a)
        self.winner = winners[1] if self.size > 1 else 0

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (order(row), row)

    def _first(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x[0], a) <= (y[0], b)

    def __iter__(self):
        if not self.runs:
            return
        while (head := self.heads[self.winner]) is not None:
            yield head[1]
            now = self.winner
            self.heads[now] = self._next(now)
            node = (now + self.size) // 2
            while node:
                if not self._first(now, self.losers[node]):
                    now, self.losers[node] = self.losers[node], now
                node //= 2
            self.winner = now


def _batches(rows, count: int = 2000):
    names = [c.split(" ")[0] for c in INDEX.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[c.split(" ")[1]]) for n, c in zip(names, INDEX.split(", "))])
    held = []
    for row in rows:
        held.append(row)
        if len(held) == count:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema)
            held = []
    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema)


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The index entries of every archive file under path, each file's own sorted."""

    def run(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1)):  # one file at a time: each is one run
                name = file.rsplit("/", 1)[-1]
                yield from _batches(sorted((entry(h, c, name, at, n) for at, n, h, c in parse(memoryview(data.as_buffer()))), key=order))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX)


def merge_runs(runs: DataFrame, parts: int | None = None) -> DataFrame:
    """Globally ordered entries: ranges of the order, each merged from the sorted stretches of all runs. There are as many
    as leave RANGE_BYTES to each, about, which one task holds."""
    if parts is None:
        size = F.octet_length("urlkey").cast("long") + 200
        parts = max(1, -(-(runs.agg(F.sum(size)).first()[0] or 0) // RANGE_BYTES))
    ranged = runs.repartitionByRange(parts, "urlkey", "ts", "page_id", "file", "offset")

    def run(batches):
        stretches: dict[str, list] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                stretches.setdefault(row[7], []).append(row)
        ready = []
        for rows in stretches.values():  # a stretch arrives in its run's order, unless a reader was retried
            keys = [order(r) for r in rows]
            ready.append(rows if all(x <= y for x, y in zip(keys, keys[1:])) else sorted(rows, key=order))
        yield from _batches(LoserTree(ready))

    return ranged.mapInArrow(run, INDEX)


def capture_index(pages: DataFrame, path: str | None = None, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages as archives under path (default: a new shared folder), read them back and merge their index."""
    spark = pages.sparkSession
    bounded_batches(spark)
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, min_revisit, file_bytes)
    return merge_runs(materialize(capture_runs(spark, path), "runs"))


#: The query's rows; the order of captures is left to the reader.
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, lower(regexp_replace(coalesce(url, ''), '\\A[^:/]*://', '')) AS rest FROM pages),
f AS (SELECT *, CASE WHEN strlen(html) >= {MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  array_to_string(list_reverse(string_split(regexp_extract(rest, '\\A([^/?#]*)', 1), '.')), ',') || ')' || regexp_extract(rest, '\\A[^/?#]*([^#]*)', 1) AS urlkey,
  strftime(make_timestamp((1577836800 + page_id % 315360000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts
FROM f
"""
