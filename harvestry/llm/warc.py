"""WARC archives with a two-level capture index.

Writing: each task writes its records, a gzip member each, to archives of its own in the shared folder; a payload that
occurs more than once is a response record for the smallest id and revisit records for the others. An attempt that is
lost leaves an archive that no index names.

Index: captures are sorted by reversed-host URL key and id over all partitions. A partition is a shard: a file of
compressed blocks of captures, and at its end its sparse directory: the first key and the byte range of every block. One
row for each shard, its first key and the range of its directory, is the level above, and the only part that a reader
holds whole: as many rows as there are partitions.

Reading: sorted keys search the shards by bisection, read that directory's range, search it by bisection, read that
block's range, and then the ranges of the records. A record is checked against its digest as it is read.

Defined cases: a null html is an empty payload; a null url has the key ')'; null ids come last and refer to nothing of
their own; rows that share the smallest id of a payload are all responses; a payload of any length is one record, which
a worker holds; an empty table gives no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm import common as C

BLOCK = 512
ARCHIVE = 1 << 30
LEVEL = 5
_NONE = (1 << 63) - 1
_SAFE = {c: f"%{c:02X}" for c in [*range(33), 127]}


def url_key(url: str | None) -> str:
    """com,example,www)/path?query of a URL; without :// all of it counts as path."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        head, rest = "", "/" + head if head else ""
        return f"){rest}"
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, _, port = rest[:cut].lower().rpartition("@")[2].partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (rest[cut:].partition("#")[0] or "/")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """first: the id that a revisit refers to; None for a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if first is None else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page is None else page}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').translate(_SAFE)}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([] if first is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers in lower case, and its payload and payload length; raises ValueError if it is damaged."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    if h["warc-type"] == "response" and (len(payload) != size or f"sha1:{digest(payload)}" != h["warc-payload-digest"]):
        raise ValueError(f"{h['warc-record-id']}: the payload does not agree with its digest")
    return h | {"payload": payload, "payload-length": size}


def _page(urn: str) -> int | None:
    x = urn.strip("<>").rpartition(":")[2]
    return None if x == "none" else int(x)


_CAPTURE = "key string, id long, file string, offset long, length long"


def _write(at: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(at)
        out, name, end = None, "", 0
        for big in batches:
            for i in range(0, big.num_rows, 500):
                b, rows = big.slice(i, 500), []
                for page, url, html, first in zip(*(b.column(j).to_pylist() for j in range(4)), strict=True):
                    if out is None or end >= ARCHIVE:
                        if out is not None:
                            out.close()
                        name, end = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    data = gzip.compress(record(page, url, (html or "").encode(), first, date), LEVEL, mtime=0)
                    out.write(data)
                    rows.append((url_key(url), page, name, end, len(data)))
                    end += len(data)
                if i + 500 >= big.num_rows:
                    out.flush()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


def _order(key: str, page: int | None) -> list:
    return [key, _NONE if page is None else page]


def _shard(at: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(at)
        name, out, end, held, directory = f"{uuid.uuid4().hex}.cdx", None, 0, [], []

        def flush() -> None:
            nonlocal end
            data = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
            out.write(data)
            directory.append([held[0][:2], end, len(data)])
            end += len(data)
            held.clear()

        for b in batches:
            for key, page, file, offset, length in zip(*(b.column(j).to_pylist() for j in range(5)), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                held.append([*_order(key, page), file, offset, length])
                if len(held) == block:
                    flush()
        if out is None:
            return
        if held:
            flush()
        data = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(data)
        out.close()
        first = directory[0][0]
        yield pa.RecordBatch.from_pydict({"key": [first[0]], "id": [first[1]], "file": [name], "offset": [end], "length": [len(data)]})

    return run


class Archive:
    """Archives and their index in a folder; shards: (first key, first id, file, offset, length), sorted."""

    def __init__(self, at: str, shards: list[tuple]):
        self.at, self.shards = at, shards
        self.firsts = [[s[0], s[1]] for s in shards]

    def _open(self) -> None:
        self.store, self.root = fs.FileSystem.from_uri(self.at)
        self.files: dict = {}
        self.directory = self.block = (None, [], [])

    def range(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[file] = self.store.open_input_file(f"{self.root}/{file}")
        return self.files[file].read_at(length, offset)

    def captures(self, key: str, page: int | None) -> Iterator[list]:
        """Entries of a key and id; equal ones can go on in the next block or shard."""
        want = _order(key, page)
        s = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while s < len(self.shards) and self.firsts[s] <= want:
            if self.directory[0] != s:
                rows = json.loads(zlib.decompress(self.range(*self.shards[s][2:])))
                self.directory = (s, [r[0] for r in rows], rows)
            _, firsts, rows = self.directory
            b = max(0, bisect.bisect_left(firsts, want) - 1)
            while b < len(rows) and firsts[b] <= want:
                if self.block[0] != (s, b):
                    entries = [json.loads(x) for x in zlib.decompress(self.range(self.shards[s][2], *rows[b][1:])).decode().split("\n")]
                    self.block = ((s, b), [e[:2] for e in entries], entries)
                _, keys, entries = self.block
                i = bisect.bisect_left(keys, want)
                while i < len(keys) and keys[i] == want:
                    yield entries[i]
                    i += 1
                b += 1
            s += 1

    def records(self, key: str, page: int | None) -> Iterator[dict]:
        for _, _, file, offset, length in self.captures(key, page):
            yield parse(gzip.decompress(self.range(file, offset, length)))

    def reader(self):
        """For mapInArrow over (url, id): the records of every key, as rows of READ."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            self._open()
            for big in batches:
                for i in range(0, big.num_rows, 500):
                    b, out = big.slice(i, 500), []
                    for key, page in zip(*(b.column(j).to_pylist() for j in range(2)), strict=True):
                        for r in self.records(key, page):
                            out.append((_page(r["warc-record-id"]), r["payload-length"], r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"], _page(r["warc-refers-to"]) if "warc-refers-to" in r else None))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        return run


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def keys_of(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(key, id) of pages; the key is made where the archive's is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string()), b.column(1)], ["key", "id"])

    return pages.select(F.col(f"`{url_col}`"), F.col(f"`{id_col}`").cast("long")).mapInArrow(run, "key string, id long")


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z", block: int = BLOCK) -> Archive:
    """Archives of pages, with their index. least: payloads of fewer bytes are never revisits."""
    spark = pages.sparkSession
    at = C.shared_dir(spark)
    store, root = fs.FileSystem.from_uri(at)
    store.create_dir(root, recursive=True)
    pages = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    bytes_ = F.coalesce("html", F.lit("")).cast("binary")
    marked = pages.withColumn("sha", F.unhex(F.sha1(bytes_)))
    # a table of the payloads that occur more than once: where it is small the plan broadcasts it, and no html moves
    repeated = C.written(marked.where(F.octet_length(bytes_) >= least).groupBy("sha").agg(F.min(F.coalesce("id", F.lit(_NONE))).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("s"), "first"))
    rows = marked.join(repeated, F.col("sha") == F.col("s"), "left").select("id", "url", "html", F.when(F.coalesce("id", F.lit(_NONE)) != F.col("first"), F.col("first")).alias("first"))
    captures = C.written(rows.mapInArrow(_write(at, date), _CAPTURE))
    n = C.parts(captures, 4)
    shards = captures.repartitionByRange(n, "key", F.col("id").asc_nulls_last()).sortWithinPartitions("key", F.col("id").asc_nulls_last()).mapInArrow(_shard(at, block), _CAPTURE)
    # a row for each partition
    found = sorted(tuple(r) for r in C.written(shards).collect())
    return Archive(at, found)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's records of all pages, written to archives and read back through the index."""
    pages = C.table(spark, sf_dir, "pages")
    archive = write_archive(pages)
    keys = keys_of(pages, "page_id", "url").distinct()
    return keys.repartitionByRange(C.parts(pages), "key", "id").sortWithinPartitions("key", "id").mapInArrow(archive.reader(), READ)


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, unhex(sha1(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first, list_transform(range(0, 32), lambda i: (
  (get_bit(h::BIT, (5 * i)::INT) * 16 + get_bit(h::BIT, (5 * i + 1)::INT) * 8 + get_bit(h::BIT, (5 * i + 2)::INT) * 4 + get_bit(h::BIT, (5 * i + 3)::INT) * 2 + get_bit(h::BIT, (5 * i + 4)::INT)))) AS d FROM p)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, list_reduce(list_transform(d, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x + 1)::INT, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
