"""WARC archives with a two-level capture index.

Records are gzip members of archive files, one file a task. The index has a line for each record, sorted by the URL with
its host reversed; lines go into compressed blocks, and each index file ends with its sparse directory, which has each block's first and
last key and place. What the driver holds is a row for each index file, of which there are as many as partitions of the sort.

Look-ups run on the executors: a key is sought by halving among the index files, then in the directory of the file (read once for
all keys that follow), and gives the blocks that may hold it; blocks are dealt over tasks, read by range and searched by halving for
the keys asked for; the lines found lead to range reads of the records. A key with very many captures spans many blocks, which
are read by as many tasks.
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

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import small_batches
from .runs import split_join
from .store import new_path, saved
from .token_files import as_uri, open_fs

LINES = 512
#: Payload bytes (compressed) that a task reads, and rows of repeated pages that may go to all executors (some 60 bytes each).
TASK_BYTES, BROADCAST_ROWS = 32 << 20, 200_000
ENTRY = "key string, page_id long, file string, offset long, length long"


def reversed_key(url: str | None) -> str:
    """``http://a.example.org/x?y`` as ``org,example,a)/x?y``; null is empty."""
    rest = (url or "").partition("://")[2] or (url or "")
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str) -> str:
    """Control characters would end a header, so they are escaped."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def _record(fields: list[str], body: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *fields, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def info(name: str, date: str) -> bytes:
    """The record that says what the file is."""
    fields = ["WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, name)}", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _record(fields, b"format: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response, or a revisit of the response that has this payload and the page id ``refers_to``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    revisit, digest = refers_to is not None, base32_sha1(payload)
    fields = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
              "Content-Type: application/http; msgtype=response", f"X-Payload-Length: {len(payload)}"]
    fields += [f"WARC-Target-URI: {_header(url)}"] if url is not None else []
    fields += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    if revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return _record(fields, http if revisit else http + payload)


def parse(raw: bytes) -> dict:
    """A record's fields; a response's payload is held against its length and digest."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    digest, n = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response" and (len(payload) != n or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload_bytes": n, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"), "payload": payload}


def write_archives(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record a row of ``pages`` (page_id, url, html); returns index lines (key, page_id, file, offset, length).

    Of records with equal payloads of at least ``min_bytes``, that with the largest page_id is a response and the others
    revisit it; without any page_id all are responses. Payloads are equal if their SHA-256 digests are. Digests are counted on the map
    side and hot ones answered by broadcast; the ids of repeated pages go to all executors while they are few, else pages are
    shuffled to meet them. ``date`` stands in every record, as pages have none.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha2(html, 256).alias("sha"))
    sums = saved(pages.select("page_id", "sha", F.octet_length("html").alias("size")), "page-digests")
    latest = sums.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1")
    repeats = split_join(sums, latest, "sha", "n", sums.count()).where("latest is not null and not page_id <=> latest").select("page_id", "sha", "latest").distinct()
    repeats = saved(repeats.select(F.col("page_id").alias("r_id"), F.col("sha").alias("r_sha"), "latest"), "page-repeats")
    repeats = F.broadcast(repeats) if repeats.count() <= BROADCAST_ROWS else repeats
    rows = pages.join(repeats, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha")), "left").select("page_id", "url", "html", "latest")
    to = as_uri(new_path(spark, "archives"))
    open_fs(to)[0].create_dir(open_fs(to)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_fs(to)
        name, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        with system.open_output_stream(name, compression=None) as out:
            for b in batches:
                lines = []
                if not at:
                    at = out.write(gzip.compress(info(name.rsplit("/", 1)[-1], date), 1, mtime=0))
                for page_id, url, text, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    member = gzip.compress(record(page_id, url, text.encode(), refers_to, date), 1, mtime=0)
                    out.write(member)
                    lines.append({"key": reversed_key(url), "page_id": page_id, "file": name, "offset": at, "length": len(member)})
                    at += len(member)
                yield pa.RecordBatch.from_pylist(lines, pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    out = saved(rows.mapInArrow(run, ENTRY), "archive-lines")
    out.at = to
    return out


INDEX_FILE = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("n_blocks", pa.int64()), ("n_lines", pa.int64())])


def write_index(lines: DataFrame, at: str) -> DataFrame:
    """Index files under ``at``: blocks of sorted lines, then the directory of the blocks, then the directory's length in eight
    bytes. Returns (first_key, last_key, file, n_blocks, n_lines), a row a file."""
    small_batches(lines.sparkSession, 5000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_fs(at)
        name, place, held, blocks, n = f"{folder}/{uuid.uuid4().hex}.cdx.gz", 0, [], [], 0
        with system.open_output_stream(name, compression=None) as out:
            def flush() -> None:
                nonlocal place, held, n
                block = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
                out.write(block)
                blocks.append((held[0][0], held[-1][0], place, len(block)))
                place, n, held = place + len(block), n + len(held), []

            for b in batches:
                for line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    held.append(line)
                    if len(held) == LINES:
                        flush()
            if held:
                flush()
            directory = zlib.compress("\n".join(json.dumps(x) for x in blocks).encode(), 6)
            out.write(directory + len(directory).to_bytes(8, "big"))
        if blocks:
            yield pa.RecordBatch.from_pylist([{"first_key": blocks[0][0], "last_key": blocks[-1][1], "file": name, "n_blocks": len(blocks), "n_lines": n}], INDEX_FILE)

    ordered = lines.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return saved(ordered.mapInArrow(run, "first_key string, last_key string, file string, n_blocks long, n_lines long"), "index-files")


def _unpacked(data: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(data).split(b"\n")]


class Directory:
    """Searches by halving: first the files (sorted by key), then the blocks of a file, whose directory is read when it is needed."""

    def __init__(self, files: list[tuple[str, str, str]], at: str) -> None:
        self.files, self.system, self.name = files, open_fs(at)[0], None
        self.lasts = [f[1] for f in files]

    def _open(self, name: str) -> None:
        if name != self.name:
            with self.system.open_input_file(name) as f:
                size = f.size()
                n = int.from_bytes(f.read_at(8, size - 8), "big")
                self.name, self.blocks = name, _unpacked(f.read_at(n, size - 8 - n))
                self.ends = [b[1] for b in self.blocks]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of the blocks that may hold the key."""
        i = bisect.bisect_left(self.lasts, key)
        while i < len(self.files) and self.files[i][0] <= key:
            self._open(self.files[i][2])
            k = bisect.bisect_left(self.ends, key)
            while k < len(self.blocks) and self.blocks[k][0] <= key:
                yield self.name, self.blocks[k][2], self.blocks[k][3]
                k += 1
            i += 1


def find_lines(keys: DataFrame, index: DataFrame, at: str) -> DataFrame:
    """The index lines of the keys (key, no key twice), by the two levels of the index."""
    small_batches(keys.sparkSession, 5000)
    files = sorted((r.first_key, r.last_key, r.file) for r in index.select("first_key", "last_key", "file").collect())
    n_blocks = index.agg(F.sum("n_blocks")).first()[0] or 1

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = Directory(files, at)
        for b in batches:
            found = [(key, *place) for key in b.column(0).to_pylist() for place in directory.find(key)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "offset", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, now = open_fs(at)[0], None
        for b in batches:
            out = []
            for key, *place in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if place != now:
                    with system.open_input_file(place[0]) as f:
                        now, lines = place, _unpacked(f.read_at(place[2], place[1]))
                    names = [x[0] for x in lines]
                out += lines[bisect.bisect_left(names, key) : bisect.bisect_right(names, key)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "file", "offset", "length"])

    # Keys in the order of the index, so that a task looks at few directories.
    asked = keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(seek, "key string, file string, offset long, length long")
    n = max(keys.sparkSession.sparkContext.defaultParallelism, min(100_000, n_blocks // 64))
    return asked.repartition(n, "file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(read, ENTRY)


def read_records(lines: DataFrame, at: str, payload: bool = False) -> DataFrame:
    """The records of the lines (a saved table) by range reads, each file's in order, some ``TASK_BYTES`` a task."""
    fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payload else [])]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(fields, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, f, name = open_fs(at)[0], None, None
        for b in batches:
            out = []
            for file, offset, length in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if file != name:
                    f, name = system.open_input_file(file), file
                r = parse(gzip.decompress(f.read_at(length, offset)))
                out.append({k: r[k] for k in fields})
            yield pa.RecordBatch.from_pylist(out, schema)

    n = max(lines.sparkSession.sparkContext.defaultParallelism, (lines.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES)
    ordered = lines.select("file", "offset", "length").repartition(n, F.col("file"), F.floor(F.col("offset") / (1 << 20))).sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload)


def archive(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, DataFrame, str]:
    """Writes archives and index; returns (lines, index files, folder)."""
    lines = write_archives(pages, min_bytes)
    return lines, write_index(lines, lines.at), lines.at


def find_records(urls: DataFrame, index: DataFrame, at: str, payload: bool = False) -> DataFrame:
    """All records of the URLs (url)."""
    @F.pandas_udf("string")
    def key(column: pd.Series) -> pd.Series:
        return column.map(reversed_key)

    found = saved(find_lines(urls.select(key("url").alias("key")).distinct(), index, at), "found-lines")
    small_batches(urls.sparkSession, 500)
    return read_records(found, at, payload)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes archives and index of ``pages``, then asks the index for every URL captured and reads all records it finds.

    Columns page_id, url, payload_bytes, payload_digest, record_type, refers_to; a row for each row of ``pages``. Null html is
    an empty payload; null urls and ids stay null. Rows with one page_id and equal payloads are alike: if it is the largest id, all are
    responses. Other columns are ignored; an empty table gives an empty result.
    """
    lines, index, at = archive(pages, min_bytes)
    found = saved(find_lines(lines.select("key").distinct(), index, at), "found-lines")
    small_batches(pages.sparkSession, 500)
    return read_records(found, at)
