"""WARC archives with a two-level capture index.

Writing: each task writes one archive (one gzip member per record) into the shared folder and
returns a capture row per record: sort key, file, offset, length. Payloads that equal an
earlier one (smallest page_id) are written as revisit records.

Index: captures are sorted by reversed-host URL key over the cluster; each task writes its
range as gzip blocks of ``block_lines`` lines into one part file, and one directory row per
block (first key, last key, file, offset, length). Blocks hold enough lines that the directory
stays under ``DIRECTORY_ROWS`` rows at any corpus size, so each task may hold it.

Reading: for a key, a binary search in the directory gives its block or blocks; a range read
fetches a block, the lines of the key give file, offset and length, and a second range read
fetches the record. Look-ups are grouped by block, so that each block is read once.

Files get a name of their own per task attempt; only files of committed attempts are in the
captures, so a lost executor or a second attempt leaves nothing half-read.

Defined cases: a null html is an empty payload; a null or hostless URL has a key of its own
path; equal payloads without any page_id are all responses, as are rows that share the
smallest page_id; rows that repeat a page_id are records of their own.
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
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import as_uri, columns_of
from parcelwise.llm.neardup import in_groups
from parcelwise.sources.scratch import Scratch

BLOCK_LINES, DIRECTORY_ROWS, LEVEL = 1000, 50_000, 5
CAPTURE = "key string, page_id long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
BLOCK = "first string, last string, part string, at long, size long, lines long"


def surt(url: str | None) -> str:
    """Reversed-host sort key: ``com,example,www)/path?query`` (no scheme, port, fragment)."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return (url or "").strip()
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + path


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _uri(url: str | None) -> str:
    """A header value on one line: JSON where the plain URL would break it, empty for null."""
    if url is None:
        return ""
    return url if url.isprintable() and url[:1] not in ("", '"') else json.dumps(url)


def _from_uri(value: str) -> str | None:
    return None if value == "" else json.loads(value) if value[0] == '"' else value


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload, only its digest and length."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Target-URI: {_uri(url)}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
            f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
            "Content-Type: text/html; charset=utf-8"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                  for line in head.decode("utf-8").split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write every page; returns the captures (a written table, so the archives exist)."""
    scratch = Scratch(pages.sparkSession, "warc")
    pages, folder = columns_of(pages, "page_id", "url", "html"), as_uri(folder)
    body = F.coalesce("html", F.lit(""))
    signed = pages.withColumn("size", F.octet_length(body)).withColumn("digest", F.sha1(body.cast("binary")))
    groups = signed.where(F.col("size") >= min_bytes).groupBy("size", "digest").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
    groups = scratch.table(groups.drop("n"), "equal_payloads")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id"))
    linked = signed.join(groups, ["size", "digest"], "left").select("page_id", "url", "html", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        offset = 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                rows = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = (html or "").encode("utf-8")
                    data = gzip.compress(record(page_id, url, payload, refers_to), LEVEL, mtime=0)
                    out.write(data)
                    rows.append((surt(url), page_id, name, offset, len(data)))
                    offset += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (
                            pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                        names=["key", "page_id", "file", "offset", "length"])
    return scratch.table(linked.mapInArrow(run, CAPTURE), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the captures into compressed blocks in ``folder``; returns the block directory."""
    spark, folder = captures.sparkSession, as_uri(folder)
    scratch = Scratch(spark, "warc_index")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = max(block_lines, -(-captures.count() // DIRECTORY_ROWS))
    order = ["key", "file", "offset"]
    dealt = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"captures-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.gz"
        at, held = 0, []

        def block(rows: list[tuple]) -> tuple:
            data = gzip.compress("\n".join(map(json.dumps, rows)).encode("utf-8"), LEVEL, mtime=0)
            out.write(data)
            return rows[0][0], rows[-1][0], name, at, len(data), len(rows)
        made: list[tuple] = []
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                held += list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                while len(held) >= lines:
                    made.append(block(held[:lines]))
                    at += made[-1][4]
                    held = held[lines:]
            if held:
                made.append(block(held))
        if made:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*made, strict=True), (
                    pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["first", "last", "part", "at", "size", "lines"])
    return scratch.table(dealt.select("key", "page_id", "file", "offset", "length").mapInArrow(run, BLOCK), "directory")


def look_up(keys: DataFrame, directory: DataFrame, archives: str, index: str) -> DataFrame:
    """The records (``RECORD``) of all captures whose key is in ``keys`` (column ``key``).

    The directory has at most ``DIRECTORY_ROWS`` rows (see ``write_index``) plus one for each
    index part, so the driver may hold it and every task gets it."""
    spark = keys.sparkSession
    archives, index = as_uri(archives), as_uri(index)
    rows = sorted((r["first"], r["last"], r["part"], r["at"], r["size"]) for r in directory.collect())
    shared = spark.sparkContext.broadcast(rows)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        firsts, lasts = [b[0] for b in blocks], [b[1] for b in blocks]
        for batch in batches:
            task, wanted = [], []
            for key in batch.column(0).to_pylist():
                for no in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    task.append(no)
                    wanted.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(task, pa.int64()), pa.array(wanted, pa.string())],
                                             names=["task", "key"])
    spread = keys.select("key").distinct().mapInArrow(search, "task long, key string")

    def fetch(group: pa.Table) -> pa.RecordBatch | None:
        from pyarrow import fs
        _, _, part, at, size = shared.value[group.column(0)[0].as_py()]
        store, root = fs.FileSystem.from_uri(index)
        with store.open_input_file(f"{root}/{part}") as source:
            source.seek(at)
            lines = gzip.decompress(source.read(size)).decode("utf-8").split("\n")
        wanted = set(group.column(1).to_pylist())
        found = [x for x in map(json.loads, lines) if x[0] in wanted]
        found.sort(key=lambda x: (x[2], x[3]))
        store, root = fs.FileSystem.from_uri(archives)
        out, opened, source = [], None, None
        for _, _, file, offset, length in found:
            if file != opened:
                if source is not None:
                    source.close()
                source, opened = store.open_input_file(f"{root}/{file}"), file
            source.seek(offset)
            fields, payload = parse(zlib.decompress(source.read(length), wbits=31))
            revisit = fields["WARC-Type"] == "revisit"
            out.append((int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, _from_uri(fields["WARC-Target-URI"]),
                        fields["WARC-Type"], int(fields["X-Payload-Length"]) if revisit else len(payload),
                        fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else payload_digest(payload),
                        int(fields["X-Refers-To-Page-ID"]) if revisit else None))
        if source is not None:
            source.close()
        if not out:
            return None
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = [part.split()[0] for part in RECORD.split(", ")]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    return in_groups(spread, fetch, RECORD)


def write_and_read(pages: DataFrame, min_bytes: int = 0, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Archive all pages, index the captures, and read every record back by its key."""
    scratch = Scratch(pages.sparkSession, "warc_files")
    archives, index = f"{scratch.root}/archives", f"{scratch.root}/index"
    captures = write_archives(pages, archives, min_bytes)
    directory = write_index(captures, index, block_lines)
    return look_up(captures.select("key"), directory, archives, index)
