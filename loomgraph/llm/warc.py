"""WARC archives: written one gzip member per record, read back by a splittable reader.

A reading task owns a byte range of a file. It looks for gzip magic, accepts a candidate only if the
member decodes to a WARC header with a matching block length and is followed by another magic or the
end of the file, and owns the records that start in its range, wherever they end.

Null html is an empty payload, null urls are empty. Records with equal payloads of ``least`` bytes or
more revisit the one with the smallest page id; rows that repeat that id are all responses, as are
groups without any id. Columns besides page_id, url, html are not read. Files go to the cluster's
shared folder through its ``file:`` (or another scheme that Arrow opens) path; a retried task replaces its own file.
"""
from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, shared_dir, store, text_of

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
TASKS = 20_000   # reading tasks at most; a task takes its ranges one after the other
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"


def open_fs(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return arrow_fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str, payload: bytes, digest: str, first: int | None) -> bytes:
    """One gzip member; a revisit (``first`` given) leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if first is not None else http + payload
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if first is not None:
        head += [f"WARC-Refers-To: <{ID}{first}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", mtime=0)


def write_archives(pages: DataFrame, least: int = 100) -> str:
    """Write one archive per task; returns their folder."""
    columns_of(pages, ["page_id", "url", "html"])
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        F.encode(text_of("html"), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = (rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first")).filter("first is not null"))
    folder = shared_dir(pages.sparkSession)
    files, top = open_fs(folder)
    files.create_dir(top, recursive=True)   # there even if no task has a row

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = open_fs(folder)
        name = f"{top}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        n = 0
        with files.open_output_stream(own := f"{top}/.{uuid.uuid4().hex}") as out:
            for batch in batches:
                for page_id, url, payload, digest, lead in zip(*(batch.column(i) for i in range(5))):
                    lead = lead.as_py()
                    out.write(record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), lead))
                    n += 1
        if n:
            files.move(own, name)
        else:
            files.delete_file(own)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["path", "records"])

    lead = F.expr("if(first <=> page_id, null, first)")
    store(rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", lead.alias("lead")).mapInArrow(write, "path string, records bigint"))
    return folder


class Source:
    """A file read by position through blocks."""

    def __init__(self, path: str):
        files, name = open_fs(path)
        self.file = files.open_input_file(name)
        self.size, self.at, self.block = self.file.size(), 0, b""

    def read(self, start: int, n: int) -> bytes:
        if not (self.at <= start and start + n <= self.at + len(self.block)):
            self.file.seek(start)
            self.at, self.block = start, self.file.read(max(n, BLOCK))
        return self.block[start - self.at:start - self.at + n]

    def find(self, start: int, stop: int) -> int:
        """Position of the first magic that begins in [start, stop), or -1."""
        while start < stop:
            part = self.read(start, min(BLOCK, stop - start + len(MAGIC) - 1))
            at = part.find(MAGIC)
            if at >= 0:
                return start + at
            if len(part) < len(MAGIC):
                return -1
            start += len(part) - len(MAGIC) + 1
        return -1


def member(source: Source, start: int) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, block, end) of the record that starts here, or None if none does."""
    unzip, out, at = zlib.decompressobj(31), [], start
    try:
        got = unzip.decompress(source.read(start, 512), 16)
        if not got.startswith(b"WARC/1."[:len(got)]) or not got:
            return None
        out.append(got)
        tail = unzip.unconsumed_tail
        at = start + 512
        while not unzip.eof:
            part = tail or source.read(at, 1 << 16)
            if not tail:
                at += len(part)
            if not part:
                return None
            out.append(unzip.decompress(part))
            tail = unzip.unconsumed_tail
    except zlib.error:
        return None
    end = min(at, source.size) - len(unzip.unused_data)
    head, found, rest = b"".join(out).partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        return None
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    size = fields.get("Content-Length", "")
    if not size.isdigit() or len(rest) != int(size) + 4 or source.read(end, 3) not in (MAGIC, b""):
        return None
    return fields, rest[:-4], end


def read_archives(spark: SparkSession, folder: str, split: int = 4 << 20) -> DataFrame:
    """(page_id, record_type, refers_to, digest, payload) of all records; revisits have no payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    ranges = files.filter("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split).cast("bigint"))).alias("start"))
    n = files.agg(F.sum(F.ceil(F.col("length") / split))).first()[0] or 1
    ranges = ranges.repartition(min(int(n), TASKS), F.col("path"), F.col("start"))   # a number, or adaptive execution merges these small rows

    def number(name: str | None) -> int | None:
        return int(name.strip("<>")[len(ID):]) if name and name.strip("<>")[len(ID):] else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()))],
                                              ["page_id", "record_type", "refers_to", "digest", "payload"])
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source, rows, held = Source(path), [], 0
                at, stop = start, min(start + split, source.size)
                while (at := source.find(at, stop)) >= 0:
                    found = member(source, at)
                    if found is None:
                        at += 1
                        continue
                    fields, block, at = found
                    kind = fields.get("WARC-Type")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    rows.append((number(fields.get("WARC-Record-ID")), kind, number(fields.get("WARC-Refers-To")),
                                 fields.get("WARC-Payload-Digest", "").rpartition(":")[2], payload))
                    held += len(block)
                    if held > BLOCK * 8:
                        yield told(rows)
                        rows, held = [], 0
                if rows:
                    yield told(rows)

    return ranges.mapInArrow(read, "page_id bigint, record_type string, refers_to bigint, digest string, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits take both from the response they name."""
    own = store(records.select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("bigint").alias("n"), F.sha2("payload", 256).alias("d")))
    answers = own.filter("record_type = 'response'")
    base = answers.filter("digest = d").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("n").alias("n"), F.max("d").alias("d"))
    names = ["page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to"]
    return answers.select(*names).union(
        own.filter("record_type <> 'response'").drop("n", "d").join(base, ["refers_to", "digest"], "left").select(*names))
