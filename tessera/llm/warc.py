"""WARC archives over a chunked record table.

A record is rows of (record identifier, chunk number, bytes, digest so far). Both ways the table is made by a stream: a
payload is cut, and an archive read, chunk by chunk, with an incremental digest, and the writer puts chunks into a
gzip member for each record and checks that their last digest is the payload's. Nothing holds a record beyond the cell
that it came in.

Payloads that occur again (same bytes, at least ``MIN_REVISIT`` of them) are written once: the smallest page_id is
the response and the others are revisit records that name it. Copies are found from digests with map-side combining;
up to ``FEW_GROUPS`` groups of copies are broadcast, so that payloads stay where they are read, and more of them are a
written table, so that a join can split a large one.

A writing task writes below a name of its own attempt in the shared folder; only names that successful tasks
returned are in the manifest.

Defined results: null html is an empty payload; empty payloads are responses. Rows that repeat a page_id are each a
record with an identifier of its own, and all of the smallest page_id are responses; a revisit names the page, as
Refers-To-Page. A null url is written as an empty target. Line breaks in urls are percent-encoded. An empty table gives
an empty manifest. Other columns of the input are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.exact import FEW_GROUPS
from tessera.llm.tokens import shipped, slices
from tessera.llm.work import file_system, shared_folder, written

MIN_REVISIT = 100
CHUNK_BYTES = 1 << 16
FILE_BYTES = 1 << 28
ID_PREFIX = "urn:tessera:record:"
CHUNKS = (
    "file string, record_no long, record_id string, page_id long, record_type string, refers_to long, header_bytes long, "
    "header_digest string, chunk_no int, data binary, digest string"
)


def typed_records(pages: DataFrame, payload: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to."""
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select("page_id", "url", body.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    copies = rows.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = written(copies.where("_n > 1").drop("_n"))
    joined = rows.join(F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups, "payload_digest", "left")
    again = F.col("page_id") != F.col("_first")
    return joined.select(
        "page_id", "url", F.when(again, None).otherwise(F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))


RECORD = "record_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, n_chunks int, chunk_no int, data binary, digest string"


def chunked(records: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table: one row for each chunk, in order, at least one for each record; ``digest`` covers the
    payload up to and with the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = [c.split()[0] for c in RECORD.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        task, number, rows, held = TaskContext.get().partitionId(), 0, [], 0
        for b in slices(batches, 64):
            fields = zip(*(b.column(c).to_pylist() for c in names[1:7]), b.column("payload"))
            for *about, cell in fields:
                payload = cell.as_buffer() or b""
                size = len(payload)
                digest, n = hashlib.sha256(), max(1, -(-size // chunk))
                for i in range(n):
                    data = bytes(payload[i * chunk : min(size, (i + 1) * chunk)])
                    digest.update(data)
                    rows.append((f"{task}-{number}", *about, n, i, data, digest.hexdigest()))
                    held += len(data)
                    if held >= 1 << 22 or len(rows) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                number += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    wanted = shipped(records).select(F.col("page_id").cast("long").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "payload")
    return wanted.mapInArrow(run, RECORD)


def head(row: dict) -> bytes:
    target = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    length = row["payload_bytes"] if row["record_type"] == "response" else 0
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{ID_PREFIX}{row['record_id']}>",
        f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"Page: {'' if row['page_id'] is None else row['page_id']}", f"Payload-Length: {row['payload_bytes']}", "Content-Type: application/http-payload",
        f"Content-Length: {length}",
    ]
    if row["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page: {row['refers_to']}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write(chunks: DataFrame) -> DataFrame:
    """Archive files from a chunked record table; returns the manifest: file, n_records."""
    folder = shared_folder(shipped(chunks).sparkSession)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = file_system(folder)
        done, out, name, size, records, member = [], None, "", 0, 0, None
        for b in slices(batches, 64):
            for row in b.to_pylist():
                if row["chunk_no"] == 0:
                    if out is not None and size >= FILE_BYTES:
                        out.close()
                        done.append((name, records))
                        out = None
                    if out is None:
                        name, size, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        fs.create_dir(place, recursive=True)
                        out = fs.open_output_stream(f"{place}/{name.rpartition('/')[2]}", compression=None)
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    size += out.write(member.compress(head(row))) or 0
                data = member.compress(row["data"])
                if row["chunk_no"] == row["n_chunks"] - 1:
                    if row["record_type"] == "response" and row["digest"] != row["payload_digest"]:
                        raise ValueError("the chunks of a record do not make up its payload")
                    data += member.compress(b"\r\n\r\n") + member.flush()
                    records += 1
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            done.append((name, records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["file", "n_records"])

    return written(chunks.mapInArrow(save, "file string, n_records long"))


def read(manifest: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of all records, in order within a record; ``digest`` covers the payload up to and with the chunk."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string()]
        for b in batches:
            for file in b.column("file").to_pylist():
                fs, place = file_system(file)
                rows, held = [], 0
                with fs.open_input_stream(place, compression=None) as raw, gzip.GzipFile(fileobj=raw) as source:
                    number = 0
                    while first := source.readline():
                        if not first.startswith(b"WARC/"):
                            raise ValueError(f"not a record in {file}")
                        fields = {}
                        while (line := source.readline().rstrip(b"\r\n")):
                            key, _, value = line.decode().partition(": ")
                            fields[key.lower()] = value
                        own, other = fields["page"], fields.get("refers-to-page", "")
                        left, part, digest = int(fields["content-length"]), 0, hashlib.sha256()
                        while part == 0 or left:
                            data = source.read(min(chunk, left))
                            digest.update(data)
                            left -= len(data)
                            rows.append((file, number, fields["warc-record-id"].strip("<>"), int(own) if own else None, fields["warc-type"], int(other) if other else None,
                                         int(fields["payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:"), part, data, digest.hexdigest()))
                            part, held = part + 1, held + len(data)
                            if held >= 1 << 22 or len(rows) >= 512:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                                rows, held = [], 0
                        source.read(4)
                        number += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that small listings are not merged
    return shipped(manifest).select("file").repartition(tasks, "file").mapInArrow(load, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row a record, from its chunk rows; a revisit has its payload's size and digest from its header."""
    whole = chunks.groupBy("file", "record_no").agg(
        F.first("page_id").alias("page_id"), F.first("record_type").alias("record_type"), F.first("refers_to").alias("refers_to"),
        F.first("header_bytes").alias("_hb"), F.first("header_digest").alias("_hd"),
        F.sum(F.octet_length("data")).cast("long").alias("_b"), F.max_by("digest", "chunk_no").alias("_d"))
    back = F.col("record_type") == "revisit"
    return whole.select(
        "page_id", F.when(back, F.col("_hb")).otherwise(F.col("_b")).alias("payload_bytes"),
        F.when(back, F.col("_hd")).otherwise(F.col("_d")).alias("payload_digest"), "record_type", "refers_to")
