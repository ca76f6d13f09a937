"""BPE encoding and decoding of document tables (see ``bpe`` for the method and the defined results).

Texts up to the leaf size are encoded where they are read. Longer texts become one row for each leaf, so that the
parts of one long text are encoded by many tasks; a document's encoded leaves (ids, no text) then meet and are joined
as a tree.

Defined results, beside those of ``bpe``: repeated rows are encoded one by one; an empty table gives no rows; columns
other than doc_id and the text are not read, so they may have any name.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm import bpe
from tessera.llm.work import ship

#: Rows that a worker turns into Python objects at once.
BATCH_ROWS = 512


def shipped(df: DataFrame) -> DataFrame:
    """``df``, in a session whose workers have this package."""
    ship(df.sparkSession)
    return df


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows. At the end the worker, which waits for other tasks, hands its free
    memory back."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    b = None
    tidy()


def tidy() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def encode(docs: DataFrame, path: str, text: str = "text", leaf: int = bpe.LEAF_CHARS) -> DataFrame:
    """(doc_id, ids): ids of the whole text as little-endian unsigned 32-bit integers, one row for each row."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = shipped(docs).select("doc_id", body.alias("body"))
    if bpe.marks_words(path):
        leaf = bpe.NO_LEAF

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with bpe.Codec.of(path).task() as codec:
            for b in slices(batches):
                ids = pa.array([codec.encode(t) for t in b.column("body").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            for row in b.to_pylist():
                parts = list(bpe.leaves(row["body"], leaf))
                for i in range(0, len(parts), BATCH_ROWS):
                    some = parts[i : i + BATCH_ROWS]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([row["doc_id"]] * len(some), pa.int64()), "uid": pa.array([row["uid"]] * len(some), pa.int64()),
                        "part": pa.array(range(i, i + len(some)), pa.int32()), "body": pa.array(some, pa.string())})

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with bpe.Codec.of(path).task() as codec:
            for b in slices(batches, 16):
                ids = pa.array([codec.encode(t) for t in b.column("body").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("uid"), b.column("part"), ids], ["doc_id", "uid", "part", "ids"])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        with bpe.Codec.of(path).task() as codec:
            ids = bpe.join_leaves(codec, [np.frombuffer(i, "<u4") for i in table["ids"].to_pylist()]).astype("<u4").tobytes()
        return pa.table({"doc_id": table["doc_id"].slice(0, 1), "ids": pa.array([ids], pa.binary())})

    short = rows.where(F.length("body") <= leaf).mapInArrow(whole, "doc_id long, ids binary")
    parts = (
        rows.where(F.length("body") > leaf).withColumn("uid", F.monotonically_increasing_id())
        .mapInArrow(cut, "doc_id long, uid long, part int, body string")
        .repartition("uid", "part").mapInArrow(encode_leaves, "doc_id long, uid long, part int, ids binary")
    )
    return short.unionByName(parts.groupBy("uid").applyInArrow(join, "doc_id long, ids binary"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` plus ``decoded``, the text of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.Codec.of(path)
        for b in slices(batches):
            texts = [codec.decode(np.frombuffer(i or b"", "<u4")) for i in b.column("ids").to_pylist()]
            yield b.append_column("decoded", pa.array(texts, pa.string()))

    kept = shipped(encoded).drop("decoded")
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("decoded", StringType())]))
