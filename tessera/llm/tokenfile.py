"""Token-id output by fixed-width bit packing.

A file holds ids in blocks of ``BLOCK`` ids, each id in the minimum number of bits for the vocabulary, little-endian.
Offsets of blocks and the documents' first ids are in the footer, so any range of ids can be read alone and unpacked
with numpy. Layout: MAGIC, blocks, then a footer: doc ids (int64), null flags (uint8), starts (int64, one more than
documents), block offsets (int64, one more than blocks), and at the very end five int64: bits, documents, ids,
blocks, footer offset, and MAGIC.

Documents go to files by ranges of doc_id, so files in name order and documents in file order ascend. A task writes
to a name of its own attempt; only names that successful tasks returned are in the manifest, so a lost or repeated
task leaves no trace in the result.

Defined results: null or empty text holds the end id alone; null doc_ids come first; rows that repeat a doc_id follow
one another; an empty table gives no files and no rows. Columns other than doc_id and the text are not read. Many rows
of one doc_id (or of none) share a file, however large; readers take it in parts of ``READ_IDS`` ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.tokens import shipped, slices
from tessera.llm.work import file_system, shared_folder, written

MAGIC = b"TESSTOK1"
BLOCK = 4096
END_ID = 2
#: Ids that a reader holds at once.
READ_IDS = 1 << 20
#: Characters of text to a file.
FILE_CHARS = 1 << 26


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = ((ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & 1).astype(np.uint8)
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    def __init__(self, out, vocab_size: int):
        self.out, self.bits = out, max(1, int(vocab_size - 1).bit_length())
        self.docs, self.starts, self.blocks, self.at, self.left = [], [0], [len(MAGIC)], len(MAGIC), np.empty(0, "<u4")
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.left = np.concatenate([self.left, ids])
        full = len(self.left) // BLOCK * BLOCK
        for i in range(0, full, BLOCK):
            self._block(self.left[i : i + BLOCK])
        self.left = self.left[full:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.out.write(data)
        self.at += len(data)
        self.blocks.append(self.at)

    def close(self) -> tuple[int, int]:
        if len(self.left):
            self._block(self.left)
        ids = np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array([d is None for d in self.docs], "u1").tobytes()
        tail = np.array([self.bits, len(self.docs), self.starts[-1], len(self.blocks) - 1, self.at], "<i8").tobytes()
        self.out.write(ids + np.array(self.starts, "<i8").tobytes() + np.array(self.blocks, "<i8").tobytes() + tail + MAGIC)
        self.out.close()
        return len(self.docs), self.starts[-1]


class Reader:
    """Random access: ``ids(a, b)`` reads only the blocks that hold ids a..b."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 48)
        tail = source.read(48)
        if tail[40:] != MAGIC:
            raise ValueError("not a token file")
        self.bits, n, self.n_ids, blocks, footer = (int(x) for x in np.frombuffer(tail[:40], "<i8"))
        source.seek(footer)
        data = source.read(size - 48 - footer)
        null = np.frombuffer(data, "u1", n, 8 * n).astype(bool)
        self.docs = [None if z else int(d) for d, z in zip(np.frombuffer(data, "<i8", n), null)]
        self.starts = np.frombuffer(data, "<i8", n + 1, 9 * n)
        self.blocks = np.frombuffer(data, "<i8", blocks + 1, 9 * n + 8 * (n + 1))

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.empty(0, "<u4")
        first, last = a // BLOCK, (b - 1) // BLOCK
        self.source.seek(int(self.blocks[first]))
        data = self.source.read(int(self.blocks[last + 1] - self.blocks[first]))
        held = min((last + 1) * BLOCK, self.n_ids) - first * BLOCK
        if self.bits in (8, 16, 32) or BLOCK * self.bits % 8 == 0:  # full blocks end on a byte
            return unpack_bits(data, self.bits, held)[a - first * BLOCK : b - first * BLOCK]
        raise ValueError("blocks must end on a byte")

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write(docs: DataFrame, path: str, end_id: int = END_ID, text: str = "text", files: int | None = None) -> DataFrame:
    """Encode, append ``end_id``, write; returns the manifest: file_no, file, n_docs, n_ids."""
    spark = shipped(docs).sparkSession
    if files is None:
        chars = docs.agg(F.coalesce(F.sum(F.length(F.col(f"`{text}`"))), F.lit(0))).first()[0]
        files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // FILE_CHARS))
    folder = shared_folder(spark)
    # borders of ranges: a fixed number of quantiles of doc_id, read without the text
    cuts = np.array(sorted(set(docs.select("doc_id").approxQuantile("doc_id", [i / files for i in range(1, files)], 0.2 / files) if files > 1 else [])))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with bpe.Codec.of(path).task() as codec:
            width, end = ("<u2" if codec.vocab_size <= 1 << 16 else "<u4"), bpe.as_bytes([end_id])
            for b in slices(batches):
                ids = [np.frombuffer(codec.encode(t) + end, "<u4").astype(width).tobytes() for t in b.column("body").to_pylist()]
                where = [0 if d is None else int(np.searchsorted(cuts, d, side="right")) for d in b.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(where, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "file_no", "ids"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab_size = max(bpe.Codec.of(path).vocab_size, end_id + 1)
        width = "<u2" if bpe.Codec.of(path).vocab_size <= 1 << 16 else "<u4"
        done, now, out, name = [], None, None, ""
        fs, place = file_system(folder)
        for b in slices(batches):
            for doc, number, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "file_no", "ids"))):
                if number != now:
                    if out:
                        done.append((now, name, *out.close()))
                    name, now = f"{folder}/part-{number:06d}-{uuid.uuid4().hex}.tok", number
                    fs.create_dir(place, recursive=True)
                    out = Writer(fs.open_output_stream(f"{place}/{name.rpartition('/')[2]}"), vocab_size)
                out.add(doc, np.frombuffer(ids, width).astype("<u4"))
        if out:
            done.append((now, name, *out.close()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["file_no", "file", "n_docs", "n_ids"])

    body = docs.select("doc_id", F.col(f"`{text}`").alias("body"))
    coded = body.mapInArrow(encode, "doc_id long, file_no int, ids binary").repartition("file_no").sortWithinPartitions("file_no", F.col("doc_id").asc_nulls_first())
    return written(coded.mapInArrow(save, "file_no long, file string, n_docs long, n_ids long"))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    # one row a file: a number fixed by the writer, whatever the input
    first = F.coalesce(F.sum("n_ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = manifest.select("file", first.alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                fs, place = file_system(row["file"])
                with fs.open_input_file(place) as source:
                    reader, i = Reader(source), 0
                    while i < len(reader.docs):
                        j = max(i + 1, int(np.searchsorted(reader.starts, reader.starts[i] + READ_IDS, side="right")) - 1)
                        j = min(j, len(reader.docs))
                        base = int(reader.starts[i])
                        ids = memoryview(reader.ids(base, int(reader.starts[j])).astype("<u4").tobytes())
                        starts = [int(x) for x in reader.starts[i : j + 1]]
                        crcs = [zlib.crc32(ids[4 * (x - base) : 4 * (y - base)]) for x, y in zip(starts, starts[1:])]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(reader.docs[i:j], pa.int64()), pa.array([row["first"] + x for x in starts[:-1]], pa.int64()),
                            pa.array([y - x for x, y in zip(starts, starts[1:])], pa.int64()), pa.array(crcs, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"])
                        i = j

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that small listings are not merged
    return listed.repartition(tasks, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
