"""Packing by shortest-pack-first over the length histogram.

Documents are tokenised once and cut into pieces of at most ``capacity`` ids; the pieces (no text) are written as a
table. Only the histogram of piece lengths, at most ``capacity`` rows whatever the input, reaches the driver. There
lengths are placed longest first, each into the pack with the most room, by updating counts of packing patterns.
Patterns become ranges of ranks for each length; a piece finds its place from its length and its rank among the
pieces of that length. Ranks come from salted windows plus offsets, so one very common length spreads over tasks.
Pieces of full length, the bulk of long documents, are sequences by themselves and are not ranked.

Defined results: null or empty text is one piece that holds the end id. An empty table gives no pieces. Repeated
rows are packed one by one. Very long documents give many pieces. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm import bpe
from tessera.llm.tokens import shipped, slices
from tessera.llm.work import written

CAPACITY = 2048
END_ID = 1
#: Pieces of one length and salt that are ranked together.
SALT_PIECES = 1 << 9
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = bpe.as_bytes([end_id])
        with bpe.Codec.of(path).task() as codec:
            for b in slices(batches):
                out = []
                for doc, body in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist()):
                    ids = memoryview(codec.encode(body) + end)
                    n = len(ids) // 4
                    out += [(doc, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)]), n) for s in range(0, n, capacity)]
                if out:
                    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return shipped(docs).select("doc_id", F.col(f"`{text}`").alias("body")).mapInArrow(run, PIECES)


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """[(count, lengths of one pack)]: lengths longest first, each into the shortest pack (most room) that exists.

    For each length the loop opens or splits at most a few patterns, so the number of patterns is bounded by the
    number of lengths and not by the number of documents."""
    room: dict[int, dict[tuple[int, ...], int]] = {}  # room left -> pattern -> packs
    open_rooms: list[int] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            best = open_rooms[-1] if open_rooms and open_rooms[-1] >= length else None
            if best is None:
                fit = max(1, capacity // length)
                if left >= fit:
                    pattern, n = (length,) * fit, left // fit
                else:
                    pattern, n = (length,) * left, 1
                rest = capacity - length * len(pattern)
            else:
                old, packs = next(iter(room[best].items()))
                n = min(left, packs)
                if n == packs:
                    del room[best][old]
                    if not room[best]:
                        del room[best]
                        open_rooms.pop()
                else:
                    room[best][old] = packs - n
                pattern, rest = (*old, length), best - length
            left -= n * (len(pattern) if best is None else 1)
            if rest not in room:
                room[rest] = {}
                insort(open_rooms, rest)
            room[rest][pattern] = room[rest].get(pattern, 0) + n
    return [(n, pattern) for rest in sorted(room) for pattern, n in room[rest].items()]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first sequence id, offset) of each slot, by rank."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for n, pattern in patterns:
        offset = 0
        for length in pattern:
            slots.setdefault(length, []).append((taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + n
            offset += length
        sequence += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in slots.items()}


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``pieces`` plus rank, gapless from 0 among the pieces of one length. A length has a salt for each
    ``SALT_PIECES`` of its pieces, so a window's group is bounded and there are at most pieces / SALT_PIECES + capacity
    offsets."""
    spark = pieces.sparkSession
    salts = spark.createDataFrame([(k, -(-n // SALT_PIECES)) for k, n in histogram.items()], "length long, _salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.col("_salts"))).drop("_salts")  # at most `capacity` rows
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")
    offsets = counts.select("length", "_salt", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start")) - 1
    joined = salted.withColumn("_own", own).join(offsets, ["length", "_salt"])  # one row a (length, salt)
    return joined.withColumn("rank", F.col("_before") + F.col("_own")).drop("_salt", "_own", "_before")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table) plus sequence_id and offset. A piece of full length is a sequence by itself and
    needs no rank."""
    rows = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in rows if r["length"] < capacity}
    patterns = shortest_pack_first(histogram, capacity)
    where, sequences = places(patterns), sum(n for n, _ in patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                at = lengths == length
                first, base, off = where[int(length)]
                slot = np.searchsorted(first, ranks[at], side="right") - 1
                sequence[at], offset[at] = base[slot] + ranks[at] - first[slot], off[slot]
            cols = [b.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kept = pieces.columns
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.lit(sequences) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    if not histogram:
        return full
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked(pieces.where(F.col("length") < capacity), histogram).mapInArrow(run, schema).unionByName(full)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(written(cut_pieces(docs, path, capacity)), capacity)
