"""Scores of a set of queries against a whole memory, block by block: rows travel packed, so that a task scores a block of
queries against a block of memory in one matrix product or one pass over postings. A task holds the best of each query over
all blocks that it has seen, and hands on those only; what falls behind them is neither rounded nor sorted."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tessera.sources.shared import ship, written

#: Rows of a packed block of memory and of queries; packed blocks of queries that are broadcast together.
MEMORY_ROWS, QUERY_ROWS, TOGETHER = 2048, 2048, 16
#: Values of arrays in a packed block, and blocks that are cut from rows at once.
BLOCK_VALUES, AT_ONCE = 1 << 19, 4
#: Pairs of packed blocks that a worker is handed at once, and queries of a block that are scored at once.
PAIRS, SCORED = 32, 512
#: How far scores that are equal after rounding may lie apart, with room.
NEAR = 1e-11
#: Digits of a cosine in which equal ones agree, however the sums were taken.
TIE_DIGITS = 12
#: A gram of one memory in so many is frequent. Grams that have a bit, and memories whose presence is held as a matrix at once.
OFTEN, WIDE, TALL = 12, 1 << 12, 512
#: Counts of other grams that are held at once.
HELD = 1 << 22
#: Queries in the sample that the bits are chosen by, about; kinds of texts; coded rows travel in blocks so many times as long, so
#: many pairs of blocks at once.
SAMPLE, KINDS, CODED, CODED_PAIRS = 1024, 8, 4, 4
#: Room for rounding in bounds. One pair in so many left is more than few.
ROOM, FEW = 1e-5, 16


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined up to ``rows`` rows or ``AT_ONCE`` times ``BLOCK_VALUES`` values, so that the size of a block does not
    depend on that of a batch."""
    held, n, values = [], 0, 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        values += b.nbytes // 8
        if n >= rows or values >= AT_ONCE * BLOCK_VALUES:
            yield pa.concat_batches(held)
            held, n, values = [], 0, 0
    if n:
        yield pa.concat_batches(held)


def packed(rows: DataFrame, size: int, sort: str | list[tuple[str, str]], at_once: int = AT_ONCE) -> DataFrame:
    """Rows as arrays, in blocks of at most ``size`` rows and about ``BLOCK_VALUES`` values of an array column; so many blocks are sorted
    and cut together."""
    ship(rows.sparkSession)
    schema = StructType([StructField(f.name, ArrayType(f.dataType)) for f in rows.schema.fields])
    listed = [f.name for f in rows.schema.fields if isinstance(f.dataType, ArrayType)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, at_once * size):
            b = b.sort_by(sort)
            values = np.cumsum(sum(np.nan_to_num(b.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(float)) for c in listed)) // BLOCK_VALUES
            cuts = np.flatnonzero((np.diff(np.arange(b.num_rows) // size) != 0) | (np.diff(values) != 0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, b.num_rows]):
                some = b.slice(begin, end - begin)
                cells = [pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), pa.concat_arrays([c])) for c in some.columns]
                yield pa.RecordBatch.from_arrays(cells, some.schema.names)

    return rows.mapInArrow(run, schema)


def pairs(queries: DataFrame, memory: DataFrame, sort: tuple[str, str], rows: int) -> list[DataFrame]:
    """Packed memory beside packed blocks of at most ``rows`` queries, some blocks at a time: as many plans as there are broadcasts.
    Blocks of memory are dealt to all cores, as a file of vectors has few splits."""
    n = queries.count()
    parts = max(1, -(-n // (QUERY_ROWS * TOGETHER)))
    held = packed(memory, MEMORY_ROWS, sort[1]).repartition(2 * memory.sparkSession.sparkContext.defaultParallelism)
    of = lambda i: queries.where(F.pmod(F.xxhash64(sort[0]), F.lit(parts)) == i) if parts > 1 else queries
    blocks = [packed(of(i).coalesce(max(1, min(8, n // parts // rows))), rows, sort[0]) for i in range(parts)]
    return [held.crossJoin(F.broadcast(b)) for b in blocks]  # QUERY_ROWS * TOGETHER queries and a few more at most


def best(score: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best columns of each row among those that fit; equal scores go by column."""
    masked = np.where(fits, score, -np.inf)
    if masked.shape[1] > k:
        fits = fits & (masked >= np.partition(masked, -k, axis=1)[:, -k, None])
    r, c = np.nonzero(fits)
    order = np.lexsort((c, -masked[r, c], r))
    r, c = r[order], c[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[first], c[first]


class Leaders:
    """The best ``k`` of each query of a block over blocks of memory, in the order of rounded score and id."""

    def __init__(self, asks: pa.Array, k: int, least: float = -np.inf):
        self.asks, self.k, self.floor = asks, k, np.full(len(asks), least)
        self.rows = None

    def wanted(self, first: int, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of scores that may be among the best, for queries from ``first`` on; -inf is no score."""
        floor = self.floor[first : first + len(score)].copy()
        fresh = np.flatnonzero(np.isneginf(floor))
        if len(fresh) and score.shape[1] > self.k:
            floor[fresh] = np.partition(score[fresh], -self.k, axis=1)[:, -self.k]
        return np.divmod(np.flatnonzero(score >= np.maximum(floor - NEAR, np.finfo(float).min)[:, None]), score.shape[1])

    def take(self, row: np.ndarray, score: np.ndarray, digits: int | None, ids: pa.Array, *more: pa.Array) -> None:
        if not len(row):
            return
        cells, others = [pa.array(row), pa.array(score + 0.0), ids, *more], None
        if self.rows is not None:  # only queries with a new row are sorted again
            fresh = np.zeros(len(self.asks), bool)
            fresh[row] = True
            fresh = fresh[self.rows[0].to_numpy()]
            others = [c.filter(pa.array(~fresh)) for c in self.rows]
            cells = [pa.concat_arrays([a.filter(pa.array(fresh)), b]) for a, b in zip(self.rows, cells)]
        row, score, names = (c.to_numpy(zero_copy_only=False) for c in cells[:3])
        score = score if digits is None else score.round(digits)
        names = np.unique(names, return_inverse=True)[1] if names.dtype == object else names
        order = np.lexsort((names, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = order[place < self.k]
        last = order[place == self.k - 1]
        self.floor[cells[0].to_numpy()[last]] = score[last]
        self.rows = [c.take(pa.array(keep)) for c in cells]
        if others is not None:
            self.rows = [pa.concat_arrays([a, b]) for a, b in zip(others, self.rows)]

    def out(self) -> list[pa.Array]:
        row, score, *others = self.rows
        return [self.asks.take(row), score, *others]


def leaders(all_of: dict, asks: pa.Array, k: int, least: float = -np.inf) -> Leaders:
    """Of a block of queries, known by its ids."""
    key = tuple(asks.to_pylist())
    if key not in all_of:
        all_of[key] = Leaders(asks, k, least)
    return all_of[key]


def unpacked(row: pa.RecordBatch, name: str) -> pa.Array:
    return row.column(name).flatten()


def matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of unit length, sizes); no vector, or one without a direction, is a row of zeros."""
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    out = np.zeros((len(sizes), max(1, sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(float))
    length = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0), sizes


def different(a: pa.Array, b: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)[:, None] != b.to_numpy(zero_copy_only=False)[None, :]


def joined_type(queries: DataFrame, memory: DataFrame, *more: StructField) -> StructType:
    return StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("id", memory.schema["id"].dataType), *more])


def cosines(queries: DataFrame, memory: DataFrame, k: int, same_kind: bool) -> DataFrame:
    """(query_id, id, kind, score): the k best of each task's blocks of ``memory`` (id, kind, v) for each of ``queries`` (query_id, q and,
    for ``same_kind``, query_kind), other rows than the query's id only. Unlike lengths and missing vectors score 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, Leaders] = {}
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                (q, q_size), (m, m_size) = matrix(unpacked(row, "q")), matrix(unpacked(row, "v"))
                asks, ids, kinds = unpacked(row, "query_id"), unpacked(row, "id"), unpacked(row, "kind")
                dim, mine = min(q.shape[1], m.shape[1]), leaders(seen, asks, k)
                alike = not len(q_size) or not len(m_size) or q_size.min() == q_size.max() == m_size.min() == m_size.max()
                own = pc.is_in(asks, ids).to_numpy(zero_copy_only=False)
                for first in range(0, len(asks), SCORED):
                    some = slice(first, first + SCORED)
                    score = q[some, :dim] @ m[:, :dim].T
                    if not alike:
                        score[q_size[some, None] != m_size] = 0.0
                    for r in np.flatnonzero(own[some]):
                        score[r, pc.equal(ids, asks[first + int(r)]).to_numpy(zero_copy_only=False)] = -np.inf
                    if same_kind:
                        score[different(unpacked(row, "query_kind")[some], kinds)] = -np.inf
                    r, c = mine.wanted(first, score)
                    at = pa.array(c)
                    mine.take(r + first, score[r, c], TIE_DIGITS, ids.take(at), kinds.take(at))
        for x in seen.values():
            if x.rows is not None:
                asked, score, ids, kinds = x.out()
                yield pa.RecordBatch.from_arrays([asked, ids, kinds, score], ["query_id", "id", "kind", "score"])

    out = joined_type(queries, memory, memory.schema["kind"], *StructType.fromDDL("score double").fields)
    return union([p.mapInArrow(run, out) for p in pairs(queries, memory, ("query_id", "id"), QUERY_ROWS)])


class Book(NamedTuple):
    """The grams whose presence is held as bits, sorted; a centre of each kind of text over those bits; the kind that has each most."""

    grams: np.ndarray
    centres: np.ndarray
    kind: np.ndarray

    def bits(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sizes, presence of the book's grams, the row of each other gram, the other grams)"""
        n = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        grams, who = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(n)), n)
        out = np.zeros((len(n), len(self.kind)), np.uint8)
        if not len(self.grams):
            return n, out, who, grams
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hit = self.grams[at] == grams
        out[who[hit], at[hit]] = 1
        return n, out, who[~hit], grams[~hit]


def book(lists: pa.Array) -> Book:
    """The most frequent grams of a sample and its kinds of texts. They only say in which order and how rows are counted: any book
    gives the same result."""
    grams, counts = np.unique(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    grams = np.sort(grams[np.argsort(-counts, kind="stable")[:WIDE]])
    width = max(64, -(-len(grams) // 64) * 64)
    held = Book(grams, np.zeros((width, KINDS), np.float32), np.zeros(width, np.int64)).bits(lists)[1].astype(np.float32)
    held /= np.maximum(np.sqrt(held.sum(1, keepdims=True)), 1)
    centres, rng = np.zeros((width, KINDS), np.float32), np.random.default_rng(1)
    for i in range(KINDS if len(held) else 0):  # each first centre is a row, far ones sooner
        far = np.maximum(1 - (held @ centres[:, :i]).max(1), 1e-9) if i else np.ones(len(held))
        centres[:, i] = held[rng.choice(len(held), p=far / far.sum())]
    for _ in range(8 if len(held) else 0):
        of = np.eye(KINDS, dtype=np.float32)[(held @ centres).argmax(1)]
        centres = held.T @ of
        centres /= np.maximum(np.sqrt((centres**2).sum(0)), 1e-9)
    return Book(grams, centres, centres.argmax(1))


def coded(rows: DataFrame, name: str, grams: str, held: Book, prefix: str = "") -> DataFrame:
    """Rows (id, grams) as (id, kind of text, size, bits of the book's grams, how many of each kind, the other grams)."""
    ship(rows.sparkSession)
    names = [name, *(prefix + c for c in ("kind", "n", "bits", "groups", "rest"))]
    schema = StructType([rows.schema[name], *StructType.fromDDL(f"{names[1]} int, {names[2]} int, {names[3]} binary, {names[4]} binary, {names[5]} array<long>").fields])
    group = np.eye(KINDS, dtype=np.float32)[held.kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SCORED):
                some = b.slice(i, SCORED)
                n, bits, who, rest = held.bits(some.column(grams))
                present = bits.astype(np.float32)
                kind, counts = (present @ held.centres).argmax(1), (present @ group).astype(np.int32)
                ends = np.searchsorted(who, np.arange(len(n) + 1)).astype(np.int32)
                cells = [[r.tobytes() for r in x] for x in (np.packbits(bits, axis=1, bitorder="little"), counts)]
                columns = [some.column(name), pa.array(kind, pa.int32()), pa.array(n, pa.int32()), *(pa.array(c, pa.binary()) for c in cells), pa.ListArray.from_arrays(pa.array(ends), pa.array(rest))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select(name, grams).mapInArrow(run, schema)


class Coded:
    """A packed block of coded rows."""

    def __init__(self, row: pa.RecordBatch, name: str, prefix: str = ""):
        cell = lambda c: unpacked(row, prefix + c)
        self.ids, self.n = unpacked(row, name), cell("n").to_numpy().astype(np.int64)
        bits, groups = (b"".join(cell(c).to_pylist()) for c in ("bits", "groups"))
        self.bits = np.frombuffer(bits, np.uint8).reshape(len(self.n), -1)
        rest = cell("rest")
        length = rest.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.rest, self.ends = rest.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(length))
        self.groups = np.vstack([np.frombuffer(groups, np.int32).reshape(len(self.n), -1).T, length[None]])

    def tile(self, first: int, size: int) -> Tile:
        return Tile(self, slice(first, min(first + size, len(self.n))))


class Tile:
    """Some rows of a block, next to each other."""

    def __init__(self, block: Coded, at: slice):
        self.n, self.bits, self.groups = block.n[at], block.bits[at], block.groups[:, at]
        ends = block.ends[at.start : at.stop + 1]
        rest, who = block.rest[ends[0] : ends[-1]], np.repeat(np.arange(len(self.n)), np.diff(ends))
        order = np.argsort(rest, kind="stable")
        self.rest, self.who = rest[order], who[order]
        self.small = self.groups.astype(np.int16) if self.groups.max(initial=0) < 1 << 14 else None

    @cached_property
    def present(self) -> np.ndarray:
        """A row for each gram of the book."""
        return np.ascontiguousarray(np.unpackbits(self.bits, axis=1, bitorder="little").T)

    @cached_property
    def often(self) -> np.ndarray:
        """Grams that one row of ``OFTEN`` or more has."""
        return np.flatnonzero(self.present.sum(1, dtype=np.int64) * OFTEN >= len(self.n))

    @cached_property
    def dense(self) -> np.ndarray:
        return self.present[self.often].astype(np.float32)


def bounded(q: Tile, m: Tile, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """No more grams than this are common: of each group, no more than the one that has fewer."""
    a, b = (q.small, m.small) if q.small is not None and m.small is not None else (q.groups, m.groups)
    a, b = a[:, rows, None], b[:, None, columns]
    out = np.minimum(a[0], b[0])
    for i in range(1, len(a)):
        out += np.minimum(a[i], b[i])
    return out


def counted(q: Tile, m: Tile, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """How many grams each pair (r, c), in order, has in common."""
    a, b = q.bits.view(np.uint64), m.bits.view(np.uint64)
    out, step = np.zeros(len(r), np.int64), max(1, BLOCK_VALUES // a.shape[1])
    for i in range(0, len(r), step):
        some = slice(i, i + step)
        out[some] = np.bitwise_count(a[r[some]] & b[c[some]]).sum(1, dtype=np.int64)
    begin = np.searchsorted(q.rest, m.rest)
    n = np.searchsorted(q.rest, m.rest, "right") - begin
    met = np.flatnonzero((n > 0) & np.isin(m.who, c))
    begin, n, doc, asked = begin[met], n[met], m.who[met], r * len(m.n) + c
    for some in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // HELD)) + 1) if len(n) else []:
        k = n[some]
        at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[some], k)
        key = q.who[at] * len(m.n) + np.repeat(doc[some], k)
        place = np.minimum(np.searchsorted(asked, key), len(asked) - 1)
        out += np.bincount(place[asked[place] == key], minlength=len(out))
    return out


def share(floor: np.ndarray) -> np.ndarray:
    """Of both sizes, what must be common for a score of ``floor``; a little less, for rounding."""
    return floor / (1 + floor) * (1 - ROOM)


def need(floor: np.ndarray, nq: np.ndarray, nm: np.ndarray) -> np.ndarray:
    return share(floor).astype(np.float32)[:, None] * (nq.astype(np.float32)[:, None] + nm.astype(np.float32))


def fitting(q: Tile, m: Tile, rows: np.ndarray, columns: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Those of ``rows`` that may reach their floor with one of ``columns``, by sizes and by the most of each group."""
    nq, nm, f = q.n[rows], m.n[columns], floor[rows]
    most = np.minimum(m.groups[:, columns].max(1)[:, None], q.groups[:, rows]).sum(0)
    return rows[(nq >= f * nm.min() * (1 - ROOM)) & (nq * f * (1 - ROOM) <= nm.max()) & (most >= share(f) * (nq + nm.min()))]


def left_over(q: Tile, m: Tile, asked: np.ndarray, held: np.ndarray, frequent: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, memory) of pairs that are still to be counted after a bound by groups and one by a matrix product of the grams that are
    ``frequent``, as the queries have them."""
    low = np.full(len(m.n), floor[asked].min())
    held = fitting(m, q, held, asked, low)
    near = bounded(q, m, asked, held) >= need(floor[asked], q.n[asked], m.n[held])
    rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if len(rows) * len(columns) < near.size:
        near, asked, held = near[rows][:, columns], asked[rows], held[columns]
    if near.size:
        nq, nm = q.n[asked], m.n[held]
        a = frequent[:, asked[0] : asked[-1] + 1].take(asked - asked[0], axis=1).astype(np.float32)
        b = m.dense if len(held) == len(m.n) else m.dense.take(held, axis=1)
        common = a.T @ b
        left = np.minimum((nq - a.sum(0)).astype(np.float32)[:, None], (nm - b.sum(0)).astype(np.float32))
        left += common
        near &= left >= need(floor[asked], nq, nm)
        if len(held) > k and np.count_nonzero(near) * FEW > near.size:  # k memories have these scores or more
            least = common / (nq.astype(np.float32)[:, None] + nm.astype(np.float32) - common)
            raised = np.maximum(floor[asked], np.partition(least, -k, axis=1)[:, -k].astype(float) * (1 - ROOM))
            near &= left >= need(raised, nq, nm)
    r, c = np.nonzero(near)
    return asked[r], held[c]


def alike(q: Tile, m: Tile, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, memory, score) of pairs that reach the query's floor, and may be among the k best. Pairs leave as soon as a bound of
    what they have in common is too low, and what is left is counted."""
    asked, held = np.flatnonzero(q.n > 0), np.flatnonzero(m.n > 0)
    if len(asked) and len(held):
        asked = fitting(q, m, asked, held, floor)
    parts = [asked[i : i + SCORED] for i in range(0, len(asked) if len(held) else 0, SCORED)]
    frequent = q.present[m.often] if parts else None
    pairs_ = [left_over(q, m, some, held, frequent, floor, k) for some in parts]
    r, c = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in pairs_)]) for i in (0, 1))
    if not len(r):
        return r, c, np.zeros(0)
    both = counted(q, m, r, c)
    score = both / np.maximum(q.n[r] + m.n[c] - both, 1)
    keep = (both > 0) & (score >= floor[r])
    return r[keep], c[keep], score[keep]


def jaccards(queries: DataFrame, memory: DataFrame, k: int, threshold: float) -> DataFrame:
    """(query_id, id, score): the k best of each task's blocks of ``memory`` (id, grams) for each of ``queries`` (query_id, asked), by the
    share of their distinct 64-bit grams that is common, ``threshold`` at least. Rows travel as bits, rows of like texts and sizes
    beside each other; a bounded sample of the queries says which grams have a bit."""
    asked, spark = written(queries, SCORED), queries.sparkSession
    n = asked.count()
    parts = max(1, -(-n // (QUERY_ROWS * TOGETHER)))
    some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, n // SAMPLE))) == 0).select(F.slice("asked", 1, WIDE).alias("asked")).limit(2 * SAMPLE)
    held = book(some.toArrow().column("asked").combine_chunks())
    of = lambda i: asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) if parts > 1 else asked
    lay = lambda rows, size, p, at_once: written(packed(rows, CODED * size, [(p + "kind", "ascending"), (p + "n", "ascending")], at_once), SCORED)
    kept = lay(coded(memory, "id", "grams", held).repartition(2 * spark.sparkContext.defaultParallelism), MEMORY_ROWS, "", 1)  # all kinds in each block: the first one sets a floor for all queries
    blocks = [lay(coded(of(i), "query_id", "asked", held, "q_").repartition(1), QUERY_ROWS, "q_", AT_ONCE) for i in range(parts)]  # bounded, see parts
    columns = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, Leaders] = {}
        last = None
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                if last is None or not row.select(columns).equals(last):  # a block of memory comes with one of queries after the other
                    last = row.select(columns)
                    block = Coded(row, "id")
                    tiles = [(first, block.tile(first, TALL)) for first in range(0, len(block.n), TALL)]
                asks = Coded(row, "query_id", "q_")
                mine, q = leaders(seen, asks.ids, k, threshold), asks.tile(0, len(asks.n))
                for begin, m in tiles:
                    r, c, score = alike(q, m, mine.floor, k)
                    mine.take(r, score, None, block.ids.take(pa.array(c + begin)))
        for x in seen.values():
            if x.rows is not None:
                asks, score, ids = x.out()
                yield pa.RecordBatch.from_arrays([asks, ids, score], ["query_id", "id", "score"])

    out = joined_type(queries, memory, *StructType.fromDDL("score double").fields)
    return union([kept.crossJoin(F.broadcast(b)).mapInArrow(run, out) for b in blocks])


_WORD_CHARACTERS: list[np.ndarray] = []


def word_characters() -> np.ndarray:
    """Whether each code point is a letter or a number of any language."""
    if not _WORD_CHARACTERS:
        _WORD_CHARACTERS.append(np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)]))
    return _WORD_CHARACTERS[0]


def trigrams(text: str | None) -> np.ndarray:
    """Distinct 3-grams, as integers, of a text's words in lower case, each with two blanks before and one after."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    inside = word_characters()[codes]
    begins = inside & ~np.append(False, inside[:-1])
    # where each character of a word lands when every word has three blanks before it, and the last one more behind
    place = (np.cumsum(inside) + 3 * np.cumsum(begins) - 1)[inside]
    padded = np.full((place[-1] + 2) if len(place) else 0, ord(" "), np.int64)
    padded[place] = codes[inside]
    grams = padded[:-2] << 42 | padded[1:-1] << 21 | padded[2:]
    middle_or_last = (padded[1:-1] != ord(" ")) | (padded[2:] != ord(" "))  # not the blanks between two words
    return np.unique(grams[middle_or_last & ~((padded[:-2] != ord(" ")) & (padded[1:-1] == ord(" ")))])


def with_grams(texts: DataFrame) -> DataFrame:
    """(id, grams) of each (id, text) with a text."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                some = b.slice(i, 512)
                grams = [trigrams(t) for t in some.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, grams)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams)))], ["id", "grams"])

    rows = texts.where("text is not null").select("id", "text")
    return rows.mapInArrow(run, StructType([rows.schema["id"], *StructType.fromDDL("grams array<long>").fields]))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
