"""Hard-negative mining over k-means inverted lists with stored radii.

Vectors become integers, so that scores (inner products) are exact. An index holds every row in the list of its nearest
centroid, with the largest distance of a row of the list from it. By the inequality of Cauchy and Schwarz the scores of a list
lie within ``a.c - |a| r`` and ``a.c + |a| r`` for an anchor a. A search asks for the best rows within windows of scores. It
visits the lists of each anchor by their upper bound, in rounds of growing length; it skips a list whose bounds lie outside
all windows, and stops where the upper bound falls strictly below the score of the kth row found, so that rows with
equal scores are still seen. The answer is exact whatever the centroids are.

Centroids are fitted on a bounded sample (``SAMPLE_ROWS`` rows are drawn in the mean, twice as many at most); every row is
indexed. Lists are cut into chunks of bounded size by a random deal, so a vector with a third of all rows fills
many chunks. Anchors travel packed to the chunks that they ask for and meet them in a shuffle join on (list, chunk); a
task holds one packed block of anchors and one chunk. Only the centroids and the sizes and radii of lists (at most
``MAX_LISTS`` rows) are broadcast. All other joins ask for a merge of sorted sides: Spark would guess the size of a side from its
compressed files, where packed rows and repeated asks look far smaller than they are, and gather it on the driver.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part. Shorter vectors count
as continued with zeros. Components are floored after scaling and held within ``LIMIT`` either way, which floats of
ordinary embeddings never reach. Rows that share the id of an anchor count as the anchor and are neither its positives nor
its negatives; other repeated rows count one by one, and each repeated anchor has its own results. Equal scores go by id.
Without rows, anchors, positives or negatives there is nothing to return. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import shipped, slices
from tessera.llm.work import discard, setting, written

SCALE = 256
LIMIT = 1 << 25
SAMPLE_ROWS = 1 << 14
MAX_LISTS = 1024
ITERATIONS = 8
#: Rows whose distances from all centroids are held at once.
NEAREST_ROWS = 1024
#: Bytes of vectors in a chunk of a list, and rows of it at most; the same for a block of anchors.
CHUNK_BYTES, CHUNK_ROWS = 1 << 19, 2048
BLOCK_BYTES, BLOCK_ROWS = 1 << 17, 512
#: Lists that an anchor has visited at the end of the first round; each later round takes FURTHER times as many.
FIRST, FURTHER = 4, 8
#: Packed rows (pairs of a block and a chunk) that a worker is handed at once.
PACKED_ROWS = 32
SEED = 7
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least so many hundredths of the positive's.
LEAST_PERCENT = 80


def prepared(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the rows that take part: integer components as an array."""
    raw = F.col(f"`{vector}`")
    sound = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    held = F.transform(raw, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))))
    some = F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{label}`").isNotNull() & raw.isNotNull()
    return rows.where(some).where(sound).select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), held.alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Arrays of up to ``dim`` integers as rows; missing components are 0."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def lloyd(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of k-means; those that no row is nearest to stay where they began."""
    rng = np.random.default_rng(SEED)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ITERATIONS):
        mine = nearest(x, centroids)
        n = np.bincount(mine, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, mine, x)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, ``NEAREST_ROWS`` rows at a time: all distances at once would take rows times lists."""
    square = (centroids**2).sum(1)
    parts = [np.argmin(square - 2 * (x[i : i + NEAREST_ROWS] @ centroids.T), axis=1) for i in range(0, len(x), NEAREST_ROWS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def merged_with(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two shuffled and sorted sides, whatever their sizes seem to be."""
    return left.hint("merge").join(right.hint("merge"), on, how)


class Index(NamedTuple):
    centroids: np.ndarray
    radius: np.ndarray
    chunks: np.ndarray  # of each list
    lists: DataFrame  # (list, chunk, ids, labels, v): rows of a chunk by id
    dtype: str  # of packed components
    exact: bool  # whether products of floats are exact

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the scores in each list, with room for rounding."""
        centre, reach = a @ self.centroids.T, np.sqrt((a**2).sum(1))[:, None] * self.radius
        room = 1e-9 * (np.abs(centre) + reach) + 1e-6
        return centre - reach - room, centre + reach + room


def build(rows: DataFrame) -> Index | None:
    """The index of every row of a ``prepared`` table; None without rows."""
    n, dim, top = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    if not n:
        return None
    dim, top = max(dim, 1), int(top or 0)
    dtype = "<i2" if top < 1 << 15 else "<i4"
    sample = rows.select("v").sample(min(1.0, SAMPLE_ROWS / n), SEED).limit(2 * SAMPLE_ROWS).toArrow()["v"].combine_chunks()
    if not len(sample):
        sample = rows.select("v").limit(1).toArrow()["v"].combine_chunks()
    centroids = lloyd(matrix(sample, dim).astype(np.float64), min(MAX_LISTS, isqrt(n)))
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng(TaskContext.get().partitionId())
        for b in slices(batches, 4096):
            x = matrix(b.column("v"), dim)
            mine = nearest(x.astype(np.float64), shared.value)
            away = np.sqrt(((x - shared.value[mine]) ** 2).sum(1))
            packed = pa.array([r.tobytes() for r in x.astype(dtype)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(mine.astype(np.int32)), b.column("vec_id"), b.column("label"), packed, pa.array(away), pa.array(rng.integers(0, 1 << 31, len(x)))],
                ["list", "vec_id", "label", "v", "away", "deal"])

    assigned = written(shipped(rows).mapInArrow(assign, "list int, vec_id long, label long, v binary, away double, deal long"))
    chunk_rows = min(CHUNK_ROWS, max(1, CHUNK_BYTES // (dim * np.dtype(dtype).itemsize)))
    sizes = written(assigned.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks"), F.max("away").alias("radius")))
    radius, chunks = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in sizes.collect():  # at most MAX_LISTS rows
        radius[r["list"]], chunks[r["list"]] = r["radius"], r["chunks"]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        cells = [table[c].to_numpy().astype("<i8").tobytes() for c in ("vec_id", "label")] + [b"".join(table["v"].to_pylist())]
        return pa.table([table["list"].slice(0, 1), table["chunk"].slice(0, 1), *[pa.array([c], pa.binary()) for c in cells]], names=["list", "chunk", "ids", "labels", "v"])

    dealt = assigned.join(F.broadcast(sizes), "list").select("list", (F.col("deal") % F.col("chunks")).cast("int").alias("chunk"), "vec_id", "label", "v")
    lists = written(dealt.groupBy("list", "chunk").applyInArrow(pack, "list int, chunk int, ids binary, labels binary, v binary"))
    discard(assigned, sizes)
    return Index(centroids, radius, chunks, lists, dtype, dim * top * top < 1 << 53)


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[dict]:
    """Columns of ``rows`` rows at a time, whatever the size of the batches."""
    held, n = [], 0

    def out() -> dict:
        return {f: pa.concat_arrays([b.column(f) for b in held]) for f in held[0].schema.names}

    for b in slices(batches, rows):
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def best(score: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best columns of each row among those that fit, equal scores by column."""
    masked = np.where(fits, score, np.iinfo(np.int64).min)
    if masked.shape[1] > k:
        fits = fits & (masked >= np.partition(masked, -k, axis=1)[:, -k, None])
    r, c = np.nonzero(fits)
    order = np.lexsort((c, -masked[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, r)
    return r[np.arange(len(r)) - first < k], c[np.arange(len(r)) - first < k]


def search(queries: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """(q, w, score, vec_id): for each query and each of its windows the k best rows with a score within the window, of the
    query's label or (``same`` false) of others. A query is (q, vec_id, label, v, low, high), q its key, low and high
    arrays of like length."""
    spark = queries.sparkSession
    dtype, exact, (n_lists, dim) = index.dtype, index.exact, index.centroids.shape
    shared = spark.sparkContext.broadcast(index._replace(lists=None))
    block_rows = min(BLOCK_ROWS, max(1, BLOCK_BYTES // (dim * np.dtype(dtype).itemsize)))
    widest = queries.agg(F.max(F.size("low"))).first()[0] or 0

    def padded(column: pa.Array, value: int) -> np.ndarray:
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        out = np.full((len(sizes), widest), value, np.int64)
        out[np.arange(widest) < sizes[:, None]] = column.flatten().to_numpy()
        return out

    def asks(begin: int, end: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for b in blocks(batches, block_rows):
                a, low, high = matrix(b["v"], dim), padded(b["floor"], 1), padded(b["high"], 0)  # windows that are not there are empty
                keys = [b[c].to_numpy() for c in ("q", "vec_id", "label")]
                lower, upper = model.bounds(a.astype(np.float64))
                visit = np.zeros(upper.shape, bool)
                np.put_along_axis(visit, np.argsort(-upper, axis=1, kind="stable")[:, begin:end], True, axis=1)
                for w in range(widest):
                    lo, hi = low[:, w, None], high[:, w, None]
                    inside = (upper >= lo) & (lower <= hi) & (lo <= hi)
                    some = inside if w == 0 else some | inside
                visit &= some & (model.chunks > 0)
                for which in np.flatnonzero(visit.any(0)):
                    mine, n = visit[:, which], int(model.chunks[which])
                    cells = [pack64(c[mine]) for c in keys] + [a[mine].astype(dtype).tobytes(), pack64(low[mine]), pack64(high[mine])]
                    yield pa.RecordBatch.from_arrays([pa.array([which] * n, pa.int32()), pa.array(range(n), pa.int32()), *[pa.array([c] * n, pa.binary()) for c in cells]], ASK_NAMES)
        return run

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            row = b.to_pylist()[0]
            q, own, label, ids, labels = (np.frombuffer(row[c], "<i8") for c in ("q", "own", "label", "ids", "labels"))
            low, high = (np.frombuffer(row[c], "<i8").reshape(len(q), -1) for c in ("low", "high"))
            a, x = (np.frombuffer(row[c], dtype).reshape(-1, dim) for c in ("a", "v"))
            score = (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if exact else a.astype(np.int64) @ x.astype(np.int64).T
            fits = ((label[:, None] == labels) == same) & (own[:, None] != ids)
            for w in range(low.shape[1]):
                r, c = best(score, fits & (score >= low[:, w, None]) & (score <= high[:, w, None]), k)
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(np.full(len(r), w, np.int32)), pa.array(score[r, c]), pa.array(ids[c])], ["q", "w", "score", "vec_id"])

    ranked = Window.partitionBy("q", "w").orderBy(F.desc("score"), "vec_id")
    state, found, begin, end = queries.withColumn("floor", F.col("low")), None, 0, FIRST
    while widest and begin < n_lists:
        asked = shipped(state).select("q", "vec_id", "label", "v", "floor", "high").mapInArrow(asks(begin, end), ASKS)
        with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(PACKED_ROWS)):
            new = written(merged_with(asked, index.lists, ["list", "chunk"]).mapInArrow(answer, FOUND))
        every = new if found is None else found.unionByName(new)
        merged = written(every.withColumn("_k", F.row_number().over(ranked)).where(F.col("_k") <= k).drop("_k"))
        discard(*[t for t in (new, found) if t is not None])
        found, begin, end = merged, end, end * FURTHER
        full = found.groupBy("q", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
        reached = full.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("reached"))
        state = merged_with(queries, reached, "q", "left").withColumn("floor", F.transform(
            "low", lambda x, i: F.greatest(x, F.element_at("reached", i)))).drop("reached")
    return found if found is not None else spark.createDataFrame([], FOUND)


ASKS = "list int, chunk int, q binary, own binary, label binary, a binary, low binary, high binary"
ASK_NAMES = [c.split()[0] for c in ASKS.split(", ")]
FOUND = "q long, w int, score long, vec_id long"
ANY = (1 << 62) - 1


def pack64(x: np.ndarray) -> bytes:
    return x.astype("<i8").tobytes()


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors (``is_anchor``, over
    vec_id and label) of a ``prepared`` table: of each anchor's best ``positives`` rows of its label the best ``negatives``
    rows of other labels with a score from ``least_percent`` hundredths of the positive's up to the positive's."""
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = written(rows)
    index = build(rows)
    if index is None:
        return rows.sparkSession.createDataFrame([], result)
    anchors = written(rows.where(is_anchor).withColumn("q", F.monotonically_increasing_id()))
    whole = lambda x: F.array(F.lit(x).cast("long"))
    found = search(anchors.withColumns({"low": whole(-ANY), "high": whole(ANY)}), index, True, positives)
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), lambda x: F.struct((-x["s"]).alias("score"), x["vec_id"].alias("vec_id")))
    of_anchor = written(found.groupBy("q").agg(order.alias("p")))  # at most ``positives`` each
    # the least n with least_percent * score <= 100 * n
    least = lambda x: F.call_function("div", x * least_percent + 99 - F.pmod(x * least_percent + 99, F.lit(100)), F.lit(100))
    asked = merged_with(anchors, of_anchor, "q").select(
        "q", "vec_id", "label", "v", F.transform("p", lambda x: least(x["score"])).alias("low"), F.transform("p", lambda x: x["score"]).alias("high"))
    hard = search(written(asked), index, False, negatives)
    rank = F.row_number().over(Window.partitionBy("q", "w").orderBy(F.desc("score"), "vec_id"))
    pairs = merged_with(anchors.select("q", F.col("vec_id").alias("anchor_id")), of_anchor, "q").select("q", "anchor_id", F.posexplode("p").alias("w", "p"))
    ranked = hard.select("q", "w", rank.alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return merged_with(pairs, ranked, ["q", "w"]).select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), "rank", "negative_id", F.col("p.score").alias("positive_score"), "negative_score")
