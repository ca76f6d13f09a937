"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct 5-word shingles (64-bit hashes); two documents link when
100 * |A and B| >= 75 * |A or B|. Documents with equal sets are one class; only classes take part.

Linked sets of sizes a and b differ in at most (a + b) / 7 shingles. Sizes fall into bands whose lower edges grow by
4/3, so linked sets are in one band or in neighbours. The scheme of a band with largest size h splits the shingle
domain into more than k / 2 groups, k = floor(2 h / 7), and each group into three parts. Linked sets differ by at most
one shingle in some group, so two of its three parts agree: a set's signatures are the hashes of every two parts of
every group. A class signs in its band's scheme and in the next.

Signatures that hold few shingles agree by chance. A class needs need = floor(d / 2) + 1 groups, d its largest
distance to a linked set. If in so many groups every two parts hold two shingles, one of these groups agrees with any
linked set, and the class is sure with signatures of two shingles or more; else it signs with those of one, and is sure
if every two parts of so many groups hold one. Shingles of about ``SAMPLE_EVERY * SAMPLE_LEAST`` classes or more are left
out of the domain too, which loses nothing as the distance on a smaller domain is no larger. That is a number of classes,
not a share of them, so that the other signatures have no more partners in a larger corpus. A class that is not sure
there also signs on the whole domain and, if that is not enough either, signs what holds nothing. A pair is lost only if
neither side is sure, and then both have signed everything. Which shingles are frequent comes from one class in
``SAMPLE_EVERY``, drawn by its hash; it steers cost, never results.

Signatures go to buckets of about ``BUCKET_SIGNATURES``, packed in binary. Classes that share a signature are a run. A
run's smallest class leads; pairs of the leader and another class come first (no pairs within the group). Exact bounds
from binned counts drop pairs that are too far apart, and a class's nearest are verified on their whole sets. Links make
components. Then only pairs across components are looked at, among the classes that follow one leader, in blocks of
classes of like size: every pair that the bound leaves is verified. No pair of different classes that share a signature
is left out unless it is in one component already. A block holds about ``BLOCK_BINS`` bins, so a class is copied once for
some thousands of classes of its size band and the next ones that follow the same leader.

Tables are discarded when their last reader is done.

Components come from min-label propagation with pointer jumping over written tables.

Defined results: null or empty text, or one without words, has no shingles and is its own component. With fewer than
five words the whole sequence is the one shingle. Repeated rows are one class. A null doc_id never names a
component that has another doc_id. Other columns of the input are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.exact import FEW_GROUPS
from tessera.llm.tokens import shipped, slices
from tessera.llm.words import hashes, mix
from tessera.llm.work import discard, written

WORDS = 5
LEAST_BINS = 64
#: Groups of three parts for each shingle of a band's largest set.
GROUPS_PER_SHINGLE = 0.16
BUCKET_SIGNATURES = 3_000_000
#: Signatures a task holds before it hands them out.
HELD_SIGNATURES = 1_500_000
#: One class in so many is in the sample; a shingle in so many sampled classes is left out of the first domain.
SAMPLE_EVERY = 32
SAMPLE_LEAST = 3
#: At most so many shingles (the most frequent ones) are left out: 16 MB.
MAX_FREQUENT = 1 << 21
#: Bins of all the sketches in a block, and the most classes in one.
BLOCK_BINS = 1 << 23
MAX_BLOCK = 4096
#: Pairs of one block that are verified together.
PART_PAIRS = 512
#: Classes that a task remembers, so as not to describe or sign them again.
SEEN_CLASSES = 200_000
#: How many of a class's nearest partners among leaders and followers are verified first.
FIRST_PARTNERS = 8
DOC_BUCKETS = 1 << 18
_SHIFTS = np.array([0, 2, 4, 6], np.uint8)
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    w = hashes(text)
    n = len(w)
    if n == 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        if n < WORDS:
            total = np.uint64(n)
            for i in range(n):
                total = mix(np.array([total * _ODD[1] + w[i]], np.uint64))[0]
            return np.array([total], np.uint64)
        total = np.zeros(n - WORDS + 1, np.uint64)
        for i in range(WORDS):
            total += w[i : n - WORDS + 1 + i] * _ODD[i]
        total = np.sort(mix(total))
        return total[np.append(True, total[1:] != total[:-1])]


def class_of(s: np.ndarray) -> int:
    """64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ _ODD[2]).sum(dtype=np.uint64) + np.uint64(len(s)) * _ODD[0]], np.uint64)).view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """How many shingles fall into each bin, at most 3, in two bits each; at least twice as many bins as shingles."""
    bins = max(LEAST_BINS, 1 << (2 * len(s) - 1).bit_length()) if len(s) else LEAST_BINS
    counts = np.minimum(np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 3).astype(np.uint8).reshape(-1, 4)
    return (counts[:, 0] | counts[:, 1] << 2 | counts[:, 2] << 4 | counts[:, 3] << 6).tobytes()


def bins_of(packed: bytes, bins: int | None = None) -> np.ndarray:
    """Counts of a sketch, folded to ``bins`` bins. Counts are capped again, so they stay what ``bins`` bins would
    have given, and differences are no larger than those of the sets."""
    raw = np.frombuffer(packed, np.uint8)
    counts = ((raw[:, None] >> _SHIFTS) & 3).ravel()
    while bins is not None and len(counts) > bins:
        counts = np.minimum(counts[: len(counts) // 2] + counts[len(counts) // 2 :], 3)
    return counts


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At most the number of shingles in which the sets differ (rows of counts)."""
    return (np.maximum(x, y) - np.minimum(x, y)).sum(axis=-1, dtype=np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def band_edges(largest: int = 1 << 40) -> list[int]:
    edges = [1]
    while edges[-1] <= largest:
        edges.append(-(-4 * edges[-1] // 3))
    return edges


EDGES = band_edges()
_EDGES = np.array(EDGES)


def scheme(band: int) -> tuple[int, int]:
    """(largest size, number of groups) of a band. More groups than k // 2, with some to spare for thin ones."""
    h = EDGES[band + 1] - 1
    return h, max(2 * h // 7 // 2 + 1, int(GROUPS_PER_SHINGLE * h)) + 1


def _sign(s: np.ndarray, mixed: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of every two parts of every group, how many shingles those hold, and the least of it in each group."""
    sums = np.zeros(3 * n, np.uint64)
    part = (((s >> np.uint64(32)) * np.uint64(3 * n)) >> np.uint64(32)).astype(np.int64)
    if len(s):
        first = np.append(0, np.flatnonzero(part[1:] != part[:-1]) + 1)
        sums[part[first]] = np.add.reduceat(mixed, first)
    counts = np.bincount(part, minlength=3 * n)
    (x, y, z), (i, j, k) = (sums[c::3] for c in range(3)), (counts[c::3] for c in range(3))
    place = np.arange(3 * n, dtype=np.uint64) * _ODD[4] + np.uint64(salt) * _ODD[1]
    held = i + j, i + k, j + k
    return mix(np.concatenate([x + y, x + z, y + z]) + place), np.concatenate(held), np.minimum(np.minimum(held[0], held[1]), held[2])


def signatures(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """All signatures of a set (sorted)."""
    out = []
    size = len(s)
    own = int(np.searchsorted(_EDGES, size, side="right")) - 1
    with np.errstate(over="ignore"):
        mixed = mix(s ^ _ODD[3])
    domains = [(s, mixed, 1)]
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        rare = frequent[at] != s
        domains = [(s[rare], mixed[rare], 0), (s, mixed, 1)]
    with np.errstate(over="ignore"):
        for band in (own, own + 1):
            h, n = scheme(band)
            need = (size + min(h, 4 * size // 3)) // 7 // 2 + 1
            for domain, values, level in domains:
                got, held, thin = _sign(domain, values, n, 2 * band + level)
                least = 2 if np.count_nonzero(thin >= 2) >= need else 1
                out.append(got[held >= least])
                if np.count_nonzero(thin >= least) >= need:
                    break
            else:  # those that hold nothing, on the whole domain
                out.append(got[held < least])
    return np.concatenate(out)


class Seen(set):
    """The classes a task has met lately; bounded."""

    def first(self, cls: int) -> bool:
        if cls in self:
            return False
        if len(self) >= SEEN_CLASSES:
            self.clear()
        self.add(cls)
        return True


def sampled(cls: int) -> bool:
    with np.errstate(over="ignore"):
        return int(mix(np.array([cls], np.int64).view(np.uint64) * _ODD[0])[0] % np.uint64(SAMPLE_EVERY)) == 0


def described(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, cls, n, and, where the task meets the class for the first time, its sketch and, if it is in the sample,
    its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b in slices(batches):
            names, sizes, sketches, samples = [], [], [], []
            for t in b.column("body").to_pylist():
                s = shingles(t)
                c = class_of(s)
                fresh = seen.first(c)
                names.append(c)
                sizes.append(len(s))
                sketches.append(sketch(s) if fresh else None)
                samples.append(s.tobytes() if fresh and sampled(c) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(samples, pa.binary())],
                ["doc_id", "cls", "n", "sketch", "sample"])

    rows = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("body"))
    return rows.mapInArrow(run, "doc_id long, cls long, n long, sketch binary, sample binary")


def named(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` plus n_shingles and cls, the name of the set of each."""
    kept = [c for c in shipped(rows).columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in kept], pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64())], [*kept, "n_shingles", "cls"])

    return rows.mapInArrow(run, StructType([*[rows.schema[c] for c in kept], StructField("n_shingles", LongType()), StructField("cls", LongType())]))


def frequent_shingles(samples: DataFrame) -> np.ndarray:
    """Shingles of many sampled classes; steers cost only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            held = [np.frombuffer(x, np.int64) for x in b.column("sample").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held))], ["s"])

    often = samples.select("sample").mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= SAMPLE_LEAST)
    most = often.orderBy(F.desc("count"), "s").limit(MAX_FREQUENT).select("s").toArrow()
    return np.sort(most["s"].to_numpy().view(np.uint64))


def signed(docs: DataFrame, text: str, frequent: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, signatures, counts, names): packed 4-byte signatures in order of their classes, and for each class with
    one in this bucket how many (4 bytes) and its name (8 bytes)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        names, held, n = [], [], 0

        def out() -> pa.RecordBatch:
            sig = np.concatenate(held)
            owner = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h) for h in held])
            bucket = (((sig >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            sig, owner, bucket = sig[order].astype(np.uint32), owner[order], bucket[order]
            kinds, first = np.unique(bucket, return_index=True)
            ends = np.append(first[1:], len(bucket))
            own = np.array(names, np.int64)
            packed = []
            for a, z in zip(first, ends):
                place, count = np.unique(owner[a:z], return_counts=True)
                packed.append((sig[a:z].tobytes(), count.astype(np.uint32).tobytes(), own[place].tobytes()))
            return pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int32()), *[pa.array(c, pa.binary()) for c in zip(*packed)]], ["bucket", "signatures", "counts", "names"])

        for b in slices(batches):
            for t in b.column("body").to_pylist():
                s = shingles(t)
                c = class_of(s)
                if not len(s) or not seen.first(c):
                    continue
                names.append(c)
                held.append(signatures(s, shared.value))
                n += len(held[-1])
                if n >= HELD_SIGNATURES or len(names) >= 60_000:
                    yield out()
                    names, held, n = [], [], 0
        if held:
            yield out()

    return shipped(docs).select(F.col(f"`{text}`").alias("body")).mapInArrow(run, "bucket int, signatures binary, counts binary, names binary")


def star_edges(packed: DataFrame, buckets: int) -> DataFrame:
    """(a, b): the smallest class of a run and each other class of it, once for each task."""

    def of_bucket(rows: list[tuple[bytes, bytes, bytes]]) -> np.ndarray:
        sig = np.concatenate([np.frombuffer(s, np.uint32) for s, _, _ in rows])
        cls = np.concatenate([np.repeat(np.frombuffer(m, np.int64), np.frombuffer(k, np.uint32)) for _, k, m in rows])
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        again = np.zeros(len(sig), bool)
        same = sig[1:] == sig[:-1]
        again[1:] |= same
        again[:-1] |= same
        sig, cls = sig[again], cls[order][again]  # most signatures are alone
        order = np.lexsort((cls, sig))
        sig, cls = sig[order], cls[order]
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.empty(0, np.int64)
        lead = np.repeat(cls[first], np.diff(np.append(first, len(sig))))
        return np.unique(np.stack([lead[lead != cls], cls[lead != cls]], 1), axis=0)

    def out(held: list) -> Iterator[pa.RecordBatch]:
        pairs = of_bucket(held)
        for i in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + (1 << 16), c]) for c in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; one bucket is held at a time."""
        held, now = [], None
        for b in slices(batches, 16):
            for bucket, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != now and held:
                    yield from out(held)
                    held = []
                now = bucket
                held.append(rest)
        if held:
            yield from out(held)

    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").distinct()


def near_enough(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that the bound from sizes and bins does not exclude; apart: the bound's share of the limit."""
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            total = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
            apart = np.empty(b.num_rows, np.float64)
            for i, (x, y) in enumerate(zip(b.column("s_a").to_pylist(), b.column("s_b").to_pylist())):
                bins = 4 * min(len(x), len(y))
                apart[i] = 7 * distance(bins_of(x, bins), bins_of(y, bins)) / total[i]
            near = pa.array(apart <= 1)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(near), b.column("b").filter(near), pa.array(apart).filter(near)], ["a", "b", "apart"])

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)")
    return sized.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long, apart double")


def verified(pairs: DataFrame, docs: DataFrame, text: str, classes: DataFrame) -> DataFrame:
    """Pairs that link, by their whole sets. Texts are read where they lie; only sets of classes asked for move."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    where = asked.join(classes.select("cls", "rep"), "cls").select(F.pmod(F.xxhash64("rep"), F.lit(DOC_BUCKETS)).alias("_bucket")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(t) for t in b.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "shingles"])

    def check(asked: pa.Table, held: pa.Table) -> pa.Table:
        of = dict(zip(held["cls"].to_pylist(), held["shingles"].to_pylist()))
        yes = pa.array([linked(np.frombuffer(of[x], np.uint64), np.frombuffer(of[y], np.uint64)) for x, y in zip(asked["a"].to_pylist(), asked["b"].to_pylist())], pa.bool_())
        return asked.select(["a", "b"]).filter(yes)

    rows = docs.select("doc_id", F.col(f"`{text}`").alias("body")).withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(DOC_BUCKETS)))
    near = rows.join(F.broadcast(where), "_bucket", "left_semi")  # at most DOC_BUCKETS rows
    sets = near.select("body").mapInArrow(run, "cls long, shingles binary").join(asked, "cls", "left_semi").dropDuplicates(["cls"])
    # a set moves once for each part of a block that asks for it, not once for each pair; parts have a bounded size
    sizes = pairs.groupBy("run", "lo", "hi").agg(F.ceil(F.count(F.lit(1)) / PART_PAIRS).alias("_parts"))
    large = written(sizes.where("_parts > 1"))
    pairs = pairs.join(F.broadcast(large) if large.count() <= FEW_GROUPS else large, ["run", "lo", "hi"], "left")
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    block = ["run", "lo", "hi", "part"]
    needs = pairs.select(*[F.col(c).alias(f"_{c}") for c in block], F.explode(F.array("a", "b")).alias("cls")).distinct().join(sets, "cls")
    return written(pairs.select(*block, "a", "b").groupBy(*block).cogroup(needs.groupBy(*[f"_{c}" for c in block])).applyInArrow(check, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(cls, label): the smallest class reachable, for every class that has a link."""
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    held = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "cls"))
    while True:
        labels = held.select("cls", "label")
        near = both.join(labels.withColumnRenamed("cls", "b"), "b").groupBy("a").agg(F.min("label").alias("_near"))
        step = labels.join(near.withColumnRenamed("a", "cls"), "cls").select("cls", F.col("label").alias("_old"), F.least("label", "_near").alias("_new"))
        of = step.select(F.col("cls").alias("_new"), F.col("_new").alias("_root"))
        jumped = written(step.join(of, "_new", "left").select("cls", "_old", F.least(F.col("_new"), F.coalesce("_root", "_new")).alias("label")))
        discard(held)
        held = jumped
        if jumped.where("_old <> label").isEmpty():
            discard(both)
            return jumped


def band_of(n: str):
    """Place of a size among the bands' lower edges."""
    return (F.array_position(F.transform(F.array(*map(F.lit, EDGES)), lambda e: e > F.col(n)), True) - 2).cast("int")


def block_size(band):
    """How many classes of a band a block takes."""
    largest = F.element_at(F.array(*map(F.lit, EDGES)), F.greatest(band, F.lit(0)) + 2)
    return F.greatest(F.lit(16), F.least(F.lit(MAX_BLOCK), F.floor(F.lit(BLOCK_BINS) / (4 * largest))))


def across(stars: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs within the group of one leading class that are in different components and pass the bound. Any two
    classes of a run are in the group of the run's leader."""
    members = stars.select(F.col("a").alias("run"), F.col("b").alias("cls")).unionByName(stars.select(F.col("a").alias("run"), F.col("a").alias("cls")).distinct())
    known = members.join(labels.select("cls", "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    known = known.join(classes.select("cls", "n", band_of("n").alias("band")), "cls")
    ends = known.groupBy("run", "band").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("m"))
    by_run = F.map_from_entries(F.collect_list(F.struct("band", "m"))).alias("bands")  # one entry a band: some 100 at most
    mixed = written(ends.groupBy("run").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), by_run).where("_lo <> _hi").select("run", "bands"))
    # ``mixed`` is a table of its own, so that the join can split a run with many members
    rows = known.join(mixed, "run").join(classes.select("cls", "sketch"), "cls")
    blocks = lambda band: F.ceil(F.coalesce(F.try_element_at("bands", band), F.lit(0)) / block_size(band)).cast("int")
    name = lambda band, i: F.shiftleft(band, 24) + i
    own = name(F.col("band"), F.pmod(F.xxhash64("cls"), blocks(F.col("band"))).cast("int"))
    partner = lambda band: F.when(blocks(band) > 0, F.transform(F.sequence(F.lit(0), F.greatest(blocks(band) - 1, F.lit(0))), lambda i: name(band, i))).otherwise(F.array().cast("array<int>"))
    near_bands = F.flatten(F.array(*[partner(F.col("band") + x) for x in (-1, 0, 1)]))  # linked sizes are at most one band apart
    rows = rows.withColumn("own", own).withColumn("other", F.explode(near_bands)).drop("bands")
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    def near(cls, label, n, own, run, lo, hi, sketches) -> np.ndarray:
        """Pairs of one block of a run."""
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        bins = 4 * min(map(len, sketches))
        counts = np.stack([bins_of(x, bins) for x in sketches])
        step, found = max(1, (1 << 22) // bins), [np.empty((2, 0), np.int64)]
        for k in range(0, len(left), 64):
            i, j = np.repeat(left[k : k + 64], len(right)), np.tile(right, len(left[k : k + 64]))
            wanted = (label[i] != label[j]) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])) & ((lo != hi) | (i < j))
            i, j = i[wanted], j[wanted]
            for z in range(0, len(i), step):
                x, y = i[z : z + step], j[z : z + step]
                close = 7 * distance(counts[x], counts[y]) <= n[x] + n[y]
                found.append(np.stack([x[close], y[close]]))
        i, j = np.concatenate(found, axis=1)
        a, b = np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])
        return np.rec.fromarrays([a, b, *(np.full(len(a), x, np.int64) for x in (run, lo, hi))], names="a,b,run,lo,hi")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; one block is held at a time."""
        key, held, found, n_found = None, [], [], 0

        def out() -> pa.RecordBatch:
            pairs = np.sort(np.concatenate(found), order=["a", "b", "run"])
            pairs = pairs[np.append(True, (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1]))[: len(pairs)]]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[c])) for c in ("a", "b", "run", "lo", "hi")], ["a", "b", "run", "lo", "hi"])

        def block() -> np.ndarray:
            cls, label, n, own = (np.concatenate([h[c] for h in held]) for c in range(4))
            return near(cls, label, n, own, *key, [x for h in held for x in h[4]])

        for b in slices(batches):
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("run", "lo", "hi")], 1)
            cols = [b.column(c).to_numpy() for c in ("cls", "label", "n", "own")]
            sketches = b.column("sketch").to_pylist()
            ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            start = 0
            for end in ends:
                if end == start:
                    continue
                now = tuple(keys[start].tolist())
                if now != key and held:
                    found.append(block())
                    n_found += len(found[-1])
                    held = []
                key = now
                held.append([c[start:end] for c in cols] + [sketches[start:end]])
                start = end
            if n_found >= 1 << 18:
                yield out()
                found, n_found = [], 0
        if held:
            found.append(block())
        if found:
            yield out()

    in_blocks = rows.select("run", "cls", "label", "n", "own", "lo", "hi", "sketch").repartition("run", "lo", "hi").sortWithinPartitions("run", "lo", "hi")
    found = in_blocks.mapInArrow(sweep, "a long, b long, run long, lo long, hi long")
    pairs = written(found.groupBy("a", "b").agg(F.min(F.struct("run", "lo", "hi")).alias("x")).select("a", "b", "x.*"))
    discard(mixed)
    return pairs


def nearest_of_each(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs that are among the k nearest of either end."""
    both = pairs.select(F.col("a").alias("c"), "a", "b", "apart").unionByName(pairs.select(F.col("b").alias("c"), "a", "b", "apart"))
    order = F.row_number().over(Window.partitionBy("c").orderBy("apart", "a", "b"))
    return both.withColumn("_k", order).where(F.col("_k") <= k).select("a", "b", "apart").distinct()


def near_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, and cls, the name of its set."""
    rows = written(described(docs, text))
    classes = written(rows.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch")))
    n_shingles = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-n_shingles // BUCKET_SIGNATURES))
    frequent = frequent_shingles(rows.where("sample is not null").dropDuplicates(["cls"]))
    stars = written(star_edges(signed(docs, text, frequent, buckets), buckets))
    chosen = written(nearest_of_each(near_enough(stars, classes), FIRST_PARTNERS))
    tried = chosen.select("a", "b", F.col("a").alias("run"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    links = verified(tried, docs, text, classes)
    labels = components(links)
    left = across(stars, classes, labels)
    rest = written(left.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    discard(stars, chosen, left)
    if not rest.isEmpty():
        more = verified(rest, docs, text, classes)
        if not more.isEmpty():
            discard(labels)
            labels = components(links.unionByName(more))
        discard(more)
    discard(links, rest)
    whole = classes.join(labels.select("cls", "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    names = whole.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = written(whole.join(names, "label").select("cls", "component_id"))
    discard(classes, labels)
    return rows.select("doc_id", "n", "cls").join(named, "cls").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "cls")
