"""Language-model scoring by a weighted backoff automaton.

Tokens are words and one end token a text. Unigrams are smoothed with 0.1; every bigram h w that occurs ``MIN_COUNT``
times or more is kept, with absolute discounting. Each history is a state. Its arcs carry log10 p(w | h); its failure
arc carries the backoff weight and leads to the root, whose arcs are the unigrams. The model grows with the corpus.

The automaton is a written table of (key, value). A traversal of a text starts from the path over the failure arcs: each
word brings its unigram and the failure weight of its state, and each kept bigram the difference between its arc and
that path. So a traversal asks for the keys of its words and bigrams and adds up what the table has.

Keys are dealt to buckets by their first bits. Counts and questions travel packed: a row holds the sorted keys of one
bucket that one chunk of texts has, so a hot word or bigram is one key a chunk. A task holds one bucket of the table and
streams the questions past it; partial sums of a chunk go back to the chunk. Texts are read ``ROUNDS`` times, each time
for a part of the keys, so that the questions of one round alone are on disk. The hottest rows of the table (from
``MIN_WORD`` and ``MIN_BIGRAM`` of the training tokens, so at most 1 / MIN_WORD words and 1 / MIN_BIGRAM bigrams) are
also held in memory, which saves questions and changes no score.

Defined results: null or empty text is the end token alone. Unknown words have count 0. Without training rows every
token has the smoothed probability of a vocabulary of none. Rows that repeat a doc_id are scored one by one; a null
doc_id is carried. An empty table gives no rows. Words and bigrams are compared by 64-bit hashes. Other columns of the
input are not read. The texts must be a table, or come in the same order whenever they are read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import shipped, slices
from tessera.llm.words import END, hashes
from tessera.llm.work import discard, written

#: Occurrences from which a bigram is kept.
MIN_COUNT = 2
#: Share of the training tokens from which a word, or a bigram, is also held in memory.
MIN_WORD = 1e-5
MIN_BIGRAM = 2e-6
DISCOUNT = 0.75
SMOOTH = 0.1
#: Tokens of a chunk that is counted, and of one that is scored (at most CHUNK_TEXTS texts).
COUNT_TOKENS = 1 << 21
CHUNK_TOKENS = 1 << 20
CHUNK_TEXTS = 1 << 16
#: Bytes of text, and keys of the table, to a bucket.
BUCKET_BYTES = 1 << 23
#: Passes over the texts to score (a power of two).
ROUNDS = 2
BUCKET_KEYS = 1 << 21
START = 2  # the state before the first word
WORD = 0  # in place of the history: a count of the word itself


def token_hashes(text: str | None) -> np.ndarray:
    return np.append(hashes(text), np.uint64(END))


def histories(tokens: np.ndarray) -> np.ndarray:
    """The word before each token of one text."""
    return np.append(np.uint64(START), tokens[:-1])


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The key of a bigram; with ``WORD`` for h that of the word, which is itself."""
    return ((h << np.uint64(23)) | (h >> np.uint64(41))) ^ w


def pair_key(h: str, w: str) -> Column:
    """The same in a plan."""
    return F.shiftleft(h, 23).bitwiseOR(F.shiftrightunsigned(h, 41)).bitwiseXOR(F.col(w))


def borders(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of sorted keys begins, and the end."""
    first = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, first), [len(sorted_keys)]]).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """64-bit integers by bytes of like place, which compresses where they are sorted."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def of_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def of_one_bucket(batches: Iterator[pa.RecordBatch], rows: int = 8) -> Iterator[tuple[int, dict]]:
    """(bucket, row) of rows that come sorted by bucket."""
    for b in slices(batches, rows):
        yield from ((r["bucket"], r) for r in b.to_pylist())


def count_grams(training: DataFrame, text: str) -> DataFrame:
    """(h, w, c): counts of all words (h is ``WORD``) and of the kept bigrams."""
    body = F.col(f"`{text}`")
    size = training.agg(F.coalesce(F.sum(F.octet_length(body)), F.lit(0))).first()[0]
    buckets = max(int(training.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            w, h = np.concatenate(held), np.concatenate([histories(t) for t in held])
            found = []
            for hist, word in ((None, w), (h, w)):
                key, first, count = np.unique(word if hist is None else pair_keys(hist, word), return_index=True, return_counts=True)
                ends, word, count = borders(key, buckets), word[first], count.astype(np.uint32)
                found += [(i, hist is not None, planes(key[a:z]), b"" if hist is None else word[a:z].tobytes(), count[a:z].tobytes())
                          for i, (a, z) in enumerate(zip(ends, ends[1:])) if z > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "pair", "key", "w", "c"])

        for b in slices(batches):
            for t in b.column(0).to_pylist():
                held.append(token_hashes(t))
                n += len(held[-1])
                if n >= COUNT_TOKENS:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            for pair in (False, True):
                some = [r for r in rows if r["pair"] == pair]
                if not some:
                    continue
                key = np.concatenate([of_planes(r["key"]) for r in some])
                order = np.argsort(key)
                key = key[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                c = np.add.reduceat(np.concatenate([np.frombuffer(r["c"], np.uint32) for r in some]).astype(np.int64)[order], first)
                kept = c >= (MIN_COUNT if pair else 1)
                key, c = key[first][kept], c[kept]
                w = np.concatenate([np.frombuffer(r["w"], np.uint64) for r in some])[order][first][kept] if pair else key
                turned = key ^ w
                h = (turned >> np.uint64(23)) | (turned << np.uint64(41))
                for i in range(0, len(c), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(w[part].view(np.int64)), pa.array(c[part])], ["h", "w", "c"])

        held, now = [], None
        for bucket, row in of_one_bucket(batches):
            if bucket != now and held:
                yield from out(held)
                held = []
            now = bucket
            held.append(row)
        if held:
            yield from out(held)

    partial = shipped(training).select(body.alias("t")).mapInArrow(run, "bucket int, pair boolean, key binary, w binary, c binary")
    return partial.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(add, "h long, w long, c long")


def places(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each word in ``known`` (sorted), -1 if it is not there."""
    if not len(known):
        return np.full(len(words), -1, np.int64)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, at, -1)


class Automaton:
    """The same automaton in one process, for small models, against which the tables are tested. States are histories
    (places of words, the start, and the root)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, total: int, distinct: int, starts: int):
        self.size = len(words) + 1
        self.denominator = total + SMOOTH * (distinct + 1)
        self.words = words
        unigram = (counts + SMOOTH) / self.denominator
        history, word = pairs // self.size, pairs % self.size
        seen = np.append(counts, starts)[history]
        p = (pair_counts - DISCOUNT) / seen
        kept_mass = np.bincount(history, p, self.size)
        uni_mass = np.bincount(history, unigram[word], self.size) if len(word) else np.zeros(self.size)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.log10((1 - kept_mass) / (1 - uni_mass))
        self.unigram = np.log10(unigram).tolist()
        self.failure = [float(x) for x in weight]
        self.arcs = dict(zip(pairs.tolist(), np.log10(p).tolist()))
        self.has_arcs = np.bincount(history, minlength=self.size).astype(bool).tolist()

    def traverse(self, tokens: np.ndarray) -> tuple[float, float, np.ndarray]:
        """(score, base score) of what the automaton knows, and the hashes of the words that it does not."""
        place = places(tokens, self.words)
        state, score, base = self.size - 1, 0.0, 0.0
        arcs, unigram, failure, has_arcs, size = self.arcs, self.unigram, self.failure, self.has_arcs, self.size
        for w in place.tolist():
            if w < 0:
                if state >= 0 and has_arcs[state]:
                    score += failure[state]
                state = -1  # the root
                continue
            base += unigram[w]
            arc = arcs.get(state * size + w) if state >= 0 else None
            if arc is not None:
                score += arc
            else:
                if state >= 0 and has_arcs[state]:
                    score += failure[state]
                score += unigram[w]
            state = w
        return score, base, tokens[place < 0]


class Model:
    """What a traversal holds in memory: the hot rows of the table, and the score of an unknown word."""

    def __init__(self, rows: pa.Table, denominator: float, start: float):
        keys = rows["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.base, self.whole = keys[order], rows["base"].to_numpy()[order], rows["whole"].to_numpy()[order]
        self.unknown, self.start = float(np.log10(SMOOTH / denominator)), start

    def traverse(self, texts: list[np.ndarray], turn: int) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """([n_tokens, n_known, base, whole] of what is in memory, (key, text) of what is not, sorted by key), for the keys
        of a round; what every text has counts in round 0."""
        n_tokens = np.array([len(t) for t in texts], np.int64)
        w, h = np.concatenate(texts), np.concatenate([histories(t) for t in texts])
        whose = np.repeat(np.arange(len(texts), dtype=np.uint16), n_tokens)
        floor = n_tokens * (0.0 if turn else self.unknown)
        sums = [n_tokens, np.zeros(len(texts), np.int64), floor, floor + (0.0 if turn else self.start)]
        asked = []
        for every in (w, pair_keys(h, w)):
            mine = (every & np.uint64(ROUNDS - 1)) == turn
            key, text = every[mine], whose[mine]
            place = places(key, self.keys)
            hit = place >= 0
            for i, more in enumerate(summed(text[hit], self.base[place[hit]], self.whole[place[hit]], len(texts)), 1):
                sums[i] = sums[i] + more
            asked.append((key[~hit], text[~hit]))
        key, text = (np.concatenate(x) for x in zip(*asked))
        order = np.argsort(key)
        return sums, (key[order], text[order])


def summed(text: np.ndarray, base: np.ndarray, whole: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known words, base, whole) of each text; a word's base is above 0, a bigram's is 0."""
    return np.bincount(text[base > 0], minlength=n), np.bincount(text, base, n), np.bincount(text, whole, n)


def split_join(rows: DataFrame, table: DataFrame, hot: Column, on: str) -> DataFrame:
    """Inner join on a key that is unique in ``table``; its hot rows are broadcast, as many rows ask for them."""
    few = F.broadcast(table.where(hot))
    return rows.join(few, on).unionByName(rows.join(few, on, "left_anti").join(table.where(~hot), on))


def fit(training: DataFrame, text: str = "text") -> tuple[Model, DataFrame, int, int]:
    """(hot rows, table of all others, N, V)."""
    grams = written(count_grams(training, text))
    words, pairs = grams.where(F.col("h") == WORD).select(F.col("w"), F.col("c").alias("cw")), grams.where(F.col("h") != WORD)
    total, distinct, texts = words.agg(
        F.coalesce(F.sum("cw"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("w") == END, F.col("cw"))), F.lit(0))).first()
    denominator = total + SMOOTH * (distinct + 1)
    often = MIN_WORD * total
    unigram = (F.col("cw") + SMOOTH) / F.lit(denominator)
    known = written(split_join(pairs, words, F.col("cw") >= often, "w"))  # at most 1 / MIN_WORD hot rows, as below
    masses = known.groupBy("h").agg(F.sum(F.col("c") - DISCOUNT).alias("kept"), F.sum(unigram).alias("uni"))
    seen = words.select(F.col("w").alias("h"), F.col("cw").alias("ch")).unionByName(training.sparkSession.range(1).select(F.lit(START).cast("long").alias("h"), F.lit(texts).cast("long").alias("ch")))
    states = written(seen.join(masses, "h", "left").select(
        "h", "ch", F.coalesce(F.log10((1 - F.col("kept") / F.col("ch")) / (1 - F.col("uni"))), F.lit(0.0)).alias("failure")))
    discard(grams)
    gain = F.log10((F.col("ch") + SMOOTH) / SMOOTH)
    word_rows = states.where(F.col("h") != START).select(
        F.col("h").alias("key"), gain.alias("base"), (gain + F.col("failure")).alias("whole"), (F.col("ch") >= often).alias("hot"))
    arcs = split_join(known, states, (F.col("ch") >= often) | (F.col("h") == START), "h")
    arc_rows = arcs.select(
        pair_key("h", "w").alias("key"), F.lit(0.0).alias("base"), (F.log10((F.col("c") - DISCOUNT) / F.col("ch")) - F.log10(unigram) - F.col("failure")).alias("whole"),
        (F.col("c") >= MIN_BIGRAM * total).alias("hot"))
    table = written(word_rows.unionByName(arc_rows))
    start = states.where(F.col("h") == START).first()["failure"]
    hot = table.where("hot").select("key", "base", "whole").toArrow()  # at most 1 / MIN_WORD + 1 / MIN_BIGRAM rows
    discard(known, states)
    return Model(hot, denominator, start), table.where("not hot").drop("hot"), total, distinct


CELLS = "bucket int, kind int, chunk long, key binary, text binary, base binary, whole binary"
CELL_NAMES = [c.split()[0] for c in CELLS.split(", ")]
CELL_TYPES = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
#: Kinds of rows: a part of the table, the keys a chunk asks for, the texts of a chunk, sums for the texts of a chunk.
TABLE, ASKED, TEXTS, SUMS = range(4)


def cells(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), CELL_TYPES)], CELL_NAMES)


def score(docs: DataFrame, model: Model, table: DataFrame, total: int, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score: one row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    buckets = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-table.count() // (ROUNDS * BUCKET_KEYS)))
    parts = [written(one_round(docs, shared, table.where(F.col("key").bitwiseAND(ROUNDS - 1) == turn), turn, buckets, text)) for turn in range(ROUNDS)]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy("chunk", "place").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), *[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")]).drop("chunk", "place")


def one_round(docs: DataFrame, shared, table: DataFrame, turn: int, buckets: int, text: str) -> DataFrame:
    """(chunk, place, doc_id, n_tokens, n_known, base_score, score): what the keys of a round add to each row."""

    def part_of_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            key, base, whole = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(key)
            key, base, whole = key[order], base[order], whole[order]
            ends = borders(key, buckets)
            return cells([(i, TABLE, 0, planes(key[a:z]), b"", base[a:z].tobytes(), whole[a:z].tobytes()) for i, (a, z) in enumerate(zip(ends, ends[1:])) if z > a])

        for b in batches:
            held.append((b.column("key").to_numpy().view(np.uint64), b.column("base").to_numpy(), b.column("whole").to_numpy()))
            n += b.num_rows
            if n >= 1 << 19:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        ids, held, n = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            sums, (key, who) = shared.value.traverse(held, turn)
            names = np.array([i or 0 for i in ids], np.int64).tobytes() + np.array([i is None for i in ids], np.uint8).tobytes()
            n_tokens, n_known, base, whole = sums
            yield cells([(chunk % buckets, TEXTS, chunk, names, np.stack([n_tokens, n_known]).tobytes(), base.tobytes(), whole.tobytes())])
            ends = borders(key, buckets)
            yield cells([(i, ASKED, chunk, planes(key[a:z]), who[a:z].tobytes(), b"", b"") for i, (a, z) in enumerate(zip(ends, ends[1:])) if z > a] or [(0, ASKED, chunk, b"", b"", b"", b"")])

        for b in slices(batches):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist()):
                ids.append(i)
                held.append(token_hashes(t))
                n += len(held[-1])
                if n >= CHUNK_TOKENS or len(ids) == CHUNK_TEXTS:
                    yield from out()
                    ids, held, n, chunk = [], [], 0, chunk + 1
        if ids:
            yield from out()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket, the table's first; one bucket of the table is held at a time."""
        parts, now, key = [], None, None
        for bucket, row in of_one_bucket(batches):
            if bucket != now:
                parts, now, key = [], bucket, None
            if row["kind"] == TABLE:
                parts.append(row)
            elif row["kind"] == TEXTS:
                yield cells([tuple(row[c] for c in CELL_NAMES)])
            elif parts:
                if key is None:
                    key = np.concatenate([of_planes(p["key"]) for p in parts])
                    order = np.argsort(key)
                    key, base, whole = key[order], *(np.concatenate([np.frombuffer(p[c]) for p in parts])[order] for c in ("base", "whole"))
                asked = of_planes(row["key"])
                place = places(asked, key)
                hit = place >= 0
                if not hit.any():
                    continue
                who, at = np.frombuffer(row["text"], np.uint16)[hit], place[hit]
                known, more_base, more_whole = summed(who, base[at], whole[at], 0)
                some = np.flatnonzero(np.bincount(who))
                known = np.pad(known, (0, len(more_base) - len(known)))
                yield cells([(bucket, SUMS, row["chunk"], some.astype(np.uint16).tobytes(), known[some].astype(np.uint32).tobytes(), more_base[some].tobytes(), more_whole[some].tobytes())])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by chunk, its texts first."""
        now = None

        def out() -> pa.RecordBatch:
            ids, null, n_tokens, n_known, base, whole, chunk = now
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), chunk, np.int64)), pa.array(np.arange(len(ids))), pa.array(ids, pa.int64(), mask=null), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(whole)],
                ["chunk", "place", "doc_id", "n_tokens", "n_known", "base_score", "score"])

        for b in slices(batches, 8):
            for row in b.to_pylist():
                if row["kind"] == TEXTS:
                    if now:
                        yield out()
                    n = len(row["base"]) // 8
                    n_tokens, n_known = np.frombuffer(row["text"], np.int64).reshape(2, n)
                    now = (np.frombuffer(row["key"], np.int64, n), np.frombuffer(row["key"], np.uint8, n, 8 * n).astype(bool), n_tokens, n_known.copy(),
                           np.frombuffer(row["base"]).copy(), np.frombuffer(row["whole"]).copy(), row["chunk"])
                else:
                    who = np.frombuffer(row["key"], np.uint16)
                    now[3][who] += np.frombuffer(row["text"], np.uint32)
                    now[4][who] += np.frombuffer(row["base"])
                    now[5][who] += np.frombuffer(row["whole"])
        if now:
            yield out()

    rows = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("body"))
    both = table.mapInArrow(part_of_table, CELLS).unionByName(rows.mapInArrow(ask, CELLS))
    answered = both.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(look_up, CELLS)
    by_chunk = answered.repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket")
    return by_chunk.mapInArrow(collect, "chunk long, place long, doc_id long, n_tokens long, n_known long, base_score double, score double")
