"""Filter interaction audit by a subset-zeta transform.

Each document fails some of the filters; the bits of its mask say which. Masks are counted per part, with the documents
of good quality and the toxic ones counted beside them. A zeta transform over the subsets of filters then turns the counts
of a part into survivors: how many documents fail none of a subset. Every order of the filters is a walk over
subsets, so what a step removes is the difference between two neighbouring subsets, and likewise for the labelled
documents. Work after the count depends on the number of parts only, and texts are read once and never shuffled.

Defined results: a null text is empty and has no words; a null part is the empty string. A document repeats another if
its text is that of a smaller doc_id; rows that share doc_id and text do not repeat each other, and a null doc_id is
neither smaller nor larger than another. Of labels that share a doc_id one with value 1 suffices; a document without
labels, or with a null doc_id, is neither good nor toxic. Repeated rows count one by one. Other columns are not read,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.exact import body_of, with_groups
from tessera.llm.quality import let, words_of
from tessera.llm.work import written

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
SYMBOLS = "[#$%&*|]"
REPEATS = 1 << FILTERS.index("E")


def own_failures(body: Column) -> Column:
    """Bits of the filters that look at one text only: A, B, C and D."""
    n_words, distinct = (let(words_of(body), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[c] for c in "nd")
    capitals = F.length(F.regexp_replace(body, "[^A-Z]+", ""))
    fails = {"A": n_words < MIN_WORDS, "B": 100 * distinct < MIN_DISTINCT_PERCENT * n_words,
             "C": 100 * capitals > MAX_CAPITALS_PERCENT * F.length(body), "D": body.rlike(SYMBOLS)}
    return reduce(Column.bitwiseOR, [F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in fails.items()])


def masks(docs: DataFrame, part: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, part, mask) of every row: the bits of the filters that it fails."""
    body = body_of(text)
    rows = written(docs.select(
        "doc_id", F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), own_failures(body).alias("mask"), F.sha2(body, 256).alias("text_sha256")))
    # the same shape as the groups of exact dedup, whose join splits large groups; the row that stays is the smallest
    groups = written(rows.groupBy(F.col("text_sha256").alias("sha256")).agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("keep_id"))
                     .where("group_size > 1").withColumn("n_keep", F.lit(1).cast("long")))
    repeats = F.when(F.col("doc_id") > F.col("keep_id"), REPEATS).otherwise(0)
    return with_groups(rows, groups).select("doc_id", "part", F.col("mask").bitwiseOR(repeats).alias("mask"))


def counts(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, counts): for each mask, in order, a struct of all documents, the good ones and the toxic ones."""
    one = F.lit(1).cast("long")
    flag = lambda c: F.max((F.col(c) == 1).cast("int"))
    marks = written(labels.groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("bad")))
    marked = masked.join(marks, "doc_id", "left")
    sums = [F.count(one).alias("n"), F.count(F.when(F.col("good") == 1, one)).alias("good"), F.count(F.when(F.col("bad") == 1, one)).alias("toxic")]
    by_mask = marked.groupBy("part", "mask").agg(*sums)
    of = lambda m, c: F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0))
    cells = [F.struct(*[of(m, c).alias(c) for c in ("n", "good", "toxic")]) for m in range(1 << len(FILTERS))]
    return by_mask.groupBy("part").agg(F.array(*cells).alias("counts"))


def survivors(cells: Column) -> Column:
    """For each subset of filters (its bits are the index), the documents that fail none of them. The sums over all
    subsets of an index take one pass for each bit, in which an index with the bit adds that without it; documents that
    fail nothing but filters of T survive all filters outside T, so the sums in reverse are the survivors."""
    def passed(a: Column, bit: int) -> Column:
        return F.transform(a, lambda x, i: F.when(i.bitwiseAND(F.lit(bit)) == 0, x).otherwise(
            F.struct(*[(x[c] + F.get(a, i.bitwiseXOR(F.lit(bit)))[c]).alias(c) for c in ("n", "good", "toxic")])))

    return F.reverse(reduce(lambda c, i: let(c, lambda a: passed(a, 1 << i)), range(len(FILTERS)), cells))


def walks() -> Column:
    """Every order and step: the order, the step, its filter's bit and the bits of the filters before it."""
    every = []
    for order in permutations(FILTERS):
        bits = [1 << FILTERS.index(f) for f in order]
        every += [f"named_struct('filter_order', '{''.join(order)}', 'step', {i + 1}, 'bit', {bits[i]}, 'before', {sum(bits[:i])})" for i in range(len(bits))]
    return F.expr(f"array({', '.join(every)})")


def shapley(s: Column, bit: Column) -> Column:
    """A filter's removals over all orders: each set of filters before it counts as often as orders begin with it."""
    last = len(FILTERS) - 1
    orders = F.array(*[F.lit(factorial(k) * factorial(last - k)) for k in range(last + 1)])
    others = F.filter(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1)), lambda x: x.bitwiseAND(bit) == 0)
    gone = lambda x: F.get(s, x)["n"] - F.get(s, x.bitwiseOR(bit))["n"]
    return F.aggregate(others, F.lit(0).cast("long"), lambda a, x: a + F.get(orders, F.bit_count(x)) * gone(x))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text") -> DataFrame:
    """One row a part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley."""
    every = (1 << len(FILTERS)) - 1
    alive = counts(masks(docs, part, text), labels).select("part", survivors(F.col("counts")).alias("s"))
    filters = F.array(*[F.struct(F.lit(1 << i).alias("bit"), shapley(F.col("s"), F.lit(1 << i)).alias("n")) for i in range(len(FILTERS))])
    by_part = written(alive.withColumn("shapley", filters))
    w = by_part.withColumn("w", F.explode(walks()))
    at = lambda x, c="n": F.get("s", x)[c]
    bit, before = F.col("w.bit"), F.col("w.before")
    after = before.bitwiseOR(bit)
    removed = at(before) - at(after)
    return w.select(
        "part", "w.filter_order", "w.step", at(after).alias("kept"), removed.alias("removed"), (at(F.lit(0)) - at(bit) - removed).alias("redundant"),
        (at(bit.bitwiseXOR(F.lit(every))) - at(F.lit(every))).alias("unique_fails"), (at(before, "good") - at(after, "good")).alias("good_lost"),
        (at(before, "toxic") - at(after, "toxic")).alias("toxic_lost"), F.filter("shapley", lambda x: x["bit"] == bit)[0]["n"].alias("shapley"))
