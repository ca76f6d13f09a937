"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each step looks only at rows whose group of the step before has more than one member: lengths are counted first, then
prefix hashes of the rows whose length occurs again, and full hashes are taken of rows whose length and prefix occur
again. Counting combines on the map side, so a group with a third of all rows costs one partial row for each task. Up
to ``FEW_GROUPS`` surviving groups are broadcast, so that other rows are dropped where they are read; beyond that the
digests of rows with a surviving length meet the groups in a shuffle. Text is never shuffled.

Copies of one text do not meet in one task either: groups with a thousandth or more of all copies are broadcast, and
the others are written tables, so that a join can split a large one.

Defined results: null text counts as empty text. Texts are equal when identical. Of equal texts the largest
doc_id stays; a null doc_id is smaller than any other. Rows that repeat a doc_id and its text count each in
group_size and are all flagged like that doc_id; ``keep_one`` leaves one row of them. Input columns other than doc_id
and the text are not read by ``copy_groups`` and ``decisions``, and ``keep_one`` carries them, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.work import written

PREFIX_CHARS = 256
#: Tables of up to so many short rows are broadcast (some 10 MB); the number is counted first.
FEW_GROUPS = 200_000
LARGE_SHARE = 1000


def body_of(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def some(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` whose key is in ``wanted`` (a written table); broadcast only if that is small."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= FEW_GROUPS else wanted.hint("merge"), on, "left_semi")


def copy_groups(docs: DataFrame, text: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """(sha256, group_size, keep_id, n_keep) of every text that occurs at least twice; n_keep: rows of it with keep_id."""
    body = body_of(text)
    sized = docs.select("doc_id", body.alias("body"), F.octet_length(body).alias("len"))
    lengths = written(sized.groupBy("len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len"))
    prefixed = some(sized, lengths, ["len"]).withColumn("prefix", F.xxhash64(F.left("body", F.lit(prefix_chars))))
    pairs = written(prefixed.groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len", "prefix"))
    if pairs.count() <= FEW_GROUPS:
        alive = prefixed.join(F.broadcast(pairs), ["len", "prefix"], "left_semi")
        hashed = alive.select("doc_id", F.sha2("body", 256).alias("sha256"))
    else:
        hashed = prefixed.select("doc_id", "len", "prefix", F.sha2("body", 256).alias("sha256")).join(pairs, ["len", "prefix"], "left_semi")
    by_id = hashed.groupBy("sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = by_id.groupBy("sha256").agg(F.sum("n").alias("group_size"), F.max(F.struct("doc_id", "n")).alias("x"))
    return written(groups.where("group_size > 1").select("sha256", "group_size", F.col("x.doc_id").alias("keep_id"), F.col("x.n").alias("n_keep")))


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (with text_sha256) plus group_size, keep_id and n_keep of their group, null for a text that is alone."""
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    large = F.col("group_size") * LARGE_SHARE >= total
    few = F.broadcast(groups.where(large).select(F.col("sha256").alias("text_sha256"), F.struct("group_size", "keep_id", "n_keep").alias("_hot")))
    rest = groups.where(~large).select(F.col("sha256").alias("_key"), F.struct("group_size", "keep_id", "n_keep").alias("_cold"))
    marked = rows.join(few, "text_sha256", "left")  # at most LARGE_SHARE rows
    settled = F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string"))  # spread, and in no group
    keyed = marked.withColumn("_key", F.when(F.col("_hot").isNotNull(), settled).otherwise(F.col("text_sha256")))
    found = F.coalesce("_hot", "_cold")
    joined = keyed.join(F.broadcast(rest) if rest.count() <= FEW_GROUPS else rest, "_key", "left")
    return joined.withColumns({c: found.getField(c) for c in ("group_size", "keep_id", "n_keep")}).drop("_key", "_hot", "_cold")


def decisions(docs: DataFrame, groups: DataFrame, text: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select("doc_id", F.sha2(body_of(text), 256).alias("text_sha256"))
    joined = with_groups(rows, groups)
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256",
    )


def keep_one(docs: DataFrame, groups: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", F.sha2(body_of(text), 256).alias("text_sha256"))
    left = with_groups(rows, groups).where("group_size is null or keep_id <=> doc_id")
    several = F.coalesce("n_keep", F.lit(1)) > 1
    one = F.row_number().over(Window.partitionBy("text_sha256").orderBy(F.xxhash64("_row")))  # a task hands on its first row only
    firsts = left.where(several).withColumn("_k", one).where("_k = 1").select("_row")
    out = left.where(~several).select("_row").unionByName(firsts)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
