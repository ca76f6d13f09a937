"""The corpus pipeline: documents -> quality -> language -> exact copies -> near copies -> packed sequences.

Every stage reads the whole result of the stage before as written Parquet. All but the last return the columns of
documents; rows that a stage rejects are gone. Stages keep every row that they do not reject, texts unchanged.

Defined results: null and empty texts fail the quality rules. Documents may share a doc_id or have none: every row is
judged by its own text, and copies count as copies whatever their ids. Of equal rows one stays. Other columns are
carried under any name. An empty table passes through every stage and gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import exact, jaccard, language, packing, quality
from tessera.llm.queries import remainder, tokenizer
from tessera.llm.work import discard, documents, written


def _whole(docs: DataFrame) -> DataFrame:
    """Rows as one column, so that no operator's column can replace one of theirs, and the text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep."""
    judged = quality.line_first(_whole(docs))
    return _unpacked(judged.where("kept"), docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells by a sufficient margin."""
    learned = language.fit(docs.select("doc_id", "text", "lang").where(remainder(5) != 0))
    return _unpacked(language.predict(_whole(docs), learned).where("accepted"), docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact.keep_one(docs, exact.copy_groups(docs.select("doc_id", "text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect, the one with the smallest doc_id. Documents without words
    are no group. Rows that share a doc_id are told apart by their sets of shingles."""
    groups = written(jaccard.near_groups(docs.select("doc_id", "text")))
    repeated = written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")
    lost = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    several = repeated.withColumnRenamed("doc_id", "_id")
    single = row if repeated.isEmpty() else row.join(several, same, "left_anti")
    kept = single.join(lost, same, "left_anti").select("_row")
    if not repeated.isEmpty():
        kept = kept.unionByName(_of_repeated(row.join(several, same, "left_semi"), groups))
    return _unpacked(kept, docs)


def _of_repeated(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows that stay among those that share their doc_id with another: of each component that is led by such a
    row, one row of the smallest set with that doc_id; and all rows without words."""
    named = jaccard.named(rows)
    leader = groups.where((F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("cls").alias("cls"))
    same = named["cls"].eqNullSafe(leader["cls"]) & named["doc_id"].eqNullSafe(leader["component_id"])
    led = named.where("n_shingles > 0").join(leader, same, "left_semi")
    one = F.row_number().over(Window.partitionBy("doc_id", "cls").orderBy(F.xxhash64("_row")))  # a task hands on its first row only
    return led.withColumn("_k", one).where("_k = 1").select("_row").unionByName(named.where("n_shingles = 0").select("_row"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence of at most 2048 ids."""
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("packing", pack),
]

#: Compression, near copies and tokenisers are beyond SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
