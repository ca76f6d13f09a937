"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of labelled text. A text is compressed whole, block
by block, with every dictionary; the language with the smallest total wins. A narrow margin to the second is a
rejection.

Fitting reads a bounded sample: for each language the rows with the smallest hash of doc_id, whole texts, until there
are ``SAMPLE_ROWS`` rows or ``DICTIONARY_BYTES`` bytes; a dictionary holds ``DICTIONARY_BYTES`` bytes of them. Rows that
share a doc_id are ordered by their text, so the sample is the same in every run. Every language of the labelled rows is
learned; samples are read, and texts compressed, for ``LANGUAGES_AT_ONCE`` languages at a time. Prediction reads whole
texts, needs no shuffle, and never looks at lang, source or doc_id.

Defined results: null text and text without a letter are ``und`` with score 0 and are not accepted. Ties go to the
language that sorts first. With one learned language every text with a letter is that language with score 1; with
none every text is ``und``. Repeated rows are predicted one by one; an empty table gives an empty table. Columns other
than the text are carried through under any name; those named like the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tessera.llm.tokens import shipped, slices
from tessera.llm.work import written

SAMPLE_ROWS = 128
LANGUAGES_AT_ONCE = 64
DICTIONARY_BYTES = 1 << 17
BLOCK_BYTES = 1 << 12
LEVEL = 6
#: (second - best) / second below this is a rejection.
MIN_MARGIN = 0.01
NONE = "und"


_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """What is compressed: lower case, each run of anything but letters as one space."""
    return _OTHER.sub(" ", text.lower()).encode()


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """language -> dictionary content, from rows (doc_id, text, lang)."""
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    names = sorted(r[lang] for r in usable.select(lang).distinct().collect())
    order = Window.partitionBy(lang).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64(text), text)
    ranked = usable.select(lang, "doc_id", text).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= SAMPLE_ROWS)
    before = F.sum(F.octet_length(text)).over(Window.partitionBy(lang).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))
    chosen = ranked.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < DICTIONARY_BYTES)
    chosen = chosen.select(lang, "_k", F.left(text, F.lit(DICTIONARY_BYTES)).alias("body"))
    parts = blocks(names)
    if len(parts) > 1:
        chosen = written(chosen)
    learned = {}
    for part in parts:
        rows = chosen.where(F.col(lang).isin(part)).collect()  # at most SAMPLE_ROWS * LANGUAGES_AT_ONCE
        learned |= {
            n: b" ".join(letters(r["body"]) for r in sorted((r for r in rows if r[lang] == n), key=lambda r: -r["_k"]))[-DICTIONARY_BYTES:]
            for n in part
        }
    return learned


def blocks(names: list[str]) -> list[list[str]]:
    return [names[i : i + LANGUAGES_AT_ONCE] for i in range(0, len(names), LANGUAGES_AT_ONCE)]


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.dictionaries = dictionaries
        self.kept = None

    def encoders(self, names: list[str]) -> list:
        """Made once where all languages are one block; else a block's encoders are gone before the next."""
        import zstandard as z

        if self.kept is not None:
            return self.kept
        made = []
        for n in names:
            content = z.ZstdCompressionDict(self.dictionaries[n], dict_type=z.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            made.append(z.ZstdCompressor(dict_data=content, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        if len(names) == len(self.names):
            self.kept = made
        return made

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        usable = [i for i, t in enumerate(texts) if self.names and t and any(map(str.isalpha, t))]
        found = [(NONE, 0.0, False)] * len(texts)
        if len(self.names) == 1:
            for i in usable:
                found[i] = (self.names[0], 1.0, True)
            return found
        sizes = {i: [] for i in usable}
        for part in blocks(self.names) if usable else []:
            encoders = self.encoders(part)
            for i in usable:
                data = letters(texts[i])
                pieces = [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]
                sizes[i] += [sum(len(e.compress(b)) for b in pieces) for e in encoders]
        for i in usable:
            found[i] = self.verdict(sizes[i])
        return found

    def verdict(self, sizes: list[int]) -> tuple[str, float, bool]:
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        margin = (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]]
        return self.names[order[0]], margin, margin >= MIN_MARGIN


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` plus lang_pred, score and accepted."""
    made = ["lang_pred", "score", "accepted"]
    kept = [c for c in shipped(docs).columns if c not in made]
    body = F.col(f"`{text}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), body.alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dictionaries)
        for b in slices(batches):
            found = classify(b.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                ["row", *made])

    schema = StructType([rows.schema["row"], StructField(made[0], StringType()), StructField(made[1], DoubleType()), StructField(made[2], BooleanType())])
    judged = rows.mapInArrow(run, schema)
    return judged.select(*[F.col("row").getField(c).alias(c) for c in kept], *made)
