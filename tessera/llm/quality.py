"""Quality rules by line-first cleaning (native: DataFrame functions only).

Every line is judged by punctuation, navigation and boilerplate rules; lines that fail are removed, and a
document that loses too large a share of its words is rejected. All work is inside one row, so there is no
shuffle at any size.

Defined results: a null or empty text has no words, so it fails the base rules and is not kept. A very long
text is read whole. Repeated rows are judged one by one. Columns of the input other than ``text`` are carried
through; a clashing name is replaced by the operator's column. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line of at least so many words is judged by its punctuation.
MIN_LINE_WORDS = 3
#: Symbols or exclamation marks a word from which a line is not prose.
MAX_MARKS_PER_WORD = 0.3
#: Share of a document's words that cleaning may remove.
MAX_LOST = 0.5
#: A line that holds one of these phrases, in any case, is boilerplate.
BOILERPLATE = (
    "licensed under the", "all rights reserved", "copyright (c)", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "subscribe to our", "click here", "enable javascript", "lorem ipsum",
)
#: A line of at most so many words that is one of these labels is navigation.
MAX_NAVIGATION_WORDS = 3
NAVIGATION = (
    r"(?i)^\s*(home|menu|login|log in|sign in|sign up|next|previous|back to top|skip to content|share|read more)"
    r"\s*[.:>]*\s*$"
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def holds_phrase(text: Column) -> Column:
    return let(F.lower(text), lambda low: reduce(or_, [F.contains(low, F.lit(p)) for p in BOILERPLATE]))


def line_fails(x: Column, phrases: Column) -> Column:
    """Punctuation (too many symbols or exclamation marks), navigation and boilerplate rules; ``phrases``: whether
    the whole text holds a boilerplate phrase at all."""
    line, n = x["line"], x["n"]
    punctuation = (n >= MIN_LINE_WORDS) & (
        (x["symbols"] >= MAX_MARKS_PER_WORD * n)
        | (F.length(line) - F.length(F.replace(line, F.lit("!"), F.lit(""))) >= MAX_MARKS_PER_WORD * n)
    )
    navigation = (n <= MAX_NAVIGATION_WORDS) & line.rlike(NAVIGATION)
    return punctuation | navigation | (phrases & holds_phrase(line))


def repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more (windows are compared by a 64-bit hash)."""

    def covered(windows: Column) -> Column:
        def of(order: Column) -> Column:
            last = F.size(order) - 1
            again = F.filter(
                order,
                lambda x, j: ((j > 0) & (F.get(order, j - 1)["h"] == x["h"]))
                | ((j < last) & (F.get(order, j + 1)["h"] == x["h"])),
            )
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(F.sort_array(pairs), of))

    def windows(w: Column) -> Column:
        return F.transform(
            F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda third, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), third),
        )

    return F.when(F.size(words) < 4, 0).otherwise(let(windows(words), covered))


def line_first(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_removed_lines,
    n_removed_words, base_failed, kept and clean_text (the lines that pass, in order)."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_removed_lines",
            "n_removed_words", "base_failed", "kept", "clean_text"]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(
        F.transform(F.split(body, "\n", -1), lambda x: F.struct(
            x.alias("line"), F.size(words_of(x)).alias("n"),
            F.length(F.regexp_replace(x, f"[^{SYMBOLS}]+", "")).alias("symbols"))),
        lambda x: x["n"] > 0,
    )
    judged = let(holds_phrase(body), lambda phrases: F.transform(lines, lambda x: x.withField("fails", line_fails(x, phrases))))
    summary = let(
        judged,
        lambda a: F.struct(
            F.size(a).alias("n_lines"),
            (F.size(a) - F.size(F.array_distinct(F.transform(a, lambda x: x["line"])))).alias("n_dup_lines"),
            F.aggregate(a, F.lit(0), lambda s, x: s + x["symbols"]).alias("n_symbols"),
            F.size(F.filter(a, lambda x: x["fails"])).alias("n_removed_lines"),
            F.aggregate(a, F.lit(0), lambda s, x: s + F.when(x["fails"], x["n"]).otherwise(0)).alias("n_removed_words"),
            F.concat_ws("\n", F.transform(F.filter(a, lambda x: ~x["fails"]), lambda x: x["line"])).alias("clean_text"),
        ),
    )
    repeats = let(words_of(body), lambda w: F.struct(
        F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
    kept = [c for c in docs.columns if c not in made]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), summary.alias("_s"), repeats.alias("_r"))
    failed = (F.col("_r.n_words") < MIN_WORDS) | (100 * F.col("_r.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_r.n_words"))
    long = lambda c: F.col(c).cast("long")
    return out.select(
        *[F.col("_row").getField(c).alias(c) for c in kept],
        long("_r.n_words").alias("n_words"), long("_r.word_chars").alias("word_chars"), long("_s.n_symbols").alias("n_symbols"),
        long("_s.n_dup_lines").alias("n_dup_lines"), long("_r.n_repeat_words").alias("n_repeat_words"),
        long("_s.n_lines").alias("n_lines"), long("_s.n_removed_lines").alias("n_removed_lines"),
        long("_s.n_removed_words").alias("n_removed_words"), failed.alias("base_failed"),
        (~failed & (F.col("_s.n_removed_words") <= MAX_LOST * F.col("_r.n_words"))).alias("kept"),
        F.col("_s.clean_text").alias("clean_text"),
    )
