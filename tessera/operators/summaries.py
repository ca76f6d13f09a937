"""Extractive summaries of many texts in one plan, without a shuffle: the words of a text are sorted and counted inside its
row, and the choice under a token budget is one pass over its ranked sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import let

#: Words that do not count, where a sentence ends, and what a word is.
STOP_WORDS = (
    "a an the and or but if while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will "
    "just don should now is are was were be been being have has had do does did i you he she it we they them this that these those my your his her its our their "
    "what which who whom me him us as").split()
SENTENCE_END = r"([.!?])\s+([A-Z(\"\[])"
WORD = "[a-z][a-z0-9'-]*"
CHARS_PER_TOKEN = 4
#: What the first sentence gains over the last.
EARLY = 0.15
MARK = "\u0001"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def truncated(text: Column, max_tokens: int) -> Column:
    """The text, cut at four characters a token if it has too many words."""
    if max_tokens <= 0:
        return F.lit("")
    cut = F.concat(F.regexp_replace(F.left(text, F.lit(max_tokens * CHARS_PER_TOKEN)), r"\s+$", ""), F.lit("…"))
    return F.when(F.size(words_of(text)) <= max_tokens, text).otherwise(cut)


def chosen(ranked: Column, max_tokens: int) -> Column:
    """Places of the sentences that are taken: the best first while they fit; longer ones are passed over, and a spent budget
    ends the list. ``ranked``: structs of cost and i, best first."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("taken"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["used"] < max_tokens) & ((F.size(a["taken"]) == 0) | (a["used"] + x["cost"] <= max_tokens))
        return F.when(fits, F.struct((a["used"] + x["cost"]).alias("used"), F.concat(a["taken"], F.array(x["i"])).alias("taken"))).otherwise(a)

    return F.aggregate(ranked, start, step, lambda a: a["taken"])


def runs(sorted_values: Column, key: Callable[[Column], Column]) -> Column:
    """Places of equal keys in a sorted array: structs of at (from 0) and n."""
    n = F.size(sorted_values)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    first = F.filter(places, lambda k: (k == 0) | (key(F.get(sorted_values, k - 1)) != key(F.get(sorted_values, k))))
    return let(first, lambda f: F.transform(f, lambda at, r: F.struct(at.alias("at"), (F.coalesce(F.get(f, r + 1), n) - at).cast("long").alias("n"))))


def part(values: Column, run: Column) -> Column:
    return F.slice(values, run["at"] + 1, run["n"].cast("int"))


def summary_of(found: Column, max_tokens: int) -> Column:
    """The summary of the sentences of one text: words are sorted within the row, so that equal ones lie together."""
    counts = lambda s: F.filter(F.regexp_extract_all(F.lower(s), F.lit(WORD), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    said = F.array_sort(F.flatten(F.transform(found, lambda s, i: F.transform(counts(s), lambda w: F.struct(w.alias("word"), i.alias("i"))))))

    def shared(words: Column, same: Column) -> Column:
        """Of each countable word its sentence and how often the text has it, and the most that it has of any: (most, by sentence)."""
        by = F.array_sort(F.flatten(F.transform(same, lambda r: F.transform(part(words, r), lambda x: F.struct(x["i"].alias("i"), r["n"].alias("count"))))))
        return F.struct(F.array_max(F.transform(same, lambda r: r["n"])).alias("most"), by.alias("by"))

    def ranked(most: Column, by: Column) -> Column:
        total = lambda r: F.aggregate(part(by, r), F.lit(0).cast("long"), lambda a, x: a + x["count"])
        weight = let(runs(by, lambda x: x["i"]), lambda rs: F.map_from_entries(F.transform(rs, lambda r: F.struct(F.get(by, r["at"])["i"], total(r) / most / F.sqrt(r["n"])))))
        return let(weight, lambda m: F.array_sort(F.transform(found, lambda s, i: F.struct(
            (-F.round(F.coalesce(F.element_at(m, i), F.lit(0.0)) + EARLY * (1 - i / F.greatest(F.lit(1), F.size(found) - 1)), 9)).alias("s"), i.alias("i"), F.size(words_of(s)).alias("cost")))))

    scored = let(said, lambda words: let(runs(words, lambda x: x["word"]), lambda same: let(shared(words, same), lambda x: F.when(F.size(words) > 0, ranked(x["most"], x["by"])))))
    taken = let(scored, lambda r: F.when(r.isNotNull(), F.array_sort(chosen(r, max_tokens))))
    return let(taken, lambda t: F.when(t.isNotNull(), F.array_join(F.transform(t, lambda i: F.get(found, i)), " ")).otherwise(truncated(F.array_join(found, " "), max_tokens)))


def summaries(texts: DataFrame, max_tokens: int = 500) -> DataFrame:
    """(id, summary) of each (id, text). A sentence scores by how frequent its words are in the text and by how early it
    comes. A text without countable words is cut where its budget ends. All work is inside the row."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), MARK, " "), SENTENCE_END, f"$1{MARK}$2")
    split = F.filter(F.transform(F.split(marked, MARK), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return texts.select("id", F.coalesce(let(split, lambda found: summary_of(found, max_tokens)), F.lit("")).alias("summary"))
