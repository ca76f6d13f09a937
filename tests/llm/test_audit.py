"""The filter audit against removal one filter after another, document by document."""

import collections
import itertools
import re

from tessera.llm import audit

LONG = " ".join(f"w{i}" for i in range(250))
DOCS = [(1, None, "a"), (2, "", None), (3, LONG, "a"), (4, LONG, "a"), (4, LONG, "a"), (5, LONG + " #", "b"), (6, "THE " * 300, "b"), (7, "x y x y x", ""),
        (8, "é" * 400 + " ÀÉ", None), (9, "same words here", "b"), (10, "same words here", "c"), (None, "same words here", "c"), (11, LONG + "\x85|", "c"), (12, "x " * 30000, "a")]
LABELS = [(1, 1, 0), (3, 1, 1), (4, 0, 1), (4, 1, 0), (5, None, 1), (10, 1, None), (None, 1, 1), (12, 1, 0), (99, 1, 1)]


def fails(doc_id, text, table):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in table)}


def brute_force(table, labels):
    good, bad = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    rows, total = {}, collections.Counter()
    for part in {p or "" for _, _, p in table}:
        mine = [(d, fails(d, t, table)) for d, t, p in table if (p or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for i, f in enumerate(order):
                out = [d for d, x in left if x[f]]
                kept = [(d, x) for d, x in left if not x[f]]
                total[part, f] += len(out)
                rows[part, order, i + 1] = [len(kept), len(out), sum(x[f] for _, x in mine) - len(out), sum(x[f] and sum(x.values()) == 1 for _, x in mine),
                                            sum(d in good for d in out), sum(d in bad for d in out)]
                left = kept
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def test_equals_removal_in_every_order(spark):
    docs = spark.createDataFrame([(*d, "mine", 7) for d in DOCS], "doc_id long, text string, source string, part string, mask long")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = audit.audit(docs, labels).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in rows} == brute_force(DOCS, LABELS)
    assert len(rows) == 600 * 4


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert all(r["good_lost"] == r["toxic_lost"] == 0 for r in audit.audit(docs, labels.limit(0)).collect())


def test_copies_of_a_large_share(spark):
    """Two thirds of all rows are one text in many parts: only the smallest doc_id of them passes filter E."""
    table = [(i, "hot" if i % 3 else f"text {i}", f"s{i % 50}") for i in range(3000)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    masked = audit.masks(docs).where(f"mask & {audit.REPEATS} = 0 and doc_id % 3 != 0")
    assert [r["doc_id"] for r in masked.collect()] == [1]
