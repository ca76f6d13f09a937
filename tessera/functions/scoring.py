"""Vector and score expressions, all inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = {"relevance": 0.45, "importance": 0.25, "recency": 0.20, "confidence": 0.10}
TAU_HOURS = 168.0
LAYER_BOOST = {"STM": 1.05, "MTM": 1.0, "LTM": 1.1}
RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector at length 1; null without a direction."""
    return F.when(norm(a) > 0, F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x / n))[0])


def cosine(a: Column, b: Column) -> Column:
    """0 for a missing vector, different lengths or a zero norm."""
    size = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def recency(age_hours: Column, accesses: Column, tau: float = TAU_HOURS) -> Column:
    return F.least(F.lit(1.0), F.exp(-F.greatest(age_hours, F.lit(0.0)) / tau) * (1.0 + F.log1p(accesses.cast("double"))))


def half_life(age_hours: Column, tau: float = TAU_HOURS) -> Column:
    return F.pow(F.lit(2.0), -age_hours / tau)


def composite(relevance: Column, importance: Column, recent: Column, confidence: Column) -> Column:
    w = WEIGHTS
    return clamp01(w["relevance"] * relevance + w["importance"] * importance + w["recency"] * recent + w["confidence"] * confidence)


def layer_boost(score: Column, layer: Column) -> Column:
    out = score
    for name, factor in LAYER_BOOST.items():
        out = F.when(layer == name, score * factor).otherwise(out)
    return out


def minmax(x: Column, lo: Column, hi: Column, tied: float) -> Column:
    """Min-max over a result set; ``tied`` is the value when all are equal (1 for fused ranks, 0 for BM25, 0.5 for cosine)."""
    return F.when(hi == lo, tied).otherwise((x - lo) / (hi - lo))


def rrf(rank: Column, k: int = RRF_K) -> Column:
    return F.when(rank.isNull(), 0.0).otherwise(1.0 / (k + rank))


def importance_level(x: Column) -> Column:
    return F.when(x >= 0.875, "CRITICAL").when(x >= 0.625, "HIGH").when(x >= 0.375, "NORMAL").otherwise("LOW")


def budget_split(total: Column) -> Column:
    reserve = F.least(F.lit(1024), F.floor(total / 4)).cast("long")
    third = F.floor((total - reserve) / 3).cast("long")
    return F.struct(reserve.alias("reserve"), third.alias("stm"), third.alias("mtm"), (total - reserve - 2 * third).alias("ltm"))


def legacy_recency(age_days: Column) -> Column:
    """Halves every seven days."""
    return F.exp(-age_days * math.log(2) / 7)


def legacy_composite(similarity: Column, importance: Column, recent: Column, same_session: Column) -> Column:
    return similarity + 0.2 * importance + 0.1 * recent + F.when(same_session, 0.05).otherwise(0.0)


def importance_value(level: Column) -> Column:
    return F.when(level == "CRITICAL", 1.0).when(level == "HIGH", 0.75).when(level == "NORMAL", 0.5).otherwise(0.25)


def sigmoid(x: Column) -> Column:
    """Stable for large arguments of either sign."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def value_score(importance: Column, confidence: Column) -> Column:
    return importance + 0.1 * confidence


def compress_fraction(base: Column, utilization: Column) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.greatest(base, F.least(utilization, F.lit(0.9)))))


#: Dollars for 1,000 tokens in and out, by a part of the model's name.
PRICES = (("large", 0.01, 0.03), ("small", 0.0005, 0.0015), ("mini", 0.00015, 0.0006))


def cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """0 for a model without a price."""
    out = F.lit(0.0)
    for part, a, b in reversed(PRICES):
        out = F.when(F.contains(model, F.lit(part)), tokens_in / 1000 * a + tokens_out / 1000 * b).otherwise(out)
    return out
