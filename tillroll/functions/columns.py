"""Column expressions shared by the jobs. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segment limits (prior orders per user) and their display order.
SEGMENT_LIMITS = (("nuevo", 5), ("medio", 15))
SEGMENTS = ("nuevo", "medio", "heavy")

# Words too common in item names to identify an item.
GENERIC_WORDS = (
    "organic", "original", "free", "natural", "fresh", "the", "and", "with",
    "of", "no", "all", "premium", "classic", "style", "flavor", "flavored",
    "unsweetened", "sweetened", "low", "reduced", "fat", "gluten", "non",
    "gmo", "large", "small", "mini", "value", "pack", "count", "oz", "size",
)


def segment(n_orders: Column) -> Column:
    """Segment of a user by number of prior orders."""
    (low, low_max), (mid, mid_max) = SEGMENT_LIMITS
    return (
        F.when(n_orders <= low_max, F.lit(low))
        .when(n_orders <= mid_max, F.lit(mid))
        .otherwise(F.lit(SEGMENTS[-1]))
    )


def segment_order(col: Column) -> Column:
    """1, 2, 3 for nuevo, medio, heavy; 0 for the total row, 9 for anything else."""
    out = F.when(col == "__all__", F.lit(0))
    for i, name in enumerate(SEGMENTS, 1):
        out = out.when(col == name, F.lit(i))
    return out.otherwise(F.lit(9))


def md5_key(seed: int | str, *cols: str) -> Column:
    """Hex digest that replaces random order: the same rows always come out in the same order."""
    parts = [F.col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))


def safe_ratio(num: Column, den: Column) -> Column:
    """Double division that gives NULL on a zero denominator."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total == 0, F.lit(0.0)).otherwise(F.lit(2.0) * precision * recall / total)


def name_tokens(name: Column) -> Column:
    """Distinct identifying words of an item name."""
    words = F.split(F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]+", " ")), " ")
    stop = F.array(*[F.lit(w) for w in GENERIC_WORDS])
    return F.array_except(F.filter(words, lambda w: F.length(w) > 2), stop)


def is_variant(tokens_a: Column, tokens_b: Column, minimum: int = 2) -> Column:
    """True if two token sets look like versions of one item.

    They do if they share `minimum` words, or all words of the smaller set.
    An item without identifying words is a variant of nothing.
    """
    shared = F.size(F.array_intersect(tokens_a, tokens_b))
    smaller = F.least(F.size(tokens_a), F.size(tokens_b))
    return (smaller > 0) & ((shared >= minimum) | (shared >= smaller))
