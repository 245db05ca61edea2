"""Exact ranks and running totals that do not need one task per group.

A plain window sorts a whole group in one task. Where a group is bounded (the items of one basket,
the aisles of one user) that is fine. Where it is not (all users of a segment, all orders of one
user, the whole catalogue) the group is cut into ordered chunks: one aggregate gives the size of
each chunk, a window over those few rows gives the offset, and the rank inside the chunk is local.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal(
    df: DataFrame,
    by: Sequence[str],
    chunk: Sequence[Column],
    order: Sequence[Column],
    rank: str,
    size: str | None = None,
    running: dict[str, str] | None = None,
) -> DataFrame:
    """Add the 1-based position of each row inside its group, ordered by (chunk, order).

    `chunk` expressions must be non-decreasing along the wanted order and must not be NULL; with
    several, each refines the one before, and none is read by a task as more than the values it has
    within one chunk of the level above. `size` adds the number of rows of the group. `running` maps
    a new column to the column whose inclusive running sum it holds.
    """
    running = running or {}
    by = list(by)
    keys = [f"_chunk{i}" for i in range(len(chunk))]
    cut = df.withColumns(dict(zip(keys, chunk)))

    sums = ["_n", *(f"_t_{dst}" for dst in running)]
    level = cut.groupBy(*by, *keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(src).alias(f"_t_{dst}") for dst, src in running.items()],
    )
    offsets = None
    for depth in range(len(keys), 0, -1):
        above, key = [*by, *keys[: depth - 1]], keys[depth - 1]
        ahead = Window.partitionBy(*above).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        before = level.select(
            *above,
            key,
            *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_{depth}") for c in sums],
            *([F.sum("_n").over(Window.partitionBy(*by)).alias(size)] if size and depth == 1 else []),
        )
        offsets = before if offsets is None else offsets.join(before, [*above, key])
        level = level.groupBy(*above).agg(*[F.sum(c).alias(c) for c in sums])
    added = lambda c: sum((F.col(f"{c}_{d}") for d in range(2, len(keys) + 1)), F.col(f"{c}_1"))
    offsets = offsets.select(
        *by,
        *keys,
        added("_n").alias("_before"),
        *([size] if size else []),
        *[added(f"_t_{dst}").alias(f"_b_{dst}") for dst in running],
    )

    local = Window.partitionBy(*by, *keys).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = cut.join(offsets, [*by, *keys]).withColumns(
        {
            rank: F.col("_before") + F.row_number().over(local),
            **{dst: F.col(f"_b_{dst}") + F.sum(src).over(upto) for dst, src in running.items()},
        }
    )
    return ranked.drop(*keys, "_before", *[f"_b_{dst}" for dst in running])


def md5_chunk(key: Column) -> Column:
    """4096 even chunks of an md5 order."""
    return F.substring(key, 1, 3)


def top_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First k rows of each group.

    The constant bound lets Spark keep at most k rows per group before the shuffle
    (WindowGroupLimit), so a group of any size reaches one task as at most k rows per input task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
