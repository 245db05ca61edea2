"""New-item candidates per user from aisle affinity, department affinity and global popularity."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import ordinal, safe_ratio, top_per_group


@dataclass(frozen=True)
class Limits:
    """List sizes of each step."""

    minimum: int = 20
    full_list: int = 10
    aisles: int = 3
    departments: int = 2
    per_aisle: int = 30
    per_department: int = 40
    global_pool: int = 100
    fallback_pool: int = 1000
    from_aisles: int = 35
    from_departments: int = 25
    from_global: int = 40


LIMITS = Limits()
# Rows that one task sorts or aggregates, where tables are so dense that splits by bytes are too large.
ROWS_PER_TASK = 1_000_000


def _tasks(df: DataFrame, rows: int) -> int:
    """Partitions for `rows` rows: what the session has, and more where a task would get too many."""
    spark = df.sparkSession
    usual = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(usual, math.ceil(rows / ROWS_PER_TASK))


def working_users(users: DataFrame, limit: int | None = None) -> DataFrame:
    """All users, or the first `limit` by id for a pilot."""
    return users if limit is None else users.orderBy("user_id").limit(limit)


def working_interactions(interactions: DataFrame, users: DataFrame) -> DataFrame:
    return interactions.join(users.select("user_id"), "user_id", "left_semi")


def item_score(items: DataFrame) -> DataFrame:
    """70 % log sales over the best seller's, 30 % reorder rate."""
    sales = F.ln(F.lit(1) + F.col("cantidad_compras"))
    top = items.agg(F.max(sales)).scalar()
    return items.select(
        "product_id",
        "aisle_id",
        "department_id",
        (
            F.lit(0.70) * safe_ratio(sales, top)
            + F.lit(0.30) * F.coalesce("reorder_rate_producto", F.lit(0.0))
        ).alias("score_producto"),
    )


def rank_items(scores: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Rank of each item in its aisle, its department and overall, cut to the ranks in use.

    Chunks of the score, and of the ids of items with the same score, keep every sort small, whatever
    the size of the catalogue or of one aisle, and however many items were never sold.
    """
    score = -F.coalesce("score_producto", F.lit(-1.0))
    chunks = [F.floor(score * 4096), score, F.floor(F.col("product_id") / 4096)]
    order = [F.desc("score_producto"), F.col("product_id")]
    ranked = scores
    for name, by in (
        ("rank_pasillo", ["aisle_id"]),
        ("rank_departamento", ["department_id"]),
        ("rank_global", []),
    ):
        ranked = ordinal(ranked, by, chunks, order, rank=name)
    return ranked.where(
        (F.col("rank_pasillo") <= limits.per_aisle)
        | (F.col("rank_departamento") <= limits.per_department)
        | (F.col("rank_global") <= limits.fallback_pool)
    ).select("product_id", "aisle_id", "department_id", "score_producto",
             "rank_pasillo", "rank_departamento", "rank_global")


def affinities(interactions: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The user's top aisles and departments with their share of the user's purchases.

    Purchases are summed by user, aisle and department first. What is left is moved once, by user;
    the two totals and both rankings then need no further shuffle and see at most one row per
    category.
    """
    base = (
        interactions.groupBy("user_id", "aisle_id", "department_id")
        .agg(F.sum("freq_usuario_producto").alias("n"))
        .repartition("user_id")
    )
    user = Window.partitionBy("user_id")

    def strongest(level: str, top: int, source: str) -> DataFrame:
        sums = base.groupBy("user_id", level).agg(F.sum("n").alias("n"))
        share = sums.withColumn(
            "afinidad", F.col("n").cast("double") / F.sum("n").over(user)
        )
        return top_per_group(share, ["user_id"], [F.desc("n"), F.col(level)], top, "pos").select(
            "user_id", level, "afinidad", F.lit(source).alias("fuente")
        )

    aisles = strongest("aisle_id", limits.aisles, "pasillo")
    departments = strongest("department_id", limits.departments, "departamento")
    return aisles.unionByName(departments, allowMissingColumns=True).select(
        "user_id", "aisle_id", "department_id", "afinidad", "fuente"
    )


def _preselect(
    affinity: DataFrame, ranked: DataFrame, level: str, source: str, weight: float,
    keep_rank: Column, top: int, per_group: int,
) -> DataFrame:
    """The best items of each user's categories.

    The few categories of a user move, not the up to `per_group` items that each of them brings: the
    users are dealt over tasks before the join, which multiplies the rows, and no task gets more users
    than it can sort the items of.
    """
    liked = affinity.where(F.col("fuente") == source).select("user_id", level, "afinidad")
    liked = liked.repartition(_tasks(liked, liked.count() * per_group), "user_id")
    items = ranked.where(keep_rank).select(level, "product_id", "score_producto")
    scored = liked.join(items, level).select(
        "user_id",
        "product_id",
        (F.lit(weight) * F.col("afinidad") + F.lit(1 - weight) * F.col("score_producto")).alias(
            "score"
        ),
    )
    return top_per_group(
        scored, ["user_id"], [F.desc("score"), F.col("product_id")], top, "pos"
    ).select("user_id", "product_id", "score", F.lit(source).alias("fuente"))


def preselect_aisle(affinity: DataFrame, ranked: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    return _preselect(
        affinity, ranked, "aisle_id", "pasillo", 0.60,
        F.col("rank_pasillo") <= limits.per_aisle, limits.from_aisles, limits.per_aisle,
    )


def preselect_department(
    affinity: DataFrame, ranked: DataFrame, limits: Limits = LIMITS
) -> DataFrame:
    return _preselect(
        affinity, ranked, "department_id", "departamento", 0.50,
        F.col("rank_departamento") <= limits.per_department, limits.from_departments, limits.per_department,
    )


def preselect_global(users: DataFrame, ranked: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The best items overall, the same for every user: one short array exploded per user."""
    keep = min(limits.global_pool, limits.from_global)
    top = ranked.where(F.col("rank_global") <= keep).select(
        F.collect_list(
            F.struct("product_id", (F.lit(0.35) * F.col("score_producto")).alias("score"))
        )
    )
    return users.select("user_id", F.explode(top.scalar()).alias("x")).select(
        "user_id", "x.product_id", "x.score", F.lit("global").alias("fuente")
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def exclude_bought(preselected: DataFrame, interactions: DataFrame) -> DataFrame:
    """Preselected rows the user has not bought. Runs after preselection: users lose places."""
    return preselected.join(
        interactions.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti"
    )


def _found(names: tuple[str, ...]) -> tuple[list[Column], Column]:
    """Aggregates that mark which sources proposed a pair, and the marked names joined by +.

    The marks are numbers: an aggregate of strings would have to sort its rows, one of numbers hashes them.
    """
    marks = [F.max(F.when(F.col("fuente") == n, F.lit(1))).alias(f"_en_{n}") for n in names]
    joined = F.concat_ws("+", *[F.when(F.col(f"_en_{n}") == 1, F.lit(n)) for n in names])
    return marks, joined.alias("fuentes")


def dedupe_sources(rows: DataFrame) -> DataFrame:
    """Best score per user and item, and the names of the sources that proposed it."""
    marks, joined = _found(("departamento", "global", "pasillo", "respaldo"))
    found = rows.groupBy("user_id", "product_id").agg(F.max("score").alias("score_candidate"), *marks)
    return found.select("user_id", "product_id", "score_candidate", joined)


def new_and_deduped(preselected: DataFrame, interactions: DataFrame, rows: int | None = None) -> DataFrame:
    """`exclude_bought` and `dedupe_sources` in one shuffle.

    History rows travel with the proposals to the same (user, item) aggregate, which drops every
    pair that has one. `rows` is how many rows come in, about: with it they are dealt over as many tasks
    as they need before they are aggregated, whatever the number of files they are read from.
    """
    known = interactions.select(
        "user_id", "product_id", F.lit(None).cast("double").alias("score"),
        F.lit("historial").alias("fuente"),
    )
    marks, joined = _found(("departamento", "global", "pasillo"))
    both = preselected.unionByName(known)
    if rows is not None:
        both = both.repartition(_tasks(both, rows), "user_id", "product_id")
    return (
        both.groupBy("user_id", "product_id")
        .agg(
            F.max("score").alias("score_candidate"),
            *marks,
            F.max((F.col("fuente") == "historial").cast("int")).alias("bought"),
        )
        .where("bought = 0")
        .select("user_id", "product_id", "score_candidate", joined)
    )


def _candidate_order() -> list[Column]:
    return [F.desc("score_candidate"), F.col("product_id")]


def rank_candidates(unique: DataFrame) -> DataFrame:
    """Score descending, item ascending. A user has at most 100 proposals here."""
    w = Window.partitionBy("user_id").orderBy(*_candidate_order())
    return unique.withColumn("candidate_rank", F.row_number().over(w))


def user_quota(users: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Places per user: the minimum, and more for users with a short history."""
    return users.select(
        "user_id",
        (
            F.lit(limits.minimum)
            + F.greatest(F.lit(limits.full_list) - F.col("productos_distintos"), F.lit(0))
        ).alias("objetivo"),
    )


def quota(users: DataFrame, unique: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Places per user and how many of them the proposals fill."""
    available = unique.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return user_quota(users, limits).join(available, "user_id", "left").select(
        "user_id",
        "objetivo",
        F.least(F.coalesce("n", F.lit(0)), F.col("objetivo")).alias("disponibles"),
    )


def fallback(
    quotas: DataFrame, ranked: DataFrame, unique: DataFrame, interactions: DataFrame,
    limits: Limits = LIMITS,
) -> DataFrame:
    """Best global items for users short of their quota, without bought or proposed ones.

    A user short by d who already has b items of the global pool finds the missing ones among the
    first d + b ranks, so only those are looked at.
    """
    short = quotas.where("disponibles < objetivo").select(
        "user_id", (F.col("objetivo") - F.col("disponibles")).alias("missing")
    )
    pool = ranked.where(F.col("rank_global") <= limits.fallback_pool).select(
        "product_id", "rank_global", "score_producto"
    )
    taken = (
        interactions.select("user_id", "product_id")
        .unionByName(unique.select("user_id", "product_id"))
        .join(short.select("user_id"), "user_id", "left_semi")
        .join(pool.select("product_id"), "product_id", "left_semi")
        .distinct()
    )
    held = taken.groupBy("user_id").agg(F.count(F.lit(1)).alias("held"))
    depth = F.least(
        F.lit(limits.fallback_pool), F.col("missing") + F.coalesce("held", F.lit(0))
    ).cast("int")
    reach = short.join(held, "user_id", "left").select(
        "user_id", "missing", F.explode(F.sequence(F.lit(1), depth)).alias("rank_global")
    )
    free = reach.join(pool, "rank_global").join(
        taken, ["user_id", "product_id"], "left_anti"
    )
    w = Window.partitionBy("user_id").orderBy("rank_global")
    return (
        free.withColumn("pos", F.row_number().over(w))
        .where("pos <= missing")
        .select(
            "user_id",
            "product_id",
            (F.lit(0.20) * F.col("score_producto")).alias("score_candidate"),
            F.lit("respaldo").alias("fuentes"),
        )
    )


def final_candidates(
    unique: DataFrame, extra: DataFrame, users: DataFrame, limits: Limits = LIMITS, checks: bool = False
) -> DataFrame:
    """Proposals and fallback ranked together and cut at each user's quota, which `checks` adds."""
    ranked = rank_candidates(unique.unionByName(extra))
    return (
        ranked.join(user_quota(users, limits), "user_id")
        .where("candidate_rank <= objetivo")
        .select(
            "user_id", "product_id", "candidate_rank", "score_candidate", "fuentes",
            *([F.col("objetivo").alias("_objetivo")] if checks else []),
        )
    )


def candidate_stats(candidates: DataFrame) -> DataFrame:
    per_item = candidates.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    per_user = candidates.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_item.agg(F.sum("n").alias("filas"), F.count(F.lit(1)).alias("productos")).select(
        "filas", per_user.agg(F.count(F.lit(1))).scalar().alias("usuarios"), "productos"
    )


def candidate_gate(
    candidates: DataFrame, interactions: DataFrame, users: DataFrame, limits: Limits = LIMITS
) -> DataFrame:
    """Counts that must all be zero: repeats, bad rows, bought items, users below quota."""
    pairs = candidates.groupBy("user_id", "product_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(
            F.when(
                F.col("user_id").isNull()
                | F.col("product_id").isNull()
                | F.col("score_candidate").isNull()
                | (F.col("candidate_rank") < 1),
                1,
            )
        ).alias("bad"),
    )
    bought = candidates.join(
        interactions.select("user_id", "product_id"), ["user_id", "product_id"], "left_semi"
    ).agg(F.count(F.lit(1)))
    got = candidates.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    below = user_quota(users, limits).join(got, "user_id", "left").where(
        F.coalesce("n", F.lit(0)) < F.col("objetivo")
    ).agg(F.count(F.lit(1)))
    return pairs.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicados"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("nulos_o_rank"),
    ).select(
        "duplicados", "nulos_o_rank", bought.scalar().alias("comprados"),
        below.scalar().alias("incompletos"),
    )


def generate(
    users: DataFrame,
    items_ranked: DataFrame,
    interactions: DataFrame,
    limits: Limits = LIMITS,
    keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
) -> DataFrame:
    """All steps from affinities to the final list.

    The deduplicated proposals are read by the quota, the fallback and the final ranking. `keep`
    may write them (and the two inputs below them) to a table, so that they are computed once.
    """
    liked = keep("afinidades", affinities(interactions, limits))
    proposals = union_sources(
        preselect_aisle(liked, items_ranked, limits),
        preselect_department(liked, items_ranked, limits),
        preselect_global(users, items_ranked, limits),
    )
    unique = keep("candidatos_unicos", new_and_deduped(proposals, interactions))
    extra = keep(
        "respaldo",
        fallback(quota(users, unique, limits), items_ranked, unique, interactions, limits),
    )
    return final_candidates(unique, extra, users, limits)
