"""Rankings as long frames (user_id, product_id, rank). Every order ends in the item id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import top_per_group

K = 10

# Hand-picked weights of the heuristic and the sets of the sensitivity run.
WEIGHTS = {"ratio": 0.50, "recencia": 0.35, "producto": 0.15}
WEIGHT_GRID = (
    {"ratio": 1.00, "recencia": 0.00, "producto": 0.00},
    {"ratio": 0.70, "recencia": 0.30, "producto": 0.00},
    {"ratio": 0.50, "recencia": 0.50, "producto": 0.00},
    {"ratio": 0.50, "recencia": 0.35, "producto": 0.15},
    {"ratio": 0.35, "recencia": 0.50, "producto": 0.15},
    {"ratio": 0.30, "recencia": 0.30, "producto": 0.40},
)


def truth(targets: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """The items of each user's target basket."""
    pairs = targets.select("user_id", "product_id").distinct()
    return pairs if users is None else pairs.join(users, "user_id", "left_semi")


def users_of_split(features: DataFrame, split: str) -> DataFrame:
    rows = features if split == "todos" else features.where(F.col("split") == split)
    return rows.select("user_id").distinct()


def history(interactions: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """The items each user bought before the target order."""
    pairs = interactions.select("user_id", "product_id")
    return pairs if users is None else pairs.join(users, "user_id", "left_semi")


def user_segments(features: DataFrame) -> DataFrame:
    return features.select("user_id", F.col("segmento_usuario").alias("segmento")).distinct()


def group_sizes(features: DataFrame) -> DataFrame:
    return features.groupBy("user_id").agg(F.count(F.lit(1)).alias("filas"))


def best_sellers(items: DataFrame, k: int = K) -> DataFrame:
    """The k best-selling items, one row each."""
    return items.orderBy(F.desc("cantidad_compras"), "product_id").limit(k).select(
        "product_id", "cantidad_compras"
    )


def popularity_topk(items: DataFrame, users: DataFrame, k: int = K) -> DataFrame:
    """The k best sellers for every user: one k-element array exploded per user."""
    top = best_sellers(items, k).select(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("cantidad_compras")), "product_id"))),
            lambda x: x["product_id"],
        )
    )
    return users.select("user_id").distinct().select(
        "user_id", F.posexplode(top.scalar()).alias("pos", "product_id")
    ).select("user_id", "product_id", (F.col("pos") + 1).alias("rank"))


def topk(
    df: DataFrame, score: str | Column = "score", k: int = K, by: Sequence[str] = ("user_id",)
) -> DataFrame:
    """Highest scores first, ties by item id."""
    col = F.col(score) if isinstance(score, str) else score
    return top_per_group(df, by, [col.desc(), F.col("product_id")], k).select(
        *by, "product_id", "rank"
    )


def repurchase_topk(features: DataFrame, k: int = K) -> DataFrame:
    """Share of the user's orders that hold the item, then the most recent, then the item id."""
    order = [F.desc("ratio_usuario_producto"), F.col("recencia_usuario_producto"), F.col("product_id")]
    return top_per_group(features, ["user_id"], order, k).select("user_id", "product_id", "rank")


def repurchase_topk_by_count(
    interactions: DataFrame, users: DataFrame, k: int = K
) -> DataFrame:
    order = [
        F.desc("freq_usuario_producto"),
        F.col("recencia_usuario_producto"),
        F.desc("ultima_orden_producto"),
        F.col("product_id"),
    ]
    rows = interactions.join(users, "user_id", "left_semi")
    return top_per_group(rows, ["user_id"], order, k).select("user_id", "product_id", "rank")


def repurchase_case(interactions: DataFrame, users: DataFrame, user_id: Column | int, k: int = K) -> DataFrame:
    """Top-k of one user: ratio, recency, count, item id."""
    orders = users.where(F.col("user_id") == user_id).select(
        "user_id", "cantidad_ordenes_historicas"
    )
    rows = interactions.where(F.col("user_id") == user_id).join(orders, "user_id")
    return (
        rows.withColumn(
            "ratio",
            F.col("freq_usuario_producto").cast("double") / F.col("cantidad_ordenes_historicas"),
        )
        .orderBy(
            F.desc("ratio"),
            "recencia_usuario_producto",
            F.desc("freq_usuario_producto"),
            "product_id",
        )
        .limit(k)
        .select("user_id", "product_id", "freq_usuario_producto", "ratio")
    )


def heuristic_score(weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of ratio, 1/(1+recency) and the item's reorder rate."""
    w = weights or WEIGHTS
    recency = F.lit(1.0) / (F.lit(1.0) + F.col("recencia_usuario_producto"))
    return (
        F.lit(w["ratio"]) * F.col("ratio_usuario_producto")
        + F.lit(w["recencia"]) * recency
        + F.lit(w["producto"]) * F.col("reorder_rate_producto")
    )


def weight_rankings(
    features: DataFrame, grid: Sequence[dict[str, float]] = WEIGHT_GRID, k: int = K
) -> DataFrame:
    """Top-k under every weight set in one pass, one `modelo` per set."""
    scores = F.array(
        *[
            F.struct(F.lit(f"pesos_{i}").alias("modelo"), heuristic_score(w).alias("score"))
            for i, w in enumerate(grid, 1)
        ]
    )
    rows = features.select("user_id", "product_id", F.explode(scores).alias("s")).select(
        "user_id", "product_id", "s.modelo", "s.score"
    )
    return topk(rows, "score", k, by=["modelo", "user_id"])
