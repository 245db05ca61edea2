"""Boosted trees for the order inside each user, with pair weights summed by rank position.

The loss is the sum over all pairs of a bought and an unbought item of one user of
`|d_i - d_j| / ideal * exp(s_unbought - s_bought)`: `d` is the discount 1 / log2(1 + rank) under the present
scores, `ideal` the user's best discounted gain. What swapping the two would change in NDCG is thus how much
the pair counts. The gradient of a row is the sum of its pairs' losses, towards +1 for a bought item and -1
for another one. The exponential splits into a factor of each row, and |d_i - d_j| by which of the two
stands above, so that the sum over a row's pairs follows from running sums along the ranking: no pairs are
formed, and the cost is that of sorting.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import ordinal
from tillroll.operators.features import MODEL_COLUMNS, SEED
from tillroll.operators.models import _assembler, design, spread, train_medians

STEP = 0.3
N_TREES = 20
TREE = {"maxDepth": 4, "minInstancesPerNode": 50}
CHUNK = 4096
# a user with more rows than this is not ordered by one task
MOST = 65536


def ranked(rows: DataFrame, score: str = "score") -> DataFrame:
    """`posicion` of each row inside its user, by score and then item.

    A user is cut by score, then by item where scores are equal, so none is sorted by one task.
    """
    down = -F.col(score)
    item = F.floor(F.col("product_id") / CHUNK)
    return ordinal(
        rows, ["user_id"], [F.floor(down * 16), down, item], [F.col("product_id")], "posicion"
    )


def crowded_users(rows: DataFrame, most: int = MOST) -> DataFrame:
    """Users with more than `most` rows: too many to be ordered by one task."""
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("user_id")


def pair_weights(rows: DataFrame, crowded: DataFrame | None = None) -> DataFrame:
    """The rows of users who have both labels, with `posicion` and `peso`, the loss of the row's pairs.

    Takes user_id, product_id, etiqueta (0 or 1) and score, and keeps other columns. The gradient of a row
    is its `peso` with the sign of its label. Rows without label or score count for nothing and are left out.

    `crowded` has the users whose rows are cut into chunks; all others are moved once and ordered whole. A
    caller that weighs the same rows several times finds them once (`crowded_users`).
    """
    labelled = rows.where(
        "etiqueta IS NOT NULL AND score IS NOT NULL AND user_id IS NOT NULL AND product_id IS NOT NULL"
    )
    crowded = crowded_users(labelled) if crowded is None else crowded
    whole = _summed_whole(labelled.join(crowded, "user_id", "left_anti"))
    cut = _summed_in_chunks(labelled.join(crowded, "user_id", "left_semi"))
    return _weighed(whole.unionByName(cut), rows.columns)


PARTS = ("_up", "_down", "_dup", "_ddown")


def _factors(placed: DataFrame) -> DataFrame:
    """The discount of each row's place and its factors of the pair losses."""
    bought = F.col("etiqueta") == 1
    placed = placed.withColumn("_d", F.lit(1.0) / F.log2(F.col("posicion") + F.lit(1.0)))
    placed = placed.withColumns(
        {
            "_up": F.when(bought, F.exp(-F.col("score"))).otherwise(0.0),
            "_down": F.when(bought, 0.0).otherwise(F.exp("score")),
        }
    )
    return placed.withColumns({"_dup": F.col("_d") * F.col("_up"), "_ddown": F.col("_d") * F.col("_down")})


def _summed_whole(labelled: DataFrame) -> DataFrame:
    """Running and total sums of users that one task can order, in one shuffle by user."""
    user = Window.partitionBy("user_id")
    down = user.orderBy(-F.col("score"), F.col("product_id"))
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _factors(labelled.withColumn("posicion", F.row_number().over(down).cast("bigint")))
    placed = placed.withColumns({f"_run{c}": F.sum(c).over(upto) for c in PARTS})
    placed = placed.withColumns(
        {
            "_n": F.count_if(F.col("etiqueta") == 1).over(user),
            "_rows": F.count(F.lit(1)).over(user),
            **{f"_all{c}": F.sum(c).over(user) for c in PARTS},
        }
    ).where("_n BETWEEN 1 AND _rows - 1")
    # ideal: the discounts of the first n places, n being the user's bought items
    ideal = F.sum(F.when(F.col("posicion") <= F.col("_n"), F.col("_d"))).over(user)
    return placed.withColumn("_ideal", ideal).drop("_n", "_rows")


def _summed_in_chunks(labelled: DataFrame) -> DataFrame:
    """The same sums of users with very many rows, none of which is ordered by one task."""
    placed = _factors(ranked(labelled))
    users = placed.groupBy("user_id").agg(
        F.count_if(F.col("etiqueta") == 1).cast("int").alias("_n"),
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(f"_all{c}") for c in PARTS],
    ).where("_n BETWEEN 1 AND _rows - 1")
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("_n")), F.lit(0.0), lambda t, i: t + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    users = users.withColumn("_ideal", ideal).drop("_rows", "_n")
    return ordinal(
        placed, ["user_id"], [F.floor(F.col("posicion") / CHUNK)], [F.col("posicion")], "_place",
        running={f"_run{c}": c for c in PARTS},
    ).drop("_place").join(users, "user_id")


def _weighed(run: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`columns`, posicion and peso from the sums along the ranking."""

    def pairs(e: str, de: str):
        """Sum over rows j of the other label of |d_j - d| e_j: those above have the larger discount."""
        above = F.col(f"_run{de}") - F.col("_d") * F.col(f"_run{e}")
        below = F.col("_d") * (F.col(f"_all{e}") - F.col(f"_run{e}")) - (F.col(f"_all{de}") - F.col(f"_run{de}"))
        return above + below

    weight = F.when(F.col("etiqueta") == 1, F.exp(-F.col("score")) * pairs("_down", "_ddown")).otherwise(
        F.exp("score") * pairs("_up", "_dup")
    )
    # differences of sums: rounding may leave a trace below zero
    return run.select(
        *columns, "posicion", F.greatest(weight / F.col("_ideal"), F.lit(0.0)).alias("peso")
    )


def train_rank_boosting(
    train: DataFrame,
    columns: Sequence[str] = MODEL_COLUMNS,
    trees: int = N_TREES,
    step: float = STEP,
    params: dict | None = None,
    seed: int = SEED,
    keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
) -> tuple[list[DecisionTreeRegressionModel], dict[str, float]]:
    """Trees that are added up with `step`, and the medians that rows are imputed with.

    Each tree is fitted to the signs of the gradients, weighted by their size, so that a leaf holds the
    Newton step of its rows and no leaf is beyond 1. `keep(name, df)` writes the rows of each round to a
    table; without it every round works out all rounds before it again.
    """
    fill = train_medians(train)
    rows = _assembler(columns).transform(spread(design(train, fill, columns)))
    rows = keep("orden_0", rows.select("user_id", "product_id", "x", "etiqueta", F.lit(0.0).alias("score")))
    labelled = rows.where("etiqueta IS NOT NULL")
    crowded = keep("grandes", crowded_users(labelled))  # the rounds change scores, not rows
    fitted = []
    for n in range(trees):
        learner = DecisionTreeRegressor(
            featuresCol="x", labelCol="signo", weightCol="peso", predictionCol="paso", seed=seed + n,
            **{**TREE, **(params or {})},
        )
        weighed = pair_weights(rows, crowded).where("peso > 0")
        weighed = weighed.withColumn("signo", F.col("etiqueta") * F.lit(2.0) - F.lit(1.0))
        fitted.append(learner.fit(keep(f"pesos_{n}", weighed.select("x", "signo", "peso"))))
        if n + 1 < trees:
            moved = fitted[-1].transform(rows).withColumn("score", F.col("score") + F.lit(step) * F.col("paso"))
            rows = keep(f"orden_{n + 1}", moved.drop("paso"))
    return fitted, fill


def score_rank_boosting(
    fitted: Sequence[DecisionTreeRegressionModel], fill: dict[str, float], df: DataFrame,
    columns: Sequence[str] = MODEL_COLUMNS, step: float = STEP,
) -> DataFrame:
    """user_id, product_id and score, the sum of the trees."""
    out = _assembler(columns).transform(design(df, fill, columns)).select("user_id", "product_id", "x")
    for n, tree in enumerate(fitted):
        out = tree.copy({tree.predictionCol: f"_paso_{n}"}).transform(out)
    total = sum((F.lit(step) * F.col(f"_paso_{n}") for n in range(len(fitted))), F.lit(0.0))
    return out.select("user_id", "product_id", total.alias("score"))
