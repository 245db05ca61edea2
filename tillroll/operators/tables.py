"""The analytic tables: catalogue, targets, profiles and user-item interactions.

The history is aggregated once to one row per user and item (`pair_history`). Item profiles, user
profiles, interactions, cadence and recent-window features all start from that table, so the order
lines cross the network once for all of them, already reduced by partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import ordinal, segment, segment_order

ORDERS_PER_CHUNK = 1000


def catalog(products: DataFrame, aisles: DataFrame, departments: DataFrame) -> DataFrame:
    return (
        products.join(aisles, "aisle_id")
        .join(departments, "department_id")
        .select(
            F.col("product_id").cast("int").alias("product_id"),
            "product_name",
            F.col("aisle_id").cast("int").alias("aisle_id"),
            "aisle",
            F.col("department_id").cast("int").alias("department_id"),
            "department",
        )
    )


def targets(train_lines: DataFrame, orders: DataFrame) -> DataFrame:
    """The held-out basket of each evaluable user."""
    held_out = orders.where("eval_set = 'train'").select("order_id", "user_id")
    return train_lines.join(held_out, "order_id").select(
        "user_id",
        "order_id",
        F.col("product_id").cast("int").alias("product_id"),
        F.col("add_to_cart_order").cast("int").alias("add_to_cart_order"),
        F.col("reordered").cast("tinyint").alias("reordered"),
    )


def order_timeline(orders: DataFrame) -> DataFrame:
    """Prior orders with their position, the days elapsed so far and the user's order count.

    The running sum of day gaps is cut into chunks of 1000 order numbers, so no task has to sort
    a whole user.
    """
    prior = orders.where("eval_set = 'prior'").select(
        "user_id",
        "order_id",
        "order_number",
        F.col("order_dow").cast("tinyint").alias("order_dow"),
        F.col("order_hour_of_day").cast("tinyint").alias("order_hour"),
        F.coalesce("days_since_prior_order", F.lit(0.0)).alias("gap"),
    )
    placed = ordinal(
        prior,
        by=["user_id"],
        chunk=[F.floor(F.col("order_number") / ORDERS_PER_CHUNK)],
        order=[F.col("order_number")],
        rank="position",
        size="n_orders",
        running={"elapsed_days": "gap"},
    )
    return placed.withColumn(
        "from_end", F.col("n_orders") - F.col("position") + 1
    ).drop("gap")


def cumulative_days(orders: DataFrame) -> DataFrame:
    return order_timeline(orders).select("user_id", "order_id", "order_number", "elapsed_days")


def _orders_seen() -> dict[str, Column]:
    """The order numbers below 128 of a pair as bits, and how many lines set them."""
    number = "order_number BETWEEN {} AND {}"
    bits = "coalesce(bit_or(CASE WHEN " + number + " THEN shiftleft(1L, order_number - {}) END), 0L)"
    return {
        "_n_seen": F.count_if(F.expr(number.format(0, 127))),
        "_seen_low": F.expr(bits.format(0, 63, 0)),
        "_seen_high": F.expr(bits.format(64, 127, 64)),
    }


def pair_history(prior_lines: DataFrame, timeline: DataFrame, checks: bool = False) -> DataFrame:
    """One row per user and item with every history aggregate.

    Lines without a prior order keep a NULL user: they still count as purchases of the item. `checks`
    adds what a check for repeated lines needs. All aggregates are of numbers, so rows are hashed; one
    of a struct would have to sort all lines before and after the shuffle.
    """
    lines = prior_lines.join(timeline, "order_id", "left")
    at_last = lambda c: F.max_by(c, "order_number")
    within = lambda n: F.count(F.when(F.col("from_end") <= n, 1))
    return (
        lines.groupBy("user_id", "product_id")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sum("reordered").alias("n_reordered"),
            F.sum("add_to_cart_order").alias("sum_position"),
            F.max("order_number").alias("last_number"),
            F.min("elapsed_days").alias("first_days"),
            F.max("elapsed_days").alias("last_days"),
            within(1).alias("in_last_1"),
            within(3).alias("in_last_3"),
            within(5).alias("in_last_5"),
            F.max("from_end").alias("first_from_end"),
            F.max("n_orders").alias("n_orders"),
            *([c.alias(n) for n, c in _orders_seen().items()] if checks else []),
            at_last("elapsed_days").alias("days_at_last"),
            at_last("order_dow").alias("dow_at_last"),
            at_last("order_hour").alias("hour_at_last"),
        )
    )


def item_profile(catalog_: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sales, buyers, reorder rate and cart position of every catalogue item, sold or not."""
    sales = pairs.groupBy("product_id").agg(
        F.sum("n_lines").alias("n"),
        F.count("user_id").alias("buyers"),
        F.sum("n_reordered").alias("r"),
        F.sum("sum_position").alias("p"),
    )
    return catalog_.join(sales, "product_id", "left").select(
        "product_id",
        "product_name",
        "aisle_id",
        "aisle",
        "department_id",
        "department",
        F.coalesce("n", F.lit(0)).alias("cantidad_compras"),
        F.coalesce("buyers", F.lit(0)).cast("int").alias("cantidad_usuarios"),
        F.coalesce(F.col("r").cast("double") / F.col("n"), F.lit(0.0)).alias(
            "reorder_rate_producto"
        ),
        (F.col("p").cast("double") / F.col("n")).alias("add_to_cart_order_promedio"),
    )


def user_profile(orders: DataFrame, pairs: DataFrame) -> DataFrame:
    """Activity, habits, rhythm and segment of each user with prior orders and lines.

    Median and modes run over at most 31, 7 and 24 distinct values, so their partial aggregates
    stay small even for a very large user. On a tie the lowest value is the mode.
    """
    activity = (
        orders.where("eval_set = 'prior'")
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.max("order_number").alias("last_number"),
            F.mode(F.col("order_dow").cast("tinyint"), True).alias("dow"),
            F.mode(F.col("order_hour_of_day").cast("tinyint"), True).alias("hour"),
            F.median("days_since_prior_order").alias("median_gap"),
            F.count(F.when(F.col("days_since_prior_order").isNull(), 1)).alias("n_first"),
            F.count(F.when(F.col("days_since_prior_order") == 30, 1)).alias("n_censored"),
        )
    )
    basket = (
        pairs.where("user_id IS NOT NULL")
        .groupBy("user_id")
        .agg(
            F.sum("n_lines").alias("n"),
            F.count(F.lit(1)).alias("items"),
            F.sum("n_reordered").alias("r"),
            F.sum("sum_position").alias("p"),
        )
    )
    flag = lambda c: (F.col(c) > 0).cast("tinyint")
    return activity.join(basket, "user_id").select(
        "user_id",
        F.col("n_orders").cast("int").alias("cantidad_ordenes_historicas"),
        F.col("last_number").cast("int").alias("ultima_order_number"),
        F.col("n").alias("cantidad_compras"),
        F.col("items").cast("int").alias("productos_distintos"),
        (F.col("r").cast("double") / F.col("n")).alias("reorder_rate_usuario"),
        (F.col("p").cast("double") / F.col("n")).alias("posicion_media_carrito"),
        F.col("dow").alias("dow_habitual"),
        F.col("hour").alias("hora_habitual"),
        F.col("median_gap").alias("mediana_dias_entre_ordenes_historicas"),
        flag("n_first").alias("tiene_primera_orden"),
        flag("n_censored").alias("tiene_intervalo_censurado_30"),
        F.col("n_censored").cast("int").alias("cantidad_intervalos_censurados_30"),
        segment(F.col("n_orders")).alias("segmento_usuario"),
    )


def segment_counts(users: DataFrame) -> DataFrame:
    return (
        users.groupBy("segmento_usuario")
        .agg(F.count(F.lit(1)).alias("cantidad"))
        .orderBy(segment_order(F.col("segmento_usuario")))
    )


def cadence() -> Column:
    """Mean days between purchases of the item by the user; NULL if bought once."""
    span = F.col("last_days") - F.col("first_days")
    return F.when(F.col("n_lines") > 1, span / (F.col("n_lines") - 1))


def interactions(
    pairs: DataFrame, catalog_: DataFrame, with_cadence: bool = False
) -> DataFrame:
    """One row per user and item bought: frequency, recency in orders and days, last visit.

    `with_cadence` adds `cadencia_par`, which the feature table needs beside these columns; both
    come from the same row of the pair history, so no join is needed to bring them together.
    """
    bought = pairs.where("user_id IS NOT NULL")
    latest = bought.groupBy("user_id").agg(
        F.max("last_number").alias("user_last"),
        F.max_by("days_at_last", "last_number").alias("user_days"),
    )
    return (
        bought.join(latest, "user_id")
        .join(catalog_.select("product_id", "aisle_id", "department_id"), "product_id")
        .select(
            "user_id",
            "product_id",
            F.col("n_lines").cast("int").alias("freq_usuario_producto"),
            (F.col("user_last") - F.col("last_number"))
            .cast("int")
            .alias("recencia_usuario_producto"),
            (F.col("user_days") - F.col("days_at_last"))
            .cast("int")
            .alias("dias_registrados_desde_ultima_compra"),
            F.col("last_number").cast("int").alias("ultima_orden_producto"),
            (F.col("sum_position").cast("double") / F.col("n_lines")).alias(
                "add_to_cart_order_promedio"
            ),
            F.col("dow_at_last").alias("ultima_order_dow"),
            F.col("hour_at_last").alias("ultima_order_hour"),
            "aisle_id",
            "department_id",
            *([cadence().alias("cadencia_par")] if with_cadence else []),
        )
    )
