"""The six raw order tables derived from order, line and part tables.

An item is one brand and type, so users buy the same item again. Every expression is
deterministic. No step gathers all orders of one user: order numbers come from day totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.functions.prefix import ordinal

# Part types in the order that numbers the departments.
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
DAY_GAP_UNIT = 10
MAX_GAP = 30
LINES_PER_CHUNK = 1024
ORDERS_PER_CHUNK = 65_536


def _aisle_id() -> Column:
    return F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")


def _department_id() -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in PART_TYPES]), F.col("p_type")).cast("int")


def parts(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/part.parquet").select(
        "p_partkey",
        "p_name",
        F.col("p_brand").alias("aisle"),
        F.col("p_type").alias("department"),
        _aisle_id().alias("aisle_id"),
        _department_id().alias("department_id"),
        (_aisle_id() * 10 + _department_id()).alias("product_id"),
    )


def products(items: DataFrame) -> DataFrame:
    return items.groupBy("product_id", "aisle_id", "department_id").agg(
        F.min_by("p_name", "p_partkey").alias("product_name")
    ).select("product_id", "product_name", "aisle_id", "department_id")


def aisles(items: DataFrame) -> DataFrame:
    return items.select("aisle_id", "aisle").distinct()


def departments(items: DataFrame) -> DataFrame:
    return items.select("department_id", "department").distinct()


def basket_lines(spark: SparkSession, directory: str, items: DataFrame) -> DataFrame:
    """One row per order and item with its cart position.

    The first aggregate removes repeats. Line numbers are unique within an order, so chunks of them
    cut one very large order into small sorts. If no line number reaches a second chunk, which one
    column tells, orders are small and one shuffle by order serves the aggregate and the sort.
    """
    lineitem = spark.read.parquet(f"{directory}/lineitem.parquet").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("p_partkey"),
        "l_linenumber",
    )
    named = lineitem.join(items.select("p_partkey", "product_id"), "p_partkey").where("order_id IS NOT NULL")
    order = [F.col("line"), F.col("product_id")]

    def distinct(rows: DataFrame) -> DataFrame:
        return rows.groupBy("order_id", "product_id").agg(F.min("l_linenumber").alias("line"))

    if (lineitem.agg(F.max("l_linenumber")).first()[0] or 0) < LINES_PER_CHUNK:
        place = F.row_number().over(Window.partitionBy("order_id").orderBy(*order))
        placed = distinct(named.repartition("order_id")).withColumn("add_to_cart_order", place)
    else:
        placed = ordinal(
            distinct(named),
            by=["order_id"],
            chunk=[F.floor(F.coalesce("line", F.lit(0)) / LINES_PER_CHUNK)],
            order=order,
            rank="add_to_cart_order",
        )
    return placed.select("order_id", "product_id", F.col("add_to_cart_order").cast("int").alias("add_to_cart_order"))


def orders(spark: SparkSession, directory: str, lines: DataFrame) -> DataFrame:
    """Orders with at least one line, of users with at least two such orders.

    A user's days are bounded by the calendar, their orders are not. The window runs over one row
    per user and day; inside a day orders are numbered in chunks of their ids. An order alone in its
    day is its first and needs no numbering.
    """
    kept = (
        spark.read.parquet(f"{directory}/orders.parquet")
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            F.to_date("o_orderdate").alias("day"),
        )
        .join(lines.select("order_id").distinct(), "order_id", "left_semi")
    )
    user = Window.partitionBy("user_id")
    by_day = user.orderBy("day")
    days = (
        kept.groupBy("user_id", "day")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "user_id",
            "day",
            "n",
            F.coalesce(
                F.sum("n").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("before"),
            F.sum("n").over(user).alias("total"),
            F.lag("day").over(by_day).alias("previous_day"),
        )
        .where("total >= 2")
    )
    dated = kept.join(days, ["user_id", "day"])
    several = ordinal(
        dated.where("n > 1"),
        by=["user_id", "day"],
        chunk=[F.floor(F.col("order_id") / ORDERS_PER_CHUNK)],
        order=[F.col("order_id")],
        rank="in_day",
    )
    placed = dated.where("n = 1").withColumn("in_day", F.lit(1).cast("bigint")).unionByName(several)
    number = F.col("before") + F.col("in_day")
    gap = F.floor(F.date_diff("day", "previous_day") / DAY_GAP_UNIT)
    return placed.select(
        "order_id",
        "user_id",
        F.when(number < F.col("total"), "prior")
        .when(F.col("user_id") % 10 == 0, "test")
        .otherwise("train")
        .alias("eval_set"),
        number.cast("int").alias("order_number"),
        (F.dayofweek("day") - 1).alias("order_dow"),
        F.lpad((F.col("order_id") % 24).cast("string"), 2, "0").alias("order_hour_of_day"),
        F.when(F.col("in_day") > 1, F.lit(0.0))
        .when(F.col("previous_day").isNotNull(), F.least(F.lit(MAX_GAP), gap).cast("double"))
        .alias("days_since_prior_order"),
    )


def order_products(lines: DataFrame, orders_: DataFrame) -> DataFrame:
    """Lines of kept orders with the reorder flag; lines of test orders are dropped."""
    placed = lines.join(
        orders_.select("order_id", "user_id", "order_number", "eval_set"), "order_id"
    )
    first = placed.groupBy("user_id", "product_id").agg(F.min("order_number").alias("first_no"))
    return (
        placed.where("eval_set <> 'test'")
        .join(first, ["user_id", "product_id"])
        .select(
            "order_id",
            "product_id",
            "add_to_cart_order",
            (F.col("order_number") > F.col("first_no")).cast("int").alias("reordered"),
            "eval_set",
        )
    )
