"""What crosses the network on the way to the features, and that the results are those of brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tillroll.operators import features as feat
from tillroll.sources import mapping


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def items_of(spark):
    return spark.createDataFrame([(k, k % 7) for k in range(40)] + [(40, None)], "p_partkey BIGINT, product_id INT")


def lines_in(spark, folder, longest):
    """Lines of 30 orders, some of them repeated, some without an order or a number."""
    rng = random.Random(longest)
    rows = [(o, rng.randrange(41), n) for o in range(30) for n in rng.sample(range(1, longest + 1), min(longest, 9))]
    rows += rows[:20] + [(None, 3, 1), (5, 4, None), (99, 2, None)]
    schema = "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/lineitem.parquet")
    first = {}
    for order, part, number in rows:
        if order is not None:
            first.setdefault((order, part % 7 if part < 40 else None), []).append(number)
    found = {}
    for (order, item), numbers in first.items():
        known = [n for n in numbers if n is not None]
        line = (0, 0) if not known else (1, min(known))
        found.setdefault(order, []).append((line, (-1 if item is None else item)))
    return {
        (order, None if item < 0 else item, place)
        for order, lines in found.items() for place, (_, item) in enumerate(sorted(lines), 1)
    }


@pytest.mark.parametrize("longest", [7, 1023, 1024, 4000])
def test_lines_are_placed_in_their_orders(spark, tmp_path, longest):
    want = lines_in(spark, str(tmp_path), longest)
    got = mapping.basket_lines(spark, str(tmp_path), items_of(spark)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_lines_of_small_orders_are_shuffled_once_by_order(spark, tmp_path):
    lines_in(spark, str(tmp_path), 7)
    placed = mapping.basket_lines(spark, str(tmp_path), F.broadcast(items_of(spark)))
    assert len(exchanges(placed)) == 1


def test_orders_alone_in_their_day_are_not_numbered(spark, tmp_path):
    day = datetime.date(2020, 1, 1)
    rows = [(1, 1, day), (2, 1, day), (70_000, 1, day), (3, 1, day + datetime.timedelta(25)), (4, 2, day),
            (5, 2, day + datetime.timedelta(7)), (6, 3, day), (7, 4, None), (10, 4, None), (8, None, day), (9, None, day)]
    spark.createDataFrame(rows, "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate DATE").write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    lines = spark.createDataFrame([(r[0],) for r in rows], "order_id BIGINT")
    made = mapping.orders(spark, str(tmp_path), lines)
    got = {r["order_id"]: (r["user_id"], r["eval_set"], r["order_number"], r["days_since_prior_order"])
           for r in made.collect()}
    assert got == {
        1: (1, "prior", 1, None), 2: (1, "prior", 2, 0.0), 70_000: (1, "prior", 3, 0.0),
        3: (1, "train", 4, 2.0), 4: (2, "prior", 1, None), 5: (2, "train", 2, 0.0),
    }
    plan = plan_of(made)
    assert "(n#" in plan and "> 1)" in plan and "Union" in plan


def test_features_are_sorted_without_what_follows_from_them(spark):
    pairs = spark.createDataFrame(
        [(u, p, p + 1, 1, 5, 2.0, 1, 8, 3.0) for u in range(6) for p in range(5)],
        "user_id BIGINT, product_id INT, freq_usuario_producto INT, recencia_usuario_producto INT, "
        "dias_registrados_desde_ultima_compra INT, add_to_cart_order_promedio DOUBLE, ultima_order_dow TINYINT, "
        "ultima_order_hour TINYINT, cadencia_par DOUBLE",
    )
    split = spark.range(6).select(
        F.col("id").alias("user_id"), F.lit("a").alias("segmento_usuario"),
        F.when(F.col("id") % 2 == 0, "train").otherwise("valid").alias("split"),
    )
    users = spark.range(6).select(
        F.col("id").alias("user_id"), F.lit(10).alias("cantidad_ordenes_historicas"),
        F.lit(4).alias("productos_distintos"), F.lit(0.5).alias("reorder_rate_usuario"),
        F.lit(3.0).alias("posicion_media_carrito"), F.lit(7.0).alias("mediana_dias_entre_ordenes_historicas"),
    )
    items = spark.range(5).select(
        F.col("id").cast("int").alias("product_id"), F.lit(9).alias("cantidad_compras"),
        F.lit(3).alias("cantidad_usuarios"), F.lit(0.1).alias("reorder_rate_producto"),
    )
    context = spark.range(6).select(
        F.col("id").alias("user_id"), F.lit(6.0).alias("dias_hasta_orden_objetivo"),
        F.lit(1).alias("dow_orden_objetivo"), F.lit(2).alias("hora_orden_objetivo"),
    )
    labels = spark.createDataFrame([(0, 1, 1), (3, 2, 1)], "user_id BIGINT, product_id INT, etiqueta INT")
    keys = ["split", "user_id", "product_id"]
    inputs = (pairs, split, users, items, context, labels)
    made, plain = feat.build_features(*inputs, sort_by=keys), feat.build_features(*inputs)
    assert made.schema == plain.schema
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, plain.collect()))
    found = [tuple(r) for r in made.coalesce(1).select(*keys).collect()]
    assert found == sorted(found) and len(found) == 30
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        above, below = plan_of(made).split("RepartitionByExpression", 1)
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "AS vencimiento" in above and "AS vencimiento" not in below
