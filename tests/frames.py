"""Small frames from Python literals."""


def recs(spark, lists):
    rows = [(u, p, i) for u, items in lists.items() for i, p in enumerate(items, 1)]
    return spark.createDataFrame(rows, "user_id BIGINT, product_id INT, rank INT")


def pairs(spark, sets):
    rows = [(u, p) for u, items in sets.items() for p in (sorted(items) or [None])]
    return spark.createDataFrame(rows, "user_id BIGINT, product_id INT")


def known(spark, sets):
    rows = [(u, p) for u, items in sets.items() for p in sorted(items)]
    return spark.createDataFrame(rows, "user_id BIGINT, product_id INT")


def segments(spark, names):
    return spark.createDataFrame(list(names.items()), "user_id BIGINT, segmento STRING")


def rules(spark, by_item):
    rows = [(a, b, c) for a, out in by_item.items() for b, c in out]
    return spark.createDataFrame(rows, "antecedente INT, product_id INT, confianza DOUBLE")
