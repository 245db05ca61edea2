"""Association rules between items and between categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import is_variant, name_tokens, ordinal, top_per_group

BASKET_CUT = 1000


def basket_total(baskets: DataFrame) -> DataFrame:
    return baskets.agg(F.count_distinct("order_id").alias("ordenes"))


def support(baskets: DataFrame, min_orders: int = 500) -> DataFrame:
    """Orders per item, for items in at least `min_orders`."""
    return (
        baskets.groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("ordenes_con"))
        .where(F.col("ordenes_con") >= min_orders)
    )


def prune_baskets(baskets: DataFrame, support_: DataFrame) -> DataFrame:
    """Basket lines of supported items only: a rare item cannot be part of a frequent pair."""
    return baskets.select("order_id", "product_id").join(
        support_.select("product_id"), "product_id", "left_semi"
    )


def pair_counts(baskets: DataFrame, key: str, min_pairs: int = 1, cut: int = BASKET_CUT) -> DataFrame:
    """Orders that hold both a and b, a < b, for pairs in at least `min_pairs` orders.

    `baskets` holds each (order_id, key) once. A basket of up to `cut` items is one join group. A
    larger one is split by item hash into p parts, and its items are sent to the cells (i, j),
    i <= j, of the p parts; a cell pairs part i with part j. Each pair meets in exactly one cell,
    and no task gets more than two parts of a basket. Both sides of the join read one shuffle.
    """
    sizes = (
        baskets.groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > cut)
        .select("order_id", F.ceil(F.col("n") / cut).cast("int").alias("parts"))
    )
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64(key), parts).cast("int")
    cells = (
        baskets.select("order_id", key)
        .join(sizes, "order_id", "left")
        .select(
            "order_id",
            F.col(key).alias("item"),
            part.alias("part"),
            F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"),
        )
        .select(
            "order_id",
            "item",
            "part",
            F.least("part", "other").alias("i"),
            F.greatest("part", "other").alias("j"),
        )
    )
    x, y = cells.alias("x"), cells.alias("y")
    together = (
        (F.col("x.order_id") == F.col("y.order_id"))
        & (F.col("x.i") == F.col("y.i"))
        & (F.col("x.j") == F.col("y.j"))
        & (F.col("x.item") < F.col("y.item"))
        & ((F.col("x.i") == F.col("x.j")) | (F.col("x.part") != F.col("y.part")))
    )
    return (
        x.join(y, together)
        .groupBy(F.col("x.item").alias("a"), F.col("y.item").alias("b"))
        .agg(F.count(F.lit(1)).alias("ordenes_juntos"))
        .where(F.col("ordenes_juntos") >= min_pairs)
    )


def _directed(pairs: DataFrame) -> DataFrame:
    """a -> b and b -> a."""
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("antecedente"), F.col("b").alias("consecuente")),
            F.struct(F.col("b").alias("antecedente"), F.col("a").alias("consecuente")),
        )
    )
    return pairs.select(both.alias("d"), "ordenes_juntos").select("d.*", "ordenes_juntos")


def _strength(together: Column, n_a: Column, n_b: Column, total: Column) -> dict[str, Column]:
    together, n_a, n_b = (c.cast("double") for c in (together, n_a, n_b))
    return {
        "soporte": together / total,
        "confianza": together / n_a,
        "lift": (together / n_a) / (n_b / total),
    }


def _with_support(pairs: DataFrame, support_: DataFrame, key: str) -> DataFrame:
    side = lambda end, n: support_.select(
        F.col(key).alias(end), F.col("ordenes_con").alias(n)
    )
    return _directed(pairs).join(side("antecedente", "n_a"), "antecedente").join(
        side("consecuente", "n_b"), "consecuente"
    )


def directed_rules(
    pairs: DataFrame, support_: DataFrame, catalog: DataFrame, total: Column,
    min_confidence: float = 0.05,
) -> DataFrame:
    """Both directions of every pair with names, aisles and unrounded strength."""
    strong = (
        _with_support(pairs, support_, "product_id")
        .withColumn("_total", total)
        .withColumns(
            _strength(F.col("ordenes_juntos"), F.col("n_a"), F.col("n_b"), F.col("_total"))
        )
        .where(F.col("confianza") >= min_confidence)
    )
    names = lambda end, item, name, aisle: catalog.select(
        F.col("product_id").alias(end),
        F.col("product_id").alias(item),
        F.col("product_name").alias(name),
        F.col("aisle").alias(aisle),
    )
    return (
        strong.join(names("antecedente", "producto_a_id", "si_compra", "pasillo_a"), "antecedente")
        .join(names("consecuente", "producto_b_id", "tambien_lleva", "pasillo_b"), "consecuente")
        .select(
            "producto_a_id",
            "producto_b_id",
            "si_compra",
            "tambien_lleva",
            "pasillo_a",
            "pasillo_b",
            (F.col("pasillo_a") == F.col("pasillo_b")).alias("mismo_pasillo"),
            "ordenes_juntos",
            "soporte",
            "confianza",
            "lift",
        )
    )


def with_variant_flags(rules: DataFrame) -> DataFrame:
    """Mark rules between versions of one item and rules inside an aisle."""
    return rules.withColumn(
        "es_variante", is_variant(name_tokens(F.col("si_compra")), name_tokens(F.col("tambien_lleva")))
    ).withColumn("descartada", F.col("mismo_pasillo") | F.col("es_variante"))


def complementary(rules: DataFrame) -> DataFrame:
    """Rules between different aisles and different items, as published: rounded, by lift."""
    return (
        with_variant_flags(rules)
        .where(~F.col("descartada"))
        .withColumns(
            {
                "soporte": F.round("soporte", 5),
                "confianza": F.round("confianza", 4),
                "lift": F.round("lift", 2),
            }
        )
    )


def category_baskets(baskets: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Each category of an order once."""
    return (
        baskets.join(catalog.select("product_id", key), "product_id")
        .select("order_id", key)
        .distinct()
    )


def category_rules(
    category_lines: DataFrame, key: str, total: Column, min_pairs: int = 100
) -> DataFrame:
    per_category = category_lines.groupBy(key).agg(F.count(F.lit(1)).alias("ordenes_con"))
    pairs = pair_counts(category_lines, key, min_pairs)
    return (
        _with_support(pairs, per_category, key)
        .withColumn("_total", total)
        .withColumns(
            _strength(F.col("ordenes_juntos"), F.col("n_a"), F.col("n_b"), F.col("_total"))
        )
        .select(
            F.col("antecedente").alias("si_compra_de"),
            F.col("consecuente").alias("tambien_lleva_de"),
            "ordenes_juntos",
            "soporte",
            "confianza",
            "lift",
        )
    )


def best_selling_baskets(baskets: DataFrame, n: int) -> DataFrame:
    """Basket lines of the n items with most lines, ties by item id."""
    top = (
        baskets.groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("c"))
        .orderBy(F.desc("c"), "product_id")
        .limit(n)
    )
    return baskets.select("order_id", "product_id").join(
        top.select("product_id"), "product_id", "left_semi"
    )


def topn_item_pairs(baskets: DataFrame, n: int, min_pairs: int) -> DataFrame:
    return pair_counts(best_selling_baskets(baskets, n), "product_id", min_pairs)


def undirected_lift(pairs: DataFrame, support_: DataFrame, key: str, total: Column) -> DataFrame:
    """Confidence both ways, support and lift of each unordered pair."""
    side = lambda end, n: support_.select(
        F.col(key).alias(end), F.col("ordenes_con").cast("double").alias(n)
    )
    co = F.col("ordenes_juntos").cast("double")
    return (
        pairs.join(side("a", "n_a"), "a")
        .join(side("b", "n_b"), "b")
        .withColumn("_total", total)
        .select(
            "a",
            "b",
            "ordenes_juntos",
            (co / F.col("_total")).alias("soporte"),
            (co / F.col("n_a")).alias("conf_a_b"),
            (co / F.col("n_b")).alias("conf_b_a"),
            (co * F.col("_total") / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        )
    )


def lift_matrix(lifts: DataFrame, ids: list[int]) -> DataFrame:
    """Symmetric lift matrix, one row and one column per category id."""
    ends = F.explode(
        F.array(
            F.struct(F.col("a").alias("fila"), F.col("b").alias("columna")),
            F.struct(F.col("b").alias("fila"), F.col("a").alias("columna")),
        )
    )
    return (
        lifts.select(ends.alias("e"), "lift")
        .select("e.fila", "e.columna", "lift")
        .groupBy("fila")
        .pivot("columna", ids)
        .agg(F.first("lift"))
        .withColumnsRenamed({str(i): f"lift_{i}" for i in ids})
    )


def pair_stats(baskets: DataFrame, catalog: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """Support, confidence and lift of the first items with two given names."""
    item = lambda name: (
        catalog.where(F.col("product_name") == name).agg(F.min("product_id")).scalar()
    )
    marked = baskets.select(
        "order_id",
        (F.col("product_id") == item(name_a)).alias("is_a"),
        (F.col("product_id") == item(name_b)).alias("is_b"),
    )
    orders = marked.groupBy("order_id").agg(
        F.max(F.col("is_a").cast("int")).alias("a"), F.max(F.col("is_b").cast("int")).alias("b")
    )
    totals = orders.agg(
        F.count(F.lit(1)).alias("ordenes"),
        F.sum("a").alias("pedidos_a"),
        F.sum("b").alias("pedidos_b"),
        F.sum(F.col("a") * F.col("b")).alias("juntos"),
    )
    n, a, b, co = (
        F.col(c).cast("double") for c in ("ordenes", "pedidos_a", "pedidos_b", "juntos")
    )
    return totals.select(
        F.lit(name_a).alias("a"),
        F.lit(name_b).alias("b"),
        "pedidos_a",
        "pedidos_b",
        "juntos",
        (co / n).alias("soporte"),
        (co / a).alias("confianza_a_b"),
        ((co / n) / ((a / n) * (b / n))).alias("lift"),
    )


def rule_index(rules: DataFrame, min_confidence: float = 0.02, per_item: int = 15) -> DataFrame:
    """The strongest consequents of each antecedent: confidence, then consequent id."""
    rows = rules.where(F.col("confianza") >= min_confidence).select(
        F.col("producto_a_id").alias("antecedente"),
        F.col("producto_b_id").alias("product_id"),
        "confianza",
    )
    return top_per_group(
        rows, ["antecedente"], [F.desc("confianza"), F.col("product_id")], per_item, "orden"
    )


def popularity_positions(baskets: DataFrame) -> DataFrame:
    """Items by number of lines with their position and the cumulated lines."""
    sold = baskets.groupBy("product_id").agg(F.count(F.lit(1)).alias("compras"))
    return ordinal(
        sold,
        by=[],
        chunk=[
            F.floor(-F.log2("compras")), -F.col("compras"), F.floor(F.col("product_id") / 100_000)
        ],
        order=[F.col("product_id")],
        rank="puesto",
        running={"acumulado": "compras"},
    )
