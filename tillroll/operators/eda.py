"""Exploratory aggregates over the raw and built tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import ordinal, segment, top_per_group
from tillroll.operators.features import quantiles
from tillroll.operators.rules import popularity_positions


def _avg(total: str, n: str) -> Column:
    return F.col(total).cast("double") / F.col(n)


def _share(col: str = "n") -> Column:
    """Percent of the column's sum. Only used on frames with one row per category."""
    return F.lit(100.0) * F.col(col) / F.sum(col).over(Window.partitionBy())


def partition_counts(orders: DataFrame) -> DataFrame:
    """Orders and users per eval_set; users are counted from one row per user."""
    per_user = orders.groupBy("eval_set", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.groupBy("eval_set").agg(
        F.sum("n").alias("pedidos"), F.count(F.lit(1)).alias("usuarios")
    )


def quality_ranges(orders: DataFrame, prior: DataFrame) -> DataFrame:
    """Ranges of the four bounded columns, and the rows that break a rule."""
    cart = prior.agg(
        F.struct(F.min("add_to_cart_order").alias("lo"), F.max("add_to_cart_order").alias("hi"))
    ).scalar()
    return orders.agg(
        F.min("order_dow").alias("dow_min"),
        F.max("order_dow").alias("dow_max"),
        F.min("order_number").alias("number_min"),
        F.max("order_number").alias("number_max"),
        F.min("days_since_prior_order").alias("dias_min"),
        F.max("days_since_prior_order").alias("dias_max"),
        F.count(F.when(F.col("days_since_prior_order").isNull(), 1)).alias("dias_nulos"),
    ).withColumn("_cart", cart).select(
        F.col("_cart.lo").alias("carrito_min"), F.col("_cart.hi").alias("carrito_max"), "*"
    ).drop("_cart")


def quality_report(t: dict[str, DataFrame]) -> DataFrame:
    """The integrity numbers of the quality review, one row each."""
    prior, orders, products = t["order_products_prior"], t["orders"], t["products"]
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    named = products.join(t["departments"], "department_id").join(t["aisles"], "aisle_id")
    surplus = (
        prior.groupBy("order_id", "product_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum(F.col("n") - 1))
    )
    same_name = (
        products.groupBy("product_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum(F.col("n") - 1))
    )
    test_orders = orders.where("eval_set = 'test'").select("order_id")
    checks = {
        "pares_duplicados": surplus.scalar(),
        "productos_huerfanos": n(
            prior.select("product_id").distinct().join(products, "product_id", "left_anti")
        ),
        "nombres_duplicados": same_name.scalar(),
        "categoria_missing": n(named.where("department = 'missing' OR aisle = 'missing'")),
        "test_con_contenido": n(
            test_orders.join(prior.select("order_id").distinct(), "order_id", "left_semi")
        ),
        "usuarios_evaluables": n(orders.where("eval_set = 'train'")),
        "max_order_number": orders.agg(F.max("order_number")).scalar(),
    }
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("control"), v.cast("long").alias("valor"))
            for k, v in checks.items()
        ]
    )
    return orders.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")


def hour_type(orders: DataFrame) -> DataFrame:
    """Type of the hour column and how many of its values are not two digits."""
    return orders.groupBy(F.typeof("order_hour_of_day").alias("tipo")).agg(
        F.count(F.lit(1)).alias("filas"),
        F.count(F.when(F.length("order_hour_of_day") != 2, 1)).alias("otro_formato"),
    )


def user_depth(prior: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders, lines, distinct items and reorder rate per user."""
    lines = prior.select("order_id", "product_id", "reordered").join(
        orders.select("order_id", "user_id"), "order_id"
    )
    by_order = lines.groupBy("user_id", "order_id").agg(F.count(F.lit(1)).alias("n"))
    n_orders = by_order.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_orders"))
    by_item = lines.groupBy("user_id", "product_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("reordered").alias("r")
    )
    items = by_item.groupBy("user_id").agg(
        F.sum("n").alias("total_items"),
        F.count(F.lit(1)).alias("distinct_products"),
        F.sum("r").alias("r"),
    )
    return n_orders.join(items, "user_id").select(
        "user_id",
        "n_orders",
        "total_items",
        "distinct_products",
        _avg("r", "total_items").alias("reorder_rate"),
    )


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("valor"))
            for c in columns
        ]
    )
    return df.select(F.explode(cells).alias("c")).select("c.*").where("valor IS NOT NULL")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and exact quartiles and p90 of several columns."""
    long = long_form(df, columns)
    marks = quantiles(
        long, ["variable"], "valor", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    )
    return long.groupBy("variable").agg(F.avg("valor").alias("media")).join(marks, "variable")


def segment_profile(depth: DataFrame) -> DataFrame:
    return (
        depth.groupBy(segment(F.col("n_orders")).alias("segmento"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("distinct_products").alias("productos_distintos"),
            F.avg("reorder_rate").alias("tasa_recompra"),
        )
        .select(
            "segmento",
            F.col("n").alias("usuarios"),
            _share().alias("pct"),
            "productos_distintos",
            "tasa_recompra",
        )
    )


def concentration_curve(prior: DataFrame) -> DataFrame:
    """Cumulative share of purchases by popularity position."""
    ranked = popularity_positions(prior)
    total = prior.agg(F.count(F.lit(1))).scalar()
    return ranked.withColumn("_t", total).select(
        "puesto",
        "product_id",
        "compras",
        (F.col("acumulado").cast("double") / F.col("_t")).alias("acumulado"),
    )


def concentration(
    prior: DataFrame, products: DataFrame, thresholds: Sequence[float] = (0.5, 0.8, 0.9)
) -> DataFrame:
    """How many items reach each share of all purchases."""
    curve = concentration_curve(prior)
    n_items = products.agg(F.count(F.lit(1))).scalar()
    reached = curve.agg(
        *[
            F.min(F.when(F.col("acumulado") >= t, F.col("puesto"))).alias(f"p{i}")
            for i, t in enumerate(thresholds)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("umbral"), F.col(f"p{i}").alias("productos"))
            for i, t in enumerate(thresholds)
        ]
    )
    return (
        reached.select(F.explode(rows).alias("r"))
        .select("r.*")
        .withColumn("_n", n_items)
        .select(
            "umbral",
            "productos",
            (F.col("productos").cast("double") / F.col("_n")).alias("pct_catalogo"),
        )
    )


def never_bought(prior: DataFrame, products: DataFrame) -> DataFrame:
    """Catalogue items without a sale, and the reorder rate of all lines."""
    sold = prior.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("reordered").alias("r")
    )
    unsold = products.join(sold, "product_id", "left_anti").agg(F.count(F.lit(1))).scalar()
    return sold.agg(F.sum("n").alias("lineas"), F.sum("r").alias("recompras")).select(
        unsold.alias("productos_nunca_comprados"),
        _avg("recompras", "lineas").alias("reorder_global"),
    )


def _segment_lines(prior: DataFrame, orders: DataFrame, depth: DataFrame) -> DataFrame:
    """Lines per segment and item.

    Lines are counted per user and item before they meet the user's segment.
    """
    pairs = (
        prior.select("order_id", "product_id")
        .join(orders.select("order_id", "user_id"), "order_id")
        .groupBy("user_id", "product_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    users = depth.select("user_id", segment(F.col("n_orders")).alias("segmento"))
    return pairs.join(users, "user_id").groupBy("segmento", "product_id").agg(
        F.sum("n").alias("n")
    )


def segment_top_items(
    prior: DataFrame, orders: DataFrame, depth: DataFrame, k: int = 10
) -> DataFrame:
    """The k best items of the new and the heavy segment, and which of them both share."""
    per_item = _segment_lines(prior, orders, depth).where("segmento IN ('nuevo', 'heavy')")
    top = top_per_group(per_item, ["segmento"], [F.desc("n"), F.col("product_id")], k, "puesto")
    both = F.count(F.lit(1)).over(Window.partitionBy("product_id")) > 1
    return top.select("segmento", "puesto", "product_id", "n", both.alias("en_ambos"))


def segment_overlap(top: DataFrame) -> DataFrame:
    return top.where("segmento = 'nuevo'").agg(
        F.count(F.when(F.col("en_ambos"), 1)).alias("en_comun")
    )


def item_lines(prior: DataFrame) -> DataFrame:
    """Lines and reorders per item: what every category aggregate starts from."""
    return prior.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("reordered").alias("r")
    )


def department_share(prior: DataFrame, catalog: DataFrame) -> DataFrame:
    return (
        item_lines(prior)
        .join(catalog.select("product_id", "department"), "product_id")
        .groupBy("department")
        .agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
        .select(
            "department",
            F.col("n").alias("compras"),
            _share().alias("pct_compras"),
            _avg("r", "n").alias("reorder_rate"),
        )
    )


def segment_department_shift(
    prior: DataFrame, orders: DataFrame, depth: DataFrame, catalog: DataFrame, top: int = 8
) -> DataFrame:
    """Departments whose share of purchases differs most between heavy and new users."""
    mix = (
        _segment_lines(prior, orders, depth)
        .join(catalog.select("product_id", "department"), "product_id")
        .groupBy("department")
        .pivot("segmento", ["heavy", "nuevo"])
        .agg(F.sum("n"))
        .fillna(0)
    )
    return (
        mix.select("department", _share("heavy").alias("heavy"), _share("nuevo").alias("nuevo"))
        .withColumn("dif", F.col("heavy") - F.col("nuevo"))
        .orderBy(F.desc(F.abs("dif")), "department")
        .limit(top)
    )


def basket_sizes(prior: DataFrame, catalog: DataFrame) -> DataFrame:
    """Items and distinct departments per order."""
    per_department = (
        prior.join(catalog.select("product_id", "department_id"), "product_id")
        .groupBy("order_id", "department_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_department.groupBy("order_id").agg(
        F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_deptos")
    )


def basket_histogram(sizes: DataFrame, cap_items: int = 40, cap_departments: int = 15) -> DataFrame:
    """Orders per basket size and per number of departments, with the long tails put together."""
    cells = F.array(
        F.struct(
            F.lit("items").alias("variable"), F.least("n_items", F.lit(cap_items)).alias("bin")
        ),
        F.struct(
            F.lit("departamentos").alias("variable"),
            F.least("n_deptos", F.lit(cap_departments)).alias("bin"),
        ),
    )
    return (
        sizes.select(F.explode(cells).alias("c"))
        .groupBy("c.variable", "c.bin")
        .agg(F.count(F.lit(1)).alias("pedidos"))
    )


def basket_medians(sizes: DataFrame) -> DataFrame:
    return quantiles(long_form(sizes, ["n_items", "n_deptos"]), ["variable"], "valor", {"mediana": 0.5})


def reorder_by_position(
    prior: DataFrame, min_lines: int = 5000, limit: int | None = 20, max_position: int | None = None
) -> DataFrame:
    rows = prior if max_position is None else prior.where(F.col("add_to_cart_order") <= max_position)
    out = (
        rows.groupBy(F.col("add_to_cart_order").alias("posicion"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("reordered").alias("reorder_rate"))
        .where(F.col("n") > min_lines)
        .orderBy("posicion")
    )
    return out if limit is None else out.limit(limit)


def orders_by(orders: DataFrame, column: str, peaks: int = 2) -> DataFrame:
    """Orders per value of a calendar column, with the busiest values marked."""
    counts = orders.groupBy(column).agg(F.count(F.lit(1)).alias("pedidos"))
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("pedidos"), column))
    return counts.select(column, "pedidos", (place <= peaks).alias("es_pico"))


def gap_distribution(orders: DataFrame) -> DataFrame:
    """Orders per day gap; first orders are the NULL row."""
    return orders.groupBy(F.col("days_since_prior_order").alias("dias")).agg(
        F.count(F.lit(1)).alias("pedidos")
    ).withColumn("es_pico", F.coalesce(F.col("dias").isin(7.0, 30.0), F.lit(False)))


def quality_variables(
    prior: DataFrame, orders: DataFrame, pairs: DataFrame
) -> DataFrame:
    """The four reviewed variables in long form: basket size, orders per user, item popularity,
    user reorder rate."""
    count = F.count(F.lit(1)).cast("double").alias("valor")
    per_user = pairs.where("user_id IS NOT NULL").groupBy("user_id").agg(
        (F.sum("n_reordered").cast("double") / F.sum("n_lines")).alias("valor")
    )
    frames = {
        "carrito": prior.groupBy("order_id").agg(count),
        "ordenes_usuario": orders.where("eval_set = 'prior'").groupBy("user_id").agg(count),
        "popularidad": prior.groupBy("product_id").agg(count),
        "recompra_usuario": per_user,
    }
    out = None
    for name, df in frames.items():
        part = df.select(F.lit(name).alias("variable"), "valor")
        out = part if out is None else out.unionByName(part)
    return out


def distribution_summary(long: DataFrame) -> DataFrame:
    """Order statistics, population deviation, bias-corrected skew and the Tukey fence.

    Values are reduced to distinct values with counts; all moments and the share above the fence
    come from those.
    """
    marks = quantiles(
        long, ["variable"], "valor",
        {"q1": 0.25, "p50": 0.5, "q3": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99},
    )
    moments = long.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("valor").alias("minimo"),
        F.max("valor").alias("maximo"),
        F.avg("valor").alias("media"),
        F.stddev_pop("valor").alias("desvio"),
        F.skewness("valor").alias("skew"),
    )
    stats = marks.join(moments, "variable").withColumn(
        "cerco", F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1"))
    )
    above = (
        long.groupBy("variable", "valor")
        .agg(F.count(F.lit(1)).alias("c"))
        .join(stats.select("variable", "cerco"), "variable")
        .groupBy("variable")
        .agg(F.sum(F.when(F.col("valor") > F.col("cerco"), F.col("c")).otherwise(0)).alias("above"))
    )
    n = F.col("n").cast("double")
    return stats.join(above, "variable").select(
        "variable", "minimo", "p50", "p90", "p95", "p99", "maximo", "media", "desvio",
        (F.col("skew") * F.sqrt(n * (n - 1)) / (n - 2)).alias("asimetria"),
        "cerco",
        (F.lit(100.0) * F.col("above") / n).alias("pct_sobre_cerco"),
    )


def histogram_vs_normal(long: DataFrame, bins: int = 55, log_variables: Sequence[str] = ()) -> DataFrame:
    """Density histogram of each variable with the mean, deviation and skew of the normal curve."""
    value = F.when(F.col("variable").isin(*log_variables), F.log10("valor")).otherwise(
        F.col("valor")
    ) if log_variables else F.col("valor")
    counts = long.select("variable", value.alias("v")).groupBy("variable", "v").agg(
        F.count(F.lit(1)).alias("c")
    )
    plain = long.select("variable", value.alias("v"))
    stats = plain.groupBy("variable").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        F.avg("v").alias("media"),
        F.stddev_pop("v").alias("desvio"),
        F.skewness("v").alias("skew"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    # the last bin is closed on both sides
    index = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    n = F.col("n")
    return (
        counts.join(stats.withColumn("width", width), "variable")
        .groupBy("variable", "n", "lo", "width", "media", "desvio", "skew", index.alias("bin"))
        .agg(F.sum("c").alias("filas"))
        .select(
            "variable",
            "bin",
            "filas",
            (F.col("filas") / (n * F.col("width"))).alias("densidad"),
            "media",
            "desvio",
            (F.col("skew") * F.sqrt(n * (n - 1)) / (n - 2)).alias("asimetria"),
        )
    )


def matrix_density(users: DataFrame, items: DataFrame, interactions: DataFrame) -> DataFrame:
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return interactions.agg(F.count(F.lit(1)).alias("pares")).select(
        n(users).alias("usuarios"), n(items).alias("productos"), "pares"
    ).withColumn(
        "densidad", F.col("pares") / (F.col("usuarios").cast("double") * F.col("productos"))
    )


def labelled_pairs(
    interactions: DataFrame, users: DataFrame, items: DataFrame, targets: DataFrame
) -> DataFrame:
    """Known pairs of evaluable users with y = 1 if the item is in the target basket."""
    y = targets.select("user_id", "product_id").distinct().withColumn("hit", F.lit(1))
    evaluable = targets.select("user_id").distinct()
    return (
        interactions.join(evaluable, "user_id", "left_semi")
        .join(y, ["user_id", "product_id"], "left")
        .join(
            users.select("user_id", "cantidad_ordenes_historicas", "segmento_usuario", "dow_habitual"),
            "user_id",
        )
        .join(items.select("product_id", "reorder_rate_producto"), "product_id")
        .select(
            "freq_usuario_producto",
            "recencia_usuario_producto",
            "dias_registrados_desde_ultima_compra",
            "add_to_cart_order_promedio",
            "ultima_order_dow",
            "cantidad_ordenes_historicas",
            "segmento_usuario",
            "dow_habitual",
            "reorder_rate_producto",
            F.coalesce("hit", F.lit(0)).alias("y"),
        )
    )


def _ratio() -> Column:
    return F.col("freq_usuario_producto").cast("double") / F.col("cantidad_ordenes_historicas")


def base_rate(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.count(F.lit(1)).alias("pares"), F.avg("y").alias("tasa_base"))


def feature_label_correlation(labelled: DataFrame) -> DataFrame:
    """Pearson correlation of six features with y."""
    features = {
        "ratio": _ratio(),
        "frecuencia": F.col("freq_usuario_producto"),
        "dias_desde_ultima": F.col("dias_registrados_desde_ultima_compra"),
        "recencia": F.col("recencia_usuario_producto"),
        "reorder_rate_producto": F.col("reorder_rate_producto"),
        "posicion_promedio": F.col("add_to_cart_order_promedio"),
    }
    row = labelled.agg(
        *[F.corr(c.cast("double"), F.col("y").cast("double")).alias(n) for n, c in features.items()]
    )
    cells = F.array(
        *[F.struct(F.lit(n).alias("variable"), F.col(n).alias("corr")) for n in features]
    )
    return row.select(F.explode(cells).alias("c")).select(
        "c.*", F.abs("c.corr").alias("senal")
    )


def reorder_prob_by_bin(labelled: DataFrame) -> DataFrame:
    """Share of y = 1 per bin, under five binnings, in one pass."""
    days = F.col("dias_registrados_desde_ultima_compra")
    cart = F.col("add_to_cart_order_promedio")
    rate = F.col("reorder_rate_producto")
    cell = lambda name, bin_, at: F.struct(
        F.lit(name).alias("variable"), bin_.cast("string").alias("bin"), at.cast("double").alias("at")
    )
    tenths = lambda c: F.format_string("%.1f", F.floor(c * 10 + 0.5) / 10)
    freq = F.least(F.col("freq_usuario_producto"), F.lit(10))
    cells = F.array(
        cell("ratio", tenths(F.least(_ratio(), F.lit(1.0))), _ratio()),
        cell("frecuencia", freq, freq),
        cell(
            "dias",
            F.when(days >= 30, "30+").when(days >= 21, "21-29").when(days >= 14, "14-20")
            .when(days >= 7, "7-13").otherwise("0-6"),
            days,
        ),
        cell("reorder_rate", F.when(rate <= 0.9, tenths(rate)), rate),
        cell(
            "carrito",
            F.when(cart < 3, "1-3").when(cart < 6, "3-6").when(cart < 10, "6-10").otherwise("10+"),
            cart,
        ),
    )
    return (
        labelled.select("y", F.explode(cells).alias("c"))
        .where("c.bin IS NOT NULL")
        .groupBy("c.variable", "c.bin")
        .agg(F.avg("y").alias("prob"), F.min("c.at").alias("desde"), F.count(F.lit(1)).alias("n"))
    )


def reorder_prob_by_segment(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("segmento_usuario").agg(
        F.avg("y").alias("prob"), F.count(F.lit(1)).alias("n")
    )


def example_users(users: DataFrame, targets: DataFrame, low: int = 6, high: int = 10) -> DataFrame:
    """The lowest user id per segment among users with a mid-sized target basket."""
    sizes = targets.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_objetivos"),
        F.count(F.when(F.col("reordered") == 0, 1)).alias("n_nuevos"),
    ).where(F.col("n_objetivos").between(low, high))
    rows = users.join(sizes, "user_id").select(
        "segmento_usuario", "user_id", "cantidad_ordenes_historicas", "n_objetivos", "n_nuevos"
    )
    pick = lambda c: F.min_by(c, "user_id").alias(c)
    return rows.groupBy("segmento_usuario").agg(
        F.min("user_id").alias("user_id"),
        *[pick(c) for c in ("cantidad_ordenes_historicas", "n_objetivos", "n_nuevos")],
    )


def qualitative_cases(
    users: DataFrame, targets: DataFrame, interactions: DataFrame, k: int = 10
) -> DataFrame:
    """Top-k repurchases of one example user per segment, with hit flags."""
    picked = example_users(users, targets)
    rows = interactions.join(picked, "user_id").withColumn(
        "ratio",
        F.col("freq_usuario_producto").cast("double") / F.col("cantidad_ordenes_historicas"),
    )
    top = top_per_group(
        rows,
        ["user_id"],
        [
            F.desc("ratio"),
            F.col("recencia_usuario_producto"),
            F.desc("freq_usuario_producto"),
            F.col("product_id"),
        ],
        k,
    )
    hits = targets.select("user_id", "product_id").distinct().withColumn("hit", F.lit(True))
    return top.join(hits, ["user_id", "product_id"], "left").select(
        "segmento_usuario", "user_id", "rank", "product_id", "freq_usuario_producto",
        F.coalesce("hit", F.lit(False)).alias("en_su_proximo_pedido"), "n_objetivos", "n_nuevos",
    )


def lift_distribution(rules: DataFrame, cap: float = 8.0, bins: int = 40) -> DataFrame:
    """Histogram of the lift, clipped at `cap`."""
    width = cap / bins
    index = F.least(F.floor(F.least("lift", F.lit(cap)) / width), F.lit(bins - 1)).cast("int")
    return rules.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("pares"))


def items_per_aisle(catalog: DataFrame) -> DataFrame:
    per_aisle = catalog.groupBy("aisle_id").agg(F.count(F.lit(1)).alias("n"))
    return per_aisle.agg(
        F.count(F.lit(1)).alias("pasillos"),
        F.avg("n").alias("promedio"),
        F.median("n").alias("mediana"),
        F.max("n").alias("maximo"),
    )


def department_dow_share(prior: DataFrame, orders: DataFrame, catalog: DataFrame) -> DataFrame:
    """Share of each department's lines per weekday, and its seasonality index."""
    lines = (
        prior.select("order_id", "product_id")
        .join(orders.select("order_id", "order_dow"), "order_id")
        .groupBy("product_id", "order_dow")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(catalog.select("product_id", "department"), "product_id")
    )
    days = list(range(7))
    total = sum((F.coalesce(F.col(str(d)), F.lit(0)) for d in days), F.lit(0))
    wide = lines.groupBy("department").pivot("order_dow", days).agg(F.sum("n"))
    share = wide.select(
        "department",
        *[
            (F.coalesce(F.col(str(d)), F.lit(0)).cast("double") / total).alias(f"dia_{d}")
            for d in days
        ],
    )
    everyone = Window.partitionBy()  # one row per department
    index = F.greatest(
        *[
            F.col(f"dia_{d}") * (F.col(f"dia_{d}") / F.avg(f"dia_{d}").over(everyone))
            for d in days
        ]
    )
    return share.withColumn("indice", index)
