"""Model features: split, labels, target context, cadence, the 25 model columns and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import md5_key, ordinal, safe_ratio
from tillroll.functions.prefix import md5_chunk
from tillroll.operators.tables import cadence
from tillroll.sources.store import sorted_ranges

SEED = 42
TRAIN_SHARE = 0.8

# The model columns by origin.
PAIR_COLUMNS = (
    "freq_usuario_producto",
    "recencia_usuario_producto",
    "dias_registrados_desde_ultima_compra",
    "posicion_par",
    "dow_ultima_compra",
    "hora_ultima_compra",
)
USER_COLUMNS = (
    "cantidad_ordenes_historicas",
    "productos_distintos",
    "reorder_rate_usuario",
    "posicion_media_carrito",
    "mediana_dias_entre_ordenes_historicas",
)
ITEM_COLUMNS = ("popularidad_producto", "usuarios_del_producto", "reorder_rate_producto")
DERIVED_COLUMNS = (
    "ratio_usuario_producto",
    "ciclos_desde_ultima_compra",
    "recencia_relativa",
    "posicion_relativa",
)
CONTEXT_COLUMNS = (
    "dias_hasta_orden_objetivo",
    "dow_orden_objetivo",
    "hora_orden_objetivo",
    "dias_sin_comprar_total",
    "cadencia_par",
    "vencimiento",
    "ciclos_totales",
)
MODEL_COLUMNS = PAIR_COLUMNS + USER_COLUMNS + ITEM_COLUMNS + DERIVED_COLUMNS + CONTEXT_COLUMNS
NULLABLE_COLUMNS = ("ciclos_desde_ultima_compra", "ciclos_totales", "cadencia_par", "vencimiento")
RECENT_COLUMNS = (
    "comprado_en_ultima",
    "ratio_ultimas_3",
    "ratio_ultimas_5",
    "tendencia",
    "afinidad_pasillo",
    "antiguedad_par",
)


def evaluable_users(targets: DataFrame, users: DataFrame) -> DataFrame:
    return targets.select("user_id").distinct().join(
        users.select("user_id", "segmento_usuario"), "user_id"
    )


def sample_users(users: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """The first n users in md5 order: a fixed pilot sample."""
    return users.orderBy(md5_key(seed, "user_id"), "user_id").limit(n)


def sample_rows(features: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """The first n user-item rows in md5 order, for pilot training."""
    return features.orderBy(
        md5_key(seed, "user_id", "product_id"), "user_id", "product_id"
    ).limit(n)


def shuffled_position(
    users: DataFrame, seed: int | str, by: Sequence[str] = (), size: str = "n_users"
) -> DataFrame:
    """Position of each user in a fixed shuffled order, per group if `by` is given.

    Groups such as segments hold millions of users; the md5 prefix cuts each into 4096 even chunks.
    """
    keyed = users.withColumn("_key", md5_key(seed, "user_id"))
    return ordinal(
        keyed,
        by=by,
        chunk=[md5_chunk(F.col("_key"))],
        order=[F.col("_key"), F.col("user_id")],
        rank="puesto",
        size=size,
    ).drop("_key")


def stratified_split(
    users: DataFrame, share: float = TRAIN_SHARE, seed: int = SEED
) -> DataFrame:
    """Whole users into train and valid with the same segment mix on both sides."""
    return shuffled_position(users, seed, by=["segmento_usuario"]).select(
        "user_id",
        "segmento_usuario",
        F.when(F.col("puesto") <= F.col("n_users") * F.lit(share), "train")
        .otherwise("valid")
        .alias("split"),
    )


def labels(targets: DataFrame) -> DataFrame:
    return targets.select("user_id", "product_id").distinct().withColumn("etiqueta", F.lit(1))


def target_context(orders: DataFrame, checks: bool = False) -> DataFrame:
    """When the target order was placed. Never what was in it. `checks` adds the number of the order."""
    return orders.where("eval_set = 'train'").select(
        "user_id",
        F.col("days_since_prior_order").alias("dias_hasta_orden_objetivo"),
        F.col("order_dow").cast("tinyint").alias("dow_orden_objetivo"),
        F.col("order_hour_of_day").cast("tinyint").alias("hora_orden_objetivo"),
        *([F.col("order_number").alias("_orden_objetivo")] if checks else []),
    )


def pair_cadence(pairs: DataFrame) -> DataFrame:
    """Days between purchases of the same item by the same user."""
    return pairs.where("user_id IS NOT NULL").select(
        "user_id", "product_id", cadence().alias("cadencia_par")
    )


def build_features(
    interactions: DataFrame,
    split: DataFrame,
    users: DataFrame,
    items: DataFrame,
    context: DataFrame,
    labels_: DataFrame,
    cadence_: DataFrame | None = None,
    sort_by: Sequence[str] = (),
) -> DataFrame:
    """One row per bought user-item pair of evaluable users: the 25 model columns and the label.

    The three user-level tables are joined with each other first, so the pairs are joined with
    users once. `cadence_` may be left out if `interactions` already holds `cadencia_par`. If `context`
    has the number of the target order, it is kept with that of the last history order for the checks.

    With `sort_by` the rows are in ranges of these columns and sorted by them. They are sorted before the
    columns that follow from others are added, so that those do not cross the network.
    """
    checks = ["_orden_objetivo", "_ultima_orden"] if "_orden_objetivo" in context.columns else []
    last = [F.col("ultima_order_number").alias("_ultima_orden")] if checks else []
    per_user = (
        split.join(context, "user_id")
        .join(users.select("user_id", *USER_COLUMNS, *last), "user_id")
    )
    per_item = items.select(
        "product_id",
        F.col("cantidad_compras").alias("popularidad_producto"),
        F.col("cantidad_usuarios").alias("usuarios_del_producto"),
        "reorder_rate_producto",
    )
    n_orders = F.col("cantidad_ordenes_historicas")
    days = F.col("dias_registrados_desde_ultima_compra")
    median = F.col("mediana_dias_entre_ordenes_historicas")
    total_days = days + F.col("dias_hasta_orden_objetivo")
    derived: dict[str, Column] = {
        "ratio_usuario_producto": F.col("freq_usuario_producto").cast("double") / n_orders,
        "ciclos_desde_ultima_compra": safe_ratio(days, median),
        "recencia_relativa": F.col("recencia_usuario_producto").cast("double") / n_orders,
        "posicion_relativa": safe_ratio(
            F.col("posicion_par"), F.col("posicion_media_carrito")
        ),
        "dias_sin_comprar_total": total_days,
        "vencimiento": safe_ratio(total_days, F.col("cadencia_par")),
        "ciclos_totales": safe_ratio(total_days, median),
        "etiqueta": F.coalesce("etiqueta", F.lit(0)),
    }
    pairs = interactions.select(
        "user_id",
        "product_id",
        "freq_usuario_producto",
        "recencia_usuario_producto",
        "dias_registrados_desde_ultima_compra",
        F.col("add_to_cart_order_promedio").alias("posicion_par"),
        F.col("ultima_order_dow").alias("dow_ultima_compra"),
        F.col("ultima_order_hour").alias("hora_ultima_compra"),
        *(["cadencia_par"] if cadence_ is None else []),
    )
    if cadence_ is not None:
        pairs = pairs.join(cadence_, ["user_id", "product_id"], "left")
    joined = (
        pairs.join(labels_, ["user_id", "product_id"], "left")
        .join(per_user, "user_id")
        .join(per_item, "product_id")
    )
    if sort_by:
        joined = sorted_ranges(joined, sort_by)
    return joined.withColumns(derived).select(
        "user_id", "product_id", "split", "segmento_usuario", *MODEL_COLUMNS, "etiqueta", *checks
    )


def aisle_affinity(pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Share of a user's purchases that come from each aisle."""
    per_aisle = (
        pairs.where("user_id IS NOT NULL")
        .join(catalog.select("product_id", "aisle_id"), "product_id")
        .groupBy("user_id", "aisle_id")
        .agg(F.sum("n_lines").alias("n"))
    )
    total = per_aisle.groupBy("user_id").agg(F.sum("n").alias("total"))
    return per_aisle.join(total, "user_id").select(
        "user_id", "aisle_id", (F.col("n").cast("double") / F.col("total")).alias("afinidad_pasillo")
    )


def recent_window_features(
    pairs: DataFrame, catalog: DataFrame, affinity: DataFrame
) -> DataFrame:
    """Six features that look at the last orders and at the item's aisle."""
    total = F.col("n_orders")
    share = lambda n: F.col(f"in_last_{n}").cast("double") / F.least(F.lit(n), total)
    return (
        pairs.where("user_id IS NOT NULL")
        .join(catalog.select("product_id", "aisle_id"), "product_id", "left")
        .join(affinity, ["user_id", "aisle_id"], "left")
        .select(
            "user_id",
            "product_id",
            (F.col("in_last_1") > 0).cast("int").alias("comprado_en_ultima"),
            share(3).alias("ratio_ultimas_3"),
            share(5).alias("ratio_ultimas_5"),
            (share(5) - F.col("n_lines").cast("double") / total).alias("tendencia"),
            F.coalesce("afinidad_pasillo", F.lit(0.0)).alias("afinidad_pasillo"),
            (F.col("first_from_end").cast("double") / total).alias("antiguedad_par"),
        )
    )


def join_new_features(features: DataFrame, new: DataFrame) -> DataFrame:
    """Features with the recent-window columns; a pair without them gets zeros."""
    return features.join(new, ["user_id", "product_id"], "left").fillna(0, list(RECENT_COLUMNS))


def missing_new_features(features: DataFrame, new: DataFrame) -> DataFrame:
    """How many values `join_new_features` has to fill."""
    joined = features.join(new, ["user_id", "product_id"], "left")
    return joined.agg(
        F.count(F.lit(1)).alias("pares"),
        sum((F.count(F.when(F.col(c).isNull(), 1)) for c in RECENT_COLUMNS), F.lit(0)).alias(
            "faltantes"
        ),
    )


def medians(train: DataFrame, columns: Sequence[str] = NULLABLE_COLUMNS) -> DataFrame:
    """Exact median of each column over its non-NULL values, one row, NaN-free.

    Each column is reduced to its distinct values with counts, and the ranks of those values come
    from `ordinal`, so no task holds the column.
    """
    long = train.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("valor"))
                    for c in columns
                ]
            )
        ).alias("x")
    ).select("x.variable", "x.valor").where("valor IS NOT NULL")
    return quantiles(long, ["variable"], "valor", {"mediana": 0.5})


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float]
) -> DataFrame:
    """Exact interpolated quantiles per group without gathering the group.

    Values are counted first. The cumulative count tells which distinct value sits at a position;
    positions fall on two neighbouring values at most, so a filter and two aggregates finish it.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    # a few thousand chunks of the value range, non-decreasing in the value
    cut = F.floor(F.signum(value) * F.log1p(F.abs(value)) * 512)
    ranked = ordinal(
        counts, by, [cut], [F.col(value)], rank="_r", running={"upto": "n"}
    ).drop("_r")
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    placed = ranked.join(total, list(by)) if by else ranked.withColumn(
        "total", counts.agg(F.sum("n")).scalar()
    )
    start = F.col("upto") - F.col("n")  # zero-based position of the first copy
    out = []
    for name, q in wanted.items():
        position = (F.col("total") - 1) * F.lit(q)
        low, high = F.floor(position), F.ceil(position)
        at_low = (start <= low) & (low < F.col("upto"))
        at_high = (start <= high) & (high < F.col("upto"))
        lo, hi = F.max(F.when(at_low, F.col(value))), F.max(F.when(at_high, F.col(value)))
        frac = F.max(position - low)
        out.append((lo + (hi - lo) * frac).alias(name))
    return placed.groupBy(*by).agg(*out)


def impute_with_indicator(
    df: DataFrame,
    medians_: DataFrame | dict[str, float],
    columns: Sequence[str] = NULLABLE_COLUMNS,
) -> DataFrame:
    """Fill NULLs with the train median and add a `<column>_imputado` flag.

    `medians_` is the frame of `medians`, or its few values as a dict when they are used by many
    jobs, as in training.
    """
    if isinstance(medians_, dict):
        fill = {c: F.lit(medians_.get(c)).cast("double") for c in columns}
    else:
        values = medians_.select(
            F.map_from_entries(F.collect_list(F.struct("variable", "mediana")))
        ).scalar()
        df = df.withColumn("_fill", values)
        fill = {c: F.col("_fill")[c] for c in columns}
    return df.withColumns(
        {
            **{f"{c}_imputado": F.col(c).isNull().cast("int") for c in columns},
            **{c: F.coalesce(F.col(c), fill[c]) for c in columns},
        }
    ).drop("_fill")
