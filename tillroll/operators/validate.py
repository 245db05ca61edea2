"""Checks on the raw and built tables. Each is a small frame of counts; `require_zero` stops on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Required columns, keys and domains of the raw tables.
REQUIRED_COLUMNS = {
    "aisles": ("aisle_id", "aisle"),
    "departments": ("department_id", "department"),
    "order_products_prior": ("order_id", "product_id", "add_to_cart_order", "reordered"),
    "order_products_train": ("order_id", "product_id", "add_to_cart_order", "reordered"),
    "orders": (
        "order_id", "user_id", "eval_set", "order_number", "order_dow", "order_hour_of_day",
        "days_since_prior_order",
    ),
    "products": ("product_id", "product_name", "aisle_id", "department_id"),
}
KEYS = {
    "aisles": ("aisle_id",),
    "departments": ("department_id",),
    "products": ("product_id",),
    "orders": ("order_id",),
    "order_products_prior": ("order_id", "product_id"),
    "order_products_train": ("order_id", "product_id"),
}
EVAL_SETS = ("prior", "train", "test")
MAX_ORDER_NUMBER = 100


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _outside(col: Column, low: int, high: int | None = None) -> Column:
    """True for NULL and for values outside the range."""
    ok = (col >= low) if high is None else col.between(low, high)
    return ~F.coalesce(ok, F.lit(False))


def require_zero(counts: DataFrame, what: str) -> None:
    """Run a frame of counts and fail if any of them is not zero."""
    bad = []
    for row in counts.collect():  # one row per check
        values = row.asDict()
        name = "/".join(str(v) for v in values.values() if isinstance(v, str))
        bad += [f"{name or k}: {v}" for k, v in values.items() if isinstance(v, int) and v]
    if bad:
        raise ValueError(f"{what}: " + "; ".join(bad))


def check_required_columns(tables: dict[str, DataFrame]) -> list[str]:
    """Missing columns per table, from the schemas alone."""
    errors = []
    for name, wanted in REQUIRED_COLUMNS.items():
        missing = sorted(set(wanted) - set(tables[name].columns))
        if missing:
            errors.append(f"{name}: missing {', '.join(missing)}")
    return errors


def check_orders(orders: DataFrame) -> DataFrame:
    hour = F.col("order_hour_of_day").try_cast("int")
    gap = F.col("days_since_prior_order")
    return orders.agg(
        F.count(F.lit(1)).alias("filas"),
        _count(F.col("order_id").isNull() | F.col("user_id").isNull()).alias("claves_nulas"),
        _count(~F.coalesce(F.col("eval_set").isin(*EVAL_SETS), F.lit(False))).alias(
            "eval_set_invalido"
        ),
        _count(_outside(F.col("order_number"), 1)).alias("order_number_invalido"),
        _count(_outside(F.col("order_dow"), 0, 6)).alias("order_dow_invalido"),
        _count(_outside(hour, 0, 23)).alias("hora_invalida"),
        _count((gap < 0) | (gap > 30)).alias("dias_invalidos"),
    )


def check_order_products(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.count(F.lit(1)).alias("filas"),
        _count(F.col("order_id").isNull() | F.col("product_id").isNull()).alias("claves_nulas"),
        _count(_outside(F.col("add_to_cart_order"), 1)).alias("posicion_invalida"),
        _count(_outside(F.col("reordered"), 0, 1)).alias("reordered_invalido"),
    )


def surplus_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("sobrantes"))
    )


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def check_primary_keys(tables: dict[str, DataFrame]) -> DataFrame:
    return _union(
        [
            surplus_rows(tables[name], keys).select(F.lit(name).alias("tabla"), "sobrantes")
            for name, keys in KEYS.items()
        ]
    )


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of `child` whose key has no row in `parent`.

    Child keys are counted before the join, so a very frequent key crosses it once.
    """
    keys = child.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return keys.join(parent.select(key), key, "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("huerfanas")
    )


def check_foreign_keys(t: dict[str, DataFrame]) -> DataFrame:
    of = lambda s: t["orders"].where(F.col("eval_set") == s)
    checks = {
        "products.aisle_id": (t["products"], t["aisles"], "aisle_id"),
        "products.department_id": (t["products"], t["departments"], "department_id"),
        "prior.product_id": (t["order_products_prior"], t["products"], "product_id"),
        "train.product_id": (t["order_products_train"], t["products"], "product_id"),
        "prior.order_id": (t["order_products_prior"], of("prior"), "order_id"),
        "train.order_id": (t["order_products_train"], of("train"), "order_id"),
    }
    return _union(
        [
            orphans(*args).select(F.lit(name).alias("relacion"), "huerfanas")
            for name, args in checks.items()
        ]
    )


def source_gate(t: dict[str, DataFrame]) -> DataFrame:
    """What must be zero before any table is built."""
    prior, orders = t["order_products_prior"], t["orders"]
    users = orders.groupBy("user_id").agg(
        _count(F.col("days_since_prior_order").isNull()).alias("first"),
        _count(_outside(F.col("order_number"), 1, MAX_ORDER_NUMBER)).alias("bad"),
    )
    per_user = users.agg(
        F.abs(F.sum("first") - F.count(F.lit(1))).alias("primeras_de_mas"),
        F.sum("bad").alias("order_number_fuera"),
    )
    repeated = prior.groupBy("order_id", "product_id").agg(F.count(F.lit(1)).alias("n")).where(
        "n > 1"
    )
    return per_user.select(
        orphans(prior, t["products"], "product_id").scalar().alias("productos_huerfanos"),
        repeated.agg(F.count(F.lit(1))).scalar().alias("pares_duplicados"),
        "primeras_de_mas",
        "order_number_fuera",
    )


def _pairs_of_counts(rows: dict[str, tuple[Column, Column]], spark) -> DataFrame:
    """One row per check with the two numbers that must agree."""
    return spark.range(1).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("control"),
                        F.coalesce(built.cast("long"), F.lit(0)).alias("construido"),
                        F.coalesce(source.cast("long"), F.lit(0)).alias("origen"),
                    )
                    for name, (built, source) in rows.items()
                ]
            )
        ).alias("c")
    ).select("c.*", (F.col("c.construido") - F.col("c.origen")).alias("diferencia"))


def _n(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def _total(df: DataFrame, col: str) -> Column:
    return df.agg(F.sum(col)).scalar()


def _users(df: DataFrame) -> Column:
    return df.agg(F.count_distinct("user_id")).scalar()


def conservation_gate(t: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """Built tables keep every source row."""
    orders = t["orders"]
    prior_rows = _n(t["order_products_prior"])
    rows = {
        "catalogo": (_n(b["catalogo"]), _n(t["products"])),
        "targets_filas": (_n(b["targets_train"]), _n(t["order_products_train"])),
        "targets_usuarios": (_users(b["targets_train"]), _n(orders.where("eval_set = 'train'"))),
        "productos": (_n(b["productos"]), _n(b["catalogo"])),
        "productos_compras": (_total(b["productos"], "cantidad_compras"), prior_rows),
        "usuarios": (_n(b["usuarios"]), _users(orders.where("eval_set = 'prior'"))),
        "usuarios_compras": (_total(b["usuarios"], "cantidad_compras"), prior_rows),
        "interacciones_freq": (
            _total(b["interacciones"], "freq_usuario_producto"), prior_rows,
        ),
    }
    return _pairs_of_counts(rows, orders.sparkSession)


def user_profile_gate(users: DataFrame) -> DataFrame:
    median = F.col("mediana_dias_entre_ordenes_historicas")
    n = F.col("cantidad_ordenes_historicas")
    return users.agg(
        _count(F.col("tiene_primera_orden") != 1).alias("sin_primera_orden"),
        _count(median < 0).alias("mediana_negativa"),
        _count((n == 1) != median.isNull()).alias("mediana_inconsistente"),
    )


def interaction_gate(inter: DataFrame) -> DataFrame:
    recency = F.col("recencia_usuario_producto")
    days = F.col("dias_registrados_desde_ultima_compra")
    keys = inter.groupBy("user_id", "product_id").agg(
        F.count(F.lit(1)).alias("n"),
        _count(recency < 0).alias("neg_recency"),
        _count(days < 0).alias("neg_days"),
        _count((recency == 0) & (days != 0)).alias("mismatch"),
    )
    return keys.agg(
        _count(F.col("n") > 1).alias("claves_duplicadas"),
        F.sum("neg_recency").alias("recencia_negativa"),
        F.sum("neg_days").alias("dias_negativos"),
        F.sum("mismatch").alias("ultima_orden_con_dias"),
    )


def split_gate(split: DataFrame, features: DataFrame) -> DataFrame:
    sides = split.groupBy("user_id").agg(F.count_distinct("split").alias("sides"))
    null = lambda c: _count(F.col(c).isNull())
    users = features.groupBy("user_id").agg(
        null("etiqueta").alias("no_label"),
        F.sum("etiqueta").alias("positives"),
        null("ratio_usuario_producto").alias("ratio"),
        null("ciclos_desde_ultima_compra").alias("cycles"),
        null("posicion_relativa").alias("position"),
    )
    return users.agg(
        F.sum("no_label").alias("sin_etiqueta"),
        F.sum("positives").alias("positivos"),
        F.sum("ratio").alias("nulos_ratio"),
        F.sum("cycles").alias("nulos_ciclos"),
        F.sum("position").alias("nulos_posicion"),
        _count(F.col("cycles") > 0).alias("usuarios_con_ciclo_nulo"),
    ).select(_n(sides.where("sides > 1")).alias("usuarios_cruzados"), "*")


def split_users(split: DataFrame) -> DataFrame:
    return split.groupBy("split", "segmento_usuario").agg(F.count(F.lit(1)).alias("usuarios"))


def split_summary(features: DataFrame) -> DataFrame:
    users = features.groupBy("split", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("etiqueta").alias("y")
    )
    return users.groupBy("split").agg(
        F.sum("n").alias("filas"), F.count(F.lit(1)).alias("usuarios"), F.sum("y").alias("positivos")
    ).withColumns(
        {
            "tasa_positivos": F.col("positivos").cast("double") / F.col("filas"),
            "filas_por_usuario": F.col("filas").cast("double") / F.col("usuarios"),
        }
    )


def table_inventory(t: dict[str, DataFrame]) -> DataFrame:
    """Rows, key, foreign keys and grain of the raw tables."""
    facts = {
        "orders": ("", "order"),
        "order_products_prior": ("order_id->orders, product_id->products", "item of a history order"),
        "order_products_train": ("order_id->orders, product_id->products", "item of a target order"),
        "products": ("aisle_id->aisles, department_id->departments", "item"),
        "aisles": ("", "aisle"),
        "departments": ("", "department"),
    }
    return _union(
        [
            t[name].agg(F.count(F.lit(1)).alias("filas")).select(
                F.lit(name).alias("tabla"),
                "filas",
                F.lit("+".join(KEYS[name])).alias("clave"),
                F.lit(fk).alias("foraneas"),
                F.lit(grain).alias("grano"),
            )
            for name, (fk, grain) in facts.items()
        ]
    )
