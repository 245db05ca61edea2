"""Registered queries: sources, checks and table builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import tables, validate
from tillroll.plans.registry import add
from tillroll.plans.workspace import Workspace
from tillroll.sources import raw, store

# sources and sinks ------------------------------------------------------------------------------

_RAW_COUNTS = """
    SELECT 'orders' AS tabla, count(*) AS filas FROM x_orders
    UNION ALL SELECT 'order_products_prior', count(*) FROM x_prior
    UNION ALL SELECT 'order_products_train', count(*) FROM x_train
    UNION ALL SELECT 'products', count(*) FROM x_products
    UNION ALL SELECT 'aisles', count(*) FROM x_aisles
    UNION ALL SELECT 'departments', count(*) FROM x_departments"""


def _csv_round_trip(ws):
    """The six tables written once as CSVs with a header, and read with the fixed schema."""
    if "csv" not in ws.made:
        folder = ws.store.fresh_path("csv")
        for name, df in ws.raw.items():
            df.write.option("header", True).csv(f"{folder}/{raw.RAW_FILES[name]}")
        ws.made["csv"] = folder
    return raw.read_raw(ws.spark, ws.made["csv"])


def _counts_from_csv(ws):
    out = None
    for name, df in _csv_round_trip(ws).items():
        row = df.agg(F.lit(name).alias("tabla"), F.count(F.lit(1)).alias("filas"))
        out = row if out is None else out.unionByName(row)
    return out


def _orders_from_csv(ws):
    return _csv_round_trip(ws)["orders"]


def _from_raw(ws):
    """A workspace over the CSVs, with everything built anew from them."""
    if "from_raw" not in ws.made:
        _csv_round_trip(ws)
        ws.made["from_raw"] = Workspace.from_raw(
            ws.spark, ws.made["csv"], folder=ws.store.folder, limits=ws.limits, report_only=ws.report_only
        )
    return ws.made["from_raw"]


def _built_from_raw(ws):
    start = _from_raw(ws)
    built = {
        "catalogo": start.catalog, "targets_train": start.targets, "productos": start.items,
        "usuarios": start.users, "interacciones": start.interactions, "features": start.features,
    }
    out = None
    for name, df in built.items():
        row = df.agg(F.lit(name).alias("tabla"), F.count(F.lit(1)).alias("filas"))
        out = row if out is None else out.unionByName(row)
    return out


def _rejected(ws):
    """Orders in whose line the weekday is no number, and what is left of each table."""
    if "broken" not in ws.made:
        folder = ws.store.fresh_path("csv")
        broken = F.when(F.col("order_id") % 50 == 0, "lunes").otherwise(F.col("order_dow").cast("string"))
        for name, df in ws.raw.items():
            given = df.withColumn("order_dow", broken) if name == "orders" else df
            given.write.option("header", True).csv(f"{folder}/{raw.RAW_FILES[name]}")
        ws.made["broken"] = Workspace.from_raw(ws.spark, folder, folder=ws.store.folder, max_rejected=1 << 62)
    return ws.made["broken"].rejected_counts()


def _inputs(ws):
    """The six files, whether they are there, and how many of the columns asked for they lack."""
    _csv_round_trip(ws)
    paths = {n: f"{ws.made['csv']}/{f}" for n, f in raw.RAW_FILES.items()}
    raw.require_inputs(ws.spark, paths.values())
    lacking = raw.missing_columns({n: raw.header(ws.spark, p) for n, p in paths.items()})
    rows = [(n, raw.path_exists(ws.spark, p), len(lacking[n])) for n, p in paths.items()]
    return ws.spark.createDataFrame(rows, "tabla STRING, presente BOOLEAN, columnas_que_faltan INT")


def _observed(ws):
    """What was counted while the tables were written. A hash of rows says nothing to SQL."""
    for name in ("catalog", "targets", "items", "users", "interactions", "features", "two_block", "candidates"):
        getattr(ws, name)
    return ws.checks().where("control <> 'huella'")


def _from_views(ws):
    raw.register_views({f"tillroll_{n}": df for n, df in ws.raw.items()})
    return ws.spark.sql(
        "SELECT eval_set, count(DISTINCT o.order_id) AS pedidos, count(*) AS lineas "
        "FROM tillroll_orders o JOIN tillroll_order_products_prior p ON o.order_id = p.order_id "
        "GROUP BY eval_set"
    )


def _bought_pairs(ws):
    """Two columns of a written table: the scan reads only those."""
    path = ws.store.path("interacciones", lambda: ws.interactions)
    return store.read_table(ws.spark, path, ["user_id", "product_id"])


def _published(ws):
    path = ws.store.fresh_path("catalogo")
    return store.publish_atomic(
        ws.catalog, path, lambda df: validate.require_zero(validate.surplus_rows(df, ["product_id"]), "catalogo")
    )


def _report(ws):
    path = ws.store.fresh_path("segmentos")
    store.write_report(tables.segment_counts(ws.users), path)
    return ws.spark.read.schema("segmento_usuario STRING, cantidad BIGINT").option(
        "header", True
    ).csv(path)


add("s1_read_raw", _counts_from_csv, _RAW_COUNTS)
add(
    "s1_raw_orders", _orders_from_csv, "SELECT * FROM x_orders", "days_since_prior_order"
)
add("s1_from_raw", _built_from_raw, """
    SELECT 'catalogo' AS tabla, count(*) AS filas FROM x_catalogo
    UNION ALL SELECT 'targets_train', count(*) FROM x_targets
    UNION ALL SELECT 'productos', count(*) FROM x_productos
    UNION ALL SELECT 'usuarios', count(*) FROM x_usuarios
    UNION ALL SELECT 'interacciones', count(*) FROM x_inter
    UNION ALL SELECT 'features', count(*) FROM x_features""")
add(
    "s1_interactions_from_raw", lambda ws: _from_raw(ws).interactions, "SELECT * FROM x_inter",
    "add_to_cart_order_promedio",
)
add("s1_rejected_lines", _rejected, f"""
    SELECT tabla, filas - bad AS aceptadas, bad AS rechazadas FROM (
      SELECT tabla, filas, CASE WHEN tabla = 'orders'
        THEN (SELECT count(*) FROM x_orders WHERE order_id % 50 = 0) ELSE 0 END AS bad
      FROM ({_RAW_COUNTS}))""")
add("s2_require_inputs", _inputs, f"""
    SELECT tabla, filas >= 0 AS presente, CAST(0 AS INTEGER) AS columnas_que_faltan FROM ({_RAW_COUNTS})""")
add(
    "s3_register_views",
    _from_views,
    """SELECT eval_set, count(DISTINCT order_id) AS pedidos, count(*) AS lineas
       FROM x_orders JOIN x_prior USING (order_id) GROUP BY 1""",
)
add(
    "s4_read_table",
    _bought_pairs,
    "SELECT user_id, product_id FROM x_inter",
)


def _written(ws, name, df, **how):
    path = ws.store.fresh_path(name)
    store.write_table(df, path, **how)
    return store.read_table(ws.spark, path)


add(
    "s5_write_table",
    lambda ws: _written(ws, "targets", ws.targets),
    "SELECT * FROM x_targets",
)
add(
    "s6_write_table_sorted",
    lambda ws: _written(
        ws, "etiquetas", ws.features.select("user_id", "product_id", "etiqueta"),
        order_by=["user_id", "product_id"],
    ),
    "SELECT user_id, product_id, etiqueta FROM x_features",
)
add("s7_publish_atomic", _published, "SELECT * FROM x_catalogo")
add(
    "s8_write_report",
    _report,
    "SELECT segmento_usuario, count(*) AS cantidad FROM x_usuarios GROUP BY 1",
)
add("raw_prior_lines", lambda ws: ws.prior, "SELECT * FROM x_prior")
add("raw_train_lines", lambda ws: ws.train, "SELECT * FROM x_train")
add("raw_products", lambda ws: ws.products, "SELECT * FROM x_products")

# checks -----------------------------------------------------------------------------------------

add(
    "v2_check_orders",
    lambda ws: validate.check_orders(ws.orders),
    """SELECT count(*) AS filas,
         count(*) FILTER (order_id IS NULL OR user_id IS NULL) AS claves_nulas,
         count(*) FILTER (coalesce(eval_set NOT IN ('prior', 'train', 'test'), true))
           AS eval_set_invalido,
         count(*) FILTER (coalesce(order_number < 1, true)) AS order_number_invalido,
         count(*) FILTER (coalesce(order_dow NOT BETWEEN 0 AND 6, true)) AS order_dow_invalido,
         count(*) FILTER (coalesce(TRY_CAST(order_hour_of_day AS INTEGER) NOT BETWEEN 0 AND 23, true))
           AS hora_invalida,
         count(*) FILTER (days_since_prior_order NOT BETWEEN 0 AND 30) AS dias_invalidos
       FROM x_orders""",
)
for _name in ("prior", "train"):
    add(
        f"v3_check_order_products_{_name}",
        lambda ws, n=_name: validate.check_order_products(getattr(ws, n)),
        f"""SELECT count(*) AS filas,
              count(*) FILTER (order_id IS NULL OR product_id IS NULL) AS claves_nulas,
              count(*) FILTER (coalesce(add_to_cart_order < 1, true)) AS posicion_invalida,
              count(*) FILTER (coalesce(reordered NOT IN (0, 1), true)) AS reordered_invalido
            FROM x_{_name}""",
    )


def _dup_sql(name: str, table: str, keys: str) -> str:
    return (
        f"SELECT '{name}' AS tabla, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS sobrantes "
        f"FROM (SELECT count(*) AS c FROM {table} GROUP BY {keys})"
    )


add(
    "v4_check_primary_keys",
    lambda ws: validate.check_primary_keys(ws.raw),
    " UNION ALL ".join(
        [
            _dup_sql("aisles", "x_aisles", "aisle_id"),
            _dup_sql("departments", "x_departments", "department_id"),
            _dup_sql("products", "x_products", "product_id"),
            _dup_sql("orders", "x_orders", "order_id"),
            _dup_sql("order_products_prior", "x_prior", "order_id, product_id"),
            _dup_sql("order_products_train", "x_train", "order_id, product_id"),
        ]
    ),
)


def _orphan_sql(label: str, child: str, key: str, parent: str) -> str:
    return (
        f"SELECT '{label}' AS relacion, count(*) AS huerfanas FROM {child} c "
        f"WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{key})"
    )


_PRIOR_ORDERS = "(SELECT * FROM x_orders WHERE eval_set = 'prior')"
_TRAIN_ORDERS = "(SELECT * FROM x_orders WHERE eval_set = 'train')"
add(
    "v5_check_foreign_keys",
    lambda ws: validate.check_foreign_keys(ws.raw),
    " UNION ALL ".join(
        [
            _orphan_sql("products.aisle_id", "x_products", "aisle_id", "x_aisles"),
            _orphan_sql("products.department_id", "x_products", "department_id", "x_departments"),
            _orphan_sql("prior.product_id", "x_prior", "product_id", "x_products"),
            _orphan_sql("train.product_id", "x_train", "product_id", "x_products"),
            _orphan_sql("prior.order_id", "x_prior", "order_id", _PRIOR_ORDERS),
            _orphan_sql("train.order_id", "x_train", "order_id", _TRAIN_ORDERS),
        ]
    ),
)
add(
    "v6_source_gate",
    lambda ws: validate.source_gate(ws.raw),
    """SELECT
         (SELECT count(*) FROM x_prior WHERE product_id NOT IN (SELECT product_id FROM x_products))
           AS productos_huerfanos,
         (SELECT count(*) FROM (SELECT 1 FROM x_prior GROUP BY order_id, product_id
                                HAVING count(*) > 1)) AS pares_duplicados,
         abs(count(*) FILTER (days_since_prior_order IS NULL) - count(DISTINCT user_id))
           AS primeras_de_mas,
         count(*) FILTER (order_number NOT BETWEEN 1 AND 100) AS order_number_fuera
       FROM x_orders""",
)
add(
    "v7_conservation_gate",
    lambda ws: validate.conservation_gate(
        ws.raw,
        {
            "catalogo": ws.catalog, "targets_train": ws.targets, "productos": ws.items,
            "usuarios": ws.users, "interacciones": ws.interactions,
        },
    ),
    """SELECT *, construido - origen AS diferencia FROM (
         SELECT 'catalogo' AS control, (SELECT count(*) FROM x_catalogo) AS construido,
                (SELECT count(*) FROM x_products) AS origen
         UNION ALL SELECT 'targets_filas', (SELECT count(*) FROM x_targets),
                (SELECT count(*) FROM x_train)
         UNION ALL SELECT 'targets_usuarios', (SELECT count(DISTINCT user_id) FROM x_targets),
                (SELECT count(*) FROM x_orders WHERE eval_set = 'train')
         UNION ALL SELECT 'productos', (SELECT count(*) FROM x_productos),
                (SELECT count(*) FROM x_catalogo)
         UNION ALL SELECT 'productos_compras',
                (SELECT CAST(sum(cantidad_compras) AS BIGINT) FROM x_productos),
                (SELECT count(*) FROM x_prior)
         UNION ALL SELECT 'usuarios', (SELECT count(*) FROM x_usuarios),
                (SELECT count(DISTINCT user_id) FROM x_orders WHERE eval_set = 'prior')
         UNION ALL SELECT 'usuarios_compras',
                (SELECT CAST(sum(cantidad_compras) AS BIGINT) FROM x_usuarios),
                (SELECT count(*) FROM x_prior)
         UNION ALL SELECT 'interacciones_freq',
                (SELECT CAST(sum(freq_usuario_producto) AS BIGINT) FROM x_inter),
                (SELECT count(*) FROM x_prior))""",
)
add(
    "v8_user_profile_gate",
    lambda ws: validate.user_profile_gate(ws.users),
    """SELECT count(*) FILTER (tiene_primera_orden <> 1) AS sin_primera_orden,
         count(*) FILTER (mediana_dias_entre_ordenes_historicas < 0) AS mediana_negativa,
         count(*) FILTER ((cantidad_ordenes_historicas = 1)
                          <> (mediana_dias_entre_ordenes_historicas IS NULL)) AS mediana_inconsistente
       FROM x_usuarios""",
)
add(
    "v9_interaction_gate",
    lambda ws: validate.interaction_gate(ws.interactions),
    """SELECT count(*) - count(DISTINCT (user_id, product_id)) AS claves_duplicadas,
         count(*) FILTER (recencia_usuario_producto < 0) AS recencia_negativa,
         count(*) FILTER (dias_registrados_desde_ultima_compra < 0) AS dias_negativos,
         count(*) FILTER (recencia_usuario_producto = 0
                          AND dias_registrados_desde_ultima_compra <> 0) AS ultima_orden_con_dias
       FROM x_inter""",
)
add(
    "v11_split_gate",
    lambda ws: validate.split_gate(ws.split, ws.features),
    """SELECT (SELECT count(*) FROM (SELECT user_id FROM x_split WHERE split = 'train'
                 INTERSECT SELECT user_id FROM x_split WHERE split = 'valid')) AS usuarios_cruzados,
         count(*) FILTER (etiqueta IS NULL) AS sin_etiqueta,
         CAST(sum(etiqueta) AS BIGINT) AS positivos,
         count(*) FILTER (ratio_usuario_producto IS NULL) AS nulos_ratio,
         count(*) FILTER (ciclos_desde_ultima_compra IS NULL) AS nulos_ciclos,
         count(*) FILTER (posicion_relativa IS NULL) AS nulos_posicion,
         count(DISTINCT user_id) FILTER (ciclos_desde_ultima_compra IS NULL)
           AS usuarios_con_ciclo_nulo
       FROM x_features""",
)
def _observed_sql(rows: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name.split('.')[0]}' AS tabla, '{name.split('.')[1]}' AS control, "
        f"CAST({built} AS BIGINT) AS construido, CAST({source} AS BIGINT) AS origen"
        for name, (built, source) in rows.items()
    )


def _where(table: str, cond: str) -> tuple[str, str]:
    return f"(SELECT count(*) FROM {table} WHERE {cond})", "0"


_COUNT = "(SELECT count(*) FROM {})".format
_BUYS = "(SELECT count(*) FROM x_prior)"
add(
    "v6_observed_checks",
    _observed,
    _observed_sql({
        "orders.claves_nulas": _where("x_orders", "order_id IS NULL OR user_id IS NULL"),
        "orders.eval_set_invalido": _where("x_orders", "coalesce(eval_set NOT IN ('prior', 'train', 'test'), true)"),
        "orders.order_number_invalido": _where("x_orders", "coalesce(order_number < 1, true)"),
        "orders.order_number_fuera": _where("x_orders", "coalesce(order_number NOT BETWEEN 1 AND 100, true)"),
        "orders.order_dow_invalido": _where("x_orders", "coalesce(order_dow NOT BETWEEN 0 AND 6, true)"),
        "orders.hora_invalida": _where(
            "x_orders", "coalesce(TRY_CAST(order_hour_of_day AS INTEGER) NOT BETWEEN 0 AND 23, true)"),
        "orders.dias_invalidos": _where("x_orders", "days_since_prior_order NOT BETWEEN 0 AND 30"),
        "order_products.claves_nulas": _where("x_prior", "order_id IS NULL OR product_id IS NULL"),
        "order_products.posicion_invalida": _where("x_prior", "coalesce(add_to_cart_order < 1, true)"),
        "order_products.reordered_invalido": _where("x_prior", "coalesce(reordered NOT IN (0, 1), true)"),
        "catalogo.productos": (_COUNT("x_catalogo"), _COUNT("x_products")),
        "targets_train.lineas": (_COUNT("x_targets"), _COUNT("x_train")),
        "targets_train.claves_nulas": _where("x_targets", "user_id IS NULL OR product_id IS NULL"),
        "order_timeline.primeras": (
            "(SELECT count(DISTINCT user_id) FROM x_orders WHERE eval_set = 'prior')",
            "(SELECT count(*) FROM x_orders WHERE eval_set = 'prior' AND days_since_prior_order IS NULL)"),
        "pair_history.lineas": (_BUYS, _BUYS),
        "pair_history.sin_pedido": _where(
            "x_prior", "order_id NOT IN (SELECT order_id FROM x_orders WHERE eval_set = 'prior')"),
        "pair_history.repetidas": (
            "(SELECT count(*) - count(DISTINCT (order_id, product_id)) FROM x_prior)", "0"),
        "productos.catalogo": (_COUNT("x_productos"), _COUNT("x_catalogo")),
        "productos.compras": ("(SELECT sum(cantidad_compras) FROM x_productos)", _BUYS),
        "usuarios.usuarios": (
            _COUNT("x_usuarios"), "(SELECT count(DISTINCT user_id) FROM x_orders WHERE eval_set = 'prior')"),
        "usuarios.compras": ("(SELECT sum(cantidad_compras) FROM x_usuarios)", _BUYS),
        "usuarios.sin_primera_orden": _where("x_usuarios", "tiene_primera_orden <> 1"),
        "usuarios.mediana_negativa": _where("x_usuarios", "mediana_dias_entre_ordenes_historicas < 0"),
        "usuarios.mediana_inconsistente": _where(
            "x_usuarios",
            "(cantidad_ordenes_historicas = 1) <> (mediana_dias_entre_ordenes_historicas IS NULL)"),
        "interacciones.pares": (
            _COUNT("x_inter"),
            "(SELECT count(DISTINCT (o.user_id, p.product_id)) FROM x_prior p JOIN x_orders o USING (order_id))"),
        "interacciones.compras": ("(SELECT sum(freq_usuario_producto) FROM x_inter)", _BUYS),
        "interacciones.recencia_negativa": _where("x_inter", "recencia_usuario_producto < 0"),
        "interacciones.dias_negativos": _where("x_inter", "dias_registrados_desde_ultima_compra < 0"),
        "interacciones.ultima_orden_con_dias": _where(
            "x_inter", "recencia_usuario_producto = 0 AND dias_registrados_desde_ultima_compra <> 0"),
        "particion.sin_lado": _where("x_split", "coalesce(split NOT IN ('train', 'valid'), true)"),
        "features.sin_etiqueta": _where("x_features", "etiqueta IS NULL"),
        "features.nulos_ratio": _where("x_features", "ratio_usuario_producto IS NULL"),
        "features.nulos_posicion": _where("x_features", "posicion_relativa IS NULL"),
        "features.fuga": (
            """(SELECT count(*) FROM x_features f JOIN x_usuarios u USING (user_id)
                JOIN x_orders o ON o.user_id = f.user_id AND o.eval_set = 'train'
                WHERE o.order_number <= u.ultima_order_number)""", "0"),
        "dos_bloques.principal": (
            "(SELECT count(*) FROM x_blocks WHERE bloque = 'principal')", _COUNT("x_top10")),
        "candidatos_nuevos.nulos_o_rank": _where(
            "x_candidates", "user_id IS NULL OR product_id IS NULL OR score_candidate IS NULL OR candidate_rank < 1"),
        "candidatos_nuevos.completos": (
            """(SELECT count(*) FROM (SELECT user_id, count(*) AS n FROM x_candidates GROUP BY 1)
                JOIN x_quota USING (user_id) WHERE n >= objetivo)""", _COUNT("x_usuarios")),
    }),
)
add(
    "v12_split_users",
    lambda ws: validate.split_users(ws.split),
    "SELECT split, segmento_usuario, count(*) AS usuarios FROM x_split GROUP BY 1, 2",
)
add(
    "v12_split_summary",
    lambda ws: validate.split_summary(ws.features),
    """SELECT split, count(*) AS filas, count(DISTINCT user_id) AS usuarios,
         CAST(sum(etiqueta) AS BIGINT) AS positivos, avg(etiqueta) AS tasa_positivos,
         count(*)::DOUBLE / count(DISTINCT user_id) AS filas_por_usuario
       FROM x_features GROUP BY 1""",
    "tasa_positivos filas_por_usuario",
)
add(
    "v15_table_inventory",
    lambda ws: validate.table_inventory(ws.raw),
    f"""SELECT r.tabla, r.filas, k.clave, k.foraneas, k.grano FROM ({_RAW_COUNTS}) r
        JOIN (VALUES
          ('orders', 'order_id', '', 'order'),
          ('order_products_prior', 'order_id+product_id',
           'order_id->orders, product_id->products', 'item of a history order'),
          ('order_products_train', 'order_id+product_id',
           'order_id->orders, product_id->products', 'item of a target order'),
          ('products', 'product_id', 'aisle_id->aisles, department_id->departments', 'item'),
          ('aisles', 'aisle_id', '', 'aisle'),
          ('departments', 'department_id', '', 'department')
        ) k(tabla, clave, foraneas, grano) USING (tabla)""",
)

# builders ---------------------------------------------------------------------------------------

add("t1_catalog", lambda ws: ws.catalog, "SELECT * FROM x_catalogo")
add("t2_targets", lambda ws: ws.targets, "SELECT * FROM x_targets")
add(
    "t3_item_profile", lambda ws: ws.items, "SELECT * FROM x_productos",
    "reorder_rate_producto add_to_cart_order_promedio",
)
add(
    "t4_user_profile", lambda ws: ws.users, "SELECT * FROM x_usuarios",
    "reorder_rate_usuario posicion_media_carrito mediana_dias_entre_ordenes_historicas",
)
add(
    "t5_segment", lambda ws: ws.users.select("user_id", "segmento_usuario"),
    "SELECT user_id, segmento_usuario FROM x_usuarios",
)
add(
    "t6_segment_counts", lambda ws: tables.segment_counts(ws.users),
    "SELECT segmento_usuario, count(*) AS cantidad FROM x_usuarios GROUP BY 1",
)
add(
    "t7_cumulative_days",
    lambda ws: tables.cumulative_days(ws.orders),
    """SELECT user_id, order_id, order_number,
         sum(coalesce(days_since_prior_order, 0)) OVER (PARTITION BY user_id ORDER BY order_number
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS elapsed_days
       FROM x_orders WHERE eval_set = 'prior'""",
    "elapsed_days",
)
add(
    "t8_interactions", lambda ws: ws.interactions, "SELECT * FROM x_inter",
    "add_to_cart_order_promedio",
)
