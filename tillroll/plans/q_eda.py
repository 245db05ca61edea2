"""Registered queries: exploratory aggregates."""

from __future__ import annotations

from tillroll.operators import eda
from tillroll.plans.registry import add


def _depth(ws):
    return ws.store.table("perfil", lambda: eda.user_depth(ws.prior, ws.orders))


def _labelled(ws):
    return ws.store.table(
        "pares_etiquetados",
        lambda: eda.labelled_pairs(ws.interactions, ws.users, ws.items, ws.targets),
    )


def _variables(ws):
    return ws.store.table(
        "variables", lambda: eda.quality_variables(ws.prior, ws.orders, ws.pairs)
    )


def _baskets(ws):
    return ws.store.table("canastas", lambda: eda.basket_sizes(ws.prior, ws.catalog))


add(
    "v14_quality_ranges",
    lambda ws: eda.quality_ranges(ws.orders, ws.prior),
    """SELECT (SELECT min(add_to_cart_order) FROM x_prior) AS carrito_min,
         (SELECT max(add_to_cart_order) FROM x_prior) AS carrito_max,
         min(order_dow) AS dow_min, max(order_dow) AS dow_max, min(order_number) AS number_min,
         max(order_number) AS number_max, min(days_since_prior_order) AS dias_min,
         max(days_since_prior_order) AS dias_max,
         count(*) FILTER (days_since_prior_order IS NULL) AS dias_nulos
       FROM x_orders""",
    "dias_min dias_max",
)
add(
    "v14_quality_report",
    lambda ws: eda.quality_report(ws.raw),
    """SELECT 'pares_duplicados' AS control,
         (SELECT count(*) - count(DISTINCT order_id || '-' || product_id) FROM x_prior) AS valor
       UNION ALL SELECT 'productos_huerfanos', (SELECT count(DISTINCT product_id) FROM x_prior
         WHERE product_id NOT IN (SELECT product_id FROM x_products))
       UNION ALL SELECT 'nombres_duplicados',
         (SELECT count(*) - count(DISTINCT product_name) FROM x_products)
       UNION ALL SELECT 'categoria_missing',
         (SELECT count(*) FROM x_catalogo WHERE department = 'missing' OR aisle = 'missing')
       UNION ALL SELECT 'test_con_contenido', (SELECT count(*) FROM x_orders
         WHERE eval_set = 'test' AND order_id IN (SELECT order_id FROM x_prior))
       UNION ALL SELECT 'usuarios_evaluables', (SELECT count(*) FROM x_orders WHERE eval_set = 'train')
       UNION ALL SELECT 'max_order_number', (SELECT CAST(max(order_number) AS BIGINT) FROM x_orders)""",
)
add(
    "v14_hour_type",
    lambda ws: eda.hour_type(ws.orders),
    """SELECT CASE typeof(order_hour_of_day) WHEN 'VARCHAR' THEN 'string' END AS tipo,
         count(*) AS filas, count(*) FILTER (length(order_hour_of_day) <> 2) AS otro_formato
       FROM x_orders GROUP BY 1""",
)
add(
    "d1_partition_counts",
    lambda ws: eda.partition_counts(ws.orders),
    """SELECT eval_set, count(*) AS pedidos, count(DISTINCT user_id) AS usuarios
       FROM x_orders GROUP BY 1""",
)
add("d2_user_depth", _depth, "SELECT * FROM x_depth", "reorder_rate")
add(
    "d2_depth_describe",
    lambda ws: eda.describe(_depth(ws), ["n_orders", "distinct_products", "reorder_rate"]),
    """SELECT variable, avg(valor) AS media, quantile_cont(valor, 0.25) AS p25,
         quantile_cont(valor, 0.5) AS p50, quantile_cont(valor, 0.75) AS p75,
         quantile_cont(valor, 0.9) AS p90
       FROM (SELECT 'n_orders' AS variable, n_orders::DOUBLE AS valor FROM x_depth
             UNION ALL SELECT 'distinct_products', distinct_products::DOUBLE FROM x_depth
             UNION ALL SELECT 'reorder_rate', reorder_rate FROM x_depth) GROUP BY 1""",
    "media p25 p50 p75 p90",
)
add(
    "d3_segment_profile",
    lambda ws: eda.segment_profile(_depth(ws)),
    """SELECT segmento, count(*) AS usuarios, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct,
         avg(distinct_products) AS productos_distintos, avg(reorder_rate) AS tasa_recompra
       FROM x_depth JOIN x_user_seg USING (user_id) GROUP BY 1""",
    "pct productos_distintos tasa_recompra",
)
_CURVE = """
    SELECT row_number() OVER (ORDER BY c DESC, product_id) AS puesto, product_id,
      CAST(c AS BIGINT) AS compras,
      sum(c) OVER (ORDER BY c DESC, product_id ROWS UNBOUNDED PRECEDING) / sum(c) OVER () AS acumulado
    FROM x_item_counts"""
add("d4_concentration_curve", lambda ws: eda.concentration_curve(ws.prior), _CURVE, "acumulado")
add(
    "d4_concentration",
    lambda ws: eda.concentration(ws.prior, ws.products),
    f"""SELECT umbral, min(puesto) AS productos,
          min(puesto)::DOUBLE / (SELECT count(*) FROM x_products) AS pct_catalogo
        FROM ({_CURVE}) JOIN (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) u(umbral)
          ON acumulado >= umbral GROUP BY 1""",
    "umbral pct_catalogo",
)
add(
    "d5_never_bought",
    lambda ws: eda.never_bought(ws.prior, ws.products),
    """SELECT (SELECT count(*) FROM x_products
               WHERE product_id NOT IN (SELECT product_id FROM x_prior)) AS productos_nunca_comprados,
         sum(reordered)::DOUBLE / count(*) AS reorder_global FROM x_prior""",
    "reorder_global",
)
_TOPS = """
    SELECT *, count(*) OVER (PARTITION BY product_id) > 1 AS en_ambos FROM (
      SELECT segmento, row_number() OVER (PARTITION BY segmento ORDER BY n DESC, product_id)
               AS puesto, product_id, n
      FROM x_seg_lines WHERE segmento <> 'medio' QUALIFY puesto <= 10)"""
add(
    "d6_segment_top_items",
    lambda ws: eda.segment_top_items(ws.prior, ws.orders, _depth(ws)),
    f"SELECT * REPLACE (CAST(puesto AS INTEGER) AS puesto) FROM ({_TOPS})",
)
add(
    "d6_segment_overlap",
    lambda ws: eda.segment_overlap(eda.segment_top_items(ws.prior, ws.orders, _depth(ws))),
    f"SELECT count(*) FILTER (segmento = 'nuevo' AND en_ambos) AS en_comun FROM ({_TOPS})",
)
add(
    "d7_department_share",
    lambda ws: eda.department_share(ws.prior, ws.catalog),
    """SELECT department, count(*) AS compras,
         100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct_compras,
         avg(reordered) AS reorder_rate
       FROM x_prior JOIN x_catalogo USING (product_id) GROUP BY 1""",
    "pct_compras reorder_rate",
)
add(
    "d8_segment_department_shift",
    lambda ws: eda.segment_department_shift(ws.prior, ws.orders, _depth(ws), ws.catalog, 8),
    """SELECT * FROM (
         SELECT department, heavy, nuevo, heavy - nuevo AS dif FROM (
           SELECT department,
             100.0::DOUBLE * coalesce(sum(n) FILTER (segmento = 'heavy'), 0)
               / sum(sum(n) FILTER (segmento = 'heavy')) OVER () AS heavy,
             100.0::DOUBLE * coalesce(sum(n) FILTER (segmento = 'nuevo'), 0)
               / sum(sum(n) FILTER (segmento = 'nuevo')) OVER () AS nuevo
           FROM x_seg_lines JOIN x_catalogo USING (product_id) GROUP BY 1))
       ORDER BY abs(dif) DESC, department LIMIT 8""",
    "heavy nuevo dif",
)
add("d9_basket_sizes", _baskets, "SELECT * FROM x_basket")
add(
    "d9_basket_histogram",
    lambda ws: eda.basket_histogram(_baskets(ws)),
    """SELECT 'items' AS variable, least(n_items, 40) AS bin, count(*) AS pedidos
       FROM x_basket GROUP BY 2
       UNION ALL SELECT 'departamentos', least(n_deptos, 15), count(*) FROM x_basket GROUP BY 2""",
)
add(
    "d9_basket_medians",
    lambda ws: eda.basket_medians(_baskets(ws)),
    """SELECT 'n_items' AS variable, median(n_items) AS mediana FROM x_basket
       UNION ALL SELECT 'n_deptos', median(n_deptos) FROM x_basket""",
    "mediana",
)
add(
    "d10_reorder_by_position",
    lambda ws: eda.reorder_by_position(ws.prior, 50),
    """SELECT add_to_cart_order AS posicion, count(*) AS n, avg(reordered) AS reorder_rate
       FROM x_prior GROUP BY 1 HAVING count(*) > 50 ORDER BY 1 LIMIT 20""",
    "reorder_rate",
)
add(
    "d10_reorder_first_positions",
    lambda ws: eda.reorder_by_position(ws.prior, 0, None, 25),
    """SELECT add_to_cart_order AS posicion, count(*) AS n, avg(reordered) AS reorder_rate
       FROM x_prior WHERE add_to_cart_order <= 25 GROUP BY 1""",
    "reorder_rate",
)
for _col in ("order_dow", "order_hour_of_day"):
    add(
        f"d11_orders_by_{_col}",
        lambda ws, c=_col: eda.orders_by(ws.orders, c),
        f"""SELECT {_col}, count(*) AS pedidos,
              row_number() OVER (ORDER BY count(*) DESC, {_col}) <= 2 AS es_pico
            FROM x_orders GROUP BY 1""",
    )
add(
    "d12_gap_distribution",
    lambda ws: eda.gap_distribution(ws.orders),
    """SELECT days_since_prior_order AS dias, count(*) AS pedidos,
         coalesce(days_since_prior_order IN (7, 30), false) AS es_pico
       FROM x_orders GROUP BY 1""",
    "dias",
)
_SKEW = """(sum(power(v - m, 3)) / count(*)) / power(any_value(s), 3)
           * sqrt(count(*)::DOUBLE * (count(*) - 1)) / (count(*) - 2)"""
add(
    "d13_distribution_summary",
    lambda ws: eda.distribution_summary(_variables(ws)),
    f"""SELECT q.*, z.asimetria, z.pct_sobre_cerco FROM (
          SELECT variable, min(valor) AS minimo, quantile_cont(valor, 0.5) AS p50,
            quantile_cont(valor, 0.9) AS p90, quantile_cont(valor, 0.95) AS p95,
            quantile_cont(valor, 0.99) AS p99, max(valor) AS maximo, avg(valor) AS media,
            stddev_pop(valor) AS desvio, quantile_cont(valor, 0.75)
              + 1.5 * (quantile_cont(valor, 0.75) - quantile_cont(valor, 0.25)) AS cerco
          FROM x_vars GROUP BY 1) q
        JOIN (SELECT variable, {_SKEW} AS asimetria,
                100.0::DOUBLE * count(*) FILTER (v > cerco) / count(*) AS pct_sobre_cerco
              FROM (SELECT variable, valor AS v FROM x_vars) JOIN (
                SELECT variable, avg(valor) AS m, stddev_pop(valor) AS s,
                  quantile_cont(valor, 0.75)
                    + 1.5 * (quantile_cont(valor, 0.75) - quantile_cont(valor, 0.25)) AS cerco
                FROM x_vars GROUP BY 1) USING (variable) GROUP BY 1) z USING (variable)""",
    "minimo p50 p90 p95 p99 maximo media desvio asimetria cerco pct_sobre_cerco",
)
add(
    "d14_histogram_vs_normal",
    lambda ws: eda.histogram_vs_normal(_variables(ws), 55, ["popularidad"]),
    f"""WITH v AS (SELECT variable,
              CASE WHEN variable = 'popularidad' THEN log10(valor) ELSE valor END AS v FROM x_vars),
        s AS (SELECT variable, count(*) AS n, min(v) AS lo, (max(v) - min(v)) / 55 AS width,
                avg(v) AS m, stddev_pop(v) AS s FROM v GROUP BY 1),
        k AS (SELECT variable, {_SKEW} AS asimetria FROM v JOIN s USING (variable) GROUP BY 1)
        SELECT variable, CAST(least(floor((v - lo) / width), 54) AS INTEGER) AS bin,
          count(*) AS filas, count(*) / (any_value(n) * any_value(width)) AS densidad,
          any_value(m) AS media, any_value(s) AS desvio, any_value(asimetria) AS asimetria
        FROM v JOIN s USING (variable) JOIN k USING (variable) GROUP BY 1, 2""",
    "densidad media desvio asimetria",
)
add(
    "d15_matrix_density",
    lambda ws: eda.matrix_density(ws.users, ws.items, ws.interactions),
    """SELECT *, pares / (usuarios::DOUBLE * productos) AS densidad FROM (
         SELECT (SELECT count(*) FROM x_usuarios) AS usuarios,
           (SELECT count(*) FROM x_productos) AS productos, count(*) AS pares FROM x_inter)""",
    "densidad",
)
add(
    "d16_labelled_pairs",
    _labelled,
    """SELECT freq_usuario_producto, recencia_usuario_producto, dias_registrados_desde_ultima_compra,
         add_to_cart_order_promedio, ultima_order_dow, cantidad_ordenes_historicas,
         segmento_usuario, dow_habitual, reorder_rate_producto, y FROM x_lab""",
    "add_to_cart_order_promedio reorder_rate_producto",
)
add(
    "d16_base_rate",
    lambda ws: eda.base_rate(_labelled(ws)),
    "SELECT count(*) AS pares, avg(y) AS tasa_base FROM x_lab",
    "tasa_base",
)
_CORR = " UNION ALL ".join(
    f"SELECT '{n}' AS variable, corr({c}, y) AS corr FROM x_lab"
    for n, c in (
        ("ratio", "ratio"), ("frecuencia", "freq_usuario_producto"),
        ("dias_desde_ultima", "dias_registrados_desde_ultima_compra"),
        ("recencia", "recencia_usuario_producto"),
        ("reorder_rate_producto", "reorder_rate_producto"),
        ("posicion_promedio", "add_to_cart_order_promedio"),
    )
)
add(
    "d17_feature_label_correlation",
    lambda ws: eda.feature_label_correlation(_labelled(ws)),
    f"SELECT variable, corr, abs(corr) AS senal FROM ({_CORR})",
    "corr senal",
)
_DAYS, _CART = "dias_registrados_desde_ultima_compra", "add_to_cart_order_promedio"
add(
    "d18_reorder_prob_by_bin",
    lambda ws: eda.reorder_prob_by_bin(_labelled(ws)),
    f"""SELECT variable, bin, avg(y) AS prob, min(v)::DOUBLE AS desde, count(*) AS n FROM (
          SELECT 'ratio' AS variable, printf('%.1f', floor(least(ratio, 1) * 10 + 0.5::DOUBLE) / 10) AS bin,
            ratio AS v, y FROM x_lab
          UNION ALL SELECT 'frecuencia', CAST(least(freq_usuario_producto, 10) AS VARCHAR),
            least(freq_usuario_producto, 10), y FROM x_lab
          UNION ALL SELECT 'dias', CASE WHEN {_DAYS} < 7 THEN '0-6' WHEN {_DAYS} < 14 THEN '7-13'
            WHEN {_DAYS} < 21 THEN '14-20' WHEN {_DAYS} < 30 THEN '21-29' ELSE '30+' END,
            {_DAYS}, y FROM x_lab
          UNION ALL SELECT 'reorder_rate',
            printf('%.1f', floor(reorder_rate_producto * 10 + 0.5::DOUBLE) / 10),
            reorder_rate_producto, y FROM x_lab WHERE reorder_rate_producto <= 0.9
          UNION ALL SELECT 'carrito', CASE WHEN {_CART} >= 10 THEN '10+' WHEN {_CART} >= 6 THEN '6-10'
            WHEN {_CART} >= 3 THEN '3-6' ELSE '1-3' END, {_CART}, y FROM x_lab) GROUP BY 1, 2""",
    "prob desde",
)
add(
    "d19_reorder_prob_by_segment",
    lambda ws: eda.reorder_prob_by_segment(_labelled(ws)),
    "SELECT segmento_usuario, avg(y) AS prob, count(*) AS n FROM x_lab GROUP BY 1",
    "prob",
)
_EXAMPLES = """
    SELECT segmento_usuario, user_id, cantidad_ordenes_historicas, n AS n_objetivos, k AS n_nuevos
    FROM x_usuarios JOIN (
      SELECT user_id, count(*) AS n, count(*) FILTER (reordered = 0) AS k FROM x_targets GROUP BY 1)
      USING (user_id)
    WHERE n BETWEEN 6 AND 10
    QUALIFY row_number() OVER (PARTITION BY segmento_usuario ORDER BY user_id) = 1"""
add(
    "d20_example_users",
    lambda ws: eda.example_users(ws.users, ws.targets),
    _EXAMPLES,
)
add(
    "d20_qualitative_cases",
    lambda ws: eda.qualitative_cases(ws.users, ws.targets, ws.interactions),
    f"""SELECT e.segmento_usuario, e.user_id,
          CAST(row_number() OVER (PARTITION BY e.user_id ORDER BY
            freq_usuario_producto::DOUBLE / cantidad_ordenes_historicas DESC,
            recencia_usuario_producto, freq_usuario_producto DESC, i.product_id) AS INTEGER) AS rank,
          i.product_id, freq_usuario_producto, t.user_id IS NOT NULL AS en_su_proximo_pedido,
          n_objetivos, n_nuevos
        FROM ({_EXAMPLES}) e JOIN x_inter i USING (user_id)
        LEFT JOIN x_truth_all t ON t.user_id = i.user_id AND t.product_id = i.product_id
        QUALIFY rank <= 10""",
)
add(
    "d22_items_per_aisle",
    lambda ws: eda.items_per_aisle(ws.catalog),
    """SELECT count(*) AS pasillos, avg(n) AS promedio, median(n) AS mediana, max(n) AS maximo
       FROM (SELECT count(*) AS n FROM x_catalogo GROUP BY aisle_id)""",
    "promedio mediana",
)
_DOW = ", ".join(
    f"count(*) FILTER (order_dow = {d})::DOUBLE / count(*) AS dia_{d}" for d in range(7)
)
_SEASON = ", ".join(f"dia_{d} * dia_{d} / avg(dia_{d}) OVER ()" for d in range(7))
add(
    "d23_department_dow_share",
    lambda ws: eda.department_dow_share(ws.prior, ws.orders, ws.catalog),
    f"""SELECT *, greatest({_SEASON}) AS indice FROM (
          SELECT department, {_DOW} FROM x_prior JOIN x_orders USING (order_id)
          JOIN x_catalogo USING (product_id) GROUP BY 1)""",
    "dia_0 dia_1 dia_2 dia_3 dia_4 dia_5 dia_6 indice",
)
