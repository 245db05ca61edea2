"""Plain SQL for the same results, written independently of the Spark jobs.

`CTES` holds one named step per table; `sql` puts the steps a query uses in front of it. The SQL
takes the direct route (windows over whole users, cross joins, one join per flag), so it shares no
logic with the distributed jobs it is compared with.
"""

from __future__ import annotations

import re

from tillroll.functions.columns import GENERIC_WORDS

_STOP = ", ".join(f"'{w}'" for w in GENERIC_WORDS)


def _tokens(col: str) -> str:
    return (
        "list_filter(list_distinct(string_split(lower(regexp_replace("
        f"{col}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')), "
        f"lambda w: length(w) > 2 AND NOT list_contains([{_STOP}], w))"
    )


CTES: dict[str, str] = {
    # raw tables
    "x_part": """
        SELECT *, aisle_id * 10 + department_id AS product_id FROM (
          SELECT p_partkey, p_name, p_brand AS aisle, p_type AS department,
                 CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS aisle_id,
                 CAST(list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'], p_type)
                      AS INTEGER) AS department_id
          FROM part)""",
    "x_products": """
        SELECT product_id, min_by(p_name, p_partkey) AS product_name, min(aisle_id) AS aisle_id,
               min(department_id) AS department_id
        FROM x_part GROUP BY product_id""",
    "x_aisles": "SELECT DISTINCT aisle_id, aisle FROM x_part",
    "x_departments": "SELECT DISTINCT department_id, department FROM x_part",
    "x_lines": """
        SELECT order_id, product_id,
               CAST(row_number() OVER (PARTITION BY order_id ORDER BY line, product_id) AS INTEGER)
                 AS add_to_cart_order
        FROM (SELECT l_orderkey AS order_id, product_id, min(l_linenumber) AS line
              FROM lineitem JOIN x_part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    "x_placed": """
        SELECT o_orderkey AS order_id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS num,
               count(*) OVER (PARTITION BY o_custkey) AS total,
               lag(CAST(o_orderdate AS DATE))
                 OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before
        FROM orders WHERE o_orderkey IN (SELECT order_id FROM x_lines)""",
    "x_orders": """
        SELECT order_id, user_id,
               CASE WHEN num < total THEN 'prior' WHEN user_id % 10 = 0 THEN 'test'
                    ELSE 'train' END AS eval_set,
               CAST(num AS INTEGER) AS order_number,
               CAST(dayofweek(day) AS INTEGER) AS order_dow,
               lpad(CAST(order_id % 24 AS VARCHAR), 2, '0') AS order_hour_of_day,
               CASE WHEN before IS NOT NULL
                    THEN CAST(least(30, (day - before) // 10) AS DOUBLE) END
                 AS days_since_prior_order
        FROM x_placed WHERE total >= 2""",
    "x_all_lines": """
        SELECT l.order_id, l.product_id, l.add_to_cart_order, o.user_id, o.eval_set,
               CAST(row_number() OVER (PARTITION BY o.user_id, l.product_id
                                       ORDER BY o.order_number) > 1 AS INTEGER) AS reordered
        FROM x_lines l JOIN x_orders o USING (order_id)""",
    "x_prior": """
        SELECT order_id, product_id, add_to_cart_order, reordered
        FROM x_all_lines WHERE eval_set = 'prior'""",
    "x_train": """
        SELECT order_id, product_id, add_to_cart_order, reordered
        FROM x_all_lines WHERE eval_set = 'train'""",
    # built tables
    "x_catalogo": """
        SELECT product_id, product_name, aisle_id, aisle, department_id, department
        FROM x_products JOIN x_aisles USING (aisle_id) JOIN x_departments USING (department_id)""",
    "x_targets": """
        SELECT o.user_id, t.order_id, t.product_id, t.add_to_cart_order,
               CAST(t.reordered AS TINYINT) AS reordered
        FROM x_train t JOIN x_orders o USING (order_id)""",
    "x_hist": """
        SELECT l.*, o.user_id, o.order_number, o.order_dow,
               CAST(o.order_hour_of_day AS INTEGER) AS order_hour, o.elapsed, o.n_orders,
               o.n_orders - o.pos + 1 AS from_end
        FROM x_prior l JOIN (
          SELECT *, sum(coalesce(days_since_prior_order, 0))
                      OVER (PARTITION BY user_id ORDER BY order_number) AS elapsed,
                 row_number() OVER (PARTITION BY user_id ORDER BY order_number) AS pos,
                 count(*) OVER (PARTITION BY user_id) AS n_orders
          FROM x_orders WHERE eval_set = 'prior') o USING (order_id)""",
    "x_productos": """
        SELECT c.*, CAST(coalesce(n, 0) AS BIGINT) AS cantidad_compras,
               CAST(coalesce(u, 0) AS INTEGER) AS cantidad_usuarios,
               coalesce(r, 0.0) AS reorder_rate_producto, p AS add_to_cart_order_promedio
        FROM x_catalogo c LEFT JOIN (
          SELECT product_id, count(*) AS n, count(DISTINCT user_id) AS u, avg(reordered) AS r,
                 avg(add_to_cart_order) AS p
          FROM x_hist GROUP BY 1) USING (product_id)""",
    "x_usuarios": """
        WITH o AS (
          SELECT user_id, count(*) AS n, max(order_number) AS last,
                 median(days_since_prior_order) AS med,
                 count(*) FILTER (days_since_prior_order IS NULL) AS firsts,
                 count(*) FILTER (days_since_prior_order = 30) AS censored
          FROM x_orders WHERE eval_set = 'prior' GROUP BY 1),
        dow AS (
          SELECT user_id, arg_min(v, (-c, v)) AS v FROM (
            SELECT user_id, order_dow AS v, count(*) AS c FROM x_orders
            WHERE eval_set = 'prior' GROUP BY 1, 2) GROUP BY 1),
        hr AS (
          SELECT user_id, arg_min(v, (-c, v)) AS v FROM (
            SELECT user_id, CAST(order_hour_of_day AS INTEGER) AS v, count(*) AS c FROM x_orders
            WHERE eval_set = 'prior' GROUP BY 1, 2) GROUP BY 1),
        l AS (
          SELECT user_id, count(*) AS n, count(DISTINCT product_id) AS items, avg(reordered) AS r,
                 avg(add_to_cart_order) AS p
          FROM x_hist GROUP BY 1)
        SELECT o.user_id, CAST(o.n AS INTEGER) AS cantidad_ordenes_historicas,
               o.last AS ultima_order_number, l.n AS cantidad_compras,
               CAST(l.items AS INTEGER) AS productos_distintos, l.r AS reorder_rate_usuario,
               l.p AS posicion_media_carrito, CAST(dow.v AS TINYINT) AS dow_habitual,
               CAST(hr.v AS TINYINT) AS hora_habitual,
               o.med AS mediana_dias_entre_ordenes_historicas,
               CAST(o.firsts > 0 AS TINYINT) AS tiene_primera_orden,
               CAST(o.censored > 0 AS TINYINT) AS tiene_intervalo_censurado_30,
               CAST(o.censored AS INTEGER) AS cantidad_intervalos_censurados_30,
               CASE WHEN o.n > 15 THEN 'heavy' WHEN o.n > 5 THEN 'medio' ELSE 'nuevo' END
                 AS segmento_usuario
        FROM o JOIN l USING (user_id) JOIN dow USING (user_id) JOIN hr USING (user_id)""",
    "x_inter": """
        SELECT h.user_id, h.product_id, CAST(count(*) AS INTEGER) AS freq_usuario_producto,
               CAST(any_value(u.last) - max(order_number) AS INTEGER) AS recencia_usuario_producto,
               CAST(any_value(u.days) - max_by(elapsed, order_number) AS INTEGER)
                 AS dias_registrados_desde_ultima_compra,
               max(order_number) AS ultima_orden_producto,
               avg(add_to_cart_order) AS add_to_cart_order_promedio,
               CAST(max_by(order_dow, order_number) AS TINYINT) AS ultima_order_dow,
               CAST(max_by(order_hour, order_number) AS TINYINT) AS ultima_order_hour,
               any_value(c.aisle_id) AS aisle_id, any_value(c.department_id) AS department_id
        FROM x_hist h
        JOIN (SELECT user_id, max(order_number) AS last, max(elapsed) AS days FROM x_hist GROUP BY 1) u
          USING (user_id)
        JOIN x_catalogo c USING (product_id)
        GROUP BY 1, 2""",
    # features
    "x_evaluables": """
        SELECT user_id, segmento_usuario FROM x_usuarios
        WHERE user_id IN (SELECT user_id FROM x_targets)""",
    "x_split": """
        SELECT user_id, segmento_usuario,
               CASE WHEN pos <= n * 0.8::DOUBLE THEN 'train' ELSE 'valid' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY segmento_usuario
                                           ORDER BY md5(user_id || ':42'), user_id) AS pos,
                     count(*) OVER (PARTITION BY segmento_usuario) AS n
              FROM x_evaluables)""",
    "x_truth_all": "SELECT DISTINCT user_id, product_id FROM x_targets",
    "x_context": """
        SELECT user_id, days_since_prior_order AS dias_hasta_orden_objetivo,
               CAST(order_dow AS TINYINT) AS dow_orden_objetivo,
               CAST(order_hour_of_day AS TINYINT) AS hora_orden_objetivo
        FROM x_orders WHERE eval_set = 'train'""",
    "x_cadence": """
        SELECT user_id, product_id,
               CASE WHEN count(*) > 1 THEN (max(elapsed) - min(elapsed)) / (count(*) - 1) END
                 AS cadencia_par
        FROM x_hist GROUP BY 1, 2""",
    "x_features": """
        SELECT i.user_id, i.product_id, s.split, s.segmento_usuario, i.freq_usuario_producto,
          i.recencia_usuario_producto, i.dias_registrados_desde_ultima_compra,
          i.add_to_cart_order_promedio AS posicion_par, i.ultima_order_dow AS dow_ultima_compra,
          i.ultima_order_hour AS hora_ultima_compra, u.cantidad_ordenes_historicas,
          u.productos_distintos, u.reorder_rate_usuario, u.posicion_media_carrito,
          u.mediana_dias_entre_ordenes_historicas, p.cantidad_compras AS popularidad_producto,
          p.cantidad_usuarios AS usuarios_del_producto, p.reorder_rate_producto,
          i.freq_usuario_producto::DOUBLE / u.cantidad_ordenes_historicas AS ratio_usuario_producto,
          i.dias_registrados_desde_ultima_compra::DOUBLE
            / nullif(u.mediana_dias_entre_ordenes_historicas, 0) AS ciclos_desde_ultima_compra,
          i.recencia_usuario_producto::DOUBLE / u.cantidad_ordenes_historicas AS recencia_relativa,
          i.add_to_cart_order_promedio / nullif(u.posicion_media_carrito, 0) AS posicion_relativa,
          c.dias_hasta_orden_objetivo, c.dow_orden_objetivo, c.hora_orden_objetivo,
          i.dias_registrados_desde_ultima_compra + c.dias_hasta_orden_objetivo
            AS dias_sin_comprar_total,
          k.cadencia_par,
          (i.dias_registrados_desde_ultima_compra + c.dias_hasta_orden_objetivo)
            / nullif(k.cadencia_par, 0) AS vencimiento,
          (i.dias_registrados_desde_ultima_compra + c.dias_hasta_orden_objetivo)
            / nullif(u.mediana_dias_entre_ordenes_historicas, 0) AS ciclos_totales,
          CAST(t.user_id IS NOT NULL AS INTEGER) AS etiqueta
        FROM x_inter i JOIN x_split s USING (user_id) JOIN x_usuarios u USING (user_id)
        JOIN x_productos p USING (product_id) JOIN x_context c USING (user_id)
        LEFT JOIN x_cadence k ON k.user_id = i.user_id AND k.product_id = i.product_id
        LEFT JOIN x_truth_all t ON t.user_id = i.user_id AND t.product_id = i.product_id""",
    "x_affinity": """
        SELECT user_id, aisle_id, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id)
                 AS afinidad_pasillo
        FROM x_hist JOIN x_catalogo USING (product_id) GROUP BY 1, 2""",
    "x_new_features": """
        SELECT h.user_id, h.product_id, CAST(min(from_end) = 1 AS INTEGER) AS comprado_en_ultima,
          count(*) FILTER (from_end <= 3)::DOUBLE / least(3, any_value(n_orders)) AS ratio_ultimas_3,
          count(*) FILTER (from_end <= 5)::DOUBLE / least(5, any_value(n_orders)) AS ratio_ultimas_5,
          count(*) FILTER (from_end <= 5)::DOUBLE / least(5, any_value(n_orders))
            - count(*)::DOUBLE / any_value(n_orders) AS tendencia,
          any_value(a.afinidad_pasillo) AS afinidad_pasillo,
          max(from_end)::DOUBLE / any_value(n_orders) AS antiguedad_par
        FROM x_hist h JOIN x_catalogo c USING (product_id)
        JOIN x_affinity a ON a.user_id = h.user_id AND a.aisle_id = c.aisle_id
        GROUP BY 1, 2""",
    # evaluation inputs
    "x_valid": "SELECT user_id, segmento_usuario AS segmento FROM x_split WHERE split = 'valid'",
    "x_truth": "SELECT t.* FROM x_truth_all t SEMI JOIN x_valid USING (user_id)",
    "x_history": "SELECT user_id, product_id FROM x_inter SEMI JOIN x_valid USING (user_id)",
    "x_popular": """
        SELECT product_id, row_number() OVER (ORDER BY cantidad_compras DESC, product_id) AS rank
        FROM x_productos""",
    "x_rank_pop": """
        SELECT user_id, product_id, rank FROM x_valid, x_popular WHERE rank <= 10""",
    "x_rank_rep": """
        SELECT user_id, product_id, row_number() OVER (PARTITION BY user_id
                 ORDER BY ratio_usuario_producto DESC, recencia_usuario_producto, product_id) AS rank
        FROM x_features WHERE split = 'valid' QUALIFY rank <= 10""",
    "x_heur": """
        SELECT user_id, product_id, split,
               0.5::DOUBLE * ratio_usuario_producto
                 + 0.35::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + recencia_usuario_producto))
                 + 0.15::DOUBLE * reorder_rate_producto AS score
        FROM x_features""",
    "x_ranking": """
        SELECT user_id, product_id,
               row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product_id) AS rank
        FROM x_heur WHERE split = 'valid' QUALIFY rank <= 30""",
    "x_top10": "SELECT * FROM x_ranking WHERE rank <= 10",
    "x_systems": """
        SELECT 'popularidad' AS modelo, * FROM x_rank_pop
        UNION ALL BY NAME SELECT 'recompra_personal' AS modelo, * FROM x_rank_rep
        UNION ALL BY NAME SELECT 'heuristica' AS modelo, * FROM x_top10""",
    # rules
    "x_n": "SELECT count(DISTINCT order_id)::DOUBLE AS n FROM x_prior",
    "x_lim": "SELECT 5 AS min_orders, 3 AS min_pairs, 0.05::DOUBLE AS min_conf",
    "x_support": """
        SELECT product_id, count(*) AS ordenes_con FROM x_prior GROUP BY 1
        HAVING count(*) >= (SELECT min_orders FROM x_lim)""",
    "x_pairs": """
        SELECT p.product_id AS a, q.product_id AS b, count(*) AS ordenes_juntos
        FROM x_prior p JOIN x_prior q ON p.order_id = q.order_id AND p.product_id < q.product_id
        WHERE p.product_id IN (SELECT product_id FROM x_support)
          AND q.product_id IN (SELECT product_id FROM x_support)
        GROUP BY 1, 2 HAVING count(*) >= (SELECT min_pairs FROM x_lim)""",
    "x_rules": """
        SELECT d.x AS producto_a_id, d.y AS producto_b_id, cx.product_name AS si_compra,
               cy.product_name AS tambien_lleva, cx.aisle AS pasillo_a, cy.aisle AS pasillo_b,
               cx.aisle = cy.aisle AS mismo_pasillo, d.ordenes_juntos,
               d.ordenes_juntos::DOUBLE / n AS soporte,
               d.ordenes_juntos::DOUBLE / sx.ordenes_con AS confianza,
               (d.ordenes_juntos::DOUBLE / sx.ordenes_con) / (sy.ordenes_con::DOUBLE / n) AS lift
        FROM (SELECT a AS x, b AS y, ordenes_juntos FROM x_pairs
              UNION ALL SELECT b, a, ordenes_juntos FROM x_pairs) d
        CROSS JOIN x_n
        JOIN x_support sx ON sx.product_id = d.x JOIN x_support sy ON sy.product_id = d.y
        JOIN x_catalogo cx ON cx.product_id = d.x JOIN x_catalogo cy ON cy.product_id = d.y
        WHERE d.ordenes_juntos::DOUBLE / sx.ordenes_con >= (SELECT min_conf FROM x_lim)""",
    "x_flagged": f"""
        SELECT *, mismo_pasillo OR es_variante AS descartada FROM (
          SELECT * EXCLUDE (ta, tb),
                 len(ta) > 0 AND len(tb) > 0
                   AND (len(list_intersect(ta, tb)) >= 2
                        OR len(list_intersect(ta, tb)) >= least(len(ta), len(tb))) AS es_variante
          FROM (SELECT *, {_tokens('si_compra')} AS ta, {_tokens('tambien_lleva')} AS tb
                FROM x_rules))""",
    "x_reglas": """
        SELECT * REPLACE (round(soporte, 5) AS soporte, round(confianza, 4) AS confianza,
                          round(lift, 2) AS lift)
        FROM x_flagged WHERE NOT descartada""",
    "x_index": """
        SELECT producto_a_id AS antecedente, producto_b_id AS product_id, confianza,
               row_number() OVER (PARTITION BY producto_a_id
                                  ORDER BY confianza DESC, producto_b_id) AS orden
        FROM x_reglas WHERE confianza >= 0.02 QUALIFY orden <= 15""",
    "x_suggest": """
        SELECT user_id, product_id, confianza,
               row_number() OVER (PARTITION BY user_id ORDER BY confianza DESC, product_id)
                 AS posicion
        FROM (SELECT h.user_id, r.product_id, max(r.confianza) AS confianza
              FROM x_history h JOIN x_index r ON r.antecedente = h.product_id
              WHERE NOT EXISTS (SELECT 1 FROM x_history k
                                WHERE k.user_id = h.user_id AND k.product_id = r.product_id)
              GROUP BY 1, 2)
        QUALIFY posicion <= 8""",
    "x_policy": "SELECT * FROM (VALUES ('nuevo', 5), ('medio', 2), ('heavy', 1)) p(segmento, n)",
    "x_blocks": """
        SELECT user_id, 'principal' AS bloque, CAST(rank AS INTEGER) AS posicion, product_id
        FROM x_top10
        UNION ALL
        SELECT s.user_id, 'sugerencia', CAST(s.posicion AS INTEGER), s.product_id
        FROM x_suggest s JOIN x_valid USING (user_id) JOIN x_policy p USING (segmento)
        WHERE s.posicion <= p.n AND s.user_id IN (SELECT user_id FROM x_top10)""",
    # candidates
    "x_item_score": """
        SELECT product_id, aisle_id, department_id,
               0.7::DOUBLE * ln(1 + cantidad_compras)
                 / nullif((SELECT max(ln(1 + cantidad_compras)) FROM x_productos), 0)
                 + 0.3::DOUBLE * reorder_rate_producto AS score_producto
        FROM x_productos""",
    "x_ranked_items": """
        SELECT *, row_number() OVER (PARTITION BY aisle_id
                    ORDER BY score_producto DESC, product_id) AS rank_pasillo,
               row_number() OVER (PARTITION BY department_id
                    ORDER BY score_producto DESC, product_id) AS rank_departamento,
               row_number() OVER (ORDER BY score_producto DESC, product_id) AS rank_global
        FROM x_item_score
        QUALIFY rank_pasillo <= 30 OR rank_departamento <= 40 OR rank_global <= 1000""",
    "x_affinities": """
        SELECT user_id, aisle_id, CAST(NULL AS INTEGER) AS department_id, n / t AS afinidad,
               'pasillo' AS fuente
        FROM (SELECT user_id, aisle_id, sum(freq_usuario_producto)::DOUBLE AS n,
                     sum(sum(freq_usuario_producto)) OVER (PARTITION BY user_id) AS t
              FROM x_inter GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, aisle_id) <= 3
        UNION ALL
        SELECT user_id, NULL, department_id, n / t, 'departamento'
        FROM (SELECT user_id, department_id, sum(freq_usuario_producto)::DOUBLE AS n,
                     sum(sum(freq_usuario_producto)) OVER (PARTITION BY user_id) AS t
              FROM x_inter GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, department_id) <= 2""",
    "x_pre_aisle": """
        SELECT a.user_id, i.product_id,
               0.6::DOUBLE * a.afinidad + 0.4::DOUBLE * i.score_producto AS score,
               'pasillo' AS fuente
        FROM x_affinities a JOIN x_ranked_items i USING (aisle_id)
        WHERE a.fuente = 'pasillo' AND i.rank_pasillo <= 30
        QUALIFY row_number() OVER (PARTITION BY a.user_id ORDER BY score DESC, i.product_id) <= 35""",
    "x_pre_dept": """
        SELECT a.user_id, i.product_id,
               0.5::DOUBLE * a.afinidad + 0.5::DOUBLE * i.score_producto AS score,
               'departamento' AS fuente
        FROM x_affinities a JOIN x_ranked_items i USING (department_id)
        WHERE a.fuente = 'departamento' AND i.rank_departamento <= 40
        QUALIFY row_number() OVER (PARTITION BY a.user_id ORDER BY score DESC, i.product_id) <= 25""",
    "x_pre_global": """
        SELECT u.user_id, i.product_id, 0.35::DOUBLE * i.score_producto AS score,
               'global' AS fuente
        FROM x_usuarios u CROSS JOIN x_ranked_items i WHERE i.rank_global <= 100
        QUALIFY row_number() OVER (PARTITION BY u.user_id ORDER BY score DESC, i.product_id) <= 40""",
    "x_pre": """
        SELECT * FROM x_pre_aisle UNION ALL SELECT * FROM x_pre_dept
        UNION ALL SELECT * FROM x_pre_global""",
    "x_new_pre": "SELECT p.* FROM x_pre p ANTI JOIN x_inter USING (user_id, product_id)",
    "x_unique": """
        SELECT user_id, product_id, max(score) AS score_candidate,
               string_agg(DISTINCT fuente, '+' ORDER BY fuente) AS fuentes
        FROM x_new_pre GROUP BY 1, 2""",
    "x_quota": """
        SELECT user_id, objetivo, least(coalesce(c, 0), objetivo) AS disponibles
        FROM (SELECT user_id, 20 + greatest(10 - productos_distintos, 0) AS objetivo
              FROM x_usuarios)
        LEFT JOIN (SELECT user_id, count(*) AS c FROM x_unique GROUP BY 1) USING (user_id)""",
    "x_fallback": """
        SELECT q.user_id, i.product_id, 0.2::DOUBLE * i.score_producto AS score_candidate,
               'respaldo' AS fuentes
        FROM x_quota q CROSS JOIN x_ranked_items i
        WHERE q.disponibles < q.objetivo AND i.rank_global <= 1000
          AND NOT EXISTS (SELECT 1 FROM x_inter b
                          WHERE b.user_id = q.user_id AND b.product_id = i.product_id)
          AND NOT EXISTS (SELECT 1 FROM x_unique b
                          WHERE b.user_id = q.user_id AND b.product_id = i.product_id)
        QUALIFY row_number() OVER (PARTITION BY q.user_id ORDER BY i.rank_global)
                <= q.objetivo - q.disponibles""",
    "x_candidates": """
        SELECT user_id, product_id,
               CAST(row_number() OVER (PARTITION BY user_id
                      ORDER BY score_candidate DESC, product_id) AS INTEGER) AS candidate_rank,
               score_candidate, fuentes
        FROM (SELECT * FROM x_unique UNION ALL SELECT * FROM x_fallback)
        JOIN x_quota USING (user_id) QUALIFY candidate_rank <= objetivo""",
    "x_base_count": """
        SELECT user_id, product_id, row_number() OVER (PARTITION BY user_id
                 ORDER BY freq_usuario_producto DESC, recencia_usuario_producto,
                          ultima_orden_producto DESC, product_id) AS rank
        FROM x_inter WHERE user_id IN (SELECT user_id FROM x_targets) QUALIFY rank <= 10""",
    "x_filled": """
        SELECT user_id, product_id, rank FROM x_base_count
        UNION ALL
        SELECT c.user_id, c.product_id, coalesce(b.n, 0) + c.candidate_rank
        FROM x_candidates c JOIN x_evaluables USING (user_id)
        LEFT JOIN (SELECT user_id, count(*) AS n FROM x_base_count GROUP BY 1) b USING (user_id)
        WHERE c.candidate_rank <= 10 - coalesce(b.n, 0)""",
    # exploration
    "x_depth": """
        SELECT user_id, count(DISTINCT order_id) AS n_orders, count(*) AS total_items,
               count(DISTINCT product_id) AS distinct_products, avg(reordered) AS reorder_rate
        FROM x_prior JOIN (SELECT order_id, user_id FROM x_orders) USING (order_id) GROUP BY 1""",
    "x_user_seg": """
        SELECT user_id, CASE WHEN n_orders <= 5 THEN 'nuevo' WHEN n_orders <= 15 THEN 'medio'
                             ELSE 'heavy' END AS segmento FROM x_depth""",
    "x_seg_lines": """
        SELECT s.segmento, p.product_id, count(*) AS n
        FROM x_prior p JOIN x_orders o USING (order_id) JOIN x_user_seg s USING (user_id)
        GROUP BY 1, 2""",
    "x_vars": """
        SELECT 'carrito' AS variable, count(*)::DOUBLE AS valor FROM x_prior GROUP BY order_id
        UNION ALL SELECT 'ordenes_usuario', count(*)::DOUBLE FROM x_orders
          WHERE eval_set = 'prior' GROUP BY user_id
        UNION ALL SELECT 'popularidad', count(*)::DOUBLE FROM x_prior GROUP BY product_id
        UNION ALL SELECT 'recompra_usuario', reorder_rate FROM x_depth""",
    "x_lab": """
        SELECT i.*, u.cantidad_ordenes_historicas, u.segmento_usuario, u.dow_habitual,
               p.reorder_rate_producto, CAST(t.user_id IS NOT NULL AS INTEGER) AS y,
               i.freq_usuario_producto::DOUBLE / u.cantidad_ordenes_historicas AS ratio
        FROM x_inter i JOIN x_usuarios u USING (user_id) JOIN x_productos p USING (product_id)
        LEFT JOIN x_truth_all t ON t.user_id = i.user_id AND t.product_id = i.product_id
        WHERE i.user_id IN (SELECT user_id FROM x_targets)""",
    "x_basket": """
        SELECT order_id, count(*) AS n_items, count(DISTINCT department_id) AS n_deptos
        FROM x_prior JOIN x_products USING (product_id) GROUP BY 1""",
    "x_item_counts": "SELECT product_id, count(*)::DOUBLE AS c FROM x_prior GROUP BY 1",
    "x_lifts": """
        SELECT a, b, ordenes_juntos, ordenes_juntos / n AS soporte,
               ordenes_juntos / sa.c AS conf_a_b, ordenes_juntos / sb.c AS conf_b_a,
               ordenes_juntos * n / (sa.c * sb.c) AS lift
        FROM x_top200_pairs CROSS JOIN x_n JOIN x_item_counts sa ON sa.product_id = a
        JOIN x_item_counts sb ON sb.product_id = b""",
}
for _top in (200, 400):
    CTES[f"x_top{_top}_pairs"] = f"""
        SELECT p.product_id AS a, q.product_id AS b, count(*) AS ordenes_juntos
        FROM x_prior p JOIN x_prior q ON p.order_id = q.order_id AND p.product_id < q.product_id
        WHERE p.product_id IN (SELECT product_id FROM x_prior GROUP BY 1
                               ORDER BY count(*) DESC, product_id LIMIT {_top})
          AND q.product_id IN (SELECT product_id FROM x_prior GROUP BY 1
                               ORDER BY count(*) DESC, product_id LIMIT {_top})
        GROUP BY 1, 2 HAVING count(*) >= 20"""
for _key in ("aisle", "aisle_id", "department_id"):
    CTES[f"x_baskets_{_key}"] = (
        f"SELECT DISTINCT order_id, {_key} FROM x_prior JOIN x_catalogo USING (product_id)"
    )
    CTES[f"x_counts_{_key}"] = (
        f"SELECT {_key}, count(*)::DOUBLE AS c FROM x_baskets_{_key} GROUP BY 1"
    )
    CTES[f"x_pairs_{_key}"] = f"""
        SELECT p.{_key} AS a, q.{_key} AS b, count(*) AS ordenes_juntos
        FROM x_baskets_{_key} p JOIN x_baskets_{_key} q
          ON p.order_id = q.order_id AND p.{_key} < q.{_key}
        GROUP BY 1, 2"""

_NAME = re.compile(r"\bx_\w+\b")


def _needed(text: str, seen: list[str]) -> None:
    for name in dict.fromkeys(_NAME.findall(text)):
        if name in CTES and name not in seen:
            _needed(CTES[name], seen)
            if name not in seen:
                seen.append(name)


def sql(body: str, floats: tuple[str, ...] = (), digits: int = 9) -> str:
    """The steps `body` uses, then `body` with its double columns rounded."""
    names: list[str] = []
    _needed(body, names)
    steps = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in names)
    cols = ", ".join(f"round({c}, {digits}) AS {c}" for c in floats)
    select = f"SELECT * REPLACE ({cols})" if cols else "SELECT *"
    return (f"WITH {steps}\n" if steps else "") + f"{select} FROM ({body.strip()}) AS result"


def score_sql(
    recs: str,
    cuts: list[tuple[str, str, int]],
    columns: str,
    truth: str = "x_truth",
    history: str | None = None,
    segments: str | None = None,
    catalog: str = "(SELECT count(*) FROM x_catalogo)",
    where: str = "true",
) -> str:
    """Metric rows for cuts (label, modelo, k) of the frame `recs`."""
    values = ", ".join(f"('{label}', '{m}', {k})" for label, m, k in cuts)
    known = history or "(SELECT NULL::BIGINT AS user_id, NULL::INTEGER AS product_id WHERE false)"
    lost = "CAST(u.user_id NOT IN (SELECT user_id FROM seg) AS INTEGER)" if segments else "0"
    seg = segments or "(SELECT NULL::BIGINT AS user_id, NULL::VARCHAR AS segmento WHERE false)"
    return f"""
      WITH cut AS (SELECT * FROM (VALUES {values}) v(label, src, k)),
      hist AS (SELECT DISTINCT user_id, product_id FROM {known} z),
      real AS (SELECT t.user_id, count(*) AS targets,
                      count(*) FILTER (h.user_id IS NULL) AS new_targets
               FROM {truth} t LEFT JOIN hist h ON h.user_id = t.user_id
                 AND h.product_id = t.product_id GROUP BY 1),
      shown AS (SELECT DISTINCT c.label, c.k, r.user_id, r.product_id
                FROM ({recs}) r JOIN cut c ON c.src = r.modelo AND r.rank <= c.k),
      flagged AS (SELECT s.*, t.user_id IS NOT NULL AS hit, h.user_id IS NULL AS is_new
                  FROM shown s
                  LEFT JOIN {truth} t ON t.user_id = s.user_id AND t.product_id = s.product_id
                  LEFT JOIN hist h ON h.user_id = s.user_id AND h.product_id = s.product_id
                  WHERE s.user_id IN (SELECT user_id FROM real)),
      counted AS (SELECT label, user_id, count(*) AS shown, count(*) FILTER (hit) AS hits,
                         count(*) FILTER (is_new) AS new_shown,
                         count(*) FILTER (is_new AND hit) AS new_hits
                  FROM flagged GROUP BY 1, 2),
      users AS (SELECT cut.label, cut.k, real.*, coalesce(c.shown, 0) AS shown,
                       coalesce(c.hits, 0) AS hits, coalesce(c.new_shown, 0) AS new_shown,
                       coalesce(c.new_hits, 0) AS new_hits
                FROM real CROSS JOIN cut LEFT JOIN counted c
                  ON c.label = cut.label AND c.user_id = real.user_id),
      seg AS (SELECT user_id, segmento FROM {seg} y),
      grouped AS (SELECT u.*, '__all__' AS segmento,
                         {lost} AS lost
                  FROM users u
                  UNION ALL SELECT u.*, seg.segmento, 0 FROM users u JOIN seg USING (user_id)),
      items AS (SELECT label, segmento, count(DISTINCT product_id) AS items FROM (
                  SELECT label, '__all__' AS segmento, product_id FROM flagged
                  UNION ALL SELECT label, seg.segmento, product_id
                  FROM flagged JOIN seg USING (user_id)) GROUP BY 1, 2),
      base AS (
        SELECT label AS modelo, g.segmento, g.k, count(*) AS n_usuarios,
          avg(hits::DOUBLE / g.k) AS precision, avg(hits::DOUBLE / targets) AS recall,
          sum(hits)::DOUBLE / sum(targets) AS recall_micro, avg((hits > 0)::INTEGER) AS hit_rate,
          coalesce(any_value(items), 0)::DOUBLE / {catalog} AS cobertura,
          avg((shown >= g.k)::INTEGER) AS usuarios_completos,
          CAST(sum(hits) AS BIGINT) AS aciertos_totales,
          CAST(sum(targets) AS BIGINT) AS objetivos_totales,
          count(*) FILTER (shown = 0) AS sin_recomendaciones,
          CAST(sum(lost) AS BIGINT) AS sin_segmento,
          avg(new_shown::DOUBLE / g.k) AS novedad_ofrecida,
          coalesce(avg(new_hits::DOUBLE / nullif(new_shown, 0)), 0) AS precision_novedad,
          coalesce(avg(new_hits::DOUBLE / nullif(new_targets, 0)), 0) AS recall_novedad,
          coalesce(avg((new_hits > 0)::INTEGER) FILTER (new_targets > 0), 0) AS hit_rate_novedad,
          count(*) FILTER (new_shown > 0) AS n_con_novedad_ofrecida,
          count(*) FILTER (new_targets > 0) AS n_con_objetivo_nuevo,
          CAST(sum(new_hits) AS BIGINT) AS aciertos_nuevos_totales,
          CAST(sum(new_targets) AS BIGINT) AS objetivos_nuevos_totales
        FROM grouped g LEFT JOIN items USING (label, segmento) GROUP BY 1, 2, 3),
      scored AS (
        SELECT *, recall AS recall_macro,
          CASE WHEN precision + recall = 0 THEN 0
               ELSE 2 * precision * recall / (precision + recall) END AS f1,
          CASE WHEN precision + recall_micro = 0 THEN 0
               ELSE 2 * precision * recall_micro / (precision + recall_micro) END AS f1_micro
        FROM base)
      SELECT {columns} FROM scored WHERE {where}"""
