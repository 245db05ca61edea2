"""Registered queries: new-item candidates."""

from __future__ import annotations

from tillroll.operators import candidates as cand
from tillroll.operators import metrics, recommend
from tillroll.operators.metrics import new_targets
from tillroll.plans.registry import add

add(
    "c1_working_users",
    lambda ws: cand.working_users(ws.users, 200).select("user_id", "segmento_usuario"),
    "SELECT user_id, segmento_usuario FROM x_usuarios ORDER BY user_id LIMIT 200",
)
add(
    "c2_working_interactions",
    lambda ws: cand.working_interactions(ws.interactions, cand.working_users(ws.users, 200)),
    """SELECT * FROM x_inter WHERE user_id IN
         (SELECT user_id FROM x_usuarios ORDER BY user_id LIMIT 200)""",
    "add_to_cart_order_promedio",
)
add("c3_item_score", lambda ws: cand.item_score(ws.items), "SELECT * FROM x_item_score", "score_producto")
add("c4_rank_items", lambda ws: ws.ranked_items, "SELECT * FROM x_ranked_items", "score_producto")
add("c5_affinities", lambda ws: ws.affinities, "SELECT * FROM x_affinities", "afinidad")
add(
    "c6_preselect_aisle",
    lambda ws: cand.preselect_aisle(ws.affinities, ws.ranked_items),
    "SELECT * FROM x_pre_aisle",
    "score",
)
add(
    "c7_preselect_department",
    lambda ws: cand.preselect_department(ws.affinities, ws.ranked_items),
    "SELECT * FROM x_pre_dept",
    "score",
)
add(
    "c8_preselect_global",
    lambda ws: cand.preselect_global(ws.users, ws.ranked_items),
    "SELECT * FROM x_pre_global",
    "score",
)
add("c9_union_sources", lambda ws: ws.preselected, "SELECT * FROM x_pre", "score")
add(
    "c10_exclude_bought",
    lambda ws: cand.exclude_bought(ws.preselected, ws.interactions),
    "SELECT * FROM x_new_pre",
    "score",
)
add("c11_dedupe_sources", lambda ws: ws.unique_candidates, "SELECT * FROM x_unique", "score_candidate")
add(
    "c11_dedupe_after_exclusion",
    lambda ws: cand.dedupe_sources(cand.exclude_bought(ws.preselected, ws.interactions)),
    "SELECT * FROM x_unique",
    "score_candidate",
)
add(
    "c12_rank_candidates",
    lambda ws: cand.rank_candidates(ws.unique_candidates),
    """SELECT *, CAST(row_number() OVER (PARTITION BY user_id
         ORDER BY score_candidate DESC, product_id) AS INTEGER) AS candidate_rank FROM x_unique""",
    "score_candidate",
)
add(
    "c13_quota",
    lambda ws: ws.quotas,
    "SELECT user_id, CAST(objetivo AS INTEGER) AS objetivo, disponibles FROM x_quota",
)
add("c14_fallback", lambda ws: ws.fallback, "SELECT * FROM x_fallback", "score_candidate")
# larger lists, so that many users run short and the fallback has work to do
_SHORT = cand.Limits(minimum=70)
add(
    "c14_fallback_long_lists",
    lambda ws: cand.fallback(
        cand.quota(ws.users, ws.unique_candidates, _SHORT), ws.ranked_items,
        ws.unique_candidates, ws.interactions, _SHORT,
    ),
    """SELECT user_id, product_id, 0.2::DOUBLE * score_producto AS score_candidate,
         'respaldo' AS fuentes
       FROM (SELECT u.user_id, 70 + greatest(10 - productos_distintos, 0) - coalesce(c, 0) AS missing
             FROM x_usuarios u LEFT JOIN (SELECT user_id, count(*) AS c FROM x_unique GROUP BY 1)
               USING (user_id)) q
       CROSS JOIN x_ranked_items i
       WHERE missing > 0 AND i.rank_global <= 1000
         AND (q.user_id, i.product_id) NOT IN (SELECT (user_id, product_id) FROM x_inter)
         AND (q.user_id, i.product_id) NOT IN (SELECT (user_id, product_id) FROM x_unique)
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank_global) <= missing""",
    "score_candidate",
)
add("c15_final_candidates", lambda ws: ws.candidates, "SELECT * FROM x_candidates", "score_candidate")
add(
    "c15_generate",
    lambda ws: cand.generate(
        ws.users, ws.ranked_items, ws.interactions,
        keep=lambda name, df: ws.store.table(f"generate_{name}", lambda: df),
    ),
    "SELECT * FROM x_candidates",
    "score_candidate",
)
add(
    "c16_candidate_stats",
    lambda ws: cand.candidate_stats(ws.candidates),
    """SELECT count(*) AS filas, count(DISTINCT user_id) AS usuarios,
         count(DISTINCT product_id) AS productos FROM x_candidates""",
)
add(
    "v10_candidate_gate",
    lambda ws: cand.candidate_gate(ws.candidates, ws.interactions, ws.users),
    """SELECT count(*) - count(DISTINCT (user_id, product_id)) AS duplicados,
         count(*) FILTER (user_id IS NULL OR product_id IS NULL OR score_candidate IS NULL
                          OR candidate_rank < 1) AS nulos_o_rank,
         (SELECT count(*) FROM x_candidates SEMI JOIN x_inter USING (user_id, product_id))
           AS comprados,
         (SELECT count(*) FROM x_quota q WHERE objetivo >
            (SELECT count(*) FROM x_candidates c WHERE c.user_id = q.user_id)) AS incompletos
       FROM x_candidates""",
)
add(
    "a20_baseline_plus_fill",
    lambda ws: recommend.baseline_plus_fill(
        ws.baseline_by_count, ws.candidates, ws.evaluable.select("user_id")
    ),
    "SELECT * FROM x_filled",
)


def _systems(ws):
    users = ws.evaluable.select("user_id")
    new = ws.candidates.where("candidate_rank <= 10").join(users, "user_id", "left_semi")
    return {
        "baseline_historico": ws.baseline_by_count,
        "candidatos_nuevos_top10": new.withColumnRenamed("candidate_rank", "rank"),
        "baseline_mas_relleno": recommend.baseline_plus_fill(
            ws.baseline_by_count, ws.candidates, users
        ),
    }


add(
    "m14_candidate_metrics",
    lambda ws: metrics.candidate_metrics(_systems(ws), ws.all_truth, ws.catalog_size),
    """WITH s AS (
         SELECT 'baseline_historico' AS sistema, user_id, product_id FROM x_base_count
         UNION ALL SELECT 'candidatos_nuevos_top10', user_id, product_id FROM x_candidates
           WHERE candidate_rank <= 10 AND user_id IN (SELECT user_id FROM x_targets)
         UNION ALL SELECT 'baseline_mas_relleno', user_id, product_id FROM x_filled),
       m AS (SELECT s.*, t.user_id IS NOT NULL AS hit FROM s LEFT JOIN x_truth_all t
             ON t.user_id = s.user_id AND t.product_id = s.product_id),
       u AS (SELECT sistema, user_id, count(*) AS n, count(*) FILTER (hit) AS h
             FROM m GROUP BY 1, 2),
       t AS (SELECT user_id, count(*) AS c FROM x_truth_all GROUP BY 1),
       k AS (SELECT count(*) AS users, CAST(sum(c) AS BIGINT) AS targets FROM t)
       SELECT sistema, CAST(sum(n) AS BIGINT) AS recomendaciones,
         count(*) AS usuarios_con_recomendaciones,
         count(*) FILTER (n >= 10) AS usuarios_topk_completo,
         (SELECT count(DISTINCT product_id) FROM s WHERE s.sistema = u.sistema)
           AS productos_recomendados,
         CAST(sum(h) AS BIGINT) AS aciertos, sum(h)::DOUBLE / any_value(targets) AS recall_micro,
         sum(h::DOUBLE / c) / any_value(users) AS recall_macro,
         count(*) FILTER (h > 0)::DOUBLE / any_value(users) AS hit_rate,
         (SELECT count(DISTINCT product_id) FROM s WHERE s.sistema = u.sistema)::DOUBLE
           / (SELECT count(*) FROM x_catalogo) AS cobertura_catalogo,
         count(*) FILTER (n >= 10)::DOUBLE / any_value(users) AS usuarios_topk_completo_pct
       FROM u JOIN t USING (user_id) CROSS JOIN k GROUP BY sistema""",
    "recall_micro recall_macro hit_rate cobertura_catalogo usuarios_topk_completo_pct",
)
add(
    "m15_discovery_metrics",
    lambda ws: metrics.discovery_metrics(
        new_targets(ws.all_truth, ws.interactions), ws.candidates
    ),
    """SELECT *, encontrados_pool::DOUBLE / objetivos_nuevos AS recall_pool_nuevos,
         encontrados_topk::DOUBLE / objetivos_nuevos AS recall_topk_nuevos,
         usuarios_hit_pool::DOUBLE / usuarios_con_objetivo_nuevo AS hit_rate_pool_nuevos,
         usuarios_hit_topk::DOUBLE / usuarios_con_objetivo_nuevo AS hit_rate_topk_nuevos
       FROM (SELECT count(*) AS objetivos_nuevos, count(candidate_rank) AS encontrados_pool,
               count(*) FILTER (candidate_rank <= 10) AS encontrados_topk,
               count(DISTINCT user_id) AS usuarios_con_objetivo_nuevo,
               count(DISTINCT user_id) FILTER (candidate_rank IS NOT NULL) AS usuarios_hit_pool,
               count(DISTINCT user_id) FILTER (candidate_rank <= 10) AS usuarios_hit_topk
             FROM (SELECT * FROM x_truth_all ANTI JOIN x_inter USING (user_id, product_id))
             LEFT JOIN x_candidates USING (user_id, product_id))""",
    "recall_pool_nuevos recall_topk_nuevos hit_rate_pool_nuevos hit_rate_topk_nuevos",
)
