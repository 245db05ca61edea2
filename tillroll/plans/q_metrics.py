"""Registered queries: metrics, experiments, exports and trained models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import features as feat
from tillroll.operators import metrics, models, rank_boosting, rankers
from tillroll.operators.metrics import ALL, BASE_COLUMNS, NOVELTY_COLUMNS, Cut
from tillroll.plans import experiments as ex
from tillroll.plans import export
from tillroll.plans.oracle import score_sql
from tillroll.plans.q_features import WEIGHT_RANKINGS
from tillroll.plans.q_rules import POLICY_VALUES, SLOT_VALUES, hybrid_sql
from tillroll.operators.recommend import POLICIES, POLICY
from tillroll.plans.registry import add
from tillroll.sources import store

_RATES = (
    "precision recall recall_macro recall_micro f1 f1_micro hit_rate cobertura usuarios_completos"
)
_NEW_RATES = "novedad_ofrecida precision_novedad recall_novedad hit_rate_novedad"
_BASE = ", ".join(BASE_COLUMNS)
_FULL = ", ".join((*BASE_COLUMNS, *NOVELTY_COLUMNS))
_REPURCHASE = "SELECT 'modelo' AS modelo, * FROM x_rank_rep"
_HEURISTIC = "SELECT 'm' AS modelo, * FROM x_ranking"
_ONE = [("modelo", "modelo", 10)]


def _repurchase(ws):
    return rankers.repurchase_topk(ws.part("valid"))


# metrics ----------------------------------------------------------------------------------------

add(
    "m12_evaluate_repurchase",
    lambda ws: metrics.evaluate(
        _repurchase(ws), ws.truth, 10, ws.segments, ws.catalog_size, strict=False,
        history=ws.history,
    ),
    score_sql(_REPURCHASE, _ONE, f"segmento, CAST(k AS INTEGER) AS k, {_FULL}",
              history="x_history", segments="x_valid"),
    f"{_RATES} {_NEW_RATES}",
)
add(
    "m12_evaluate_popularity",
    lambda ws: metrics.evaluate(
        rankers.popularity_topk(ws.items, ws.valid_users), ws.truth, 10, ws.segments,
        ws.catalog_size, history=ws.history,
    ),
    score_sql("SELECT 'modelo' AS modelo, * FROM x_rank_pop", _ONE,
              f"segmento, CAST(k AS INTEGER) AS k, {_FULL}", history="x_history", segments="x_valid"),
    f"{_RATES} {_NEW_RATES}",
)
add(
    "m10_metric_block",
    lambda ws: metrics.evaluate(ws.ranking, ws.truth, 5, catalog_size=ws.catalog_size),
    score_sql(_HEURISTIC, [("m", "m", 5)], f"segmento, CAST(k AS INTEGER) AS k, {_BASE}"),
    _RATES,
)
add(
    "m1_to_m8_per_user",
    lambda ws: metrics.per_user(
        metrics.stack({"m": rankers.popularity_topk(ws.items, ws.valid_users)}),
        ws.truth, [Cut("m", "m", 10)], ws.history,
    ).select(
        "user_id", "targets", "new_targets", "hits", "new_shown", "new_hits",
        (F.col("hits") / F.col("k")).alias("precision"),
        (F.col("hits") / F.col("targets")).alias("recall"),
        (F.col("hits") > 0).alias("acerto"),
        (F.col("new_shown") / F.col("k")).alias("novedad_ofrecida"),
    ),
    """SELECT user_id, targets, new_targets, hits, new_shown, new_hits, hits / 10 AS precision,
         hits / targets AS recall, hits > 0 AS acerto, new_shown / 10 AS novedad_ofrecida
       FROM (SELECT user_id, count(*) AS targets, count(*) FILTER (h.p IS NULL) AS new_targets
             FROM x_truth LEFT JOIN (SELECT *, product_id AS p FROM x_history) h
               USING (user_id, product_id) GROUP BY 1) JOIN (
             SELECT r.user_id, count(t.product_id) AS hits,
               count(*) FILTER (h.product_id IS NULL) AS new_shown,
               count(t.product_id) FILTER (h.product_id IS NULL) AS new_hits
             FROM x_rank_pop r
             LEFT JOIN x_truth t ON t.user_id = r.user_id AND t.product_id = r.product_id
             LEFT JOIN x_history h ON h.user_id = r.user_id AND h.product_id = r.product_id
             GROUP BY 1) USING (user_id)""",
    "precision recall novedad_ofrecida",
)
add(
    "m7_new_targets",
    lambda ws: metrics.new_targets(ws.all_truth, ws.interactions),
    "SELECT * FROM x_truth_all ANTI JOIN x_inter USING (user_id, product_id)",
)
_SYSTEM_CUTS = [(m, m, 10) for m in ("popularidad", "recompra_personal", "heuristica")]
_COMPARED = f"""
    SELECT CASE modelo WHEN 'popularidad' THEN 1 WHEN 'recompra_personal' THEN 2 ELSE 3 END AS orden,
      *, (recall - base) / base AS lift
    FROM (SELECT *, max(recall) FILTER (modelo = 'popularidad') OVER () AS base FROM (
      {score_sql("SELECT * FROM x_systems", _SYSTEM_CUTS,
                 "modelo, precision, recall, recall_micro, f1, hit_rate, cobertura, n_usuarios")}))"""


def _comparison(ws):
    return metrics.compare(
        ex.rule_systems(ws.part("valid"), ws.items, ws.valid_users), ws.truth, 10, "popularidad",
        catalog_size=ws.catalog_size,
    )


add(
    "m13_compare",
    _comparison,
    f"SELECT * EXCLUDE (base) FROM ({_COMPARED})",
    "precision recall recall_micro f1 hit_rate cobertura lift",
)
_NS = "(VALUES (5), (8), (10), (12), (15), (20), (25), (30)) ns(n)"
_CEILING = f"""
    SELECT n, segmento, avg(least(rep, n)::DOUBLE / items) AS techo
    FROM (SELECT user_id, count(*) AS items, sum(reordered) AS rep FROM x_targets GROUP BY 1)
    JOIN (SELECT user_id, segmento FROM x_valid UNION ALL SELECT user_id, '__all__' FROM x_valid)
      USING (user_id) CROSS JOIN {_NS} GROUP BY 1, 2"""
add(
    "m16_ceiling_at_n",
    lambda ws: metrics.ceiling_at_n(ws.targets, ex.LIST_LENGTHS, ws.segments),
    _CEILING,
    "techo",
)


def _percent_of_ceiling(ws):
    scored = metrics.evaluate(ws.top10, ws.truth, 10, ws.segments, ws.catalog_size)
    tops = metrics.ceiling_at_n(ws.targets, [10], ws.segments)
    return metrics.pct_of_ceiling(scored, tops).select(
        "segmento", "n_usuarios", "recall", "techo", "pct_del_techo", "hit_rate"
    )


add(
    "m17_pct_of_ceiling",
    _percent_of_ceiling,
    f"""SELECT segmento, n_usuarios, recall, techo, recall / techo AS pct_del_techo, hit_rate
        FROM ({score_sql(_HEURISTIC, [("m", "m", 10)], "segmento, n_usuarios, recall, hit_rate",
                         segments="x_valid")})
        JOIN (SELECT * FROM ({_CEILING}) WHERE n = 10) USING (segmento)""",
    "recall techo pct_del_techo hit_rate",
)

# experiments ------------------------------------------------------------------------------------

_WEIGHT_CUTS = [Cut(f"pesos_{i}", f"pesos_{i}", 10) for i in range(1, len(rankers.WEIGHT_GRID) + 1)]
add(
    "r6_weight_sensitivity",
    lambda ws: metrics.score(
        rankers.weight_rankings(ws.part("train")),
        rankers.truth(ws.targets, rankers.users_of_split(ws.features, "train")), _WEIGHT_CUTS,
    ).select("modelo", "n_usuarios", "recall", "hit_rate"),
    score_sql(
        WEIGHT_RANKINGS, [(c.label, c.modelo, c.k) for c in _WEIGHT_CUTS],
        "modelo, n_usuarios, recall, hit_rate",
        truth="(SELECT * FROM x_truth_all SEMI JOIN (SELECT user_id FROM x_split "
              "WHERE split = 'train') USING (user_id))",
    ),
    "recall hit_rate",
)
add(
    "e2_gain_ladder",
    lambda ws: ex.gain_ladder(_comparison(ws)),
    f"""WITH c AS ({_COMPARED})
        SELECT b.orden, a.modelo AS desde, b.modelo AS hasta, b.recall - a.recall AS gana,
          (b.recall - a.recall) / ((SELECT recall FROM c WHERE orden = 3)
                                   - (SELECT recall FROM c WHERE orden = 1)) AS del_total
        FROM c a JOIN c b ON b.orden = a.orden + 1""",
    "gana del_total",
)


def _sweep(ws):
    return ex.sweep_n(ws.ranking, ws.truth, ws.targets, ws.segments, ws.catalog_size)


_SWEEP = f"""
    SELECT n, segmento, n_usuarios, hit_rate, recall, precision, f1, cobertura, techo,
      recall / techo AS pct_del_techo
    FROM ({score_sql(_HEURISTIC, [(str(n), "m", n) for n in ex.LIST_LENGTHS],
                     "CAST(k AS INTEGER) AS n, segmento, n_usuarios, hit_rate, recall, precision, f1, cobertura",
                     segments="x_valid")})
    JOIN ({_CEILING}) USING (n, segmento)"""
add(
    "e3_sweep_n", _sweep, _SWEEP,
    "hit_rate recall precision f1 cobertura techo pct_del_techo",
)
add(
    "e3_best_n",
    lambda ws: ex.best_n(_sweep(ws)),
    f"""SELECT segmento, arg_min(n, (-f1, n)) AS mejor_n, max(f1) AS mejor_f1,
          max(f1) - max(f1) FILTER (n = 10) AS gana_sobre_10
        FROM ({_SWEEP}) GROUP BY 1""",
    "mejor_f1 gana_sobre_10",
)
add(
    "e3_sweep_steps",
    lambda ws: ex.sweep_steps(_sweep(ws)),
    f"""SELECT * FROM (
          SELECT lag(n) OVER w AS desde, n AS hasta, recall - lag(recall) OVER w AS gana_recall,
            hit_rate - lag(hit_rate) OVER w AS gana_hit_rate,
            precision - lag(precision) OVER w AS paga_precision
          FROM ({_SWEEP}) WHERE segmento = '__all__' WINDOW w AS (ORDER BY n))
        WHERE desde IS NOT NULL""",
    "gana_recall gana_hit_rate paga_precision",
)
add(
    "e12_novelty_slots_sweep",
    lambda ws: ex.novelty_slots_sweep(
        ws.top10, ws.suggestions, ws.truth, ws.history, ws.segments, ws.catalog_size
    ),
    f"""WITH h AS ({hybrid_sql(SLOT_VALUES)}),
        s AS ({score_sql("SELECT * FROM h", [(str(i), str(i), 10) for i in range(4)],
                         "*", history="x_history", segments="x_valid")}),
        b AS (SELECT *, max(aciertos_totales) FILTER (modelo = '0') OVER (PARTITION BY segmento)
                - aciertos_totales + aciertos_nuevos_totales AS lost FROM s),
        served AS (SELECT modelo, segmento, count(DISTINCT user_id) AS c FROM (
            SELECT modelo, user_id, '__all__' AS segmento FROM h WHERE es_nuevo = 1
            UNION ALL SELECT modelo, user_id, segmento FROM h JOIN x_valid USING (user_id)
            WHERE es_nuevo = 1) GROUP BY 1, 2)
        SELECT CAST(modelo AS INTEGER) AS slots_novedad, segmento, n_usuarios, hit_rate, recall,
          precision, cobertura, objetivos_nuevos_totales::DOUBLE / objetivos_totales
            AS pct_objetivo_nuevo, novedad_ofrecida, precision_novedad, recall_novedad,
          hit_rate_novedad, aciertos_totales, aciertos_nuevos_totales AS aciertos_nuevos,
          lost AS recompra_resignada,
          CASE WHEN modelo <> '0' THEN lost::DOUBLE / nullif(aciertos_nuevos_totales, 0) END AS precio,
          coalesce(c, 0) AS usuarios_con_novedad
        FROM b LEFT JOIN served USING (modelo, segmento)""",
    "hit_rate recall precision cobertura pct_objetivo_nuevo novedad_ofrecida precision_novedad "
    "recall_novedad hit_rate_novedad precio",
)
add(
    "e13_novelty_policy_comparison",
    lambda ws: ex.novelty_policy_comparison(
        ws.top10, ws.suggestions, ws.truth, ws.history, ws.segments
    ),
    f"""WITH h AS ({hybrid_sql(POLICY_VALUES)}),
        s AS ({score_sql("SELECT * FROM h", [(p, p, 10) for p in POLICIES], "*",
                         history="x_history")})
        SELECT modelo AS politica, hit_rate, recall, aciertos_totales,
          aciertos_nuevos_totales AS aciertos_nuevos, hit_rate_novedad,
          (max(aciertos_totales) FILTER (modelo = 'sin novedad') OVER () - aciertos_totales
           + aciertos_nuevos_totales)::DOUBLE / nullif(aciertos_nuevos_totales, 0) AS precio
        FROM s""",
    "hit_rate recall hit_rate_novedad precio",
)
add(
    "e14_novelty_universe",
    lambda ws: metrics.novelty_universe(ws.truth, ws.history),
    """SELECT *, objetivos_nuevos::DOUBLE / objetivos AS pct_objetivos_nuevos,
         usuarios_con_objetivo_nuevo::DOUBLE / usuarios AS pct_usuarios
       FROM (SELECT count(*) AS objetivos, count(*) FILTER (p IS NULL) AS objetivos_nuevos,
               count(DISTINCT user_id) AS usuarios,
               count(DISTINCT user_id) FILTER (p IS NULL) AS usuarios_con_objetivo_nuevo
             FROM x_truth LEFT JOIN (SELECT *, product_id AS p FROM x_history)
               USING (user_id, product_id))""",
    "pct_objetivos_nuevos pct_usuarios",
)
_MAIN = "SELECT 'm' AS modelo, user_id, product_id, posicion AS rank FROM x_blocks WHERE bloque = 'principal'"
_EXTRA = _MAIN.replace("principal", "sugerencia")
_BLOCK_ONE = score_sql(
    _MAIN, [("m", "m", 10)], "segmento, n_usuarios, hit_rate, recall, precision, cobertura",
    segments="x_valid",
)
_BLOCK_TWO = score_sql(
    _EXTRA, [(s, "m", n) for s, n in POLICY.items()],
    "*", history="x_history", segments="x_valid", where="modelo = segmento",
)


def _block_one(ws):
    return ex.block_one_report(ws.two_block, ws.truth, ws.segments, ws.catalog_size)


def _block_two(ws):
    return ex.block_two_report(ws.two_block, ws.truth, ws.history, ws.segments)


def _pooled(ws):
    return ex.pooled_novelty_hit_rate(ws.two_block, ws.truth, ws.history, ws.segments)


add("e15_block_one_report", _block_one, _BLOCK_ONE, "hit_rate recall precision cobertura")
add(
    "e15_block_two_report",
    _block_two,
    f"""SELECT segmento, CAST(k AS INTEGER) AS lugares, n_usuarios, precision_novedad,
          hit_rate_novedad, aciertos_nuevos_totales AS aciertos_nuevos FROM ({_BLOCK_TWO})""",
    "precision_novedad hit_rate_novedad",
)
_POOLED = f"""
    SELECT *, con_acierto::DOUBLE / con_objetivo AS hit_rate_novedad FROM (
      SELECT CAST(sum(aciertos_nuevos_totales) AS BIGINT) AS aciertos_nuevos,
        CAST(sum(n_con_objetivo_nuevo) AS BIGINT) AS con_objetivo,
        CAST(sum(round(hit_rate_novedad * n_con_objetivo_nuevo)) AS BIGINT) AS con_acierto
      FROM ({_BLOCK_TWO}))"""
add("e16_pooled_novelty_hit_rate", _pooled, _POOLED, "hit_rate_novedad")
add(
    "e17_block_size_curve",
    lambda ws: ex.block_size_curve(ws.suggestions, ws.truth, ws.segments),
    """WITH s AS (SELECT s.user_id, s.posicion, t.user_id IS NOT NULL AS hit FROM x_suggest s
                  LEFT JOIN x_truth t ON t.user_id = s.user_id AND t.product_id = s.product_id),
       u AS (SELECT v.segmento, z.tamano, v.user_id,
               count(s.posicion) FILTER (s.posicion <= tamano) AS n,
               count(*) FILTER (s.hit AND s.posicion <= tamano) AS h,
               count(*) FILTER (s.hit AND s.posicion = tamano) AS l
             FROM x_valid v CROSS JOIN (VALUES (1), (2), (3), (4), (5), (8)) z(tamano)
             LEFT JOIN s ON s.user_id = v.user_id GROUP BY 1, 2, 3)
       SELECT segmento, tamano, count(*) FILTER (n > 0) AS usuarios_con_bloque,
         count(*) FILTER (n > 0)::DOUBLE / count(*) AS pct_con_bloque,
         avg(h::DOUBLE / nullif(n, 0)) AS precision_bloque,
         count(*) FILTER (h > 0)::DOUBLE / count(*) AS pct_usuarios_con_acierto,
         CAST(sum(h) AS BIGINT) AS aciertos,
         sum(l)::DOUBLE / nullif(count(*) FILTER (n > 0), 0) AS precision_ultimo_lugar
       FROM u GROUP BY 1, 2""",
    "pct_con_bloque precision_bloque pct_usuarios_con_acierto precision_ultimo_lugar",
)
_SAMPLE = """
    SELECT user_id, segmento FROM (
      SELECT user_id, segmento, row_number() OVER (PARTITION BY segmento
               ORDER BY md5(user_id || ':muestra:42'), user_id) AS pos,
             count(*) OVER (PARTITION BY segmento) AS n, count(*) OVER () AS total FROM x_valid)
    WHERE pos <= greatest(1, floor(100 * n::DOUBLE / total))"""
add("e18_stratified_sample", lambda ws: ex.stratified_sample(ws.segments, 100), _SAMPLE)

# exports ----------------------------------------------------------------------------------------

_EXPORT = """
    SELECT b.user_id, coalesce(v.segmento, '') AS segmento, b.bloque, b.posicion, b.product_id,
      t.user_id IS NOT NULL AS acerto, c.product_name, c.aisle
    FROM x_blocks b LEFT JOIN x_valid v USING (user_id)
    LEFT JOIN x_truth t ON t.user_id = b.user_id AND t.product_id = b.product_id
    LEFT JOIN x_catalogo c ON c.product_id = b.product_id"""


def _exported(ws):
    return ws.store.table(
        "recomendaciones",
        lambda: export.export_recommendations(ws.two_block, ws.truth, ws.segments, ws.catalog),
        order_by=["user_id", "bloque", "posicion"],
    )


def _served(ws):
    """The export as it is published for lookups."""
    if "lookup" not in ws.made:
        ws.made["lookup"] = ws.store.fresh_path("consulta")
        export.publish_lookup(_exported(ws), ws.made["lookup"])
    return store.read_table(ws.spark, ws.made["lookup"])


add("s11_export_recommendations", _exported, _EXPORT)


def _rules_report(ws):
    path = ws.store.fresh_path("reglas")
    store.write_table(ws.published_rules, path)
    return store.read_rules(ws.spark, path)


add(
    "s9_read_rules",
    _rules_report,
    "SELECT producto_a_id, producto_b_id, confianza FROM x_reglas WHERE confianza >= 0.02",
    "confianza",
)
add(
    "s11_export_sample",
    lambda ws: export.export_recommendations(
        ws.two_block, ws.truth, ws.segments, ws.catalog, ex.stratified_sample(ws.segments, 100)
    ),
    f"SELECT * FROM ({_EXPORT}) WHERE user_id IN (SELECT user_id FROM ({_SAMPLE}))",
)
_KPI_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS metrica, CAST({col} AS DOUBLE) AS valor, '{fmt}' AS formato, "
    f"'{text}' AS descripcion FROM k"
    for name, col, fmt, text in export.KPIS
)
add(
    "s12_export_kpis",
    lambda ws: export.export_kpis(_block_one(ws), _pooled(ws)),
    f"""WITH k AS (SELECT * FROM (SELECT * FROM ({_BLOCK_ONE}) WHERE segmento = '__all__')
                    CROSS JOIN ({_POOLED})) {_KPI_ROWS}""",
    "valor",
)
add(
    "s12_export_kpis_by_segment",
    lambda ws: export.export_kpis_by_segment(_block_one(ws), _block_two(ws)),
    f"""SELECT segmento, a.n_usuarios, a.hit_rate, a.recall,
          coalesce(b.hit_rate_novedad, 0) AS hit_rate_novedad,
          coalesce(b.aciertos_nuevos_totales, 0) AS aciertos_novedad,
          coalesce(p.n, 0) AS lugares_de_sugerencia
        FROM ({_BLOCK_ONE}) a LEFT JOIN ({_BLOCK_TWO}) b USING (segmento)
        LEFT JOIN x_policy p USING (segmento) WHERE segmento <> '__all__'""",
    "hit_rate recall hit_rate_novedad",
)
add(
    "s13_lookup_recommendations",
    lambda ws: export.lookup_recommendations(
        _served(ws), ws.valid_users.agg(F.min("user_id")).scalar()
    ),
    f"""SELECT segmento, bloque, posicion, product_id, product_name, aisle, acerto
        FROM ({_EXPORT}) WHERE user_id = (SELECT min(user_id) FROM x_valid)""",
)
add(
    "s14_showcase_users",
    lambda ws: export.showcase_users(_exported(ws)),
    f"""WITH u AS (SELECT user_id, any_value(segmento) AS segmento,
            count(*) FILTER (bloque = 'principal' AND acerto) AS aciertos,
            count(*) FILTER (bloque = 'sugerencia' AND acerto) AS aciertos_nuevos
          FROM ({_EXPORT}) GROUP BY 1),
        p AS (
          SELECT * FROM u WHERE aciertos_nuevos > 0 QUALIFY row_number() OVER
            (PARTITION BY segmento ORDER BY aciertos DESC, user_id) <= 2
          UNION SELECT * FROM u QUALIFY row_number() OVER
            (PARTITION BY segmento ORDER BY aciertos DESC, user_id) <= 2
          UNION SELECT * FROM u WHERE aciertos BETWEEN 4 AND 7 QUALIFY row_number() OVER
            (PARTITION BY segmento ORDER BY user_id) <= 2
          UNION SELECT * FROM u WHERE aciertos <= 2 QUALIFY row_number() OVER
            (PARTITION BY segmento ORDER BY user_id) <= 1)
        SELECT *, user_id = coalesce(
            (SELECT user_id FROM p WHERE aciertos_nuevos > 0 ORDER BY aciertos DESC, user_id LIMIT 1),
            (SELECT min(user_id) FROM p)) AS es_default
        FROM p""",
)

# trained models: rows only -----------------------------------------------------------------------

# The search (E9) is registered with few trees. All other experiments train the whole model, as R8 does.


def _logistic(ws):
    if "logistic" not in ws.made:
        ws.made["logistic"] = models.train_logistic(ws.part("train"))
    return ws.made["logistic"]


def _boosting(ws):
    return ws.boosting


add(
    "r7_train_logistic",
    lambda ws: rankers.topk(models.score_logistic(*_logistic(ws), ws.part("valid")), "score", 10),
)
add("r7_logistic_weights", lambda ws: models.logistic_weights(_logistic(ws)[0]))
add(
    "r8_train_boosting",
    lambda ws: rankers.topk(models.score_boosting(*_boosting(ws), ws.part("valid")), "score", 10),
)


def _nodes(ws):
    if "nodes" not in ws.made:
        ws.made["nodes"] = models.save_model(_boosting(ws)[0], ws.store.fresh_path("modelo"))
    return models.tree_nodes(ws.spark, ws.made["nodes"])


# The final system on the trained model. Its SQL is that of the query on the heuristic with the stored
# ranking in place of x_ranking, which only a test can name.
add("a16_two_block_trained", lambda ws: ws.trained.two_block)
add("e3_sweep_n_trained", lambda ws: _sweep(ws.trained))
add("e15_block_one_trained", lambda ws: _block_one(ws.trained))
add("e15_block_two_trained", lambda ws: _block_two(ws.trained))
add("s11_export_trained", lambda ws: _exported(ws.trained))
add("r11_feature_importance", lambda ws: models.feature_importance(_nodes(ws)))


def _centred(ws):
    return lambda df: ws.store.table("filas_centradas", lambda: df)


def _pairwise(ws):
    weights, fill = models.train_pairwise_ranker(ws.part("train"), keep=_centred(ws))
    return rankers.topk(models.score_pairwise(weights, fill, ws.part("valid")), "score", 10)


add("r9_train_pairwise_ranker", _pairwise)
# every pair of a user's bought and unbought items, under the heuristic; a user without both has no rows
add(
    "r9_pair_weights",
    lambda ws: rank_boosting.pair_weights(
        ws.part("train").select("user_id", "product_id", "etiqueta", rankers.heuristic_score().alias("score"))
    ).select("user_id", "product_id", "posicion", "peso"),
    """WITH s AS (
          SELECT h.user_id, h.product_id, f.etiqueta, h.score,
                 row_number() OVER (PARTITION BY h.user_id ORDER BY h.score DESC, h.product_id) AS posicion
          FROM x_heur h JOIN x_features f USING (user_id, product_id) WHERE h.split = 'train'),
        n AS (SELECT user_id, sum(etiqueta) AS n FROM s GROUP BY 1),
        i AS (SELECT user_id, (SELECT sum(1 / log2(1 + r)) FROM range(1, n.n::BIGINT + 1) t(r)) AS ideal
              FROM n WHERE n > 0)
        SELECT a.user_id, a.product_id, a.posicion, sum(
            abs(1 / log2(1 + a.posicion) - 1 / log2(1 + b.posicion)) / ideal
            * CASE WHEN a.etiqueta = 1 THEN exp(b.score - a.score) ELSE exp(a.score - b.score) END) AS peso
        FROM s a JOIN s b ON a.user_id = b.user_id AND a.etiqueta <> b.etiqueta JOIN i ON i.user_id = a.user_id
        GROUP BY 1, 2, 3""",
    "peso",
)


def _rank_boosting(ws):
    if "rank_boosting" not in ws.made:
        ws.made["rank_boosting"] = rank_boosting.train_rank_boosting(
            ws.part("train"), keep=lambda name, df: ws.store.table(f"ranker_{name}", lambda: df)
        )
    return ws.made["rank_boosting"]


add(
    "r9_train_rank_boosting",
    lambda ws: rankers.topk(rank_boosting.score_rank_boosting(*_rank_boosting(ws), ws.part("valid")), "score", 10),
)


def _five_systems(ws):
    return ws.store.table(
        "comparacion",
        lambda: ex.compare_all(
            ws.part("train"), ws.part("valid"), ws.items, ws.truth, ws.catalog_size,
            trained={"regresion_logistica": _logistic(ws), "boosting": _boosting(ws)},
        ),
    )


add("e1_compare_all", _five_systems)
add("e2_gain_ladder_five_systems", lambda ws: ex.gain_ladder(_five_systems(ws)))
_SEED_NS = ex.LIST_LENGTHS


def _by_seed(ws):
    return ws.store.table(
        "f1_por_semilla",
        lambda: ex.seed_robustness(
            ws.part("train"), ws.part("valid"), ws.truth, (42, 7, 2024), _SEED_NS, params=ws.boosting_params()[0],
            keep=lambda name, df: ws.store.table(name, lambda: df),
        ),
    )


add("e4_seed_robustness", lambda ws: ex.robustness_summary(_by_seed(ws)))
add("e4_seed_by_length", lambda ws: ex.robustness_pivot(_by_seed(ws), _SEED_NS))
add(
    "e6_learning_curve",
    lambda ws: ex.learning_curve(
        ws.part("train"), ws.part("valid"), ws.truth, ex.FRACTIONS, params=ws.boosting_params()[0],
        keep=lambda name, df: ws.store.table(name, lambda: df),
    ),
)
add(
    "e9_search_params",
    lambda ws: ex.best_trial(
        ws.store.table(
            "busqueda",
            lambda: ex.search_params(
                ws.part("train"), ws.targets, first_trees=3, max_trees=12,
                keep=lambda name, df: ws.store.table(name, lambda: df),
            ),
        )
    ),
)
add(
    "e10_feature_ablation",
    lambda ws: ex.feature_ablation(
        feat.join_new_features(ws.part("train"), ws.new_features),
        feat.join_new_features(ws.part("valid"), ws.new_features),
        ws.truth, extra=feat.RECENT_COLUMNS, params=ws.boosting_params()[0],
        catalog_size=ws.catalog_size, keep=lambda name, df: ws.store.table(name, lambda: df),
    ),
)
add(
    "e11_objective_comparison",
    lambda ws: ex.objective_comparison(
        ws.part("train"), ws.part("valid"), ws.truth, trained=_boosting(ws),
        catalog_size=ws.catalog_size, boosted_ranker=_rank_boosting(ws), keep=_centred(ws),
    ),
)
