"""Registered queries: features and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import features as feat
from tillroll.operators import models, rankers
from tillroll.plans.registry import add

_FEATURE_FLOATS = (
    "posicion_par reorder_rate_usuario posicion_media_carrito "
    "mediana_dias_entre_ordenes_historicas reorder_rate_producto ratio_usuario_producto "
    "ciclos_desde_ultima_compra recencia_relativa posicion_relativa dias_hasta_orden_objetivo "
    "dias_sin_comprar_total cadencia_par vencimiento ciclos_totales"
)
_NEW_FLOATS = "ratio_ultimas_3 ratio_ultimas_5 tendencia afinidad_pasillo antiguedad_par"

add("f1_evaluable_users", lambda ws: ws.evaluable, "SELECT * FROM x_evaluables")
add(
    "f2_sample_users",
    lambda ws: feat.sample_users(ws.evaluable, 100),
    "SELECT * FROM x_evaluables ORDER BY md5(user_id || ':42'), user_id LIMIT 100",
)
add("f3_stratified_split", lambda ws: ws.split, "SELECT * FROM x_split")
add(
    "f4_labels",
    lambda ws: feat.labels(ws.targets),
    "SELECT *, 1 AS etiqueta FROM x_truth_all",
)
add(
    "f5_target_context",
    lambda ws: feat.target_context(ws.orders),
    "SELECT * FROM x_context",
    "dias_hasta_orden_objetivo",
)
add(
    "f6_pair_cadence", lambda ws: feat.pair_cadence(ws.pairs), "SELECT * FROM x_cadence",
    "cadencia_par",
)
add("f7_build_features", lambda ws: ws.features.select(
        "user_id", "product_id", "split", "segmento_usuario", *feat.MODEL_COLUMNS, "etiqueta"),
    "SELECT * FROM x_features", _FEATURE_FLOATS)
add(
    "f7_features_from_separate_cadence",
    lambda ws: feat.build_features(
        ws.interactions, ws.split, ws.users, ws.items, feat.target_context(ws.orders),
        feat.labels(ws.targets), feat.pair_cadence(ws.pairs),
    ).select("user_id", "product_id", "cadencia_par", "vencimiento", "etiqueta"),
    "SELECT user_id, product_id, cadencia_par, vencimiento, etiqueta FROM x_features",
    "cadencia_par vencimiento",
)
for _letter, _col in zip(
    "abcdefg",
    (
        "ratio_usuario_producto", "ciclos_desde_ultima_compra", "recencia_relativa",
        "posicion_relativa", "dias_sin_comprar_total", "vencimiento", "ciclos_totales",
    ),
):
    add(
        f"f7{_letter}_{_col}",
        lambda ws, c=_col: ws.features.select("user_id", "product_id", c),
        f"SELECT user_id, product_id, {_col} FROM x_features",
        _col,
    )
add("f8_recent_window_features", lambda ws: ws.new_features, "SELECT * FROM x_new_features", _NEW_FLOATS)
add(
    "f9_aisle_affinity",
    lambda ws: feat.aisle_affinity(ws.pairs, ws.catalog),
    "SELECT * FROM x_affinity",
    "afinidad_pasillo",
)
add(
    "f10_join_new_features",
    lambda ws: feat.join_new_features(
        ws.features.select("user_id", "product_id", "etiqueta"), ws.new_features
    ),
    """SELECT f.user_id, f.product_id, f.etiqueta, coalesce(comprado_en_ultima, 0) AS comprado_en_ultima,
         coalesce(ratio_ultimas_3, 0) AS ratio_ultimas_3, coalesce(ratio_ultimas_5, 0) AS ratio_ultimas_5,
         coalesce(tendencia, 0) AS tendencia, coalesce(afinidad_pasillo, 0) AS afinidad_pasillo,
         coalesce(antiguedad_par, 0) AS antiguedad_par
       FROM x_features f LEFT JOIN x_new_features USING (user_id, product_id)""",
    _NEW_FLOATS,
)
add(
    "f10_missing_new_features",
    lambda ws: feat.missing_new_features(ws.features, ws.new_features),
    """SELECT count(*) AS pares, 6 * count(*) FILTER (n.user_id IS NULL) AS faltantes
       FROM x_features f LEFT JOIN x_new_features n
         ON n.user_id = f.user_id AND n.product_id = f.product_id""",
)
add(
    "f11_train_medians",
    lambda ws: feat.medians(ws.part("train")),
    """SELECT variable, median(valor) AS mediana FROM (
         UNPIVOT (SELECT ciclos_desde_ultima_compra, ciclos_totales, cadencia_par, vencimiento
                  FROM x_features WHERE split = 'train')
         ON ciclos_desde_ultima_compra, ciclos_totales, cadencia_par, vencimiento
         INTO NAME variable VALUE valor) GROUP BY 1""",
    "mediana",
)
_IMPUTED = ", ".join(
    f"coalesce({c}, (SELECT median({c}) FROM x_features WHERE split = 'train')) AS {c}, "
    f"CAST({c} IS NULL AS INTEGER) AS {c}_imputado"
    for c in feat.NULLABLE_COLUMNS
)
add(
    "f11_impute_with_indicator",
    lambda ws: feat.impute_with_indicator(ws.part("valid"), feat.medians(ws.part("train"))).select(
        "user_id", "product_id",
        *[x for c in feat.NULLABLE_COLUMNS for x in (c, f"{c}_imputado")],
    ),
    f"SELECT user_id, product_id, {_IMPUTED} FROM x_features WHERE split = 'valid'",
    " ".join(feat.NULLABLE_COLUMNS),
)


def _standardized(ws):
    from pyspark.ml.functions import vector_to_array

    z = models.standardize(ws.part("train"), ws.part("valid"))
    names = models.design_columns()
    return z.withColumn("z", vector_to_array("z")).select(
        "user_id", "product_id",
        F.col("z")[names.index("freq_usuario_producto")].alias("z_freq"),
        F.col("z")[names.index("ratio_usuario_producto")].alias("z_ratio"),
        F.col("z")[names.index("popularidad_producto")].alias("z_popularidad"),
    )


add(
    "f12_standardize",
    _standardized,
    """SELECT user_id, product_id,
         (freq_usuario_producto - f.m) / f.s AS z_freq,
         (ratio_usuario_producto - r.m) / r.s AS z_ratio,
         (popularidad_producto - p.m) / p.s AS z_popularidad
       FROM x_features,
         (SELECT avg(freq_usuario_producto) AS m, stddev_samp(freq_usuario_producto) AS s
          FROM x_features WHERE split = 'train') f,
         (SELECT avg(ratio_usuario_producto) AS m, stddev_samp(ratio_usuario_producto) AS s
          FROM x_features WHERE split = 'train') r,
         (SELECT avg(popularidad_producto) AS m, stddev_samp(popularidad_producto) AS s
          FROM x_features WHERE split = 'train') p
       WHERE split = 'valid'""",
    "z_freq z_ratio z_popularidad",
)

# rankings ---------------------------------------------------------------------------------------

add("r1_truth", lambda ws: ws.truth, "SELECT * FROM x_truth")
add(
    "r2_users_of_split",
    lambda ws: rankers.users_of_split(ws.features, "valid"),
    "SELECT DISTINCT user_id FROM x_features WHERE split = 'valid'",
)
add(
    "r3_popularity_topk",
    lambda ws: rankers.popularity_topk(ws.items, ws.valid_users),
    "SELECT user_id, product_id, CAST(rank AS INTEGER) AS rank FROM x_rank_pop",
)
add(
    "r4_repurchase_topk",
    lambda ws: rankers.repurchase_topk(ws.part("valid")),
    "SELECT user_id, product_id, CAST(rank AS INTEGER) AS rank FROM x_rank_rep",
)
add(
    "r4b_repurchase_topk_by_count",
    lambda ws: ws.baseline_by_count,
    "SELECT user_id, product_id, CAST(rank AS INTEGER) AS rank FROM x_base_count",
)
add(
    "r4c_repurchase_case",
    lambda ws: rankers.repurchase_case(
        ws.interactions, ws.users, ws.users.agg(F.min("user_id")).scalar()
    ),
    """SELECT user_id, product_id, freq_usuario_producto,
         freq_usuario_producto::DOUBLE / cantidad_ordenes_historicas AS ratio
       FROM x_inter JOIN x_usuarios USING (user_id)
       WHERE user_id = (SELECT min(user_id) FROM x_usuarios)
       ORDER BY ratio DESC, recencia_usuario_producto, freq_usuario_producto DESC, product_id
       LIMIT 10""",
    "ratio",
)
add(
    "r5_heuristic_score",
    lambda ws: ws.features.select("user_id", "product_id", rankers.heuristic_score().alias("score")),
    "SELECT user_id, product_id, score FROM x_heur",
    "score",
)
_WEIGHTED = " UNION ALL ".join(
    f"SELECT 'pesos_{i}' AS modelo, user_id, product_id, {w['ratio']}::DOUBLE * ratio_usuario_producto "
    f"+ {w['recencia']}::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + recencia_usuario_producto)) "
    f"+ {w['producto']}::DOUBLE * reorder_rate_producto AS score FROM x_features WHERE split = 'train'"
    for i, w in enumerate(rankers.WEIGHT_GRID, 1)
)
WEIGHT_RANKINGS = f"""
    SELECT modelo, user_id, product_id, row_number() OVER (PARTITION BY modelo, user_id
             ORDER BY score DESC, product_id) AS rank
    FROM ({_WEIGHTED}) QUALIFY rank <= 10"""
add(
    "r6_weight_rankings",
    lambda ws: rankers.weight_rankings(ws.part("train")),
    f"SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM ({WEIGHT_RANKINGS})",
)
add(
    "r10_topk",
    lambda ws: ws.ranking,
    "SELECT user_id, product_id, CAST(rank AS INTEGER) AS rank FROM x_ranking",
)
add(
    "r12_group_sizes",
    lambda ws: rankers.group_sizes(ws.features),
    "SELECT user_id, count(*) AS filas FROM x_features GROUP BY 1",
)
add("r13_history", lambda ws: ws.history, "SELECT * FROM x_history")
add(
    "r14_user_segments",
    lambda ws: rankers.user_segments(ws.features),
    "SELECT DISTINCT user_id, segmento_usuario AS segmento FROM x_features",
)

# user splits for training -----------------------------------------------------------------------

_TRAIN_USERS = "(SELECT user_id FROM x_split WHERE split = 'train')"


def _shuffled(seed: str) -> str:
    return (
        f"(SELECT user_id, row_number() OVER (ORDER BY md5(user_id || ':{seed}'), user_id) AS pos, "
        f"count(*) OVER () AS n FROM {_TRAIN_USERS})"
    )


add(
    "e5_nested_user_sample",
    lambda ws: models.nested_user_sample(ws.part("train"), (0.25, 0.5, 0.75, 1.0)),
    f"""SELECT fraccion, user_id FROM {_shuffled('curva:42')} CROSS JOIN
        (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) f(fraccion)
        WHERE pos <= floor(n * fraccion)""",
    "fraccion",
)
add(
    "e7_early_stop_split",
    lambda ws: models.early_stop_split(ws.part("train")),
    f"SELECT user_id, pos > floor(n * 0.9::DOUBLE) AS es_freno FROM {_shuffled('freno:42')}",
)
add(
    "e8_three_way_split",
    lambda ws: models.three_way_split(ws.part("train")),
    f"""SELECT user_id, CASE WHEN pos <= floor(n * 0.8::DOUBLE) THEN 'ajuste'
          WHEN pos <= floor(n * 0.9::DOUBLE) THEN 'freno' ELSE 'tuning' END AS parte
        FROM {_shuffled('tres:42')}""",
)
add(
    "e19_sample_rows",
    lambda ws: feat.sample_rows(ws.part("train"), 1000).select("user_id", "product_id", "etiqueta"),
    """SELECT user_id, product_id, etiqueta FROM x_features WHERE split = 'train'
       ORDER BY md5(user_id || ':' || product_id || ':42'), user_id, product_id LIMIT 1000""",
)
