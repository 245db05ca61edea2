"""Registered queries: association rules and the two-block recommender."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.functions import is_variant, name_tokens
from tillroll.operators import eda, recommend, rules
from tillroll.plans.registry import add

_STRENGTH = "soporte confianza lift"

add(
    "a1_basket_total",
    lambda ws: rules.basket_total(ws.prior),
    "SELECT count(DISTINCT order_id) AS ordenes FROM x_prior",
)
add("a2_support", lambda ws: ws.support, "SELECT * FROM x_support")
add(
    "a3_prune_baskets",
    lambda ws: rules.prune_baskets(ws.prior, ws.support),
    """SELECT order_id, product_id FROM x_prior
       WHERE product_id IN (SELECT product_id FROM x_support)""",
)
add("a4_pair_counts", lambda ws: ws.pair_counts, "SELECT * FROM x_pairs")
add(
    "a4_pair_counts_split_baskets",
    lambda ws: rules.pair_counts(
        rules.prune_baskets(ws.prior, ws.support), "product_id", ws.limits[1], cut=2
    ),
    "SELECT * FROM x_pairs",
)
add("a5_directed_rules", lambda ws: ws.rules, "SELECT * FROM x_rules", _STRENGTH)


def _variants(ws):
    return ws.rules.select(
        "producto_a_id", "producto_b_id",
        is_variant(name_tokens(F.col("si_compra")), name_tokens(F.col("tambien_lleva"))).alias(
            "es_variante"
        ),
    )


add("a6_is_variant", _variants, "SELECT producto_a_id, producto_b_id, es_variante FROM x_flagged")
add("a7_complementary", lambda ws: ws.published_rules, "SELECT * FROM x_reglas", _STRENGTH)
add(
    "a8_aisle_rules",
    lambda ws: rules.category_rules(
        rules.category_baskets(ws.prior, ws.catalog, "aisle"), "aisle", ws.basket_total, 20
    ),
    """SELECT d.x AS si_compra_de, d.y AS tambien_lleva_de, ordenes_juntos,
         ordenes_juntos / n AS soporte, ordenes_juntos / cx.c AS confianza,
         (ordenes_juntos / cx.c) / (cy.c / n) AS lift
       FROM (SELECT a AS x, b AS y, ordenes_juntos FROM x_pairs_aisle
             UNION ALL SELECT b, a, ordenes_juntos FROM x_pairs_aisle) d CROSS JOIN x_n
       JOIN x_counts_aisle cx ON cx.aisle = d.x JOIN x_counts_aisle cy ON cy.aisle = d.y
       WHERE ordenes_juntos >= 20""",
    _STRENGTH,
)
# The two published numbers of best sellers.
_TOP, _MORE, _MIN = 200, 400, 20
add(
    "a9_topn_item_pairs",
    lambda ws: rules.topn_item_pairs(ws.prior, _TOP, _MIN),
    "SELECT * FROM x_top200_pairs",
)
add(
    "a9_topn_item_pairs_400",
    lambda ws: rules.topn_item_pairs(ws.prior, _MORE, _MIN),
    "SELECT * FROM x_top400_pairs",
)
add(
    "a9_best_pairs_by_count",
    lambda ws: rules.topn_item_pairs(ws.prior, _TOP, _MIN)
    .orderBy(F.desc("ordenes_juntos"), "a", "b").limit(12),
    "SELECT * FROM x_top200_pairs ORDER BY ordenes_juntos DESC, a, b LIMIT 12",
)


def _lifts(ws):
    counts = rules.support(ws.prior, 1)
    pairs = rules.topn_item_pairs(ws.prior, _TOP, _MIN)
    return rules.undirected_lift(pairs, counts, "product_id", ws.basket_total)


add("a10_undirected_lift", _lifts, "SELECT * FROM x_lifts", "soporte conf_a_b conf_b_a lift")
add(
    "a10_best_pairs_by_lift",
    lambda ws: _lifts(ws).orderBy(F.desc(F.round("lift", 9)), "a", "b").limit(15),
    "SELECT * FROM x_lifts ORDER BY round(lift, 9) DESC, a, b LIMIT 15",
    "soporte conf_a_b conf_b_a lift",
)


def _category_lifts(ws, key, min_pairs):
    lines = rules.category_baskets(ws.prior, ws.catalog, key)
    counts = lines.groupBy(key).agg(F.count(F.lit(1)).alias("ordenes_con"))
    return rules.undirected_lift(
        rules.pair_counts(lines, key, min_pairs), counts, key, ws.basket_total
    )


def _category_sql(key: str, min_pairs: int) -> str:
    return f"""
      SELECT a, b, ordenes_juntos, ordenes_juntos / n AS soporte,
        ordenes_juntos / ca.c AS conf_a_b, ordenes_juntos / cb.c AS conf_b_a,
        ordenes_juntos * n / (ca.c * cb.c) AS lift
      FROM x_pairs_{key} CROSS JOIN x_n JOIN x_counts_{key} ca ON ca.{key} = a
      JOIN x_counts_{key} cb ON cb.{key} = b WHERE ordenes_juntos >= {min_pairs}"""


add(
    "a11_aisle_pairs",
    lambda ws: _category_lifts(ws, "aisle_id", 100),
    _category_sql("aisle_id", 100),
    "soporte conf_a_b conf_b_a lift",
)
add(
    "a11_department_lift_matrix",
    lambda ws: rules.lift_matrix(_category_lifts(ws, "department_id", 1), list(range(1, 7))),
    f"""SELECT fila, {", ".join(f"max(lift) FILTER (columna = {i}) AS lift_{i}" for i in range(1, 7))}
        FROM (SELECT a AS fila, b AS columna, lift FROM ({_category_sql("department_id", 1)})
              UNION ALL SELECT b, a, lift FROM ({_category_sql("department_id", 1)}))
        GROUP BY fila""",
    " ".join(f"lift_{i}" for i in range(1, 7)),
)
_A, _B = "red widget", "blue bolt"
add(
    "a12_pair_stats",
    lambda ws: rules.pair_stats(ws.prior, ws.catalog, _A, _B),
    f"""SELECT '{_A}' AS a, '{_B}' AS b, na AS pedidos_a, nb AS pedidos_b, nab AS juntos,
          nab / n AS soporte, nab::DOUBLE / na AS confianza_a_b,
          (nab / n) / ((na / n) * (nb / n)) AS lift
        FROM x_n CROSS JOIN (
          SELECT (SELECT count(*) FROM (SELECT order_id FROM x_prior WHERE product_id = ia)) AS na,
                 (SELECT count(*) FROM (SELECT order_id FROM x_prior WHERE product_id = ib)) AS nb,
                 (SELECT count(*) FROM (SELECT order_id FROM x_prior WHERE product_id = ia
                    INTERSECT SELECT order_id FROM x_prior WHERE product_id = ib)) AS nab
          FROM (SELECT min(product_id) FILTER (product_name = '{_A}') AS ia,
                       min(product_id) FILTER (product_name = '{_B}') AS ib FROM x_products))""",
    "soporte confianza_a_b lift",
)
add(
    "a13_rule_index",
    lambda ws: ws.rule_index,
    "SELECT * REPLACE (CAST(orden AS INTEGER) AS orden) FROM x_index",
    "confianza",
)
add(
    "a14_novelty_suggestions",
    lambda ws: ws.suggestions,
    "SELECT * REPLACE (CAST(posicion AS INTEGER) AS posicion) FROM x_suggest",
    "confianza",
)
add(
    "a15_novelty_policy",
    lambda ws: ws.segments.select("user_id", "segmento", recommend.slots(recommend.POLICY).alias("n")),
    "SELECT user_id, segmento, coalesce(n, 0) AS n FROM x_valid LEFT JOIN x_policy USING (segmento)",
)
add("a16_two_block", lambda ws: ws.two_block, "SELECT * FROM x_blocks")
for _block in ("principal", "sugerencia"):
    add(
        f"a17_only_block_{_block}",
        lambda ws, b=_block: recommend.only_block(ws.two_block, b),
        f"SELECT user_id, product_id, posicion AS rank FROM x_blocks WHERE bloque = '{_block}'",
    )


def hybrid_sql(values: str) -> str:
    """Hybrid lists for (modelo, segmento, slots) rows; a NULL segment means every segment."""
    return f"""
      WITH p AS (SELECT v.user_id, m.modelo, least(m.slots, coalesce(s.c, 0)) AS n_new, r.c AS n_rank
                 FROM x_valid v
                 JOIN (SELECT user_id, count(*) AS c FROM x_top10 GROUP BY 1) r USING (user_id)
                 LEFT JOIN (SELECT user_id, count(*) AS c FROM x_suggest GROUP BY 1) s
                   ON s.user_id = v.user_id
                 JOIN (VALUES {values}) m(modelo, segmento, slots)
                   ON m.segmento IS NULL OR m.segmento = v.segmento)
      SELECT modelo, user_id, product_id, rank, 0 AS es_nuevo
      FROM x_top10 JOIN p USING (user_id) WHERE rank <= 10 - n_new
      UNION ALL
      SELECT modelo, user_id, product_id, least(n_rank, 10 - n_new) + posicion, 1
      FROM x_suggest JOIN p USING (user_id) WHERE posicion <= n_new"""


SLOT_VALUES = ", ".join(f"('{s}', NULL, {s})" for s in range(4))
POLICY_VALUES = ", ".join(
    f"('{name}', '{seg}', {policy.get(seg, 0)})"
    for name, policy in recommend.POLICIES.items()
    for seg in ("nuevo", "medio", "heavy")
)
add(
    "a18_hybrid_topk",
    lambda ws: recommend.hybrid_topk(
        ws.top10, ws.suggestions, {f"{s}": F.lit(s) for s in range(4)}
    ),
    hybrid_sql(SLOT_VALUES),
)
add(
    "a19_hybrid_by_segment",
    lambda ws: recommend.hybrid_topk(
        ws.top10, ws.suggestions,
        {n: recommend.slots(p) for n, p in recommend.POLICIES.items()}, ws.segments,
    ),
    hybrid_sql(POLICY_VALUES),
)
add(
    "v13_two_block_gate",
    lambda ws: recommend.two_block_gate(ws.two_block, ws.top10),
    """SELECT count(DISTINCT user_id) AS usuarios,
         count(DISTINCT user_id) FILTER (b.product_id IS DISTINCT FROM r.product_id)
           AS usuarios_distintos
       FROM (SELECT user_id, posicion AS rank, product_id FROM x_blocks WHERE bloque = 'principal') b
       FULL JOIN x_top10 r USING (user_id, rank)""",
)
add(
    "d21_lift_distribution",
    lambda ws: eda.lift_distribution(_lifts(ws)),
    """SELECT CAST(least(floor(least(lift, 8.0::DOUBLE) / (8.0::DOUBLE / 40)), 39) AS INTEGER) AS bin,
         count(*) AS pares FROM x_lifts GROUP BY 1""",
)
