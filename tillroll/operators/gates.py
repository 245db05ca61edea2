"""Checks that stop a build, counted while its tables are written.

`COUNTS` says what a table counts about its rows as they go to its files: observed metrics of the job
that writes them, so a check costs no second scan. All counting is done by the tasks that write, and
Spark takes in the counts of each of those once, also when executors are lost and stages run again.

`RULES` says which counts must agree. A rule is looked at when its table has been written and before
anything can read it; what breaks one raises `BuildStopped` and the table's files are removed.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.validate import EVAL_SETS, MAX_ORDER_NUMBER


class BuildStopped(ValueError):
    """A table was not built because a check on it failed."""


@dataclass(frozen=True)
class Finding:
    """Two counts that must agree."""

    table: str
    control: str
    built: int
    source: int


_EVAL = ", ".join(f"'{s}'" for s in EVAL_SETS)
_LINES = {
    "claves_nulas": "count_if(order_id IS NULL OR product_id IS NULL)",
    "posicion_invalida": "count_if(coalesce(add_to_cart_order < 1, true))",
    "reordered_invalido": "count_if(coalesce(reordered NOT IN (0, 1), true))",
}
# what rows hold, as one number that does not depend on their order
_PRINT = "coalesce(bit_xor(CASE WHEN {0} THEN xxhash64(user_id, CAST({1} AS INT), product_id) END), 0)"
COUNTS: dict[str, dict[str, str]] = {
    **{
        f"raw_{t}": {"aceptadas": "count_if(NOT _rechazada)", "rechazadas": "count_if(_rechazada)"}
        for t in ("orders", "products", "aisles", "departments")
    },
    **{
        f"raw_order_products_{t}": {
            "aceptadas": "count_if(NOT _rechazada)", "rechazadas": "count_if(_rechazada)",
            **{c: e.replace("count_if(", "count_if(NOT _rechazada AND (") + ")" for c, e in _LINES.items()},
        }
        for t in ("prior", "train")
    },
    "products": {"filas": "count(1)", "repetidas": "count_if(_repetida)"},
    "orders": {
        "filas": "count(1)",
        "claves_nulas": "count_if(order_id IS NULL OR user_id IS NULL)",
        "eval_set_invalido": f"count_if(coalesce(eval_set NOT IN ({_EVAL}), true))",
        "order_number_invalido": "count_if(coalesce(order_number < 1, true))",
        "order_number_fuera": f"count_if(coalesce(order_number NOT BETWEEN 1 AND {MAX_ORDER_NUMBER}, true))",
        "order_dow_invalido": "count_if(coalesce(order_dow NOT BETWEEN 0 AND 6, true))",
        "hora_invalida": "count_if(coalesce(try_cast(order_hour_of_day AS INT) NOT BETWEEN 0 AND 23, true))",
        "dias_invalidos": "count_if(days_since_prior_order NOT BETWEEN 0 AND 30)",
        "primeras": "count_if(days_since_prior_order IS NULL AND eval_set = 'prior')",
        "repetidas": "count_if(_repetida)",
    },
    "order_products": {
        "prior": "count_if(eval_set = 'prior')", "train": "count_if(eval_set = 'train')", **_LINES,
    },
    "catalogo": {"filas": "count(1)"},
    "targets_train": {
        "filas": "count(1)",
        "claves_nulas": "count_if(user_id IS NULL OR product_id IS NULL)",
    },
    "order_timeline": {"usuarios": "count_if(position = 1)"},
    # each line sets the bit of its order, so repeated lines are more than there are bits
    "pair_history": {
        "pares": "count_if(user_id IS NOT NULL)",
        "lineas": "coalesce(sum(n_lines), 0)",
        "sin_pedido": "coalesce(sum(CASE WHEN user_id IS NULL THEN n_lines END), 0)",
        "repetidas": "coalesce(sum(_n_seen - bit_count(_seen_low) - bit_count(_seen_high)), 0)",
        "sin_bit": "coalesce(sum(CASE WHEN user_id IS NOT NULL THEN n_lines - _n_seen END), 0)",
    },
    "productos": {"filas": "count(1)", "compras": "coalesce(sum(cantidad_compras), 0)"},
    "usuarios": {
        "filas": "count(1)",
        "compras": "coalesce(sum(cantidad_compras), 0)",
        "sin_primera_orden": "count_if(tiene_primera_orden <> 1)",
        "mediana_negativa": "count_if(mediana_dias_entre_ordenes_historicas < 0)",
        "mediana_inconsistente": (
            "count_if((cantidad_ordenes_historicas = 1) <> (mediana_dias_entre_ordenes_historicas IS NULL))"
        ),
    },
    "interacciones": {
        "filas": "count(1)",
        "freq": "coalesce(sum(freq_usuario_producto), 0)",
        "recencia_negativa": "count_if(recencia_usuario_producto < 0)",
        "dias_negativos": "count_if(dias_registrados_desde_ultima_compra < 0)",
        "ultima_orden_con_dias": (
            "count_if(recencia_usuario_producto = 0 AND dias_registrados_desde_ultima_compra <> 0)"
        ),
    },
    "particion": {
        "filas": "count(1)",
        "sin_lado": "count_if(coalesce(split NOT IN ('train', 'valid'), true))",
    },
    "features": {
        "filas": "count(1)",
        "sin_etiqueta": "count_if(etiqueta IS NULL)",
        "positivos": "coalesce(sum(etiqueta), 0)",
        "nulos_ratio": "count_if(ratio_usuario_producto IS NULL)",
        "nulos_posicion": "count_if(posicion_relativa IS NULL)",
        "fuga": "count_if(coalesce(_orden_objetivo <= _ultima_orden, true))",
    },
    "ranking": {"principal": "count_if(rank <= 10)", "huella": _PRINT.format("rank <= 10", "rank")},
    "candidatos_nuevos": {
        "filas": "count(1)",
        "nulos_o_rank": (
            "count_if(user_id IS NULL OR product_id IS NULL OR score_candidate IS NULL "
            "OR coalesce(candidate_rank < 1, true))"
        ),
        "completos": "count_if(candidate_rank = _objetivo)",
    },
    "dos_bloques": {
        "principal": "count_if(bloque = 'principal')",
        "huella": _PRINT.format("bloque = 'principal'", "posicion"),
    },
}

# table -> control -> (own count, count of a table before it, or None for zero)
RULES: dict[str, dict[str, tuple[str, str | None]]] = {
    "orders": {
        c: (c, None)
        for c in (
            "claves_nulas", "eval_set_invalido", "order_number_invalido", "order_number_fuera",
            "order_dow_invalido", "hora_invalida", "dias_invalidos", "repetidas",
        )
    },
    "products": {"repetidas": ("repetidas", None)},
    "order_products": {c: (c, None) for c in _LINES},
    "catalogo": {"productos": ("filas", "products.filas")},
    "targets_train": {"lineas": ("filas", "order_products.train"), "claves_nulas": ("claves_nulas", None)},
    "order_timeline": {"primeras": ("usuarios", "orders.primeras")},
    "pair_history": {
        "lineas": ("lineas", "order_products.prior"),
        "sin_pedido": ("sin_pedido", None),
        "repetidas": ("repetidas", None),
    },
    "productos": {"catalogo": ("filas", "catalogo.filas"), "compras": ("compras", "pair_history.lineas")},
    "usuarios": {
        "usuarios": ("filas", "order_timeline.usuarios"),
        "compras": ("compras", "pair_history.lineas"),
        **{c: (c, None) for c in ("sin_primera_orden", "mediana_negativa", "mediana_inconsistente")},
    },
    "interacciones": {
        "pares": ("filas", "pair_history.pares"),
        "compras": ("freq", "pair_history.lineas"),
        **{c: (c, None) for c in ("recencia_negativa", "dias_negativos", "ultima_orden_con_dias")},
    },
    "particion": {"sin_lado": ("sin_lado", None)},
    "features": {c: (c, None) for c in ("sin_etiqueta", "nulos_ratio", "nulos_posicion", "fuga")},
    "candidatos_nuevos": {
        "nulos_o_rank": ("nulos_o_rank", None),
        "completos": ("completos", "usuarios.filas"),
    },
    "dos_bloques": {"principal": ("principal", "ranking.principal"), "huella": ("huella", "ranking.huella")},
}


def counts(table: str, columns: Sequence[str]) -> dict[str, Column]:
    """What to observe while a table is written; nothing for a table without checks.

    Columns whose names begin with _ are there for the checks only and are not written. A count of such
    a column that the table was built without is left out.
    """
    has = lambda e: set(re.findall(r"\b_\w+", e)) <= set(columns)
    return {name: F.expr(e).alias(name) for name, e in COUNTS.get(table, {}).items() if has(e)}


def findings(table: str, observed: Mapping[str, Mapping[str, int]]) -> list[Finding]:
    """The rules of a table with their counts. A rule on a table that wasn't observed says nothing."""
    out = []
    for control, (own, other) in RULES.get(table, {}).items():
        source = 0
        if other:
            name, count = other.split(".")
            if name not in observed:
                continue
            source = observed[name][count]
        if own in observed[table]:
            out.append(Finding(table, control, observed[table][own], source))
    return out


def require(table: str, observed: Mapping[str, Mapping[str, int]], skip: frozenset[str] = frozenset()) -> None:
    """Raise if two counts of a table don't agree. `skip` names rules as table.control."""
    bad = [
        f"{table}.{f.control}: {f.built}" + (f" instead of {f.source}" if f.source else "")
        for f in findings(table, observed)
        if f.built != f.source and f"{table}.{f.control}" not in skip
    ]
    if bad:
        raise BuildStopped("build stopped: " + "; ".join(bad))


def report(spark, observed: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """All rules of the tables that were written: tabla, control, construido, origen."""
    rows = [
        (f.table, f.control, f.built, f.source) for table in observed for f in findings(table, observed)
    ]
    return spark.createDataFrame(rows, "tabla STRING, control STRING, construido BIGINT, origen BIGINT")
