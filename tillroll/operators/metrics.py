"""Ranking and novelty metrics for any number of systems in one pass.

Recommendations are long frames (modelo, user_id, product_id, rank); truth and history are
(user_id, product_id). The three are stacked and aggregated once by (user, item), so a pair meets
its truth and history flags without three joins and a very large user is spread over its items. User
metrics and catalogue coverage both come from that aggregate, so a ranking is computed once.
The truth decides which users count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import f1, safe_ratio

ALL = "__all__"
K = 10
DEFAULT_CATALOG_SIZE = 49_688

BASE_COLUMNS = (
    "n_usuarios", "precision", "recall", "recall_macro", "recall_micro", "f1", "f1_micro",
    "hit_rate", "cobertura", "usuarios_completos", "aciertos_totales", "objetivos_totales",
    "sin_recomendaciones", "sin_segmento",
)
NOVELTY_COLUMNS = (
    "novedad_ofrecida", "precision_novedad", "recall_novedad", "hit_rate_novedad",
    "n_con_novedad_ofrecida", "n_con_objetivo_nuevo", "aciertos_nuevos_totales",
    "objetivos_nuevos_totales",
)
SHOWN = ("hits", "shown", "new_shown", "new_hits")


@dataclass(frozen=True)
class Cut:
    """One row of the report: the first `k` of the list called `modelo`, shown as `label`."""

    label: str
    modelo: str
    k: int


def _mark(i: int) -> str:
    return f"_rank_{i}"


def pair_marks(
    recs: DataFrame, truth: DataFrame, cuts: Sequence[Cut], history: DataFrame | None
) -> DataFrame:
    """One row per user and item that was recommended or bought.

    Holds the best rank in each list and the truth and history flags.
    """
    models = list(dict.fromkeys(c.modelo for c in cuts))
    deepest = {m: max(c.k for c in cuts if c.modelo == m) for m in models}
    wanted = F.lit(False)
    for m in models:
        wanted = wanted | ((F.col("modelo") == m) & (F.col("rank") <= deepest[m]))
    cols = lambda df, model, rank, real, known: df.select(
        "user_id",
        "product_id",
        model.cast("string").alias("modelo"),
        rank.cast("long").alias("rank"),
        F.lit(real).alias("real"),
        F.lit(known).alias("known"),
    )
    none = F.lit(None)
    rows = cols(recs.where(wanted), F.col("modelo"), F.col("rank"), 0, 0).unionByName(
        cols(truth, none, none, 1, 0)
    )
    if history is not None:
        rows = rows.unionByName(cols(history, none, none, 0, 1))
    return (
        rows.groupBy("user_id", "product_id")
        .agg(
            *[
                F.min(F.when(F.col("modelo") == m, F.col("rank"))).alias(_mark(i))
                for i, m in enumerate(models)
            ],
            F.max("real").alias("real"),
            F.max("known").alias("known"),
        )
        .where(
            (F.col("real") == 1)
            | F.coalesce(*[F.col(_mark(i)) for i in range(len(models))]).isNotNull()
        )
    )


def _user_counts(pairs: DataFrame, cuts: Sequence[Cut], models: Sequence[str], lists: bool) -> DataFrame:
    """One row per user of the truth: what each cut shows and hits, and with `lists` what was shown.

    A list holds at most the longest cut of every model, so it is bounded for a hot user as well.
    """
    real = (F.col("real") == 1) & F.col("product_id").isNotNull()
    new = F.col("known") == 0
    count = lambda cond: F.count(F.when(cond, 1))
    aggs: list[Column] = [
        F.max("real").alias("in_truth"),
        count(real).alias("targets"),
        count(real & new).alias("new_targets"),
    ]
    for i, c in enumerate(cuts):
        shown = F.col(_mark(models.index(c.modelo))) <= c.k
        aggs += [
            count(shown & real).alias(f"hits_{i}"),
            count(shown).alias(f"shown_{i}"),
            count(shown & new).alias(f"new_shown_{i}"),
            count(shown & new & real).alias(f"new_hits_{i}"),
        ]
    if lists:
        marks = F.array(*[F.col(_mark(m)) for m in range(len(models))])
        some = F.coalesce(*[F.col(_mark(m)) for m in range(len(models))]).isNotNull()
        item = F.struct(F.col("product_id").alias("product_id"), marks.alias("ranks"))
        aggs.append(F.collect_list(F.when(some, item)).alias("items"))
    return pairs.groupBy("user_id").agg(*aggs).where("in_truth = 1")


def per_user(
    recs: DataFrame, truth: DataFrame, cuts: Sequence[Cut], history: DataFrame | None = None
) -> DataFrame:
    """Hits, list length and novelty counts of every user of the truth, one row per cut."""
    models = list(dict.fromkeys(c.modelo for c in cuts))
    users = _user_counts(pair_marks(recs, truth, cuts, history), cuts, models, lists=False)
    per_cut = F.array(
        *[
            F.struct(
                F.lit(c.label).alias("modelo"),
                F.lit(c.k).alias("k"),
                *[F.col(f"{name}_{i}").alias(name) for name in SHOWN],
            )
            for i, c in enumerate(cuts)
        ]
    )
    return users.select(
        "user_id", "targets", "new_targets", F.explode(per_cut).alias("c")
    ).select("user_id", "targets", "new_targets", "c.*")


def _sums() -> dict[str, Column]:
    """What is added up over users, from the columns of one user and cut."""
    flag = lambda cond: cond.cast("long")
    return {
        "n_usuarios": F.lit(1).cast("long"),
        "aciertos_totales": F.col("hits"),
        "objetivos_totales": F.col("targets"),
        "sum_recall": safe_ratio(F.col("hits"), F.col("targets")),
        "n_hit": flag(F.col("hits") > 0),
        "n_full": flag(F.col("shown") >= F.col("k")),
        "sin_recomendaciones": flag(F.col("shown") == 0),
        "sin_segmento": F.col("no_segment"),
        "n_empty": flag(F.col("targets") == 0),
        "sum_new_shown": F.col("new_shown"),
        "sum_new_precision": safe_ratio(F.col("new_hits"), F.col("new_shown")),
        "sum_new_recall": safe_ratio(F.col("new_hits"), F.col("new_targets")),
        "n_con_novedad_ofrecida": flag(F.col("new_shown") > 0),
        "n_con_objetivo_nuevo": flag(F.col("new_targets") > 0),
        "n_new_hit": flag(F.col("new_hits") > 0),
        "aciertos_nuevos_totales": F.col("new_hits"),
        "objetivos_nuevos_totales": F.col("new_targets"),
    }


def totals_and_items(
    recs: DataFrame,
    truth: DataFrame,
    cuts: Sequence[Cut],
    segments: DataFrame | None,
    history: DataFrame | None,
) -> DataFrame:
    """Sums over users and distinct items shown, by cut and group, from one pass over the rankings.

    Each user gives one row per cut and one per item and model. Both kinds go through one aggregate, by
    (group, cut) and by (group, model, item): the sums are partly added up before its shuffle, and an
    item is left with its best rank. Only then is an item counted in every cut that reaches that rank.
    """
    models = list(dict.fromkeys(c.modelo for c in cuts))
    users = _user_counts(pair_marks(recs, truth, cuts, history), cuts, models, lists=True)
    if segments is not None:
        users = users.join(segments.select("user_id", "segmento"), "user_id", "left")
        groups = F.array_compact(F.array(F.lit(ALL), F.col("segmento")))
        no_segment = F.col("segmento").isNull().cast("long")
    else:
        groups = F.array(F.lit(ALL))
        no_segment = F.lit(0).cast("long")

    row = "struct<cut:int,k:int,model:int,product_id:int,best:bigint," + ",".join(f"{c}:bigint" for c in SHOWN) + ">"
    none = F.lit(None)
    per_cut = [
        F.struct(F.lit(i), F.lit(c.k), none, none, none, *[F.col(f"{name}_{i}") for name in SHOWN]).cast(row)
        for i, c in enumerate(cuts)
    ]
    ranked = F.flatten(
        F.transform(
            "items",
            lambda item: F.transform(
                item["ranks"],
                lambda rank, model: F.struct(none, none, model, item["product_id"], rank, *[none for _ in SHOWN]),
            ),
        )
    )
    per_item = F.filter(ranked.cast(f"array<{row}>"), lambda x: x["best"].isNotNull())
    rows = users.select(
        "targets", "new_targets", no_segment.alias("no_segment"), F.explode(groups).alias("grupo"),
        F.concat(F.array(*per_cut), per_item).alias("rows"),
    )
    rows = rows.select("targets", "new_targets", "no_segment", "grupo", F.explode("rows").alias("r"))
    rows = rows.select("targets", "new_targets", "no_segment", "grupo", "r.*")
    of_cut = F.col("cut").isNotNull()
    sums = _sums()
    reduced = rows.groupBy("grupo", "cut", "model", "product_id").agg(
        F.min("best").alias("best"), *[F.sum(F.when(of_cut, c)).alias(n) for n, c in sums.items()]
    )
    reached = [
        F.when((F.col("model") == models.index(c.modelo)) & (F.col("best") <= c.k), F.lit(i))
        for i, c in enumerate(cuts)
    ]
    spread = F.when(of_cut, F.array("cut")).otherwise(F.array_compact(F.array(*reached)))
    counted = reduced.select(
        "grupo", F.explode(spread).alias("cut"), F.when(~of_cut, 1).alias("item"), *sums
    )
    # a row of zeros per cut keeps the total row even when the truth is empty
    zeros = recs.sparkSession.range(len(cuts)).select(
        F.lit(ALL).alias("grupo"), F.col("id").cast("int").alias("cut"), none.cast("int").alias("item"),
        *[F.lit(0).cast("double" if n.startswith("sum_new_p") or n.endswith("recall") else "long").alias(n) for n in sums],
    )
    out = counted.unionByName(zeros).groupBy("grupo", "cut").agg(
        F.count("item").alias("items"), *[F.sum(n).alias(n) for n in sums]
    )
    named = F.array(*[F.struct(F.lit(c.label).alias("modelo"), F.lit(c.k).alias("k")) for c in cuts])
    return out.select(F.element_at(named, F.col("cut") + 1).alias("c"), "*").select("c.*", "*").drop("c", "cut")


def score(
    recs: DataFrame,
    truth: DataFrame,
    cuts: Sequence[Cut],
    segments: DataFrame | None = None,
    history: DataFrame | None = None,
    catalog_size: int | Column = DEFAULT_CATALOG_SIZE,
    strict: bool = True,
) -> DataFrame:
    """One row per cut for all users, and one per cut and segment if `segments` is given.

    With `strict` the job fails if a user of the truth got no recommendation; otherwise that user
    counts as zero hits. A truth row without an item (an empty target basket) always fails it.
    """
    if not cuts:
        raise ValueError("no systems to score")
    totals = totals_and_items(recs, truth, cuts, segments, history)
    mean = lambda x, n: F.coalesce(safe_ratio(x, n), F.lit(0.0))
    totals = totals.where(
        F.when(
            F.col("n_empty") > 0,
            F.raise_error(
                F.concat(F.col("n_empty").cast("string"), F.lit(" users have an empty target basket"))
            ).cast("boolean"),
        ).otherwise(F.lit(True))
    )
    if strict:
        totals = totals.where(
            F.when(
                F.col("sin_recomendaciones") > 0,
                F.raise_error(
                    F.concat(
                        F.col("sin_recomendaciones").cast("string"),
                        F.lit(" users have no recommendations in "),
                        F.col("modelo"),
                    )
                ).cast("boolean"),
            ).otherwise(F.lit(True))
        )
    n = F.col("n_usuarios")
    size = F.lit(catalog_size) if isinstance(catalog_size, int) else catalog_size
    out = (
        totals.withColumns(
            {
                "precision": mean(F.col("aciertos_totales"), n * F.col("k")),
                "recall": mean(F.col("sum_recall"), n),
                "recall_micro": mean(F.col("aciertos_totales"), F.col("objetivos_totales")),
                "hit_rate": mean(F.col("n_hit"), n),
                "cobertura": mean(F.coalesce("items", F.lit(0)), size),
                "usuarios_completos": mean(F.col("n_full"), n),
                "novedad_ofrecida": mean(F.col("sum_new_shown"), n * F.col("k")),
                "precision_novedad": mean(
                    F.col("sum_new_precision"), F.col("n_con_novedad_ofrecida")
                ),
                "recall_novedad": mean(F.col("sum_new_recall"), F.col("n_con_objetivo_nuevo")),
                "hit_rate_novedad": mean(F.col("n_new_hit"), F.col("n_con_objetivo_nuevo")),
            }
        )
        .withColumns(
            {
                "recall_macro": F.col("recall"),
                "f1": f1(F.col("precision"), F.col("recall")),
                "f1_micro": f1(F.col("precision"), F.col("recall_micro")),
            }
        )
    )
    return out.select(
        "modelo",
        F.col("grupo").alias("segmento"),
        "k",
        *BASE_COLUMNS,
        *(NOVELTY_COLUMNS if history is not None else ()),
    )


def evaluate(
    recs: DataFrame,
    truth: DataFrame,
    k: int = K,
    segments: DataFrame | None = None,
    catalog_size: int | Column = DEFAULT_CATALOG_SIZE,
    strict: bool = True,
    history: DataFrame | None = None,
) -> DataFrame:
    """Metrics of one system."""
    named = recs.withColumn("modelo", F.lit("modelo"))
    return score(
        named, truth, [Cut("modelo", "modelo", k)], segments, history, catalog_size, strict
    ).drop("modelo")


def stack(systems: dict[str, DataFrame]) -> DataFrame:
    """Several rankings in one long frame."""
    frames = [
        df.select(F.lit(name).alias("modelo"), "user_id", "product_id", F.col("rank").cast("long").alias("rank"))
        for name, df in systems.items()
    ]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def compare(
    systems: dict[str, DataFrame],
    truth: DataFrame,
    k: int = K,
    reference: str | None = None,
    lift_metric: str = "recall",
    catalog_size: int | Column = DEFAULT_CATALOG_SIZE,
    strict: bool = True,
) -> DataFrame:
    """One row per system on the same users, with the lift over the reference system."""
    if not systems:
        raise ValueError("no systems to compare")
    reference = reference or next(iter(systems))
    if reference not in systems:
        raise ValueError(f"the reference {reference!r} is not among the systems")
    rows = score(
        stack(systems),
        truth,
        [Cut(name, name, k) for name in systems],
        catalog_size=catalog_size,
        strict=strict,
    )
    # one row per system: the window holds as many rows as there are systems
    base = F.max(F.when(F.col("modelo") == reference, F.col(lift_metric))).over(
        Window.partitionBy("segmento")
    )
    position = F.array_position(F.array(*[F.lit(m) for m in systems]), F.col("modelo"))
    return rows.select(
        position.cast("int").alias("orden"),
        "modelo", "precision", "recall", "recall_micro", "f1", "hit_rate", "cobertura",
        "n_usuarios",
        F.when(base == 0, F.lit(float("nan")))
        .otherwise((F.col(lift_metric) - base) / base)
        .alias("lift"),
    )


def new_targets(truth: DataFrame, history: DataFrame) -> DataFrame:
    """Target items the user had never bought."""
    return truth.join(history, ["user_id", "product_id"], "left_anti")


def novelty_universe(truth: DataFrame, history: DataFrame) -> DataFrame:
    """How much of the targets no history-only system can reach."""
    marked = truth.join(
        history.select("user_id", "product_id", F.lit(1).alias("known")),
        ["user_id", "product_id"],
        "left",
    )
    users = marked.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("targets"),
        F.count(F.when(F.col("known").isNull(), 1)).alias("new"),
    )
    return users.agg(
        F.sum("targets").alias("objetivos"),
        F.sum("new").alias("objetivos_nuevos"),
        F.count(F.lit(1)).alias("usuarios"),
        F.count(F.when(F.col("new") > 0, 1)).alias("usuarios_con_objetivo_nuevo"),
    ).withColumns(
        {
            "pct_objetivos_nuevos": safe_ratio(F.col("objetivos_nuevos"), F.col("objetivos")),
            "pct_usuarios": safe_ratio(F.col("usuarios_con_objetivo_nuevo"), F.col("usuarios")),
        }
    )


def ceiling_at_n(
    targets: DataFrame, ns: Sequence[int], segments: DataFrame | None = None
) -> DataFrame:
    """Best recall a history-only ranker can reach with n places: min(reordered, n) / items."""
    users = targets.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum("reordered").alias("repeated")
    )
    groups = F.array(F.lit(ALL))
    if segments is not None:
        users = users.join(segments, "user_id")
        groups = F.array(F.lit(ALL), F.col("segmento"))
    return (
        users.withColumn("n", F.explode(F.array(*[F.lit(n) for n in ns])))
        .withColumn("grupo", F.explode(groups))
        .groupBy("n", F.col("grupo").alias("segmento"))
        .agg(
            F.avg(F.least(F.col("repeated"), F.col("n")).cast("double") / F.col("items")).alias(
                "techo"
            )
        )
    )


def pct_of_ceiling(metrics: DataFrame, ceilings: DataFrame) -> DataFrame:
    """Recall of each row of `score` over the ceiling of its segment and list length."""
    tops = ceilings.select(F.col("n").alias("k"), "segmento", "techo")
    return metrics.join(tops, ["k", "segmento"]).withColumn(
        "pct_del_techo", F.col("recall") / F.col("techo")
    )


def candidate_metrics(
    systems: dict[str, DataFrame], truth: DataFrame, catalog_size: Column, k: int = K
) -> DataFrame:
    """Size, reach and recall of the candidate systems over all evaluable users."""
    recs = stack(systems)
    hits = recs.join(
        truth.withColumn("hit", F.lit(1)), ["user_id", "product_id"], "left"
    )
    users = hits.groupBy("modelo", "user_id").agg(
        F.count(F.lit(1)).alias("shown"), F.count("hit").alias("hits")
    )
    totals = truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("targets"))
    per_system = (
        users.join(totals, "user_id")
        .groupBy("modelo")
        .agg(
            F.sum("shown").alias("recomendaciones"),
            F.count(F.lit(1)).alias("usuarios_con_recomendaciones"),
            F.count(F.when(F.col("shown") >= k, 1)).alias("usuarios_topk_completo"),
            F.sum("hits").alias("aciertos"),
            F.count(F.when(F.col("hits") > 0, 1)).alias("n_hit"),
            F.sum(F.col("hits").cast("double") / F.col("targets")).alias("sum_recall"),
        )
    )
    items = recs.groupBy("modelo").agg(
        F.count_distinct("product_id").alias("productos_recomendados")
    )
    base = totals.agg(
        F.struct(F.count(F.lit(1)).alias("users"), F.sum("targets").alias("targets"))
    ).scalar()
    out = per_system.join(items, "modelo").withColumn("_base", base)
    n, t = F.col("_base.users"), F.col("_base.targets")
    return out.select(
        F.col("modelo").alias("sistema"),
        "recomendaciones",
        "usuarios_con_recomendaciones",
        "usuarios_topk_completo",
        "productos_recomendados",
        "aciertos",
        safe_ratio(F.col("aciertos"), t).alias("recall_micro"),
        (F.col("sum_recall") / n).alias("recall_macro"),
        safe_ratio(F.col("n_hit"), n).alias("hit_rate"),
        safe_ratio(F.col("productos_recomendados"), catalog_size).alias("cobertura_catalogo"),
        safe_ratio(F.col("usuarios_topk_completo"), n).alias("usuarios_topk_completo_pct"),
    )


def discovery_metrics(new_targets_: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """How many never-bought targets the candidate pool and its first k hold."""
    found = new_targets_.join(
        candidates.select("user_id", "product_id", "candidate_rank"),
        ["user_id", "product_id"],
        "left",
    )
    rank = F.col("candidate_rank")
    users = found.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("new"),
        F.count(rank).alias("pool"),
        F.count(F.when(rank <= k, 1)).alias("top"),
    )
    totals = users.agg(
        F.sum("new").alias("objetivos_nuevos"),
        F.sum("pool").alias("encontrados_pool"),
        F.sum("top").alias("encontrados_topk"),
        F.count(F.lit(1)).alias("usuarios_con_objetivo_nuevo"),
        F.count(F.when(F.col("pool") > 0, 1)).alias("usuarios_hit_pool"),
        F.count(F.when(F.col("top") > 0, 1)).alias("usuarios_hit_topk"),
    )
    over = lambda a, b: safe_ratio(F.col(a), F.col(b))
    return totals.withColumns(
        {
            "recall_pool_nuevos": over("encontrados_pool", "objetivos_nuevos"),
            "recall_topk_nuevos": over("encontrados_topk", "objetivos_nuevos"),
            "hit_rate_pool_nuevos": over("usuarios_hit_pool", "usuarios_con_objetivo_nuevo"),
            "hit_rate_topk_nuevos": over("usuarios_hit_topk", "usuarios_con_objetivo_nuevo"),
        }
    )
