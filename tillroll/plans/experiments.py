"""Experiment jobs: comparisons, sweeps, policies and the final report."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.functions import safe_ratio, segment_order
from tillroll.functions.prefix import ordinal, md5_chunk
from tillroll.functions import md5_key
from tillroll.operators import metrics, models, rank_boosting, rankers, recommend
from tillroll.operators.features import MODEL_COLUMNS, SEED
from tillroll.operators.metrics import ALL, Cut
from tillroll.sources.store import save_params

# List lengths of the sweep, block sizes of the curve, training fractions.
LIST_LENGTHS = (5, 8, 10, 12, 15, 20, 25, 30)
BLOCK_SIZES = (1, 2, 3, 4, 5, 8)
FRACTIONS = (0.25, 0.50, 0.75, 1.00)


def gain_ladder(comparison: DataFrame, metric: str = "recall") -> DataFrame:
    """Step of the metric from each system to the next, and its share of the whole climb.

    One row per system, so the window is as small as the comparison.
    """
    by_order = Window.partitionBy().orderBy("orden")
    steps = comparison.select(
        "orden",
        F.lag("modelo").over(by_order).alias("desde"),
        F.col("modelo").alias("hasta"),
        (F.col(metric) - F.lag(metric).over(by_order)).alias("gana"),
    ).where("desde IS NOT NULL")
    return steps.withColumn(
        "del_total", safe_ratio(F.col("gana"), F.sum("gana").over(Window.partitionBy()))
    )


def sweep_n(
    ranking: DataFrame,
    truth: DataFrame,
    targets: DataFrame,
    segments: DataFrame,
    catalog_size: Column | int,
    ns: Sequence[int] = LIST_LENGTHS,
    strict: bool = True,
) -> DataFrame:
    """Metrics and ceiling at every list length from one ranking, in all and per segment."""
    named = ranking.withColumn("modelo", F.lit("m"))
    scored = metrics.score(
        named, truth, [Cut(f"n{n}", "m", n) for n in ns], segments, catalog_size=catalog_size,
        strict=strict,
    )
    users = truth.select("user_id").distinct()
    tops = metrics.ceiling_at_n(
        targets.join(users, "user_id", "left_semi"), ns, segments
    )
    return metrics.pct_of_ceiling(scored, tops).select(
        F.col("k").alias("n"), "segmento", "n_usuarios", "hit_rate", "recall", "precision", "f1",
        "cobertura", "techo", "pct_del_techo",
    )


def best_n(sweep: DataFrame) -> DataFrame:
    """The list length with the best F1 per segment, and its gain over 10. Ties: the shorter."""
    best = F.max_by("n", F.struct(F.col("f1"), -F.col("n")))
    return sweep.groupBy("segmento").agg(
        best.alias("mejor_n"),
        F.max("f1").alias("mejor_f1"),
        (F.max("f1") - F.max(F.when(F.col("n") == 10, F.col("f1")))).alias("gana_sobre_10"),
    )


def sweep_steps(sweep: DataFrame) -> DataFrame:
    """What each longer list gains and pays. One row per list length."""
    w = Window.partitionBy("segmento").orderBy("n")
    step = lambda c: (F.col(c) - F.lag(c).over(w))
    return sweep.where(F.col("segmento") == ALL).select(
        F.lag("n").over(w).alias("desde"),
        F.col("n").alias("hasta"),
        step("recall").alias("gana_recall"),
        step("hit_rate").alias("gana_hit_rate"),
        step("precision").alias("paga_precision"),
    ).where("desde IS NOT NULL")


def _price(lost: Column, gained: Column) -> Column:
    return safe_ratio(lost + gained, gained)


def novelty_slots_sweep(
    ranking: DataFrame,
    suggestions: DataFrame,
    truth: DataFrame,
    history: DataFrame,
    segments: DataFrame,
    catalog_size: Column | int,
    slots: Sequence[int] = (0, 1, 2, 3),
    k: int = 10,
) -> DataFrame:
    """Metrics with 0..n of the k places given to new items, and the price of a new hit."""
    hybrid = recommend.hybrid_topk(
        ranking, suggestions, {f"{s}": F.lit(s) for s in slots}, k=k
    )
    scored = metrics.score(
        hybrid, truth, [Cut(f"{s}", f"{s}", k) for s in slots], segments, history, catalog_size
    )
    base = F.max(F.when(F.col("modelo") == F.lit("0"), F.col("aciertos_totales"))).over(
        Window.partitionBy("segmento")
    )
    served = hybrid.where("es_nuevo = 1").groupBy("modelo", "user_id").agg(
        F.count(F.lit(1)).alias("n")
    ).join(segments, "user_id", "left")
    with_new = served.select(
        "modelo", F.explode(F.array_compact(F.array(F.lit(ALL), F.col("segmento")))).alias("segmento")
    ).groupBy("modelo", "segmento").agg(F.count(F.lit(1)).alias("usuarios_con_novedad"))
    lost = base - F.col("aciertos_totales")
    new = F.col("aciertos_nuevos_totales")
    return (
        scored.withColumn("recompra_resignada", lost + new)
        .withColumn("precio", F.when(F.col("modelo") != F.lit("0"), _price(lost, new)))
        .join(with_new, ["modelo", "segmento"], "left")
        .select(
            F.col("modelo").cast("int").alias("slots_novedad"),
            "segmento", "n_usuarios", "hit_rate", "recall", "precision", "cobertura",
            safe_ratio(F.col("objetivos_nuevos_totales"), F.col("objetivos_totales")).alias(
                "pct_objetivo_nuevo"
            ),
            "novedad_ofrecida", "precision_novedad", "recall_novedad", "hit_rate_novedad",
            "aciertos_totales",
            new.alias("aciertos_nuevos"),
            "recompra_resignada",
            "precio",
            F.coalesce("usuarios_con_novedad", F.lit(0)).alias("usuarios_con_novedad"),
        )
    )


def novelty_policy_comparison(
    ranking: DataFrame,
    suggestions: DataFrame,
    truth: DataFrame,
    history: DataFrame,
    segments: DataFrame,
    policies: dict[str, dict[str, int]] | None = None,
    k: int = 10,
) -> DataFrame:
    """Policies of places per segment against no new items at all (the first policy)."""
    policies = policies or recommend.POLICIES
    hybrid = recommend.hybrid_topk(
        ranking, suggestions, {n: recommend.slots(p) for n, p in policies.items()}, segments, k
    )
    scored = metrics.score(hybrid, truth, [Cut(n, n, k) for n in policies], history=history)
    first = next(iter(policies))
    base = F.max(F.when(F.col("modelo") == first, F.col("aciertos_totales"))).over(
        Window.partitionBy("segmento")
    )
    new = F.col("aciertos_nuevos_totales")
    return scored.select(
        F.col("modelo").alias("politica"), "hit_rate", "recall", "aciertos_totales",
        new.alias("aciertos_nuevos"), "hit_rate_novedad",
        _price(base - F.col("aciertos_totales"), new).alias("precio"),
    )


def block_one_report(
    recs: DataFrame, truth: DataFrame, segments: DataFrame, catalog_size: Column | int, k: int = 10
) -> DataFrame:
    """Repurchase metrics of the main block, in all and per segment."""
    return metrics.evaluate(
        recommend.only_block(recs, "principal"), truth, k, segments, catalog_size
    ).select("segmento", "n_usuarios", "hit_rate", "recall", "precision", "cobertura")


def block_two_scores(
    recs: DataFrame, truth: DataFrame, history: DataFrame, segments: DataFrame,
    policy: dict[str, int] | None = None,
) -> DataFrame:
    """Novelty metrics of the suggestion block; each segment is scored at its own block size."""
    policy = recommend.POLICY if policy is None else policy
    named = recommend.only_block(recs, "sugerencia").withColumn("modelo", F.lit("s"))
    shown = {s: n for s, n in policy.items() if n > 0}
    scored = metrics.score(
        named, truth, [Cut(s, "s", n) for s, n in shown.items()], segments, history, strict=False
    )
    return scored.where(F.col("modelo") == F.col("segmento"))


def block_two_report(*args, **kwargs) -> DataFrame:
    return block_two_scores(*args, **kwargs).select(
        "segmento", F.col("k").alias("lugares"), "n_usuarios", "precision_novedad",
        "hit_rate_novedad", F.col("aciertos_nuevos_totales").alias("aciertos_nuevos"),
    )


def pooled_novelty_hit_rate(*args, **kwargs) -> DataFrame:
    """Users with a new hit over users with a new target, all segments together."""
    scored = block_two_scores(*args, **kwargs)
    n = F.col("n_con_objetivo_nuevo")
    return scored.agg(
        F.sum("aciertos_nuevos_totales").alias("aciertos_nuevos"),
        F.sum(n).alias("con_objetivo"),
        F.sum(F.round(F.col("hit_rate_novedad") * n)).cast("long").alias("con_acierto"),
    ).withColumn(
        "hit_rate_novedad",
        F.coalesce(safe_ratio(F.col("con_acierto"), F.col("con_objetivo")), F.lit(0.0)),
    )


def block_size_curve(
    suggestions: DataFrame, truth: DataFrame, segments: DataFrame,
    sizes: Sequence[int] = BLOCK_SIZES,
) -> DataFrame:
    """Quality of the suggestion block at each size, and of its last place."""
    hits = suggestions.join(
        truth.withColumn("hit", F.lit(1)), ["user_id", "product_id"], "left"
    )
    upto = lambda s: F.col("posicion") <= s
    aggs = []
    for s in sizes:
        aggs += [
            F.count(F.when(upto(s), 1)).alias(f"n_{s}"),
            F.count(F.when(upto(s), F.col("hit"))).alias(f"h_{s}"),
            F.count(F.when(F.col("posicion") == s, F.col("hit"))).alias(f"l_{s}"),
        ]
    per_user = hits.groupBy("user_id").agg(*aggs)
    users = truth.select("user_id").distinct().join(segments, "user_id").join(
        per_user, "user_id", "left"
    )
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(s).alias("tamano"),
                    *[F.coalesce(f"{x}_{s}", F.lit(0)).alias(x) for x in ("n", "h", "l")],
                )
                for s in sizes
            ]
        )
    )
    with_block = F.count(F.when(F.col("n") > 0, 1))
    total = F.count(F.lit(1))
    return (
        users.select("segmento", cells.alias("c"))
        .select("segmento", "c.*")
        .groupBy("segmento", "tamano")
        .agg(
            with_block.alias("usuarios_con_bloque"),
            safe_ratio(with_block, total).alias("pct_con_bloque"),
            F.avg(F.when(F.col("n") > 0, F.col("h").cast("double") / F.col("n"))).alias(
                "precision_bloque"
            ),
            safe_ratio(F.count(F.when(F.col("h") > 0, 1)), total).alias(
                "pct_usuarios_con_acierto"
            ),
            F.sum("h").alias("aciertos"),
            safe_ratio(F.sum("l"), with_block).alias("precision_ultimo_lugar"),
        )
    )


def stratified_sample(users: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """A proportional sample of users per segment, at least one each.

    `users` is (user_id, segmento). The quota of a segment is its share of n, rounded down.
    """
    keyed = users.withColumn("_key", md5_key(f"muestra:{seed}", "user_id"))
    placed = ordinal(
        keyed, ["segmento"], [md5_chunk(F.col("_key"))], [F.col("_key"), F.col("user_id")],
        rank="puesto", size="del_segmento",
    )
    total = users.agg(F.count(F.lit(1))).scalar()
    quota = F.greatest(
        F.lit(1), F.floor(F.lit(n) * F.col("del_segmento").cast("double") / F.col("_total"))
    )
    return placed.withColumn("_total", total).where(F.col("puesto") <= quota).select(
        "user_id", "segmento"
    )


# jobs that train models ------------------------------------------------------------------------


def rule_systems(valid: DataFrame, items: DataFrame, users: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    return {
        "popularidad": rankers.popularity_topk(items, users, k),
        "recompra_personal": rankers.repurchase_topk(valid, k),
        "heuristica": rankers.topk(valid, rankers.heuristic_score(), k),
    }


def compare_all(
    train: DataFrame, valid: DataFrame, items: DataFrame, truth: DataFrame,
    catalog_size: Column | int, k: int = 10, trees: int = models.N_TREES, params: dict | None = None,
    trained: dict[str, tuple] | None = None,
) -> DataFrame:
    """The five systems, simplest first, on the same users.

    `trained` may hold models that were trained on `train` before, by the names of their systems.
    """
    trained = trained or {}
    systems = rule_systems(valid, items, truth.select("user_id").distinct(), k)
    logistic, fill = trained.get("regresion_logistica") or models.train_logistic(train)
    systems["regresion_logistica"] = rankers.topk(
        models.score_logistic(logistic, fill, valid), "score", k
    )
    boosted, fill = trained.get("boosting") or models.train_boosting(train, trees, params)
    systems["boosting"] = rankers.topk(models.score_boosting(boosted, fill, valid), "score", k)
    return metrics.compare(systems, truth, k, "popularidad", catalog_size=catalog_size)


def seed_robustness(
    train: DataFrame, valid: DataFrame, truth: DataFrame, seeds: Sequence[int],
    ns: Sequence[int] = LIST_LENGTHS, trees: int = models.N_TREES, params: dict | None = None,
    keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
) -> DataFrame:
    """F1 of every list length under several seeds.

    The seeds differ in who decides when to stop and in the draws of the trees, not in the rows, so
    these are made once. `keep` may write them to a table, so that no training shuffles them again.
    """
    stop, columns = models.early_stop_splits(train, seeds)
    rows, fill = models.boosting_rows(train, held_out=stop, flags=tuple(columns.values()))
    rows = keep("filas_por_semilla", rows)
    lists = {}
    for seed in columns:  # one training job per seed
        own = rows.select("x", "etiqueta", F.col(columns[seed]).alias("es_freno"))
        model = models.fit_boosting(own, trees, params, seed=seed)
        lists[str(seed)] = rankers.topk(
            models.score_boosting(model, fill, valid), "score", max(ns)
        )
    cuts = [Cut(f"{seed}/{n}", seed, n) for seed in lists for n in ns]
    scored = metrics.score(metrics.stack(lists), truth, cuts)
    return scored.select(
        F.split("modelo", "/")[0].cast("int").alias("semilla"), F.col("k").alias("n"), "f1"
    )


def robustness_summary(by_seed: DataFrame) -> DataFrame:
    """Mean and deviation of F1 per list length, how often it wins, and the lead over the rest."""
    per_seed = Window.partitionBy("semilla")
    wins = by_seed.withColumn("_best", F.max("f1").over(per_seed))
    stats = wins.groupBy("n").agg(
        F.avg("f1").alias("media"),
        F.stddev_samp("f1").alias("desvio"),
        F.count(F.when(F.col("f1") == F.col("_best"), 1)).alias("semillas_ganadas"),
    )
    everyone = Window.partitionBy()  # one row per list length
    place = F.row_number().over(everyone.orderBy(F.desc("media"), "n"))
    return stats.select(
        "n", "media", "desvio", "semillas_ganadas",
        (F.max("media").over(everyone) - F.col("media")).alias("distancia_al_mejor"),
        F.max("desvio").over(everyone).alias("ruido"),
        (place == 1).alias("es_mejor"),
    )


def robustness_pivot(by_seed: DataFrame, ns: Sequence[int] = LIST_LENGTHS) -> DataFrame:
    """F1 with one row per seed and one column per list length."""
    wide = by_seed.groupBy("semilla").pivot("n", list(ns)).agg(F.first("f1"))
    return wide.withColumnsRenamed({str(n): f"f1_n{n}" for n in ns})


def learning_curve(
    train: DataFrame, valid: DataFrame, truth: DataFrame, fractions: Sequence[float] = FRACTIONS,
    k: int = 10, trees: int = models.N_TREES, params: dict | None = None,
    keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
) -> DataFrame:
    """Train on nested shares of the train users, score the same validation users.

    `keep` may write the rows of each training to a table, so that its passes don't shuffle them again.
    """
    samples = models.nested_user_sample(train, fractions)
    lists, sizes = {}, None
    for f in sorted(fractions):  # one training job per fraction
        users = samples.where(F.col("fraccion") == float(f)).select("user_id")
        part = train.join(users, "user_id", "left_semi")
        model, fill = models.train_boosting(
            part, trees, params, keep=lambda df, f=f: keep(f"filas_de_curva_{f}", df)
        )
        lists[str(f)] = rankers.topk(models.score_boosting(model, fill, valid), "score", k)
        size = part.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(
            F.lit(str(f)).alias("modelo"),
            F.count(F.lit(1)).alias("usuarios_entrenamiento"),
            F.sum("n").alias("filas_entrenamiento"),
        )
        sizes = size if sizes is None else sizes.unionByName(size)
    scored = metrics.score(metrics.stack(lists), truth, [Cut(m, m, k) for m in lists])
    by_size = Window.partitionBy().orderBy("fraccion")  # one row per fraction
    return scored.join(sizes, "modelo").select(
        F.col("modelo").cast("double").alias("fraccion"), "usuarios_entrenamiento",
        "filas_entrenamiento", "recall", "hit_rate", "precision",
    ).withColumn("paso_recall", F.col("recall") - F.lag("recall").over(by_size))


# Search ranges of the boosting parameters; those in LOG_SCALE are drawn by their logarithm.
SEARCH_SPACE = {
    "stepSize": (0.02, 0.15),
    "maxDepth": (5, 8),
    "minInstancesPerNode": (50, 500),
    "subsamplingRate": (0.6, 1.0),
    "featureSubsetStrategy": (0.5, 1.0),
}
LOG_SCALE = ("stepSize", "minInstancesPerNode")
TRIAL_SCHEMA = "peldano INT, intento INT, arboles INT, recall DOUBLE, parametros STRING"


def trial_params(trial: int, seed: int = SEED) -> dict:
    """Parameters of a trial. Trial 0 is the current setting, the others are drawn from the space."""
    if trial == 0:
        return dict(models.BOOSTING)
    draw = random.Random(f"{seed}:{trial}")
    out = {}
    for name, (low, high) in SEARCH_SPACE.items():
        if name in LOG_SCALE:
            value = math.exp(draw.uniform(math.log(low), math.log(high)))
        else:
            value = draw.uniform(low, high + 1 if isinstance(low, int) else high)
        out[name] = min(int(value), high) if isinstance(low, int) else value
    out["featureSubsetStrategy"] = f"{out['featureSubsetStrategy']:.4f}"
    return out


def rungs(trials: int, first_trees: int, max_trees: int) -> list[tuple[int, int]]:
    """(trials, trees) of each step: half of the trials and twice the trees, to the last one or the most trees."""
    out = [(trials, min(first_trees, max_trees))]
    while out[-1][0] > 1 and out[-1][1] < max_trees:
        out.append(((out[-1][0] + 1) // 2, min(2 * out[-1][1], max_trees)))
    return out


def search_params(
    train: DataFrame, targets: DataFrame, trials: int = 25, k: int = 10,
    first_trees: int = 10, max_trees: int = models.N_TREES, fixed: dict | None = None, seed: int = SEED,
    at_once: int = 4, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
) -> DataFrame:
    """Search by successive halving for the recall of held-out train users.

    All trials are fitted with few trees; the better half goes on with twice as many, and so on. Users of
    train are split into fit, stop and tune; every trial fits on the first two and is scored on the
    third. Validation users are never used. Up to `at_once` trials are fitted at the same time, which
    fills the cluster while single trees are small; `keep` may write the rows that they share to a table.

    One row per trial and step: peldano, intento, arboles, recall, parametros. `best_trial` chooses.
    """
    parts = models.three_way_split(train, seed)
    fit = train.join(parts.where("parte <> 'tuning'").select("user_id"), "user_id", "left_semi")
    tune = train.join(parts.where("parte = 'tuning'").select("user_id"), "user_id", "left_semi")
    tune = keep("busqueda_prueba", tune)
    stop = parts.select("user_id", (F.col("parte") == "freno").alias("es_freno"))
    truth = keep("busqueda_verdad", rankers.truth(targets, tune.select("user_id").distinct()))
    rows, fill = models.boosting_rows(fit, held_out=stop)
    rows = keep("busqueda_filas", rows)
    params = {t: {**trial_params(t, seed), **(fixed or {})} for t in range(trials)}
    alive, found = list(params), []
    spark = train.sparkSession
    for step, (n, trees) in enumerate(rungs(trials, first_trees, max_trees)):
        alive = alive[:n]

        def one(trial: int, trees: int = trees):
            return models.fit_boosting(rows, trees, params[trial])

        with ThreadPoolExecutor(at_once) as pool:
            # each thread takes the session's settings along
            fitted = list(pool.map(inheritable_thread_target(spark)(one), alive))
        lists = {
            f"{t:03d}": rankers.topk(models.score_boosting(m, fill, tune), "score", k) for t, m in zip(alive, fitted)
        }
        scored = metrics.score(metrics.stack(lists), truth, [Cut(m, m, k) for m in lists])
        recall = {int(r["modelo"]): r["recall"] for r in scored.select("modelo", "recall").collect()}
        found += [(step, t, trees, recall[t], json.dumps(params[t], sort_keys=True)) for t in alive]
        alive.sort(key=lambda t: (-recall[t], t))
    return spark.createDataFrame(found, TRIAL_SCHEMA)


def best_trial(trials: DataFrame) -> DataFrame:
    """The trials with `sigue`, whether one went on, and `es_mejor`, the best of the last step."""
    last = Window.partitionBy("intento")
    place = F.row_number().over(Window.partitionBy("peldano").orderBy(F.desc("recall"), "intento"))
    everything = Window.partitionBy()  # a few dozen rows
    return trials.withColumns(
        {
            "sigue": F.max("peldano").over(last) > F.col("peldano"),
            "es_mejor": (F.col("peldano") == F.max("peldano").over(everything)) & (place == 1),
        }
    )


def tuned_params(trials: DataFrame, spark: SparkSession, path: str) -> dict:
    """Save the parameters of the best trial where training looks for them (`store.load_params`)."""
    best = best_trial(trials).where("es_mejor").first()
    params = json.loads(best["parametros"])
    tried = trials.agg(F.count_distinct("intento")).first()[0]
    save_params(spark, path, params, recall=best["recall"], trees=best["arboles"], trials=tried)
    return params


def feature_ablation(
    train: DataFrame, valid: DataFrame, truth: DataFrame, base: Sequence[str] = MODEL_COLUMNS,
    extra: Sequence[str] = (), k: int = 10, trees: int = models.N_TREES, params: dict | None = None,
    catalog_size: Column | int = metrics.DEFAULT_CATALOG_SIZE,
    keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
) -> DataFrame:
    """The same model with and without the extra columns. `keep` is as in `learning_curve`."""
    lists = {}
    for name, columns in (("base", tuple(base)), ("con_nuevas", (*base, *extra))):
        model, fill = models.train_boosting(
            train, trees, params, columns, keep=lambda df, name=name: keep(f"filas_de_ablacion_{name}", df)
        )
        lists[name] = rankers.topk(
            models.score_boosting(model, fill, valid, columns), "score", k
        )
    return metrics.compare(lists, truth, k, "base", catalog_size=catalog_size)


def objective_comparison(
    train: DataFrame, valid: DataFrame, truth: DataFrame, k: int = 10,
    trees: int = models.N_TREES, params: dict | None = None,
    catalog_size: Column | int = metrics.DEFAULT_CATALOG_SIZE, boosted_ranker: tuple | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df, trained: tuple | None = None,
) -> DataFrame:
    """Row classifier against the rankers inside a user, the linear one and, if given trained, the boosted one.

    `keep` is as in `train_pairwise_ranker`. `trained` may hold the classifier, trained on `train` before.
    """
    model, fill = trained or models.train_boosting(train, trees, params)
    weights, fill_rank = models.train_pairwise_ranker(train, keep=keep)
    lists = {
        "clasificador": rankers.topk(models.score_boosting(model, fill, valid), "score", k),
        "ranker": rankers.topk(models.score_pairwise(weights, fill_rank, valid), "score", k),
    }
    if boosted_ranker:
        scored = rank_boosting.score_rank_boosting(*boosted_ranker, valid)
        lists["ranker_boosting"] = rankers.topk(scored, "score", k)
    return metrics.compare(lists, truth, k, "clasificador", catalog_size=catalog_size)
