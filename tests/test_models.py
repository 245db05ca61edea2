"""Learned rankers: exactness where it can be checked, and no leaks."""

import json

import duckdb
import harness
import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tillroll.operators import models, rankers
from tillroll.operators import rank_boosting as rb
from tillroll.operators.features import MODEL_COLUMNS, NULLABLE_COLUMNS, RECENT_COLUMNS
from tillroll.plans import experiments as ex
from tillroll.plans import oracle
from tillroll.plans.registry import REGISTRY, rounded
from tillroll.plans.workspace import Workspace, workspace

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ws(spark):
    return workspace(spark, SF_DIR)


def synthetic(spark, n_users=40, per_user=25, seed=4):
    """Rows whose label follows two columns inside each user, on top of a user-level offset."""
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(n_users):
        offset = rng.normal(0, 3)
        for p in range(per_user):
            x = {c: float(rng.normal()) for c in MODEL_COLUMNS}
            z = 1.5 * x["ratio_usuario_producto"] - x["recencia_relativa"]
            y = int(z + rng.normal(0, 0.5) > 0)
            x["freq_usuario_producto"] += offset
            for c in NULLABLE_COLUMNS:
                if rng.random() < 0.2:
                    x[c] = None
            rows.append((u, p, *[x[c] for c in MODEL_COLUMNS], y))
    schema = "user_id BIGINT, product_id INT, " + ", ".join(f"{c} DOUBLE" for c in MODEL_COLUMNS)
    return spark.createDataFrame(rows, schema + ", etiqueta INT")


def hit_share(df, scored):
    """Share of positives among each user's best five."""
    top = rankers.topk(scored, "score", 5)
    return top.join(df.select("user_id", "product_id", "etiqueta"), ["user_id", "product_id"]).agg(
        F.avg("etiqueta")
    ).first()[0]


def test_the_within_user_ranker_minimises_the_loss_over_all_pairs(spark):
    columns = ("ratio_usuario_producto", "recencia_relativa", "posicion_par")
    df = synthetic(spark, 12, 15)
    reg = 1e-6
    weights, _ = models.train_pairwise_ranker(df, columns, reg)
    pdf = df.toPandas()
    x, y = [], []
    for _, g in pdf.groupby("user_id"):
        v, t = g[list(columns)].to_numpy(), g["etiqueta"].to_numpy()
        for i in range(len(t)):
            for j in range(len(t)):
                x.append(v[i] - v[j])
                y.append(t[i] - t[j])
    want, *_ = np.linalg.lstsq(np.array(x), np.array(y, dtype=float), rcond=None)
    assert [weights[c] for c in columns] == pytest.approx(want, rel=1e-3)


def test_columns_that_are_constant_inside_users_get_no_weight(spark):
    df = synthetic(spark).withColumn("productos_distintos", F.col("user_id").cast("double"))
    weights, fill = models.train_pairwise_ranker(df)
    assert "productos_distintos" not in weights
    assert hit_share(df, models.score_pairwise(weights, fill, df)) > 0.9


def test_the_within_user_ranker_centres_its_rows_once(spark, tmp_path):
    df = synthetic(spark, 12, 15)
    kept = []

    def keep(rows):
        kept.append(rows)
        rows.write.parquet(f"{tmp_path}/centradas")
        return spark.read.parquet(f"{tmp_path}/centradas")

    weights, _ = models.train_pairwise_ranker(df, keep=keep)
    assert len(kept) == 1
    assert weights == pytest.approx(models.train_pairwise_ranker(df)[0], rel=1e-9)
    # a user is one row of sums when it meets its rows: nothing else than rows and users is shuffled
    assert kept[0]._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert kept[0].agg(*[F.round(F.sum(c), 6) for c in MODEL_COLUMNS]).first() == tuple([0.0] * len(MODEL_COLUMNS))


def test_models_learn_and_take_nulls(spark, tmp_path):
    df = synthetic(spark)
    logistic, fill = models.train_logistic(df, max_iter=50)
    assert hit_share(df, models.score_logistic(logistic, fill, df)) > 0.9
    top = [r["variable"] for r in models.logistic_weights(logistic).take(2)]
    assert set(top) == {"ratio_usuario_producto", "recencia_relativa"}
    boosted, fill = models.train_boosting(df, 5, {"maxDepth": 3, "minInstancesPerNode": 5})
    assert hit_share(df, models.score_boosting(boosted, fill, df)) > 0.8
    nodes = models.save_model(boosted, str(tmp_path / "model"))
    imp = models.feature_importance(models.tree_nodes(spark, nodes)).collect()
    names = models.design_columns()
    weights = boosted.stages[-1].featureImportances.toArray()
    assert {r["variable"]: r["pct_gain"] for r in imp} == pytest.approx(dict(zip(names, weights)))
    want = duckdb.sql(f"""
        SELECT nodeData.split.featureIndex, sum(nodeData.gain * nodeData.impurityStats[1]), count(*)
        FROM read_parquet('{nodes}/*.parquet') WHERE nodeData.split.featureIndex >= 0 GROUP BY 1""").fetchall()
    got = {r["variable"]: (r["gain"], r["split"]) for r in imp if r["split"]}
    assert {n: g[1] for n, g in got.items()} == {names[c]: n for c, _, n in want}
    assert {n: g[0] for n, g in got.items()} == pytest.approx({names[c]: g for c, g, _ in want})
    assert len(imp) == len(names)
    assert sum(r["pct_gain"] for r in imp) == pytest.approx(1)
    assert sum(r["pct_split"] for r in imp) == pytest.approx(1)
    assert imp[0]["variable"] in {"ratio_usuario_producto", "recencia_relativa"}


def test_the_logistic_model_scores_after_a_metric_was_observed(spark):
    df = synthetic(spark, 10, 10)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 100
    model, fill = models.train_logistic(df, max_iter=20)
    got = {(r["user_id"], r["product_id"]): r["score"] for r in models.score_logistic(model, fill, df).collect()}
    rows = PipelineModel(model.stages[:-1]).transform(models.design(df, fill)).select("user_id", "product_id", "z")
    want = {(r["user_id"], r["product_id"]): model.stages[-1].predictProbability(r["z"])[1] for r in rows.collect()}
    assert got == pytest.approx(want, rel=1e-9) and len(got) == 100


def test_no_training_user_is_validated(ws):
    both = ws.part("train").select("user_id").join(
        ws.part("valid").select("user_id"), "user_id", "left_semi"
    )
    assert both.count() == 0
    parts = models.three_way_split(ws.part("train"))
    assert parts.join(ws.valid_users, "user_id", "left_semi").count() == 0
    assert parts.groupBy("user_id").count().where("count > 1").count() == 0


def test_smaller_training_samples_are_contained_in_larger_ones(ws):
    got = {}
    for r in models.nested_user_sample(ws.part("train"), (0.25, 0.5, 1.0)).collect():
        got.setdefault(r["fraccion"], set()).add(r["user_id"])
    assert got[0.25] < got[0.5] < got[1.0]


def test_the_final_system_on_a_trained_ranking(spark, ws, monkeypatch):
    """The queries on the trained ranking against the SQL of those on the heuristic, given that ranking."""
    model, fill = models.train_boosting(ws.part("train"), 4, {"maxDepth": 4, "minInstancesPerNode": 20})
    trained = ws.with_ranking(lambda: rankers.topk(models.score_boosting(model, fill, ws.part("valid")), "score", 30))
    stored = trained.ranking
    assert sorted(stored.collect()) != sorted(ws.ranking.collect())
    path = trained.store.path("ranking", lambda: None)
    monkeypatch.setitem(oracle.CTES, "x_ranking", f"SELECT * FROM read_parquet('{path}/*.parquet')")
    monkeypatch.setattr(type(ws), "trained", trained)
    con = harness.database(SF_DIR)
    for name, base in {
        "a16_two_block_trained": "a16_two_block", "e3_sweep_n_trained": "e3_sweep_n",
        "e15_block_one_trained": "e15_block_one_report", "s11_export_trained": "s11_export_recommendations",
    }.items():
        query = REGISTRY[base]
        sql = oracle.sql(query.sql, query.floats, 9)
        assert "read_parquet" in sql
        assert harness.compare(rounded(REGISTRY[name].job(ws)), con, sql) == [], name
    assert trained.two_block.count() and ws.two_block.count()
    # what was counted while both were written
    assert trained.store.observed["dos_bloques"]["huella"] == trained.store.observed["ranking"]["huella"]
    assert trained.store.observed["ranking"]["huella"] != ws.store.observed["ranking"]["huella"]


def test_trainings_read_rows_that_were_made_once(spark, tmp_path):
    df = synthetic(spark, 20, 10).withColumns({c: F.lit(1.0) for c in RECENT_COLUMNS})
    truth = df.where("etiqueta = 1").select("user_id", "product_id")
    few = {"trees": 2, "params": {"maxDepth": 2, "minInstancesPerNode": 2}}
    stop, columns = models.early_stop_splits(df, (42, 7))
    for seed, column in columns.items():
        want = {(r["user_id"], r["es_freno"]) for r in models.early_stop_split(df, seed=seed).collect()}
        assert {(r["user_id"], r[column]) for r in stop.collect()} == want and len(want) == 20
    kept = {}

    def keep(name, rows):
        rows.write.parquet(str(tmp_path / name))  # fails if a name comes twice
        kept[name] = spark.read.parquet(str(tmp_path / name))
        return kept[name]

    seeds = ex.seed_robustness(df, df, truth, (42, 7), (3, 5), keep=keep, **few).collect()
    assert sorted((r["semilla"], r["n"]) for r in seeds) == [(7, 3), (7, 5), (42, 3), (42, 5)]
    curve = ex.learning_curve(df, df, truth, (0.5, 1.0), 5, keep=keep, **few).collect()
    ex.feature_ablation(df, df, truth, extra=RECENT_COLUMNS, k=5, keep=keep, **few).collect()
    sizes = {str(r["fraccion"]): r["filas_entrenamiento"] for r in curve}
    assert {n: rows.count() for n, rows in kept.items()} == {
        "filas_por_semilla": 200, "filas_de_ablacion_base": 200, "filas_de_ablacion_con_nuevas": 200,
        **{f"filas_de_curva_{f}": n for f, n in sizes.items()},
    } and sizes == {"0.5": 100, "1.0": 200}


@pytest.mark.parametrize("name, trainings", [
    ("e10_feature_ablation", 2), ("e11_objective_comparison", 1), ("e4_seed_by_length", 3), ("e6_learning_curve", 4),
])
def test_experiments_train_the_whole_model(spark, ws, monkeypatch, name, trainings):
    asked, real = [], models.fit_boosting

    def fit(rows, trees=models.N_TREES, params=None, *args, **how):
        asked.append((trees, {**models.BOOSTING, **(params or {})}))
        return real(rows, 2, {"maxDepth": 2, "minInstancesPerNode": 2}, *args, **how)

    monkeypatch.setattr(models, "fit_boosting", fit)
    ranker = rb.train_rank_boosting(synthetic(spark, 10, 10), trees=1, params={"maxDepth": 1})
    own = ws.with_ranking(None)  # what is made here stays here
    own.__dict__.pop("boosting", None)
    own.store, own.made = own.store.branch(["filas_de_ajuste", "f1_por_semilla"]), {"rank_boosting": ranker}
    REGISTRY[name].job(own)
    assert asked == [(600, models.BOOSTING)] * trainings


def test_search_starts_with_the_current_parameters():
    assert ex.trial_params(0) == models.BOOSTING
    assert ex.trial_params(1) == ex.trial_params(1) != ex.trial_params(2)
    drawn = [ex.trial_params(t) for t in range(1, 400)]
    for name, (low, high) in ex.SEARCH_SPACE.items():
        values = sorted(float(p[name]) for p in drawn)
        assert low <= values[0] <= low + (high - low) / 5 and high - (high - low) / 5 <= values[-1] <= high
        if name in ex.LOG_SCALE:  # half of the draws are below the geometric mean
            assert values[len(values) // 2] == pytest.approx((low * high) ** 0.5, rel=0.2)
    assert set(models.BOOSTING) == set(ex.SEARCH_SPACE)


def test_steps_of_the_search():
    assert ex.rungs(25, 10, 600) == [(25, 10), (13, 20), (7, 40), (4, 80), (2, 160), (1, 320)]
    assert ex.rungs(25, 4, 32) == [(25, 4), (13, 8), (7, 16), (4, 32)]
    assert ex.rungs(1, 4, 32) == [(1, 4)] and ex.rungs(9, 50, 20) == [(9, 20)]


def test_the_better_half_goes_on(spark, ws, tmp_path):
    kept = {}

    def keep(name, df):
        kept[name] = ws.store.table(f"prueba_{name}", lambda: df)
        return kept[name]

    trials = ex.search_params(
        ws.part("train"), ws.targets, trials=5, first_trees=1, max_trees=3, fixed={"maxDepth": 3}, keep=keep
    )
    trials = ws.store.table("prueba_intentos", lambda: trials)
    steps = {}
    for r in trials.collect():
        steps.setdefault(r["peldano"], {})[r["intento"]] = (-r["recall"], r["intento"])
        assert json.loads(r["parametros"])["maxDepth"] == 3 and r["arboles"] == [1, 2, 3][r["peldano"]]
    assert [len(steps[i]) for i in sorted(steps)] == [5, 3, 2] and set(kept) == {"busqueda_prueba", "busqueda_verdad", "busqueda_filas"}
    for a, b in ((0, 1), (1, 2)):
        assert set(steps[b]) == set(sorted(steps[a], key=steps[a].get)[: len(steps[b])])
    # the choice, by SQL over the written table
    path = ws.store.path("prueba_intentos", lambda: None)
    want = duckdb.sql(f"""
        SELECT peldano, intento, row_number() OVER (PARTITION BY peldano ORDER BY recall DESC, intento) = 1
                 AND peldano = max(peldano) OVER () AS es_mejor,
               max(peldano) OVER (PARTITION BY intento) > peldano AS sigue
        FROM read_parquet('{path}/*.parquet')""").fetchall()
    got = ex.best_trial(trials).select("peldano", "intento", "es_mejor", "sigue").collect()
    assert sorted(want) == sorted(tuple(r) for r in got)

    saved = str(tmp_path / "params")
    best = ex.tuned_params(trials, spark, saved)
    assert Workspace(spark, SF_DIR, params=saved).boosting_params() == (best, "tuned in 5 trials")
    assert Workspace(spark, SF_DIR, params=str(tmp_path / "none")).boosting_params() == (models.BOOSTING, "default")
    assert Workspace(spark, SF_DIR).boosting_params() == (models.BOOSTING, "default")
