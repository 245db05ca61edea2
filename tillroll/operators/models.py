"""Learned rankers on pyspark.ml: logistic regression, boosted trees and a within-user ranker."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.functions import safe_ratio
from tillroll.operators import boosting
from tillroll.operators.features import (
    MODEL_COLUMNS,
    NULLABLE_COLUMNS,
    SEED,
    impute_with_indicator,
    medians,
    shuffled_position,
)

# Boosting defaults. A tree of depth 6 has up to 64 leaves; `featureSubsetStrategy` is the
# share of columns that a split may choose from.
BOOSTING = {
    "stepSize": 0.05, "maxDepth": 6, "minInstancesPerNode": 200, "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
}
N_TREES = 600
# The vector columns take no NULLs. A user with one prior order has no median gap either.
IMPUTED_COLUMNS = (*NULLABLE_COLUMNS, "mediana_dias_entre_ordenes_historicas")
STOP_SHARE = 0.10
STOP_TOL = 1e-4


def design_columns(columns: Sequence[str] = MODEL_COLUMNS) -> list[str]:
    """Model columns and the flags of imputed values."""
    flags = [f"{c}_imputado" for c in IMPUTED_COLUMNS if c in columns]
    return [*columns, *flags]


def early_stop_split(
    train: DataFrame, share: float = STOP_SHARE, seed: int = SEED
) -> DataFrame:
    """Users of train with `es_freno`: the held-out part decides when to stop adding trees."""
    users = shuffled_position(train.select("user_id").distinct(), f"freno:{seed}")
    cut = F.floor(F.col("n_users") * F.lit(1 - share))
    return users.select("user_id", (F.col("puesto") > cut).alias("es_freno"))


def early_stop_splits(train: DataFrame, seeds: Sequence[int]) -> tuple[DataFrame, dict[int, str]]:
    """The early-stop splits of several seeds side by side, and the column of each seed."""
    columns = {seed: f"es_freno_{i}" for i, seed in enumerate(seeds)}
    out = None
    for seed, column in columns.items():
        split = early_stop_split(train, seed=seed).withColumnRenamed("es_freno", column)
        out = split if out is None else out.join(split, "user_id")
    return out, columns


def three_way_split(train: DataFrame, seed: int = SEED) -> DataFrame:
    """Users of train into fit (80 %), stop (10 %) and tune (10 %)."""
    users = shuffled_position(train.select("user_id").distinct(), f"tres:{seed}")
    place, n = F.col("puesto"), F.col("n_users")
    return users.select(
        "user_id",
        F.when(place <= F.floor(n * 0.8), "ajuste")
        .when(place <= F.floor(n * 0.9), "freno")
        .otherwise("tuning")
        .alias("parte"),
    )


def nested_user_sample(
    train: DataFrame, fractions: Sequence[float], seed: int = SEED
) -> DataFrame:
    """Users of each training fraction. A smaller fraction is contained in every larger one."""
    users = shuffled_position(train.select("user_id").distinct(), f"curva:{seed}")
    return users.withColumn(
        "fraccion", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    ).where(
        (F.col("fraccion") >= 1.0) | (F.col("puesto") <= F.floor(F.col("n_users") * F.col("fraccion")))
    ).select("fraccion", "user_id")


def train_medians(train: DataFrame) -> dict[str, float]:
    """Median per imputed column: a handful of numbers that every pass over the data needs."""
    return {r["variable"]: r["mediana"] for r in medians(train, IMPUTED_COLUMNS).collect()}


def design(df: DataFrame, fill: dict[str, float], columns: Sequence[str] = MODEL_COLUMNS) -> DataFrame:
    """Imputed numeric columns ready for an assembler."""
    nullable = [c for c in IMPUTED_COLUMNS if c in columns]
    filled = impute_with_indicator(df, fill, nullable)
    return filled.withColumns({c: F.col(c).cast("double") for c in design_columns(columns)})


def spread(rows: DataFrame) -> DataFrame:
    """Rows in as many even partitions as the cluster can work on.

    Training makes many passes, so the input must not stay in the few partitions an adaptive join
    leaves. Hashing the pair also spreads a user with very many rows.
    """
    spark = rows.sparkSession
    n = max(
        spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )
    return rows.repartition(n, "user_id", "product_id")


def _assembler(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=design_columns(columns), outputCol="x")


def _scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).select(
        "user_id", "product_id", vector_to_array("probability")[1].alias("score")
    )


def standardize(train: DataFrame, df: DataFrame, columns: Sequence[str] = MODEL_COLUMNS) -> DataFrame:
    """z-scores with the mean and deviation of train."""
    fill = train_medians(train)
    steps = Pipeline(
        stages=[
            _assembler(columns),
            StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True),
        ]
    ).fit(design(train, fill, columns))
    return steps.transform(design(df, fill, columns)).select("user_id", "product_id", "z")


def train_logistic(
    train: DataFrame, columns: Sequence[str] = MODEL_COLUMNS, c: float = 1.0, max_iter: int = 1000
) -> tuple[PipelineModel, dict[str, float]]:
    """L2 logistic regression on z-scores. Returns the model and the medians it imputes with.

    A penalty of strength C on the summed loss is 1 / (C n) on the mean loss.
    """
    fill = train_medians(train)
    rows = spread(design(train, fill, columns))
    n = train.count()
    steps = Pipeline(
        stages=[
            _assembler(columns),
            StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True),
            LogisticRegression(
                featuresCol="z", labelCol="etiqueta", regParam=1.0 / (c * n), elasticNetParam=0.0,
                standardization=False, maxIter=max_iter,
            ),
        ]
    )
    return steps.fit(rows), fill


def score_logistic(
    model: PipelineModel, fill: dict[str, float], df: DataFrame, columns: Sequence[str] = MODEL_COLUMNS
) -> DataFrame:
    """user_id, product_id and score, the probability of label 1.

    Only the coefficients go to the tasks: a freshly fitted logistic model holds the summary of its training
    and with it the session, which can't be sent once the session has observed a metric.
    """
    fitted = model.stages[-1]
    z = PipelineModel(model.stages[:-1]).transform(design(df, fill, columns)).select(
        "user_id", "product_id", vector_to_array("z").alias("z")
    )
    margin = sum(
        (F.lit(float(w)) * F.col("z")[i] for i, w in enumerate(fitted.coefficients.toArray())),
        F.lit(float(fitted.intercept)),
    )
    return z.select("user_id", "product_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).alias("score"))


def logistic_weights(model: PipelineModel, columns: Sequence[str] = MODEL_COLUMNS) -> DataFrame:
    """Coefficient per column, largest first. One row per model column."""
    values = model.stages[-1].coefficients.toArray().tolist()
    rows = [(n, float(v), abs(float(v))) for n, v in zip(design_columns(columns), values)]
    return SparkSession.getActiveSession().createDataFrame(
        rows, "variable STRING, peso DOUBLE, magnitud DOUBLE"
    ).orderBy(F.desc("magnitud"), "variable")


def boosting_rows(
    train: DataFrame,
    columns: Sequence[str] = MODEL_COLUMNS,
    seed: int = SEED,
    held_out: DataFrame | None = None,
    flags: Sequence[str] = ("es_freno",),
) -> tuple[DataFrame, dict[str, float]]:
    """The rows that boosting fits on (x, etiqueta, es_freno), and the medians they were imputed with.

    A caller that fits several times writes them to a table first, so that they are made once; `flags`
    are the columns of `held_out` that it needs then.
    """
    fill = train_medians(train)
    stop = early_stop_split(train, seed=seed) if held_out is None else held_out
    rows = spread(design(train, fill, columns).join(stop, "user_id"))
    return _assembler(columns).transform(rows).select("x", "etiqueta", *flags), fill


def fit_boosting(
    rows: DataFrame,
    trees: int = N_TREES,
    params: dict | None = None,
    columns: Sequence[str] = MODEL_COLUMNS,
    seed: int = SEED,
) -> PipelineModel:
    """Boosted trees that stop when the rows marked es_freno stop improving."""
    fitted = boosting.fit(rows, trees, seed, STOP_TOL, **{**BOOSTING, **(params or {})})
    return PipelineModel([_assembler(columns), fitted])


def train_boosting(
    train: DataFrame,
    trees: int = N_TREES,
    params: dict | None = None,
    columns: Sequence[str] = MODEL_COLUMNS,
    seed: int = SEED,
    held_out: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[PipelineModel, dict[str, float]]:
    """Boosted trees that stop when held-out train users stop improving.

    `held_out` is (user_id, es_freno); by default 10 % of the train users. `keep` may write the rows to
    a table, so that the passes of the training read them and not what they come from.
    """
    rows, fill = boosting_rows(train, columns, seed, held_out)
    return fit_boosting(keep(rows), trees, params, columns, seed), fill


def score_boosting(
    model: PipelineModel, fill: dict[str, float], df: DataFrame, columns: Sequence[str] = MODEL_COLUMNS
) -> DataFrame:
    return _scored(model, design(df, fill, columns))


def save_model(model: PipelineModel, path: str) -> str:
    """Save the trees of a boosted model; returns where their nodes lie as a table."""
    model.stages[-1].save(path)
    return f"{path}/data"


def tree_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a saved model: arbol, nodo, columna (-1 in a leaf), ganancia, filas.

    `filas` is the weight of the rows that reached the node, `ganancia` what its split gains per row.
    """
    return spark.read.parquet(path).select(
        F.col("treeID").alias("arbol"),
        F.col("nodeData.id").alias("nodo"),
        F.col("nodeData.split.featureIndex").alias("columna"),
        F.col("nodeData.gain").alias("ganancia"),
        F.col("nodeData.impurityStats")[0].alias("filas"),
    )


def feature_importance(nodes: DataFrame, columns: Sequence[str] = MODEL_COLUMNS) -> DataFrame:
    """Gain and number of splits per column, each with its share. One row per model column."""
    names = [(i, n) for i, n in enumerate(design_columns(columns))]
    used = nodes.where("columna >= 0").groupBy("columna").agg(
        F.sum(F.col("ganancia") * F.col("filas")).alias("gain"), F.count(F.lit(1)).cast("int").alias("split")
    )
    everything = Window.partitionBy()  # one row per model column
    rows = nodes.sparkSession.createDataFrame(names, "columna INT, variable STRING").join(used, "columna", "left")
    rows = rows.fillna(0, ["gain", "split"])
    share = lambda c: F.coalesce(safe_ratio(F.col(c), F.sum(c).over(everything)), F.lit(0.0))
    return rows.select(
        "variable", "gain", "split", share("gain").alias("pct_gain"), share("split").alias("pct_split")
    ).orderBy(F.desc("gain"), "variable")


def train_pairwise_ranker(
    train: DataFrame, columns: Sequence[str] = MODEL_COLUMNS, reg: float = 1e-3,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[dict[str, float], dict[str, float]]:
    """A linear ranker of the order inside each user.

    The squared loss over all pairs of a user's rows, (y_i - y_j - w(x_i - x_j))^2, equals m times
    the squared loss of the rows centred on the user's mean, m being the user's row count. So the
    pairs need not be formed: centre, weight by m, fit a regression without intercept. The cost is
    linear in the rows, and a user with very many rows is no hot spot. `keep` may write the centred rows
    to a table, so that no pass of the training shuffles them again.
    """
    fill = train_medians(train)
    names = design_columns(columns)
    rows = design(train, fill, columns).withColumn("etiqueta", F.col("etiqueta").cast("double"))
    totals = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).cast("double").alias("peso"), *[F.sum(c).alias(f"_s_{c}") for c in [*names, "etiqueta"]]
    )
    # rows and users meet once, and as they are stored; the passes of the training read what comes of it
    met = design(train.join(totals, "user_id"), fill, columns)
    centred = keep(met.select(
        "peso", *[(F.col(c) - F.col(f"_s_{c}") / F.col("peso")).alias(c) for c in [*names, "etiqueta"]]
    ))
    # a column that is the same for all rows of a user says nothing about their order
    deviation = centred.agg(*[F.stddev_pop(c).alias(c) for c in names]).first().asDict()
    largest = rows.agg(*[F.max(F.abs(c)).alias(c) for c in names]).first().asDict()
    used = [c for c in names if (deviation[c] or 0.0) > 1e-9 * max(largest[c] or 0.0, 1e-9)]
    scaled = centred.select(
        "peso", "etiqueta", *[(F.col(c) / F.lit(deviation[c])).alias(c) for c in used]
    )
    fitted = Pipeline(
        stages=[
            VectorAssembler(inputCols=used, outputCol="x"),
            LinearRegression(
                featuresCol="x", labelCol="etiqueta", weightCol="peso", fitIntercept=False,
                standardization=False, regParam=reg, elasticNetParam=0.0, solver="normal",
            ),
        ]
    ).fit(scaled)
    weights = fitted.stages[-1].coefficients.toArray().tolist()
    return {c: w / deviation[c] for c, w in zip(used, weights)}, fill


def score_pairwise(
    weights: dict[str, float], fill: dict[str, float], df: DataFrame,
    columns: Sequence[str] = MODEL_COLUMNS,
) -> DataFrame:
    total = sum((F.lit(float(w)) * F.col(c) for c, w in weights.items()), F.lit(0.0))
    return design(df, fill, columns).select("user_id", "product_id", total.alias("score"))
