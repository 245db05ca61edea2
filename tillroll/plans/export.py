"""Serving tables: recommendations in long form, headline numbers, lookups and example users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import top_per_group
from tillroll.operators.metrics import ALL
from tillroll.operators.recommend import POLICY, slots
from tillroll.sources.store import publish_atomic

# Name, format and explanation of the headline numbers.
KPIS = (
    ("Hit Rate", "hit_rate", "porcentaje", "users with at least one hit"),
    ("Recall", "recall", "decimal", "share of the next basket that was captured"),
    ("Precision", "precision", "decimal", "share of the shown items that were bought"),
    ("Cobertura", "cobertura", "porcentaje", "share of the catalogue that is ever shown"),
    ("Hit Rate en novedad", "hit_rate_novedad", "porcentaje", "users with a new target and a new hit"),
    ("Aciertos de descubrimiento", "aciertos_nuevos", "entero", "new items that were bought"),
    ("Usuarios evaluados", "n_usuarios", "entero", "users of the evaluation"),
)


def export_recommendations(
    recs: DataFrame, truth: DataFrame, segments: DataFrame, catalog: DataFrame,
    users: DataFrame | None = None,
) -> DataFrame:
    """One row per recommended item with its segment, names and hit flag."""
    if users is not None:
        recs = recs.join(users.select("user_id"), "user_id", "left_semi")
    hits = truth.withColumn("hit", F.lit(True))
    return (
        recs.join(hits, ["user_id", "product_id"], "left")
        .join(segments, "user_id", "left")
        .join(catalog.select("product_id", "product_name", "aisle"), "product_id", "left")
        .select(
            "user_id",
            F.coalesce("segmento", F.lit("")).alias("segmento"),
            "bloque",
            "posicion",
            "product_id",
            F.coalesce("hit", F.lit(False)).alias("acerto"),
            "product_name",
            "aisle",
        )
    )


def export_kpis(block_one: DataFrame, pooled: DataFrame) -> DataFrame:
    """Headline numbers as rows of (metrica, valor, formato, descripcion)."""
    one = block_one.where(F.col("segmento") == ALL).select(
        F.struct("hit_rate", "recall", "precision", "cobertura", "n_usuarios")
    ).scalar()
    values = pooled.withColumn("_one", one).select(
        "_one.*", "hit_rate_novedad", "aciertos_nuevos"
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("metrica"),
                F.col(col).cast("double").alias("valor"),
                F.lit(fmt).alias("formato"),
                F.lit(text).alias("descripcion"),
            )
            for name, col, fmt, text in KPIS
        ]
    )
    return values.select(F.explode(rows).alias("r")).select("r.*")


def export_kpis_by_segment(block_one: DataFrame, block_two: DataFrame) -> DataFrame:
    two = block_two.select("segmento", "hit_rate_novedad", "aciertos_nuevos")
    return (
        block_one.where(F.col("segmento") != ALL)
        .join(two, "segmento", "left")
        .select(
            "segmento",
            "n_usuarios",
            "hit_rate",
            "recall",
            F.coalesce("hit_rate_novedad", F.lit(0.0)).alias("hit_rate_novedad"),
            F.coalesce("aciertos_nuevos", F.lit(0)).alias("aciertos_novedad"),
            slots(POLICY).alias("lugares_de_sugerencia"),
        )
    )


USERS_PER_ROW_GROUP = 100_000


def publish_lookup(exported: DataFrame, path: str, keep: int = 2) -> DataFrame:
    """The export as a table for lookups of single users: sorted by user, with a bloom filter per row group."""
    return publish_atomic(
        exported, path, keep=keep, order_by=["user_id", "bloque", "posicion"],
        lookup={"user_id": USERS_PER_ROW_GROUP},
    )


def lookup_recommendations(exported: DataFrame, user_id: int | Column) -> DataFrame:
    """One user's rows: suggestions first, then the main block, by position."""
    return exported.where(F.col("user_id") == user_id).orderBy(F.desc("bloque"), "posicion").select(
        "segmento", "bloque", "posicion", "product_id", "product_name", "aisle", "acerto"
    )


def showcase_users(exported: DataFrame) -> DataFrame:
    """Example users per segment with varied results; `es_default` marks the first one to show.

    Per segment: the two best with a new hit, the two best, two middling ones and a weak one.
    """
    hit = lambda b: F.count(F.when((F.col("bloque") == b) & F.col("acerto"), 1))
    users = exported.groupBy("user_id").agg(
        F.max("segmento").alias("segmento"),
        hit("principal").alias("aciertos"),
        hit("sugerencia").alias("aciertos_nuevos"),
    )
    best = [F.desc("aciertos"), F.col("user_id")]
    by_id = [F.col("user_id")]
    picks = (
        (users.where("aciertos_nuevos > 0"), best, 2),
        (users, best, 2),
        (users.where("aciertos BETWEEN 4 AND 7"), by_id, 2),
        (users.where("aciertos <= 2"), by_id, 1),
    )
    chosen = None
    for rows, order, n in picks:
        part = top_per_group(rows, ["segmento"], order, n, "_place").drop("_place")
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.distinct()  # at most 7 per segment
    wow = chosen.where("aciertos_nuevos > 0").agg(
        F.max_by("user_id", F.struct(F.col("aciertos"), -F.col("user_id")))
    ).scalar()
    fallback = chosen.agg(F.min("user_id")).scalar()
    return chosen.withColumn(
        "es_default", F.col("user_id") == F.coalesce(wow, fallback)
    )
