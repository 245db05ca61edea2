"""The two-block recommender and its variants that mix new items into the main list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import top_per_group

K = 10
# New-item places per segment, and the policies that were compared with it.
POLICY = {"nuevo": 5, "medio": 2, "heavy": 1}
POLICIES = {
    "sin novedad": {},
    "1 lugar a todos": {"nuevo": 1, "medio": 1, "heavy": 1},
    "2 nuevo / 1 medio / 0 heavy": {"nuevo": 2, "medio": 1, "heavy": 0},
    "3 nuevo / 1 medio / 0 heavy": {"nuevo": 3, "medio": 1, "heavy": 0},
}


def slots(policy: dict[str, int], segment: Column | None = None) -> Column:
    """Places of a segment under a policy; an unknown segment gets none."""
    col = F.col("segmento") if segment is None else segment
    out = F.lit(None).cast("int")
    for name, n in policy.items():
        out = F.when(col == name, F.lit(n)).otherwise(out)
    return F.coalesce(out, F.lit(0))


def novelty_suggestions(history: DataFrame, rules: DataFrame, n: int) -> DataFrame:
    """Up to n items per user that the rules suggest and the user never bought.

    An item scores the highest confidence of any rule that fires it. Fired rules and history meet
    in one (user, item) aggregate: it takes the maximum and drops bought items together. Rules per
    antecedent are few (`rule_index`), and Spark splits a hot antecedent when it joins.
    """
    fired = history.select("user_id", F.col("product_id").alias("antecedente")).join(
        rules.select("antecedente", "product_id", "confianza"), "antecedente"
    )
    rows = fired.select(
        "user_id", "product_id", "confianza", F.lit(0).alias("bought")
    ).unionByName(
        history.select(
            "user_id", "product_id", F.lit(None).cast("double").alias("confianza"),
            F.lit(1).alias("bought"),
        )
    )
    open_ = (
        rows.groupBy("user_id", "product_id")
        .agg(F.max("confianza").alias("confianza"), F.max("bought").alias("bought"))
        .where((F.col("bought") == 0) & (F.col("confianza") > 0))
    )
    return top_per_group(
        open_, ["user_id"], [F.desc("confianza"), F.col("product_id")], max(n, 0), "posicion"
    ).select("user_id", "product_id", "confianza", "posicion")


def two_block(
    ranking: DataFrame,
    history: DataFrame,
    segments: DataFrame,
    rules: DataFrame,
    k: int = K,
    policy: dict[str, int] | None = None,
) -> DataFrame:
    """Main block: the ranking's first k, untouched. Suggestions: as many as the segment allows.

    Either block may be short. Suggestions are only made for users of the ranking.
    """
    policy = POLICY if policy is None else policy
    main = ranking.where(F.col("rank") <= k).select(
        "user_id", F.lit("principal").alias("bloque"), F.col("rank").cast("int").alias("posicion"),
        "product_id",
    )
    users = ranking.select("user_id").distinct()
    allowed = users.join(segments, "user_id", "left").select(
        "user_id", slots(policy).alias("n")
    ).where("n > 0")
    most = max(policy.values(), default=0)
    served = history.join(allowed.select("user_id"), "user_id", "left_semi")
    extra = (
        novelty_suggestions(served, rules, most)
        .join(allowed, "user_id")
        .where("posicion <= n")
        .select(
            "user_id", F.lit("sugerencia").alias("bloque"),
            F.col("posicion").cast("int").alias("posicion"), "product_id",
        )
    )
    return main.unionByName(extra)


def only_block(recs: DataFrame, block: str) -> DataFrame:
    return recs.where(F.col("bloque") == block).select(
        "user_id", "product_id", F.col("posicion").alias("rank")
    )


def hybrid_topk(
    ranking: DataFrame,
    suggestions: DataFrame,
    places: dict[str, Column],
    segments: DataFrame | None = None,
    k: int = K,
) -> DataFrame:
    """Give the last places of the list to new items, for several place counts at once.

    `places` maps a label to the number of places, a constant or an expression over `segmento`.
    A user keeps the full ranking where there is nothing new to show.
    """
    users = ranking.where(F.col("rank") <= k).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_ranked")
    )
    available = suggestions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_available"))
    users = users.join(available, "user_id", "left")
    if segments is not None:
        users = users.join(segments, "user_id", "left")
    options = F.explode(
        F.array(
            *[F.struct(F.lit(m).alias("modelo"), c.cast("int").alias("places")) for m, c in places.items()]
        )
    )
    n_new = F.least(F.greatest(F.col("o.places"), F.lit(0)), F.coalesce("n_available", F.lit(0)))
    plan = users.select("user_id", "n_ranked", "n_available", options.alias("o")).select(
        "user_id",
        "o.modelo",
        n_new.alias("n_new"),
        F.least(F.col("n_ranked"), F.lit(k) - n_new).alias("kept"),
    )
    kept = ranking.join(plan, "user_id").where("rank <= kept").select(
        "modelo", "user_id", "product_id", F.col("rank").cast("long").alias("rank"),
        F.lit(0).alias("es_nuevo"),
    )
    new = suggestions.join(plan, "user_id").where("posicion <= n_new").select(
        "modelo", "user_id", "product_id",
        (F.col("kept") + F.col("posicion")).cast("long").alias("rank"),
        F.lit(1).alias("es_nuevo"),
    )
    return kept.unionByName(new)


def baseline_plus_fill(
    baseline: DataFrame, candidates: DataFrame, users: DataFrame, k: int = K
) -> DataFrame:
    """The baseline's list; free places go to the user's new candidates in rank order."""
    filled = baseline.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    free = users.join(filled, "user_id", "left").select(
        "user_id", F.coalesce("n", F.lit(0)).alias("n")
    ).where(F.col("n") < k)
    # at most k candidates can be needed, so the first k per user are enough
    first = top_per_group(
        candidates.select("user_id", "product_id", "candidate_rank"),
        ["user_id"], [F.col("candidate_rank"), F.col("product_id")], k, "pos",
    )
    fill = first.join(free, "user_id").where(F.col("pos") <= F.lit(k) - F.col("n")).select(
        "user_id", "product_id", (F.col("n") + F.col("pos")).cast("long").alias("rank")
    )
    return baseline.select(
        "user_id", "product_id", F.col("rank").cast("long").alias("rank")
    ).unionByName(fill)


def two_block_gate(recs: DataFrame, ranking: DataFrame, k: int = K) -> DataFrame:
    """Users whose main block is not the ranking's first k. Must be zero."""
    main = only_block(recs, "principal").select(
        "user_id", "rank", F.col("product_id").alias("shown")
    )
    wanted = ranking.where(F.col("rank") <= k).select(
        "user_id", "rank", F.col("product_id").alias("wanted")
    )
    users = (
        main.join(wanted, ["user_id", "rank"], "full")
        .groupBy("user_id")
        .agg(F.count(F.when(~F.col("shown").eqNullSafe(F.col("wanted")), 1)).alias("bad"))
    )
    return users.agg(
        F.count(F.lit(1)).alias("usuarios"),
        F.count(F.when(F.col("bad") > 0, 1)).alias("usuarios_distintos"),
    )
