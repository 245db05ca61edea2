"""Boosting for the order inside a user: gradients against all pairs, and what it learns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import hit_share, synthetic

from tillroll.operators import models
from tillroll.operators import rank_boosting as rb
from tillroll.operators.features import MODEL_COLUMNS

SCHEMA = "user_id BIGINT, product_id INT, etiqueta INT, score DOUBLE, extra STRING"


def all_pairs(rows):
    """(user, item) -> place and summed loss of its pairs, by forming them."""
    out, users = {}, {}
    for u, p, y, s, _ in rows:
        if y is not None and s is not None:
            users.setdefault(u, []).append((-s, p, y))
    for u, items in users.items():
        items.sort()
        n = sum(y for *_, y in items)
        if not 0 < n < len(items):
            continue
        ideal = sum(1 / math.log2(1 + r) for r in range(1, n + 1))
        for i, (si, p, y) in enumerate(items, 1):
            loss = 0.0
            for j, (sj, _, z) in enumerate(items, 1):
                if y != z:
                    swap = abs(1 / math.log2(1 + i) - 1 / math.log2(1 + j)) / ideal
                    good, bad = (-si, -sj) if y else (-sj, -si)
                    loss += swap * math.exp(bad - good)
            out[u, p] = (i, loss)
    return out


def test_weights_equal_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(rb, "CHUNK", 7)  # running sums cross chunks
    rng = np.random.default_rng(3)
    rows = []
    for u in range(1, 25):
        n = 150 if u == 1 else int(rng.integers(1, 20))
        for p in rng.permutation(200)[:n]:
            score = float(np.round(rng.normal(0, 2), 1)) if u % 3 else 0.0  # many equal scores
            rows.append((u, int(p), int(rng.random() < 0.3), score, "x"))
    rows += [(90, 1, 1, 0.0, "x"), (90, 2, 1, 1.0, "x"), (91, 1, 0, 0.0, "x"), (92, 1, None, 0.0, "x")]
    rows += [(1, 900, None, 5.0, "x"), (1, 901, 1, None, "x")]
    got = rb.pair_weights(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = all_pairs(rows)
    assert {(r["user_id"], r["product_id"]): r["posicion"] for r in got} == {k: v[0] for k, v in want.items()}
    assert {(r["user_id"], r["product_id"]): r["peso"] for r in got} == pytest.approx(
        {k: v[1] for k, v in want.items()}, rel=1e-9, abs=1e-12
    )
    assert {r["extra"] for r in got} == {"x"} and len(want) > 200
    assert rb.pair_weights(spark.createDataFrame([], SCHEMA)).collect() == []


def test_only_crowded_users_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(rb, "CHUNK", 7)
    rng = np.random.default_rng(5)
    rows = [
        (u, p, int(rng.random() < 0.3), float(np.round(rng.normal(0, 2), 1)), "x")
        for u in range(1, 9) for p in range(60 if u < 3 else 12)
    ]
    df = spark.createDataFrame([*rows, (None, 1, 1, 0.5, "x"), (3, None, 1, 0.5, "x")], SCHEMA)
    crowded = rb.crowded_users(df, 59)
    assert sorted(r["user_id"] for r in crowded.collect()) == [1, 2]
    want = all_pairs(rows)
    for some in (crowded, rb.crowded_users(df, 1000), rb.crowded_users(df, 1)):
        got = rb.pair_weights(df, some).collect()
        assert {(r["user_id"], r["product_id"]): r["posicion"] for r in got} == {k: v[0] for k, v in want.items()}
        assert {(r["user_id"], r["product_id"]): r["peso"] for r in got} == pytest.approx(
            {k: v[1] for k, v in want.items()}, rel=1e-9, abs=1e-12
        )
    # without crowded users the rows are moved once
    none = spark.createDataFrame([], "user_id BIGINT")
    moved = rb.pair_weights(df, none)
    moved.collect()
    plan = moved._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("hashpartitioning") <= 2


def test_it_finds_an_order_that_no_line_gives(spark, tmp_path):
    """Labels follow the size of a column, whatever its sign: a linear ranker sees nothing of it."""
    df = synthetic(spark).withColumn("etiqueta", (F.abs("recencia_relativa") > 1.0).cast("int"))
    df = df.fillna(0.0, ["recencia_relativa"]).cache()

    def keep(name, rows):
        rows.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    fitted, fill = rb.train_rank_boosting(df, trees=4, params={"maxDepth": 3, "minInstancesPerNode": 5}, keep=keep)
    boosted = hit_share(df, rb.score_rank_boosting(fitted, fill, df))
    linear = hit_share(df, models.score_pairwise(*models.train_pairwise_ranker(df), df))
    assert len(fitted) == 4 and boosted > 0.9 > linear + 0.2
    # the score that training carries along is the one that scoring gives, but for the last tree
    last = spark.read.parquet(f"{tmp_path}/orden_3").select("user_id", "product_id", F.col("score").alias("carried"))
    both = rb.score_rank_boosting(fitted[:3], fill, df, MODEL_COLUMNS).join(last, ["user_id", "product_id"])
    assert both.where("abs(score - carried) > 1e-9").count() == 0 and both.count() == df.count()
