"""Building blocks against plain Python on the same rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.functions import is_variant, name_tokens, ordinal, segment, top_per_group
from tillroll.functions.columns import GENERIC_WORDS
from tillroll.functions.prefix import md5_chunk
from tillroll.operators.features import quantiles, shuffled_position
from tillroll.operators.rules import pair_counts


@pytest.mark.parametrize("chunk", ["1", "floor(v / 7)", "v"])
def test_ordinal_matches_a_plain_sort(spark, chunk):
    rng = random.Random(3)
    rows = [(rng.choice("aaaab"), rng.randint(0, 40), i, rng.randint(1, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g STRING, v INT, id INT, x INT")
    got = ordinal(
        df, ["g"], [F.expr(chunk)], [F.col("v"), F.col("id")], "pos", "size", {"run": "x"}
    ).collect()
    for g in "ab":
        run = 0
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        by_id = {r["id"]: r for r in got if r["g"] == g}
        assert len(by_id) == len(mine)
        for pos, (_, _, i, x) in enumerate(mine, 1):
            run += x
            assert (by_id[i]["pos"], by_id[i]["size"], by_id[i]["run"]) == (pos, len(mine), run)


def test_ordinal_over_all_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = ordinal(df, [], [F.floor(F.col("v") / 64)], [F.col("v")], "pos").collect()
    assert all(r["pos"] == r["v"] + 1 for r in got)


def test_shuffled_positions_are_a_permutation(spark):
    got = shuffled_position(spark.range(3000).withColumnRenamed("id", "user_id"), 1).collect()
    assert sorted(r["puesto"] for r in got) == list(range(1, 3001))
    again = shuffled_position(spark.range(3000).withColumnRenamed("id", "user_id"), 2).collect()
    assert {r["user_id"]: r["puesto"] for r in got} != {r["user_id"]: r["puesto"] for r in again}


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    data = {
        "ints": rng.integers(0, 30, 501).astype(float),
        "floats": rng.normal(0, 100, 700),
        "one": np.array([4.0]),
        "hot": np.array([7.0] * 900 + [1.0, 9.5]),
    }
    rows = [(n, float(v)) for n, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    wanted = {"q10": 0.1, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    for r in quantiles(df, ["g"], "v", wanted).collect():
        for name, q in wanted.items():
            assert r[name] == pytest.approx(np.quantile(data[r["g"]], q), rel=1e-12)


def test_top_per_group_keeps_the_group_limit_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    top = top_per_group(df, ["g"], [F.desc("id")], 2)
    assert sorted((r["g"], r["id"]) for r in top.collect()) == [
        (0, 96), (0, 99), (1, 94), (1, 97), (2, 95), (2, 98),
    ]
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


@pytest.mark.parametrize("n, name", [(1, "nuevo"), (5, "nuevo"), (6, "medio"), (15, "medio"), (16, "heavy")])
def test_segment_limits(spark, n, name):
    assert spark.range(1).select(segment(F.lit(n)).alias("s")).first()["s"] == name


def _words(name):
    words = re.split(r"[^\w]|_", name)
    return {w.lower() for w in words if len(w) > 2} - set(GENERIC_WORDS)


@pytest.mark.parametrize(
    "a, b, wanted",
    [
        ("Organic Milk", "Organic Bread", False),
        ("Yogur Frutilla", "Yogur Frutilla Light", True),
        ("Yerba Mate Naranja", "Yerba Mate Limon", True),
        ("Banana", "Banana Split Ice", True),
        ("Organic Low Fat", "Banana", False),
        ("Café Molido", "CAFÉ molido", True),
        ("Milk", "Bread", False),
    ],
)
def test_variants(spark, a, b, wanted):
    row = spark.range(1).select(
        is_variant(name_tokens(F.lit(a)), name_tokens(F.lit(b))).alias("v"),
        name_tokens(F.lit(a)).alias("t"),
    ).first()
    assert row["v"] is wanted
    assert set(row["t"]) == _words(a)


@pytest.mark.parametrize("cut", [1, 3, 1000])
def test_pair_counts_match_brute_force_however_baskets_are_split(spark, cut):
    rng = random.Random(11)
    baskets = {o: set(rng.sample(range(60), rng.choice([1, 2, 5, 40]))) for o in range(60)}
    baskets[60] = set(range(60))
    want = {}
    for items in baskets.values():
        for a in items:
            for b in items:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    rows = [(o, p) for o, items in baskets.items() for p in items]
    df = spark.createDataFrame(rows, "order_id BIGINT, product_id INT")
    got = {(r["a"], r["b"]): r["ordenes_juntos"] for r in pair_counts(df, "product_id", 3, cut).collect()}
    assert got == {k: v for k, v in want.items() if v >= 3}


def test_md5_chunks_keep_the_md5_order(spark):
    rows = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("k")).withColumn(
        "c", md5_chunk(F.col("k"))
    ).orderBy("k").collect()
    assert [r["c"] for r in rows] == sorted(r["c"] for r in rows)


def test_ranks_with_very_many_ties_are_cut_into_chunks(spark):
    """100 000 items that were never sold share a score; no chunk of them is large."""
    from tillroll.operators import candidates

    n = 100_000
    scores = spark.range(n).selectExpr(
        "CAST(id AS INT) AS product_id", "CAST(id % 3 AS INT) AS aisle_id", "1 AS department_id",
        "CASE WHEN id < 20 THEN 0.5 - id / 1000D ELSE 0D END AS score_producto",
    )
    ranked = candidates.rank_items(scores, candidates.Limits(per_aisle=n, per_department=n, fallback_pool=n))
    got = ranked.selectExpr("max(abs(rank_global - 1 - product_id))", "count(*)", "count(DISTINCT rank_departamento)")
    assert tuple(got.first()) == (0, n, n)
    chunks = scores.groupBy("score_producto", F.floor(F.col("product_id") / 4096)).count()
    assert chunks.agg(F.max("count")).first()[0] <= 4096


def test_ordinal_with_several_levels(spark):
    rows = [(g, x, (7 * x) % 11) for g in "ab" for x in range(90)]
    df = spark.createDataFrame(rows, "g STRING, x INT, v INT")
    chunks = [F.floor(F.col("x") / 40), F.floor(F.col("x") / 8), F.floor(F.col("x") / 3)]
    got = ordinal(df, ["g"], chunks, [F.col("x")], "r", size="n", running={"total": "v"}).collect()
    assert len(got) == 180
    for r in got:
        assert (r["r"], r["n"]) == (r["x"] + 1, 90)
        assert r["total"] == sum((7 * x) % 11 for x in range(r["x"] + 1))
