"""The recommender of two blocks against plain Python, on random baskets and rules."""

import random

import pytest
from frames import known, recs, rules, segments
from pyspark.sql import functions as F

from tillroll.operators import recommend


def proposed(bought, by_item, n):
    """Consequents of bought items by their best confidence, then by id, without bought ones."""
    best = {}
    for item in bought:
        for out, confidence in by_item.get(item, ()):
            if out not in bought:
                best[out] = max(best.get(out, 0), confidence)
    return sorted(best, key=lambda p: (-best[p], p))[:n]


def shop(seed, users=25, items=30):
    """Histories, rankings of the bought items, segments, and rules whose confidences often tie."""
    rng = random.Random(seed)
    bought = {u: set(rng.sample(range(items), rng.randint(0, 15))) for u in range(users)}
    ranking = {u: rng.sample(range(items), rng.randint(1, 18)) for u in range(users)}
    segs = {u: rng.choice(["nuevo", "medio", "heavy", "otro"]) for u in range(users)}
    by_item = {
        a: [(b, rng.choice([0.1, 0.2, 0.35, 0.6])) for b in rng.sample(range(items), rng.randint(1, 7)) if b != a]
        for a in rng.sample(range(items), 20)
    }
    return bought, ranking, segs, by_item


@pytest.mark.parametrize("seed, n", [(1, 1), (2, 3), (3, 50), (4, 0)])
def test_suggestions_of_random_baskets(spark, seed, n):
    bought, _, _, by_item = shop(seed)
    rows = recommend.novelty_suggestions(known(spark, bought), rules(spark, by_item), n).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["user_id"], r["posicion"])):
        got.setdefault(r["user_id"], []).append(r["product_id"])
    assert {u: x for u, b in bought.items() if (x := proposed(b, by_item, n))} == got


@pytest.mark.parametrize("policy", [None, {"nuevo": 4, "medio": 0, "heavy": 2}])
def test_both_blocks_of_random_baskets(spark, policy):
    bought, ranking, segs, by_item = shop(9)
    out = recommend.two_block(
        recs(spark, ranking), known(spark, bought), segments(spark, segs), rules(spark, by_item), policy=policy
    )
    sizes = policy or recommend.POLICY
    got = {}
    for r in out.orderBy("user_id", "bloque", "posicion").collect():
        got.setdefault((r["user_id"], r["bloque"]), []).append(r["product_id"])
    want = {(u, "principal"): x[:10] for u, x in ranking.items()}
    for u, b in bought.items():
        if extra := proposed(b, by_item, sizes.get(segs[u], 0)):
            want[u, "sugerencia"] = extra
    assert got == want
    gate = recommend.two_block_gate(out, recs(spark, ranking)).first()
    assert (gate["usuarios"], gate["usuarios_distintos"]) == (len(ranking), 0)
    turned = {u: x[::-1] for u, x in ranking.items()}
    changed = recommend.two_block_gate(out, recs(spark, turned)).first()["usuarios_distintos"]
    assert changed == sum(x[:10] != x[::-1][:10] for x in ranking.values())


def test_each_published_segment_has_room_for_something_new():
    assert min(recommend.POLICY.values()) >= 1


@pytest.mark.parametrize("seed", [5, 6])
@pytest.mark.parametrize("n", [0, 1, 4])
def test_new_items_take_the_last_places(spark, seed, n, k=8):
    rng = random.Random(seed)
    ranking = {u: rng.sample(range(100), rng.randint(1, 12)) for u in range(20)}
    extra = {u: rng.sample(range(200, 260), rng.randint(0, 5)) for u in range(20)}
    sug = spark.createDataFrame(
        [(u, p, i) for u, x in extra.items() for i, p in enumerate(x, 1)],
        "user_id BIGINT, product_id INT, posicion INT",
    )
    rows = recommend.hybrid_topk(recs(spark, ranking), sug, {"h": F.lit(n)}, k=k).orderBy("user_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r["user_id"], []).append(r["product_id"])
    for u in range(20):
        new = extra[u][:n]
        assert got.get(u, []) == ranking[u][: k - len(new)] + new


def test_candidates_go_where_the_ranking_ends(spark, k=6):
    rng = random.Random(8)
    ranking = {u: rng.sample(range(100), rng.randint(0, 6)) for u in range(15)}
    more = {u: rng.sample(range(200, 260), rng.randint(0, 9)) for u in range(15)}
    cand = spark.createDataFrame(
        [(u, p, i) for u, x in more.items() for i, p in enumerate(x, 1)],
        "user_id BIGINT, product_id INT, candidate_rank INT",
    )
    users = spark.createDataFrame([(u,) for u in range(15)], "user_id BIGINT")
    got = {}
    for r in recommend.baseline_plus_fill(recs(spark, ranking), cand, users, k=k).orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append((r["rank"], r["product_id"]))
    for u in range(15):
        assert got.get(u, []) == list(enumerate((ranking[u][:k] + more[u])[:k], 1))
