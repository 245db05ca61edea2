"""Metrics against a scorer in plain Python, on random users and on small cases of each definition."""

import math
import random

import pytest
from frames import known, pairs, recs, segments

from tillroll.operators import metrics
from tillroll.operators.metrics import ALL, Cut


def ratio(a, b):
    return a / b if b else 0.0


def harmonic(a, b):
    return 2 * a * b / (a + b) if a + b else 0.0


def scored(lists, truth, k, size, history=None):
    """The report row of these users by the definitions."""
    n = len(truth)
    hits = shown = full = hit_users = 0
    recall, items, offered, new_precision, new_recall = 0.0, set(), [], [], []
    new_targets = new_hits = new_hit_users = 0
    for user, wanted in truth.items():
        first = set(lists.get(user, [])[:k])
        right = len(first & wanted)
        hits += right
        shown += not first
        full += len(first) == k
        hit_users += right > 0
        recall += right / len(wanted)
        items |= first
        seen = (history or {}).get(user, set())
        new, new_wanted = first - seen, wanted - seen
        got = len(new & new_wanted)
        offered.append(len(new) / k)
        if new:
            new_precision.append(got / len(new))
        if new_wanted:
            new_recall.append(got / len(new_wanted))
            new_hit_users += got > 0
        new_targets += len(new_wanted)
        new_hits += got
    targets = sum(map(len, truth.values()))
    precision, macro, micro = ratio(hits, n * k), ratio(recall, n), ratio(hits, targets)
    out = {
        "n_usuarios": n, "aciertos_totales": hits, "objetivos_totales": targets, "precision": precision,
        "recall": macro, "recall_macro": macro, "recall_micro": micro, "f1": harmonic(precision, macro),
        "f1_micro": harmonic(precision, micro), "hit_rate": ratio(hit_users, n), "k": k,
        "cobertura": len(items) / size, "usuarios_completos": ratio(full, n), "sin_recomendaciones": shown,
    }
    if history is not None:
        out |= {
            "novedad_ofrecida": ratio(sum(offered), n),
            "precision_novedad": ratio(sum(new_precision), len(new_precision)),
            "recall_novedad": ratio(sum(new_recall), len(new_recall)),
            "hit_rate_novedad": ratio(new_hit_users, len(new_recall)),
            "n_con_novedad_ofrecida": len(new_precision), "n_con_objetivo_nuevo": len(new_recall),
            "aciertos_nuevos_totales": new_hits, "objetivos_nuevos_totales": new_targets,
        }
    return out


def people(seed, n=60, items=40):
    rng = random.Random(seed)
    some = lambda low, high: set(rng.sample(range(items), rng.randint(low, high)))
    lists = {u: [rng.randrange(items) for _ in range(rng.randint(0, 14))] for u in range(n) if rng.random() < 0.9}
    truth = {u: some(1, 9) for u in range(5, n)}
    history = {u: some(1, 25) for u in range(n) if rng.random() < 0.8}
    segs = {u: rng.choice(["nuevo", "medio", "heavy"]) for u in range(n) if rng.random() < 0.85}
    return lists, truth, history, segs


def run(spark, lists, truth, k, segs=None, size=100, strict=True, history=None):
    rows = metrics.evaluate(
        recs(spark, lists), pairs(spark, truth), k,
        segments(spark, segs) if segs is not None else None, size, strict,
        known(spark, history) if history is not None else None,
    ).collect()
    return {r["segmento"]: r.asDict() for r in rows}


def assert_row(got, want):
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=1e-12), name


@pytest.mark.parametrize("seed, k", [(1, 1), (2, 4), (3, 10), (4, 20)])
def test_random_users_in_all_and_per_segment(spark, seed, k):
    lists, truth, history, segs = people(seed)
    got = run(spark, lists, truth, k, segs, 50, False, history)
    assert_row(got[ALL], scored(lists, truth, k, 50, history))
    assert got[ALL]["sin_segmento"] == len(set(truth) - set(segs))
    assert set(got) == {ALL, *(segs[u] for u in truth if u in segs)}
    for name in set(got) - {ALL}:
        mine = {u: t for u, t in truth.items() if segs.get(u) == name}
        assert_row(got[name], scored(lists, mine, k, 50, history))


@pytest.mark.parametrize("seed", [11, 12])
def test_without_history_there_are_no_novelty_columns(spark, seed):
    lists, truth, _, _ = people(seed)
    got = run(spark, lists, truth, 6, strict=False)[ALL]
    assert_row(got, scored(lists, truth, 6, 100))
    assert "novedad_ofrecida" not in got


@pytest.mark.parametrize("seed", [21, 22])
def test_systems_are_compared_on_the_same_users(spark, seed):
    first, truth, history, _ = people(seed)
    second = people(seed + 100)[0]
    systems = {"uno": first, "dos": second}
    rows = metrics.score(
        metrics.stack({m: recs(spark, x) for m, x in systems.items()}), pairs(spark, truth),
        [Cut("uno corto", "uno", 3), Cut("uno largo", "uno", 8), Cut("dos", "dos", 5)],
        None, known(spark, history), 60, False,
    ).collect()
    got = {r["modelo"]: r.asDict() for r in rows}
    assert_row(got["uno corto"], scored(first, truth, 3, 60, history))
    assert_row(got["uno largo"], scored(first, truth, 8, 60, history))
    assert_row(got["dos"], scored(second, truth, 5, 60, history))


# single definitions ------------------------------------------------------------------------------


def test_a_short_list_is_measured_against_k(spark):
    got = run(spark, {4: [31, 32]}, {4: {32, 33}}, 8)[ALL]
    assert got["precision"] == 1 / 8 and got["recall"] == 1 / 2 and got["usuarios_completos"] == 0


def test_repeated_items_count_once_and_use_up_their_places(spark):
    got = run(spark, {4: [31, 31, 31, 33]}, {4: {31, 33}}, 3)[ALL]
    assert got["aciertos_totales"] == 1 and got["usuarios_completos"] == 0


def test_other_users_lists_do_not_matter(spark):
    got = run(spark, {4: [31], 77: [40, 41, 42]}, {4: {31}}, 2, size=10)[ALL]
    assert got["n_usuarios"] == 1 and got["cobertura"] == 0.1


def test_strict_jobs_stop_at_a_user_without_list(spark):
    with pytest.raises(Exception, match="have no recommendations"):
        run(spark, {4: [31]}, {4: {31}, 5: {31}}, 2)


def test_an_empty_target_basket_stops_every_job(spark):
    with pytest.raises(Exception, match="empty target basket"):
        run(spark, {4: [31]}, {4: set()}, 2, strict=False)


def test_no_users_give_a_row_of_zeros(spark):
    got = run(spark, {4: [31]}, {}, 2, segs={4: "medio"}, history={})
    assert set(got) == {ALL}
    assert all(got[ALL][c] == 0 for c in ("n_usuarios", "recall", "f1", "hit_rate", "recall_novedad"))


def test_with_an_empty_history_all_is_new(spark):
    got = run(spark, {4: [31, 32]}, {4: {32}}, 2, history={})[ALL]
    assert got["novedad_ofrecida"] == got["recall_novedad"] == 1 and got["precision_novedad"] == 0.5


def test_new_targets_are_those_never_bought(spark):
    left = metrics.new_targets(pairs(spark, {4: {1, 2}, 5: {3}}), known(spark, {4: {2}, 6: {3}})).collect()
    assert {(r["user_id"], r["product_id"]) for r in left} == {(4, 1), (5, 3)}


def test_lift_is_relative_to_the_reference(spark):
    lists, truth, _, _ = people(31)
    lists |= {u: [39] for u in truth if u not in lists}
    half = {u: x[: len(x) // 2] or x[:1] or [39] for u, x in lists.items()}
    lists = {u: x or [39] for u, x in lists.items()}
    frames = {"media": recs(spark, half), "entera": recs(spark, lists)}
    rows = {r["modelo"]: r for r in metrics.compare(frames, pairs(spark, truth), 10, "media", catalog_size=40).collect()}
    a, b = scored(half, truth, 10, 40), scored(lists, truth, 10, 40)
    assert rows["media"]["lift"] == 0
    assert rows["entera"]["lift"] == pytest.approx(b["recall"] / a["recall"] - 1)
    assert [rows[m]["orden"] for m in ("media", "entera")] == [1, 2]
    nothing = {u: [1000] for u in truth}
    rows = metrics.compare({"nada": recs(spark, nothing), "x": frames["entera"]}, pairs(spark, truth), 10, "nada", catalog_size=40)
    assert math.isnan({r["modelo"]: r["lift"] for r in rows.collect()}["x"])


def test_a_comparison_needs_systems_and_a_known_reference(spark):
    with pytest.raises(ValueError, match="no systems"):
        metrics.compare({}, pairs(spark, {1: {1}}), catalog_size=10)
    with pytest.raises(ValueError, match="reference"):
        metrics.compare({"x": recs(spark, {1: [1]})}, pairs(spark, {1: {1}}), reference="y", catalog_size=10)
