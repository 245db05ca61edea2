"""Candidates: rows against plain Python, and how many tasks they are dealt over."""

import re

import pytest

from tillroll.operators import candidates as cand


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dealt_over(df, column):
    """The numbers of partitions of the exchanges by hash whose first key is `column`."""
    return [int(n) for n in re.findall(rf"Exchange hashpartitioning\({column}#[^)]*, (\d+)\)", plan(df))]


@pytest.mark.parametrize(
    "level, source, preselect, weight, top",
    [
        ("aisle_id", "pasillo", cand.preselect_aisle, 0.6, 35),
        ("department_id", "departamento", cand.preselect_department, 0.5, 25),
    ],
)
def test_users_are_dealt_over_tasks_before_their_items_are_added(
    spark, tmp_path, monkeypatch, level, source, preselect, weight, top
):
    monkeypatch.setattr(cand, "ROWS_PER_TASK", 100)
    liked = [(u, c, 1 / (1 + u + c)) for u in range(30) for c in (1, 2)] + [(None, 1, 0.5)]
    items = [(100 * c + i, c, round(1 / i, 6), i) for c in (1, 2) for i in range(1, 51)]
    other = "department_id" if level == "aisle_id" else "aisle_id"
    affinity = spark.createDataFrame(
        [(u, c, None, a, source) for u, c, a in liked] + [(99, 1, None, 0.5, "global")],
        f"user_id BIGINT, {level} INT, {other} INT, afinidad DOUBLE, fuente STRING",
    )
    ranked = spark.createDataFrame(
        [(p, c, 0, s, r, r, 1) for p, c, s, r in items],
        f"product_id INT, {level} INT, {other} INT, score_producto DOUBLE, rank_pasillo INT,"
        " rank_departamento INT, rank_global INT",
    )
    ranked.write.parquet(str(tmp_path / "ranked"))  # of known size, as all tables
    got = preselect(affinity, spark.read.parquet(str(tmp_path / "ranked")))
    # 61 rows that bring up to `keep` items each; nothing moves after the join
    keep = 30 if source == "pasillo" else 40
    assert dealt_over(got, "user_id") == [-(-61 * keep // 100)]
    want = {}
    for u, c, a in liked:
        want.setdefault(u, []).extend((-(weight * a + (1 - weight) * s), p) for p, k, s, r in items if k == c and r <= keep)
    want = {(u, p) for u, rows in want.items() for _, p in sorted(rows)[:top]}
    rows = got.collect()
    assert {(r["user_id"], r["product_id"]) for r in rows} == want and len(rows) == len(want)
    assert {r["fuente"] for r in rows} == {source}


def proposals(spark):
    named = ["pasillo", "departamento", "global"]
    rows = [(u, p, (u + p) / 100, named[(u * p + i) % 3]) for u in range(20) for p in range(15) for i in range(1 + (u + p) % 4)]
    rows += [(None, 1, 0.5, "global"), (1, None, 0.5, "pasillo"), (1, 2, None, "global")]
    return rows, spark.createDataFrame(rows, "user_id BIGINT, product_id INT, score DOUBLE, fuente STRING")


def merged(rows, bought=()):
    pairs = {}
    for u, p, s, f in rows:
        pairs.setdefault((u, p), []).append((s, f))
    return {
        k: (max((s for s, _ in v if s is not None), default=None), "+".join(sorted({f for _, f in v})))
        for k, v in pairs.items() if k not in bought
    }


def as_dict(df):
    rows = df.collect()
    out = {(r["user_id"], r["product_id"]): (r["score_candidate"], r["fuentes"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_sources_are_merged_without_sorting(spark, monkeypatch):
    monkeypatch.setattr(cand, "ROWS_PER_TASK", 100)
    rows, df = proposals(spark)
    bought = {(u, 3) for u in range(0, 20, 2)} | {(None, 1)}
    known = spark.createDataFrame(sorted(bought, key=str), "user_id BIGINT, product_id INT")
    alone = cand.dedupe_sources(df)
    assert as_dict(alone) == merged(rows)
    assert "SortAggregate" not in plan(alone)
    assert dealt_over(cand.new_and_deduped(df, known, 1234), "user_id") == [13]
    for n in (None, 1234):
        new = cand.new_and_deduped(df, known, n)
        assert as_dict(new) == merged(rows, bought)
        assert "SortAggregate" not in plan(new)
