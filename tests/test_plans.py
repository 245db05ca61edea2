"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tillroll.operators import metrics, rankers, tables
from tillroll.plans.registry import REGISTRY
from tillroll.plans.workspace import workspace

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_no_cross_join_and_no_python_in_the_plan(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text


def test_top_k_is_limited_before_the_shuffle(spark):
    ws = workspace(spark, SF_DIR)
    assert "WindowGroupLimit" in plan(rankers.topk(ws.part("valid"), rankers.heuristic_score(), 10))


def test_filters_and_columns_reach_the_files(spark):
    ws = workspace(spark, SF_DIR)
    text = plan(ws.part("valid").where("recencia_usuario_producto < 3").select("user_id"))
    assert re.search(r"PartitionFilters: \[[^\]]*split[^\]]*valid", text)
    assert "LessThan(recencia_usuario_producto,3)" in text
    assert "ReadSchema: struct<user_id:bigint,recencia_usuario_producto:int>" in text


def test_pair_history_is_partially_aggregated_before_its_shuffle(spark):
    ws = workspace(spark, SF_DIR)
    text = plan(tables.pair_history(ws.prior, ws.timeline))
    assert "partial_max_by" in text and "partial_count" in text


def test_pair_history_is_hashed_and_keeps_the_last_order_whole(spark):
    lines = [(o, p, o % 3, 1 + p) for o in range(12) for p in range(5) if (o * p) % 4 < 2]
    orders = {o: (o % 2, 1 + o // 2, None if o == 3 else o % 7, o % 24, float(o * o % 50)) for o in range(11)}
    prior = spark.createDataFrame(lines, "order_id BIGINT, product_id INT, reordered INT, add_to_cart_order INT")
    timeline = spark.createDataFrame(
        [(o, u, n, d, h, e, n, 6, 7 - n) for o, (u, n, d, h, e) in orders.items()],
        "order_id BIGINT, user_id BIGINT, order_number INT, order_dow TINYINT, order_hour TINYINT,"
        " elapsed_days DOUBLE, position INT, n_orders INT, from_end INT",
    )
    got = tables.pair_history(prior, timeline, checks=True)
    assert "SortAggregate" not in plan(got)
    want = {}
    for o, p, *_ in lines:
        u, n, d, h, e = orders.get(o, (None,) * 5)
        if (u, p) not in want or n > want[u, p][0]:
            want[u, p] = (n, e, d, h)
    rows = got.collect()
    assert {
        (r["user_id"], r["product_id"]): (r["last_number"], r["days_at_last"], r["dow_at_last"], r["hour_at_last"])
        for r in rows
    } == want and len(rows) == len(want)


def test_no_window_runs_over_a_whole_user_or_segment(spark):
    ws = workspace(spark, SF_DIR)
    for df in (tables.order_timeline(ws.orders), QUERIES["f3_stratified_split"](spark, SF_DIR)):
        for keys in re.findall(r"row_number\(\) windowspecdefinition\(([^)]*) ASC", plan(df)):
            assert "_chunk0" in keys


def test_scalars_are_subqueries(spark):
    ws = workspace(spark, SF_DIR)
    assert "Subquery" in plan(rankers.popularity_topk(ws.items, ws.valid_users))
    assert ws.items.agg(F.count("*")).count() == 1


def scans(df):
    """File scans of the plan before stages are reused, so a table read twice counts twice."""
    return df._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet")


def test_a_ranking_is_scored_in_one_pass(spark):
    ws = workspace(spark, SF_DIR)
    inputs = {"recs": ws.ranking, "truth": ws.truth, "history": ws.history, "segments": ws.segments}
    named = ws.ranking.withColumn("modelo", F.lit("m"))
    cuts = [metrics.Cut(f"top{k}", "m", k) for k in (1, 5, 10)]
    scored = metrics.score(named, ws.truth, cuts, ws.segments, ws.history, catalog_size=100)
    assert scans(scored) == sum(scans(df) for df in inputs.values())
    systems = {"a": ws.ranking, "b": ws.top10, "c": ws.ranking.where("rank > 2")}
    assert scans(metrics.compare(systems, ws.truth, catalog_size=100)) == 3 * scans(ws.ranking) + scans(ws.truth)
