"""The same results when one user, one item and one order hold a third of the rows, and when the
input rows come in another order."""

import duckdb
import harness
import pytest

import __spark_entry__ as entry

BASE = f"{harness.DATA}/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = (
    "raw_prior_lines", "s1_raw_orders", "t3_item_profile", "t4_user_profile", "t7_cumulative_days",
    "t8_interactions", "f3_stratified_split", "f7_build_features", "f8_recent_window_features",
    "f11_train_medians", "r4_repurchase_topk", "r6_weight_rankings", "c4_rank_items",
    "c15_generate", "c14_fallback_long_lists", "a4_pair_counts", "a4_pair_counts_split_baskets",
    "a14_novelty_suggestions", "a16_two_block", "m12_evaluate_repurchase", "m14_candidate_metrics",
    "e3_sweep_n", "e12_novelty_slots_sweep", "e18_stratified_sample", "d2_user_depth",
    "d4_concentration_curve", "d13_distribution_summary",
)


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """A third of all orders moved to one customer, of all lines to one part and to one order."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    con = duckdb.connect()
    src = lambda t: f"read_parquet('{BASE}/{t}.parquet')"
    con.execute(
        f"COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey) "
        f"FROM {src('orders')} ORDER BY hash(o_orderkey)) TO '{folder}/orders.parquet'"
    )
    con.execute(
        f"""COPY (SELECT * EXCLUDE (h) REPLACE (
              CASE WHEN h % 3 = 0 THEN 21 ELSE l_orderkey END AS l_orderkey,
              CASE WHEN h % 3 = 1 THEN 5 ELSE l_partkey END AS l_partkey)
            FROM (SELECT *, hash(l_orderkey, l_linenumber, l_partkey) AS h FROM {src('lineitem')})
            ORDER BY hash(l_partkey, l_orderkey)) TO '{folder}/lineitem.parquet'"""
    )
    con.execute(f"COPY (SELECT * FROM {src('part')}) TO '{folder}/part.parquet'")
    return folder


@pytest.fixture(scope="module")
def skewed_database(skewed):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{skewed}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_skewed_data(spark, skewed, skewed_database, name):
    assert harness.compare(QUERIES[name](spark, skewed), skewed_database, SQL[name]) == []


@pytest.fixture(scope="module")
def shuffled(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shuffled"))
    con = duckdb.connect()
    for t, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey, l_linenumber"), ("part", "p_partkey")):
        con.execute(
            f"COPY (SELECT * FROM read_parquet('{BASE}/{t}.parquet') ORDER BY md5(concat({key}))) "
            f"TO '{folder}/{t}.parquet' (ROW_GROUP_SIZE 2048)"
        )
    return folder


@pytest.mark.parametrize(
    "name",
    ["r3_popularity_topk", "r4_repurchase_topk", "r10_topk", "a13_rule_index", "a16_two_block",
     "c15_final_candidates"],
)
def test_the_order_of_input_rows_changes_no_ranking(spark, shuffled, name):
    rows = lambda folder: sorted(map(repr, QUERIES[name](spark, folder).collect()))
    assert rows(shuffled) == rows(BASE)
