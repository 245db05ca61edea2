"""Readers, writers, the shared folder and saved parameters."""

import os
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest

from tillroll.operators import validate
from tillroll.operators.models import BOOSTING
from tillroll.sources import raw, store

CSV = {
    "orders.csv": "order_id,user_id,eval_set,order_number,order_dow,order_hour_of_day,days_since_prior_order\n"
    "1,7,prior,1,0,08,\n2,7,train,2,6,23,30.0\n3,9,bad,0,7,x,31.0\n",
    "order_products__prior.csv": "order_id,product_id,add_to_cart_order,reordered\n1,5,1,0\n1,6,0,2\n1,6,3,0\n",
    "order_products__train.csv": "order_id,product_id,add_to_cart_order,reordered\n2,5,1,1\n9,77,1,0\n",
    "products.csv": 'product_id,product_name,aisle_id,department_id\n5,"Milk, whole",1,1\n6,Bread,2,9\n',
    "aisles.csv": "aisle_id,aisle\n1,dairy\n2,bakery\n",
    "departments.csv": "department_id,department\n1,fresh\n",
}


@pytest.fixture()
def folder(tmp_path):
    for name, text in CSV.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_raw_tables_have_a_fixed_schema(spark, folder):
    t = raw.read_raw(spark, folder)
    assert validate.check_required_columns(t) == []
    orders = {r["order_id"]: r for r in t["orders"].collect()}
    assert orders[1]["order_hour_of_day"] == "08"
    assert orders[1]["days_since_prior_order"] is None
    assert orders[2]["days_since_prior_order"] == 30.0
    assert t["products"].where("product_id = 5").first()["product_name"] == "Milk, whole"


def test_all_missing_inputs_are_listed(spark, folder):
    os.remove(f"{folder}/aisles.csv")
    os.remove(f"{folder}/orders.csv")
    with pytest.raises(FileNotFoundError) as e:
        raw.read_raw(spark, folder)
    assert "aisles.csv" in str(e.value) and "orders.csv" in str(e.value)


def test_checks_count_what_is_wrong(spark, folder):
    t = raw.read_raw(spark, folder)
    o = validate.check_orders(t["orders"]).first().asDict()
    assert o == {
        "filas": 3, "claves_nulas": 0, "eval_set_invalido": 1, "order_number_invalido": 1,
        "order_dow_invalido": 1, "hora_invalida": 1, "dias_invalidos": 1,
    }
    p = validate.check_order_products(t["order_products_prior"]).first().asDict()
    assert p == {"filas": 3, "claves_nulas": 0, "posicion_invalida": 1, "reordered_invalido": 1}
    keys = {r["tabla"]: r["sobrantes"] for r in validate.check_primary_keys(t).collect()}
    assert keys["order_products_prior"] == 1 and sum(keys.values()) == 1
    fk = {r["relacion"]: r["huerfanas"] for r in validate.check_foreign_keys(t).collect()}
    assert fk["products.department_id"] == 1
    assert fk["train.product_id"] == 1 and fk["train.order_id"] == 1
    assert fk["prior.order_id"] == 0
    with pytest.raises(ValueError, match="order_products_prior: 1"):
        validate.require_zero(validate.check_primary_keys(t), "keys")
    with pytest.raises(ValueError, match="pares_duplicados"):
        validate.require_zero(validate.source_gate(t), "sources")


def test_missing_columns_are_named(spark, folder):
    t = raw.read_raw(spark, folder)
    t["aisles"] = t["aisles"].drop("aisle")
    assert validate.check_required_columns(t) == ["aisles: missing aisle"]


def test_sorted_and_partitioned_write(spark, tmp_path):
    df = spark.range(200).selectExpr(
        "id % 10 AS user_id", "id AS product_id", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS split"
    )
    path = str(tmp_path / "t")
    store.write_table(df, path, order_by=["user_id", "product_id"], partition_by=["split"])
    back = store.read_table(spark, path, ["user_id", "product_id"])
    assert back.columns == ["user_id", "product_id"]
    assert back.count() == 200
    files = [f for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]
    assert files and all("zstd" in f for f in files)
    for part in spark.read.parquet(path + "/split=a").rdd.glom().collect():
        keys = [(r["user_id"], r["product_id"]) for r in part]
        assert keys == sorted(keys)


def numbers(spark, path):
    return sorted(r["id"] for r in store.read_table(spark, path).collect())


def test_a_failed_check_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    store.publish_atomic(spark.range(3), path)

    def refuse(df):
        assert df.count() == 9
        raise ValueError("bad table")

    with pytest.raises(ValueError, match="bad table"):
        store.publish_atomic(spark.range(9), path, refuse)
    assert numbers(spark, path) == [0, 1, 2]
    assert store.publish_atomic(spark.range(5), path).count() == 5
    assert os.listdir(tmp_path) == ["t"] and len(os.listdir(path)) == 3


def test_old_versions_are_removed(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(1, 6):
        store.publish_atomic(spark.range(n), path, keep=2)
        assert len(numbers(spark, path)) == n
    assert len([d for d in os.listdir(path) if d.startswith("v-")]) == 2
    assert store.publish_atomic(spark.range(0), path).count() == 0


@pytest.mark.parametrize("step", ["write", "point", "half a pointer", "prune"])
def test_a_writer_lost_at_any_step_leaves_a_whole_table(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    store.publish_atomic(spark.range(3), path)

    def lost(*args, **how):
        raise KeyboardInterrupt

    if step == "half a pointer":
        def half(self, name):
            stream = self.fs.create(self._pointer(2), False)
            stream.write(bytearray(name[:5].encode()))
            stream.close()
            raise KeyboardInterrupt

        monkeypatch.setattr(store.Versions, "point_to", half)
    elif step == "write":
        monkeypatch.setattr(store, "write_table", lost)
    else:
        monkeypatch.setattr(store.Versions, "point_to" if step == "point" else "prune", lost)
    with pytest.raises(KeyboardInterrupt):
        store.publish_atomic(spark.range(9), path)
    monkeypatch.undo()
    assert len(numbers(spark, path)) == (9 if step == "prune" else 3)
    store.publish_atomic(spark.range(4), path)
    assert len(numbers(spark, path)) == 4


def test_two_writers_with_one_number(spark, tmp_path):
    path = str(tmp_path / "t")
    store.publish_atomic(spark.range(3), path)
    one, other = store.Versions(spark, path), store.Versions(spark, path)
    for n, versions in ((5, one), (6, other)):
        store.write_table(spark.range(n), f"{path}/v-{n}")
        monkey = [1] if versions is other else None
        if monkey:  # the second one saw the numbers before the first one had its own
            versions._numbers = lambda: monkey
        versions.point_to(f"v-{n}")
    assert len(numbers(spark, path)) == 6


def test_readers_never_miss_a_table_that_is_being_published(spark, tmp_path):
    path = str(tmp_path / "t")
    store.publish_atomic(spark.range(10), path)
    done, seen = threading.Event(), []

    def read():
        while not done.is_set():
            seen.append(numbers(spark, path))

    with ThreadPoolExecutor(2) as pool:
        readers = [pool.submit(read) for _ in range(2)]
        for n in range(11, 19):
            store.publish_atomic(spark.range(n), path, keep=4)
        done.set()
        for r in readers:
            r.result()
    assert len(seen) > 4 and all(x == list(range(len(x))) and len(x) >= 10 for x in seen)


def rows_read(df):
    """Rows of the row groups that a query's scans read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_lookup_reads_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    # ids that are multiples of 7 in no order, so that least and greatest say nothing
    df = spark.range(60_000).selectExpr("pmod(hash(id), 20000) * 7 AS user_id", "id AS product_id").repartition(4)
    how = {"lookup": {"user_id": 2000}, "row_group_bytes": 16_384}
    for n in (1, 2):  # as published first, and after an update
        store.publish_atomic(df.where(f"product_id % {n} = 0"), path, **how)
        total = store.read_table(spark, path).count()
        there = df.where(f"product_id % {n} = 0 AND user_id = 7007").collect()
        found = store.read_table(spark, path).where("user_id = 7007")
        assert sorted(found.collect()) == sorted(there)
        assert rows_read(found) < total / 2
        assert rows_read(store.read_table(spark, path).where("user_id = 7008")) < total / 10
    without = str(tmp_path / "u")
    store.publish_atomic(df, without, row_group_bytes=16_384)
    assert rows_read(store.read_table(spark, without).where("user_id = 7008")) > 50_000
    store.publish_atomic(df, path, order_by=["user_id"], **how)
    assert rows_read(store.read_table(spark, path).where("user_id = 7007")) < 60_000 / 5


def test_parameters_keep_their_origin(spark, tmp_path):
    path = str(tmp_path / "params")
    assert store.load_params(spark, path, BOOSTING) == (BOOSTING, "default")
    store.save_params(spark, path, {"maxDepth": 5}, trials=3)
    assert store.load_params(spark, path, BOOSTING) == ({"maxDepth": 5}, "tuned in 3 trials")


def test_the_work_folder_is_the_one_the_session_names(spark, shared_folder):
    assert store.work_folder(spark) == shared_folder
    made = store.Store(spark).table("t", lambda: spark.range(4))
    assert made.count() == 4
    assert made.inputFiles()[0].startswith(f"file://{shared_folder}")


def test_without_the_setting_the_work_folder_is_in_the_warehouse():
    class Session:
        conf = {"spark.sql.warehouse.dir": "hdfs://h/warehouse"}

        class sparkContext:  # noqa: N801
            getCheckpointDir = staticmethod(lambda: None)

    assert store.work_folder(Session) == "hdfs://h/warehouse/tillroll"


def test_two_calls_never_write_to_the_same_place(spark):
    made = store.Store(spark)
    assert made.fresh_path("t") != made.fresh_path("t")


def test_small_report(spark, tmp_path):
    path = str(tmp_path / "r")
    store.write_report(spark.range(3), path)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 1
    assert spark.read.option("header", True).csv(path).count() == 3
