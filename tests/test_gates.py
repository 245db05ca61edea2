"""Builds that start from raw CSVs, and what stops them."""

import os

import harness
import pytest
from pyspark.sql import functions as F

from tillroll.operators import gates
from tillroll.plans.registry import REGISTRY
from tillroll.plans.workspace import REGISTERED_LIMITS, Workspace, workspace
from tillroll.sources import raw

SF_DIR = f"{harness.DATA}/sf0.001"
BUILT = ("catalog", "targets", "items", "users", "interactions", "features", "ranking", "two_block", "candidates")


@pytest.fixture(scope="module")
def frames(spark):
    return {n: df.toPandas() for n, df in workspace(spark, SF_DIR).raw.items()}


@pytest.fixture()
def start(spark, frames, tmp_path):
    """Write the frames, with changes, as CSVs and start from them."""
    made = []

    def begin(max_rejected=0, lines=None, header=None, **changed):
        folder = tmp_path / f"raw{len(made)}"
        folder.mkdir()
        for name, file in raw.RAW_FILES.items():
            df = changed.get(name, frames[name])
            text = df.to_csv(index=False)
            if header and name in header:
                text = header[name] + text[text.index("\n"):]
            (folder / file).write_text(text + "".join(f"{x}\n" for x in (lines or {}).get(name, ())))
        ws = Workspace.from_raw(spark, str(folder), max_rejected, folder=str(tmp_path / "work"), limits=REGISTERED_LIMITS)
        made.append(ws)
        return ws

    yield begin
    for ws in made:
        ws.store.drop()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def build(ws):
    return {name: getattr(ws, name) for name in BUILT}


def test_all_tables_are_built_from_csv(spark, start):
    mapped = workspace(spark, SF_DIR)
    built = build(start())
    for name in BUILT:
        assert rows(built[name]) == rows(getattr(mapped, name)), name


def test_columns_in_another_order_and_further_ones(spark, start, frames):
    products = frames["products"][["aisle_id", "product_name", "product_id", "department_id"]].copy()
    products["product_name"] = 'a "quoted", name'
    products["more"] = "x"
    ws = start(products=products)
    assert ws.products.columns == ["product_id", "product_name", "aisle_id", "department_id"]
    assert ws.catalog.where("product_name = 'a \"quoted\", name'").count() == len(products)


def test_missing_columns_are_named_by_table(start, frames):
    with pytest.raises(ValueError, match="missing columns: orders: order_number, order_dow; aisles: aisle$"):
        start(orders=frames["orders"].drop(columns=["order_dow", "order_number"]), aisles=frames["aisles"].drop(columns="aisle"))


def test_headers_must_agree_between_files_of_a_table(spark, start, frames, tmp_path):
    ws = start()
    folder = tmp_path / "raw0"
    parts = folder / "aisles.csv.d"
    parts.mkdir()
    (parts / "a.csv").write_text("aisle_id,aisle\n1,x\n")
    (parts / "b.csv").write_text("aisle,aisle_id\nx,1\n")
    os.remove(folder / "aisles.csv")
    os.rename(parts, folder / "aisles.csv")
    with pytest.raises(Exception, match="CSV header does not conform"):
        Workspace.from_raw(spark, str(folder), folder=str(tmp_path / "work")).aisles.collect()
    assert ws.source == str(folder)


BROKEN = {"order_products_prior": ["1,2", "x,5,1,0", "7,5,1,0,9"], "orders": ["5,oops,prior,1,0,08,"]}


def test_broken_lines_stop_the_build(start):
    with pytest.raises(gates.BuildStopped, match="rejected lines: orders: 1; order_products_prior: 3"):
        start(lines=BROKEN).interactions  # noqa: B018


def test_a_few_broken_lines_can_be_set_aside(spark, start):
    ws = start(max_rejected=4, lines=BROKEN)
    assert rows(ws.rejected) == sorted([(t, x) for t, some in BROKEN.items() for x in some], key=repr)
    counts = {r["tabla"]: (r["aceptadas"], r["rechazadas"]) for r in ws.rejected_counts().collect()}
    mapped = workspace(spark, SF_DIR)
    assert counts["order_products_prior"] == (mapped.prior.count(), 3) and counts["aisles"][1] == 0
    assert rows(ws.interactions) == rows(mapped.interactions)


def changed(frames, name, **values):
    """The table with its first row changed."""
    df = frames[name].copy()
    for column, value in values.items():
        df[column] = df[column].astype("object")
        df.loc[df.index[0], column] = value
    return {name: df}


def test_faults_stop_the_build(start, frames):
    twice = lambda name: {name: frames[name].iloc[[0, *range(len(frames[name]))]]}
    less = lambda name: {name: frames[name].iloc[1:]}
    orders = frames["orders"]
    target = orders[orders.eval_set == "train"].iloc[0]
    early = orders.copy()
    early.loc[early.order_id == target.order_id, "order_number"] = 1
    leaked = frames["order_products_prior"].copy()
    leaked.loc[leaked.index[0], "order_id"] = target.order_id
    cases = [
        (twice("order_products_prior"), "pair_history.repetidas: 1"),
        (twice("orders"), "orders.repetidas: 1"),
        (twice("products"), "products.repetidas: 1"),
        (twice("aisles"), "catalogo.productos"),
        (less("departments"), "catalogo.productos"),
        (less("products"), "productos.compras"),
        (changed(frames, "order_products_prior", order_id=10**12), "pair_history.sin_pedido: 1"),
        (changed(frames, "order_products_train", order_id=10**12), "targets_train.lineas"),
        (changed(frames, "order_products_prior", add_to_cart_order=0), "order_products.posicion_invalida: 1"),
        (changed(frames, "order_products_train", reordered=2), "order_products.reordered_invalido: 1"),
        (changed(frames, "orders", order_dow=7), "orders.order_dow_invalido: 1"),
        (changed(frames, "orders", eval_set="other"), "orders.eval_set_invalido: 1"),
        (changed(frames, "orders", order_number=101), "orders.order_number_fuera: 1"),
        ({"order_products_prior": leaked}, "pair_history.sin_pedido: 1"),
        ({"orders": early}, "features.fuga"),
    ]
    for change, message in cases:
        ws = start(**change)
        with pytest.raises(gates.BuildStopped, match=message):
            build(ws)
        table = message.split(".")[0]
        assert table not in ws.store._tables and not [f for f in os.listdir(ws.store.folder) if f.startswith(f"{table}-")]


def test_more_than_128_orders_are_checked_by_a_job(start, frames):
    orders = frames["orders"].copy()
    first = orders[orders.eval_set == "prior"].iloc[0]
    orders.loc[orders.order_id == first.order_id, "order_number"] = 500
    orders.loc[(orders.user_id == first.user_id) & (orders.eval_set == "train"), "order_number"] = 501
    lines = frames["order_products_prior"]
    line = lines[lines.order_id == first.order_id].iloc[[0]]
    import pandas as pd

    for given, stops in ((lines, False), (pd.concat([lines, line]), True)):
        ws = start(orders=orders, order_products_prior=given)
        ws.store.require = lambda name, observed: gates.require(name, observed, frozenset(["orders.order_number_fuera"]))
        if stops:
            with pytest.raises(gates.BuildStopped, match="order_products"):
                ws.pairs  # noqa: B018
            assert "pair_history" not in ws.store._tables
        else:
            assert ws.pairs.count() > 0


def test_counts_agree_with_the_tables(spark):
    ws = workspace(spark, SF_DIR)
    build(ws)
    seen = ws.store.observed
    assert seen["interacciones"]["filas"] == ws.interactions.count()
    assert seen["order_products"]["prior"] == ws.prior.count()
    assert seen["features"]["positivos"] == ws.features.agg(F.sum("etiqueta")).first()[0]
    bad = [r for r in ws.checks().collect() if r["construido"] != r["origen"]]
    assert {f"{r['tabla']}.{r['control']}" for r in bad} <= {"candidatos_nuevos.completos"}
    assert len(REGISTRY) > 150


def test_empty_tables_pass(spark, start, frames):
    ws = start(**{n: df.iloc[:0] for n, df in frames.items()})
    assert ws.interactions.count() == 0 and ws.features.count() == 0


def test_counting_needs_no_scan_of_its_own(spark, tmp_path):
    """A table with checks is written by the same jobs and stages as one without."""
    from tillroll.operators import tables
    from tillroll.sources.store import Store

    ws = workspace(spark, SF_DIR)
    lines, timeline = ws.prior, ws.timeline
    tracker = spark.sparkContext.statusTracker()
    stages = []
    for counts in (gates.counts, lambda name, columns: {}):
        store = Store(spark, str(tmp_path), counts)
        group = f"write-{len(stages)}"
        spark.sparkContext.setJobGroup(group, group)
        store.table("pair_history", lambda: tables.pair_history(lines, timeline, checks=True))
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        stages.append(sorted(len(j.stageIds) for j in jobs))
        assert bool(store.observed["pair_history"]) == (counts is gates.counts)
    spark.sparkContext.setJobGroup("", "")
    assert stages[0] == stages[1]
