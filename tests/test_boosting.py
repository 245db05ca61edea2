"""Boosting on bins against `GBTClassifier`, which it must equal where nothing is drawn."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors

from tillroll.operators import boosting

PLAIN = {"subsamplingRate": 1.0, "featureSubsetStrategy": "all", "stepSize": 0.2, "minInstancesPerNode": 5}


def rows(spark, n=3000, seed=1, noise=0.4):
    rng = np.random.default_rng(seed)
    x = np.column_stack([
        rng.normal(size=n), rng.integers(0, 5, n), rng.exponential(size=n), np.zeros(n), rng.integers(0, 300, n) / 7
    ])
    y = (x[:, 0] + (x[:, 1] == 2) - 0.5 * x[:, 2] + rng.normal(0, noise, n) > 0).astype(int)
    held = rng.random(n) < 0.2
    data = [(Vectors.dense(a.tolist()), int(b), bool(h)) for a, b, h in zip(x, y, held)]
    return spark.createDataFrame(data, ["x", "etiqueta", "es_freno"])


def splits(model):
    """Column and limit of each split, tree by tree."""
    return [line.strip() for line in model.toDebugString.splitlines() if "(feature" in line or line.startswith("  Tree")]


def reference(df, trees, depth, tol):
    return GBTClassifier(
        featuresCol="x", labelCol="etiqueta", maxIter=trees, seed=3, maxDepth=depth,
        validationIndicatorCol="es_freno", validationTol=tol, **PLAIN,
    ).fit(df)


@pytest.mark.parametrize("trees, depth, tol", [(4, 3, 1e-4), (2, 6, 1e-4), (60, 2, 0.02), (1, 1, 1e-4)])
def test_it_equals_the_classifier_of_pyspark(spark, monkeypatch, trees, depth, tol):
    monkeypatch.setattr(boosting, "TASK_ROWS", 800)  # several tasks
    monkeypatch.setattr(boosting, "CHAIN", 3)
    df = rows(spark).repartition(4).cache()
    got, want = boosting.fit(df, trees, 3, tol, maxDepth=depth, **PLAIN), reference(df, trees, depth, tol)
    assert got.getNumTrees == want.getNumTrees and got.getNumTrees < 60
    assert splits(got) == splits(want) and got.treeWeights == want.treeWeights
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), rel=1e-6)
    both = zip(*[m.transform(df).select("probability", "prediction").collect() for m in (got, want)])
    assert all(a[1] == b[1] and a[0][1] == pytest.approx(b[0][1], rel=1e-9) for a, b in both)


@pytest.mark.parametrize("collected", [1, 1024])
def test_many_tasks_fit_what_one_task_fits(spark, monkeypatch, collected):
    how = {**PLAIN, "featureSubsetStrategy": "0.6"}
    df = rows(spark, noise=0.1).repartition(4).cache()
    monkeypatch.setattr(boosting, "TASK_ROWS", 800)
    one = boosting.fit(df, 4, 3, 1e-4, maxDepth=4, **how)
    monkeypatch.setattr(boosting, "ALONE", 800)
    monkeypatch.setattr(boosting, "MOST_COLLECTED", collected)
    monkeypatch.setattr(boosting, "CHAIN", 3)
    many = boosting.fit(df, 4, 3, 1e-4, maxDepth=4, **how)
    assert one.getNumTrees == many.getNumTrees == 4 and splits(one) == splits(many) and len(splits(one)) > 40


def test_impurities_of_children_that_are_not_counted(spark):
    df = rows(spark)
    want = boosting_nodes(reference(df, 1, 6, 1e-4))
    got = boosting_nodes(boosting.fit(df, 1, 3, 1e-4, maxDepth=6, **PLAIN))
    # pyspark.ml gives no impurity (-1) where a leaf was not worth a look
    assert [g for g, w in zip(got, want) if w != -1] == pytest.approx([w for w in want if w != -1], abs=1e-9)
    assert len(got) == len(want) > 100


def boosting_nodes(model):
    """Impurity and prediction of the nodes of the first tree, from the left."""
    def walk(node):
        sides = [] if node.subtreeDepth() == 0 else [*walk(node.leftChild()), *walk(node.rightChild())]
        return [node.impurity(), node.prediction(), *sides]

    return walk(model.trees[0]._call_java("rootNode"))


def test_few_rows_are_fitted_by_one_task(spark):
    tracker, jobs = spark.sparkContext.statusTracker(), []
    df = rows(spark).repartition(4).cache()
    df.count()
    for trees in (1, 8):
        before = len(tracker.getJobIdsForGroup(None))
        assert boosting.fit(df, trees, 3, -9.0, maxDepth=3, **PLAIN).getNumTrees == trees
        jobs.append(len(tracker.getJobIdsForGroup(None)) - before)
    assert jobs[0] == jobs[1] < 10
