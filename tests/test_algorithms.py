import math
import random

import numpy as np
import pytest

from tabloom.errors import TableError
from tabloom.operators.components import CovariancePCA, means_and_covariance, vector_covariance
from tabloom.operators.descent import GradientLogistic
from tabloom.operators.lloyd import LloydKMeans

POINTS = [(0, 1.0, 1.0), (1, 1.0, 2.0), (2, 2.0, 1.0), (3, 8.0, 8.0), (4, 8.0, 9.0), (5, 9.0, 8.0)]


def test_lloyd(spark):
    df = spark.createDataFrame(POINTS, "id int, x double, y double")
    model = LloydKMeans(2).fit(df, "id", ["x", "y"])
    assert sorted(round(c[0], 6) for c in model.centroids) == [1.333333, 8.333333]
    assert all(a >= b - 1e-12 for a, b in zip(model.costs, model.costs[1:]))
    groups = {r["id"]: r["cluster"] for r in model.predict(df).collect()}
    assert groups[0] == groups[1] == groups[2] != groups[3] == groups[4] == groups[5]
    assert LloydKMeans(2).fit(df.repartition(3), "id", ["x", "y"]).centroids == model.centroids
    assert {r["id"]: r["cluster"] for r in model.labels_at(df, model.n_iter - 1).collect()} == groups
    assert model.cost(df) == pytest.approx(model.costs[-1])


def test_lloyd_keeps_empty_clusters_and_checks_input(spark):
    df = spark.createDataFrame(POINTS, "id int, x double, y double")
    model = LloydKMeans(2, 1).fit(df, "id", ["x", "y"], start=[[5.0, 5.0], [100.0, 100.0]])
    assert model.centroids[1] == [100.0, 100.0]
    with pytest.raises(ValueError):
        LloydKMeans(7).fit(df, "id", ["x", "y"])
    with pytest.raises(RuntimeError):
        LloydKMeans(2).predict(df)
    for bad in (spark.createDataFrame([(0, float("nan"))], "id int, x double"), df.where("id < 0"),
                spark.createDataFrame([(0, None)], "id int, x double"), df.selectExpr("id", "'a' AS x")):
        with pytest.raises(TableError):
            LloydKMeans(1).fit(bad, "id", ["x"])
    for k, n in ((0, 1), (1, 0), (1.5, 1)):
        with pytest.raises(ValueError):
            LloydKMeans(k, n)


def test_components_match_numpy(spark):
    rnd = np.random.default_rng(3)
    data = rnd.normal(size=(100, 5))
    names = [f"x{i}" for i in range(5)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"{n} double" for n in names))
    means, matrix = means_and_covariance(df, names)
    assert np.allclose(means, data.mean(axis=0)) and np.allclose(matrix, np.cov(data, rowvar=False))
    model = CovariancePCA(5).fit(df, names)
    assert all(a >= b for a, b in zip(model.variances, model.variances[1:]))
    assert np.allclose(model.components.T @ model.components, np.eye(5))
    back = model.inverse_transform(model.transform(df)).select(*[f"{n}_back" for n in names]).collect()
    assert np.allclose(np.array([list(r) for r in back]), data)
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(df)
    assert np.allclose(vector_covariance(vectors, "v")[1], matrix)
    with pytest.raises(ValueError):
        CovariancePCA(6).fit(df, names)
    with pytest.raises(RuntimeError):
        CovariancePCA(1).transform(df)
    with pytest.raises(ValueError):
        CovariancePCA(1).fit(df.limit(1), names)


def test_logistic_descent(spark):
    rnd = random.Random(1)
    rows = [(rnd.gauss(c * 4, 1), rnd.gauss(c * 4, 1), c) for c in (0, 1) for _ in range(25)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    model = GradientLogistic(0.5, 40).fit(df, ["a", "b"], "y")
    assert all(x >= y for x, y in zip(model.loss_history, model.loss_history[1:])) and len(model.loss_history) == 40
    scored = model.predict(df)
    assert scored.where("prediction = y").count() / 50 >= 0.95
    summed = GradientLogistic(0.01, 40, "sum").fit(df, ["a", "b"], "y")
    assert summed.weights == pytest.approx(model.weights, rel=1e-9)  # 0.01 times fifty rows
    far = spark.createDataFrame([(1e9, 0.0, 0), (-1e9, 0.0, 0)], "a double, b double, y int")
    assert all(math.isfinite(r["probability"]) for r in model.predict(far).collect())
    with pytest.raises(ValueError):
        GradientLogistic(0.5, 1).fit(df.selectExpr("a", "b", "y + 1 AS y"), ["a", "b"], "y")
    with pytest.raises(RuntimeError):
        GradientLogistic().predict(df)
    for rate, epochs in ((0, 1), (0.1, 0)):
        with pytest.raises(ValueError):
            GradientLogistic(rate, epochs)
