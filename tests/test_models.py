"""Solvers of the models against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import descent, evaluate, forest, newton, preprocess, sketches, starts
from tabloom.operators.models import fit_model, most_likely, nearest
from tabloom.operators.rows import row_hash


def frame(spark, x, y):
    rows = [([float(v) for v in a], int(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "x array<double>, y int").repartition(3)


@pytest.mark.parametrize("classes", [2, 3, 4])
def test_newton_reaches_a_stationary_point(spark, classes):
    rng = np.random.default_rng(classes)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.2]
    y = np.array([rng.choice(classes, p=p / p.sum()) for p in np.exp(x @ rng.normal(size=(3, classes)) * 0.5)])
    weights, steps = newton.newton_logistic(frame(spark, x, y), classes, 1.0)
    assert steps < 15
    full = np.column_stack([np.ones(len(x)), x])

    def loss(w):
        z = full @ w.reshape(weights.shape).T
        z = np.column_stack([np.zeros(len(x)), z]) if classes == 2 else z
        top = z.max(1)
        return (np.log(np.exp(z - top[:, None]).sum(1)) + top - z[np.arange(len(y)), y]).sum() + (w.reshape(weights.shape)[:, 1:] ** 2).sum() / 2

    at = weights.ravel()
    for k in range(len(at)):  # a numeric gradient of the whole loss
        step = np.zeros(len(at))
        step[k] = 1e-5
        assert abs(loss(at + step) - loss(at - step)) / 2e-5 < 1e-3
    scored = frame(spark, x, y).select("x", most_likely(F.col("x"), weights.tolist()).alias("c")).collect()
    for r in scored:
        z = weights @ np.array([1.0, *r.x])
        assert r.c == (int(z[0] > 0) if classes == 2 else int(z.argmax()))


def test_newton_on_separated_classes_and_its_limit(spark):
    x, y = np.arange(20.0)[:, None] - 9.5, np.arange(20) >= 10
    weights, _ = newton.newton_logistic(frame(spark, x, y), 2, 1.0)
    assert 0 < weights[0, 1] < 5 and abs(weights[0, 0]) < 1e-6
    assert newton.newton_logistic(frame(spark, x, y), 2, 1.0, steps=1)[0] is None


def plain_lloyd(x, centres, iterations):
    for step in range(iterations):
        near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        after = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        moved, centres = np.abs(after - centres).max(), after
        if moved <= starts.REST:
            break
    return centres, ((x[:, None] - centres) ** 2).sum(2).min(1).sum()


def test_all_starts_at_once_as_one_by_one(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(m, 1, (40, 2)) for m in ((0, 0), (6, 0), (0, 7), (6, 7))])
    rows = frame(spark, x, np.zeros(len(x))).select("x", F.xxhash64("x").alias("key"))
    first = starts.first_centres(rows, 4, 10, 42)
    known = {tuple(r) for r in x.tolist()}
    assert all(tuple(c) in known for s in first.tolist() for c in s) and all(len({tuple(c) for c in s}) == 4 for s in first.tolist())
    assert (starts.first_centres(rows.repartition(5), 4, 10, 42) == first).all()
    centres, cost, iterations, sizes = starts.best_of_starts(rows, 4, 10, 300, 42)
    plain = [plain_lloyd(x, c, 300) for c in first]
    assert math.isclose(cost, min(c for _, c in plain), rel_tol=1e-9) and sum(sizes) == len(x) and iterations > 1
    # a fixed point: every centre is the mean of its rows
    found = rows.withColumn("c", nearest(F.col("x"), centres.tolist())).collect()
    for c in range(4):
        assert np.allclose(np.mean([r.x for r in found if r.c == c], axis=0), centres[c], atol=1e-5)


def test_passes_over_blocks_of_rows(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(500, 3))
    rows = frame(spark, x, np.zeros(len(x))).select("x", F.xxhash64("x").alias("key"))
    blocks = starts.blocks(rows)
    assert starts.blocks(blocks) is blocks and blocks.count() == 3  # one a task
    read = np.concatenate([a for a, _ in starts.opened(blocks.toArrow().to_batches())])
    assert sorted(map(tuple, read)) == sorted(map(tuple, x))
    centres = x[:14].reshape(7, 2, 3)
    monkeypatch.setattr(starts, "CENTRES", 4)  # not all starts at once
    far = ((x[:, None, None] - centres) ** 2).sum(3)
    want = [[[(far[:, s].argmin(1) == c).sum(), *x[far[:, s].argmin(1) == c].sum(0)] for c in range(2)] for s in range(7)]
    found = starts.sums(blocks, centres)
    assert np.allclose(found[:, :, [0, 2, 3, 4]], want) and np.allclose(found[:, :, 1].sum(1), far.min(2).sum(0))


def test_starts_with_fewer_different_rows_than_groups(spark):
    rows = frame(spark, [[1.0], [1.0], [2.0]], [0, 0, 0]).select("x", F.xxhash64("x").alias("key"))
    assert 0 in starts.best_of_starts(rows, 3, 4, 50, 1)[3]


def test_local_descent_on_one_task_is_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(k, *map(float, rng.normal(size=2)), k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    model = descent.LocalLogistic(0.1, 3, tasks=1).fit(df, "id", ["a", "b"], "y")
    theta, order = np.zeros(3), [r.id for r in df.orderBy(row_hash(F.col("id"))).collect()]
    for _ in range(3):
        for k in order:
            x = np.array([1.0, rows[k][1], rows[k][2]])
            theta = theta - 0.1 * (1 / (1 + math.exp(-(x @ theta))) - rows[k][3]) * x
    assert np.allclose(model.theta, theta, atol=1e-12) and len(model.loss_history) == 3
    clear = spark.createDataFrame([(k, k / 20 - 2, int(k >= 40)) for k in range(80)], "id int, a double, y int")
    spread = descent.LocalLogistic(0.2, 12, tasks=4).fit(clear, "id", ["a"], "y")
    assert all(a > b for a, b in zip(spread.loss_history, spread.loss_history[1:]))
    assert spread.predict(clear).where("prediction = y").count() >= 74
    with pytest.raises(ValueError):
        descent.LocalLogistic().fit(clear.selectExpr("id", "a", "y + 1 AS y"), "id", ["a"], "y")


def test_gates_and_cluster_summary(spark):
    schema = "label double, prediction double"
    assert {r.code: r.rows for r in evaluate.evaluation_gates(spark.createDataFrame([], schema)).collect()}["EMPTY"] == 1
    evaluate.require_evaluable(spark.createDataFrame([(1.0, 2.0)], schema))
    for row, code in (((None, 1.0), "MISSING"), ((1.0, float("nan")), "NOT_FINITE"), ((1e300, -1e300), "OVERFLOW")):
        with pytest.raises(ValueError, match=code):
            evaluate.require_evaluable(spark.createDataFrame([(1.0, 2.0), row], schema))
    prep = preprocess.Preprocessor((preprocess.NumberState("c0", 0.0, 10.0, 2.0, label="width"),), (), True)
    state = {"centers": [[-1.0], [3.0], [9.0]], "inertia": 2.5, "iterations": 4}
    assigned = spark.createDataFrame([(0,), (0,), (1,)], "cluster int")
    got = {r.cluster: (r.name, r.center, r.n, r.inertia, r.iterations) for r in evaluate.cluster_summary(assigned, prep, state).collect()}
    assert got == {0: ("width", 8.0, 2, 2.5, 4), 1: ("width", 16.0, 1, 2.5, 4), 2: ("width", 28.0, 0, 2.5, 4)}


def test_sketches_merge_to_that_of_the_whole(spark):
    rows = spark.range(30000).select((F.col("id") % 7).alias("part"), (F.col("id") % 9001).cast("string").alias("a"), F.when(F.col("id") % 3 > 0, "x").alias("b"))
    whole = {r.name: r for r in sketches.estimates(sketches.column_sketches(rows, ["a", "b"])).collect()}
    parts = {r.name: r for r in sketches.estimates(sketches.merged(sketches.column_sketches(rows, ["a", "b"], "part"))).collect()}
    assert whole == parts and abs(whole["a"].distinct_estimate - 9001) < 450
    assert (whole["b"].rows, whole["b"].missing, whole["b"].distinct_estimate) == (30000, 10000, 1)


def test_forest_work_follows_the_cells_and_not_the_rows(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 6, 300), rng.integers(0, 4, 300)]).astype(float)
    y = 10 * x[:, 0] + np.where(x[:, 1] > 1, 1000, 0)
    rows = frame(spark, x, y)
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("copy")
    edges = forest.bin_edges(rows.select("x"))
    assert edges == [[0.5, 1.5, 2.5, 3.5, 4.5], [0.5, 1.5, 2.5]]
    few, same = (forest.cells_of(r.withColumn("y", F.col("y").cast("double")), edges) for r in (rows, many))
    assert few.count() == same.count() and same.agg(F.sum("copies")).first()[0] == 40 * 300
    state = forest.fit_forest(many, 20, 12, 2, seed=1)
    assert state == forest.fit_forest(many.repartition(7), 20, 12, 2, seed=1)
    found = rows.select("y", forest.predicted(F.col("x"), state).alias("p")).collect()
    assert all(abs(r.p - r.y) < 1e-6 for r in found)  # every cell has copies enough to be drawn for each tree
    model = fit_model("regression.forest", vectors(many), seed=1)
    assert model.ml is None and len(model.state["roots"]) == 100


def vectors(rows):
    from pyspark.ml.functions import array_to_vector

    return rows.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))


def test_forest_draws_are_poisson_and_its_first_split_is_the_best(spark):
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 4000)
    for n in (1, 7, 5000):
        got = forest.drawn(keys, np.full(4000, n), 50, 9)
        assert abs(got.mean() - n) < 5 * math.sqrt(n / got.size) and abs(got.var() / n - 1) < 0.03
        assert abs(np.corrcoef(got[:, 0], got[:, 1])[0, 1]) < 0.08
    rng = np.random.default_rng(2)
    codes, n, mean = rng.integers(0, 9, (60, 3)).astype(np.uint8), rng.integers(1, 5, 60).astype(float), rng.normal(size=60)
    node = forest.grown(codes, np.column_stack([n, n * mean]), 0, [9, 9, 9], 1, 2, 3, 0)[0]

    def spread_of(at):
        m = np.average(mean[at], weights=n[at])
        return (n[at] * (mean[at] - m) ** 2).sum()

    splits = {(i, k): spread_of(codes[:, i] <= k) + spread_of(codes[:, i] > k) for i in range(3) for k in range(8) if 2 <= n[codes[:, i] <= k].sum() <= n.sum() - 2}
    assert (node[0], node[1]) == min(splits, key=splits.get)
    share = forest.grown(codes, np.column_stack([n * (codes[:, 1] > 4), n * (codes[:, 1] <= 4)]), 2, [9, 9, 9], 5, 2, 3, 0)
    assert share[0][:2] == [1, 4] and len(share) == 3


def test_forest_over_many_cells_goes_to_the_row_solver(spark, monkeypatch):
    monkeypatch.setattr(forest, "CELLS", 5)
    rows = vectors(frame(spark, np.arange(30.0)[:, None], np.arange(30) >= 15))
    model = fit_model("classification.forest", rows.withColumn("label", F.col("label").cast("int").cast("string")), labels=("0", "1"))
    assert model.ml is not None and {r.prediction for r in model.apply(rows).collect()} == {"0", "1"}
