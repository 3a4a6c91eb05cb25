import math
import random

import pytest
from pyspark.sql import functions as F

from tabloom.contracts import Candidate, Metric
from tabloom.errors import TableError
from tabloom.operators import evaluate as ev
from tabloom.operators.ranking import rank_candidates


def sides(spark, train, truth, predicted):
    labels = ev.label_counts(spark.createDataFrame([(t,) for t in train], "label string"))
    scored = spark.createDataFrame(list(zip(truth, predicted)), "label string, prediction string")
    return ev.pair_counts(scored), labels


def test_classification(spark):
    pairs, labels = sides(spark, "baba", "aabb", "abbb")
    row = ev.classification_metrics(pairs, labels).first()
    assert row["accuracy"] == 0.75 and row["macro_f1"] == pytest.approx((2 / 3 + 4 / 5) / 2)
    grid = {(r["label"], r["prediction"]): r["n"] for r in ev.confusion_matrix(pairs, labels).collect()}
    assert grid == {("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 2}
    base = ev.majority_baseline(pairs, labels).first()
    assert (base["label"], base["accuracy"]) == ("a", 0.5) and base["macro_f1"] == pytest.approx(1 / 3)


def test_class_that_is_never_predicted(spark):
    pairs, labels = sides(spark, "aab", "ab", "aa")
    assert ev.classification_metrics(pairs, labels).first()["macro_f1"] == pytest.approx(1 / 3)
    b = ev.per_class(pairs, labels).where("label = 'b'").first()
    assert (b["precision"], b["recall"], b["f1"], b["support"]) == (0.0, 0.0, 0.0, 1)
    strange = spark.createDataFrame([("a", "z")], "label string, prediction string")
    assert [r["label"] for r in ev.unknown_labels(strange, labels).collect()] == ["z"]


def test_regression(spark):
    scored = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], "label double, prediction double")
    row = ev.regression_metrics(scored).first()
    assert (row["mae"], row["rmse"], row["r2"], row["r2_reason"]) == (1.5, math.sqrt(2.5), -1.5, None)
    assert tuple(ev.residual_summary(scored).first()) == (2, -1.5, -2.0, -1.0)
    train = spark.createDataFrame([(2.0,), (4.0,)], "label double")
    base = ev.mean_baseline(train, scored).first()
    assert (base["mean"], base["mae"], base["rmse"], base["r2"]) == (3.0, 1.0, math.sqrt(2), -1.0)
    flat = spark.createDataFrame([(3.0, 3.0), (3.0, 3.0)], "label double, prediction double")
    row = ev.regression_metrics(flat).first()
    assert row["r2"] is None and row["r2_reason"] and row["mae"] == 0


def squared_silhouette(rows):
    """All pairs, as the definition says."""
    def mean(x, others):
        return sum(sum((p - q) ** 2 for p, q in zip(x, y)) for y in others) / len(others)

    widths = []
    for i, (x, c) in enumerate(rows):
        mates = [y for j, (y, d) in enumerate(rows) if d == c and j != i]
        if not mates:
            widths.append(0.0)
            continue
        a = mean(x, mates)
        b = min(mean(x, [y for y, d in rows if d == k]) for k in {d for _, d in rows} - {c})
        widths.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return sum(widths) / len(widths)


def test_silhouette_is_that_of_all_pairs(spark):
    rng = random.Random(5)
    rows = [([rng.gauss(3 * (i % 3), 1.5), rng.gauss(100, 2)], i % 3) for i in range(300)] + [([50.0, 1.0], 7)]
    df = spark.createDataFrame(rows, "features array<double>, prediction int").repartition(5)
    row = ev.silhouette(df).first()
    assert row["silhouette"] == pytest.approx(squared_silhouette(rows), abs=1e-9) and row["silhouette_rows"] == 301


def test_silhouette_of_many_rows_has_no_sample(spark):
    df = spark.range(25_000).selectExpr("array(id % 2 * 10.0D + id / 1e6D) AS features", "cast(id % 2 AS int) AS prediction")
    row = ev.silhouette(df).first()
    assert row["silhouette_rows"] == 25_000 and row["silhouette"] > 0.99


def test_silhouette_without_an_answer(spark):
    df = spark.createDataFrame([([0.1], 1), ([0.1], 1), ([0.1], 2), ([0.1], 2)], "features array<double>, prediction int")
    assert ev.silhouette(df).first()["silhouette"] == 0.0
    one = df.selectExpr("features", "0 AS prediction")
    each = df.selectExpr("features", "monotonically_increasing_id() AS prediction")
    for flat in (one, each, df.limit(0)):
        row = ev.silhouette(flat).first()
        assert row["silhouette"] is None and row["reason"]
    with pytest.raises(TableError):
        ev.silhouette(df, max_clusters=1)
    for ragged in ("if(prediction = 1, array(1.0D, 2.0D), features)", "if(prediction = 1, null, features)"):
        with pytest.raises(TableError):
            ev.silhouette(df.selectExpr(f"{ragged} AS features", "prediction"))


def test_ranking(spark):
    def done(model, f1, accuracy, status="completed", task="classification"):
        return Candidate(model, task, status, metrics=(Metric("macro_f1", f1), Metric("accuracy", accuracy)))

    candidates = [done("c", 0.5, 0.6), done("b", 0.5, 0.6), done("a", 0.5, 0.7), done("d", None, 0.9), done("e", 0.9, 0.9, "failed")]
    frame = spark.createDataFrame(
        [(c.model, c.task, c.status, c.metrics[1].value, c.metrics[0].value, None) for c in candidates],
        "model_id string, task string, status string, accuracy double, macro_f1 double, mae double",
    )
    rows = rank_candidates(frame).orderBy("rank").collect()
    assert [(r["model_id"], r["recommendation"]) for r in rows] == [("a", "BEST_ON_TEST"), ("b", None), ("c", None)]
    assert [r["recommendation"] for r in rank_candidates(frame.where("model_id = 'c'")).collect()] == ["ONLY_COMPLETED"]
    assert [r["recommendation"] for r in rank_candidates(frame.withColumn("task", F.lit("clustering"))).collect()] == [None] * 4


def test_too_many_classes_fail(spark):
    names = [str(i) for i in range(21)]
    pairs, labels = sides(spark, names, names, names)
    with pytest.raises(Exception, match="EVALUATION"):
        ev.confusion_matrix(pairs, labels).collect()
    assert isinstance(ev.evaluation_error(), TableError)


def test_number_of_classes_without_a_limit(spark):
    names = [f"k{k:02}" for k in range(23)]
    labels = spark.createDataFrame([(n, 1) for n in names], "label string, n long")
    pairs = spark.createDataFrame([("k00", "k22", 4)], "label string, prediction string, n long")
    grid = {(r["label"], r["prediction"]): r["n"] for r in ev.confusion_matrix(pairs, labels, most_labels=None).collect()}
    assert len(grid) == 23**2 and grid["k00", "k22"] == 4 and sum(grid.values()) == 4
