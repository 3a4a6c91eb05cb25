"""Holdout metrics, baselines and diagnostics as aggregates over scored rows."""

from pyspark.sql import functions as F

from tabloom.contracts import Metric
from tabloom.errors import TableError
from tabloom.operators.eligibility import MAX_CLASSES


def evaluation_error():
    return TableError("EVALUATION", "The candidate gave values that cannot be evaluated.", "Try another model.")


# Classification. Everything follows from two small counts: training rows per label and
# test rows per (label, prediction).

def label_counts(train, label="label"):
    return train.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def _bounded_labels(labels, most):
    """All training labels in one row; more than `most` is an error, None allows any number."""
    if most is None:
        return labels.agg(F.sort_array(F.collect_list("label")).alias("labels"))
    bounded = labels.limit(most + 1).agg(F.sort_array(F.collect_list("label")).alias("labels"))
    return bounded.select(
        F.when(F.size("labels") <= most, F.col("labels"))
        .otherwise(F.raise_error(F.lit("EVALUATION: too many classes")).cast("array<string>"))
        .alias("labels")
    )


def pair_counts(scored, label="label", prediction="prediction"):
    return scored.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(pairs, labels, most_labels=MAX_CLASSES):
    """One row per (label, prediction) over all training labels, zeros filled in.

    The result has the square of the number of labels; over `most_labels` of them (None: no limit) is an error.
    """
    grid = (
        _bounded_labels(labels, most_labels)
        .select(F.explode("labels").alias("label"), "labels")
        .select("label", F.explode("labels").alias("prediction"))
    )
    return grid.join(pairs, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).alias("n")
    )


def per_class(pairs, labels):
    """Precision, recall, F1 and support per training label; undefined ratios are zero."""
    c = F.col
    sides = pairs.select(
        F.explode(F.array(
            F.struct(c("label").alias("label"), c("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                     F.when(c("label") == c("prediction"), c("n")).otherwise(0).alias("hits")),
            F.struct(c("prediction").alias("label"), F.lit(0).cast("bigint").alias("support"), c("n").alias("predicted"),
                     F.lit(0).cast("bigint").alias("hits")),
        )).alias("s")
    ).select("s.*")
    totals = sides.groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    filled = labels.select("label").join(totals, "label", "left").fillna(0, ["support", "predicted", "hits"])

    def ratio(top, bottom):
        return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)

    return filled.select(
        "label",
        ratio(c("hits"), c("predicted")).alias("precision"),
        ratio(c("hits"), c("support")).alias("recall"),
        ratio(2 * c("hits"), c("support") + c("predicted")).alias("f1"),
        "support",
    )


def classification_metrics(pairs, labels):
    """Accuracy and macro F1; the mean of F1 runs over all training labels."""
    rows = per_class(pairs, labels)
    hits = pairs.agg(
        (F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"),
        F.lit(1).alias("one"),
    )
    macro = rows.agg(F.avg("f1").alias("macro_f1"), F.lit(1).alias("one"))
    return hits.join(macro, "one").select("accuracy", "macro_f1")


def class_counts(split_df, label="label"):
    return split_df.groupBy("split", F.col(label).alias("label")).agg(F.count("*").alias("n"))


def majority_label(labels):
    """The most frequent training label; the smallest text among equals."""
    return labels.orderBy(F.desc("n"), "label").limit(1)


def majority_baseline(pairs, labels):
    """Scores of always answering the majority label."""
    top = majority_label(labels).select(F.col("label").alias("majority"), F.lit(1).alias("one"))
    answered = (
        pairs.groupBy("label").agg(F.sum("n").alias("n"), F.lit(1).alias("one"))
        .join(F.broadcast(top), "one")
        .select("label", F.col("majority").alias("prediction"), "n")
    )
    scores = classification_metrics(answered, labels).withColumn("one", F.lit(1))
    return scores.join(top, "one").select(F.col("majority").alias("label"), "accuracy", "macro_f1")


def unknown_labels(scored, labels, column="prediction"):
    """Values of a column that are no training label, with their rows counted."""
    seen = scored.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return seen.join(labels.select("label"), "label", "left_anti")


# Regression.

def regression_metrics(scored, label="label", prediction="prediction"):
    """MAE, RMSE and R2 in one pass; R2 is null for a single row or a constant target."""
    y = F.col(label).cast("double")
    error = y - F.col(prediction)
    sums = scored.agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.sum(error * error).alias("squared"),
        F.var_pop(y).alias("variance"),
        F.min(y).alias("low"),
        F.max(y).alias("high"),
    )
    defined = (F.col("n") >= 2) & (F.col("low") < F.col("high"))
    return sums.select(
        "mae",
        "rmse",
        F.when(defined, 1 - F.col("squared") / (F.col("variance") * F.col("n"))).alias("r2"),
        F.when(~defined, "R2 needs a varying target in two test rows or more.").alias("r2_reason"),
    )


def residual_summary(scored, label="label", prediction="prediction"):
    error = F.col(label) - F.col(prediction)
    return scored.agg(
        F.count("*").alias("count"), F.avg(error).alias("mean"), F.min(error).alias("minimum"), F.max(error).alias("maximum")
    )


def mean_baseline(train, test, label="label"):
    """Scores of always answering the mean of the training target."""
    mean = train.agg(F.avg(F.col(label))).first()[0]
    scored = test.withColumn("__mean", F.lit(mean))
    return regression_metrics(scored, label, "__mean").select(F.lit(mean).alias("mean"), "mae", "rmse", "r2")


def evaluation_gates(scored, label="label", prediction="prediction"):
    """One row per rule that scored numbers must keep: code and the rows that break it; EMPTY counts one if there are no rows.

    MISSING: label or prediction is null; NOT_FINITE: one of them is no finite number; OVERFLOW: both are finite, but not
    the square of their difference.
    """
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")

    def finite(c):
        return F.abs(c) < float("inf")

    gap = y - p
    rules = {
        "EMPTY": F.when(F.count("*") == 0, 1).otherwise(0), "MISSING": F.count_if(y.isNull() | p.isNull()),
        "NOT_FINITE": F.count_if(~finite(y) | ~finite(p)), "OVERFLOW": F.count_if(finite(y) & finite(p) & ~finite(gap * gap)),
    }
    row = scored.agg(*[c.cast("bigint").alias(k) for k, c in rules.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("code"), F.col(k).alias("rows")) for k in rules])))


def require_evaluable(scored, label="label", prediction="prediction"):
    """Fail with the first gate that some row does not pass."""
    broken = [r["code"] for r in evaluation_gates(scored, label, prediction).collect() if r["rows"]]
    if broken:
        raise TableError("EVALUATION", f"The scored rows cannot be evaluated: {', '.join(broken)}.", "Try another model.")


# Clustering.

def equal_width(df, features="features"):
    """Length shared by all arrays of a column; null arrays or different lengths are an error.

    Returns None for an empty table.
    """
    size = F.coalesce(F.when(F.col(features).isNotNull(), F.size(features)), F.lit(-1))
    low, high = df.agg(F.min(size), F.max(size)).first()
    if low is not None and (low != high or low < 0):
        raise TableError("EVALUATION", "Some vectors are missing or differ in length.", "Give vectors of one length.")
    return low


def silhouette(df, cluster="prediction", features="features", max_clusters=1_000):
    """Mean silhouette width on squared Euclidean distances, over all rows.

    The mean squared distance of a row to a cluster is its squared distance to the centre
    plus the cluster's own variance, so no pairs of rows are needed: one aggregation per
    cluster and dimension, then one projection. A row alone in its cluster, or without
    any distance, scores zero. The result is null with a reason where it is not defined.
    Centres travel whole, at most `max_clusters` of them; more is an error.
    """
    rows = df.select(F.col(cluster).alias("c"), F.col(features).alias("x"))
    equal_width(rows, "x")
    found = rows.groupBy("c").agg(F.count("*").alias("n")).agg(F.count("*"), F.sum("n")).first()
    clusters, total = found[0], found[1] or 0
    if clusters < 2 or clusters == total:
        reason = "Silhouette needs two groups or more, and fewer groups than rows."
        return df.sparkSession.createDataFrame(
            [(None, total, reason)], "silhouette double, silhouette_rows bigint, reason string"
        )
    if clusters > max_clusters:
        raise TableError("EVALUATION", f"More than {max_clusters} clusters.", "Raise the limit or use fewer clusters.")
    entries = rows.select("c", F.posexplode("x").alias("i", "v")).groupBy("c", "i").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance")
    )
    centres = entries.groupBy("c").agg(
        F.max("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("i", "mean"))).alias("means"),
        F.sum("variance").alias("variance"),
    )
    known = centres.agg(F.collect_list(F.struct("c", "n", F.col("means.mean").alias("means"), "variance")).alias("known"))

    def squares(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)

    far = F.transform("known", lambda k: F.struct(
        k["c"].eqNullSafe(F.col("c")).alias("own"), k["n"].alias("n"), (squares(F.col("x"), k["means"]) + k["variance"]).alias("d")
    ))
    size = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    placed = rows.crossJoin(F.broadcast(known)).select(far.alias("far"), size.alias("size"))  # joins one row
    own = F.filter("far", lambda k: k["own"])[0]
    sides = placed.select(
        "size", own["n"].alias("n"), (own["d"] * own["n"] / F.greatest(own["n"] - 1, F.lit(1))).alias("a"),
        F.array_min(F.transform(F.filter("far", lambda k: ~k["own"]), lambda k: k["d"])).alias("b"),
    )
    most = F.greatest("a", "b")
    # Rounding leaves equal points a trace apart.
    width = F.when((F.col("n") == 1) | (most <= 1e-24 * F.col("size")), 0.0).otherwise((F.col("b") - F.col("a")) / most)
    return sides.agg(
        F.avg(width).alias("silhouette"), F.count("*").alias("silhouette_rows"), F.lit(None).cast("string").alias("reason")
    )


def cluster_sizes(df, cluster="prediction"):
    return df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))


def cluster_summary(assigned, prep, state, cluster="cluster"):
    """One row per cluster and input: n, name, center in the input's own units, and the fit's inertia and iterations."""
    rows = []
    for c, center in enumerate(state["centers"]):
        for number, value in zip(prep.numbers, center):
            own = value * number.deviation + number.mean if prep.scale else value
            rows.append((c, number.shown, float(own), float(state["inertia"]), int(state["iterations"])))
        rows += [(c, n, float(v), float(state["inertia"]), int(state["iterations"]))
                 for n, v in zip(prep.feature_names[len(prep.numbers):], center[len(prep.numbers):])]
    centers = assigned.sparkSession.createDataFrame(rows, "cluster int, name string, center double, inertia double, iterations int")
    return centers.join(cluster_sizes(assigned, cluster), "cluster", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def metric(key, value, reason=None):
    return Metric(key, None if value is None else float(value), reason)
