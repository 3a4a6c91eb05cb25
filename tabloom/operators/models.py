"""The six models. Each fit takes encoded rows and returns a small fitted record."""

import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.ml.classification import (
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import functions as F

from tabloom.contracts import SEED, Task
from tabloom.errors import TableError
from tabloom.operators import forest
from tabloom.operators.components import principal_axes, vector_covariance
from tabloom.operators.newton import NARROW, newton_logistic
from tabloom.operators.starts import best_of_starts

# The parameters of the models.
INVERSE_PENALTY = 1.0
LOGISTIC_ITERATIONS = 1_000
TREES = 100
DEPTH = 12
LEAF_ROWS = 2
KMEANS_STARTS = 10
KMEANS_ITERATIONS = 300

# Room for the statistics of the tree nodes grown in one pass; more room, fewer passes.
FOREST_MEMORY_MB = 1_024
PART_ROWS = 500_000
DEFAULT_GROUPS = 3
DEFAULT_COMPONENTS = 2

# A component below this share of all variance counts as absent. Eigenvalues of a
# covariance matrix carry rounding noise of about this size.
RANK_TOLERANCE = 1e-12


@dataclass(frozen=True)
class ModelSpec:
    id: str
    name: str
    task: Task
    scale: bool


MODELS = (
    ModelSpec("classification.logistic", "Logistic Regression", Task.CLASSIFICATION, True),
    ModelSpec("classification.forest", "Random Forest Classifier", Task.CLASSIFICATION, False),
    ModelSpec("regression.linear", "Linear Regression", Task.REGRESSION, True),
    ModelSpec("regression.forest", "Random Forest Regressor", Task.REGRESSION, False),
    ModelSpec("clustering.kmeans", "K-Means", Task.CLUSTERING, True),
    ModelSpec("reduction.pca", "PCA", Task.REDUCTION, True),
)


def model_spec(model_id):
    for spec in MODELS:
        if spec.id == model_id:
            return spec
    raise TableError("MODEL", "There is no such model.", "Choose an available model.")


def models_for(task):
    return tuple(m for m in MODELS if m.task == task)


@dataclass
class FittedModel:
    """`ml` is the fitted Spark model of a line, or of a forest over rows in too many cells; the others keep plain arrays in `state`."""

    id: str
    labels: tuple = ()
    ml: Any = None
    state: dict = field(default_factory=dict)
    notes: tuple = ()

    def apply(self, df, features="features"):
        """Append `prediction`, `cluster` or `components`."""
        task = model_spec(self.id).task
        if task == Task.REDUCTION:
            return df.withColumn("components", project(vector_to_array(features), self.state))
        if task == Task.CLUSTERING:
            return df.withColumn("cluster", nearest(vector_to_array(features), self.state["centers"]))
        names = F.array(*[F.lit(x) for x in self.labels])
        if "roots" in self.state:
            found = forest.predicted(vector_to_array(features), self.state)
            return df.withColumn("prediction", F.element_at(names, found.cast("int") + 1) if self.labels else found)
        if self.ml is None:
            return df.withColumn("prediction", F.element_at(names, most_likely(vector_to_array(features), self.state["weights"]) + 1))
        scored = self.ml.transform(df)
        if task == Task.CLASSIFICATION:
            scored = scored.withColumn("prediction", F.element_at(names, F.col("prediction").cast("int") + 1))
        return scored.drop("rawPrediction", "probability")


def _dot(x, weights):
    products = F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def project(x, state):
    """Scores of an encoded row on each axis."""
    axes = np.asarray(state["axes"])
    offset = np.asarray(state["means"]) @ axes
    return F.array(*[_dot(x, axes[:, k]) - F.lit(float(offset[k])) for k in range(axes.shape[1])])


def back_project(components, state):
    axes = np.asarray(state["axes"])
    return F.array(*[
        _dot(components, axes[i, :]) + F.lit(float(state["means"][i])) for i in range(axes.shape[0])
    ])


def most_likely(x, weights):
    """Number of the class with the largest score, the first among equals; one row of weights compares with a score of zero."""
    scores = [_dot(x, w[1:]) + F.lit(float(w[0])) for w in weights]
    scores = F.array(*([F.lit(0.0)] if len(scores) == 1 else []), *scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def nearest(x, centers):
    """Number of the nearest centre, the first among equals."""
    far = F.array(*[F.lit(float(np.dot(c, c))) - 2 * _dot(x, c) for c in centers])
    return (F.array_position(far, F.array_min(far)) - 1).cast("int")


def label_index(label, labels):
    """Position of a label in the ordered label list; at most twenty comparisons."""
    index = F.when(F.lit(False), F.lit(0.0))
    for i, name in enumerate(labels):
        index = index.when(label == name, F.lit(float(i)))
    return index


def fit_model(model_id, encoded, option=None, labels=(), seed=SEED):
    """Fit on training rows with columns `features` and, if supervised, `label`."""
    fit = {
        "classification.logistic": _logistic,
        "classification.forest": _classifier_forest,
        "regression.linear": _linear,
        "regression.forest": _regressor_forest,
        "clustering.kmeans": _kmeans,
        "reduction.pca": _pca,
    }[model_spec(model_id).id]
    return fit(encoded, option, tuple(labels), seed)


def _indexed(encoded, labels):
    return encoded.select("features", label_index(F.col("label"), labels).alias("label"))


def _logistic(encoded, option, labels, seed):
    rows = _indexed(encoded, labels)
    width = len(encoded.first()["features"]) + 1
    if (1 if len(labels) == 2 else len(labels)) * width <= NARROW:
        x = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"))
        weights, _ = newton_logistic(x, len(labels), 1.0 / INVERSE_PENALTY)
    else:
        # This estimator averages the loss over rows, hence the penalty is divided by them.
        model = LogisticRegression(
            regParam=1.0 / (INVERSE_PENALTY * rows.count()), elasticNetParam=0.0, standardization=False, maxIter=LOGISTIC_ITERATIONS,
        ).fit(rows)
        stopped = model.summary.totalIterations >= LOGISTIC_ITERATIONS
        weights = None if stopped else np.column_stack([model.interceptVector.toArray(), model.coefficientMatrix.toArray()])
    if weights is None:
        raise TableError("CONVERGENCE", "The candidate did not converge.", "Try another model.")
    return FittedModel("classification.logistic", labels, None, {"weights": weights.tolist()})


def _classifier_forest(encoded, option, labels, seed):
    rows = _indexed(encoded, labels)
    tried = math.ceil(math.sqrt(encoded.first()["features"].size))
    state = forest.fit_forest(_arrays(rows), TREES, DEPTH, LEAF_ROWS, len(labels), tried, seed)
    if state is not None:
        return FittedModel("classification.forest", labels, None, state)
    model = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAF_ROWS, seed=seed, featureSubsetStrategy="sqrt", maxMemoryInMB=FOREST_MEMORY_MB,
    ).fit(_parted(rows))
    return FittedModel("classification.forest", labels, model)


def _arrays(rows):
    return rows.select(vector_to_array("features").alias("x"), F.col("label").alias("y"))


def _parted(rows):
    """Parts of at most PART_ROWS rows: a tree ensemble keeps a number per row and tree of each part it reads."""
    parts = math.ceil(rows.count() / PART_ROWS)
    return rows if parts <= rows.rdd.getNumPartitions() else rows.repartition(parts)


def _numeric(encoded):
    return encoded.select("features", F.col("label").cast("double").alias("label"))


def _linear(encoded, option, labels, seed):
    model = LinearRegression(regParam=0.0, solver="normal").fit(_numeric(encoded))
    return FittedModel("regression.linear", (), model)


def _regressor_forest(encoded, option, labels, seed):
    rows = _numeric(encoded)
    state = forest.fit_forest(_arrays(rows), TREES, DEPTH, LEAF_ROWS, seed=seed)
    if state is not None:
        return FittedModel("regression.forest", (), None, state)
    model = RandomForestRegressor(
        numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAF_ROWS, seed=seed, featureSubsetStrategy="all", maxMemoryInMB=FOREST_MEMORY_MB,
    ).fit(_parted(rows))
    return FittedModel("regression.forest", (), model)


def _kmeans(encoded, option, labels, seed):
    k = DEFAULT_GROUPS if option is None else option
    x = vector_to_array("features")
    data = encoded.select(x.alias("x"), F.xxhash64(x).alias("key"))
    centers, inertia, iterations, sizes = best_of_starts(data, k, KMEANS_STARTS, KMEANS_ITERATIONS, seed)
    if not all(sizes):
        raise TableError("CLUSTERS", "Fewer groups were formed than requested.", "Choose fewer groups.")
    return FittedModel("clustering.kmeans", (), None, {"inertia": inertia, "iterations": iterations, "centers": centers.tolist()})


def _pca(encoded, option, labels, seed):
    k = DEFAULT_COMPONENTS if option is None else option
    means, matrix = vector_covariance(encoded, "features")
    total = float(np.trace(matrix))
    if not total > 0:
        raise TableError("PCA_VARIANCE", "The inputs have no variance.", "Choose other inputs.")
    axes, variances = principal_axes(matrix, k)
    variances = np.maximum(variances, 0.0)
    notes = ("PCA_RANK_DEFICIENT",) if (variances <= RANK_TOLERANCE * total).any() else ()
    state = {"means": means.tolist(), "axes": axes.tolist(), "variances": variances.tolist(),
             "ratios": (variances / total).tolist()}
    return FittedModel("reduction.pca", (), None, state, notes)


LOADERS = {
    "classification.forest": RandomForestClassificationModel,
    "regression.linear": LinearRegressionModel,
    "regression.forest": RandomForestRegressionModel,
}
