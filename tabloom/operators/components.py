"""Principal components from the covariance matrix."""

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import functions as F

from tabloom.functions.names import col
from tabloom.operators.lloyd import require_finite

# Up to this many columns, all pairs fit one aggregation; wider tables use vector sums.
NARROW = 24


def covariance_rows(df, columns):
    """Sample covariance of every pair of columns, one row per pair, from one aggregation."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = df.agg(*[
        F.covar_samp(col(columns[i]).cast("double"), col(columns[j]).cast("double")).alias(f"c{i}_{j}") for i, j in pairs
    ])
    rows = [
        F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"c{i}_{j}").alias("covariance"))
        for i, j in pairs
    ]
    return sums.select(F.inline(F.array(*rows)))


def means_and_covariance(df, columns):
    """Column means and covariance matrix as small arrays."""
    k = len(columns)
    if k <= NARROW:
        matrix = np.zeros((k, k))
        place = {c: i for i, c in enumerate(columns)}
        for r in covariance_rows(df, columns).collect():
            matrix[place[r["a"]], place[r["b"]]] = matrix[place[r["b"]], place[r["a"]]] = r["covariance"]
        means = df.agg(*[F.avg(col(c).cast("double")) for c in columns]).first()
        return np.array(list(means), dtype=float), matrix
    vectors = df.select(array_to_vector(F.array(*[col(c).cast("double") for c in columns])).alias("v"))
    return vector_covariance(vectors, "v")


def vector_covariance(df, features):
    """The same for a vector column: correlations scaled by the deviations.

    A constant entry has no correlation and zero covariance.
    """
    stats = df.select(Summarizer.metrics("mean", "std").summary(F.col(features)).alias("s")).select("s.mean", "s.std").first()
    deviation = stats["std"].toArray()
    correlation = np.nan_to_num(Correlation.corr(df, features).first()[0].toArray(), nan=0.0)
    np.fill_diagonal(correlation, 1.0)
    return stats["mean"].toArray(), correlation * np.outer(deviation, deviation)


def principal_axes(matrix, k):
    """Leading axes and variances. Each axis is signed so that its largest entry is positive."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:k]
    axes = vectors[:, order]
    largest = axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]
    return axes * np.where(largest < 0, -1.0, 1.0), values[order]


def scores(df, columns, means, axes, prefix="pc"):
    """(x - mean) times each axis, as plain column arithmetic."""
    exprs = {}
    for k in range(axes.shape[1]):
        total = F.lit(0.0)
        for name, mean, weight in zip(columns, means, axes[:, k]):
            total = total + (col(name) - F.lit(float(mean))) * F.lit(float(weight))
        exprs[f"{prefix}{k + 1}"] = total
    return df.withColumns(exprs)


def reconstruct(scored, columns, means, axes, prefix="pc", suffix="_back"):
    """Back from scores to the original columns."""
    exprs = {}
    for i, name in enumerate(columns):
        total = F.lit(float(means[i]))
        for k in range(axes.shape[1]):
            total = total + F.col(f"{prefix}{k + 1}") * F.lit(float(axes[i, k]))
        exprs[name + suffix] = total
    return scored.withColumns(exprs)


def reconstruction_error(df, columns, suffix="_back"):
    """Mean squared error over all cells."""
    total = F.lit(0.0)
    for name in columns:
        gap = col(name) - col(name + suffix)
        total = total + gap * gap
    return df.agg((F.avg(total) / len(columns)).alias("reconstruction_mse"))


@dataclass
class CovariancePCA:
    n_components: int
    columns: list = field(default=None, init=False)
    means: np.ndarray = field(default=None, init=False)
    components: np.ndarray = field(default=None, init=False)
    variances: np.ndarray = field(default=None, init=False)

    def __post_init__(self):
        if type(self.n_components) is not int or self.n_components < 1:
            raise ValueError("n_components is a positive integer")

    def fit(self, df, columns):
        if require_finite(df, columns) < 2:
            raise ValueError("Two rows or more are needed")
        if self.n_components > len(columns):
            raise ValueError("There are fewer columns than components")
        self.columns = list(columns)
        self.means, matrix = means_and_covariance(df, self.columns)
        self.components, self.variances = principal_axes(matrix, self.n_components)
        return self

    def transform(self, df):
        self._require_fit(df)
        return scores(df, self.columns, self.means, self.components)

    def inverse_transform(self, scored, suffix="_back"):
        if self.means is None:
            raise RuntimeError("Fit first")
        if not {f"pc{k + 1}" for k in range(self.n_components)} <= set(scored.columns):
            raise ValueError("The score columns are missing")
        return reconstruct(scored, self.columns, self.means, self.components, suffix=suffix)

    def _require_fit(self, df):
        if self.means is None:
            raise RuntimeError("Fit first")
        if not set(self.columns) <= set(df.columns):
            raise ValueError("The fitted columns are missing")
