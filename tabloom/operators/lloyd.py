"""Lloyd's K-Means as repeated aggregations over a DataFrame.

Between steps only the centroids, k rows of numbers, pass through the driver. They go
back into the next step as literals, so the plan never grows.
"""

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import functions as F

from tabloom.contracts import SEED
from tabloom.errors import TableError
from tabloom.functions.names import col
from tabloom.operators.rows import row_hash, spread
from tabloom.operators.selection import smallest_rows


NUMERIC = ("double", "float", "integer", "long", "short", "byte", "decimal")


def require_numeric(df, columns):
    if not columns:
        raise TableError("INPUT", "At least one numeric column is needed.")
    for name in columns:
        if df.schema[name].dataType.typeName() not in NUMERIC:
            raise TableError("INPUT", "All columns must be numeric.", column=name)


def require_finite(df, columns):
    """Fail unless the table has rows and every value is a finite number."""
    require_numeric(df, columns)
    good = F.lit(True)
    for name in columns:
        good = good & F.coalesce(F.abs(col(name).cast("double")) < float("inf"), F.lit(False))
    row = df.agg(F.count("*").alias("n"), F.bool_and(good).alias("finite")).first()
    if not row["n"]:
        raise TableError("INPUT", "At least one row is needed.")
    if not row["finite"]:
        raise TableError("INPUT", "All values must be finite.")
    return row["n"]


def squared_distance(columns, centroid):
    total = F.lit(0.0)
    for name, value in zip(columns, centroid):
        gap = col(name) - F.lit(float(value))
        total = total + gap * gap
    return total


def assign(df, columns, centroids, output="cluster", cost="squared_distance"):
    """Nearest centroid per row, the first one on ties, and the squared distance to it."""
    distances = df.withColumn("__d", F.array(*[squared_distance(columns, c) for c in centroids]))
    return (
        distances.withColumn(cost, F.array_min("__d"))
        .withColumn(output, (F.array_position("__d", F.col(cost)) - 1).cast("int"))
        .drop("__d")
    )


def update(assigned, columns, cluster="cluster"):
    """Mean per cluster; at most k rows come out."""
    return assigned.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)])


def total_cost(assigned, cost="squared_distance"):
    return assigned.agg(F.sum(cost).alias("cost"))


def start_rows(df, row_id, columns, k, seed=SEED):
    """k rows as first centroids: the first ones in seeded hash order."""
    digest = row_hash(col(row_id), seed)
    rows = smallest_rows(df, digest, k).select(digest.alias("__h"), *[col(c) for c in columns]).collect()
    return [[float(v) for v in list(r)[1:]] for r in sorted(rows, key=lambda r: r["__h"])]


@dataclass
class LloydKMeans:
    n_clusters: int = 8
    max_iter: int = 300
    seed: int = SEED
    centroids: list = field(default=None, init=False)
    centroids_history: list = field(default_factory=list, init=False)
    costs: list = field(default_factory=list, init=False)
    columns: list = field(default=None, init=False)
    n_iter: int = field(default=0, init=False)

    def __post_init__(self):
        if type(self.n_clusters) is not int or self.n_clusters < 1:
            raise ValueError("n_clusters is a positive integer")
        if type(self.max_iter) is not int or self.max_iter < 1:
            raise ValueError("max_iter is a positive integer")

    def fit(self, df, row_id, columns, start=None):
        self.columns = list(columns)
        require_numeric(df, self.columns)
        data = spread(df.select(col(row_id).alias("__id"), *[col(c).cast("double").alias(c) for c in columns])).persist()
        try:
            if self.n_clusters > require_finite(data, self.columns):
                raise ValueError("There are fewer rows than clusters")
            self.centroids = start or start_rows(data, "__id", self.columns, self.n_clusters, self.seed)
            self.centroids_history, self.costs, self.n_iter = [], [], 0
            for step in range(self.max_iter):
                before = self.centroids
                self.centroids = self._step(data, before)
                cost = total_cost(assign(data, self.columns, self.centroids)).first()["cost"]
                self.centroids_history.append(self.centroids)
                self.costs.append(cost)
                self.n_iter = step + 1
                if np.allclose(before, self.centroids):
                    break
        finally:
            data.unpersist()
        return self

    def _step(self, data, before):
        after = [list(c) for c in before]  # a cluster without rows stays where it is
        for row in update(assign(data, self.columns, before), self.columns).collect():
            after[row["cluster"]] = [row[f"m{i}"] for i in range(len(self.columns))]
        return after

    def predict(self, df, output="cluster"):
        self._require_fit(df)
        return assign(df, self.columns, self.centroids, output).drop("squared_distance")

    def labels_at(self, df, iteration):
        """Assignments after one of the fitted iterations, worked out when asked for."""
        self._require_fit(df)
        return assign(df, self.columns, self.centroids_history[iteration]).drop("squared_distance")

    def cost(self, df):
        self._require_fit(df)
        return total_cost(assign(df, self.columns, self.centroids)).first()["cost"]

    def _require_fit(self, df):
        if self.centroids is None:
            raise RuntimeError("Fit first")
        if not set(self.columns) <= set(df.columns):
            raise ValueError("The fitted columns are missing")
