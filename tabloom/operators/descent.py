"""Binary logistic regression by gradient descent.

Updating after every single row is sequential by nature. Here each epoch is one
aggregation over all rows and one update, which gives the same result on any cluster.
"""

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import functions as F

from tabloom.contracts import SEED
from tabloom.functions.names import col
from tabloom.operators.lloyd import require_finite, require_numeric
from tabloom.operators.newton import matrix, summed
from tabloom.operators.rows import row_hash, spread

# Bounds of the exponent and of the probabilities inside the loss.
EXPONENT_LIMIT = 500.0
PROBABILITY_FLOOR = 1e-15
THRESHOLD = 0.5


def probability(columns, weights, bias):
    z = F.lit(float(bias))
    for name, w in zip(columns, weights):
        z = z + col(name) * F.lit(float(w))
    z = F.greatest(F.lit(-EXPONENT_LIMIT), F.least(F.lit(EXPONENT_LIMIT), z))
    return 1.0 / (1.0 + F.exp(-z))


def log_loss(p, y):
    p = F.greatest(F.lit(PROBABILITY_FLOOR), F.least(F.lit(1.0 - PROBABILITY_FLOOR), p))
    return -F.avg(y * F.log(p) + (1.0 - y) * F.log(1.0 - p))


@dataclass
class GradientLogistic:
    """`reduction` says whether a step follows the mean or the sum of the row gradients.

    The mean keeps one learning rate valid for any number of rows; the sum moves as far
    as one pass of single-row updates does, to first order.
    """

    learning_rate: float = 0.01
    epochs: int = 10_000
    reduction: str = "mean"
    columns: list = field(default=None, init=False)
    weights: list = field(default=None, init=False)
    bias: float = field(default=None, init=False)
    loss_history: list = field(default_factory=list, init=False)

    def __post_init__(self):
        if self.learning_rate <= 0:
            raise ValueError("learning_rate is positive")
        if type(self.epochs) is not int or self.epochs < 1:
            raise ValueError("epochs is a positive integer")
        if self.reduction not in ("mean", "sum"):
            raise ValueError("reduction is mean or sum")

    def fit(self, df, columns, label):
        self.columns = list(columns)
        require_numeric(df, [*self.columns, label])
        y = col(label).cast("double")
        data = spread(df.select(y.alias("__y"), *[col(c).cast("double").alias(c) for c in columns])).persist()
        try:
            require_finite(data, self.columns)
            if not data.agg(F.bool_and(F.coalesce(F.col("__y").isin(0.0, 1.0), F.lit(False)))).first()[0]:
                raise ValueError("Labels are 0 and 1")
            theta = [0.0] * (len(self.columns) + 1)
            self.loss_history = []
            combine = F.avg if self.reduction == "mean" else F.sum
            # The loss after one step and the gradient of the next come from the same pass.
            for epoch in range(self.epochs + 1):
                p = probability(self.columns, theta[1:], theta[0])
                error = p - F.col("__y")
                parts = [combine(error)] + [combine(error * col(c)) for c in self.columns]
                row = data.agg(log_loss(p, F.col("__y")), *[g.alias(f"g{i}") for i, g in enumerate(parts)]).first()
                if epoch:
                    self.loss_history.append(row[0])
                if epoch < self.epochs:
                    theta = [t - self.learning_rate * g for t, g in zip(theta, list(row)[1:])]
        finally:
            data.unpersist()
        self.bias, self.weights = theta[0], theta[1:]
        return self

    def predict(self, df, output="prediction"):
        """Probability and class of every row; exactly one half counts as class one."""
        if self.weights is None:
            raise RuntimeError("Fit first")
        if not set(self.columns) <= set(df.columns):
            raise ValueError("The fitted columns are missing")
        p = probability(self.columns, self.weights, self.bias)
        return df.withColumn("probability", p).withColumn(output, (F.col("probability") >= THRESHOLD).cast("int"))


@dataclass
class LocalLogistic:
    """Logistic regression by an update per row, as fast as the cluster allows.

    The rows of each task are put in seeded order once. In an epoch every task goes through its rows from the same weights, one update
    each, and the weights that come out are averaged by rows. On one task this is plain stochastic descent.
    """

    learning_rate: float = 0.01
    epochs: int = 10
    seed: int = SEED
    tasks: int | None = None
    columns: list = field(default=None, init=False)
    theta: list = field(default=None, init=False)
    loss_history: list = field(default_factory=list, init=False)

    def fit(self, df, row_id, columns, label):
        self.columns = list(columns)
        require_numeric(df, [*self.columns, label])
        x = F.array(F.lit(1.0), *[col(c).cast("double") for c in columns])
        rows = df.select(x.alias("x"), col(label).cast("double").alias("y"), row_hash(col(row_id), self.seed).alias("order"))
        rows = rows.repartition(self.tasks, "order") if self.tasks else rows
        data = rows.sortWithinPartitions("order").select("x", "y").persist()
        try:
            if not data.agg(F.bool_and(F.col("y").isin(0.0, 1.0) & F.forall("x", lambda v: F.abs(v) < float("inf")))).first()[0]:
                raise ValueError("Labels are 0 and 1, inputs finite, and there are rows")
            self.theta, self.loss_history = np.zeros(len(self.columns) + 1), []
            for _ in range(self.epochs):
                found = summed(data.mapInArrow(self._epoch(self.theta.copy()), "v array<double>"))
                self.loss_history.append(found[1] / found[0])
                self.theta = found[2:] / found[0]
        finally:
            data.unpersist()
        return self

    def _epoch(self, start):
        rate = self.learning_rate

        def go(batches):
            import pyarrow as pa

            theta, n, loss = start.copy(), 0, 0.0
            for batch in batches:
                if not len(batch):
                    continue
                x, y = matrix(batch.column("x")), batch.column("y").to_numpy()
                p = 1 / (1 + np.exp(-np.clip(x @ start, -EXPONENT_LIMIT, EXPONENT_LIMIT)))  # the loss before this epoch
                p = np.clip(p, PROBABILITY_FLOOR, 1 - PROBABILITY_FLOOR)
                loss -= (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
                for row, target in zip(x, y):
                    z = min(max(float(row @ theta), -EXPONENT_LIMIT), EXPONENT_LIMIT)
                    theta -= rate * (1 / (1 + math.exp(-z)) - target) * row
                n += len(x)
            yield pa.RecordBatch.from_pydict({"v": [np.concatenate([[n, loss], theta * n])]})

        return go

    def predict(self, df, output="prediction"):
        """Probability and class of every row; exactly one half counts as class one."""
        if self.theta is None:
            raise RuntimeError("Fit first")
        p = probability(self.columns, self.theta[1:], self.theta[0])
        return df.withColumn("probability", p).withColumn(output, (F.col("probability") >= THRESHOLD).cast("int"))
