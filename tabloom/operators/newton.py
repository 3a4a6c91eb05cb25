"""Multinomial logistic regression by Newton steps.

Each step is one aggregation: every task sums loss, gradient and second derivatives of its rows, and the driver solves one
system of (classes x inputs) numbers. A step that does not lower the loss is halved. Two classes have one weight
vector, more have one each; weights carry the penalty, intercepts do not. Wide tables are for other solvers.
"""

import numpy as np
from pyspark.sql import functions as F

#: Unknowns up to which their square is summed and solved.
NARROW = 96
STEPS, GRADIENT = 50, 1e-9


def summed(parts, column="v"):
    """Sum of arrays of one length, entry by entry."""
    rows = parts.select(F.posexplode(column).alias("pos", "value")).groupBy("pos").agg(F.sum("value").alias("value")).collect()
    found = np.zeros(max((r.pos for r in rows), default=-1) + 1)
    for r in rows:
        found[r.pos] = r.value
    return found


def matrix(column):
    """Rows of an Arrow list column as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def derivatives(rows, weights, classes):
    """Rows, loss, gradient and second derivatives summed over (x array, class number) rows at some weights.

    `weights` has a row per score: the intercept first, then one number per input.
    """
    scores, width = weights.shape

    def add(batches):
        import pyarrow as pa

        total = 0.0
        for batch in batches:
            if not len(batch):
                continue
            x, y = matrix(batch.column("x")), batch.column("y").to_numpy().astype(int)
            x = np.column_stack([np.ones(len(x)), x])
            z = x @ weights.T
            full = np.column_stack([np.zeros(len(x)), z]) if scores < classes else z
            full = full - full.max(1, keepdims=True)
            p = np.exp(full)
            size = p.sum(1, keepdims=True)
            loss = (np.log(size[:, 0]) - full[np.arange(len(x)), y]).sum()
            p, hit = (p / size)[:, classes - scores :], (y[:, None] == np.arange(classes - scores, classes)).astype(float)
            gradient = (p - hit).T @ x
            second = np.empty((scores, width, scores, width))
            for a in range(scores):
                for b in range(a + 1):
                    curve = p[:, a] * ((a == b) - p[:, b])
                    second[a, :, b, :] = second[b, :, a, :] = x.T @ (x * curve[:, None])
            total = total + np.concatenate([[len(x), loss], gradient.ravel(), second.ravel()])
        if np.ndim(total):
            yield pa.RecordBatch.from_pydict({"v": [total]})

    found = summed(rows.select("x", "y").mapInArrow(add, "v array<double>"))
    n = scores * width
    return found[0], found[1], found[2 : 2 + n], found[2 + n :].reshape(n, n)


def newton_logistic(rows, classes, penalty, steps=STEPS):
    """(weights, steps taken) at the least loss plus penalty / 2 times the squared weights; weights is None without convergence.

    `rows` has x, an array, and y, the class number from 0.
    """
    scores, width = (1 if classes == 2 else classes), len(rows.first()["x"]) + 1
    free = np.tile(np.arange(width) > 0, scores).astype(float) * penalty
    weights, before, step = np.zeros((scores, width)), None, np.zeros(scores * width)
    for k in range(steps):
        n, loss, gradient, second = derivatives(rows, weights, classes)
        loss += (free * weights.ravel() ** 2).sum() / 2
        if before is not None and loss > before + 1e-12 * abs(before):
            step = step / 2
            weights = weights - step.reshape(weights.shape)  # back by half of what was left of the step
            continue
        before, gradient = loss, gradient + free * weights.ravel()
        if np.abs(gradient).max() <= GRADIENT * n:
            return weights, k
        # scores of more than two classes are free up to a common shift, hence the least solution
        step = -np.linalg.lstsq(second + np.diag(free), gradient, rcond=1e-13)[0]
        weights = weights + step.reshape(weights.shape)
    return None, steps
