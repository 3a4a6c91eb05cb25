"""Random forests grown from sums per cell instead of rows.

Each input is cut into at most BINS bins, by all its values while they are few, else by quantiles of all rows. Rows with the
same bins form a cell. A tree needs no more of a bootstrap sample than its rows and sums of labels per cell: every row is
drawn Poisson(1) times per tree, hence n equal rows Poisson(n) times, by hashes of cell, label and tree. One aggregation makes
these sums for all trees at once; after it the work depends on the cells alone. Each tree is grown from its own cells, at
most CELLS of them; `cells_of` is None for tables with more, which are for other solvers.
"""

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from tabloom.operators.newton import matrix

BINS = 32
#: Most cells of a table, and sums that a task holds before it sends them on.
CELLS, HELD = 20_000, 2_000_000
#: A split must lower the impurity by more than this share of what parting all cells would.
LEAST_GAIN = 1e-12


def bin_edges(x):
    """Upper edges of the bins of each input of `x` (a column x of arrays), the last bin open."""
    width = len(x.first()["x"])

    def seen(batches):
        import pyarrow as pa

        values = [np.zeros(0)] * width
        for batch in batches:
            if len(batch):
                rows = matrix(batch.column("x"))
                for i in range(width):
                    if len(values[i]) <= BINS and not np.isin(rows[:, i], values[i]).all():
                        values[i] = np.union1d(values[i], rows[:, i])[: BINS + 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([v.tolist() for v in values], pa.list_(pa.float64()))], ["i", "v"]
        )

    merged = x.mapInArrow(seen, "i int, v array<double>").groupBy("i").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))).alias("v"))
    few = {r.i: r.v for r in merged.collect()}  # at most 33 values per task and input
    many = [i for i in range(width) if len(few[i]) > BINS]
    edges = [[(a + b) / 2 for a, b in zip(few[i], few[i][1:])] for i in range(width)]
    if many:
        at = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
        found = x.agg(*[F.percentile_approx(F.col("x")[i], at, 10_000).alias(str(i)) for i in many]).first()
        for i in many:
            edges[i] = sorted(set(found[str(i)]))
    return edges


def binned(x, edges):
    """Bins of rows: the number of edges below each value."""
    return np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def cells_of(rows, edges):
    """cell (its bins as bytes), y and copies of rows with x and y; None if there are more than CELLS cells."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                found = binned(matrix(batch.column("x")), edges)
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in found], pa.binary()), batch.column("y")], ["cell", "y"])

    grouped = rows.select("x", "y").mapInArrow(cut, "cell binary, y double").groupBy("cell", "y").agg(F.count("*").alias("copies"))
    grouped = grouped.withColumn("key", F.xxhash64("cell", "y")).persist()
    if grouped.select("cell").distinct().limit(CELLS + 1).count() > CELLS:
        grouped.unpersist()
        return None
    return grouped


@lru_cache(maxsize=1024)
def poisson(mean):
    """The least count and the distribution function from it on, up to where doubles end."""
    low, high = max(0, math.floor(mean - 12 * math.sqrt(mean))), math.ceil(mean + 12 * math.sqrt(mean) + 30)
    steps = np.cumsum(np.concatenate([[0.0], math.log(mean) - np.log(np.arange(low + 1, high + 1))]))
    share = np.exp(steps - steps.max())
    return low, np.cumsum(share) / share.sum()


def noise(keys, trees, seed):
    """Numbers in [0, 1) per key and tree."""
    salt = (np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed % 2**63 * 0xC2B2AE3D27D4EB4F % 2**64)
    z = keys.view(np.uint64)[:, None] + salt[None, :]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


def drawn(keys, copies, trees, seed):
    """How often the copies of each row are drawn for each tree."""
    out = noise(keys, trees, seed)
    for n in np.unique(copies):
        at = np.flatnonzero(copies == n)
        low, below = poisson(int(n))
        out[at] = low + np.minimum(np.searchsorted(below, out[at], side="right"), len(below) - 1)
    return out


def bags(cells, trees, classes, seed):
    """Sums per tree and cell: of rows drawn in each class or, without classes, of rows drawn and of their labels."""
    parts = classes or 2

    def add(batches):
        import pyarrow as pa

        known, total = {}, np.zeros((0, trees, parts))

        def sent():
            n = len(known)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, t, np.int32)), pa.array(list(known), pa.binary()), *[pa.array(total[:n, t, p]) for p in range(parts)]],
                    ["tree", "cell", *[f"s{p}" for p in range(parts)]],
                )

        for batch in batches:
            names, keys = batch.column("cell").to_pylist(), batch.column("key").to_numpy()
            copies, y = batch.column("copies").to_numpy(), batch.column("y").to_numpy()
            for k in range(0, len(names), 2048):
                if len(known) * trees * parts > HELD:
                    yield from sent()
                    known.clear()
                    total[:] = 0
                slots = np.array([known.setdefault(c, len(known)) for c in names[k : k + 2048]])
                if len(known) > len(total):
                    total = np.concatenate([total, np.zeros((len(known), trees, parts))])
                n, label = drawn(keys[k : k + 2048], copies[k : k + 2048], trees, seed), y[k : k + 2048]
                order = np.argsort(slots, kind="stable")
                first = np.flatnonzero(np.diff(slots[order], prepend=-1))
                held = slots[order][first]
                for p in range(parts):
                    share = (label == p) if classes else (np.ones(len(label)) if p == 0 else label)
                    total[held, :, p] += np.add.reduceat((n * share[:, None])[order], first, axis=0)
        if known:
            yield from sent()

    columns = [f"s{p}" for p in range(parts)]
    drawn_rows = cells.mapInArrow(add, "tree int, cell binary, " + ", ".join(f"{c} double" for c in columns))
    return drawn_rows.groupBy("tree", "cell").agg(*[F.sum(c).alias(c) for c in columns])


def worth(s, classes):
    """Weight times impurity, up to a constant per label for values; least is best."""
    if classes:
        return s.sum(-1) - (s * s).sum(-1) / np.maximum(s.sum(-1), 1e-300)
    return -(s[..., 1] ** 2) / np.maximum(s[..., 0], 1e-300)


def grown(codes, sums, classes, bins, depth, least, tried, seed):
    """Nodes of one tree: input (-1 for a leaf), last bin of the left side, number of the left child, sums. The right child follows the left."""
    rng = np.random.default_rng(seed)
    nodes, inputs = [[-1, 0, 0, sums.sum(0)]], codes.shape[1]
    floor = LEAST_GAIN * float(worth(nodes[0][3], classes) - worth(sums, classes).sum())
    level = [(0, np.flatnonzero(sums.any(1)))]
    for _ in range(depth):
        after = []
        for number, at in level:
            if len(at) < 2:
                continue
            best, whole = (max(floor, 0.0), None, None), worth(nodes[number][3], classes)
            for i in np.sort(rng.choice(inputs, tried, replace=False)):
                if bins[i] < 2:
                    continue
                table = np.stack([np.bincount(codes[at, i], sums[at, p], bins[i]) for p in range(sums.shape[1])], axis=1)
                left = np.cumsum(table, axis=0)[:-1]
                right = nodes[number][3] - left
                rows = (left.sum(1), right.sum(1)) if classes else (left[:, 0], right[:, 0])
                gain = np.where((rows[0] >= least) & (rows[1] >= least), whole - worth(left, classes) - worth(right, classes), -np.inf)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = gain[k], i, k
            _, i, k = best
            if i is None:
                continue
            goes = codes[at, i] <= k
            nodes[number][:3] = int(i), k, len(nodes)
            for part in (at[goes], at[~goes]):
                after.append((len(nodes), part))
                nodes.append([-1, 0, 0, sums[part].sum(0)])
        level = after
    return nodes


def fit_forest(rows, trees, depth, least, classes=0, tried=None, seed=0):
    """The forest as plain lists, or None if the rows form too many cells. `rows` has x, an array, and y; `tried` inputs are looked at per node."""
    shift = 0.0 if classes else rows.agg(F.avg("y")).first()[0]  # sums of squares lose no digits to the mean
    rows = rows.select("x", (F.col("y") - F.lit(shift)).alias("y"))
    edges = bin_edges(rows.select("x"))
    cells = cells_of(rows, edges)
    if cells is None:
        return None
    bins, width, parts = [len(e) + 1 for e in edges], len(edges), classes or 2

    def grow(pdf):
        import pandas as pd

        pdf = pdf.sort_values("cell")
        codes = np.frombuffer(b"".join(pdf["cell"]), np.uint8).reshape(-1, width)
        tree = int(pdf["tree"].iloc[0])
        sums = pdf[[f"s{p}" for p in range(parts)]].to_numpy()
        nodes = grown(codes, sums, classes, bins, depth, least, tried or width, [seed, tree])
        value = [(s / s.sum()).tolist() if classes else [float(s[1] / s[0]) + shift] for *_, s in nodes]
        lists = {c: [[n[k] for n in nodes]] for k, c in enumerate(("input", "bin", "left"))}
        return pd.DataFrame({"tree": [tree], **lists, "value": [[v for x in value for v in x]]})

    schema = "tree int, input array<int>, bin array<int>, left array<int>, value array<double>"
    try:
        some = "s0 > 0" if not classes else " + ".join(f"s{p}" for p in range(parts)) + " > 0"
        found = bags(cells, trees, classes, seed).where(some).repartition(trees, "tree").groupBy("tree").applyInPandas(grow, schema).collect()
    finally:
        cells.unpersist()
    out = {"edges": edges, "classes": classes, "depth": depth, "roots": [], "input": [], "bin": [], "left": [], "value": []}
    for r in sorted(found, key=lambda r: r.tree):
        at = len(out["input"])
        out["roots"].append(at)
        out["input"] += r.input
        out["bin"] += r.bin
        out["left"] += [at + k for k in r.left]
        out["value"] += r.value
    return out


def predicted(features, state):
    """Column of the forest's answer for an array of inputs: the mean of the trees or, with classes, the class with the largest share, the first among equals."""
    edges, classes, depth = state["edges"], state["classes"], state["depth"]
    split, last, left = (np.array(state[c], np.int32) for c in ("input", "bin", "left"))
    roots, value = np.array(state["roots"], np.int32), np.array(state["value"]).reshape(len(split), -1)

    def answers(codes):
        node = np.repeat(roots[None, :], len(codes), axis=0)
        for _ in range(depth):
            on = split[node]
            right = np.take_along_axis(codes, np.maximum(on, 0), axis=1) > last[node]
            node = np.where(on < 0, node, left[node] + right)
        mean = value[node].mean(1)
        return mean.argmax(1).astype(float) if classes else mean[:, 0]

    @F.arrow_udf("double")
    def answer(x):
        import pyarrow as pa

        if not len(x):
            return pa.array([], pa.float64())
        codes = binned(matrix(x), edges)
        _, first, of = np.unique(codes.view(np.dtype((np.void, codes.shape[1]))).ravel(), return_index=True, return_inverse=True)
        found = np.concatenate([answers(codes[first[k : k + 1000]]) for k in range(0, len(first), 1000)])
        return pa.array(found[of])

    return answer(features)
