"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance V is never formed. A pass multiplies it with a narrow block Q: each task centres its rows,
adds up their XᵀXQ, and Spark sums one row per task and dimension. A polynomial recurrence over such passes
(Chebyshev polynomials that stay small between the ends of the unwanted spectrum) damps what is not wanted, then
QR and a Rayleigh-Ritz step on the driver turn the block. The upper end of the unwanted spectrum is the block's smallest
Ritz value; the lower one comes from a Lanczos vector that rides along in each pass. Rounds go on until the residual of
every wanted vector is below TOLERANCE of the largest eigenvalue, or no longer falls below LOOSE. Only blocks of
dimensions x (components + guards) numbers reach the driver; rows never do.

Entries become whole numbers first, so sums and deviations are exact. A row is dropped if its vector is null, empty, or has
null or non-finite entries; repeated rows count as often as they occur. All vectors have one length, else the
job fails. Entries beyond 2**60 count as 2**60. Components without variance (below EMPTY of the trace) have explained 0 and null
whitened values; a deviation beyond 64 bits is null. An empty table gives no rows.
"""

import numpy as np
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Vectors of the block beyond the wanted ones; they speed up the filter.
GUARDS = 16
#: Degree of the filter polynomial, and filters at most.
DEGREE, ROUNDS = 8, 40
#: Residuals over the largest eigenvalue: good, and good enough once they no longer fall.
TOLERANCE, LOOSE = 1e-14, 1e-11
#: The unwanted spectrum ends this share below the last wanted value, even if the block's values are all equal.
APART = 0.05
#: How much more a filter may let one wanted vector grow than another.
SPREAD = 1e8
EMPTY = 1e-13
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def whole_rows(column):
    """(places of usable rows, their whole numbers) of an Arrow list column."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    entries = pc.list_flatten(column)
    values = entries.cast("double").to_numpy(zero_copy_only=False)  # null entries become NaN
    bad = np.flatnonzero(~np.isfinite(values))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    good = sizes > 0
    good[owner[bad]] = False
    places = np.flatnonzero(good)
    width = set(sizes[places].tolist())
    if len(width) > 1:
        raise ValueError("vectors have different lengths")
    values = values[np.repeat(good, sizes)].reshape(len(places), *(width or {0}))
    return places, np.clip(np.floor(SCALE * values), -(2.0**60), 2.0**60).astype(np.int64) + SHIFT


class Centre:
    """Count, sums and mean of the fit list; rows come out exactly centred or as n * x - S."""

    def __init__(self, n, sums):
        self.n, self.sums = n, sums
        self.floor = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def rows(self, whole):
        return (whole - self.floor).astype(float) - self.rest / self.n

    def deviations(self, whole):
        apart = whole - self.floor
        most = (int(np.abs(apart).max(initial=0)) + 1) * self.n
        if most * most * len(self.sums) < 2**63:
            return ((self.n * apart - self.rest) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(v) - int(r)) ** 2 for v, r in zip(row, self.rest)) for row in apart]
        return [x if x < 2**63 else None for x in exact]


def totals(vectors):
    """Centre of all rows, or None if there are none."""

    def add(batches):
        import pyarrow as pa

        for batch in batches:
            whole = whole_rows(batch.column(0))[1]
            if len(whole):
                halves = whole >> 32, whole & 0xFFFFFFFF  # halves cannot overflow a sum
                sums = [(int(h) << 32) + int(low) for h, low in zip(halves[0].sum(0), halves[1].sum(0))]
                dims = range(len(sums))
                yield pa.RecordBatch.from_pydict({"dim": pa.array(dims, pa.int32()), "n": [len(whole)] * len(sums), "total": map(str, sums)})

    parts = vectors.mapInArrow(add, "dim int, n long, total string").withColumn("total", F.col("total").cast("decimal(38,0)"))
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect()
    if not rows:
        return None
    if len({r.n for r in rows}) > 1:
        raise ValueError("vectors have different lengths")
    return Centre(rows[0].n, [int(r.total) for r in rows])


def summed(vectors, centre, block, kind):
    """A matrix summed over all centred rows X: XᵀXQ ("product"), or the Gram matrix of XQ ("gram"), over n.

    A last column has the sums of squares by dimension, or the sums of XQ.
    """

    def add(batches):
        import pyarrow as pa

        found = 0
        for batch in batches:
            whole = whole_rows(batch.column(0))[1]
            if len(whole):
                rows = centre.rows(whole)
                seen = rows @ block
                left, last = (rows, (rows * rows).sum(0)) if kind == "product" else (seen, seen.sum(0))
                found = found + np.column_stack([left.T @ seen, last])
        if np.ndim(found):
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(len(found)), pa.int32()), "v": list(found)})

    width = block.shape[1] + 1
    parts = vectors.mapInArrow(add, "dim int, v array<double>")
    sums = parts.groupBy("dim").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(width)]).alias("v")).collect()
    return np.array([r.v for r in sorted(sums, key=lambda r: r.dim)]) / centre.n


class Lanczos:
    """Ends of the spectrum from a vector that rides along in the passes."""

    def __init__(self, start):
        self.vectors, self.diagonal, self.beside = [start], [], []

    def take(self, product):
        """The product of V with the last vector gives the next one."""
        self.diagonal.append(float(product @ self.vectors[-1]))
        for _ in range(2):  # orthogonal to all before, in spite of rounding
            product = product - np.array(self.vectors).T @ (np.array(self.vectors) @ product)
        size = float(np.linalg.norm(product))
        self.beside.append(size)
        if size > 1e-10 * max(map(abs, self.diagonal)) and len(self.vectors) < len(product):
            self.vectors.append(product / size)

    @property
    def open(self):
        return len(self.vectors) > len(self.diagonal)

    def least(self):
        """A lower end: the smallest Ritz value less its residual, at least 0."""
        if not self.diagonal:
            return 0.0
        k = len(self.diagonal)
        between = np.array(self.beside[: k - 1])
        values, turns = np.linalg.eigh(np.diag(self.diagonal) + np.diag(between, 1) + np.diag(between, -1))
        return max(0.0, float(values[0] - self.beside[k - 1] * abs(turns[-1, 0])))


def leading(multiply, dims, wanted, guards=GUARDS, degree=DEGREE, rounds=ROUNDS, tolerance=TOLERANCE):
    """(eigenvalues, unit eigenvectors as columns, passes) of the largest eigenvalues of V, falling.

    `multiply` gives V times a block. Raises ArithmeticError if the residuals stay too large.
    """
    width = min(dims, wanted + guards)
    rng = np.random.default_rng(13)
    block = np.linalg.qr(rng.standard_normal((dims, width)))[0]
    ride = rng.standard_normal(dims)
    lanczos, passes = Lanczos(ride / np.linalg.norm(ride)), 0

    def product(q):
        nonlocal passes
        passes += 1
        if width == dims or not lanczos.open:
            return multiply(q)
        both = multiply(np.column_stack([q, lanczos.vectors[-1]]))
        lanczos.take(both[:, -1])
        return both[:, :-1]

    best = np.inf
    for _ in range(rounds):
        image = product(block)
        small = block.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        block, image = block @ turns, image @ turns
        residuals = np.linalg.norm(image - block * values, axis=0)[:wanted]
        residual, top = residuals.max(), max(values[0], 0.0)
        if residual <= tolerance * top or top == 0 or width == dims:
            break
        if residual <= LOOSE * top and residual > best / 2:  # rounding is reached
            break
        best = min(best, residual)
        low, edge = lanczos.least(), float(values[wanted - 1])
        if edge <= low:
            low = 0.0
        high = min(float(values[-1]), edge - APART * (edge - low))
        done = int((np.cumsum(residuals > tolerance * top) == 0).sum())  # these vectors are locked
        found = block[:, :done]
        block = filtered(product, found, block[:, done:], image[:, done:], (low, high), (float(values[done]), edge), degree)
        block = np.linalg.qr(np.column_stack([found, block]))[0]
    else:
        raise ArithmeticError(f"residual {residual:.2g} after {passes} passes; give more guards or rounds")
    return np.maximum(values[:wanted], 0), block[:, :wanted], passes


def filtered(product, found, block, image, unwanted, kept, degree):
    """A Chebyshev polynomial of V times the block, small between the ends of `unwanted`, orthogonal to `found`.

    Its degree falls where the largest of the `kept` values would grow SPREAD times more than the smallest one, which
    rounding could then not tell from zero. Scaled so that the largest keeps its size; `image` is the first pass.
    """
    middle, half = sum(unwanted) / 2, max((unwanted[1] - unwanted[0]) / 2, 1e-3 * kept[1], 1e-300)
    growth = [np.arccosh(max(1.0, (v - middle) / half)) for v in kept]
    degree = max(1, min(degree, int(np.log(SPREAD) / max(growth[0] - growth[1], 1e-9))))
    first = scale = half / (kept[0] - middle) if kept[0] > middle else 1.0
    before, now = block, (image - middle * block) * (scale / half)
    for _ in range(degree - 1):
        now = now - found @ (found.T @ now)
        following = 1 / (2 / first - scale)
        before, now = now, 2 * (following / half) * (product(now) - middle * now) - scale * following * before
        scale = following
    return now - found @ (found.T @ now)


class Whitening:
    """A fitted whitening: `centre`, `values`, `axes`, `trace` and `error`, measured over all rows."""

    def __init__(self, vectors, components=COMPONENTS, **options):
        self.centre = totals(vectors)
        if self.centre is None:
            return
        dims, squares = len(self.centre.sums), []

        def multiply(block):
            found = summed(vectors, self.centre, block, "product")
            squares[:] = [float(found[:, -1].sum())]
            return found[:, :-1]

        self.values, self.axes, self.passes = leading(multiply, dims, min(components, dims), **options)
        self.trace = squares[0]
        self.live = self.values > EMPTY * max(self.trace, 0) if self.trace else np.zeros(len(self.values), bool)
        self.error = 0.0
        if self.live.any():
            found = summed(vectors, self.centre, self.turn()[:, self.live], "gram")
            mean = found[:, -1]
            self.error = float(np.abs(found[:, :-1] - np.outer(mean, mean) - np.eye(len(found))).max())

    def turn(self):
        return self.axes / np.sqrt(np.where(self.live, self.values, np.inf))

    def applied(self, rows):
        """Rows of SCHEMA for every usable row of (vec_id, embedding) and component."""
        centre, turn, live, explained = self.centre, self.turn(), self.live, self.values / (self.trace or 1)
        k = len(explained)

        def whiten(batches):
            import pyarrow as pa

            for batch in batches:
                places, whole = whole_rows(batch.column(1))
                if not len(places):
                    continue
                # one row at a time, so that equal rows get equal numbers whatever their neighbours
                values = np.einsum("rd,dk->rk", centre.rows(whole), turn).ravel()
                where = np.repeat(places, k)
                deviations = pa.array(centre.deviations(whole), pa.int64()).take(pa.array(np.repeat(np.arange(len(places)), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(where)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(places))),
                        pa.array(np.full(len(where), centre.n)), deviations,
                        pa.array(values, mask=np.tile(~live, len(places))), pa.array(np.tile(np.where(live, explained, 0.0), len(places))),
                    ],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )

        return rows.mapInArrow(whiten, SCHEMA)


def whiten(embeddings, components=COMPONENTS, **options):
    """vec_id, component, n, deviation, whitened, explained and identity_error of all usable rows."""
    vectors = embeddings.filter("embedding IS NOT NULL").select("embedding")
    fitted = Whitening(vectors, components, **options)
    rows = embeddings.filter("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    if fitted.centre is None:
        made = embeddings.sparkSession.createDataFrame([], SCHEMA)
    else:
        made = fitted.applied(rows)
    return made.withColumn("identity_error", F.lit(0.0 if fitted.centre is None else fitted.error))
