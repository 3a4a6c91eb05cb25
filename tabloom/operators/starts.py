"""K-Means from several starts at once.

All starts share every pass: one aggregation per new centre while they are chosen, one per iteration after that. Centres are
chosen with probability in proportion to the squared distance from those chosen before, by an exponential race on hashes of
the rows, so a start does not depend on tasks or their order. Starts that have come to rest leave the passes.
"""

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import functions as F

from tabloom.operators.newton import matrix

#: A start rests when no centre moves further than this, relative to the spread of the data.
REST = 1e-7
#: Size of a block of rows, and centres held against it at once.
BLOCK_BYTES, CENTRES = 2_000_000, 64


def blocks(rows):
    """The rows as blocks of matrices: inputs `x` and hashes `key` as bytes, which later passes read without converting a value.

    Rows that are blocks already stay as they are.
    """
    if rows.schema["x"].dataType.typeName() == "binary":
        return rows

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                x, keys = matrix(batch.column("x")), batch.column("key").to_numpy()
                step = max(1, BLOCK_BYTES // (8 * x.shape[1]))
                for at in range(0, len(x), step):
                    yield pa.RecordBatch.from_pydict({"x": [x[at : at + step].tobytes()], "key": [keys[at : at + step].tobytes()]})

    return rows.select("x", "key").mapInArrow(pack, "x binary, key binary")


def opened(batches):
    """Inputs and hashes of each block."""
    for batch in batches:
        for x, key in zip(batch.column("x"), batch.column("key")):
            keys = np.frombuffer(key.as_buffer(), np.int64)
            yield np.frombuffer(x.as_buffer(), float).reshape(len(keys), -1), keys


def squares(x, centres):
    """Squared distance of each centre (row) to each row of x."""
    return np.maximum((x * x).sum(1) - 2 * centres @ x.T + (centres * centres).sum(1)[:, None], 0.0)


def together(starts, k):
    """Slices of starts whose centres are held against a block at once."""
    step = max(1, CENTRES // k)
    return [slice(at, min(at + step, starts)) for at in range(0, starts, step)]


def noise(keys, start, turn):
    """A number in (0, 1] per row, start and turn."""
    salt = ((start + 1) * 0x9E3779B97F4A7C15 + (turn + 1) * 0xC2B2AE3D27D4EB4F) % 2**64
    z = keys.view(np.uint64) + np.uint64(salt)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53 + 2.0**-54


def first_centres(rows, k, starts, seed):
    """Centres (starts, k, inputs) by rows drawn far from each other."""
    rows, centres = blocks(rows), np.zeros((starts, 0, 0))
    for turn in range(k):
        chosen = centres

        def race(batches):
            import pyarrow as pa

            best = {}
            for x, keys in opened(batches):
                for s in range(starts):
                    far = squares(x, chosen[s]).min(0) if turn else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        time = -np.log(noise(keys, seed + s, turn)) / far
                    at = int(time.argmin())
                    if s not in best or time[at] < best[s][0]:
                        best[s] = time[at], x[at].tolist()
            if best:
                yield pa.RecordBatch.from_pydict({"start": pa.array(list(best), pa.int32()), "time": [t for t, _ in best.values()], "x": [x for _, x in best.values()]})

        raced = rows.select("x", "key").mapInArrow(race, "start int, time double, x array<double>")
        winners = raced.groupBy("start").agg(F.min_by("x", F.struct("time", "x")).alias("x")).collect()
        new = np.array([r.x for r in sorted(winners, key=lambda r: r.start)])
        centres = np.concatenate([centres.reshape(starts, turn, new.shape[1]), new[:, None, :]], axis=1)
    return centres


def sums(rows, centres):
    """Rows, sums of inputs and cost per start and centre: an array (starts, k, 2 + inputs)."""
    starts, k, width = centres.shape
    parted = together(starts, k)

    def add(batches):
        import pyarrow as pa

        total = np.zeros((starts, k, 2 + width))
        for x, _ in opened(batches):
            for some in parted:
                far = squares(x, centres[some].reshape(-1, width)).reshape(-1, k, len(x))
                least, near = far[:, 0].copy(), np.zeros((len(far), len(x)), np.int64)
                for c in range(1, k):
                    near[far[:, c] < least] = c  # the first among equals
                    np.minimum(least, far[:, c], out=least)
                for s, (own, cost) in enumerate(zip(near, least), some.start):
                    total[s, :, 0] += np.bincount(own, minlength=k)
                    total[s, :, 1] += np.bincount(own, cost, k)
                members = (near[:, None, :] == np.arange(k)[:, None]).astype(float)
                total[some, :, 2:] += (members.reshape(-1, len(x)) @ x).reshape(-1, k, width)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(range(starts * k), pa.int32()), "v": list(total.reshape(starts * k, -1))})

    parts = rows.mapInArrow(add, "slot int, v array<double>").select("slot", F.posexplode("v").alias("pos", "value"))
    found = np.zeros((starts * k, 2 + width))
    for r in parts.groupBy("slot", "pos").agg(F.sum("value").alias("value")).collect():
        found[r.slot, r.pos] = r.value
    return found.reshape(starts, k, -1)


def best_of_starts(rows, k, starts, iterations, seed):
    """(centres, cost, iterations, rows per centre) of the start with the least cost, the first among equals.

    `rows` has x, an array of numbers, and key, a hash of it. A centre without rows stays where it is.
    The rows are read once, into blocks that stay while the passes go on.
    """
    held = blocks(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _best(held, k, starts, iterations, seed)
    finally:
        held.unpersist()


def _best(rows, k, starts, iterations, seed):
    centres = first_centres(rows, k, starts, seed)
    moving, taken = list(range(starts)), np.zeros(starts, int)
    spread = float(np.abs(centres).max()) or 1.0
    while moving:
        found = sums(rows, centres[moving])
        still = []
        for at, s in enumerate(moving):
            n = found[at, :, :1]
            after = np.where(n > 0, found[at, :, 2:] / np.maximum(n, 1), centres[s])
            moved, centres[s] = np.abs(after - centres[s]).max(), after
            taken[s] += 1
            if moved > REST * spread and taken[s] < iterations:
                still.append(s)
        moving = still
    final = sums(rows, centres)
    cost = final[:, :, 1].sum(1)
    best = int(np.flatnonzero(cost <= cost.min() * (1 + 1e-12))[0])
    return centres[best], float(cost[best]), int(taken[best]), final[best, :, 0].astype(int).tolist()
