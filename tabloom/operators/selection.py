"""Exact order statistics on data of any size, without sorting it.

Both functions narrow down to the wanted value over a few passes that each reduce the
table to a small summary. Nothing is ranked before it has become small.
"""

import math
from functools import partial

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.functions.names import col

DIGITS = 3  # hex digits settled per pass: 4,096 summary rows per group
SMALL = 10_000  # rows or values a single task may rank
ACCURACY = 4_096  # counts per column and pass of a median, a power of two


def hash_cutoffs(df, digest, quotas, group=None, small=SMALL):
    """For each group, the digest value up to which exactly `quota` rows lie.

    `digest` is a lower-case hex column, unique per row. `quotas` maps group values to
    row counts. The answer is a handful of literals, so taking the smallest rows becomes
    a plain filter: no shuffle, and the same rows on every run and every cluster.
    Each pass counts rows by the next digits and keeps only the one prefix per group in
    which the boundary falls.
    """
    group = F.lit("") if group is None else group
    data = df.select(group.cast("string").alias("g"), digest.alias("d"))
    open_ = {str(g): ("", int(q)) for g, q in quotas.items() if q > 0}
    cutoffs = {str(g): "" for g, q in quotas.items() if q <= 0}
    depth = 0
    while open_:
        boundary = _in_prefixes(data, open_, depth)
        width = depth + DIGITS
        counted = boundary.groupBy("g", F.substring("d", 1, width).alias("p")).agg(F.count("*").alias("n"))
        upto = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
        wanted = F.create_map(*[F.lit(v) for g, (_, q) in open_.items() for v in (g, q)])
        hit = (
            counted.withColumn("upto", F.sum("n").over(upto))
            .withColumn("left", wanted[F.col("g")] - (F.col("upto") - F.col("n")))
            .where((F.col("left") > 0) & (F.col("left") <= F.col("n")))
            .select("g", "p", "n", "left")
            .collect()
        )
        found = {r["g"]: r for r in hit}
        for g in list(open_):
            if g not in found:  # the quota exceeds the group: take all of it
                cutoffs[g] = "g"
                del open_[g]
            else:
                open_[g] = (found[g]["p"], found[g]["left"])
        depth = width
        ready = {g: open_[g] for g, r in found.items() if r["n"] <= small or depth >= 32}
        if ready:
            rank = F.row_number().over(Window.partitionBy("g").orderBy("d"))
            wanted = F.create_map(*[F.lit(v) for g, (_, q) in ready.items() for v in (g, q)])
            for row in (
                _in_prefixes(data, ready, depth)
                .withColumn("rank", rank)
                .where(F.col("rank") == wanted[F.col("g")])
                .select("g", "d")
                .collect()
            ):
                cutoffs[row["g"]] = row["d"]
                del open_[row["g"]]
    return cutoffs


def _in_prefixes(data, open_, depth):
    if depth == 0:
        return data.where(F.col("g").isin(*open_))
    prefixes = F.create_map(*[F.lit(v) for g, (p, _) in open_.items() for v in (g, p)])
    return data.where(F.substring("d", 1, depth) == prefixes[F.col("g")])


def within_cutoff(digest, cutoffs, group=None):
    """Whether a row is among the smallest of its group, given `hash_cutoffs`."""
    if group is None:
        return digest <= F.lit(cutoffs[""])
    limits = F.create_map(*[F.lit(v) for pair in sorted(cutoffs.items()) for v in pair])
    return digest <= F.coalesce(limits[group.cast("string")], F.lit(""))


def smallest_rows(df, digest, k):
    """The k rows with the smallest digests, as a filter."""
    return df.where(within_cutoff(digest, hash_cutoffs(df, digest, {"": k})))


def exact_medians(df, columns, small=SMALL, accuracy=ACCURACY):
    """Exact median of each double column, nulls left out; None for an empty column.

    Doubles are read as whole numbers in the same order. Each pass counts rows by the next bits of them, at most `accuracy`
    counts up to the next power of two, and keeps only the prefix in which the wanted rank falls, until few rows or
    one value are left. All columns share the passes, and each task sends one count per prefix on.
    """
    if not columns:
        return {}
    c = [col(n) for n in columns]
    counts = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(c)]).first()
    medians = {name: None for name in columns}
    # The built-in exact median keeps all distinct values of a column in one task.
    few = [i for i in range(len(columns)) if 0 < counts[i] <= small]
    if few:
        row = df.agg(*[F.median(c[i]) for i in few]).first()
        medians.update({columns[i]: row[n] for n, i in enumerate(few)})
    ranks = {
        i: sorted({(counts[i] - 1) // 2, counts[i] // 2}) for i in range(len(columns)) if counts[i] > small
    }
    if ranks:
        found = _order_statistics(df.select(*[x.cast("double").alias(f"c{i}") for i, x in enumerate(c) if i in ranks]), ranks, small, max(1, (accuracy - 1).bit_length()))
        medians.update({columns[i]: sum(found[i, r] for r in ranks[i]) / len(ranks[i]) for i in ranks})
    return medians


def ordered(values):
    """Doubles as whole numbers in Spark's order: zeros are equal, NaN comes last."""
    values = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return np.where(values < 0, values ^ np.int64(2**63 - 1), values)


def unordered(number):
    """The double of such a number."""
    number = np.int64(number)
    return float((number ^ np.int64(2**63 - 1) if number < 0 else number).view(np.float64))


def _order_statistics(df, ranks, small, bits):
    """Values at zero-based ranks of columns c0, c1, ... by (column number, rank)."""
    found, open_ = {}, {(i, r): (0, 0, r) for i in ranks for r in ranks[i]}  # bits known, the prefix they make, rank within it
    while open_:
        asked = {}  # ranks in the same rows share their counts
        for (i, r), (depth, prefix, left) in open_.items():
            asked.setdefault((i, depth, prefix), []).append((r, left))
        jobs = list(asked)
        counted = df.mapInArrow(partial(_count, jobs, bits), "job int, place long, n long, low long, high long")
        whole = Window.partitionBy("job")
        upto = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        counted = counted.groupBy("job", "place").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        counted = counted.select("job", "place", "n", F.min("low").over(whole).alias("low"), F.max("high").over(whole).alias("high"), F.sum("n").over(upto).alias("upto"))
        wanted = F.create_map(*[x for k, job in enumerate(jobs) for x in (F.lit(k), F.array(*[F.lit(left) for _, left in asked[job]]))])
        hit = F.exists(wanted[F.col("job")], lambda left: (left >= F.col("upto") - F.col("n")) & (left < F.col("upto")))
        open_, ready = {}, {}
        for row in counted.where(hit).collect():
            i, depth, prefix = jobs[row["job"]]
            width = min(bits, 64 - depth)
            for r, left in asked[i, depth, prefix]:
                left -= row["upto"] - row["n"]
                if not 0 <= left < row["n"]:
                    continue
                if row["low"] == row["high"]:
                    found[i, r] = unordered(row["low"])
                elif depth + width == 64:
                    found[i, r] = unordered(row["place"])
                else:
                    (ready if row["n"] <= small else open_)[i, r] = (depth + width, row["place"], left)
        if ready:
            jobs = sorted({(i, *at[:2]) for (i, _), at in ready.items()})
            rows = df.mapInArrow(partial(_inside, jobs), "job int, value long").groupBy("job").agg(F.sort_array(F.collect_list("value")).alias("v")).collect()
            values = {jobs[row["job"]]: row["v"] for row in rows}
            found.update({(i, r): unordered(values[i, depth, prefix][left]) for (i, r), (depth, prefix, left) in ready.items()})
    return found


def _prefixed(batch, jobs):
    """Number of the job and its rows' numbers, for each prefix of bits that rows of the batch have."""
    column, numbers = None, None
    for k, (i, depth, prefix) in enumerate(jobs):
        if i != column:
            column, numbers = i, ordered(batch.column(f"c{i}").drop_null().to_numpy(zero_copy_only=False))
        inside = numbers[numbers >> np.int64(64 - depth) == prefix] if depth else numbers
        if len(inside):
            yield k, inside


def _count(jobs, bits, batches):
    import pyarrow as pa

    counts, ends = {}, {}
    for batch in batches:
        for k, numbers in _prefixed(batch, jobs):
            depth = jobs[k][1]
            width = min(bits, 64 - depth)
            place = (numbers >> np.int64(64 - depth - width)) & np.int64(2**width - 1)
            counts[k] = counts.get(k, 0) + np.bincount(place, minlength=2**width)
            low, high = ends.get(k, (numbers[0], numbers[0]))
            ends[k] = min(low, numbers.min()), max(high, numbers.max())
    for k, n in counts.items():
        _, depth, prefix = jobs[k]
        width, seen = min(bits, 64 - depth), np.flatnonzero(n)
        place = np.int64(prefix) << np.int64(width) | seen if depth else np.where(seen >= 2 ** (width - 1), seen - 2**width, seen)
        columns = [np.full(len(seen), k, np.int32), place, n[seen], *[np.full(len(seen), end, np.int64) for end in ends[k]]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["job", "place", "n", "low", "high"])


def _inside(jobs, batches):
    import pyarrow as pa

    for batch in batches:
        for k, numbers in _prefixed(batch, jobs):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), k, np.int32)), pa.array(numbers)], ["job", "value"])


def held_out(n):
    """Held-out rows of n: one fifth, rounded up."""
    return math.ceil(n / 5)
