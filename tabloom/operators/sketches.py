"""Distinct counts that can be merged: a sketch per column and part of a table.

Sketches of parts add up to that of the whole, so a profile grows with new files without reading the old ones again.
"""

from pyspark.sql import functions as F

from tabloom.functions.interpret import is_missing, raw_of

#: 2 to this power registers a sketch; the standard error is 1.04 / sqrt(registers), 0.8 % here.
PRECISION = 14


def column_sketches(df, columns, part=None):
    """One row per column (and value of `part`): name, rows, missing and sketch, from one aggregation."""
    texts = {n: F.when(~is_missing(raw_of(df, n)), raw_of(df, n)) for n in columns}
    facts = [F.struct(F.count("*").alias("rows"), F.count_if(t.isNull()).alias("missing"), F.hll_sketch_agg(t, F.lit(PRECISION)).alias("sketch"))
             for t in texts.values()]
    whole = (df.groupBy(F.col(part).alias("part")) if part else df.groupBy()).agg(*[f.alias(f"s{i}") for i, f in enumerate(facts)])
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"s{i}").alias("fact")) for i, n in enumerate(texts)])
    rows = whole.select(*(["part"] if part else []), F.explode(cells).alias("cell"))
    return rows.select(*(["part"] if part else []), "cell.name", "cell.fact.*")


def merged(sketches):
    """One row per column from sketches of parts or of earlier files."""
    return sketches.groupBy("name").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.hll_union_agg("sketch").alias("sketch")
    )


def estimates(sketches):
    """name, rows, missing and distinct_estimate of sketches."""
    return sketches.select("name", "rows", "missing", F.hll_sketch_estimate("sketch").alias("distinct_estimate"))
