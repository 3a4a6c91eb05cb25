"""Row identity. Spark rows have no position, so every order starts from an explicit id."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.contracts import SEED
from tabloom.functions.names import col
from tabloom.sources.scratch import kept


#: Rows of the block table, one per file block, that may be sent to all tasks.
BROADCAST_BLOCKS = 200_000


def with_file_order(df, name="row_id", broadcast_blocks=BROADCAST_BLOCKS):
    """Dense zero-based row numbers in file order, for a DataFrame read straight from files.

    Each file block knows its own first row after a count per block. Only those counts
    are put in order, one row per block, and joined back: a broadcast while they are few. A
    delimited table with line breaks in cells is numbered by the columns that
    `read_delimited(..., places=True)` adds.
    """
    if name in df.columns:
        raise ValueError(f"the table has a column {name} already")
    placed = df if {"__path", "__block", "__place"} <= set(df.columns) else df.select(
        "*",
        F.col("_metadata.file_path").alias("__path"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__place"),
    )
    blocks = kept(placed.groupBy("__path", "__block").agg(F.count("*").alias("rows"), F.min("__place").alias("__first")), "blocks")
    before = Window.orderBy("__path", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "__path", "__block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__base"),
        F.coalesce("__first", F.lit(0)).alias("__first"), (F.col("rows") - 1).alias("__last"),
    )
    starts = F.broadcast(starts) if blocks.count() <= broadcast_blocks else starts
    within = F.coalesce(F.col("__place") - F.col("__first"), F.col("__last"))  # no place: the record over the block's end
    return (
        placed.join(starts, ["__path", "__block"])
        .withColumn(name, F.col("__base") + within)
        .drop("__path", "__block", "__place", "__base", "__first", "__last")
    )


def row_digest(df, columns=None):
    """Digest of a row's values, for tables without a key. Copies of a row share it."""
    names = df.columns if columns is None else columns
    parts = [
        F.coalesce(F.concat(F.char_length(col(n).cast("string")), F.lit(":"), col(n).cast("string")), F.lit("-"))
        for n in names
    ]
    return F.md5(F.concat(*parts))


def row_hash(row_id, seed=SEED):
    """The seeded order of rows behind every split, sample and start point."""
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def spread(df):
    """At least one task per core for data that is read again in every iteration.

    Only tables of a few file splits are affected; large ones keep their partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
