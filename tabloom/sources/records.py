"""Delimited records that go over line ends, read by as many tasks as the file has splits.

Quoting is sound (`audits.quoting_audit` proves it), so a line changes between outside and inside a quoted cell if
it holds an odd number of quotes, and the state at the start of a split is the parity of all odd lines of
its file before it. One aggregation over lines gives each split's count, first and last odd line; a
window over that table, one row per split, gives the states. Then every task puts its lines together from a known state, and
only the records over the edge of a split are gathered from the lines around it; they belong to the split they start in.

Lines end with a line feed, after a carriage return or not; inside a cell both stay as they are.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.sources.scratch import kept

BOM = "﻿"
#: Rows of the split table that may be sent to all tasks, about 200 bytes each; beyond, lines are joined and sorted.
BROADCAST_SPLITS = 200_000
RECORDS = "value string, __path string, __block bigint, __place bigint"


def odd_quotes(value):
    return (F.char_length(value) - F.char_length(F.translate(value, '"', ""))) % 2 == 1


def numbered_lines(spark, path):
    """Lines with file, split and a place that grows along the split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )


def split_states(lines):
    """file, block, inside (state at the start), first and last odd place, open (a record runs on) and owner of its head lines."""
    odd = odd_quotes(F.col("value"))
    splits = lines.groupBy("file", "block").agg(
        F.count_if(odd).alias("odd"), F.min(F.when(odd, F.col("place"))).alias("first"), F.max(F.when(odd, F.col("place"))).alias("last")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    splits = splits.withColumn("open", (F.col("odd") > 0) & ((F.col("odd") % 2 == 1) != F.col("inside")))
    return splits.withColumn("owner", F.last(F.when(F.col("open"), F.col("block")), ignorenulls=True).over(before))


def with_states(lines, states, broadcast_splits):
    """Lines with the state of their split, those of a split still together and in order."""
    if states.count() <= broadcast_splits:
        return lines.join(F.broadcast(states), ["file", "block"])
    return lines.join(states, ["file", "block"]).sortWithinPartitions("file", "block", "place")


def _whole(batches):
    """Records that start and end in their split, with their number in it; the header of each file is left out."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    at, inside, held, started, nth, header = None, False, [], False, 0, False

    def made(file, block, values):
        nonlocal nth, header
        values = pc.ascii_rtrim(values, characters="\r")
        values = values.filter(pc.not_equal(values, ""))
        if header and len(values):
            values, header = values[1:], False
        place = pa.array(np.arange(nth, nth + len(values)), pa.int64())
        nth += len(values)
        same = [pa.repeat(pa.scalar(x, t), len(values)) for x, t in ((file, pa.string()), (block, pa.int64()))]
        return pa.RecordBatch.from_arrays([values.cast(pa.string()), *same, place], ["value", "__path", "__block", "__place"])

    for batch in batches:
        blocks, files = batch.column("block").to_numpy(), batch.column("file")
        odd_lines = batch.column("odd").to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1
        if len(batch) > 1:  # neighbouring splits of two files may start at the same byte
            other = pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
            changes = np.union1d(changes, np.flatnonzero(other) + 1)
        edges = [0, *changes.tolist(), len(batch)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            values, key = batch.column("value").slice(a, b - a).cast(pa.large_string()), (files[a].as_py(), int(blocks[a]))
            if key != at:
                at, inside, held, started, nth, header = key, batch.column("inside")[a].as_py(), [], False, 0, key[1] == 0
                if header:
                    first = pc.replace_substring_regex(values.slice(0, 1), pattern=f"^{BOM}", replacement="")
                    values = pa.concat_arrays([first, values.slice(1)])
            odd = odd_lines[a:b]
            states = (np.cumsum(odd) + inside) % 2  # after each line
            starts = np.flatnonzero(np.concatenate([[inside], states[:-1]]) == 0)
            head = int(starts[0]) if len(starts) else b - a
            if started:  # a record of this split goes on
                held.append(values.slice(0, head))
                if len(starts):
                    yield made(*at, pa.array(["\n".join(x for v in held for x in v.to_pylist())], pa.large_string()))
            if len(starts):
                whole = starts if states[-1] == 0 else starts[:-1]
                if len(whole):
                    end = b - a if states[-1] == 0 else int(starts[-1])
                    lists = pa.LargeListArray.from_arrays(pa.array([*whole.tolist(), end], pa.int64()), values)
                    yield made(*at, pc.binary_join(lists, pa.scalar("\n", pa.large_string())))
                started = bool(states[-1])
                held = [values.slice(int(starts[-1]))] if started else []
            inside = bool(states[-1])


def spanning_records(spark, path, broadcast_splits=BROADCAST_SPLITS):
    """All records as texts, with their file, split and number in it (null for the one over its end)."""
    lines = numbered_lines(spark, path)
    states = kept(split_states(lines), "states")  # one row per split
    known = with_states(lines, states, broadcast_splits)
    columns = known.select("value", "file", "block", "inside", odd_quotes(F.col("value")).alias("odd"))
    whole = columns.mapInArrow(_whole, RECORDS)
    if not states.where("open").limit(1).count():
        return whole
    head = F.col("inside") & (F.col("first").isNull() | (F.col("place") <= F.col("first")))
    tail = F.col("open") & (F.col("place") >= F.col("last"))
    around = known.where(head | tail).withColumn("__block", F.when(tail, F.col("block")).otherwise(F.col("owner")))
    parts = around.groupBy("file", "__block").agg(F.sort_array(F.collect_list(F.struct("block", "place", "value"))).alias("parts"))
    text = F.rtrim(F.array_join("parts.value", "\n"), F.lit("\r"))
    edges = parts.select(text.alias("value"), F.col("file").alias("__path"), "__block", F.lit(None).cast("bigint").alias("__place"))
    return whole.unionByName(edges.where("value != ''"))
