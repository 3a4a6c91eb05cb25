"""Checks of raw text files, each a distributed pass over their lines.

Every audit reports counts and positions; none returns cell values.
"""

import re
from collections import Counter

import pandas as pd
import regex
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.errors import TableError
from tabloom.functions.interpret import raw_of
from tabloom.sources.scratch import kept

# Optional limits on headers and cells.
MAX_HEADER = 128
MAX_CELL = 4_096

BOM = "\ufeff"
#: Characters of the general category "other": controls, formats, surrogates, private and unassigned ones.
CONTROL = regex.compile(r"\p{C}")


def lines(spark, path):
    """Lines of a file with their place: file, start of the split, number inside it.

    Ordered by these three, lines are in file order whatever the number of tasks.
    """
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )


def with_line(lines, marked):
    """The marked rows (file, block, place, ...) of a table of `lines`, with their line in the file, from 1, instead of block and place."""
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    return marked.join(starts, ["file", "block"]).withColumn("line", F.col("place") + F.col("shift")).drop("block", "place", "shift")


PLACE = "__place"


def with_place(text):
    """Lines with a number that grows along each file split, for a table of text just read."""
    return text.withColumn(PLACE, F.monotonically_increasing_id())


def content(value):
    """A line without a byte order mark or carriage return; empty lines are no records."""
    return F.rtrim(F.regexp_replace(value, f"^{BOM}", ""), F.lit("\r"))


def split_summary(text, first, wrong_width=None):
    """What is known of every file split, from one pass with fixed-width buffers.

    One row per split: its lines, those not empty, its smallest place, the places of its
    first faulty line (`bad`), of its file's first non-empty line (`head`), of the first line
    equal to `first`, of the first non-empty line of another width (`ragged`), and whether quotes, or odd numbers of them in a line, occur.
    """
    place, start = F.col(PLACE), F.col("_metadata.file_block_start") == 0
    filled = content("value") != ""
    quotes = F.char_length("value") - F.char_length(F.translate("value", '"', ""))
    ragged = F.lit(False) if wrong_width is None else filled & wrong_width
    return text.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).agg(
        F.count("*").alias("lines"), F.count_if(filled).alias("filled"), F.min(place).alias("place"),
        F.min(F.when(~F.is_valid_utf8("value"), place)).alias("bad"),
        F.min(F.when(filled & start, place)).alias("head"),
        F.min(F.when((content("value") == first) & start, place)).alias("same"),
        F.min(F.when(ragged, place)).alias("ragged"),
        F.bool_or(quotes > 0).alias("quotes"), F.bool_or(quotes % 2 == 1).alias("odd"),
    )


def first_place(splits, column):
    """Number, from 1, of the first line marked in a column of `split_summary`, counted in its file; None if there is none."""
    found = splits.where(F.col(column).isNotNull()).orderBy("file", "block").select("file", "block", "place", column).first()
    if found is None:
        return None
    file, block, start, place = found
    before = splits.where((F.col("file") == file) & (F.col("block") < block)).agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    return before + place - start + 1


def encoding_audit(spark, path):
    """Lines that are not valid UTF-8."""
    return spark.read.text(path).agg(F.count_if(~F.is_valid_utf8("value")).alias("bad_lines"), F.count("*").alias("lines"))


def blank_records(spark, path, jsonl=False):
    """Empty records, skipped by the readers: empty lines, or blank ones in JSON lines."""
    text = F.regexp_replace("value", f"^{BOM}", "")
    blank = (F.trim(F.translate(text, "\t\r\n\x0b\x0c", "     ")) if jsonl else F.rtrim(text, F.lit("\r"))) == ""
    return spark.read.text(path).agg(F.count_if(blank).alias("blank_records"))


def cell_limits(df, columns=None):
    """Longest text per column, and the rows of the table, in one pass without a shuffle of rows."""
    names = df.columns if columns is None else columns
    row = df.agg(F.count("*").alias("rows"), *[F.max(F.char_length(raw_of(df, n))).alias(f"m{i}") for i, n in enumerate(names)])
    cells = F.array(*[
        F.struct(F.lit(n).alias("name"), F.coalesce(F.col(f"m{i}"), F.lit(0)).cast("bigint").alias("longest"))
        for i, n in enumerate(names)
    ])
    return row.select("rows", F.inline(cells))


def file_bytes(spark, path):
    """Files and bytes of a source, from the file listing."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def check_limits(df, rows=None, columns=None, cell=MAX_CELL):
    """Fail when the table exceeds a limit; limits that are None are not checked."""
    if columns is not None and len(df.columns) > columns:
        raise TableError("DATA_LIMIT", f"More than {columns} columns.", "Use a narrower table.")
    found = cell_limits(df).collect()
    if rows is not None and found[0]["rows"] > rows:
        raise TableError("DATA_LIMIT", f"More than {rows} rows.", "Use a smaller table.")
    for r in found:
        if cell is not None and r["longest"] > cell:
            raise TableError("DATA_LIMIT", f"A cell has more than {cell} characters.", "Shorten the cells.", column=r["name"])


# Quoting. A line either starts outside or inside a quoted cell. For both starts we note
# whether the line is well formed and where it ends, which makes lines composable: each
# task folds its own lines, and the driver folds one small row per file split.

OUTSIDE, INSIDE, BROKEN = 0, 1, 2


def _line_effects(delimiter):
    d = re.escape(delimiter)
    plain, body = rf'[^"{d}]*', r'(?:[^"]|"")*'
    cell = rf'(?:{plain}|"{body}")'
    closed = re.compile(rf"{cell}(?:{d}{cell})*\Z")
    opened = re.compile(rf'(?:{cell}{d})*"{body}\Z')
    resumed = re.compile(rf'{body}"(?:{d}{cell})*\Z')
    reopened = re.compile(rf'{body}"(?:{d}{cell})*{d}"{body}\Z')
    staying = re.compile(rf"{body}\Z")

    def effects(line):
        if '"' not in line:
            return OUTSIDE, INSIDE
        outside = OUTSIDE if closed.match(line) else INSIDE if opened.match(line) else BROKEN
        inside = (
            INSIDE if staying.match(line) or reopened.match(line) else OUTSIDE if resumed.match(line) else BROKEN
        )
        return outside, inside

    return effects


def quoting_summary(spark, path, delimiter=","):
    """Per file split: the state at its end and its first broken line, for both starts.

    Rows: file, block, lines, end_outside, bad_outside, end_inside, bad_inside, spans;
    `spans` tells whether a record goes over a line end when the split starts outside. A line without quotes keeps
    the state, so only the others leave the JVM.
    """
    effects_of = _line_effects(delimiter)

    def fold(batches):
        splits = {}
        for batch in batches:
            for file, block, place, value in zip(batch["file"], batch["block"], batch["place"], batch["value"]):
                state = splits.setdefault((file, block), [OUTSIDE, -1, INSIDE, -1, False])
                steps = effects_of(value)
                for start in (0, 2):
                    if state[start] != BROKEN:
                        state[start] = steps[state[start]]
                        if state[start] == BROKEN:
                            state[start + 1] = place
                state[4] = state[4] or state[0] == INSIDE
        yield pd.DataFrame(
            [(f, b, *s) for (f, b), s in splits.items()],
            columns=["file", "block", "end_outside", "bad_outside", "end_inside", "bad_inside", "spans"],
        )

    all_lines = lines(spark, path)
    quoted = all_lines.where(F.contains("value", F.lit('"'))).select("file", "block", "place", F.regexp_replace("value", f"^{BOM}", "").alias("value"))
    folded = quoted.mapInPandas(
        fold,
        "file string, block bigint, end_outside int, bad_outside bigint, end_inside int, bad_inside bigint, spans boolean",
    )
    counts = all_lines.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("place").alias("place"))
    return counts.join(folded, ["file", "block"], "left").select(
        "file", "block", "lines",
        F.coalesce("end_outside", F.lit(OUTSIDE)).alias("end_outside"), (F.col("bad_outside") - F.col("place")).alias("bad_outside"),
        F.coalesce("end_inside", F.lit(INSIDE)).alias("end_inside"), (F.col("bad_inside") - F.col("place")).alias("bad_inside"),
        F.coalesce("spans", F.lit(False)).alias("spans"),
    )


def quoting_report(spark, path, delimiter=","):
    """One row per file: file, lines, line (number of the first malformed one, null if none) and spans.

    The splits of a file are folded in order, each from the state that the one before leaves.
    """
    split = F.struct("block", "lines", "end_outside", "bad_outside", "end_inside", "bad_inside", "spans")
    files = quoting_summary(spark, path, delimiter).groupBy("file").agg(F.sort_array(F.collect_list(split)).alias("splits"))
    start = "named_struct('state', {}, 'lines', 0L, 'line', cast(null as bigint), 'spans', false)".format(OUTSIDE)

    def step(s, x):
        outside = s["state"] == OUTSIDE
        end = F.when(outside, x["end_outside"]).otherwise(x["end_inside"])
        bad = F.when(outside, x["bad_outside"]).otherwise(x["bad_inside"])
        return F.struct(
            F.when(s["state"] == BROKEN, BROKEN).otherwise(end).alias("state"), (s["lines"] + x["lines"]).alias("lines"),
            F.coalesce(s["line"], F.when((s["state"] != BROKEN) & (end == BROKEN), s["lines"] + bad + 1)).alias("line"),
            F.when(s["state"] == BROKEN, s["spans"]).otherwise(s["spans"] | ~outside | x["spans"]).alias("spans"),
        )

    folded = files.select("file", F.aggregate("splits", F.expr(start), step).alias("s"))
    line = F.when(F.col("s.state") == INSIDE, F.col("s.lines")).otherwise(F.col("s.line"))  # a cell open at the end
    return folded.select("file", "s.lines", line.alias("line"), "s.spans")


def quoting_audit(spark, path, delimiter=","):
    """(line number of the first malformed record or None, whether any record spans lines), by file order."""
    report = kept(quoting_report(spark, path, delimiter), "quoting")  # one row per file
    broken = report.where("line IS NOT NULL").orderBy("file").select("line").first()
    spans = report.agg(F.coalesce(F.bool_or("spans"), F.lit(False))).first()[0]
    return (broken[0] if broken else None), spans


def header_faults(names):
    """(code, text) of every rule that some header breaks."""
    rules = {
        ("HEADERS", "Every column needs a name."): [n for n in names if not n.strip()] if names else [None],
        ("HEADERS", "Column names must differ."): [n for n, times in Counter(names).items() if times > 1],
        ("DATA_LIMIT", f"A column name has more than {MAX_HEADER} characters."): [n for n in names if len(n) > MAX_HEADER],
        ("HEADERS", "Column names cannot hold control characters."): [n for n in names if CONTROL.search(n)],
    }
    return [rule for rule, broken_by in rules.items() if broken_by]


def require_headers(names):
    """Headers are present, unique, short and free of control characters."""
    for code, text in header_faults(names):
        raise TableError(code, text, "Fix the header.", row=1)


def require_rows(df):
    if df.limit(1).count() == 0:
        raise TableError("NO_DATA", "The table has no records.", "Choose a table with data.")
    return df
