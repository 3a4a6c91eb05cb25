"""Reading comma- or tab-separated text without interpreting a single cell."""

import csv

from pyspark.sql import functions as F

from tabloom.errors import TableError
from tabloom.sources import audits
from tabloom.sources.records import spanning_records
from tabloom.sources.scratch import kept

CORRUPT = "__malformed"
#: Files whose headers' places may be literals of the plan.
LITERAL_FILES = 100


def header(spark, path, delimiter=","):
    """Column names from the first non-empty line."""
    return _names(_first_line(spark, path), delimiter)


def _first_line(spark, path):
    first = spark.read.text(path).select(audits.content("value").alias("value")).where("value != ''").first()
    if first is None:
        raise TableError("NO_DATA", "The file is empty.", "Choose a file with data.")
    return first[0]


def _names(line, delimiter):
    if not line.strip(" \t") and delimiter not in line:
        raise TableError("HEADERS", "Every column needs a name.", "Fix the header.", row=1)
    names = next(csv.reader([line], delimiter=delimiter))
    audits.require_headers(names)
    return names


def read_delimited(spark, path, delimiter=",", multiline=None, malformed="fail", audit=True, places=False):
    """All cells as text under their exact headers.

    Every file starts with the same header. Only empty lines are no records; one of blanks
    or delimiters is. Large files are split over tasks, also where quoted cells hold line breaks
    (`multiline=None` looks for such cells; see `records`). `malformed` is `fail` or `quarantine`; the latter
    keeps records of another width and shows their text in a column of its own.

    One pass over the lines checks headers, encoding and widths and finds the places of the headers; a
    second, over lines with quotes, runs only if there are any. Without `audit` neither quoting nor widths are checked.
    Errors name the line where it is known, counted in its file. `places` adds the columns that
    `with_file_order` numbers rows by, which a table of spanning records needs.
    """
    if malformed not in ("fail", "quarantine"):
        raise ValueError("malformed is fail or quarantine")
    first = _first_line(spark, path)
    names = _names(first, delimiter)
    text = audits.with_place(spark.read.text(path))
    splits = kept(audits.split_summary(text, first, _wrong_width(len(names), delimiter) if audit else None), "splits")  # one row per split
    facts = splits.agg(
        F.bool_or("quotes").alias("quotes"), F.bool_or("odd").alias("odd"), F.sum("filled").alias("filled"),
        F.count("head").alias("heads"), F.count_if(~F.col("head").eqNullSafe(F.col("same")) & F.col("head").isNotNull()).alias("others"),
    ).first()
    if audit:
        line = audits.first_place(splits, "bad")
        if line is not None:
            raise TableError("ENCODING", "The text is not UTF-8.", "Save it as UTF-8.", row=line)
    if facts["others"]:
        _require_same_headers(text, splits, names, delimiter)
    if audit:
        line, spans = audits.quoting_audit(spark, path, delimiter) if facts["quotes"] else (None, False)
        if line is not None:
            raise TableError("CSV_QUOTES", "Quotes are malformed.", "Fix the quoting.", row=line)
        multiline = spans if multiline is None else multiline
    elif multiline is None:
        multiline = facts["odd"]
    if multiline:
        rows = spanning_records(spark, path)
    else:
        rows = _without_headers(text, splits, facts["heads"])
        if places:
            file, block = F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block")
            rows = rows.select("value", file, block, F.monotonically_increasing_id().alias("__place"))
    more = ["__path", "__block", "__place"] if places else []
    cells = [F.col(f"c{i}").alias(n) for i, n in enumerate(names)]
    if malformed == "quarantine":
        return _parsed(rows, len(names), delimiter, True, more).select(*cells, CORRUPT, *more)
    if audit:
        _require_widths(rows, splits, len(names), delimiter, multiline)
        if facts["filled"] <= facts["heads"]:
            raise TableError("NO_DATA", "The table has no records.", "Choose a table with data.")
    return _parsed(rows, len(names), delimiter, False, more).select(*cells, *more)


def _wrong_width(width, delimiter):
    """Whether a line holds another number of cells; only lines with quotes are parsed for it."""
    value = F.col("value")
    cells = F.char_length(value) - F.char_length(F.translate(value, delimiter, "")) + 1
    parsed = F.from_csv(value, _fields(width, True), _options(delimiter)).getField(CORRUPT).isNotNull()
    return F.when(F.contains(value, F.lit('"')), parsed).otherwise(cells != width)


def _without_headers(text, splits, files):
    """Lines that are records. Many files have their headers' places joined, not written into the plan."""
    rows, heads = text.where(audits.content("value") != ""), splits.where("head IS NOT NULL").select("head")
    if files <= LITERAL_FILES:
        return rows.where(~F.col(audits.PLACE).isin([r[0] for r in heads.collect()]))
    return rows.join(F.broadcast(heads), F.col(audits.PLACE) == F.col("head"), "left_anti")  # a number per file


def _require_same_headers(text, splits, names, delimiter):
    """The first non-empty line of every file gives the same names in the same order; one job for all files."""
    other = splits.where("head IS NOT NULL AND NOT head <=> same").select("head")
    lines = text.join(F.broadcast(other), F.col(audits.PLACE) == F.col("head"))
    parsed = F.from_csv(audits.content("value"), _fields(len(names), True), _options(delimiter)).alias("r")
    fits = F.col(f"r.{CORRUPT}").isNull()
    for i, n in enumerate(names):
        fits = fits & F.col(f"r.c{i}").eqNullSafe(F.lit(n))
    if lines.select(parsed).where(~fits).limit(1).count():
        raise TableError("HEADERS", "The files have different headers.", "Give files of one table.", row=1)


def _require_widths(rows, splits, width, delimiter, multiline):
    if multiline:
        line, wrong = None, rows.where(_wrong_width(width, delimiter)).limit(1).count()
    else:
        line = wrong = audits.first_place(splits, "ragged")
    if wrong:
        raise TableError("ROW_WIDTH", "Some records do not match the header.", "Fix or quarantine them.", row=line)


def _options(delimiter):
    return {
        "sep": delimiter, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false", "columnNameOfCorruptRecord": CORRUPT,
    }


def _fields(width, whole):
    return ", ".join([f"c{i} string" for i in range(width)] + ([f"{CORRUPT} string"] if whole else []))


def _parsed(rows, width, delimiter, whole, more):
    """Cells of records. Without `whole`, widths are not checked."""
    return rows.select(F.from_csv("value", _fields(width, whole), _options(delimiter)).alias("r"), *more).select("r.*", *more)


def write_delimited(df, path, delimiter=","):
    """Write text cells so that `read_delimited` gives them back."""
    df.write.option("sep", delimiter).option("header", True).option("quote", '"').option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
