"""Type detection and column profiles over every row of a table.

The whole table is read once, turned into (column, value) pairs and reduced to its
distinct values before any of them is interpreted. Facts about a column hold for every
possible type, so changing a type later needs no second scan.
"""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.contracts import ColumnProfile, ColumnType, Schema
from tabloom.errors import TableError
from tabloom.functions.interpret import (
    has_leading_zero,
    is_missing,
    number_error,
    raw_of,
    stripped,
    to_boolean,
    to_date,
    to_number,
)
from tabloom.functions.names import by_place, col

# Which names look like identifiers, and the limits behind each warning.
IDENTIFIER_NAMES = ("id", "uuid", "guid", "identifier")
IDENTIFIER_SUFFIX = "_id"
IDENTIFIER_ROWS = 10
IDENTIFIER_RATIO = 0.9
MANY_CATEGORIES = 50
CARDINALITY_ROWS = 20
CARDINALITY_RATIO = 0.8
LONG_TEXT = 200
SAMPLES = 3

# Text beyond this length is grouped by its digest, so that long documents do not travel
# through the shuffle. Its interpretation is worked out before grouping instead.
DIGEST_LENGTH = 256


# Source kinds as bits, so that the kinds seen in a column combine in one integer.
KIND_BITS = {"text": 1, "number": 2, "boolean": 4}


def _nested(df, name):
    return df.schema[name].dataType.typeName() == "struct"


def cells(df, row_id, columns=None):
    """One row per cell: column position, row id, raw text (null when missing), kind bit."""
    names = [n for n in df.columns if n != row_id] if columns is None else list(columns)
    if not names:
        raise TableError("HEADERS", "The table has no columns to profile.")

    def cell(position, name):
        raw = F.when(~is_missing(raw_of(df, name)), raw_of(df, name))
        bit = F.lit(KIND_BITS["text"])
        if _nested(df, name):
            source = col(name).getField("kind")
            bit = (
                F.when(source == "number", KIND_BITS["number"])
                .when(source == "boolean", KIND_BITS["boolean"])
                .otherwise(KIND_BITS["text"])
            )
        return F.struct(F.lit(position).alias("position"), raw.alias("raw"), bit.alias("kind"))

    # Generated rows rather than `unpivot`: the planner recognises two uses of them as
    # one, which it does not for the expansion behind `unpivot`.
    rows = F.inline(F.array(*[cell(i, n) for i, n in enumerate(names)]))
    return df.select(col(row_id).alias("row_id"), rows), names


def _distinct(long):
    """Distinct values per column and kind, with copies counted and the first row kept.

    What a long text can be read as is found before grouping and rides along in the key,
    which it cannot split because it follows from the text.
    """
    far = F.char_length("raw") > DIGEST_LENGTH
    raw = F.col("raw")
    return (
        long.select(
            "position",
            "row_id",
            "kind",
            raw.isNotNull().alias("present"),
            F.when(~far, raw).alias("short"),
            F.when(far, F.md5(raw)).alias("digest"),
            F.when(far, to_number(raw)).alias("far_number"),
            F.when(far, number_error(raw) == "PRECISION").alias("far_precision"),
            F.when(far, has_leading_zero(raw)).alias("far_zero"),
            F.when(far, F.char_length(raw)).alias("far_length"),
        )
        .groupBy(
            "position", "kind", "present", "short", "digest",
            "far_number", "far_precision", "far_zero", "far_length",
        )
        .agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))
    )


def _read(distinct):
    """Each distinct value read as every type, once."""
    short, near, kind = F.col("short"), F.col("short").isNotNull(), F.col("kind")
    plain = kind != KIND_BITS["boolean"]
    error = F.col("error")
    return (
        distinct.withColumn("error", number_error(short))
        .select(
            "position",
            "present",
            "n",
            "first_row",
            "short",
            "digest",
            "kind",
            F.when(plain, F.when(near & error.isNull(), stripped(short).try_cast("double")).otherwise(
                F.col("far_number"))).alias("number"),
            to_boolean(short).alias("flag"),
            to_date(short).isNotNull().alias("is_date"),
            (plain & F.coalesce(error == "PRECISION", "far_precision", F.lit(False))).alias("precision"),
            ((kind == KIND_BITS["text"]) & F.coalesce(has_leading_zero(short), "far_zero", F.lit(False))).alias("leading_zero"),
            F.coalesce(F.char_length(short), "far_length").alias("length"),
        )
        # Adding zero turns -0.0 into 0.0, so the two count as one value.
        .withColumn("number", F.col("number") + F.lit(0.0))
    )


def column_facts(df, row_id, columns=None):
    """One row per column with all counts any later type decision needs.

    Every aggregation buffer has a fixed width, so all of them run as hash aggregations.
    """
    long, names = cells(df, row_id, columns)
    distinct = _distinct(long)
    rows = _read(distinct)
    present, number, n, flag = F.col("present"), F.col("number"), F.col("n"), F.col("flag")

    def kept(condition, value):
        return F.sum(F.when(condition, value).otherwise(0))

    rows = rows.withColumn("n_number", F.when(number.isNotNull(), n).otherwise(0))
    if any(_nested(df, name) for name in names):
        # The same text may come with several kinds; merge them before counting texts.
        rows = rows.groupBy("position", "present", "short", "digest").agg(
            F.sum("n").alias("n"),
            F.min("first_row").alias("first_row"),
            F.max("number").alias("number"),
            F.sum("n_number").alias("n_number"),
            F.bool_or("flag").alias("flag"),
            F.bool_or("is_date").alias("is_date"),
            F.bool_or("precision").alias("precision"),
            F.bool_or("leading_zero").alias("leading_zero"),
            F.max("length").alias("length"),
            F.bit_or("kind").alias("kind"),
        )
    # Equal numbers written differently meet here; every other value of a column shares
    # one null group, already reduced to a single row per task before the shuffle.
    grouped = rows.groupBy("position", "number").agg(
        F.sum("n").alias("n"),
        F.min(F.when(present, F.col("first_row"))).alias("first_row"),
        kept(present, n).alias("n_present"),
        kept(present, F.lit(1)).alias("raw_distinct"),
        F.min(F.when(present, n)).alias("raw_smallest"),
        F.sum("n_number").alias("n_number"),
        kept(flag.isNotNull(), n).alias("n_boolean"),
        kept(flag, n).alias("n_true"),
        kept(F.col("is_date"), n).alias("n_date"),
        F.bool_or("precision").alias("precision"),
        F.bool_or("leading_zero").alias("leading_zero"),
        F.max("length").alias("longest"),
        F.bit_or(F.when(present, F.col("kind"))).alias("kind"),
    )
    valued = number.isNotNull()
    facts = grouped.groupBy("position").agg(
        F.sum("n").alias("n_rows"),
        F.min("first_row").alias("first_row"),
        F.sum("n_present").alias("n_present"),
        F.sum("raw_distinct").alias("raw_distinct"),
        F.min("raw_smallest").alias("raw_smallest"),
        F.sum("n_number").alias("n_number"),
        F.count(number).alias("number_distinct"),
        F.min(F.when(valued, F.col("n_present"))).alias("number_smallest"),
        F.coalesce(F.bool_and(F.when(valued, number == F.floor(number))), F.lit(False)).alias("integral"),
        F.sum("n_boolean").alias("n_boolean"),
        F.sum("n_true").alias("n_true"),
        F.sum("n_date").alias("n_date"),
        F.coalesce(F.bool_or("precision"), F.lit(False)).alias("precision"),
        F.coalesce(F.bool_or("leading_zero"), F.lit(False)).alias("leading_zero"),
        F.coalesce(F.max("longest"), F.lit(0)).alias("longest"),
        F.coalesce(F.bit_count(F.bit_or("kind")) > 1, F.lit(False)).alias("mixed_kinds"),
    )
    # At most three rows per column reach this join, so it is always a small broadcast.
    facts = facts.join(F.broadcast(_samples(long, distinct)), "position", "left")
    names_by_position = F.array(*[F.lit(n) for n in names])
    return facts.select(
        "position",
        F.element_at(names_by_position, F.col("position") + 1).alias("name"),
        *[c for c in facts.columns if c not in ("position", "samples")],
        # Asking for the first row here keeps both uses of the distinct values alike.
        F.when(F.col("first_row").isNull(), F.array().cast("array<string>"))
        .otherwise(F.col("samples"))
        .alias("samples"),
    )


def _samples(long, distinct):
    """The first three distinct texts per column, by row id.

    Every task ranks its own rows and sends on only the best few, so a column with
    billions of distinct values is no hot spot. Nothing is filtered or dropped below the
    rank: the plan up to there equals that of the facts, and its shuffle is reused.
    """
    # One text can occur once per kind, so keep enough candidates for three texts.
    order = Window.partitionBy("position").orderBy(F.col("present").desc(), "first_row")
    first = (
        distinct.withColumn("rank", F.row_number().over(order))
        .where((F.col("rank") <= SAMPLES * len(KIND_BITS)) & (F.col("n") > 0))
        .where("present")
        .groupBy("position", "short", "digest")
        .agg(F.min("first_row").alias("row_id"))
    )
    # Only sampled long texts are fetched again by row id; with none, AQE drops the scan.
    far = first.where(F.col("digest").isNotNull()).select("position", "row_id")
    found = (
        long.where(F.char_length("raw") > DIGEST_LENGTH)
        .join(F.broadcast(far), ["position", "row_id"])
        .select("position", "row_id", "raw")
    )
    near = first.where(F.col("digest").isNull()).select("position", "row_id", F.col("short").alias("raw"))
    ordered = F.slice(F.array_sort(F.collect_list(F.struct("row_id", "raw"))), 1, SAMPLES)
    return (
        near.unionByName(found)
        .groupBy("position")
        .agg(F.transform(ordered, lambda s: s["raw"]).alias("samples"))
    )


def _detected():
    """First matching rule decides; the order of the rules is part of the contract."""
    c = F.col
    low = F.lower(c("name"))
    identifier = (
        (low.isin(*IDENTIFIER_NAMES) | low.endswith(IDENTIFIER_SUFFIX))
        & (c("n_present") >= IDENTIFIER_ROWS)
        & (c("raw_distinct") / c("n_present") >= IDENTIFIER_RATIO)
    )
    return (
        F.when(c("n_present") == 0, ColumnType.UNKNOWN.value)
        .when(identifier, ColumnType.IDENTIFIER.value)
        .when(c("n_boolean") == c("n_present"), ColumnType.BOOLEAN.value)
        .when(c("n_date") == c("n_present"), ColumnType.DATE.value)
        .when((c("n_number") == c("n_present")) & ~c("leading_zero"), ColumnType.NUMBER.value)
        .otherwise(ColumnType.CATEGORY.value)
    )


def _by_type(number, boolean, text):
    effective = F.col("effective")
    return (
        F.when(effective == ColumnType.UNKNOWN.value, F.lit(0))
        .when(effective == ColumnType.NUMBER.value, number)
        .when(effective == ColumnType.BOOLEAN.value, boolean)
        .otherwise(text)
    )


def profile(facts, overrides=None):
    """Profile rows from facts; `overrides` maps column names to a chosen type."""
    overrides = overrides or {}
    chosen = reduce(
        lambda chain, item: chain.when(F.col("name") == item[0], F.lit(str(item[1]))),
        overrides.items(),
        F.when(F.lit(False), F.lit(None).cast("string")),
    )
    c = F.col
    n_false = c("n_boolean") - c("n_true")
    flags = (c("n_true") > 0).cast("bigint") + (n_false > 0).cast("bigint")
    rarer_flag = F.least(
        F.when(c("n_true") > 0, c("n_true")), F.when(n_false > 0, n_false)
    )
    typed = (
        facts.withColumn("detected", _detected())
        .withColumn("overridden", chosen.isNotNull())
        .withColumn("effective", F.coalesce(chosen, "detected"))
        .withColumn("distinct_count", _by_type(c("number_distinct"), flags, c("raw_distinct")).cast("bigint"))
        .withColumn("smallest_class", _by_type(c("number_smallest"), rarer_flag, c("raw_smallest")).cast("bigint"))
    )
    category = c("effective") == ColumnType.CATEGORY.value
    many = (c("distinct_count") > MANY_CATEGORIES) | (
        (c("n_present") >= CARDINALITY_ROWS)
        & (c("distinct_count") / c("n_present") > CARDINALITY_RATIO)
    )
    texts = c("detected").isin(ColumnType.CATEGORY.value, ColumnType.IDENTIFIER.value)
    warnings = F.array_compact(F.array(
        F.when(c("mixed_kinds") & texts & ~c("overridden"), "MIXED_KINDS"),
        F.when(c("leading_zero") & (c("detected") != ColumnType.NUMBER.value), "LEADING_ZEROS"),
        F.when(c("precision") & (c("effective") != ColumnType.NUMBER.value), "PRECISION"),
        F.when(category & many, "HIGH_CARDINALITY"),
        F.when(c("longest") > LONG_TEXT, "LONG_TEXT"),
    ))
    missing = c("n_rows") - c("n_present")
    return typed.select(
        "position",
        "name",
        "detected",
        "effective",
        "overridden",
        c("n_rows").alias("row_count"),
        missing.alias("missing_count"),
        (F.lit(100.0) * missing / c("n_rows")).alias("missing_percent"),
        "distinct_count",
        "smallest_class",
        "integral",
        "samples",
        warnings.alias("warnings"),
    )


def collect_schema(profiled, revision=0, fingerprint=None):
    """Bring the profile, one row per column, to the driver."""
    rows = sorted(profiled.collect(), key=lambda r: r["position"])
    if not rows or not rows[0]["row_count"]:
        raise TableError("NO_DATA", "The table has no rows.", "Choose a table with data.")
    return Schema(
        tuple(
            ColumnProfile(
                r["position"], r["name"], r["detected"], r["effective"], r["missing_count"],
                r["distinct_count"], tuple(r["samples"]), tuple(r["warnings"]), r["overridden"],
                r["integral"], r["smallest_class"],
            )
            for r in rows
        ),
        rows[0]["row_count"],
        revision,
        fingerprint,
    )


def infer_schema(df, row_id, fingerprint=None):
    """Profile every column over all rows and collect the result. Names may differ by case only."""
    placed, place = by_place(df)
    back = F.create_map(*[F.lit(x) for n, c in place.items() for x in (c, n)])
    facts = column_facts(placed, place[row_id]).withColumn("name", back[F.col("name")])
    return collect_schema(profile(facts), fingerprint=fingerprint)
