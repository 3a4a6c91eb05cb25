"""Changing the type of a column after checking every value it holds."""

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.contracts import ColumnType
from tabloom.errors import TableError
from tabloom.functions.interpret import interpreted, is_missing, raw_of
from tabloom.functions.names import col
from tabloom.functions.text import visible_text
from tabloom.operators.profile import collect_schema, column_facts, profile

SHOWN_FAILURES = 5
PREVIEW_ROWS = 50


def override_failures(df, row_id, kinds):
    """How many present values of each column do not fit its wanted type, and the first rows.

    `kinds` maps columns to types. All columns share one scan; only failing cells are
    grouped, and each task sends at most five row ids per column on to the ranking.
    """
    names = list(kinds)
    checks = [
        F.when(
            ~is_missing(raw_of(df, n)) & interpreted(raw_of(df, n), kinds[n]).isNull(), F.lit(n)
        )
        for n in names
    ]
    failing = df.select(col(row_id).alias("row_id"), F.explode(F.array_compact(F.array(*checks))).alias("name"))
    order = Window.partitionBy("name").orderBy("row_id")
    first = (
        failing.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= SHOWN_FAILURES)
        .groupBy("name")
        .agg(F.array_sort(F.collect_list("row_id")).alias("first_rows"))
    )
    return failing.groupBy("name").agg(F.count("*").alias("failures")).join(first, "name")


def change_type(df, row_id, schema, name, kind, facts=None):
    """New schema with one column read as `kind`; None goes back to the detected type.

    Refuses when any present value does not fit, telling how many and where, never what.
    """
    before = schema[name]
    if kind is not None and kind not in set(ColumnType) - {ColumnType.UNKNOWN}:
        raise TableError("TYPE", "This is not a type to choose.", "Choose another type.", column=name)
    if kind is not None and before.missing_count == schema.rows:
        raise TableError("TYPE_EMPTY", "The column holds no values.", "Choose another column.", column=name)
    effective = before.detected if kind is None else ColumnType(kind)
    if effective != ColumnType.UNKNOWN:
        found = override_failures(df, row_id, {name: effective}).first()
        if found:
            shown = ", ".join(str(r) for r in found["first_rows"])
            raise TableError(
                "TYPE_VALUES",
                f"{found['failures']} values do not fit this type, first in rows {shown}.",
                "Keep the type or use Category.",
                row=found["first_rows"][0],
                column=name,
            )
    facts = column_facts(df, row_id, [name]) if facts is None else facts.where(F.col("name") == name)
    new = collect_schema(profile(facts, {} if kind is None else {name: effective})).columns[0]
    new = replace(new, position=before.position)
    return replace(
        schema,
        columns=tuple(new if c.name == name else c for c in schema.columns),
        revision=schema.revision + 1,
    )


def preview_rows(df, row_id, limit=PREVIEW_ROWS, text_limit=None):
    """The first rows by id with missing cells null and control characters made visible."""
    first = df.orderBy(col(row_id)).limit(limit)
    names = [n for n in df.columns if n != row_id]
    return first.select(
        col(row_id),
        *[visible_text(F.when(~is_missing(raw_of(df, n)), raw_of(df, n)), text_limit).alias(n) for n in names],
    )


def preview(df, row_id, schema, text_limit=None):
    """Shape of the table, a summary per column, and its first rows."""
    shown = min(PREVIEW_ROWS, schema.rows)
    return {
        "row_count": schema.rows,
        "column_count": len(schema.columns),
        "shown_rows": shown,
        "columns": [
            {
                "name": c.name,
                "type": str(c.effective),
                "detected": str(c.detected),
                "overridden": c.overridden,
                "missing_count": c.missing_count,
                "missing_percent": 100 * c.missing_count / schema.rows,
                "distinct_count": c.distinct_count,
                "samples": list(c.samples),
                "warnings": list(c.warnings),
            }
            for c in schema.columns
        ],
        "rows": [list(r)[1:] for r in sorted(preview_rows(df, row_id, text_limit=text_limit).collect())],
    }
