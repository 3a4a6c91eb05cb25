"""Synthetic example tables of any size, computed from a row number column `i`."""

from pyspark.sql import functions as F

from tabloom.errors import TableError


def _tenths(c):
    return c / F.lit(10.0)


def _classification(i):
    return {
        "signal": F.round((i % 2) * 4 + _tenths((i * 7) % 13), 2),
        "variation": F.round(_tenths((i * 11) % 17), 2),
        "outcome": F.when(i % 2 == 1, "on").otherwise("off"),
    }


def _regression(i):
    length, width = i % 20, (i * 7) % 11
    return {
        "length": length,
        "width": width,
        "response": F.round(3.2 * length - 1.7 * width + _tenths(i % 5 - 2), 2),
    }


def _clustering(i):
    return {
        "x": F.round((i % 3) * 5 + _tenths((i * 7) % 11), 2),
        "y": F.round((i % 3) * -4 + _tenths((i * 13) % 17), 2),
    }


def _reduction(i):
    length = i % 20 + 1
    return {
        "length": length,
        "width": F.round(0.8 * length + _tenths(i % 3), 2),
        "mass": F.round(1.2 * length + _tenths((i * 7) % 11), 2),
    }


def _mixed(i):
    region = F.array(F.lit("North"), F.lit("East"), F.lit("West"))
    return {
        "customer_id": F.concat(F.lit("demo_"), F.lpad(i.cast("string"), F.greatest(F.lit(3), F.length(i.cast("string"))), F.lit("0"))),
        "age": (20 + (i * 7) % 45).cast("string"),
        "income": F.when(i % 13 == 0, "").otherwise((2000 + (i * 137) % 5000).cast("string")),
        "zip_code": F.lpad((i % 5 + 1).cast("string"), 4, "0"),
        "region": F.element_at(region, (i % 3 + 1).cast("int")),
        "active": F.when(i % 2 == 1, "true").otherwise("false"),
        "joined": F.concat(F.lit("2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0")),
        "outcome": F.when(i % 3 == 0, "left").otherwise("retained"),
    }


TABLES = {
    "classification": (_classification, 80, "csv"),
    "regression": (_regression, 80, "tsv"),
    "clustering": (_clustering, 90, "csv"),
    "reduction": (_reduction, 60, "jsonl"),
    "mixed": (_mixed, 90, "csv"),
}


def example_columns(name, i):
    if name not in TABLES:
        raise TableError("EXAMPLE", "There is no such example table.")
    return TABLES[name][0](i)


def example_table(spark, name, rows=None):
    """An example table with `row_id`; `rows` defaults to its customary size."""
    size = TABLES[name][1] if rows is None else rows
    columns = example_columns(name, F.col("row_id"))
    return spark.range(size).withColumnRenamed("id", "row_id").select("row_id", *[c.alias(n) for n, c in columns.items()])
