"""Column profiles, type changes, previews and table audits."""

from pyspark.sql import functions as F

from tabloom.contracts import ColumnType
from tabloom.operators.override import override_failures, preview_rows
from tabloom.operators.profile import column_facts, profile
from tabloom.plans.catalog import query, table
from tabloom.plans.text_tables import (
    TEXT_LINEITEM,
    TEXT_LINEITEM_COLUMNS,
    TEXT_ORDERS,
    TEXT_ORDERS_COLUMNS,
    number_sql,
    profile_sql,
    text_lineitem,
    text_orders,
)
from tabloom.sources.audits import cell_limits
from tabloom.sources.fingerprint import fingerprint

ORDERS_PROFILE = profile_sql(TEXT_ORDERS, TEXT_ORDERS_COLUMNS)
LINEITEM_PROFILE = profile_sql(TEXT_LINEITEM, TEXT_LINEITEM_COLUMNS, samples=False)


def orders_profile(spark, directory):
    return profile(column_facts(text_orders(spark, directory), "row_id")).withColumns({
        "samples": F.array_join("samples", "|"),
        "warnings": F.array_join("warnings", ","),
    })


@query(ORDERS_PROFILE + """
SELECT position, name, detected, missing_count, round(100.0 * missing_count / row_count, 6)::double AS missing_percent,
  distinct_count, coalesce(samples, '') AS samples, warnings FROM profile""")
def profile_full(spark, directory):
    return orders_profile(spark, directory).select(
        "position", "name", "detected", "missing_count", F.round("missing_percent", 6).alias("missing_percent"),
        "distinct_count", "samples", "warnings",
    )


@query(LINEITEM_PROFILE + "SELECT name, detected FROM profile")
def profile_types(spark, directory):
    return profile(column_facts(text_lineitem(spark, directory), "row_id")).select("name", "detected")


@query(ORDERS_PROFILE + """
SELECT name, row_count, missing_count, round(100.0 * missing_count / row_count, 6)::double AS missing_percent FROM profile""")
def profile_missing(spark, directory):
    return orders_profile(spark, directory).select(
        "name", "row_count", "missing_count", F.round("missing_percent", 6).alias("missing_percent")
    )


@query(LINEITEM_PROFILE + "SELECT name, distinct_count, smallest_class FROM profile")
def profile_distinct(spark, directory):
    return profile(column_facts(text_lineitem(spark, directory), "row_id")).select("name", "distinct_count", "smallest_class")


@query(ORDERS_PROFILE + "SELECT name, coalesce(samples, '') AS samples FROM profile")
def profile_samples(spark, directory):
    return orders_profile(spark, directory).select("name", "samples")


@query(ORDERS_PROFILE + "SELECT name, warnings FROM profile")
def profile_warnings(spark, directory):
    return orders_profile(spark, directory).select("name", "warnings")


OVERRIDES = {"price": ColumnType.NUMBER, "priority": ColumnType.NUMBER, "serial": ColumnType.NUMBER,
             "zip": ColumnType.NUMBER, "status": ColumnType.BOOLEAN, "day": ColumnType.DATE, "level": ColumnType.DATE}


def _failures_sql():
    value, _ = number_sql("x")
    fits = {
        ColumnType.NUMBER: f"({value}) IS NOT NULL",
        ColumnType.BOOLEAN: "lower(x) IN ('true', 'false')",
        ColumnType.DATE: "regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(x AS date) IS NOT NULL",
    }
    parts = [
        f"SELECT '{n}' AS name, row_id FROM (SELECT {n} AS x, row_id FROM t) WHERE coalesce(x, '') <> '' AND NOT coalesce(({fits[k]}), false)"
        for n, k in OVERRIDES.items()
    ]
    return f"""WITH {TEXT_ORDERS}, failing AS ({" UNION ALL ".join(parts)})
    SELECT name, count(*) AS failures,
      array_to_string(list_slice(list_sort(list(row_id)), 1, 5), ',') AS first_rows FROM failing GROUP BY name"""


@query(_failures_sql(), name="override_failures")
def override_failure_rows(spark, directory):
    found = override_failures(text_orders(spark, directory), "row_id", OVERRIDES)
    return found.select("name", "failures", F.array_join(F.col("first_rows").cast("array<string>"), ",").alias("first_rows"))


@query(f"""WITH {TEXT_ORDERS} SELECT row_id, {", ".join(f"nullif({c}, '') AS {c}" for c in TEXT_ORDERS_COLUMNS)}
FROM t ORDER BY row_id LIMIT 50""")
def preview_50(spark, directory):
    return preview_rows(text_orders(spark, directory), "row_id")


@query("""
SELECT n AS rows, name, longest FROM (
  SELECT count(*) AS n, coalesce(max(length(text)), 0) AS text, coalesce(max(length(lang)), 0) AS lang,
    coalesce(max(length(source)), 0) AS source FROM documents)
UNPIVOT (longest FOR name IN (text, lang, source))""", name="cell_limits")
def cell_limit_audit(spark, directory):
    return cell_limits(table(spark, directory, "documents"), ["text", "lang", "source"])


_CELLS = " || ".join(
    f"CASE WHEN coalesce({c}, '') = '' THEN '-' ELSE 't' || length({c}) || ':' || {c} END" for c in TEXT_ORDERS_COLUMNS
)
_HEAD = "[" + ",".join(f'"{c}"' for c in TEXT_ORDERS_COLUMNS) + "]"


@query(f"""WITH {TEXT_ORDERS}, sums AS (
  SELECT count(*) AS row_count, sum(('0x' || substr(md5({_CELLS}), 1, 15))::bigint)::hugeint AS digest_sum FROM t)
SELECT row_count, sha256('{_HEAD}' || '|' || row_count::varchar || '|' || digest_sum::varchar) AS fingerprint FROM sums""", name="fingerprint")
def content_fingerprint(spark, directory):
    return fingerprint(text_orders(spark, directory), list(TEXT_ORDERS_COLUMNS))
