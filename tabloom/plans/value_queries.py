"""Reading single text values: numbers, booleans, dates, labels, categories."""

from pyspark.sql import functions as F

from tabloom.contracts import ColumnType
from tabloom.functions import (
    interpreted,
    marked,
    number_error,
    raw_records,
    target_labels,
    to_boolean,
    to_date,
    to_number,
    typed_view,
    visible_text,
)
from tabloom.plans.catalog import query, table
from tabloom.plans.text_tables import TEXT_ORDERS, number_sql, text_orders

# Spellings around the quantity of every line item; {q} is that quantity.
SPELLINGS = (
    "{q}", " {q} ", "+{q}.50", "-{q}e-3", ".{q}", "{q}.", "{q}E+2", "00{q}", "$" + "{q}", "1,0{q}", "{q}e400", "NaN",
    "90071992547409{q}", "9007199254740993.{q}", "9007199254740993.0", "{q}00000000000000000000e-20", "{q}d", "1e-400",
)


def _spelled():
    q = F.col("l_quantity").cast("int").cast("string")
    which = F.col("l_partkey") % len(SPELLINGS)
    chain = F.when(F.lit(False), F.lit(""))
    for i, s in enumerate(SPELLINGS):
        chain = chain.when(which == i, F.replace(F.lit(s), F.lit("{q}"), q))
    return chain


_SPELLED = "CASE l_partkey %% %d %s END" % (
    len(SPELLINGS),
    " ".join(f"WHEN {i} THEN replace('{s}', '{{q}}', l_quantity::int::varchar)" for i, s in enumerate(SPELLINGS)),
)
_VALUE, _ERROR = number_sql("x")


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, {_SPELLED} AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, x AS raw, {_VALUE} AS value, {_ERROR} AS error FROM s""")
def interpret_number(spark, directory):
    rows = table(spark, directory, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", _spelled().alias("raw"))
    raw = F.col("raw")
    return rows.withColumns({"value": to_number(raw), "error": number_error(raw)})


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'yes'
  WHEN 3 THEN '1' WHEN 4 THEN ' true' ELSE 'False' END AS raw FROM orders)
SELECT o_orderkey, raw, CASE WHEN lower(raw) IN ('true', 'false') THEN lower(raw) = 'true' END AS value FROM s""")
def interpret_boolean(spark, directory):
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, "true").when(k == 1, "FALSE").when(k == 2, "yes").when(k == 3, "1").when(k == 4, " true").otherwise("False")
    rows = table(spark, directory, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.withColumn("value", to_boolean(F.col("raw")))


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 1 THEN strftime(o_orderdate, '%Y-02-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d ')
  WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m') || '-1' END AS raw FROM orders)
SELECT o_orderkey, raw, CASE WHEN regexp_full_match(raw, '[0-9]{4}-[0-9]{2}-[0-9]{2}')
  THEN strftime(try_cast(raw AS date), '%Y%m%d')::int END AS value FROM s""")
def interpret_date(spark, directory):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    raw = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy-'02'-dd"))
        .when(k == 2, F.date_format(d, "yyyy-MM-dd' '")).when(k == 3, F.date_format(d, "yyyy/MM/dd"))
        .otherwise(F.concat(F.date_format(d, "yyyy-MM"), F.lit("-1")))
    )
    rows = table(spark, directory, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.withColumn("value", F.date_format(to_date(F.col("raw")), "yyyyMMdd").cast("int"))


@query(f"""WITH {TEXT_ORDERS} SELECT row_id, try_cast(nullif(price, '') AS double) AS price, lower(urgent) = 'true' AS urgent,
  strftime(try_cast(day AS date), '%Y%m%d')::int AS day, priority, try_cast(trim(level) AS double) AS level FROM t""", name="typed_view")
def typed_columns(spark, directory):
    types = {"price": ColumnType.NUMBER, "urgent": ColumnType.BOOLEAN, "day": ColumnType.DATE,
             "priority": ColumnType.CATEGORY, "level": ColumnType.NUMBER}
    typed = typed_view(text_orders(spark, directory), types, keep=["row_id"])
    return typed.withColumn("day", F.date_format("day", "yyyyMMdd").cast("int"))


@query(f"WITH {TEXT_ORDERS} SELECT row_id, nullif(price, '') AS price, priority, nullif(constant, '') AS constant FROM t")
def raw_feature_records(spark, directory):
    return raw_records(text_orders(spark, directory), ["price", "priority", "constant"], keep=["row_id"])


@query(f"""WITH {TEXT_ORDERS} SELECT row_id, try_cast(trim(level) AS double)::bigint::varchar AS level,
  lower(urgent) AS urgent, status FROM t""", name="target_labels")
def target_label_text(spark, directory):
    rows = text_orders(spark, directory)
    return rows.select(
        "row_id",
        target_labels(interpreted(F.col("level"), ColumnType.NUMBER), ColumnType.NUMBER).alias("level"),
        target_labels(interpreted(F.col("urgent"), ColumnType.BOOLEAN), ColumnType.BOOLEAN).alias("urgent"),
        target_labels(F.col("status"), ColumnType.CATEGORY).alias("status"),
    )


@query(f"""WITH {TEXT_ORDERS} SELECT row_id, coalesce('v:' || priority, 'm:') AS priority,
  coalesce('v:' || nullif(constant, ''), 'm:') AS constant FROM t""")
def marked_categories(spark, directory):
    records = raw_records(text_orders(spark, directory), ["priority", "constant"], keep=["row_id"])
    return records.select("row_id", *[marked(F.col(c)).alias(c) for c in ("priority", "constant")])


@query(r"""SELECT doc_id, list_aggregate(list_transform(string_split(text, ''), lambda c:
  CASE WHEN regexp_matches(c, '[\p{C}\x{2028}\x{2029}]') THEN printf('\u%04x', unicode(c)) ELSE c END), 'string_agg', '') AS shown
FROM documents""")
def visible_document_text(spark, directory):
    return table(spark, directory, "documents").select("doc_id", visible_text(F.col("text")).alias("shown"))
