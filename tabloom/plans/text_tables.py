"""Text tables derived from whole given tables, as a lexical reader would deliver them.

Columns get missing cells, padded numbers, dates and mixed text by formulas of the key.
No row is left out.
"""

from pyspark.sql import functions as F

from tabloom.operators.rows import with_file_order
from tabloom.plans.catalog import table


def text_orders(spark, directory):
    key = F.col("o_orderkey")
    return table(spark, directory, "orders").select(
        key.alias("row_id"),
        F.lpad(key.cast("string"), 8, "0").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer"),
        F.col("o_orderstatus").alias("status"),
        F.when(key % 13 == 0, "").otherwise(F.format_string("%.2f", "o_totalprice")).alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(key % 11 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(key % 3 == 0, "true").when(key % 3 == 1, "FALSE").otherwise("True").alias("urgent"),
        F.lpad((F.col("o_custkey") % 5 + 1).cast("string"), 4, "0").alias("zip"),
        (F.lit(9007199254740990) + key % 7).cast("string").alias("serial"),
        F.when(key % 4 == 0, "1").when(key % 4 == 1, "1.0").when(key % 4 == 2, " 1 ").otherwise("2e0").alias("level"),
        F.when(key % 5 == 0, F.repeat(F.lit("n"), 300)).otherwise(F.concat(F.lit("note "), (key % 3).cast("string"))).alias("note"),
        F.when(key % 7 == 0, "").otherwise(F.lit("fixed")).alias("constant"),
        F.lit("").alias("empty"),
    )


# The same table for the SQL side.
TEXT_ORDERS = """
t AS (
  SELECT o_orderkey AS row_id,
    lpad(o_orderkey::varchar, 8, '0') AS order_id,
    o_custkey::varchar AS customer,
    o_orderstatus AS status,
    CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE printf('%.2f', o_totalprice) END AS price,
    strftime(o_orderdate, '%Y-%m-%d') AS day,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority,
    CASE o_orderkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' ELSE 'True' END AS urgent,
    lpad((o_custkey % 5 + 1)::varchar, 4, '0') AS zip,
    (9007199254740990 + o_orderkey % 7)::varchar AS serial,
    CASE o_orderkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '1.0' WHEN 2 THEN ' 1 ' ELSE '2e0' END AS level,
    CASE WHEN o_orderkey % 5 = 0 THEN repeat('n', 300) ELSE 'note ' || (o_orderkey % 3)::varchar END AS note,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'fixed' END AS constant,
    '' AS empty
  FROM orders
)"""

TEXT_ORDERS_COLUMNS = (
    "order_id", "customer", "status", "price", "day", "priority", "urgent", "zip", "serial", "level", "note", "constant", "empty",
)


def text_lineitem(spark, directory):
    """All line items as text. They have no key, so their place in the file numbers them."""
    decimals = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    whole = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return with_file_order(table(spark, directory, "lineitem")).select(
        "row_id",
        *[F.col(c).cast("string").alias(c) for c in whole],
        *[F.format_string("%.2f", c).alias(c) for c in decimals],
        "l_returnflag",
        "l_linestatus",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"),
    )


TEXT_LINEITEM = """
t AS (
  SELECT l_orderkey::varchar AS l_orderkey, l_partkey::varchar AS l_partkey, l_suppkey::varchar AS l_suppkey,
    l_linenumber::varchar AS l_linenumber, printf('%.2f', l_quantity) AS l_quantity,
    printf('%.2f', l_extendedprice) AS l_extendedprice, printf('%.2f', l_discount) AS l_discount,
    printf('%.2f', l_tax) AS l_tax, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate
  FROM lineitem
)"""

TEXT_LINEITEM_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)

NUMBER_SQL = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"


def number_sql(x):
    """SQL for the number in a text: value, null when it is none or not exact."""
    s = f"trim({x})"
    mantissa = f"regexp_extract({s}, '^[+-]?([0-9.]*)', 1)"
    fraction = f"regexp_extract({mantissa}, '\\.([0-9]*)', 1)"
    exponent = f"coalesce(try_cast(regexp_extract({s}, '[eE]([+-]?[0-9]+)', 1) AS bigint), 0)"
    digits = f"replace({mantissa}, '.', '')"
    integral = f"(length({digits}) - length(rtrim({digits}, '0')) >= length({fraction}) - {exponent})"
    value = f"try_cast({s} AS double)"
    fits = f"regexp_full_match({s}, '{NUMBER_SQL}')"
    return (
        f"CASE WHEN {fits} AND abs({value}) < 9007199254740992.0::double THEN {value} "
        f"WHEN {fits} AND NOT isinf({value}) AND NOT {integral} THEN {value} END"
    ), (
        f"CASE WHEN NOT {fits} THEN 'NUMBER_REQUIRED' WHEN abs({value}) < 9007199254740992.0::double THEN NULL "
        f"WHEN {value} IS NULL OR isinf({value}) THEN 'NUMBER_RANGE' WHEN {integral} THEN 'PRECISION' END"
    )


def profile_sql(cte, columns, row_id="row_id", samples=True):
    """CTEs ending in `profile`: the profile of every column of `t`."""
    value, error = number_sql("x")
    parts = []
    for i, name in enumerate(columns):
        sample = (
            f"""(SELECT string_agg(x, '|' ORDER BY r) FROM (
              SELECT {name} AS x, min({row_id}) AS r FROM t WHERE coalesce({name}, '') <> '' GROUP BY 1 ORDER BY 2 LIMIT 3))"""
            if samples
            else "NULL"
        )
        parts.append(f"""
        SELECT {i} AS position, '{name}' AS name, (SELECT count(*) FROM t) AS row_count, {sample} AS samples,
          count(*) AS n_present, count(DISTINCT x) AS raw_distinct,
          count(*) FILTER (regexp_full_match(lower(x), 'true|false')) AS n_boolean,
          count(*) FILTER (lower(x) = 'true') AS n_true,
          count(*) FILTER (regexp_full_match(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND year(try_cast(x AS date)) >= 1) AS n_date,
          count(v) AS n_number, count(DISTINCT v) AS number_distinct,
          coalesce(bool_and(v = floor(v)), false) AS integral,
          coalesce(bool_or(e = 'PRECISION'), false) AS has_precision,
          coalesce(bool_or(regexp_full_match(trim(x), '[+-]?0[0-9]+')), false) AS leading_zero,
          coalesce(max(length(x)), 0) AS longest,
          (SELECT min(c) FROM (SELECT count(*) AS c FROM u{i} GROUP BY x)) AS raw_smallest,
          (SELECT min(c) FROM (SELECT count(*) AS c FROM u{i} WHERE v IS NOT NULL GROUP BY v)) AS number_smallest,
          (SELECT min(c) FROM (SELECT count(*) AS c FROM u{i} WHERE lower(x) IN ('true', 'false') GROUP BY lower(x))) AS boolean_smallest
        FROM u{i}""")
    typed = ",".join(
        f" u{i} AS (SELECT x, {value} AS v, {error} AS e FROM (SELECT {name} AS x FROM t WHERE coalesce({name}, '') <> ''))"
        for i, name in enumerate(columns)
    )
    return f"""WITH {cte},{typed},
    facts AS ({" UNION ALL ".join(parts)}),
    typed AS (SELECT *, CASE
        WHEN n_present = 0 THEN 'Unknown'
        WHEN (lower(name) IN ('id', 'uuid', 'guid', 'identifier') OR lower(name) LIKE '%\\_id' ESCAPE '\\')
          AND n_present >= 10 AND raw_distinct / n_present >= 0.9 THEN 'Identifier'
        WHEN n_boolean = n_present THEN 'Boolean'
        WHEN n_date = n_present THEN 'Date'
        WHEN n_number = n_present AND NOT leading_zero THEN 'Number'
        ELSE 'Category' END AS detected FROM facts),
    counted AS (SELECT *, row_count - n_present AS missing_count,
        CASE detected WHEN 'Unknown' THEN 0 WHEN 'Number' THEN number_distinct
          WHEN 'Boolean' THEN (n_true > 0)::int + (n_boolean > n_true)::int ELSE raw_distinct END::bigint AS distinct_count,
        CASE detected WHEN 'Unknown' THEN 0 WHEN 'Number' THEN number_smallest
          WHEN 'Boolean' THEN boolean_smallest ELSE raw_smallest END::bigint AS smallest_class FROM typed),
    profile AS (SELECT *, concat_ws(',',
        CASE WHEN leading_zero AND detected <> 'Number' THEN 'LEADING_ZEROS' END,
        CASE WHEN has_precision AND detected <> 'Number' THEN 'PRECISION' END,
        CASE WHEN detected = 'Category' AND (distinct_count > 50 OR (n_present >= 20 AND distinct_count / n_present > 0.8))
          THEN 'HIGH_CARDINALITY' END,
        CASE WHEN longest > 200 THEN 'LONG_TEXT' END) AS warnings FROM counted)"""
