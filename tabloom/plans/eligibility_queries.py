"""Target and feature rules over the profiles of whole tables, and review warnings."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.contracts import ColumnType, Task
from tabloom.operators import eligibility, review
from tabloom.operators.profile import column_facts, profile
from tabloom.plans.catalog import query, table
from tabloom.plans.profile_queries import LINEITEM_PROFILE, ORDERS_PROFILE
from tabloom.plans.text_tables import TEXT_LINEITEM, TEXT_ORDERS, text_lineitem, text_orders

_TARGET = """CASE WHEN detected IN ('Unknown', 'Identifier', 'Date') THEN 'TARGET_TYPE' {regression}
  WHEN missing_count > 0 THEN 'TARGET_MISSING' WHEN row_count < 20 THEN 'TARGET_ROWS'
  WHEN distinct_count < 2 THEN 'TARGET_CONSTANT' {classification} END"""
TARGET_SQL = {
    "classification": _TARGET.format(regression="", classification="""
      WHEN detected = 'Number' AND NOT integral THEN 'TARGET_FRACTION'
      WHEN distinct_count NOT BETWEEN 2 AND 20 THEN 'CLASS_COUNT' WHEN smallest_class < 5 THEN 'CLASS_SIZE'"""),
    "regression": _TARGET.format(regression="WHEN detected <> 'Number' THEN 'TARGET_NUMBER'", classification=""),
}
_FEATURE = """CASE {target} WHEN distinct_count < 2 THEN 'CONSTANT' WHEN detected IN ('Unknown', 'Identifier', 'Date') THEN 'FEATURE_TYPE'
  {numbers} WHEN warnings LIKE '%HIGH_CARDINALITY%' OR warnings LIKE '%LONG_TEXT%' THEN 'REVIEW' END"""
NUMBERS_ONLY = "WHEN detected <> 'Number' THEN 'NUMBER_ONLY'"


def feature_sql(target="", numbers=""):
    return _FEATURE.format(target=f"WHEN name = '{target}' THEN 'IS_TARGET'" if target else "", numbers=numbers)


def _lineitem(spark, directory):
    return profile(column_facts(text_lineitem(spark, directory), "row_id"))


def _orders(spark, directory):
    return profile(column_facts(text_orders(spark, directory), "row_id"))


@query(LINEITEM_PROFILE + f"""
SELECT 'classification' AS task, name, {TARGET_SQL['classification']} AS reason FROM profile
UNION ALL SELECT 'regression', name, {TARGET_SQL['regression']} FROM profile""")
def target_reasons(spark, directory):
    profiled = _lineitem(spark, directory)
    both = F.array(*[
        F.struct(F.lit(t.value).alias("task"), eligibility.target_reason(t).alias("reason"))
        for t in (Task.CLASSIFICATION, Task.REGRESSION)
    ])
    return profiled.select("name", F.inline(both)).select("task", "name", "reason")


@query(ORDERS_PROFILE + f"""
SELECT name, (row_number() OVER (ORDER BY detected = 'Number', position))::int AS place FROM profile
WHERE ({TARGET_SQL['classification']}) IS NULL AND warnings NOT LIKE '%LONG_TEXT%'""")
def target_choices(spark, directory):
    # One row per column of the table.
    order = Window.orderBy("last", "position")
    choices = eligibility.target_choices(_orders(spark, directory), Task.CLASSIFICATION)
    return choices.select("name", F.row_number().over(order).alias("place"))


@query(ORDERS_PROFILE + f""", choices AS (
SELECT 'supervised' AS kind, name, {feature_sql('status')} AS reason FROM profile
UNION ALL SELECT 'unsupervised', name, {feature_sql(numbers=NUMBERS_ONLY)} FROM profile)
SELECT kind, name, reason, coalesce(reason = 'REVIEW', true) AS eligible, reason IS NULL AS is_default FROM choices""")
def feature_choices(spark, directory):
    profiled = _orders(spark, directory)
    both = F.array(
        F.struct(F.lit("supervised").alias("kind"), eligibility.feature_reason(Task.CLASSIFICATION, "status").alias("reason")),
        F.struct(F.lit("unsupervised").alias("kind"), eligibility.feature_reason(Task.CLUSTERING).alias("reason")),
    )
    rows = profiled.select("name", F.inline(both))
    return rows.withColumns({
        "eligible": F.coalesce(F.col("reason") == "REVIEW", F.lit(True)),
        "is_default": F.col("reason").isNull(),
    })


@query(LINEITEM_PROFILE + f""", marks AS (
SELECT row_count, coalesce(({feature_sql()}) = 'REVIEW', true) AS feature,
  coalesce(({feature_sql(numbers=NUMBERS_ONLY)}) = 'REVIEW', true) AS numeric_feature, name,
  ({TARGET_SQL['classification']}) IS NULL AS class_target, ({TARGET_SQL['regression']}) IS NULL AS number_target FROM profile),
totals AS (SELECT max(row_count) AS n, count(*) FILTER (numeric_feature) AS k FROM marks)
SELECT 'classification' AS task, CASE WHEN NOT EXISTS (SELECT 1 FROM marks t, marks f WHERE t.class_target AND f.feature AND f.name <> t.name)
  THEN 'GOAL_TARGET' END AS reason, NULL::bigint AS minimum, NULL::bigint AS maximum, NULL::bigint AS default_option
UNION ALL SELECT 'regression', CASE WHEN NOT EXISTS (SELECT 1 FROM marks t, marks f WHERE t.number_target AND f.feature AND f.name <> t.name)
  THEN 'GOAL_TARGET' END, NULL, NULL, NULL
UNION ALL SELECT 'clustering', CASE WHEN n < 10 THEN 'GOAL_ROWS' WHEN k < 1 THEN 'GOAL_FEATURES' END, 2, least(10, n - 1), 3 FROM totals
UNION ALL SELECT 'reduction', CASE WHEN n < 3 THEN 'GOAL_ROWS' WHEN k < 2 THEN 'GOAL_FEATURES' END, 1, least(10, n - 1, k - 1),
  least(2, 10, n - 1, k - 1) FROM totals""")
def goal_reasons(spark, directory):
    return eligibility.goal_reasons(_lineitem(spark, directory))


@query(ORDERS_PROFILE + """
SELECT name, code FROM (SELECT name, unnest(string_split(warnings, ',')) AS code FROM profile
  WHERE name IN ('order_id', 'customer', 'note', 'zip', 'price'))
WHERE code IN ('HIGH_CARDINALITY', 'LONG_TEXT', 'MIXED_KINDS')""")
def review_warnings(spark, directory):
    chosen = ["order_id", "customer", "note", "zip", "price"]
    return review.carried_warnings(_orders(spark, directory), chosen, "status").select("name", "code")


@query(f"""WITH {TEXT_ORDERS}, x AS (SELECT *, try_cast(nullif(price, '') AS double) AS p, try_cast(trim(level) AS double) AS l,
  lower(urgent) = 'true' AS u FROM t)
SELECT 'price_copy' AS name, bool_and(p IS NOT DISTINCT FROM try_cast(nullif(price, '') || '0' AS double)) AS equal FROM x
UNION ALL SELECT 'level', bool_and(l IS NOT DISTINCT FROM p) FROM x
UNION ALL SELECT 'urgent', bool_and(u::int::double IS NOT DISTINCT FROM p) FROM x
UNION ALL SELECT 'status', bool_and(status IS NULL AND p IS NULL) FROM x""")
def leakage_equal_target(spark, directory):
    rows = text_orders(spark, directory).withColumn(
        "price_copy", F.when(F.col("price") == "", "").otherwise(F.concat("price", F.lit("0")))
    )
    types = {"price": ColumnType.NUMBER, "price_copy": ColumnType.NUMBER, "level": ColumnType.NUMBER,
             "urgent": ColumnType.BOOLEAN, "status": ColumnType.CATEGORY}
    return review.equal_to_target(rows, types, "price", ["price_copy", "level", "urgent", "status"])


# Headers taken from the data, some of them named like an answer.
@query(f"""SELECT p_partkey AS position, name FROM (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'Prediction' WHEN 1 THEN 'LABEL'
  WHEN 2 THEN 'post_outcome' WHEN 3 THEN 'result_2' ELSE p_name END AS name FROM part)
WHERE lower(name) IN ({", ".join(f"'{n}'" for n in review.LEAKAGE_NAMES)})""")
def leakage_names(spark, directory):
    key = F.col("p_partkey") % 9
    name = F.when(key == 0, "Prediction").when(key == 1, "LABEL").when(key == 2, "post_outcome").when(key == 3, "result_2").otherwise(F.col("p_name"))
    return review.leakage_names(table(spark, directory, "part").select(F.col("p_partkey").alias("position"), name.alias("name")))


@query(f"""WITH {TEXT_LINEITEM}, g AS (SELECT count(*) AS c FROM t GROUP BY l_quantity, l_discount, l_tax, l_returnflag)
SELECT count(*) FILTER (c > 1) AS repeated_combinations, coalesce(sum(c - 1) FILTER (c > 1), 0)::bigint AS extra_rows FROM g""")
def duplicate_rows(spark, directory):
    types = {"l_quantity": ColumnType.NUMBER, "l_discount": ColumnType.NUMBER, "l_tax": ColumnType.NUMBER,
             "l_returnflag": ColumnType.CATEGORY}
    return review.duplicate_rows(text_lineitem(spark, directory), types, list(types))
