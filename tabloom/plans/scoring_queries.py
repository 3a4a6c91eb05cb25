"""Input checks and warnings of scored rows, probes and comparison of predictions."""

from pyspark.sql import functions as F

from tabloom.contracts import ColumnType
from tabloom.operators import preprocess, score, split
from tabloom.plans.catalog import query, table
from tabloom.plans.split_queries import ORDERS_SHUFFLED
from tabloom.plans.text_tables import number_sql

TYPES = {"price": ColumnType.NUMBER, "priority": ColumnType.CATEGORY, "customer": ColumnType.CATEGORY}

# Training inputs: orders of known priority; many customers, each a category of its own.
_TRAIN = f"""{ORDERS_SHUFFLED}, train AS (SELECT o_orderkey, o_totalprice AS price,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_custkey::varchar AS customer
  FROM s WHERE split = 'train')"""
_INPUT = """i AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN printf('%.2f', o_totalprice * 3)
    WHEN 2 THEN 'n/a' WHEN 3 THEN '' WHEN 4 THEN '1e400' ELSE printf('%.2f', o_totalprice) END AS price,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'm:' ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 9 = 0 THEN 'nobody' ELSE o_custkey::varchar END AS customer FROM orders)"""
_VALUE, _ERROR = number_sql("price")


def training_inputs(spark, directory):
    rows = split.shuffled_holdout(table(spark, directory, "orders"), "o_orderkey")
    return rows.where(F.col("split") == "train").select(
        "o_orderkey",
        F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("priority"),
        F.col("o_custkey").cast("string").alias("customer"),
    )


def new_inputs(spark, directory):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    price = (
        F.when(k % 6 == 0, F.lit(None)).when(k % 6 == 1, F.format_string("%.2f", p * 3)).when(k % 6 == 2, "n/a")
        .when(k % 6 == 3, "").when(k % 6 == 4, "1e400").otherwise(F.format_string("%.2f", p))
    )
    priority = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "").when(k % 5 == 2, "m:").otherwise(F.col("o_orderpriority"))
    customer = F.when(k % 9 == 0, "nobody").otherwise(F.col("o_custkey").cast("string"))
    return table(spark, directory, "orders").select(
        "o_orderkey", price.alias("price"), priority.alias("priority"), customer.alias("customer")
    )


def fitted(spark, directory):
    train = training_inputs(spark, directory)
    return score.fitted_fields(train, TYPES), preprocess.fit_preprocessor(train, TYPES, True)


@query(f"""WITH {_TRAIN}
SELECT 'price' AS name, 'Number' AS type, min(price) AS minimum, max(price) AS maximum, NULL::varchar AS category FROM train
UNION ALL SELECT DISTINCT 'priority', 'Category', NULL::double, NULL::double, priority FROM train WHERE priority IS NOT NULL
UNION ALL SELECT DISTINCT 'customer', 'Category', NULL::double, NULL::double, customer FROM train""")
def fitted_schema(spark, directory):
    fields, prep = fitted(spark, directory)
    return score.fitted_schema(fields, prep, spark).drop("position")


def _checked(spark, directory):
    fields, prep = fitted(spark, directory)
    typed = score.read_inputs(new_inputs(spark, directory), fields)
    return score.input_warnings(preprocess.with_known_flags(typed, prep), fields, prep)


@query(f"""WITH {_TRAIN}, {_INPUT}, v AS (SELECT *, {_VALUE} AS value FROM i),
b AS (SELECT min(price) AS low, max(price) AS high FROM train)
SELECT o_orderkey, concat_ws(',',
  CASE WHEN value IS NULL THEN 'price:MISSING_IMPUTED' WHEN value < low OR value > high THEN 'price:OUTSIDE_TRAINING_RANGE' END,
  CASE WHEN priority IS NULL THEN 'priority:MISSING_IMPUTED'
    WHEN priority NOT IN (SELECT priority FROM train WHERE priority IS NOT NULL) THEN 'priority:UNKNOWN_CATEGORY' END,
  CASE WHEN customer NOT IN (SELECT customer FROM train) THEN 'customer:UNKNOWN_CATEGORY' END) AS warnings
FROM v, b WHERE NOT (price IS NOT NULL AND value IS NULL)""")
def score_warnings(spark, directory):
    rows = _checked(spark, directory).where(F.size("errors") == 0)
    notes = F.transform("warnings", lambda w: F.concat(w["field"], F.lit(":"), w["code"]))
    return rows.select("o_orderkey", F.array_join(notes, ",").alias("warnings"))


@query(f"""WITH {_INPUT} SELECT o_orderkey, 'price' AS field,
  CASE WHEN {_ERROR} = 'NUMBER_REQUIRED' THEN 'NUMBER_REQUIRED' ELSE 'NUMBER_RANGE' END AS code
FROM i WHERE price IS NOT NULL AND ({_VALUE}) IS NULL""")
def score_errors(spark, directory):
    return _checked(spark, directory).select("o_orderkey", F.inline("errors")).select("o_orderkey", "field", "code")


@query(f"""WITH {_TRAIN}, w AS (SELECT max(length(priority)) + 3 AS p, max(length(customer)) + 3 AS c FROM train)
SELECT price, priority, customer, 'observed' AS probe FROM train
UNION ALL SELECT NULL, NULL, NULL, 'missing'
UNION ALL SELECT price, rpad('unseen', greatest(6, p)::int, '_'), rpad('unseen', greatest(6, c)::int, '_'), 'unseen' FROM (
  SELECT price FROM train ORDER BY price, priority NULLS FIRST, customer LIMIT 1), w""")
def probe_rows(spark, directory):
    fields, prep = fitted(spark, directory)
    return score.probe_rows(training_inputs(spark, directory), fields, prep.vocabulary)


@query("""WITH a AS (SELECT o_orderkey, o_totalprice AS p FROM orders WHERE o_orderkey % 10 <> 3),
b AS (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 1 THEN o_totalprice * (1 + 1e-6::double) WHEN 2 THEN o_totalprice * (1 + 1e-10::double)
  ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 10 <> 4)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'MISSING_LEFT'
  WHEN b.o_orderkey IS NULL THEN 'MISSING_RIGHT' ELSE 'DIFFERENT' END AS reason
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
WHERE a.p IS NULL OR b.p IS NULL OR abs(a.p - b.p) > greatest(1e-8::double * greatest(abs(a.p), abs(b.p)), 1e-10::double)""")
def prediction_parity(spark, directory):
    rows = table(spark, directory, "orders").select("o_orderkey", F.col("o_totalprice").alias("prediction"))
    last, p = F.col("o_orderkey") % 10, F.col("prediction")
    # Two scored tables that differ: values slightly apart, and rows missing on either side.
    other = rows.select(
        "o_orderkey", F.when(last == 1, p * (1 + 1e-6)).when(last == 2, p * (1 + 1e-10)).otherwise(p).alias("prediction")
    )
    return score.prediction_parity(rows.where(last != 3), other.where(last != 4), "o_orderkey").select("o_orderkey", "reason")
