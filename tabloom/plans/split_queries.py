"""Holdout splits and the encodings learned from their training side."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.contracts import ColumnType
from tabloom.operators import preprocess, split
from tabloom.plans.catalog import plain_zero, query, table

# The same splits for the SQL side.
SHUFFLED = """s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('42:' || {key})) <= ceil(count(*) OVER () / 5.0)
  THEN 'test' ELSE 'train' END AS split FROM {table})"""
STRATIFIED = """
k AS (SELECT {label} AS label, count(*) AS n FROM {table} GROUP BY 1),
w AS (SELECT label, n, sum(n) OVER ()::bigint AS total, ceil(sum(n) OVER () / 5.0)::bigint AS wanted FROM k),
b AS (SELECT label, wanted, n * wanted // total AS base, n * wanted % total AS rest FROM w),
q AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= wanted - (SELECT sum(base) FROM b)
  THEN 1 ELSE 0 END AS quota FROM b),
s AS (SELECT o.*, CASE WHEN row_number() OVER (PARTITION BY {label} ORDER BY md5('42:' || {key})) <= q.quota
  THEN 'test' ELSE 'train' END AS split FROM {table} o JOIN q ON q.label = o.{label})"""

ORDERS_SHUFFLED = SHUFFLED.format(key="o_orderkey", table="orders")
ORDERS_STRATIFIED = STRATIFIED.format(key="o_orderkey", table="orders", label="o_orderstatus")
CUSTOMER_SHUFFLED = SHUFFLED.format(key="c_custkey", table="customer")
PART_SHUFFLED = SHUFFLED.format(key="p_partkey", table="part")


def orders_shuffled(spark, directory):
    return split.shuffled_holdout(table(spark, directory, "orders"), "o_orderkey")


def orders_stratified(spark, directory):
    return split.stratified_holdout(table(spark, directory, "orders"), "o_orderkey", "o_orderstatus")


@query(f"WITH {ORDERS_SHUFFLED} SELECT o_orderkey, split FROM s")
def split_shuffled(spark, directory):
    return orders_shuffled(spark, directory).select("o_orderkey", "split")


@query(f"WITH {ORDERS_STRATIFIED} SELECT o_orderkey, o_orderstatus, split FROM s")
def split_stratified(spark, directory):
    return orders_stratified(spark, directory).select("o_orderkey", "o_orderstatus", "split")


@query(f"""WITH {ORDERS_STRATIFIED}, g AS (SELECT o_orderstatus, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b
  FROM s GROUP BY 1)
SELECT count(*) AS row_count, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'test') AS test_rows,
  count(*) FILTER (split IS NULL) AS unassigned_rows, count(DISTINCT o_orderkey) AS distinct_ids,
  (SELECT count(*) FROM g) AS classes, (SELECT count(*) FROM g WHERE a = 0) AS classes_without_train,
  (SELECT count(*) FROM g WHERE b = 0) AS classes_without_test FROM s""")
def split_check(spark, directory):
    return split.split_check(orders_stratified(spark, directory), "o_orderkey", "o_orderstatus")


def customer_train(spark, directory):
    """Training customers with a balance that is sometimes missing and one that always is."""
    rows = split.shuffled_holdout(table(spark, directory, "customer"), "c_custkey")
    return rows.where(F.col("split") == "train").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 13 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"),
        F.lit(None).cast("double").alias("nothing"),
        F.lit(7.0).alias("seven"),
    )


CUSTOMER_TRAIN = f"""{CUSTOMER_SHUFFLED}, r AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS balance,
  c_nationkey::double AS nation, NULL::double AS nothing, 7.0::double AS seven FROM s WHERE split = 'train')"""


@query(f"""WITH {CUSTOMER_TRAIN}
SELECT 'balance' AS name, median(balance) AS fill, false AS all_missing FROM r
UNION ALL SELECT 'nation', median(nation), false FROM r UNION ALL SELECT 'nothing', 0.0::double, true""")
def impute_median(spark, directory):
    fills, empty = preprocess.impute_medians(customer_train(spark, directory), ["balance", "nation", "nothing"])
    return spark.createDataFrame(
        [(n, v, n in empty) for n, v in fills.items()], "name string, fill double, all_missing boolean"
    )


@query(f"""WITH {CUSTOMER_TRAIN}, m AS (SELECT median(balance) AS b, median(nation) AS n FROM r),
f AS (SELECT c_custkey, coalesce(balance, b) AS balance, coalesce(nation, n) AS nation FROM r, m),
z AS (SELECT avg(balance) AS ab, stddev_pop(balance) AS sb, avg(nation) AS an, stddev_pop(nation) AS sn FROM f)
SELECT c_custkey, round((balance - ab) / sb, 6) + 0.0::double AS balance, round((nation - an) / sn, 6) + 0.0::double AS nation,
  0.0::double AS nothing, 0.0::double AS seven FROM f, z""")
def scale_standard(spark, directory):
    train = customer_train(spark, directory)
    names = ["balance", "nation", "nothing", "seven"]
    prep = preprocess.fit_preprocessor(train, {n: ColumnType.NUMBER for n in names}, True)
    encoded = preprocess.encode(train, prep, as_vector=False)
    return encoded.select("c_custkey", *[plain_zero(F.round(F.col("features")[i], 6)).alias(n) for i, n in enumerate(names)])


def part_sides(spark, directory):
    rows = split.shuffled_holdout(table(spark, directory, "part"), "p_partkey")
    return rows.withColumn("name", F.when(F.col("p_partkey") % 17 == 0, F.lit(None)).otherwise(F.col("p_name")))


_PART = f"""{PART_SHUFFLED}, p AS (SELECT *, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_name END AS name FROM s),
c AS (SELECT coalesce('v:' || name, 'm:') AS value, count(*) AS n FROM p WHERE split = 'train' GROUP BY 1),
r AS (SELECT value, row_number() OVER (ORDER BY n DESC, value DESC) AS rank, count(*) OVER () AS size FROM c),
kept AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS slot FROM r WHERE size <= 32 OR rank <= 31)"""


@query(f"""WITH {_PART}
SELECT p_partkey, CASE WHEN k.slot IS NOT NULL THEN k.slot WHEN c.value IS NOT NULL THEN 31 ELSE -1 END::bigint AS slot,
  (c.value IS NOT NULL)::int::double AS ones
FROM p LEFT JOIN kept k ON k.value = coalesce('v:' || name, 'm:') LEFT JOIN c ON c.value = coalesce('v:' || name, 'm:')""")
def onehot_topk(spark, directory):
    rows = part_sides(spark, directory)
    prep = preprocess.fit_preprocessor(
        rows.where(F.col("split") == "train"), {"name": ColumnType.CATEGORY}, False
    )
    encoded = preprocess.encode(rows, prep, as_vector=False)
    return encoded.select(
        "p_partkey",
        (F.array_position("features", 1.0) - 1).alias("slot"),
        F.aggregate("features", F.lit(0.0), lambda s, x: s + x).alias("ones"),
    )


@query(f"WITH {_PART} SELECT value, n FROM c")
def category_vocabulary(spark, directory):
    train = part_sides(spark, directory).where(F.col("split") == "train")
    return preprocess.category_counts(train, ["name"]).select("value", "n")


@query(f"""WITH {CUSTOMER_TRAIN}, m AS (SELECT median(balance) AS b FROM r)
SELECT count(*) AS row_count, round(min(coalesce(balance, b)), 6) AS balance_low, round(max(coalesce(balance, b)), 6) AS balance_high,
  min(nation) AS nation_low, max(nation) AS nation_high, 7.0::double AS seven_low, 7.0::double AS seven_high FROM r, m""")
def constant_gate(spark, directory):
    train = customer_train(spark, directory)
    names = ["balance", "nation", "seven"]
    prep = preprocess.fit_preprocessor(train, {n: ColumnType.NUMBER for n in names}, False)
    ranges = preprocess.feature_ranges(preprocess.encode(train, prep))
    low, high = vector_to_array("min"), vector_to_array("max")
    return ranges.select(
        F.col("count").alias("row_count"),
        *[F.round(side[i], 6).alias(f"{n}_{w}") for i, n in enumerate(names) for w, side in (("low", low), ("high", high))],
    )


@query("""SELECT least(count(*), 10) AS distinct_rows, count(*) >= 10 AS enough FROM (SELECT DISTINCT l_quantity, l_discount FROM lineitem)""")
def distinct_gate(spark, directory):
    rows = table(spark, directory, "lineitem").select("l_quantity", "l_discount")
    enough = preprocess.distinct_at_least(rows, ["l_quantity", "l_discount"], 10)
    return rows.distinct().limit(10).agg(F.count("*").alias("distinct_rows"), F.lit(enough).alias("enough"))
