"""Whole experiments as tables, scoring under any names, and model steps with a closed form."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.contracts import ColumnProfile, ColumnType, ExperimentSpec, Schema
from tabloom.operators import evaluate, newton, score, sketches, split
from tabloom.operators.profile import column_facts, infer_schema, profile
from tabloom.plans import experiment
from tabloom.plans.algorithm_queries import _DOCUMENTS, _documents
from tabloom.plans.catalog import plain_zero, query, table
from tabloom.plans.model_queries import _test_predictions, fit_side
from tabloom.plans.split_queries import ORDERS_SHUFFLED
from tabloom.plans.text_tables import TEXT_ORDERS, TEXT_ORDERS_COLUMNS, text_orders
from tabloom.sources.jsonl import read_jsonl
from tabloom.sources.scratch import scratch_directory

# One line through customer and price; an input that varies on test rows only; and the mean as the baseline.
_METRICS = """round(avg(abs(y - p)), 3) AS mae, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) + 0.0::double AS r2,
  round(sqrt(avg((y - p) ** 2)), 3) AS rmse"""


@query(f"""WITH {ORDERS_SHUFFLED}, x AS (SELECT o_custkey::double AS c, printf('%.2f', o_totalprice)::double AS y, split FROM s),
f AS (SELECT regr_slope(y, c) AS a, regr_intercept(y, c) AS b, avg(y) AS mean FROM x WHERE split = 'train'),
t AS (SELECT y, b + a * c AS line, mean FROM x, f WHERE split = 'test')
SELECT 'customer' AS inputs, 'regression.linear' AS model_id, 'completed' AS status, 1 AS rank, {_METRICS.replace('p)', 'line)')}, NULL::varchar AS error_code FROM t
UNION ALL SELECT 'customer', 'baseline', 'completed', NULL, {_METRICS.replace('p)', 'mean)')}, NULL FROM t
UNION ALL SELECT 'marked', 'regression.linear', 'failed', NULL, NULL, NULL, NULL, 'CONSTANT_TRAIN'""")
def experiment_results(spark, directory):
    """Every model of two experiments, fitted, saved, loaded back and ranked, next to the baseline."""
    rows = split.shuffled_holdout(table(spark, directory, "orders"), "o_orderkey").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("customer"), F.format_string("%.2f", "o_totalprice").alias("price"),
        F.when(F.col("split") == "test", (F.col("o_orderkey") % 7).cast("string")).otherwise("3").alias("marked"),
    ).persist()
    schema, parts = infer_schema(rows, "o_orderkey"), []
    for name in ("customer", "marked"):
        seen = tuple(f"{w}:{name}" for w in schema[name].warnings) + ("DUPLICATE_ROWS",)
        spec = ExperimentSpec("regression", "price", (name,), ("regression.linear",), acknowledged=seen)
        result = experiment.run_experiment(rows, "o_orderkey", schema, spec, scratch_directory(spark, "experiment"))
        loaded = experiment.reloaded_results(spark, result)
        for c in result.candidates:
            if "baseline" in c.diagnostics:
                base = {k: float(v) for k, v in c.diagnostics["baseline"].items() if v is not None}
                line = spark.createDataFrame([("baseline", "completed", None, base, None)], loaded.schema)
                loaded = loaded.unionByName(line)
        parts.append(loaded.withColumn("inputs", F.lit(name)))
    rows.unpersist()
    metrics = [F.round(F.col("metrics")[k], n).alias(k) for k, n in (("mae", 3), ("r2", 6), ("rmse", 3))]
    metrics[1] = (F.round(F.col("metrics")["r2"], 6) + F.lit(0.0)).alias("r2")
    return parts[0].unionByName(parts[1]).select("inputs", "model_id", "status", "rank", *metrics, "error_code")


# Inputs called like working and output columns, like each other but for case, and with a dot; the target is a sum of them.
HOSTILE = ("split", "errors", "prediction", "label", "a", "A", "x.y")
_TERMS = {
    "split": "o_orderkey % 7", "errors": "o_custkey % 11", "prediction": "o_orderkey % 5", "label": "o_custkey % 3", "a": "o_orderkey % 13",
    "A": "(o_orderkey * 7) % 17", "x.y": "o_custkey % 19",
}
_WEIGHTS = (2.0, 3.0, -1.0, 0.5, 1.25, -4.0, 0.75)


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 2 THEN NULL ELSE round(7 + {" + ".join(
    f"{w}::double * " + (f"(CASE WHEN o_orderkey % 40 = 1 THEN 100 ELSE {t} END)" if n == "split" else f"({t})")
    for (n, t), w in zip(_TERMS.items(), _WEIGHTS))}, 4) END AS prediction,
  CASE o_orderkey % 40 WHEN 1 THEN 'split:OUTSIDE_TRAINING_RANGE' WHEN 2 THEN 'errors:MISSING_IMPUTED' ELSE '' END AS warnings,
  CASE WHEN o_orderkey % 40 = 2 THEN 'errors:NUMBER_REQUIRED' ELSE '' END AS errors FROM orders""")
def score_hostile_names(spark, directory):
    orders = table(spark, directory, "orders")
    terms = {n: F.expr(t) for n, t in _TERMS.items()}
    target = sum((F.lit(w) * t for w, t in zip(_WEIGHTS, terms.values())), F.lit(7.0))
    rows = orders.select("o_orderkey", *[t.cast("string").alias(f"s{i}") for i, t in enumerate(terms.values())], target.cast("string").alias("t"))
    rows = rows.toDF("key", *HOSTILE, "Split").persist()
    numbers = tuple(ColumnProfile(i, n, "Number", "Number", 0, 100, integral=False) for i, n in enumerate((*HOSTILE, "Split")))
    spec = ExperimentSpec("regression", "Split", HOSTILE, ("regression.linear",), acknowledged=("DUPLICATE_ROWS", "LEAKAGE_NAME:prediction", "LEAKAGE_NAME:label"))
    run = experiment.prepare_run(rows, "key", Schema(numbers, rows.count()), spec)
    scorer = experiment.fit_candidate(run, "regression.linear")
    run.rows.unpersist()
    rows.unpersist()
    key = F.col("o_orderkey") % 40
    inputs = [
        F.when(key == 1, "100").otherwise(t.cast("string")) if n == "split" else F.when(key == 2, "n/a").otherwise(t.cast("string")) if n == "errors" else t
        for n, t in terms.items()
    ]
    new = orders.select("o_orderkey", *[c.alias(f"s{i}") for i, c in enumerate(inputs)]).toDF("o_orderkey", *HOSTILE)
    scored = score.predict_many(scorer, new, keep=["o_orderkey"], strict=False)

    def listed(column):
        return F.array_join(F.transform(column, lambda n: F.concat(n["field"], F.lit(":"), n["code"])), ",").alias(column)

    return scored.select("o_orderkey", F.round("prediction", 4).alias("prediction"), listed("warnings"), listed("errors"))


# Newton steps with a penalty of one on both weights; three unknowns are solved by determinants.
NEWTON_STEPS = 8


def _newton_sql():
    parts = [_DOCUMENTS, "w0 AS (SELECT 0.0::double AS c, 0.0::double AS u, 0.0::double AS v)"]
    for i in range(NEWTON_STEPS):
        parts.append(f"q{i} AS (SELECT y, a, b, c, u, v, 1 / (1 + exp(-(c + a * u + b * v))) AS q FROM p, w{i})")
        parts.append(f"""h{i} AS (SELECT max(c) AS c, max(u) AS u, max(v) AS v, sum(q - y) AS g0, sum((q - y) * a) + max(u) AS g1, sum((q - y) * b) + max(v) AS g2,
          sum(q * (1 - q)) AS m00, sum(q * (1 - q) * a) AS m01, sum(q * (1 - q) * b) AS m02, sum(q * (1 - q) * a * a) + 1 AS m11,
          sum(q * (1 - q) * a * b) AS m12, sum(q * (1 - q) * b * b) + 1 AS m22 FROM q{i})""")
        parts.append(f"""d{i} AS (SELECT *, m00 * (m11 * m22 - m12 * m12) - m01 * (m01 * m22 - m12 * m02) + m02 * (m01 * m12 - m11 * m02) AS det FROM h{i})""")
        parts.append(f"""w{i + 1} AS (SELECT
          c - (g0 * (m11 * m22 - m12 * m12) - m01 * (g1 * m22 - m12 * g2) + m02 * (g1 * m12 - m11 * g2)) / det AS c,
          u - (m00 * (g1 * m22 - m12 * g2) - g0 * (m01 * m22 - m12 * m02) + m02 * (m01 * g2 - g1 * m02)) / det AS u,
          v - (m00 * (m11 * g2 - g1 * m12) - m01 * (m01 * g2 - g1 * m02) + g0 * (m01 * m12 - m11 * m02)) / det AS v FROM d{i})""")
    return "WITH " + ", ".join(parts)


@query(_newton_sql() + f" SELECT doc_id, round(1 / (1 + exp(-(c + a * u + b * v))), 5) AS probability FROM p, w{NEWTON_STEPS}")
def logistic_newton(spark, directory):
    rows = _documents(spark, directory)
    data = rows.select(F.array("a", "b").alias("x"), F.col("quality").alias("y")).persist()
    weights, _ = newton.newton_logistic(data, 2, 1.0)
    data.unpersist()
    c, u, v = map(float, weights[0])
    p = 1 / (1 + F.exp(-(F.lit(c) + F.col("a") * u + F.col("b") * v)))
    return rows.select("doc_id", F.round(p, 5).alias("probability"))


@query("""SELECT code, rows FROM (SELECT
  'EMPTY' AS code, (SELECT count(*) FROM orders WHERE o_orderkey < 0) AS rows UNION ALL
  SELECT 'MISSING', count(*) FILTER (o_orderkey % 20 IN (3, 4)) FROM orders UNION ALL
  SELECT 'NOT_FINITE', count(*) FILTER (o_orderkey % 20 IN (5, 6, 7)) FROM orders UNION ALL
  SELECT 'OVERFLOW', count(*) FILTER (o_orderkey % 20 = 8) FROM orders)""")
def evaluation_gates(spark, directory):
    k = F.col("o_orderkey") % 20
    scored = table(spark, directory, "orders").select(
        F.when(k == 3, F.lit(None)).when(k == 5, float("nan")).otherwise(F.col("o_totalprice")).alias("label"),
        F.when(k == 4, F.lit(None)).when(k == 6, float("inf")).when(k == 7, float("-inf")).when(k == 8, -1e200).otherwise(1.0).alias("prediction"),
    )
    return evaluate.evaluation_gates(scored)


@query(f"""WITH {TEXT_ORDERS} {" UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) AS rows, count(*) FILTER (coalesce({c}, '') = '') AS missing, count(DISTINCT nullif({c}, '')) AS distinct_count, true AS within FROM t"
    for c in TEXT_ORDERS_COLUMNS)}""")
def profile_distinct_sketch(spark, directory):
    """Sketches per month of the table, merged; each estimate lies within 5 % of the exact count."""
    rows = text_orders(spark, directory).withColumn("month", F.substring("day", 1, 7))
    found = sketches.estimates(sketches.merged(sketches.column_sketches(rows, TEXT_ORDERS_COLUMNS, "month")))
    exact = rows.agg(*[F.countDistinct(F.when(F.col(c) != "", F.col(c))).alias(c) for c in TEXT_ORDERS_COLUMNS]).unpivot(
        [], list(TEXT_ORDERS_COLUMNS), "name", "distinct_count"
    )
    gap = F.abs(F.col("distinct_estimate") - F.col("distinct_count"))
    return found.join(exact, "name").select("name", "rows", "missing", "distinct_count", (gap <= 0.05 * F.col("distinct_count")).alias("within"))


# Models whose answers are known: classes and values that one input decides, and groups far apart.
_LEVEL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'mid' ELSE 'low' END"


@query(f"WITH {ORDERS_SHUFFLED} SELECT o_orderkey, {_LEVEL} AS prediction FROM s WHERE split = 'test'")
def forest_classes(spark, directory):
    rows = split.shuffled_holdout(table(spark, directory, "orders"), "o_orderkey").select(
        "o_orderkey", F.col("o_orderpriority").alias("priority"), F.expr(_LEVEL).alias("__label"), "split"
    )
    scorer = fit_side(rows, {"priority": ColumnType.CATEGORY}, "classification.forest")
    return _test_predictions(rows, scorer).select("o_orderkey", "prediction")


@query(f"WITH {ORDERS_SHUFFLED} SELECT o_orderkey, (CASE WHEN o_custkey % 4 = 1 THEN 70.0 ELSE 10.0 * (o_custkey % 4) END)::double AS prediction FROM s WHERE split = 'test'")
def forest_values(spark, directory):
    step = F.col("o_custkey") % 4
    rows = split.shuffled_holdout(table(spark, directory, "orders"), "o_orderkey").select(
        "o_orderkey", step.cast("double").alias("step"), F.when(step == 1, 70.0).otherwise(10.0 * step).alias("__label"), "split"
    )
    scorer = fit_side(rows, {"step": ColumnType.NUMBER}, "regression.forest")
    return _test_predictions(rows, scorer).select("o_orderkey", F.round("prediction", 6).alias("prediction"))


@query("""SELECT (o_orderkey % 3)::int AS place, count(*) AS n, round(avg((o_orderkey % 3) * 50 + o_custkey % 5), 4) AS x, round(avg((o_orderkey % 3) * -20 + o_custkey % 7), 4) AS y
FROM orders GROUP BY 1""")
def kmeans_groups(spark, directory):
    """Clusters of groups far apart, by their centres in input units, numbered by the first of them."""
    third = F.col("o_orderkey") % 3
    rows = table(spark, directory, "orders").select(
        (third * 50 + F.col("o_custkey") % 5).cast("double").alias("x"), (third * -20 + F.col("o_custkey") % 7).cast("double").alias("y"), F.lit("train").alias("split")
    )
    scorer = fit_side(rows, {"x": ColumnType.NUMBER, "y": ColumnType.NUMBER}, "clustering.kmeans", 3)
    found = score.predict_many(scorer, rows.select("x", "y"))
    summary = evaluate.cluster_summary(found, scorer.preprocessor, scorer.model.state)
    wide = summary.groupBy("cluster").agg(F.max("n").alias("n"), *[F.round(F.max(F.when(F.col("name") == c, F.col("center"))), 4).alias(c) for c in ("x", "y")])
    return wide.select((F.row_number().over(Window.orderBy("x")) - 1).alias("place"), "n", "x", "y")  # a row per cluster


@query("""WITH x AS (SELECT *, l_quantity * 2000 + l_extendedprice AS worth FROM lineitem),
m AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(worth) AS mw, stddev_pop(worth) AS sw FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(((l_quantity - mq) / sq + (worth - mw) / sw) / sqrt(2), 4) + 0.0::double AS pc1 FROM x, m""")
def pca_transform(spark, directory):
    """The first axis of two scaled inputs that rise together weighs both alike."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, directory, "lineitem").select(*keys, F.col("l_quantity").alias("quantity"), (F.col("l_quantity") * 2000 + F.col("l_extendedprice")).alias("worth"))
    scorer = fit_side(rows.withColumn("split", F.lit("train")), {"quantity": ColumnType.NUMBER, "worth": ColumnType.NUMBER}, "reduction.pca", 1)
    return score.transform_many(scorer, rows, keep=keys).select(*keys, plain_zero(F.round(F.col("components")[0], 4)).alias("pc1"))


@query("""SELECT name, warned FROM (SELECT 'mixed' AS name, count(DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 'number' ELSE 'text' END) > 1 AS warned FROM orders
UNION ALL SELECT 'plain', count(DISTINCT 'text') > 1 FROM orders UNION ALL SELECT 'nulls', false)""")
def mixed_kinds(spark, directory):
    """Columns that hold values of several JSON kinds."""
    path = scratch_directory(spark, "kinds")
    key = F.col("o_orderkey")
    line = F.concat(
        F.lit('{"mixed":'), F.when(key % 3 == 0, key.cast("string")).otherwise(F.concat(F.lit('"k'), key.cast("string"), F.lit('"'))),
        F.lit(',"plain":"p'), (key % 9).cast("string"), F.lit('","nulls":'), F.when(key % 2 == 0, "null").otherwise('"x"'), F.lit("}"),
    )
    table(spark, directory, "orders").select(line.alias("value")).write.text(path)
    rows = read_jsonl(spark, path, malformed="raise").withColumn("row", F.monotonically_increasing_id())
    return profile(column_facts(rows, "row")).select("name", F.array_contains("warnings", "MIXED_KINDS").alias("warned"))
