"""Metrics, baselines and rankings of rule-based predictions on held-out rows."""

from pyspark.sql import functions as F

from tabloom.operators import evaluate, ranking
from tabloom.plans.catalog import plain_zero, query, table
from tabloom.plans.split_queries import ORDERS_SHUFFLED, ORDERS_STRATIFIED, orders_shuffled, orders_stratified

# A rule that answers the order status from its priority.
_RULE = """CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'F' WHEN o_orderpriority = '5-LOW' THEN 'P' ELSE 'O' END"""
_LABELED = f"""{ORDERS_STRATIFIED}, x AS (SELECT o_orderstatus AS label, {_RULE} AS prediction, split FROM s),
train AS (SELECT label, count(*) AS n FROM x WHERE split = 'train' GROUP BY 1),
pairs AS (SELECT label, prediction, count(*) AS n FROM x WHERE split = 'test' GROUP BY 1, 2)"""
_PER_CLASS = """
per AS (SELECT label, coalesce((SELECT sum(n) FROM {pairs} p WHERE p.label = t.label AND p.prediction = t.label), 0) AS hits,
  coalesce((SELECT sum(n) FROM {pairs} p WHERE p.prediction = t.label), 0) AS predicted,
  coalesce((SELECT sum(n) FROM {pairs} p WHERE p.label = t.label), 0)::bigint AS support FROM train t),
scores AS (SELECT label, CASE WHEN predicted = 0 THEN 0.0 ELSE hits / predicted END::double AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE hits / support END::double AS recall,
  CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * hits / (support + predicted) END::double AS f1, support FROM per)"""


def _scored(spark, directory):
    priority = F.col("o_orderpriority")
    rule = F.when(priority.isin("1-URGENT", "2-HIGH"), "F").when(priority == "5-LOW", "P").otherwise("O")
    return orders_stratified(spark, directory).select(F.col("o_orderstatus").alias("label"), rule.alias("prediction"), "split")


def _sides(spark, directory):
    rows = _scored(spark, directory)
    labels = evaluate.label_counts(rows.where(F.col("split") == "train"))
    return evaluate.pair_counts(rows.where(F.col("split") == "test")), labels


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"""WITH {_LABELED} SELECT a.label, b.label AS prediction, coalesce(p.n, 0) AS n
FROM train a CROSS JOIN train b LEFT JOIN pairs p ON p.label = a.label AND p.prediction = b.label""")
def confusion_matrix(spark, directory):
    return evaluate.confusion_matrix(*_sides(spark, directory))


@query(f"""WITH {_LABELED}, {_PER_CLASS.format(pairs='pairs')}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM scores""")
def per_class(spark, directory):
    return _rounded(evaluate.per_class(*_sides(spark, directory)), "precision", "recall", "f1")


@query(f"""WITH {_LABELED}, {_PER_CLASS.format(pairs='pairs')}
SELECT (SELECT round(sum(n) FILTER (label = prediction) / sum(n), 6)::double FROM pairs) AS accuracy,
  (SELECT round(avg(f1), 6) FROM scores) AS macro_f1""")
def classification_metrics(spark, directory):
    return _rounded(evaluate.classification_metrics(*_sides(spark, directory)), "accuracy", "macro_f1")


@query(f"""WITH {_LABELED}, top AS (SELECT label AS m FROM train ORDER BY n DESC, label LIMIT 1),
flat AS (SELECT label, m AS prediction, sum(n) AS n FROM pairs, top GROUP BY 1, 2), {_PER_CLASS.format(pairs='flat')}
SELECT (SELECT m FROM top) AS label, (SELECT round(sum(n) FILTER (label = prediction) / sum(n), 6)::double FROM flat) AS accuracy,
  (SELECT round(avg(f1), 6) FROM scores) AS macro_f1""")
def majority_baseline(spark, directory):
    return _rounded(evaluate.majority_baseline(*_sides(spark, directory)), "accuracy", "macro_f1")


@query(f"WITH {_LABELED} SELECT split, label, count(*) AS n FROM x GROUP BY 1, 2")
def class_counts(spark, directory):
    return evaluate.class_counts(_scored(spark, directory))


@query(f"""WITH {_LABELED} SELECT o_orderpriority AS label, count(*) AS n FROM s
WHERE split = 'test' AND o_orderpriority NOT IN (SELECT label FROM train) GROUP BY 1""")
def unknown_labels(spark, directory):
    rows = orders_stratified(spark, directory).select(
        F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("prediction"), "split"
    )
    labels = evaluate.label_counts(rows.where(F.col("split") == "train"))
    return evaluate.unknown_labels(rows.where(F.col("split") == "test"), labels)


# Regression: the price of a line item answered from its quantity.
_PRICED = "x AS (SELECT l_extendedprice AS label, l_quantity * 2100.0::double AS prediction FROM lineitem)"


def _priced(spark, directory):
    return table(spark, directory, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2100.0).alias("prediction")
    )


@query(f"""WITH {_PRICED} SELECT round(avg(abs(label - prediction)), 4) AS mae, round(sqrt(avg((label - prediction) ** 2)), 4) AS rmse,
  round(1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*)), 6) AS r2, NULL::varchar AS r2_reason FROM x""")
def regression_metrics(spark, directory):
    scores = evaluate.regression_metrics(_priced(spark, directory))
    return scores.withColumns({"mae": F.round("mae", 4), "rmse": F.round("rmse", 4), "r2": F.round("r2", 6)})


@query(f"""WITH {_PRICED} SELECT count(*) AS count, round(avg(label - prediction), 4) + 0.0::double AS mean,
  round(min(label - prediction), 4) AS minimum, round(max(label - prediction), 4) AS maximum FROM x""")
def residual_summary(spark, directory):
    row = evaluate.residual_summary(_priced(spark, directory))
    return row.withColumns({n: plain_zero(F.round(n, 4)) for n in ("mean", "minimum", "maximum")})


@query(f"""WITH {ORDERS_SHUFFLED}, m AS (SELECT avg(o_totalprice) AS mean FROM s WHERE split = 'train')
SELECT round(mean, 4) AS mean, round(avg(abs(o_totalprice - mean)), 4) AS mae, round(sqrt(avg((o_totalprice - mean) ** 2)), 4) AS rmse,
  round(1 - sum((o_totalprice - mean) ** 2) / (var_pop(o_totalprice) * count(*)), 6) + 0.0::double AS r2
FROM s, m WHERE split = 'test' GROUP BY mean""")
def mean_baseline(spark, directory):
    rows = orders_shuffled(spark, directory)
    base = evaluate.mean_baseline(
        rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test"), "o_totalprice"
    )
    return base.withColumns({"mean": F.round("mean", 4), "mae": F.round("mae", 4), "rmse": F.round("rmse", 4),
                             "r2": plain_zero(F.round("r2", 6))})


@query("""WITH p AS (SELECT vec_id, label AS own, unnest(embedding)::double AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT own AS other, i, count(*) AS n, avg(v) AS mean, var_pop(v) AS variance FROM p GROUP BY 1, 2),
k AS (SELECT other, max(n) AS n, sum(variance) AS variance FROM m GROUP BY 1),
d AS (SELECT vec_id, own, other, sum((v - mean) ** 2) AS d FROM p JOIN m USING (i) GROUP BY 1, 2, 3),
w AS (SELECT vec_id, max(n) FILTER (own = other) AS n, max((d + variance) * n / greatest(n - 1, 1)) FILTER (own = other) AS a,
  min(d + variance) FILTER (own <> other) AS b FROM d JOIN k USING (other) GROUP BY 1)
SELECT round(avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette,
  count(*) AS silhouette_rows, NULL::varchar AS reason FROM w""")
def silhouette(spark, directory):
    rows = table(spark, directory, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("features"))
    return evaluate.silhouette(rows, "label").withColumn("silhouette", F.round("silhouette", 6))


@query("SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1")
def cluster_sizes(spark, directory):
    return evaluate.cluster_sizes(table(spark, directory, "embeddings"), "label")


# Candidates: three rules for the status and two for the price, each evaluated on the test rows.
_STATUS_RULES = {
    "rule.priority": (_RULE, lambda: F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "F")
                      .when(F.col("o_orderpriority") == "5-LOW", "P").otherwise("O")),
    "rule.always_f": ("'F'", lambda: F.lit("F")),
    "rule.always_f_again": ("'F'", lambda: F.lit("F")),
}


def _f1_sql(rule):
    return f"""(WITH p AS (SELECT o_orderstatus AS label, {rule} AS prediction FROM s WHERE split = 'test'),
      l AS (SELECT DISTINCT o_orderstatus AS label FROM s WHERE split = 'train')
      SELECT avg(coalesce(2.0::double * (SELECT count(*) FROM p WHERE p.label = l.label AND p.prediction = l.label)
        / nullif((SELECT count(*) FROM p WHERE p.label = l.label) + (SELECT count(*) FROM p WHERE p.prediction = l.label), 0), 0.0)) FROM l)"""


def _rank_sql():
    rows = [
        f"SELECT '{name}' AS model_id, 'classification' AS task, "
        f"(SELECT avg((o_orderstatus = {rule})::int) FROM s WHERE split = 'test') AS accuracy, {_f1_sql(rule)} AS macro_f1, NULL::double AS mae"
        for name, (rule, _) in _STATUS_RULES.items()
    ]
    for name, price in (("rule.flat", "250000.0::double"), ("rule.key", "o_custkey::double")):
        rows.append(
            f"SELECT '{name}', 'regression', NULL, NULL, (SELECT avg(abs(o_totalprice - {price})) FROM s WHERE split = 'test')"
        )
    return f"""WITH {ORDERS_STRATIFIED}, c AS ({" UNION ALL ".join(rows)}),
    r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY -macro_f1, -accuracy, mae, model_id)::int AS rank FROM c)
    SELECT model_id, task, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(mae, 4) AS mae, rank,
      CASE WHEN rank = 1 THEN 'BEST_ON_TEST' END AS recommendation FROM r"""


@query(_rank_sql())
def rank_candidates(spark, directory):
    rows = orders_stratified(spark, directory)
    train, test = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")
    labels = evaluate.label_counts(train, "o_orderstatus")
    parts = []
    for name, (_, rule) in _STATUS_RULES.items():
        pairs = evaluate.pair_counts(test.withColumn("prediction", rule()), "o_orderstatus")
        scores = evaluate.classification_metrics(pairs, labels)
        parts.append(scores.select(
            F.lit(name).alias("model_id"), F.lit("classification").alias("task"), F.lit("completed").alias("status"),
            "accuracy", "macro_f1", F.lit(None).cast("double").alias("mae"),
        ))
    prices = {"rule.flat": F.lit(250000.0), "rule.key": F.col("o_custkey").cast("double")}
    for name, price in prices.items():
        scores = evaluate.regression_metrics(test.withColumn("prediction", price), "o_totalprice")
        parts.append(scores.select(
            F.lit(name).alias("model_id"), F.lit("regression").alias("task"), F.lit("completed").alias("status"),
            F.lit(None).cast("double").alias("accuracy"), F.lit(None).cast("double").alias("macro_f1"), "mae",
        ))
    results = parts[0]
    for part in parts[1:]:
        results = results.unionByName(part)
    # A failed candidate never ranks.
    failed = results.where(F.col("model_id") == "rule.flat").withColumns(
        {"model_id": F.lit("rule.broken"), "status": F.lit("failed")}
    )
    order = ranking.rank_candidates(results.unionByName(failed))
    return order.select(
        "model_id", "task", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"),
        F.round("mae", 4).alias("mae"), "rank", "recommendation",
    )
