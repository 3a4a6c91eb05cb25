"""Lloyd's K-Means, covariance PCA and gradient-descent logistic regression, step by step."""

import numpy as np
from pyspark.sql import functions as F

from tabloom.operators import components, lloyd
from tabloom.operators.descent import GradientLogistic
from tabloom.plans.catalog import plain_zero, query, table

STEPS, GROUPS = 3, 3
_POINTS = "p AS (SELECT p_partkey AS id, p_size / 50.0::double AS x, p_retailprice / 1000.0::double AS y FROM part)"


def _points(spark, directory):
    return table(spark, directory, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("x"), (F.col("p_retailprice") / 1000.0).alias("y")
    )


def _lloyd_sql():
    """Start rows and one pair of CTEs per step."""
    parts = [_POINTS, f"""c0 AS (SELECT row_number() OVER (ORDER BY md5('42:' || id)) - 1 AS k, x, y FROM p
      QUALIFY k < {GROUPS})"""]
    for i in range(STEPS + 1):
        parts.append(f"""a{i} AS (SELECT id, x, y, k, d FROM (SELECT p.id, p.x, p.y, c.k, (p.x - c.x) ** 2 + (p.y - c.y) ** 2 AS d,
          row_number() OVER (PARTITION BY p.id ORDER BY (p.x - c.x) ** 2 + (p.y - c.y) ** 2, c.k) AS r FROM p, c{i} c) WHERE r = 1)""")
        if i < STEPS:
            parts.append(f"""c{i + 1} AS (SELECT c.k, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y FROM c{i} c
              LEFT JOIN (SELECT k, avg(x) AS x, avg(y) AS y FROM a{i} GROUP BY k) m ON m.k = c.k)""")
    return "WITH " + ", ".join(parts)


def _fit(spark, directory):
    return lloyd.LloydKMeans(GROUPS, STEPS).fit(_points(spark, directory), "id", ["x", "y"])


@query(_lloyd_sql() + " UNION ALL ".join(
    f" SELECT {i} AS step, k::int AS cluster, round(x, 6) AS x, round(y, 6) AS y FROM c{i}" for i in range(1, STEPS + 1)))
def lloyd_steps(spark, directory):
    model = _fit(spark, directory)
    rows = [
        (s + 1, k, float(c[0]), float(c[1])) for s, cs in enumerate(model.centroids_history) for k, c in enumerate(cs)
    ]
    steps = spark.createDataFrame(rows, "step int, cluster int, x double, y double")
    return steps.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query(_lloyd_sql() + f" SELECT id, k::int AS cluster FROM a{STEPS}")
def lloyd_assign(spark, directory):
    return _fit(spark, directory).predict(_points(spark, directory)).select("id", "cluster")


@query(_lloyd_sql() + " UNION ALL ".join(
    f" SELECT {i} AS step, round(sum(d), 6) AS cost FROM a{i}" for i in range(1, STEPS + 1)))
def lloyd_cost(spark, directory):
    model = _fit(spark, directory)
    rows = [(i + 1, float(c)) for i, c in enumerate(model.costs)]
    return spark.createDataFrame(rows, "step int, cost double").withColumn("cost", F.round("cost", 6))


COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) + 0.0::double AS covariance FROM lineitem"
    for i, a in enumerate(COLUMNS) for b in COLUMNS[i:]))
def covariance_matrix(spark, directory):
    rows = components.covariance_rows(table(spark, directory, "lineitem"), COLUMNS)
    return rows.withColumn("covariance", plain_zero(F.round("covariance", 4)))


# Two columns, where axes and variances have a closed form.
_PAIR = "p AS (SELECT l_quantity / 50.0::double AS x, l_extendedprice / 100000.0::double AS y, l_orderkey, l_linenumber, l_partkey FROM lineitem)"
_AXES = f"""{_PAIR}, m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM p),
e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM m),
v AS (SELECT *, b / sqrt(b * b + (l1 - a) ** 2) AS ux, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS uy FROM e),
w AS (SELECT *, CASE WHEN (CASE WHEN abs(ux) >= abs(uy) THEN ux ELSE uy END) < 0 THEN -1 ELSE 1 END AS sg FROM v),
z AS (SELECT mx, my, l1, l2, ux * sg AS ux, uy * sg AS uy FROM w)"""


def _pair(spark, directory):
    return table(spark, directory, "lineitem").select(
        (F.col("l_quantity") / 50.0).alias("x"), (F.col("l_extendedprice") / 100000.0).alias("y"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )


@query(f"""WITH {_AXES}, k AS (SELECT 1 AS component, l1 AS v, ux AS wx, uy AS wy, l1 + l2 AS total FROM z
UNION ALL SELECT 2, l2, CASE WHEN abs(uy) > abs(ux) THEN abs(uy) ELSE -uy * sign(ux) END,
  CASE WHEN abs(uy) > abs(ux) THEN -ux * sign(uy) ELSE abs(ux) END, l1 + l2 FROM z)
SELECT component, round(v, 6) AS variance, round(v / total, 6) AS ratio, round(wx, 6) AS wx, round(wy, 6) AS wy FROM k""")
def pca_two_columns(spark, directory):
    model = components.CovariancePCA(2).fit(_pair(spark, directory), ["x", "y"])
    total = float(np.sum(model.variances))
    rows = [
        (i + 1, float(v), float(v) / total, float(model.components[0, i]), float(model.components[1, i]))
        for i, v in enumerate(model.variances)
    ]
    out = spark.createDataFrame(rows, "component int, variance double, ratio double, wx double, wy double")
    return out.withColumns({c: F.round(c, 6) for c in ("variance", "ratio", "wx", "wy")})


@query(f"WITH {_AXES} SELECT l_orderkey, l_linenumber, l_partkey, round((x - mx) * ux + (y - my) * uy, 5) + 0.0::double AS pc1 FROM p, z")
def pca_scores(spark, directory):
    rows = _pair(spark, directory)
    model = components.CovariancePCA(1).fit(rows, ["x", "y"])
    return model.transform(rows).select("l_orderkey", "l_linenumber", "l_partkey", plain_zero(F.round("pc1", 5)).alias("pc1"))


@query(f"""WITH {_AXES}, s AS (SELECT x, y, mx, my, ux, uy, (x - mx) * ux + (y - my) * uy AS t FROM p, z)
SELECT round(avg(((x - mx - t * ux) ** 2 + (y - my - t * uy) ** 2) / 2), 8) AS reconstruction_mse FROM s""")
def pca_reconstruction(spark, directory):
    rows = _pair(spark, directory)
    model = components.CovariancePCA(1).fit(rows, ["x", "y"])
    back = model.inverse_transform(model.transform(rows))
    error = components.reconstruction_error(back, ["x", "y"])
    return error.withColumn("reconstruction_mse", F.round("reconstruction_mse", 8))


# Logistic regression of the quality label on two features of the document.
RATE, EPOCHS = 0.5, 3
_DOCUMENTS = """p AS (SELECT doc_id, quality::double AS y, n_chars / 10000.0::double AS a, (lang = 'en')::int::double AS b
  FROM documents JOIN labels USING (doc_id))"""


def _documents(spark, directory):
    rows = table(spark, directory, "documents").join(table(spark, directory, "labels"), "doc_id")
    return rows.select(
        "doc_id", "quality", (F.col("n_chars") / 10000.0).alias("a"), (F.col("lang") == "en").cast("double").alias("b")
    )


def _descent_sql():
    parts = [_DOCUMENTS, "w0 AS (SELECT 0.0::double AS c, 0.0::double AS u, 0.0::double AS v)"]
    for i in range(EPOCHS + 1):
        parts.append(f"""g{i} AS (SELECT y, a, b, 1 / (1 + exp(-greatest(-500, least(500, c + a * u + b * v)))) AS q FROM p, w{i})""")
        if i < EPOCHS:
            parts.append(f"""w{i + 1} AS (SELECT c - {RATE}::double * (SELECT avg(q - y) FROM g{i}) AS c,
              u - {RATE}::double * (SELECT avg((q - y) * a) FROM g{i}) AS u, v - {RATE}::double * (SELECT avg((q - y) * b) FROM g{i}) AS v FROM w{i})""")
    return "WITH " + ", ".join(parts)


@query(_descent_sql() + " UNION ALL ".join(
    f""" SELECT {i} AS epoch, round(-avg(y * ln(greatest(1e-15, least(1 - 1e-15::double, q)))
    + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15::double, q)))), 6) AS loss FROM g{i}""" for i in range(1, EPOCHS + 1)))
def logistic_gd_steps(spark, directory):
    model = GradientLogistic(RATE, EPOCHS).fit(_documents(spark, directory), ["a", "b"], "quality")
    rows = [(i + 1, float(x)) for i, x in enumerate(model.loss_history)]
    return spark.createDataFrame(rows, "epoch int, loss double").withColumn("loss", F.round("loss", 6))


@query(_descent_sql() + f""" SELECT doc_id, round(1 / (1 + exp(-(c + a * u + b * v))), 6) AS probability,
  (1 / (1 + exp(-(c + a * u + b * v))) >= 0.5)::int AS prediction FROM p, w{EPOCHS}""")
def logistic_scores(spark, directory):
    rows = _documents(spark, directory)
    model = GradientLogistic(RATE, EPOCHS).fit(rows, ["a", "b"], "quality")
    return model.predict(rows).select("doc_id", F.round("probability", 6).alias("probability"), "prediction")
