"""The six models on whole tables: fitted on the training side, scored on the test side."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.contracts import ColumnType, Task
from tabloom.operators import evaluate, models, preprocess, score, split
from tabloom.operators.rows import spread, with_file_order
from tabloom.plans.catalog import query, table
from tabloom.plans.split_queries import SHUFFLED

# Line items have no key, so a record's place in the file names it.


def _lineitem(spark, directory):
    return with_file_order(table(spark, directory, "lineitem")).select(
        "row_id",
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.year("l_shipdate").cast("double").alias("year"),
        F.col("l_linestatus").alias("status"),
        F.col("l_returnflag").alias("flag"),
    )


def _classified(spark, directory):
    """Return flag from the other columns; the test side has every class."""
    return split.stratified_holdout(_lineitem(spark, directory), "row_id", "flag").withColumnRenamed("flag", "__label")


CLASS_INPUTS = {"quantity": ColumnType.NUMBER, "price": ColumnType.NUMBER, "discount": ColumnType.NUMBER,
                "year": ColumnType.NUMBER, "status": ColumnType.CATEGORY}
PRICE_INPUTS = {"quantity": ColumnType.NUMBER, "discount": ColumnType.NUMBER, "status": ColumnType.CATEGORY}


def fit_side(rows, types, model_id, option=None):
    """A scorer fitted on the training rows of a split table with `__label`."""
    task = models.model_spec(model_id).task
    # Medians, scales, categories and the fit itself all read the training rows.
    train = spread(rows.where(F.col("split") == split.TRAIN)).persist()
    prep = preprocess.fit_preprocessor(train, types, models.model_spec(model_id).scale)
    kept = ["features", *([F.col("__label").alias("label")] if task.supervised else [])]
    encoded = preprocess.encode(train, prep).select(*kept)
    if task != Task.CLUSTERING:  # which reads the rows once
        encoded = encoded.persist()
    labels = ()
    if task == Task.CLASSIFICATION:
        labels = tuple(sorted(r[0] for r in encoded.select("label").distinct().collect()))
    model = models.fit_model(model_id, encoded, option, labels)
    encoded.unpersist()
    fields = score.fitted_fields(train, types)
    train.unpersist()
    return score.Scorer(fields, prep, model)


def _test_predictions(rows, scorer):
    test = rows.where(F.col("split") == split.TEST)
    return scorer.model.apply(preprocess.encode(test, scorer.preprocessor))


def _class_scores(rows, model_id, types):
    scorer = fit_side(rows, types, model_id)
    labels = evaluate.label_counts(rows.where(F.col("split") == split.TRAIN), "__label")
    pairs = evaluate.pair_counts(_test_predictions(rows, scorer), "__label")
    return evaluate.classification_metrics(pairs, labels)


@query()
def fit_logistic(spark, directory):
    return _class_scores(_classified(spark, directory), "classification.logistic", CLASS_INPUTS)


ORDER_INPUTS = {"customer": ColumnType.NUMBER, "price": ColumnType.NUMBER, "priority": ColumnType.CATEGORY}


def _orders(spark, directory):
    return table(spark, directory, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("double").alias("customer"), F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
    )


@query()
def fit_forest_classifier(spark, directory):
    rows = split.stratified_holdout(_orders(spark, directory), "o_orderkey", "status")
    return _class_scores(rows.withColumnRenamed("status", "__label"), "classification.forest", ORDER_INPUTS)


def _priced(spark, directory):
    rows = split.shuffled_holdout(_lineitem(spark, directory), "row_id")
    return rows.withColumnRenamed("price", "__label")


@query()
def fit_linear(spark, directory):
    rows = _priced(spark, directory)
    scorer = fit_side(rows, PRICE_INPUTS, "regression.linear")
    return evaluate.regression_metrics(_test_predictions(rows, scorer), "__label")


@query()
def fit_forest_regressor(spark, directory):
    rows = split.shuffled_holdout(_orders(spark, directory), "o_orderkey").withColumnRenamed("price", "__label")
    types = {"customer": ColumnType.NUMBER, "priority": ColumnType.CATEGORY, "status": ColumnType.CATEGORY}
    scorer = fit_side(rows, types, "regression.forest")
    return evaluate.regression_metrics(_test_predictions(rows, scorer), "__label")


@query(f"""WITH {SHUFFLED.format(key='o_orderkey', table='orders')}, f AS (
  SELECT regr_slope(o_totalprice, o_custkey::double) AS slope, regr_intercept(o_totalprice, o_custkey::double) AS icept FROM s WHERE split = 'train')
SELECT o_orderkey, round(icept + slope * o_custkey, 3) AS prediction FROM s, f WHERE split = 'test'""")
def linear_closed_form(spark, directory):
    rows = split.shuffled_holdout(table(spark, directory, "orders"), "o_orderkey").select(
        "o_orderkey", F.col("o_custkey").cast("double").alias("customer"), F.col("o_totalprice").alias("__label"), "split"
    )
    scorer = fit_side(rows, {"customer": ColumnType.NUMBER}, "regression.linear")
    return _test_predictions(rows, scorer).select("o_orderkey", F.round("prediction", 3).alias("prediction"))


def _vectors(spark, directory):
    """All entries of the embeddings as columns of their own; vectors of different lengths are an error."""
    rows = table(spark, directory, "embeddings")
    width = evaluate.equal_width(rows, "embedding") or 0
    return rows.select(
        "vec_id", F.lit("train").alias("split"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)]
    ), {f"e{i}": ColumnType.NUMBER for i in range(width)}


@query()
def fit_kmeans(spark, directory):
    rows, types = _vectors(spark, directory)
    scorer = fit_side(rows, types, "clustering.kmeans", 3)
    found = scorer.model.apply(preprocess.encode(rows, scorer.preprocessor))
    return evaluate.cluster_sizes(found, "cluster").withColumns({
        "inertia": F.lit(scorer.model.state["inertia"]), "iterations": F.lit(scorer.model.state["iterations"]),
    })


@query()
def fit_pca(spark, directory):
    rows, types = _vectors(spark, directory)
    scorer = fit_side(rows, types, "reduction.pca", 2)
    return score.transform_many(scorer, rows.drop("split"), keep=["vec_id"]).select(
        "vec_id", *[F.col("components")[i].alias(f"pc{i + 1}") for i in range(2)], F.size("warnings").alias("warnings")
    )


@query()
def silhouette_of_fit(spark, directory):
    rows, types = _vectors(spark, directory)
    scorer = fit_side(rows, types, "clustering.kmeans", 3)
    found = scorer.model.apply(preprocess.encode(rows, scorer.preprocessor))
    return evaluate.silhouette(
        found.select("cluster", vector_to_array("features").alias("features")), "cluster"
    )


@query()
def score_batch(spark, directory):
    """Every line item scored as raw text by a fitted classifier, with its input warnings."""
    rows = _classified(spark, directory)
    scorer = fit_side(rows, CLASS_INPUTS, "classification.logistic")
    raw = _lineitem(spark, directory).select(
        "row_id",
        *[F.when(F.col("row_id") % 50 == i, F.lit(None)).otherwise(F.format_string("%.2f", n)).alias(n)
          for i, n in enumerate(("quantity", "price", "discount", "year"))],
        F.when(F.col("row_id") % 50 == 49, "X").otherwise(F.col("status")).alias("status"),
    )
    scored = score.predict_many(scorer, raw, keep=["row_id"])
    return scored.select("row_id", "prediction", F.array_join(F.transform("warnings", lambda w: w["code"]), ",").alias("warnings"))
