"""Ordering finished candidates and recommending one."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.contracts import Task


def rank_candidates(results):
    """Valid candidates per task, best first.

    `results` has one row per model: model_id, task, status, accuracy, macro_f1, mae.
    Classification ranks by macro F1, then accuracy; regression by MAE; the model id
    breaks ties and orders the unsupervised tasks. Candidates without a finite required
    metric are left out.
    """
    c = F.col
    classes, numbers = c("task") == Task.CLASSIFICATION.value, c("task") == Task.REGRESSION.value

    def finite(name):
        return F.coalesce(F.abs(c(name)) < float("inf"), F.lit(False))

    valid = (c("status") == "completed") & (
        F.when(classes, finite("macro_f1") & finite("accuracy")).when(numbers, finite("mae")).otherwise(True)
    )
    order = Window.partitionBy("task").orderBy(
        F.when(classes, -c("macro_f1")), F.when(classes, -c("accuracy")), F.when(numbers, c("mae")), c("model_id")
    )
    size = F.count("*").over(Window.partitionBy("task"))
    first = c("rank") == 1
    supervised = classes | numbers
    return (
        results.where(valid)
        .withColumn("rank", F.row_number().over(order))
        .withColumn("candidates", size)
        .withColumn(
            "recommendation",
            F.when(first & supervised & (c("candidates") == 1), "ONLY_COMPLETED")
            .when(first & supervised, "BEST_ON_TEST"),
        )
        .drop("candidates")
    )
