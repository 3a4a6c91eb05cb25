"""Which columns may be a target or a feature, and why not.

These rules read the profile, one row per column, never the table itself.
"""

from pyspark.sql import functions as F

from tabloom.contracts import ColumnType, Task

# Size limits of the rules.
MIN_TARGET_ROWS = 20
MIN_CLASSES, MAX_CLASSES = 2, 20
MIN_CLASS_ROWS = 5
CLUSTERING_ROWS, CLUSTERING_FEATURES = 10, 1
REDUCTION_ROWS, REDUCTION_FEATURES = 3, 2
MAX_OPTION = 10
DEFAULT_GROUPS = 3
DEFAULT_COMPONENTS = 2

NO_ROLE = (ColumnType.UNKNOWN.value, ColumnType.IDENTIFIER.value, ColumnType.DATE.value)

# Reason codes with the text shown for them.
REASONS = {
    "NO_TARGET": "Unsupervised tasks have no target.",
    "TARGET_TYPE": "Read this column as another type before using it as target.",
    "TARGET_NUMBER": "Regression needs a Number target.",
    "TARGET_MISSING": "The target may not have missing values.",
    "TARGET_ROWS": "The table needs 20 rows or more.",
    "TARGET_CONSTANT": "The target needs two different values or more.",
    "TARGET_FRACTION": "Fractional numbers are classes only after reading them as Category.",
    "CLASS_COUNT": "A target needs 2 to 20 classes.",
    "CLASS_SIZE": "Each class needs 5 rows or more.",
    "IS_TARGET": "The target is not an input.",
    "CONSTANT": "The column does not vary.",
    "FEATURE_TYPE": "Read this column as another type before using it as input.",
    "NUMBER_ONLY": "This task takes Number inputs only.",
    "REVIEW": "Many categories or long text: look before selecting.",
    "NO_INPUT": "This column cannot be an input.",
    "TOO_FEW_INPUTS": "PCA needs two Number inputs or more.",
    "NO_OPTION": "Supervised tasks take no option.",
    "OPTION_RANGE": "The option is a whole number within the bounds of this table.",
    "GOAL_TARGET": "No complete, varying target with a usable input.",
    "GOAL_ROWS": "Too few rows for this task.",
    "GOAL_FEATURES": "Too few varying Number columns for this task.",
}


def target_reason(task):
    """Reason code of the first rule a column fails as target, null when it is eligible.

    Applies to profile rows. The order of the rules decides the answer.
    """
    c, kind = F.col, F.col("effective")
    number = kind == ColumnType.NUMBER.value
    if not Task(task).supervised:
        return F.lit("NO_TARGET")
    reason = F.when(kind.isin(*NO_ROLE), "TARGET_TYPE")
    if task == Task.REGRESSION:
        reason = reason.when(~number, "TARGET_NUMBER")
    reason = (
        reason.when(c("missing_count") > 0, "TARGET_MISSING")
        .when(c("row_count") < MIN_TARGET_ROWS, "TARGET_ROWS")
        .when(c("distinct_count") < 2, "TARGET_CONSTANT")
    )
    if task == Task.CLASSIFICATION:
        reason = (
            reason.when(number & ~c("integral"), "TARGET_FRACTION")
            .when(~c("distinct_count").between(MIN_CLASSES, MAX_CLASSES), "CLASS_COUNT")
            .when(c("smallest_class") < MIN_CLASS_ROWS, "CLASS_SIZE")
        )
    return reason


def target_reasons(profiled, task):
    return profiled.select(
        "position", "name", "effective", "warnings", target_reason(task).alias("reason")
    ).withColumn("eligible", F.col("reason").isNull())


def target_choices(profiled, task, show_all=False):
    """Eligible targets in the order to offer them; long text only with `show_all`."""
    choices = target_reasons(profiled, task)
    if not show_all:
        choices = choices.where(F.col("eligible") & ~F.array_contains("warnings", "LONG_TEXT"))
    number_last = F.lit(task == Task.CLASSIFICATION) & (F.col("effective") == ColumnType.NUMBER.value)
    return choices.select("name", "eligible", "reason", number_last.alias("last"), "position").orderBy(
        "last", "position"
    )


def feature_reason(task, target=None):
    kind = F.col("effective")
    reason = F.when(F.col("name").eqNullSafe(F.lit(target)), "IS_TARGET").when(
        F.col("distinct_count") < 2, "CONSTANT"
    ).when(kind.isin(*NO_ROLE), "FEATURE_TYPE")
    if not Task(task).supervised:
        reason = reason.when(kind != ColumnType.NUMBER.value, "NUMBER_ONLY")
    return reason.when(
        F.arrays_overlap("warnings", F.array(F.lit("HIGH_CARDINALITY"), F.lit("LONG_TEXT"))), "REVIEW"
    )


def feature_choices(profiled, task, target=None):
    """Per column: may it be an input, is it one by default, and the reason if not."""
    rows = profiled.select("position", "name", feature_reason(task, target).alias("reason"))
    eligible = F.col("reason").isNull() | (F.col("reason") == "REVIEW")
    return rows.select(
        "position", "name", eligible.alias("eligible"), F.col("reason").isNull().alias("is_default"), "reason"
    )


def option_bounds(task, rows, features):
    """(minimum, maximum, default) of k or the number of components; None if supervised."""
    if task == Task.CLUSTERING:
        return 2, min(MAX_OPTION, rows - 1), DEFAULT_GROUPS
    if task == Task.REDUCTION:
        high = min(MAX_OPTION, rows - 1, features - 1)
        return 1, high, min(DEFAULT_COMPONENTS, high)
    return None


def goal_reasons(profiled):
    """One row per task: can it be done on this table, and within which option bounds.

    A supervised task needs a target and another column to learn from. A column's own
    feature rules do not depend on the target, so it is enough to count usable columns
    and take the target itself out of the count.
    """
    supervised_ok = feature_reason(Task.CLASSIFICATION)
    numeric_ok = feature_reason(Task.CLUSTERING)

    def usable(reason):
        return reason.isNull() | (reason == "REVIEW")

    marks = profiled.select(
        "row_count",
        usable(supervised_ok).cast("int").alias("feature"),
        usable(numeric_ok).cast("int").alias("numeric"),
        target_reason(Task.CLASSIFICATION).isNull().alias("class_target"),
        target_reason(Task.REGRESSION).isNull().alias("number_target"),
    )
    totals = marks.agg(
        F.max("row_count").alias("rows"),
        F.sum("feature").alias("features"),
        F.sum("numeric").alias("numeric"),
        # The best target leaves most inputs: one that is itself no input, if there is one.
        F.min(F.when(F.col("class_target"), F.col("feature"))).alias("class_cost"),
        F.min(F.when(F.col("number_target"), F.col("feature"))).alias("number_cost"),
    )
    c = F.col
    top = F.lit(MAX_OPTION)

    def supervised(task, cost):
        ok = F.coalesce(c("features") - c(cost) >= 1, F.lit(False))
        none = F.lit(None).cast("bigint")
        return F.struct(
            F.lit(task.value).alias("task"), F.when(~ok, "GOAL_TARGET").alias("reason"),
            none.alias("minimum"), none.alias("maximum"), none.alias("default_option"),
        )

    def unsupervised(task, rows, features, low, high, default):
        reason = F.when(c("rows") < rows, "GOAL_ROWS").when(c("numeric") < features, "GOAL_FEATURES")
        return F.struct(
            F.lit(task.value).alias("task"), reason.alias("reason"),
            F.lit(low).cast("bigint").alias("minimum"), high.cast("bigint").alias("maximum"),
            default.cast("bigint").alias("default_option"),
        )

    groups = F.least(top, c("rows") - 1)
    components = F.least(top, c("rows") - 1, c("numeric") - 1)
    tasks = F.array(
        supervised(Task.CLASSIFICATION, "class_cost"),
        supervised(Task.REGRESSION, "number_cost"),
        unsupervised(Task.CLUSTERING, CLUSTERING_ROWS, CLUSTERING_FEATURES, 2, groups, F.lit(DEFAULT_GROUPS)),
        unsupervised(Task.REDUCTION, REDUCTION_ROWS, REDUCTION_FEATURES, 1, components,
                     F.least(F.lit(DEFAULT_COMPONENTS), components)),
    )
    return totals.select(F.inline(tasks))
