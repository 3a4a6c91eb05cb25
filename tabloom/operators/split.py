"""One deterministic holdout split, made before anything is fitted."""

import math

from pyspark.sql import functions as F

from tabloom.contracts import SEED
from tabloom.errors import TableError
from tabloom.functions.names import col
from tabloom.operators.rows import row_hash
from tabloom.operators.selection import hash_cutoffs, held_out, within_cutoff

TRAIN, TEST = "train", "test"


def _tagged(df, is_test):
    return df.withColumn("split", F.when(is_test, TEST).otherwise(TRAIN))


def shuffled_holdout(df, row_id, seed=SEED):
    """Exactly ceil(n/5) rows become test rows, chosen by seeded hash of the row id."""
    digest = row_hash(col(row_id), seed)
    cutoffs = hash_cutoffs(df, digest, {"": held_out(df.count())})
    return _tagged(df, within_cutoff(digest, cutoffs))


def stratified_quotas(counts):
    """Test rows per class: proportional shares of ceil(n/5), largest remainders first.

    Ties between equal remainders go to the smaller label. Shares are compared as exact
    integers.
    """
    total = sum(counts.values())
    wanted = held_out(total)
    quotas = {label: n * wanted // total for label, n in counts.items()}
    rest = sorted(counts, key=lambda label: (-(counts[label] * wanted % total), label))
    for label in rest[: wanted - sum(quotas.values())]:
        quotas[label] += 1
    return quotas


def stratified_holdout(df, row_id, label, seed=SEED):
    """The same total, divided over the classes in proportion to their size."""
    counts = {r["label"]: r["n"] for r in df.groupBy(col(label).cast("string").alias("label")).agg(F.count("*").alias("n")).collect()}
    if None in counts:
        raise TableError("SPLIT", "The target has missing values.", "Choose another target.")
    quotas = stratified_quotas(counts)
    if any(not 0 < quotas[k] < n for k, n in counts.items()):
        raise TableError("SPLIT", "Some class cannot be on both sides of the split.", "Choose another target.")
    digest = row_hash(col(row_id), seed)
    cutoffs = hash_cutoffs(df, digest, quotas, col(label))
    return _tagged(df, within_cutoff(digest, cutoffs, col(label)))


def all_rows(df):
    """Plan of the unsupervised tasks: every row is used for fitting."""
    return df.withColumn("split", F.lit(TRAIN))


def split_check(split_df, row_id, label=None):
    """One row of counts that prove a split: sizes, distinct ids, classes per side."""
    test = F.col("split") == TEST
    aggregates = [
        F.count("*").alias("row_count"),
        F.count_if(F.col("split") == TRAIN).alias("train_rows"),
        F.count_if(test).alias("test_rows"),
        F.count_if(F.col("split").isNull() | ~F.col("split").isin(TRAIN, TEST)).alias("unassigned_rows"),
    ]
    facts = split_df.agg(*aggregates, F.countDistinct(col(row_id)).alias("distinct_ids"))
    if label is None:
        return facts
    sides = split_df.groupBy(col(label).alias("label")).agg(
        F.count_if(~test).alias("in_train"), F.count_if(test).alias("in_test")
    )
    classes = sides.agg(
        F.count("*").alias("classes"),
        F.count_if(F.col("in_train") == 0).alias("classes_without_train"),
        F.count_if(F.col("in_test") == 0).alias("classes_without_test"),
    )
    # Both sides hold exactly one row.
    return facts.withColumn("one", F.lit(1)).join(classes.withColumn("one", F.lit(1)), "one").drop("one")


def require_valid_split(split_df, row_id, label=None):
    """Fail unless every row is on exactly one side, once, and no class misses a side."""
    row = split_check(split_df, row_id, label).first()
    whole = row["train_rows"] + row["test_rows"] == row["row_count"] == row["distinct_ids"]
    sized = row["test_rows"] in (0, math.ceil(row["row_count"] / 5))
    if not (whole and sized) or (label and (row["classes_without_train"] or row["classes_without_test"])):
        raise TableError("SPLIT", "The split lost or repeated rows or classes.", "Use a unique row id.")
    return row
