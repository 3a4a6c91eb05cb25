import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.contracts import ColumnType
from tabloom.errors import TableError
from tabloom.operators import preprocess, selection, split
from tabloom.operators.rows import row_hash, with_file_order
from tabloom.operators.selection import exact_medians, hash_cutoffs, smallest_rows, within_cutoff


def md5(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def test_shuffled_sizes_and_repeatability(spark):
    rows = spark.range(41).withColumnRenamed("id", "row_id")
    first = split.shuffled_holdout(rows, "row_id")
    row = split.require_valid_split(first, "row_id")
    assert (row["train_rows"], row["test_rows"]) == (32, 9)
    again = split.shuffled_holdout(rows.repartition(7), "row_id")
    assert sorted(first.collect()) == sorted(again.collect())
    want = set(sorted(range(41), key=md5)[:9])
    assert {r["row_id"] for r in first.where("split = 'test'").collect()} == want
    assert split.all_rows(rows).where("split = 'train'").count() == 41


def test_stratified_quotas(spark):
    assert split.stratified_quotas({"a": 10, "b": 10, "c": 5}) == {"a": 2, "b": 2, "c": 1}
    assert split.stratified_quotas({"a": 7, "b": 7, "c": 7}) == {"a": 2, "b": 2, "c": 1}
    rows = spark.range(60).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "no").otherwise("yes").alias("y"))
    sides = split.stratified_holdout(rows, "row_id", "y")
    assert split.require_valid_split(sides, "row_id", "y")["test_rows"] == 12
    with pytest.raises(TableError):
        split.stratified_holdout(rows.withColumn("y", F.col("row_id").cast("string")), "row_id", "y")
    with pytest.raises(TableError):
        split.require_valid_split(sides.unionByName(sides.where("split = 'test'")), "row_id", "y")


@pytest.mark.parametrize("small", [2, 50])
def test_hash_cutoffs_against_brute_force(spark, small):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("g"))
    quotas = {"hot": 333, "cold": 1}
    limits = hash_cutoffs(rows, row_hash(F.col("id")), quotas, F.col("g"), small)
    picked = rows.where(within_cutoff(row_hash(F.col("id")), limits, F.col("g"))).collect()
    for g, q in quotas.items():
        ids = [i for i in range(3000) if ("hot" if i % 10 < 7 else "cold") == g]
        assert {r["id"] for r in picked if r["g"] == g} == set(sorted(ids, key=md5)[:q])
    assert smallest_rows(rows, row_hash(F.col("id")), 10_000).count() == 3000


@pytest.mark.parametrize("small, accuracy", [(0, 4096), (7, 32), (0, 8)])
def test_exact_medians_in_the_order_of_doubles(spark, small, accuracy):
    rng = random.Random(1)
    columns = {
        "normal": [rng.gauss(0, 1) for _ in range(501)], "zeros": [-0.0, 0.0] * 100 + [1.0], "not.a number": [math.nan] * 90 + [1.0] * 50, "same": [5.0] * 400,
        "wide": [1e300, -1e300, 1e-310, -1e-310, 0.0, math.inf, -math.inf] * 30, "apart": [-2.5, -2.5, 7.0, 7.0] * 50, "empty": [],
    }
    rows = [tuple(v[k] if k < len(v) else None for v in columns.values()) for k in range(501)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in columns)).repartition(3)
    want = df.agg(*[F.median(f"`{n}`") for n in columns]).first()
    assert repr(list(exact_medians(df, list(columns), small, accuracy).values())) == repr(list(want))
    assert [selection.unordered(k) for k in selection.ordered(np.array([-math.inf, -1.5, -0.0, 0.0, 3.0]))] == [-math.inf, -1.5, 0.0, 0.0, 3.0]


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_medians_of_large_and_skewed_columns(spark, accuracy):
    rnd = random.Random(7)
    data = []
    for i in range(4000):
        data.append((
            rnd.gauss(0, 1), float(i % 2), 5.0 if i % 3 else rnd.random() * 100, 1e300 * rnd.random() if i % 2 else -rnd.random(),
            rnd.random() if i % 5 else None, None,
        ))
    names = ["normal", "two", "hot", "wide", "gaps", "none"]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names))
    got = exact_medians(df, names, small=10, accuracy=accuracy)
    for k, name in enumerate(names):
        values = [r[k] for r in data if r[k] is not None]
        assert got[name] == (statistics.median(values) if values else None), name


def test_file_order_numbers_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(path)
    numbered = with_file_order(spark.read.parquet(path))
    assert [tuple(r) for r in numbered.select("row_id", "id").orderBy("row_id").collect()] == [(i, i) for i in range(1000)]


def test_nothing_is_learned_from_test_rows(spark):
    """Changing only test rows leaves the fitted state as it is."""
    rows = spark.range(60).select(
        F.col("id").alias("row_id"), (F.col("id") % 13).cast("double").alias("x"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"),
    )
    sides = split.shuffled_holdout(rows, "row_id")
    test = F.col("split") == "test"
    wild = sides.withColumn("x", F.when(test, 1e9).otherwise(F.col("x"))).withColumn("c", F.when(test, "new").otherwise(F.col("c")))
    types = {"x": ColumnType.NUMBER, "c": ColumnType.CATEGORY}
    plain = preprocess.fit_preprocessor(sides.where(~test), types, True)
    changed = preprocess.fit_preprocessor(wild.where(~test), types, True)
    assert plain == changed and "v:new" not in changed.categories[0].kept
    encoded = preprocess.encode(wild.where(test), changed, as_vector=False).select("features").collect()
    assert all(r["features"][1:] == [0.0, 0.0] for r in encoded)


def test_missing_training_column_and_gates(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (2.0, None, 3.0), (None, None, 3.0)], "a double, b double, c double")
    prep = preprocess.fit_preprocessor(df, {n: ColumnType.NUMBER for n in "abc"}, True)
    assert [n.median for n in prep.numbers] == [1.5, 0.0, 3.0] and prep.notes == ("TRAIN_ALL_MISSING:b",)
    preprocess.varying_gate(preprocess.encode(df, prep))
    flat = preprocess.fit_preprocessor(df, {"b": ColumnType.NUMBER, "c": ColumnType.NUMBER}, True)
    with pytest.raises(TableError) as caught:
        preprocess.varying_gate(preprocess.encode(df, flat))
    assert caught.value.code == "CONSTANT_TRAIN"
    encoded = preprocess.encode(df, prep)
    preprocess.distinct_gate(encoded, 3)
    with pytest.raises(TableError) as caught:
        preprocess.distinct_gate(encoded, 4)
    assert caught.value.code == "DISTINCT_ROWS"
    with pytest.raises(TableError) as caught:
        preprocess.finite_gate(spark.createDataFrame([([1.0, float("inf")],)], "features array<double>"))
    assert caught.value.code == "NUMERICAL"
    with pytest.raises(TableError):
        preprocess.feature_limit({f"c{i}": ColumnType.CATEGORY for i in range(17)})


def test_rare_categories_share_a_column(spark, monkeypatch):
    # Value k occurs k // 2 + 1 times, so neighbours tie; 40 values and the missing one.
    rows = [(f"v{k:02d}",) for k in range(40) for _ in range(k // 2 + 1)] + [(None,)]
    df = spark.createDataFrame(rows, "c string")
    prep = preprocess.fit_preprocessor(df, {"c": ColumnType.CATEGORY}, False)
    state = prep.categories[0]
    assert state.kept == tuple(f"v:v{k:02d}" for k in range(9, 40)) and state.shared and state.width == 32
    probe = spark.createDataFrame([("v39",), ("v00",), (None,), ("unseen",)], "c string")
    for limit in (1_000, 5):  # known values as literals, then through a join
        monkeypatch.setattr(preprocess, "LITERAL_VOCABULARY", limit)
        found = {r["c"]: r["features"] for r in preprocess.encode(probe, prep, as_vector=False).collect()}
        assert found["v39"].index(1.0) == 30 and sum(found["v39"]) == 1
        assert found["v00"][31] == found[None][31] == 1.0
        assert sum(found["unseen"]) == 0
