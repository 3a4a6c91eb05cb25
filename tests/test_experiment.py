import pytest
from pyspark.sql import functions as F

from tabloom.contracts import ExperimentSpec
from tabloom.errors import TableError
from tabloom.operators import split
from tabloom.operators.models import MODELS, models_for
from tabloom.operators.profile import infer_schema
from tabloom.operators.score import predict_many, prediction_parity, probe_rows, transform_many
from tabloom.plans import experiment
from tabloom.plans.experiment import LABEL, prepare_run, run_experiment
from tabloom.sources.bundle import load_bundle, save_bundle
from tabloom.streaming.scoring import score_stream

FEATURES = ("x", "z", "city", "flag")


@pytest.fixture(scope="module")
def table(spark):
    """Sixty rows; one city is called like the marker of a missing value."""
    i = F.col("row_id")
    return spark.range(60).withColumnRenamed("id", "row_id").select(
        "row_id",
        F.when(i == 7, "").otherwise((i % 13).cast("string")).alias("x"),
        (F.floor(i / 5) + (i % 3) / 10).cast("string").alias("z"),
        F.element_at(F.array(F.lit("north"), F.lit("south"), F.lit("m:")), (i % 3 + 1).cast("int")).alias("city"),
        F.when(i % 2 == 1, "TRUE").otherwise("false").alias("flag"),
        F.when((i % 13) + F.floor(i / 5) > 11, "yes").otherwise("no").alias("outcome"),
        (i * 1.5).cast("string").alias("value"),
    ).persist()


@pytest.fixture(scope="module")
def schema(table):
    return infer_schema(table, "row_id")


@pytest.fixture(scope="module")
def runs(spark, table, schema, tmp_path_factory):
    specs = {
        "classification": ("outcome", FEATURES, None), "regression": ("value", FEATURES, None),
        "clustering": (None, ("x", "z"), 3), "reduction": (None, ("x", "z"), 1),
    }
    results = {}
    for task, (target, features, option) in specs.items():
        spec = ExperimentSpec(task, target, features, tuple(m.id for m in models_for(task)), option, ("DUPLICATE_ROWS",))
        results[task] = run_experiment(table, "row_id", schema, spec, str(tmp_path_factory.mktemp(task)))
    return results


def raw(table, features):
    return table.select("row_id", *[F.when(F.col(f) != "", F.col(f)).alias(f) for f in features])


def test_every_task_completes(runs):
    for task, result in runs.items():
        assert result.status == "completed", [(c.error_code, c.error_message) for c in result.candidates]
        assert len(result.ranking) == len(models_for(task))
    metrics = {c.model: {m.key: m.value for m in c.metrics} for r in runs.values() for c in r.candidates}
    assert metrics["classification.logistic"]["accuracy"] > 0.7
    assert metrics["regression.linear"]["r2"] > 0.9 and metrics["regression.forest"]["r2"] > 0.9
    assert metrics["clustering.kmeans"]["clusters"] == 3 and 0 < metrics["clustering.kmeans"]["silhouette"] < 1
    assert 0.4 < metrics["reduction.pca"]["retained_variance"] < 1
    assert runs["classification"].recommended[1] == "BEST_ON_TEST" and runs["clustering"].recommended is None
    forest = next(c for c in runs["classification"].candidates if c.model == "classification.forest")
    assert sum(r["n"] for r in forest.diagnostics["confusion_matrix"]) == 12


def test_saved_candidates_score_again(spark, table, runs):
    for task, result in runs.items():
        for candidate in result.candidates:
            scorer = load_bundle(spark, candidate.bundle)
            rows = raw(table, scorer.inputs)
            call = transform_many if task == "reduction" else predict_many
            output = {"clustering": "cluster", "reduction": "components"}.get(task, "prediction")
            scored = call(scorer, rows, keep=["row_id"]).persist()
            assert scored.count() == 60 and scored.where(F.col(output).isNull()).count() == 0
            again = call(load_bundle(spark, candidate.bundle), rows.repartition(5), keep=["row_id"])
            assert prediction_parity(scored, again, "row_id", output).count() == 0
            codes = {(w["code"], w["field"]) for r in scored.where("row_id = 7").collect() for w in r["warnings"]}
            assert ("MISSING_IMPUTED", "x") in codes
            with pytest.raises(TableError):
                (predict_many if task == "reduction" else transform_many)(scorer, rows, keep=["row_id"])


def test_input_checks_and_warnings(spark, runs):
    scorer = load_bundle(spark, runs["classification"].candidates[0].bundle)
    rows = spark.createDataFrame(
        [(0, "1", "2", "north", "true"), (1, "1e9", "2", "", "FALSE"), (2, "", "2", "east", "false"),
         (3, "nan", "1e400", None, "yes"), (4, None, "9007199254740993", "v:north", None)],
        "row_id int, x string, z string, city string, flag string",
    )
    got = {r["row_id"]: r for r in predict_many(scorer, rows, keep=["row_id"], strict=False).collect()}
    warned = {k: [(w["code"], w["field"]) for w in r["warnings"]] for k, r in got.items()}
    failed = {k: [(e["code"], e["field"]) for e in r["errors"]] for k, r in got.items()}
    assert warned[0] == [] and warned[1] == [("OUTSIDE_TRAINING_RANGE", "x"), ("UNKNOWN_CATEGORY", "city")]
    assert failed[0] == failed[1] == [] and failed[2] == [("NUMBER_REQUIRED", "x")]
    assert failed[3] == [("NUMBER_REQUIRED", "x"), ("NUMBER_RANGE", "z"), ("BOOLEAN_REQUIRED", "flag")]
    assert failed[4] == [("NUMBER_RANGE", "z")] and ("UNKNOWN_CATEGORY", "city") in warned[4]
    assert got[0]["prediction"] in ("yes", "no") and got[2]["prediction"] is None
    with pytest.raises(Exception, match="record [234]: NUMBER_R"):
        predict_many(scorer, rows, keep=["row_id"]).collect()
    with pytest.raises(TableError) as caught:
        predict_many(scorer, rows)
    assert caught.value.code == "FIELD_NAMES"
    typed = spark.createDataFrame([(True, 2.0, 5, True)], "x boolean, z double, city int, flag boolean")
    errors = predict_many(scorer, typed, strict=False).first()["errors"]
    assert [(e["code"], e["field"]) for e in errors] == [("NUMBER_REQUIRED", "x"), ("CATEGORY_TEXT_REQUIRED", "city")]


def test_probe_rows(spark, table, runs):
    scorer = load_bundle(spark, runs["regression"].candidates[0].bundle)
    known = scorer.preprocessor.vocabulary.withColumn("value", F.substring("value", 3, 1000))
    probes = probe_rows(raw(table, scorer.inputs), scorer.fields, known)
    scored = predict_many(scorer, probes, keep=["probe"]).collect()
    assert len(scored) == 62
    by_probe = {r["probe"]: {w["code"] for w in r["warnings"]} for r in scored}
    assert by_probe["missing"] == {"MISSING_IMPUTED"} and "UNKNOWN_CATEGORY" in by_probe["unseen"]


def test_streams_are_scored_like_batches(spark, table, runs, tmp_path):
    scorer = load_bundle(spark, runs["classification"].candidates[0].bundle)
    rows = raw(table, scorer.inputs)
    path = str(tmp_path / "in")
    rows.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = score_stream(scorer, stream, keep=["row_id"])
    query = out.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    batch = predict_many(scorer, rows, keep=["row_id"])
    assert prediction_parity(spark.table("scored"), batch, "row_id").count() == 0
    assert spark.table("scored").count() == 60


def test_bundles_are_checked(spark, runs, tmp_path):
    source = runs["reduction"].candidates[0].bundle
    scorer = load_bundle(spark, source)
    path = str(tmp_path / "b")
    save_bundle(spark, scorer, path)
    with pytest.raises(Exception):
        save_bundle(spark, scorer, path)
    spark.createDataFrame([("{}",)], "state string").coalesce(1).write.mode("append").parquet(f"{path}/schema")
    with pytest.raises(TableError) as caught:
        load_bundle(spark, path)
    assert caught.value.code == "HASH_MISMATCH"


def test_one_failure_does_not_stop_the_others(table, schema, tmp_path, monkeypatch):
    models = ("regression.linear", "regression.forest")
    spec = ExperimentSpec("regression", "value", ("x", "z"), models, acknowledged=("DUPLICATE_ROWS",))
    whole = experiment.fit_model

    def fails(model_id, *rest):
        if model_id == "regression.linear":
            raise TableError(code, "no")
        return whole(model_id, *rest)

    monkeypatch.setattr(experiment, "fit_model", fails)
    code = "CONVERGENCE"
    result = run_experiment(table, "row_id", schema, spec, str(tmp_path / "a"))
    assert result.status == "partial" and result.ranking == ("regression.forest",)
    assert result.recommended == ("regression.forest", "ONLY_COMPLETED")
    code = "STORAGE"
    result = run_experiment(table, "row_id", schema, spec, str(tmp_path / "b"))
    assert result.status == "failed" and len(result.candidates) == 1


def test_prepared_rows(table, schema):
    spec = ExperimentSpec("classification", "outcome", FEATURES, ("classification.logistic",), fingerprint="other")
    with pytest.raises(TableError) as caught:
        prepare_run(table, "row_id", schema, spec)
    assert caught.value.code == "STALE_DATA"
    spec = ExperimentSpec("classification", "outcome", FEATURES, ("classification.logistic",))
    run = prepare_run(table, "row_id", schema, spec)
    assert run.counts == {"train": 48, "test": 12} and run.labels == ("no", "yes")
    assert set(run.rows.columns) == {experiment.ROW, *run.names, LABEL, "split"} and tuple(run.names.values()) == FEATURES
    assert run.side(split.TEST).count() == 12 and run.policy["widest"] == 66
    assert len(MODELS) == 6


def test_rank_deficient_components(spark, tmp_path):
    df = spark.range(30).select(F.col("id").alias("row_id"), *[(F.col("id") * k).cast("string").alias(f"c{k}") for k in (1, 2, 3)])
    spec = ExperimentSpec("reduction", None, ("c1", "c2", "c3"), ("reduction.pca",), 2)
    result = run_experiment(df, "row_id", infer_schema(df, "row_id"), spec, str(tmp_path / "p"))
    candidate = result.candidates[0]
    assert candidate.notes == ("PCA_RANK_DEFICIENT",)
    assert candidate.diagnostics["per_component"][1]["variance_ratio"] < 1e-10
    assert candidate.diagnostics["reconstruction_mse"] < 1e-20
