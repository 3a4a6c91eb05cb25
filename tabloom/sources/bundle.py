"""Saving a fitted candidate and loading it back, checked against its own digests.

A bundle is a directory with the model, the fitted inputs, the vocabularies and one
metadata row. It holds no data rows. All files go through Spark's own writers, so any
shared file system will do.
"""

import hashlib
import json

from pyspark.sql import functions as F

from tabloom.contracts import SEED, ColumnType
from tabloom.errors import TableError
from tabloom.functions.names import col
from tabloom.operators.models import LOADERS, FittedModel, model_spec
from tabloom.operators.preprocess import CategoryState, NumberState, Preprocessor
from tabloom.operators.score import FieldState, Scorer

VERSION = 1


def stored_digest(spark, path):
    """Digest of all rows stored below a directory, whatever their order, files or tasks.

    Each folder of Parquet or text files is read as a table; its rows' digests are added up, so no file is held whole.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    names = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.col("path").endswith(".parquet").alias("parquet"))
    parts = []
    for folder, parquet in sorted(map(tuple, names.distinct().collect())):  # a few folders per bundle
        table = spark.read.parquet(folder) if parquet else spark.read.text(folder)
        number = F.conv(F.substring(F.sha2(F.to_json(F.struct(*map(col, sorted(table.columns)))), 256), 1, 15), 16, 10).cast("decimal(28,0)")
        row = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(number), F.lit(0)).alias("sum")).first()
        parts.append((folder.rsplit("/", 1)[-1], row["n"], str(row["sum"]), sorted(table.columns)))
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def _state(scorer):
    prep = scorer.preprocessor
    return {
        "version": VERSION,
        "fields": [vars(f) for f in scorer.fields],
        "numbers": [vars(n) for n in prep.numbers],
        "categories": [{**vars(c), "kept": list(c.kept)} for c in prep.categories],
        "scale": prep.scale,
        "labels": list(scorer.model.labels),
        "model_state": scorer.model.state,
        "notes": list(scorer.model.notes),
    }


def _parts(scorer):
    parts = ["schema"]
    if scorer.model.ml is not None:
        parts.append("model")
    if scorer.preprocessor.vocabulary is not None:
        parts.append("vocabulary")
    return parts


def save_bundle(spark, scorer, directory, **metadata):
    """Write a bundle; the directory must not exist yet. Returns the metadata."""
    spark.createDataFrame([(json.dumps(_state(scorer), sort_keys=True),)], "state string").coalesce(1).write.parquet(
        f"{directory}/schema"
    )
    if scorer.model.ml is not None:
        scorer.model.ml.write().save(f"{directory}/model")
    if scorer.preprocessor.vocabulary is not None:
        scorer.preprocessor.vocabulary.select("field", "value").write.parquet(f"{directory}/vocabulary")
    spec = model_spec(scorer.model.id)
    meta = {
        "version": VERSION,
        "model": scorer.model.id,
        "task": spec.task.value,
        "seed": SEED,
        "notes": list(scorer.preprocessor.notes) + list(scorer.model.notes),
        **metadata,
        "digests": {part: stored_digest(spark, f"{directory}/{part}") for part in _parts(scorer)},
    }
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "metadata string").coalesce(1).write.parquet(
        f"{directory}/metadata"
    )
    return meta


def load_bundle(spark, directory):
    """Read a bundle after checking version, model, task and every digest."""
    meta = json.loads(spark.read.parquet(f"{directory}/metadata").first()["metadata"])
    if meta.get("version") != VERSION:
        raise TableError("METADATA_VERSION", "The bundle has another version.", "Fit and save again.")
    try:
        spec = model_spec(meta.get("model"))
    except TableError:
        spec = None
    if spec is None or meta.get("task") != spec.task.value:
        raise TableError("TASK_MISMATCH", "Model and task of the bundle do not agree.", "Fit and save again.")
    for part, digest in meta["digests"].items():
        if stored_digest(spark, f"{directory}/{part}") != digest:
            raise TableError("HASH_MISMATCH", "Files of the bundle changed after saving.", "Fit and save again.")
    state = json.loads(spark.read.parquet(f"{directory}/schema").first()["state"])
    if state.get("version") != VERSION:
        raise TableError("METADATA_VERSION", "The fitted inputs have another version.", "Fit and save again.")
    vocabulary = spark.read.parquet(f"{directory}/vocabulary") if "vocabulary" in meta["digests"] else None
    prep = Preprocessor(
        tuple(NumberState(**n) for n in state["numbers"]),
        tuple(CategoryState(**{**c, "kept": tuple(c["kept"])}) for c in state["categories"]),
        state["scale"],
        vocabulary,
    )
    fields = tuple(FieldState(**{**f, "type": ColumnType(f["type"])}) for f in state["fields"])
    if len(prep.numbers) + len(prep.categories) != len(fields):
        raise TableError("SCHEMA_SHAPE", "Inputs and preprocessing of the bundle do not agree.", "Fit and save again.")
    ml = LOADERS[spec.id].load(f"{directory}/model") if "model" in meta["digests"] else None
    model = FittedModel(spec.id, tuple(state["labels"]), ml, state["model_state"], tuple(state["notes"]))
    return Scorer(fields, prep, model, meta)
