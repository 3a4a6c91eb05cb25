"""Scoring new rows: input checks, warnings per row, prediction.

Everything is a projection over the input, so the same plan scores batches of any size
and streams.
"""

from collections import Counter
from dataclasses import dataclass, field, replace

from pyspark.sql import functions as F

from tabloom.contracts import ColumnType, Task
from tabloom.errors import TableError
from tabloom.functions.interpret import number_error, to_number
from tabloom.functions.names import col
from tabloom.operators.models import FittedModel, model_spec
from tabloom.operators.preprocess import Preprocessor, encode, known_flag, with_known_flags

# Warning codes with the text shown for them.
WARNINGS = {
    "MISSING_IMPUTED": "The value is missing; the fitted default is used.",
    "OUTSIDE_TRAINING_RANGE": "The value lies outside the range seen in training.",
    "UNKNOWN_CATEGORY": "The category did not occur in training.",
}
NUMERIC = ("double", "float", "integer", "long", "short", "byte", "decimal")


@dataclass(frozen=True)
class FieldState:
    """What training saw of one input: its range if a Number."""

    name: str
    type: str
    minimum: float | None = None
    maximum: float | None = None
    label: str | None = None

    @property
    def shown(self):
        return self.label or self.name


@dataclass
class Scorer:
    """A fitted candidate: inputs, preprocessing and model, as evaluated."""

    fields: tuple[FieldState, ...]
    preprocessor: Preprocessor
    model: FittedModel
    metadata: dict = field(default_factory=dict)

    @property
    def task(self):
        return model_spec(self.model.id).task

    @property
    def inputs(self):
        return [f.shown for f in self.fields]

    def numbered(self):
        """The same scorer for columns called c0, c1, ..., so that no working column can clash with an input."""
        ids = {f.name: f"c{i}" for i, f in enumerate(self.fields)}

        def named(states):
            return tuple(replace(s, name=ids[s.name], label=s.shown) for s in states)

        prep = replace(self.preprocessor, numbers=named(self.preprocessor.numbers), categories=named(self.preprocessor.categories))
        return Scorer(named(self.fields), prep, self.model, self.metadata)


def fitted_ranges(train, types):
    """Minimum and maximum of every Number field over the training rows, in one pass."""
    numbers = [n for n, t in types.items() if t == ColumnType.NUMBER]
    if not numbers:
        return {}
    row = train.agg(
        *[F.min(col(n)).alias(f"l{i}") for i, n in enumerate(numbers)],
        *[F.max(col(n)).alias(f"h{i}") for i, n in enumerate(numbers)],
    ).first()
    return {n: (row[f"l{i}"], row[f"h{i}"]) for i, n in enumerate(numbers)}


def fitted_fields(train, types, labels=None):
    ranges = fitted_ranges(train, types)
    return tuple(FieldState(n, str(t), *ranges.get(n, (None, None)), (labels or {}).get(n)) for n, t in types.items())


def fitted_schema(fields, preprocessor, spark):
    """Inputs of a fitted candidate as a DataFrame, with the vocabulary of each category.

    One row per field and category value; a Number field has a single row.
    """
    rows = spark.createDataFrame(
        [(i, f.shown, f.type, f.minimum, f.maximum) for i, f in enumerate(fields)],
        "position int, name string, type string, minimum double, maximum double",
    )
    if preprocessor.vocabulary is None:
        return rows.withColumn("category", F.lit(None).cast("string"))
    words = preprocessor.vocabulary.where(F.col("value").startswith("v:")).select(
        F.col("field").alias("name"), F.substring("value", 3, 2**31 - 1).alias("category")
    )
    return rows.join(words, "name", "left").select("position", "name", "type", "minimum", "maximum", "category")


def read_inputs(df, fields):
    """Typed inputs plus `errors`: one entry per value that cannot be used.

    Unlike a stored cell, an empty text is present here: a category of its own, and an
    error for a Number.
    """
    errors, typed = [], {}
    for f in fields:
        value, kind = col(f.name), df.schema[f.name].dataType.typeName()
        present = value.isNotNull()
        if f.type == ColumnType.NUMBER:
            if kind == "string":
                read = to_number(value)
                code = F.when(number_error(value) == "NUMBER_REQUIRED", "NUMBER_REQUIRED").otherwise("NUMBER_RANGE")
                bad = present & read.isNull()
            elif kind in NUMERIC:
                number = value.cast("double")
                large = (F.abs(number) >= float(2**53)) & (number == F.floor(number))
                finite = F.abs(number) < float("inf")
                read = F.when(finite & ~large, number)
                code = F.when(~finite | F.isnan(number), "NUMBER_REQUIRED").otherwise("NUMBER_RANGE")
                bad = present & read.isNull()
            else:
                read, code, bad = F.lit(None).cast("double"), F.lit("NUMBER_REQUIRED"), present
        elif f.type == ColumnType.BOOLEAN:
            if kind == "boolean":
                read, bad = value.cast("string"), F.lit(False)
            elif kind == "string":
                read = F.when(F.lower(value).isin("true", "false"), F.lower(value))
                bad = present & read.isNull()
            else:
                read, bad = F.lit(None).cast("string"), present
            code = F.lit("BOOLEAN_REQUIRED")
        else:
            text = kind == "string"
            read = value if text else F.lit(None).cast("string")
            code, bad = F.lit("CATEGORY_TEXT_REQUIRED"), (F.lit(False) if text else present)
        errors.append(F.when(bad, F.struct(code.alias("code"), F.lit(f.shown).alias("field"))))
        typed[f.name] = read
    return df.withColumn("errors", F.array_compact(F.array(*errors))).withColumns(typed)


def input_warnings(typed, fields, preprocessor):
    """Append `warnings`; `typed` must carry the known flags of its category fields."""
    categories = {c.name for c in preprocessor.categories}
    notes = []
    for f in fields:
        value = col(f.name)
        chain = F.when(value.isNull(), "MISSING_IMPUTED")
        if f.type == ColumnType.NUMBER and f.minimum is not None:
            chain = chain.when((value < f.minimum) | (value > f.maximum), "OUTSIDE_TRAINING_RANGE")
        elif f.name in categories:
            chain = chain.when(~col(known_flag(f.name)), "UNKNOWN_CATEGORY")
        notes.append(F.struct(chain.alias("code"), F.lit(f.shown).alias("field")))
    texts = F.create_map(*[F.lit(x) for pair in WARNINGS.items() for x in pair])
    listed = F.filter(F.array(*notes), lambda n: n["code"].isNotNull())
    return typed.withColumn(
        "warnings",
        F.transform(listed, lambda n: F.struct(n["code"].alias("code"), n["field"].alias("field"), texts[n["code"]].alias("message"))),
    )


def score(scorer, df, keep=(), strict=True):
    """Predictions and warnings for every row of a batch or streaming DataFrame.

    The input has exactly the fitted fields plus the columns in `keep`, which pass through; the first of them names a record
    in errors. Names may be anything, also those of working and output columns, and may differ by case only; a kept column cannot be
    called like an output. With `strict`, one unusable value stops the whole job; otherwise such rows
    come out with `errors` filled and no prediction.
    """
    output = {Task.CLUSTERING: "cluster", Task.REDUCTION: "components"}.get(scorer.task, "prediction")
    added = [output, "warnings"] + ([] if strict else ["errors"])
    if Counter(df.columns) != Counter({*scorer.inputs, *keep}) or {k.lower() for k in keep} & set(added):
        raise TableError("FIELD_NAMES", "Give exactly the fitted input fields.", "Compare with the fitted schema.")
    inner, place = scorer.numbered(), {n: f"s{i}" for i, n in enumerate(df.columns)}
    kept = [f"k{i}" for i in range(len(keep))]
    # By position, since names that differ by case only cannot be told apart otherwise.
    flat = df.toDF(*place.values()).select(
        *[F.col(place[f.shown]).alias(f.name) for f in inner.fields], *[F.col(place[k]).alias(i) for i, k in zip(kept, keep)]
    )
    typed = with_known_flags(read_inputs(flat, inner.fields), inner.preprocessor)
    typed = input_warnings(typed, inner.fields, inner.preprocessor)
    result = inner.model.apply(encode(typed, inner.preprocessor))
    valid = F.size("errors") == 0
    value = F.when(valid, F.col(output))
    if strict:
        first = F.element_at("errors", 1)
        record = F.concat(F.lit("record "), F.coalesce(F.col(kept[0]).cast("string"), F.lit("?")), F.lit(": ")) if kept else F.lit("")
        stop = F.raise_error(F.concat(record, first["code"], F.lit(": "), first["field"]))
        value = value.otherwise(stop.cast(result.schema[output].dataType))
    return result.select(*kept, value.alias(output), *added[1:]).toDF(*keep, *added)


def predict_many(scorer, df, keep=(), strict=True):
    if scorer.task == Task.REDUCTION:
        raise TableError("UNSUPPORTED", "PCA transforms, it does not predict.", "Use transform_many.")
    return score(scorer, df, keep, strict)


def transform_many(scorer, df, keep=(), strict=True):
    if scorer.task != Task.REDUCTION:
        raise TableError("UNSUPPORTED", "Only PCA transforms.", "Use predict_many.")
    return score(scorer, df, keep, strict)


def probe_rows(df, fields, known):
    """Observed inputs, one row with everything missing, one with unseen categories.

    `known` is a DataFrame of (field, value) pairs. The unseen text is longer than every
    known value of its field, so it cannot be one of them. The unseen row copies the
    first observed row by value order and only exists when there are category fields.
    """
    names = [f.shown for f in fields]
    categories = [f.shown for f in fields if f.type == ColumnType.CATEGORY]
    observed = df.select(*[col(n) for n in names], F.lit("observed").alias("probe"))
    spark = df.sparkSession
    missing = spark.range(1).select(
        *[F.lit(None).cast(df.schema[n].dataType).alias(n) for n in names], F.lit("missing").alias("probe")
    )
    probes = observed.unionByName(missing)
    if not categories:
        return probes
    longest = {
        r["field"]: r["longest"]
        for r in known.where(F.col("field").isin(*categories)).groupBy("field").agg(F.max(F.char_length("value")).alias("longest")).collect()
    }
    first = df.select(*[col(n) for n in names]).orderBy(*[col(n) for n in names]).limit(1)
    unseen = first.select(
        *[
            F.rpad(F.lit("unseen"), max(6, (longest.get(n) or 0) + 1), "_").alias(n) if n in categories else col(n)
            for n in names
        ],
        F.lit("unseen").alias("probe"),
    )
    return probes.unionByName(unseen)


RELATIVE_TOLERANCE = 1e-8
ABSOLUTE_TOLERANCE = 1e-10


def prediction_parity(left, right, row_id, value="prediction"):
    """Rows on which two scored tables differ: numbers beyond tolerance, texts at all."""
    a = left.select(col(row_id), F.col(value).alias("a"), *([F.col("warnings").alias("wa")] if "warnings" in left.columns else []), F.lit(True).alias("in_left"))
    b = right.select(col(row_id), F.col(value).alias("b"), *([F.col("warnings").alias("wb")] if "warnings" in right.columns else []), F.lit(True).alias("in_right"))
    joined = a.join(b, row_id, "full")
    numeric = left.schema[value].dataType.typeName() in ("double", "float")
    x, y = F.col("a"), F.col("b")
    if numeric:
        bound = F.greatest(F.lit(RELATIVE_TOLERANCE) * F.greatest(F.abs(x), F.abs(y)), F.lit(ABSOLUTE_TOLERANCE))
        same = F.coalesce((x == y) | (F.abs(x - y) <= bound), x.isNull() & y.isNull())
    else:
        same = x.eqNullSafe(y)
    if "wa" in joined.columns and "wb" in joined.columns:
        same = same & F.col("wa").eqNullSafe(F.col("wb"))
    reason = F.when(F.col("in_left").isNull(), "MISSING_LEFT").when(F.col("in_right").isNull(), "MISSING_RIGHT").when(~same, "DIFFERENT")
    return joined.select(col(row_id), "a", "b", reason.alias("reason")).where(F.col("reason").isNotNull())
