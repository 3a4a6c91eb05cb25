"""Imputation, scaling and capped one-hot encoding, learned from training rows only."""

from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tabloom.contracts import ColumnType
from tabloom.errors import TableError
from tabloom.functions.interpret import marked
from tabloom.functions.names import col
from tabloom.operators.selection import exact_medians
from tabloom.sources.scratch import scratch_directory

# The widest encoding of one category column and of a whole table.
MAX_CATEGORIES = 32
MAX_FEATURES = 512

# Vocabularies up to this many values are compared as literals, larger ones are joined.
LITERAL_VOCABULARY = 1_000


@dataclass(frozen=True)
class NumberState:
    name: str
    median: float
    mean: float
    deviation: float
    all_missing: bool = False
    label: str | None = None

    @property
    def shown(self):
        return self.label or self.name


@dataclass(frozen=True)
class CategoryState:
    """`kept` values have a column each; with `shared`, all other known values have one."""

    name: str
    kept: tuple[str, ...]
    shared: bool
    size: int
    label: str | None = None

    @property
    def shown(self):
        return self.label or self.name

    @property
    def width(self):
        return len(self.kept) + self.shared


@dataclass(frozen=True)
class Preprocessor:
    numbers: tuple[NumberState, ...]
    categories: tuple[CategoryState, ...]
    scale: bool
    vocabulary: DataFrame | None = field(default=None, compare=False)

    @property
    def width(self):
        return len(self.numbers) + sum(c.width for c in self.categories)

    @property
    def feature_names(self):
        names = [n.shown for n in self.numbers]
        for c in self.categories:
            names += [f"{c.shown}={v}" for v in c.kept]
            names += [f"{c.shown}=*"] if c.shared else []
        return names

    @property
    def notes(self):
        return tuple(f"TRAIN_ALL_MISSING:{n.shown}" for n in self.numbers if n.all_missing)


def feature_limit(types):
    """Most columns the encoding of these fields can have; fail when over the limit."""
    widest = sum(1 if t == ColumnType.NUMBER else MAX_CATEGORIES for t in types.values())
    if not 1 <= widest <= MAX_FEATURES:
        raise TableError("MATRIX_LIMIT", "The encoded inputs exceed 512 columns.", "Choose fewer inputs.")
    return widest


def impute_medians(train, names):
    """Exact training medians; a column without any value imputes zero."""
    medians = exact_medians(train, names)
    return {n: (0.0 if m is None else float(m)) for n, m in medians.items()}, [n for n, m in medians.items() if m is None]


def scaling(train, medians):
    """Mean and population deviation after imputation, all columns in one pass."""
    if not medians:
        return {}
    values = [F.coalesce(col(n), F.lit(m)) for n, m in medians.items()]
    row = train.agg(
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)],
        *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(values)],
    ).first()
    return {n: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, n in enumerate(medians)}


def category_counts(train, names):
    """Training rows per category field and marked value, all fields in one shuffle."""
    wide = train.select(*[marked(col(n)).alias(f"c{i}") for i, n in enumerate(names)])
    if len(names) == 1:
        long = wide.select(F.lit(0).alias("field"), F.col("c0").alias("value"))
    else:
        long = wide.unpivot([], [f"c{i}" for i in range(len(names))], "field", "value").withColumn(
            "field", F.substring("field", 2, 10).cast("int")
        )
    return long.groupBy("field", "value").agg(F.count("*").alias("n"))


def frequent_categories(counts, limit=MAX_CATEGORIES):
    """The most frequent values per field, and how many there are in all.

    Of equally frequent values the lexically last are kept. Each task ranks its own
    values and sends on at most `limit` per field.
    """
    order = Window.partitionBy("field").orderBy(F.desc("n"), F.desc("value"))
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return top.join(counts.groupBy("field").agg(F.count("*").alias("size")), "field")


def fit_preprocessor(train, types, scale, labels=None):
    """Learn from the typed training rows `train`; `types` gives the fields in order, `labels` the names users know them by.

    The vocabulary is written once, so that scoring never counts training rows again.
    """
    labels = {n: n for n in types} | (labels or {})
    feature_limit(types)
    numbers = [n for n, t in types.items() if t == ColumnType.NUMBER]
    names = [n for n, t in types.items() if t in (ColumnType.CATEGORY, ColumnType.BOOLEAN)]
    if len(numbers) + len(names) != len(types):
        raise TableError("INPUT_SCHEMA", "Inputs must be Number, Category or Boolean.", "Choose other inputs.")
    medians, empty = impute_medians(train, numbers)
    scales = scaling(train, medians)
    number_states = tuple(NumberState(n, medians[n], *scales[n], n in empty, labels[n]) for n in numbers)
    if not names:
        return Preprocessor(number_states, (), scale)
    path = scratch_directory(train.sparkSession, "vocabulary")
    category_counts(train, names).write.parquet(path)
    counts = train.sparkSession.read.parquet(path)
    tops = {i: [] for i in range(len(names))}
    sizes = {}
    for r in frequent_categories(counts).collect():
        tops[r["field"]].append((r["rank"], r["value"]))
        sizes[r["field"]] = r["size"]
    states = []
    for i, name in enumerate(names):
        values = [v for _, v in sorted(tops[i])]
        shared = sizes.get(i, 0) > MAX_CATEGORIES
        kept = values[: MAX_CATEGORIES - 1] if shared else values
        states.append(CategoryState(name, tuple(sorted(kept)), shared, sizes.get(i, 0), labels[name]))
    by_name = F.array(*[F.lit(labels[n]) for n in names])
    vocabulary = counts.select(F.element_at(by_name, F.col("field") + 1).alias("field"), "value")
    return Preprocessor(number_states, tuple(states), scale, vocabulary)


def known_flag(name):
    return f"__known_{name}"


def with_known_flags(df, prep):
    """Mark per category field whether the value occurred in training."""
    for state in prep.categories:
        value = marked(col(state.name))
        if not state.shared:
            df = df.withColumn(known_flag(state.name), value.isin(*state.kept) if state.kept else F.lit(False))
            continue
        words = prep.vocabulary.where(F.col("field") == state.shown).select(F.col("value").alias("__value"))
        if state.size <= LITERAL_VOCABULARY:
            literals = [r[0] for r in words.collect()]
            df = df.withColumn(known_flag(state.name), value.isin(*literals))
        else:
            # Distinct training values on one side, so a row matches at most once; a hot
            # value in the data is split by adaptive skew handling.
            words = words.withColumn(known_flag(state.name), F.lit(True))
            df = df.join(words, value == F.col("__value"), "left").drop("__value")
            df = df.withColumn(known_flag(state.name), F.coalesce(col(known_flag(state.name)), F.lit(False)))
    return df


def number_column(state, scale):
    filled = F.coalesce(col(state.name), F.lit(state.median))
    return (filled - F.lit(state.mean)) / F.lit(state.deviation) if scale else filled


def category_slot(state):
    """Position of a row's value in its block of columns; null for unknown values."""
    value = marked(col(state.name))
    slot = F.when(F.lit(False), F.lit(0))
    for i, v in enumerate(state.kept):
        slot = slot.when(value == v, F.lit(i))
    if state.shared:
        slot = slot.when(col(known_flag(state.name)), F.lit(len(state.kept)))
    return slot


def encode(df, prep, output="features", as_vector=True):
    """Append the encoded inputs as one vector (or array) column."""
    if any(known_flag(c.name) not in df.columns for c in prep.categories if c.shared):
        df = with_known_flags(df, prep)
    slots = {f"__slot_{i}": category_slot(c) for i, c in enumerate(prep.categories)}
    df = df.withColumns(slots) if slots else df
    cells = [number_column(n, prep.scale) for n in prep.numbers]
    for i, state in enumerate(prep.categories):
        slot = F.coalesce(F.col(f"__slot_{i}"), F.lit(-1))
        cells += [F.when(slot == j, 1.0).otherwise(0.0) for j in range(state.width)]
    values = F.array(*cells)
    df = df.withColumn(output, array_to_vector(values) if as_vector else values)
    return df.drop(*slots, *[known_flag(c.name) for c in prep.categories])


def feature_ranges(encoded, features="features"):
    """Row count, minimum and maximum per encoded column, in one pass over the vectors."""
    summary = Summarizer.metrics("count", "min", "max").summary(F.col(features))
    return encoded.select(summary.alias("s")).select("s.count", "s.min", "s.max")


def finite_gate(encoded, features="features"):
    row = encoded.select(
        F.bool_and(F.forall(features, lambda x: F.abs(x) < float("inf"))).alias("finite")
    ).first()
    if not row["finite"]:
        raise TableError("NUMERICAL", "Encoding gave values that are not finite.", "Review the magnitudes.")


def varying_gate(encoded, features="features"):
    row = feature_ranges(encoded, features).first()
    if not any(high > low for low, high in zip(row["min"].toArray(), row["max"].toArray())):
        raise TableError("CONSTANT_TRAIN", "No input varies over the training rows.", "Choose other inputs.")


def distinct_at_least(df, columns, k):
    """Whether there are at least k different rows. A look at the first rows often settles it."""
    picked = df.select(*columns)
    if picked.limit(1_000).distinct().count() >= k:
        return True
    return picked.distinct().limit(k).count() >= k


def distinct_gate(encoded, k, features="features"):
    if not distinct_at_least(encoded, [features], k):
        raise TableError("DISTINCT_ROWS", "There are fewer different rows than groups.", "Choose fewer groups.")
