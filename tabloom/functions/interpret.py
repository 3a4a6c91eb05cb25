"""Reading one text cell as a number, boolean, date, label or category.

All functions map Columns to Columns, stay in generated JVM code and never change
the raw text. A value that does not fit gives null.
"""

from pyspark.sql import functions as F

from tabloom.contracts import ColumnType
from tabloom.errors import TableError
from tabloom.functions.names import col

# The number, date and zero-padded grammars, the characters that count as
# surrounding whitespace, the largest exact integer, and the category markers.
NUMBER_GRAMMAR = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
DATE_GRAMMAR = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
LEADING_ZERO_GRAMMAR = r"^[+-]?0[0-9]+\z"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
EXACT_LIMIT = float(2**53)
PRESENT = "v:"
MISSING = "m:"


def is_missing(c):
    return c.isNull() | (c == "")


def stripped(c):
    return F.btrim(c, F.lit(WHITESPACE))


def _integral_text(text):
    """Whether the decimal written in `text` has no fractional part, digit by digit.

    With `scale` digits behind the point after applying the exponent, the value is
    integral exactly when at least that many of its last digits are zero.
    """
    mantissa = F.regexp_extract(text, r"^[+-]?([0-9.]*)", 1)
    fraction = F.regexp_extract(mantissa, r"\.([0-9]*)", 1)
    exponent = F.coalesce(
        F.regexp_extract(text, r"[eE]([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0)
    )
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    zeros = F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))
    return zeros >= F.length(fraction) - exponent


def to_number(c):
    """Finite double, or null. Integers beyond 2^53-1 would lose digits and give null."""
    text = stripped(c)
    value = text.try_cast("double")
    size = F.abs(value)
    return F.when(
        text.rlike(NUMBER_GRAMMAR),
        F.when(size < EXACT_LIMIT, value).when((size < float("inf")) & ~_integral_text(text), value),
    )


def number_error(c):
    """Why a present cell is not a number: the first failing rule, null if it is one."""
    text = stripped(c)
    size = F.abs(text.try_cast("double"))
    return (
        F.when(~text.rlike(NUMBER_GRAMMAR), "NUMBER_REQUIRED")
        .when(size < EXACT_LIMIT, F.lit(None).cast("string"))
        .when(size == float("inf"), "NUMBER_RANGE")
        .when(_integral_text(text), "PRECISION")
    )


def to_boolean(c):
    low = F.lower(c)
    return F.when(low.isin("true", "false"), low == "true")


def to_date(c):
    day = F.when(c.rlike(DATE_GRAMMAR), c.try_cast("date"))
    return F.when(F.year(day) >= 1, day)


def has_leading_zero(c):
    return stripped(c).rlike(LEADING_ZERO_GRAMMAR)


def interpreted(c, kind):
    """Typed view of one text column; missing and unreadable cells are null."""
    present = F.when(~is_missing(c), c)
    if kind == ColumnType.NUMBER:
        return to_number(present)
    if kind == ColumnType.BOOLEAN:
        return to_boolean(present)
    if kind == ColumnType.DATE:
        return to_date(present)
    return present


def raw_of(df, name):
    """Text of a lexical column, whether stored bare or with its source kind."""
    nested = df.schema[name].dataType.typeName() == "struct"
    return col(name).getField("raw") if nested else col(name)


def typed_view(df, types, keep=()):
    """Select the columns in `types`, each as its effective type; `keep` passes through."""
    return df.select(
        *[col(k) for k in keep],
        *[interpreted(raw_of(df, n), t).alias(n) for n, t in types.items()],
    )


def raw_records(df, features, keep=()):
    """Selected raw text with missing cells as null."""
    return df.select(
        *[col(k) for k in keep],
        *[F.when(~is_missing(raw_of(df, n)), raw_of(df, n)).alias(n) for n in features],
    )


def target_labels(value, kind):
    """Class label text of a typed target column.

    Booleans become true/false, integral numbers plain decimal integers. A nonintegral
    number stops the job: such a column has to be made a Category first.
    """
    if kind == ColumnType.NUMBER:
        text = value.cast("bigint").cast("string")
        return F.when(value.isNull(), F.lit(None).cast("string")).when(
            value == F.floor(value), text
        ).otherwise(F.raise_error(F.lit("TARGET: class numbers must be integral")).cast("string"))
    if kind == ColumnType.BOOLEAN:
        return value.cast("string")
    if kind in (ColumnType.CATEGORY, ColumnType.IDENTIFIER):
        return value
    raise TableError("TARGET", "This type has no class labels.", "Override the column type.")


def marked(value):
    """Category text tagged so that a missing value can never equal a present one."""
    return F.coalesce(F.concat(F.lit(PRESENT), value.cast("string")), F.lit(MISSING))
