"""Reading flat JSON objects, one per line, keeping the text of every number.

All work stays in built-in expressions. A record is parsed once as a whole, which finds faults of form and repeated keys,
and once into a variant per column, whose types are the kinds. A variant keeps numbers as values, so the text of one with
a fraction, an exponent or over 64 bits is taken from the line itself.

Faults have the codes ENCODING (bytes that are no UTF-8), JSON_STRUCTURE (no flat object with unique keys and finite
scalars, or a lone surrogate, which no text can hold) and JSON_KEYS (other keys than the first record).
"""

import re

from pyspark.sql import functions as F

from tabloom.errors import TableError
from tabloom.functions.names import by_place, quoted
from tabloom.sources import audits

ERROR = "__error"
MESSAGES = {
    "ENCODING": ("The text is not UTF-8.", "Save it as UTF-8."),
    "JSON_STRUCTURE": ("Some records are not flat JSON objects of finite values.", "Fix or quarantine them."),
    "JSON_KEYS": ("Some records have other keys.", "Fix or quarantine them."),
}


def _records(lines):
    """Lines without a byte order mark that are not blank, and whether their bytes are valid."""
    text = F.when(F.startswith("value", F.lit(audits.BOM)), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    return lines.withColumns({"valid": F.is_valid_utf8("value"), "value": text}).where(F.trim(F.translate("value", "\t\r\n\x0b\x0c", "     ")) != "")


def keys(spark, path):
    """Column names in the order of the first object."""
    first = _records(spark.read.text(path)).select(F.json_object_keys("value").alias("names")).first()
    if first is None:
        raise TableError("NO_DATA", "The file has no records.", "Choose a file with data.")
    names = first["names"]
    if names is None:
        raise TableError("JSON_STRUCTURE", "The first record is no flat object.", "Fix the record.", row=1)
    if len(set(names)) != len(names):
        raise TableError("JSON_STRUCTURE", "The first record repeats a key.", "Fix the record.", row=1)
    audits.require_headers(names)
    return names


def _whole(value):
    """Whether a text is one JSON object with unique keys and nothing after it."""
    parsed = F.try_parse_json(F.concat(F.lit("["), value, F.lit("]")))
    one = F.schema_of_variant(parsed).startswith("ARRAY<OBJECT<") & F.try_variant_get(parsed, "$[1]", "variant").isNull()
    # a parser stops where the outer bracket closes, so one that the text itself closes needs another look
    closed = ~F.contains(value, F.lit("]")) | F.try_parse_json(F.concat(F.lit('{"_":'), value, F.lit("}"))).isNotNull()
    return F.coalesce(one & closed, F.lit(False))


def _lone_surrogate(value):
    """Whether an escape names half a surrogate pair. Escaped backslashes and whole pairs are put aside first."""
    rest = F.regexp_replace(value, r"\\\\|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}", " ")
    return F.contains(F.lower(value), F.lit("\\ud")) & F.regexp_like(rest, F.lit(r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}"))


#: A JSON string; its escapes are the only thing the expression goes through one by one.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _number_text(key, position):
    """The text of the number under a key of a flat object, from the line."""
    found = F.lit("")
    if re.match(r"\w", key):  # no string can end right before or begin right after such a key
        found = F.regexp_extract("value", rf'"{_literal(key)}"\s*:\s*(-?[0-9][0-9.eE+-]*)', 1)
    before = rf'\s*{STRING}\s*:\s*(?:{STRING}|[^",\s]+)\s*,'  # a key and its value
    pattern = F.concat(F.lit(rf"^\s*\{{(?:{before}){{"), (position - 1).cast("string"), F.lit(rf"}}\s*{STRING}\s*:\s*([^,\s}}]+)"))
    return F.coalesce(F.nullif(found, F.lit("")), F.call_function("regexp_extract", F.col("value"), pattern, F.lit(1)))


def _literal(key):
    return "".join(c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):x}}}" for c in key)


def _judged(lines, names):
    """Records with a variant `v.c0`, `v.c1`, ... and its type `t0`, `t1`, ... per column, and what is wrong with them."""
    others = [c for c in lines.columns if c not in ("value", "valid")]
    fields, schema = ", ".join(f"{quoted(n)} variant" for n in names), ", ".join(f"c{i}: variant" for i in range(len(names)))
    cells = F.from_json("value", fields).cast(f"struct<{schema}>")
    parsed = lines.select("value", "valid", *others, _whole(F.col("value")).alias("whole"), F.json_object_keys("value").alias("order"), cells.alias("v"))
    typed = parsed.select("*", *[F.schema_of_variant(F.col(f"v.c{i}")).alias(f"t{i}") for i in range(len(names))])
    nested = infinite = F.lit(False)
    for i in range(len(names)):
        kind = F.col(f"t{i}")
        nested = nested | F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False))
        size = F.abs(F.try_variant_get(f"v.c{i}", "$", "double"))
        infinite = infinite | F.when(kind == "DOUBLE", size == float("inf")).otherwise(False)
    wanted = F.array_sort(F.array(*[F.lit(n) for n in names]))
    return typed.withColumns({
        "broken": ~F.col("whole") | infinite | _lone_surrogate(F.col("value")),
        "other_keys": ~F.array_sort("order").eqNullSafe(wanted), "nested": nested,
    })


def _table(lines, names, kinds):
    """Cells of the records, and the code of each one's fault: its cells are null then. Other columns of the lines stay."""
    others = [c for c in lines.columns if c not in ("value", "valid")]
    error = (
        F.when(~F.col("valid"), "ENCODING").when(F.col("broken"), "JSON_STRUCTURE").when(F.col("other_keys"), "JSON_KEYS")
        .when(F.col("nested"), "JSON_STRUCTURE")
    )
    # A filter on the code would be moved below the parsing, where each use of a cell parses the line again; it stays above
    # a column that Spark takes for indeterminate. Row numbers are never negative.
    error = F.when(F.monotonically_increasing_id() >= 0, error)
    cells = []
    for i, n in enumerate(names):
        kind, text = F.col(f"t{i}"), F.try_variant_get(f"v.c{i}", "$", "string")
        number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
        changed = number & ((kind != "BIGINT") | (text == "0"))  # -0 is no other whole number's text
        raw = F.when(changed, _number_text(n, F.array_position("order", F.lit(n)))).otherwise(text)
        name = F.when(kind == "STRING", "text").when(kind == "BOOLEAN", "boolean").when(number, "number").otherwise("null")
        cell = F.struct(raw.alias("raw"), name.alias("kind")) if kinds else raw
        cells.append(F.when(F.col(ERROR).isNull(), cell).alias(n))
    return _judged(lines, names).withColumn(ERROR, error).select(*cells, F.col(ERROR), *others)


def json_structure(spark, path, keys):
    """One row of counts: records, those that are no flat object of finite values or repeat a key, with other keys, with nested values."""
    judged = _judged(_records(spark.read.text(path)), keys)
    broken = ~F.col("valid") | F.col("broken")
    return judged.agg(
        F.count("*").alias("records"), F.count_if(broken).alias("not_objects"), F.count_if(~broken & F.col("other_keys")).alias("other_keys"),
        F.count_if(~broken & ~F.col("other_keys") & F.col("nested")).alias("nested"),
    )


def json_faults(spark, path, names=None):
    """One row per faulty record: file, line (from 1, in its file) and code. Only blocks of files are counted for the lines."""
    names = keys(spark, path) if names is None else names
    lines = audits.lines(spark, path)
    found = _table(_records(lines), names, False).where(F.col(ERROR).isNotNull()).select("file", "block", "place", F.col(ERROR).alias("code"))
    return audits.with_line(lines, found)


def read_jsonl(spark, path, kinds=True, malformed="fail"):
    """A table of texts. With `kinds`, each column is a struct of `raw` and `kind` (text, number, boolean or null).

    `malformed` says what becomes of faulty records: `fail` looks for them first, in a pass of its own, and names the line
    of the first; `raise` reads once and fails when a task meets one; `quarantine` keeps them, with null cells and their
    code in the column `__error`.
    """
    if malformed not in ("fail", "raise", "quarantine"):
        raise ValueError("malformed is fail, raise or quarantine")
    names = keys(spark, path)
    table = _table(_records(spark.read.text(path)), names, kinds)
    if malformed == "quarantine":
        return table
    if malformed == "raise":
        stop = F.when(F.col(ERROR).isNotNull(), F.raise_error(F.concat(F.col(ERROR), F.lit(": a record cannot be read"))))
        checked = table.where(F.coalesce(stop.cast("boolean"), F.lit(True)))
        return checked.drop(ERROR)
    fault = table.where(F.col(ERROR).isNotNull()).select(ERROR).limit(1).collect()
    if fault:
        fault = json_faults(spark, path, names).orderBy("file", "line").first()
        raise TableError(fault["code"], *MESSAGES[fault["code"]], row=fault["line"])
    return table.drop(ERROR)


def lexical(df):
    """Drop the kinds: every column as plain text."""
    placed, place = by_place(df)
    return placed.select(*[
        (F.col(c).getField("raw") if placed.schema[c].dataType.typeName() == "struct" else F.col(c)).alias(n) for n, c in place.items()
    ])


def write_jsonl(df, path):
    """One JSON object per row with all cells present, nulls included."""
    placed, place = by_place(df)
    placed.select(F.to_json(F.struct(*[F.col(c).alias(n) for n, c in place.items()]), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
