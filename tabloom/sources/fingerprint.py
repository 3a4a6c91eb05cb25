"""Digest of a table's content that does not depend on the order of its rows."""

import hashlib
import json

from pyspark.sql import functions as F

from tabloom.functions.interpret import is_missing, raw_of
from tabloom.functions.names import col

# Fixed value: letter of each source kind inside a row's text.
KIND_LETTERS = {"text": "t", "number": "n", "boolean": "b", "null": "z"}


def _cell(df, name):
    raw = raw_of(df, name)
    kind = F.lit("t")
    if df.schema[name].dataType.typeName() == "struct":
        letters = F.create_map(*[F.lit(x) for pair in KIND_LETTERS.items() for x in pair])
        kind = F.coalesce(letters[col(name).getField("kind")], F.lit("z"))
    present = F.concat(kind, F.char_length(raw).cast("string"), F.lit(":"), raw)
    return F.when(is_missing(raw), F.lit("-")).otherwise(present)


def row_sums(df, columns=None):
    """Row count and sum of the first sixty bits of every row's digest, in one aggregation."""
    names = df.columns if columns is None else columns
    digest = F.md5(F.concat(*[_cell(df, n) for n in names]))
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(28,0)")
    return df.agg(F.count("*").alias("row_count"), F.sum(number).alias("digest_sum"))


def fingerprint(df, columns=None):
    """One row: row count and SHA-256 over headers, count and digest sum."""
    names = df.columns if columns is None else columns
    head = json.dumps(list(names), separators=(",", ":"))
    return row_sums(df, names).select(
        "row_count",
        F.sha2(
            F.concat_ws("|", F.lit(head), F.col("row_count").cast("string"), F.coalesce(F.col("digest_sum"), F.lit(0)).cast("string")),
            256,
        ).alias("fingerprint"),
    )


def effective_fingerprint(content, schema):
    """Digest of content and the way each column is read."""
    payload = [content, [(c.name, str(c.effective), c.overridden) for c in schema.columns]]
    return hashlib.sha256(json.dumps(payload, separators=(",", ":")).encode()).hexdigest()
