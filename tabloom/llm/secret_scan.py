"""Secret scans over an incremental ledger of blobs.

A blob is a text under its SHA-256, whatever paths and versions hold it. The ledger is a table
of (blob, rule_version, spans), one row for every blob scanned under a rule version, also those
without findings. `scan` looks only at (blob, rule version) pairs the ledger lacks, one
text for each, and `findings` joins the ledger back to all paths. New rules get a new version
and so new scans; known blobs at known versions are never read again.

A span is kind:start:end in code points, end exclusive. Null and empty texts are one blob
without findings. Paths may repeat or be null.
"""

import re

import pandas as pd
from pyspark.sql import functions as F

from tabloom.llm.common import kept, slices, stored

RULE_VERSION = "1"
#: Texts with findings that may be sent to all tasks; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
# The three kinds every scan reports, with the shortest match that counts.
BASE_RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
#: Added kinds: private key blocks, hosting tokens, chat tokens, payment keys, signed web
#: tokens, and passwords in addresses.
MORE_RULES = (
    ("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"), 0, 1),
    ("code_host", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{30,}|\bglpat-[A-Za-z0-9_-]{20,}"), 0, 1),
    ("chat", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"), 0, 1),
    ("payment", re.compile(r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"), 0, 1),
    ("web_token", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 1),
    ("address", re.compile(r"://[^\s/:@]{1,64}:[^\s/:@]{4,128}@"), 0, 1),
)
RULES = BASE_RULES + MORE_RULES
KINDS = [rule[0] for rule in RULES]
BASE_KINDS = [rule[0] for rule in BASE_RULES]


#: What a text must hold for a rule to match at all; rules without one always run.
NEEDLES = {"access": "AKIA", "private_key": "-----BEGIN", "chat": "xox", "web_token": "eyJ", "payment": "k_", "address": "://"}


def spans_of(text):
    """(start, kind number, end) of every match, in order."""
    found = []
    for k, (kind, pattern, group, shortest) in enumerate(RULES):
        if NEEDLES.get(kind, "") not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= shortest:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def written(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def blobs(paths, path="doc_id", text="text"):
    """path, blob and text of every row; the text is the whole version."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return paths.select(F.col(path).alias("path"), F.sha2(whole, 256).alias("blob"), whole.alias("text"))


def scan(versions, ledger=None, rule_version=RULE_VERSION):
    """Ledger rows of the blobs not yet scanned under this rule version.

    Only the ids of the blobs are grouped; texts meet the chosen path by path and blob, so
    that a blob with very many paths never gathers its copies.
    """
    place = F.coalesce(F.col("path").cast("string"), F.lit("")).alias("place")
    unseen = versions.select("blob", place).groupBy("blob").agg(F.min("place").alias("place"))
    if ledger is not None:
        unseen = unseen.join(ledger.filter(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")

    def look(batches):
        import pyarrow as pa

        kept("secret_scan")
        for batch in slices(batches):
            spans = [written(spans_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(spans, pa.string())], ["blob", "spans"])

    texts = versions.select("blob", place, "text").join(unseen, ["blob", "place"]).select("blob", "text")
    found = texts.mapInArrow(look, "blob string, spans string").dropDuplicates(["blob"])  # rows may repeat whole
    return found.select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def findings(versions, ledger, rule_version=RULE_VERSION):
    """path and spans of every path whose blob is in the ledger."""
    known = ledger.filter(F.col("rule_version") == rule_version).select("blob", "spans")
    return versions.select("path", "blob").join(known, "blob").select("path", "spans")


def updated(versions, ledger=None, rule_version=RULE_VERSION):
    """The ledger with the rows of all blobs it lacked."""
    new = stored(scan(versions, ledger, rule_version), "ledger")
    return new if ledger is None else ledger.unionByName(new)


def digest(spans):
    """Lowercase hex SHA-256 of the base spans of a span list."""
    parts = F.filter(F.split(spans, ","), lambda s: F.substring_index(s, ":", 1).isin(BASE_KINDS))
    return F.sha2(F.array_join(parts, ","), 256)


def count_of(spans, kind):
    return F.size(F.filter(F.split(spans, ","), lambda s: F.substring_index(s, ":", 1) == kind)).cast("long")


def secret_report(documents):
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    versions = blobs(documents)
    return findings(versions, updated(versions)).select(
        F.col("path").cast("long").alias("doc_id"),
        *[count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        digest(F.col("spans")).alias("base_sha256"), "spans",
    )


def masked(text, spans, mask="[secret]"):
    """The text with every span, overlapping ones as one, replaced by the mask."""
    out, at = [], 0
    for start, end in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(","))):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(documents, ledger=None, broadcast_rows=BROADCAST_ROWS):
    """The documents with their secrets masked; n_chars, if there, follows the text.

    Texts with findings are looked up by blob. Up to `broadcast_rows` of them are sent to all
    tasks, else both sides are dealt by blob; the rows are the same. Texts without findings stay
    where they are: only the others go to Python.
    """
    versions = blobs(documents)
    hits = updated(versions, ledger).filter("spans != ''").select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    few = hits.limit(broadcast_rows + 1).count() <= broadcast_rows
    whole = documents.withColumn("__blob", F.sha2("text", 256))
    joined = whole.join(F.broadcast(hits) if few else hits, "__blob", "left")

    @F.pandas_udf("string")
    def mask(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)

    found = F.when(F.col("__spans").isNotNull(), F.col("text"))
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(mask(found, "__spans"))
    done = joined.withColumn("text", text)
    if "n_chars" in documents.columns:
        counted = F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
        done = done.withColumn("n_chars", counted)
    return done.drop("__blob", "__spans")
