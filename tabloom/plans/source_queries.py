"""Reading and auditing text files written from whole given tables, and example formulas."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.operators.rows import with_file_order
from tabloom.plans.catalog import query, table
from tabloom.plans.text_tables import TEXT_ORDERS, TEXT_ORDERS_COLUMNS, text_orders
from tabloom.sources import audits
from tabloom.sources.delimited import CORRUPT, read_delimited, write_delimited
from tabloom.sources.examples import example_columns
from tabloom.sources.jsonl import json_faults, json_structure, lexical, read_jsonl, write_jsonl
from tabloom.sources.scratch import scratch_directory

_BLANK_TO_NULL = ", ".join(f"nullif({c}, '') AS {c}" for c in TEXT_ORDERS_COLUMNS)
_ORDERS_BACK = f"WITH {TEXT_ORDERS} SELECT row_id::varchar AS row_id, {_BLANK_TO_NULL} FROM t"


def _text(spark, directory):
    rows = text_orders(spark, directory)
    return rows.withColumn("row_id", F.col("row_id").cast("string"))


def _blanks_to_null(df):
    return df.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in df.columns])


@query(_ORDERS_BACK)
def csv_roundtrip(spark, directory):
    path = scratch_directory(spark, "csv")
    write_delimited(_text(spark, directory), path)
    return _blanks_to_null(read_delimited(spark, path))


@query(_ORDERS_BACK)
def tsv_roundtrip(spark, directory):
    path = scratch_directory(spark, "tsv")
    write_delimited(_text(spark, directory), path, "\t")
    return _blanks_to_null(read_delimited(spark, path, "\t"))


@query("SELECT doc_id::varchar AS doc_id, text, lang, source FROM documents")
def csv_multiline_roundtrip(spark, directory):
    path = scratch_directory(spark, "documents")
    write_delimited(table(spark, directory, "documents").select(F.col("doc_id").cast("string"), "text", "lang", "source"), path)
    return read_delimited(spark, path)


# Rows with line breaks in cells keep their order, however the files are split over tasks.
@query("""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id::varchar AS doc_id, nullif(text, '') AS text, nullif(lang, '') AS lang,
  nullif(source, '') AS source FROM documents""")
def csv_multiline_split(spark, directory):
    path = scratch_directory(spark, "ordered")
    rows = table(spark, directory, "documents").orderBy("doc_id").select(F.col("doc_id").cast("string"), "text", "lang", "source")
    write_delimited(rows, path)
    read = with_file_order(read_delimited(spark, path, places=True))
    return read.select("row_id", *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("doc_id", "text", "lang", "source")])


# Two lines for every fourth order, quotes in every seventh; a closed cell goes on in some, and the first of them counts.
@query("""WITH r AS (SELECT o_orderkey, sum(CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 1 END) OVER (ORDER BY o_orderkey) AS upto FROM orders)
SELECT (SELECT max(upto) FROM r)::bigint AS lines, min(upto)::bigint AS line, true AS spans FROM r WHERE o_orderkey % 1000 = 502""")
def csv_quoting_audit(spark, directory):
    path = scratch_directory(spark, "quotes")
    k = F.col("o_orderkey")
    key = k.cast("string")
    line = (
        F.when(k % 1000 == 502, F.concat(key, F.lit(',"a"b'))).when(k % 4 == 1, F.concat(key, F.lit(',"a\n""b"')))
        .when(k % 7 == 0, F.concat(F.lit('"'), key, F.lit('","""",'))).otherwise(F.concat(key, F.lit(",a,")))
    )
    table(spark, directory, "orders").orderBy("o_orderkey").select(line.alias("value")).write.text(path)
    report = audits.quoting_report(spark, path)
    before = F.coalesce(F.sum("lines").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per file
    return report.withColumn("line", F.col("line") + before).agg(
        F.sum("lines").alias("lines"), F.min("line").alias("line"), F.bool_or("spans").alias("spans")
    )


# Bytes that are no UTF-8: a lone continuation, an overlong form, half a surrogate and an open sequence.
@query("SELECT count(*) FILTER (o_orderkey % 11 IN (1, 4, 6, 9)) AS bad_lines, count(*) AS lines FROM orders")
def encoding_audit(spark, directory):
    path = scratch_directory(spark, "bytes")
    k = F.col("o_orderkey") % 11
    tail = (
        F.when(k == 1, F.unhex(F.lit("80"))).when(k == 4, F.unhex(F.lit("C0AF"))).when(k == 6, F.unhex(F.lit("EDA080")))
        .when(k == 9, F.unhex(F.lit("E282"))).otherwise(F.unhex(F.lit("E282AC")))
    )
    line = F.concat(F.col("o_orderkey").cast("string").cast("binary"), tail).cast("string")
    table(spark, directory, "orders").select(line.alias("value")).write.text(path)
    return audits.encoding_audit(spark, path)


@query(_ORDERS_BACK)
def jsonl_roundtrip(spark, directory):
    path = scratch_directory(spark, "jsonl")
    write_jsonl(_text(spark, directory), path)
    return _blanks_to_null(lexical(read_jsonl(spark, path, malformed="raise")))


@query(_ORDERS_BACK)
def jsonl_roundtrip_plain(spark, directory):
    path = scratch_directory(spark, "jsonl")
    write_jsonl(_text(spark, directory), path)
    return _blanks_to_null(read_jsonl(spark, path, kinds=False, malformed="raise"))


# Values of every JSON kind by line item; number tokens with exponents keep their spelling.
@query("""SELECT o_orderkey::varchar AS id,
  CASE o_orderkey % 4 WHEN 0 THEN o_custkey::varchar || '.00e+2' WHEN 1 THEN 'true' WHEN 2 THEN 'c' || o_custkey::varchar END AS raw,
  CASE o_orderkey % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'boolean' WHEN 2 THEN 'text' ELSE 'null' END AS kind FROM orders""")
def json_kinds(spark, directory):
    path = scratch_directory(spark, "kinds")
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    value = (
        F.when(k % 4 == 0, F.concat(c, F.lit(".00e+2"))).when(k % 4 == 1, "true")
        .when(k % 4 == 2, F.concat(F.lit('"c'), c, F.lit('"'))).otherwise("null")
    )
    line = F.concat(F.lit('{"id":"'), k.cast("string"), F.lit('","x":'), value, F.lit("}"))
    table(spark, directory, "orders").select(line.alias("value")).write.text(path)
    return read_jsonl(spark, path).select(F.col("id.raw").alias("id"), F.col("x.raw").alias("raw"), F.col("x.kind").alias("kind"))


# Every seventh record or so is faulty in its own way; lines count over all files, blank ones included.
@query("""WITH r AS (SELECT o_orderkey, sum(CASE WHEN o_orderkey % 9 = 5 THEN 2 ELSE 1 END) OVER (ORDER BY o_orderkey) AS line FROM orders)
SELECT line::bigint AS line, CASE o_orderkey % 50 WHEN 3 THEN 'JSON_KEYS' WHEN 4 THEN 'ENCODING' ELSE 'JSON_STRUCTURE' END AS code
FROM r WHERE o_orderkey % 50 IN (3, 4, 8, 13, 20, 27, 34, 41)""")
def json_record_faults(spark, directory):
    path = scratch_directory(spark, "faults")
    order = F.col("o_orderkey")
    key = order.cast("string")
    odd = {
        3: '{"id":1,"y":2}', 8: '{"id":1,"x":1e400}', 13: '{"id":1,"x":"\\ud83d \\udead"}', 20: '{"id":1,"x":2} {}', 27: '{"id":1,"x":2,"x":2}',
        34: '{"id":1,"x":[2]}', 41: '{"id":1,"x":NaN}',
    }
    text = F.concat(F.lit('{"id":"'), key, F.lit('","x":"\\ud83d\\ude00 \\\\ud83d"}'))
    for k, fault in odd.items():
        text = F.when(order % 50 == k, F.lit(fault)).otherwise(text)
    line = F.when(order % 50 == 4, F.concat(F.lit('{"id":"'), F.unhex(F.lit("E282")), F.lit('","x":1}')).cast("string")).otherwise(text)
    line = F.when(order % 9 == 5, F.concat(F.lit(" \n"), line)).otherwise(line)
    table(spark, directory, "orders").orderBy("o_orderkey").select(line.alias("value")).write.text(path)
    files = audits.lines(spark, path).groupBy("file").agg(F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per file
    found = json_faults(spark, path, ["id", "x"])
    return found.join(files.select("file", before.alias("before")), "file").select((F.col("line") + F.col("before")).alias("line"), "code")


# One fault per line in a fixed rotation.
@query("""SELECT count(*) AS records, count(*) FILTER (o_orderkey % 10 IN (1, 2, 3)) AS not_objects,
  count(*) FILTER (o_orderkey % 10 IN (4, 5)) AS other_keys, count(*) FILTER (o_orderkey % 10 IN (6, 7)) AS nested FROM orders""")
def json_structure_audit(spark, directory):
    path = scratch_directory(spark, "structure")
    k = F.col("o_orderkey") % 10
    key = F.col("o_orderkey").cast("string")
    line = (
        F.when(k == 1, '{"a":1,"a":2,"b":3}').when(k == 2, "[1,2]").when(k == 3, '{"a":1,"b":"open')
        .when(k == 4, '{"a":1}').when(k == 5, F.concat(F.lit('{"a":1,"b":2,"c":'), key, F.lit("}")))
        .when(k == 6, '{"a":[1],"b":2}').when(k == 7, '{"a":1,"b":{"c":2}}')
        .otherwise(F.concat(F.lit('{"b":"x","a":'), key, F.lit("}")))
    )
    table(spark, directory, "orders").select(line.alias("value")).write.text(path)
    return json_structure(spark, path, ["a", "b"])


@query("SELECT o_orderkey::varchar AS id, o_orderkey % 9 IN (1, 2) AS malformed FROM orders")
def row_width_audit(spark, directory):
    path = scratch_directory(spark, "ragged")
    k = F.col("o_orderkey") % 9
    key = F.col("o_orderkey").cast("string")
    # Short and long records are kept and marked.
    line = F.when(k == 1, key).when(k == 2, F.concat(key, F.lit(",x,y"))).otherwise(F.concat(key, F.lit(",x")))
    rows = table(spark, directory, "orders").select(line.alias("value"))
    # Spark's writer puts the given header on top of every file it writes.
    rows.select(F.col("value").alias("id,kind")).write.option("header", True).option("quote", "").option("sep", "|").csv(path)
    read = read_delimited(spark, path, malformed="quarantine", audit=False)
    return read.select("id", F.col(CORRUPT).isNotNull().alias("malformed"))


# Records of nothing but blanks and tabs are records; empty lines are none.
@query("""SELECT CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE o_orderkey::varchar END AS id,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'x' END AS kind FROM orders WHERE o_orderkey % 5 <> 2""")
def tsv_blank_records(spark, directory):
    path = scratch_directory(spark, "blanks")
    k = F.col("o_orderkey") % 5
    line = (
        F.when(k == 0, "\t").when(k == 1, " \t  ").when(k == 2, "").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit("\tx")))
    )
    # A header of its own in every file, as the writer gives to tables of several columns.
    rows = table(spark, directory, "orders").repartition(4, "o_orderkey").select(line.alias("id\tkind"))
    rows.write.options(header=True, quote="", sep="|", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_delimited(spark, path, "\t")


@query("SELECT count(*) FILTER (o_orderkey % 9 = 3) AS blank_records FROM orders")
def blank_record_count(spark, directory):
    path = scratch_directory(spark, "blank")
    k = F.col("o_orderkey") % 9
    line = F.when(k == 3, "").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(",x")))
    table(spark, directory, "orders").select(line.alias("value")).write.text(path)
    return audits.blank_records(spark, path)


def _example(spark, directory, name):
    """An example table over all orders, with the order key as row number."""
    rows = table(spark, directory, "orders").select(F.col("o_orderkey").alias("i"))
    return rows.select("i", *[c.alias(n) for n, c in example_columns(name, F.col("i")).items()])


_I = "WITH r AS (SELECT o_orderkey AS i FROM orders)"


@query(f"""{_I} SELECT i, round((i % 2) * 4 + ((i * 7) % 13) / 10.0::double, 2) AS signal, round(((i * 11) % 17) / 10.0::double, 2) AS variation,
  CASE WHEN i % 2 = 1 THEN 'on' ELSE 'off' END AS outcome FROM r""")
def synthetic_classification(spark, directory):
    return _example(spark, directory, "classification")


@query(f"""{_I} SELECT i, i % 20 AS length, (i * 7) % 11 AS width,
  round(3.2::double * (i % 20) - 1.7::double * ((i * 7) % 11) + (i % 5 - 2) / 10.0::double, 2) AS response FROM r""")
def synthetic_regression(spark, directory):
    return _example(spark, directory, "regression")


@query(f"""{_I} SELECT i, round((i % 3) * 5 + ((i * 7) % 11) / 10.0::double, 2) AS x,
  round((i % 3) * -4 + ((i * 13) % 17) / 10.0::double, 2) AS y FROM r""")
def synthetic_clustering(spark, directory):
    return _example(spark, directory, "clustering")


@query(f"""{_I} SELECT i, i % 20 + 1 AS length, round(0.8::double * (i % 20 + 1) + (i % 3) / 10.0::double, 2) AS width,
  round(1.2::double * (i % 20 + 1) + ((i * 7) % 11) / 10.0::double, 2) AS mass FROM r""")
def synthetic_reduction(spark, directory):
    return _example(spark, directory, "reduction")


@query(f"""{_I} SELECT i, 'demo_' || lpad(i::varchar, greatest(3, length(i::varchar))::int, '0') AS customer_id,
  (20 + (i * 7) % 45)::varchar AS age, CASE WHEN i % 13 = 0 THEN '' ELSE (2000 + (i * 137) % 5000)::varchar END AS income,
  lpad((i % 5 + 1)::varchar, 4, '0') AS zip_code, CASE i % 3 WHEN 0 THEN 'North' WHEN 1 THEN 'East' ELSE 'West' END AS region,
  CASE WHEN i % 2 = 1 THEN 'true' ELSE 'false' END AS active, '2024-01-' || lpad((i % 28 + 1)::varchar, 2, '0') AS joined,
  CASE WHEN i % 3 = 0 THEN 'left' ELSE 'retained' END AS outcome FROM r""")
def synthetic_mixed(spark, directory):
    return _example(spark, directory, "mixed")
