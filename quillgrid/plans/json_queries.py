"""Queries over JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import table
from ..operators import jsonops as J
from ..registry import query

CUSTOMER = """'{"name": "' || c_name || '", "meta": {"nation": ' || c_nationkey || ', "gone": null, "in": {"seg": "' || c_mktsegment || '"}}, "_id": ' || c_custkey || ', "debug_info": "x", "tags": [], "created_at": "2024-01-0' || (c_custkey % 2 + 1) || 'T10", "updated_at": "2024-01-01T11"' || CASE WHEN c_custkey % 3 = 0 THEN ', "note": null}' ELSE ', "note": "n"}' END"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    parts = ['{"name": "', F.col("c_name"), '", "meta": {"nation": ', F.col("c_nationkey").cast("string"), ', "gone": null, "in": {"seg": "', F.col("c_mktsegment"), '"}}, "_id": ', k.cast("string"), ', "debug_info": "x", "tags": [], "created_at": "2024-01-0', (k % 2 + 1).cast("string"), 'T10", "updated_at": "2024-01-01T11"', F.when(k % 3 == 0, ', "note": null}').otherwise(', "note": "n"}')]
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("text"), "c_name", "c_nationkey", "c_mktsegment")


_DATE = "c_custkey % 2 + 1"


@query(f"""SELECT c_custkey, '{{"_id":' || c_custkey || ',"created_at":"2024-01-0' || ({_DATE}) || 'T10","debug_info":"x","meta":{{"in":{{"seg":"' || c_mktsegment || '"}},"nation":' || c_nationkey || '}},"name":"' || c_name || '"' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',"note":"n"' END || ',"tags":[],"updated_at":"2024-01-01T11"}}' AS json FROM customer""")
def json_strip_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select("c_custkey", J.rewrite("text", J.strip_nulls).alias("json"))


@query(f"""SELECT c_custkey, '{{"_id":' || c_custkey || ',"created_at":"2024-01-0' || ({_DATE}) || 'T10","debug_info":"x","meta.gone":null,"meta.in.seg":"' || c_mktsegment || '","meta.nation":' || c_nationkey || ',"name":"' || c_name || '","note":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"n"' END || ',"tags":[],"updated_at":"2024-01-01T11"}}' AS json FROM customer""")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select("c_custkey", J.rewrite("text", J.flatten).alias("json"))


@query(f"""SELECT c_custkey, '{{"created_at":"2024-01-0' || ({_DATE}) || 'T10","meta":{{"gone":null,"in":{{"seg":"' || c_mktsegment || '"}},"nation":' || c_nationkey || '}},"name":"' || c_name || '","note":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"n"' END || CASE WHEN {_DATE} = 1 THEN '' ELSE ',"updated_at":"2024-01-01T11"' END || '}}' AS json FROM customer""")
def json_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise fields, empty values and repeated dates go."""
    return customers(spark, sf_dir).select("c_custkey", J.rewrite("text", J.project).alias("json"))


@query("""SELECT c_custkey, '{"name":"' || c_name || '"}' AS kept, 'TOON:{meta:{in:{seg:"' || c_mktsegment || '"}},name:"' || c_name || '"}' AS encoded FROM customer""")
def json_fields_and_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields kept and fields stripped by path, the second in the compact notation."""
    gone = ["meta.nation", "meta.gone", "_id", "debug_info", "tags", "created_at", "updated_at", "note"]
    c = customers(spark, sf_dir)
    return c.select("c_custkey", J.rewrite("text", lambda v: J.keep_fields(v, ["name"])).alias("kept"), J.rewrite("text", lambda v: J.strip_fields(v, gone), out=J.encode).alias("encoded"))


@query("""SELECT event_id, 'TOON:' || replace(replace(props, '"', ''), ' ', '') AS encoded, true AS same FROM events""")
def compact_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties in the compact notation, and whether decoding gives them back."""
    e = table(spark, sf_dir, "events").withColumn("encoded", J.rewrite("props", out=J.encode))
    back = J.rewrite("props", lambda v: J.decode(J.encode(v)) == v, out=lambda v: str(v).lower())
    return e.select("event_id", "encoded", (back == "true").alias("same"))


@query("""WITH k AS (SELECT l_orderkey, count(*) AS n, string_agg('{"p":' || l_partkey || '}', ',' ORDER BY l_partkey) AS js, string_agg(CAST(l_partkey AS VARCHAR), chr(10) ORDER BY l_partkey) AS cells FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN n > 5 THEN '["[table: ' || n || ' rows]\\np\\n' || replace(cells, chr(10), '\\n') || '"]' ELSE '[' || js || ']' END AS json FROM k""")
def array_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda p: F.concat(F.lit('{"p":'), p.cast("string"), F.lit("}"))), ",").alias("items"))
    return li.select("l_orderkey", J.rewrite(F.concat(F.lit("["), "items", F.lit("]")), J.collapse_arrays).alias("json"))


@query("""SELECT field, count(*) AS n FROM (SELECT unnest(regexp_extract_all(props, '"([^"]+)"\\s*:', 1)) AS field FROM events) GROUP BY field""")
def json_key_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.explode(J.field_names(F.col("props"))).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


@query()
def json_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer objects, three times over in an array, with learned and fixed field codes."""
    c = customers(spark, sf_dir).withColumn("text", F.concat(F.lit("["), "text", F.lit(","), "text", F.lit(","), "text", F.lit("]"))).withColumn("text", J.rewrite("text"))
    learned = [r["field"] for r in J.learn_dictionary(c, "text").collect()]
    return c.select("c_custkey", J.apply_dictionary(c, "text", learned).alias("json"), F.octet_length("text").alias("bytes"))


@query("""SELECT o_orderkey, '{"comment":"' || CASE WHEN o_orderkey % 2 = 0 THEN repeat('ab', 250) || '..."}' ELSE repeat('ab', 250) || '"}' END AS json FROM orders""")
def json_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"comment": "'), F.when(F.col("o_orderkey") % 2 == 0, F.repeat(F.lit("ab"), 251)).otherwise(F.repeat(F.lit("ab"), 250)), F.lit('"}'))
    return table(spark, sf_dir, "orders").select("o_orderkey", J.rewrite(text, J.truncate_strings).alias("json"))
