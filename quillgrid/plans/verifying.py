"""Queries over the checks after compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import table
from ..operators import verify as V
from ..registry import query
from .texts import LINES

#: Originals and what a careless compaction would leave of them, made from orders alike in both engines.
PAIRS = """SELECT o_orderkey, 'error: order ' || o_orderkey || ' failed' || chr(10) || 'see /var/log/' || o_custkey || '.log' || chr(10) || '@@ -1 +2 @@' || chr(10) || 'total 12.50 and ' || o_orderkey || chr(10) || repeat('x', 40) AS old,
CASE o_orderkey % 6 WHEN 0 THEN 'x' WHEN 1 THEN 'see /var/log/' || o_custkey || '.log' || chr(10) || '@@ -1 +2 @@ total 12.50 and ' || o_orderkey WHEN 2 THEN 'error: order ' || o_orderkey || ' failed @@ -1 +2 @@ 12.50'
 WHEN 3 THEN 'error: order ' || o_orderkey || ' failed' || chr(10) || 'see /var/log/' || o_custkey || '.log total 12.50' WHEN 4 THEN 'error: order ' || o_orderkey || ' failed see /var/log/' || o_custkey || '.log @@ -1 +2 @@'
 ELSE 'error: order ' || o_orderkey || ' failed' || chr(10) || 'see /var/log/' || o_custkey || '.log' || chr(10) || '@@ -1 +2 @@' || chr(10) || 'total 12.50 and ' || o_orderkey || chr(10) || repeat('x', 40) END AS new FROM orders"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    j = lambda *x: F.concat(*(F.lit(i) if isinstance(i, str) else i for i in x))
    error, path = j("error: order ", k, " failed"), j("see /var/log/", c, ".log")
    old = j(error, "\n", path, "\n@@ -1 +2 @@\ntotal 12.50 and ", k, "\n", "x" * 40)
    n = F.col("o_orderkey") % 6
    new = F.when(n == 0, "x").when(n == 1, j(path, "\n@@ -1 +2 @@ total 12.50 and ", k)).when(n == 2, j(error, " @@ -1 +2 @@ 12.50")).when(n == 3, j(error, "\n", path, " total 12.50")).when(n == 4, j(error, " ", path, " @@ -1 +2 @@")).otherwise(old)
    return o.select("o_orderkey", old.alias("old"), new.alias("new"))


CHECKED = f"""p AS ({PAIRS}), l AS (SELECT *, {LINES.replace("text", "old")} AS ls FROM p),
c AS (SELECT o_orderkey, old, new, strlen(new) * 10 >= strlen(old) AS min_retention,
  len(list_filter(ls, lambda x: contains(x, 'error:') AND NOT contains(new, trim(x)))) = 0 AS error_lines,
  len(list_filter(list_filter(ls, lambda x: contains(x, '/') AND contains(x, '.')), lambda x: NOT contains(new, regexp_extract(x, '(\\S*/\\S*)', 1)))) = 0 AS file_paths,
  len(list_filter(ls, lambda x: starts_with(x, '@@') AND NOT contains(new, x))) = 0 AS diff_hunks,
  len(list_filter(list_slice(list_filter(regexp_split_to_array(old, '[^0-9.\\-]+'), lambda x: strlen(x) >= 2 AND regexp_matches(x, '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)$')), 1, 10), lambda x: NOT contains(new, x))) = 0 AS numeric_values FROM l)"""


@query(f"WITH {CHECKED} SELECT o_orderkey, min_retention, error_lines, file_paths, true AS json_keys, diff_hunks, numeric_values FROM c")
def verify_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    return p.select("o_orderkey", *(f(F.col("old"), F.col("new")).alias(n) for n, f in V.CHECKS.items()))


@query(f"""WITH {CHECKED}, f AS (SELECT o_orderkey, min_retention::INT + error_lines::INT + file_paths::INT + 1 + diff_hunks::INT + numeric_values::INT AS n, file_paths AS kept FROM c)
SELECT o_orderkey, round(CASE WHEN kept THEN (n + 1) / 7.0 ELSE least(n / 7.0, 0.5) END, 6)::DOUBLE AS confidence, CASE WHEN kept THEN (n + 1) / 7.0 ELSE least(n / 7.0, 0.5) END < 0.6 AS fallback FROM f""")
def verify_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven checks; here the only identifier tokens are the paths, so both fail together."""
    p = pairs(spark, sf_dir)
    x = p.select("o_orderkey", *(f(F.col("old"), F.col("new")).alias(n) for n, f in V.CHECKS.items()), V.preservation(F.col("old"), F.col("new")).alias("kept"))
    c = V.confidence([F.col(n) for n in V.CHECKS], F.col("kept"))
    return x.select("o_orderkey", F.round(c, 6).alias("confidence"), (c < V.FALLBACK).alias("fallback"))


@query("""SELECT c_custkey, c_custkey % 3 <> 0 AS json_keys FROM customer""")
def verify_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = F.concat(F.lit('{"name": "'), "c_name", F.lit('", "seg": "x", "nation": 1, "balance": 2}'))
    new = F.when(F.col("c_custkey") % 3 == 0, "name only").otherwise("name and seg")
    return c.select("c_custkey", V.json_keys(old, new).alias("json_keys"))


@query()
def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether URLs set in prose survive a shortening; the scanner is Python."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", V.preservation(F.concat(F.lit("see "), "url", F.lit(" for v1.2.3")), F.concat(F.lit("see "), "url")).alias("preserved"))
