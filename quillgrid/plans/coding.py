"""Queries over command output and source code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import table
from ..operators import code as K
from ..operators import formatters as O
from ..registry import query

#: Commands with raw and expected output.
SAMPLES = (
    ("git status", "On branch main\nnothing to commit, working tree clean\n", "clean"),
    ("tsc", "Found 0 errors. Watching for file changes.", "ok: 0 errors"),
    ("cargo test", "test a ... ok\ntest b ... FAILED\ntest c ... ok\nnoise noise noise noise noise noise noise\n", "FAILURES (1):\ntest b ... FAILED"),
    ("npm install", "npm warn old\nadded 12 packages in 3s\n", "added 12 packages in 3s"),
    ("git pull", "Updating a..b\n 3 files changed, 10 insertions(+), 2 deletions(-)\n", "ok 3 files +10 -2"),
    ("kubectl get pods", "NAME      READY   AGE\nweb-1     1/1     5d\n", "NAME READY AGE\nweb-1 1/1 5d"),
    ("eslint", "  1:1  error  Bad thing  no-var\n  2:1  error  Bad thing  no-var\n", "2 issues:\n  no-var (2x)"),
    ("unknown_tool", "left as it is", "left as it is"),
)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({_q(c)}, {_q(x)})" for c, _, x in SAMPLES) + ") v(command, formatted)")
def command_formatters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.createDataFrame([(c, o) for c, o, _ in SAMPLES], "command string, output string")
    return s.select("command", O.formatted(F.col("command"), F.col("output")).alias("formatted"))


@query("""WITH r AS (SELECT event_type AS rule, count(*) AS n FROM events GROUP BY event_type) SELECT rule, n, rule || ' (' || n || 'x)' AS line FROM r ORDER BY n DESC, rule LIMIT 10""")
def issues_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines grouped by a key, the ten commonest: the distributed form of the grouping formatters."""
    r = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("rule")).agg(F.count("*").alias("n"))
    return r.select("rule", "n", F.concat("rule", F.lit(" ("), F.col("n").cast("string"), F.lit("x)")).alias("line")).orderBy(F.desc("n"), "rule").limit(10)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small source file for each supplier."""
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("import os\nfrom mod_"), (F.col("s_suppkey") % 10).cast("string"), F.lit(" import x\n\nclass C"), k, F.lit(":\n    pass\n\ndef f"), k, F.lit("(a):\n    return g"), k, F.lit("(a)\n\ndef g"), k, F.lit("(b):\n    return b\n"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("mod_"), k).alias("path"), text.alias("text"))


@query("""SELECT s_suppkey, unnest([1, 2, 4, 7, 10]) AS line_no, unnest(['import', 'import', 'class', 'function', 'function']) AS kind,
  unnest(['os', 'mod_' || (s_suppkey % 10) || ' import x', 'C' || s_suppkey, 'f' || s_suppkey, 'g' || s_suppkey]) AS name FROM supplier""")
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.symbols(sources(spark, sf_dir), "s_suppkey", "text").select("s_suppkey", "line_no", "kind", "name")


@query("""SELECT 'mod_' || s_suppkey AS src, 'mod_' || (s_suppkey % 10) AS dst FROM supplier UNION ALL SELECT 'mod_' || s_suppkey, 'os' FROM supplier""")
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dependency_edges(sources(spark, sf_dir), "path", "text")


@query("""SELECT 'mod_' || (s_suppkey % 10) AS module, count(*) AS importers FROM supplier GROUP BY 1 UNION ALL SELECT 'os', count(*) FROM supplier""")
def reverse_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = K.reverse(K.dependency_edges(sources(spark, sf_dir), "path", "text"))
    return edges.groupBy(F.col("src").alias("module")).agg(F.count("*").alias("importers"))


@query("""SELECT 'mod_' || s_suppkey AS path FROM supplier WHERE s_suppkey IN (SELECT s_suppkey % 10 FROM supplier WHERE s_suppkey > 50) AND s_suppkey <= 50""")
def predictive_precache(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = sources(spark, sf_dir)
    cached = src.filter("s_suppkey > 50").select("path")
    return K.to_precache(K.dependency_edges(src, "path", "text"), src.select("path"), cached, "path")


@query("SELECT s_suppkey, 'f' || s_suppkey AS caller, 'g' || s_suppkey AS callee FROM supplier")
def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.call_edges(sources(spark, sf_dir), "s_suppkey", "text")


@query("""SELECT s_suppkey, 'imports: mod_' || (s_suppkey % 10) || ' import x, os' || chr(10) || 'class C' || s_suppkey || ':' || chr(10) || 'def f' || s_suppkey || '(a):' || chr(10) || 'def g' || s_suppkey || '(b):' AS outline FROM supplier""")
def structural_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.outline(sources(spark, sf_dir), "s_suppkey", "text").select("s_suppkey", "outline")


@query("""WITH r AS (SELECT source, doc_id, count(*) OVER (PARTITION BY source) - row_number() OVER (PARTITION BY source ORDER BY doc_id) AS age FROM documents)
SELECT doc_id, CASE WHEN age < 10 THEN 'fresh' WHEN age < 20 THEN 'aging' WHEN age < 30 THEN 'old' ELSE 'ancient' END AS level FROM r""")
def cascade_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("source")
    age = F.count("*").over(w) - F.row_number().over(w.orderBy("doc_id"))
    return table(spark, sf_dir, "documents").withColumn("age", age).select("doc_id", K.age_level(F.col("age")).alias("level"))


@query("""SELECT doc_id, first, last FROM (SELECT doc_id, source, text, count(*) OVER (PARTITION BY source) - row_number() OVER (PARTITION BY source ORDER BY doc_id) AS age FROM documents),
LATERAL (SELECT strlen(text) AS first, CASE WHEN age < 10 THEN strlen(text) ELSE 0 END AS last) WHERE age < 10""")
def cascade_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh texts are untouched: their size before and after."""
    w = W.partitionBy("source")
    age = F.count("*").over(w) - F.row_number().over(w.orderBy("doc_id"))
    d = table(spark, sf_dir, "documents").withColumn("age", age).filter("age < 10")
    return d.select("doc_id", F.octet_length("text").cast("long").alias("first"), F.octet_length(K.cascade(F.col("text"), F.col("age"))).cast("long").alias("last"))
