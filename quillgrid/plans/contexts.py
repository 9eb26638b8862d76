"""Queries over what a context holds, sampled arrays, dense sentences and read modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import table, token_estimate
from ..operators import code as K
from ..operators import context as X
from ..operators import entropy as E
from ..operators import jsonops as J
from ..operators import textops as T
from ..registry import query
from .coding import sources
from .json_queries import customers
from .texts import LINES


@query("""WITH u AS (SELECT conv_id, CAST(sum(ceil(strlen(text) / 4.0)) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id)
SELECT conv_id, tokens, tokens / 400.0 >= 0.7 AS evict, (conv_id % 2 = 1) AND tokens / 400.0 >= 0.7 AS evict_odd FROM u""")
def eviction_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations at 70 percent of a ceiling of 400 tokens; in the second column even ones have no ceiling."""
    u = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(token_estimate(F.col("text"))).alias("tokens"))
    return u.select("conv_id", "tokens", E.should_evict(F.col("tokens"), F.lit(400)).alias("evict"), E.should_evict(F.col("tokens"), F.when(F.col("conv_id") % 2 == 1, 400).otherwise(0)).alias("evict_odd"))


@query("SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents WHERE ceil(strlen(text) / 4.0) > 500")
def preview_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.previewed(table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens")), "tokens")


@query(f"""WITH t AS (SELECT *, {LINES} AS ls FROM conversations), s AS (SELECT *, CASE WHEN strlen(text) >= 200 AND len(ls) > 3 THEN ls[1] || chr(10) || '[... ' || (len(ls) - 2) || ' lines, ' || strlen(text) || ' chars ...]' || chr(10) || ls[-1] ELSE text END AS after FROM t),
k AS (SELECT conv_id, role, text <> after AS changed, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS b, CAST(ceil(strlen(after) / 4.0) AS BIGINT) AS a FROM s),
g AS (SELECT conv_id, CAST(sum(b) AS BIGINT) AS tokens_original, CAST(sum(a) AS BIGINT) AS tokens_compacted, count(*) FILTER (WHERE changed) AS messages_compacted, count(*) FILTER (WHERE changed) AS messages_summarised,
  CAST(coalesce(sum(greatest(b - a, 0)) FILTER (WHERE role = 'system'), 0) AS BIGINT) AS system_tokens_saved, CAST(coalesce(sum(greatest(b - a, 0)) FILTER (WHERE role = 'tool'), 0) AS BIGINT) AS tool_tokens_saved FROM k GROUP BY conv_id)
SELECT *, greatest(tokens_original - tokens_compacted, 0) AS tokens_saved, CASE WHEN tokens_original = 0 THEN 0.0 ELSE round((1 - tokens_compacted / tokens_original::DOUBLE) * 100, 6) END::DOUBLE AS reduction FROM g""")
def proxy_request_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What summarised messages save in each conversation's request."""
    c = table(spark, sf_dir, "conversations").withColumn("after", T.summarise(F.col("text")))
    return X.proxy_stats(c, ["conv_id"], F.col("role"), "text", "after", F.col("text") != F.col("after"))


@query("""WITH log AS (SELECT user_id AS conv_id, event_id % 4 AS turn, CASE WHEN event_type = 'purchase' THEN 'pin' ELSE 'unpin' END AS action, event_type, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT c.conv_id, c.turn, coalesce(action = 'pin', false) AS pinned, NOT coalesce(action = 'pin', false) AS eligible, CASE WHEN action = 'pin' THEN event_type END AS reason FROM conversations c LEFT JOIN log ON log.conv_id = c.conv_id AND log.turn = c.turn AND n = 1""")
def pinned_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns protected by the last pin or unpin; purchases of the user of the same number pin."""
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("conv_id"), (F.col("event_id") % 4).alias("turn"), F.when(F.col("event_type") == "purchase", "pin").otherwise("unpin").alias("action"), F.col("event_type").alias("reason"), "ts", "event_id")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return X.pinned_turns(turns, log, ["conv_id", "turn"], ["ts", "event_id"]).select("conv_id", "turn", "pinned", "eligible", "reason")


@query("""SELECT event_id, 'error[E1]: bad' || chr(10) || ' --> src/f' || (user_id % 50) || '.rs' || CASE WHEN user_id % 50 IN (SELECT s_suppkey * 2 FROM supplier) THEN ' [in context]' ELSE '' END || ':3:1' || chr(10) || 'at src/f' || (event_id % 50) || '.rs'
  || CASE WHEN event_id % 50 IN (SELECT s_suppkey * 2 FROM supplier) THEN ' [in context]' ELSE '' END || ':9' AS text FROM events""")
def known_file_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiler messages in which files already read are marked."""
    s = lambda c: (F.col(c) % 50).cast("string")
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("error[E1]: bad\n --> src/f"), s("user_id"), F.lit(".rs:3:1\nat src/f"), s("event_id"), F.lit(".rs:9")).alias("text"))
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/f"), (F.col("s_suppkey") * 2).cast("string"), F.lit(".rs")).alias("path"))
    return X.known_file_refs(e, "event_id", "text", known, "path").select("event_id", "text")


_COMMON = ", ".join(f"'{w}'" for w in T.FUNCTION_WORDS)


@query(rf"""WITH p AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents),
s AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM p WHERE len(ss) > 8),
w AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(lower(s), '[^a-z'' ]', ' ', 'g'), '\s+'), lambda x: length(x) > 1) AS ws FROM s),
f AS (SELECT *, CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_filter(ws, lambda x: x NOT IN ({_COMMON}))) / len(ws)::DOUBLE END AS d,
  i > 1 AND i < n AND len(regexp_split_to_array(s, '\s+')) > 5 AND NOT regexp_matches(s, '[0-9]') AND NOT regexp_matches(s, '{T.CITATION}') AND NOT regexp_matches(s, '{T.FORMULA}') AS free FROM w),
r AS (SELECT *, free AND row_number() OVER (PARTITION BY doc_id, free ORDER BY d, i) <= floor(n * 0.15) AS gone FROM f),
o AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS pruned FROM r WHERE NOT gone GROUP BY doc_id)
SELECT doc_id, coalesce(pruned, text) AS pruned FROM p LEFT JOIN o USING (doc_id)""")
def density_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their least dense sentences."""
    return table(spark, sf_dir, "documents").select("doc_id", T.density_prune(F.col("text")).alias("pruned"))


@query("""WITH k AS (SELECT l_orderkey, count(*) AS n, list(l_partkey ORDER BY l_partkey) AS ps, string_agg('{"p":' || l_partkey || '}', ',' ORDER BY l_partkey) AS js FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN n > 5 THEN '{"_sampled":true,"count":' || n || ',"examples":[{"p":' || ps[1] || '},{"p":' || ps[n // 2 + 1] || '}],"shape":{"p":"number"}}' ELSE '[' || js || ']' END AS json FROM k""")
def array_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("l_orderkey", J.rewrite("json", J.sample_array).alias("json"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each order as an array of objects."""
    items = F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda p: F.concat(F.lit('{"p":'), p.cast("string"), F.lit("}"))), ",")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("["), items, F.lit("]")).alias("json"))


@query()
def array_keep_informative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays without their elements of low entropy; tested by brute force, as medians of logarithms tie differently in SQL."""
    return _orders(spark, sf_dir).select("l_orderkey", J.rewrite("json", J.keep_informative).alias("json"))


@query("""SELECT c_custkey, 'TOON:{_id:' || c_custkey || ',created_at:"2024-01-0' || (c_custkey % 2 + 1) || 'T10",debug_info:"x",meta:{in:{seg:"' || c_mktsegment || '"},nation:' || c_nationkey || '},name:"' || c_name || '"' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',note:"n"' END || ',tags:[],updated_at:"2024-01-01T11"}' AS json FROM customer""")
def json_squeeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select("c_custkey", J.shorter("text", out=J.squeeze).alias("json"))


@query("""SELECT 'mod_' || s_suppkey AS path, '# mod_' || s_suppkey || ' (11 lines)' || chr(10) || 'imports: 2' || chr(10) || 'structs(1): C' || s_suppkey || chr(10) || 'fns(2): f' || s_suppkey || ', g' || s_suppkey AS content FROM supplier""")
def file_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.read_files(sources(spark, sf_dir), "path", "text", "map").select("path", "content")


@query()
def read_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mode of reading over the same files; the earlier version has another first line."""
    s = sources(spark, sf_dir).withColumn("old", F.concat(F.lit("import sys\n"), F.regexp_replace("text", "^[^\n]*\n", "")))
    out = None
    for mode in ("full", "map", "signatures", "diff", "aggressive", "entropy", "task", "lines"):
        one = K.read_files(s, "path", "text", mode, previous="old", first=2, last=3, context=1, intent=("return",))
        out = one if out is None else out.unionByName(one)
    return out
