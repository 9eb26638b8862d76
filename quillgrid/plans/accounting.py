"""Queries over savings, costs and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import table, token_estimate
from ..operators import account as A
from ..operators.dedup import condense
from ..registry import query
from .deduplicating import ISLANDS, LINES

CONDENSED = f"""t AS (SELECT doc_id, text FROM documents), {ISLANDS.format(k="doc_id", lines=LINES)},
cond AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) || CASE WHEN bool_or(tail) THEN chr(10) ELSE '' END AS out FROM n WHERE rn <= 3 GROUP BY doc_id),
log AS (SELECT doc_id, source, lang, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tin, CAST(ceil(strlen(out) / 4.0) AS BIGINT) AS tout FROM documents JOIN cond USING (doc_id))"""


def compaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", token_estimate(F.col("text")).alias("tin"), token_estimate(condense(F.col("text"))).alias("tout"))


TOTALS = "count(*) AS n, CAST(sum(tin) AS BIGINT) AS tokens_in, CAST(sum(tout) AS BIGINT) AS tokens_out, CAST(greatest(sum(tin) - sum(tout), 0) AS BIGINT) AS saved, round(100.0 * greatest(sum(tin) - sum(tout), 0) / sum(tin), 6)::DOUBLE AS reduction"


@query(f"WITH {CONDENSED} SELECT {TOTALS} FROM log")
def global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.totals(compaction_log(spark, sf_dir), [], "tin", "tout")


@query(f"WITH {CONDENSED} SELECT source, {TOTALS} FROM log GROUP BY source")
def project_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.totals(compaction_log(spark, sf_dir), ["source"], "tin", "tout")


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), token_estimate(F.col("text")).alias("tokens"))


DAILY = "d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS saved FROM events GROUP BY 1)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum(F.floor("value")).cast("long").alias("saved"))


@query(f"WITH {DAILY} SELECT * FROM d WHERE day > (SELECT max(day) FROM d) - INTERVAL 7 DAY")
def daily_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    return d.join(F.broadcast(d.agg(F.max("day").alias("last")))).filter("day > date_sub(last, 7)").drop("last")


@query(f"WITH {DAILY} SELECT day, saved, repeat('█', CAST(floor(saved * 30 / greatest((SELECT max(saved) FROM d), 1)::DOUBLE) AS INT)) AS bar FROM d")
def gain_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.gain_bars(daily(spark, sf_dir), "saved").select("day", "saved", "bar")


@query("""WITH u AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, min(day) AS a, max(day) AS b FROM u GROUP BY user_id),
c AS (SELECT user_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM s) SELECT user_id, count(*) AS idle FROM c WHERE (user_id, day) NOT IN (SELECT user_id, day FROM u) GROUP BY user_id""")
def idle_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day"))
    return A.idle_days(e, "user_id", "day").groupBy("user_id").agg(F.count("*").alias("idle"))


@query("""SELECT coalesce(event_type, 'all') AS tool, count(*) AS calls, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM events GROUP BY ROLLUP (event_type)""")
def tool_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").rollup("event_type").agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))
    return e.select(F.coalesce("event_type", F.lit("all")).alias("tool"), "calls", "users", "total")


COSTS = """c AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'sonnet' WHEN 1 THEN 'gpt' WHEN 2 THEN 'gemini' ELSE 'other' END AS model, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tin, turn * 10 AS tout, turn * 5 AS cached FROM conversations),
p AS (SELECT * FROM (VALUES ('sonnet', 3.0::DOUBLE, 15.0::DOUBLE, 0.9::DOUBLE), ('gpt', 2.5, 10.0, 0.5), ('gemini', 1.25, 5.0, 0.75)) v(model, ri, ro, d)),
x AS (SELECT c.*, (tin * coalesce(ri, 0) + tout * coalesce(ro, 0) + cached * coalesce(ri, 0) * (1 - coalesce(d, 0))) / 1e6 AS cost, cached * coalesce(ri, 0) * coalesce(d, 0) / 1e6 AS cache_saved FROM c LEFT JOIN p USING (model))"""


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.element_at(F.array(*map(F.lit, ("sonnet", "gpt", "gemini", "other"))), (F.col("conv_id") % 4 + 1).cast("int"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", model.alias("model"), token_estimate(F.col("text")).alias("tin"), (F.col("turn") * 10).alias("tout"), (F.col("turn") * 5).alias("cached"))
    return A.with_cost(c, "model", "tin", "tout", "cached")


@query(f"WITH {COSTS} SELECT conv_id, turn, round(cost * 1e6, 3) AS micro_cost FROM x")
def model_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).select("conv_id", "turn", F.round(F.col("cost") * 1e6, 3).alias("micro_cost"))


@query(f"WITH {COSTS} SELECT conv_id, count(*) AS turns, round(sum(cost) * 1e6, 3) AS micro_cost, round(sum(cache_saved) * 1e6, 3) AS micro_saved FROM x GROUP BY conv_id")
def session_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("turns"), F.round(F.sum("cost") * 1e6, 3).alias("micro_cost"), F.round(F.sum("cache_saved") * 1e6, 3).alias("micro_saved"))


BUDGET = """e AS (SELECT user_id, event_id, ts, CAST(floor(value) AS BIGINT) AS tokens FROM events), u AS (SELECT *, sum(tokens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS used FROM e),
b AS (SELECT *, coalesce(lag(used) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS before FROM u)"""


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.floor("value").cast("long").alias("tokens"))
    return A.budget(e, ["user_id"], ["ts", "event_id"], "tokens", 2000)


@query(f"WITH {BUDGET} SELECT event_id, CAST(used AS BIGINT) AS used, CAST(greatest(2000 - used, 0) AS BIGINT) AS available FROM b")
def budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget(spark, sf_dir).select("event_id", "used", "available")


@query(f"WITH {BUDGET} SELECT user_id, event_id, before < 1400 AND used >= 1400 AS crossed_70, before < 1700 AND used >= 1700 AS crossed_85 FROM b WHERE (before < 1400 AND used >= 1400) OR (before < 1700 AND used >= 1700)")
def budget_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget(spark, sf_dir).filter("crossed_70 or crossed_85").select("user_id", "event_id", "crossed_70", "crossed_85")


@query("SELECT user_id, count(*) AS calls, CAST(round(8000 * (count(*) / (SELECT count(*) FROM events)::DOUBLE)) AS BIGINT) AS share FROM events GROUP BY user_id")
def agent_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("calls")).join(F.broadcast(e.agg(F.count("*").alias("n")))).select("user_id", "calls", F.round(8000 * (F.col("calls") / F.col("n"))).cast("long").alias("share"))


@query("""WITH n AS (SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, CASE WHEN n <= 3 THEN 'normal' WHEN n <= 8 THEN 'reduced' ELSE 'blocked' END AS level FROM n""")
def throttle_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return A.throttle(e, ["event_type", "user_id", "day"], ["ts", "event_id"]).select("event_id", "level")


@query("""WITH f AS (SELECT sha256(text) AS h, count(*) AS n, min(strlen(text)) AS b FROM documents GROUP BY 1)
SELECT count(*) AS entries, CAST(sum(b) AS BIGINT) AS bytes, round((sum(n) - count(*)) / sum(n)::DOUBLE, 6) AS hit_rate FROM f""")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"), F.min(F.octet_length("text")).alias("b"))
    return f.agg(F.count("*").alias("entries"), F.sum("b").cast("long").alias("bytes"), F.round((F.sum("n") - F.count("*")) / F.sum("n"), 6).alias("hit_rate"))


@query("""SELECT CAST(ts AS DATE) AS day, event_type AS mode, event_id, 'run' || event_id || '_' || event_type AS tee_id FROM events WHERE event_type = 'error'""")
def tee_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw outputs that are kept: those of failures, with an id of time and name."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return e.select(F.to_date("ts").alias("day"), F.col("event_type").alias("mode"), "event_id", F.concat(F.lit("run"), F.col("event_id").cast("string"), F.lit("_"), "event_type").alias("tee_id"))
