"""Queries that run streams to their end, and queries over sources. Their SQL is that of the batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import table
from ..registry import query
from ..sources import envelope as V
from ..sources import readers as R
from ..sources import store as T
from ..streaming import streams as S
from .accounting import BUDGET


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.event_stream(spark, f"{sf_dir}/events.parquet")


@query("""WITH g AS (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events)
SELECT event_id, CASE WHEN gap IS NULL THEN 'fresh' WHEN gap < 86400000000 THEN 'ref' ELSE 'resend' END AS outcome FROM g""")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run(S.dedup(events(spark, sf_dir), 86400), "dedup")


@query("""WITH c AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS era FROM events),
n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, era, event_type ORDER BY ts, event_id) AS n FROM c)
SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'control' WHEN n > 1 THEN 'ref' ELSE 'fresh' END AS outcome FROM n""")
def stream_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run(S.invalidating(events(spark, sf_dir), "purchase"), "invalidation")


@query("""WITH n AS (SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, CASE WHEN n <= 3 THEN 'normal' WHEN n <= 8 THEN 'reduced' ELSE 'blocked' END AS level FROM n""")
def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.throttle(events(spark, sf_dir).withColumn("day", F.to_date("ts")))


@query(f"WITH {BUDGET} SELECT event_id, CAST(used AS BIGINT) AS used, before < 1400 AND used >= 1400 AS crossed FROM b")
def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run(S.budget(events(spark, sf_dir), 2000), "budget")


@query()
def stream_regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run(S.regret(events(spark, sf_dir)), "regret")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS saved FROM events GROUP BY 1")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run(S.daily(events(spark, sf_dir)), "daily", "complete")


@query("""SELECT field, count(*) AS n FROM (SELECT unnest(regexp_extract_all(props, '"([^"]+)"\\s*:', 1)) AS field FROM events) GROUP BY field""")
def stream_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run(S.learn_fields(events(spark, sf_dir), "props"), "dictionary", "complete")


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'block' WHEN 'purchase' THEN 'capture' WHEN 'signup' THEN 'snapshot' WHEN 'click' THEN 'allow' ELSE 'inject' END AS action FROM events""")
def lifecycle_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.routed(table(spark, sf_dir, "events")).select("event_id", "action")


@query("SELECT conv_id AS id, CAST(NULL AS VARCHAR) AS error, turn, role, text FROM conversations")
def envelope_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.load(V.export(table(spark, sf_dir, "conversations"), "conv_id", "turn"))


@query("""SELECT conv_id, 'm' AS model, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY role <> 'system', turn) - 1 AS INT) AS pos, role, text AS content FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) WHERE role <> 'system' OR k = 1""")
def request_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of request bodies; a system text comes separately, before the others."""
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.when(F.col("role") != "system", F.struct("turn", "role", "text"))))
    body = c.groupBy("conv_id").agg(turns.alias("t"), F.min_by(F.when(F.col("role") == "system", F.col("text")), F.when(F.col("role") == "system", F.col("turn"))).alias("system"))
    json = F.to_json(F.struct(F.lit("m").alias("model"), "system", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    return R.request_messages(body.select("conv_id", json.alias("body")), "conv_id", "body")


@query("""SELECT page_id, '[' || CASE WHEN page_id % 2 = 0 THEN 'user interface' ELSE 'image' END || ': p' || page_id || '.png, ' || strlen(html) || ' bytes]' AS description, CAST(greatest(floor(strlen(html) / 4), 1) AS BIGINT) AS tokens FROM pages""")
def image_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("name", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".png")))
    text, tokens = R.describe_image(F.col("name"), F.when(F.col("page_id") % 2 == 0, "a screenshot").otherwise("a photo"), F.octet_length("html"))
    return p.select("page_id", text.alias("description"), tokens.alias("tokens"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return T.latest(e.select("user_id", "at", "event_id", "event_type"), ["user_id"], "at").select("user_id", "event_id", "event_type")


@query("""SELECT page_id, url FROM pages WHERE page_id % 48 < 24""")
def url_cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fetched, as their number says, less than 24 hours before a given time."""
    now = F.to_timestamp(F.lit("2024-01-03 00:00:00"))
    p = table(spark, sf_dir, "pages").withColumn("fetched", F.timestamp_seconds(F.unix_timestamp(now) - (F.col("page_id") % 48) * 3600))
    return T.fresh(p, "fetched", now, 86400).select("page_id", "url")
