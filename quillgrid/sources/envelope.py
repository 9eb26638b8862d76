"""A versioned JSON envelope for sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "1.0"
SCHEMA = "version string, format string, session struct<id bigint, turns array<struct<turn bigint, role string, text string>>>, _corrupt_record string"


def export(turns: DataFrame, session: str, order: str) -> DataFrame:
    """session, envelope: a JSON text for each session."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("turn"), "role", "text")))
    body = turns.groupBy(session).agg(ordered.alias("turns"))
    return body.select(session, F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit("session").alias("format"), F.struct(F.col(session).cast("bigint").alias("id"), "turns").alias("session"))).alias("envelope"))


def load(envelopes: DataFrame, column: str = "envelope") -> DataFrame:
    """The sessions' turns; ``error`` says what is wrong with an envelope, and a newer version is a warning."""
    e = envelopes.withColumn("e", F.from_json(column, SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    error = F.when(F.col("e._corrupt_record").isNotNull(), "no valid JSON").when(F.col("e.session").isNull(), "no session").when(F.col("e.version") > VERSION, "a newer version")
    return e.select(F.col("e.session.id").alias("id"), error.alias("error"), F.explode_outer("e.session.turns").alias("t")).select("id", "error", "t.*")
