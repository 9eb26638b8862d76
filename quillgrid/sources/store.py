"""Tables and folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name in spark.checkpoint.dir; in a temporary folder where that is unset and Spark runs locally."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quillgrid-")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append facts, partitioned by date or the like so that later reads prune."""
    df.write.mode("append").partitionBy(*(by or [])).parquet(path)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row for each key, by an aggregate that combines before it moves anything."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def fresh(entries: DataFrame, at: str, now, ttl_seconds: int) -> DataFrame:
    """Entries younger than the time to live at ``now``."""
    return entries.filter(F.unix_timestamp(F.col(at).cast("timestamp")) > F.unix_timestamp(now) - ttl_seconds)


def tee(df: DataFrame, mode: str, exit_code: str, at: str, name: str) -> DataFrame:
    """Raw outputs to keep: always, failures or never; with an id of time and name, newest first on reading."""
    slug = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    kept = {"always": F.lit(True), "failures": F.col(exit_code) != 0, "never": F.lit(False)}[mode]
    return df.filter(kept).withColumn("tee_id", F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), slug))


def newest(df: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    w = W.partitionBy(*group).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")
