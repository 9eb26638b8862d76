"""Readers of texts, folders, images, and request bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold bulk rather than sources.
SKIPPED = ("node_modules", "target", "dist", "build", "__pycache__", "vendor")


def read_texts(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, text: a row for each file, read whole."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.decode("content", "UTF-8").alias("text"))


def list_files(spark: SparkSession, path: str, max_depth: int = 10) -> DataFrame:
    """path, bytes, modified of files below a folder, without hidden and bulk folders. Only the listing is read, not the contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    inner = F.regexp_replace(F.substring_index("path", path.rstrip("/"), -1), "^/", "")
    parts = F.split(inner, "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIPPED))
    return files.filter(~hidden & (F.size(parts) <= max_depth)).withColumn("name", inner)


def describe_image(name: Column, context: Column, size: Column) -> tuple[Column, Column]:
    """A text for an image, and the tokens the image would cost (a quarter of its bytes, one at least)."""
    ui = F.lower(F.concat_ws(" ", name, context)).rlike("screenshot|screen|button|dialog|form|menu|window|page")
    what = F.when(ui, "user interface").otherwise("image")
    return F.concat(F.lit("["), what, F.lit(": "), name, F.lit(", "), size.cast("string"), F.lit(" bytes]")), F.greatest(F.floor(size / 4), F.lit(1)).cast("long")


BODY = "model string, messages array<struct<role string, content string>>, system string, contents array<struct<role string, parts array<struct<text string>>>>"


def request_messages(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """key, model, pos, role, content of the messages in request bodies of either shape; a separate system text comes first."""
    b = bodies.withColumn("b", F.from_json(body, BODY))
    parts = F.transform(F.coalesce("b.contents", F.array().cast("array<struct<role string, parts array<struct<text string>>>>")), lambda c: F.struct(c["role"].alias("role"), F.array_join(F.transform(c["parts"], lambda p: p["text"]), "\n").alias("content")))
    empty = F.array().cast("array<struct<role string, content string>>")
    system = F.when(F.col("b.system").isNotNull(), F.array(F.struct(F.lit("system").alias("role"), F.col("b.system").alias("content")))).otherwise(empty)
    return b.select(key, F.col("b.model").alias("model"), F.posexplode(F.concat(system, F.coalesce("b.messages", empty), parts)).alias("pos", "m")).select(key, "model", "pos", "m.role", "m.content")
