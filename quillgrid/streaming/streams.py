"""Stateful operators over streams. Each has a batch twin with the same result, which the tests compare."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

from ..sources.store import shared_folder

Step = Callable[[tuple, pd.DataFrame], tuple[tuple, dict]]


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events as a stream, with micros of their time; a watermark bounds state of windows."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # As a pattern that only this path matches: a stream's plain path must be a folder, and a table may be a single file.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, kind: str, mode: str = "append", trigger: dict | None = None) -> DataFrame:
    """Run what is there now (or by another trigger) into a table of the shared folder, and read that.

    Complete results replace the table's one version of each batch; appended ones add to it.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, kind)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={n if mode == 'append' else 0}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/table").drop("batch")


def keyed(stream: DataFrame, keys: list[str], state: str, start: tuple, step: Step, out: str) -> DataFrame:
    """A keyed state machine: a batch's rows of a key, in order of time, go through ``step(state, rows)``."""

    def f(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["micros", "event_id"], ignore_index=True)
        new, columns = step(held.get if held.exists else start, rows)
        held.update(new)
        yield pd.DataFrame(columns)

    return stream.groupBy(*keys).applyInPandasWithState(f, out, state, "append", GroupStateTimeout.NoTimeout)


def dedup(stream: DataFrame, ttl_seconds: int) -> DataFrame:
    """fresh, ref or resend of each look-up, with a time to live that every look-up renews."""

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, dict]:
        last, out = state[0], []
        for t in rows["micros"]:
            out.append("fresh" if last is None or last < 0 else "ref" if t - last < ttl_seconds * 1_000_000 else "resend")
            last = t
        return (int(last),), {"event_id": rows["event_id"], "outcome": out}

    return keyed(stream, ["user_id", "event_type"], "last long", (-1,), step, "event_id long, outcome string")


def invalidating(stream: DataFrame, control: str) -> DataFrame:
    """ref if the same content came since the user's last control event, else fresh; control events clear what is known."""

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, dict]:
        known, out = set(state[0] or []), []
        for kind in rows["event_type"]:
            if kind == control:
                known = set()
                out.append("control")
            else:
                out.append("ref" if kind in known else "fresh")
                known.add(kind)
        return (sorted(known),), {"event_id": rows["event_id"], "outcome": out}

    return keyed(stream, ["user_id"], "known array<string>", ([],), step, "event_id long, outcome string")


def numbered(stream: DataFrame, kind: str, keys: list[str], trigger: dict | None = None) -> DataFrame:
    """Number of each event among those of its keys, in order of time and over all batches, as a table of the shared folder.

    Where keys are about as many as events, a Python call for each key takes most of the time, so numbers are a window over the batch,
    and what came before is a table of counts: each batch adds its own, and each sixteenth the sums of all so far.
    """
    folder, every = shared_folder(stream.sparkSession, kind), 16

    def write(batch: DataFrame, n: int) -> None:
        w = W.partitionBy(*keys).orderBy(F.asc_nulls_last("micros"), F.asc_nulls_last("event_id"))
        rows, counts = batch.select(*keys, "event_id", F.row_number().over(w).cast("long").alias("number")), batch.groupBy(*keys).agg(F.count("*").alias("n"))
        if n:
            held = batch.sparkSession.read.parquet(f"{folder}/counts").filter(F.col("batch").between(n // every * every - 1, n - 1)).drop("batch")
            before = held.groupBy(*keys).agg(F.sum("n").alias("before"))
            same = [rows[k].eqNullSafe(before[k]) for k in keys]
            rows = rows.join(before, same, "left").select("event_id", (F.col("number") + F.coalesce("before", F.lit(0))).alias("number"))
            if n % every == every - 1:
                counts = held.unionByName(counts).groupBy(*keys).agg(F.sum("n").alias("n"))
        rows.select("event_id", "number").write.mode("overwrite").parquet(f"{folder}/table/batch={n}")
        counts.write.mode("overwrite").parquet(f"{folder}/counts/batch={n}")

    q = stream.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/table").drop("batch")


def throttle(stream: DataFrame, normal: int = 3, reduced: int = 8, trigger: dict | None = None) -> DataFrame:
    n = F.col("number")
    level = F.when(n <= normal, "normal").when(n <= reduced, "reduced").otherwise("blocked")
    return numbered(stream, "throttle", ["event_type", "user_id", "day"], trigger).select("event_id", level.alias("level"))


def budget(stream: DataFrame, window: int, percent: int = 70) -> DataFrame:
    """Running use of a budget, and the event that crosses the threshold, once."""

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, dict]:
        used, totals, crossed = state[0], [], []
        for v in rows["value"]:
            before, used = used, used + int(v)
            totals.append(used)
            crossed.append(before < window * percent / 100 <= used)
        return (used,), {"event_id": rows["event_id"], "used": totals, "crossed": crossed}

    return keyed(stream, ["user_id"], "used long", (0,), step, "event_id long, used long, crossed boolean")


def regret(stream: DataFrame) -> DataFrame:
    """Confidence in each kind after each event, clamped between 0.1 and 1."""

    def step(state: tuple, rows: pd.DataFrame) -> tuple[tuple, dict]:
        x, out = state[0], []
        for v in rows["value"]:
            x = min(1.0, max(0.1, x + (-0.075 if v < 20 else -0.15 if v < 50 else 0.02)))
            out.append(round(x, 6))
        return (x,), {"event_id": rows["event_id"], "confidence": out}

    return keyed(stream, ["event_type"], "x double", (1.0,), step, "event_id long, confidence double")


def daily(stream: DataFrame) -> DataFrame:
    """Tumbling daily sums; late data within a day still count."""
    w = stream.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w"))
    return w.agg(F.count("*").alias("n"), F.sum(F.floor("value")).cast("long").alias("saved")).select(F.to_date("w.start").alias("day"), "n", "saved")


def learn_fields(stream: DataFrame, text: str) -> DataFrame:
    """Field names and how often they occur, kept up to date as a complete result."""
    from ..operators.jsonops import field_names

    return stream.select(F.explode(field_names(F.col(text))).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


ROUTES = {"error": "block", "purchase": "capture", "signup": "snapshot", "click": "allow"}


def routed(events: DataFrame) -> DataFrame:
    """What each event type sets off; works on batches and streams alike."""
    out = F.lit("inject")
    for kind, action in ROUTES.items():
        out = F.when(F.col("event_type") == kind, action).otherwise(out)
    return events.withColumn("action", out)
