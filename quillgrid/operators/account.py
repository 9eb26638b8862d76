"""Token, cost and budget accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def saved(before: Column, after: Column) -> Column:
    return F.greatest(before - after, F.lit(0))


def totals(df: DataFrame, group: list[str], before: str, after: str) -> DataFrame:
    """Count, tokens before and after, saved (never negative) and the reduction in percent."""
    out = df.groupBy(*group).agg(F.count("*").alias("n"), F.coalesce(F.sum(before), F.lit(0)).cast("long").alias("tokens_in"), F.coalesce(F.sum(after), F.lit(0)).cast("long").alias("tokens_out"))
    return out.withColumn("saved", saved(F.col("tokens_in"), F.col("tokens_out"))).withColumn("reduction", F.when(F.col("tokens_in") == 0, 0.0).otherwise(F.round(100.0 * F.col("saved") / F.col("tokens_in"), 6)))


def gain_bars(daily: DataFrame, value: str, width: int = 30) -> DataFrame:
    """A bar for each row, scaled to the largest; the maximum is one small aggregate, not a window over everything."""
    most = daily.agg(F.max(value).alias("most"))
    return daily.join(F.broadcast(most)).withColumn("bar", F.repeat(F.lit("█"), F.floor(F.col(value) * width / F.greatest("most", F.lit(1))).cast("int"))).drop("most")


def idle_days(df: DataFrame, group: str, day: str) -> DataFrame:
    """Days between a group's first and last on which it has no row."""
    span = df.groupBy(group).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    calendar = span.select(group, F.explode(F.sequence("a", "b")).alias(day))
    return calendar.join(df.select(group, day).distinct(), [group, day], "left_anti")


# Dollars per million tokens in and out, and the discount on cached ones.
PRICES = (("sonnet", 3.0, 15.0, 0.9), ("gpt", 2.5, 10.0, 0.5), ("gemini", 1.25, 5.0, 0.75))


def with_cost(df: DataFrame, model: str, tokens_in: str, tokens_out: str, cached: str) -> DataFrame:
    """Cost and cache savings by a broadcast dimension of a few rows; unknown models cost nothing."""
    prices = df.sparkSession.createDataFrame(PRICES, f"{model} string, r_in double, r_out double, discount double")
    x = df.join(F.broadcast(prices), model, "left")
    rate = lambda c: F.coalesce(c, F.lit(0.0))
    cost = (F.col(tokens_in) * rate("r_in") + F.col(tokens_out) * rate("r_out") + F.col(cached) * rate("r_in") * (1 - rate("discount"))) / 1e6
    return x.withColumn("cost", cost).withColumn("cache_saved", F.col(cached) * rate("r_in") * rate("discount") / 1e6).drop("r_in", "r_out", "discount")


def budget(df: DataFrame, group: list[str], order: list[str], tokens: str, window: int) -> DataFrame:
    """Running use of a token budget, what is left, and the row that crosses 70 and 85 percent."""
    w = W.partitionBy(*group).orderBy(*order)
    x = df.withColumn("used", F.sum(tokens).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long"))
    before = F.coalesce(F.lag("used").over(w), F.lit(0))
    crossed = lambda p: (before < window * p / 100) & (F.col("used") >= window * p / 100)
    return x.withColumn("available", F.greatest(F.lit(window) - F.col("used"), F.lit(0)).cast("long")).withColumn("crossed_70", crossed(70)).withColumn("crossed_85", crossed(85))


def throttle(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """normal for the first three equal calls, reduced up to eight, then blocked."""
    n = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("level", F.when(n <= 3, "normal").when(n <= 8, "reduced").otherwise("blocked"))
