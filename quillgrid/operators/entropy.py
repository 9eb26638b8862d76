"""Entropy scoring, selection under budgets, ranking of contexts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window as W

from ..functions.text import let, lines


def _of_counts(counts: np.ndarray, total: int) -> float:
    p = counts[counts > 0] / total
    return float(-(p * np.log2(p)).sum())


@F.pandas_udf(DoubleType())
def byte_entropy_of(texts: pd.Series) -> pd.Series:
    """Entropy of bytes. A row for each byte would multiply the rows a thousandfold, so counting is a vectorised UDF."""
    return texts.map(lambda t: _of_counts(np.bincount(np.frombuffer(t.encode(), dtype=np.uint8)), len(t.encode())) if t else 0.0)


@F.pandas_udf(DoubleType())
def char_entropy_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _of_counts(np.unique(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32), return_counts=True)[1], len(t.encode())) if t else 0.0)


def byte_entropy(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Shannon entropy of each text's bytes, 0 if it is null or empty."""
    return df.select(key, byte_entropy_of(text).alias("entropy"))


def char_entropy(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Entropy of a text's characters, with the number of bytes as the total: the shares of non-ASCII texts don't sum to 1.
    0 if the text is null or empty."""
    return df.select(key, char_entropy_of(text).alias("entropy"))


def quality_metrics(tokens: Column, size: Column, entropy: Column) -> tuple[Column, Column, Column]:
    """Least tokens by entropy, efficiency and grade."""
    least = F.least(F.ceil(entropy * size / 32).cast("long"), tokens)
    efficiency = F.when(tokens == 0, 1.0).otherwise(least / tokens)
    grade = F.when(efficiency >= 0.9, "A").when(efficiency >= 0.7, "B").when(efficiency >= 0.5, "C").otherwise("D")
    return least, efficiency, grade


def blocks(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Blocks between blank lines, with their first and last line's number."""
    ex = df.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line"))
    blank = F.trim("line") == ""
    ex = ex.withColumn("block", F.sum(blank.cast("int")).over(W.partitionBy(key).orderBy("pos"))).filter(~blank)
    out = ex.groupBy(key, "block").agg((F.min("pos") + 1).alias("start_line"), (F.max("pos") + 1).alias("end_line"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    return out.select(key, "block", "start_line", "end_line", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))


def nearest_rank(df: DataFrame, group: list[str], value: str, order: list[str], percents: tuple[int, ...]) -> DataFrame:
    """Values at nearest ranks: index round(p / 100 * (n - 1)) of the sorted values of each group."""
    w = W.partitionBy(*group)
    ranked = df.withColumn("__i", F.row_number().over(w.orderBy(value, *order)) - 1).withColumn("__n", F.count("*").over(w))
    return ranked.groupBy(*group).agg(*(F.max(F.when(F.col("__i") == F.floor(F.lit(p / 100) * (F.col("__n") - 1) + 0.5), F.col(value))).alias(f"p{p}") for p in percents))


def chunked(df: DataFrame, key: str, text: str = "text", size: int = 10) -> DataFrame:
    """Segments of a text: at blank lines if it has them, else of ten lines."""
    paragraphs = F.filter(F.split(text, "\n\n"), lambda x: F.trim(x) != "")
    tens = let(lines(F.col(text)), lambda ls: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(ls) - 1) / size), F.lit(0)).cast("int")), lambda i: F.array_join(F.slice(ls, i * size + 1, size), "\n")))
    return df.select(key, F.posexplode(F.when(F.contains(F.col(text), F.lit("\n\n")), paragraphs).otherwise(tens)).alias("pos", "segment"))


def keep_by_entropy(scored: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Segments with at least the median entropy, or short ones, and at least ``least`` of each text."""
    w = W.partitionBy(key)
    x = scored.withColumn("median", F.median("entropy").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("entropy"), "pos")))
    return x.withColumn("kept", (F.col("entropy") >= F.col("median")) | (F.octet_length("segment") < 20) | (F.col("rank") <= least))


def reorder_edges(df: DataFrame, group: list[str], priority: str, order: list[str]) -> DataFrame:
    """Positions that put high priorities at both ends: even ranks in front, odd ranks from the back."""
    w = W.partitionBy(*group)
    x = df.withColumn("rank", F.row_number().over(w.orderBy(F.desc(priority), *order)) - 1).withColumn("n", F.count("*").over(w))
    half = F.floor(F.col("rank") / 2)
    return x.withColumn("position", F.when(F.col("rank") % 2 == 0, half).otherwise(F.col("n") - 1 - half).cast("long")).drop("rank", "n")


def evict(df: DataFrame, group: list[str], last: str, count: str, order: list[str], now: Column, ratio: float = 0.3, keep: int = 5, pinned: Column | None = None) -> DataFrame:
    """Marks contexts to evict: the lowest scores of recency and use, never pinned ones, and never below ``keep``."""
    score = 0.7 * F.exp(-(now - F.col(last)) / 30.0) + 0.3 * F.least(F.lit(1.0), F.log(F.col(count) + 1.0) / F.log(F.lit(5.0)))
    w = W.partitionBy(*group)
    free = ~(pinned if pinned is not None else F.lit(False))
    x = df.withColumn("score", F.round(score, 9)).withColumn("n", F.count("*").over(w)).withColumn("free", free)
    x = x.withColumn("rank", F.row_number().over(W.partitionBy(*group, "free").orderBy("score", *order)))
    most = F.least(F.ceil(F.col("n") * ratio), F.greatest(F.col("n") - keep, F.lit(0)))
    return x.withColumn("evicted", F.col("free") & (F.col("rank") <= most)).drop("n", "rank", "free")


def within_budget(df: DataFrame, group: list[str], size: str, order: list, budget: int) -> DataFrame:
    """Rows in order while their sizes' sum stays within the budget."""
    total = F.sum(size).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("used", total).filter(F.col("used") <= budget)


def complexity(tokens: Column, files: Column, code: Column) -> Column:
    return F.least(tokens / 10000.0, F.lit(0.5)) + F.least(0.1 * files, F.lit(0.3)) + F.when(code, 0.1).otherwise(0.0)


def cache_boundary(df: DataFrame, group: list[str], order: list[str], text: str, limit: int = 4096) -> DataFrame:
    """Cumulative bytes before and after each turn, and whether the prefix of ``limit`` bytes ends in it."""
    end = F.sum(F.octet_length(text)).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("end_bytes", end).withColumn("start_bytes", F.col("end_bytes") - F.octet_length(text)).withColumn("holds_boundary", (F.col("start_bytes") < limit) & (F.col("end_bytes") >= limit))


def should_evict(used: Column, ceiling: Column, threshold: float = 0.7) -> Column:
    """Whether a context's use has reached the threshold's share of its ceiling; never without a ceiling."""
    return F.when(ceiling == 0, False).otherwise(used / ceiling >= threshold)


def previewed(df: DataFrame, tokens: str, over: int = 500) -> DataFrame:
    """Rows whose text is long enough to be worth a preview."""
    return df.filter(F.col(tokens) > over)
