"""What a context already holds: known files, pinned turns, corrections, and statistics of compacted requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_estimate

#: Fixed: the forms in which an error names a file, and the note that the file is known.
LOCATION = r"(?:--> ([^\s:]+)|\bat ([^\s:]+):)"
NOTE = " [in context]"


def named_paths(text: Column) -> Column:
    """The distinct paths that a text gives as error locations."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(LOCATION), F.lit(g)) for g in (1, 2)))
    return F.filter(F.array_distinct(found), lambda p: p != "")


def known_file_refs(df: DataFrame, key: str, text: str, known: DataFrame, path: str) -> DataFrame:
    """Texts in which error locations of known files carry a note.

    Paths are read from the texts and joined by equality, so neither side is held in one place. Of a path only the distinct
    names are looked up, so that a path that a third of the texts name is one row of the join to the known ones; texts come back
    by ``key``, which must be unique. Null texts stay null."""
    rows = df.select(key, F.col(text).alias("__t"))
    named = rows.select(key, F.explode(named_paths(F.col("__t"))).alias("__p"))
    held = named.select("__p").distinct().join(known.select(F.col(path).alias("__p")), "__p", "left_semi")
    # The hot name is dealt over shares, each with its own copy of the names held.
    shares = 8
    dealt = named.withColumn("__s", F.pmod(F.xxhash64(key), F.lit(shares)).cast("int"))
    met = dealt.join(held.withColumn("__s", F.explode(F.array(*map(F.lit, range(shares))))), ["__p", "__s"]).groupBy(key).agg(F.collect_set("__p").alias("__ps"))
    quoted = lambda p: F.concat(F.lit("\\Q"), p, F.lit("\\E"))

    def noted(t: Column, p: Column) -> Column:
        arrows = F.regexp_replace(t, F.concat(F.lit("(--> "), quoted(p), F.lit(r")(?=[\s:]|$)")), F.lit("$1" + NOTE))
        return F.regexp_replace(arrows, F.concat(F.lit(r"(\bat "), quoted(p), F.lit(")(?=:)")), F.lit("$1" + NOTE))

    out = F.when(F.col("__ps").isNull(), F.col("__t")).otherwise(F.aggregate("__ps", F.col("__t"), noted))
    return rows.join(met, key, "left").select(key, out.alias("text"), F.coalesce(F.size("__ps"), F.lit(0)).alias("files"))


def pinned_turns(turns: DataFrame, log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``turns`` with ``pinned``, ``reason`` and ``eligible`` for compaction. ``log`` has pin and unpin actions (``action``, ``reason``);
    the last one of a turn counts, and one for a turn that isn't there is ignored."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct("action", "reason"), F.struct(*order)).alias("__last"))
    pinned = F.coalesce(F.col("__last.action") == "pin", F.lit(False))
    return turns.join(last, keys, "left").withColumn("pinned", pinned).withColumn("eligible", ~pinned).withColumn("reason", F.when(pinned, F.col("__last.reason"))).drop("__last")


def replay(turns: DataFrame, corrections: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """A context's entries with its corrections appended in their order: ``position`` is (0, turn) or (1, correction)."""
    of = lambda df, n: df.select(group, F.lit(n).alias("part"), F.col(order).alias("place"), F.col(text).alias("text"))
    return of(turns, 0).unionByName(of(corrections, 1))


def proxy_stats(messages: DataFrame, group: list[str], role: Column, before: str, after: str, summarised: Column) -> DataFrame:
    """Tokens before and after, messages changed and summarised, and what system and tool messages save, for each request."""
    b, a = token_estimate(F.coalesce(F.col(before), F.lit(""))), token_estimate(F.coalesce(F.col(after), F.lit("")))
    less = F.greatest(b - a, F.lit(0))
    of = lambda name: F.coalesce(F.sum(F.when(role == name, less)), F.lit(0)).cast("long")
    out = messages.groupBy(*group).agg(
        F.sum(b).alias("tokens_original"), F.sum(a).alias("tokens_compacted"), F.count_if(~F.col(before).eqNullSafe(F.col(after))).alias("messages_compacted"),
        F.count_if(summarised).alias("messages_summarised"), of("system").alias("system_tokens_saved"), of("tool").alias("tool_tokens_saved"),
    )
    saved = F.greatest(F.col("tokens_original") - F.col("tokens_compacted"), F.lit(0))
    return out.withColumn("tokens_saved", saved).withColumn("reduction", F.when(F.col("tokens_original") == 0, 0.0).otherwise(F.round((1 - F.col("tokens_compacted") / F.col("tokens_original")) * 100, 6)))
