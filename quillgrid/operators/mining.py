"""Word n-grams, phrase dictionaries, sentence ranking and other per-text mining."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import let, words

# Frequent word triples and their counts.
TRIGRAMS = (
    ("in", "the", "same", 80), ("in", "the", "following", 75), ("of", "the", "same", 70), ("on", "the", "other", 65), ("at", "the", "same", 60),
    ("to", "the", "same", 55), ("is", "a", "function", 50), ("is", "a", "method", 48), ("is", "a", "type", 45), ("is", "the", "same", 70),
    ("as", "a", "result", 60), ("this", "is", "a", 90), ("this", "is", "the", 85), ("this", "is", "an", 80), ("it", "is", "a", 85),
    ("it", "is", "the", 80), ("it", "is", "not", 75), ("there", "is", "a", 80), ("there", "is", "no", 75), ("there", "are", "no", 70),
    ("that", "is", "a", 75), ("that", "is", "the", 70), ("which", "is", "a", 70), ("which", "is", "the", 65), ("error", "in", "the", 60),
    ("failed", "to", "connect", 55), ("failed", "to", "open", 50), ("failed", "to", "read", 50), ("unable", "to", "find", 55),
    ("unable", "to", "open", 50), ("could", "not", "find", 60), ("could", "not", "open", 55), ("does", "not", "exist", 65), ("is", "not", "a", 60),
    ("is", "not", "the", 55), ("for", "more", "information", 80), ("for", "more", "details", 75), ("see", "the", "documentation", 70),
    ("refer", "to", "the", 65), ("please", "refer", "to", 60), ("note", "that", "the", 55), ("note", "that", "this", 50), ("make", "sure", "that", 60),
    ("make", "sure", "to", 55), ("in", "order", "to", 90), ("as", "well", "as", 85), ("due", "to", "the", 70), ("based", "on", "the", 65),
    ("with", "respect", "to", 60), ("in", "addition", "to", 55), ("as", "opposed", "to", 50), ("on", "behalf", "of", 50),
)
# Short words that carry meaning.
TECHNICAL = ("null", "none", "true", "false", "void", "self", "this", "type", "enum", "impl", "func", "main", "test", "init", "open", "read", "send", "recv", "lock", "drop", "move", "copy", "sync", "push", "pull", "port", "host", "path", "file", "line", "code", "data", "node", "root", "hash", "size", "name", "list", "loop", "exit", "fail", "pass", "skip", "todo", "warn", "info", "http", "json", "yaml", "toml", "html", "rust", "java", "bash")


def exploded(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return df.select(key, F.posexplode(words(F.col(text))).alias("i", "word"))


def trigrams(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Counts of lower-case word triples. They are built within a row, so only counts are exchanged."""
    lower = F.transform(words(F.col(text)), lambda x: F.lower(x))
    grams = let(lower, lambda w: F.filter(F.transform(w, lambda x, i: F.slice(w, i + 1, 3)), lambda g: F.size(g) == 3))
    return df.select(F.explode(grams).alias("g")).groupBy(F.get("g", F.lit(0)).alias("w1"), F.get("g", F.lit(1)).alias("w2"), F.get("g", F.lit(2)).alias("w3")).agg(F.count("*").alias("n"))


def trigram_prune(df: DataFrame, key: str, text: str = "text", limit: float = 0.85) -> DataFrame:
    """Drops a word that the two before it predict better than ``limit``, by the fixed table, which is broadcast."""
    table = df.sparkSession.createDataFrame(TRIGRAMS, "w1 string, w2 string, w3 string, n int")
    p = table.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("w1", "w2"))).drop("n")
    w = W.partitionBy(key).orderBy("i")
    ex = exploded(df, key, text).withColumn("w1", F.lower(F.lag("word", 2).over(w))).withColumn("w2", F.lower(F.lag("word").over(w)))
    ex = ex.withColumn("w3", F.lower(F.regexp_replace("word", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    met = ex.join(F.broadcast(p), ["w1", "w2", "w3"], "left").withColumn("drop", F.coalesce("p", F.lit(0.0)) > limit)
    kept = F.array_sort(F.collect_list(F.when(~F.col("drop"), F.struct("i", "word"))))
    return met.groupBy(key).agg(F.array_join(F.transform(kept, lambda x: x["word"]), " ").alias("text"), F.count_if("drop").alias("removed"))


def zipf_redundant(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """How many words of each text go: short common ones that occur half again as often as their rank lets expect, but for the first."""
    counts = exploded(df, key, text).groupBy(key, F.lower("word").alias("lw")).agg(F.count("*").alias("n"))
    w = W.partitionBy(key)
    r = counts.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "lw"))).withColumn("total", F.sum("n").over(w))
    r = r.withColumn("hn", F.sum(F.round(1.0 / F.col("rank"), 12)).over(w))
    gone = (F.col("total") >= 10) & (F.col("n") > 1.5 * (F.col("total") / F.col("hn") / F.col("rank"))) & (F.octet_length("lw") <= 4) & ~F.col("lw").isin(*TECHNICAL)
    return r.groupBy(key).agg(F.sum(F.when(gone, F.col("n") - 1).otherwise(0)).cast("long").alias("removed"))


def ngrams(df: DataFrame, key: str, text: str = "text", low: int = 3, high: int = 8, least: int = 3, min_bytes: int = 10) -> DataFrame:
    """Word n-grams that recur, with the bytes that a four-byte code for them would save."""
    grams = let(words(F.col(text)), lambda w: F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.filter(F.transform(w, lambda x, i: F.when(i + n <= F.size(w), F.array_join(F.slice(w, i + 1, n), " "))), lambda g: g.isNotNull()))))
    counts = df.select(F.explode(grams).alias("gram")).filter(F.octet_length("gram") >= min_bytes).groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counts.withColumn("savings", ((F.col("n") - 1) * (F.octet_length("gram") - 4)).cast("long"))


def first_merge(df: DataFrame, key: str, text: str = "text", least: int = 3) -> DataFrame:
    """The commonest pair of neighbouring words of each text."""
    w = W.partitionBy(key).orderBy("i")
    pairs = exploded(df, key, text).withColumn("b", F.lead("word").over(w)).filter("b is not null")
    counts = pairs.groupBy(key, F.col("word").alias("a"), "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "a", "b")).alias("s"))
    return best.select(key, "s.a", "s.b", (-F.col("s.m")).alias("n"))


def merge_words(df: DataFrame, key: str, text: str = "text", most: int = 50, least: int = 3) -> DataFrame:
    @F.pandas_udf("merges int, symbols int")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts.fillna(""):
            seq, merges = t.split(), 0
            while merges < most:
                pairs = Counter(zip(seq, seq[1:], strict=False))
                if not pairs:
                    break
                (a, b), n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
                if n < least:
                    break
                merged, i = [], 0
                while i < len(seq):
                    if i + 1 < len(seq) and (seq[i], seq[i + 1]) == (a, b):
                        merged.append(f"{a} {b}")
                        i += 2
                    else:
                        merged.append(seq[i])
                        i += 1
                seq, merges = merged, merges + 1
            out.append((merges, len(seq)))
        return pd.DataFrame(out, columns=["merges", "symbols"])

    return df.select(key, run(text).alias("r")).select(key, "r.merges", "r.symbols")


def apply_legend(df: DataFrame, key: str, mined: DataFrame, most: int, text: str = "text") -> DataFrame:
    """Replaces each of the ``most`` best phrases after its first occurrence in a text. The legend is a top-k list, so broadcast."""
    legend = [r["gram"] for r in mined.orderBy(F.desc("savings"), "gram").limit(most).collect()]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            for n, phrase in enumerate(legend):
                at = t.find(phrase)
                if at >= 0:
                    cut = at + len(phrase)
                    t = t[:cut] + t[cut:].replace(phrase, f"§{n}")
            return t

        return texts.fillna("").map(one)

    return df.select(key, run(text).alias("text"))


def rank_sentences(sents: list[str], damping: float = 0.85, rounds: int = 50, eps: float = 1e-4) -> list[int]:
    """Places of the better half of sentences (two at least), in order."""
    sets = [{w for w in re.findall(r"[^\W_]+", s.lower()) if len(w.encode()) > 2} for s in sents]
    n = len(sents)
    if n <= 2:
        return list(range(n))
    vocabulary = {w: k for k, w in enumerate({w for s in sets for w in s})}
    has = np.zeros((n, max(1, len(vocabulary))), dtype=np.float32)
    for k, s in enumerate(sets):
        has[k, [vocabulary[w] for w in s]] = 1
    logs = np.array([math.log(len(s)) if s else 0.0 for s in sets])
    scale = logs[:, None] + logs[None, :]
    sim = np.divide(has @ has.T, scale, out=np.zeros((n, n)), where=scale > 0)
    np.fill_diagonal(sim, 0)
    out = sim.sum(axis=1)
    step = np.divide(sim, out[:, None], out=np.zeros_like(sim), where=out[:, None] > 0)
    rank = np.full(n, 1.0 / n)
    for _ in range(rounds):
        new = (1 - damping) / n + damping * (rank @ step)
        done = np.abs(new - rank).max() < eps
        rank = new
        if done:
            break
    keep = max(2, math.ceil(n / 2))
    return sorted(sorted(range(n), key=lambda k: (-round(rank[k], 9), k))[:keep])


def textrank(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            sents = [s for s in re.split(r"(?<=[.!?])[ \n]", t) if len(s.split()) >= 3]
            return " ".join(sents[k] for k in rank_sentences(sents)) if sents else t

        return texts.fillna("").map(one)

    return df.select(key, run(text).alias("text"))


def prune_tree(df: DataFrame, key: str, budget: int, text: str = "text") -> DataFrame:
    """Removes a text's sentences, the least important (mean of 1 / word frequency) first, until it has at most ``budget`` tokens."""

    @F.pandas_udf("kept int, tokens int")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts.fillna(""):
            sents = [s for s in re.split(r"(?<=[.!?])\s+", t) if s]
            counts = Counter(w for s in sents for w in s.lower().split())
            score = [sum(1 / counts[w] for w in s.lower().split()) / max(1, len(s.split())) for s in sents]
            tokens = [-(-len(s.encode()) // 4) for s in sents]
            left, total = set(range(len(sents))), sum(tokens)
            for k in sorted(left, key=lambda k: (round(score[k], 9), k)):
                if total <= budget or len(left) == 1:
                    break
                left.remove(k)
                total -= tokens[k]
            out.append((len(left), total))
        return pd.DataFrame(out, columns=["kept", "tokens"])

    return df.select(key, run(text).alias("r")).select(key, "r.kept", "r.tokens")


def stages(tokens: Column, repetition: Column, long: Column) -> Column:
    """Names of the stages worth their overhead, by net benefit."""
    options = [("ansi_strip", F.lit(1000000.0), F.lit(True)), ("condense", tokens * 0.15 - 2, repetition), ("run_length", tokens * 0.2 - 3, repetition), ("entropy_truncate", tokens * 0.1 - 5, long)]
    rows = F.array(*(F.struct((-net).alias("net"), F.lit(name).alias("name"), ok.alias("ok")) for name, net, ok in options))
    return F.array_join(F.transform(F.array_sort(F.filter(rows, lambda x: x["ok"] & (x["net"] < 0))), lambda x: x["name"]), ",")


def regret(events: DataFrame, kind: str, order: str) -> DataFrame:
    """A clamped running value is sequential, so each kind's outcomes are folded in order: blocks of outcomes compose to a function
    ``x -> min(max(x + add, low), high)``, and blocks to one another, so no task needs more than a block."""
    step = F.when(F.col("value") < 20, -0.075).when(F.col("value") < 50, -0.15).otherwise(0.02)
    block = F.floor(F.col(order) / 4096)

    def fold(xs: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("add"), F.lit(0.1).alias("low"), F.lit(1.0).alias("high"))
        clamp = lambda v: F.least(F.greatest(v, F.lit(0.1)), F.lit(1.0))
        return F.aggregate(xs, start, lambda a, x: F.struct((a["add"] + x["add"]).alias("add"), clamp(F.least(F.greatest(a["low"] + x["add"], x["low"]), x["high"])).alias("low"), clamp(F.least(F.greatest(a["high"] + x["add"], x["low"]), x["high"])).alias("high")))

    one = F.struct(step.alias("add"), F.lit(0.1).alias("low"), F.lit(1.0).alias("high"))
    ordered = lambda k, v: F.transform(F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), v.alias("v")))), lambda x: x["v"])
    blocks = events.groupBy(kind, block.alias("b")).agg(fold(ordered(order, one)).alias("f"))
    total = blocks.groupBy(kind).agg(fold(ordered("b", F.col("f"))).alias("f"))
    return total.select(kind, F.round(F.least(F.greatest(F.lit(1.0) + F.col("f.add"), F.col("f.low")), F.col("f.high")), 6).alias("confidence"))
