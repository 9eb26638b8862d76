"""Retrieval: BM25, substrings, rank fusion, snippets, fuzzy terms, TF-IDF selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import terms

#: Our own choice of BM25's constants, the usual ones.
K1, B = 1.2, 0.75


def bm25(df: DataFrame, key: str, text: str, query: list[str], every: bool = True) -> DataFrame:
    """Scores of texts that hold every (or any) query term. Term counts are taken within a row, so only matching rows move;
    document frequencies and the mean length are one small aggregate."""
    t = terms(F.col(text))
    count = lambda q: F.size(F.filter(F.col("t"), lambda x: x == q))
    tf = F.array(*map(count, query))
    rows = df.select(key, t.alias("t")).select(key, F.size("t").alias("len"), tf.alias("tf"))
    stats = rows.agg(F.count("*").alias("N"), F.avg("len").alias("avg_len"), *(F.count_if(F.get("tf", F.lit(i)) > 0).alias(f"df{i}") for i in range(len(query))))
    x = rows.join(F.broadcast(stats))  # one row
    parts = []
    for i in range(len(query)):
        f, d = F.get("tf", F.lit(i)), F.col(f"df{i}")
        idf = F.log(1 + (F.col("N") - d + 0.5) / (d + 0.5))
        parts.append(idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))))
    hits = F.size(F.filter("tf", lambda n: n > 0))
    return x.filter(hits == len(query) if every else hits > 0).select(key, F.round(sum(parts[1:], parts[0]), 6).alias("score"))


def substring_rank(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """Texts that hold the query in any case, by how often for their length."""
    low = F.lower(text)
    n = (F.length(low) - F.length(F.replace(low, F.lit(query.lower()), F.lit("")))) / len(query)
    return df.filter(F.contains(low, F.lit(query.lower()))).select(key, F.round(n / F.length(low), 9).alias("score"))


def ranked(scores: DataFrame, key: str, k: int) -> DataFrame:
    """The k best with their ranks from 0. The limit comes first, so ranks are given to k rows."""
    top = scores.orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)) - 1)


def fuse(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion."""
    every = lists[0].select(key, "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select(key, "rank"))
    return every.groupBy(key).agg(F.round(F.sum(1.0 / (k + F.col("rank") + 1)), 9).alias("score"))


def proximity(text: Column, query: list[str], score: Column) -> Column:
    """A score raised where the terms' first places are near each other."""
    low = F.lower(text)
    at = F.filter(F.array(*(F.instr(low, q) for q in query)), lambda p: p > 0)
    span = F.array_max(at) - F.array_min(at)
    return F.when(F.size(at) > 1, score * (1 + 1 / (1 + span / 50.0))).otherwise(score)


def snippet(text: Column, query: list[str], around: int = 80) -> Column:
    """Text around the earliest query term."""
    low = F.lower(text)
    first = F.array_min(F.filter(F.array(*(F.instr(low, q) for q in query)), lambda p: p > 0))
    start = F.greatest(first - around, F.lit(1))
    end = first + around
    return F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, end - start), F.when(end <= F.length(text), "…").otherwise(""))


def vocabulary(df: DataFrame, key: str, text: str, k: int | None = 100) -> DataFrame:
    """The k terms in most texts, or all terms, in no order."""
    ex = df.select(key, F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
    counts = ex.groupBy("term").agg(F.count("*").alias("docs"))
    return counts if k is None else counts.orderBy(F.desc("docs"), "term").limit(k)


def nearest_terms(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """For each query term, the vocabulary's nearest within two edits. Lengths differ by two at most, so the join is on the length."""
    bands = queries.withColumn("n", F.explode(F.array(*(F.length("q") + i for i in range(-2, 3)))))
    pairs = bands.join(vocab.withColumn("n", F.length("term")), "n").withColumn("d", F.levenshtein("q", "term")).filter("d between 1 and 2")
    best = pairs.groupBy("q").agg(F.min(F.struct("d", F.col("term"))).alias("m"))
    return best.select("q", "m.term", F.col("m.d").alias("distance"))


def tfidf_select(docs: DataFrame, key: str, intents: DataFrame, intent: str, text: str = "text") -> DataFrame:
    """For each intent, the documents by TF-IDF cosine. Vectors are long-form (id, term, weight) and meet on the term."""
    def vectors(df: DataFrame, k: str) -> DataFrame:
        return df.select(F.col(k), F.explode(terms(F.col(text))).alias("term")).groupBy(k, "term").agg(F.count("*").alias("tf"))

    dv = vectors(docs, key)
    n = docs.agg(F.count("*").alias("N"))
    idf = dv.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", F.log(F.col("N") / F.col("df")).alias("idf"))
    dw = dv.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("dw"))
    iw = vectors(intents, intent).join(idf, "term").select(intent, "term", (F.col("tf") * F.col("idf")).alias("iw"))
    dn = dw.groupBy(key).agg(F.sqrt(F.sum(F.col("dw") * F.col("dw"))).alias("dn"))
    in_ = iw.groupBy(intent).agg(F.sqrt(F.sum(F.col("iw") * F.col("iw"))).alias("inorm"))
    dots = iw.join(dw, "term").groupBy(intent, key).agg(F.sum(F.col("iw") * F.col("dw")).alias("dot"))
    cos = dots.join(dn, key).join(in_, intent).filter("dn > 0 and inorm > 0").select(intent, key, F.round(F.col("dot") / (F.col("dn") * F.col("inorm")), 6).alias("score"))
    return cos.withColumn("r", F.row_number().over(W.partitionBy(intent).orderBy(F.desc("score"), key))).filter("r <= 5").drop("r")
