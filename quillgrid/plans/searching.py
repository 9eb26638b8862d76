"""Queries over retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import table
from ..operators import search as S
from ..operators import textops as T
from ..registry import query
from .texts import CHUNKS


def terms_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def bm25_sql(name: str, src: str, key: str, text: str, qs: list[str], every: bool = True) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(qs))
    stats = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(qs)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.2) / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / al))" for i in range(len(qs)))
    cond = (" AND " if every else " OR ").join(f"tf{i} > 0" for i in range(len(qs)))
    return f"""{name}_r AS (SELECT {key}, len(t) AS dl, {tf} FROM (SELECT {key}, {terms_sql(text)} AS t FROM {src})), {name}_s AS (SELECT count(*) AS n, avg(dl) AS al, {stats} FROM {name}_r),
{name} AS (SELECT {key}, round({score}, 6)::DOUBLE AS score FROM {name}_r, {name}_s WHERE {cond})"""


QS = ["license", "mit"]


@query(f"WITH {bm25_sql('b', 'documents', 'doc_id', 'text', ['the', 'and'])} SELECT doc_id, score FROM b")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ["the", "and"])


@query(f"WITH {bm25_sql('b', 'documents', 'doc_id', 'text', QS, False)} SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 20")
def intent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best texts for any of the terms."""
    return S.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", QS, every=False).orderBy(F.desc("score"), "doc_id").limit(20)


SUB = "s AS (SELECT doc_id, round((length(lower(text)) - length(replace(lower(text), 'tion', ''))) / 4.0 / length(lower(text)), 9)::DOUBLE AS score FROM documents WHERE contains(lower(text), 'tion'))"


@query(f"WITH {SUB} SELECT doc_id, score FROM s")
def trigram_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.substring_rank(table(spark, sf_dir, "documents"), "doc_id", "text", "tion")


@query(f"""WITH {bm25_sql('b', 'documents', 'doc_id', 'text', ['the', 'and'])}, {SUB},
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM (SELECT * FROM b ORDER BY score DESC, doc_id LIMIT 50) UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 FROM (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 50))
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS score FROM r GROUP BY doc_id""")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    a = S.ranked(S.bm25(docs, "doc_id", "text", ["the", "and"]), "doc_id", 50)
    b = S.ranked(S.substring_rank(docs, "doc_id", "text", "tion"), "doc_id", 50)
    return S.fuse([a, b], "doc_id")


@query("""WITH p AS (SELECT doc_id, strpos(lower(text), 'the') AS a, strpos(lower(text), 'and') AS b FROM documents)
SELECT doc_id, round(CASE WHEN a > 0 AND b > 0 THEN 1 + 1 / (1 + abs(a - b) / 50.0) ELSE 1.0 END, 6)::DOUBLE AS score FROM p""")
def proximity_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.proximity(F.col("text"), ["the", "and"], F.lit(1.0)), 6).alias("score"))


@query("""WITH p AS (SELECT doc_id, text, strpos(lower(text), 'license') AS a, strpos(lower(text), 'copyright') AS b FROM documents),
q AS (SELECT doc_id, text, CASE WHEN a > 0 AND b > 0 THEN least(a, b) WHEN a > 0 THEN a ELSE b END AS f FROM p WHERE a > 0 OR b > 0)
SELECT doc_id, CASE WHEN f - 80 > 1 THEN '…' ELSE '' END || substr(text, greatest(f - 80, 1), f + 80 - greatest(f - 80, 1)) || CASE WHEN f + 80 <= length(text) THEN '…' ELSE '' END AS snippet FROM q""")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.lower("text").rlike("license|copyright"))
    return d.select("doc_id", S.snippet(F.col("text"), ["license", "copyright"]).alias("snippet"))


@query(f"""SELECT term, count(*) AS docs FROM (SELECT doc_id, unnest(list_distinct({terms_sql("text")})) AS term FROM documents) GROUP BY term ORDER BY docs DESC, term LIMIT 100""")
def vocab_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vocabulary(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def fuzzy_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all terms of the documents, of two characters at least, for the first word of each part's name."""
    vocab = S.vocabulary(table(spark, sf_dir, "documents"), "doc_id", "text", None).filter(F.length("term") >= 2).select("term")
    q = table(spark, sf_dir, "part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("q")).distinct()
    return S.nearest_terms(q, vocab)


@query(f"""WITH {CHUNKS}, c2 AS (SELECT page_id * 1000 + chunk AS cid, heading || ' ' || body AS text FROM chunks), {bm25_sql('b', 'c2', 'cid', 'text', ['the', 'of'])}
SELECT cid, score FROM b ORDER BY score DESC, cid LIMIT 20""")
def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = table(spark, sf_dir, "pages").select("page_id", T.html_to_markdown(F.col("html")).alias("text"))
    c = T.heading_chunks(md, "page_id", "text").select((F.col("page_id") * 1000 + F.col("chunk")).alias("cid"), F.concat("heading", F.lit(" "), "body").alias("text"))
    return S.bm25(c, "cid", "text", ["the", "of"]).orderBy(F.desc("score"), "cid").limit(20)


@query(f"""WITH dv AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({terms_sql("text")}) AS term FROM benchmark) GROUP BY item_id, term),
idf AS (SELECT term, ln((SELECT count(*) FROM benchmark) / count(*)::DOUBLE) AS idf FROM dv GROUP BY term),
dw AS (SELECT item_id, term, tf * idf AS w FROM dv JOIN idf USING (term)),
iv AS (SELECT iid, term, count(*) AS tf FROM (SELECT conv_id * 100 + turn AS iid, unnest({terms_sql("text")}) AS term FROM conversations WHERE role = 'user') GROUP BY iid, term),
iw AS (SELECT iid, term, tf * idf AS w FROM iv JOIN idf USING (term)),
dn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY item_id), inn AS (SELECT iid, sqrt(sum(w * w)) AS n FROM iw GROUP BY iid),
dots AS (SELECT iid, item_id, sum(iw.w * dw.w) AS dot FROM iw JOIN dw USING (term) GROUP BY iid, item_id),
c AS (SELECT iid, item_id, round(dot / (dn.n * inn.n), 6) AS score FROM dots JOIN dn USING (item_id) JOIN inn USING (iid) WHERE dn.n > 0 AND inn.n > 0)
SELECT iid, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, item_id) AS r FROM c) WHERE r <= 5""")
def tool_select_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    intents = table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("iid"), "text")
    return S.tfidf_select(table(spark, sf_dir, "benchmark"), "item_id", intents, "iid")


@query(f"""WITH d AS (SELECT item_id, list_distinct({terms_sql("text")}) AS w FROM benchmark), i AS (SELECT conv_id, list_distinct({terms_sql("text")}) AS w FROM conversations WHERE role = 'system'),
p AS (SELECT conv_id, item_id, len(list_intersect(i.w, d.w)) AS s, len(i.w) AS a, len(d.w) AS b FROM i, d), j AS (SELECT conv_id, item_id, round(s / (a + b - s)::DOUBLE, 6) AS score FROM p WHERE s > 0)
SELECT conv_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, item_id) AS r FROM j) WHERE r <= 3""")
def tool_select_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by Jaccard similarity to each system prompt: common terms are counted by a join on the term."""
    from pyspark.sql.window import Window as W

    d = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(S.terms(F.col("text"))).alias("w")).withColumn("b", F.size("w"))
    i = table(spark, sf_dir, "conversations").filter("role = 'system'").select("conv_id", F.array_distinct(S.terms(F.col("text"))).alias("w")).withColumn("a", F.size("w"))
    met = i.select("conv_id", "a", F.explode("w").alias("t")).join(d.select("item_id", "b", F.explode("w").alias("t")), "t").groupBy("conv_id", "item_id").agg(F.count("*").alias("s"), F.first("a").alias("a"), F.first("b").alias("b"))
    j = met.select("conv_id", "item_id", F.round(F.col("s") / (F.col("a") + F.col("b") - F.col("s")), 6).alias("score"))
    return j.withColumn("r", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("score"), "item_id"))).filter("r <= 3").drop("r")


@query("""SELECT conv_id, count(*) AS turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id HAVING bool_or(contains(lower(text), 'the')) ORDER BY turns DESC, conv_id LIMIT 10""")
def session_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    hits = c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.bool_or(F.contains(F.lower("text"), F.lit("the"))).alias("hit"))
    return hits.filter("hit").drop("hit").orderBy(F.desc("turns"), "conv_id").limit(10)
