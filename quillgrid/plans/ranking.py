"""Queries over entropy, selection, ranking and eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import table, token_estimate
from ..operators import classify as C
from ..operators import entropy as E
from ..operators import mining as M
from ..operators import phrases as P
from ..registry import query
from .texts import LINES

BYTES = """b AS (SELECT doc_id, strlen(text) AS t, unnest(regexp_extract_all(hex(encode(text)), '(..)', 1)) AS c FROM documents),
bc AS (SELECT doc_id, c, t, count(*)::DOUBLE AS n FROM b GROUP BY doc_id, c, t), h AS (SELECT doc_id, -sum(n / t * log2(n / t)) AS entropy FROM bc GROUP BY doc_id)"""


@query(f"WITH {BYTES} SELECT doc_id, round(entropy, 6) AS entropy FROM h")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.byte_entropy(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.round("entropy", 6).alias("entropy"))


@query("""WITH b AS (SELECT doc_id, strlen(text) AS t, unnest(string_split(text, '')) AS c FROM documents), bc AS (SELECT doc_id, c, t, count(*)::DOUBLE AS n FROM b GROUP BY doc_id, c, t)
SELECT doc_id, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM bc GROUP BY doc_id""")
def char_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.char_entropy(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.round("entropy", 6).alias("entropy"))


@query(f"""WITH {BYTES}, q AS (SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens, least(CAST(ceil(round(entropy, 6) * strlen(text) / 32) AS BIGINT), CAST(ceil(strlen(text) / 4.0) AS BIGINT)) AS least_tokens FROM documents JOIN h USING (doc_id))
SELECT doc_id, tokens, least_tokens, round(least_tokens / tokens::DOUBLE, 6) AS efficiency, CASE WHEN least_tokens / tokens::DOUBLE >= 0.9 THEN 'A' WHEN least_tokens / tokens::DOUBLE >= 0.7 THEN 'B' WHEN least_tokens / tokens::DOUBLE >= 0.5 THEN 'C' ELSE 'D' END AS grade FROM q""")
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    x = docs.join(E.byte_entropy(docs, "doc_id"), "doc_id").withColumn("tokens", token_estimate(F.col("text")))
    least, efficiency, grade = E.quality_metrics(F.col("tokens"), F.octet_length("text"), F.round("entropy", 6))
    return x.select("doc_id", "tokens", least.alias("least_tokens"), F.round(efficiency, 6).alias("efficiency"), grade.alias("grade"))


BY_SOURCE = "s AS (SELECT source, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY source)"


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of blocks: a conversation's turns with blank lines between."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


CONV = "s AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"
BLOCKS = f"""{CONV}, l AS (SELECT conv_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT conv_id, {LINES} AS ls FROM s)),
n AS (SELECT *, sum((trim(line) = '')::INT) OVER (PARTITION BY conv_id ORDER BY i) AS block FROM l),
blk AS (SELECT conv_id, block, CAST(min(i) AS INT) AS start_line, CAST(max(i) AS INT) AS end_line, string_agg(line, chr(10) ORDER BY i) AS text FROM n WHERE trim(line) <> '' GROUP BY conv_id, block),
bb AS (SELECT conv_id, block, strlen(text) AS t, unnest(string_split(text, '')) AS c FROM blk), bn AS (SELECT conv_id, block, c, t, count(*)::DOUBLE AS n FROM bb GROUP BY conv_id, block, c, t),
be AS (SELECT conv_id, block, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM bn GROUP BY conv_id, block)"""


def block_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = E.blocks(by_source(spark, sf_dir), "conv_id").withColumn("bid", F.struct("conv_id", "block"))
    h = E.char_entropy(b, "bid").select("bid.*", F.round("entropy", 6).alias("entropy"))
    return b.drop("bid").join(h, ["conv_id", "block"])


@query(f"WITH {BLOCKS} SELECT conv_id, start_line, end_line, entropy FROM blk JOIN be USING (conv_id, block)")
def entropy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_entropies(spark, sf_dir).select("conv_id", "start_line", "end_line", "entropy")


@query(f"""WITH {BLOCKS}, r AS (SELECT conv_id, block, entropy, row_number() OVER (PARTITION BY conv_id ORDER BY entropy, block) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM be),
p AS (SELECT conv_id, max(entropy) FILTER (WHERE i = floor(0.25 * (n - 1) + 0.5)) AS p25, max(entropy) FILTER (WHERE i = floor(0.6 * (n - 1) + 0.5)) AS p60 FROM r GROUP BY conv_id)
SELECT conv_id, start_line, CASE WHEN entropy >= p60 THEN 'high' WHEN entropy >= p25 THEN 'medium' ELSE 'low' END AS level FROM be JOIN p USING (conv_id) JOIN blk USING (conv_id, block)""")
def entropy_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = block_entropies(spark, sf_dir)
    p = E.nearest_rank(b, ["conv_id"], "entropy", ["block"], (25, 60))
    return b.join(p, "conv_id").select("conv_id", "start_line", F.when(F.col("entropy") >= F.col("p60"), "high").when(F.col("entropy") >= F.col("p25"), "medium").otherwise("low").alias("level"))


@query(f"""WITH d AS (SELECT doc_id, {LINES} AS ls FROM documents), seg AS (SELECT doc_id, ls, unnest(range(0, CAST(floor((len(ls) - 1) / 10) AS BIGINT) + 1)) AS pos FROM d),
t AS (SELECT doc_id, pos, array_to_string(list_slice(ls, pos * 10 + 1, pos * 10 + 10), chr(10)) AS segment FROM seg),
b AS (SELECT doc_id, pos, strlen(segment) AS t, unnest(regexp_extract_all(hex(encode(segment)), '(..)', 1)) AS c FROM t), bc AS (SELECT doc_id, pos, c, t, count(*)::DOUBLE AS n FROM b GROUP BY doc_id, pos, c, t),
h AS (SELECT doc_id, pos, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM bc GROUP BY doc_id, pos),
r AS (SELECT doc_id, pos, segment, entropy, median(entropy) OVER (PARTITION BY doc_id) AS m, row_number() OVER (PARTITION BY doc_id ORDER BY entropy DESC, pos) AS rn FROM h JOIN t USING (doc_id, pos))
SELECT doc_id, CAST(pos AS INT) AS pos, entropy >= m OR strlen(segment) < 20 OR rn <= 2 AS kept FROM r""")
def entropy_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = E.chunked(table(spark, sf_dir, "documents"), "doc_id").withColumn("sid", F.struct("doc_id", "pos"))
    h = E.byte_entropy(seg, "sid", "segment").select("sid.*", F.round("entropy", 6).alias("entropy"))
    return E.keep_by_entropy(seg.drop("sid").join(h, ["doc_id", "pos"]), "doc_id").select("doc_id", "pos", "kept")


WORDS = "w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents))"


@query(f"""WITH {WORDS}, g AS (SELECT lower(lag(word, 2) OVER p) AS w1, lower(lag(word) OVER p) AS w2, lower(word) AS w3 FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i))
SELECT w1, w2, w3, count(*) AS n FROM g WHERE w1 IS NOT NULL GROUP BY w1, w2, w3 HAVING count(*) >= 3""")
def trigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.trigrams(table(spark, sf_dir, "documents"), "doc_id").filter("n >= 3")


_TRI = ", ".join(f"('{a}', '{b}', '{c}', {n})" for a, b, c, n in M.TRIGRAMS)


@query(f"""WITH src AS (SELECT p_partkey, 'this is a ' || p_name || ' and it is not in order to ' || p_type AS text FROM part),
w AS (SELECT p_partkey, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT p_partkey, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM src)),
g AS (SELECT *, lower(lag(word, 2) OVER p) AS w1, lower(lag(word) OVER p) AS w2, lower(regexp_replace(word, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')) AS w3 FROM w WINDOW p AS (PARTITION BY p_partkey ORDER BY i)),
t AS (SELECT * FROM (VALUES {_TRI}) v(w1, w2, w3, n)), s AS (SELECT w1, w2, w3, n / sum(n) OVER (PARTITION BY w1, w2)::DOUBLE AS p FROM t)
SELECT p_partkey, string_agg(word, ' ' ORDER BY i) FILTER (WHERE coalesce(p, 0) <= 0.85) AS text, count(*) FILTER (WHERE p > 0.85) AS removed FROM g LEFT JOIN s USING (w1, w2, w3) GROUP BY p_partkey""")
def trigram_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("this is a "), "p_name", F.lit(" and it is not in order to "), "p_type").alias("text"))
    return M.trigram_prune(src, "p_partkey")


@query(f"""WITH {WORDS}, c AS (SELECT doc_id, lower(word) AS lw, count(*) AS n, min(i) AS first FROM w GROUP BY doc_id, lower(word)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lw) AS rank, sum(n) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY doc_id) AS kinds FROM c),
h AS (SELECT *, sum(round(1.0::DOUBLE / rank, 12)) OVER (PARTITION BY doc_id) AS hn FROM r)
SELECT doc_id, CAST(sum(CASE WHEN total >= 10 AND n > 1.5 * (total / hn / rank) AND strlen(lw) <= 4 AND lw NOT IN ({", ".join(f"'{w}'" for w in M.TECHNICAL)}) THEN n - 1 ELSE 0 END) AS BIGINT) AS removed FROM h GROUP BY doc_id""")
def zipf_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.zipf_redundant(table(spark, sf_dir, "documents"), "doc_id")


_LEADS = ", ".join(f"lead(word, {n}) OVER p AS w{n}" for n in range(1, 8))
_GRAMS = " UNION ALL ".join("SELECT word" + "".join(f" || ' ' || w{k}" for k in range(1, n)) + f" AS gram FROM x WHERE w{n - 1} IS NOT NULL" for n in range(3, 9))


@query(f"""WITH {WORDS}, x AS (SELECT word, {_LEADS} FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)), k AS ({_GRAMS}),
c AS (SELECT gram, count(*) AS n FROM k WHERE strlen(gram) >= 10 GROUP BY gram HAVING count(*) >= 3)
SELECT gram, n, CAST((n - 1) * (strlen(gram) - 4) AS BIGINT) AS savings FROM c ORDER BY savings DESC, gram LIMIT 20""")
def ngram_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_ngrams(table(spark, sf_dir, "documents"))


@query(f"""WITH {WORDS}, p AS (SELECT doc_id, word AS a, lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM w), c AS (SELECT doc_id, a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY doc_id, a, b HAVING count(*) >= 3)
SELECT doc_id, a, b, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, a, b) AS r FROM c) WHERE r = 1""")
def bpe_first_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_merge(table(spark, sf_dir, "documents"), "doc_id")


@query()
def bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pairs merged over and over within each text; iterative, so without SQL."""
    return M.merge_words(table(spark, sf_dir, "documents"), "doc_id")


@query()
def phrase_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with the mined phrases replaced after their first occurrence."""
    docs = table(spark, sf_dir, "documents")
    return M.apply_legend(docs, "doc_id", P.top_ngrams(docs, most=20), 20)


@query()
def textrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences that stay of each text, by page rank over their common words."""
    return M.textrank(table(spark, sf_dir, "documents"), "doc_id")


@query("""WITH s AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: strlen(w) > 2)) AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn AS a, b.turn AS b, len(list_intersect(a.w, b.w)) AS shared, len(a.w) AS na, len(b.w) AS nb FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn < b.turn)
SELECT conv_id, a, b, round(shared / (ln(na) + ln(nb)), 6) AS weight FROM p WHERE na > 1 AND nb > 1 AND shared > 0""")
def textrank_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity edges between the turns of a conversation."""
    c = table(spark, sf_dir, "conversations")
    w = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: F.octet_length(x) > 2))
    s = c.select("conv_id", "turn", w.alias("w")).filter(F.size("w") > 1)
    a, b = s.select("conv_id", F.col("turn").alias("a"), F.col("w").alias("wa")), s.select("conv_id", F.col("turn").alias("b"), F.col("w").alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    return a.join(b, "conv_id").filter((F.col("a") < F.col("b")) & (shared > 0)).select("conv_id", "a", "b", F.round(shared / (F.log(F.size("wa")) + F.log(F.size("wb"))), 6).alias("weight"))


@query()
def tree_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences pruned from the least important up until a text meets its token budget."""
    return M.prune_tree(table(spark, sf_dir, "documents"), "doc_id", 200)


ITEMS = """i AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS last, n_chars % 7 AS uses, count(*) OVER (PARTITION BY source) AS now FROM documents)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("source", "doc_id", F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("last"), (F.col("n_chars") % 7).alias("uses"), F.count("*").over(W.partitionBy("source")).alias("now"))


@query(f"""WITH {ITEMS}, s AS (SELECT *, round(0.7 * exp(-(now - last) / 30.0) + 0.3 * least(1.0, ln(uses + 1.0) / ln(5.0)), 9) AS score, doc_id % 10 = 0 AS pinned FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY source, pinned ORDER BY score, doc_id) AS rank, count(*) OVER (PARTITION BY source) AS n FROM s)
SELECT source, doc_id, round(score, 6) AS score, NOT pinned AND rank <= least(ceil(n * 0.3), greatest(n - 5, 0)) AS evicted FROM r""")
def context_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = E.evict(items(spark, sf_dir), ["source"], "last", "uses", ["doc_id"], F.col("now"), pinned=F.col("doc_id") % 10 == 0)
    return x.select("source", "doc_id", F.round("score", 6).alias("score"), "evicted")


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY strlen(text) DESC, turn) - 1 AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, CAST(CASE WHEN r % 2 = 0 THEN floor(r / 2) ELSE n - 1 - floor(r / 2) END AS BIGINT) AS position FROM r""")
def context_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("priority", F.octet_length("text"))
    return E.reorder_edges(c, ["conv_id"], "priority", ["turn"]).select("conv_id", "turn", "position")


@query("""WITH s AS (SELECT conv_id, turn, sum(strlen(text) + 20) OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn) AS used FROM conversations)
SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM s WHERE used <= 2048""")
def session_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by priority of their role while the snapshot stays within 2,048 bytes."""
    c = table(spark, sf_dir, "conversations").withColumn("bytes", (F.octet_length("text") + 20).cast("long"))
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return E.within_budget(c.withColumn("rank", rank), ["conv_id"], "bytes", ["rank", "turn"], 2048).select("conv_id", "turn", "used")


@query("""SELECT conv_id, substr(text, 1, 512) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user') WHERE r = 1""")
def last_prompt_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("t"))
    return last.select("conv_id", F.substring("t", 1, 512).alias("prompt"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, turn, back <= 3 AS recent, CASE WHEN back > 3 AND role <> 'system' AND strlen(text) >= 80 THEN substr(text, 1, 40) || ' [...]' ELSE text END AS text FROM r""")
def history_summarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns as they are; longer older ones of user and assistant cut."""
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    c = table(spark, sf_dir, "conversations").withColumn("back", back)
    cut = (F.col("back") > 3) & (F.col("role") != "system") & (F.octet_length("text") >= 80)
    return c.select("conv_id", "turn", (F.col("back") <= 3).alias("recent"), F.when(cut, F.concat(F.substring("text", 1, 40), F.lit(" [...]"))).otherwise(F.col("text")).alias("text"))


@query("""WITH e AS (SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e, strlen(text) AS n FROM conversations)
SELECT conv_id, turn, CAST(e AS BIGINT) AS end_bytes, e - n < 1024 AND e >= 1024 AS holds_boundary FROM e""")
def cache_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cache_boundary(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text", 1024).select("conv_id", "turn", F.col("end_bytes").cast("long").alias("end_bytes"), "holds_boundary")


@query("""SELECT doc_id, round(least(ceil(strlen(text) / 4.0) / 10000.0, 0.5) + least(0.1 * (doc_id % 5), 0.3) + CASE WHEN doc_id % 2 = 0 THEN 0.1 ELSE 0.0 END, 6)::DOUBLE AS score FROM documents""")
def complexity_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = E.complexity(token_estimate(F.col("text")), F.col("doc_id") % 5, F.col("doc_id") % 2 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(score, 6).alias("score"))


@query(f"""WITH l AS (SELECT doc_id, text, {LINES} AS ls FROM documents), f AS (SELECT doc_id, ceil(strlen(text) / 4.0) AS t, len(list_filter(range(3, len(ls) + 1), lambda i: ls[i] = ls[i - 1] AND ls[i] = ls[i - 2])) > 0 AS rep, strlen(text) > 500 AS long FROM l),
c AS (SELECT doc_id, 'ansi_strip' AS stage, 1000000.0 AS net, true AS ok FROM f UNION ALL SELECT doc_id, 'condense', t * 0.15 - 2, rep FROM f UNION ALL SELECT doc_id, 'run_length', t * 0.2 - 3, rep FROM f UNION ALL SELECT doc_id, 'entropy_truncate', t * 0.1 - 5, long FROM f)
SELECT doc_id, string_agg(stage, ',' ORDER BY net DESC, stage) AS stages FROM c WHERE ok AND net > 0 GROUP BY doc_id""")
def mdl_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages whose expected savings exceed their overhead, the best first."""
    p = C.profile(F.col("text"))
    x = table(spark, sf_dir, "documents").select("doc_id", p["tokens"].alias("t"), p["repetition"].alias("rep"), (p["bytes"] > 500).alias("long"))
    return x.select("doc_id", M.stages(F.col("t"), F.col("rep"), F.col("long")).alias("stages"))


@query()
def regret_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence in each event type after its events in order: failures lower it, successes raise it, between 0.1 and 1."""
    return M.regret(table(spark, sf_dir, "events"), "event_type", "event_id")
