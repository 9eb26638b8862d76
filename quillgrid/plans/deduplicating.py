"""Queries over exact and near duplicates, repeated lines and deltas."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import table, token_estimate
from ..operators import dedup as D
from ..registry import query

LINES = "string_split(CASE WHEN ends_with(text, chr(10)) THEN substr(text, 1, length(text) - 1) ELSE text END, chr(10))"
USER_LOG = "SELECT user_id, string_agg(event_type, chr(10) ORDER BY ts, event_id) AS text FROM events GROUP BY user_id"
STAMPED = "SELECT user_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type, chr(10) ORDER BY ts, event_id) AS text FROM events GROUP BY user_id"


def user_logs(spark: SparkSession, sf_dir: str, stamped: bool = False) -> DataFrame:
    """A log text for each user: event types in the order of time."""
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.col("event_type")) if stamped else F.col("event_type")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("line"))))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


@query("""SELECT doc_id, sha256(text) AS hash, substr(sha256(text), 1, 16) AS ref, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id,
  count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact_dedup(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "hash", "ref", "first_id", "copies")


@query("""WITH g AS (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events)
SELECT event_id, CASE WHEN gap IS NULL THEN 'fresh' WHEN gap < 86400000000 THEN 'ref' ELSE 'resend' END AS outcome FROM g""")
def dedup_ttl_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ttl_outcomes(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 86400, ["event_id"]).select("event_id", "outcome")


@query("""WITH s AS (SELECT DISTINCT sha256(text) AS hash FROM documents), p AS (
  SELECT DISTINCT substr(sha256(text), 1, 4) AS prefix FROM documents UNION SELECT DISTINCT substr(sha256(text), 1, 16) FROM documents)
SELECT prefix, count(hash) AS matches, CASE WHEN count(hash) = 1 THEN min(hash) END AS hash FROM p LEFT JOIN s ON starts_with(hash, prefix) GROUP BY prefix""")
def ref_prefix_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = D.with_hash(table(spark, sf_dir, "documents")).select("hash").distinct()
    prefixes = stored.select(F.explode(F.array(F.substring("hash", 1, 4), F.substring("hash", 1, 16))).alias("prefix")).distinct()
    return D.expand_refs(prefixes, stored)


@query("""WITH s AS (SELECT source, doc_id, strlen(text) AS bytes FROM documents), r AS (
  SELECT *, sum(bytes) OVER (PARTITION BY source ORDER BY doc_id DESC) AS kept_bytes FROM s)
SELECT source, doc_id, CAST(kept_bytes AS BIGINT) AS kept_bytes FROM r WHERE kept_bytes <= 60000""")
def lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return D.lru_keep(entries, "bytes", "doc_id", "doc_id", 60000, ["source"]).select("source", "doc_id", "kept_bytes")


SHINGLES = """t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) END AS s FROM t),
ex AS (SELECT doc_id, unnest(s) AS s FROM sh), h AS (SELECT doc_id, s, CAST('0x' || substr(md5(s), 1, 15) AS BIGINT) AS h FROM ex)"""
_BITS = " + ".join(f"CASE WHEN sum(CASE WHEN h & {1 << b} <> 0 THEN w ELSE -w END) > 0 THEN {1 << b} ELSE 0 END" for b in range(60))
SIMHASH = f"WITH {SHINGLES}, f AS (SELECT doc_id, CAST({_BITS} AS BIGINT) AS simhash FROM (SELECT doc_id, h, 1 AS w FROM h) GROUP BY doc_id), v AS (SELECT doc_id, coalesce(simhash, 0) AS simhash FROM documents LEFT JOIN f USING (doc_id))"


@query(f"{SIMHASH} SELECT * FROM v")
def simhash60(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.simhash60(table(spark, sf_dir, "documents"), "doc_id")


@query(f"""WITH {SHINGLES}, g AS (SELECT doc_id, CAST({_BITS} AS BIGINT) AS simhash FROM (SELECT doc_id, h, length(s) AS w FROM h) GROUP BY doc_id)
SELECT doc_id, coalesce(simhash, 0) AS simhash FROM documents LEFT JOIN g USING (doc_id)""")
def simhash_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.simhash60(table(spark, sf_dir, "documents"), "doc_id", weight=F.length)


@query(f"""{SIMHASH}, r AS (SELECT simhash, min(doc_id) AS doc_id FROM v GROUP BY simhash)
SELECT a.doc_id AS a, b.doc_id AS b, CAST(bit_count(xor(a.simhash, b.simhash)) AS INT) AS distance FROM r a JOIN r b ON a.doc_id < b.doc_id AND bit_count(xor(a.simhash, b.simhash)) <= 3""")
def simhash_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.near_pairs(D.simhash60(table(spark, sf_dir, "documents"), "doc_id"), "doc_id")


@query(f"""{SIMHASH}, r AS (SELECT simhash, min(doc_id) AS doc_id FROM v GROUP BY simhash),
p AS (SELECT b.doc_id AS b, a.doc_id AS a, bit_count(xor(a.simhash, b.simhash)) AS d FROM r a JOIN r b ON a.doc_id < b.doc_id AND bit_count(xor(a.simhash, b.simhash)) <= 3)
SELECT b AS doc_id, a AS nearest, CAST(d AS INT) AS distance, round(1 - d / 60.0, 6)::DOUBLE AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY d, a) AS n FROM p) WHERE n = 1""")
def simhash_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = D.near_pairs(D.simhash60(table(spark, sf_dir, "documents"), "doc_id"), "doc_id")
    best = pairs.groupBy("b").agg(F.min(F.struct("distance", "a")).alias("m"))
    return best.select(F.col("b").alias("doc_id"), F.col("m.a").alias("nearest"), F.col("m.distance").alias("distance"), F.round(1 - F.col("m.distance") / 60.0, 6).alias("similarity"))


_MINS = ", ".join(f"min((b * {(2 * i + 1) * 7919} + {i * 104729}) % 2147483647) AS m{i}" for i in range(64))
_BANDS = " UNION ALL ".join("SELECT item_id, " + str(b) + " AS band, md5(" + " || ',' || ".join(f"m{i}" for i in range(8 * b, 8 * b + 8)) + ") AS bucket FROM m" for b in range(8))
MINHASH = f"""WITH turns AS (SELECT conv_id * 100 + turn AS item_id, text FROM conversations), g AS (SELECT DISTINCT item_id, substr(text, i, 3) AS g FROM (SELECT item_id, text, unnest(range(1, length(text) - 1)) AS i FROM turns WHERE length(text) >= 3)),
h AS (SELECT item_id, CAST('0x' || substr(md5(g), 1, 7) AS BIGINT) AS b FROM g), m AS (SELECT item_id, {_MINS} FROM h GROUP BY item_id UNION ALL SELECT item_id, {", ".join(["2147483647"] * 64)} FROM turns WHERE coalesce(length(text), 0) < 3), bands AS ({_BANDS})"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), "text")


@query(f"{MINHASH} SELECT * FROM bands")
def minhash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.bands(D.minhash(turns(spark, sf_dir), "item_id"), "item_id")


@query(f"""{MINHASH}, sig AS (SELECT item_id, string_agg(bucket, '' ORDER BY band) AS s FROM bands GROUP BY item_id), c AS (SELECT s, min(item_id) AS rep, count(*) AS members FROM sig GROUP BY s),
met AS (SELECT q.item_id, b.item_id AS rep, count(*) AS shared FROM bands q JOIN bands b USING (band, bucket) WHERE q.item_id % 20 = 0 AND b.item_id IN (SELECT rep FROM c) GROUP BY ALL)
SELECT item_id, rep, members, shared FROM met JOIN c USING (rep)""")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class of turns with a common band, for the query set of keys divisible by 20, against all turns."""
    m = D.minhash(turns(spark, sf_dir), "item_id")
    return D.lsh_candidates(m.filter("item_id % 20 = 0"), D.signature_classes(m, "item_id"), "item_id")


RECENT = f"""t AS (SELECT conv_id * 100 + turn AS item_id, conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id * 100 + turn) AS n FROM conversations),
p AS (SELECT x.item_id, y.item_id AS c, x.n - y.n AS back, x.text AS l, y.text AS r FROM t x JOIN t y ON x.conv_id = y.conv_id AND x.n - y.n BETWEEN 1 AND 10),
a AS (SELECT item_id, c, back, unnest({LINES.replace("text", "l")}) AS line, 0 AS side FROM p WHERE l <> '' UNION ALL SELECT item_id, c, back, unnest({LINES.replace("text", "r")}), 1 FROM p WHERE r <> ''),
k AS (SELECT item_id, c, back, line, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1 FROM a GROUP BY ALL),
s AS (SELECT item_id, c, back, sum(least(n0, n1)) / greatest(sum(n0), sum(n1)) AS similarity FROM k GROUP BY ALL UNION ALL SELECT item_id, c, back, 1.0 FROM p WHERE l = '' AND r = ''),
f AS (SELECT item_id, c, similarity, row_number() OVER (PARTITION BY item_id ORDER BY back) AS rn FROM s WHERE similarity >= 0.6)"""


@query(f"WITH {RECENT} SELECT t.item_id, c AS candidate, round(similarity, 6)::DOUBLE AS similarity FROM t LEFT JOIN f ON f.item_id = t.item_id AND rn = 1")
def recent_delta_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of a conversation's ten turns before each turn that is like it."""
    c = table(spark, sf_dir, "conversations").withColumn("item_id", F.col("conv_id") * 100 + F.col("turn"))
    return D.recent_candidates(c, "conv_id", "turn", "item_id").withColumn("similarity", F.round("similarity", 6))


@query(f"""{MINHASH} SELECT x.item_id AS a, y.item_id AS b, round(({" + ".join(f"(x.m{i} = y.m{i})::INT" for i in range(64))}) / 64.0, 6)::DOUBLE AS jaccard
FROM m x JOIN m y ON y.item_id = x.item_id + 1""")
def signature_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.minhash(turns(spark, sf_dir), "item_id")
    other = m.select((F.col("item_id") - 1).alias("item_id"), F.col("signature").alias("s2"))
    return m.join(other, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.round(D.signature_jaccard(F.col("signature"), F.col("s2")), 6).alias("jaccard"))


NEXT_DOC = "SELECT source, doc_id, text, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS later FROM documents"


@query(f"""WITH p AS (SELECT doc_id, text AS l, later AS r FROM ({NEXT_DOC}) WHERE later IS NOT NULL),
a AS (SELECT doc_id, unnest({LINES.replace("text", "l")}) AS line, 0 AS side FROM p UNION ALL SELECT doc_id, unnest({LINES.replace("text", "r")}), 1 FROM p),
c AS (SELECT doc_id, line, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1 FROM a GROUP BY doc_id, line)
SELECT doc_id, round(sum(least(n0, n1)) / greatest(sum(n0), sum(n1)), 6)::DOUBLE AS similarity FROM c GROUP BY doc_id""")
def line_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("source").orderBy("doc_id")
    pairs = table(spark, sf_dir, "documents").withColumn("later", F.lead("text").over(w)).filter("later is not null")
    return D.line_similarity(pairs, "text", "later", ["doc_id"]).select("doc_id", F.round("similarity", 6).alias("similarity"))


ISLANDS = """l AS (SELECT {k}, unnest(s) AS line, generate_subscripts(s, 1) AS i, tail FROM (SELECT {k}, {lines} AS s, ends_with(text, chr(10)) AS tail FROM t)),
c AS (SELECT *, CASE WHEN line = lag(line) OVER (PARTITION BY {k} ORDER BY i) THEN 0 ELSE 1 END AS new FROM l),
g AS (SELECT *, sum(new) OVER (PARTITION BY {k} ORDER BY i) AS run FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY {k}, run ORDER BY i) AS rn, count(*) OVER (PARTITION BY {k}, run) AS cnt FROM g)"""


@query(f"""WITH t AS (SELECT doc_id, text FROM documents), {ISLANDS.format(k="doc_id", lines=LINES)}
SELECT doc_id, string_agg(line, chr(10) ORDER BY i) || CASE WHEN bool_or(tail) THEN chr(10) ELSE '' END AS condensed FROM n WHERE rn <= 3 GROUP BY doc_id""")
def condense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", D.condense(F.col("text")).alias("condensed"))


@query(f"""WITH t AS ({USER_LOG}), {ISLANDS.format(k="user_id", lines=LINES)}
SELECT user_id, string_agg(CASE WHEN cnt >= 3 THEN line || ' [×' || cnt || ']' ELSE line END, chr(10) ORDER BY i) AS folded FROM n WHERE cnt < 3 OR rn = 1 GROUP BY user_id""")
def rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_logs(spark, sf_dir).select("user_id", D.fold_runs(F.col("text")).alias("folded"))


@query(f"""WITH t AS ({STAMPED}), l AS (SELECT user_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT user_id, {LINES} AS s FROM t)),
k AS (SELECT *, trim(regexp_replace(line, '^[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}[.0-9]*\\s*', '')) AS key FROM l),
c AS (SELECT *, CASE WHEN key = lag(key) OVER (PARTITION BY user_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM k),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i) AS run FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY i) AS rn, count(*) OVER (PARTITION BY user_id, run) AS cnt FROM g)
SELECT user_id, string_agg(CASE WHEN cnt >= 2 THEN line || ' [x' || cnt || ']' ELSE line END, chr(10) ORDER BY i) AS folded FROM n WHERE rn = 1 GROUP BY user_id""")
def log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_logs(spark, sf_dir, stamped=True).select("user_id", D.fold_runs(F.col("text"), 2, "x", D.strip_timestamp).alias("folded"))


@query(f"""WITH l AS (SELECT doc_id, tail, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, {LINES} AS s, ends_with(text, chr(10)) AS tail FROM documents)),
n AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> ''), ' ') AS norm FROM l),
f AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, norm) AS first FROM n)
SELECT doc_id, string_agg(CASE WHEN strlen(norm) >= 12 AND first < pos THEN '[→L' || (first + 1) || ']' ELSE line END, chr(10) ORDER BY pos) || CASE WHEN bool_or(tail) THEN chr(10) ELSE '' END AS text,
  count(*) FILTER (WHERE strlen(norm) >= 12 AND first < pos) AS replaced FROM f GROUP BY doc_id""")
def line_backrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.line_backrefs(table(spark, sf_dir, "documents"), "doc_id")


@query(f"""WITH p AS (SELECT doc_id, {LINES} AS o, {LINES.replace("text", "later")} AS n FROM ({NEXT_DOC}) WHERE later IS NOT NULL),
i AS (SELECT doc_id, o, n, unnest(range(1, greatest(len(o), len(n)) + 1)) AS i FROM p)
SELECT doc_id, count(*) FILTER (WHERE o[i] IS DISTINCT FROM n[i]) AS differing, coalesce(CAST(min(i) FILTER (WHERE o[i] IS DISTINCT FROM n[i]) AS INT), 0) AS first_line FROM i GROUP BY doc_id""")
def diff_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("source").orderBy("doc_id")
    d = table(spark, sf_dir, "documents").withColumn("later", F.lead("text").over(w)).filter("later is not null")
    at = D.positional_diff(F.col("text"), F.col("later"))
    return d.select("doc_id", at.alias("at")).select("doc_id", F.size("at").cast("long").alias("differing"), F.coalesce(F.get("at", F.lit(0)), F.lit(0)).cast("int").alias("first_line"))


@query()
def lcs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line deltas between near-duplicate documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = D.near_pairs(D.simhash60(docs, "doc_id"), "doc_id", 3)
    old, new = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("old")), docs.select(F.col("doc_id").alias("b"), F.col("text").alias("new"))
    return D.line_deltas(pairs.join(old, "a").join(new, "b").select("a", "b", "old", "new"), ["a", "b"], "old", "new")


@query()
def sentence_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that stay when near copies of an earlier one go, in the order of the text."""

    @F.pandas_udf("long")
    def kept(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(D.sentence_near_dedup(re.split(r"(?<=[.!?])\s+", t))))

    return table(spark, sf_dir, "documents").select("doc_id", kept("text").alias("kept"))


@query("""WITH d AS (SELECT source, doc_id, sha256(text) AS h, text FROM documents),
p AS (SELECT *, lag(doc_id) OVER (PARTITION BY h ORDER BY doc_id) AS prev FROM d)
SELECT doc_id, CASE WHEN prev IS NOT NULL THEN 'ref' ELSE 'fresh' END AS outcome, CASE WHEN prev IS NOT NULL THEN 13 ELSE CAST(ceil(strlen(text) / 4.0) AS BIGINT) END AS tokens FROM p""")
def cached_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome and tokens of sending each document: earlier content costs a reference."""
    d = D.with_hash(table(spark, sf_dir, "documents"))
    first = d.groupBy("hash").agg(F.min("doc_id").alias("first_id"))
    seen = F.col("doc_id") > F.col("first_id")
    return D.join_hot(d, first).select("doc_id", F.when(seen, "ref").otherwise("fresh").alias("outcome"), F.when(seen, F.lit(D.REFERENCE_TOKENS)).otherwise(token_estimate(F.col("text"))).cast("long").alias("tokens"))
