"""The flagship query and the full chain of compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import table, token_estimate
from ..operators import compact as C
from ..operators import dedup as D
from ..registry import query
from .deduplicating import ISLANDS, LINES

FLAGSHIP = f"""WITH h AS (SELECT doc_id, source, text, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents), t AS (SELECT doc_id, text FROM h WHERE doc_id = first_id),
{ISLANDS.format(k="doc_id", lines=LINES)}, cc AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) || CASE WHEN bool_or(tail) THEN chr(10) ELSE '' END AS text FROM n WHERE rn <= 3 GROUP BY doc_id),
l2 AS (SELECT doc_id, tail, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, {LINES} AS s, ends_with(text, chr(10)) AS tail FROM cc)),
n2 AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> ''), ' ') AS norm FROM l2),
f2 AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, norm) AS first FROM n2),
o AS (SELECT doc_id, string_agg(CASE WHEN strlen(norm) >= 12 AND first < pos THEN '[→L' || (first + 1) || ']' ELSE line END, chr(10) ORDER BY pos) || CASE WHEN bool_or(tail) THEN chr(10) ELSE '' END AS out FROM f2 GROUP BY doc_id),
x AS (SELECT source, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tin, CASE WHEN h.doc_id = first_id THEN CAST(ceil(strlen(out) / 4.0) AS BIGINT) ELSE 13 END AS tout FROM h LEFT JOIN o USING (doc_id))
SELECT source, count(*) AS n, CAST(sum(tin) AS BIGINT) AS tokens_in, CAST(sum(tout) AS BIGINT) AS tokens_out, CAST(greatest(sum(tin) - sum(tout), 0) AS BIGINT) AS saved, round(100.0 * greatest(sum(tin) - sum(tout), 0) / sum(tin), 6)::DOUBLE AS reduction FROM x GROUP BY source"""


@query(FLAGSHIP)
def flagship_source_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that compaction and deduplication save for each source: first occurrences are compacted, copies cost a reference."""
    from ..operators.account import totals

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    hashed = docs.select("doc_id", "source", token_estimate(F.col("text")).alias("tin"), F.sha2("text", 256).alias("hash"))
    firsts = hashed.groupBy("hash").agg(F.min("doc_id").alias("first_id"))
    compacted = D.line_backrefs(docs.select("doc_id", D.condense(F.col("text")).alias("text")), "doc_id").select(F.col("doc_id").alias("first_id"), token_estimate(F.col("text")).alias("compact"))
    x = D.join_hot(hashed, firsts.join(compacted, "first_id"))
    tout = F.when(F.col("doc_id") == F.col("first_id"), F.col("compact")).otherwise(F.lit(D.REFERENCE_TOKENS))
    return totals(x.withColumn("tout", tout), ["source"], "tin", "tout")


@query()
def compact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain over distinct texts, with verification and fallback, and references for copies."""
    return C.compact(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "mode", "tokens_original", "tokens_compacted", "confidence", "stages")


@query()
def compact_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return C.compact(c, "id", "text", C.Preset(max_run=2)).select("id", "mode", "tokens_original", "tokens_compacted", "stages")
