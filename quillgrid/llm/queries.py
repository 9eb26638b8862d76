"""The registered queries of the training-data operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_rounds, hd_langid, histogram_sort, media_store, packing, prefix_counts, rans_store, rule_ledger, simhash_grid, url_filter


TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort.shard(table(spark, sf_dir, "documents"), 16)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_grid.groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans_store.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_store.store_and_read(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_rounds.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hd_langid.identify(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = rule_ledger.apply_policy(rule_ledger.measure(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.col("fail_bits").bitwiseAND(rule_ledger.mask(1)) != 0
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_sharding": op2_sharding,
    "op3_simhash": op3_simhash,
    "op4_token_counts": op4_token_counts,
    "op5_token_store": op5_token_store,
    "op6_media_columns": op6_media_columns,
    "op7_packing": op7_packing,
    "op8_bpe": op8_bpe,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
}

_K = url_filter.ORDER
_LEVELS = ",\n".join(
    f"""l{k} AS (SELECT substr(g, {_K + 1 - k}, {k + 1}) AS s, sum(a)::DOUBLE AS a, sum(r)::DOUBLE AS r FROM seen GROUP BY 1)"""
    if k == 0
    else f"""l{k} AS (SELECT substr(g, {_K + 1 - k}, {k + 1}) AS s, sum(a)::DOUBLE AS a, sum(r)::DOUBLE AS r FROM seen GROUP BY 1),
c{k} AS (SELECT substr(s, 1, {k}) AS c, sum(a) AS n_a, sum(r) AS n_r, (count(*) FILTER (WHERE a > 0))::DOUBLE AS k_a, (count(*) FILTER (WHERE r > 0))::DOUBLE AS k_r FROM l{k} GROUP BY 1),
p{k} AS (SELECT l.s, CASE WHEN n_a >= {url_filter.MIN_CONTEXT} THEN (l.a + k_a * p_a) / (n_a + k_a) ELSE p_a END AS p_a,
    CASE WHEN n_r >= {url_filter.MIN_CONTEXT} THEN (l.r + k_r * p_r) / (n_r + k_r) ELSE p_r END AS p_r
  FROM l{k} l JOIN c{k} ON c = substr(l.s, 1, {k}) JOIN p{k - 1} p ON p.s = substr(l.s, 2, {k}))"""
    for k in range(_K + 1)
).replace("FROM seen GROUP BY 1),\n", "FROM seen GROUP BY 1),\np0 AS (SELECT s, (a + 1) / (sum(a) OVER () + count(*) OVER ()) AS p_a, (r + 1) / (sum(r) OVER () + count(*) OVER ()) AS p_r FROM l0),\n", 1)
OP1_SQL = f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts),
rowed AS (
  SELECT row_number() OVER () AS r, *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS good,
    substr(md5(url), 1, 1) IN ('0','1','2','3','4') AS held,
    chr(2) || chr(2) || chr(2) || chr(2) || translate(coalesce(url, ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS pad FROM ruled),
grams AS (
  SELECT r, good, held, substr(pad, i, {_K + 1}) AS g FROM (SELECT r, good, held, pad, unnest(range(1, length(pad) - {_K} + 1)) AS i FROM rowed)),
seen AS (
  SELECT g, count(*) FILTER (WHERE good = 1 AND NOT held) AS a, count(*) FILTER (WHERE good = 0 AND NOT held) AS r FROM grams GROUP BY g),
{_LEVELS},
model AS (SELECT s AS g, CAST(floor((ln(p_a) - ln(p_r)) * {url_filter.UNIT} + 0.5) AS BIGINT) AS llr FROM p{_K}),
sums AS (SELECT r, sum(llr) AS s, count(*) AS n FROM grams JOIN model USING (g) GROUP BY r),
scored AS (
  SELECT rowed.*, CAST(greatest(-{url_filter.MOST}, least({url_filter.MOST}, floor(coalesce(s, 0)::DOUBLE / (greatest(coalesce(n, 0), 1) * {url_filter.BIN})))) AS BIGINT) AS score_bin
  FROM rowed LEFT JOIN sums USING (r)),
bins AS (
  SELECT bin, sum(good) AS a, sum(1 - good) AS r FROM (SELECT score_bin AS bin, good FROM scored WHERE good IS NOT NULL AND held) GROUP BY bin),
filled AS (SELECT bin, sum(a) AS a, sum(r) AS r FROM (SELECT * FROM bins UNION ALL SELECT 0, 0, 0) GROUP BY bin),
curve AS (
  SELECT bin, sum(a) OVER () - coalesce(sum(a) OVER up, 0) AS a_ge, coalesce(sum(r) OVER up, 0) AS r_lt, sum(a) OVER () AS na, sum(r) OVER () AS nr
  FROM filled WINDOW up AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT bin FROM curve ORDER BY a_ge * nr + r_lt * na DESC, abs(bin), bin LIMIT 1)
SELECT page_id, host, path, rule, CASE WHEN good = 1 THEN 'allow' WHEN good = 0 THEN 'block' WHEN coalesce(url, '') = '' THEN 'block'
  WHEN score_bin >= (SELECT bin FROM best) THEN 'allow' ELSE 'block' END AS verdict, score_bin
FROM scored
"""

_WHITE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP10_SQL = f"""
WITH cut AS (
  SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), {_WHITE}, '     '), ' '), lambda x: x <> '') AS words,
    translate(coalesce(text, ''), {_WHITE} || ' ', '') AS bare,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: translate(x, {_WHITE} || ' ', '') <> '') AS lines FROM documents),
base AS (
  SELECT doc_id, words, len(words) AS n_words, length(bare) AS word_chars, length(bare) - length(translate(bare, '{rule_ledger.SYMBOLS}', '')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM cut),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, n_words - 6)) AS i FROM base WHERE n_words >= 8)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
spread AS (SELECT DISTINCT doc_id, i + k AS at FROM repeated, (SELECT unnest(range(8)) AS k)),
covered AS (SELECT doc_id, count(*) AS n FROM spread GROUP BY doc_id),
ledger AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM base LEFT JOIN covered USING (doc_id)),
bits AS (
  SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (100 * n_dup_lines > 30 * n_lines)::INT
    + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 12 * n_words)::INT AS INT) AS fail_bits FROM ledger)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM bits
"""

ORACLE_SQL: dict[str, str] = {"op1_url_filter": OP1_SQL, "op10_quality_rules": OP10_SQL}
