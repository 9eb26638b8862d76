"""Queries over classifiers, routing and risk rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import table
from ..operators import classify as C
from ..operators import entropy as E
from ..registry import query
from .texts import LINES

#: Texts that set off the risk rules, made from customers alike in both engines.
RISKY = """SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'password: ' || c_name WHEN 1 THEN '-----BEGIN KEY ' || c_name WHEN 2 THEN 'thread panicked at ' || c_name || '  at main'
 WHEN 3 THEN 'ALTER TABLE t ADD COLUMN ' || c_name WHEN 4 THEN 'api_key=' || c_name WHEN 5 THEN 'fix: password: reset ' || c_name WHEN 6 THEN 'apiVersion: v1 kind: Secret ' || c_name
 WHEN 7 THEN 'our Privacy Policy for ' || c_name ELSE 'plain ' || c_name END AS text FROM customer"""


def risky(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey") % 9
    parts = ["password: ", "-----BEGIN KEY ", "thread panicked at ", "ALTER TABLE t ADD COLUMN ", "api_key=", "fix: password: reset ", "apiVersion: v1 kind: Secret ", "our Privacy Policy for ", "plain "]
    text = F.concat(F.element_at(F.array(*map(F.lit, parts)), (n + 1).cast("int")), F.col("c_name"), F.when(n == 2, "  at main").otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))


RISK_SQL = """x AS (SELECT c_custkey, text, lower(text) AS x FROM r),
g AS (SELECT *, (regexp_matches(trim(x), '^[0-9a-f]{7}') AND strlen(trim(x)) > 8) OR regexp_matches(trim(x), '^(feat|fix|chore|docs|refactor|test|ci|style|perf):') AS log FROM x),
f AS (SELECT c_custkey, text, (contains(x, 'panicked at') OR contains(x, 'traceback')) AND (contains(x, 'stack backtrace') OR contains(x, '  0:') OR contains(x, '  at ')) AS trace_frames,
  contains(x, 'stack trace') AND contains(x, '  at ') AS trace_text,
  regexp_matches(x, 'alter table|create table|drop table') AND regexp_matches(x, 'column|index|constraint|primary key|references') AS schema_change, contains(x, '-----begin') AS pem,
  regexp_matches(x, 'private_key|secret_key|api_key') AND regexp_matches(x, '[=:]') AND NOT log AS key_value, regexp_matches(x, 'password:|password=|password "') AND NOT log AS password,
  regexp_matches(x, 'terms of service|privacy policy|license agreement|gdpr') AS legal, contains(x, 'apiversion:') AND contains(x, 'kind:') AND regexp_matches(x, 'secret|configmap') AS cluster_config FROM g)"""
_ANY = "trace_frames OR trace_text OR schema_change OR pem OR key_value OR password OR legal OR cluster_config"


@query(f"WITH r AS ({RISKY}), {RISK_SQL} SELECT c_custkey, trace_frames, trace_text, schema_change, pem, key_value, password, legal, cluster_config, {_ANY} AS high_risk FROM f")
def risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risky(spark, sf_dir).select("c_custkey", *(c.alias(n) for n, c in C.risk_flags(F.col("text")).items()), C.is_high_risk(F.col("text")).alias("high_risk"))


@query(f"""WITH b AS (SELECT doc_id, text, unnest(string_split(text, '')) AS c FROM documents), e AS (SELECT doc_id, c, count(*)::DOUBLE AS n FROM b GROUP BY doc_id, c),
h AS (SELECT doc_id, round(-sum(n / strlen(text) * log2(n / strlen(text))), 6) AS entropy FROM e JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CASE WHEN strlen(text) < 100 THEN 'default' WHEN regexp_matches(lower(text), 'terms of service|privacy policy|license agreement|gdpr|-----begin') THEN 'safe' WHEN coalesce(entropy, 0) < 4.2 THEN 'aggressive' ELSE 'default' END AS mode
FROM documents LEFT JOIN h USING (doc_id)""")
def route_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing with a higher entropy limit than the default, at which both modes occur in these texts."""
    docs = table(spark, sf_dir, "documents")
    h = E.char_entropy(docs, "doc_id").select("doc_id", F.round("entropy", 6).alias("entropy"))
    mode = C.route(F.col("text"), F.coalesce("entropy", F.lit(0.0)) - (4.2 - 2.5))
    return docs.join(h, "doc_id", "left").select("doc_id", mode.alias("mode"))


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(list_slice({LINES}, 1, 20), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents)
SELECT doc_id, 2 * len(list_filter(ls, lambda x: regexp_matches(x, '[{{}};]$|^(fn|pub|let|const|import|def|class) |::|->|=>'))) < len(ls) AS prose,
  CAST(len(list_filter(ls, lambda x: regexp_matches(x, '^(fn|pub|let|const|var|def|class|import|from|use|return|if|for|while) |^(#|//|/\\*|\\*)|[{{}};)]$|->|=>|::|\\(\\)'))) AS INT) AS code_lines FROM l""")
def prose_or_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = F.transform(F.slice(C.lines(F.col("text")), 1, 20), lambda x: F.trim(x))
    return table(spark, sf_dir, "documents").select("doc_id", C.looks_like_prose(F.col("text")).alias("prose"), F.size(F.filter(ls, C.is_code_line)).alias("code_lines"))


@query(f"""WITH l AS (SELECT doc_id, text, {LINES} AS ls FROM documents)
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens,
  len(list_filter(range(3, len(ls) + 1), lambda i: ls[i] = ls[i - 1] AND ls[i] = ls[i - 2])) > 0 AS repetition, starts_with(text, 'diff --git ') OR contains(text, chr(10) || '@@ ') AS diff,
  3 * len(list_filter(list_slice(ls, 1, 10), lambda x: regexp_matches(x, '^([0-9]{{4}}[-/][0-9]{{2}}|\\[?(INFO|WARN|ERROR|DEBUG)\\]?|[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})'))) > len(list_slice(ls, 1, 10)) AS log,
  CAST((length(text) - length(replace(text, 'null', ''))) / 4 AS BIGINT) AS nulls, CAST(greatest(length(text) - length(replace(text, '{{', '')) - 1, 0) AS BIGINT) AS nested FROM l""")
def content_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.profile(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *(v.alias(k) for k, v in p.items() if k != "prose"))


KINDS = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '{"name": "' || p_name || '"}' WHEN 1 THEN 'import x' || chr(10) || 'fn main() {' || chr(10) || '  let a = 1;' || chr(10) || '}'
 WHEN 2 THEN '2024-01-02 10:00:00 [INFO] ' || p_name || chr(10) || '2024-01-02 10:00:01 [WARN] x' ELSE 'A part named ' || p_name || ' of ' || p_type END AS text, CASE p_partkey % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'code' WHEN 2 THEN 'log' ELSE 'prose' END AS kind FROM part"""


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 4
    text = F.when(n == 0, F.concat(F.lit('{"name": "'), "p_name", F.lit('"}'))).when(n == 1, "import x\nfn main() {\n  let a = 1;\n}").when(n == 2, F.concat(F.lit("2024-01-02 10:00:00 [INFO] "), "p_name", F.lit("\n2024-01-02 10:00:01 [WARN] x"))).otherwise(F.concat(F.lit("A part named "), "p_name", F.lit(" of "), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


@query(f"SELECT p_partkey, kind, kind AS weighted_kind, kind = 'json' AS is_json FROM ({KINDS})")
def content_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return kinds(spark, sf_dir).select("p_partkey", C.classify(t).alias("kind"), C.classify_weighted(t).alias("weighted_kind"), C.is_json(t).alias("is_json"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' WHEN 3 THEN 'unknown' ELSE 'yaml' END AS language, p_partkey % 3 <> 2 AS known_command FROM part""")
def language_and_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/src/"), F.col("p_brand"), F.element_at(F.array(*map(F.lit, (".rs", ".py", ".tsx", "", ".YML"))), (F.col("p_partkey") % 5 + 1).cast("int")))
    command = F.element_at(F.array(*map(F.lit, ("git status", "/usr/bin/CARGO build", "frobnicate --x"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    path = F.replace(path, F.lit("#"), F.lit("_"))
    return table(spark, sf_dir, "part").select("p_partkey", C.language_of(path).alias("language"), C.is_known_command(command).alias("known_command"))


@query("""SELECT o_orderkey, o_orderstatus = 'F' AS diff, o_orderpriority IN ('1-URGENT', '2-HIGH') AS commit_log FROM orders""")
def diff_and_commit_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "abcdef1 message\nfix: it").otherwise("some\ntext"), F.when(F.col("o_orderstatus") == "F", "\n@@ -1 +1 @@").otherwise("\nend"))
    return o.select("o_orderkey", C.looks_like_diff(text).alias("diff"), C.looks_like_commit_log(text).alias("commit_log"))
