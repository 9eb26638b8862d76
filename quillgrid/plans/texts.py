"""Queries over text rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, table
from ..operators import textops as T
from ..registry import query

LINES = "string_split(CASE WHEN ends_with(text, chr(10)) THEN substr(text, 1, length(text) - 1) ELSE text END, chr(10))"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_chain(expr: str, steps) -> str:
    """Regular expressions in order, as DuckDB's function."""
    for p, r in steps:
        expr = f"regexp_replace({expr}, {q(p)}, {q(r.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
    return expr


def sql_replaces(expr: str, pairs) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {q(a)}, {q(b)})"
    return expr


def coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal lines from orders, some with colours."""
    o = table(spark, sf_dir, "orders")
    plain = F.concat("o_orderstatus", F.lit(" "), "o_orderpriority")
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", plain).otherwise(F.concat(F.lit("\x1b[31;1m"), "o_orderstatus", F.lit("\x1b[0m \x1b]0;t\x07"), "o_orderpriority")).alias("text"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_orderstatus || ' ' || o_orderpriority ELSE o_orderstatus || ' ' || o_orderpriority END AS clean,
  CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 17 END AS removed FROM orders""")
def ansi_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = T.ansi_strip(F.col("text"))
    return coloured(spark, sf_dir).select("o_orderkey", clean.alias("clean"), (F.length("text") - F.length(clean)).cast("int").alias("removed"))


DIFFS = """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '-' WHEN l_returnflag = 'A' AND l_linenumber % 3 = 0 THEN '+' ELSE ' ' END || l_partkey || ' ' || l_linestatus AS line FROM lineitem"""


@query(f"""WITH l AS (SELECT l_orderkey, line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, line) - 1 AS pos FROM ({DIFFS})),
n AS (SELECT *, max(regexp_matches(line, '^(\\+|-|@@|diff |index )')::INT) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS near FROM l),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY l_orderkey, near ORDER BY pos) AS run FROM n),
c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, near, run) AS cnt, min(pos) OVER (PARTITION BY l_orderkey, near, run) AS first FROM r)
SELECT l_orderkey, string_agg(CASE WHEN near THEN line ELSE '[' || cnt || ' unchanged lines]' END, chr(10) ORDER BY pos) AS folded FROM c WHERE near OR pos = first GROUP BY l_orderkey""")
def diff_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    mark = F.when(F.col("l_returnflag") == "R", "-").when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") % 3 == 0), "+").otherwise(" ")
    line = F.concat(mark, F.col("l_partkey").cast("string"), F.lit(" "), "l_linestatus")
    diffs = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return T.fold_diff(diffs, "l_orderkey", "text")


SAMPLE = "'The implementation of ' || p_type || ' configuration, as well as ' || p_name || ' (REPOSITORY): in order to  use it'"


def part_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("The implementation of "), "p_type", F.lit(" configuration, as well as "), "p_name", F.lit(" (REPOSITORY): in order to  use it")).alias("text"))


@query(f"""SELECT p_partkey, replace(replace(replace({SAMPLE}, 'implementation', 'impl'), 'configuration', 'config'), 'REPOSITORY', 'repo') AS short FROM part""")
def word_abbreviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_prose(spark, sf_dir).select("p_partkey", T.abbreviate(F.col("text")).alias("short"))


@query(f"""WITH s AS (SELECT p_partkey, {SAMPLE} AS text FROM part), n AS (SELECT p_partkey, text, rtrim({sql_replaces(sql_chain("text", [("[ ]+", " ")]), T.PHRASES)}) AS x FROM s)
SELECT p_partkey, CASE WHEN strlen(x) < strlen(text) THEN x ELSE text END AS short FROM n""")
def phrase_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_prose(spark, sf_dir).select("p_partkey", T.substitute_if_shorter(F.col("text")).alias("short"))


_MESSY = "replace(replace(text, ' ', '  '), '. ', '.   ')"


@query(f"""SELECT doc_id, regexp_replace({sql_chain(_MESSY, [("[ \\t]+", " "), ("(^|\\n) +", "$1"), (" +(\\n|$)", "$1"), ("\\n{3,}", chr(10) * 2)])}, '\\s+$', '') AS clean FROM documents""")
def whitespace_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.replace(F.replace("text", F.lit(" "), F.lit("  ")), F.lit(". "), F.lit(".   "))
    return table(spark, sf_dir, "documents").select("doc_id", T.normalise_space(messy).alias("clean"))


_CODE = "CASE WHEN l_linenumber % 4 = 0 THEN '// note ' || l_partkey WHEN l_linenumber % 4 = 1 THEN 'x = ' || l_partkey WHEN l_linenumber % 4 = 2 THEN '' ELSE '#[test]' END"


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber AS i, {_CODE} AS line FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 99, 'end' FROM lineitem), k AS (SELECT * FROM l WHERE NOT starts_with(line, '// ')),
p AS (SELECT *, lag(line) OVER (PARTITION BY l_orderkey ORDER BY i, line) AS prev FROM k),
t AS (SELECT l_orderkey, string_agg(line, chr(10) ORDER BY i, line) AS code FROM p WHERE line <> '' OR prev IS NULL OR prev <> '' GROUP BY l_orderkey)
SELECT DISTINCT l_orderkey, coalesce(code, '') AS code FROM lineitem LEFT JOIN t USING (l_orderkey) WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 2)""")
def comment_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    part = F.col("l_partkey").cast("string")
    line = F.when(n == 0, F.concat(F.lit("// note "), part)).when(n == 1, F.concat(F.lit("x = "), part)).when(n == 2, F.lit("")).otherwise("#[test]")
    code = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"), F.count("*").alias("n")).filter("n > 2").withColumn("text", F.concat("text", F.lit("\nend")))
    return code.select("l_orderkey", T.strip_comments(F.col("text")).alias("code"))


_TALK = "'I think that ' || p_name || ' is really very good. Of course, ' || p_type || ' does not break; however it is ' || p_brand"


@query(f"SELECT p_partkey, {sql_chain(_TALK, [('(?i)' + p, '') for p in T.FILLERS])} AS text FROM part")
def filler_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = F.concat(F.lit("I think that "), "p_name", F.lit(" is really very good. Of course, "), "p_type", F.lit(" does not break; however it is "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", T.strip_fillers(talk).alias("text"))


def _sql_prose(expr: str) -> str:
    x = sql_chain(expr, [("(?i)" + p, "") for p in T.FILLERS])
    for a, b in T.PROSE_PHRASES:
        x = sql_replaces(x, [(a, b), (a[0].upper() + a[1:], b[0].upper() + b[1:])])
    steps = [(r"\b(The|the|A|a|An|an)\s+([a-z])", "$2"), (rf"(?i)\b({T.THAT_VERBS})\s+that\b", "$1"), *((rf"(?i)\b{a}\b", b) for a, b in T.VERBS), (rf"(?m)^({T.TRANSITIONS})\s*,?\s+", ""), *((rf"\b{a}\b", b) for a, b in T.CONTRACTIONS), (rf"(?i)\b({T.ADVERBS})\s+", ""), ("  +", " "), ("\\n ", "\n"), ("\\n{3,}", "\n\n"), (" ([.,;:!?])", "$1"), ("\\s+$", "")]
    return sql_chain(x, steps)


@query("WITH s AS (SELECT p_partkey, " + _TALK + " || ' in order to show that the part is able to work' AS t FROM part), " + "a AS (SELECT p_partkey, " + sql_chain("t", [("(?i)" + p, "") for p in T.FILLERS]) + " AS t FROM s), b AS (SELECT p_partkey, replace(replace(t, 'in order to', 'to'), 'is able to', 'can') AS t FROM a) SELECT p_partkey, " + sql_chain("t", [(r"\b(The|the|A|a|An|an)\s+([a-z])", "$2"), (rf"(?i)\b({T.THAT_VERBS})\s+that\b", "$1"), *((rf"\b{a}\b", b) for a, b in T.CONTRACTIONS), (rf"(?i)\b({T.ADVERBS})\s+", ""), ("  +", " "), (" ([.,;:!?])", "$1")]) + " AS text FROM b")
def prose_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = F.concat(F.lit("I think that "), "p_name", F.lit(" is really very good. Of course, "), "p_type", F.lit(" does not break; however it is "), "p_brand", F.lit(" in order to show that the part is able to work"))
    return table(spark, sf_dir, "part").select("p_partkey", T.tighten_prose(talk).alias("text"))


_MD = "'## ' || p_name || chr(10) || '**' || p_brand || '** and *' || p_type || '*' || chr(10) || '---' || chr(10) || '* item'"


@query(f"SELECT p_partkey, {sql_chain(_MD, [(r'[*][*]([^*]+)[*][*]', '$1'), (r'[*]([^*]+)[*]', '$1'), (r'__([^_]+)__', '$1'), (r'_([^_]+)_', '$1'), (r'(?m)^#{1,6}\s+(.+)$', '$1:'), (r'(?m)^[-*_]{3,}\s*$', ''), (r'(?m)^(\s*)[-*+]\s+', '$1- ')])} AS text FROM part")
def markdown_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat(F.lit("## "), "p_name", F.lit("\n**"), "p_brand", F.lit("** and *"), "p_type", F.lit("*\n---\n* item"))
    return table(spark, sf_dir, "part").select("p_partkey", T.strip_markdown(md).alias("text"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'key [blob:' || (96 + 32 * (c_custkey % 3 + 1)) || 'ch] ' ELSE 'key ' || repeat('Ab3/', 20) || ' ' END || c_name AS text FROM customer""")
def blob_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    blob = F.when(F.col("c_custkey") % 2 == 0, F.expr("repeat('Ab3/', cast(24 + 8 * (c_custkey % 3 + 1) as int))")).otherwise(F.repeat(F.lit("Ab3/"), 20))
    return table(spark, sf_dir, "customer").select("c_custkey", T.strip_blobs(F.concat(F.lit("key "), blob, F.lit(" "), "c_name")).alias("text"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'see ~/a' || s_suppkey || '.rs and ~/b/c.rs' ELSE 'see /srv/a' || s_suppkey || '.rs' END AS text FROM supplier""")
def path_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    text = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("see /srv/projects/engine/a"), k, F.lit(".rs and /srv/projects/engine/b/c.rs"))).otherwise(F.concat(F.lit("see /srv/a"), k, F.lit(".rs")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.shorten_paths(text).alias("text"))


@query("""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])([ \\n])', concat('\\1', chr(1), '\\2'), 'g'), chr(1)) AS p FROM documents),
u AS (SELECT doc_id, trim(replace(x, chr(10), ' ')) AS x FROM (SELECT doc_id, unnest(p) AS x FROM s))
SELECT doc_id, count(*) FILTER (WHERE len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) >= 3) AS n,
  CAST(coalesce(sum(length(x)) FILTER (WHERE len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) >= 3), 0) AS BIGINT) AS chars FROM u GROUP BY doc_id""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query(f"""WITH l AS (SELECT conv_id, turn, text, {LINES} AS ls FROM conversations)
SELECT conv_id, turn, CASE WHEN strlen(text) >= 60 AND len(ls) > 3 THEN ls[1] || chr(10) || '[... ' || (len(ls) - 2) || ' lines, ' || strlen(text) || ' chars ...]' || chr(10) || ls[len(ls)] ELSE text END AS short,
  CASE WHEN strlen(coalesce(ls[1], '')) <= 80 THEN coalesce(ls[1], '') ELSE substr(ls[1], 1, 77) || '...' END AS headline FROM l""")
def summarise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.summarise(F.col("text"), 60).alias("short"), T.headline(F.col("text")).alias("headline"))


@query("""WITH t AS (SELECT doc_id, substr(text, 1, 16) AS head, string_split(substr(text, 17), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, head, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM t), r AS (SELECT doc_id, head, i, regexp_replace(x, '[ \\t]+$', '') AS x FROM u),
p AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM r)
SELECT doc_id, min(head) || string_agg(x, chr(10) ORDER BY i) AS text FROM p WHERE prev IS NULL OR x <> prev GROUP BY doc_id""")
def protected_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.protect_prefix(F.col("text"), 16).alias("text"))


@query(f"""SELECT conv_id, turn, {q(T.DIRECTIVES["high"])} || chr(10) || text AS text, '100→' || turn * 10 || ' tokens (' || (100 - turn * 10) || '% saved) ' || CASE WHEN turn > 5 THEN '✓' WHEN turn > 2 THEN '~' ELSE '⚠' END AS note FROM conversations""")
def directives_and_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.when(F.col("turn") > 5, 0.95).when(F.col("turn") > 2, 0.7).otherwise(0.3)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.with_directive(F.col("text"), "high").alias("text"), T.annotation(F.lit(100), F.col("turn") * 10, confidence).alias("note"))


@query(f"""WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, {LINES} AS s FROM documents))
SELECT doc_id, CAST(i AS INT) AS line_no, line FROM l WHERE contains(line, 'License')""")
def grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.grep(table(spark, sf_dir, "documents"), "doc_id", "text", "License")


@query(f"""WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, {LINES} AS s FROM documents))
SELECT doc_id, CAST(i AS INT) AS line_no, line FROM l WHERE regexp_matches(line, '[a-z0-9.]+@[a-z0-9.]+')""")
def grep_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.grep(table(spark, sf_dir, "documents"), "doc_id", "text", "[a-z0-9.]+@[a-z0-9.]+", regex=True)


@query(f"""WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, {LINES} AS s FROM documents))
SELECT doc_id, coalesce(string_agg(CASE WHEN i BETWEEN 4 AND 5 THEN '> ' ELSE '  ' END || i || ': ' || line, chr(10) ORDER BY i) FILTER (WHERE i BETWEEN 1 AND 8), '') AS lines FROM l GROUP BY doc_id""")
def line_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.line_range(F.col("text"), 4, 5).alias("lines"))


def _sql_html(expr: str) -> str:
    steps = [(r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", ""), *((rf"(?is)<h{n}[^>]*>", "\n" + "#" * n + " ") for n in range(1, 7)), (r"(?is)</h[1-6]>", "\n"), (r"(?is)<(p|br|div)[^>]*>", "\n"), (r"(?is)</(p|div)>", "\n"), (r"(?is)<li[^>]*>", "\n- "), (r"(?is)</?pre[^>]*>", "\n```\n"), (r"(?is)</?code[^>]*>", "`"), (r"(?is)</?(b|strong)>", "**"), (r"(?is)</?(i|em)>", "_"), (r"(?s)<[^>]*>", "")]
    x = sql_replaces(sql_chain(expr, steps), [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")])
    return "trim(" + sql_chain(x, [("[ \\t]+", " "), (" ?\\n ?", "\n"), ("\\n{3,}", "\n\n"), ("^\\n+|\\n+$", "")]) + ")"


HTML = _sql_html("html")


@query(f"SELECT page_id, {HTML} AS markdown FROM pages")
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_markdown(F.col("html")).alias("markdown"))


CHUNKS = f"""m AS (SELECT page_id, {HTML} AS text FROM pages), l AS (SELECT page_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT page_id, {LINES} AS s FROM m)),
n AS (SELECT *, CAST(sum(starts_with(line, '#')::INT) OVER (PARTITION BY page_id ORDER BY i) AS INT) AS chunk FROM l),
k AS (SELECT page_id, chunk, coalesce(max(trim(regexp_replace(line, '^#+', ''))) FILTER (WHERE starts_with(line, '#')), '') AS heading,
  regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT starts_with(line, '#')), ''), '^\\s+|\\s+$', '', 'g') AS body FROM n GROUP BY page_id, chunk),
chunks AS (SELECT * FROM k WHERE heading <> '' OR body <> '')"""


@query(f"WITH {CHUNKS} SELECT page_id, chunk, heading, body FROM chunks")
def heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = table(spark, sf_dir, "pages").select("page_id", T.html_to_markdown(F.col("html")).alias("text"))
    return T.heading_chunks(md, "page_id", "text")


@query()
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line blocks of at most 512 bytes; packing in order is sequential, so SQL has no short form."""
    return table(spark, sf_dir, "documents").select("doc_id", let(T.pack_blocks(F.col("text")), lambda b: F.struct(F.size(b).cast("long").alias("blocks"), F.aggregate(b, F.lit(0), lambda a, x: F.greatest(a, F.octet_length(x))).alias("longest"))).alias("s")).select("doc_id", "s.*")
