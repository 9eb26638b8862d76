"""Source code: signatures, imports, call edges, summaries, by line patterns."""

from __future__ import annotations

import math
import statistics
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import any_of, let, lines, token_estimate
from .textops import line_range

# Line patterns of our own, by kind; they cover the usual forms of some twenty languages rather than their grammars.
IMPORT = r"^\s*(?:import|from|use|require|include|#include|using|package)\b\s*(.+?);?\s*$"
FUNCTION = r"^\s*(?:pub(?:\([a-z]+\))?\s+|export\s+|default\s+|async\s+|static\s+|public\s+|private\s+|protected\s+|override\s+|final\s+)*(?:fn|def|func|function|fun|sub)\s+([A-Za-z_$][\w$]*)"
CLASS = r"^\s*(?:pub\s+|export\s+|default\s+|abstract\s+|public\s+|final\s+|data\s+|sealed\s+)*(?:class|struct|interface|trait|enum|object|module|impl|type)\s+([A-Za-z_$][\w$]*)"


def symbols(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each line that declares something: its kind, name and number."""
    ex = df.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line"))
    kinds = [("import", IMPORT), ("function", FUNCTION), ("class", CLASS)]
    kind = F.coalesce(*(F.when(F.col("line").rlike(p), F.lit(k)) for k, p in kinds))
    name = F.coalesce(*(F.when(F.col("line").rlike(p), F.regexp_extract("line", p, 1)) for _, p in kinds))
    return ex.withColumn("kind", kind).withColumn("name", name).filter("kind is not null").select(key, (F.col("pos") + 1).alias("line_no"), "kind", "name", F.trim("line").alias("signature"))


def dependency_edges(df: DataFrame, path: str, text: str) -> DataFrame:
    """(src, dst): a file and what it imports."""
    return symbols(df, path, text).filter("kind = 'import'").select(F.col(path).alias("src"), F.regexp_replace("name", r"^[\"'<]|[\"'>].*$| import .*$", "").alias("dst")).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def to_precache(edges: DataFrame, files: DataFrame, cached: DataFrame, path: str) -> DataFrame:
    """Files that a cached file imports and that aren't cached."""
    wanted = edges.join(cached.select(F.col(path).alias("src")), "src", "left_semi").select(F.col("dst").alias(path)).distinct()
    return files.join(wanted, path, "left_semi").join(cached, path, "left_anti")


def call_edges(df: DataFrame, key: str, text: str) -> DataFrame:
    """(caller, callee): names called on lines after a function's declaration and before the next one's, that are functions too."""
    from pyspark.sql.window import Window as W

    ex = df.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line"))
    own = F.when(F.col("line").rlike(FUNCTION), F.regexp_extract("line", FUNCTION, 1))
    w = W.partitionBy(key).orderBy("pos")
    ex = ex.withColumn("own", own).withColumn("caller", F.last("own", ignorenulls=True).over(w))
    calls = ex.filter("own is null and caller is not null").select(key, "caller", F.explode(F.regexp_extract_all("line", F.lit(r"([A-Za-z_][\w]*)\("), F.lit(1))).alias("callee"))
    names = ex.filter("own is not null").select(key, F.col("own").alias("callee")).distinct()
    return calls.join(names, [key, "callee"]).select(key, "caller", "callee").distinct()


def outline(df: DataFrame, key: str, text: str) -> DataFrame:
    """A structural summary: imports in one line, then signatures in order, with tokens before and after."""
    s = symbols(df, key, text)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != "import", F.struct("line_no", "signature")))), lambda x: x["signature"]), "\n")
    imports = F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "import", F.col("name")))), ", ")
    out = s.groupBy(key).agg(F.concat(F.lit("imports: "), imports, F.lit("\n"), body).alias("outline"))
    return df.join(out, key).select(key, "outline", token_estimate(F.col(text)).alias("tokens_original"), token_estimate(F.col("outline")).alias("tokens_outline"))


def age_level(age: Column) -> Column:
    """How strongly a turn is compacted by its age."""
    return F.when(age < 10, "fresh").when(age < 20, "aging").when(age < 30, "old").otherwise("ancient")


def cascade(text: Column, age: Column) -> Column:
    """Fresh turns stay; aging ones lose blank lines, old ones keep lines of declarations and errors, ancient ones the first line."""
    ls = lines(text)
    solid = F.filter(ls, lambda x: F.trim(x) != "")
    marked = F.filter(ls, lambda x: x.rlike(FUNCTION) | x.rlike(CLASS) | x.rlike("(?i)error|warning|fail"))
    return F.when(age < 10, text).when(age < 20, F.array_join(solid, "\n")).when(age < 30, F.array_join(F.when(F.size(marked) > 0, marked).otherwise(F.slice(solid, 1, 3)), "\n")).otherwise(F.coalesce(F.get(solid, F.lit(0)), F.lit("")))


def _entropy(text: str) -> float:
    data = text.encode()
    return -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values()) if data else 0.0


def collapse_blocks(source: str) -> str:
    """Top-level blocks of less than the median entropy as their first line and a mark. A block starts at a line without indent
    that isn't blank and doesn't close a bracket; blank lines and comments between blocks stay."""
    blocks: list[tuple[bool, list[str]]] = []
    for line in source.split("\n"):
        plain = not line.strip() or line.startswith(("#", "//")) and not line.startswith(("#include", "#["))
        if line[:1] not in ("", " ", "\t", "}", ")", "]") and not plain:
            blocks.append((True, [line]))
        elif plain and line.strip() or not blocks:
            blocks.append((False, [line]))
        else:
            blocks[-1][1].append(line)
    scores = [_entropy("\n".join(x).rstrip()) for node, x in blocks if node]
    if not scores:
        return source
    middle, out = statistics.median(scores), []
    for node, x in blocks:
        body = "\n".join(x)
        end = body[len(body.rstrip()) :]
        out.append(x[0] + " /* … */" + end if node and _entropy(body.rstrip()) < middle else body)
    return "\n".join(out)


@F.pandas_udf(StringType())
def collapse_low_entropy(sources: pd.Series) -> pd.Series:
    return sources.map(collapse_blocks, na_action="ignore")


#: Fixed: the most tokens of a map.
MAP_TOKENS = 50


def file_map(df: DataFrame, path: str, text: str) -> DataFrame:
    """A file's name and number of lines, and its imports' number, classes and functions while all fit in ``MAP_TOKENS``."""
    names = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name"))))
    s = symbols(df, path, text).groupBy(path).agg(F.count_if(F.col("kind") == "import").alias("__i"), names("class").alias("__c"), names("function").alias("__f"))
    x = df.select(path, F.col(text).alias("__t")).join(s, path, "left")
    head = F.concat(F.lit("# "), F.regexp_extract(path, r"([^/]*)$", 1), F.lit(" ("), F.size(lines(F.coalesce("__t", F.lit("")))).cast("string"), F.lit(" lines)"))
    listed = lambda c, label: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}("), F.size(c).cast("string"), F.lit("): "), F.array_join(c, ", ")))
    parts = F.array_compact(F.array(head, F.when(F.col("__i") > 0, F.concat(F.lit("imports: "), F.col("__i").cast("string"))), listed("__c", "structs"), listed("__f", "fns")))
    cuts = let(parts, lambda p: F.transform(F.sequence(F.size(p), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(p, F.lit(1), n), "\n")))
    fitting = let(cuts, lambda c: F.coalesce(F.get(F.filter(c, lambda m: token_estimate(m) <= MAP_TOKENS), F.lit(0)), F.element_at(c, -1)))
    return x.select(path, fitting.alias("content"))


def read_files(df: DataFrame, path: str, text: str, mode: str, previous: str | None = None, first: int = 1, last: int = 1, context: int = 3, intent: tuple[str, ...] = ()) -> DataFrame:
    """``content`` of each file as ``mode`` gives it, with tokens before and after: full, map, signatures, diff (against the column
    ``previous``), aggressive (signatures of the collapsed file), entropy (low-entropy blocks collapsed), task (blocks with a word
    of ``intent``, all without one) or lines. Null texts count as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(path, t.alias("__t"), *([F.col(previous).alias("__p")] if previous else [F.lit(None).cast("string").alias("__p")]))
    if mode in ("map", "signatures", "aggressive"):
        source = rows.withColumn("__t", collapse_low_entropy("__t")) if mode == "aggressive" else rows
        made = file_map(source, path, "__t") if mode == "map" else outline(source, path, "__t").select(path, F.col("outline").alias("content"))
        out = rows.join(made, path, "left").withColumn("content", F.coalesce("content", "__t"))
    else:
        changed = let(lines(F.col("__p")), lambda old: let(lines(F.col("__t")), lambda new: F.filter(F.transform(new, lambda x, i: F.when(~F.get(old, i).eqNullSafe(x), F.struct((i + 1).alias("n"), x.alias("x")))), lambda r: r.isNotNull())))
        near = let(changed, lambda c: let(lines(F.col("__t")), lambda ls: F.array_join(F.filter(F.transform(ls, lambda x, i: F.when(F.exists(c, lambda r: F.abs(r["n"] - i - 1) <= context), F.concat(F.when(F.exists(c, lambda r: r["n"] == i + 1), F.lit("> ")).otherwise(F.lit("  ")), (i + 1).cast("string"), F.lit(": "), x))), lambda y: y.isNotNull()), "\n")))
        wanted = F.filter(F.split("__t", "\n\n"), lambda b: any_of(F.lower(b), *(w.lower() for w in intent)))
        forms = {
            "full": F.col("__t"), "entropy": collapse_low_entropy("__t"), "lines": line_range(F.col("__t"), first, last, context),
            "diff": F.when(F.col("__p").isNull(), F.col("__t")).when(F.col("__p") == F.col("__t"), "(no changes)").otherwise(near),
            "task": F.when(F.size(wanted) > 0, F.array_join(wanted, "\n\n")).otherwise(F.col("__t")) if intent else F.col("__t"),
        }
        if mode not in forms:
            raise ValueError(f"no such mode: {mode}")
        out = rows.withColumn("content", forms[mode])
    return out.select(path, F.lit(mode).alias("mode"), "content", token_estimate(F.col("__t")).alias("tokens_original"), token_estimate(F.col("content")).alias("tokens_result"))
