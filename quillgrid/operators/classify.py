"""Content classifiers and risk rules as column algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import any_of, let, lines, starts_with_any, token_estimate

# File extensions and their languages.
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "kt": "kotlin", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "scala": "scala", "sh": "bash", "html": "html", "css": "css", "sql": "sql", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml"}
# Prefixes of conventional commits.
COMMITS = ("feat:", "fix:", "chore:", "docs:", "refactor:", "test:", "ci:", "style:", "perf:")


def count_lines(ls: Column, test) -> Column:
    return F.size(F.filter(ls, test))


def is_json(text: Column) -> Column:
    return F.coalesce((F.trim(text) != "") & F.try_parse_json(F.trim(text)).isNotNull(), F.lit(False))


def looks_like_commit_log(text: Column) -> Column:
    """Of the first ten lines, a third or more begin with a short hash or a commit prefix (a line may count twice)."""
    ls = F.transform(F.slice(lines(F.lower(text)), 1, 10), lambda x: F.trim(x))
    hits = count_lines(ls, lambda x: (F.octet_length(x) > 8) & x.rlike("^[0-9a-f]{7}")) + count_lines(ls, lambda x: starts_with_any(x, *COMMITS))
    return (hits > 0) & (hits >= F.floor(F.size(ls) / 3))


def risk_flags(text: Column) -> dict[str, Column]:
    """One column for each risk rule, on the lower-case text."""
    x = F.lower(text)
    log = looks_like_commit_log(text)
    return {
        "trace_frames": any_of(x, "panicked at", "traceback") & any_of(x, "stack backtrace", "  0:", "  at "),
        "trace_text": F.contains(x, F.lit("stack trace")) & F.contains(x, F.lit("  at ")),
        "schema_change": any_of(x, "alter table", "create table", "drop table") & any_of(x, "column", "index", "constraint", "primary key", "references"),
        "pem": F.contains(x, F.lit("-----begin")),
        "key_value": any_of(x, "private_key", "secret_key", "api_key") & any_of(x, "=", ":") & ~log,
        "password": any_of(x, "password:", "password=", 'password "') & ~log,
        "legal": any_of(x, "terms of service", "privacy policy", "license agreement", "gdpr"),
        "cluster_config": F.contains(x, F.lit("apiversion:")) & F.contains(x, F.lit("kind:")) & any_of(x, "secret", "configmap"),
    }


def is_high_risk(text: Column) -> Column:
    out = F.lit(False)
    for c in risk_flags(text).values():
        out = out | c
    return out


def route(text: Column, entropy: Column) -> Column:
    """safe, aggressive or default; short texts are default whatever they hold."""
    return F.when(F.octet_length(text) < 100, "default").when(is_high_risk(text), "safe").when(entropy < 2.5, "aggressive").otherwise("default")


def looks_like_prose(text: Column) -> Column:
    def code(x: Column) -> Column:
        return x.rlike(r"[{};]$") | starts_with_any(x, "fn ", "pub ", "let ", "const ", "import ", "def ", "class ") | any_of(x, "::", "->", "=>")

    ls = F.filter(F.transform(F.slice(lines(text), 1, 20), lambda x: F.trim(x)), lambda x: x != "")
    return 2 * count_lines(ls, code) < F.size(ls)


def is_code_line(line: Column) -> Column:
    x = F.trim(line)
    return (x != "") & (x.rlike(r"^(fn|pub|let|const|var|def|class|import|from|use|return|if|for|while) |^(#|//|/\*|\*)|[{};)]$") | any_of(x, "->", "=>", "::", "()"))


def looks_like_diff(text: Column) -> Column:
    return starts_with_any(text, "diff --git ", "diff -") | any_of(text, "\n@@ ", "\n--- a/", "\n+++ b/")


def profile(text: Column) -> dict[str, Column]:
    """What the stage selection looks at."""
    ls = lines(text)
    first10 = F.slice(ls, 1, 10)
    repeats = let(ls, lambda a: F.exists(F.sequence(F.lit(2), F.greatest(F.size(a) - 1, F.lit(2))), lambda i: F.coalesce((F.get(a, i) == F.get(a, i - 1)) & (F.get(a, i) == F.get(a, i - 2)), F.lit(False))))
    return {
        "bytes": F.octet_length(text).cast("long"), "tokens": token_estimate(text), "repetition": repeats, "diff": looks_like_diff(text),
        "log": (F.size(first10) > 0) & (3 * count_lines(first10, lambda x: x.rlike(r"^(\d{4}[-/]\d{2}|\[?(INFO|WARN|ERROR|DEBUG)\]?|\d{2}:\d{2}:\d{2})")) > F.size(first10)),
        "prose": looks_like_prose(text), "nulls": F.regexp_count(text, F.lit("null")).cast("long"), "nested": F.greatest(F.regexp_count(text, F.lit(r"\{")) - 1, F.lit(0)).cast("long"),
    }


def classify(text: Column) -> Column:
    """json, code, log or prose by the first twenty lines."""
    t = F.trim(text)
    ls = F.transform(F.slice(lines(t), 1, 20), lambda x: F.trim(x))
    code = count_lines(ls, lambda x: x.rlike(r"[{};]$") | starts_with_any(x, "fn ", "def ", "class ", "import ") | any_of(x, "->", "::"))
    log = count_lines(ls, lambda x: any_of(x, "[INFO]", "[ERROR]", "[WARN]", "[DEBUG]") | x.startswith("20"))
    return F.when(t.rlike(r"^[\[{]") & is_json(t), "json").when(code > F.floor(F.size(ls) / 2), "code").when(log > F.floor(F.size(ls) / 3), "log").otherwise("prose")


def classify_weighted(text: Column) -> Column:
    """json, code, log, markdown or prose by weighted pattern hits."""
    t = F.trim(text)
    hits = [(r"(?m)^(import |from |require\(|#include|using |package )", 3), (r"(?m)^(def |fn |func |function |class |interface |struct |enum |const |let |var )", 3), (r"(?m)[{};]\s*$", 2), (r"(?m)^\s*(if|for|while|return|switch|case)\s*[\s(]", 2), (r"//|/\*|\*/|#\s|--\s", 1)]
    score = sum((F.when(t.rlike(p), w).otherwise(0) for p, w in hits), F.lit(0))
    ls = F.split(t, "\n", -1)
    logs = count_lines(ls, lambda x: F.trim(x).rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}|^\[?(INFO|WARN|ERROR|DEBUG|TRACE)\]?|^\d{2}:\d{2}:\d{2}"))
    return F.when(t.rlike(r"(?s)^[\[{].*[\]}]$") & is_json(t), "json").when(score >= 4, "code").when(10 * logs > 3 * F.size(ls), "log").when(t.rlike(r"(?m)^#{1,6}\s") & t.rlike(r"\n#{1,6}\s"), "markdown").otherwise("prose")


def language_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(table[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))], F.lit("unknown"))


# Commands whose output is known.
COMMANDS = ("git", "cargo", "npm", "yarn", "pnpm", "node", "python", "python3", "pip", "pytest", "go", "docker", "kubectl", "helm", "terraform", "aws", "gcloud", "az", "make", "cmake", "gcc", "g++", "clang", "rustc", "tsc", "eslint", "prettier", "jest", "mocha", "vitest", "ls", "find", "grep", "rg", "cat", "head", "tail", "curl", "wget", "ps", "df", "du", "tree", "java", "javac", "mvn", "gradle", "ruby", "bundle", "rake", "php", "composer", "dotnet", "swift")


def is_known_command(command: Column) -> Column:
    base = F.regexp_extract(F.lower(F.get(F.split(F.trim(command), r"\s+"), F.lit(0))), r"([^/\\]*)$", 1)
    return base.isin(*COMMANDS)
