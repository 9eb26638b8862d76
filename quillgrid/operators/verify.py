"""Checks that a compacted text kept what matters, as columns over (original, compacted)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import any_of, lines

FALLBACK = 0.6


def min_retention(old: Column, new: Column) -> Column:
    return (F.octet_length(old) == 0) | (10 * F.octet_length(new) >= F.octet_length(old))


def error_lines(old: Column, new: Column) -> Column:
    bad = F.filter(lines(old), lambda x: any_of(F.lower(x), "error:", "warning:", "fatal:", "panic:", "exception:"))
    return F.forall(bad, lambda x: F.contains(new, F.trim(x)))


def file_paths(old: Column, new: Column) -> Column:
    """The first token with a slash of each of the first twenty lines that look like paths."""
    paths = F.slice(F.filter(lines(old), lambda x: any_of(x, "/", "\\") & F.contains(x, F.lit(".")) & (F.octet_length(x) < 200)), 1, 20)
    token = lambda x: F.regexp_extract(x, r"(\S*[/\\]\S*)", 1)
    return F.forall(paths, lambda x: F.contains(new, token(x)))


def json_keys(old: Column, new: Column) -> Column:
    """At least half of a JSON object's top keys are there."""
    keys = F.coalesce(F.json_object_keys(F.trim(old)), F.array().cast("array<string>"))
    here = F.size(F.filter(keys, lambda k: F.contains(new, k)))
    return ~F.trim(old).startswith("{") | (2 * here >= F.size(keys))


def diff_hunks(old: Column, new: Column) -> Column:
    return F.forall(F.filter(lines(old), lambda x: x.startswith("@@")), lambda x: F.contains(new, x))


def numeric_values(old: Column, new: Column) -> Column:
    """The first ten numbers of two characters or more."""
    runs = F.filter(F.split(old, r"[^0-9.\-]+"), lambda x: (F.octet_length(x) >= 2) & x.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"))
    return F.forall(F.slice(runs, 1, 10), lambda x: F.contains(new, x))


TOKEN = re.compile(r"`([^`\n]{1,200})`|\b[A-Z][A-Z0-9]*_[A-Z0-9_]+\b|https?://[^\s\"'<>)]+|(?<![\w.-])(?:[\w.-]+)?(?:/[\w.-]+)+/?|\bv?\d+\.\d+\.\d+(?:[-+][\w.]+)?\b")


def identifier_tokens(text: str, most: int = 500) -> list[str]:
    """Back-quoted code, environment variables, URLs, paths and versions, without repeats, in order."""
    found = {m.group(1) or m.group(0): None for m in TOKEN.finditer(text[: 1 << 20])}
    return list(found)[:most]


@F.pandas_udf(DoubleType())
def _kept_share(old: pd.Series, new: pd.Series) -> pd.Series:
    def one(a: str, b: str) -> float:
        tokens = identifier_tokens(a)
        return sum(t in b for t in tokens) / len(tokens) if tokens else 1.0

    return pd.Series([one(a or "", b or "") for a, b in zip(old, new, strict=True)])


def preservation(old: Column, new: Column) -> Column:
    """At least 85 percent of identifier-like tokens survive. Their scanner is a state machine, so this check alone is Python."""
    return _kept_share(old, new) >= 0.85


CHECKS = {"min_retention": min_retention, "error_lines": error_lines, "file_paths": file_paths, "json_keys": json_keys, "diff_hunks": diff_hunks, "numeric_values": numeric_values}


def confidence(passed: list[Column], preserved: Column) -> Column:
    """The share of passed checks, at most a half if identifiers were lost."""
    n = sum((p.cast("int") for p in passed), preserved.cast("int"))
    share = n / F.lit(float(len(passed) + 1))
    return F.when(preserved, share).otherwise(F.least(share, F.lit(0.5)))
