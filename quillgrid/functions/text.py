"""Text primitives: lines, words, byte-based token estimates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a variable that holds ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(text: Column) -> Column:
    """Lines as an array: split at line feeds, without a last empty one or carriage returns; none for an empty text."""
    body = F.regexp_replace(text, "\n$", "")
    parts = F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(parts)


def join_lines(parts: Column, text: Column) -> Column:
    """Lines joined again, with a line feed at the end if ``text`` has one."""
    return F.concat(F.array_join(parts, "\n"), F.when(text.endswith("\n"), F.lit("\n")).otherwise(F.lit("")))


def words(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def token_estimate(text: Column) -> Column:
    """A token for every four bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4.0).cast("long")


def any_of(text: Column, *parts: str) -> Column:
    """Whether the text contains one of the parts."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def starts_with_any(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.startswith(p)
    return out


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
