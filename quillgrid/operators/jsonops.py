"""JSON rewriting. Objects of unknown shape are walked in one vectorised pass; flat shapes have column forms.

Numbers keep their source digits; object keys come out sorted.
"""

from __future__ import annotations

import json
import math
import re
import statistics
from collections import Counter
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names and prefixes of fields that carry no content.
NOISE_NAMES = ("__v", "__typename", "etag", "_links", "_embedded", "cursor", "request_id", "x_request_id", "correlation_id")
NOISE_PREFIXES = ("_", "debug", "internal", "trace", "x_")
# Field names that have a short code from the start.
SHORT_FIELDS = {"status_code": "~s", "message": "~m", "timestamp": "~ts", "created_at": "~ca", "updated_at": "~ua", "deleted_at": "~da", "description": "~dc", "metadata": "~md", "properties": "~pp", "attributes": "~at", "parameters": "~pm", "configuration": "~cf", "environment": "~ev", "dependencies": "~dp", "permissions": "~pr", "resources": "~rs", "namespace": "~ns", "annotations": "~an", "error_code": "~ec", "error_message": "~em", "stack_trace": "~st"}


class Number(str):
    """A number's source digits."""

    __slots__ = ()


def parse(text: str) -> Any:
    return json.loads(text, parse_float=Number, parse_int=Number)


def dump(v: Any, ascii_only: bool = False) -> str:
    if isinstance(v, Number):
        return str(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=ascii_only)}:{dump(v[k], ascii_only)}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(dump(x, ascii_only) for x in v) + "]"
    return json.dumps(v, ensure_ascii=ascii_only)


def strip_nulls(v: Any) -> Any:
    """Without null fields at any depth; nulls in arrays stay."""
    if isinstance(v, dict):
        return {k: strip_nulls(x) for k, x in v.items() if x is not None}
    return [strip_nulls(x) for x in v] if isinstance(v, list) else v


def flatten(v: Any, depth: int = 3) -> Any:
    """Nested objects as dotted keys, down to ``depth``."""
    if not isinstance(v, dict):
        return v
    out: dict[str, Any] = {}

    def walk(prefix: str, x: dict, level: int) -> None:
        for k, y in x.items():
            name = f"{prefix}.{k}" if prefix else k
            if isinstance(y, dict) and level < depth:
                walk(name, y, level + 1)
            else:
                out[name] = y

    walk("", v, 1)
    return out


def keep_fields(v: Any, names: list[str]) -> Any:
    return {k: x for k, x in v.items() if k in names} if isinstance(v, dict) else v


def strip_fields(v: Any, paths: list[str]) -> Any:
    if isinstance(v, list):
        return [strip_fields(x, paths) for x in v]
    if not isinstance(v, dict):
        return v
    heads = {p for p in paths if "." not in p}
    below = lambda k: [p[len(k) + 1 :] for p in paths if p.startswith(k + ".")]
    return {k: strip_fields(x, below(k)) if below(k) else x for k, x in v.items() if k not in heads}


def truncate_strings(v: Any, most: int = 500) -> Any:
    if isinstance(v, Number):
        return v
    if isinstance(v, str):
        return v if len(v) <= most else v[:most] + "..."
    if isinstance(v, dict):
        return {k: truncate_strings(x, most) for k, x in v.items()}
    return [truncate_strings(x, most) for x in v] if isinstance(v, list) else v


def cell(v: Any) -> str:
    """A value in a table's cell."""
    if isinstance(v, dict):
        return "{%d keys}" % len(v)
    if isinstance(v, list):
        return f"[{len(v)} items]"
    if isinstance(v, str) and not isinstance(v, Number):
        return v if len(v.encode()) <= 50 else v[:47] + "..."
    return dump(v)


def collapse_arrays(v: Any, most: int = 5) -> Any:
    """Longer arrays become a table if their objects have the same keys, else their first items and a note."""
    if isinstance(v, dict):
        return {k: collapse_arrays(x, most) for k, x in v.items()}
    if not isinstance(v, list):
        return v
    if len(v) <= most:
        return [collapse_arrays(x, most) for x in v]
    if all(isinstance(x, dict) and x and sorted(x) == sorted(v[0]) for x in v):
        names = sorted(v[0])
        return ["\n".join([f"[table: {len(v)} rows]", "|".join(names), *("|".join(cell(x[n]) for n in names) for x in v)])]
    return [*(collapse_arrays(x, most) for x in v[:most]), f"... and {len(v) - most} more items"]


def project(v: Any, depth: int = 5, level: int = 0) -> Any:
    """Without noise fields, empty values and repeated dates; beyond ``depth`` objects become their number of keys."""
    if isinstance(v, list):
        return [project(x, depth, level) for x in v]
    if not isinstance(v, dict):
        return v
    if level >= depth:
        return {"summary": f"{len(v)} keys"}
    kept = {k: project(x, depth, level + 1) for k, x in v.items() if k not in NOISE_NAMES and not k.lower().startswith(NOISE_PREFIXES)}
    kept = {k: x for k, x in kept.items() if x not in ({}, [], "")}
    by_date: dict[str, list[str]] = {}
    for k in sorted(kept):
        x = kept[k]
        if k.endswith(("_at", "_date", "_time")) and isinstance(x, str) and len(x) >= 10 and "-" in x[:10]:
            by_date.setdefault(x[:10], []).append(k)
    for names in by_date.values():
        main = next((k for k in names if "created" in k), names[0])
        for k in names:
            if k != main:
                del kept[k]
    return kept


def keep_informative(v: Any, least: int = 2) -> Any:
    """An array's elements of at least the median entropy, those before there are ``least``, and a note on the others."""
    if not isinstance(v, list) or len(v) <= 2:
        return v
    scores = [byte_entropy_of_one(dump(x)) for x in v]
    middle, kept = statistics.median(scores), []
    for x, score in zip(v, scores, strict=True):
        if score >= middle or len(kept) < least:
            kept.append(x)
    gone = len(v) - len(kept)
    return [*kept, f"[{gone} low-information elements omitted]"] if gone else kept


def byte_entropy_of_one(text: str) -> float:
    data = text.encode()
    return -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values())


def kind_of(v: Any) -> str:
    """A value's kind by name, as scripts in browsers name it."""
    if isinstance(v, bool):
        return "boolean"
    return "number" if isinstance(v, Number) else "string" if isinstance(v, str) else "object"


def sample_array(v: Any, over: int = 5) -> Any:
    """A longer array as its number of elements, its first one's shape, and its first and middle element."""
    if not isinstance(v, list) or len(v) <= over:
        return v
    shape = {k: kind_of(x) for k, x in v[0].items()} if isinstance(v[0], dict) else {}
    return {"_sampled": True, "count": Number(len(v)), "shape": shape, "examples": [v[0], v[len(v) // 2]]}


#: The most elements an array keeps in each mode; None: all.
MODES = {"minimal": None, "default": 10, "aggressive": 5}


def squeeze(v: Any, mode: str = "default") -> str:
    """A value in the compact notation, without nulls and with long arrays collapsed, but for the minimal mode."""
    if mode == "minimal":
        return encode(v)
    return encode(collapse_arrays(strip_nulls(v), MODES[mode]))


def shorter(text: str | Column, *steps: Callable[[Any], Any], out: Callable[[Any], str] | None = None) -> Column:
    """The rewritten text where it has fewer bytes than the given one, else that."""
    given = F.col(text) if isinstance(text, str) else text
    new = rewrite(given, *steps, out=out or dump)
    return F.when(F.octet_length(new) < F.octet_length(given), new).otherwise(given)


BARE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def encode(v: Any) -> str:
    """A compact notation: no blanks, bare simple keys, ASCII only, with a mark in front."""

    def body(x: Any) -> str:
        if isinstance(x, dict):
            return "{" + ",".join((k if BARE.fullmatch(k) else json.dumps(k)) + ":" + body(x[k]) for k in sorted(x)) + "}"
        return "[" + ",".join(map(body, x)) + "]" if isinstance(x, list) else dump(x, ascii_only=True)

    return "TOON:" + body(v)


def decode(text: str) -> Any:
    """The value of a compact notation; errors name their place."""
    if not text.startswith("TOON:"):
        raise ValueError("position 0: no mark in front")
    reader = json.JSONDecoder(parse_float=Number, parse_int=Number)

    def value(at: int) -> tuple[Any, int]:
        head = text[at : at + 1]
        if head == "{":
            out, at = {}, at + 1
            while text[at : at + 1] != "}":
                if text[at : at + 1] == '"':
                    name, at = reader.raw_decode(text, at)
                else:
                    m = BARE.match(text, at)
                    if not m:
                        raise ValueError(f"position {at}: a key is expected")
                    name, at = m.group(), m.end()
                if text[at : at + 1] != ":":
                    raise ValueError(f"position {at}: a colon is expected")
                out[name], at = value(at + 1)
                if text[at : at + 1] == ",":
                    at += 1
                elif text[at : at + 1] != "}":
                    raise ValueError(f"position {at}: an object isn't closed")
            return out, at + 1
        if head == "[":
            items, at = [], at + 1
            while text[at : at + 1] != "]":
                x, at = value(at)
                items.append(x)
                if text[at : at + 1] == ",":
                    at += 1
                elif text[at : at + 1] != "]":
                    raise ValueError(f"position {at}: an array isn't closed")
            return items, at + 1
        try:
            return reader.raw_decode(text, at)
        except json.JSONDecodeError as e:
            raise ValueError(f"position {e.pos}: a value is expected") from None

    v, end = value(5)
    if end != len(text):
        raise ValueError(f"position {end}: more follows the value")
    return v


def rewrite(column: str | Column, *steps: Callable[[Any], Any], out: Callable[[Any], str] = dump) -> Column:
    """A column of JSON texts through all steps, parsed once; what is no JSON stays as it is."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                v = parse(t)
            except (TypeError, ValueError):
                return t
            for s in steps:
                v = s(v)
            return out(v)

        return texts.map(one)

    return run(column)


def field_names(text: Column) -> Column:
    """Every quoted name before a colon, at any depth."""
    return F.regexp_extract_all(text, F.lit(r'"([^"\\]+)"\s*:'), F.lit(1))


def learn_dictionary(df: DataFrame, text: str, least: int = 2, min_bytes: int = 4, most: int = 256) -> DataFrame:
    """Frequent field names with codes, at most ``most`` of them, the commonest first; fixed codes come before learned ones."""
    counts = df.select(F.explode(field_names(F.col(text))).alias("field")).groupBy("field").agg(F.count("*").alias("n"))
    known = counts.filter((F.octet_length("field") >= min_bytes) & (F.col("n") >= least) & ~F.col("field").isin(*SHORT_FIELDS))
    return known.orderBy(F.desc("n"), "field").limit(most - len(SHORT_FIELDS))


def apply_dictionary(df: DataFrame, text: str, learned: list[str], least_saved: int = 50) -> Column:
    """Field names by their codes, longest first, with a header of those used, if that saves more than ``least_saved`` bytes."""
    codes = SHORT_FIELDS | {f: f"~{len(SHORT_FIELDS) + n:X}" for n, f in enumerate(learned)}
    order = sorted(codes, key=lambda f: (-len(f.encode()), f))

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            used, x = [], t
            for f in order:
                if f'"{f}":' in x:
                    x = x.replace(f'"{f}":', f'"{codes[f]}":')
                    used.append(f"{codes[f]}={f}")
            header = f"§dict§{','.join(used)}\n"
            return header + x if len(t.encode()) - len((header + x).encode()) > least_saved else t

        return texts.fillna("").map(one)

    return run(text)
