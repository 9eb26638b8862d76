"""Quality rules as a bitmask ledger, in built-in functions only.

``measure`` evaluates every rule once: it stores the measurements and one failure bit for each rule. A policy is a version
with a mask of the bits that reject; applying another version, or asking what each rule adds, reads the ledger and never the
text again.

Defined cases: a null or empty text has no words, so it fails ``few_words``; a text in which no line has a word has no
duplicate lines; equal rows give equal ledger rows; a column of the input that is named like an output column is replaced
by it; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` is true; it is SQL over the measurements."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_passages", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 12 * n_words"),
)

#: The rules with one that judges repeated lines by their share of the characters too, and only where there are several.
ALL_RULES = (*RULES, Rule(6, "repeated_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines and 100 * dup_line_chars > 10 * word_chars"))

#: Versions of the policy: the rules that reject. Version 3 needs a ledger of ALL_RULES.
POLICIES = {
    1: ("few_words", "repeated_passages"),
    2: ("few_words", "repeated_passages", "symbols", "duplicate_lines", "short_words", "long_words"),
    3: ("few_words", "repeated_passages", "symbols", "repeated_lines", "short_words", "long_words"),
}
LATEST = 2


def mask(version: int, rules: tuple[Rule, ...] = RULES) -> int:
    return sum(1 << r.bit for r in rules if r.name in POLICIES[version])


def _bind(value: Column, body) -> Column:
    """``body`` of a lambda variable that holds ``value``: the value is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in windows of eight that occur at least twice in the text, the first occurrence included.

    Windows are compared by 64-bit hashes, folded from pairs, fours and eights of word hashes. A text without an equal pair,
    which array_distinct shows, needs no more. Otherwise the hashes are sorted with their positions: equal neighbours are
    repeats, and their positions, in order, cover at most eight words each.
    """

    def fold(h: Column, k: int) -> Column:
        return F.zip_with(F.slice(h, F.lit(1), F.size(h) - k), F.slice(h, F.lit(1 + k), F.size(h) - k), lambda a, b: F.xxhash64(a, b))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, n: F.struct(x.alias("h"), n.alias("n"))))

        def repeats(s: Column) -> Column:
            last = F.size(s) - 1
            near = lambda x, n: (((n > 0) & (F.get(s, F.greatest(n - 1, F.lit(0)))["h"] == x["h"])) | ((n < last) & (F.get(s, F.least(n + 1, last))["h"] == x["h"])))
            return F.array_sort(F.transform(F.filter(s, near), lambda x: x["n"]))

        start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("sum"))
        step = lambda acc, n: F.struct(n.alias("at"), (acc["sum"] + F.least(n - acc["at"], F.lit(WINDOW)).cast("long")).alias("sum"))
        return F.aggregate(_bind(pairs, repeats), start, step, lambda acc: acc["sum"])

    def of_hashes(h8: Column) -> Column:
        return F.when(F.size(F.array_distinct(h8)) == F.size(h8), F.lit(0).cast("long")).otherwise(covered(h8))

    def of_words(w: Column) -> Column:
        h = F.transform(w, lambda x: F.xxhash64(x))
        h8 = _bind(_bind(_bind(h, lambda x: fold(x, 1)), lambda x: fold(x, 2)), lambda x: fold(x, 4))
        return F.when(F.size(w) < WINDOW + 1, F.lit(0).cast("long")).otherwise(_bind(h8, of_hashes))

    return of_words(words)


def measurements(text: Column) -> Column:
    """One struct of all measurements of a text."""
    blank = F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))

    words = F.filter(F.split(blank, " "), lambda x: x != "")
    bare = F.translate(F.coalesce(text, F.lit("")), SPACE + " ", "")
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.translate(x, SPACE + " ", "") != "")
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    of_bare = lambda x: F.struct(F.length(x).cast("long").alias("word_chars"), (F.length(x) - F.length(F.translate(x, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    return F.struct(_bind(words, of_words).alias("w"), _bind(lines, of_lines).alias("l"), _bind(bare, of_bare).alias("b"))


def repeated_line_chars(text: Column) -> Column:
    """Characters, white space left out, of lines that came before in the text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.translate(x, SPACE + " ", "") != "")
    chars = lambda x: F.length(F.translate(F.array_join(x, ""), SPACE + " ", ""))
    return _bind(lines, lambda x: (chars(x) - chars(F.array_distinct(x))).cast("long"))


def measure(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger: the input's columns with measurements and ``fail_bits``, one bit for each failed rule."""
    name = "__m"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    m = F.col(f"`{name}`")
    got = docs.withColumn(name, measurements(F.col(f"`{text}`")))
    parts = {"n_words": m["w"]["n_words"], "word_chars": m["b"]["word_chars"], "n_symbols": m["b"]["n_symbols"], "n_lines": m["l"]["n_lines"], "n_dup_lines": m["l"]["n_dup_lines"], "n_repeat_words": m["w"]["n_repeat_words"]}
    if any("dup_line_chars" in r.fails for r in rules):
        parts["dup_line_chars"] = F.when(m["l"]["n_dup_lines"] >= 3, repeated_line_chars(F.col(f"`{text}`"))).otherwise(F.lit(0).cast("long"))
    taken = {k.lower() for k in parts} | {"fail_bits"}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken or c == text]
    out = got.select(*kept, *(v.alias(k) for k, v in parts.items()))
    return out.withColumn("fail_bits", sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in rules), F.lit(0)))


def apply_policy(ledger: DataFrame, version: int = LATEST, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with ``kept`` under a version of the policy."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(mask(version, rules)) == 0)


def ablations(ledger: DataFrame, version: int = LATEST, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail only it, and that would be kept without it.

    One pass over the bits; the result has a row for each rule.
    """
    on = [r for r in rules if r.name in POLICIES[version]]
    bits = F.col("fail_bits").bitwiseAND(mask(version, rules))
    aggs = [F.count_if(bits == 0).alias("kept")]
    for r in on:
        aggs += [F.count_if(bits.bitwiseAND(1 << r.bit) != 0).alias(f"failed_{r.bit}"), F.count_if(bits == 1 << r.bit).alias(f"only_{r.bit}")]
    total = ledger.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(f"failed_{r.bit}").alias("failed"), F.col(f"only_{r.bit}").alias("failed_only"), (F.col("kept") + F.col(f"only_{r.bit}")).alias("kept_without")) for r in on))
    return total.select(F.inline(rows))
