"""Exact and near duplicates, repeated lines, and line deltas."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.window import Window as W

from ..functions.text import join_lines, let, lines, terms

#: Fixed: tokens of a reference to earlier content, and how long one stays valid.
REFERENCE_TOKENS = 13
TTL_SECONDS = 1800


def with_hash(df: DataFrame, text: str = "text") -> DataFrame:
    """The content hash, and the reference that stands for the content: its first 16 hexadecimal digits."""
    return df.withColumn("hash", F.sha2(F.col(text), 256)).withColumn("ref", F.substring("hash", 1, 16))


def exact_dedup(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Each row's first occurrence; null texts are copies of each other. Partial aggregation reduces copies before anything moves."""
    hashed = with_hash(df, text)
    first = hashed.groupBy("hash").agg(F.min(key).alias("first_id"), F.count("*").alias("copies"))
    return join_hot(hashed, first)


#: Shares into which the rows of a hash are dealt.
SALTS = 8


def join_hot(rows: DataFrame, by_hash: DataFrame) -> DataFrame:
    """``rows`` with what ``by_hash`` has for their hash, also where it is null. One hash may be a third of all rows, so rows are dealt
    over shares, and each share has its own copy of the other side, a row for each hash."""
    known = lambda: F.coalesce("hash", F.lit("")).alias("__h")
    shares = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("__s")
    dealt = rows.select("*", known(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("__s"))
    other = by_hash.select(*(F.col(c) for c in by_hash.columns if c != "hash"), known(), shares)
    return dealt.join(other, ["__h", "__s"]).drop("__h", "__s")


def ttl_outcomes(lookups: DataFrame, keys: list[str], ts: str, seconds: int = TTL_SECONDS, order: list[str] | None = None) -> DataFrame:
    """fresh, ref or resend by the gap to the previous look-up of the same content, which renews it."""
    w = W.partitionBy(*keys).orderBy(ts, *(order or []))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    return lookups.withColumn("outcome", F.when(gap.isNull(), "fresh").when(gap < seconds * 1_000_000, "ref").otherwise("resend"))


def expand_refs(refs: DataFrame, stored: DataFrame, prefix: str = "prefix") -> DataFrame:
    """The stored hash of each prefix, if exactly one has it. Prefixes of one length join by equality."""
    n = F.length(prefix)
    joined = refs.withColumn("n", n).join(stored, F.col("hash").startswith(F.col(prefix)) & (F.substring("hash", 1, 4) == F.substring(prefix, 1, 4)), "left")
    return joined.groupBy(prefix).agg(F.count("hash").alias("matches"), F.min("hash").alias("h")).select(prefix, "matches", F.when(F.col("matches") == 1, F.col("h")).alias("hash"))


def lru_keep(entries: DataFrame, size: str, accessed: str, key: str, limit: int, group: list[str]) -> DataFrame:
    """Entries that stay when the least recently used go until the rest fits, within each cache (``group``)."""
    w = W.partitionBy(*group).orderBy(F.desc(accessed), F.desc(key))
    return entries.withColumn("kept_bytes", F.sum(size).over(w)).filter(F.col("kept_bytes") <= limit)


def shingles(text: Column, n: int) -> Column:
    """Lower-case word n-grams; of a text with fewer words, its words."""
    return let(terms(text), lambda w: F.when(F.size(w) < n, w).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))))


def hash60(s: Column) -> Column:
    """The first 15 hexadecimal digits of the MD5, as a number; other engines have the same."""
    return F.conv(F.substring(F.md5(s.cast("binary")), 1, 15), 16, 10).cast("long")


#: Rows of a text's hashes that are worked on at a time.
STEP = 1 << 14
BITS = np.arange(60, dtype=np.int64)


def _votes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bits that most of the weight sets, 0 without hashes."""

    def one(h, w) -> int:
        votes = np.zeros(60, dtype=np.int64)
        for at in range(0, 0 if h is None else len(h), STEP):
            bits = (np.asarray(h[at : at + STEP], dtype=np.int64)[:, None] >> BITS & 1) * 2 - 1
            votes += np.asarray(w[at : at + STEP], dtype=np.int64) @ bits
        return int(((votes > 0).astype(np.int64) << BITS).sum())

    for f in frames:
        yield f.assign(simhash=np.array([one(h, w) for h, w in zip(f["h"], f["w"], strict=True)], dtype=np.int64))[[f.columns[0], "simhash"]]


def simhash60(df: DataFrame, key: str, text: str = "text", n: int = 3, weight: Callable[[Column], Column] = lambda s: F.lit(1)) -> DataFrame:
    """60-bit SimHash by votes of word shingles, each with a weight of one or ``weight`` of the shingle. A text's shingles stay in
    its row, so nothing is exchanged; a null text and one without words have 0."""
    s = shingles(F.col(text), n)
    rows = df.select(key, F.transform(s, hash60).alias("h"), F.transform(s, lambda x: weight(x).cast("long")).alias("w"))
    return rows.mapInPandas(_votes, StructType([rows.schema[0], StructField("simhash", LongType())]))


def near_pairs(hashes: DataFrame, key: str, distance: int = 3, bands: int = 4) -> DataFrame:
    """Pairs within ``distance`` bits (fewer than ``bands``): some band of the fingerprint is equal. Distinct fingerprints are
    paired, so copies don't multiply; a fingerprint stands for its smallest key."""
    width = 60 // bands
    reps = hashes.groupBy("simhash").agg(F.min(key).alias(key))
    banded = reps.select(key, "simhash", F.posexplode(F.array(*(F.shiftright("simhash", b * width).bitwiseAND(F.lit((1 << width) - 1)) for b in range(bands)))).alias("band", "bucket"))
    a, b = banded.alias("a"), banded.alias("b")
    near = F.bit_count(F.col("a.simhash").bitwiseXOR(F.col("b.simhash")))
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & (near <= distance))
    return pairs.groupBy(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b")).agg(F.first(near).cast("int").alias("distance"))


PRIME, HASHES, ROWS = 2147483647, 64, 8


def _minima(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    i = np.arange(HASHES, dtype=np.int64)
    scale, shift = (2 * i + 1) * 7919, i * 104729

    def one(b) -> list[int]:
        least = np.full(HASHES, PRIME, dtype=np.int64)
        for at in range(0, len(b), STEP):
            least = np.minimum(least, ((np.asarray(b[at : at + STEP], dtype=np.int64)[:, None] * scale + shift) % PRIME).min(axis=0))
        return least.tolist()

    for f in frames:
        yield f.assign(signature=[one(b) for b in f["b"]])[[f.columns[0], "signature"]]


def minhash(df: DataFrame, key: str, text: str = "text", chars: int = 3) -> DataFrame:
    """64 minima over a text's distinct character n-grams, which stay in its row; null and shorter texts have the largest value
    everywhere, so they are alike."""
    at = lambda c: F.transform(F.slice(c, F.lit(1), F.greatest(F.size(c) - chars + 1, F.lit(0))), lambda x, i: F.concat(x, *(F.get(c, i + k) for k in range(1, chars))))
    grams = F.array_distinct(let(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), ""), lambda x: x != ""), at))
    base = lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 7), 16, 10).cast("long")
    rows = df.select(key, F.transform(grams, base).alias("b"))
    return rows.mapInPandas(_minima, StructType([rows.schema[0], StructField("signature", ArrayType(LongType()))]))


def bands(signatures: DataFrame, key: str) -> DataFrame:
    """Eight band hashes of eight rows each."""
    parts = F.array(*(F.md5(F.array_join(F.transform(F.slice("signature", 1 + b * ROWS, ROWS), lambda x: x.cast("string")), ",").cast("binary")) for b in range(HASHES // ROWS)))
    return signatures.select(key, F.posexplode(parts).alias("band", "bucket"))


def signature_jaccard(a: Column, b: Column) -> Column:
    """The share of equal positions of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(HASHES))


def signature_classes(signatures: DataFrame, key: str) -> DataFrame:
    """Each distinct signature with its least key ``rep`` and the number of its texts; copies are combined before anything moves."""
    return signatures.groupBy("signature").agg(F.min(key).alias("rep"), F.count("*").alias("members"))


def lsh_candidates(asked: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """For each text of ``asked`` (key, signature), every class of texts, its own too, that shares a band with it: the class's least
    key and its number of texts. Equal signatures among ``asked`` are looked up once, and a pair comes from its first shared band."""
    of = classes.select("rep", "members", "signature")
    mine = asked.select("signature").distinct().withColumn("__q", F.xxhash64("signature"))
    theirs = bands(of, "rep").alias("t")
    sides = bands(mine, "__q").alias("m")
    met = sides.join(theirs, ["band", "bucket"]).groupBy("__q", "rep").agg(F.count("*").alias("shared"))
    found = met.join(of.select("rep", "members"), "rep")
    # xxhash64 only names a signature here; the join back compares the signatures themselves.
    return asked.join(mine, "signature").join(found, "__q").select(key, "rep", "members", "shared")


def recent_candidates(rows: DataFrame, stream: str, order: str, key: str, text: str = "text", most: int = 10, least: float = 0.6) -> DataFrame:
    """For each text, the most recent of the ``most`` before it in its stream that shares enough lines with it, or none.

    Only keys are numbered by a window; texts meet by equality of (stream, number), ``most`` times. Equal texts qualify. Null
    texts count as empty, and an empty text is like an empty one only."""
    numbered = rows.select(stream, F.col(order).alias("__o"), F.col(key).alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    place = numbered.select(stream, "__o", "__k").withColumn("__n", F.row_number().over(W.partitionBy(stream).orderBy("__o", "__k"))).select("__k", "__n")
    numbered = numbered.join(place, "__k")
    back = numbered.select(stream, F.col("__k").alias("__id"), F.col("__t").alias("__new"), "__n", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("back")).withColumn("__n", F.col("__n") - F.col("back"))
    pairs = back.join(numbered.select(stream, "__n", F.col("__k").alias("__c"), F.col("__t").alias("__old")), [stream, "__n"])
    alike = line_similarity(pairs, "__old", "__new", ["__id", "back", "__c"]).filter(F.col("similarity") >= least)
    best = alike.groupBy("__id").agg(F.min_by(F.struct(F.col("__c").alias("candidate"), "similarity"), "back").alias("b"))
    return place.select("__k").join(best, F.col("__k") == F.col("__id"), "left").select(F.col("__k").alias(key), "b.candidate", "b.similarity")


def hybrid_similarity(bits: Column, lines_alike: Column, floor: float = 0.3) -> Column:
    """The share of equal fingerprint bits (of 60) if it is under ``floor``, else the texts' line similarity."""
    quick = 1 - F.bit_count(bits) / F.lit(60.0)
    return F.when(quick < floor, quick).otherwise(lines_alike)


def line_similarity(pairs: DataFrame, left: str, right: str, keys: list[str]) -> DataFrame:
    """Shared lines, with multiplicity, over the longer text's number of lines; both empty: 1, one empty: 0."""
    sides = pairs.select(*keys, lines(F.col(left)).alias("l"), lines(F.col(right)).alias("r"))
    counts = sides.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("l").alias("x")), F.struct(F.lit(1).alias("side"), F.col("r").alias("x")))).alias("s")).select(*keys, "s.side", F.explode("s.x").alias("line"))
    both = counts.groupBy(*keys, "line").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    shared = both.groupBy(*keys).agg(F.sum(F.least("n0", "n1")).alias("shared"))
    most = F.greatest(F.size("l"), F.size("r"))
    out = sides.join(shared, keys, "left")
    return out.select(*keys, F.when(most == 0, 1.0).otherwise(F.coalesce("shared", F.lit(0)) / most).alias("similarity"))


def condense(text: Column, most: int = 3) -> Column:
    """Runs of equal lines cut to ``most``. A line goes if the ``most`` lines before it equal it; no shuffle, no Python."""

    def cut(ls: Column) -> Column:
        def stays(x: Column, i: Column) -> Column:
            same = F.lit(True)
            for k in range(1, most + 1):
                same = same & (F.get(ls, F.greatest(i - k, F.lit(0))) == x)
            return (i < most) | ~same

        return F.filter(ls, stays)

    return join_lines(let(lines(text), cut), text)


def run_starts(ls: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: (i == 0) | (F.get(ls, i) != F.get(ls, F.greatest(i - 1, F.lit(0)))))


def fold_runs(text: Column, least: int = 3, mark: str = "×", key=None) -> Column:
    """Runs of at least ``least`` equal lines become one line with their number; lines are compared by ``key`` if given."""

    def fold(ls: Column) -> Column:
        keyed = F.transform(ls, key) if key else ls

        def of(ks: Column) -> Column:
            def runs(st: Column) -> Column:
                def one(start: Column, k: Column) -> Column:
                    n = F.coalesce(F.get(st, k + 1), F.size(ls)) - start
                    folded = F.concat(F.get(ls, start), F.lit(f" [{mark}"), n.cast("string"), F.lit("]"))
                    foldable = (n >= least) & (F.get(ks, start) != "") if key else n >= least
                    return F.when(foldable, folded).otherwise(F.array_join(F.slice(ls, start + 1, n), "\n"))

                return F.transform(st, one)

            return let(run_starts(ks), runs)

        return let(keyed, of)

    return F.when(text == "", text).otherwise(join_lines(let(lines(text), fold), text))


def strip_timestamp(line: Column) -> Column:
    """A log line without its leading date and time, trimmed; lines are compared by it."""
    x = F.regexp_replace(line, r"^\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}[.\d]*\s*", "")
    return F.trim(F.regexp_replace(x, r"^\[?\d{2}:\d{2}:\d{2}[.\d]*\]?\s*", ""))


def line_backrefs(df: DataFrame, key: str, text: str = "text", min_bytes: int = 12) -> DataFrame:
    """Later copies of a line (blanks collapsed, at least ``min_bytes``) become ``[→L<n>]``, n the first copy's number.

    The first positions come from a window over (key, line), so a long text's lines spread over tasks.
    """
    ex = df.select(key, F.col(text).endswith("\n").alias("tail"), F.posexplode_outer(lines(F.col(text))).alias("pos", "line"))
    norm = F.array_join(F.filter(F.split("line", r"\s+"), lambda x: x != ""), " ")
    ex = ex.withColumn("norm", norm).withColumn("first", F.min("pos").over(W.partitionBy(key, "norm")))
    out = F.when((F.octet_length("norm") >= min_bytes) & (F.col("first") < F.col("pos")), F.concat(F.lit("[→L"), (F.col("first") + 1).cast("string"), F.lit("]"))).otherwise(F.col("line"))
    parts = ex.withColumn("out", out).groupBy(key, "tail").agg(F.array_sort(F.collect_list(F.struct("pos", "out"))).alias("ls"), F.count_if((F.octet_length("norm") >= min_bytes) & (F.col("first") < F.col("pos"))).alias("replaced"))
    return parts.select(key, F.concat(F.array_join(F.transform("ls", lambda x: x["out"]), "\n"), F.when(F.col("tail"), "\n").otherwise("")).alias("text"), "replaced")


def positional_diff(old: Column, new: Column) -> Column:
    """Line numbers (from 1) at which two texts differ, compared by position."""
    return F.filter(F.transform(F.arrays_zip(lines(old).alias("o"), lines(new).alias("n")), lambda x, i: F.when(x["o"].eqNullSafe(x["n"]), F.lit(None)).otherwise(i + 1)), lambda i: i.isNotNull())


def delta_text(old: str, new: str, prefix: str, context: int = 2) -> tuple[str, int]:
    """A delta of two texts by their longest common lines: unchanged runs are skipped, deletions counted, insertions given."""
    a, b = old.split("\n"), new.split("\n")
    out, changed = [f"§delta:{prefix}§"], 0
    for tag, a0, a1, b0, b1 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            kept = a[a0:a1]
            if len(kept) > 2 * context:
                out += [" " + x for x in kept[:context]] + [f" @@ skip {len(kept) - 2 * context} unchanged lines @@"] + [" " + x for x in kept[-context:]]
            else:
                out += [" " + x for x in kept]
            continue
        changed += max(a1 - a0, b1 - b0)
        if a1 > a0:
            out.append(f"-[{a1 - a0} lines removed at L{a0 + 1}]")
        out += ["+" + x for x in b[b0:b1]]
    return "\n".join(out), changed


def line_deltas(pairs: DataFrame, keys: list[str], old: str, new: str, least: float = 0.6) -> DataFrame:
    """Deltas of pairs with enough lines in common; accepted if shorter than the new text, at a token for four bytes, five at least."""
    kinds = ", ".join(f"{k} {dict(pairs.dtypes)[k]}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for o, n in zip(f[old], f[new], strict=True):
                o, n = o or "", n or ""
                a, b = Counter(o.split("\n")), Counter(n.split("\n"))
                similarity = sum((a & b).values()) / max(sum(a.values()), sum(b.values()))
                delta, changed = delta_text(o, n, "0" * 16) if similarity >= least else ("", 0)
                accepted = bool(delta) and len(delta.encode()) < len(n.encode())
                rows.append((similarity, changed, accepted, max(len(delta.encode()) // 4, 5) if accepted else None, delta if accepted else None))
            yield pd.concat([f[keys].reset_index(drop=True), pd.DataFrame(rows, columns=["similarity", "changed", "accepted", "cost", "delta"])], axis=1).astype({"cost": "Int64"})

    return pairs.mapInPandas(run, f"{kinds}, similarity double, changed long, accepted boolean, cost long, delta string")


def sentence_near_dedup(sentences: list[str], distance: int = 3, shortest: int = 15) -> list[str]:
    """Sentences without those near a kept one, by 32-bit fingerprints of word hashes; short ones stay."""
    kept, prints = [], []
    for s in sentences:
        if len(s) >= shortest:
            votes = [0] * 32
            for w in s.lower().split():
                h = 0
                for c in w:
                    h = (h * 31 + ord(c)) & 0xFFFFFFFF
                for b in range(32):
                    votes[b] += 1 if h >> b & 1 else -1
            own = sum(1 << b for b in range(32) if votes[b] > 0)
            if any((own ^ p).bit_count() <= distance for p in prints):
                continue
            prints.append(own)
        kept.append(s)
    return kept
