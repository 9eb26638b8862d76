"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, a function of the letter and a seed. An n-gram's vector binds (multiplies) its
letters' vectors, each permuted (rotated) by its distance from the end; a text's vector bundles (sums) those of its n-grams,
with what is no letter as one blank. A language's prototype is the sum of its training texts' unit vectors. A text's language
is that of the prototype with the largest cosine, of equal ones the first by name.

All labelled training rows count, and what is gathered from them is one vector a language. Distinct n-grams of a batch are
bound once, KINDS of them at a time, and a batch's bundles are a sum of matrix products. The driver gets a vector for each
distinct label; labels are a closed set of languages, a few hundred at most, and 8 KB each.

Defined cases: a null text or one without a letter is ``und`` with score 0; equal texts get equal rows; rows with a null lang
train nothing; without training rows everything is ``und``; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_slices, texts_of

DIMENSIONS, N, SEED = 1024, 3, 7
UNKNOWN = "und"
#: Texts of a matrix product, and their most characters together.
ROWS, CHARS = 512, 1 << 21
#: Kinds of n-grams that are bound at a time, five kilobytes each.
KINDS = 1 << 12


@lru_cache(maxsize=20_000)
def letter_vector(code: int) -> np.ndarray:
    """The letter's vector; 0 is the blank."""
    return np.random.default_rng((SEED, code)).choice(np.array([-1, 1], dtype=np.int8), DIMENSIONS)


_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), dtype=np.int32, count=0x110000)
    return _letters


def codes_of(text: str) -> np.ndarray:
    """Lower-case letters with single blanks between and around words; nothing if there is no letter."""
    codes = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    return codes if codes.any() else np.zeros(0, dtype=np.int32)


def bound_vectors(kinds: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The vectors of n-grams, whose numbers have the places of their letters in ``symbols`` as digits."""
    k = len(symbols)
    places = [kinds // k ** (N - 1 - n) % k for n in range(N)]
    used, index = np.unique(np.concatenate(places), return_inverse=True)
    table = np.stack([letter_vector(int(symbols[u])) for u in used])
    bound = np.ones((len(kinds), DIMENSIONS), dtype=np.int8)
    for n, at in enumerate(np.split(index, N)):
        bound *= np.roll(table, N - 1 - n, axis=1)[at]
    return bound.astype(np.float32)


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's vector, and which texts have a letter."""
    all_codes = [codes_of(t) for t in texts]
    sizes = np.array([max(0, len(c) - N + 1) for c in all_codes])
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    flat = np.concatenate(all_codes) if all_codes else np.zeros(0, dtype=np.int32)
    has = sizes > 0
    if not has.any():
        return out, has
    seen = np.zeros(0x110000, dtype=bool)
    seen[flat] = True
    symbols = np.flatnonzero(seen)
    place = np.zeros(0x110000, dtype=np.int64)
    place[symbols] = np.arange(len(symbols))
    k = len(symbols)
    grams = []
    for c in all_codes:
        if len(c) >= N:
            p = place[c]
            g = p[: len(p) - N + 1]
            for n in range(1, N):
                g = g * k + p[n : len(p) - N + 1 + n]
            grams.append(g)
    grams = np.concatenate(grams)
    if k**N <= 1 << 22:
        present = np.zeros(k**N, dtype=bool)
        present[grams] = True
        kinds = np.flatnonzero(present)
        index = np.zeros(k**N, dtype=np.int64)
        index[kinds] = np.arange(len(kinds))
        grams = index[grams]
    else:
        kinds, grams = np.unique(grams, return_inverse=True)
    row = np.repeat(np.arange(int(has.sum())), sizes[has])
    total = np.zeros((int(has.sum()), DIMENSIONS), dtype=np.float32)
    ordered = len(kinds) > 16 * KINDS
    if ordered:
        order = np.argsort(grams, kind="stable")
        grams, row = grams[order], row[order]
    for low in range(0, len(kinds), KINDS):  # a slice of the kinds, however many there are
        some = kinds[low : low + KINDS]
        part = slice(*np.searchsorted(grams, [low, low + len(some)])) if ordered else np.flatnonzero((grams >= low) & (grams < low + len(some)))
        counts = np.bincount(row[part] * len(some) + grams[part] - low, minlength=len(total) * len(some)).reshape(len(total), len(some))
        total += counts.astype(np.float32) @ bound_vectors(some, symbols)
    out[has] = total
    return out, has


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros(v.shape, dtype=np.float64), where=norm > 0)


def runs(texts: list[str]) -> Iterator[range]:
    """Runs of texts of bounded number and size; a longer text is a run of its own."""
    start = held = 0
    for n, t in enumerate(texts):
        if n > start and (n - start >= ROWS or held + len(t) > CHARS):
            yield range(start, n)
            start, held = n, 0
        held += len(t)
    if len(texts) > start:
        yield range(start, len(texts))


def held_out(key: Column) -> Column:
    """Rows that never train: crc32 of the key as text leaves 1 when divided by 3. A null key counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language. A partition sends one vector for each language it holds, so the driver gets as much as the languages need."""
    rows = docs.filter(~held_out(F.col(f"`{key}`")) & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in text_slices(batches, "text"):
            texts, langs = texts_of(batch), np.array(batch.column(1).to_pylist(), dtype=object)
            for r in runs(texts):
                vectors, has = bundles([texts[n] for n in r])
                units = unit(vectors)
                own = langs[r.start : r.stop]
                for name in set(own[has]):
                    sums[name] = sums.get(name, 0) + units[has & (own == name)].sum(axis=0)
        for name, v in sums.items():
            # whole numbers add up alike in any order
            yield pa.record_batch([pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS), pa.int32()), pa.array(np.rint(v * (1 << 24)).astype(np.int64))], names=["lang", "d", "v"])

    total = rows.mapInArrow(run, "lang string, d int, v long").groupBy("lang", "d").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in total.collect():
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["d"]] = r["v"]
    return out


def predictor(prototypes: dict[str, np.ndarray]):
    """A function of texts that gives languages and scores, the cosine put from -1..1 to 0..1."""
    names = sorted(prototypes)
    matrix = unit(np.stack([prototypes[n] for n in names])).T if names else np.zeros((DIMENSIONS, 0))

    def predict(texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for r in runs(texts):
            vectors, has = bundles([texts[n] for n in r])
            if not names:
                has = np.zeros(len(r), dtype=bool)
            cosines = np.round(unit(vectors) @ matrix, 9)
            best = cosines.argmax(axis=1) if names else np.zeros(len(r), dtype=int)
            langs += [names[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
            scores += [float(min(1.0, max(0.0, (1 + c[b]) / 2))) if h else 0.0 for c, b, h in zip(cosines, best, has, strict=True)]
        return langs, scores

    return predict


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score of every row, learned from the rows that aren't held out."""
    predict = predictor(train(docs, key, text, lang))
    rows = docs.select(F.col(f"`{key}`").alias("k"), held_out(F.col(f"`{key}`")).alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            langs, scores = predict(texts_of(batch))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(langs), pa.array(scores, pa.float64())], names=["k", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"k {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("k", key)


def language_column(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Column:
    """A column of structs (lang, score) for ``docs``, learned from it, for filters that keep all other columns."""
    predict = predictor(train(docs, key, text, lang))

    @F.arrow_udf("lang string, score double")
    def identified(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for part in text_slices([pa.record_batch([texts], names=["text"])], "text"):
            some = predict(texts_of(part))
            langs += some[0]
            scores += some[1]
        return pa.StructArray.from_arrays([pa.array(langs), pa.array(scores, pa.float64())], names=["lang", "score"])

    return identified(F.col(f"`{text}`").cast("string"))
