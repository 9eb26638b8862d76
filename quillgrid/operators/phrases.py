"""The word n-grams that save most, exactly, without an exchange of those that can't be among them.

A first pass counts every n-gram in bins of its hash: a bin's count bounds those of its n-grams from above. The same pass counts the
likely best n-grams of each stretch of words by their text, which bounds their counts from below. The second pass counts exactly, and
passes over only what its bin proves to save less than as many others as are asked for. No input is left out of either pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.store import shared_folder

BITS, BLOCK, STRETCH, LIKELY, PORTION = 22, 1 << 16, 1 << 18, 1 << 14, 1 << 24
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Stretch:
    """The n-grams of one length that begin in a stretch of words: first word, bin of the hash and bytes of each."""

    def __init__(self, flat: pa.Array, n: int, at: np.ndarray, bins: np.ndarray, size: np.ndarray):
        self.flat, self.n, self.at, self.bins, self.size = flat, n, at, bins, size

    def texts(self, chosen: np.ndarray) -> pa.Array:
        at = self.at[chosen]
        parts = self.flat.take(pa.array((at[:, None] + np.arange(self.n)).ravel()))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * self.n, pa.int32()), parts)
        return pc.binary_join(lists, " ")


def stretches(batch: pa.RecordBatch, low: int, high: int, min_bytes: int) -> Iterator[Stretch]:
    """N-grams within the texts of a batch, whose first column holds lists of words; a few at a time however long a text is."""
    column = batch.column(0)
    flat, counts = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    if not len(flat):
        return
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy()
    distinct = coded.dictionary.cast(pa.binary())
    values = pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)[ids]
    sizes = pc.binary_length(distinct).to_numpy().astype(np.int64)[ids]
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(flat))
    for begin in range(0, len(flat), STRETCH):
        end = min(begin + STRETCH, len(flat))
        hashes, size = values[begin:end].copy(), sizes[begin:end].copy()
        for n in range(2, high + 1):
            more = len(flat) - begin - n + 1
            if more <= 0:
                break
            hashes, size = hashes[:more], size[:more]
            hashes *= _P
            hashes += values[begin + n - 1 : begin + n - 1 + len(hashes)]
            size += 1 + sizes[begin + n - 1 : begin + n - 1 + len(size)]
            if n >= low:
                at = np.flatnonzero((left[begin : begin + len(size)] >= n) & (size >= min_bytes))
                h = hashes[at]
                h ^= h >> np.uint64(32)
                yield Stretch(flat, n, begin + at, (h * _Q + np.uint64(n)) * _P >> np.uint64(64 - BITS), size[at])


def most_savings(counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (counts - 1) * np.maximum(size - 4, 0)


def bounds(rows: DataFrame, low: int, high: int, min_bytes: int, most: int) -> DataFrame:
    """Blocks of bin counts, and n-grams with how often they were seen at least, of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.zeros(1 << BITS, dtype=np.uint32), Counter()
        for batch in batches:
            for s in stretches(batch, low, high, min_bytes):
                np.add.at(table, s.bins, 1)
                hope = most_savings(table[s.bins].astype(np.float64), s.size)
                likely = np.argpartition(hope, -LIKELY)[-LIKELY:] if len(hope) > LIKELY else np.arange(len(hope))
                likely = likely[np.cumsum(s.size[likely]) <= PORTION]
                for x in pc.value_counts(s.texts(likely)).to_pylist():
                    if x["counts"] > 1:
                        seen[x["values"]] += x["counts"]
            if len(seen) > 64 * LIKELY:
                seen = Counter(best(seen, 8 * LIKELY))
        codec = pa.Codec("zstd", compression_level=1)
        blocks = [(k, codec.compress(part.tobytes(), asbytes=True)) for k, part in enumerate(table.reshape(-1, BLOCK)) if part.any()]
        for k, data in blocks:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], ["block", "counts", "gram", "n"])
        top = best(seen, 64 * most)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(top), pa.int32()), pa.nulls(len(top), pa.binary()), pa.array(list(top), pa.string()), pa.array(list(top.values()), pa.int64())], ["block", "counts", "gram", "n"])

    def best(seen: Counter, k: int) -> dict[str, int]:
        return dict(sorted(seen.items(), key=lambda x: (x[1] - 1) * (len(x[0].encode("utf-8", "replace")) - 4), reverse=True)[:k])

    return rows.mapInArrow(run, "block int, counts binary, gram string, n long")


def bin_counts(found: DataFrame) -> np.ndarray:
    """The bins' counts over all tasks, rounded up to the next number of 32 bits."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        codec = pa.Codec("zstd")
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(codec.decompress(data, decompressed_size=4 * BLOCK, asbytes=True), dtype=np.uint32)
                sums[k] = sums[k] + part if k in sums else part.astype(np.uint64)
        for k, total in sums.items():
            up = np.where(total > 0, np.nextafter(total.astype(np.float32), np.float32(np.inf)), np.float32(0))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([up.astype(np.float32).tobytes()], pa.binary())], ["block", "counts"])

    out = np.zeros(1 << BITS, dtype=np.float32)
    for r in found.filter("block is not null").select("block", "counts").repartition("block").mapInArrow(add, "block int, counts binary").toLocalIterator():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], dtype=np.float32)
    return out


def candidates(df: DataFrame, text: str, most: int, low: int, high: int, least: int, min_bytes: int) -> DataFrame:
    """Parts of the counts of every n-gram that may be among the ``most`` that save most; those of one n-gram add up to its count."""
    spark = df.sparkSession
    rows = df.select(words(F.col(text)).alias("words"))
    folder = shared_folder(spark, "phrases")
    bounds(rows, low, high, min_bytes, most).write.parquet(folder)
    found = spark.read.parquet(folder)
    sure = found.filter("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) & (F.octet_length("gram") >= 4))
    proven = [r["s"] for r in sure.select(((F.col("n") - 1) * (F.octet_length("gram") - 4)).alias("s")).orderBy(F.desc("s")).limit(most).collect()]
    floor = min(proven) if len(proven) == most else 0
    counts = spark.sparkContext.broadcast(bin_counts(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in stretches(batch, low, high, min_bytes):
                bound = counts.value[s.bins].astype(np.float64)
                chosen = np.flatnonzero((bound >= least) & ((most_savings(bound, s.size) >= floor) | (floor <= 0)))
                for part in np.split(chosen, np.flatnonzero(np.diff(np.cumsum(s.size[chosen]) // PORTION)) + 1) if len(chosen) else ():
                    x = pc.value_counts(s.texts(part))
                    yield pa.RecordBatch.from_arrays([x.field("values"), x.field("counts")], ["gram", "n"])

    return rows.mapInArrow(run, "gram string, n long")


def top_ngrams(df: DataFrame, text: str = "text", most: int = 20, low: int = 3, high: int = 8, least: int = 3, min_bytes: int = 10) -> DataFrame:
    """The ``most`` rows of ``mining.ngrams`` that save most, of equal ones the first by text."""
    counts = candidates(df, text, most, low, high, least, min_bytes).groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return counts.withColumn("savings", ((F.col("n") - 1) * (F.octet_length("gram") - 4)).cast("long")).orderBy(F.desc("savings"), "gram").limit(most)
