"""Best-fit packing of token pieces into sequences of fixed capacity, planned on sizes alone.

Sizes are whole numbers up to the capacity, so the plan needs only how many pieces have each size: a table whose length the
capacity bounds, whatever the corpus is. On it, pieces above one third of the capacity are matched greedily, the largest with
the largest that still fits, so that no sequence takes more than two of them; smaller ones, largest first, then go where they
leave the smallest gap. Sequences with equal contents are handled as one run, so each step places many pieces at once. The
plan is a list of spans (size, first rank, count, first sequence, offset); a piece finds its place by its rank among
the pieces of its size. Ranks come from counts of hashed blocks of documents, so no task gathers all pieces of a size.

Defined cases: a null or empty text is a document of the end id alone; equal texts and repeated rows are packed each; an empty
table gives an empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .rans_store import with_end
from .shared import materialise, text_array, text_slices
from .words import library_words

#: Pieces that a block of the ranking holds on average, as long as there are at most so many blocks.
BLOCK_ROWS, MOST_BLOCKS = 1_000, 100_000


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole if it fits, else full ones after a first that may be shorter."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return [first] * (first > 0) + [capacity] * (n // capacity)


def cut_all(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``cut_lengths`` of all documents: for each piece its document, its number there and its length."""
    each = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), each)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    first = np.where(sizes > 0, (sizes - 1) % capacity + 1, 0)
    return row, piece, np.where(piece == 0, first[row], capacity)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Spans (size, first rank, count, first sequence, offset) that place ``counts[size]`` pieces of each size."""
    left = {s: n for s, n in counts.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("sizes must be from 1 to the capacity")
    used = dict.fromkeys(left, 0)
    spans: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, count) that have it
    sequences = 0

    def place(size: int, count: int, first: int, offset: int) -> None:
        spans.append((size, used[size], count, first, offset))
        used[size] += count
        left[size] -= count

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            gaps.setdefault(gap, []).append((first, count))

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for size in large:
        while left[size]:
            mate = next((m for m in large if left[m] - (m == size) > 0 and m <= capacity - size), None)
            count = left[size] if mate is None else min(left[size], left[mate]) if mate != size else left[size] // 2
            place(size, count, sequences, 0)
            if mate is not None:
                place(mate, count, sequences, size)
            leave(capacity - size - (mate or 0), sequences, count)
            sequences += count
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            gap = min((g for g in gaps if g >= size), default=None)
            if gap is None:  # new sequences: so many of this size in each as fit
                each = capacity // size
                whole, rest = divmod(left[size], each)
                for n, k in ((whole, each), (1, rest)):
                    if n and k:
                        for nth in range(k):
                            place(size, n, sequences, nth * size)
                        leave(capacity - k * size, sequences, n)
                        sequences += n
                continue
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            count = min(n, left[size])
            place(size, count, first, capacity - gap)
            leave(gap - size, first, count)
            leave(gap, first + count, n - count)
    return spans


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = library_words(tokenizer)
        for batch in text_slices(batches, "text"):
            ids, at = with_end(*words.encode(text_array(batch)), end_id)
            row, piece, length = cut_all(np.diff(at), capacity)
            ends = np.cumsum(length)
            data = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(data[a:b]) for a, b in zip((4 * (ends - length)).tolist(), (4 * ends).tolist(), strict=True)]
            yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(ends - length - at[row]), pa.array(length), pa.array(crc, pa.int64())], names=["k", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"k {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("k", key)


def pack_pieces(cut: DataFrame, key: str = "doc_id", capacity: int = 1024) -> DataFrame:
    """``cut`` (key, piece, length and more) with sequence_id and offset."""
    spark = cut.sparkSession
    cut = materialise(cut.withColumn("__n", F.monotonically_increasing_id()))
    total = cut.count()
    blocks = min(MOST_BLOCKS, max(1, -(-total // BLOCK_ROWS)))
    cut = cut.withColumn("__b", F.pmod(F.xxhash64(F.col("__n")), F.lit(blocks)))
    counts = cut.groupBy("length", "__b").agg(F.count("*").alias("n"))
    sizes = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    spans = plan(sizes, capacity)
    before = counts.select("length", "__b", (F.sum("n").over(W.partitionBy("length").orderBy("__b")) - F.col("n")).alias("__before"))
    rank = F.row_number().over(W.partitionBy("length", "__b").orderBy(F.col("__n"))) - 1
    ranked = cut.withColumn("__r", rank).join(before, ["length", "__b"]).withColumn("__rank", F.col("__before") + F.col("__r"))
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    for size, first, _, sequence, offset in spans:
        by_size.setdefault(size, []).append((first, sequence, offset))
    table = {s: tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(v), strict=True)) for s, v in by_size.items()}
    shared = spark.sparkContext.broadcast(table)  # its length is bounded by the capacity, not by the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            sequence, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                firsts, sequences, offsets = shared.value[size]
                span = np.searchsorted(firsts, ranks[rows], side="right") - 1
                sequence[rows], offset[rows] = sequences[span] + ranks[rows] - firsts[span], offsets[span]
            names = [c for c in batch.schema.names if not c.startswith("__")]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    columns = [c for c in cut.columns if not c.startswith("__")]
    ranked = ranked.select(*columns, "__rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if not f.name.startswith("__"))
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(pieces(docs, tokenizer, key, text, capacity, end_id), key, capacity)
