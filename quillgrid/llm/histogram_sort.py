"""Sharding by histogram sort: shards of near equal bytes, found by counting and filled in one exchange.

Rows are ordered by (hash of the text, doc_id, row number), so equal texts are neighbours and no two keys are equal. Boundaries
between shards are keys. Candidate keys (probes) are tried a few thousand at a time: every partition counts the exact bytes up
to each probe and gives the least and the greatest key between two. The sums narrow each boundary's interval until a
probe meets the tolerance, or until a single key is left. So a hot text is split over shards where it must be, and so are rows
that are equal in all they hold. Counting moves a row of sums for each probe; the driver holds the probes of a round and, in the
end, a key for each boundary, whatever the number of rows.

The rows move once, to blocks of their shard of about BLOCK_ROWS rows, dealt by the hash of the row number. A row's slot is its
rank in its block plus the count of the shard's blocks before, a prefix sum over a row for each block.

Law ``bytes``: sizes (UTF-8 bytes of the text plus 1) of shards differ from the mean by at most TOLERANCE of it or, where rows
are larger than that, by about a row. grown_shard is null, as shards move when their number grows.

Defined cases: a null text has the size and hash of the empty one; a null doc_id sorts before others; repeated rows are kept
each, and may be in several shards; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import materialise

TOLERANCE = 0.001
#: Rows of a block in which slots are ranked, on average; probes of a round.
BLOCK_ROWS, PROBES = 16_384, 4096
LEAST = -(1 << 63)

#: (hash, doc_id, row number)
Key = tuple[int, int, int]


def number_of(key: Sequence[int]) -> int:
    """The key as one whole number, in the same order."""
    out = 0
    for k in key:
        out = out << 64 | (k - LEAST)
    return out


def key_of(number: int) -> Key:
    part = (1 << 64) - 1
    return tuple((number >> shift & part) + LEAST for shift in (128, 64, 0))


#: The numbers below and of the greatest key.
BELOW, MOST = -1, (1 << 192) - 1


def below(cuts: np.ndarray, columns: Sequence[np.ndarray]) -> np.ndarray:
    """For each row, how many of the ascending cuts are less than its key."""
    if not len(cuts):
        return np.zeros(len(columns[0]), dtype=np.int64)
    first, starts = np.unique(cuts[:, 0], return_index=True)
    bounds = np.append(starts, len(cuts))
    at = np.searchsorted(first, columns[0], side="left")
    out = bounds[at]
    if len(columns) > 1:
        hit = np.flatnonzero((at < len(first)) & (first[np.minimum(at, len(first) - 1)] == columns[0]))
        order = hit[np.argsort(at[hit], kind="stable")]
        groups, begin = np.unique(at[order], return_index=True)
        for g, rows in zip(groups.tolist(), np.split(order, begin)[1:], strict=True):
            out[rows] = bounds[g] + below(cuts[bounds[g] : bounds[g + 1], 1:], [c[rows] for c in columns[1:]])
    return out


def count_between(rows: DataFrame, probes: list[int]) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """Exact bytes up to each probe, and the least and greatest key of the rows between two."""
    cuts = np.array([key_of(p) for p in probes], dtype=np.int64).reshape(-1, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, d, r, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "d", "r", "size"))
            at = below(cuts, (h, d, r))
            order = np.lexsort((r, d, h, at))
            begin = np.flatnonzero(np.diff(at[order], prepend=-1))
            end = np.append(begin[1:], len(order)) - 1
            key = [pa.StructArray.from_arrays([pa.array(c[order[x]]) for c in (h, d, r)], names=["h", "d", "r"]) for x in (begin, end)]
            yield pa.record_batch([pa.array(at[order[begin]]), pa.array(np.add.reduceat(size[order], begin) if len(begin) else size), *key], names=["at", "bytes", "least", "most"])

    kind = "struct<h: long, d: long, r: long>"
    found = rows.select("h", "d", "r", "size").mapInArrow(run, f"at long, bytes long, least {kind}, most {kind}")
    sums = found.groupBy("at").agg(F.sum("bytes").alias("bytes"), F.min("least").alias("least"), F.max("most").alias("most"))
    size, ends = np.zeros(len(probes) + 1, dtype=np.int64), {}
    for x in sums.collect():  # a row for each probe at most
        size[x["at"]] = x["bytes"]
        ends[x["at"]] = number_of(x["least"]), number_of(x["most"])
    return np.cumsum(size), ends


def between(low: int, high: int, k: int) -> list[int]:
    """Up to k whole numbers above low and below high, evenly spread."""
    room = high - low - 1
    return [low + 1 + i for i in range(room)] if room <= k else [low + (i + 1) * (room + 1) // (k + 1) for i in range(k)]


def find_boundaries(rows: DataFrame, targets: list[int], slack: float) -> list[Key]:
    """For each target, a key up to which there are about so many bytes, ascending. Intervals (low, high] hold it: bytes up to low
    are less than the target, bytes up to high aren't."""
    low, high = [BELOW] * len(targets), [MOST] * len(targets)
    found: list[int | None] = [None] * len(targets)
    while open_ := [n for n, f in enumerate(found) if f is None]:
        probes = sorted({p for n in open_ for p in between(low[n], high[n], max(3, PROBES // len(open_)))} | {high[n] for n in open_})
        size, ends = count_between(rows, probes)
        for n in open_:
            at = int(np.searchsorted(size, targets[n], side="left"))
            before = int(size[at - 1]) if at else 0
            least, most = ends.get(at, (low[n], high[n]))
            # No row is between the probes and the ends of what lies between them.
            low[n], high[n] = least - 1, most
            off, end = min((abs(int(size[at]) - targets[n]), high[n]), (abs(before - targets[n]), low[n]))
            if off <= slack or least == most:
                found[n] = end
    return [key_of(max(0, f)) for f in sorted(found)]


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    id_ = F.col(f"`{key}`").cast("long")
    rows = docs.select(id_.alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.xxhash64(body).alias("h"), F.coalesce(id_, F.lit(LEAST)).alias("d"), F.monotonically_increasing_id().alias("r"))
    rows = materialise(rows)  # a row keeps its number
    whole = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    ends = find_boundaries(rows, [whole["b"] * k // shards for k in range(1, shards)], whole["b"] / shards * TOLERANCE) if whole["n"] else []
    cuts = np.array(ends, dtype=np.int64).reshape(-1, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = below(cuts, [batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "d", "r")])
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "size", "text_crc32", "r")), pa.array(at.astype(np.int32))], names=["doc_id", "size", "text_crc32", "r", "shard"])

    blocks = max(1, -(-whole["n"] // (shards * BLOCK_ROWS)))
    dealt = rows.mapInArrow(run, "doc_id long, size long, text_crc32 long, r long, shard int").withColumn("block", F.pmod(F.xxhash64("r"), F.lit(blocks)))
    counts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = counts.select("shard", "block", (F.sum("n").over(W.partitionBy("shard").orderBy("block")) - F.col("n")).alias("base"))
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("shard", "block").orderBy("r")) - 1)
    return ranked.join(before, ["shard", "block"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
