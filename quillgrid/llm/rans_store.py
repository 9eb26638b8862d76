"""Token ids in a binary store, coded by a static range asymmetric numeral system.

A row of the store is a group: one shared frequency table and the independent blocks coded with it. In a block, ids are dealt
over interleaved lanes, each with a 64-bit state; lanes share one stream of 32-bit words, which a reader takes in lane order.
Every CHECKPOINT steps the block holds all lanes' states and the stream's position, so segments can be decoded in parallel,
and each segment has a checksum of its ids. Groups hold whole documents in ascending order of their id, over numbered parts
that are ranges of the id; a part's files are ordinary Parquet, written by Spark and so committed once per task.

A group is closed at GROUP ids, which bounds the memory of writer and reader; a longer document is a group of its own, and
needs memory in proportion to its text, which a row holds anyway.

Defined cases: a null or empty text has the end id alone; a null doc_id sorts first; repeated rows and equal doc_ids are
stored each, in no fixed order among themselves; an empty table gives an empty store; other columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import shared_folder, text_array, text_slices
from .words import library_words

SCALE = 20  # frequencies sum to 2**SCALE; a vocabulary may have as many ids at most
LOW = np.uint64(1 << 31)
LANES, CHECKPOINT = 8192, 64
BLOCK = LANES * CHECKPOINT * 2
GROUP = 2 * BLOCK
MAGIC = b"QGR1"
U64 = np.uint64


class Table:
    """Frequencies of ids, scaled to 2**SCALE with at least one for each that occurs."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray):
        self.symbols, self.freqs = symbols.astype(np.uint32), freqs.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.freqs)[:-1]]).astype(np.uint64)
        self._rows: np.ndarray | None = None

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        if len(symbols) > 1 << SCALE:
            raise ValueError("more distinct ids than the table can hold")
        counts = counts[symbols].astype(np.float64)
        freqs = np.maximum(1, np.floor(counts * ((1 << SCALE) - len(symbols)) / counts.sum())).astype(np.int64)
        freqs[np.argmax(freqs)] += (1 << SCALE) - freqs.sum()
        return cls(symbols, freqs)

    def dump(self) -> bytes:
        gaps = np.diff(self.symbols.astype(np.int64), prepend=0).astype("<u4")
        return zlib.compress(gaps.tobytes() + self.freqs.astype("<u4").tobytes(), 1)

    @classmethod
    def load(cls, data: bytes) -> Table:
        raw = np.frombuffer(zlib.decompress(data), dtype="<u4").reshape(2, -1)
        return cls(np.cumsum(raw[0].astype(np.int64)), raw[1])

    def rows(self) -> np.ndarray:
        """The table's row of each id."""
        if self._rows is None:
            self._rows = np.zeros(int(self.symbols[-1]) + 1, dtype=np.uint32)
            self._rows[self.symbols] = np.arange(len(self.symbols), dtype=np.uint32)
        return self._rows

    def slots(self) -> np.ndarray:
        """The table's row for each slot."""
        return np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freqs.astype(np.int64))


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    lanes = int(min(LANES, max(1, len(ids) // CHECKPOINT)))
    steps = -(-len(ids) // lanes)
    row = table.rows()[ids]
    fill = int(np.argmax(table.freqs))
    grid = np.concatenate([row, np.full(steps * lanes - len(ids), fill, dtype=row.dtype)]).reshape(steps, lanes)
    state = np.full(lanes, LOW, dtype=U64)
    words: list[np.ndarray] = []
    marks = []
    n_words = 0
    shift, most = U64(SCALE), U64(63 - SCALE)
    for step in range(steps - 1, -1, -1):
        f, c = table.freqs[grid[step]], table.starts[grid[step]]
        full = (state >> most) >= f
        if full.any():
            out = (state[full] & U64(0xFFFFFFFF)).astype("<u4")
            words.append(out)
            n_words += len(out)
            state[full] >>= U64(32)
        q = state // f
        state = (q << shift) + (state - q * f) + c
        if step % CHECKPOINT == 0:
            segment = ids[step * lanes : (step + CHECKPOINT) * lanes]
            marks.append((n_words, zlib.crc32(segment.astype("<u4").tobytes()), state.astype("<u8").tobytes()))
    stream = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    heads = b"".join(struct.pack("<II", n_words - n, crc) + s for n, crc, s in reversed(marks))
    return struct.pack("<IIII", len(ids), lanes, len(marks), n_words) + heads + stream


def decode_segment(stream: np.ndarray, at: int, state: np.ndarray, steps: int, table: Table, slots: np.ndarray) -> np.ndarray:
    out = np.empty((steps, len(state)), dtype=np.uint32)
    mask, shift = U64((1 << SCALE) - 1), U64(SCALE)
    for step in range(steps):
        slot = state & mask
        row = slots[slot.astype(np.int64)]
        out[step] = row
        state = table.freqs[row] * (state >> shift) + slot - table.starts[row]
        low = state < LOW
        n = int(np.count_nonzero(low))
        if n:
            state[low] = (state[low] << U64(32)) | stream[at : at + n].astype(U64)
            at += n
    return table.symbols[out.ravel()]


def decode_block(data: bytes, table: Table, slots: np.ndarray, segments: range | None = None) -> np.ndarray:
    """The ids of a block, or of some of its segments, each from its own checkpoint. A wrong checksum is an error."""
    n_ids, lanes, n_marks, n_words = struct.unpack_from("<IIII", data)
    width = 8 + 8 * lanes
    stream = np.frombuffer(data, dtype="<u4", count=n_words, offset=16 + n_marks * width)
    steps = -(-n_ids // lanes)
    parts = []
    for k in segments or range(n_marks):
        at, crc = struct.unpack_from("<II", data, 16 + k * width)
        state = np.frombuffer(data, dtype="<u8", count=lanes, offset=24 + k * width).copy()
        ids = decode_segment(stream, at, state, min(CHECKPOINT, steps - k * CHECKPOINT), table, slots)
        ids = ids[: n_ids - k * CHECKPOINT * lanes]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"segment {k} doesn't match its checksum")
        parts.append(ids)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


def encode_group(ids: np.ndarray) -> bytes:
    table = Table.of(ids)
    head = table.dump()
    blocks = [encode_block(ids[n : n + BLOCK], table) for n in range(0, len(ids), BLOCK)]
    return MAGIC + struct.pack("<II", len(head), len(blocks)) + b"".join(struct.pack("<I", len(b)) for b in blocks) + head + b"".join(blocks)


def decode_group(data: bytes) -> np.ndarray:
    if data[:4] != MAGIC:
        raise ValueError("not a group of this format")
    n_head, n_blocks = struct.unpack_from("<II", data, 4)
    sizes = struct.unpack_from(f"<{n_blocks}I", data, 12)
    at = 12 + 4 * n_blocks
    table = Table.load(data[at : at + n_head])
    slots = table.slots()
    at += n_head
    parts = []
    for size in sizes:
        parts.append(decode_block(data[at : at + size], table, slots))
        at += size
    return np.concatenate(parts)


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts with ``end_id`` after each, and where each text's begin."""
    return np.insert(ids, at[1:], end_id), at + np.arange(len(at))


def write_store(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0, parts: int | None = None) -> None:
    """Encode all texts and write the groups below ``path``, a folder that only this call fills."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    # A row number is the last part of the order, so that a range may end among rows of one doc_id, or of none.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = library_words(tokenizer)
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        number = held = 0

        def close() -> pa.RecordBatch:
            each = np.concatenate(lengths)
            whole = pa.array([0, len(each)], pa.int32())
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.ListArray.from_arrays(whole, pa.concat_arrays(keys)), pa.ListArray.from_arrays(whole, pa.array(each)), pa.array([encode_group(np.concatenate(ids))], pa.binary())]
            return pa.record_batch(columns, names=["part", "group", "n_ids", "doc_ids", "lengths", "payload"])

        for batch in text_slices(batches, "text"):
            part = batch.column(2)[0].as_py()
            some, at = with_end(*words.encode(text_array(batch)), end_id)
            first, last = 0, len(at) - 1
            while first < last:
                stop = min(last, max(first + 1, int(np.searchsorted(at, at[first] + GROUP - held, side="left"))))
                keys.append(batch.column(0).slice(first, stop - first))
                ids.append(some[at[first] : at[stop]])
                lengths.append(np.diff(at[first : stop + 1]))
                held += int(at[stop] - at[first])
                first = stop
                if held >= GROUP:
                    yield close()
                    keys, ids, lengths, held, number = [], [], [], 0, number + 1
        if keys:
            yield close()

    rows.mapInArrow(run, "part int, group int, n_ids long, doc_ids array<long>, lengths array<long>, payload binary").write.parquet(path)


def read_store(spark, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; with_ids adds ``ids``."""
    store = spark.read.parquet(path)
    groups = store.select("part", "group", "n_ids")
    # A part's sum is one row; there are as many as range partitions.
    of_parts = groups.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = of_parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    starts = groups.join(before, "part").select("part", "group", (F.col("part_start") + F.sum("n_ids").over(W.partitionBy("part").orderBy("group")) - F.col("n_ids")).alias("group_start"))
    more = ", ids array<long>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                part, group, doc_ids, lengths, payload = (batch.column(c)[n].as_py() for c in ("part", "group", "doc_ids", "lengths", "payload"))
                ids = decode_group(payload).astype("<u4")
                ends = np.cumsum(lengths)
                begins = ends - np.array(lengths)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                k = len(doc_ids)
                columns = [pa.array([part] * k, pa.int32()), pa.array([group] * k, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["part", "group", "doc_id", "begin", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    rows = store.select("part", "group", "doc_ids", "lengths", "payload").mapInArrow(run, f"part int, group int, doc_id long, begin long, n_tokens long, ids_crc32 long{more}")
    out = rows.join(starts, ["part", "group"])
    return out.select("doc_id", (F.col("group_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write a store in the shared folder and read it back."""
    path = shared_folder(docs.sparkSession, "ids")
    write_store(docs, path, tokenizer, key, text)
    return read_store(docs.sparkSession, path)
