"""Media columns: payloads as images in tar shards, addressed by content.

A text's bytes, padded with blanks to whole rows of 192, are the samples of an 8-bit grey PNG, which is lossless. Each task
appends its images to tar shards in the shared folder; a row carries the image's digest, its shard, offset and length. Equal
payloads of a task are stored once and share an address; then ``canonical`` gives equal digests of all tasks one address. Metadata
columns come from range reads of the image's first 33 bytes, and features from a range read of the rest.

Shards have a name of their own for each attempt, so a task that runs again never touches a shard that rows point to. The rows
are checkpointed before anything reads a shard. Shards are written and read with pyarrow's file systems, so any shared store
that they know will do.

Defined cases: a null or empty text is one row of 192 blanks; equal texts have equal values; repeated rows are kept each; an
empty table gives an empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, shared_folder, stored, text_slices, texts_of

WIDTH = 192
SHARD_BYTES = 256 << 20
HEADER_BYTES = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Digests that a task remembers, so that equal payloads share an address; beyond it starts anew.
MAX_DIGESTS = 200_000
#: Shares into which the rows of a digest are dealt.
SALTS = 8


def payload_of(data: bytes) -> bytes:
    return data + b" " * ((-len(data)) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = rows  # each row begins with its filter, 0: none
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits and colour type from an image's first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not the head of a PNG")
    return struct.unpack(">IIBB", head[16:26])


def from_png(data: bytes) -> bytes:
    width, height, bits, colour = png_header(data[:HEADER_BYTES])
    if (bits, colour) != (8, 0):
        raise ValueError("8-bit grey samples are needed")
    at, parts = HEADER_BYTES, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a damaged chunk")
        parts += [body] * (kind == b"IDAT")
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only rows without a filter are written")
    return lines[:, 1:].tobytes()


class ShardWriter:
    """Appends members to tar files, a new one at SHARD_BYTES."""

    def __init__(self, folder: str):
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.root, recursive=True)
        self.folder, self.out, self.at = folder, None, 0

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        if self.out is not None and self.at >= SHARD_BYTES:
            self.close()
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.tar"
            self.out, self.at = self.files.open_output_stream(f"{self.root}/{self.name}"), 0
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        offset = self.at + len(head)
        body = head + data + b"\0" * (-len(data) % tarfile.BLOCKSIZE)
        self.out.write(body)
        self.at += len(body)
        return self.name, offset

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None


def write_media(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, digest, shard, offset, length), checkpointed; the images are in the folder's shards."""
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, known = ShardWriter(folder), {}
        for batch in text_slices(batches, "text"):
            out = []
            for t in texts_of(batch):
                data = t.encode()
                own = hashlib.sha256(data).digest()
                if own not in known:
                    if len(known) >= MAX_DIGESTS:
                        known.clear()
                    image = to_png(payload_of(data))
                    digest = hashlib.sha256(image).hexdigest()
                    known[own] = (len(data), digest, *writer.add(f"{digest[:2]}/{digest}.png", image), len(image))
                out.append(known[own])
            sizes, digests, shards, offsets, lengths = zip(*out, strict=True)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(shards), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["k", "n_bytes", "digest", "shard", "offset", "length"])
        writer.close()

    return materialise(rows.mapInArrow(run, f"k {kind}, n_bytes long, digest string, shard string, offset long, length long")).withColumnRenamed("k", key)


def canonical(rows: DataFrame) -> DataFrame:
    """Rows with one address for each digest, the least; others' copies are then garbage for a compaction to drop.

    Only digests with several addresses are looked up. One may be a third of all rows, so rows are dealt over shares.
    """
    address = F.struct("shard", "offset", "length")
    several = rows.groupBy("digest").agg(F.min(address).alias("a"), F.max(address).alias("b")).filter("a <> b")
    shares = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    several = stored(several.select("digest", "a"), "addresses").select("digest", "a", shares)
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    own = {c: F.coalesce(F.col(f"a.{c}"), F.col(c)).alias(c) for c in ("shard", "offset", "length")}
    return dealt.join(several, ["digest", "salt"], "left").select(*(own.get(c, F.col(f"`{c}`")) for c in rows.columns))


class ShardReader:
    """Range reads; one shard is open at a time."""

    def __init__(self, folder: str):
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = shard, self.files.open_input_file(f"{self.root}/{shard}")
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise ValueError(f"{shard} is too short")
        return data


def with_metadata(rows: DataFrame, folder: str) -> DataFrame:
    """Rows with width, height, bits and colour, of which only the images' first bytes are read."""
    more = [("width", pa.int64()), ("height", pa.int64()), ("bits", pa.int32()), ("colour", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShardReader(folder)
        for batch in batches:
            heads = [png_header(reader.read(s, o, HEADER_BYTES)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            yield pa.record_batch([*batch.columns, *(pa.array([h[n] for h in heads], t) for n, (_, t) in enumerate(more))], names=[*batch.schema.names, *(n for n, _ in more)])

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, width long, height long, bits int, colour int")


def features(rows: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """From the stored bytes: payload and media figures, and ``feature``: image size, mean sample, distinct samples, and the share of the
    commonest sample in thousandths. ``rows`` has the columns of with_metadata."""
    kind = rows.schema[key].dataType.simpleString()
    rows = rows.select(F.col(f"`{key}`").alias("k"), "n_bytes", "digest", "shard", "offset", "length", "width", "height", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShardReader(folder)
        names = ["k", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            out = []
            for r in batch.drop_columns(["k"]).to_pylist():
                image = reader.read(r["shard"], r["offset"], r["length"])
                stored = hashlib.sha256(image).hexdigest()
                if stored != r["digest"]:
                    raise ValueError(f"{r['shard']} at {r['offset']} isn't what was stored")
                payload = from_png(image)
                counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
                mean = int(counts @ np.arange(256)) / len(payload)
                feature = f"{r['width']}x{r['height']}x{r['bits']} mean={mean:.4f} distinct={np.count_nonzero(counts)} top={1000 * int(counts.max()) // len(payload)}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), stored, feature))
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.record_batch([batch.column("k"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return rows.mapInArrow(run, f"k {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("k", key)


def store_and_read(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    folder = shared_folder(docs.sparkSession, "media")
    return features(with_metadata(canonical(write_media(docs, folder, key, text)), folder), folder, key)
