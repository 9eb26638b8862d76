"""Near-duplicate groups by SimHash, with candidates from a grid over segment popcounts.

A fingerprint's 64 bits are cut into segments, and each segment's number of ones is a coordinate. Changing one bit moves one
coordinate by one, so the Manhattan distance of two embeddings is at most the fingerprints' Hamming distance. Fingerprints
within D bits are therefore within D in the embedding, and if it is cut into parts, within their share of D in one of them:
two, with two parts for D up to 5 and three up to 8. In a grid of unit cells, a range join within two steps is an equality
join: the two points have a cell within one step of both, so each emits its own cell and the next ones in each direction, and
cells that fall together give candidates. Candidates are verified by the exact Hamming distance, on distinct fingerprints
only; copies of a fingerprint never multiply.

A cell with many members is cut by the bits themselves: fingerprints within D differ in at most two bits of one part, so they
agree in one of three blocks of that part's bits, and only members with an equal block are compared. For random fingerprints
that leaves two pairs in ten million, at 64 bits and D = 4. In a block, components are grown from a pivot: each member found is
compared with those that are not yet in a component. A tight group costs its size, and yields an edge for each member rather
than its pairs. Edges of all cells are joined to components by hooking roots and jumping pointers, in DataFrames, with a
table written each round: Spark knows its size, so while few are left, joins need no exchange.

Defined cases: a null or empty text, or one of blanks, has the fingerprint 0 and is linked like any other; a null doc_id gets a
component but never names one unless all of it is null; repeated rows are kept each; an empty table gives an empty
result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, stored, text_slices

BITS, SEGMENT = 64, 2
#: Runs of a cell up to this length are compared pair by pair in one sweep over the batch.
SHORT = 8
#: Cells with more members are cut into blocks.
CUT = 64
#: Shares into which the nodes of a label are dealt, and the copies of a fingerprint.
SALTS, COPY_SALTS = 16, 8
#: Shingles whose bits are counted at a time.
SHINGLES = 1 << 16


def bit_counts(digests: np.ndarray) -> np.ndarray:
    """How many of the big-endian 64-bit digests have each bit set, from the highest."""
    return np.unpackbits(digests.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint, as a signed number: bits that are set in over half of n."""
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprint_of_hashes(hashes: np.ndarray) -> int:
    """SimHash of signed 64-bit hashes; 0 if there are none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), SHINGLES):
        ones += bit_counts(hashes[at : at + SHINGLES].astype(">i8").view(np.uint8))
    return majority(ones, len(hashes)) if len(hashes) else 0


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of all shingles, repeats included, as a signed 64-bit number."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1
    buffer = b" ".join(tokens)
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    if len(tokens) > words:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), SHINGLES):
        some = zip(starts[at : at + SHINGLES].tolist(), ends[at : at + SHINGLES].tolist(), strict=True)
        ones += bit_counts(np.frombuffer(b"".join([digest(buffer[a:b], 42) for a, b in some]), dtype=np.uint8))
    return majority(ones, len(starts))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """key, fp (long) of every row."""
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            yield pa.record_batch([batch.column(0), pa.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], pa.int64())], names=["k", "fp"])

    return rows.mapInArrow(run, f"k {kind}, fp long").withColumnRenamed("k", key)


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def parts_for(distance: int) -> list[np.ndarray]:
    """The segments of each part."""
    return np.array_split(np.arange(BITS // SEGMENT), max(2, distance // 3 + 1))


def blocks(fps: np.ndarray, part: int, distance: int) -> np.ndarray:
    """For each fingerprint the bits of each block of a part, as numbers: one block more than bits that the part may differ in."""
    parts = parts_for(distance)
    columns = (parts[part][:, None] * SEGMENT + np.arange(SEGMENT)).ravel()
    own = np.array_split(columns, distance // len(parts) + 1)
    bits = bits_of(fps)
    return np.stack([bits[:, c] @ (1 << np.arange(len(c), dtype=np.int64)) for c in own], axis=1)


def cells(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The grid cells within one step of each part's embedding: cell numbers, and the row of each.

    There are as many parts as leave at most two bits of ``distance`` to one of them.
    """
    counts = bits_of(fps).reshape(len(fps), BITS // SEGMENT, SEGMENT).sum(axis=2, dtype=np.int64)
    parts = parts_for(distance)
    rows = np.arange(len(fps))
    out_cells, out_rows = [], []
    for part, columns in enumerate(parts):
        point = counts[:, columns]
        power = (SEGMENT + 1) ** np.arange(len(columns), dtype=np.int64)
        own = point @ power
        near, of = [own], [rows]
        for c, step in ((c, step) for c in range(len(columns)) for step in (-1, 1)):
            ok = (point[:, c] + step >= 0) & (point[:, c] + step <= SEGMENT)
            near.append(own[ok] + step * power[c])
            of.append(rows[ok])
        out_cells.append(np.concatenate(near) * len(parts) + part)
        out_rows.append(np.concatenate(of))
    return np.concatenate(out_cells), np.concatenate(out_rows)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers numpy would count the absolute value's bits


def grow(fps: np.ndarray, distance: int) -> np.ndarray:
    """For each member of a cell, the first member of its component within the cell."""
    root = np.arange(len(fps))
    free = np.arange(len(fps))
    while len(free):
        pivot, free = free[0], free[1:]
        waiting = [pivot]
        while waiting and len(free):
            near = differing(fps[free], fps[waiting.pop()]) <= distance
            found = free[near]
            root[found] = pivot
            waiting.extend(found.tolist())
            free = free[~near]
    return root


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """Edges (u, v) with u > v between distinct fingerprints, enough to connect all that are within ``distance`` over any path.
    ``nodes`` has the distinct ``fp``."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for start in range(0, len(fps), 4096):
                part = fps[start : start + 4096]
                cell, row = cells(part, distance)
                yield pa.record_batch([pa.array(cell), pa.array(part[row])], names=["cell", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell, held_fp = [], []

        def pairs_of(cell: np.ndarray, fp: np.ndarray, whole: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
            """Edges within runs of a cell; ``whole`` cells that are long are cut into blocks first."""
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(cell)]]))
            u, v = [], []
            short = np.repeat(sizes <= SHORT, sizes)
            for k in range(1, SHORT):
                at = np.flatnonzero((cell[k:] == cell[:-k]) & short[k:])
                at = at[differing(fp[at], fp[at + k]) <= distance]
                u.append(fp[at + k])
                v.append(fp[at])
            for n in np.flatnonzero(sizes > SHORT).tolist():
                run = fp[starts[n] : starts[n] + sizes[n]]
                if whole and len(run) > CUT:
                    for block in blocks(run, int(cell[starts[n]]) % len(parts_for(distance)), distance).T:
                        order = np.lexsort((run, block))
                        more = pairs_of(block[order], run[order], False)
                        u += more[0]
                        v += more[1]
                    continue
                root = grow(run, distance)
                own = np.flatnonzero(root != np.arange(len(run)))
                u.append(run[own])
                v.append(run[root[own]])
            return u, v

        def edges(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            u, v = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in pairs_of(cell, fp, True))
            u, v = np.maximum(u, v), np.minimum(u, v)
            pairs = np.unique(np.stack([u, v], axis=1), axis=0) if len(u) else np.zeros((0, 2), dtype=np.int64)
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            cell, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp"))
            if not len(cell):
                continue
            held_cell.append(cell)
            held_fp.append(fp)
            if cell[0] == cell[-1] and held_cell[0][0] == cell[0]:
                continue  # one cell so far
            cell, fp = np.concatenate(held_cell), np.concatenate(held_fp)
            whole = int(np.searchsorted(cell, cell[-1], side="left"))  # the last cell may go on in the next batch
            yield edges(cell[:whole], fp[:whole])
            held_cell, held_fp = [cell[whole:]], [fp[whole:]]
        if held_cell:
            yield edges(np.concatenate(held_cell), np.concatenate(held_fp))

    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grid = nodes.select("fp").mapInArrow(emit, "cell long, fp long")
    found = grid.repartition(parts, "cell").sortWithinPartitions("cell", "fp").mapInArrow(verify, "u long, v long")
    return found.groupBy("u", "v").agg(F.lit(1).alias("n")).select("u", "v")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that is connected, for all nodes of ``edges`` (u > v)."""
    edges = stored(edges, "links")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "links")

    def relabel(labels: DataFrame, moves: DataFrame) -> DataFrame:
        """Labels with those of ``moves`` (label, next) replaced. A label may hold a third of all nodes, so its nodes are salted."""
        salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
        salted = labels.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        return stored(salted.join(moves.select("label", "next", salts), ["label", "salt"], "left").select("node", F.coalesce("next", "label").alias("label")), "links")

    def jump(labels: DataFrame) -> DataFrame:
        """Each node gets its label's label, until labels are their own. Only distinct labels are looked up."""
        while True:
            used = labels.groupBy("label").agg(F.lit(1).alias("n")).select("label")
            moves = stored(used.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").filter("next <> label"), "links")
            if not moves.limit(1).count():
                return labels
            labels = relabel(labels, moves)

    while True:
        labels = jump(labels)
        ends = [labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_root")) for c in ("u", "v")]
        open_ = edges.join(ends[0], "u").join(ends[1], "v").filter("u_root <> v_root")
        edges = stored(open_.select(F.greatest("u_root", "v_root").alias("u"), F.least("u_root", "v_root").alias("v")).groupBy("u", "v").agg(F.lit(1).alias("n")).select("u", "v"), "links")
        if not edges.limit(1).count():
            return labels
        labels = relabel(labels, edges.groupBy(F.col("u").alias("label")).agg(F.min("v").alias("next")))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """key, fp (long), fingerprint (hexadecimal), component_id: the smallest key that can be reached over links."""
    rows = materialise(fingerprints(docs, key, text, words).withColumnRenamed(key, "k"))
    nodes = materialise(rows.groupBy("fp").agg(F.min("k").alias("rep")))
    labels = components(links(nodes, distance)).withColumnRenamed("node", "fp")
    linked = materialise(nodes.join(labels, "fp").select("fp", "rep", "label"))
    named = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")  # a component may hold a third of all fingerprints
    salted = linked.select("fp", "label", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt"))
    found = salted.join(named.select("label", "component_id", salts), ["label", "salt"]).select("fp", "component_id")
    of_fp = nodes.join(found, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    # A fingerprint's copies may be a third of all rows, so they are dealt over shares, each with its own row of the other side.
    shares = F.explode(F.array(*map(F.lit, range(COPY_SALTS)))).alias("salt")
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(COPY_SALTS)).cast("int"))
    return dealt.join(of_fp.select("fp", "component_id", shares), ["fp", "salt"]).select(F.col("k").alias(key), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, and the number's column. Written once, so that a row keeps its number when it is read again."""
    number = "__row"
    while number.lower() in {c.lower() for c in docs.columns}:
        number += "_"
    return stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered"), number


def first_of_groups(docs: DataFrame, key: str, grouped: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``docs`` with one row of each group, and all its columns: the row with the smallest key, and of these the first.

    ``grouped`` takes numbered rows and the number's column, and gives n, label for each number. Rows are told apart by that
    number, so a key that is null or repeated joins nothing. Null keys come last.
    """
    rows, number = numbered(docs)
    keys = rows.select(F.col(f"`{number}`").alias("n"), F.col(f"`{key}`").alias("k"))
    members = materialise(keys.join(grouped(rows, number), "n").select("n", "label", F.struct(F.col("k").isNull().alias("last"), "k", "n").alias("order")))
    of = members.groupBy("label").agg(F.min("order").alias("least"), F.count("*").alias("size")).filter("size > 1")
    # Of groups with several members (a third of all rows may be in one) all go but the least, dealt over shares.
    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(SALTS)).cast("int"))
    gone = dealt.join(of.select("label", F.col("least.n").alias("kept"), salts), ["label", "salt"]).filter("n <> kept").select(F.col("n").alias(number))
    return rows.join(stored(gone, "gone"), number, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 2, distance: int = 7) -> DataFrame:
    """One row of each group of ``groups``."""
    return first_of_groups(docs, key, lambda rows, number: groups(rows, number, text, words, distance).select(F.col(f"`{number}`").alias("n"), F.col("component_id").alias("label")))
