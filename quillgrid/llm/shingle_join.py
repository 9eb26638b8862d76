"""Near-duplicate groups by SimHash, completed to exact Jaccard similarity of word shingles without loss.

A text is the set of its shingles; texts with equal sets are one node. The SimHash grid (simhash_grid.py) proposes edges
between nodes with near fingerprints, and each is verified exactly. No fingerprint distance that a grid can afford finds all pairs
of similarity 0.8, so a prefix filter completes them; what the verified edges join is not compared again. Two sets x, y with similarity 0.8 share at least
0.8 |x| of x's shingles, so in any fixed order of all shingles they share one among the first |x| - ceil(0.8 |x|) + 1 of x and
as many of y (prefix filter). The order is by how often a shingle occurs in a sample of the texts, then by hash: rare ones come
first and few unrelated texts meet. The sample only decides what it costs; with any order no pair is lost.

Texts that meet at a shingle are candidates if their sizes allow the similarity. Of short runs all pairs are taken. Members of a
long run are first compared with a few pivots of it; where that leaves more than one component in the run, all pairs over
components are compared within the run, and one edge leaves it for each two components that it joins. There an upper bound
saves most comparisons: sets share at most the sum, over bins of hashes, of the lesser number of shingles in the bin; so only
the bins' counts are sent to every run, and then the pairs that may be alike are compared, or, of a run with many, its sets. Links come
from an exact comparison, of the shingles or, within long runs, of their 64-bit hashes. A long run is held by one task, with its
sets, and costs the square of its size where its members are not alike.

Defined cases: a null or empty text, or one of blanks, is the empty set, and all of them are one group; a text of fewer words
than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored, text_slices
from .simhash_grid import components, fingerprint_of_hashes, first_of_groups
from .simhash_grid import links as grid_links

#: Runs up to this length are compared pair by pair.
SHORT = 8
#: Texts in the sample, and shingles whose frequency is kept.
SAMPLE, KNOWN = 20000, 1 << 18
#: Members of a long run that one is compared with at a time.
BLOCK = 4096
#: Pairs for each member of a long run that are compared outside the run.
PAIRS = 8
#: Bits within which fingerprints are proposed, and shares into which a hot member's pairs or copies are dealt.
DISTANCE, SALTS = 4, 16


def shingles(text: str | None, words: int) -> set[bytes]:
    """A text's shingles: words are cut at ASCII white space, and A-Z are lowered."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return set()
    return {b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))}


def hashes(text: str | None, words: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in order."""
    digest = xxhash.xxh64_intdigest
    found = shingles(text, words)
    return np.unique(np.fromiter((digest(s, 42) for s in found), dtype=np.uint64, count=len(found)).view(np.int64))  # in order as signed numbers


def alike(a: set[bytes], b: set[bytes], percent: int) -> bool:
    shared = len(a & b)
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def prefix(found: np.ndarray, known: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The rarest of a text's hashes, as many as the filter needs."""
    if not len(found):
        return found
    count = np.zeros(len(found), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        count = np.where(known[at] == found, often[at], 0)
    return found[np.lexsort((found, count))[: len(found) - -(-percent * len(found) // 100) + 1]]


def runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Batches sorted by their first column, as columns that hold whole runs of it."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        part = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not len(part[0]):
            continue
        held.append(part)
        if part[0][-1] == held[0][0][0]:
            continue  # one run so far
        whole = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.searchsorted(whole[0], whole[0][-1], side="left"))  # the last run may go on in the next batch
        yield [x[:cut] for x in whole]
        held = [[x[cut:] for x in whole]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def starts_of(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    return starts, np.diff(np.concatenate([starts, [len(run)]]))


def first_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of (h, size, node, label) sorted: pairs (h null, a > b) of different labels to compare, and the members (h, node as a, size
    as b) of long runs, with a hash of all members as h."""
    for h, size, node, label in runs(batches, ("h", "size", "node", "label")):
        starts, sizes = starts_of(h)
        short = np.repeat(sizes <= SHORT, sizes)
        us, vs, hs, ms, mb = [], [], [], [], []
        for k in range(1, SHORT):
            at = np.flatnonzero((h[k:] == h[:-k]) & short[k:] & (label[k:] != label[:-k]))
            at = at[100 * size[at] >= percent * size[at + k]]  # sizes ascend within a run
            us.append(node[at])
            vs.append(node[at + k])
        for n in np.flatnonzero(sizes > SHORT).tolist():
            part = slice(starts[n], starts[n] + sizes[n])
            s, who, of = size[part], node[part], label[part]
            if (of == of[0]).all():
                continue
            same = np.frombuffer(xxhash.xxh3_64_digest(np.sort(who).tobytes()), dtype=np.int64)
            at = 0
            while at < len(s):
                end = int(np.searchsorted(s, 100 * int(s[at]) // percent, side="right"))
                others = who[at + 1 : end][of[at + 1 : end] != of[at]]
                us.append(np.full(len(others), who[at]))
                vs.append(others)
                at = end
            hs.append(np.repeat(same, len(who)))  # runs with the same members are one
            ms.append(who)
            mb.append(s)
        pairs = np.stack([np.concatenate(us), np.concatenate(vs)], axis=1)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        yield pa.record_batch([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], names=["h", "a", "b"])
        if hs:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in (hs, ms, mb)], names=["h", "a", "b"])


#: The most that a bin's count can say.
FULL = 255


def bins_of(found: np.ndarray) -> np.ndarray:
    """How many of the hashes are in each bin; there are more bins the more hashes, so that a bin holds four on average at most."""
    width = max(64, 1 << (len(found) // 4).bit_length())
    return np.minimum(np.bincount(found & (width - 1), minlength=width), FULL).astype(np.uint8)


def halved(bins: np.ndarray) -> np.ndarray:
    """The counts for half as many bins."""
    half = len(bins) // 2
    return np.minimum(bins[:half].astype(np.uint16) + bins[half:], FULL).astype(np.uint8)


def may_be_alike(one: np.ndarray, rest: np.ndarray, size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these counts and sizes can have the similarity: they share at most the lesser count of each bin."""
    least = np.minimum(rest, one)
    most = least.sum(axis=1, dtype=np.int64)
    most[(least == FULL).any(axis=1)] = 1 << 40
    most = np.minimum(most, np.minimum(sizes, size))
    return 100 * most >= percent * (sizes + size - most)


def pair_may_be_alike(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int, percent: int) -> bool:
    while len(a) != len(b):
        a, b = (halved(a), b) if len(a) > len(b) else (a, halved(b))
    return bool(may_be_alike(a, b[None], size_a, np.array([size_b]), percent)[0])


def open_pairs(size: np.ndarray, of: np.ndarray, bins: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of one run, sizes ascending, the later ones of another label that may be alike. Labels may change meanwhile.
    Sizes of alike sets are so near that one has at most twice the other's bins."""
    width = np.array(list(map(len, bins)))
    for w in np.unique(width).tolist():
        own, next_ = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        index = np.concatenate([own, next_])
        counts = np.stack([bins[k] for k in own.tolist()] + [halved(bins[k]) for k in next_.tolist()])
        for j, k in enumerate(own.tolist()):
            end = int(np.searchsorted(size[index], 100 * int(size[k]) // percent, side="right"))
            for at in range(j + 1, end, BLOCK):
                some = np.arange(at, min(end, at + BLOCK))
                some = some[of[index[some]] != of[k]]
                some = some[may_be_alike(counts[j], counts[some], int(size[k]), size[index[some]], percent)]
                if len(some):
                    yield k, index[some]


def rest_open(batches: Iterator[pa.RecordBatch], percent: int, most: int) -> Iterator[pa.RecordBatch]:
    """Of (h, size, node, label, bins) sorted: the pairs that may be alike (h null, node > other) of runs that have few, ``most`` for
    each member. Of other runs the rows that may be alike another (other null)."""
    names = ["h", "size", "node", "label", "other"]
    for h, size, node, label, bins in runs(batches, ("h", "size", "node", "label", "bins")):
        for start, n in zip(*(x.tolist() for x in starts_of(h)), strict=True):
            part = slice(start, start + n)
            own, open_, pairs, held = node[part], np.zeros(n, dtype=bool), [], 0
            for k, rest in open_pairs(size[part], label[part], [np.frombuffer(b, dtype=np.uint8) for b in bins[part]], percent):
                open_[rest] = open_[k] = True
                held += len(rest)
                if held <= most * n:
                    pairs.append(np.stack([np.full(len(rest), own[k]), own[rest]], axis=1))
            if held > most * n:
                yield pa.record_batch([*(pa.array(x[part][open_]) for x in (h, size, node, label)), pa.nulls(int(open_.sum()), pa.int64())], names=names)
            elif pairs:
                both = np.sort(np.concatenate(pairs), axis=1)
                none = pa.nulls(len(both), pa.int64())
                yield pa.record_batch([none, none, pa.array(both[:, 1]), none, pa.array(both[:, 0])], names=names)


def run_edges(size: np.ndarray, node: np.ndarray, label: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges (u > v) that join what is alike over the components of one run, sizes ascending: one for each two that it joins."""
    of, edges = label.copy(), []
    for k, rest in open_pairs(size, of, [bins_of(s) for s in sets], percent):
        theirs = np.concatenate([sets[r] for r in rest.tolist()])
        place = np.minimum(np.searchsorted(sets[k], theirs), len(sets[k]) - 1)
        shared = np.add.reduceat((sets[k][place] == theirs).astype(np.int64), np.cumsum(size[rest]) - size[rest])
        for r in rest[100 * shared >= percent * (size[rest] + size[k] - shared)].tolist():
            if of[r] != of[k]:
                edges.append((max(node[r], node[k]), min(node[r], node[k])))
                of[of == of[r]] = of[k]
    return edges


def rest_edges(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of (h, size, node, label, found) sorted: the edges of each run."""
    for h, size, node, label, found in runs(batches, ("h", "size", "node", "label", "found")):
        edges = []
        for start, n in zip(*(x.tolist() for x in starts_of(h)), strict=True):
            part = slice(start, start + n)
            edges += run_edges(size[part], node[part], label[part], [np.frombuffer(f, dtype=np.int64) for f in found[part]], percent)
        yield pa.record_batch([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["u", "v"])


def groups(rows: DataFrame, number: str, text: str, words: int = 5, percent: int = 80, most: int = PAIRS) -> DataFrame:
    """n, label: for each row's number the least number in its group. Rows are in one group if a path of pairs links them whose
    similarity is at least ``percent`` in a hundred. A long run with more than ``most`` pairs a member is compared in one
    task, so that no more pairs are emitted. ``number`` is distinct, and the same whenever ``rows`` is read."""
    spark = rows.sparkSession
    texts = rows.select(F.col(f"`{number}`").alias("n"), F.col(f"`{text}`").cast("string").alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = [hashes(t, words) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], names=["h"])

    every = max(1, texts.count() // SAMPLE)
    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).dropDuplicates(["text"])
    common = sample.mapInArrow(emit, "h long").groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").orderBy(F.desc("c"), "h").limit(KNOWN).toArrow()
    known, often = (common.column(c).to_numpy().astype(np.int64) for c in ("h", "c"))
    known, often = known[np.argsort(known)], often[np.argsort(known)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = [hashes(t, words) for t in batch.column("text").to_pylist()]
            same = [xxhash.xxh3_128_digest(f.tobytes()) for f in found]
            first = pa.array([prefix(f, known, often, percent) for f in found], pa.list_(pa.int64()))
            fp = pa.array([fingerprint_of_hashes(f) for f in found], pa.int64())
            bins = pa.array([bins_of(f).tobytes() for f in found], pa.binary())
            yield pa.record_batch([batch.column("n"), pa.array(same, pa.binary()), pa.array([len(f) for f in found], pa.int64()), first, fp, bins], names=["n", "same", "size", "first", "fp", "bins"])

    sketches = stored(texts.mapInArrow(sketch, "n long, same binary, size long, first array<long>, fp long, bins binary"), "sketches")
    nodes = stored(sketches.groupBy("same").agg(F.min("n").alias("node")), "part")
    of_node = stored(sketches.drop("same").join(nodes.select(F.col("node").alias("n")), "n", "left_semi").withColumnRenamed("n", "node"), "nodes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int | None, set[bytes]]] = {"a": (None, set()), "b": (None, set())}  # rows come in runs of one side
        for batch in batches:
            ids = {side: batch.column(side).to_pylist() for side in held}
            kept = []
            for n in range(batch.num_rows):
                for side in held:
                    if ids[side][n] != held[side][0]:
                        held[side] = (ids[side][n], shingles(batch.column(f"t{side}")[n].as_py(), words))
                kept.append(alike(held["a"][1], held["b"][1], percent))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["u", "v"]).filter(pa.array(kept, pa.bool_()))

    def texts_of(numbers: DataFrame) -> DataFrame:
        """The texts of some numbers. They are stored, so that Spark knows their size: few are broadcast, and no other text is moved."""
        return texts.join(stored(numbers.distinct().toDF("n"), "numbers"), "n", "left_semi")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = ([np.frombuffer(x, dtype=np.uint8) for x in batch.column(c).to_pylist()] for c in ("xa", "xb"))
            sizes = (batch.column(c).to_pylist() for c in ("sa", "sb"))
            kept = [pair_may_be_alike(*x, percent) for x in zip(*sides, *sizes, strict=True)]
            yield pa.record_batch([batch.column(c) for c in ("a", "b", "salt")], names=["a", "b", "salt"]).filter(pa.array(kept, pa.bool_()))

    def both_sides(pairs: DataFrame, of_a: DataFrame, of_b: DataFrame) -> DataFrame:
        """Pairs with what their sides have. One b may be in most pairs, so its pairs are dealt over shares by a."""
        with_b = pairs.select("b", "salt").distinct().join(of_b, "b")
        return pairs.join(of_a, "a").join(with_b, ["b", "salt"])

    def links(pairs: DataFrame, bound: bool = True) -> DataFrame:
        """Those of the pairs (a > b) that are alike: the upper bound leaves few whose texts are compared."""
        salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int").alias("salt")
        pairs = stored(pairs.groupBy("a", "b").agg(F.lit(1).alias("x")).select("a", "b", salt), "part")
        if bound:
            counts = of_node.select("node", "size", "bins")
            found = both_sides(pairs, counts.toDF("a", "sa", "xa"), counts.toDF("b", "sb", "xb"))
            pairs = stored(found.select("a", "b", "salt", "sa", "sb", "xa", "xb").mapInArrow(bounded, "a long, b long, salt int"), "pairs")
        found = both_sides(pairs, texts_of(pairs.select("a")).toDF("a", "ta"), texts_of(pairs.select("b")).toDF("b", "tb"))
        return stored(found.select("a", "b", "ta", "tb").mapInArrow(compare, "u long, v long"), "part")

    # Equal or near fingerprints: each node with the first of its fingerprint, and those firsts along the grid's edges.
    fps = of_node.select("node", "fp")
    first_of = stored(fps.groupBy("fp").agg(F.min("node").alias("lead")), "part")
    shares = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    dealt = fps.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    equal = dealt.join(first_of.select("fp", "lead", shares), ["fp", "salt"]).filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    ends = [first_of.select(F.col("fp").alias(c), F.col("lead").alias(f"{c}_lead")) for c in ("u", "v")]
    near = grid_links(first_of, DISTANCE).join(ends[0], "u").join(ends[1], "v").select(F.greatest("u_lead", "v_lead").alias("a"), F.least("u_lead", "v_lead").alias("b"))
    proposed = links(equal.unionByName(near))
    joined = components(proposed)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    labelled = of_node.select("node", "size", "first").join(joined, "node", "left").select("node", "size", "first", F.coalesce("label", "node").alias("label"))
    met = labelled.select(F.explode("first").alias("h"), "size", "node", "label").repartition(parts, "h").sortWithinPartitions("h", "size", "node")
    met = stored(met.mapInArrow(lambda b: first_pairs(b, percent), "h long, a long, b long"), "met")

    edges = proposed.unionByName(links(met.filter("h is null").select("a", "b")))
    labels = components(edges)
    long_ = met.filter("h is not null").groupBy("h", F.col("a").alias("node")).agg(F.lit(1).alias("x")).select("h", "node")
    members = stored(long_.join(labels, "node", "left").select("h", "node", F.coalesce("label", "node").alias("label")), "part")
    open_ = members.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("h")
    rest = stored(members.join(open_, "h", "left_semi"), "part")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = [hashes(t, words).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("n"), pa.array(found, pa.binary())], names=["node", "found"])

    # A text is in many runs. First the counts alone go to them. The pairs that may be alike are compared once over all runs; only
    # where a run has many of them, sets follow.
    sorted_by = lambda x: x.repartition(parts, "h").sortWithinPartitions("h", "size", "node")
    counted = sorted_by(rest.join(of_node.select("node", "size", "bins"), "node").select("h", "size", "node", "label", "bins"))
    left = stored(counted.mapInArrow(lambda b: rest_open(b, percent, most), "h long, size long, node long, label long, other long"), "open")
    edges = edges.unionByName(links(left.filter("h is null").select(F.col("node").alias("a"), F.col("other").alias("b")), bound=False))
    left = left.filter("h is not null").drop("other")
    used = texts_of(left.select("node")).mapInArrow(sets, "node long, found binary")
    rest = sorted_by(left.join(used, "node").select("h", "size", "node", "label", "found"))
    more = rest.mapInArrow(lambda b: rest_edges(b, percent), "u long, v long").groupBy("u", "v").agg(F.lit(1).alias("x")).select("u", "v")
    labels = components(edges.unionByName(more))
    of = nodes.join(labels, "node", "left").select("same", F.coalesce("label", "node").alias("label"), shares)
    copies = sketches.select("n", "same", F.pmod(F.xxhash64("n"), F.lit(SALTS)).cast("int").alias("salt"))  # a text may be a third of all rows
    return copies.join(of, ["same", "salt"]).select("n", "label")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group, the one with the smallest key, and all its columns."""
    return first_of_groups(docs, key, lambda rows, number: groups(rows, number, text, words, percent))
