"""BPE encoding in batched rounds over numpy arrays, and decoding.

The symbols of many words lie in one flat array. A round finds each neighbouring pair's rank by binary search over the sorted
pair keys, lets every word merge its pair of lowest rank, at all places where it occurs, and closes the gaps; words in which
no pair has a rank leave. Rounds end when no word is left. Only words that a bounded table does not know yet are encoded.
A long piece, which needs many rounds, is encoded by itself, and a round reads only the places where its pair came up.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows are encoded each; an empty table
gives an empty result; other columns of the input, whatever their names, are left out; a special token's string in a text
becomes that token and decodes to its string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .prefix_counts import PATTERN, split_specials
from .shared import text_array, text_slices
from .words import MAX_WORDS, WordTable, byte_alphabet, description, ragged, special_ids, special_texts, token_bytes

#: Bytes from which a piece is encoded by itself.
LONG_PIECE = 512


class RoundWords(WordTable):
    """Words and their ids, unsigned 32-bit."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        super().__init__("<u4", max_words)
        d = description(path)
        if d["model"]["type"] != "BPE" or d["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE tokenizer is needed")
        vocab = d["model"]["vocab"]
        table = token_bytes(path)
        self.base = len(table)
        self.bytes = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.lengths = np.array(list(map(len, table)), dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        alphabet = byte_alphabet()
        self.first = np.zeros(256, dtype=np.int64)
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        keys, made = [], []
        for merge in d["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            keys.append(vocab[a] * self.base + vocab[b])
            made.append(vocab[a + b])
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.rank = order.astype(np.int64)
        self.made = np.array(made, dtype=np.int64)[order]
        self.cut = regex.compile(PATTERN)
        self.specials = special_ids(path)

    def rounds(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and the number of each piece's."""
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        sizes = np.array(list(map(len, pieces)), dtype=np.int64)
        symbols, owner = self.first[data], np.repeat(np.arange(len(pieces)), sizes)
        place = np.arange(len(symbols))
        done_symbols, done_place, done_owner = [], [], []
        none = len(self.keys)
        while len(symbols):
            pair = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            same = owner[:-1] == owner[1:]
            rank = np.where(same & (self.keys[at] == pair), self.rank[at], none)
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            lowest = np.minimum.reduceat(np.concatenate([rank, [none]]), starts)
            index = np.cumsum(np.concatenate([[0], ~same]))
            alive = (lowest < none)[index]
            if not alive.all():
                done_symbols.append(symbols[~alive])
                done_place.append(place[~alive])
                done_owner.append(owner[~alive])
            hit = np.concatenate([(rank == lowest[index[:-1]]) & (rank < none), [False]])
            # Of overlapping hits (a run of one symbol) every second one merges, from the left.
            run_start = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
            if len(run_start):
                position = np.arange(len(hit))
                begin = np.zeros(len(hit), dtype=np.int64)
                begin[run_start] = run_start
                begin = np.maximum.accumulate(begin)
                hit &= (position - begin) % 2 == 0
            symbols = symbols.copy()
            symbols[np.flatnonzero(hit)] = self.made[at[np.flatnonzero(hit)]]
            keep = alive & ~np.concatenate([[False], hit[:-1]])
            symbols, owner, place = symbols[keep], owner[keep], place[keep]
        if not done_symbols:
            return np.zeros(0, dtype=np.int64), sizes
        order = np.argsort(np.concatenate(done_place))
        return np.concatenate(done_symbols)[order], np.bincount(np.concatenate(done_owner), minlength=len(pieces))

    def long_piece(self, data: bytes) -> np.ndarray:
        """The ids of one long piece. Its rounds touch only the places where a pair was made: symbols are a linked list, and each
        rank has the places at which it came up."""
        symbols = self.first[np.frombuffer(data, dtype=np.uint8)]
        n, none = len(symbols), len(self.keys)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def rank_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            pair = symbols[at] * self.base + symbols[after[at]]
            place = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            return np.where(self.keys[place] == pair, self.rank[place], none), place

        def wait(at: np.ndarray) -> None:
            if not len(at):
                return
            rank, _ = rank_of(at)
            order = np.argsort(rank, kind="stable")
            found, starts = np.unique(rank[order], return_index=True)
            for r, places in zip(found.tolist(), np.split(at[order], starts[1:]), strict=True):
                if r < none:
                    if r not in waiting:
                        heappush(ranks, r)
                    waiting.setdefault(r, []).append(places)

        wait(np.arange(n - 1))
        while ranks:
            r = heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[(symbols[at] >= 0) & (after[at] < n)]
            rank, place = rank_of(at)
            at, place = at[rank == r], place[rank == r]
            if not len(at):
                continue
            # Of overlapping places (a run of one symbol) every second one merges, from the left.
            begins = np.concatenate([[True], after[at[:-1]] != at[1:]])
            index = np.arange(len(at))
            at = at[(index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0]
            right = after[at]
            symbols[at] = self.made[place[0]]
            symbols[right] = -1
            after[at] = after[right]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            left = before[at]
            wait(np.unique(np.concatenate([at[inner], left[left >= 0]])))
        return symbols[symbols >= 0]

    def resolve(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, ends = [], []
        for w in words.to_pylist():
            pieces += [p.encode() for p in self.cut.findall(w)]
            ends.append(len(pieces))
        long = [n for n, p in enumerate(pieces) if len(p) > LONG_PIECE]
        alone = [self.long_piece(pieces[n]) for n in long]
        for n in long:
            pieces[n] = b""
        ids, counts = self.rounds(pieces)
        if long:
            starts = np.cumsum(counts) - counts
            counts[long] = list(map(len, alone))
            starts[long] = len(ids) + np.cumsum(counts[long]) - counts[long]
            ids = ragged(np.concatenate([ids, *alone]), starts, counts)
        return ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[[0, *ends]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings without null), and where each text's begin."""
        special = special_texts(texts, list(self.specials))
        parts = [split_specials(t, self.specials) for t in texts.take(pa.array(special, pa.int64())).to_pylist()]
        if len(special):  # what lies between special strings is a text of its own, after the others
            texts = pc.replace_with_mask(texts, pa.array(np.isin(np.arange(len(texts)), special)), pa.scalar("", texts.type))
            between = [x for p in parts for x, is_special in p if not is_special]
            n, texts = len(texts), pa.concat_arrays([texts, pa.array(between, texts.type)])
        numbers, bounds = self.words_of(texts)
        sizes = self.sizes(numbers)
        ids = ragged(self.flat.data, self.ends.data[numbers] - sizes, sizes)
        at = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        if not len(special):
            return ids, at
        whole, k = {}, n
        for row, p in zip(special.tolist(), parts, strict=True):
            runs = []
            for x, is_special in p:
                runs.append(np.array([self.specials[x]], dtype=ids.dtype) if is_special else ids[at[k] : at[k + 1]])
                k += not is_special
            whole[row] = np.concatenate(runs)
        runs = [whole[row] if row in whole else ids[at[row] : at[row + 1]] for row in range(n)]
        return np.concatenate(runs), np.cumsum([0, *map(len, runs)])

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of runs of ids: their bytes, read as UTF-8; what is not UTF-8 becomes the replacement character, as in the library."""
        sizes = self.lengths[ids]
        data = ragged(self.bytes, self.starts[ids], sizes).tobytes()
        cuts = np.concatenate([[0], np.cumsum(sizes)])[at].tolist()
        return [data[a:b].decode("utf-8", errors="replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def round_words(path: str) -> RoundWords:
    return RoundWords(path)


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_values: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256; with values also ``ids`` (array of int) and ``decoded``."""
    rows = docs.select(docs[f"`{key}`"].alias("k"), docs[f"`{text}`"].cast("string").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = round_words(path)
        for batch in text_slices(batches, "text"):
            ids, at = words.encode(text_array(batch))
            decoded = words.decode(ids, at)
            data, cuts = memoryview(ids.astype("<u4")).cast("B"), (4 * at).tolist()
            digests = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            columns = [batch.column(0), pa.array(np.diff(at)), pa.array(digests), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
            names = ["k", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_values:
                columns += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(decoded)]
                names += ["ids", "decoded"]
            yield pa.record_batch(columns, names=names)

    more = ", ids array<int>, decoded string" if with_values else ""
    return rows.mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}").withColumnRenamed("k", key)
