"""Word-wise access to a byte-level BPE tokenizer.

Such a tokenizer splits a text with a fixed pattern before it merges bytes, so a text may be cut at certain white space
without changing its ids. ``word_keys`` cuts there, and ``WordTable`` computes each distinct word once and keeps the
result in a bounded table. Texts are cut and their distinct words found by Arrow, a slice of texts at a time; words that are
not in the table are computed together.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, models, pre_tokenizers

#: Unicode's White_Space, as the tokenizer's pattern sees it (Python's \s has four control characters more).
WHITE = "\t-\r \x85\xa0  -     　"
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


BLANK = re.compile(f"[{WHITE}]*")
#: The run of characters at a word's end that are neither letters nor digits.
TAIL = re.compile(r"[\W_]*$")
#: A word of letters, after a line feed, a blank or nothing.
BARE = r"^\n? ?\p{L}+$"
#: What texts that Arrow cuts don't hold: white space other than single blanks and line feeds between other characters, or NUL.
ODD = rf"[ \n][ \n]|^[ \n]| $|[\x00-\x09\x0b-\x1f\x7f{WHITE[4:]}]"
#: Bytes of a word that a table keeps at most, one less than a multiple of eight; and words that it keeps.
LONG, MAX_WORDS = 31, 600_000


def word_keys(text: str) -> list[str]:
    """Cut a text into words that can be tokenized alone. ``raw_word`` gives a key's text; their concatenation is the text.

    A blank starts a new word when it precedes a non-blank, and so does a line feed between two non-blanks.
    Most texts hold only such white space and are cut with ``str.split``; others go through the pattern CHUNK.
    """
    if not text:
        return []
    lines = text.split("\n")
    closed = len(lines) > 1 and not lines[-1]
    if closed:
        lines.pop()
    keys: list[str] = []
    first = "\0"
    for line in lines:
        if not line or line[0] == " " or line[-1] == " " or "  " in line or not line.isprintable():
            return [_key(x) for x in CHUNK.findall(text)]
        parts = line.split(" ")
        parts[0] = first + parts[0]
        keys += parts
        first = "\n"
    if closed:
        keys.append("\0\n")
    return keys


def _key(chunk: str) -> str:
    return chunk[1:] if chunk[0] == " " and len(chunk) > 1 and chunk[1] not in "\0\n " else "\0" + chunk


def raw_word(key: str) -> str:
    head = key[:1]
    return key[1:] if head == "\0" else key if head == "\n" else " " + key


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary, by their public rule."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in own}
    return table | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(own))}


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    """The tokenizer without truncation or padding; in one thread, as Spark runs a worker for each core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=4)
def description(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; an added token has its own text."""
    d = description(path)
    alphabet = byte_alphabet()
    table = [b""] * (1 + max([*d["model"]["vocab"].values(), *(x["id"] for x in d["added_tokens"])]))
    for token, i in d["model"]["vocab"].items():
        table[i] = bytes(alphabet[c] for c in token)
    for x in d["added_tokens"]:
        table[x["id"]] = x["content"].encode()
    return table


def special_ids(path: str) -> dict[str, int]:
    return {x["content"]: x["id"] for x in description(path)["added_tokens"]}


def raw_words(keys: pa.Array) -> pa.Array:
    """``raw_word`` of all keys."""
    plain, fed = pc.starts_with(keys, "\0"), pc.starts_with(keys, "\n")
    return pc.if_else(plain, pc.utf8_slice_codeunits(keys, 1), pc.if_else(fed, keys, pc.binary_join_element_wise(" ", keys, "")))


class Growing:
    """A numpy array that grows at its end."""

    def __init__(self, dtype: np.dtype | str, *shape: int):
        self.data, self.size = np.zeros((1024, *shape), dtype=dtype), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.zeros((max(need, 2 * len(self.data)) - self.size, *self.data.shape[1:]), dtype=self.data.dtype)])
        self.data[self.size : need] = values
        self.size = need


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after another."""
    total = int(sizes.sum())
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    index = np.repeat((starts - (np.cumsum(sizes) - sizes)).astype(kind), sizes)
    index += np.arange(total, dtype=kind)
    return flat[index]


def packed(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys' first LONG bytes, filled up with zeros, and the length in a last byte, as rows of whole numbers; and the lengths."""
    _, offsets, data = keys.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[keys.offset : keys.offset + len(keys) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(1, dtype=np.uint8)
    starts, sizes = offsets[:-1], np.diff(offsets)
    out = np.zeros((len(keys), LONG + 1), dtype=np.uint8)
    for n in range(int(min(LONG, sizes.max(initial=0)))):
        rows = np.flatnonzero(sizes > n)
        out[rows, n] = data[starts[rows] + n]
    out[:, LONG] = np.minimum(sizes, 255)
    return out.view(np.uint64), sizes


def mixed(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row; equal hashes are told apart by the rows."""
    h = np.zeros(len(rows), dtype=np.uint64)
    for n in range(rows.shape[1]):
        h = (h ^ rows[:, n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class WordTable:
    """Distinct words and the run of numbers that ``resolve`` computed for each, all in one flat array.

    Words are found by binary search over sorted hashes, then compared. The table is bounded: it holds about ``max_words`` words of
    at most LONG bytes; when it is full, words that were met once go. Longer words are computed anew for each slice of texts.
    """

    def __init__(self, dtype: np.dtype | str, max_words: int = MAX_WORDS):
        self.dtype, self.max_words = np.dtype(dtype), max_words
        self._start()

    def _start(self) -> None:
        self.hashes, self.order = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.rows, self.flat, self.ends, self.uses = Growing(np.uint64, (LONG + 1) // 8), Growing(self.dtype), Growing(np.int64), Growing(np.int32)

    def __len__(self) -> int:
        return len(self.hashes)

    def resolve(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The values of all words, one after another, and how many each has."""
        raise NotImplementedError

    def _append(self, values: np.ndarray, sizes: np.ndarray) -> None:
        base = self.flat.size
        self.flat.extend(values)
        self.ends.extend(base + np.cumsum(sizes))
        self.uses.extend(np.zeros(len(sizes), dtype=np.int32))

    def _keep(self, rows: np.ndarray, hashes: np.ndarray) -> None:
        """Words become known under the numbers that follow; ``hashes`` ascend and are new."""
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.order = np.insert(self.order, at, self.rows.size + np.arange(len(rows)))
        self.rows.extend(rows)

    def _shrink(self) -> None:
        """Keep words met more than once, half of the most at most; the others are computed again if they come back."""
        uses = self.uses.data[self.order]
        kept = np.flatnonzero(uses > 1)
        if len(kept) > self.max_words // 2:
            kept = np.sort(kept[np.argpartition(-uses[kept], self.max_words // 2)[: self.max_words // 2]])
        numbers, hashes = self.order[kept], self.hashes[kept]
        values, sizes, rows = self.values(numbers), self.sizes(numbers), self.rows.data[numbers]
        self._start()
        self._append(values, sizes)
        self._keep(rows, hashes)

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        ends = self.ends.data
        return ends[numbers] - np.where(numbers > 0, ends[numbers - 1], 0)

    def last(self, numbers: np.ndarray) -> np.ndarray:
        """The last value of each word."""
        return self.flat.data[self.ends.data[numbers] - 1]

    def values(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.sizes(numbers)
        return ragged(self.flat.data, self.ends.data[numbers] - sizes, sizes)

    def look_up(self, keys: pa.Array) -> np.ndarray:
        """Numbers of distinct keys, valid until the next call. Those not known are computed together."""
        n = len(self)
        self.flat.size, self.ends.size, self.uses.size = int(self.ends.data[n - 1]) if n else 0, n, n  # long words of the last call go
        if n > self.max_words:
            self._shrink()
            n = len(self)
        rows, sizes = packed(keys)
        hashes = mixed(rows)
        by_hash = np.argsort(hashes)
        hashes, numbers = hashes[by_hash], np.full(len(keys), -1, dtype=np.int64)
        free = np.ones(len(keys), dtype=bool)
        if n:
            at = np.minimum(np.searchsorted(self.hashes, hashes), n - 1)
            met = self.hashes[at] == hashes
            found = np.flatnonzero(met)
            number = self.order[at[found]]
            same = (self.rows.data[number] == rows[by_hash[found]]).all(axis=1) & (sizes[by_hash[found]] <= LONG)
            numbers[by_hash[found[same]]] = number[same]
            free = ~met
        free[1:] &= hashes[1:] != hashes[:-1]
        free &= sizes[by_hash] <= LONG
        new, once = by_hash[free], np.flatnonzero(numbers < 0)
        once = np.setdiff1d(once, new, assume_unique=True)
        for part, stays in ((new, True), (once, False)):
            if len(part):
                first = self.ends.size
                self._append(*self.resolve(raw_words(keys.take(pa.array(part)))))
                numbers[part] = np.arange(first, first + len(part))
                if stays:
                    self._keep(rows[part], hashes[free])
        self.uses.data[numbers] += 1
        return numbers

    def words_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of all texts, and where each text's words begin and end."""
        keys, bounds = split_texts(texts)
        coded = keys.dictionary_encode()
        numbers = self.look_up(coded.dictionary)
        return numbers[coded.indices.to_numpy(zero_copy_only=False)], bounds


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``word_keys`` of all texts in one array, and where each text's begin. Texts without nulls and special strings.

    Those with single blanks and line feeds only, between other characters, are cut by Arrow at once.
    """
    odd = np.flatnonzero(pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0))
    fed = pc.binary_join_element_wise("\0", pc.replace_substring(texts, "\n", " \n"), "")
    if not len(odd):
        cut = pc.split_pattern(fed, " ")
        offsets = cut.offsets.to_numpy()
        return cut.flatten(), (offsets - offsets[0]).astype(np.int64)
    by_hand = [word_keys(t) for t in texts.take(pa.array(odd)).to_pylist()]
    plain = np.setdiff1d(np.arange(len(texts)), odd)
    cut = pc.split_pattern(fed.take(pa.array(plain, pa.int64())), " ")
    flat = pa.array([k for keys in by_hand for k in keys], cut.type.value_type)
    sizes, starts = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    offsets = cut.offsets.to_numpy().astype(np.int64)
    sizes[plain], starts[plain] = np.diff(offsets), offsets[:-1] - offsets[0]
    n = int(offsets[-1] - offsets[0])
    sizes[odd] = list(map(len, by_hand))
    starts[odd] = n + np.cumsum(sizes[odd]) - sizes[odd]
    order = ragged(np.arange(n + len(flat)), starts, sizes)
    return pa.concat_arrays([cut.flatten(), flat]).take(pa.array(order)), np.concatenate([[0], np.cumsum(sizes)])


class LibraryWords(WordTable):
    """Words encoded by the tokenizers library; a word's values are its ids."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        self.tok = load(path)
        table = token_bytes(path)
        super().__init__("<u2" if len(table) <= 1 << 16 else "<u4", max_words)
        self.lengths = np.array([len(x) for x in table], dtype=np.int64)
        self.specials = list(special_ids(path))
        model = {k: v for k, v in description(path)["model"].items() if k != "type" and v is not None}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.pop("merges")]
        self.pieces = Tokenizer(models.BPE(merges=merges, cache_capacity=0, **model))  # words come once, so the model's own cache only costs
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _alone(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words that the pattern leaves whole: the library's model encodes a run of them at once, and byte lengths tell where
        each begins. The ids, and the end of each word's."""
        if not len(pieces):
            return np.zeros(0, dtype=self.dtype), np.zeros(0, dtype=np.int64)
        runs = pa.ListArray.from_arrays(pa.array([*range(0, len(pieces), 512), len(pieces)], pa.int32()), pieces)
        coded = self.pieces.encode_batch_fast(pc.binary_join(runs, "\n").to_pylist(), add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype=self.dtype) for e in coded])
        sizes = pc.binary_length(pieces).to_numpy(zero_copy_only=False)
        return ids, 1 + np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes, dtype=np.int64))

    def resolve(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """To the pattern, a blank with letters is one piece, a line feed before letters another, and so is what follows them if it
        holds no letter or digit. Words of such pieces are put together; others go to the library one by one."""
        is_bare = pc.match_substring_regex(words, BARE).to_numpy(zero_copy_only=False)
        bare = np.flatnonzero(is_bare)
        tailed, bodies, tails, rest, left = [], [], [], [], []
        others = np.flatnonzero(~is_bare)
        for n, w in zip(others.tolist(), words.take(pa.array(others)).to_pylist(), strict=True):
            cut = TAIL.search(w).start()
            body = w[w[0] == "\n" : cut]
            if body.isalpha() or body[:1] == " " and body[1:].isalpha():
                tailed.append(n)
                bodies.append(body)
                tails.append(w[cut:])
            else:
                rest.append(n)
                left.append(w)
        fed = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        letters = words.take(pa.array(bare))
        if fed[bare].any():
            letters = pc.if_else(pa.array(fed[bare]), pc.utf8_slice_codeunits(letters, 1), letters)
        ids, ends = self._pieces(pa.concat_arrays([letters, pa.array(bodies, words.type)]))
        known = list(dict.fromkeys(["\n", *tails]))
        parts = [*self._alone(known), *self._alone(left)]
        lengths = np.array(list(map(len, parts)), dtype=np.int64)
        flat = np.concatenate([ids, *parts])
        first = len(ids) + np.cumsum(lengths) - lengths
        # Three runs for each word: the line feed, the letters, what follows.
        starts, sizes = np.zeros((len(words), 3), dtype=np.int64), np.zeros((len(words), 3), dtype=np.int64)
        plain = np.concatenate([bare, np.array(tailed, dtype=np.int64)])
        lead = plain[fed[plain]]
        starts[lead, 0], sizes[lead, 0] = first[0], lengths[0]
        begins = np.concatenate([[0], ends])[:-1]
        starts[plain, 1], sizes[plain, 1] = begins, ends - begins
        number = {x: k for k, x in enumerate(known)}
        of = np.fromiter(map(number.__getitem__, tails), dtype=np.int64, count=len(tails))
        starts[tailed, 2], sizes[tailed, 2] = first[of], lengths[of]
        starts[rest, 1], sizes[rest, 1] = first[len(known) :], lengths[len(known) :]
        return ragged(flat, starts.ravel(), sizes.ravel()), sizes.sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings without null), equal to the library's without added special tokens, and where each text's begin."""
        whole = special_texts(texts, self.specials)
        if len(whole):  # a special string is found in the whole text first
            coded = self._alone(texts.take(pa.array(whole)).to_pylist())
            texts = pc.replace_with_mask(texts, pa.array(np.isin(np.arange(len(texts)), whole)), pa.scalar("", texts.type))
        numbers, bounds = self.words_of(texts)
        sizes = self.sizes(numbers)
        ids = ragged(self.flat.data, self.ends.data[numbers] - sizes, sizes)
        at = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        if not len(whole):
            return ids, at
        sizes = np.diff(at)
        starts = at[:-1].copy()
        more = np.array(list(map(len, coded)), dtype=np.int64)
        starts[whole], sizes[whole] = len(ids) + np.cumsum(more) - more, more
        return ragged(np.concatenate([ids, *coded]), starts, sizes), np.concatenate([[0], np.cumsum(sizes)])


def special_texts(texts: pa.Array, specials: list[str]) -> np.ndarray:
    """Which texts hold a special token's string."""
    found = np.zeros(len(texts), dtype=bool)
    for s in specials:
        found |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    return np.flatnonzero(found)


@lru_cache(maxsize=2)
def library_words(path: str) -> LibraryWords:
    """One table for each worker process and tokenizer file; it lives on over tasks."""
    return LibraryWords(path)
