"""Exact token counts at every prefix of a text, by dynamic programming over its bytes.

In byte-pair encoding, a sequence of tokens is what merging gives exactly if each neighbouring pair of it is: merging the two
tokens' bytes gives just these two. So the last token of a prefix of length i is the only token t that ends there and goes
with the last token of the prefix that t leaves, and the count is one more than that prefix's. One pass over a word's bytes
yields the count at each of its prefixes, without encoding any prefix anew. Words are the pieces between which the
tokenizer's pattern always cuts (words.py); a table keeps distinct words' counts at all their prefixes. With the sums over
words they are the counts at every prefix of a text: a budget is met by binary search over the sums and a look into one row.

``count_tokens`` gives a row for each row of the input. ``fit_bytes`` is the longest prefix, in bytes and at a character's
end, of at most ``limit`` tokens; a prefix is cut as a text of its own, so white space at the cut counts as it would there.
``Ledger`` answers the same for any budget or prefix of a text.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; an empty table gives an empty
result; other columns of the input, whatever their names, are left out; a text with a special token's string counts it as
that token, and every prefix that ends within it as ordinary text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .shared import text_array, text_slices
from .words import BLANK, MAX_WORDS, WHITE_SPACE, WordTable, byte_alphabet, description, raw_word, special_ids, special_texts, split_texts, token_bytes, word_keys

#: The public pattern of this tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The rank that ends a whole token.
NEVER = 1 << 40


class PrefixRows(WordTable):
    """For each word, the token count at each of its byte prefixes; the last is the word's own count."""

    def __init__(self, path: str, max_words: int = MAX_WORDS, max_pairs: int = 1_000_000):
        super().__init__("<u4", max_words)
        d = description(path)
        if d["model"]["type"] != "BPE" or d["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE tokenizer is needed")
        alphabet = byte_alphabet()
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, merge in enumerate(d["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[bytes(alphabet[c] for c in a), bytes(alphabet[c] for c in b)] = rank
        specials = set(special_ids(path).values())
        self.tokens = {t for i, t in enumerate(token_bytes(path)) if t and i not in specials}
        self.suffixes = {t[n:] for t in self.tokens for n in range(len(t))}
        self.made = {a + b: (a, b) for a, b in self.ranks}
        self.cut = regex.compile(PATTERN)
        self.max_pairs = max_pairs
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The symbols at one end of a token while it is merged, from its byte to itself, each with the rank that ends it."""
        spine, ends = [], NEVER
        while True:
            spine.append((token, ends))
            if token not in self.made:
                return spine[::-1]
            ends = self.ranks[self.made[token]]
            token = self.made[token][side]

    def _goes(self, a: bytes, b: bytes) -> bool:
        """Whether merging the bytes of both tokens gives just them. A token's parts rank before it, so merges happen in the order
        of rank: two symbols that meet at the seam merge if their rank comes before either ends (a tie goes to the left)."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > self.max_pairs:
                self.pairs = {}
            left, right = self._spine(a, 1), self._spine(b, 0)
            i = j = 0
            known = True
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                rank = self.ranks.get((x, y))
                if rank is not None and rank < x_ends and rank <= y_ends:
                    known = False
                    break
                if x_ends == y_ends == NEVER:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            self.pairs[a, b] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        """Counts at the prefixes of one piece of the pattern, without the empty one."""
        last: list[bytes | None] = [None] * (len(data) + 1)
        counts = [0] * (len(data) + 1)
        tokens, suffixes = self.tokens, self.suffixes
        for end in range(1, len(data) + 1):
            for start in range(end - 1, -1, -1):
                t = data[start:end]
                if t in tokens and (start == 0 or self._goes(last[start], t)):
                    last[end], counts[end] = t, counts[start] + 1
                    break
                if t not in suffixes:
                    raise ValueError("no token ends here; the vocabulary lacks a byte")
        return counts[1:]

    def row(self, word: str) -> list[int]:
        """Counts at the byte prefixes of a word, without the empty one. Each is the count of the prefix as a text of its own, at
        every byte that ends a character: pieces before the one cut stay as they are, and the cut one is still one piece."""
        if word[:1] == " " and word[1:].isalpha():
            return self.piece(word.encode())
        out, before = [], 0
        for piece in self.cut.findall(word):
            counts = self.piece(piece.encode())
            if piece[0] == "'" and len(piece) > 2 and piece[1:].isalpha():  # 're cut after the r is no such piece
                counts[1] = counts[0] + self.piece(piece[1].encode())[-1]
            out += [before + n for n in counts] if before else counts
            before = out[-1]
        return out

    def total(self, word: str) -> int:
        return self.row(word)[-1] if word else 0

    def resolve(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = list(map(self.row, words.to_pylist()))
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        return np.fromiter(chain.from_iterable(rows), dtype=self.dtype, count=int(sizes.sum())), sizes


@lru_cache(maxsize=2)
def prefix_rows(path: str) -> PrefixRows:
    return PrefixRows(path)


class Ledger:
    """One text's token counts: at each word's end, and at each prefix of a word. Prefixes and budgets are looked up.

    Only white space that a cut joins with white space before it, and a special token's string that is cut, are counted anew.
    """

    def __init__(self, words: list[str], special: list[bool], sums: np.ndarray, row: Callable[[int], np.ndarray], total: Callable[[str], int]):
        self.words, self.special, self.sums, self.row, self.total = words, special, sums, row, total
        self.ends = np.cumsum([0, *map(len, words)])

    @classmethod
    def of(cls, rows: PrefixRows, text: str, specials: dict[str, int]) -> Ledger:
        words: list[str] = []
        special: list[bool] = []
        for part, is_special in split_specials(text, specials):
            raws = [part] if is_special else list(map(raw_word, word_keys(part)))
            words += raws
            special += [is_special] * len(raws)
        counts = [[] if s else rows.row(w) for w, s in zip(words, special, strict=True)]
        return cls(words, special, np.cumsum([0, *(c[-1] if c else 1 for c in counts)]), lambda n: np.array(counts[n]), rows.total)

    def _joins(self, n: int) -> bool:
        """Whether blanks at the beginning of word n are one piece with those before them."""
        return n > 0 and not self.special[n - 1] and BLANK.fullmatch(self.words[n - 1][-1]) is not None

    def at(self, chars: int) -> int:
        """Tokens of the prefix of so many characters, as a text of its own."""
        n = int(np.searchsorted(self.ends, chars, side="right")) - 1
        part = "" if n == len(self.words) else self.words[n][: chars - self.ends[n]]
        if part and self.special[n]:  # a cut special string is text, joined to what precedes it
            while n and not self.special[n - 1]:
                n -= 1
                part = self.words[n] + part
                if not BLANK.fullmatch(self.words[n]):
                    break
            return int(self.sums[n]) + sum(self.total(raw_word(k)) for k in word_keys(part))
        if self._joins(n) and BLANK.fullmatch(part):
            while self._joins(n):
                n -= 1
                part = self.words[n] + part
                if not BLANK.fullmatch(self.words[n]):
                    break
            return int(self.sums[n]) + sum(self.total(raw_word(k)) for k in word_keys(part))
        return int(self.sums[n]) + (int(self.row(n)[len(part.encode()) - 1]) if part else 0)

    def _within(self, n: int, limit: int) -> int:
        """The most characters of a prefix that ends inside word n and keeps to the limit, or 0."""
        word, start = self.words[n], int(self.ends[n])
        if self.special[n]:
            return next((start + c for c in range(len(word) - 1, 0, -1) if self.at(start + c) <= limit), 0)
        ends = np.arange(1, len(word)) if word.isascii() else np.cumsum(np.fromiter((len(c.encode()) for c in word[:-1]), dtype=np.int64, count=len(word) - 1))
        blanks = len(word) - len(word.lstrip(WHITE_SPACE)) if self._joins(n) else 0
        fits = np.flatnonzero(self.row(n)[ends - 1] <= limit - self.sums[n]) if len(word) > 1 else []
        if len(fits) and fits[-1] >= blanks:
            return start + 1 + int(fits[-1])
        return next((start + c for c in range(min(blanks, len(word) - 1), 0, -1) if self.at(start + c) <= limit), 0)

    def fit(self, limit: int) -> int:
        """The most characters of which the prefix has at most ``limit`` tokens: binary search finds the word, its counts the rest.
        Cutting a text can save two tokens at most where white space joins, so the search begins two above the limit."""
        if limit < 0:
            return 0
        most = min(int(np.searchsorted(self.sums, limit + 2, side="right")), len(self.words))
        for n in range(most, 0, -1):
            if self.at(int(self.ends[n])) <= limit:
                return int(self.ends[n])
            if inside := self._within(n - 1, limit):
                return inside
        return 0


def split_specials(text: str, specials: dict[str, int]) -> list[tuple[str, bool]]:
    if not any(s in text for s in specials):
        return [(text, False)] if text else []
    pattern = "|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))
    return [(p, p in specials) for p in regex.split(f"({pattern})", text) if p]


SCHEMA = "n_bytes long, n_tokens long, over_limit boolean, fit_bytes long"


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) and fit_bytes."""
    rows = docs.select(docs[f"`{key}`"].alias("k"), docs[f"`{text}`"].cast("string").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, specials = prefix_rows(path), special_ids(path)
        for batch in text_slices(batches, "text"):
            texts = text_array(batch)
            n_bytes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            special = special_texts(texts, list(specials))
            plain = pc.replace_with_mask(texts, pa.array(np.isin(np.arange(len(texts)), special)), pa.scalar("", texts.type)) if len(special) else texts
            keys, bounds = split_texts(plain)
            coded = keys.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            numbers = table.look_up(coded.dictionary)[codes]
            sums = np.concatenate([[0], np.cumsum(table.last(numbers), dtype=np.int64)])
            n_tokens, fit = np.diff(sums[bounds]), n_bytes.copy()
            for n in np.flatnonzero(n_tokens > limit).tolist():  # of a long text only the words up to the limit are needed
                start, end = int(bounds[n]), int(bounds[n + 1])
                end = min(end, start + 1 + int(np.searchsorted(sums[start:end] - sums[start], limit + 2, side="right")))
                words = list(map(raw_word, keys.slice(start, end - start).to_pylist()))
                row = lambda k, start=start: table.values(numbers[start + k : start + k + 1]).astype(np.int64)
                ledger = Ledger(words, [False] * len(words), sums[start : end + 1] - sums[start], row, table.total)
                fit[n] = len("".join(words)[: ledger.fit(limit)].encode())
            for n in special.tolist():
                text = texts[n].as_py()
                ledger = Ledger.of(table, text, specials)
                n_tokens[n] = ledger.sums[-1]
                fit[n] = n_bytes[n] if n_tokens[n] <= limit else len(text[: ledger.fit(limit)].encode())
            yield pa.record_batch([batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit), pa.array(fit)], names=["k", "n_bytes", "n_tokens", "over_limit", "fit_bytes"])

    return rows.mapInArrow(run, f"k {kind}, {SCHEMA}").withColumnRenamed("k", key)
