"""The algorithms without Spark, against the libraries or brute force."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgrid.llm import bpe_rounds, hd_langid, histogram_sort, media_store, packing, prefix_counts, rans_store, simhash_grid, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "foo", " ", "  ", "\n", "\n\n", "'ll", "'", "é", "\t", "\x85", "　", "1", "23", "<|endoftext|>", "!", "日本", "\x1c", "\0", "\r\n", "🙂", "x" * 50, " \n", "\n ", "The", "hello", "ing"]
texts = st.lists(st.sampled_from(PARTS), max_size=12).map("".join) | st.text(max_size=40)


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(texts)
def test_words_make_the_text_and_the_ids(text):
    assert "".join(map(words.raw_word, words.word_keys(text))) == text
    got, at = words.library_words(PATH).encode(pa.array([text, "", text + " <|endoftext|>", text]))
    assert [got[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [ids(text), [], ids(text + " <|endoftext|>"), ids(text)]


@settings(max_examples=300, deadline=None)
@given(texts)
def test_rounds(text):
    r = bpe_rounds.round_words(PATH)
    coded, at = r.encode(pa.array([text, "", text + "x<|endoftext|> y", text]))
    assert [coded[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [ids(text), [], ids(text + "x<|endoftext|> y"), ids(text)]
    assert r.decode(coded, at)[0] == LIBRARY.decode(ids(text), skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_every_prefix(text):
    ledger = prefix_counts.Ledger.of(prefix_counts.prefix_rows(PATH), text, words.special_ids(PATH))
    for n in range(len(text) + 1):
        assert ledger.at(n) == len(ids(text[:n]))


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(0, 12))
def test_budget(text, limit):
    ledger = prefix_counts.Ledger.of(prefix_counts.prefix_rows(PATH), text, words.special_ids(PATH))
    best = max(n for n in range(len(text) + 1) if len(ids(text[:n])) <= limit)
    assert ledger.fit(limit) == best


def long_texts():
    rng = random.Random(5)
    letters = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    yield from (letters, "a" * 5001, "日本語中文字" * 4000, letters[:3000] + " x  \n" + letters[3000:9000], " " * 3000 + "b", "=-" * 4000, "'re" * 900)


@pytest.mark.parametrize("text", list(long_texts()), ids=range(7))
def test_long_words(text):
    r, l, p = bpe_rounds.round_words(PATH), words.library_words(PATH), prefix_counts.prefix_rows(PATH)
    some = pa.array([text, "a b", text])
    assert r.encode(some)[0].tolist() == l.encode(some)[0].tolist() == ids(text) + ids("a b") + ids(text)
    ledger = prefix_counts.Ledger.of(p, text, {})
    assert ledger.sums[-1] == len(ids(text))
    for limit in (0, 1, 700, 1024):
        n = ledger.fit(limit)
        assert len(ids(text[:n])) <= limit and all(len(ids(text[:k])) > limit for k in range(n + 1, min(len(text), n + 60) + 1))


def test_a_full_table_keeps_frequent_words():
    table = words.LibraryWords(PATH, max_words=50)
    rng = random.Random(2)
    for _ in range(30):
        some = ["the same words again", " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))]
        got, at = table.encode(pa.array(some))
        assert [got[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == list(map(ids, some))
        assert len(table) <= 50 + 24
    keys = pa.array(["\0the", "same", "words"])
    assert np.isin(words.mixed(words.packed(keys)[0]), table.hashes).all()


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(words, "mixed", lambda rows: (rows[:, 0] % 7).astype(np.uint64))
    table = words.LibraryWords(PATH, max_words=20)
    for k in range(5):
        some = [f"one two three four five six seven eight nine ten w{k} " + "x" * 40, "nine three one a\0b a"]
        got, at = table.encode(pa.array(some))
        assert [got[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == list(map(ids, some))


def test_bad_tokens_decode_like_the_library():
    r = bpe_rounds.round_words(PATH)
    rng = random.Random(3)
    for _ in range(200):
        some = [rng.randrange(50257) for _ in range(6)]
        assert r.decode(np.array(some), np.array([0, 6]))[0] == LIBRARY.decode(some, skip_special_tokens=False)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000, 140_000, rans_store.BLOCK + 3])
def test_store_round_trip(n):
    data = (np.random.default_rng(n).zipf(1.3, n) % 50257).astype(np.uint16)
    assert np.array_equal(rans_store.decode_group(rans_store.encode_group(data)), data)


def test_store_segments_and_checksums():
    data = (np.random.default_rng(1).zipf(1.3, 4 * rans_store.CHECKPOINT * rans_store.LANES) % 5000).astype(np.uint16)
    table = rans_store.Table.of(data)
    block = rans_store.encode_block(data, table)
    slots = table.slots()
    size = rans_store.CHECKPOINT * rans_store.LANES
    assert np.array_equal(rans_store.decode_block(block, table, slots, range(2, 3)), data[2 * size : 3 * size])
    with pytest.raises((ValueError, IndexError)):
        rans_store.decode_block(block[:-40] + bytes(40), table, slots)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_plan_places_everything(sizes):
    counts = {s: sizes.count(s) for s in set(sizes)}
    fill, placed = {}, {}
    for size, rank, count, first, offset in packing.plan(counts, 64):
        assert rank == placed.get(size, 0)
        placed[size] = rank + count
        for k in range(first, first + count):
            assert fill.get(k, 0) == offset
            fill[k] = offset + size
    assert placed == counts and max(fill.values()) <= 64 and sorted(fill) == list(range(len(fill)))
    first_fit: list[int] = []  # no worse than first fit decreasing by more than one
    for s in sorted(sizes, reverse=True):
        at = next((n for n, f in enumerate(first_fit) if f + s <= 64), None)
        if at is None:
            first_fit.append(s)
        else:
            first_fit[at] += s
    assert len(fill) <= len(first_fit) + 1


@pytest.mark.parametrize(("n", "want"), [(1, [1]), (1024, [1024]), (1025, [1, 1024]), (2048, [1024, 1024]), (3000, [952, 1024, 1024])])
def test_cut(n, want):
    assert packing.cut_lengths(n, 1024) == want


@pytest.mark.parametrize("distance", [4, 5, 7, 8])
def test_grid_loses_no_pair(distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 200, dtype=np.int64)
    flips = [sum(1 << int(b) for b in rng.choice(63, distance, replace=False)) for _ in base]
    other = base ^ np.array(flips, dtype=np.int64)
    for a, b in zip(base, other, strict=True):
        cell, row = simhash_grid.cells(np.array([a, b]), distance)
        assert set(cell[row == 0]) & set(cell[row == 1])


def test_growing_finds_components():
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 8, dtype=np.int64)
    fps = np.sort(np.concatenate([b ^ (1 << rng.integers(0, 63, 20, dtype=np.int64)) for b in base]))
    root = simhash_grid.grow(fps, 4)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin((int(fps[i]) ^ int(fps[j])) & (2**64 - 1)).count("1") <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == root.tolist()


def test_rows_are_below_cuts_like_tuples():
    rng = random.Random(1)
    keys = sorted({tuple(rng.randrange(4) for _ in range(3)) for _ in range(20)})
    rows = [(h, d, r) for h in range(5) for d in range(5) for r in range(5)]
    got = histogram_sort.below(np.array(keys, dtype=np.int64), [np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)])
    assert got.tolist() == [sum(k < r for k in keys) for r in rows]
    some = [(-(2**63), 0, 2**63 - 1), (-5, 7, -1), (3, -(2**63), 2)]
    assert [histogram_sort.key_of(histogram_sort.number_of(k)) for k in some] == some
    assert sorted(some) == sorted(some, key=histogram_sort.number_of)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000))
def test_png_round_trip(data):
    payload = media_store.payload_of(data)
    image = media_store.to_png(payload)
    assert len(payload) % 192 == 0 and payload and media_store.from_png(image) == payload
    assert media_store.png_header(image[:33])[:2] == (192, len(payload) // 192)


def test_bundles_are_sums_of_bound_rotations():
    text = "Ab c"
    codes = hd_langid.codes_of(text).tolist()
    assert codes == [0, ord("a"), ord("b"), 0, ord("c"), 0]
    want = np.zeros(hd_langid.DIMENSIONS)
    for n in range(len(codes) - 2):
        v = [np.roll(hd_langid.letter_vector(c).astype(int), 2 - k) for k, c in enumerate(codes[n : n + 3])]
        want += v[0] * v[1] * v[2]
    got, has = hd_langid.bundles([text, "", "12 3"])
    assert np.array_equal(got[0], want) and has.tolist() == [True, False, False]


def test_many_kinds_of_letters_are_bound_in_slices(monkeypatch):
    rng = random.Random(4)
    some = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000)), "some words", "", "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(900))]
    whole, has = hd_langid.bundles(some)
    monkeypatch.setattr(hd_langid, "KINDS", 500)
    sliced, _ = hd_langid.bundles(some)
    assert np.array_equal(whole, sliced) and has.tolist() == [True, True, False, True]
