"""Operators through Spark: brute force on small tables, edge cases, and the pipeline."""

import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from quillgrid.llm import bpe_rounds, hd_langid, histogram_sort, media_store, packing, prefix_counts, queries, rans_store, rule_ledger, shingle_join, simhash_grid, url_filter

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")

#: Nulls, empty and very long texts, ties, repeated rows, a hot text, and columns named like outputs or helpers.
ROWS = [(1, "The quick brown fox jumps over the lazy dog again and again", "en"), (2, "The quick brown fox jumps over the lazy dog again and again", "en"), (3, None, "en"), (4, "", None), (5, "   \n\t ", "de"), (None, "Der schnelle braune Fuchs springt über den faulen Hund", "de"), (7, "x", "fr"), (7, "x", "fr"), (8, "wort " * 30000, "de"), (9, "<|endoftext|> a  b\n\nc", None), (10, "12 34 !!", "en"), *((100 + n, "hot text of many rows, the same in each of them", "en") for n in range(40))]
EXTRA = "doc_id long, text string, lang string, n_tokens string, shard string, fp string, k string, fail_bits string, `a.b` string, __k string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in ROWS], EXTRA).repartition(3)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


OPERATORS = {
    "shard": lambda d: histogram_sort.shard(d, 16), "simhash": simhash_grid.groups, "counts": lambda d: prefix_counts.count_tokens(d, PATH), "store": lambda d: rans_store.round_trip(d, PATH),
    "media": media_store.store_and_read, "bpe": lambda d: bpe_rounds.encode_decode(d, PATH), "language": hd_langid.identify, "rules": lambda d: rule_ledger.apply_policy(rule_ledger.measure(d)), "pack": lambda d: packing.pack(d, PATH),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(odd, name):
    got = OPERATORS[name](odd).select("doc_id").collect()
    if name == "pack":
        assert {r["doc_id"] for r in got} == {r[0] for r in ROWS}
    else:
        assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in ROWS)
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_counts_store_and_bpe_agree_with_the_library(odd):
    want = collections.Counter((r[0], len(ids_of(r[1]))) for r in ROWS)
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in OPERATORS["counts"](odd).collect()) == want
    assert collections.Counter((r["doc_id"], r["n_tokens"] - 1) for r in OPERATORS["store"](odd).collect()) == want
    digest = collections.Counter((r[0], hashlib.sha256(np.array(ids_of(r[1]), "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in ROWS)
    assert collections.Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in OPERATORS["bpe"](odd).collect()) == digest


def test_store_is_in_order(odd):
    rows = OPERATORS["store"](odd).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    want = collections.Counter((k, zlib.crc32(np.array([*ids_of(t), 0], "<u4").tobytes())) for k, t, _ in ROWS)
    assert collections.Counter((r["doc_id"], r["ids_crc32"]) for r in rows) == want


def test_media_columns(odd):
    """Every column from the payload, with another PNG reader's steps: inflate, drop the filter bytes."""
    got = collections.Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")) for r in OPERATORS["media"](odd).collect())
    want = collections.Counter()
    for k, t, _ in ROWS:
        data = (t or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        image = media_store.to_png(payload)
        at = image.index(b"IDAT")
        lines = zlib.decompress(image[at + 4 : at + 4 + int.from_bytes(image[at - 4 : at], "big")])
        assert b"".join(lines[n + 1 : n + 193] for n in range(0, len(lines), 193)) == payload
        counts = collections.Counter(payload)
        feature = f"192x{len(payload) // 192}x8 mean={sum(payload) / len(payload):.4f} distinct={len(counts)} top={1000 * max(counts.values()) // len(payload)}"
        want[k, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature] += 1
    assert got == want


def test_packing_is_close_to_the_bound(odd):
    rows = packing.pack(odd, PATH).collect()
    sizes = [r["length"] for r in rows]
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(sizes) // 1024) + 1


def check_shards(rows, out, shards=16):
    """Every column of the result by brute force: sizes, digests, even shards, gapless slots."""
    size = lambda t: len((t or "").encode()) + 1
    want = collections.Counter((k, size(t), zlib.crc32((t or "").encode()), "bytes", None) for k, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in out) == want
    sizes, slots = collections.Counter(dict.fromkeys(range(shards), 0)), collections.defaultdict(list)
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(sizes) == set(range(shards))
    mean, most = sum(sizes.values()) / shards, max((size(t) for _, t in rows), default=0)
    assert all(abs(s - mean) <= max(2 * histogram_sort.TOLERANCE * mean, most + 1) for s in sizes.values())


SHARDED = {
    "a hot text": [(n, "hot" if n % 3 == 0 else f"text {n} " * (n % 17)) for n in range(3000)],
    "a hot text without ids": [(None, "the same text") for _ in range(3000)] + [(n, f"another text {n}") for n in range(3000)],
    "one row many times": [(5, "é") for _ in range(500)],
    "few rows": [(1, "a"), (2, None), (3, "")],
    "a long text": [(n, "x" * (20_000 if n == 7 else 3)) for n in range(100)],
}


@pytest.mark.parametrize("name", SHARDED)
def test_shards_are_even_and_gapless(spark, name):
    rows = SHARDED[name]
    check_shards(rows, histogram_sort.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 16).collect())


@needs_data
def test_shards_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_shards([(r["doc_id"], r["text"]) for r in docs.collect()], queries.QUERIES["op2_sharding"](spark, SF).collect())


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def grouped(keys, fps, distance):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = collections.defaultdict(lambda: 1 << 62)
    for i, k in enumerate(keys):
        if k is not None:
            least[find(i)] = min(least[find(i)], k)
    return [least[find(i)] for i in range(len(fps))]


def test_simhash_groups(spark, odd):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{n}" for n in range(50)]
    base = [" ".join(rng.choice(vocabulary, 60)) for _ in range(40)]
    texts = base + [b.replace(" ", " Zusatz ", 1) for b in base] + [b.upper() for b in base]
    rows = [(n, t) for n, t in enumerate(texts)] + [(r[0], r[1]) for r in ROWS if r[0] and r[0] > 200]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_grid.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [fingerprint(t) for _, t in rows]
    assert {k: f"{f:016x}" for (k, _), f in zip(rows, fps, strict=True)} == {k: v[0] for k, v in got.items()}
    assert dict(zip([k for k, _ in rows], grouped([k for k, _ in rows], fps, 4), strict=True)) == {k: v[1] for k, v in got.items()}


def test_a_long_cell_loses_no_link(spark):
    rng = np.random.default_rng(11)
    halves = rng.integers(0, 2, (500, 32))  # each segment of two bits has one set, so all are in one cell
    base = [sum((1 if bit else 2) << (2 * n) for n, bit in enumerate(row)) for row in halves.tolist()]
    base += [b ^ sum(1 << int(x) for x in rng.choice(64, int(rng.integers(1, 6)), replace=False)) for b in base[:250] for _ in range(2)]
    fps = np.unique(np.array(base, dtype=np.uint64).view(np.int64))
    edges = simhash_grid.links(spark.createDataFrame([(int(f),) for f in fps], "fp long"), 4)
    assert edges.filter("u <= v").count() == 0
    got = {r["node"]: r["label"] for r in simhash_grid.components(edges).collect()}
    want = grouped(list(range(len(fps))), [int(f) & (2**64 - 1) for f in fps], 4)
    assert [int(got.get(int(f), f)) for f in fps] == [int(fps[n]) for n in want]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(n + 1, n) for n in range(200)] + [(1001, 1000)], "u long, v long")
    got = {r["node"]: r["label"] for r in simhash_grid.components(edges).collect()}
    assert got == {n: 0 for n in range(201)} | {1000: 1000, 1001: 1000}


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(max(0, len(words) - 7)))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\v\f")]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", " ".join(words))), len(lines) - len(set(lines)), len(covered)


def test_rules(odd, spark):
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in OPERATORS["rules"](odd).collect())
    assert got == collections.Counter((r[0], *measured(r[1])) for r in ROWS)
    ledger = rule_ledger.measure(odd)
    kept = rule_ledger.apply_policy(ledger).filter("kept").count()
    for r in rule_ledger.ablations(ledger).collect():
        assert r["kept_without"] == kept + r["failed_only"] and r["failed"] >= r["failed_only"]


def test_packing_is_whole(odd):
    rows = packing.pack(odd.filter("doc_id != 7"), PATH).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for key, text, _ in ROWS:
        if key not in (None, 7):
            data, at = [*ids_of(text), 2], 0
            for r in sorted((r for r in rows if r["doc_id"] == key), key=lambda r: r["piece"]):
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(data[at : at + r["length"]], "<u4").tobytes())
                at += r["length"]
            assert at == len(data)


def test_media_addresses(odd):
    folder = media_store.shared_folder(odd.sparkSession, "media")
    rows = media_store.with_metadata(media_store.write_media(odd, folder), folder)
    one = media_store.canonical(rows)
    assert one.count() == len(ROWS)
    assert one.select("digest", "shard", "offset").distinct().count() == one.select("digest").distinct().count()
    got = {r["doc_id"]: r for r in media_store.features(rows, folder).collect()}
    assert got[3]["payload_bytes"] == 192 and got[3]["feature"] == got[4]["feature"] and got[1]["media_sha256"] == got[2]["media_sha256"]


def test_language(odd, spark):
    got = {r["doc_id"]: r for r in hd_langid.identify(odd).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[10]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(("" if k is None else str(k)).encode()) % 3 == 1) for k, r in got.items())
    nothing = odd.withColumn("lang", odd["lang"].substr(100, 1)).filter("lang is null")
    assert {r["lang_pred"] for r in hd_langid.identify(nothing).collect()} <= {"und"}


@needs_data
def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    x = hd_langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'")
    assert x.filter("lang = lang_pred").count() >= 0.97 * x.count()


URLS = [None, "", "no scheme", "HTTP://Shop.Example.COM/A?b#c", "http://example.com", "http://www.example.com/en/x", "http://a.example.com/en/x", "ftp://x.net/es/", "http://x.net/esx", "http://notexample.com/en/", "http://x.org/?q=://y", "a://b://c"]


def test_urls(spark):
    rows = spark.createDataFrame([(n, u, "x") for n, u in enumerate(URLS)], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(rows).collect()}
    assert {k: v[:3] for k, v in got.items()} == {
        0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("shop.example.com", "/A", "com/"), 4: ("example.com", "", None), 5: ("www.example.com", "/en/x", "www.example.com/en/"),
        6: ("a.example.com", "/en/x", "example.com/en/"), 7: ("x.net", "/es/", "net/es/"), 8: ("x.net", "/esx", None), 9: ("notexample.com", "/en/", "com/"), 10: ("x.org", "/", None), 11: ("b:", "//c", None),
    }
    assert got[0][3] == got[1][3] == "block" and got[5][3] == "allow" and {v[3] for v in got.values()} <= {"allow", "block"}
    assert url_filter.judge(rows.limit(0)).count() == 0


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twins(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = c.sql(queries.ORACLE_SQL[name])
    theirs = sorted((tuple(dict(zip(got.columns, r, strict=True))[k] for k in columns) for r in got.fetchall()), key=str)
    assert sorted((tuple(r[k] for k in columns) for r in df.collect()), key=str) == theirs


@needs_data
def test_pipeline(spark):
    """Every stage by brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_key = {r["doc_id"]: r["text"] for r in docs.collect()}

    def repeated_lines(text):
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\v\f")]
        seen, again = set(), []
        for x in lines:
            again += [x] * (x in seen)
            seen.add(x)
        chars = lambda xs: sum(len(re.sub(r"[\x20\x09-\x0D]", "", x)) for x in xs)
        return len(again) >= 3 and 100 * len(again) > 30 * len(lines) and 100 * chars(again) > 10 * chars(lines)

    def good(text):
        n, chars, symbols, _, repeat = measured(text)
        return n >= 20 and 100 * repeat <= 30 * n and 10 * symbols <= n and not repeated_lines(text) and 2 * n <= chars <= 12 * n

    first = corpus_pipeline.quality_rules(spark, docs, SF)
    left = sorted(r["doc_id"] for r in first.collect())
    assert first.columns == docs.columns and left == sorted(k for k, t in by_key.items() if good(t))
    second = corpus_pipeline.language_id(spark, first, SF)
    predict = hd_langid.predictor(hd_langid.train(first))
    langs, scores = predict([by_key[k] for k in left])
    left = [k for k, x, s in zip(left, langs, scores, strict=True) if x != hd_langid.UNKNOWN and s >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    assert second.columns == docs.columns and sorted(r["doc_id"] for r in second.collect()) == left
    third = corpus_pipeline.simhash_dedup(spark, second, SF)
    want = sorted({left[n] for n in jaccard_groups([by_key[k] for k in left])})
    assert third.columns == docs.columns and sorted(r["doc_id"] for r in third.collect()) == want
    last = corpus_pipeline.best_fit_packing(spark, third, SF).collect()
    total = collections.Counter()
    for r in last:
        total[r["doc_id"]] += r["length"]
    assert total == {k: len(ids_of(by_key[k])) + 1 for k in want}


def test_stages_take_odd_rows(odd, spark):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() >= 0
        assert stage(spark, odd.limit(0), SF).count() == 0
    kept = corpus_pipeline.simhash_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(7) == 1 and 100 in ids and 101 not in ids


def test_representatives_with_null_and_repeated_ids(spark):
    texts = [" ".join(f"w{m}x{n}" for m in range(30)) for n in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (9, texts[4]), (None, texts[4]), (7, texts[4]), (8, texts[5])]
    kept = simhash_grid.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept) == collections.Counter([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[5])])


def jaccard_groups(texts, words=5):
    """The least index in each text's group, by all pairs."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    label = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if v == old else v for v in label]
    return label


@pytest.mark.parametrize("most", [0, 8])
def test_near_copies_by_exact_similarity(spark, most):
    rng = np.random.default_rng(3)
    common = " ".join(f"law{n}" for n in range(16))  # in every text: a long run of texts that are not alike
    texts = []
    for n in range(30):
        w = [f"w{v}" for v in rng.integers(0, 10**6, int(rng.integers(5, 120)))]
        texts.append(common + " " + " ".join(w))
        for _ in range(int(rng.integers(0, 4))):  # copies on both sides of 0.8, also of copies
            for at in rng.integers(0, len(w), max(1, len(w) // 40)):
                w[at] = f"v{rng.integers(0, 10**6)}"
            texts.append(common + " " + " ".join(w))
    texts += [common, common.upper(), common + " end", None, "", " \n", "a b", "A  b", "a b c"]
    texts += [" ".join(f"h{n}" if n != k else f"x{k}" for n in range(60)) for k in range(40)]  # a large group of near copies
    order = rng.permutation(len(texts)).tolist()
    rows = spark.createDataFrame([(n, texts[k]) for n, k in enumerate(order)], "n long, text string").repartition(3)
    got = {r["n"]: r["label"] for r in shingle_join.groups(rows, "n", "text", most=most).collect()}
    assert [got[n] for n in range(len(order))] == jaccard_groups([texts[k] for k in order])


@needs_data
def test_pipeline_dedup_is_exact(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    want = {rows[k]["doc_id"] for k in jaccard_groups([r["text"] for r in rows])}
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, SF).collect()) == sorted(want)


def test_a_repeated_line_rejects_no_clean_document(spark):
    body = " ".join(f"word{n}" for n in range(80))
    texts = [f"See below\n{body}\nSee below", f"a title\na title\n{body}\na title", "\n".join(["buy the best things here now"] * 5 + [" ".join(f"word{n}" for n in range(40))]), body]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()) == [0, 1, 3]


def test_url_model_contexts_and_shares(spark, monkeypatch):
    """Contexts of four characters count, digits and letters of any script tell apart, and it makes no difference which grams are broadcast."""
    rows = [(n, f"http://a{n}.com/{'абв' if n % 2 else 'ok'}/7{n % 10}") for n in range(60)] + [(100 + n, f"http://b{n}.net/fr/где/8{n % 10}") for n in range(60)]
    rows += [(300, "http://x.org/абв/7"), (301, "http://x.org/где/8"), (302, "http://x.org/" + "ab" * 50000), (303, "x" * 3), (303, None), (304, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
    show = lambda: sorted((tuple(r) for r in url_filter.judge(pages).collect()), key=str)
    every = show()
    verdicts = {r[0]: r[4] for r in every}
    assert verdicts[300] == "allow" and verdicts[301] == "block" and verdicts[304] == "block" and len(every) == len(rows)
    monkeypatch.setattr(url_filter, "HOT", 20)
    assert show() == every
