"""Literal examples and invariants of single operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.operators import classify, code, context, dedup, entropy, formatters, jsonops, mining, textops, verify
from quillgrid.operators import compact as C
from quillgrid.operators import search as S


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "expected"), [("a\na\na\na\na\nb\n", "a\na\na\nb\n"), ("", ""), ("a\nb", "a\nb"), ("\n\n\n\n\n", "\n\n\n")])
def test_condense(spark, text, expected):
    assert one(spark, dedup.condense(F.col("t")), t=text) == expected


def test_runs_fold_with_their_number(spark):
    assert one(spark, dedup.fold_runs(F.col("t"), 2), t="ok\nok\nok\nok\nok") == "ok [×5]"
    assert one(spark, dedup.fold_runs(F.col("t"), 2), t="a\nb\nc\n") == "a\nb\nc\n"


def test_log_lines_fold_without_their_times(spark):
    text = "2024-01-01 10:00:00 up\n2024-01-01 10:00:01 up\n2024-01-01 10:00:02 down"
    assert one(spark, dedup.fold_runs(F.col("t"), 2, "x", dedup.strip_timestamp), t=text) == "2024-01-01 10:00:00 up [x2]\n2024-01-01 10:00:02 down"


def test_line_similarity(spark):
    rows = [(1, "a\nb\nc", "a\nb\nc"), (2, "a\nb\nc", "x\ny\nz"), (3, "a\nb\nc\nd\ne", "a\nb\nc\nd\nX"), (4, "", ""), (5, "a", "")]
    got = {r["k"]: r["similarity"] for r in dedup.line_similarity(spark.createDataFrame(rows, "k int, l string, r string"), "l", "r", ["k"]).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.8, 4: 1.0, 5: 0.0}


def test_delta_text():
    delta, changed = dedup.delta_text("a\nb\nc\nd\ne", "a\nb\nX\nd\ne", "abc123")
    assert delta.startswith("§delta:abc123§") and "+X" in delta and changed == 1


def test_word_abbreviation(spark):
    got = one(spark, textops.abbreviate(F.col("t")), t="The implementation of the Configuration; we implement this.")
    assert got == "The impl of the config; we implement this."


def test_escapes_go(spark):
    assert one(spark, textops.ansi_strip(F.col("t")), t="\x1b[31mred\x1b[0m \x1b]0;title\x07x\x1bc") == "red xc"


def test_html(spark):
    html = "<h1>Title</h1><script>var x;</script><p>A &amp; B &lt; C</p><style>p{}</style><h2>Sub</h2>"
    assert one(spark, textops.html_to_markdown(F.col("t")), t=html) == "# Title\n\nA & B < C\n\n## Sub"


@pytest.mark.parametrize(("text", "expected"), [("thread panicked at x\nstack backtrace:\n  0: y", True), ("CREATE TABLE t (id int PRIMARY KEY)", True), ("abc1234 fix: password: reset\nabc1235 feat: x", False), ("user: a\npassword: hunter2", True), ("plain", False)])
def test_risk(spark, text, expected):
    assert one(spark, classify.is_high_risk(F.col("t")), t=text) is expected


def test_verifier(spark):
    error = "error: bad thing\nline two"
    assert one(spark, verify.error_lines(F.col("a"), F.col("b")), a=error, b=error)
    assert not one(spark, verify.error_lines(F.col("a"), F.col("b")), a=error, b="line two")
    assert not one(spark, verify.min_retention(F.col("a"), F.col("b")), a="y" * 100, b="x")
    assert not one(spark, verify.json_keys(F.col("a"), F.col("b")), a='{"alpha":1,"beta":2,"gamma":3}', b="alpha")


def test_json_examples():
    run = lambda f, t: jsonops.dump(f(jsonops.parse(t)))
    assert run(jsonops.strip_nulls, '{"a":{"b":null,"c":1}}') == '{"a":{"c":1}}'
    assert run(jsonops.flatten, '{"a":{"b":{"c":1}}}') == '{"a.b.c":1}'
    assert run(lambda v: jsonops.flatten(v, 1), '{"a":{"b":{"c":1}}}') == '{"a":{"b":{"c":1}}}'
    assert run(lambda v: jsonops.keep_fields(v, ["id", "name"]), '{"id":1,"name":"Alice","debug":"x"}') == '{"id":1,"name":"Alice"}'
    assert run(lambda v: jsonops.strip_fields(v, ["metadata.internal_id"]), '{"metadata":{"internal_id":"x","public":"y"},"name":"Bob"}') == '{"metadata":{"public":"y"},"name":"Bob"}'
    assert jsonops.collapse_arrays(jsonops.parse('{"i":[1,2,3,4,5,6,7]}'))["i"][-1] == "... and 2 more items"
    assert run(jsonops.project, '{"id":1,"name":"x","_id":2,"__v":0,"debug_info":1,"internal_state":2,"e":[],"s":""}') == '{"id":1,"name":"x"}'
    assert run(lambda v: v, "1.50e3") == "1.50e3"


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=6), x, max_size=4), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(values)
def test_notation_round_trip(v):
    import json

    parsed = jsonops.parse(json.dumps(v))
    coded = jsonops.encode(parsed)
    assert coded.isascii() and jsonops.decode(coded) == parsed


@pytest.mark.parametrize("text", ["x", "TOON:{a:", "TOON:[1", "TOON:1 2", "TOON:{1:2}"])
def test_notation_errors_name_the_place(text):
    with pytest.raises(ValueError, match="position"):
        jsonops.decode(text)


def test_formatters():
    assert formatters.format_output("git status", "nothing to commit") == "clean"
    assert formatters.format_output("unknown_tool", "x") is None
    assert "FAIL" in formatters.format_output("cargo test", "test a ... ok\ntest b ... FAILED\n")
    assert formatters.format_output("/usr/bin/tsc", "Found 0 errors.") == "ok: 0 errors"
    assert formatters.format_output("find", "\n".join(f"a/{n}.py" for n in range(30))).startswith("30 files found:")


def test_eviction(spark):
    rows = [("s", "old1", 0, 1), ("s", "old2", 1, 1), ("s", "a", 8, 5), ("s", "b", 9, 5), ("s", "c", 10, 5)]
    df = spark.createDataFrame(rows, "g string, id string, last int, n int")
    out = entropy.evict(df, ["g"], "last", "n", ["id"], F.lit(10), ratio=0.4, keep=3).filter("evicted")
    assert {r["id"] for r in out.collect()} == {"old1", "old2"}


def test_reorder_puts_the_best_at_the_ends(spark):
    df = spark.createDataFrame([("c", p) for p in (1, 3, 8, 10, 7)], "g string, p int")
    got = [r["p"] for r in entropy.reorder_edges(df, ["g"], "p", ["p"]).orderBy("position").collect()]
    assert got == [10, 7, 1, 3, 8]


def test_bm25(spark):
    df = spark.createDataFrame([(1, "the quick brown fox"), (2, "a red car")], "id int, t string")
    assert [r["id"] for r in S.bm25(df, "id", "t", ["fox"]).collect()] == [1]


def test_textrank_keeps_the_better_half():
    sents = ["cats chase mice daily", "mice fear cats daily", "cats chase mice often", "stock prices fell again"]
    kept = mining.rank_sentences(sents)
    assert len(kept) == 2 and 3 not in kept


def test_regret_is_the_same_in_blocks(spark):
    rows = [(n, "k", float(n * 37 % 90)) for n in range(10000)]
    got = mining.regret(spark.createDataFrame(rows, "event_id long, event_type string, value double"), "event_type", "event_id").first()["confidence"]
    x = 1.0
    for _, _, v in rows:
        x = min(1.0, max(0.1, x + (-0.075 if v < 20 else -0.15 if v < 50 else 0.02)))
    assert abs(got - x) < 1e-6


def test_code_symbols(spark):
    df = spark.createDataFrame([(1, "use std::fs;\npub fn run(x: i32) {\n    helper(x)\n}\nfn helper(x: i32) {}\nstruct Point;")], "id int, t string")
    got = {(r["kind"], r["name"]) for r in code.symbols(df, "id", "t").collect()}
    assert {("function", "run"), ("function", "helper"), ("class", "Point")} <= got
    assert [(r["caller"], r["callee"]) for r in code.call_edges(df, "id", "t").collect()] == [("run", "helper")]


def test_presets():
    p = C.Preset(name="x", max_run=2, off=("condense",))
    assert C.Preset.parse(p.dump()) == p
    with pytest.raises(ValueError, match="unknown"):
        C.Preset.parse("stagez = 1")
    with pytest.raises(ValueError, match="max_run"):
        C.Preset(max_run=0)


def test_own_stage(spark):
    before = list(C.STAGES)
    try:
        C.register(C.Stage("shout", 80, lambda t, p: F.upper(t)))
        df = spark.createDataFrame([(1, "quiet words " * 20)], "id int, text string")
        row = C.chain(df, "text", C.Preset()).first()
        assert row["compacted"].isupper() and row["stages"] == ["shout"]
    finally:
        C.STAGES[:] = before


def test_copies_cost_a_reference(spark):
    df = spark.createDataFrame([(1, "some words " * 30), (2, "some words " * 30)], "id int, text string")
    got = {r["id"]: r for r in C.compact(df, "id", "text").collect()}
    assert got[2]["tokens_compacted"] == 13 and got[2]["compacted"].startswith("§ref:") and got[1]["confidence"] == 1.0


def test_files_and_envelopes(spark, tmp_path):
    from quillgrid.sources import envelope, readers

    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / ".git" / "b.py").write_text("y")
    assert [r["name"] for r in readers.list_files(spark, str(tmp_path)).collect()] == ["src/a.py"]
    assert [r["text"] for r in readers.read_texts(spark, str(tmp_path / "src"), "*.py").collect()] == ["x = 1\n"]
    bad = spark.createDataFrame([("{nope",), ('{"version":"9.0","session":{"id":1,"turns":[]}}',)], "envelope string")
    assert {r["error"] for r in envelope.load(bad).collect()} == {"no valid JSON", "a newer version"}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_terms_by_brute_force(spark):
    from quillgrid.operators import search

    texts = [(1, "Red rad ready green greens grün blau blue of"), (2, "blu reed grean, straße strasse"), (3, None), (4, "")]
    vocab = search.vocabulary(spark.createDataFrame(texts, "id long, text string"), "id", "text", None)
    terms = {w for _, t in texts for w in (t or "").lower().replace(",", "").split()}
    assert {r["term"] for r in vocab.collect()} == terms
    queries = ["red", "rid", "green", "gruen", "blue", "strase", "zzzzzz"]
    got = {r["q"]: (r["distance"], r["term"]) for r in search.nearest_terms(spark.createDataFrame([(q,) for q in queries], "q string"), vocab.select("term")).collect()}
    want = {q: min(((edits(q, t), t) for t in terms if 1 <= edits(q, t) <= 2), default=None) for q in queries}
    assert got == {q: w for q, w in want.items() if w}


def test_null_empty_and_repeated_texts_stay(spark):
    from quillgrid.operators import compact, dedup

    rows = [(1, "a text"), (2, None), (3, "a text"), (4, ""), (5, None)] + [(10 + n, "hot") for n in range(50)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = {r["id"]: (r["first_id"], r["copies"]) for r in dedup.exact_dedup(df, "id").collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 2), 5: (2, 2), 4: (4, 1)} | {10 + n: (10, 50) for n in range(50)}
    out = {r["id"]: r["compacted"] for r in compact.compact(df, "id", "text").collect()}
    assert set(out) == {k for k, _ in rows} and out[1] == "a text" and out[3].startswith("§ref:") and out[2] == ""
    assert compact.compact(df.limit(0), "id", "text").count() == 0


def test_short_texts_have_hashes(spark):
    rows = [(1, None), (2, ""), (3, "ab"), (4, "abcd"), (5, "abcd"), (6, "one two three four")]
    d = spark.createDataFrame(rows, "id long, text string")
    sigs = {r["id"]: r["signature"] for r in dedup.minhash(d, "id").collect()}
    assert len(sigs) == 6 and sigs[1] == sigs[2] == sigs[3] == [dedup.PRIME] * 64 and sigs[4] == sigs[5] != sigs[6]
    bits = {r["id"]: r["simhash"] for r in dedup.simhash60(d, "id").collect()}
    assert bits[1] == bits[2] == 0 and bits[4] == bits[5] != 0
    m = dedup.minhash(d, "id")
    found = {(r["id"], r["rep"], r["members"]) for r in dedup.lsh_candidates(m.filter("id = 5"), dedup.signature_classes(m, "id"), "id").collect()}
    assert found == {(5, 4, 2)}
    assert {r["entropy"] for r in entropy.byte_entropy(d.filter("id < 3"), "id").collect()} == {0.0}


def test_recent_candidates(spark):
    rows = [(1, n, n, t) for n, t in enumerate(["a\nb\nc", "x", "a\nb\nd", None, "", *["q%d" % k for k in range(10)], "a\nb\nc"])] + [(2, 0, 100, "a\nb\nc")]
    d = spark.createDataFrame(rows, "s long, turn long, id long, text string")
    got = {r["id"]: (r["candidate"], r["similarity"]) for r in dedup.recent_candidates(d, "s", "turn", "id").collect()}
    assert len(got) == len(rows) and got[2][0] == 0 and abs(got[2][1] - 2 / 3) < 1e-9 and got[4] == (3, 1.0)
    assert got[15] == (None, None) and got[100] == (None, None) and got[0] == (None, None)


def test_keep_informative():
    kept = jsonops.keep_informative(jsonops.parse('["aaaaaaaa", "bbbbbbbb", "cccc", "abcdefgh", "the quick fox", "eeeeeeee", "dddd", 17]'))
    assert kept[:2] == ["aaaaaaaa", "bbbbbbbb"] and "eeeeeeee" not in kept and "the quick fox" in kept and "abcdefgh" in kept and kept[-1] == "[1 low-information elements omitted]"
    assert jsonops.keep_informative([1, 2]) == [1, 2] and jsonops.keep_informative({}) == {}


def test_density_prune(spark):
    dull, dense = "It was the one that they had been with.", "Quantum lattice spectra reveal hidden symmetry breaking."
    ss = [dull, dense, dull, dense, dense, dense, "See Table of the one that is it.", "It is as it was at 7 of the day.", dull, "It is so.", dense, dull]
    assert one(spark, textops.density_prune(F.col("t")), t=" ".join(ss)) == " ".join(ss[:2] + ss[3:])
    assert one(spark, textops.density_prune(F.col("t")), t="A b. C d.") == "A b. C d." and one(spark, textops.density_prune(F.col("t")), t="") == ""


def test_known_file_refs(spark):
    rows = [(1, " --> a.rs:1\nat a.rs:2 and at b.rs:3"), (2, None), (3, ""), (4, " --> a.rsx:1"), (5, " --> a.rs"), *((n, "at a.rs:9") for n in range(10, 40))]
    known = spark.createDataFrame([("a.rs",), ("a.rs",), ("c+(.rs",)], "path string")
    got = {r["id"]: r["text"] for r in context.known_file_refs(spark.createDataFrame(rows, "id long, text string"), "id", "text", known, "path").collect()}
    assert got[1] == " --> a.rs [in context]:1\nat a.rs [in context]:2 and at b.rs:3" and got[2] is None and got[3] == "" and got[4] == " --> a.rsx:1"
    assert got[5] == " --> a.rs [in context]" and got[39] == "at a.rs [in context]:9" and len(got) == len(rows)


def test_replay(spark):
    turns = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "c long, n long, text string")
    more = spark.createDataFrame([(1, 0, "no, x")], "c long, n long, text string")
    assert [r["text"] for r in context.replay(turns, more, "c", "n", "text").orderBy("part", "place").collect()] == ["a", "b", "no, x"]


def test_read_modes(spark):
    source = "import os\n\nclass Abcdefgh(Base):\n    value: int = 1234567890\n\ndef aa(aa):\n    aa = aa\n    aa = aa\n\ndef xyz(q, w, e):\n    return q * w + e / 97\n"
    d = spark.createDataFrame([("src/m.py", source, source.replace("/ 97", "/ 98")), ("x.py", None, None)], "path string, text string, old string")
    read = lambda mode, **k: {r["path"]: r for r in code.read_files(d, "path", "text", mode, **k).collect()}
    assert read("full")["src/m.py"]["content"] == source and read("full")["x.py"]["content"] == ""
    assert read("map")["src/m.py"]["content"] == "# m.py (11 lines)\nimports: 1\nstructs(1): Abcdefgh\nfns(2): aa, xyz" and read("map")["x.py"]["content"] == "# x.py (0 lines)"
    low = read("entropy")["src/m.py"]["content"]
    assert "def aa(aa): /* … */" in low and "return q * w + e / 97" in low and "aa = aa" not in low
    assert read("diff", previous="old", context=1)["src/m.py"]["content"] == "  10: def xyz(q, w, e):\n> 11:     return q * w + e / 97"
    assert read("task", intent=("VALUE",))["src/m.py"]["content"].startswith("class Abcdefgh") and read("task")["src/m.py"]["content"] == source
    assert "> 1: import os" in read("lines")["src/m.py"]["content"] and "def xyz" in read("signatures")["src/m.py"]["content"]
    with pytest.raises(ValueError):
        code.read_files(d, "path", "text", "other")


def test_compact_json(spark):
    rows = [(1, '{"a": 1, "gone": null, "names": ["x", "y"],   "text": "' + "z" * 40 + '"}'), (2, "[1, 2"), (3, '{"a": 1, "gone": null, "names": ["x", "y"],   "text": "' + "z" * 40 + '"}'), (4, None), (5, "plain\nplain\nplain\nplain\nplain")]
    d = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: r for r in C.compact(d, "id", "text").collect()}
    assert got[1]["stages"] == ["json"] and got[1]["compacted"] == 'TOON:{a:1,names:["x","y"],text:"' + "z" * 40 + '"}'
    assert got[2]["compacted"] == "[1, 2" and got[3]["compacted"].startswith("§ref:") and got[4]["compacted"] == "" and "condense" in got[5]["stages"]
    assert {r["id"]: r["compacted"] for r in C.compact(d, "id", "text", C.Preset(json=False)).collect()}[1] == rows[0][1]


def test_best_phrases_by_brute_force(spark):
    import random

    from quillgrid.operators import mining, phrases

    pick = random.Random(7)
    texts = [" ".join(pick.choice(("alpha", "beta", "g", "delta\u2003é", "ooo\n\n")) if pick.random() < 0.3 else f"word{pick.randrange(900)}" for _ in range(400)) for _ in range(40)]
    texts += [None, "", "a b", *["the licence of this text is free for all to use and to change"] * 60, *[f"see the page {k} of the book for more" for k in range(30)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    for most in (1, 5, 20, 5000):
        assert phrases.top_ngrams(df, most=most).collect() == mining.ngrams(df, "id").orderBy(F.desc("savings"), "gram").limit(most).collect()
    # Few n-grams are moved where few are asked for.
    assert phrases.candidates(df, "text", 5, 3, 8, 3, 10).count() < 200 < mining.ngrams(df, "id", least=1).count() / 100


def test_a_phrase_of_long_words_and_of_a_long_text(spark):
    from quillgrid.operators import mining, phrases

    df = spark.createDataFrame([(0, " ".join(["x" * 3000, "y"] * 300)), (1, "p q r stuvwxyz " * 90000)], "id int, text string")
    assert phrases.top_ngrams(df, most=7).collect() == mining.ngrams(df, "id").orderBy(F.desc("savings"), "gram").limit(7).collect()


def test_throttle_goes_on_over_batches(spark, tmp_path):
    from quillgrid.streaming import streams

    rows = [(k, f"2024-01-01 00:{k // 60:02}:{k % 60:02}", None if k % 3 == 0 else k % 2, "view" if k % 5 else None) for k in range(180)]
    for part in range(18):
        spark.createDataFrame(rows[10 * part : 10 * part + 10], "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    stream = streams.event_stream(spark, f"{tmp_path}/events.parquet", 1).withColumn("day", F.to_date("ts"))
    seen, expected = {}, {}
    for k, _, user, kind in rows:
        n = seen[user, kind] = seen.get((user, kind), 0) + 1
        expected[k] = "normal" if n <= 3 else "reduced" if n <= 8 else "blocked"
    assert {r["event_id"]: r["level"] for r in streams.throttle(stream).collect()} == expected
