"""Text rewriting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import join_lines, let, lines, words

#: CSI sequences, OSC sequences (ended by BEL or ST), two-byte escapes and a bare escape.
ANSI = "\x1b\\[[0-?]*[ -/]*[@-~]|\x1b\\][^\x07\x1b]*(\x07|\x1b\\\\)|\x1b[@-Z\\\\-_]|\x1b"


def ansi_strip(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def fold_diff(df: DataFrame, key: str, text: str, context: int = 2) -> DataFrame:
    """Unchanged lines of a diff further than ``context`` from a change become their number. A line is near if a window around it
    holds a change; runs of far lines are islands."""
    ex = df.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line"))
    changed = F.col("line").rlike(r"^(\+|-|@@|diff |index )")
    w = W.partitionBy(key).orderBy("pos")
    ex = ex.withColumn("near", F.max(changed.cast("int")).over(w.rowsBetween(-context, context)) == 1)
    ex = ex.withColumn("run", F.col("pos") - F.row_number().over(W.partitionBy(key, "near").orderBy("pos")))
    islands = W.partitionBy(key, "near", "run")
    ex = ex.withColumn("n", F.count("*").over(islands)).withColumn("first", F.min("pos").over(islands))
    out = F.when(F.col("near"), F.col("line")).when(F.col("pos") == F.col("first"), F.concat(F.lit("["), F.col("n").cast("string"), F.lit(" unchanged lines]")))
    kept = ex.withColumn("out", out).filter("out is not null")
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]), "\n").alias("folded"))


# Words and their abbreviations.
ABBREVIATIONS = {
    "implementation": "impl", "implementations": "impls", "configuration": "config", "configurations": "configs", "authentication": "auth",
    "authorization": "authz", "application": "app", "applications": "apps", "environment": "env", "environments": "envs", "development": "dev",
    "production": "prod", "repository": "repo", "repositories": "repos", "dependency": "dep", "dependencies": "deps", "documentation": "docs",
    "information": "info", "directory": "dir", "directories": "dirs", "parameter": "param", "parameters": "params", "argument": "arg",
    "arguments": "args", "function": "fn", "functions": "fns", "reference": "ref", "references": "refs", "specification": "spec",
    "specifications": "specs", "temporary": "tmp", "administrator": "admin", "administrators": "admins", "database": "db", "databases": "dbs",
    "message": "msg", "messages": "msgs", "response": "resp", "request": "req", "requests": "reqs", "attribute": "attr", "attributes": "attrs",
    "expression": "expr", "expressions": "exprs", "operation": "op", "operations": "ops", "maximum": "max", "minimum": "min", "boolean": "bool",
    "integer": "int", "previous": "prev", "current": "curr", "original": "orig", "synchronize": "sync", "asynchronous": "async",
    "initialize": "init", "allocation": "alloc", "allocations": "allocs", "generation": "gen", "miscellaneous": "misc", "statistics": "stats",
    "connection": "conn", "connections": "conns", "transaction": "txn", "transactions": "txns", "management": "mgmt", "notification": "notif",
    "notifications": "notifs", "permission": "perm", "permissions": "perms", "distribution": "distro", "distributions": "distros",
    "architecture": "arch", "infrastructure": "infra", "kubernetes": "k8s", "namespace": "ns", "namespaces": "nses", "container": "ctr",
    "containers": "ctrs", "microservice": "svc", "microservices": "svcs",
}


def abbreviate(text: Column, table: dict[str, str] = ABBREVIATIONS) -> Column:
    """Whole words, in any case, by their abbreviations. Runs of ASCII letters and digits are looked up in one map, so the text is
    read once however long the table is."""
    marked = F.regexp_replace(text, "([A-Za-z0-9]+)", "\x01$1\x01")
    lookup = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.array_join(F.transform(F.split(marked, "\x01"), lambda w: F.coalesce(lookup[F.lower(w)], w)), "")


# Phrases in the order of their substitution; the last squeezes blanks.
PHRASES = (
    ("for example", "e.g."), ("For example", "E.g."), ("that is to say", "i.e."), ("in order to", "to"), ("In order to", "To"), ("as well as", "&"),
    ("such as", "e.g."), ("a number of", "several"), ("A number of", "Several"), ("due to the fact that", "because"),
    ("Due to the fact that", "Because"), ("in the event that", "if"), ("In the event that", "If"), ("at this point in time", "now"),
    ("At this point in time", "Now"), ("it is important to note that ", ""), ("It is important to note that ", ""),
    ("it should be noted that ", ""), ("It should be noted that ", ""), ("the fact that ", ""), ("there is a need to", "must"),
    ("There is a need to", "Must"), ("in terms of", "regarding"), ("In terms of", "Regarding"), ("with respect to", "regarding"),
    ("With respect to", "Regarding"), ("on the other hand", "conversely"), ("On the other hand", "Conversely"), ("in addition to", "besides"),
    ("In addition to", "Besides"), ("as a result of", "from"), ("As a result of", "From"), ("  ", " "),
)


def normalise_space(text: Column) -> Column:
    """Lines trimmed, runs of blanks and tabs one blank, runs of blank lines one; trailing white space goes."""
    x = F.regexp_replace(text, "\r\n", "\n")
    x = F.regexp_replace(x, "[ \t]+", " ")
    x = F.regexp_replace(x, "(^|\n) +", "$1")
    x = F.regexp_replace(x, " +(\n|$)", "$1")
    return F.rtrim(F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), "\\s+$", ""))


def substitute(text: Column, phrases=PHRASES) -> Column:
    for a, b in phrases:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def substitute_if_shorter(text: Column) -> Column:
    """Phrases substituted, if that makes the text shorter in bytes."""
    return let(F.rtrim(substitute(normalise_space(text))), lambda x: F.when(F.octet_length(x) < F.octet_length(text), x).otherwise(text))


def strip_comments(text: Column) -> Column:
    """Code without whole-line comments (documentation, shebangs and attributes stay) and with runs of blank lines cut to one."""

    def comment(x: Column) -> Column:
        t = F.trim(x)
        return (t.startswith("//") & ~t.startswith("///")) | (t.startswith("#") & ~t.startswith("#!") & ~t.startswith("#["))

    def cut(ls: Column) -> Column:
        return F.filter(ls, lambda x, i: (F.trim(x) != "") | (i == 0) | (F.trim(F.get(ls, F.greatest(i - 1, F.lit(0)))) != ""))

    return join_lines(let(F.filter(lines(text), lambda x: ~comment(x)), cut), text)


# Filler that goes, as patterns in any case.
FILLERS = (
    r"\b(I think that|I believe that|I feel that|It seems that|It appears that)\s*",
    r"\b(As you (may |might )?know|As we all know|As mentioned (earlier|above|before|previously))\s*,?\s*",
    r"\b(It is (important|worth|interesting) to note that|It should be noted that)\s*",
    r"\b(Needless to say|It goes without saying that|Obviously|Clearly|Of course)\s*,?\s*",
    r"\b(In my opinion|From my perspective|In my view|Personally)\s*,?\s*",
    r"\b(basically|essentially|fundamentally|literally|actually|really|quite|rather|somewhat|fairly)\s+",
    r"\b(In conclusion|To summarize|To sum up|In summary|All in all|Overall)\s*,?\s*",
    r"\b(As a matter of fact|The thing is|The point is|What I mean is)\s*,?\s*",
)
# Long phrases of prose and their short forms.
PROSE_PHRASES = (
    ("in spite of the fact that", "although"), ("despite the fact that", "although"), ("due to the fact that", "because"),
    ("for the purpose of", "to"), ("in the event that", "if"), ("with the exception of", "except"), ("in the absence of", "without"),
    ("at this point in time", "now"), ("in close proximity to", "near"), ("the vast majority of", "most"), ("a large number of", "many"),
    ("has the ability to", "can"), ("in accordance with", "per"), ("take into consideration", "consider"), ("with respect to", "about"),
    ("with regard to", "about"), ("in conjunction with", "with"), ("on the other hand", "however"), ("in addition to", "besides"),
    ("a number of", "several"), ("in order to", "to"), ("as a result of", "from"), ("in terms of", "regarding"), ("pertaining to", "about"),
    ("subsequent to", "after"), ("prior to", "before"), ("whether or not", "whether"), ("as well as", "and"), ("in the field of", "in"),
    ("in the area of", "in"), ("is able to", "can"), ("are able to", "can"), ("was able to", "could"), ("such as", "like"),
    ("on a daily basis", "daily"), ("for the most part", "mostly"), ("in the near future", "soon"), ("a wide range of", "many"),
    ("a variety of", "various"), ("the majority of", "most"), ("a significant number of", "many"), ("on the basis of", "based on"),
    ("in the context of", "in"), ("make a decision", "decide"), ("have an impact on", "affect"), ("plays a role in", "affects"),
)
# Verbs after which "that" goes.
THAT_VERBS = "believe|think|know|said|found|show|suggest|indicate|ensure|note|argue|claim|assume|expect|hope|feel|realize|understand|demonstrate|reveal|confirm|conclude|determine|observe|report|state|mention|explain|propose|recommend|consider|notice|remember|prove|verify|imply|mean|see"
VERBS = (("is being", "is"), ("are being", "are"), ("has been", "was"), ("have been", "were"), ("will be able to", "can"), ("would be able to", "could"))
TRANSITIONS = "However|Therefore|Furthermore|Moreover|Additionally|Consequently|Nevertheless|Nonetheless|Meanwhile|Subsequently|Accordingly|Similarly|Likewise|Alternatively|Conversely|Specifically|Importantly|Interestingly|Notably|Significantly|Ultimately"
CONTRACTIONS = (
    ("do not", "don't"), ("Do not", "Don't"), ("cannot", "can't"), ("will not", "won't"), ("should not", "shouldn't"), ("would not", "wouldn't"),
    ("could not", "couldn't"), ("does not", "doesn't"), ("did not", "didn't"), ("is not", "isn't"), ("are not", "aren't"), ("was not", "wasn't"),
    ("were not", "weren't"), ("has not", "hasn't"), ("have not", "haven't"), ("it is", "it's"), ("that is", "that's"), ("there is", "there's"),
    ("they are", "they're"), ("we are", "we're"), ("you are", "you're"), ("I am", "I'm"), ("I have", "I've"), ("I would", "I'd"), ("I will", "I'll"),
)
ADVERBS = "very|extremely|incredibly|remarkably|particularly|especially|significantly|substantially|considerably|tremendously|enormously|immensely|vastly|greatly|highly|deeply|strongly|firmly|closely|widely|largely|mostly|nearly|almost|approximately|roughly|generally|typically|usually|often|frequently|commonly|increasingly|rapidly|gradually|slowly|carefully|properly|effectively|efficiently|successfully|completely|entirely|totally|fully|absolutely|perfectly|exactly|precisely|certainly|definitely|undoubtedly|obviously|apparently|seemingly|relatively|comparatively"


def strip_fillers(text: Column) -> Column:
    for p in FILLERS:
        text = F.regexp_replace(text, "(?i)" + p, "")
    return text


def tighten_prose(text: Column) -> Column:
    """All passes over prose in their order: fillers, phrases, articles, "that", verbs, transitions, contractions, adverbs, polish."""
    x = strip_fillers(text)
    for a, b in PROSE_PHRASES:
        x = F.replace(F.replace(x, F.lit(a), F.lit(b)), F.lit(a[0].upper() + a[1:]), F.lit(b[0].upper() + b[1:]))
    x = F.regexp_replace(x, r"\b(The|the|A|a|An|an)\s+([a-z])", "$2")
    x = F.regexp_replace(x, rf"(?i)\b({THAT_VERBS})\s+that\b", "$1")
    for a, b in VERBS:
        x = F.regexp_replace(x, rf"(?i)\b{a}\b", b)
    x = F.regexp_replace(x, rf"(?m)^({TRANSITIONS})\s*,?\s+", "")
    for a, b in CONTRACTIONS:
        x = F.regexp_replace(x, rf"\b{a}\b", b)
    x = F.regexp_replace(x, rf"(?i)\b({ADVERBS})\s+", "")
    for p, r in (("  +", " "), ("\n ", "\n"), ("\n{3,}", "\n\n"), (" ([.,;:!?])", "$1")):
        x = F.regexp_replace(x, p, r)
    return F.regexp_replace(x, "\\s+$", "")


def strip_markdown(text: Column) -> Column:
    for p, r in ((r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1"), (r"(?m)^#{1,6}\s+(.+)$", "$1:"), (r"(?m)^[-*_]{3,}\s*$", ""), (r"(?m)^(\s*)[-*+]\s+", "$1- ")):
        text = F.regexp_replace(text, p, r)
    return text


def strip_blobs(text: Column) -> Column:
    """Base64 runs of at least 100 characters become their length: the text is split at them and put together again."""
    pattern = r"(?:data:[a-z]+/[a-z+.-]+;base64,)?[A-Za-z0-9+/]{100,}={0,2}"
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.array_join(F.flatten(F.transform(F.split(text, pattern, -1), lambda x, i: F.when(i < F.size(found), F.array(x, F.concat(F.lit("[blob:"), F.length(F.get(found, i)).cast("string"), F.lit("ch]")))).otherwise(F.array(x)))), "")


def shorten_paths(text: Column) -> Column:
    """The common folder of a text's deep paths becomes ``~/`` if it is longer than ten characters."""
    paths = F.regexp_extract_all(text, F.lit(r"((?:/[\w.-]+){3,})"), F.lit(1))

    def cut(ps: Column) -> Column:
        a, b = F.array_min(ps), F.array_max(ps)
        same = F.aggregate(F.sequence(F.lit(1), F.least(F.length(a), F.length(b))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(n))
        prefix = F.regexp_extract(F.substring(a, F.lit(1), same), "^(.*/)", 1)
        return F.when((F.size(ps) > 1) & (F.length(prefix) > 11), F.replace(text, prefix, F.lit("~/"))).otherwise(text)

    return let(paths, cut)


def sentences(text: Column, least_words: int = 3) -> Column:
    """Sentences end at . ! or ? before a blank or line feed; shorter ones are dropped."""
    parts = F.split(F.regexp_replace(text, "([.!?])([ \n])", "$1\x01$2"), "\x01")
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, "\n", " "))), lambda x: F.size(words(x)) >= least_words)


def summarise(text: Column, least_bytes: int = 200) -> Column:
    """A long message's first and last line with what is left out between."""
    ls = lines(text)
    short = F.concat(F.element_at(ls, 1), F.lit("\n[... "), (F.size(ls) - 2).cast("string"), F.lit(" lines, "), F.octet_length(text).cast("string"), F.lit(" chars ...]\n"), F.element_at(ls, -1))
    return F.when((F.octet_length(text) >= least_bytes) & (F.size(ls) > 3), short).otherwise(text)


def headline(text: Column, most: int = 80) -> Column:
    """A first line cut to ``most`` bytes, characters here, as bytes may fall within one."""
    first = F.coalesce(F.get(lines(text), F.lit(0)), F.lit(""))
    return F.when(F.octet_length(first) <= most, first).otherwise(F.concat(F.substring(first, 1, most - 3), F.lit("...")))


def protect_prefix(text: Column, chars: int) -> Column:
    """The first characters stay as they are; in the rest, lines lose trailing blanks, equal neighbours and doubled blank lines."""
    head, tail = F.substring(text, 1, chars), F.substring(text, F.lit(chars + 1), F.length(text))
    ls = F.transform(F.split(tail, "\n", -1), lambda x: F.regexp_replace(x, "[ \t]+$", ""))
    cut = let(ls, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, F.greatest(i - 1, F.lit(0))))))
    return F.concat(head, F.array_join(cut, "\n"))


DIRECTIVES = {"low": "Be concise.", "medium": "Be terse. Skip pleasantries.", "high": "Answer in as few words as possible."}


def with_directive(text: Column, level: str) -> Column:
    return F.concat(F.lit(DIRECTIVES[level] + "\n"), text)


def annotation(before: Column, after: Column, confidence: Column) -> Column:
    """``a→b tokens (p% saved)`` with a mark for the confidence."""
    saved = F.when(before > 0, F.round(100.0 * F.greatest(before - after, F.lit(0)) / before).cast("int")).otherwise(F.lit(0))
    mark = F.when(confidence >= 0.9, "✓").when(confidence >= 0.6, "~").otherwise("⚠")
    return F.concat(before.cast("string"), F.lit("→"), after.cast("string"), F.lit(" tokens ("), saved.cast("string"), F.lit("% saved) "), mark)


def grep(df: DataFrame, key: str, text: str, pattern: str, regex: bool = False) -> DataFrame:
    """Lines that contain or match a pattern, with their numbers."""
    ex = df.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line"))
    return ex.filter(F.col("line").rlike(pattern) if regex else F.contains(F.col("line"), F.lit(pattern))).select(key, (F.col("pos") + 1).cast("int").alias("line_no"), "line")


def line_range(text: Column, first: int, last: int, context: int = 3) -> Column:
    """Lines of a range with a mark, and unmarked ones around it."""
    ls = lines(text)
    kept = F.filter(F.transform(ls, lambda x, i: F.concat(F.when((i + 1 >= first) & (i + 1 <= last), F.lit("> ")).otherwise(F.lit("  ")), (i + 1).cast("string"), F.lit(": "), x)), lambda x, i: (i + 1 >= first - context) & (i + 1 <= last + context))
    return F.array_join(kept, "\n")


def html_to_markdown(html: Column) -> Column:
    """Headings, paragraphs, lists, code and emphasis as markdown; scripts, styles and other tags go."""
    x = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", "")
    for n in range(1, 7):
        x = F.regexp_replace(x, rf"(?is)<h{n}[^>]*>", "\n" + "#" * n + " ")
    for p, r in ((r"(?is)</h[1-6]>", "\n"), (r"(?is)<(p|br|div)[^>]*>", "\n"), (r"(?is)</(p|div)>", "\n"), (r"(?is)<li[^>]*>", "\n- "), (r"(?is)</?pre[^>]*>", "\n```\n"), (r"(?is)</?code[^>]*>", "`"), (r"(?is)</?(b|strong)>", "**"), (r"(?is)</?(i|em)>", "_"), (r"(?s)<[^>]*>", "")):
        x = F.regexp_replace(x, p, r)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, "[ \t]+", " ")
    x = F.regexp_replace(x, " ?\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), "^\n+|\n+$", ""))


def heading_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Chunks of markdown, each from a heading to the next; a running count of headings numbers them."""
    ex = df.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line"))
    is_head = F.col("line").startswith("#")
    ex = ex.withColumn("chunk", F.sum(is_head.cast("int")).over(W.partitionBy(key).orderBy("pos")).cast("int"))
    out = ex.groupBy(key, "chunk").agg(F.max(F.when(is_head, F.trim(F.regexp_replace("line", "^#+", "")))).alias("heading"), F.array_sort(F.collect_list(F.when(~is_head, F.struct("pos", "line")))).alias("body"))
    out = out.select(key, "chunk", F.coalesce("heading", F.lit("")).alias("heading"), F.regexp_replace(F.array_join(F.transform("body", lambda x: x["line"]), "\n"), "^\\s+|\\s+$", "").alias("body"))
    return out.filter((F.col("heading") != "") | (F.col("body") != ""))


def pack_blocks(text: Column, most: int = 512) -> Column:
    """Line blocks of at most ``most`` bytes each, filled in order; a longer line is a block of its own."""
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("held"), F.lit(0).alias("n"))

    def step(acc: Column, line: Column) -> Column:
        size = F.octet_length(line) + 1
        full = (acc["held"] > 0) & (acc["held"] + size > most)
        return F.struct(F.when(full, F.concat(acc["ends"], F.array(acc["n"]))).otherwise(acc["ends"]).alias("ends"), F.when(full, size).otherwise(acc["held"] + size).alias("held"), (acc["n"] + 1).alias("n"))

    def cut(ls: Column) -> Column:
        return let(F.aggregate(ls, start, step), lambda a: let(F.concat(a["ends"], F.array(a["n"])), lambda ends: F.transform(ends, lambda e, i: let(F.when(i > 0, F.get(ends, F.greatest(i - 1, F.lit(0)))).otherwise(F.lit(0)), lambda b: F.array_join(F.slice(ls, b + 1, e - b), "\n")))))

    return F.when(text == "", F.array().cast("array<string>")).otherwise(let(lines(text), cut))


#: English function words, which carry little; a parameter of ``density_prune``.
FUNCTION_WORDS = tuple("a about after all also an and any are as at be because been before but by can could did do does for from had has have he her here him his how if in into is it its just like may more most my no not now of on one only or other our out over she should so some such than that the their them then there these they this those through to under up us very was we were what when where which while who will with would you your".split())
#: Fixed: sentences that name a source, a part of a document or a formula stay.
CITATION = r"(?i)\[[\d,\s]+\]|\(\d{4}\)|et al|Fig\.|Table|Equation|Section|Chapter"
FORMULA = r"[=<>{}()\[\]].*[=<>{}()\[\]]"


def density(sentence: Column, common: tuple[str, ...] = FUNCTION_WORDS) -> Column:
    """The share of a sentence's words of two letters or more that are not common ones, 0 without words."""
    ws = F.filter(F.split(F.regexp_replace(F.lower(sentence), "[^a-z' ]", " "), r"\s+"), lambda w: F.length(w) > 1)
    return let(ws, lambda w: F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.filter(w, lambda x: ~x.isin(*common))) / F.size(w)))


def density_prune(text: Column, over: int = 8, share: float = 0.15, common: tuple[str, ...] = FUNCTION_WORDS) -> Column:
    """Of a text of more than ``over`` sentences, ``share`` of them go, the least dense ones first. The first and the last, short ones,
    and those with digits, citations or formulas stay. All in the row; a null text stays null."""
    parts = F.split(F.regexp_replace(text, r"(?<=[.!?])\s+", "\x01"), "\x01", -1)

    def prune(ss: Column) -> Column:
        last = F.size(ss) - 1
        free = lambda x, i: (i > 0) & (i < last) & (F.size(F.split(x, r"\s+")) > 5) & ~x.rlike(r"\d") & ~x.rlike(CITATION) & ~x.rlike(FORMULA)
        ranked = F.array_sort(F.filter(F.transform(ss, lambda x, i: F.when(free(x, i), F.struct(density(x, common).alias("d"), i.alias("i")))), lambda r: r.isNotNull()))
        gone = F.transform(F.slice(ranked, F.lit(1), F.floor(F.size(ss) * share).cast("int")), lambda r: r["i"])
        return let(gone, lambda g: F.array_join(F.filter(ss, lambda x, i: ~F.array_contains(g, i)), " "))

    return let(parts, lambda ss: F.when(F.size(ss) > over, prune(ss)).otherwise(text))
