"""URL filter: host and path rules, and a character language-model ratio for the URLs that no rule fits. Built-in functions only.

Two variable-order Markov models over URL characters, one for accepted and one for rejected URLs, are counted from the URLs
that a rule decides. Orders 0 to ORDER are interpolated by Witten-Bell smoothing; a context seen fewer than MIN_CONTEXT times is
left out, so the order varies with the evidence. Every character counts as itself (A-Z as a-z), and every distinct gram of the
table has a row with its log-likelihood difference in whole millionths of a nat, so the models grow with the input. A URL's
score is the sum of its grams' differences over their number. A third of the decided URLs is held back from counting, and the
threshold is the one that separates it best.

Grams that make up at least one in HOT of all occurrences are HOT at most whatever the corpus is: they are broadcast, and the
others, none of them frequent, meet the model by an exchange.

Defined cases: host and path of a null URL or one without ``://`` are empty; a null or empty URL that no rule fits is blocked;
equal URLs get equal rows; without decided URLs every score is 0 and the threshold 0, which allows; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored

#: (rule, allowed): host and path in one; it fits the host and its subdomains and paths that begin so.
RULES = (("com/", True), ("example.com/en/", False), ("www.example.com/en/", True), ("net/es/", False), ("net/fr/", False))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The longest context, in characters, and what stands before a URL's first one.
ORDER = 4
START = "\x02"
MIN_CONTEXT = 4
UNIT = 1_000_000
#: The number of grams that may be broadcast.
HOT = 1 << 16
#: Threshold candidates are steps of a thousandth of a nat up to these.
BIN, MOST = 1000, 5000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, bool]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; of two as long, the one with the longer host."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, allow in sorted(rules, key=lambda x: (len(x[0]), x[0].index("/"))):
        h, p = r[: r.index("/")], r[r.index("/") :]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit("allow" if allow else "block")).otherwise(verdict)
    return rule, verdict


def grams(url: Column) -> Column:
    """For each character, itself after the ORDER before it."""
    plain = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    pad = F.concat(F.array(*[F.lit(START)] * ORDER), F.filter(F.split(plain, ""), lambda c: c != ""))
    of = lambda s: F.transform(F.slice(s, F.lit(ORDER + 1), F.size(s) - ORDER), lambda c, i: F.concat(*(F.get(s, i + k) for k in range(ORDER)), c))
    return F.element_at(F.transform(F.array(pad), of), 1)


def model(counts: DataFrame) -> DataFrame:
    """``g``, ``n``, ``llr``: the log-likelihood difference of each gram in millionths. ``counts`` has a row for each gram of the
    table, with its occurrences ``n`` and those in accepted (``a``) and rejected (``r``) URLs. A context has as many rows as
    there are characters at most, so no key of these joins is hot."""
    sides = ("a", "r")
    level = lambda k: counts.groupBy(F.substring("g", ORDER + 1 - k, k + 1).alias("s")).agg(*(F.sum(x).cast("double").alias(x) for x in sides))
    ones = level(0)
    whole = lambda x: ones.agg(F.sum(x) + F.count("*")).scalar()
    p = ones.select("s", *(((F.col(x) + 1) / whole(x)).alias(f"p_{x}") for x in sides))
    for k in range(1, ORDER + 1):
        seen = level(k).withColumns({"c": F.substring("s", 1, k), "t": F.substring("s", 2, k)})
        of = seen.groupBy("c").agg(*(F.sum(x).alias(f"n_{x}") for x in sides), *(F.count_if(F.col(x) > 0).cast("double").alias(f"k_{x}") for x in sides))
        mixed = lambda x: F.when(F.col(f"n_{x}") >= MIN_CONTEXT, (F.col(x) + F.col(f"k_{x}") * F.col(f"p_{x}")) / (F.col(f"n_{x}") + F.col(f"k_{x}"))).otherwise(F.col(f"p_{x}"))
        p = seen.join(of, "c").join(p.withColumnRenamed("s", "t"), "t").select("s", *(mixed(x).alias(f"p_{x}") for x in sides))
    # floor(x + 0.5), as round() at a half differs between engines
    llr = F.floor((F.log("p_a") - F.log("p_r")) * UNIT + 0.5).cast("long").alias("llr")
    return p.select(F.col("s").alias("g"), llr).join(counts.select("g", "n"), "g")


def scores(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``__r`` and ``score_bin`` of the rows with a character. ``rows`` has a row number ``__r`` and the URL ``__u``."""
    each = rows.select("__r", F.explode(grams(F.col("__u"))).alias("g"))
    share = known.withColumn("hot", F.col("n") * HOT >= known.agg(F.sum("n")).scalar())
    hot, rest = share.filter("hot").select("g", "llr"), share.filter("not hot").select("g", "llr")
    part = lambda x: x.groupBy("__r").agg(F.sum("llr").alias("s"), F.count("*").alias("n"))
    frequent = part(each.join(F.broadcast(hot), "g"))
    others = part(each.join(F.broadcast(hot.select("g")), "g", "left_anti").join(rest, "g"))
    total = frequent.unionByName(others).groupBy("__r").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    step = F.floor(F.col("s") / (F.col("n") * BIN)).cast("long")
    return total.select("__r", F.greatest(F.lit(-MOST), F.least(F.lit(MOST), step)).cast("long").alias("score_bin"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row: ``bin``, the step from which a score is accepted that gives the largest sum of both classes' shares decided right;
    of equal ones the nearest to 0, then the smaller. ``scored`` has ``score_bin`` and ``good``; bins are few and bounded."""
    bins = scored.select("good", F.col("score_bin").alias("bin")).groupBy("bin").agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("r"))
    bins = bins.unionByName(scored.sparkSession.range(1).select(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("r"))).groupBy("bin").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    up, every = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    sums = bins.select("bin", (F.sum("a").over(every) - F.coalesce(F.sum("a").over(up), F.lit(0))).alias("a_ge"), F.coalesce(F.sum("r").over(up), F.lit(0)).alias("r_lt"), F.sum("a").over(every).alias("na"), F.sum("r").over(every).alias("nr"))
    worth = (F.col("a_ge") * F.col("nr") + F.col("r_lt") * F.col("na")).alias("worth")
    return sums.select(worth, (-F.abs("bin")).alias("near"), (-F.col("bin")).alias("low"), "bin").agg(F.max(F.struct("worth", "near", "low", "bin"))["bin"].alias("bin"))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, bool]] = RULES) -> DataFrame:
    """key, host, path, rule, verdict, and ``score_bin``, the score in thousandths of a nat a character."""
    u = F.col("__u")
    rows = pages.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{url}`").alias("__u"))
    host, path = host_and_path(u)
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict})
    held = F.coalesce(F.md5(F.encode(u, "UTF-8")).substr(1, 1).isin(*"01234"), F.lit(False))
    # Written once, so that row numbers are the same wherever the rows are read.
    rows = stored(rows.withColumns({"rule": rule, "said": verdict, "held": held, "__r": F.monotonically_increasing_id()}), "urls")
    of = lambda said: F.count_if((F.col("said") == said) & ~F.col("held"))
    counts = stored(rows.select("said", "held", F.explode(grams(u)).alias("g")).groupBy("g").agg(F.count("*").alias("n"), of("allow").alias("a"), of("block").alias("r")), "grams")
    scored = rows.join(scores(rows, stored(model(counts), "model")), "__r", "left").withColumn("score_bin", F.coalesce("score_bin", F.lit(0).cast("long")))
    scored = stored(scored.select("__k", (F.coalesce(u, F.lit("")) == "").alias("blank"), "host", "path", "rule", "said", "held", "score_bin"), "scored")
    least = threshold(scored.filter("held and said is not null").select((F.col("said") == "allow").alias("good"), "score_bin"))
    own = F.when(F.col("blank"), "block").when(F.col("score_bin") >= least.scalar(), "allow").otherwise("block")
    return scored.select(F.col("__k").alias(key), "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "score_bin")
