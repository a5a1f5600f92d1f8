"""URL filter: host rules, and for the rest a ratio of character language models.

Two Markov models of variable order, one of accepted and one of rejected URLs, give
every character a probability after its context of up to ORDER characters. Each order
is interpolated with the next lower one by Witten and Bell: a context weighs its own
counts by how often it was seen against how many different characters followed it,
and a context never seen passes on the lower order unchanged. A URL's score is the
difference of its two log-likelihoods over its length. The threshold is calibrated on
labelled URLs the models have not seen (one in FOLDS by hash): where the shares of
rejected URLs below it and of accepted ones below it are furthest apart, halfway to the
next score seen.

Everything is DataFrame expressions. Positions are counted once, as grams of the
highest order; all lower orders are sums over the distinct grams. Distinct URLs are
scored once. Frequent grams are joined with their one row of the gram table: Spark
broadcasts that where it is small and otherwise splits the frequent ones (AQE).

Defined results: null URLs, and those without "://", have an empty host and path and
no rule; a null URL's score is 0, like that of an empty one. Repeated rows are judged
alike. With no labels of one class all scores are 0 and the threshold is 0, so that
URLs without a rule are allowed. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.plans.storage import stage

ORDER = 4
FOLDS = 5
_START, _END = "\u0002", "\u0003"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = _rest(url)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first "://"; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, else nulls.

    The rules are configuration, a short list; of equally long ones the first wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for then, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(then)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column) -> Column:
    """At each character, and at the end, the character after its ORDER predecessors."""
    chars = F.split(F.concat(F.lit(_START * ORDER), text, F.lit(_END)), "")
    places = F.sequence(F.lit(1), F.length(text) + 1)
    return F.transform(places, lambda i: F.array_join(F.slice(chars, i, ORDER + 1), ""))


def gram_scores(urls: DataFrame) -> DataFrame:
    """(gram, score) for all grams of urls (text, accepted long, rejected long: how
    often the text is a training example): log P(accepted) - log P(rejected)."""
    counts = urls.select(F.explode(_grams(F.col("text"))).alias("gram"), "accepted", "rejected")
    counts = stage(counts.groupBy("gram").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")), "grams")
    letters = counts.agg(F.count_distinct(F.right("gram", F.lit(1)))).first()[0] + 1
    lower = None
    for k in range(ORDER + 1):
        own = counts.groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")) if k < ORDER else counts
        context = F.expr(f"left(gram, {k})")
        after = own.groupBy(context.alias("context")).agg(
            *[F.sum(c).alias(f"n{c}") for c in "ar"], *[F.sum((F.col(c) > 0).cast("long")).alias(f"t{c}") for c in "ar"]
        )
        here = own.withColumn("context", context)
        if lower is None:
            here = here.withColumns({"pa": F.lit(1.0 / letters), "pr": F.lit(1.0 / letters)}).join(after, "context")
        else:
            here = here.withColumn("shorter", F.right("gram", F.lit(k))).join(lower, "shorter").join(after, "context")
        better = {
            f"p{c}": F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"p{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(F.col(f"p{c}"))
            for c in "ar"
        }
        lower = stage(here.select(F.col("gram").alias("shorter"), *[v.alias(n) for n, v in better.items()]), f"order{k}")
    return lower.select(F.col("shorter").alias("gram"), F.log(F.col("pa") / F.col("pr")).alias("score"))


def score(urls: DataFrame) -> DataFrame:
    """(text, score): the length-normalised log-likelihood difference of each distinct
    text of urls (text, accepted, rejected)."""
    urls = stage(urls.groupBy("text").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "urls")
    seen = urls.agg(F.sum("accepted"), F.sum("rejected")).first()
    if not seen[0] or not seen[1]:
        return urls.select("text", F.lit(0.0).alias("score"))
    grams = gram_scores(urls)
    places = urls.select("text", F.explode(_grams(F.col("text"))).alias("gram"))
    total = places.join(grams, "gram").groupBy("text").agg((F.sum("score") / F.count("*")).alias("score"))
    return total


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of pages. The examples
    of accepted and rejected URLs are those that a rule allows or blocks."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_and_path(url)
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), F.translate(_rest(url), _UPPER, _LOWER).alias("text"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("*", rule.alias("rule"), verdict.alias("ruled"))
    for_curve = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0

    def example(of: str) -> Column:
        return ((F.col("ruled") == of) & ~for_curve).cast("long")

    texts = ruled.where("text <> ''").select("text", *[F.coalesce(example(v), F.lit(0).cast("long")).alias(n) for v, n in (("allow", "accepted"), ("block", "rejected"))])
    scored = stage(score(texts), "scores")
    kept_back = ruled.where(F.col("ruled").isNotNull() & for_curve).select("text", "ruled").join(scored, "text")
    limit = threshold(kept_back)
    out = ruled.join(scored, "text", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by_score = F.when(F.col("score") >= limit, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_score).alias("verdict"), "score")


def threshold(kept_back: DataFrame) -> float:
    """Where the two classes of (ruled, score) are best told apart, from at most 2001 bins."""
    bin_ = F.least(F.greatest(F.floor(F.col("score") * 200), F.lit(-1000)), F.lit(1000)).alias("bin")
    rows = kept_back.groupBy(bin_).agg(*[F.sum((F.col("ruled") == v).cast("long")).alias(v) for v in ("allow", "block")]).orderBy("bin").collect()
    good, bad = sum(r["allow"] for r in rows), sum(r["block"] for r in rows)
    if not good or not bad:
        return 0.0
    best, at, lost, caught = 0.0, 0.0, 0, 0
    for r, after in zip(rows, rows[1:]):
        lost, caught = lost + r["allow"], caught + r["block"]
        if (gain := caught / bad - lost / good) > best:
            best, at = gain, (r["bin"] + 1 + after["bin"]) / 400
    return at
