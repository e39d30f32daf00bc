"""URL filter: prefix rules, then the likelihood ratio of two character Markov models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_UPPER, saved

#: Verdict and rule (host, then path prefix), as the task states them.
RULES: tuple[tuple[str, str], ...] = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("block", "example.net/de/8"),
    ("allow", "net/de/"),
    ("block", "org/es/"),
)
#: Characters the models tell apart, digits as 0; anything else is one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0-._~/%^$"
ORDER = 4


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first :// up to / ? # or end, A-Z lower-cased; then up to ? # or end. Null or no ://: both empty."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "(?s)://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), ASCII_UPPER, ASCII_UPPER.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _longest_rule(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null if none."""
    rule = verdict = None
    for decision, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = text.partition("/")
        of_host = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        fits = of_host & F.col("path").startswith(f"/{path}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    none = F.lit(None).cast("string")
    return (rule, verdict) if rule is not None else (none, none)


def _grams(urls: DataFrame) -> DataFrame:
    """urls and one row for each character (and the end): gram, that character after the ORDER - 1 before it."""
    folded = F.translate(F.lower(F.concat("host", "path")), "123456789", "000000000")
    folded = F.regexp_replace(folded, "[^a-z0\\-._~/%]", "?")
    padded = F.concat(F.lit("^" * (ORDER - 1)), folded, F.lit("$"))
    spots = F.sequence(F.lit(1), F.length(padded) - (ORDER - 1))
    return urls.withColumn("padded", padded).withColumn("gram", F.explode(F.transform(spots, lambda i: F.substring(F.col("padded"), i, F.lit(ORDER)))))


def _ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log probability under the model of allowed urls less that under the model of blocked ones.

    counts: (gram, allowed, blocked). Each order is interpolated with the one below by Witten-Bell's weights; a context
    that was never seen leaves all to the order below, so the order varies with what is known.
    """
    kinds = ("allowed", "blocked")
    below = None
    for order in range(1, ORDER + 1):
        own = counts.groupBy(F.expr(f"right(gram, {order})").alias("gram")).agg(*(F.sum(k).alias(k) for k in kinds))
        own = own.withColumn("context", F.expr(f"left(gram, {order - 1})"))
        totals = own.groupBy("context").agg(*(f(k) for k in kinds for f in (lambda k: F.sum(k).alias(f"{k}_total"), lambda k: F.count_if(F.col(k) > 0).alias(f"{k}_kinds"))))
        own = own.join(totals, "context")
        if below is None:
            own = own.withColumns({f"{k}_low": F.lit(1.0 / (len(ALPHABET) + 1)) for k in kinds})
        else:
            own = own.withColumn("short", F.expr(f"right(gram, {order - 1})")).join(below, "short")
        p = {k: F.when(F.col(f"{k}_total") > 0, (F.col(k) + F.col(f"{k}_kinds") * F.col(f"{k}_low")) / (F.col(f"{k}_total") + F.col(f"{k}_kinds"))).otherwise(F.col(f"{k}_low")) for k in kinds}
        below = own.select(F.col("gram").alias("short"), *(p[k].alias(f"{k}_low") for k in kinds))
    return below.select(F.col("short").alias("gram"), (F.log("allowed_low") - F.log("blocked_low")).alias("ratio"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """The verdict on each row of pages: page_id, host, path, rule, verdict, score.

    pages needs page_id and url; extra columns are ignored. A rule decides the urls it fits, the longest first. All
    urls that rules decide train two character models, of allowed and of blocked ones; another url is allowed if its
    log-likelihood ratio per character reaches a level that is as many deviations from the mean of either kind.

    Null urls and urls without :// have an empty host and path and are judged by the model like others. Without urls
    of both kinds the model allows. Repeated rows and urls give repeated results, and count once in the models.
    """
    host, path = split_url(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, decided = _longest_rule(rules)
    urls = saved(parts.select("host", "path").distinct().withColumn("decided", decided), "urls")
    grams = _grams(urls)
    counts = saved(grams.groupBy("gram").agg(F.count_if(F.col("decided") == "allow").alias("allowed"), F.count_if(F.col("decided") == "block").alias("blocked")), "counts")
    ratios = saved(_ratios(counts), "ratios")
    scored = grams.select("host", "path", "decided", "gram").join(ratios, "gram").groupBy("host", "path", "decided").agg(F.avg("ratio").alias("score"))
    scored = saved(scored, "scored")
    fit = {r["decided"]: r for r in scored.where("decided is not null").groupBy("decided").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd")).collect()}
    level = float("-inf")
    if len(fit) == 2:
        a, b = fit["allow"], fit["block"]
        spread = a["sd"] + b["sd"]
        level = (a["mean"] * b["sd"] + b["mean"] * a["sd"]) / spread if spread else (a["mean"] + b["mean"]) / 2
    own = parts.withColumn("rule", rule).withColumn("decided", decided)
    verdict = F.coalesce(F.col("decided"), F.when(F.col("score") >= level, "allow").otherwise("block"))
    return own.join(scored.select("host", "path", "score"), ["host", "path"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
