"""URL filter: rules first, then a character language-model ratio.

Urls that a rule decides train two smoothed Markov models of variable order, one of allowed and
one of blocked urls. A symbol's probability after a context of three symbols is interpolated
with that after two, one and none (Witten and Bell's weights), so that a context counts for as
much as has been seen of it. A url without a rule gets the difference of its two
log-likelihoods for each symbol; the difference is calibrated by the normal distributions it has
on a fifth of the ruled urls, kept out of the counts.

Everything is DataFrame functions. All tables of the model have at most ``ALPHABET ** 4`` rows,
about 3.1 million, however many urls there are; that proven bound is why the table of weights is
broadcast. Counts take in every row with a rule outside that fifth. If a kind has no url in the
fifth or none outside it, nothing is kept out: all ruled rows are counted and the difference of
the log-likelihoods is taken as it is. The four sums of the counts and the six of the calibration
are all that reaches the driver.

A null url counts as empty: no host, path or rule, and a model verdict like any other. Equal
urls get equal verdicts; repeated rows are returned as often as they come. Without ruled urls of
both kinds everything else is allowed. Other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import stored, table

#: (verdict, host, path); the longest that fits wins.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
CONTEXT = 3
#: Letters, one digit, a dozen marks, one symbol for all else, start and end.
MARKS = "./:?=&#_%-+@"
ALPHABET = 26 + 1 + len(MARKS) + 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, its_host, its_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith(its_path)
        rule = F.when(fits, its_host + its_path).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _grams(url: Column) -> Column:
    """Every symbol of a url with the three before it."""
    plain = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    plain = F.regexp_replace(F.regexp_replace(plain, "[0-9]", "0"), r"[^a-z0./:?=&#_%\-+@]", "~")
    padded = F.concat(F.lit("^" * CONTEXT), plain, F.lit("$"))
    return F.transform(
        F.sequence(F.lit(1), F.length(padded) - CONTEXT), lambda i: F.substring(padded, i, F.lit(CONTEXT + 1))
    )


def _weights(counts: DataFrame) -> DataFrame:
    """``gram, weight``: log-probability of the last symbol if allowed, less that if blocked.

    ``counts`` has ``gram, allow, block`` for every gram to be scored, seen in training or not.
    """
    model = counts
    kinds = ("allow", "block")
    for order in range(CONTEXT + 1):  # the order is the number of symbols before
        gram = F.substring("gram", CONTEXT + 1 - order, order + 1)
        seen = counts.groupBy(gram.alias("g")).agg(*(F.sum(k).alias(k) for k in kinds))
        context = seen.groupBy(F.substring("g", 1, order).alias("c")).agg(
            *(F.sum(k).alias(f"{k}_n{order}") for k in kinds),
            *(F.sum((F.col(k) > 0).cast("long")).alias(f"{k}_t{order}") for k in kinds),
        )
        seen = seen.withColumn("c", F.substring("g", 1, order)).join(context, "c").drop("c")
        seen = seen.withColumnsRenamed({k: f"{k}_{order}" for k in kinds} | {"g": f"g{order}"})
        model = model.withColumn(f"g{order}", gram).join(seen, f"g{order}")
    logs = []
    for k in kinds:
        p = F.lit(1.0 / ALPHABET)
        for order in range(CONTEXT + 1):
            n, t = F.col(f"{k}_n{order}"), F.col(f"{k}_t{order}")
            p = F.when(n > 0, (F.col(f"{k}_{order}") + t * p) / (n + t)).otherwise(p)
        logs.append(F.log(p))
    return model.select("gram", (logs[0] - logs[1]).alias("weight"))


def _calibration(scores: DataFrame) -> tuple[float, float]:
    """Slope and offset that make a score a log-odds of being allowed."""
    kept = scores.filter(F.col("calibrates") & F.col("verdict").isNotNull()).groupBy("verdict").agg(
        F.count("score").alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") ** 2).alias("q")
    )
    sums = {r["verdict"]: r for r in kept.collect()}  # two rows
    if set(sums) != {"allow", "block"}:
        return 0.0, 0.0
    a, b = sums["allow"], sums["block"]
    mean_a, mean_b = a["s"] / a["n"], b["s"] / b["n"]
    spread = a["q"] - a["n"] * mean_a**2 + b["q"] - b["n"] * mean_b**2
    spread = max(spread / (a["n"] + b["n"]), 1e-6)
    slope = max((mean_a - mean_b) / spread, 0.0)
    return slope, math.log(a["n"] / b["n"]) - slope * (mean_a + mean_b) / 2


def filter_urls(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, score`` (probability of being allowed) of every row."""
    host, path = host_and_path(F.col("url"))
    placed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = placed.withColumns({"rule": rule, "verdict": verdict})
    calibrates = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    kinds = {"allow": ("allow", ~calibrates), "block": ("block", ~calibrates),
             "allow_kept": ("allow", calibrates), "block_kept": ("block", calibrates)}
    counted = ruled.select(
        F.explode(_grams(F.col("url"))).alias("gram"),
        *((F.coalesce((F.col("verdict") == k) & part, F.lit(False))).cast("long").alias(name)
          for name, (k, part) in kinds.items()),
    )
    counts = stored(counted.groupBy("gram").agg(*(F.sum(name).alias(name) for name in kinds)), "grams")
    sums = counts.agg(*(F.sum(name).alias(name) for name in kinds)).first()
    both = all(sums[k] or sums[f"{k}_kept"] for k in ("allow", "block"))
    apart = all(sums[name] for name in kinds)
    if both and not apart:
        counts = counts.select("gram", *((F.col(k) + F.col(f"{k}_kept")).alias(k) for k in ("allow", "block")))
    counts = counts.select("gram", "allow", "block")
    weights = stored(_weights(counts), "weights")

    # Equal urls are scored once; null counts as empty.
    keyed = ruled.withColumn("key", F.coalesce("url", F.lit("")))
    distinct = keyed.select("key", "verdict", calibrates.alias("calibrates")).distinct()
    symbols = distinct.select("*", F.explode(_grams(F.col("key"))).alias("gram"))
    scores = stored(
        symbols.join(F.broadcast(weights), "gram").groupBy("key", "verdict", "calibrates").agg(
            F.avg("weight").alias("score")
        ), "url-scores",
    )
    slope, offset = (1.0, 0.0) if both and not apart else _calibration(scores)
    odds = F.round(F.lit(offset) + F.lit(slope) * F.col("score"), 9)
    judged = scores.groupBy("key").agg(F.max(1 / (1 + F.exp(-odds))).alias("score"))
    return keyed.join(judged, "key", "left").select(
        "page_id", "url", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("score") >= 0.5, "allow").otherwise("block")).alias("verdict"), "score",
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
