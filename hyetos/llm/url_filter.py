"""Operator 2: URL filters by rules, and beyond them by a ratio of character language models.

URLs that a rule decides are the examples: one variable-order Markov model is built from the allowed URLs and one from
the blocked ones. A character's probability after up to four characters is smoothed by Witten-Bell interpolation down
to a uniform distribution. The score of a URL is the difference of its two log-likelihoods, divided by its length; the
threshold is the one that best separates the examples that were held out (a fifth, by the URL's crc32).

All counts come from one table of distinct five-character strings with their counts in either set; shorter strings
are sums over it. Distinct URLs are scored once, so a URL that holds a third of all rows costs one;
its strings carry its md5, not the URL. The table of
strings is broadcast only up to `broadcast_rows` rows; beyond, it is joined by a shuffle whose hot strings Spark
splits.

Edge cases: a null URL, or one without `://`, has an empty host and path and no rule; an empty URL is judged by its end alone; without
allowed or without blocked examples the held-out threshold is 0 and the missing model is uniform; extra columns pass
through, and of columns that clash with the results the operator's values stay; repeated rows are judged alike; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hyetos.llm.common import ascii_lower, table, written

ORDER = 4
#: Characters that the uniform distribution spreads over.
ALPHABET = 256
START, END = "\u0002", "\u0003"
#: (verdict, host and path that a URL starts with)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
RESULTS = ("host", "path", "rule", "verdict", "score")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(url: Column) -> Column:
    """All strings of ORDER + 1 characters of the URL after its scheme, with boundaries."""
    body = F.lower(F.regexp_replace(url, r"(?s)^.*?://", ""))
    return F.regexp_extract_all(F.concat(F.lit(START * ORDER), body, F.lit(END)), F.lit(f"(?s)(?=(.{{{ORDER + 1}}}))"), F.lit(1))


def _ratios(counts: DataFrame) -> DataFrame:
    """gram, llr: log p(last character | the others) in the allowed model less that in the blocked one."""
    sides = ("a", "b")
    out = counts
    probs = {s: F.lit(1.0 / ALPHABET) for s in sides}
    for k in range(1, ORDER + 2):
        tail = F.substring(F.col("gram"), F.lit(-k), F.lit(k))
        ends = counts.groupBy(tail.alias("tail")).agg(*[F.sum(s).alias(s) for s in sides])
        stats = ends.groupBy(F.substring("tail", 1, k - 1).alias("context")).agg(
            *[F.sum(s).alias(f"n_{s}") for s in sides], *[F.count(F.when(F.col(s) > 0, 1)).alias(f"t_{s}") for s in sides])
        if k == 1:  # one row
            only = stats.first()
            known = ends.select("tail", *sides, *[F.lit((only[f"{x}_{s}"] if only else 0) or 0).alias(f"{x}_{s}") for x in "nt" for s in sides])
        else:
            known = ends.withColumn("context", F.substring("tail", 1, k - 1)).join(stats, "context").drop("context")
        known = known.select(F.col("tail").alias(f"tail{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("a", "b", "n_a", "n_b", "t_a", "t_b")])
        out = out.join(known, tail == known[f"tail{k}"]).drop(f"tail{k}")
        for s in sides:
            n, t, c = F.col(f"n_{s}_{k}"), F.col(f"t_{s}_{k}"), F.col(f"{s}_{k}")
            probs[s] = F.when(n > 0, (c + t * probs[s]) / F.greatest(n + t, F.lit(1))).otherwise(probs[s])
    return out.select("gram", (F.log(probs["a"]) - F.log(probs["b"])).alias("llr"))


def _threshold(scored: DataFrame) -> float:
    """The score at which held-out allowed and blocked URLs part best, from counts in 4,001 bins."""
    bins = (
        scored.filter("held and label is not null")
        .groupBy(F.greatest(F.least(F.floor(F.col("score") * 100), F.lit(2000)), F.lit(-2000)).alias("bin"))
        .agg(F.count(F.when(F.col("label") == "allow", 1)).alias("a"), F.count(F.when(F.col("label") == "block", 1)).alias("b"))
    )
    upward = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    share = lambda c: F.coalesce(F.sum(c).over(upward), F.lit(0)) / F.sum(c).over(every)
    if bins.filter("a > 0").isEmpty() or bins.filter("b > 0").isEmpty():
        return 0.0
    best = bins.select("bin", (share("b") - share("a")).alias("gain")).orderBy(F.desc("gain"), F.abs("bin"), "bin").first()
    return best["bin"] / 100


def url_verdicts(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, *, url_col: str = "url", broadcast_rows: int = 500_000,
) -> DataFrame:
    """The table with host, path, rule, verdict and score."""
    pages = pages.drop(*[c for c in RESULTS if c in pages.columns])
    url = F.coalesce(F.col(url_col), F.lit(""))
    urls = pages.select(url.alias("url")).distinct()
    urls = urls.withColumn("label", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"])
    urls = urls.withColumn("held", F.pmod(F.crc32("url"), F.lit(5)) == 0)
    # The key first: beside the explode it would be computed again for every string of the URL.
    urls = urls.select(F.md5("url").alias("key"), "label", "held", "url")
    grams = written(urls.select("key", "label", "held", F.explode(_grams(F.col("url"))).alias("gram")), "grams")
    seen = lambda v: F.count(F.when((F.col("label") == v) & ~F.col("held"), 1))
    counts = written(grams.groupBy("gram").agg(seen("allow").alias("a"), seen("block").alias("b")), "gram-counts")
    ratios = written(_ratios(counts), "ratios")
    if ratios.count() <= broadcast_rows:
        ratios = F.broadcast(ratios)
    scored = written(
        grams.join(ratios, "gram").groupBy("key", "label", "held").agg((F.sum("llr") / F.count("*")).alias("score")), "scores"
    )
    threshold = _threshold(scored)
    known = scored.select(F.col("key").alias("__key"), "score")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    fit = rule_of(F.col("host"), F.col("path"), rules)
    return (
        pages.withColumns({"host": host, "path": path})
        .join(known, F.md5(url) == known["__key"], "left").drop("__key")
        .withColumn("rule", fit["rule"])
        .withColumn("verdict", F.coalesce(fit["verdict"], F.when(F.col("score") >= threshold, "allow").otherwise("block")))
    )


def op2_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_verdicts(pages).select("page_id", "host", "path", "rule", "verdict", "score")
