"""URL filters: rules first, and gradient-boosted trees on lexical features beyond.

The trees are trained on the URLs that a rule decides. Features are built from
DataFrame functions: lengths, path depth, share of digits, entropy of the
characters, counts of parameters, and how often the ruled URLs with the same host
suffix, all of them, are blocked.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import with_small
from tidemark.session import materialised

#: (host, path, verdict); a rule is written as host and path together.
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
TRAIN_ROWS = 20_000
TREES = 20
DEPTH = 4
FEATURES = ("n_url", "n_host", "n_path", "depth", "digit_share", "entropy", "n_params", "n_labels", "n_hyphens", "suffix_blocked", "suffix_known")


def _parts(url: Column) -> dict[str, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return {"host": F.coalesce(lower, F.lit("")), "path": F.coalesce(path, F.lit(""))}


def rule_of(rules: tuple = RULES) -> Column:
    """The longest rule that fits columns host and path, as (rule, verdict); null if none."""
    chosen = None
    for host, path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen


def _features() -> dict[str, Column]:
    """Lexical features of columns url, host and path; null URLs count as empty."""
    url = F.coalesce("url", F.lit(""))
    size = F.length(url)
    query = F.regexp_extract(url, "[?]([^#]*)", 1)
    letters = F.filter(F.array_distinct(F.split(url, "")), lambda c: c != "")
    share = lambda c: (size - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(letters, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
    return {
        "n_url": size, "n_host": F.length("host"), "n_path": F.length("path"),
        "depth": F.regexp_count(F.col("path"), F.lit("/")),
        "digit_share": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(size, F.lit(1)),
        "entropy": F.coalesce(entropy, F.lit(0.0)),
        "n_params": F.when(query == "", 0).otherwise(1 + F.regexp_count(query, F.lit("&"))),
        "n_labels": F.regexp_count(F.col("host"), F.lit("[.]")),
        "n_hyphens": F.regexp_count(F.col("host"), F.lit("-")),
    }


def judge_urls(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``.

    The longest fitting rule decides; where none fits, the trees do, fitted on
    at most about ``TRAIN_ROWS`` ruled URLs drawn by a hash of page and URL.
    Where rules leave one verdict only, it is the method's; without any, URLs
    are allowed. Null URLs, and those without ``://``, have an empty host and
    path. Repeated rows are judged alike; extra columns are left out; an empty
    table gives an empty result.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.withColumns(_parts(F.col("url"))).withColumn("by_rule", rule_of(rules))
    suffix = F.element_at(F.split("host", "[.]"), -1)
    rows = rows.withColumns(_features() | {"suffix": suffix})
    rows = materialised(rows, "urls")
    ruled = rows.filter("by_rule IS NOT NULL").withColumn("blocked", (F.col("by_rule.verdict") == "block").cast("double"))
    total = ruled.count()
    drawn = F.pmod(F.xxhash64("page_id", "url"), F.lit(1_000_000)) < int(min(1.0, TRAIN_ROWS / max(total, 1)) * 1_000_000)
    train = materialised(ruled.filter(drawn), "ruled_urls")
    stats = materialised(ruled.groupBy("suffix").agg(F.avg("blocked").alias("suffix_blocked"), F.log1p(F.count(F.lit(1))).alias("suffix_known")), "suffixes")
    verdicts = [r[0] for r in train.select("by_rule.verdict").distinct().collect()]

    def assembled(df: DataFrame) -> DataFrame:
        df = with_small(df, stats, ["suffix"], "left").fillna(0.0, ["suffix_blocked", "suffix_known"])
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)

    if len(verdicts) == 2:
        trees = GBTClassifier(labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, seed=7, subsamplingRate=1.0, cacheNodeIds=False)
        judged = trees.fit(assembled(train).select("features", "blocked").coalesce(4)).transform(assembled(rows))
        own = F.when(vector_to_array("probability")[1] >= 0.5, "block").otherwise("allow")
    else:
        judged, own = rows, F.lit(verdicts[0] if verdicts else "allow")
    return judged.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce(F.col("by_rule.verdict"), own).alias("verdict"))
