"""URL filtering: host and path rules, and gradient-boosted trees on lexical features for all other URLs.

The trees learn from the URLs that a rule decides. Features: lengths of URL, host and path, numbers of host
labels and path segments, digit ratio, character entropy of host and of path, numbers of parameters, hyphens
and other marks, and two statistics of the host's last label: how common it is and how often rules block it.
The latter is taken out of fold: a URL that a rule decides sees the counts of other folds of URLs only, so its
own verdict is no part of its features.
Everything runs in DataFrame operations and Spark's own tree learner.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Bound of the training sample: URLs of smallest hash for each verdict.
SAMPLE = 10_000
TREES, DEPTH = 12, 4
#: The last labels of hosts are hashed into so many groups, so their statistics are a table of known size.
SUFFIXES = 1024
#: Folds of URLs by hash, for statistics that must not hold a URL's own verdict.
FOLDS = 5
MARKS = 96


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and begins the path; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    # The last one wraps all others, so the longest comes last.
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Bits per character, by counts of the first MARKS printable characters and of all others together."""
    n = F.length(text)
    each = [n - F.length(F.translate(text, chr(32 + i), "")) for i in range(MARKS) if chr(32 + i).isalnum() or chr(32 + i) in "-._~/%"]
    rest = n - sum(each[1:], each[0])
    share = lambda c: F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0)
    return F.when(n > 0, F.aggregate(F.array(*each, rest), F.lit(0.0), lambda acc, c: acc + share(c))).otherwise(0.0)


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


FEATURES = ("n_url", "n_host", "n_path", "labels", "depth", "digits", "host_entropy", "path_entropy", "parameters", "hyphens", "marks", "suffix_share", "suffix_blocked")


def lexical(df: DataFrame) -> DataFrame:
    """df (url, host, path) with the features that need no other row, and the suffix group."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    n = F.length(url).cast("double")
    return df.withColumns(
        {
            "n_url": n,
            "n_host": F.length("host").cast("double"),
            "n_path": F.length("path").cast("double"),
            "labels": F.when(F.col("host") == "", 0.0).otherwise(_count(F.col("host"), ".") + 1),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "digits": F.when(n > 0, _count(url, "0123456789") / n).otherwise(0.0),
            "host_entropy": _entropy(F.col("host")),
            "path_entropy": _entropy(F.col("path")),
            "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
            "hyphens": _count(F.col("host"), "-"),
            "marks": _count(url, "%_~=@:;,"),
            "suffix": F.pmod(F.xxhash64(F.substring_index("host", ".", -1)), F.lit(SUFFIXES)).cast("int"),
        }
    )


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE, learn: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, method_score for every row of pages (page_id, url).

    verdict is the rule's, or else that of the trees: block if their probability is 0.5 or more. Null URLs and
    those without `://` have an empty host and path and fit no rule. If the rules decide no URL, or all alike,
    there is nothing to learn: all others get the one verdict that occurs, or allow. Rows that repeat a
    page_id are judged each; an empty table gives an empty result; other columns are ignored. The trees learn
    from a bounded sample (`sample` URLs for each verdict, of smallest hash); suffix statistics use all rows.
    learn: a condition on pages; only rows that meet it may teach the trees and the statistics of verdicts (by
    default all), so the rest can be held out.
    """
    host, path = host_and_path(F.col("url"))
    taught = F.coalesce(learn, F.lit(False)) if learn is not None else F.lit(True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), taught.alias("taught")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "url", "host", "path", "taught", "found.*")
    teaches = F.col("taught") & F.col("verdict").isNotNull()
    rows = lexical(rows).withColumn("fold", F.when(teaches, F.pmod(F.xxhash64("url"), F.lit(FOLDS))).otherwise(FOLDS).cast("int"))
    stats = rows.groupBy("suffix", "fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(teaches).alias("ruled"), F.count_if(teaches & (F.col("verdict") == "block")).alias("blocked"))
    stats = materialize(stats, "urls-suffixes")  # SUFFIXES * (FOLDS + 1) rows at most
    total = stats.agg(F.sum("n"), F.sum("ruled"), F.sum("blocked")).first()
    n, ruled, blocked = (x or 0 for x in total)
    out = ["page_id", "host", "path", "rule"]
    if not 0 < blocked < ruled:
        alone = "block" if blocked else "allow"
        return rows.select(*out, F.coalesce("verdict", F.lit(alone)).alias("verdict"), F.lit(1.0 if blocked else 0.0).alias("method_score"))
    # For each suffix and fold the counts of all other folds; rows that do not teach are in a fold of their own.
    whole = stats.groupBy("suffix").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "ruled", "blocked")])
    stats = stats.join(F.broadcast(whole), "suffix")
    other = lambda c: F.col(f"all_{c}") - F.when(F.col("fold") < FOLDS, F.col(c)).otherwise(0)
    smooth = (other("blocked") + blocked / ruled) / (other("ruled") + 1)
    stats = stats.select("suffix", "fold", (F.col("all_n") / n).alias("suffix_share"), smooth.alias("suffix_blocked"))
    rows = rows.join(F.broadcast(stats), ["suffix", "fold"])
    known = rows.where(teaches).select(*FEATURES, (F.col("verdict") == "block").cast("double").alias("label"), F.xxhash64("url").alias("h"), "url", "page_id")
    picked = [known.where(F.col("label") == y).orderBy("h", "url", "page_id").limit(sample) for y in (0.0, 1.0)]
    learn = materialize(picked[0].unionByName(picked[1]).select(*FEATURES, "label"), "urls-sample")
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=3, featureSubsetStrategy="all")
    model = learner.fit(assemble.transform(learn.coalesce(2)).select("features", "label"))
    scored = model.transform(assemble.transform(rows)).withColumn("method_score", vector_to_array("probability")[1])
    own = F.when(F.col("method_score") >= 0.5, "block").otherwise("allow")
    return scored.select(*out, F.coalesce("verdict", own).alias("verdict"), "method_score")
