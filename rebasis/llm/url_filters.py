"""URL filters: host and path rules first, gradient-boosted trees for the rest.

A rule names a host and a path prefix; it fits the host and all its subdomains,
and the longest rule wins. Rules are a table: a url's host suffixes meet the
rules' hosts in an equi-join, so long lists work too.

The trees learn from the urls that rules decide, on lexical features only: lengths,
path depth, digit ratio, character entropy, numbers of parameters, host labels and hyphens,
and statistics of the host's last two labels over all urls (how many there are, the
smoothed share of blocked ones among those with a label). Training is Spark ML's, over all labelled rows.

A null url, or one without ``://``, has an empty host and path; features are those of an empty url.
If the rules decide no url, or give one verdict only, the trees cannot be
trained and the rest gets that verdict, or ``allow``. Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebasis.llm.common import let, small, stored

FEATURES = ["url_length", "host_length", "depth", "digits", "entropy", "parameters", "labels", "hyphens",
            "fragment", "suffix_urls", "suffix_blocked"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(urls: DataFrame) -> DataFrame:
    """``urls`` with ``host`` and ``path``, both empty for null or no ``://``."""
    rest = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://(.*)$", 1)
    rows = urls.withColumn("rest", rest)
    return rows.withColumns({
        "host": F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), UPPER, LOWER),
        "path": F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1),
    }).drop("rest")


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct host and path pairs that a rule fits."""
    pairs = urls.select("host", "path").where(F.col("host") != "").distinct()
    labels = F.split("host", r"\.")
    suffixes = let(labels, lambda p: F.transform(
        F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))
    named = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "verdict")
    fits = pairs.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix")).join(
        small(named, named.count()), "suffix").where(F.expr("startswith(path, prefix)"))
    rule = F.concat("suffix", "prefix")
    return fits.select("host", "path", rule.alias("rule"), "verdict").groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best")
    ).select("host", "path", "best.rule", "best.verdict")


def entropy(text: Column) -> Column:
    """Bits per character."""
    kinds = F.array_distinct(F.split(text, ""))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
    return F.when(F.length(text) > 0, F.aggregate(
        F.transform(F.filter(kinds, lambda c: c != ""), share), F.lit(0.0),
        lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (with host and path) with the features of each url alone, and its host suffix."""
    url = F.coalesce("url", F.lit(""))
    after = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return urls.withColumns({
        "url_length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
        "digits": F.when(F.length(url) > 0, F.length(F.regexp_replace(url, "[^0-9]+", "")) / F.length(url)).otherwise(0.0),
        "entropy": entropy(url),
        "parameters": F.size(F.filter(F.split(after, "&"), lambda s: s != "")).cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"),
        "hyphens": F.length(F.regexp_replace("host", "[^-]+", "")).cast("double"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "suffix": F.substring_index("host", ".", -2),
    })


def judged(pages: DataFrame, rules: DataFrame, iterations: int = 12, depth: int = 3) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` of every row."""
    urls = parts(pages.select("page_id", "url"))
    fits = ruled(urls, rules).select(F.col("host").alias("h"), F.col("path").alias("p"), "rule", "verdict")
    rows = stored(
        lexical(urls).join(fits, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").drop("h", "p", "url"),
        "urls")
    label = F.when(F.col("verdict").isNotNull(), (F.col("verdict") == "block").cast("double"))
    stats = rows.groupBy("suffix").agg(
        F.log1p(F.count("*")).alias("suffix_urls"),
        ((F.sum(F.coalesce(label, F.lit(0.0))) + 1) / (F.count(label) + 2)).alias("suffix_blocked"))
    stats = stored(stats, "suffixes")
    full = rows.join(small(stats, stats.count()), "suffix")
    seen = [r.verdict for r in rows.select("verdict").where("verdict is not null").distinct().collect()]
    if len(seen) < 2:
        score = F.lit(float(seen == ["block"]))
        out = full.withColumn("block_score", score)
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(full)
        known = vectors.where(label.isNotNull()).select("features", label.alias("label"))
        trees = GBTClassifier(maxIter=iterations, maxDepth=depth, stepSize=0.3, seed=42, cacheNodeIds=False)
        out = trees.fit(known).transform(vectors).withColumn("block_score", vector_to_array("probability")[1])
    fallback = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", fallback).alias("verdict"), "block_score")
