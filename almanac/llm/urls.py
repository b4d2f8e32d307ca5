"""URL filters: rules for hosts and paths, and boosted trees on lexical features for what no rule decides."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from almanac.llm.columns import beside, let, lower_ascii

# Fixed values of the query: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# Host words by which a URL is labelled as blocked where no rule labels it.
BLOCKED_WORDS = ("adult", "bets", "casino", "porn", "pills", "ads-", "track")

# Bounds of the fit: labelled URLs of each label, trees and their depth.
SAMPLE_PER_LABEL = 10_000
TREES, DEPTH = 10, 4

# Weight of the overall share in the share of a suffix, in URLs.
PRIOR = 20

FEATURES = (
    "length", "host_length", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "n_hyphens", "has_fragment", "suffix_share",
)


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, "(?s)\\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without a host."""
    return F.coalesce(F.regexp_extract(url, "(?s)\\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdict(host: Column, path: Column, rules) -> Column:
    """``rule`` and ``verdict`` of the longest rule that fits, as a struct; null without one.

    A rule fits its host and all hosts below it, where the path starts with its path.
    """
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    fits = F.array(*fits).cast("array<struct<n:int,rule:string,verdict:string>>")
    return F.array_max(F.array_compact(fits))


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text)
    return F.coalesce(F.aggregate(
        F.array_distinct(F.split(text, "")), F.lit(0.0),
        lambda sum_, c: sum_ - let(
            (n - F.length(F.replace(text, c, F.lit("")))) / n, lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0)
        ),
    ), F.lit(0.0))


def lexical_features(df: DataFrame, url: str, host: str) -> DataFrame:
    """Add the features of ``FEATURES`` that follow from the URL alone, and ``suffix``, the host's last label."""
    text = F.coalesce(F.col(url), F.lit(""))
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    query = F.regexp_extract(text, "(?s)\\?([^#]*)", 1)
    return beside(df, {
        "length": F.length(text).cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": F.size(F.array_remove(F.split(path_of(text), "/"), "")).cast("double"),
        "digit_ratio": F.coalesce(F.try_divide(digits, F.length(text)), F.lit(0.0)),
        "entropy": F.when(F.length(text) > 0, _entropy(text)).otherwise(0.0),
        "n_params": F.size(F.array_remove(F.split(query, "[&;]"), "")).cast("double"),
        "n_labels": F.size(F.array_remove(F.split(F.col(host), "\\."), "")).cast("double"),
        "n_hyphens": (F.length(host) - F.length(F.replace(F.col(host), F.lit("-"), F.lit("")))).cast("double"),
        "has_fragment": F.contains(text, F.lit("#")).cast("double"),
        "suffix": F.substring_index(F.col(host), ".", -1),
    })


def url_verdicts(
    pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, url: str = "url",
    sample_per_label: int = SAMPLE_PER_LABEL, trees: int = TREES, depth: int = DEPTH,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` (``allow`` or ``block``) and ``block_score`` to each page.

    A rule decides where one fits (``block_score`` null). Elsewhere boosted trees do, fitted on
    ``labelled`` (``url``, ``blocked`` 0 or 1); without it the URLs that a rule decides are the
    labelled ones, and those whose host has one of ``BLOCKED_WORDS``. The fit takes at most
    ``sample_per_label`` URLs of each label, those with the least hash; the shares of blocked URLs
    by suffix count all labelled ones. With labels of one kind only, that kind is the verdict; with
    none, ``allow``. A null or malformed URL has an empty host and path and is judged alike. Every row
    gives one row; input columns named like a result give way.
    """
    known = beside(pages, {"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    known = beside(known, {"_llm_rule": rule_verdict(F.col("host"), F.col("path"), rules)})
    if labelled is None:
        word = reduce(lambda a, b: a | b, [F.contains("host", F.lit(w)) for w in BLOCKED_WORDS])
        labelled = known.select(
            F.col(url).alias("url"), "host",
            F.coalesce((F.col("_llm_rule.verdict") == "block").cast("int"), F.when(word, 1)).alias("blocked"),
        ).where(F.col("blocked").isNotNull() & F.col("url").isNotNull())
    else:
        labelled = labelled.select("url", host_of(F.col("url")).alias("host"), F.col("blocked").cast("int").alias("blocked"))
        labelled = labelled.where(F.col("blocked").isNotNull() & F.col("url").isNotNull())

    shares = labelled.groupBy(F.substring_index("host", ".", -1).alias("suffix")).agg(
        F.sum("blocked").alias("b"), F.count("*").alias("n")
    )
    total = shares.agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect()[0]  # one row
    if not total.n or total.b in (0, total.n):
        only = "block" if total.n and total.b else "allow"
        return _decided(known, F.lit(only), F.lit(None).cast("double"))
    overall = total.b / total.n
    shares = shares.select("suffix", ((F.col("b") + PRIOR * overall) / (F.col("n") + PRIOR)).alias("_llm_share"))

    def with_features(df: DataFrame, address: str) -> DataFrame:
        out = lexical_features(df, address, "host").join(shares, "suffix", "left")
        return beside(out, {"suffix_share": F.coalesce("_llm_share", F.lit(overall))}).drop("_llm_share", "suffix")

    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_llm_features")
    sample = reduce(DataFrame.unionByName, [
        labelled.where(F.col("blocked") == b).withColumn("h", F.xxhash64("url")).orderBy("h", "url").limit(sample_per_label)
        for b in (0, 1)
    ])
    sample = assembler.transform(with_features(sample, "url")).select("_llm_features", F.col("blocked").cast("double"))
    model = GBTClassifier(
        featuresCol="_llm_features", labelCol="blocked", maxIter=trees, maxDepth=depth, seed=1,
    ).fit(sample)
    # Features and the model's columns stand apart from the page's own ones in a struct.
    packed = known.select(F.struct("*").alias("_llm_page"), "host", F.col(url).alias("_llm_url"))
    scored = model.transform(assembler.transform(with_features(packed, "_llm_url")))
    judged = scored.select("_llm_page.*", F.get(vector_to_array("probability"), F.lit(1)).alias("_llm_score"))
    return _decided(judged, F.when(F.col("_llm_score") >= 0.5, "block").otherwise("allow"), F.col("_llm_score")).drop("_llm_score")


def _decided(known: DataFrame, otherwise: Column, score: Column) -> DataFrame:
    rule = F.col("_llm_rule")
    return beside(known, {
        "rule": rule["rule"], "verdict": F.coalesce(rule["verdict"], otherwise),
        "block_score": F.when(rule.isNull(), score),
    }).drop("_llm_rule")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_verdicts(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")
