"""Mixing sources to target weights: each source gives its share of the words, cut at the exact word.

Documents get a key by a hash of their id and text. One sort by source and key puts those of a source
into a random order; a distributed prefix sum of their sizes says which of them a budget reaches. A source
whose budget is larger than itself is read in whole epochs first.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from almanac.llm.columns import SPACES, beside
from almanac.llm.quality import words_of
from almanac.operators.joins import null_safe_join
from almanac.operators.numbering import row_numbers, running_before
from almanac.operators.settle import settle

# Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)

# Largest number of epochs of a source.
MOST_EPOCHS = 3

_EXACT = "decimal(38,0)"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Share the total size among the sources by weight, none above ``most_epochs`` times its size.

    Takes one row per source: ``source`` and ``source_size``. The sources weigh ``weights`` in the order of their
    names (null last), repeating. What a full source leaves is shared by weight among the others, until none
    is above: with the sources in the order of limit by weight, those before one place are full and the others
    share the rest, which prefix sums of limits and weights find at once. Adds ``target`` (double) and
    ``budget`` (the target rounded half up, long). All comparisons are exact.
    """
    each = lcm(*weights)
    numbered = row_numbers(sizes, [], [F.col("source").isNull(), "source"], "_place")
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int")
    ).cast("long")
    limits = numbered.select(
        "source", "source_size", "_place", weight.alias("_weight"), (most_epochs * F.col("source_size")).alias("_limit")
    ).withColumn("_filled_at", F.col("_limit").cast(_EXACT) * (F.lit(each) / F.col("_weight")).cast("long"))
    order = ["_filled_at", "_place"]
    ranked = settle(running_before(
        limits, [], {"_limits_before": (order, F.col("_limit")), "_weights_before": (order, F.col("_weight"))}
    ))
    total = ranked.agg(F.sum("source_size").alias("size"), F.sum("_weight").alias("weight")).first()
    if total.size is None:
        return sizes.select("source", "source_size", F.lit(None).cast("double").alias("target"),
                            F.lit(None).cast("long").alias("budget"))
    left = F.lit(total.size) - F.col("_limits_before")
    sharing = F.lit(total.weight) - F.col("_weights_before")
    open_ = left.cast(_EXACT) * F.col("_weight") <= F.col("_limit").cast(_EXACT) * sharing
    # The first source that is not filled says what is shared; there is one unless all sources are full.
    first = ranked.where(open_).orderBy(*order).select(left.alias("left"), sharing.alias("sharing")).first()
    # A literal of a Python number is an int where it fits, which its multiples need not.
    left, sharing = (F.lit(n).cast("long") for n in ((first.left, first.sharing) if first else (0, 1)))
    full = (
        F.lit(True) if first is None
        else F.col("_limit").cast(_EXACT) * sharing < left.cast(_EXACT) * F.col("_weight")
    )
    share = left.cast("double") * F.col("_weight") / sharing
    # Rounded half up in whole numbers.
    shares = ranked.withColumns({"_left": 2 * left.cast(_EXACT), "_sharing": sharing})
    rounded = F.expr("(_left * _weight + _sharing) div (2 * _sharing)")
    return shares.select(
        "source", "source_size",
        F.when(full, F.col("_limit").cast("double")).otherwise(share).alias("target"),
        F.when(full, F.col("_limit")).otherwise(rounded).alias("budget"),
    )


def random_key(key: Column, text: Column, seed: str = "") -> Column:
    """A place in the random order that depends on the id, the text and the seed only, so that reruns agree."""
    return F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"), F.md5(F.coalesce(text, F.lit("")))))


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = "",
    text: str = "text", key: str = "doc_id", source: str = "source",
) -> DataFrame:
    """How many words of each document the mix takes.

    Columns: ``doc_id``, ``source``, ``size`` (words: runs of characters other than space and U+0009 to
    U+000D; 0 for a null text), ``source_size``, ``target`` and ``taken``. Each source's words add up to its
    target, rounded half up: whole epochs of all its documents first, then documents in the order of the
    random key, the last of them in part. Rows without a source are a source of their own, last in the order.
    Repeated rows each count; rows equal in source, key and text are alike, so their order does not matter.
    Other columns of the input have no part in it, whatever their names; an empty table gives no rows.
    """
    sized = settle(docs.select(
        F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.size(words_of(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("size"),
        random_key(F.col(key), F.col(text), seed).alias("_random"),
    ))
    sizes = settle(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = settle(source_targets(sizes, weights, most_epochs))
    placed = running_before(sized, ["source"], {"_before": (["_random", "size"], F.col("size"))})
    out = null_safe_join(placed, targets, ["source"])
    epochs = F.coalesce(F.expr("budget div nullif(source_size, 0)"), F.lit(0))
    rest = F.col("budget") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")
    )


def repeated_texts(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The texts of a mix: documents with ``size`` and ``taken`` (see ``mixed_documents``), one row per epoch.

    Adds ``epoch`` from 1 on. An epoch that takes a document whole has its text as it is, one that takes
    a part has its first words, joined by spaces. Documents that give nothing have no row.
    """
    times = F.expr("cast((taken + size - 1) div size as int)")
    rows = mixed.where("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), times)))
    words = (F.col("taken") - (F.col("epoch") - 1) * F.col("size")).cast("int")
    start = F.array_join(F.slice(words_of(F.col(text)), F.lit(1), words), " ")
    return beside(rows, {text: F.when(words < F.col("size"), start).otherwise(F.col(text))})


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents with weights 5, 2, 1 and at most three epochs of a source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixed_documents(docs).select("doc_id", "size", "source_size", "target", "taken")


OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, source, md5(concat_ws(':', '', doc_id::VARCHAR, md5(coalesce(text, '')))) AS h,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [{", ".join(map(str, WEIGHTS))}][(place - 1) % {len(WEIGHTS)} + 1] AS weight, {MOST_EPOCHS} * source_size AS lim
  FROM (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM s)
), r AS (
  SELECT *,
    sum(source_size) OVER () - coalesce(sum(lim) OVER before, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS sharing
  FROM w WINDOW before AS (ORDER BY lim * ({lcm(*WEIGHTS)} // weight), place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT rest AS l, sharing AS n FROM r WHERE rest * weight <= lim * sharing
  ORDER BY lim * ({lcm(*WEIGHTS)} // weight), place LIMIT 1
), g AS (
  SELECT source, source_size,
    CASE WHEN lim * n < l * weight THEN lim::DOUBLE ELSE l::DOUBLE * weight / n END AS target,
    CASE WHEN lim * n < l * weight THEN lim ELSE (2 * l * weight + n) // (2 * n) END AS budget
  FROM r, f
), p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM d
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE
    budget // source_size * size + greatest(0, least(size, budget % source_size - earlier)) END)::BIGINT AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source"""
