"""From raw documents to packed sequences: quality, near copies, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each as Parquet in the shared
folder and hands the written table to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from almanac.llm.decontaminate import contaminated_passages
from almanac.llm.near_copies import near_copies
from almanac.llm.packing import pack_documents, tokenizer_file
from almanac.llm.quality import quality_scores
from almanac.llm.secrets import redacted, secret_spans
from almanac.operators.settle import settle

# Near copies of the pipeline: runs of five words.
SHINGLE_WORDS = 5

_CONTENT = "_content_key"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _carried(docs: DataFrame) -> DataFrame:
    """The text, and all columns as one, so that no result of an operator can take the place of a column of the same name."""
    return docs.select(F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("_input"), F.col("text"))


def _with_text(judged: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` out of what was carried, with a new text and its length."""
    new = judged.withColumn("_text", text)
    kinds = dict(docs.dtypes)

    def column(name: str) -> Column:
        if name == "text":
            return F.col("_text")
        return F.length("_text").cast(kinds[name]) if name == "n_chars" else F.col("_input").getField(name)

    return new.select(*[column(c).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failed lines."""
    return _with_text(quality_scores(_carried(docs)).where("kept"), docs, F.col("clean_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    kept = near_copies(docs, words=SHINGLE_WORDS).where("kept").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    return named.unionByName(docs.where("doc_id is null")).dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item. The text alone decides, so rows without an id, or that share one, are judged by their own text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = docs.withColumn(_CONTENT, F.sha2(F.coalesce("text", F.lit("")), 256))
    found = contaminated_passages(marked.select(_CONTENT, "text"), items, key=_CONTENT)
    found = found.select(F.col("doc_id").alias(_CONTENT)).distinct()
    return marked.join(found, _CONTENT, "left_anti").select(*[_quoted(c) for c in docs.columns])


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret."""
    return _with_text(secret_spans(_carried(docs)), docs, redacted(F.col("text"), F.col("secrets")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids."""
    return pack_documents(docs, tokenizer_file())


STAGES = [
    ("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination),
    ("secret_removal", secret_removal), ("packing", packing),
]

# Tokens and alignments have no SQL; tests/llm/test_pipeline.py runs the stages on the smallest tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
