"""Token ids in binary files: documents in order, Simple-8b records, read back by the same code.

A table of records is written through Spark's own writer, so that failed tasks leave nothing behind
and any shared file system will do. Each record holds consecutive documents: their ids and lengths,
and their token ids as a Simple-8b record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from almanac.llm import simple8b
from almanac.llm.batches import column_slices
from almanac.llm.packing import tokenizer_file
from almanac.llm.tokens import encoder_of
from almanac.operators.settle import scratch_path
from almanac.session import ship_package

END_ID = 2
RECORDS = "part long, record long, before long, n_ids long, docs array<{id}>, lengths array<long>, ids binary"


def write_token_files(
    docs: DataFrame, path: str, tokenizer_json: str, end_id: int = END_ID, text: str = "text", key: str = "doc_id"
) -> None:
    """Write the ids of all documents below ``path``, ascending by ``key`` (nulls first, ties by text).

    A document is the ids of its text and then ``end_id``; a null or empty text has only that.
    Documents are range-partitioned by the key; partition ``part`` writes its records in order,
    with ``before`` ids of its own before each. Other input columns take no part.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file, a few MB
    end = end_id.to_bytes(4, "little")
    kind = docs.schema[key].dataType.simpleString()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        part, before = TaskContext.get().partitionId(), 0
        for number, (rows, texts) in enumerate(column_slices(batches)):
            ids = [found + end for found in encoder.encode(texts)]
            values = np.frombuffer(b"".join(ids), dtype="<u4")
            yield pa.RecordBatch.from_arrays([
                pa.array([part]), pa.array([number]), pa.array([before]), pa.array([len(values)]),
                pa.ListArray.from_arrays([0, rows.num_rows], rows.column(0)),
                pa.array([[len(x) // 4 for x in ids]], pa.list_(pa.int64())),
                pa.array([simple8b.encode(values)], pa.binary()),
            ], names=["part", "record", "before", "n_ids", "docs", "lengths", "ids"])
            before += len(values)

    ordered = docs.select(F.col(key), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange(F.col(key).asc_nulls_first()).sortWithinPartitions(
        F.col(key).asc_nulls_first(), "text"
    )
    ordered.mapInArrow(records, RECORDS.format(id=kind)).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: ``doc_id``, ``start``, ``ids`` (little-endian unsigned 32-bit)."""
    ship_package(spark)
    records = spark.read.parquet(path)
    kind = records.schema["docs"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, docs, lengths, ids = (batch.column(k)[i] for k in range(4))
                raw = simple8b.decode(ids.as_py()).astype("<u4").tobytes()
                lengths = np.array(lengths.as_py(), dtype=np.int64)
                bounds = np.concatenate(([0], np.cumsum(lengths)))
                yield pa.RecordBatch.from_arrays([
                    docs.values, pa.array(at.as_py() + bounds[:-1]),
                    pa.array([raw[4 * a:4 * b] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                ], names=["doc_id", "start", "ids"])

    # As many rows as files were written, never as many as documents: two numbers for each partition of the
    # writer. They meet the records before these are decoded, so that no token is shuffled.
    parts = records.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    placed = records.join(F.broadcast(parts), "part")
    return placed.select((F.col("first") + F.col("before")).alias("at"), "docs", "lengths", "ids").mapInArrow(
        documents, f"doc_id {kind}, start long, ids binary"
    )


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token ids and read back."""
    path = scratch_path(spark)
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_file())
    return read_token_files(spark, path).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
