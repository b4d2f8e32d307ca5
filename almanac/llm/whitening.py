"""Whitening of embeddings along the leading eigenvectors of their covariance.

The covariance is never formed: Jacobi-Davidson (``eigen``) asks for products with a few columns at a time,
and each is one pass over the distinct vectors, in which every task centres its vectors and multiplies them. The driver
only holds sums, means and eigenvectors, whose size is that of a few vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from almanac.llm.eigen import EPS, leading_eigenvectors
from almanac.operators.settle import settle
from almanac.session import ship_package

# Entries become whole numbers of this fraction.
SCALE = 256

# Components that rows are projected on.
COMPONENTS = 4

# Numbers of a block of vectors in one row of the written table.
BLOCK_NUMBERS = 1 << 18


def whole_vectors(df: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """Rows whose vector is there, has entries and none that is null, NaN or infinite; ``_x``: floor(scale * entry), long.

    Vectors of another length than most (the longest of equally frequent ones) have no place in the same space and
    go as well. Entries beyond the range of a long become its bounds.
    """
    def good(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))

    numbers = F.col(f"`{vector}`").cast("array<double>")
    rows = df.withColumn("_v", numbers).where(F.col("_v").isNotNull() & (F.size("_v") > 0) & F.forall("_v", good))
    sizes = rows.groupBy(F.size("_v").alias("size")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    rows = rows.where(F.size("_v") == (most.size if most else 0))
    whole = F.transform("_v", lambda c: F.floor(scale * c).cast("long"))
    return rows.withColumn("_x", whole).drop("_v")


class FitList:
    """The distinct vectors of a table as blocks of rows, with their number, sums and mean."""

    def __init__(self, whole: DataFrame):
        self.spark = whole.sparkSession
        ship_package(self.spark)
        self.blocks = settle(whole.select("_x").distinct().mapInArrow(_packed, "n long, size long, data binary"))
        head = self.blocks.agg(F.sum("n").alias("n"), F.max("size").alias("size")).first()
        self.n, self.size = head.n or 0, head.size or 0
        if self.n:
            self.sums = [int(v) for v in self._summed(_sums, "decimal(38,0)")]
            self.mean = np.array([_ratio(s, self.n) for s in self.sums])

    def _summed(self, part, kind: str) -> list:
        """Per slot the sum over all tasks of what ``part`` gives for a block; a few vectors of numbers."""
        size = self.size

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for x in _unpacked(batches, size):
                got = part(x)
                total = got if total is None else total + got
            if total is not None:
                slots = pa.array(np.arange(len(total)), pa.int32())
                yield pa.RecordBatch.from_arrays([slots, _column(total)], ["slot", "value"])

        # Whole numbers cross as text, since they may pass 64 bits.
        exact = kind != "double"
        rows = self.blocks.mapInArrow(add_up, f"slot int, value {'string' if exact else kind}")
        total = rows.groupBy("slot").agg(F.sum(F.col("value").cast(kind)).alias("value"))
        return [r.value for r in sorted(total.collect(), key=lambda r: r.slot)]

    def product(self, columns: np.ndarray) -> np.ndarray:
        """The covariance times a few columns: one pass over the vectors, each centred before it is multiplied."""
        mean = self.mean

        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return (centred.T @ (centred @ columns)).ravel()

        return np.array(self._summed(part, "double")).reshape(columns.shape) / self.n

    def trace(self) -> float:
        mean = self.mean
        return self._summed(lambda x: np.array([((x - mean) ** 2).sum()]), "double")[0] / self.n

    def identity_error(self, whitener: np.ndarray) -> float | None:
        """Largest absolute entry of the covariance of the whitened vectors minus the identity."""
        mean, k = self.mean, whitener.shape[1]
        if not k:
            return None

        def part(x: np.ndarray) -> np.ndarray:
            z = (x - mean) @ whitener
            return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

        got = np.array(self._summed(part, "double")) / self.n
        centre, second = got[:k], got[k:].reshape(k, k)
        return float(np.abs(second - np.outer(centre, centre) - np.eye(k)).max())


def _ratio(a: int, b: int) -> float:
    return a / b  # whole numbers of any size divide correctly rounded


def _column(values: np.ndarray) -> pa.Array:
    return pa.array([str(v) for v in values]) if values.dtype == object else pa.array(values.astype(np.float64))


def _rows_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(batch.num_rows, -1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _rows_of(batch, "_x")
        step = max(1, BLOCK_NUMBERS // x.shape[1])
        for i in range(0, len(x), step):
            part = x[i : i + step]
            # Little-endian, in the narrowest type that holds the block.
            kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= part.min() and part.max() <= np.iinfo(k).max)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(part)], pa.int64()), pa.array([x.shape[1]], pa.int64()),
                 pa.array([part.astype(kind).tobytes()], pa.binary())], ["n", "size", "data"]
            )


def _unpacked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for n, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            yield np.frombuffer(data, dtype=f"<i{len(data) // (n * size)}").astype(np.int64).reshape(n, size)


def _sums(x: np.ndarray) -> np.ndarray:
    largest = max(abs(int(x.min())), abs(int(x.max())))
    exact = x if largest * len(x) < 2**62 else x.astype(object)
    return exact.sum(axis=0).astype(object)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - S)^2, exact; None where it does not fit into 64 bits."""
    largest = n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(s) for s in sums)
    if x.shape[1] * largest**2 < 2**63:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def whitened_embeddings(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """Project every vector on the leading components of the covariance, each to variance one.

    Rows whose vector is null, empty, of another length than most, or holds null or non-finite entries are dropped;
    the others become whole numbers (``whole_vectors``). The fit counts each distinct vector once; every
    row gets its result, repeated rows and rows without an id too. Columns: the key, ``component`` from 1 on by falling variance (at most
    ``components`` and the length of the vectors), ``n`` (vectors of the fit), ``deviation`` (sum over dimensions of
    (n * x - S)^2, exact; null where it does not fit into a long), ``whitened``, ``explained`` (share of the total variance) and
    ``identity_error``. A component without variance has a null ``whitened`` and, with no variance at all, a null
    ``explained``. Other columns have no part in it. A table without usable vectors gives no rows.
    """
    kind = df.schema[key].dataType
    rows = whole_vectors(df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{vector}`").alias("_vector")), "_vector", scale)
    out = T.StructType([
        T.StructField("_key", kind), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.ArrayType(T.DoubleType())),
    ])
    fit = FitList(rows)
    if not fit.n:
        values, error, explained = [], None, []
        done = rows.sparkSession.createDataFrame([], out)
    else:
        values, vectors = leading_eigenvectors(fit.product, fit.size, components)
        trace = fit.trace()
        spread = values > fit.size * EPS * max(values[0], 0.0)
        whitener = vectors[:, spread] / np.sqrt(values[spread])
        error = fit.identity_error(whitener)
        explained = [float(v) / trace if trace > 0 else None for v in values]
        done = rows.select("_key", "_x").mapInArrow(_projector(fit, whitener, int((~spread).sum())), out)
    share = F.array(*[F.lit(v).cast("double") for v in explained]) if explained else F.lit(None).cast("array<double>")
    placed = done.select("_key", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return placed.select(
        F.col("_key").alias(key), (F.col("_at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(share, F.col("_at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def _projector(fit: FitList, whitener: np.ndarray, empty: int):
    n, sums, mean = fit.n, fit.sums, fit.mean

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows_of(batch, "_x")
            z = (x - mean) @ whitener
            rows = [[*row, *[None] * empty] for row in z.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_deviations(x, n, sums), pa.int64()), pa.array(rows, pa.list_(pa.float64()))],
                ["_key", "deviation", "whitened"],
            )

    return project


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on four components."""
    return whitened_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
