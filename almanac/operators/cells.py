"""Nearest neighbours among wide vectors: a tree of cells, a stated number of cells searched per row.

Bounds by the triangle inequality tell nothing in many dimensions, so the exact search of ``neighbors`` ends up comparing all
rows. Here every cell of more than ``cell_rows`` vectors is divided around centres that a bounded sample of it
gives, level by level; each row then follows its ``probes`` best cells down the tree and is compared in full with the
vectors of the last ones. What is shuffled grows with rows x probes x levels. Neighbours in other cells are missed: the
result is exact while ``probes`` reaches all cells, and its recall is to be measured otherwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from almanac.operators.keys import first_n
from almanac.operators.neighbors import BLOCK_ROWS, _closest, _distances, distinct_vectors, neighbors_of_rows
from almanac.operators.settle import settle
from almanac.session import ship_package

# Most children of a cell, and sampled vectors per child that its centres are fitted on.
FAN = 64
SAMPLE_PER_CHILD = 48

# Cells that each row searches.
PROBES = 16

_ROUNDS = 6


def knn_neighbors_in_cells(
    df: DataFrame, id_col: str, features: list[str], k: int, cell_rows: int = BLOCK_ROWS, probes: int = PROBES, fan: int = FAN
) -> DataFrame:
    """The ``k`` nearest other rows of each row among those of its ``probes`` best cells, ties by id.

    Arguments and columns are those of ``knn_neighbors``; distances are exact. A cell is divided into at most ``fan``
    children while it holds more than ``cell_rows`` distinct vectors. A row whose cells hold fewer than ``k``
    others has fewer neighbours.
    """
    ship_package(df.sparkSession)
    rows, vectors = distinct_vectors(df, id_col, features, k)
    vectors = vectors.select(F.element_at("ids", 1).alias("vector"), "v", "ids")
    id_type = vectors.schema["vector"].dataType.simpleString()
    cells, levels = _divided(vectors, id_type, cell_rows, fan)
    visits = _visits(vectors.select("vector", "v"), levels, id_type, probes)
    found = _searched(cells, visits, id_type, k)
    return neighbors_of_rows(rows, vectors.select("v", "ids"), found, id_col, k)


def _shares(sizes: DataFrame) -> DataFrame:
    """Per cell the number of tasks its rows are dealt to."""
    return sizes.select("cell", F.ceil(F.col("n") / BLOCK_ROWS).cast("long").alias("shares"))


def _divided(vectors: DataFrame, id_type: str, cell_rows: int, fan: int) -> tuple[DataFrame, list[DataFrame]]:
    """The cell of every vector (``vector``, ``v``, ``ids``, ``cell``), and the centres of the children, level by level."""
    open_ = settle(vectors.withColumn("cell", F.lit(0).cast("long")))
    done, levels = [], []
    while True:
        sizes = settle(open_.groupBy("cell").agg(F.count("*").alias("n")))
        large = sizes.where(F.col("n") > cell_rows)
        if large.isEmpty():
            done.append(open_)
            break
        done.append(open_.join(large, "cell", "left_anti"))
        open_ = open_.join(large, "cell", "left_semi")
        children = F.least(F.lit(fan), F.ceil(4 * F.col("n") / cell_rows)).cast("int")
        sample = first_n(
            open_.join(large.select("cell", children.alias("children")), "cell"), ["cell"], [F.xxhash64("vector"), F.col("vector")],
            fan * SAMPLE_PER_CHILD,
        ).select("cell", "children", "v")
        centres = settle(sample.groupBy("cell").applyInPandas(_centres(fan), "cell long, child long, centre array<double>"))
        levels.append(centres)
        open_ = settle(_routed(open_, centres, _shares(large), f"vector {id_type}, v array<double>, ids array<{id_type}>", 1)
                       .select("vector", "v", "ids", F.col("child").alias("cell")))
    cells = done[0]
    for part in done[1:]:
        cells = cells.unionByName(part)
    return settle(cells), levels


def _centres(fan: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        sample = np.stack(pdf["v"].to_numpy())
        n = max(2, min(int(pdf["children"].iloc[0]), len(sample)))
        start = sample[np.linspace(0, len(sample) - 1, n).astype(int)]  # the sample is in the order of a hash
        centres = start
        for _ in range(_ROUNDS):
            nearest = _distances(sample, centres).argmin(axis=1)
            used = np.unique(nearest)
            centres = np.stack([sample[nearest == j].mean(axis=0) for j in used])
        if len(np.unique(_distances(sample, centres).argmin(axis=1))) < 2:
            centres = start  # distinct vectors of the sample always divide it
        # The children of a cell in a tree with ``fan`` of each.
        child = int(pdf["cell"].iloc[0]) * fan + 1 + np.arange(len(centres))
        return pd.DataFrame({"cell": pdf["cell"].iloc[0], "child": child, "centre": list(centres)})

    return fit


def _routed(rows: DataFrame, centres: DataFrame, shares: DataFrame, schema: str, best: int) -> DataFrame:
    """The ``best`` children of its cell for each row, with the distance to their centres; large cells take several tasks."""
    dealt = rows.join(shares, "cell").withColumn("share", F.pmod(F.xxhash64("vector"), "shares")).drop("shares")
    sent = centres.join(shares, "cell").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")

    def route(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        kept = part.drop(columns=["cell", "share"])
        if not len(part):
            return kept.assign(child=pd.Series(dtype="int64"), d=pd.Series(dtype="float64"))
        own = own.sort_values("child")
        d = _distances(np.stack(part["v"].to_numpy()), np.stack(own["centre"].to_numpy()))
        nearest = np.argsort(d, axis=1, kind="stable")[:, :best]
        row = np.repeat(np.arange(len(part)), nearest.shape[1])
        out = kept.iloc[row].reset_index(drop=True)
        return out.assign(child=own["child"].to_numpy()[nearest.ravel()], d=d[row, nearest.ravel()])

    return dealt.groupBy("cell", "share").cogroup(sent.groupBy("cell", "share")).applyInPandas(
        route, f"{schema}, child long, d double"
    )


def _visits(vectors: DataFrame, levels: list[DataFrame], id_type: str, probes: int) -> DataFrame:
    """The cells each vector searches: ``vector``, ``v``, ``cell``."""
    now = vectors.select("vector", "v", F.lit(0).cast("long").alias("cell"), F.lit(0.0).alias("d"))
    for centres in levels:
        split = centres.select("cell").distinct()
        inner = settle(now.join(split, "cell", "left_semi").select("vector", "v", "cell"))
        shares = _shares(inner.groupBy("cell").agg(F.count("*").alias("n")))
        deeper = _routed(inner, centres, shares, f"vector {id_type}, v array<double>", probes)
        deeper = deeper.select("vector", "v", F.col("child").alias("cell"), "d")
        together = now.join(split, "cell", "left_anti").select("vector", "v", "cell", "d").unionByName(deeper)
        now = settle(first_n(together, ["vector"], [F.col("d"), F.col("cell")], probes))
    return now.select("vector", "v", "cell")


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    data = np.stack(pdf["v"].to_numpy()).astype("<f8")
    return pd.DataFrame({
        "cell": [pdf["cell"].iloc[0]], "vectors": [pdf["vector"].tolist()], "ids": [pdf["ids"].tolist()], "data": [data.tobytes()],
    })


def _searched(cells: DataFrame, visits: DataFrame, id_type: str, k: int) -> DataFrame:
    """Per vector the nearest ids that carry other vectors, from all cells it visits."""
    blocks = settle(cells.groupBy("cell").applyInPandas(
        _packed, f"cell long, vectors array<{id_type}>, ids array<array<{id_type}>>, data binary"
    ))
    shares = settle(_shares(visits.groupBy("cell").agg(F.count("*").alias("n"))))
    queries = visits.join(shares, "cell").withColumn("share", F.pmod(F.xxhash64("vector"), "shares")).drop("shares")
    # A cell goes as one row to each task that holds queries for it.
    sent = blocks.join(shares, "cell").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")

    def search(query: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(query) or not len(block):
            return pd.DataFrame({"vector": [], "d": [], "id": []}, dtype=object)
        names = block["vectors"].iloc[0]
        data = np.frombuffer(block["data"].iloc[0], dtype="<f8").reshape(len(names), -1)
        skip = pd.Series(np.arange(len(names)), index=names).reindex(query["vector"]).fillna(-1).to_numpy(dtype=np.int64)
        row, d, near = _closest(np.stack(query["v"].to_numpy()), data, [list(i) for i in block["ids"].iloc[0]], skip, k)
        return pd.DataFrame({"vector": query["vector"].to_numpy()[row], "d": d, "id": near})

    found = queries.groupBy("cell", "share").cogroup(sent.groupBy("cell", "share")).applyInPandas(
        search, f"vector {id_type}, d double, id {id_type}"
    )
    best = first_n(found, ["vector"], [F.col("d"), F.col("id")], k)
    return best.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("found"))
