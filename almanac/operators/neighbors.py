"""Exact nearest neighbours and prediction from them.

Rows are grouped around reference points. A first pass inside blocks of one group gives every
row an upper bound on the distance of its k-th neighbour; by the triangle inequality a second
pass then visits only the groups that can hold anything closer. Copies of one feature vector
are searched once. Nothing pairs all rows with all rows, and no row or candidate is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from almanac.functions.missing import none_missing
from almanac.operators.keys import first_n
from almanac.operators.settle import settle
from almanac.session import ship_package

# Vectors compared with each other in one step of a task.
BLOCK_ROWS = 4096

# Blocks of rows that one task holds on each side of the second pass, and rows compared with them in one step.
PART_BLOCKS = 8
QUERY_ROWS = 256

# Rows whose visits are worked out at once.
VISIT_ROWS = 2048

# Reference points, and so the rows of every table about them that the driver holds.
MOST_PIVOTS = 1024

def feature_vector(df: DataFrame, features: list[str]) -> Column:
    """The features as one array of doubles; a single array column stands for itself."""
    if len(features) == 1 and isinstance(df.schema[features[0]].dataType, T.ArrayType):
        return F.col(features[0]).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in features])


def knn_neighbors(
    df: DataFrame, id_col: str, features: list[str], k: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The ``k`` nearest other rows of each row by Euclidean distance, ties by id.

    ``id_col`` is a whole number or text without repeats. Columns: the id, ``rn`` from 1 on,
    ``neighbor`` and ``distance``. Rows that miss a feature take no part.
    """
    ship_package(df.sparkSession)
    rows, vectors = distinct_vectors(df, id_col, features, k)
    return neighbors_of_rows(rows, vectors, _nearest_vectors(vectors, k, block_rows), id_col, k)


def distinct_vectors(df: DataFrame, id_col: str, features: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """Rows without missing features (``id``, ``v``), and one row per distinct vector: ``v`` and ``ids``.

    ``ids`` are the ``k + 1`` least of the vector, so that no neighbour can be missed.
    """
    if not isinstance(df.schema[features[0]].dataType, T.ArrayType):
        df = df.where(none_missing(df, features))
    rows = df.select(F.col(id_col).alias("id"), feature_vector(df, features).alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    vectors = first_n(rows, ["v"], [F.col("id")], k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return rows, settle(vectors)


def neighbors_of_rows(rows: DataFrame, vectors: DataFrame, others: DataFrame, id_col: str, k: int) -> DataFrame:
    """The neighbours of every row: other ids of its own vector first, then those that ``others`` has for the vector."""
    own = F.transform(
        F.filter("ids", lambda i: i != F.col("id")),
        lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("id")),
    )
    found = rows.join(vectors, "v").select("id", own.alias("own"), F.element_at("ids", 1).alias("vector"))
    found = found.join(others, "vector", "left").select(
        "id", F.slice(F.concat("own", F.coalesce("found", F.slice("own", 1, 0))), 1, k).alias("found")
    )
    return found.select("id", F.posexplode("found").alias("rn", "f")).select(
        F.col("id").alias(id_col), (F.col("rn") + 1).alias("rn"),
        F.col("f.id").alias("neighbor"), F.col("f.d").alias("distance"),
    )


def _nearest_vectors(vectors: DataFrame, k: int, block_rows: int) -> DataFrame:
    """Per distinct vector, named by its smallest id, the nearest ids that carry other vectors."""
    total = vectors.count()
    n_pivots = min(MOST_PIVOTS, 4 * total // block_rows) if total > block_rows else 1
    pivots = [
        r.v for r in vectors.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(n_pivots).collect()
    ]
    id_type = vectors.schema["ids"].dataType.elementType.simpleString()
    if not pivots:
        nothing = F.lit(None).cast(f"array<struct<d: double, id: {id_type}>>")
        return vectors.select(F.element_at("ids", 1).alias("vector"), nothing.alias("found"))
    pivots = np.array(pivots)
    placed = settle(_around_pivots(vectors, pivots, id_type))
    groups = {
        r.cell: r
        for r in placed.groupBy("cell").agg(
            F.count("*").alias("n"), F.min("reach").alias("inner"), F.max("reach").alias("outer")
        ).collect()
    }
    blocks = {cell: max(1, -(-r.n // block_rows)) for cell, r in groups.items()}
    placed = placed.join(_numbers(vectors, ["cell int", "blocks long"], blocks.items()), "cell").withColumn(
        "block", F.pmod(F.xxhash64("vector"), "blocks")
    )

    first = placed.groupBy("cell", "block").applyInPandas(
        _search_own_block(k),
        f"vector {id_type}, v array<double>, cell int, block long, d array<double>, near array<{id_type}>",
    )
    if sum(blocks.values()) == 1:
        return first.select("vector", F.arrays_zip("d", F.col("near").alias("id")).alias("found"))
    first = settle(first)
    # A row whose own block holds fewer than k other ids has no bound yet and visits every group.
    bound = F.when(F.size("d") >= k, F.element_at("d", k)).otherwise(F.lit(math.inf))
    # Blocks are searched together in parts of about ``PART_BLOCKS`` blocks of rows, and a row goes once to each part it
    # visits: what is sent grows with rows x parts, not with rows x groups.
    places, parts = _parts_of_blocks(groups, blocks, PART_BLOCKS * block_rows)
    visits = settle(
        first.select("vector", "v", "cell", "block", bound.alias("bound"))
        .mapInPandas(
            _parts_to_visit(pivots, groups, places, parts),
            f"vector {id_type}, v array<double>, bound double, own int, own_block long, part int",
        )
    )
    waiting = {r.part: r.n for r in visits.groupBy("part").agg(F.count("*").alias("n")).collect()}
    shares = {part: -(-n // (PART_BLOCKS * block_rows)) for part, n in waiting.items()}

    # The own block is done. Queries of a part split into shares, and each share meets the part in a task of its own.
    shares = _numbers(vectors, ["part int", "shares long"], shares.items())
    queries = visits.join(shares, "part").withColumn("share", F.pmod(F.xxhash64("vector"), "shares")).drop("shares")
    of_block = _numbers(
        vectors, ["cell int", "block long", "part int"], [(*place, part) for place, part in zip(places, parts)]
    )
    data = (
        placed.join(of_block, ["cell", "block"]).join(shares, "part")
        .withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
        .select("part", "share", "cell", "block", "vector", "v", "ids")
    )
    second = (
        queries.groupBy("part", "share")
        .cogroup(data.groupBy("part", "share"))
        .applyInPandas(_search_part(k, pivots, groups), f"vector {id_type}, d double, id {id_type}")
    )
    near = first.select("vector", F.inline(F.arrays_zip("d", F.col("near").alias("id"))))
    merged = first_n(near.unionByName(second), ["vector"], [F.col("d"), F.col("id")], k)
    return merged.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("found"))


def _numbers(like: DataFrame, columns: list[str], rows) -> DataFrame:
    """Whole numbers as a table of at most as many rows as there are blocks."""
    rows = [tuple(int(value) for value in row) for row in rows]
    return like.sparkSession.createDataFrame(rows, ", ".join(columns))


def _parts_of_blocks(groups: dict, blocks: dict[int, int], part_rows: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Every block, as its group and number, and the part it is searched in, of about ``part_rows`` rows each."""
    places, parts, part, held = [], [], 0, 0
    for cell in sorted(groups):
        rows = groups[cell].n / blocks[cell]
        for block in range(blocks[cell]):
            if held and held + rows > part_rows:
                part, held = part + 1, 0
            places.append((cell, block))
            parts.append(part)
            held += rows
    return places, parts


def _around_pivots(vectors: DataFrame, pivots: np.ndarray, id_type: str) -> DataFrame:
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _distances(np.stack(pdf["v"].to_numpy()), pivots)
                cell = d.argmin(axis=1)
                yield pdf.assign(
                    vector=[ids[0] for ids in pdf["ids"]], cell=cell, reach=d[np.arange(len(d)), cell]
                )

    return vectors.mapInPandas(
        place, f"v array<double>, ids array<{id_type}>, vector {id_type}, cell int, reach double"
    )


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.sqrt(((a[i : i + step, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


def _within_reach(to_cells: np.ndarray, own: np.ndarray, bound: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Which groups can hold a row within ``bound``, per row, from the distances to their pivots and to the own one."""
    # A group is out of reach if all its rows are too near or too far from its pivot, or if
    # the row is so much nearer to its own pivot that the border lies beyond the bound.
    slack = 1e-9 * (1 + to_cells)
    bound, own = bound[:, None], own[:, None]
    return (
        (to_cells - bound <= outer + slack) & (to_cells + bound >= inner - slack)
        & ((to_cells - own) / 2 <= bound + slack)
    )


def _parts_to_visit(pivots: np.ndarray, groups: dict, places: list[tuple[int, int]], parts: list[int]):
    cells = np.array(sorted(groups))
    inner = np.array([groups[c].inner for c in cells])
    outer = np.array([groups[c].outer for c in cells])
    place_cell, place_block = np.array(places).T
    starts = np.flatnonzero(np.r_[True, np.diff(parts) != 0])  # parts are numbered in the order of the blocks

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), VISIT_ROWS):
                some = pdf.iloc[start : start + VISIT_ROWS]
                cell, block, bound = (some[c].to_numpy() for c in ("cell", "block", "bound"))
                to_all = _distances(np.stack(some["v"].to_numpy()), pivots)
                near = _within_reach(to_all[:, cells], to_all[np.arange(len(some)), cell], bound, inner, outer)
                near = near[:, np.searchsorted(cells, place_cell)]
                near &= (place_cell != cell[:, None]) | (place_block != block[:, None])
                # One part at a time, so that no more rows are held than came in.
                for part, visited in enumerate(np.logical_or.reduceat(near, starts, axis=1).T):
                    row = np.flatnonzero(visited)
                    if len(row):
                        yield pd.DataFrame({
                            "vector": some["vector"].to_numpy()[row], "v": some["v"].to_numpy()[row], "bound": bound[row],
                            "own": cell[row], "own_block": block[row], "part": part,
                        })

    return visit


def _closest(query: np.ndarray, data: np.ndarray, ids: list, skip: np.ndarray, k: int, bound: np.ndarray | None = None):
    """Per query row its ``k`` nearest ids among the data rows, nearest first, ties by id.

    ``ids`` holds the ids of each data row, ``skip`` the data row each query leaves out, or -1. Data rows beyond
    the ``bound`` of a query may be missing. Returns flat arrays: the query row, the distance and the id.
    """
    copies = np.array([min(len(i), k) for i in ids])
    flat = np.array([one for i in ids for one in i[:k]])
    at_flat = np.cumsum(copies) - copies
    norms = (data**2).sum(axis=1)
    kth = min(k + 1, len(data)) - 1
    step = max(1, 2_000_000 // len(data))
    parts = []
    for i in range(0, len(query), step):
        part = query[i : i + step]
        sizes = (part**2).sum(axis=1)
        rough = norms[None, :] + sizes[:, None] - 2 * part @ data.T
        cut = np.partition(rough, kth, axis=1)[:, kth]
        if bound is not None:
            cut = np.minimum(cut, bound[i : i + step] ** 2)
        # The fast form rounds; keep all that rounding could hide and measure those again.
        cut = cut + 1e-12 * (1 + data.shape[1]) * (sizes + norms.max())
        row, at = np.nonzero(rough <= cut[:, None])
        kept = at != skip[i + row]
        row, at = row[kept], at[kept]
        d = np.sqrt(((data[at] - part[row]) ** 2).sum(axis=1))
        times = copies[at]
        row, d = np.repeat(row, times), np.repeat(d, times)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        near = flat[np.repeat(at_flat[at], times) + inside]
        order = np.lexsort((near, d, row))
        row, d, near = row[order], d[order], near[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < k
        parts.append((row[best] + i, d[best], near[best]))
    return [np.concatenate(x) for x in zip(*parts)]


def _search_own_block(k: int):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.stack(pdf["v"].to_numpy())
        row, d, near = _closest(data, data, pdf["ids"].tolist(), np.arange(len(pdf)), k)
        ends = np.searchsorted(row, np.arange(1, len(pdf)))
        return pd.DataFrame(
            {"vector": pdf["vector"], "v": pdf["v"], "cell": pdf["cell"], "block": pdf["block"],
             "d": np.split(d, ends), "near": np.split(near, ends)}
        )

    return search


def _search_part(k: int, pivots: np.ndarray, groups: dict):
    def search(query: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"vector": [], "d": [], "id": []}, dtype=object)
        if not len(query) or not len(part):
            return nothing
        part = part.sort_values(["cell", "block"], kind="stable")
        data, ids = np.stack(part["v"].to_numpy()), part["ids"].tolist()
        cell, block = part["cell"].to_numpy(), part["block"].to_numpy()
        first = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (block[1:] != block[:-1])])
        sizes = np.diff(np.r_[first, len(part)])
        cell, block = cell[first], block[first]
        inner = np.array([groups[c].inner for c in cell.tolist()])
        outer = np.array([groups[c].outer for c in cell.tolist()])

        # Rows of one block ask for the same blocks, more or less: they are searched together.
        query = query.sort_values(["own", "own_block"], kind="stable")
        vector, v, bound = query["vector"].to_numpy(), np.stack(query["v"].to_numpy()), query["bound"].to_numpy()
        own, own_block = query["own"].to_numpy(), query["own_block"].to_numpy()
        changes = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (own_block[1:] != own_block[:-1])])
        found = []
        for start, stop in zip(changes, np.r_[changes[1:], len(query)]):
            for a in range(start, stop, QUERY_ROWS):
                b = min(a + QUERY_ROWS, stop)
                to_cells, to_own = _distances(v[a:b], pivots[cell]), _distances(v[a:b], pivots[own[a : a + 1]])[:, 0]
                asked = _within_reach(to_cells, to_own, bound[a:b], inner, outer).any(axis=0)
                asked &= (cell != own[a]) | (block != own_block[a])
                at = np.flatnonzero(np.repeat(asked, sizes))
                if not len(at):
                    continue
                row, d, near = _closest(
                    v[a:b], data[at], [ids[i] for i in at.tolist()], np.full(b - a, -1), k, bound[a:b]
                )
                useful = d <= bound[a:b][row]
                found.append((vector[a:b][row][useful], d[useful], near[useful]))
        if not found:
            return nothing
        return pd.DataFrame(dict(zip(("vector", "d", "id"), (np.concatenate(x) for x in zip(*found)))))

    return search


def knn_predict(
    df: DataFrame,
    id_col: str,
    features: list[str],
    target: str,
    k: int,
    exponent: float = 1.0,
    comps: int = 3,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean of the neighbours' targets weighted by ``1 / distance ** exponent``.

    Columns: the id, ``predicted`` and the nearest ids ``comp_1``, ``comp_2``, ... The prediction is
    null where a neighbour has distance 0, since its weight would be infinite, and where a neighbour
    has no target.
    """
    near = knn_neighbors(df, id_col, features, k, block_rows)
    targets = df.select(F.col(id_col).alias("neighbor"), F.col(target).cast("double").alias("_t"))
    weight = F.try_divide(F.lit(1.0), F.pow("distance", F.lit(float(exponent))))
    return near.join(targets, "neighbor").groupBy(id_col).agg(
        F.when(
            (F.min("distance") > 0) & (F.count("*") == F.count("_t")),
            F.try_divide(F.sum(F.col("_t") * weight), F.sum(weight)),
        ).alias("predicted"),
        *[F.max(F.when(F.col("rn") == i, F.col("neighbor"))).alias(f"comp_{i}") for i in range(1, comps + 1)],
    )
