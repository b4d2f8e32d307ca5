import math

import numpy as np
import pytest

from almanac.operators.cells import knn_neighbors_in_cells
from almanac.operators.neighbors import knn_neighbors, knn_predict


def brute(points, k):
    out = {}
    for i, a in points.items():
        near = sorted((math.dist(a, b), j) for j, b in points.items() if j != i)[:k]
        out[i] = near
    return out


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_neighbors_equal_brute_force(spark, block_rows):
    r = np.random.default_rng(3)
    points = {i: tuple(map(float, p)) for i, p in enumerate(r.normal(size=(150, 3)).round(3))}
    # A third of the rows are copies of one vector, and some ties on a line.
    points.update({200 + i: (0.5, 0.5, 0.5) for i in range(75)})
    points.update({300 + i: (float(i), 0.0, 0.0) for i in range(10)})
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], "id long, a double, b double, c double")
    k = 4
    got = {}
    for row in knn_neighbors(df, "id", ["a", "b", "c"], k, block_rows).orderBy("id", "rn").collect():
        got.setdefault(row.id, []).append((row.distance, row.neighbor))
    want = brute(points, k)
    assert set(got) == set(want)
    for i in want:
        assert [n for _, n in got[i]] == [n for _, n in want[i]]
        assert [d for d, _ in got[i]] == pytest.approx([d for d, _ in want[i]], abs=1e-12)


def test_k_beyond_the_table_and_missing_features(spark):
    df = spark.createDataFrame(
        [(1, 0.0), (2, 1.0), (3, 3.0), (4, None), (5, float("nan"))], "id long, a double"
    )
    rows = knn_neighbors(df, "id", ["a"], 5).orderBy("id", "rn").collect()
    assert [(r.id, r.neighbor) for r in rows] == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 2), (3, 1)]


def test_prediction_is_the_weighted_mean(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 10.0), (2, 1.0, 20.0), (3, 3.0, 40.0), (4, 3.0, 5.0)], "id long, a double, t double"
    )
    rows = {r.id: r for r in knn_predict(df, "id", ["a"], "t", 2, comps=2).collect()}
    assert rows[1].predicted == pytest.approx((20 / 1 + 40 / 3) / (1 + 1 / 3))
    assert (rows[1].comp_1, rows[1].comp_2) == (2, 3)
    assert rows[3].predicted is None and rows[4].predicted is None


def test_text_ids_rank_by_code_point(spark):
    names = {"b": (0.0, 0.0), "a": (1.0, 0.0), "C": (-1.0, 0.0), "d": (0.0, 5.0), "é": (0.0, 5.0)}
    df = spark.createDataFrame([(n, *p) for n, p in names.items()], "id string, x double, y double")
    for block_rows in (2, 4096):
        got = {}
        for row in knn_neighbors(df, "id", ["x", "y"], 3, block_rows).orderBy("id", "rn").collect():
            got.setdefault(row.id, []).append(row.neighbor)
        assert got == {i: [n for _, n in near] for i, near in brute(names, 3).items()}


def test_gaps_in_vectors_and_targets(spark):
    from almanac.functions.aggregates import weighted_mean
    from almanac.operators.neighbors import knn_neighbors, knn_predict

    rows = [(1, [0.0, 0.0], 10.0), (2, [1.0, 0.0], None), (3, [3.0, 0.0], 10.0), (4, [None, 0.0], 1.0), (5, [float("nan"), 0.0], 1.0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, t double")
    assert {r.id for r in knn_neighbors(df, "id", ["v"], 2).collect()} == {1, 2, 3}
    predicted = {r.id: r.predicted for r in knn_predict(df, "id", ["v"], "t", 2).collect()}
    assert predicted[1] is None and predicted[3] is None and abs(predicted[2] - 10) < 1e-9
    pairs = spark.createDataFrame([(10.0, 1.0), (None, 1.0)], "x double, w double")
    assert pairs.agg(weighted_mean(pairs.x, pairs.w).alias("m")).collect()[0].m == 10


def test_cells_are_exact_when_all_are_searched(spark):
    r = np.random.default_rng(4)
    points = {i: tuple(map(float, p)) for i, p in enumerate(r.normal(size=(160, 3)).round(2))}
    points.update({200 + i: (0.5, 0.5, 0.5) for i in range(70)})
    df = spark.createDataFrame([(i, list(p)) for i, p in points.items()], "id long, v array<double>")
    got = {}
    for row in knn_neighbors_in_cells(df, "id", ["v"], 4, cell_rows=20, probes=1000, fan=3).orderBy("id", "rn").collect():
        got.setdefault(row.id, []).append(row.neighbor)
    assert got == {i: [n for _, n in near] for i, near in brute(points, 4).items()}
    nothing = knn_neighbors_in_cells(df.limit(0), "id", ["v"], 4)
    assert nothing.count() == 0 and nothing.columns == ["id", "rn", "neighbor", "distance"]


def recall(spark, points, k, **kwargs):
    """Share of the exact neighbours that the cells find, over the rows whose id is divisible by 100."""
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    got = {}
    for row in knn_neighbors_in_cells(df, "id", ["v"], k, **kwargs).where("id % 100 = 0").collect():
        got.setdefault(row.id, set()).add(row.neighbor)
    hits = 0
    asked = range(0, len(points), 100)
    for i in asked:
        d = ((points - points[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hits += len(got[i] & set(np.argsort(d, kind="stable")[:k].tolist()))
    return hits / (k * len(asked))


def test_recall_on_groups_in_many_dimensions(spark):
    """Wide vectors around many centres: 8 of about 120 cells, in two levels."""
    r = np.random.default_rng(6)
    centres = r.normal(size=(60, 48)) * 2
    points = centres[r.integers(0, 60, 6000)] + r.normal(size=(6000, 48)) * 0.7
    assert recall(spark, points, 10, cell_rows=100, probes=8, fan=16) >= 0.9


def test_recall_on_the_embeddings(spark):
    """Vectors almost without structure, where half of the cells have to be searched."""
    import pyarrow.parquet as pq

    points = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist())
    assert recall(spark, points, 10, cell_rows=1024, probes=12, fan=20) >= 0.9


def test_second_pass_sends_a_row_once_to_each_part():
    """Where bounds rule nothing out, a row goes to every part but not to every group, in frames no longer than those that came."""
    from types import SimpleNamespace

    import pandas as pd

    from almanac.operators import neighbors

    r = np.random.default_rng(5)
    pivots = r.normal(size=(60, 8))
    groups = {c: SimpleNamespace(n=10, inner=0.0, outer=100.0) for c in range(60)}
    places, parts = neighbors._parts_of_blocks(groups, dict.fromkeys(groups, 1), 200)
    assert len(places) == 60 and max(parts) + 1 == 3
    rows = pd.DataFrame({
        "vector": range(3000), "v": list(r.normal(size=(3000, 8))), "cell": np.arange(3000) % 60, "block": 0, "bound": math.inf,
    })
    out = list(neighbors._parts_to_visit(pivots, groups, places, parts)(iter([rows])))
    assert max(map(len, out)) <= neighbors.VISIT_ROWS
    sent = pd.concat(out)
    assert len(sent) == 3 * 3000 and not sent.duplicated(["vector", "part"]).any()
