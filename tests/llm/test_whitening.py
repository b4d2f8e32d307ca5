"""Whitening against dense eigenvectors and whole-number arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from almanac.llm import whitening as wh
from almanac.llm.eigen import leading_eigenvectors


def plain(rows, components=4):
    """Per row and component the expected values, with the dense covariance of the distinct vectors."""
    kept = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return []
    lengths = [len(v) for _, v in kept]
    most = max(set(lengths), key=lambda n: (lengths.count(n), n))
    whole = [(k, tuple(math.floor(256 * c) for c in v)) for k, v in kept if len(v) == most]
    fit = sorted({x for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for k, x in whole:
        z = (np.array(x) - np.array(sums) / n) @ vectors
        for j in range(len(values)):
            flat = values[j] <= most * 2.3e-16 * max(values[0], 0)
            out.append((k, j + 1, n, sum((n * c - s) ** 2 for c, s in zip(x, sums)),
                        None if flat else z[j] / math.sqrt(values[j]), values[j] / np.trace(cov) if np.trace(cov) else None))
    return out


def same(got, want):
    assert len(got) == len(want)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    signs = {}
    for g, w in zip(got, want):
        assert g[:4] == w[:4]
        assert (g[4] is None) == (w[4] is None) and (g[5] is None) == (w[5] is None)
        if w[4] is not None:
            if abs(w[4]) > 1e-3:
                signs.setdefault(g[1], g[4] * w[4] > 0)
            assert abs(abs(g[4]) - abs(w[4])) < 1e-9
            assert abs(w[4]) <= 1e-3 or (g[4] * w[4] > 0) == signs[g[1]]
        if w[5] is not None:
            assert abs(g[5] - w[5]) <= 1e-12 * max(1, abs(w[5]))
        assert g[6] is None or g[6] < 1e-10


SCHEMA = "vec_id long, embedding array<double>, component int, n string"


def test_whitened_rows(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(120, 7)) * np.array([3, 2.4, 1.7, 1.1, 0.5, 0.2, 0.1]) @ np.linalg.qr(r.normal(size=(7, 7)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(500 + i, base[7].tolist()) for i in range(200)] + [(7, base[7].tolist()), (None, base[1].tolist())]
    rows += [(900, None), (901, []), (902, [1.0] * 6 + [None]), (903, [float("nan")] * 7), (904, [float("inf")] * 7), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(*x, 9, "s") for x in rows], SCHEMA)
    same(wh.whitened_embeddings(df.repartition(5)).collect(), plain(rows))


def test_flat_small_and_empty_tables(spark):
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.75]), (3, [0.75])],
                 [(i, [float(i), 2.0 * i, 0.0]) for i in range(6)], [(1, [1e5, -1e5]), (2, [3e5, 2e4])]):
        df = spark.createDataFrame([(*x, 9, "s") for x in rows], SCHEMA)
        same(wh.whitened_embeddings(df).collect(), plain(rows))
    # Entries and deviations beyond 64 bits.
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<double>")
    got = wh.whitened_embeddings(df).collect()
    assert len(got) == 6 and all((r.deviation is None) == (r.vec_id < 3) for r in got)


def test_eigenvectors_of_known_matrices():
    r = np.random.default_rng(1)
    for size in (1, 2, 5, 30, 200):
        b = r.normal(size=(size, size))
        for a in (b @ b.T, np.diag(np.arange(size) / 7.0), np.eye(size), np.zeros((size, size))):
            values, vectors = leading_eigenvectors(lambda x: a @ x, size, 4)
            want = np.linalg.eigvalsh(a)[::-1][:4]
            scale = max(want[0], 1e-300)
            assert np.abs(values - want).max() <= 1e-13 * scale
            assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() <= 2e-14 * scale
            assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-13


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    df = wh.op11_embedding_whitening(spark, folder)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    same(df.collect(), plain(rows))
