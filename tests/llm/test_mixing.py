"""Source mixing against rounds of sharing in plain Python."""

import re
from fractions import Fraction

from almanac.llm import mixing as mx


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Share, cap, share the excess among the others by weight, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = {s: Fraction(0) for s in names}
    full, excess = set(), Fraction(sum(sizes.values()))
    while excess and len(full) < len(names):
        among = [s for s in names if s not in full]
        total = sum(weight[s] for s in among)
        for s in among:
            target[s] += excess * weight[s] / total
        excess = Fraction(0)
        for s in among:
            if target[s] >= most * sizes[s]:
                excess += target[s] - most * sizes[s]
                target[s], full = Fraction(most * sizes[s]), full | {s}
    return target


def check(rows, got, most=3):
    sizes = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken = plain_targets(sizes, most=most), dict.fromkeys(sizes, 0)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-9 * max(1, want[r.source])
        assert 0 <= r.taken <= most * r.size
        taken[r.source] += r.taken
    for source in sizes:
        assert abs(taken[source] - want[source]) <= Fraction(1, 2)
        # Whole epochs and one cut: at most one document of a source is taken in part.
        parts = {r.doc_id for r in got if r.source == source and r.size and r.taken % r.size}
        assert len(parts) <= 1


def corpus():
    rows = [(i, "abcdef"[min(i * i % 11 // 2, 5)], "w " * (i * 7 % 23)) for i in range(200)]
    rows += [(900 + i, "hot", "x y z\t\n" * 5) for i in range(150)]
    return rows + [(None, None, "one two"), (None, None, "one two"), (None, "a", None), (5, None, ""), (5, "é", "u"), (7, "Z", "  ")]


def test_targets_and_cuts(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, source string, text string, size int, taken string")
    got = mx.mixed_documents(df.repartition(5)).collect()
    check(rows, got)
    again = mx.mixed_documents(df.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(map(str, got)) != sorted(map(str, mx.mixed_documents(df, seed="other").collect()))


def test_few_words_and_empty_tables(spark):
    schema = "doc_id long, source string, text string"
    for rows in ([(1, "a", ""), (2, "b", None)], [(1, "a", "w")], [(1, "a", "w w w"), (2, "b", "w"), (3, None, "")],
                 [(1, None, "w " * 9)], [(i, f"s{i}", "w " * (1 + 10 ** (i % 3))) for i in range(12)]):
        check(rows, mx.mixed_documents(spark.createDataFrame(rows, schema)).collect())
    empty = mx.mixed_documents(spark.createDataFrame([], schema))
    assert empty.count() == 0 and "taken" in empty.columns


def test_targets_of_billions_of_words(spark):
    twenty = {f"src{i}": 54_000_000 + 17 * i for i in range(1, 20)} | {"src0": 587_237_333}
    for sizes in ({"a": 2**30}, {"a": 2**31 - 1}, {"a": 3 * 2**28, None: 2**28}, twenty, {"a": 2**52 + 1, "b": 7, "c": 2**40}):
        got = mx.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = plain_targets(sizes)
        assert {r.source: r.budget for r in got} == {s: int(t + Fraction(1, 2)) for s, t in want.items()}
        assert all(r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-9 * want[r.source] for r in got)


def test_texts_of_a_mix(spark):
    rows = [(1, "a b  c", 3, 7, "u"), (2, "d e", 2, 0, "v"), (3, " f\n", 1, 3, "w"), (4, None, 0, 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, size long, taken long, more string")
    got = sorted((r.doc_id, r.epoch, r.text, r.more) for r in mx.repeated_texts(df).collect())
    assert got == [(1, 1, "a b  c", "u"), (1, 2, "a b  c", "u"), (1, 3, "a", "u"), (3, 1, " f\n", "w"), (3, 2, " f\n", "w"), (3, 3, " f\n", "w")]


def test_query_equals_sql(spark):
    import duckdb

    from check import compare

    df = mx.op12_source_mix(spark, "/root/testdata/sf0.001")
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    result = db.sql(mx.OP12_SQL)
    assert compare(df.collect(), df.columns, result.fetchall(), result.columns) == ""
