"""Near copies against all pairs."""

import random
import re

from almanac.llm import near_copies as nc
from almanac.llm.components import connected_components


def plain(rows, words=2):
    sets = []
    for _, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(ws[i:i + words]) for i in range(len(ws) - words + 1)} if len(ws) >= words else {tuple(ws)} if ws else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(d, len(s), least.get(find(i)) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def corpus():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 6))) for _ in range(400)] + ["the", "of"] * 40
    bases = [[r.choice(vocabulary) for _ in range(r.randrange(1, 160))] for _ in range(40)]
    texts = [None, "", "  \n", "One", "one", "one two", "The of", "the\tOF"]
    for base in bases:
        for _ in range(r.randrange(1, 9)):
            copy = list(base)
            for _ in range(int(len(copy) * r.choice([0, 0.02, 0.05, 0.1, 0.15]))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary) + "x"
            texts.append(" ".join(copy))
    big = [r.choice(vocabulary) for _ in range(150)]
    for _ in range(60):  # one large group, in which many link only through others
        copy = list(big)
        for _ in range(r.randrange(0, 22)):
            copy[r.randrange(len(copy))] = r.choice(vocabulary) + "y"
        texts.append(" ".join(copy))
    r.shuffle(texts)
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts))


def test_components_equal_all_pairs(spark):
    rows = corpus() + [(None, "one two"), (None, None)]
    rows.append(rows[5])
    df = spark.createDataFrame([(d, t, True) for d, t in rows], "doc_id long, text string, kept boolean").repartition(3)
    for words, block in ((2, 2048), (2, 16), (5, 2048)):
        got = nc.near_copies(df, words=words, block=block).collect()
        want = plain(rows, words)
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted(
            (d, n, c) for d, n, c in want if d is not None)
        assert len(got) == len(rows)
        assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in got)


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (101, 103)], "a long, b long")
    assert {(r.node, r.root) for r in connected_components(chain).collect()} == {(i, 0) for i in range(41)} | {(101, 101), (103, 101)}
    assert connected_components(chain.limit(0)).count() == 0


def test_empty_table(spark):
    assert nc.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_sql(spark):
    import duckdb

    from check import compare

    df = nc.op1_minhash_near_dedup(spark, "/root/testdata/sf0.001")
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    result = db.sql(nc.OP1_SQL)
    assert compare(df.collect(), df.columns, result.fetchall(), result.columns) == ""
