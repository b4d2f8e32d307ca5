"""Decontamination against a plain alignment of every document with every item."""

import random
import re

import numpy as np

from almanac.llm import decontaminate as d


def plain_alignment(item, passage):
    rows = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if a == b else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
            best = max(best, rows[i][j])
    return best


def test_alignment_equals_plain_one():
    r = np.random.default_rng(2)
    for _ in range(200):
        a, b = r.integers(0, 6, r.integers(1, 14)), r.integers(0, 6, r.integers(0, 25))
        score, first, end = d.alignment(a, b)
        assert score == plain_alignment(a.tolist(), b.tolist())
        assert score == plain_alignment(a.tolist(), b[first:end].tolist())


def made(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(n)]


def corpus():
    r = random.Random(8)
    items = [made(r, r.randrange(9, 40)) for _ in range(12)] + [made(r, 2), made(r, 3)]
    docs = []
    for k in range(120):
        doc = made(r, r.randrange(0, 200)) + ["the", "of", "and"] * r.randrange(4)
        if k % 3 == 0:
            copy = list(items[k % len(items)])
            for _ in range(len(copy) * (k % 5) // 10):
                copy[r.randrange(len(copy))] = "edited"
            at = r.randrange(len(doc) + 1)
            doc[at:at] = copy
        docs.append(" ".join(doc).title() + ".")
    return docs + [None, "", "..."] + docs[:3], [" ".join(i) for i in items] + [None, ""]


def test_findings_equal_all_pairs(spark):
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(docs)], "doc_id long, text string, score double")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for i, text in enumerate(docs):
        words = re.findall(r"[a-z0-9]+", (text or "").lower())
        for j, item in enumerate(items):
            mine = (item or "").split()
            if mine:
                share = plain_alignment(mine, words) / (2 * len(mine))
                if share >= (0.5 if len(mine) >= 8 else 1):
                    want[i, j] = share
    for block in (10 ** 6, 30):
        rows = d.contaminated_passages(df.repartition(3), bench, block_words=block).collect()
        assert {(r.doc_id, r.item_id): r.score for r in rows} == want
        assert len(rows) == len(want)
    for r in rows:
        words = re.findall(r"[a-z0-9]+", docs[r.doc_id].lower())[r.first_word:r.end_word]
        assert plain_alignment(items[r.item_id].split(), words) == round(r.score * 2 * len(items[r.item_id].split()))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert d.contaminated_passages(docs.limit(0), items).count() == 0
    assert d.contaminated_passages(docs, items.limit(0)).count() == 0


def test_query_finds_whole_items(spark):
    folder = "/root/testdata/sf0.001"
    rows = d.op4_benchmark_decontamination(spark, folder).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    for doc in spark.read.parquet(f"{folder}/documents.parquet").collect():
        for item in items:
            if item.text in doc.text:
                assert (doc.doc_id, item.item_id) in found


def test_items_copied_alike_by_many_documents(spark):
    r = random.Random(3)
    cut, edited = made(r, 40), made(r, 40)
    copies = [cut[:28], edited[:10] + ["edited"] + edited[11:24] + made(r, 16)]
    texts = [made(r, 30) + copies[k % 2] + made(r, 30) for k in range(100)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(0, " ".join(cut)), (1, " ".join(edited))], "item_id long, text string")
    rows = d.contaminated_passages(docs, items).collect()
    want = {(k, i): plain_alignment(item, t) / 80 for k, t in enumerate(texts) for i, item in enumerate((cut, edited))}
    assert {(r.doc_id, r.item_id): r.score for r in rows} == {k: v for k, v in want.items() if v >= 0.5}
    assert len(rows) == 100
