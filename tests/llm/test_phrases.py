"""Collocations against counts of all phrases in plain Python."""

import random
import re
from collections import Counter

from almanac.llm import phrases as ph


def plain(rows, most=3, least=10, percent=50, top=2000):
    count, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, most + 1):
                count.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    out = {}
    candidates = {key: a for key, a in count.items() if len(key[1]) > 1 and a >= least}
    for (lang, g), a in candidates.items():
        cuts = [(10**6 * a * a // (count[lang, g[:k]] * count[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        if any(lang == other and len(longer) > len(g) and 100 * f >= percent * a
               and any(longer[i:i + len(g)] == g for i in range(len(longer) - len(g) + 1))
               for (other, longer), f in candidates.items()):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), count[lang, g[:k]], count[lang, g[k:]]))
    return [(lang, i, p.decode(), -a, left, right, sizes[lang], -s)
            for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]


def corpus():
    r = random.Random(4)
    words = [f"w{i}" for i in range(12)] + ["é", "日本", "A", "a", "x" * 300]
    rows = []
    for i in range(400):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", "\n", "! "]) for _ in range(r.randrange(0, 60)))
        if i % 3 == 0:
            text += r.choice(["New York City", "new  york city hall", "to be or not", "a a a a a a", "w1 w1 w1"])
        rows.append((text, r.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (" \t\n", "xx"), ("one", "yy")] + [("same text again and again", "zz")] * 30


def test_collocations_equal_counts_of_all_phrases(spark):
    rows = corpus()
    df = spark.createDataFrame([(*x, "q", 1) for x in rows], "text string, lang string, word string, n int").repartition(3)
    for kwargs in ({}, {"most_words": 2}, {"most_words": 4, "least_count": 6, "covered_percent": 80}, {"top": 7}):
        got = ph.collocations(df, **kwargs).collect()
        want = plain(rows, kwargs.get("most_words", 3), kwargs.get("least_count", 10), kwargs.get("covered_percent", 50), kwargs.get("top", 2000))
        assert sorted(map(tuple, got)) == sorted(want)


def test_slices_do_not_matter():
    texts, langs = zip(*[(t or "", g or "und") for t, g in corpus()])
    planes, words, codes, names, counts = ph._occurrences(list(texts), list(langs))
    line = ph._line(planes)
    assert (line >= 0).sum() == sum(counts.to_pylist()) == sum(len(re.findall("[^\x20\x09.,;:!?\x0a-\x0d]+", t)) for t in texts)
    assert len(set(zip(words.to_pylist(), codes.to_pylist()))) == len(words)


def test_no_words(spark):
    schema = "text string, lang string"
    for rows in ([], [(None, None)], [(" .,", "en")], [("one two three", "en")]):
        assert ph.collocations(spark.createDataFrame(rows, schema)).collect() == []


def test_exact_scores_of_large_counts(spark):
    big = 10**14 + 7
    found = [spark.createDataFrame([(1, "en", "a", 3 * big), (2, "en", "b", 2 * big)], "w1 long, lang string, word string, f long"),
             spark.createDataFrame([(1, 2, big)], "w1 long, w2 long, f long")]
    pairs = ph._not_covered(found, 2, 50)
    assert ph._scored(pairs, found, 2).first().score == 10**6 * big * big // (6 * big * big)


def test_query_equals_sql(spark):
    import duckdb

    from check import compare

    df = ph.op13_phrase_collocations(spark, "/root/testdata/sf0.001")
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    result = db.sql(ph.OP13_SQL)
    assert compare(df.collect(), df.columns, result.fetchall(), result.columns) == ""
