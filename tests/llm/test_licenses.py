"""License scans against plain Python."""

import random
import re

from almanac.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def base(text):
    words = WORD.findall(lowered(text))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i:i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_equals_plain_search(spark):
    r = random.Random(1)
    parts = ["MIT", "license", "License.", "Apache", "general", "public", "é", "İ", "K", "mit license", "\n", ",", "x",
             "GNU General Public License, version 3", "🙂", "\x7f"]
    texts = [None, "", "...", "mit license", "MIT LICENSE MIT License", "mit-license apache_license", "emit license"]
    texts += [" ".join(r.choice(parts) for _ in range(r.randrange(1, 40))) for _ in range(200)]
    texts += ["mit license " * 5000]
    df = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = licenses.license_labels(df).collect()
    assert len(got) == len(texts)
    for row in got:
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == base(row.text or "")
        assert set(filter(None, row.base_labels.split(","))) <= set(filter(None, row.labels.split(",")))
        assert row.labels == ",".join(sorted(set(row.labels.split(",")))) and 0 <= row.score <= 1


def labels(spark, text):
    row = licenses.license_labels(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    return row.labels.split(","), row.score


def test_longer_and_surer_rules_win(spark):
    assert labels(spark, "Licensed under the Apache License, Version 2.0.") == (["apache", "apache-2.0"], 0.95)
    assert labels(spark, "SPDX-License-Identifier: MIT") == (["mit"], 1.0)
    assert labels(spark, "Licensed under CC BY-NC 4.0.") == (["cc-by-nc-4.0"], 0.95)
    assert labels(spark, "See https://creativecommons.org/licenses/by-sa/4.0/") == (["cc-by-sa-4.0"], 0.9)
    assert labels(spark, "This library is under the GNU Lesser General Public License, version 2.1") == (["gpl", "lgpl-2.1"], 0.8)
    assert labels(spark, "Nothing of the kind is said here.") == ([""], 0.0)


def test_rules(spark):
    rules = licenses._rules()
    assert len(rules) > 200
    texts = []
    for label, kind, pattern, signals in rules:
        for text in licenses.matched_texts(pattern[4:-6]):
            text = text.replace("\0", "1999" if "[0-9]{4}" in pattern else "7")
            assert re.search(pattern, f" {text} "), (pattern, text)
            # What the filter before a rule looks for must be part of whatever the rule finds.
            assert set(signals) & set(text.split()), (pattern, text)
            texts.append((label, text))
    # Every text of every rule gives a detection, of its own rule or of one that contains it.
    found = licenses.license_labels(spark.createDataFrame(texts, "label string, text string"))
    assert found.where("labels = ''").count() == 0
    assert licenses.license_labels(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_detections_equal_plain_rules(spark):
    r = random.Random(2)
    rules = licenses._rules()
    pool = [t.replace("\0", "1999") for _, _, p, _ in rules for t in sorted(licenses.matched_texts(p[4:-6]))]
    texts = [" ".join(r.choice(pool) for _ in range(r.randrange(1, 9))) for _ in range(60)]
    got = licenses.license_labels(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in got:
        joined = f" {row.text} "
        spans = [
            (m.start() + 1, -m.end(), kind, label) for label, kind, pattern, _ in rules
            for m in re.finditer(pattern, joined)
        ]
        kept, ends = [], []
        for start, least, kind, label in sorted(spans):
            if not any(k <= kind and end >= -least for k, end in ends):
                kept.append((start, -least, kind, label))
            ends.append((kind, -least))
        assert [tuple(d) for d in row.detections] == kept
