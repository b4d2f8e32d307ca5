"""The pipeline on the smallest tables and on awkward rows."""

import corpus_pipeline as pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    clean = {r.doc_id for r in pipeline.quality(spark, docs, FOLDER).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert not [d for d, q in labels.items() if q == 0 and d in clean]
    long = {r.doc_id for r in docs.collect() if len(r.text.split()) >= 10}
    assert sum(d in clean for d, q in labels.items() if q == 1 and d in long) >= 0.97 * sum(
        q == 1 and d in long for d, q in labels.items())
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    left = pipeline.decontamination(spark, docs, FOLDER)
    assert left.columns == columns and not [r for r in left.collect() if any(i in r.text for i in items)]
    marked = pipeline.secret_removal(spark, docs, FOLDER)
    assert marked.columns == columns and marked.count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in marked.collect())


def test_run(spark):
    rows = pipeline.run(spark, FOLDER).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())


def test_awkward_rows(spark):
    text = "A normal sentence with quite a few words, and it has an end as well. "
    rows = [(1, text, "x"), (2, text, "x"), (2, text, "x"), (None, text, None), (3, None, "y"), (4, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    for stage in (pipeline.quality, pipeline.near_dedup, pipeline.decontamination, pipeline.secret_removal):
        assert stage(spark, docs, FOLDER).columns == docs.columns
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_columns_and_rows_keep_their_own(spark):
    """Columns named like results of the operators, rows without an id, an id shared by two texts."""
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    text = "A normal sentence with quite a few words, and it has an end as well. "
    rows = [(None, item, "s1", 5, "c1"), (1, item, "s2", 6, "c2"), (1, text + "user: bob pwd=hunter2", "s3", 7, "c3"), (None, text, "s4", 8, "c4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secrets string, n_words int, clean_text string")
    kept = {r.secrets: r for r in pipeline.decontamination(spark, docs, FOLDER).collect()}
    assert set(kept) == {"s3", "s4"}
    marked = {r.secrets: r for r in pipeline.secret_removal(spark, docs, FOLDER).collect()}
    assert {k: (r.n_words, r.clean_text) for k, r in marked.items()} == {"s1": (5, "c1"), "s2": (6, "c2"), "s3": (7, "c3"), "s4": (8, "c4")}
    assert marked["s3"].text == text + "user: bob [SECRET]" and marked["s4"].text == text
    clean = {r.secrets: r for r in pipeline.quality(spark, docs, FOLDER).collect()}
    assert (clean["s4"].n_words, clean["s4"].clean_text, clean["s4"].text) == (8, "c4", text)
    strange = docs.withColumn("a`b.c", docs.n_words)
    for stage in (pipeline.quality, pipeline.decontamination, pipeline.secret_removal):
        assert stage(spark, strange, FOLDER).columns == strange.columns
