"""What Python workers hold while they work and afterwards."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa

from almanac.llm import decontaminate
from almanac.llm.batches import leaving_nothing
from almanac.llm.wordhash import Words


def held():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGESIZE")


def test_hashing_words_takes_a_bounded_multiple_of_the_text():
    text = " ".join(f"word{i}" for i in range(400_000))
    tracemalloc.start()
    Words([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 22 * len(text)


def test_hashes_do_not_depend_on_other_words():
    texts = ["one two", "x" * 5000, "three " * 100_000, "one two", "y" * 300_000 + " one two"]
    together = Words(texts)
    alone = [Words([t]).hash for t in texts]
    assert np.array_equal(together.hash, np.concatenate(alone))
    assert np.array_equal(alone[0], alone[4][1:])
    assert Words(["x" * 5000, "x" * 4999 + "y", "x" * 5001]).hash.tolist() == [
        int(Words([t]).hash[0]) for t in ("x" * 5000, "x" * 4999 + "y", "x" * 5001)]
    assert len(set(Words(["x" * 5000, "x" * 4999 + "y", "x" * 5001, "x" * 904]).hash.tolist())) == 4


def test_a_step_gives_its_memory_back():
    kept = []

    def step(batches):
        for batch in batches:
            pieces = [bytes(1000) for _ in range(150_000)]
            kept.append(bytes(1000))  # lies above the pieces
            out = pa.array(pieces, pa.binary())
            del pieces
            yield pa.RecordBatch.from_arrays([batch.column(0), out[:batch.num_rows].take(pa.array([0]))], names=["a", "b"])

    before = held()
    out = [b.num_rows for b in leaving_nothing(step)(iter([pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])]))]
    assert out == [1] and held() - before < 60_000_000


def test_findings_need_one_kind_of_worker(spark, capsys):
    docs = spark.createDataFrame([(1, "some words of a test item here and more")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "some words of a test item here"), (8, None)], "item_id long, text string")
    found = decontaminate.contaminated_passages(docs, items)
    found.explain(True)
    assert "Union" not in capsys.readouterr().out
    assert [(r.doc_id, r.item_id, r.score) for r in found.collect()] == [(1, 7, 1.0)]
    by_block = decontaminate.contaminated_passages(docs, items.unionAll(items.selectExpr("item_id + 10", "text")), block_words=1)
    assert sorted(r.item_id for r in by_block.collect()) == [7, 17]
    none = decontaminate.contaminated_passages(docs, items.limit(0))
    assert none.count() == 0 and none.columns == found.columns
