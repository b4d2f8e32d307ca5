"""Repeated strings against a table of all of them."""

import hashlib
import random

from pyspark.sql import functions as F

from almanac.llm import repeats


def plain(rows):
    least = {}
    for doc, text in rows:
        raw = (text or "").encode()
        if doc is not None:
            for i in range(len(raw) - 49):
                least[raw[i:i + 50]] = min(doc, least.get(raw[i:i + 50], doc))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if doc is not None and least[raw[i:i + 50]] < doc:
                gone[i:i + 50] = b"\1" * 50
        spans = bytes(gone).replace(b"\0", b" ").split()
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((-1 if doc is None else doc, len(raw), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    r = random.Random(7)
    letters = "abcdeé \n"
    passages = ["".join(r.choice(letters) for _ in range(r.choice([30, 49, 50, 51, 60, 120, 400]))) for _ in range(25)]
    texts = [None, "", "a" * 49, "a" * 50, "a" * 200, "ab" * 90, "a" * 120]
    for _ in range(150):
        parts = ["".join(r.choice(letters) for _ in range(r.randrange(80)))]
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            if r.random() < 0.5 and len(p) > 60:
                k = r.randrange(len(p))
                p = p[:k] + "X" + p[k + 1:]
            parts += [p, "".join(r.choice(letters) for _ in range(r.randrange(40)))]
        texts.append("".join(parts))
    base = "".join(r.choice("abcdefghij ") for _ in range(900))
    for _ in range(60):
        copy = list(base)
        for _ in range(r.randrange(9)):
            copy[r.randrange(900)] = r.choice("XYZ")
        texts.append("".join(copy))
    texts += texts[20:30]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts))


def test_removed_bytes_equal_plain_ones(spark):
    rows = corpus() + [(None, "a" * 80)]
    rows.append((rows[30][0], rows[31][1]))
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, seed int, spans int").repartition(4)
    got = repeats.repeated_passages(df).mapInArrow(
        repeats._kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    ).select(F.coalesce("doc_id", F.lit(-1)), "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(tuple(r) for r in got) == plain(rows)


def test_empty_table(spark):
    assert repeats.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in repeats.op10_suffix_array_dedup(spark, folder).collect()) == plain(rows)


def test_every_number_of_leaders_gives_the_same(monkeypatch):
    import pyarrow as pa

    rows = [(d, t) for d, t in corpus()]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": [d for d, _ in rows], "tag": [0] * len(rows), "text": [t or "" for _, t in rows],
        "gone": pa.array([None] * len(rows), pa.list_(pa.struct({"tag": pa.int64(), "first": pa.int64(), "end": pa.int64()}))),
        "seeds": pa.array([[] for _ in rows], pa.list_(pa.int64())),
    })
    seeds = repeats._Seeds([t or "" for _, t in rows]).hash.view("int64").tolist()
    batch = batch.set_column(4, "seeds", pa.array([seeds] + [[]] * (len(rows) - 1), pa.list_(pa.int64())))
    found = pa.Table.from_batches(list(repeats._stretches(iter([batch])))).to_pylist()
    open_ = sorted((r for r in found if r["run"] is not None), key=lambda r: r["seed"])
    columns = ("seed", "back", "run", "doc_id", "tag", "first", "end")
    table = pa.RecordBatch.from_pylist([{k: r[k] for k in columns} for r in open_])
    results = []
    for leaders in (0, 1, 8):
        monkeypatch.setattr(repeats, "LEADERS", leaders)
        out = pa.Table.from_batches(list(repeats._compared(iter([table])))).to_pylist()
        results.append({(r["doc_id"], b) for r in out for b in range(r["first"], r["end"])})
    assert results[0] == results[1] == results[2] and results[0]
    # Seeds taken in chunks of any size: the smallest documents of the chunks decide.
    for size in (1, 7, 60):
        monkeypatch.setattr(repeats, "ROWS", size)
        parts = [table.slice(i, size) for i in range(0, table.num_rows, size)]
        out = pa.Table.from_batches(list(repeats._compared(iter(parts)))).to_pylist()
        least = {}
        for r in out:
            least[r["hash"], r["hash_2"]] = min(r["doc_id"], least.get((r["hash"], r["hash_2"]), r["doc_id"]))
        gone = [r for r in out if r["hash"] is None or r["doc_id"] > least[r["hash"], r["hash_2"]]]
        assert {(r["doc_id"], b) for r in gone for b in range(r["first"], r["end"])} == results[0]


def test_seed_of_many_documents(spark, monkeypatch):
    """One passage in every document, each time between other words, through chunks of the whole operator."""
    r = random.Random(5)
    passage = "".join(r.choice("abcdefghij ") for _ in range(70))
    rows = [(k, f"{r.random()} {passage[r.randrange(8):]} {r.random()}") for k in range(300)]
    r.shuffle(rows)
    monkeypatch.setattr(repeats, "_compared", in_chunks(40))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: [tuple(s) for s in x.spans] for x in repeats.repeated_passages(df).collect()}
    assert sorted((k, len(t.encode()), sum(b - a for a, b in got[k]), len(got[k])) for k, t in rows) == [x[:4] for x in plain(rows)]


def test_long_copies_with_edits(spark):
    """Texts of many pieces, whole and edited, also under one id."""
    r = random.Random(11)
    base = ["".join(r.choice("abcdefghij ") for _ in range(6000)) for _ in range(4)]
    rows = [(k, base[k % 4]) for k in range(12)]
    for k in range(12, 40):
        copy = list(base[k % 4])
        for _ in range(r.randrange(6)):
            copy[r.randrange(6000)] = "X"
        rows.append((k, "".join(copy[r.randrange(900):])))
    rows += [(39, base[0]), (5, base[2][:3000] + base[1][:3000])]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = repeats.repeated_passages(df).mapInArrow(
        repeats._kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    assert sorted(tuple(x) for x in got) == plain(rows)


def in_chunks(size):
    def compared(batches):
        from almanac.llm import repeats as there

        there.ROWS = size
        yield from there._compared(p for b in batches for p in (b.slice(i, size) for i in range(0, b.num_rows, size)))

    return compared


def test_text_of_many_spans(spark):
    """Tens of thousands of spans in one text, in about linear time."""
    lines = [f"{k * 7919 % 100_003:06d} " * 8 for k in range(20_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(f"{s}x{k:05x}" for k, s in enumerate(lines)))]
    got = {x.doc_id: x for x in repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got[1].spans) == 0 and len(got[2].spans) == 20_000


def test_copied_text_is_one_row_of_pieces():
    """Whole copies within a slice come out as one span each, and their spans hold the same strings as their pieces."""
    import pyarrow as pa

    r = random.Random(3)
    text = "".join(r.choice("abcdefgh ") for _ in range(20_000))
    other = "".join(r.choice("abcdefgh ") for _ in range(3_000))
    texts = [text] * 30 + [other + text[5_000:9_000] + other[::-1]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "tag", "text"]
    )
    rows = [row for out in repeats._text_pieces(iter([batch])) for row in out.to_pylist()]
    copied = [row for row in rows if row["copied"]]
    whole = [row for row in copied if row["doc_id"] < 30]
    assert sorted(row["doc_id"] for row in whole) == list(range(1, 30))
    assert {(row["first"], row["end"]) for row in whole} == {(0, 20_000)}
    part, = [row for row in copied if row["doc_id"] == 30]
    assert 3_000 <= part["first"] < part["end"] <= 7_000 and part["end"] - part["first"] > 1_000
    assert sum(not row["copied"] for row in rows) > 20


def test_places_of_least_seeds_do_not_depend_on_parts(monkeypatch):
    """Seeds found part by part, also with equal ones and across the ends of parts, against a plain search."""
    import numpy as np

    text = "".join(random.Random(9).choice("ab") for _ in range(900)) + "a" * 200
    want = None
    for places in (1, 7, 64, 1 << 15):
        monkeypatch.setattr(repeats, "PLACES", places)
        hashes = repeats._run_hashes(text.encode())
        assert len(hashes) == len(text) - 15 and hashes[900] == hashes[950]
        key = [(int(h) >> 16, i) for i, h in enumerate(hashes)]
        span = repeats.WIDTH - repeats.SEED + 1
        assert repeats._least_places(hashes, span).tolist() == [min(key[i:i + span])[1] for i in range(len(key) - span + 1)]
        s = repeats._Seeds([None, text[:60], "", "a" * 49, text, "b"])
        got = [x.tolist() for x in (s.first, s.last, s.at, s.text, s.hash)]
        want = want or got
        assert got == want
        starts = [p for a, b in zip(s.first, s.last) for p in range(a, b + 1)]
        assert starts == [*range(11), *range(109, 109 + len(text) - 49)]
        assert set(s.text.tolist()) == {1, 4} and bool(np.all((s.at >= s.first) & (s.at <= s.last + span - 1)))


def test_stretches_around_one_string_are_one_text(monkeypatch):
    """What the smallest documents leave open is sorted without what stands around it."""
    import pyarrow as pa

    r = random.Random(2)
    letters = "cdefghijklmnop"
    seed, share = "A" * repeats.SEED, "".join(r.choice(letters) for _ in range(34))
    before = ["".join(r.choice(letters) for _ in range(19)) + end for end in "qrstuvwxyzBCDEF"]
    runs = [x + seed + "".join(r.choice(letters) for _ in range(34)) for x in before[:9]]
    runs += [x + seed + share for x in before[9:]]
    table = pa.RecordBatch.from_pydict({
        "seed": [1] * 15, "back": [20] * 15, "run": [x.encode() for x in runs], "doc_id": list(range(15)), "tag": [0] * 15,
        "first": [0] * 15, "end": [70] * 15,
    })
    sorted_ = []
    equal_runs = repeats.equal_runs
    monkeypatch.setattr(repeats, "equal_runs", lambda texts, width: sorted_.append(texts) or equal_runs(texts, width))
    out = pa.Table.from_batches(list(repeats._compared(iter([table])))).to_pylist()
    assert sorted((x["doc_id"], x["first"], x["end"]) for x in out) == [(k, 20, 70) for k in range(10, 15)]
    assert sorted_ == [[(seed + share).encode()]]
