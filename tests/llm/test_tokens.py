"""Token ids, packing and token files: exact round trips."""

import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from almanac.llm import packing, simple8b, token_files, tokens

PIECES = ["a", " ", "  ", "\n", " \n", "é", "it's", "I'll", " 12", "3", "...", "🙂", "\t", " ", "<|endoftext|>", "\0", "Abc.\nDef",
          "²", "ª", "_x", "Ⅷ", "(a)", "word", "thing"]


def made_texts(n=300):
    r = random.Random(4)
    texts = [None, "", " ", "word " * 9000, "word"] + ["".join(r.choice(PIECES) for _ in range(r.randrange(30))) for _ in range(n)]
    return texts + [" ".join(["thing"] * r.randrange(3000)) for _ in range(20)]


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(packing.tokenizer_file())


def plain(encoder, text):
    return encoder._tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_encode_as_in_their_text(encoder):
    texts = made_texts(3000)
    for text, got in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == plain(encoder, text)


@given(st.lists(st.one_of(st.integers(0, 70000), st.integers(0, 3), st.integers(0, 2**64 - 1)), max_size=1500))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(values):
    record = simple8b.encode(np.array(values, dtype=np.uint64))
    assert simple8b.decode(record).tolist() == values


def test_simple8b_is_small():
    values = np.random.default_rng(1).integers(0, 32768, 100_000)
    assert len(simple8b.encode(values)) < 2.2 * len(values)


def frame(spark, texts):
    rows = [(None if i == 7 else i % 290, t, 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(5)


def test_packing_holds_every_id_once(spark, encoder):
    texts = made_texts()
    rows = packing.pack_documents(frame(spark, texts), packing.tokenizer_file()).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id, r.doc_tokens].append(r)
        assert len(r.ids) == 4 * r.length
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    total = sum(r.length for r in rows)
    assert total == sum(len(plain(encoder, t)) + 1 for t in texts)
    assert padding < 0.02 * total
    want = defaultdict(list)
    for i, t in enumerate(texts):
        ids = np.array(plain(encoder, t) + [1], dtype="<u4").tobytes()
        want[None if i == 7 else i % 290, len(ids) // 4].append(ids)
    for key, pieces in documents.items():
        # Repeated ids may interleave; each start then stands once per copy.
        copies = defaultdict(list)
        for p in pieces:
            copies[p.start].append(p.ids)
        assert sum(map(len, want[key])) == sum(4 * p.length for p in pieces)
        if len(want[key]) == 1:
            assert b"".join(copies[s][0] for s in sorted(copies)) == want[key][0]


def test_token_files_round_trip(spark, encoder, tmp_path):
    texts = made_texts()
    path = str(tmp_path / "ids")
    token_files.write_token_files(frame(spark, texts), path, packing.tokenizer_file())
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    order = sorted(range(len(texts)), key=lambda i: (
        (-1 if i == 7 else i % 290), texts[i] is not None, (texts[i] or "").encode()
    ))
    at = 0
    for i, r in zip(order, rows, strict=True):
        ids = plain(encoder, texts[i]) + [2]
        assert (r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) == (None if i == 7 else i % 290, at, ids)
        at += len(ids)


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, packing.tokenizer_file()).count() == 0
    token_files.write_token_files(empty, str(tmp_path / "none"), packing.tokenizer_file())
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_queries(spark, encoder):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    at = 0
    rows = {r.doc_id: r for r in token_files.op8_token_ids(spark, folder).collect()}
    for doc in sorted(texts):
        ids = np.array(plain(encoder, texts[doc]) + [2], dtype="<u4")
        assert (rows[doc].start, rows[doc].n_tokens, rows[doc].ids_crc32) == (at, len(ids), crc32(ids.tobytes()))
        at += len(ids)
    pieces = packing.op2_packing(spark, folder).collect()
    for r in pieces:
        ids = np.array(plain(encoder, texts[r.doc_id]) + [1], dtype="<u4")[r.start:r.start + r.length]
        assert (r.length, r.ids_crc32) == (len(ids), crc32(ids.tobytes()))


def test_simple8b_widths_and_ends_of_blocks():
    import numpy as np

    from almanac.llm import simple8b

    edges = [0, 1, *[v for b in range(1, 64) for v in (2**b - 1, 2**b, 2**b + 1)], 2**64 - 1]
    assert simple8b._widths(np.array(edges, dtype=np.uint64)).tolist() == [v.bit_length() for v in edges]
    r = np.random.default_rng(4)
    for n in (0, 1, 511, 512, 513, 1025, 3000):
        for bits in (1, 13, 16, 60, 64):
            values = r.integers(0, 2**63, n, dtype=np.uint64) >> np.uint64(64 - bits) if bits < 64 else r.integers(0, 2**64 - 1, n, dtype=np.uint64)
            record = simple8b.encode(values)
            assert np.array_equal(simple8b.decode(record), values)
            assert int(np.frombuffer(record, dtype="<u4", count=1, offset=4)[0]) == n


def test_columns_are_encoded_as_they_are_and_known_pieces_only_looked_up(encoder, monkeypatch):
    import pyarrow as pa

    texts = made_texts() + ["größe größe, größe.\nÜber größe", "Ελλάδα, Жизнь. 5é×ß ÷"]
    column = pa.array(["left out", *texts, "left out"], pa.string()).slice(1, len(texts))
    want = [np.array(plain(encoder, t), dtype="<u4").tobytes() for t in texts]
    assert encoder.encode(column) == want
    asked = []
    encoded = encoder._encoded
    monkeypatch.setattr(encoder, "_encoded", lambda pieces: asked.extend(pieces) or encoded(pieces))
    assert encoder.encode(column) == want
    assert all(tokens._odd(*tokens._bytes_of(pa.array([t])))[0] for t in asked)  # whole texts, no piece


def test_letters_of_two_bytes_are_cut_from_signs():
    import pyarrow as pa

    raw, bounds = tokens._bytes_of(pa.array(["größe größe, größe.", "é's ¿qué"]))
    pieces, first = tokens._pieces(raw, bounds)
    assert [p.decode() for p in pieces.to_pylist()] == ["größe", " größe", ",", " größe", ".", "é's", " ¿qué"]
    assert first.tolist() == [0, 5, 7]


def test_memory_forgets_what_was_used_least_lately():
    import pyarrow as pa

    memory, asked = tokens._Memory(6), []

    def ids(names):
        found = memory.ids_of(pa.array(names, pa.large_binary()), lambda p: asked.extend(p) or [x.encode() * 2 for x in p])
        assert [x.decode() for x in found.to_pylist()] == [2 * n for n in names]

    for names in (["a", "b", "c"], ["d", "a"], ["e", "a", "f"], ["a", "g", "e"], ["f", "b"]):
        ids(names)
    assert asked == ["a", "b", "c", "d", "e", "f", "g", "f", "b"]


def test_memory_of_long_pieces_is_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "PIECE_BYTES", 100_000)
    memory = tokens._Memory(1000)
    for k in range(60):
        names = [chr(97 + i) * (5_000 + k) for i in range(6)]
        found = memory.ids_of(pa.array(names, pa.large_binary()), lambda p: [x.encode()[:9] for x in p])
        assert found.to_pylist() == [x.encode()[:9] for x in names]
        assert memory._pieces.nbytes + memory._ids.nbytes < 100_000 + 6 * 5_200
