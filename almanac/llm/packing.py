"""Harmonic packing of documents into training sequences.

Lengths fall into reciprocal classes: class ``i`` holds the pieces of length above ``capacity / (i + 1)``
and up to ``capacity / i``, and each of its bins takes exactly ``i`` of them. Documents are cut at
lengths that fill their bins to the end (the capacity and its halves), so only the short tails leave a
little room. Each partition fills its own bins: no shuffle, nothing is shared between workers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from almanac.llm.batches import column_slices, leaving_nothing
from almanac.llm.tokens import encoder_of
from almanac.session import ship_package

CAPACITY = 2048
END_ID = 1

# Shortest half of the capacity at which documents are cut; a rest below it stays in one piece.
LEAST_CUT = 64

_BYTES = 4
_BINS_PER_PARTITION = 1 << 40
SCHEMA = (
    "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)


def cuts(n: int, capacity: int = CAPACITY, least: int = LEAST_CUT) -> list[int]:
    """Lengths into which a document of ``n`` ids is cut, in order."""
    out = [capacity] * (n // capacity)
    rest, part = n % capacity, capacity // 2
    while part >= least and rest:
        out += [part] * (rest // part)
        rest, part = rest % part, part // 2
    return out + [rest] if rest else out


class _Bins:
    """The bins of one partition. A piece is (document, start, ids, tokens of the document)."""

    def __init__(self, capacity: int, first_sequence: int):
        self._capacity, self._next = capacity, first_sequence
        self._open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple) -> Iterator[tuple]:
        klass = self._capacity // (len(piece[2]) // _BYTES)
        held = self._open.setdefault(klass, [])
        held.append(piece)
        if len(held) == klass:
            del self._open[klass]
            yield from self._sequence(held)

    def rest(self) -> Iterator[tuple]:
        """Bins that did not fill up: their pieces in a row, cut at the capacity and last at powers of two."""
        pieces = [p for klass in sorted(self._open) for p in self._open[klass]]
        left = sum(len(p[2]) for p in pieces) // _BYTES
        while left:
            size = self._capacity if left >= self._capacity else 1 << (left.bit_length() - 1)
            taken, room = [], size * _BYTES
            while room:
                doc, start, ids, tokens = pieces.pop(0)
                taken.append((doc, start, ids[:room], tokens))
                if len(ids) > room:
                    pieces.insert(0, (doc, start + room // _BYTES, ids[room:], tokens))
                room -= len(taken[-1][2])
            yield from self._sequence(taken)
            left -= size

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, tokens in pieces:
            yield doc, start, len(ids) // _BYTES, ids, tokens, self._next, at
            at += len(ids) // _BYTES
        self._next += 1


def pack_documents(
    docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is the ids of its text and then ``end_id``; a null or empty text has only that. ``ids``
    are little-endian unsigned 32-bit numbers. Every id of every row is in exactly one piece, also of
    repeated rows and rows without an id; other input columns take no part. Sequences are full, or
    short of the capacity by what one class of tails leaves, or a power of two long.
    ``sequence_id`` follows from the partition and the order of its rows, so packing a table that is
    read from files again gives the same sequences.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file, a few MB
    schema = SCHEMA.format(id=docs.schema[key].dataType.simpleString())
    end = end_id.to_bytes(_BYTES, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        bins = _Bins(capacity, TaskContext.get().partitionId() * _BINS_PER_PARTITION)
        fields = None
        for part, texts in column_slices(batches):
            fields = fields or _fields(part.schema.field(0).type)
            rows = []
            for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                ids += end
                tokens, start = len(ids) // _BYTES, 0
                for length in cuts(tokens, capacity):
                    piece = ids[start * _BYTES:(start + length) * _BYTES]
                    rows.extend(bins.add((doc, start, piece, tokens)))
                    start += length
            yield _batch(rows, fields)
        if fields is not None:
            yield _batch(list(bins.rest()), fields)

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(leaving_nothing(pack), schema)


def _fields(key: pa.DataType) -> pa.Schema:
    names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.schema([("doc_id", key)] + [(n, pa.binary() if n == "ids" else pa.int64()) for n in names])


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


def tokenizer_file() -> str:
    """The vocabulary of the queries."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
