"""Benchmark decontamination: word runs of the test items find passages, local alignment scores them.

The test items are the stated query set. They are taken in blocks of bounded size; each block meets
every document, so nothing is shuffled but findings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from almanac.llm.batches import leaving_nothing, text_slices
from almanac.llm.wordhash import NO_LETTER, WORD_BYTES, Words
from almanac.session import ship_package

# Words of a seed.
SEED_WORDS = 3

# Alignment of words: a match, another word, a word left out on either side.
MATCH, OTHER, GAP = 2, 1, 1

# Least share of the best possible score; items below LEAST_WORDS words must be there whole.
LEAST_SCORE = 0.5
LEAST_WORDS = 8

# Words of test items per block: what is sent to every worker, about 24 bytes each.
BLOCK_WORDS = 1_000_000

_HITS = "doc_id {doc}, item_id {item}, score double, first_word long, end_word long"


class _Items:
    """The test items of one block: their words and the places of their seeds."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        words = Words([r[1] for r in rows], NO_LETTER)
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        hashes, bounds = words.shingles(SEED_WORDS)
        self.seed = hashes
        self.item = np.repeat(np.arange(len(rows)), np.diff(bounds))
        self.offset = np.arange(len(hashes)) - bounds[self.item] if len(hashes) else np.zeros(0, dtype=np.int64)
        # Items with fewer words than a seed are looked for as a whole, at their own width.
        self.widths = sorted({min(len(w), SEED_WORDS) for w in self.words if len(w)})
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item, self.offset = self.seed[order], self.item[order], self.offset[order]
        self.distinct = np.unique(self.seed)
        self.bags = [np.unique(w, return_counts=True) for w in self.words]

    def can_reach(self, i: int, passage: np.ndarray, least: float) -> bool:
        """Whether the words that item and passage share, in any order, are enough for a share of ``least``."""
        words, counts = self.bags[i]
        index = np.minimum(np.searchsorted(words, passage), len(words) - 1)
        shared = np.bincount(index[words[index] == passage], minlength=len(words))
        return np.minimum(shared, counts).sum() / len(self.words[i]) >= least

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word (counted over the batch) and index in ``distinct`` of every seed in the texts."""
        texts, places, found = [], [], []
        for width in self.widths:
            hashes, bounds = words.shingles(width)
            index = np.minimum(np.searchsorted(self.distinct, hashes), len(self.distinct) - 1)
            hit = np.flatnonzero(self.distinct[index] == hashes) if len(self.distinct) else np.zeros(0, dtype=np.int64)
            text = np.searchsorted(bounds, hit, side="right") - 1
            texts.append(text)
            places.append(hit - bounds[text] + words.first[text])
            found.append(index[hit])
        if not texts:
            return (np.zeros(0, dtype=np.int64),) * 3
        return np.concatenate(texts), np.concatenate(places), np.concatenate(found)


def alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, first word and end in ``passage`` (end exclusive, 0 and 0 without a match)."""
    score, end = _best(item, passage)
    if not score:
        return 0, 0, 0
    _, length = _best(item[::-1], passage[:end][::-1])
    return score, end - length, end


def _best(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    n = len(passage)
    row, slope = np.zeros(n + 1, dtype=np.int64), GAP * np.arange(n + 1)
    best, end = 0, 0
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, MATCH, -OTHER)
        row = np.maximum(row - GAP, 0)
        np.maximum(row[1:], diagonal, out=row[1:])
        row = np.maximum.accumulate(row + slope) - slope  # words of the passage left out
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def contaminated_passages(
    docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text",
    item_key: str = "item_id", least_score: float = LEAST_SCORE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document and test item it holds: ``doc_id``, ``item_id``, ``score``, ``first_word``, ``end_word``.

    Words are runs of letters, digits and characters above U+007F, A-Z in lower case. Seeds are all
    runs of three words of an item, however many documents hold them. Around each place with seeds in a row the passage is aligned to the item; ``score`` is the share of the best
    possible score, and the best passage of the document is reported if it reaches ``least_score``
    (items below eight words: if it holds all of them in a row). A null or empty text or item has
    no findings. Repeated rows give repeated findings; other input columns take no part.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(key), F.col(text).alias("text"))
    schema = _HITS.format(
        doc=docs.schema[key].dataType.simpleString(), item=items.schema[item_key].dataType.simpleString()
    )
    blocks = _blocks(items.select(F.col(item_key), F.col(item_text)), block_words)
    found = [_block_findings(rows, _Items(block), schema, least_score) for block in blocks]
    # An empty table made by the driver would be read by Python workers of another kind, which stay beside these.
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """The test items in blocks; the driver holds one block at a time."""
    held, size = [], 0
    for row in items.toLocalIterator():
        words = len((row[1] or "").split())
        if held and size + words > block_words:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += words
    if held:
        yield held


def _block_findings(rows: DataFrame, items: _Items, schema: str, least_score: float) -> DataFrame:
    context = rows.sparkSession.sparkContext
    everything = context.broadcast(items)  # at most block_words words

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = everything.value
        for part, texts in text_slices(batches, size=WORD_BYTES):
            found = _findings(wanted, Words(texts, NO_LETTER), least_score)
            if found:
                index, item, score, first, end = zip(*found)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(index)), pa.array([wanted.ids[i] for i in item]),
                    pa.array(score), pa.array(first), pa.array(end),
                ], names=["doc_id", "item_id", "score", "first_word", "end_word"])

    return rows.mapInArrow(leaving_nothing(search), schema)


def _findings(items: _Items, words: Words, least_score: float) -> list[tuple]:
    text, place, seed = items.hits(words)
    if not len(text):
        return []
    # Every item that has the seed, and where its first word would stand if the passage ran along with it.
    low = np.searchsorted(items.seed, items.distinct[seed], side="left")
    many = np.searchsorted(items.seed, items.distinct[seed], side="right") - low
    hit = np.repeat(np.arange(len(text)), many)
    entry = low[hit] + np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many)
    text, item, along = text[hit], items.item[entry], place[hit] - items.offset[entry]
    order = np.lexsort((along, item, text))
    text, item, along = text[order], item[order], along[order]
    length = np.array([len(w) for w in items.words])[item]
    slack = np.maximum(4, length // 2)
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (along[1:] - along[:-1] > slack[1:])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(text)) - 1
    best: dict[tuple[int, int], tuple] = {}
    for a, b in zip(starts, ends):
        t, i = int(text[a]), int(item[a])
        begin = max(int(words.first[t]), int(along[a] - slack[a]))
        end = min(int(words.first[t + 1]), int(along[b] + length[a] + slack[a]))
        mine = items.words[i]
        least = least_score if len(mine) >= LEAST_WORDS else 1.0
        if not items.can_reach(i, words.hash[begin:end], least):
            continue
        score, first, last = alignment(mine, words.hash[begin:end])
        share = score / (MATCH * len(mine))
        if share >= least and share > best.get((t, i), (0.0,))[0]:
            offset = begin - int(words.first[t])
            best[t, i] = (share, offset + first, offset + last)
    return [(t, i, *found) for (t, i), found in sorted(best.items())]


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all test items."""
    return contaminated_passages(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
