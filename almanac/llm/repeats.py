"""Repeated passages: bytes under a string of ``WIDTH`` bytes that an earlier document also holds.

Texts are first cut where their content says so; of pieces of text with the same bytes (and the same
``WIDTH - 1`` bytes behind them, compared by a 128-bit digest) only that of the smallest document goes on.
There, every string of ``WIDTH`` bytes contains one seed, the least hash of its ``SEED`` byte runs; equal strings
have equal seeds at the same place. Seeds that only one document has settle their strings at once.
The others bring their strings together by seed. There, strings are first held against those of the
smallest documents; what that leaves open and occurs again is sorted by suffix groups
(``suffixes.equal_runs``), and equal neighbours in that order decide. A seed with more rows than one task
should gather is taken in chunks: each chunk keeps the smallest document of each of its strings, and
these meet by a 128-bit hash of the string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from almanac.llm.batches import text_slices
from almanac.llm.columns import let
from almanac.llm.suffixes import equal_runs
from almanac.llm.wordhash import _mixed, random_words
from almanac.operators.settle import settle
from almanac.session import ship_package

WIDTH = 50
SEED = 16

# Mean bytes of the pieces of text whose copies collapse first.
PIECE = 256

# How many documents of a seed, the smallest first, the others are held against before suffixes are sorted.
LEADERS = 8

# Bytes of text whose seeds are computed at once: about 150 bytes of memory each.
SLICE = 1_000_000

# Places handled at once where seeds are found, so that all of them stay in a processor's cache; below 2**16.
PLACES = 1 << 15

# Rows of strings handled at once behind the exchange by seed; a seed with more is taken in chunks.
ROWS = 50_000


def _run_hashes(raw: bytes) -> np.ndarray:
    """A hash of the ``SEED`` bytes from each place on."""
    out = np.empty(max(len(raw) - SEED + 1, 0), dtype=np.uint64)
    for c in range(0, len(out), PLACES):
        with np.errstate(over="ignore"):
            b = np.frombuffer(raw[c:c + PLACES + SEED - 1], dtype=np.uint8).astype(np.uint64)
            two = b[:-1] | (b[1:] << np.uint64(8))
            four = two[:-2] | (two[2:] << np.uint64(16))
            eight = four[:-4] | (four[4:] << np.uint64(32))
            out[c:c + PLACES] = _mixed(eight[:-8] * np.uint64(0x9E3779B97F4A7C15) + eight[8:])
    return out


def _least_places(seeds: np.ndarray, span: int) -> np.ndarray:
    """For each place, that of the least of ``span`` seeds from there on, by their upper 48 bits; of equal ones the first.

    A seed and its place within a part of the seeds are one number, so that one minimum takes both along.
    """
    out = np.empty(len(seeds) - span + 1, dtype=np.int64)
    for c in range(0, len(out), PLACES):
        least = seeds[c:c + PLACES + span - 1] & ~np.uint64(0xFFFF)
        least |= np.arange(len(least), dtype=np.uint64)
        width = 1
        while width < span:
            step = min(width, span - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        out[c:c + PLACES] = (least & np.uint64(0xFFFF)).view(np.int64) + c
    return out


def _joined(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """The bytes of all texts, and where each begins and ends."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return b"".join(encoded), np.concatenate(([0], np.cumsum([len(e) for e in encoded], dtype=np.int64)))


class _Seeds:
    """Stretches of the texts whose strings share a seed: ``first`` to ``last`` start, ``at`` of the seed, ``hash``.

    Strings of the pieces that are ``gone`` from the rows of ``part`` take no part.
    """

    def __init__(self, texts: list[str | None], part: pa.RecordBatch | None = None):
        self.raw, self.bounds = _joined(texts)
        if len(self.raw) < WIDTH:
            self.first = self.last = self.at = self.text = np.zeros(0, dtype=np.int64)
            self.hash = np.zeros(0, dtype=np.uint64)
            return
        seeds = _run_hashes(self.raw)
        place = _least_places(seeds, WIDTH - SEED + 1)
        # No string begins in the last bytes of a text, so those of two texts never stand side by side.
        inside = np.ones(len(place), dtype=bool)
        closed = (self.bounds[1:, None] - np.arange(1, WIDTH)).reshape(-1)
        inside[closed[(closed >= 0) & (closed < len(place))]] = False
        for a, b in _gone(part, self.bounds) if part is not None else ():
            inside[a:b - WIDTH + 1] = False
        new = np.ones(len(place), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
        edges = np.flatnonzero(new)
        mine = np.flatnonzero(inside[edges])
        # Strings of one seed stand side by side and all begin in one text; the last inside ends the stretch.
        self.first, self.last = edges[mine], np.append(edges, len(place))[mine + 1] - 1
        self.text = np.searchsorted(self.bounds, self.first, side="right") - 1
        self.at = place[self.first]
        self.hash = seeds[self.at]


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text``, ``n_bytes`` and ``spans``, the bytes to remove.

    ``spans`` are structs ``start``, ``end`` of the UTF-8 bytes, sorted, neither overlapping nor touching. A
    byte goes if a string of ``WIDTH`` bytes over it also starts in a document with a smaller id
    (whole numbers). Strings are those of the input, whatever is removed. A null text counts as empty; a
    row without an id neither removes nor loses anything; rows with the same id do not remove each
    other's bytes. Other input columns take no part.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tag", F.xxhash64("text"))
    # Both joins take the texts by id and the same columns of them, so that they are shuffled once.
    named = rows.where("doc_id is not null").select("doc_id", "tag", "text")
    copied = settle(named.mapInArrow(
        _text_pieces, "hash long, hash_2 long, copied boolean, doc_id long, tag long, first long, end long"
    ).repartition("hash", "hash_2").sortWithinPartitions("hash", "hash_2", "doc_id").mapInArrow(
        _copied, "doc_id long, tag long, first long, end long"
    ))
    gone = copied.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "first", "end")).alias("gone"))
    open_ = named.join(gone, "doc_id", "left").select("doc_id", "tag", "text", "gone")
    shared = _shared_seeds(open_).groupBy("doc_id").agg(F.collect_list("seed").alias("seeds"))
    found = open_.join(shared, "doc_id").select("doc_id", "tag", "text", "gone", "seeds").mapInArrow(
        _stretches, "doc_id long, tag long, first long, end long, seed long, back long, run binary"
    )
    compared = settle(found.select("seed", "back", "run", "doc_id", "tag", "first", "end").repartition(
        "seed").sortWithinPartitions("seed").mapInArrow(
        _compared, "doc_id long, tag long, first long, end long, hash long, hash_2 long"
    ))
    # Strings of seeds taken in chunks: the smallest document of each chunk, and of all of them.
    several = compared.where("hash is not null")
    least = several.groupBy("hash", "hash_2").agg(F.min("doc_id").alias("least"))
    late = several.join(least, ["hash", "hash_2"]).where("doc_id > least")
    pieces = compared.where("hash is null").select("doc_id", "tag", "first", "end").unionByName(
        late.select("doc_id", "tag", "first", "end")
    ).unionByName(copied)
    spans = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "first", "end")).alias("pieces"))
    whole = named.join(spans, "doc_id", "left").select("doc_id", "text", _size(), _merged().alias("spans"))
    nameless = rows.where("doc_id is null").select("doc_id", "text", _size(), F.lit(None).cast(_SPANS).alias("spans"))
    return whole.unionByName(nameless).withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))


_SPANS = "array<struct<start:long,end:long>>"


def _size():
    return F.length(F.col("text").cast("binary")).cast("long").alias("n_bytes")


def _merged():
    """The pieces of a row as spans that neither overlap nor touch.

    With starts and ends sorted apart, a span begins where all earlier ones have ended: at each start
    above the end before it in number.
    """
    mine = F.filter("pieces", lambda p: p["tag"] == F.col("tag"))
    sides = let(mine, lambda m: F.struct(
        F.array_sort(F.transform(m, lambda p: p["first"])).alias("a"),
        F.array_sort(F.transform(m, lambda p: p["end"])).alias("b"),
    ))

    def joined(x):
        begins = F.filter(x["a"], lambda a, i: (i == 0) | (a > F.get(x["b"], i - 1)))
        ends = F.filter(x["b"], lambda b, i: F.coalesce(F.get(x["a"], i + 1) > b, F.lit(True)))
        return F.arrays_zip(begins.alias("start"), ends.alias("end"))

    return let(sides, joined).cast(_SPANS)


def _text_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each text, with the digest of their bytes and of those behind them that their strings reach.

    Cuts are where the bytes behind them say so, so copies are cut alike. Within a slice the smallest
    document stands for all; the others are ``copied``, as one span wherever their pieces touch, so that a text with
    very many copies is one row for most of them.
    """
    for part, texts in text_slices(batches, size=SLICE):
        raw, bounds = _joined(texts)
        hashes = _run_hashes(raw) if len(raw) >= SEED else np.zeros(0, dtype=np.uint64)
        cuts = np.flatnonzero((hashes >> np.uint64(32)) % np.uint64(PIECE) == 0)
        text = np.searchsorted(bounds, cuts, side="right") - 1
        cuts = cuts[cuts + SEED <= bounds[text + 1]]
        begin = np.union1d(bounds[:-1][np.diff(bounds) > 0], cuts)
        text = np.searchsorted(bounds, begin, side="right") - 1
        end = np.minimum(np.append(begin[1:], len(raw)) + WIDTH - 1, bounds[text + 1])
        long_ = end - begin >= WIDTH
        begin, end, text = begin[long_], end[long_], text[long_]
        digests = b"".join(
            hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist())
        )
        one, two = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2).T
        ids, tags = (part.column(k).to_numpy() for k in range(2))
        doc, tag = ids[text], tags[text]
        order = np.lexsort((doc, two, one))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        copied = np.zeros(len(order), dtype=bool)
        copied[order] = doc[order] > least
        # Pieces of a text overlap by what their strings reach; its first copied one after others stands for the run.
        joined = np.zeros(len(begin), dtype=bool)
        joined[1:] = copied[1:] & copied[:-1] & (text[1:] == text[:-1]) & (begin[1:] + WIDTH - 1 <= end[:-1])
        head = np.flatnonzero(~joined)
        end = end[np.append(head[1:], len(begin))[:len(head)] - 1]
        one, two, copied, doc, tag, begin, text = (x[head] for x in (one, two, copied, doc, tag, begin, text))
        # Copies need no other row: they are dealt out by their place.
        one = np.where(copied, _mixed(begin.astype(np.uint64) + doc.astype(np.uint64)).view(np.int64), one)
        yield pa.RecordBatch.from_arrays([
            pa.array(one), pa.array(two), pa.array(copied), pa.array(doc), pa.array(tag),
            pa.array(begin - bounds[text]), pa.array(end - bounds[text]),
        ], names=["hash", "hash_2", "copied", "doc_id", "tag", "first", "end"])


def _copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces that a smaller document has, too; rows come by hash and document, and none waits for others."""
    key, least = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two, done, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        goes = done.copy()
        mine = np.flatnonzero(~done)
        if len(mine):
            one, two, doc = one[mine], two[mine], doc[mine]
            new = np.ones(len(mine), dtype=bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            leaders = doc[np.flatnonzero(new)]
            if key == (one[0], two[0]):
                leaders[0] = least
            goes[mine] = doc > leaders[np.cumsum(new) - 1]
            key, least = (one[-1], two[-1]), leaders[-1]
        yield batch.select(["doc_id", "tag", "first", "end"]).filter(pa.array(goes))


def _gone(part: pa.RecordBatch, bounds: np.ndarray) -> list[tuple[int, int]]:
    """The spans of a slice's copied pieces over all its texts; of rows with one id, each has its own ``tag``."""
    return [
        (at + p["first"], at + p["end"])
        for at, tag, pieces in zip(bounds.tolist(), part.column("tag").to_pylist(), part.column("gone").to_pylist())
        for p in pieces or () if p["tag"] == tag
    ]


def _shared_seeds(named: DataFrame) -> DataFrame:
    """Seeds that two documents or more have, with each of those documents."""
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, size=SLICE):
            s = _Seeds(texts, part)
            order = np.lexsort((s.hash, s.text))
            text, value = s.text[order], s.hash[order]
            once = np.ones(len(text), dtype=bool)
            once[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
            ids = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[once].view(np.int64)), pa.array(ids[text[once]], pa.int64())], names=["seed", "doc_id"]
            )

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by seed. A seed's first document waits for a second one; after that all pass.
        seed, doc, passed = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            s, d = (batch.column(k).to_numpy() for k in range(2))
            if not passed or seed is not None and s[0] == seed:
                s, d = np.concatenate(([seed], s)), np.concatenate(([doc], d))
                known = passed
            else:
                known = False
            first = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1))
            many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
            resumed = seed is not None and s[0] == seed and known
            many[0] |= resumed
            keep = np.repeat(many, np.diff(np.append(first, len(s))))
            seed, doc, passed = s[-1], d[first[-1]], bool(many[-1])
            if resumed:
                keep[0] = False  # passed before
            yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(d[keep])], names=["seed", "doc_id"])

    every = named.mapInArrow(seeds, "seed long, doc_id long")
    return every.repartition("seed").sortWithinPartitions("seed").mapInArrow(several, "seed long, doc_id long")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches with shared seeds. Within a slice the smallest document stands for all with the same bytes.

    The others lose theirs at once, as rows without ``run``; so a passage in very many documents is
    one row per slice behind the exchange.
    """
    for part, texts in text_slices(batches, size=SLICE):
        s = _Seeds(texts, part)
        wanted = part.column("seeds").flatten().to_numpy().view(np.uint64)  # of this slice's rows only
        mine = np.flatnonzero(np.isin(s.hash, wanted))
        ids, tags = (part.column(k).to_numpy() for k in range(2))
        doc, tag = ids[s.text[mine]], tags[s.text[mine]]
        offset = s.bounds[s.text[mine]]
        first, last, back = s.first[mine], s.last[mine], s.at[mine] - s.first[mine]
        seed = s.hash[mine].view(np.int64)
        runs = [s.raw[a:b] for a, b in zip(first.tolist(), (last + WIDTH).tolist())]
        least: dict[tuple[int, bytes], int] = {}
        keys = list(zip(back.tolist(), runs))
        for k, d in zip(keys, doc.tolist()):
            if least.setdefault(k, d) > d:
                least[k] = d
        gone = doc > np.array([least[k] for k in keys], dtype=np.int64) if keys else np.zeros(0, dtype=bool)
        # What goes at once, as one span wherever its stretches touch.
        out = np.flatnonzero(gone)
        text, begin, stop = s.text[mine][out], first[out], last[out] + WIDTH
        new = np.ones(len(out), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (begin[1:] > stop[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(out))[:len(head)] - 1
        none, open_ = np.zeros(len(head), dtype=np.int64), np.flatnonzero(~gone)
        spread = _mixed(begin[head].astype(np.uint64) + doc[out][head].astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate((doc[open_], doc[out][head]))), pa.array(np.concatenate((tag[open_], tag[out][head]))),
            pa.array(np.concatenate(((first - offset)[open_], (first - offset)[out][head]))),
            pa.array(np.concatenate(((last + WIDTH - offset)[open_], (last + WIDTH - offset)[out][tail]))),
            pa.array(np.concatenate((seed[open_], spread))), pa.array(np.concatenate((back[open_], none))),
            pa.array([runs[i] for i in open_.tolist()] + [None] * len(head), pa.binary()),
        ], names=["doc_id", "tag", "first", "end", "seed", "back", "run"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What goes of the stretches, by seed.

    Rows without ``run`` pass. A seed with fewer than ``ROWS`` rows is gathered and settled; of others,
    chunk by chunk, strings that the chunk's smallest document does not settle come out with their hash.
    """
    held, rows, large = [], 0, None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        settled = table.filter(table.column("run").is_null())
        if settled.num_rows:
            yield from _final(settled.select(["doc_id", "tag", "first", "end"])).to_batches()
        open_ = table.filter(table.column("run").is_valid())
        if not open_.num_rows:
            continue
        held.append(open_)
        rows += open_.num_rows
        if rows < ROWS:
            continue
        table = pa.concat_tables(held).combine_chunks()
        seed = table.column("seed").to_numpy()
        cut = int(np.searchsorted(seed, seed[-1]))
        if not cut:
            large, cut = int(seed[-1]), len(seed)
        yield from _settled(table.slice(0, cut), large)
        held, rows = [table.slice(cut)], len(seed) - cut
    if rows:
        yield from _settled(pa.concat_tables(held).combine_chunks(), large)


def _settled(table: pa.Table, large: int | None) -> Iterator[pa.RecordBatch]:
    """A run of rows by seed; those of the seed ``large``, which come first, are one chunk of it."""
    cut = int(np.searchsorted(table.column("seed").to_numpy(), large, side="right")) if large is not None else 0
    if cut and table.column("seed")[0].as_py() == large:
        yield _of_chunk(table.slice(0, cut).combine_chunks())
        table = table.slice(cut).combine_chunks()
    if table.num_rows:
        yield from _final(pa.Table.from_batches([_removed(table)])).to_batches()


def _final(table: pa.Table) -> pa.Table:
    none = pa.nulls(table.num_rows, pa.int64())
    return table.append_column("hash", none).append_column("hash_2", none)


_LEFT = WIDTH - SEED  # most bytes before a seed in its strings
_COLUMNS = _LEFT + WIDTH
_NOTHING = 0xFF  # no byte of UTF-8


def _grid(runs: list[bytes], back: np.ndarray) -> np.ndarray:
    """All stretches with their seed in the same column; ``_NOTHING`` elsewhere."""
    sizes = np.array([len(r) for r in runs], dtype=np.int64)
    grid = np.full((len(runs), _COLUMNS), _NOTHING, dtype=np.uint8)
    row = np.repeat(np.arange(len(runs)), sizes)
    column = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(_LEFT - back, sizes)
    grid[row, column] = np.frombuffer(b"".join(runs), dtype=np.uint8)
    return grid


def _hashes(grid: np.ndarray, row: np.ndarray, column: np.ndarray, which: int) -> np.ndarray:
    """64-bit hashes of the strings that begin at the cells ``row``, ``column``."""
    letters = random_words(256, which)
    base = int(random_words(1, which + 1)[0]) | 1
    with np.errstate(over="ignore"):
        sums = np.zeros((len(grid), _COLUMNS + 1), dtype=np.uint64)
        for k in range(_COLUMNS):
            sums[:, k + 1] = sums[:, k] * np.uint64(base) + letters[grid[:, k]]
        return _mixed(sums[row, column + WIDTH] - sums[row, column] * np.uint64(pow(base, WIDTH, 1 << 64)))


def _of_chunk(table: pa.Table) -> pa.RecordBatch:
    """Of rows of one seed, strings that a smaller document of the rows has, as spans, and the others with their hash."""
    back, doc, tag, start = (table.column(k).to_numpy() for k in ("back", "doc_id", "tag", "first"))
    grid = _grid(table.column("run").to_pylist(), back)
    row, column = np.nonzero(_full(grid != _NOTHING))
    one, two = _hashes(grid, row, column, 7), _hashes(grid, row, column, 11)
    order = np.lexsort((doc[row], two, one))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    least = doc[row][order][np.flatnonzero(new)][np.cumsum(new) - 1]
    goes = doc[row][order] > least
    # One row stands for a string and document, but rows with the same id each lose or keep theirs.
    row, column, one, two = row[order], column[order], one[order].view(np.int64), two[order].view(np.int64)
    first = start[row] + column - (_LEFT - back[row])
    return pa.RecordBatch.from_arrays([
        pa.array(doc[row]), pa.array(tag[row]), pa.array(first), pa.array(first + WIDTH),
        pa.array(one, mask=goes), pa.array(two, mask=goes),
    ], names=["doc_id", "tag", "first", "end", "hash", "hash_2"])


def _removed(table: pa.Table) -> pa.RecordBatch:
    """What goes of rows by seed, all rows of each seed at once."""
    seed, back, doc, tag, start = (table.column(k).to_numpy() for k in ("seed", "back", "doc_id", "tag", "first"))
    runs = table.column("run").to_pylist()
    grid = _grid(runs, back)
    group = np.concatenate(([0], np.cumsum(seed[1:] != seed[:-1])))
    order = np.lexsort((doc, group))
    there = grid != _NOTHING
    open_ = _full(there)
    gone = np.zeros_like(open_)
    for _ in range(LEADERS):
        left = order[open_[order].any(axis=1)]
        if not len(left):
            break
        leader, where = np.unique(group[left], return_index=True)
        mine = left[where][np.searchsorted(leader, group[left])]
        same = open_[left] & _full(there[left] & (grid[left] == grid[mine]))
        gone[left] |= same & (doc[left] > doc[mine])[:, None]
        # A leader's open strings are its own: no smaller document has them.
        open_[left] &= ~same
    if open_.any():
        _decide_open(grid, open_, doc, back, runs, gone)
    # Neighbouring strings that go, as one span of bytes.
    edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    r, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    first = start[r] + a - (_LEFT - back[r])
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[r]), pa.array(tag[r]), pa.array(first), pa.array(first + (b - a) + WIDTH - 1)],
        names=["doc_id", "tag", "first", "end"],
    )


def _full(cells: np.ndarray) -> np.ndarray:
    """For each start column, whether all ``WIDTH`` cells from it on are true."""
    # Rows stand side by side; what reaches into the next row begins in columns that are left out.
    flat, width = np.ascontiguousarray(cells).reshape(-1), 1
    while width < WIDTH:
        step = min(width, WIDTH - width)
        flat = flat[:-step] & flat[step:]
        width += step
    out = np.zeros(cells.shape, dtype=bool)
    out.reshape(-1)[:len(flat)] = flat
    return np.ascontiguousarray(out[:, :cells.shape[1] - WIDTH + 1])


def _decide_open(grid, open_, doc, back, runs, gone) -> None:
    """Strings that the smallest documents lack: those that occur once stay, the rest goes by suffix groups."""
    r, c = np.nonzero(open_)
    rows = np.flatnonzero(open_.any(axis=1))
    value = _hashes(grid[rows], np.searchsorted(rows, r), c, 7)
    order = np.lexsort((doc[r], value))
    new = np.concatenate(([True], value[order][1:] != value[order][:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    several = doc[r][order[first]] != doc[r][order[last]]
    again = order[np.repeat(several, last - first + 1)]
    if not len(again):
        return
    r, c = r[again], c[again]
    # Of each stretch what its strings cover: stretches that share no more than these are one text.
    low, high = np.full(len(grid), _COLUMNS), np.zeros(len(grid), dtype=np.int64)
    np.minimum.at(low, r, c)
    np.maximum.at(high, r, c)
    which, place = np.unique(r, return_inverse=True)
    skip = low[which] - (_LEFT - back[which])
    covered = [runs[i][a:b] for i, a, b in zip(which, skip, skip + (high - low)[which] + WIDTH)]
    number = {t: k for k, t in enumerate(dict.fromkeys(covered))}
    text, at, name = equal_runs(list(number), WIDTH)
    names = np.zeros((len(number), _COLUMNS - WIDTH + 1), dtype=np.int64)
    names[text, at] = name
    mine = names[np.array([number[t] for t in covered])[place], c - low[r]]
    least = np.full(mine.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, mine, doc[r])
    goes = doc[r] > least[mine]
    gone[r[goes], c[goes]] = True


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_slices(batches):
        rows = []
        for text, spans in zip(texts, part.column(3).to_pylist()):
            raw, digest, at = text.encode("utf-8", "surrogatepass"), hashlib.sha256(), 0
            for span in spans:
                digest.update(raw[at:span["start"]])
                at = span["end"]
            digest.update(raw[at:])
            rows.append((sum(s["end"] - s["start"] for s in spans), len(spans), digest.hexdigest()))
        removed, n, digests = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(2), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(digests)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 50 bytes over all documents."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).mapInArrow(
        _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
