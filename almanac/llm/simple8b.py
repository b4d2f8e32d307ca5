"""Simple-8b: unsigned numbers in 64-bit words, in blocks that decode at once.

The top four bits of a word select how the other 60 are cut: into ``n`` numbers of ``b`` bits. Selector
15 is an escape: the next word is one number of up to 64 bits. A record holds numbers in blocks of
``BLOCK``; the offset of each block's first word stands before the words, so that blocks can be read
alone and all words of a record are decoded selector by selector, not one by one.

Record, little-endian: ``S8B1``, u32 numbers, u32 blocks, u32 words, u32 offset per block, u64 per word.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512
MAGIC = b"S8B1"

# Fixed values of the format: bits and numbers per word, by selector.
CUTS = (
    (1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1),
)
ESCAPE = 15

_SHIFT = np.uint64(60)
_COUNTS = np.array([n for _, n in CUTS] + [0, 1])


def encode(values: np.ndarray) -> bytes:
    """A record of the numbers, in order."""
    values = np.asarray(values, dtype=np.uint64)
    total = len(values)
    blocks = -(-total // BLOCK)
    selector = _selectors(values)
    # Every block walks from word to word at the same time as all others; a row holds one step of all of them.
    at = np.arange(blocks, dtype=np.int64) * BLOCK
    ends = np.minimum(at + BLOCK, total)
    steps, live = [], np.arange(blocks)
    while len(live):
        step = np.full(blocks, -1, dtype=np.int64)
        step[live] = at[live]
        steps.append(step)
        at[live] += _COUNTS[selector[at[live]]]
        live = live[at[live] < ends[live]]
    start = np.stack(steps, axis=1).reshape(-1) if steps else np.zeros(0, dtype=np.int64)
    start = start[start >= 0]
    chosen = selector[start]
    width = np.where(chosen == ESCAPE, 2, 1)
    place = np.concatenate(([0], np.cumsum(width)))
    words = np.zeros(int(place[-1]), dtype=np.uint64)
    stop = ends[start // BLOCK]
    padded = np.concatenate((values, np.zeros(int(_COUNTS.max()), dtype=np.uint64)))
    for s, (bits, count) in enumerate(CUTS):
        mine = np.flatnonzero(chosen == s)
        if not len(mine):
            continue
        first = start[mine]
        word = padded[first]
        for k in range(1, count):
            word |= padded[first + k] << np.uint64(bits * k)
        # The last word of a block may have room left: what follows is not its own.
        room = stop[mine] - first
        last = np.flatnonzero(room < count)
        word[last] &= (np.uint64(1) << (bits * room[last]).astype(np.uint64)) - np.uint64(1)
        words[place[:-1][mine]] = word | np.uint64(s) << _SHIFT
    mine = np.flatnonzero(chosen == ESCAPE)
    words[place[:-1][mine]] = np.uint64(ESCAPE) << _SHIFT
    words[place[:-1][mine] + 1] = values[start[mine]]
    firsts = place[:-1][np.searchsorted(start, np.arange(blocks) * BLOCK)]
    head = np.array([total, blocks, len(words)], dtype="<u4").tobytes()
    return MAGIC + head + firsts.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def _widths(values: np.ndarray) -> np.ndarray:
    """The bits of each number, as bytes."""
    high = values >> np.uint64(32)
    out = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1].astype(np.uint8)
    if high.any():
        above = np.flatnonzero(high)
        out[above] = np.frexp(high[above].astype(np.float64))[1] + 32
    return out


def _selectors(values: np.ndarray) -> np.ndarray:
    """For a word that begins at each number, the selector that takes most numbers of its block."""
    total, most = len(values), int(_COUNTS.max())
    if not total:
        return np.zeros(0, dtype=np.int64)
    blocks = -(-total // BLOCK)
    # Behind each block stand numbers without bits, so that they never keep a word from taking the rest of it.
    widths = np.zeros(blocks * BLOCK, dtype=np.uint8)
    widths[:total] = _widths(values)
    rows = np.zeros((blocks, BLOCK + most), dtype=np.uint8)
    rows[:, :BLOCK] = widths.reshape(blocks, BLOCK)
    out = np.full(rows.size, ESCAPE, dtype=np.uint8)
    widest, n = rows.reshape(-1), 1  # the most bits of the n numbers from each place on
    for s in range(len(CUTS) - 1, -1, -1):
        bits, count = CUTS[s]
        while n < count:
            step = min(n, count - n)
            widest = np.maximum(widest, np.concatenate((widest[step:], np.zeros(step, dtype=np.uint8))))
            n += step
        np.copyto(out, np.uint8(s), where=widest <= bits)
    return out.reshape(blocks, BLOCK + most)[:, :BLOCK].reshape(-1)[:total].astype(np.int64)


def decode(record: bytes) -> np.ndarray:
    """The numbers of a record."""
    if record[:4] != MAGIC:
        raise ValueError("not a Simple-8b record")
    total, blocks, n_words = np.frombuffer(record, dtype="<u4", count=3, offset=4)
    at = 16 + 4 * int(blocks)
    firsts = np.frombuffer(record, dtype="<u4", count=int(blocks), offset=16).astype(np.int64)
    words = np.frombuffer(record, dtype="<u8", count=int(n_words), offset=at)
    chosen = (words >> _SHIFT).astype(np.int64)
    raw = _after_escapes(chosen)
    # What the selectors say, cut off at the end of each block.
    counts = np.where(raw, 0, _COUNTS[chosen])
    block = np.searchsorted(firsts, np.arange(len(words)), side="right") - 1
    before = np.concatenate(([0], np.cumsum(counts)))[:-1]
    start = before - before[firsts][block] + block * BLOCK if len(words) else before
    out = np.zeros(int(total) + int(_COUNTS.max()), dtype=np.uint64)
    # Later words overwrite the unused room of earlier ones, so blocks are filled back to front in room only.
    ends = np.minimum((block + 1) * BLOCK, int(total))
    for s, (bits, count) in enumerate(CUTS):
        mine = np.flatnonzero((chosen == s) & ~raw)
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            inside = start[mine] + k < ends[mine]
            out[start[mine][inside] + k] = (words[mine][inside] >> np.uint64(bits * k)) & mask
    mine = np.flatnonzero((chosen == ESCAPE) & ~raw)
    out[start[mine]] = words[mine + 1] if len(mine) else 0
    return out[:int(total)]


def _after_escapes(chosen: np.ndarray) -> np.ndarray:
    """Which words hold the number of the escape before them."""
    marked = chosen == ESCAPE
    out = np.zeros(len(chosen), dtype=bool)
    if marked.any():
        for i in np.flatnonzero(marked):
            if not out[i] and i + 1 < len(out):
                out[i + 1] = True
    return out
