"""Token ids of whole texts, with a per-worker memory of what words encode to.

The ids are those of the ``tokenizers`` library. A byte-level vocabulary cuts a text before every single space between
two words, and between letters, digits and signs, and never joins across such a cut; the pieces repeat, so each distinct one is
encoded once and then looked up. All cuts of a slice of texts are found at once in its bytes, and all its distinct pieces
are looked up at once, in Arrow arrays. Texts with other runs of white space are encoded whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Distinct pieces of text remembered per worker, and the bytes of them and their ids; beyond that the half used least
# lately is forgotten.
PIECES = 1_200_000
PIECE_BYTES = 128_000_000

# Kinds of bytes for the cuts. Between letters, digits, signs and a line end the pattern of byte-level vocabularies always
# cuts; apostrophes, other white space and other characters beyond ASCII follow rules of their own.
_SPACE, _LETTER, _DIGIT, _SIGN, _LINE_END, _OTHER = range(6)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[[0x20, 0x0A, 0x27]] = _SPACE, _LINE_END, _OTHER

# Characters of two bytes that are letters in the oldest and the newest Unicode known here, and so in all between.
_LETTERS = np.array([
    c >= 0x80 and all(u.category(chr(c))[0] == "L" for u in (unicodedata.ucd_3_2_0, unicodedata)) for c in range(0x800)
])

# White space: in ASCII, and the UTF-8 bytes of all other.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_WIDE_BLANKS = [chr(c).encode() for c in range(0x80, 0x10000) if chr(c).isspace()]
_BLANKS = {n: np.array([int.from_bytes(b) for b in _WIDE_BLANKS if len(b) == n]) for n in (2, 3)}


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (none null) side by side, and where each begins (one more at the end)."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def _odd(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts hold a space that touches white space or an end of the text, and so does not begin a word of its own."""
    out = np.zeros(len(bounds) - 1, dtype=bool)
    spaces = np.flatnonzero(raw == 0x20)
    if not len(spaces):
        return out
    near = np.concatenate((np.full(3, 0x20, dtype=np.uint8), raw, np.full(3, 0x20, dtype=np.uint8)))
    before, after = near[spaces + 2], near[spaces + 4]
    blank = _BLANK[before] | _BLANK[after]
    # Wider white space: its bytes as one number, big end first.
    for side, places in ((before, (0, 1, 2)), (after, (4, 5, 6))):
        wide = np.flatnonzero(side >= 0x80)
        a, b, c = (near[spaces[wide] + k].astype(np.int64) for k in places)
        two, three = (b << 8 | c if side is before else a << 8 | b), a << 16 | b << 8 | c
        blank[wide[np.isin(two, _BLANKS[2]) | np.isin(three, _BLANKS[3])]] = True
    filled = np.flatnonzero(np.diff(bounds))
    first = bounds[filled]
    out[filled] = (raw[first] == 0x20) | (raw[bounds[filled + 1] - 1] == 0x20)
    # What stands beside a space at an end is of another text, but then the text is odd anyway.
    out[np.searchsorted(bounds, spaces[blank], side="right") - 1] = True
    return out


def _pieces(raw: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Texts cut where a byte-level vocabulary always cuts: the pieces of all, and the first of each text (one more at
    the end).

    Words of ASCII and of letters of two bytes are cut before their space and where the kind of their characters changes; all
    others, and those with an apostrophe or several line ends in a row, only before their space.
    """
    kind = _KIND[raw]
    other = np.flatnonzero(kind == _OTHER)
    lead = other[(raw[other] >= 0xC2) & (raw[other] < 0xE0)]
    lead = lead[_LETTERS[(raw[lead] & 0x1F).astype(np.int64) << 6 | raw[lead + 1] & 0x3F]]
    kind[lead] = kind[lead + 1] = _LETTER
    ends = np.flatnonzero(kind == _LINE_END)
    hard = np.union1d(other[kind[other] == _OTHER], ends[1:][np.diff(ends) == 1])
    changes = np.ones(len(raw), dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=changes[1:])
    changes[1:] &= kind[:-1] != _SPACE
    first = bounds[:-1][np.diff(bounds) > 0]
    changes[first] = True
    start = np.flatnonzero(changes)
    if len(hard):
        begins = raw[start] == 0x20  # a word
        begins[np.searchsorted(start, first)] = True
        word = np.cumsum(begins) - 1
        whole = np.zeros(int(word[-1]) + 1, dtype=bool)
        whole[word[np.searchsorted(start, hard, side="right") - 1]] = True
        start = start[begins | ~whole[word]]
    offsets = np.append(start, len(raw)).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return pieces.dictionary_encode(), np.searchsorted(start, bounds)


class _Memory:
    """What pieces were encoded to lately: about ``most`` of them, in the order they came."""

    def __init__(self, most: int):
        self._most, self._turn = most, 0
        self._pieces = self._ids = pa.array([], pa.large_binary())
        self._used = np.zeros(0, dtype=np.int64)

    def ids_of(self, pieces: pa.Array, encoded: Callable[[list[str]], list[bytes]]) -> pa.Array:
        """The ids of distinct pieces; those that are not known are ``encoded`` and learnt."""
        place = pc.fill_null(pc.index_in(self._pieces, value_set=pieces), -1).to_numpy()
        hit = np.flatnonzero(place >= 0)
        number = np.full(len(pieces), -1, dtype=np.int64)
        number[place[hit]] = hit
        fresh = np.flatnonzero(number < 0)
        number[fresh] = len(self._pieces) + np.arange(len(fresh))
        new = pieces.take(pa.array(fresh))
        found = pa.array(encoded(new.cast(pa.large_string()).to_pylist()), pa.large_binary())
        self._pieces, self._ids = pa.concat_arrays([self._pieces, new]), pa.concat_arrays([self._ids, found])
        self._used = np.concatenate((self._used, np.zeros(len(fresh), dtype=np.int64)))
        self._turn += 1
        self._used[number] = self._turn
        ids = self._ids.take(pa.array(number))
        if len(self._pieces) > self._most or self._pieces.nbytes + self._ids.nbytes > PIECE_BYTES:
            kept = pa.array(np.sort(np.argsort(-self._used, kind="stable")[:len(self._pieces) // 2]))
            self._pieces, self._ids, self._used = self._pieces.take(kept), self._ids.take(kept), self._used[kept.to_numpy()]
        return ids


class Encoder:
    """Encodes texts with one tokenizer file, given as its JSON."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        self._tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        self._by_words = _cuts_before_spaces(tokenizer_json)
        self._known = _Memory(PIECES)

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; a null text has none."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        odd = _odd(*_bytes_of(texts)) if self._by_words else np.ones(len(texts), dtype=bool)
        if not odd.any():
            return self._by_word(texts)
        out = [b""] * len(texts)
        for mine, found in (
            (odd, self._encoded(texts.filter(pa.array(odd)).to_pylist())), (~odd, self._by_word(texts.filter(pa.array(~odd)))),
        ):
            for i, ids in zip(np.flatnonzero(mine).tolist(), found):
                out[i] = ids
        return out

    def _by_word(self, texts: pa.Array) -> list[bytes]:
        """Texts with single spaces between words: every distinct piece is looked up once, its ids are copied by place."""
        raw, bounds = _bytes_of(texts)
        if not len(raw):
            return [b""] * len(texts)
        pieces, first = _pieces(raw, bounds)
        ids = self._known.ids_of(pieces.dictionary, self._encoded).take(pieces.indices)
        found, cut = _bytes_of(ids)
        found, cut = found.tobytes(), cut[first].tolist()
        return [found[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [array("I", f.ids).tobytes() for f in found]


def _cuts_before_spaces(tokenizer_json: str) -> bool:
    """Whether the file is byte-level with the usual pattern, so that words can be encoded one by one."""
    parts = json.loads(tokenizer_json)
    first = parts.get("pre_tokenizer") or {}
    return (
        first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and bool(first.get("use_regex", True))
        and not parts.get("normalizer") and not (parts.get("post_processor") or {}).get("add_prefix_space")
    )


_encoders: dict[int, Encoder] = {}


def encoder_of(tokenizer_json: str) -> Encoder:
    """The worker's encoder for a file; it outlives the task, so that later tasks know its words."""
    key = hash(tokenizer_json)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def batches_of(texts: list, chars: int = 2_000_000):
    """Ranges of consecutive texts with about ``chars`` characters each; a longer text stands alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if i > start and held + size > chars:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)
