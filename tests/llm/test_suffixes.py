"""Suffix arrays against sorting."""

import random

from hypothesis import given, settings, strategies as st

from almanac.llm.suffixes import equal_runs, suffix_array


@given(st.lists(st.integers(0, 3), max_size=80))
@settings(max_examples=400, deadline=None)
def test_suffix_array(letters):
    assert suffix_array(letters) == sorted(range(len(letters)), key=lambda i: letters[i:])


def test_long_and_repetitive_texts():
    r = random.Random(1)
    for letters in ([1] * 500, [1, 2] * 300, [r.randrange(200) for _ in range(3000)], [1, 1, 2, 1, 1, 2, 1, 3] * 80):
        assert suffix_array(letters) == sorted(range(len(letters)), key=lambda i: letters[i:])


def test_equal_runs():
    texts = [b"abcabc", b"xabcab", b"", b"ab"]
    names = {}
    for k, s, name in zip(*equal_runs(texts, 3)):
        names.setdefault(name, set()).add(texts[k][s:s + 3])
    assert all(len(v) == 1 for v in names.values()) and len(names) == len({x for v in names.values() for x in v})
    assert sum(1 for _ in zip(*equal_runs(texts, 3))) == 8
