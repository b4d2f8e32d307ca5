"""Suffix sorting by grouping, in linear time and without renaming the text.

Suffixes are grouped by the longest Lyndon word they begin with (one smaller than all its own proper
suffixes). At first that word is one letter. Groups are taken from the highest to the lowest: where the
words of a group stand, alone or several in a row, the nearest earlier position not yet taken (the
previous smaller one) grows its own word by them and moves to a group right above its old one. Then the
groups are in order, and what follows the word of a suffix is a smaller suffix: walking the suffixes in
ascending order puts each one behind the last of its group.
"""

from __future__ import annotations

import numpy as np


def suffix_array(letters: list[int]) -> list[int]:
    """The starts of all suffixes in ascending order; the end of the text is below every letter."""
    n = len(letters)
    if not n:
        return []
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))  # neighbours among positions not yet taken
    alphabet = sorted(set(letters))
    name = {letter: g for g, letter in enumerate(alphabet)}
    group = [name[letter] for letter in letters]
    members: list[list[int]] = [[] for _ in alphabet]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(alphabet) - 1))
    above = list(range(1, len(alphabet))) + [-1]
    top = len(alphabet) - 1
    end = [0] * n  # where the final word of each position ends

    g = top
    while g >= 0:
        moved: dict[tuple[int, int], list[int]] = {}
        for i in members[g]:
            if group[i] != g or end[i]:
                continue
            # The first of a row of equal words, and the position behind the row.
            while left[i] >= 0 and group[left[i]] == g and not end[left[i]]:
                i = left[i]
            p, count = left[i], 0
            while i < n and group[i] == g:
                end[i] = i = right[i]
                count += 1
            if p >= 0:
                right[p] = i
                moved.setdefault((group[p], count), []).append(p)
            if i < n:
                left[i] = p
        lowest = {}
        for u, count in sorted(moved):
            at = lowest.get(u, u)
            new = len(members)
            members.append(moved[u, count])
            for p in members[new]:
                group[p] = new
            below.append(at)
            above.append(above[at])
            if above[at] >= 0:
                below[above[at]] = new
            else:
                top = new
            above[at] = new
            lowest[u] = new
        g = below[g]

    # Groups in ascending order, and the suffixes by the place where their word ends.
    first = below.index(-1)
    slot, at, g = [0] * len(members), 0, first
    sizes = [0] * len(members)
    for g_of in group:
        sizes[g_of] += 1
    while g >= 0:
        slot[g], at, g = at, at + sizes[g], above[g]
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for i in range(n):
        ending[end[i]].append(i)
    order = [0] * n
    for j in range(-1, n):
        for i in ending[n if j < 0 else order[j]]:
            order[slot[group[i]]] = i
            slot[group[i]] += 1
    return order


def equal_runs(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all runs of ``width`` bytes in the texts: text, start and name; equal names, equal runs.

    One suffix array over all texts, with a letter below all bytes after each; neighbours in its
    order are compared.
    """
    letters, text, start = [], [], []
    for k, t in enumerate(texts):
        letters += [b + 1 for b in t] + [0]
        text += [k] * (len(t) + 1)
        start += range(len(t) + 1)
    rows, last, name = [], None, -1
    for i in suffix_array(letters):
        k, s = text[i], start[i]
        if len(texts[k]) - s >= width:
            run = texts[k][s:s + width]
            name += run != last
            last = run
            rows.append((k, s, name))
    return tuple(np.array(rows, dtype=np.int64).reshape(-1, 3).T)
