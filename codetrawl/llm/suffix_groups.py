"""Suffix arrays by grouping, in linear time and without recursion.

First the suffixes are grouped by their Lyndon prefixes: groups are taken in descending order; every suffix of a group
points to the closest suffix before it that is in a smaller group (previous-smaller pointer), and those it points to
leave their groups for new ones just above, apart by how many members of the group point to them. Then the order within
groups is emitted from the smallest suffix up: each placed suffix puts the one before it, and what that points to in
turn, to the front of their groups. Nothing is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: list[int]) -> list[int]:
    """Order of the suffixes of `symbols`; a suffix that is a prefix of another comes first."""
    text = [*symbols, min(symbols, default=0) - 1]  # an end that is smaller than all and unique
    n = len(text)
    kinds = sorted(set(text))
    number = {kind: k for k, kind in enumerate(kinds)}
    group = [number[x] for x in text]
    members: list[list[int]] = [[] for _ in kinds]
    for i, g in enumerate(group):
        members[g].append(i)
    # groups in their order, as a list linked both ways; new groups get the next number
    below, above = list(range(-1, len(kinds) - 1)), [*range(1, len(kinds)), -1]

    smaller = [-1] * n  # previous-smaller pointers, as of the time their suffix's group was taken
    hop = [-1] * n      # the same, shortened when walked
    taken = bytearray(n)
    at = len(kinds) - 1
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        own.sort()
        for i in own:
            taken[i] = 1
        pointed: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and taken[j]:
                j = hop[j]
            smaller[i] = j
            k = i - 1
            while k >= 0 and taken[k]:
                k, hop[k] = hop[k], j
            hop[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        split: dict[tuple[int, int], list[int]] = {}
        for j, count in pointed.items():
            key = (-count, group[j])
            if key in split:
                split[key].append(j)
            else:
                split[key] = [j]
        for (_, old), part in sorted(split.items()):
            new = len(members)
            members.append(part)
            for j in part:
                group[j] = new
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
        at = below[at]

    sizes = [0] * len(members)
    for g in group:
        sizes[g] += 1
    lowest = 0
    while below[lowest] >= 0:
        lowest = below[lowest]
    front, start, at = [0] * len(members), 0, lowest
    while at >= 0:
        front[at] = start
        start += sizes[at]
        at = above[at]

    order, placed = [0] * n, bytearray(n)
    order[0], placed[n - 1] = n - 1, 1
    for rank in range(n):
        j = order[rank] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[front[g]] = j
            front[g] += 1
            placed[j] = 1
            j = smaller[j]
    return order[1:]


def ranks(symbols: list[int]) -> np.ndarray:
    """The rank of each suffix."""
    order = np.array(suffix_array(symbols), dtype=np.int64)
    out = np.empty(len(symbols), dtype=np.int64)
    out[order] = np.arange(len(symbols))
    return out
