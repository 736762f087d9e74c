"""Suffix sorting by linear grouping of Lyndon prefixes.

Suffixes are grouped by their first sign at first, and groups keep the slots their members will have
in the suffix array, so a group is named by its first slot. In the first phase groups are processed
from the largest to the smallest. A suffix of the group looks up its previous smaller suffix; that
one's Lyndon prefix goes on with the group's own, and it moves up, in its own group's slots, above
those for which that is not so, and the more often the higher. In the second phase suffixes come out
in ascending order: along the previous-smaller pointers from the place before each sorted suffix,
all suffixes take the next slot of their groups. Nothing is renamed or sorted recursively.
"""

from __future__ import annotations

from collections import defaultdict
from heapq import heapify, heappop, heappush


def suffix_array(text: bytes) -> list[int]:
    """Start positions of the suffixes of ``text`` in ascending order; shorter ones come first on ties."""
    n = len(text)
    if n < 2:
        return list(range(n))
    group, smaller = _group(text)
    return _emit(n, group, smaller)


def _group(text: bytes) -> tuple[list[int], list[int]]:
    """The first slot of each suffix's group, and the previous smaller suffix of each (-1: none)."""
    n = len(text)
    members: dict[int, list[int]] = {}
    by_sign: dict[int, list[int]] = defaultdict(list)
    for i, sign in enumerate(text):
        by_sign[sign].append(i)
    group, sizes, start = [0] * n, {}, 0
    for sign in sorted(by_sign):
        own = by_sign[sign]
        members[start], sizes[start] = own, len(own)
        for i in own:
            group[i] = start
        start += len(own)
    smaller = [-1] * n
    heap = [-s for s in members]  # groups are met from the largest down; new ones are always smaller
    heapify(heap)
    while heap:
        now = -heappop(heap)
        times: dict[int, int] = {}
        for i in members.pop(now):
            if group[i] != now:
                continue  # it has moved up
            p = i - 1
            while p >= 0 and group[p] >= now:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if not times:
            continue
        moving: dict[int, dict[int, list[int]]] = {}
        for p, k in times.items():
            moving.setdefault(group[p], {}).setdefault(k, []).append(p)
        for old, by_times in moving.items():
            size = sizes[old]
            for k in sorted(by_times, reverse=True) if len(by_times) > 1 else by_times:
                own = by_times[k]
                size -= len(own)
                if not size:
                    break  # what is left of the group is just these
                new = old + size
                own.sort()
                members[new], sizes[new] = own, len(own)
                heappush(heap, -new)
                for p in own:
                    group[p] = new
            sizes[old] = size or len(own)
    return group, smaller


def _emit(n: int, group: list[int], smaller: list[int]) -> list[int]:
    out, placed = [0] * n, bytearray(n)
    s, i = n - 1, 0
    slot = list(range(n))  # by first slot of a group: its next free one
    while True:
        while s >= 0 and not placed[s]:
            g = group[s]
            out[slot[g]] = s
            slot[g] += 1
            placed[s] = 1
            s = smaller[s]
        if i == n:
            return out
        s = out[i] - 1
        i += 1
