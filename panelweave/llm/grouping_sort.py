"""Suffix array by linear grouping: Lyndon-prefix groups first, then the order inside each group."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of an integer sequence in ascending order.

    The first phase begins with one group per first symbol and takes the groups in descending
    order. Each member points to the nearest position before it in a lower group (its
    previous-smaller pointer; pointers of higher groups are jumped over). Positions hit by
    pointers leave their group for new groups right behind it, those hit more often further
    behind. In the end a group holds the suffixes with one and the same Lyndon prefix.

    The second phase fills the groups from the front: whoever stands before the next suffix in
    order, and whatever the pointers lead to from there, comes next in its group. Nothing is
    renamed and nothing recurses.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    starts = np.concatenate(([0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1))
    sizes = np.diff(np.append(starts, n))
    group_of, place_of, size_of = (np.zeros(n, np.int64) for _ in range(3))
    group_of[order] = np.repeat(starts, sizes)
    place_of[order] = np.arange(n)
    size_of[starts] = sizes
    slots, place, size = order.tolist(), place_of.tolist(), size_of.tolist()
    # Position -1 stands before the text, in a group below all others; Python's index -1 finds it.
    group, before = [*group_of.tolist(), -1], [-1] * n

    end = n - 1
    while end >= 0:
        low = group[slots[end]]
        if low == end:
            i = slots[end]
            j = i - 1
            while group[j] > low:
                j = before[j]
            before[i] = j
            if j >= 0:
                old = group[j]
                left = size[old] - 1
                if left:
                    size[old] = left
                    new = old + left
                    other, at = slots[new], place[j]
                    slots[at], place[other] = other, at
                    slots[new], place[j] = j, new
                    group[j], size[new] = new, 1
        else:
            hits: dict[int, int] = {}
            for i in sorted(slots[low : end + 1]):
                j = i - 1
                while group[j] >= low:
                    j = before[j]
                before[i] = j
                hits[j] = hits.get(j, 0) + 1
            hits.pop(-1, None)
            leaving: dict[tuple[int, int], list[int]] = {}
            for j, count in hits.items():
                leaving.setdefault((-count, group[j]), []).append(j)
            for (_, old), members in sorted(leaving.items()):
                left = size[old] - len(members)
                if left == 0:
                    continue
                size[old] = left
                new = old + left
                last = new + len(members)
                for j in members:
                    last -= 1
                    other, at = slots[last], place[j]
                    slots[at], place[other] = other, at
                    slots[last], place[j] = j, last
                    group[j] = new
                size[new] = len(members)
        end = low - 1

    result = [0] * n
    front = list(range(n))
    placed = bytearray(n + 1)
    placed[n] = 1
    j = n - 1
    for i in range(n):
        while not placed[j]:
            at = front[group[j]]
            front[group[j]] = at + 1
            result[at] = j
            placed[j] = 1
            j = before[j]
        j = result[i] - 1
    return np.array(result, np.int64)
