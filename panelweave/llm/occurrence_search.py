"""T-occurrence search: members of many sorted lists, found without merging the long ones."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from heapq import heapify, heappop, heappush
from math import log2

import numpy as np

#: Weight of a probe against a step of the merge; balances how many lists are only probed.
PROBE_COST = 0.0085
#: Items up to which short lists are merged on a heap.
HEAP_ITEMS = 1024
#: Survivors up to which each is looked up by itself.
FEW = 8


class OverlapIndex:
    """Inverted lists over sets of distinct tokens, numbered in the order in which they come."""

    def __init__(self, sets: Sequence[np.ndarray]) -> None:
        self.sizes = [len(s) for s in sets]
        tokens = np.concatenate(sets) if sets else np.empty(0, np.int64)
        order = np.argsort(tokens, kind="stable")
        self.members = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        self.tokens, heads = np.unique(tokens[order], return_index=True)
        self.heads = np.append(heads, len(tokens))

    def lists(self, tokens: np.ndarray) -> list[np.ndarray]:
        """The lists of the distinct tokens that have one, shortest first."""
        at = np.searchsorted(self.tokens, tokens)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == tokens] if len(self.tokens) else at[:0]
        at = at[np.argsort(self.heads[at + 1] - self.heads[at], kind="stable")]
        ends = zip(self.heads[at].tolist(), self.heads[at + 1].tolist())
        return [self.members[low:high] for low, high in ends]

    def search(self, tokens: np.ndarray, least: int) -> list[tuple[int, int]]:
        """(number, overlap) of every set that shares ``least`` tokens or more with the given ones.

        The longest lists are put aside. Whoever is in ``least`` lists is in ``least`` minus that
        many of the short ones; these are merged, and only the survivors are looked up in the
        long lists by halving, until they cannot reach ``least`` any more.
        """
        lists = self.lists(tokens)
        if len(lists) < least:
            return []
        aside = min(least - 1, int(least / (PROBE_COST * log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        numbers, counts = merged(short, least - aside)
        if len(numbers) <= FEW:
            return probed(numbers.tolist(), counts.tolist(), long, least)
        for i, x in enumerate(long):
            hopeful = counts + (len(long) - i) >= least
            numbers, counts = numbers[hopeful], counts[hopeful]
            if len(numbers) == 0:
                return []
            place = np.searchsorted(x, numbers)
            place[place == len(x)] = 0
            counts = counts + (x[place] == numbers)
        done = counts >= least
        return list(zip(numbers[done].tolist(), counts[done].tolist()))


def probed(numbers: list[int], counts: list[int], long: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """The same for few survivors, one by one."""
    lists = [x.tolist() for x in long] if numbers else []
    out = []
    for number, count in zip(numbers, counts):
        for i, x in enumerate(lists):
            if count + len(lists) - i < least:
                break
            place = bisect_left(x, number)
            count += place < len(x) and x[place] == number
        if count >= least:
            out.append((number, count))
    return out


def merged(lists: list[np.ndarray], need: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are in ``need`` lists or more, ascending, with how many lists hold them.

    Lists are merged on a heap of their fronts, and numbers that cannot get there are jumped over.
    Beyond some length all lists are merged in one sort instead, which gives the same.
    """
    if sum(map(len, lists)) > HEAP_ITEMS:
        numbers, counts = np.unique(np.concatenate(lists), return_counts=True)
        return numbers[counts >= need], counts[counts >= need]
    lists = [x.tolist() for x in lists]
    at = [0] * len(lists)
    heap = [(x[0], i) for i, x in enumerate(lists)]
    heapify(heap)
    numbers, counts = [], []
    while len(heap) >= need:
        number = heap[0][0]
        popped = []
        while heap and heap[0][0] == number:
            popped.append(heappop(heap)[1])
        if len(popped) >= need:
            numbers.append(number)
            counts.append(len(popped))
            target = number + 1
        else:
            # Numbers below the need-th smallest front are in too few lists: jump to it.
            while heap and len(popped) < need - 1:
                popped.append(heappop(heap)[1])
            if not heap:
                break
            target = max(heap[0][0], number + 1)
        for i in popped:
            x = lists[i]
            at[i] = bisect_left(x, target, at[i])
            if at[i] < len(x):
                heappush(heap, (x[at[i]], i))
    return np.array(numbers, np.int32), np.array(counts, np.int64)
