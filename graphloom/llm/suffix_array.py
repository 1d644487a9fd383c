"""Suffix array by linear grouping (Baier, "Linear-time Suffix Sorting", CPM 2016)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def by_symbol(symbols: np.ndarray) -> np.ndarray:
    """The places of non-negative integers in ascending order of their values: radix sorting, 16 bits at a time."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while len(symbols) and int(symbols.max()) >> shift:
        order = order[np.argsort((symbols[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """The start positions of the suffixes of ``symbols`` (integers over 0) in ascending order.

    First part: suffixes lie in groups, at first by their first symbol. Groups are taken in descending order. For each
    suffix of a group the previous smaller pointer names the nearest suffix to its left in a lower group; suffixes that
    are pointed at k times move behind those that are pointed at less often, in a new group. In the end a group holds
    the suffixes with one Lyndon prefix.
    Second part: going through the order from its start, the suffix before a placed one and the chain of its pointers
    take the next free places of their groups. Nothing is renamed and there is no recursion.
    """
    text = [*symbols, 0]
    n = len(text)
    order = by_symbol(np.array(text, np.int64)).tolist()
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for at, i in enumerate(order):
        place[i] = at
        if at and text[i] != text[order[at - 1]]:
            start = at
        group[i] = start
        size[start] += 1
    unset = -2
    smaller = [unset] * n
    end = n
    while end:
        start = group[order[end - 1]]
        pointed: dict[int, int] = {}
        for i in order[start:end]:
            p = smaller[i]
            if p == unset:
                p, passed = i - 1, []
                while p >= 0 and group[p] >= start:
                    q = smaller[p]
                    if q == unset:  # of this group, not yet seen: it has the same pointer
                        passed.append(p)
                        p -= 1
                    else:
                        p = q
                smaller[i] = p
                for j in passed:
                    smaller[j] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        end = start
        if not pointed:
            continue
        levels: dict[int, list[int]] = {}
        for p, k in pointed.items():
            levels.setdefault(k, []).append(p)
        for k in sorted(levels, reverse=True):
            moved: dict[int, int] = {}
            for p in levels[k]:
                home = group[p]
                moved[home] = m = moved.get(home, 0) + 1
                to, at = home + size[home] - m, place[p]
                other = order[to]
                order[to], order[at] = p, other
                place[p], place[other] = to, at
            for home, m in moved.items():
                if m < size[home]:
                    size[home] -= m
                    new = home + size[home]
                    size[new] = m
                    for p in order[new : new + m]:
                        group[p] = new
    free = list(range(n))
    done = [False] * n
    sorted_ = [n - 1] * n
    done[n - 1] = True
    for at in range(n):
        i = sorted_[at] - 1
        while i >= 0 and not done[i]:
            home = group[i]
            sorted_[free[home]] = i
            free[home] += 1
            done[i] = True
            i = smaller[i]
    return sorted_[1:]
