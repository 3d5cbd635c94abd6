"""Suffix arrays by linear grouping (the construction of Baier, 2016).

Phase 1 sorts suffixes into groups by their Lyndon prefixes. Groups are taken in descending order. For each suffix of a group the nearest suffix before
it in a lower group (its *previous smaller* one) is found; those previous ones then leave their group for a new one right above it, higher the
more suffixes of the group point at them. Phase 2 reads the suffixes in ascending order; each places those that end at it, following the pointers,
at the front of what is left of their groups. No order is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence of nonnegative integers in ascending order; a suffix comes before those it is a prefix of."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(text, kind="stable")
    values, begin = np.unique(text[order], return_index=True)
    members = [list(x) for x in np.split(order, begin[1:])]
    members = [[int(i) for i in m] for m in members]
    group = np.searchsorted(values, text).tolist()
    above = [*range(1, len(members)), -1]  # the next higher group
    below = [-1, *range(len(members) - 1)]
    free = list(range(-1, n))  # free[i + 1]: a place at or before i from which to look for one that is in no finished group
    prev = [-1] * n
    size = [len(m) for m in members]  # of those still in the group
    g, finished = len(members) - 1, []
    while g >= 0:
        left = size[g]
        if left:
            mine = members[g]
            if left < len(mine):
                mine = [i for i in mine if group[i] == g]
            finished.append(mine)
            for i in mine:
                free[i + 1] = i - 1
            if left == 1:
                i = mine[0]
                p = free[i + 1]
                while (q := free[p + 1]) != p:
                    p = q
                free[i + 1] = prev[i] = p
                moves = (((group[p], 1), (p,)),) if p >= 0 and size[group[p]] > 1 else ()
            else:
                count: dict[int, int] = {}
                for i in mine:
                    p = free[i + 1]
                    while (q := free[p + 1]) != p:
                        p = q
                    free[i + 1] = prev[i] = p
                    if p >= 0:
                        count[p] = count.get(p, 0) + 1
                by: dict[tuple[int, int], list[int]] = {}
                for p, k in count.items():
                    if size[h := group[p]] > 1:
                        by.setdefault((h, k), []).append(p)
                moves = sorted(by.items(), reverse=True) if len(by) > 1 else by.items()
            for (h, _), moved in moves:  # more pointers first: each later one goes between the group and it
                n_moved = len(moved)
                if n_moved == size[h]:
                    continue  # all that is left of the group
                size[h] -= n_moved
                new = len(members)
                members.append(moved)
                size.append(n_moved)
                for p in moved:
                    group[p] = new
                up = above[h]
                above.append(up)
                below.append(h)
                above[h] = new
                below[up] = new
        g = below[g]
    start = [0] * len(members)
    at = 0
    for mine in reversed(finished):
        start[group[mine[0]]] = at
        at += len(mine)
    sa = [-1] * n
    placed = bytearray(n)
    j = n - 1
    for i in range(-1, n):
        if i >= 0:
            j = sa[i] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            sa[start[g]] = j
            start[g] += 1
            j = prev[j]
    return np.array(sa, np.int64)
