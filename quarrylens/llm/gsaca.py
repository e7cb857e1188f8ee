"""Suffix array by linear grouping: Lyndon-prefix groups, then a non-recursive emission.

Phase one keeps the suffixes in groups that are intervals of the final order.  Groups are taken from the
highest to the lowest.  Each suffix of a group finds its previous smaller suffix by hopping over pointers
that are already known; the suffixes so pointed at leave their group and form new groups right above it,
those hit more often further up.  In the end each group holds the suffixes of one Lyndon prefix.
Phase two walks the order from the smallest suffix on and places each predecessor, and its chain of previous
smaller suffixes, at the next free place of its group.  No renaming, no recursion, and no comparison sort: members of a
group stay in order of place, as a later suffix never points before where an earlier one of its group points.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of an integer sequence; the end of the sequence counts as smaller than any symbol.

    Empty input: empty array.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    # place 0 is the end mark; group id = first place of the group in the final order
    symbols = np.asarray(symbols)
    low = symbols.min()
    if symbols.max() - low < 1 << 16:
        symbols = (symbols - low).astype(np.uint16)  # a stable sort of such numbers goes digit by digit
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(fresh)
    size_of = np.diff(np.append(first, n))
    group_np = np.empty(n + 1, np.int64)
    group_np[order] = np.repeat(first, size_of) + 1
    group_np[n] = 0
    group = group_np.tolist()
    size = [0] * (n + 1)
    begin_at = [0] * (n + 1)  # by last place of a group: its first place
    members: list = [None] * (n + 1)
    listed = order.tolist()
    for f, s in zip(first.tolist(), size_of.tolist()):
        size[f + 1] = s
        begin_at[f + s] = f + 1
        members[f + 1] = listed[f : f + s]
    prev = [-1] * (n + 1)

    last = n
    while last > 0:
        start = begin_at[last]
        held = members[start]
        members[start] = None
        if last == start:
            i = -1
            for i in held:
                if group[i] == start:
                    break
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                g = group[p]
                s = size[g]
                if s > 1:
                    end = g + s - 1
                    size[g] = s - 1
                    begin_at[end - 1] = g
                    group[p] = end
                    size[end] = 1
                    begin_at[end] = end
                    members[end] = (p,)
            last = start - 1
            continue
        held = [i for i in held if group[i] == start]  # by place, as all lists of members are: pointers never cross
        hits: dict[int, int] = {}
        for i in held:
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        if hits:
            by_count: dict[int, dict[int, list[int]]] = {}
            for p, c in hits.items():
                by_count.setdefault(c, {}).setdefault(group[p], []).append(p)
            for c in sorted(by_count, reverse=True):  # a group of m has at most sqrt(2 m) different counts, so this is within m
                for g, moved in by_count[c].items():
                    s, m = size[g], len(moved)
                    if m == s:
                        continue
                    end = g + s - 1
                    new = end - m + 1
                    size[g] = s - m
                    begin_at[new - 1] = g
                    size[new] = m
                    begin_at[end] = new
                    members[new] = moved
                    for p in moved:
                        group[p] = new
        last = start - 1

    out = [-1] * (n + 1)
    out[0] = n
    free = list(range(n + 1))
    for k in range(n + 1):
        s = out[k] - 1
        while s >= 0:
            g = group[s]
            if g < 0:
                break
            at = free[g]
            free[g] = at + 1
            out[at] = s
            group[s] = -1
            s = prev[s]
    return np.asarray(out[1:], np.int64)
