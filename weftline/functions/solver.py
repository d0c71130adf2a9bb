"""Rectangular assignment by shortest augmenting paths, component by component."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a least-cost assignment of the shorter side."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    row_price, col_price = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0] = i
        at = 0
        slack = np.full(m + 1, np.inf)
        before = np.zeros(m + 1, dtype=int)
        done = np.zeros(m + 1, dtype=bool)
        while owner[at]:
            done[at] = True
            r = owner[at]
            open_ = ~done
            open_[0] = False
            reduced = cost[r - 1] - row_price[r] - col_price[1:]
            better = open_[1:] & (reduced < slack[1:])
            slack[1:][better] = reduced[better]
            before[1:][better] = at
            free = np.flatnonzero(open_)
            nearest = free[np.argmin(slack[free])]
            step = slack[nearest]
            row_price[owner[done]] += step
            col_price[done] -= step
            slack[open_] -= step
            at = nearest
        while at:
            owner[at] = owner[before[at]]
            at = before[at]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def components(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component number of each pair (a[i], b[i]) of a bipartite graph."""
    (left, x), (right, y) = (np.unique(k, return_inverse=True) for k in (a, b))
    parent = list(range(len(left) + len(right)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    x = x.tolist()
    for i, j in zip(x, (y + len(left)).tolist(), strict=True):
        r, s = find(i), find(j)
        if r != s:
            parent[max(r, s)] = min(r, s)
    names: dict = {}
    return np.array([names.setdefault(find(i), len(names)) for i in x], dtype=int)


def match_pairs(a: np.ndarray, b: np.ndarray, d: np.ndarray, infeasible: float, group: np.ndarray | None = None) -> np.ndarray:
    """Which candidate pairs an optimal one-to-one matching takes. ``group`` numbers the pairs' components, if they are known.

    Pairs that are no candidates cost ``infeasible``: far above all distances, most pairs come before least distance;
    just above the gate, the sum of (infeasible - d) is maximal instead. Ties go to smaller distances and ids.
    """
    take = np.zeros(len(d), dtype=bool)
    if not len(d):
        return take
    group = components(a, b) if group is None else group
    order = np.lexsort((b, a, d, group))
    # each component is a run of the order, so that a frame of many components is passed once
    begin = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    one = [np.minimum.reduceat(x[order], begin) == np.maximum.reduceat(x[order], begin) for x in (a, b)]
    star = one[0] | one[1]  # all pairs share an end: the first one is the best
    take[order[begin[star]]] = d[order[begin[star]]] <= infeasible
    end = np.r_[begin[1:], len(order)]
    for first, last in zip(begin[~star].tolist(), end[~star].tolist(), strict=True):
        rows = order[first:last]
        left, right = np.unique(a[rows]), np.unique(b[rows])
        cost = np.full((left.size, right.size), float(infeasible))
        index = np.full(cost.shape, -1)
        i, j = np.searchsorted(left, a[rows]), np.searchsorted(right, b[rows])
        for r, x, y in zip(rows[::-1], i[::-1], j[::-1], strict=True):
            if d[r] <= cost[x, y]:
                cost[x, y], index[x, y] = d[r], r
        for x, y in assign(cost):
            if index[x, y] >= 0:
                take[index[x, y]] = True
    return take
