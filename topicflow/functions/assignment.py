"""Minimum-cost assignment for one small cost matrix (shortest augmenting paths)."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> np.ndarray:
    """Column for each row of an ``n x m`` matrix (n <= m) with the least total cost.

    Row by row, a Dijkstra search over reduced costs finds the cheapest
    augmenting path; duals are updated so that reduced costs stay non-negative.
    """
    n, m = cost.shape
    if n > m:
        raise ValueError("more sources than targets")
    row_dual, col_dual = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        dist = cost[start] - row_dual[start] - col_dual
        came_from = np.full(m, start)
        done = np.zeros(m, dtype=bool)
        while True:
            open_dist = np.where(done, np.inf, dist)
            j = int(open_dist.argmin())
            reach = open_dist[j]
            if owner[j] < 0:
                break
            done[j] = True
            i = owner[j]
            through = reach + cost[i] - row_dual[i] - col_dual
            better = ~done & (through < dist)
            dist = np.where(better, through, dist)
            came_from[better] = i
        # settled columns and the rows that own them move by their slack
        slack = reach - dist[done]
        row_dual[owner[done]] += slack
        col_dual[done] -= slack
        row_dual[start] += reach
        while True:
            i = came_from[j]
            owner[j], previous = i, np.flatnonzero(owner == i)
            if i == start:
                break
            j = int(previous[previous != j][0])
    result = np.empty(n, dtype=np.int64)
    taken = owner >= 0
    result[owner[taken]] = np.flatnonzero(taken)
    return result


def auction(cost: np.ndarray, target: np.ndarray, n_targets: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Target of each of ``n`` sources that know a few targets each, and the targets' final prices.

    ``cost`` and ``target`` are ``n x w``, padded with infinite costs; some complete match must be among the cells.  All
    sources without a target bid at once for the one that is cheapest with its price, by as much as it beats their
    second choice, plus a step; the highest bid has it.  Steps shrink from the range of costs to ``least``, each phase
    starting from the prices of the one before.  The total is within ``n * least`` of the best.
    """
    n = len(cost)
    finite = cost[np.isfinite(cost)]
    span = finite.max() - finite.min()
    price = np.zeros(n_targets)
    step = max(span / 4, least)
    while True:
        owner = np.full(n_targets, -1)
        chosen = np.full(n, -1)
        free = np.arange(n)
        while free.size:
            total = cost[free] + price[target[free]]
            best = total.argmin(axis=1)
            row = np.arange(free.size)
            low = total[row, best]
            total[row, best] = np.inf
            # a source that knows one target only outbids by the whole range
            ahead = np.minimum(total.min(axis=1) - low, n * span + step)
            wanted = target[free, best]
            bid = price[wanted] + ahead + step
            order = np.lexsort((bid, wanted))
            wins = order[np.append(wanted[order][1:] != wanted[order][:-1], True)]
            sold, buyer = wanted[wins], free[wins]
            before = owner[sold]
            before = before[before >= 0]
            chosen[before] = -1
            owner[sold], price[sold], chosen[buyer] = buyer, bid[wins], sold
            lost = np.ones(free.size, bool)
            lost[wins] = False
            free = np.concatenate([free[lost], before])
        if step <= least:
            return chosen, price
        step = max(step / 5, least)
