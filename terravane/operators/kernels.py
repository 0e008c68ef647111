"""Small numeric kernels on the driver or in one grouped task: assignment, linkage, selection, simplification."""

from __future__ import annotations

import numpy as np


def assign_min_cost(cost: np.ndarray) -> tuple[list[int], list[int]]:
    """Rows and columns of a one-to-one assignment of least total cost; with unequal sides the longer has unmatched entries.

    Shortest augmenting paths with potentials, one row at a time.
    """
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return [], []
    if cost.shape[0] > cost.shape[1]:
        cols, rows = assign_min_cost(cost.T)
        order = np.argsort(rows)
        return [rows[i] for i in order], [cols[i] for i in order]
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        dist, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, here, base = start, -1, 0.0
        while True:
            slack = base + cost[row] - row_price[row] - col_price
            better = ~done & (slack < dist)
            dist[better], came[better] = slack[better], here
            here = int(np.argmin(np.where(done, np.inf, dist)))
            base = dist[here]
            done[here] = True
            if owner[here] < 0:
                break
            row = owner[here]
        for c in np.flatnonzero(done):
            if owner[c] >= 0:
                row_price[owner[c]] += base - dist[c]
            col_price[c] -= base - dist[c]
        row_price[start] += base
        while here >= 0:
            before = came[here]
            owner[here] = owner[before] if before >= 0 else start
            here = before
    pairs = sorted((int(r), c) for c, r in enumerate(owner) if r >= 0)
    return [r for r, _ in pairs], [c for _, c in pairs]


def average_linkage(points: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers after merging the two clusters of least mean distance while that is at most cut; numbered by first member."""
    groups = [[i] for i in range(len(points))]
    dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    while len(groups) > 1:
        mean = np.array([[dist[np.ix_(a, b)].mean() if i < j else np.inf for j, b in enumerate(groups)] for i, a in enumerate(groups)])
        i, j = np.unravel_index(np.argmin(mean), mean.shape)
        if mean[i, j] > cut:
            break
        groups[i] += groups.pop(j)
    out = np.empty(len(points), int)
    for k, g in enumerate(sorted(groups, key=min)):
        out[g] = k
    return out


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices kept by the farthest-point rule: a stretch is split at its farthest vertex from the chord while that is beyond tolerance."""
    keep = {0, len(points) - 1}
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord = points[b] - points[a]
        rest = points[a + 1 : b] - points[a]
        length = np.hypot(*chord)
        away = np.abs(chord[0] * rest[:, 1] - chord[1] * rest[:, 0]) / length if length else np.hypot(rest[:, 0], rest[:, 1])
        far = int(np.argmax(away))
        if away[far] > tolerance:
            keep.add(a + 1 + far)
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return np.array(sorted(keep))


def thin_once(img: np.ndarray) -> np.ndarray:
    """The pixels that one round of two alternating passes takes off a mask: border pixels that do not part their neighbours. Wrong within two pixels of the array's border unless that is empty."""
    before, img = img, img.copy()
    for turn in (0, 1):
        # neighbours clockwise from above
        p = [np.roll(img, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
        total = sum(x.astype(np.int8) for x in p)
        turns = sum((~a & b).astype(np.int8) for a, b in zip(p, p[1:] + p[:1], strict=True))
        n, e, s, w = p[0], p[2], p[4], p[6]
        free = ~(n & e & s) & ~(e & s & w) if turn == 0 else ~(n & e & w) & ~(n & s & w)
        img &= ~((total >= 2) & (total <= 6) & (turns == 1) & free)
    return before & ~img


def thin(mask: np.ndarray) -> np.ndarray:
    """A one-pixel skeleton: rounds of thin_once() until nothing goes."""
    img = np.pad(mask.astype(bool), 1)
    while (gone := thin_once(img)).any():
        img &= ~gone
    return img[1:-1, 1:-1]
