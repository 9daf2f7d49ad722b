"""Boxes around vectors of few dimensions: where rows lie, and exact neighbours inside one task.

A distance to a box is never more than that to a row in it: differences, squares, their sum in one order and the root are each
rounded monotonically, so a box is ruled out without room for error; ``MARGIN`` is kept all the same.
"""

from __future__ import annotations

import numpy as np

#: Rows of a leaf, and queries that are measured together.
LEAF = 64
GROUP = 32
#: Leaves that a group of queries meets first; each turn takes ``WIDER`` times as many.
FIRST = 8
WIDER = 4
MARGIN = 1 + 1e-9
#: Share of the squared lengths that a squared distance from a matrix product may be off.
SLACK = 1e-12


class Splits:
    """Halves a sample along its widest axis until a box holds at most ``most`` of its rows; equal rows share a box."""

    def __init__(self, points: np.ndarray, most: int):
        self.axis, self.at, self.lower, self.upper, self.boxes = [], [], [], [], 0
        left = [(np.arange(len(points)), -1, False)]
        while left:
            rows, parent, above = left.pop()
            node = len(self.axis)
            if parent >= 0:
                (self.upper if above else self.lower)[parent] = node
            part = points[rows]
            axis = int(np.ptp(part, axis=0).argmax()) if len(rows) else 0
            values = np.sort(part[:, axis])
            if len(rows) <= max(1, most) or values[0] == values[-1]:
                self._add(-1, 0.0, self.boxes)
                self.boxes += 1
                continue
            at = values[(len(values) - 1) // 2]
            if at == values[-1]:
                at = values[values < at][-1]
            self._add(axis, at, 0)
            below = part[:, axis] <= at
            left += [(rows[~below], node, True), (rows[below], node, False)]
        self.axis, self.at = np.array(self.axis), np.array(self.at)
        self.lower, self.upper = np.array(self.lower), np.array(self.upper)

    def _add(self, axis: int, at: float, lower: int) -> None:
        """A node; one without an axis is a box, and ``lower`` is its number."""
        self.axis.append(axis)
        self.at.append(at)
        self.lower.append(lower)
        self.upper.append(0)

    def box_of(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), int)
        while len(inner := np.flatnonzero(self.axis[node] >= 0)):
            here = node[inner]
            below = rows[inner, self.axis[here]] <= self.at[here]
            node[inner] = np.where(below, self.lower[here], self.upper[here])
        return self.lower[node]


def distances(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """From every row to every box; infinite to a box that holds nothing (``low`` above ``high``)."""
    total = np.zeros((len(rows), len(low)))
    for part, least, most in zip(rows.T, low.T, high.T, strict=True):
        gap = np.maximum(least[None, :] - part[:, None], part[:, None] - most[None, :])
        np.maximum(gap, 0.0, out=gap)
        gap *= gap
        total += gap
    return np.sqrt(total, out=total)


def leaves(rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of rows that lie together, at most ``most`` each; leaves that follow each other lie close."""
    left, found = [np.arange(len(rows))] if len(rows) else [], []
    while left:
        places = left.pop()
        if len(places) <= most:
            found.append(places)
            continue
        part = rows[places]
        half = len(places) // 2
        order = part[:, np.ptp(part, axis=0).argmax()].argpartition(half)
        left += [places[order[half:]], places[order[:half]]]
    return found


def nearest_rows(
    queries: np.ndarray,
    reach: np.ndarray,
    rows: np.ndarray,
    k: int,
    same: np.ndarray | None = None,
    own: np.ndarray | None = None,
    block_rows: int = 4096,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of their k nearest rows within ``reach``, and distances; equal ones go to the earlier row.

    A row whose ``own`` equals the query's ``same`` is left out. Vectors with a missing or infinite part are near nothing.
    """
    usable, asking = np.flatnonzero(np.isfinite(rows).all(1)), np.flatnonzero(np.isfinite(queries).all(1))
    nothing = np.zeros(0, int)
    if not len(usable) or not len(asking):
        return nothing, nothing, np.zeros(0)
    held = [usable[leaf] for leaf in leaves(rows[usable], LEAF)]
    low, high = (np.stack([side(rows[leaf], axis=0) for leaf in held]) for side in (np.min, np.max))
    middle, lengths = (low + high) / 2, (rows * rows).sum(1)
    longest = lengths[usable].max()
    # one product gives the squares of both vectors less twice their product
    wide = np.column_stack([rows, lengths, np.ones(len(rows))])
    out = []
    for group in leaves(queries[asking], GROUP):
        group = asking[group]
        at, limit = queries[group], reach[group].astype(float)
        mine = (at * at).sum(1)
        slack = SLACK * (mine + longest)
        ask = np.column_stack([-2.0 * at, np.ones(len(at)), mine])
        gap = np.maximum(np.maximum(low - at.max(0), at.min(0) - high), 0.0)
        todo = np.flatnonzero(np.sqrt((gap * gap).sum(1)) <= limit.max() * MARGIN)
        todo = todo[((middle[todo] - at.mean(0)) ** 2).sum(1).argsort(kind="stable")]
        q, r, dist, turn = nothing, nothing, np.zeros(0), FIRST
        while len(todo):
            turn = min(turn, max(1, block_rows // LEAF))
            here, todo, turn = np.concatenate([held[i] for i in todo[:turn]]), todo[turn:], turn * WIDER
            rough = ask @ wide[here].T
            if same is not None:
                rough[same[group][:, None] == own[None, here]] = np.inf
            # matrix products lose the last digits: keep everything near the edge, then re-measure
            edge = limit * limit * MARGIN + slack
            near = rough <= edge[:, None]
            busy = np.flatnonzero(np.count_nonzero(near, axis=1) > k)
            if len(busy):
                kth = np.partition(rough[busy], k - 1, axis=1)[:, k - 1] + 2 * slack[busy]
                near[busy] &= rough[busy] <= kth[:, None]
            new_q, new_r = np.nonzero(near)
            fits = np.isfinite(rough[new_q, new_r])
            new_q, new_r = new_q[fits], here[new_r[fits]]
            if len(new_q):
                apart = np.sqrt(((at[new_q] - rows[new_r]) ** 2).sum(1))
                q, r, dist = np.concatenate([q, new_q]), np.concatenate([r, new_r]), np.concatenate([dist, apart])
                order = np.lexsort((r, dist, q))
                q, r, dist = q[order], r[order], dist[order]
                place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
                full = place == k - 1
                limit[q[full]] = np.minimum(limit[q[full]], dist[full])
                q, r, dist = q[place < k], r[place < k], dist[place < k]
            if len(todo):
                todo = todo[(distances(at, low[todo], high[todo]) <= limit[:, None] * MARGIN).any(0)]
        out.append((group[q], r, dist))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
