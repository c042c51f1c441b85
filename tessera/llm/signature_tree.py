"""Signature trees over token sets, joined by dual traversal.

A leaf entry is one set: a bitmap with the bit of each of its tokens and its
size.  A node holds the OR of its children's bitmaps, the range of their
sizes and the most tokens that share bits in one of their sets.  Two nodes
can hold a linked pair only if the bits they have in common, with that
allowance, reach the overlap that their smallest sizes ask for.
"""

from __future__ import annotations

import numpy as np

BITS = 2048
FAN = 8
PAIRS_AT_ONCE = 1 << 14


class Tree:
    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        """``sets``: sorted 64-bit tokens; ``sizes``: full set sizes (tokens
        that no other set has may be left out of ``sets``)."""
        n = len(sets)
        held = np.fromiter(map(len, sets), np.int64, n)
        grid = np.zeros((n, BITS), bool)
        if held.sum():
            grid[np.repeat(np.arange(n), held), (np.concatenate(sets) % np.uint64(BITS)).astype(np.int64)] = True
        bits = np.packbits(grid, axis=1).view(np.uint64)
        slack = held - grid.sum(axis=1)
        # one tuple of arrays a level: bitmaps, least and largest size, most tokens held, allowance
        self.levels = [(bits, sizes, sizes, held, slack)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, h, s = self.levels[-1]
            at = np.arange(0, len(b), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at),
                                np.maximum.reduceat(h, at), np.maximum.reduceat(s, at)))


def _may_link(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    fits = (100 * x[2][i] >= percent * y[1][j]) & (100 * y[2][j] >= percent * x[1][i])
    common = np.bitwise_count(x[0][i] & y[0][j]).sum(axis=1, dtype=np.int64) + np.minimum(x[4][i], y[4][j])
    most = np.minimum(common, np.minimum(x[3][i], y[3][j]))
    return fits & ((100 + percent) * most >= percent * (x[1][i] + y[1][j]))


def _children(i: np.ndarray, j: np.ndarray, n_i: int, n_j: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(FAN)
    a = (i[:, None, None] * FAN + k[None, :, None] + np.zeros((1, 1, FAN), np.int64)).ravel()
    b = (j[:, None, None] * FAN + k[None, None, :] + np.zeros((1, FAN, 1), np.int64)).ravel()
    ok = (a < n_i) & (b < n_j)
    return a[ok], b[ok]


def candidate_pairs(x: Tree, y: Tree, percent: int, settled):
    """Batches of leaf pairs (arrays i, j) that may link, by a depth-first
    dual traversal from the two roots.  ``x is y`` joins a tree with itself
    (i < j).  ``settled(level, i, j)`` tells which node pairs need no look
    because everything below them is in one component already."""
    same = x is y
    top_x, top_y = len(x.levels) - 1, len(y.levels) - 1
    if not len(x.levels[0][0]) or not len(y.levels[0][0]):
        return
    zero = np.zeros(1, np.int64)
    stack = [(top_x, top_y, zero, zero)]
    while stack:
        lx, ly, i, j = stack.pop()
        keep = _may_link(x.levels[lx], i, y.levels[ly], j, percent)
        if same:
            keep &= (i < j) if lx == 0 else (i <= j)
        i, j = i[keep], j[keep]
        if lx == ly:
            open_ = ~settled(lx, i, j)
            i, j = i[open_], j[open_]
        if not len(i):
            continue
        if lx == 0 and ly == 0:
            yield i, j
            continue
        if lx > ly:  # the trees differ in height: go down in the taller one first
            a = (i[:, None] * FAN + np.arange(FAN)).ravel()
            b = np.repeat(j, FAN)
            ok = a < len(x.levels[lx - 1][0])
            a, b, to = a[ok], b[ok], (lx - 1, ly)
        elif ly > lx:
            b = (j[:, None] * FAN + np.arange(FAN)).ravel()
            a = np.repeat(i, FAN)
            ok = b < len(y.levels[ly - 1][0])
            a, b, to = a[ok], b[ok], (lx, ly - 1)
        else:
            a, b = _children(i, j, len(x.levels[lx - 1][0]), len(y.levels[ly - 1][0]))
            to = (lx - 1, ly - 1)
        for at in range(0, len(a), PAIRS_AT_ONCE):
            stack.append((*to, a[at:at + PAIRS_AT_ONCE], b[at:at + PAIRS_AT_ONCE]))


class Forest:
    """Union-find over the sets of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def labels(self) -> np.ndarray:
        return np.fromiter(map(self.find, range(len(self.up))), np.int64, len(self.up))


def _node_labels(labels: np.ndarray, height: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = [(labels, labels)]
    for _ in range(height - 1):
        lo, hi = out[-1]
        at = np.arange(0, len(lo), FAN)
        out.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))
    return out


def link(sets: list[np.ndarray], sizes: np.ndarray, residents: int, percent: int, own: bool) -> Forest:
    """Join the first ``residents`` sets with each other (if ``own``) and with
    the rest; the rest are not compared among themselves.  Every pair that
    links ends in one tree of the forest; a pair whose ends are connected
    already is not looked at again."""
    forest = Forest(len(sets))
    rt, vt = Tree(sets[:residents], sizes[:residents]), Tree(sets[residents:], sizes[residents:])
    for x, y, shift in ([(rt, rt, 0)] if own else []) + [(rt, vt, residents)]:
        state = {}

        def refresh(x=x, y=y, shift=shift, state=state):
            lab = forest.labels()
            state["x"] = _node_labels(lab[:residents], len(x.levels))
            state["y"] = _node_labels(lab[shift:shift + len(y.levels[0][0])], len(y.levels))

        def settled(level, i, j, state=state):
            (xl, xh), (yl, yh) = state["x"][level], state["y"][level]
            return (xl[i] == xh[i]) & (yl[j] == yh[j]) & (xl[i] == yl[j])

        if not len(x.levels[0][0]) or not len(y.levels[0][0]):
            continue
        refresh()
        for i, j in candidate_pairs(x, y, percent, settled):
            changed = False
            for a, b in zip(i.tolist(), (j + shift).tolist(), strict=True):
                ra, rb = forest.find(a), forest.find(b)
                if ra == rb:
                    continue
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * common >= percent * (sizes[a] + sizes[b] - common):
                    forest.up[max(ra, rb)] = min(ra, rb)
                    changed = True
            if changed:
                refresh()
    return forest
