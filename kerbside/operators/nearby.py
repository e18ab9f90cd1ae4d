"""Pairs of positions by distance, in blocks of numpy arrays: memory grows with the points, never with the pairs.

Positions are cut into strips and ordered within each, so that those near a point are
a few ranges of consecutive rows.  Candidates of many points are tested at once, and a
block is given up before the next one is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Candidates tested at once.
BLOCK = 1 << 17
#: Ranges are searched a little wider than the limit; the distance itself decides.
WIDER = 1 + 1e-9


class Strips:
    """Points in the order of their strip (of ``s``) and, within it, of ``t``."""

    def __init__(self, s: np.ndarray, t: np.ndarray, width: float):
        strip = np.clip(np.floor(s / width), -(2.0**62), 2.0**62).astype(np.int64)
        self.order = np.lexsort((t, strip))
        strip, self.t = strip[self.order], t[self.order]
        names, starts = np.unique(strip, return_index=True)
        self.part = {int(n): (int(a), int(b)) for n, a, b in zip(names, starts, [*starts[1:], len(t)])}


def ranges(a: Strips, b: Strips, offset: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of ``a`` and, for each, the range of places of ``b`` in the strip ``offset`` further whose ``t`` is within ``reach``."""
    out = []
    for n, (start, end) in a.part.items():
        if n + offset in b.part:
            first, last = b.part[n + offset]
            own, other = a.t[start:end], b.t[first:last]
            reach_of = reach * WIDER + np.abs(own) * 1e-15
            out.append((np.arange(start, end), first + np.searchsorted(other, own - reach_of, "left"), first + np.searchsorted(other, own + reach_of, "right")))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def expanded(i: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with j in the range of i, by blocks of some ``BLOCK``."""
    some = hi > lo
    i, lo, n = i[some], lo[some], (hi - lo)[some]
    until = np.cumsum(n)
    start = 0
    while start < len(i):
        end = max(start + 1, int(np.searchsorted(until, (until[start - 1] if start else 0) + BLOCK, "right")))
        c = n[start:end]
        at = np.cumsum(c) - c
        yield np.repeat(i[start:end], c), np.arange(int(c.sum())) - np.repeat(at - lo[start:end], c)
        start = end


def within(x: np.ndarray, y: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of points at most ``radius`` apart, each once, by blocks."""
    cut = Strips(x, y, radius * WIDER / 4)
    xs, ys = x[cut.order], y[cut.order]
    for offset in range(5):
        i, lo, hi = ranges(cut, cut, offset, radius)
        lo = np.maximum(lo, i + 1) if offset == 0 else lo
        for p, q in expanded(i, lo, hi):
            dx, dy = xs[q] - xs[p], ys[q] - ys[p]
            hit = np.flatnonzero(np.sqrt(dx * dx + dy * dy) <= radius)
            if len(hit):
                yield cut.order[p[hit]], cut.order[q[hit]]


def between(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of a point of ``a`` (x, y) and one of ``b`` at most ``radius`` apart, by blocks."""
    sa, sb = (Strips(x, y, radius * WIDER / 4) for x, y in (a, b))
    (xs, ys), (xt, yt) = (a[0][sa.order], a[1][sa.order]), (b[0][sb.order], b[1][sb.order])
    for offset in range(-4, 5):
        for p, q in expanded(*ranges(sa, sb, offset, radius)):
            dx, dy = xt[q] - xs[p], yt[q] - ys[p]
            hit = np.flatnonzero(np.sqrt(dx * dx + dy * dy) <= radius)
            if len(hit):
                yield sa.order[p[hit]], sb.order[q[hit]]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the number of the first node of its group) after nodes a and b have been joined."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def dense(x: np.ndarray, y: np.ndarray, n: np.ndarray, eps: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a point, which stands for ``n``, has ``least`` within ``eps``, and a number of its group where it does (else -1).

    Points of one cell are within ``eps`` of each other: full cells are dense as they are,
    a cell's dense points are of one group, and two cells are compared point by point
    only where a few of their outermost points have not joined them.
    """
    side = eps / np.sqrt(2) * (1 - 1e-9)
    cx, cy = (np.floor((v - v.min()) / side).astype(np.int64) + 2 for v in (x, y))
    tall = int(cy.max()) + 3
    name = cx * tall + cy
    cell = np.unique(name, return_inverse=True)[1].ravel()
    core = np.bincount(cell, n)[cell] >= least
    light = np.flatnonzero(~core)
    count = np.zeros(len(light))
    for p, q in between((x[light], y[light]), (x, y), eps):
        count += np.bincount(p, n[q], len(light))
    core[light] = count >= least
    group = np.full(len(x), -1)
    of = np.flatnonzero(core)
    if not len(of):
        return core, group
    of = of[np.argsort(name[of], kind="stable")]
    u, v = x[of], y[of]
    names, start, own = np.unique(name[of], return_index=True, return_inverse=True)
    own, end, label = own.ravel(), np.append(start[1:], len(of)), np.arange(len(names))
    ends = np.stack([np.lexsort((sign * w, own))[start] for w in (u, v, u + v, u - v) for sign in (1, -1)], axis=1)
    ahead = [(i, j) for i in range(3) for j in range(-2, 3) if i > 0 or j > 0]
    near = [(k, np.minimum(np.searchsorted(names, names + i * tall + j), len(names) - 1), names + i * tall + j) for i, j in ahead for k in (np.arange(len(names)),)]
    a, b = (np.concatenate(w) for w in zip(*[(k[names[at] == want], at[names[at] == want]) for k, at, want in near]))
    met = np.zeros(len(a), bool)
    for k in range(0, len(a), BLOCK // 64):
        p, q = ends[a[k : k + BLOCK // 64]][:, :, None], ends[b[k : k + BLOCK // 64]][:, None]
        dx, dy = u[q] - u[p], v[q] - v[p]
        met[k : k + BLOCK // 64] = (np.sqrt(dx * dx + dy * dy) <= eps).any(axis=(1, 2))
    label = joined(label, a[met], b[met])
    a, b = a[~met], b[~met]
    low, high = (np.stack([f.reduceat(w, start) for w in (u, v)]) for f in (np.minimum, np.maximum))
    while len(a):
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        if not len(a):
            break
        k = max(1, int(np.searchsorted(np.cumsum(end[a] - start[a]), BLOCK)))
        which, p = next(expanded(np.arange(k), start[a[:k]], end[a[:k]]))
        to = b[which]
        # a point farther than eps from the other cell's bounds has no link there
        gap = [np.maximum(np.maximum(low[d][to] - w[p], w[p] - high[d][to]), 0) for d, w in enumerate((u, v))]
        use = np.flatnonzero(gap[0] ** 2 + gap[1] ** 2 <= (eps * WIDER) ** 2)
        which, p, to = which[use], p[use], to[use]
        hit = np.zeros(k, bool)
        for i, q in expanded(np.arange(len(p)), start[to], end[to]):
            dx, dy = u[q] - u[p[i]], v[q] - v[p[i]]
            hit[which[i[np.sqrt(dx * dx + dy * dy) <= eps]]] = True
        label = joined(label, a[:k][hit], b[:k][hit])
        a, b = a[k:], b[k:]
    group[of] = label[own]
    return core, group


def least(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], asked: np.ndarray, radius: float) -> np.ndarray:
    """Least squared distance up to ``radius`` between the points of each group of ``a`` and each of ``b``; infinite where none or not asked.

    ``a`` and ``b`` are (group, x, y) in the order of groups.  Distances are tried from
    small to large: a pair of groups that has met within a radius has its least distance
    and is left out of the next, wider, one.  Where that leaves few pairs, their points
    are compared all with all.
    """
    (ga, xa, ya), (gb, xb, yb) = a, b
    best = np.full(asked.shape, np.inf)
    flat, left = best.reshape(-1), asked.copy()
    ends_a, ends_b = (np.searchsorted(g, np.arange(n + 1)) for g, n in zip((ga, gb), asked.shape))
    sizes_a, sizes_b = np.diff(ends_a), np.diff(ends_b)
    for r in (radius / 5, radius / 2.4, radius):
        if not left.any():
            break
        sa, sb = Strips(ya, xa, r * WIDER / 2), Strips(yb, xb, r * WIDER / 2)
        found = [ranges(sa, sb, k, r) for k in (-2, -1, 0, 1, 2)]
        if int((left * sizes_a[:, None] @ sizes_b).sum()) < 4 * sum(int((hi - lo).sum()) for _, lo, hi in found):
            for p, q in np.argwhere(left):
                u, v = slice(ends_a[p], ends_a[p + 1]), slice(ends_b[q], ends_b[q + 1])
                if sizes_a[p] and sizes_b[q]:
                    dx, dy = xb[v][None] - xa[u][:, None], yb[v][None] - ya[u][:, None]
                    best[p, q] = min(best[p, q], float((dx * dx + dy * dy).min()))
            break
        xs, ys, gs = xa[sa.order], ya[sa.order], ga[sa.order] * asked.shape[1]
        xt, yt, gt = xb[sb.order], yb[sb.order], gb[sb.order]
        open_ = left.reshape(-1)
        for i, lo, hi in found:
            for p, q in expanded(i, lo, hi):
                pair = gs[p] + gt[q]
                use = np.flatnonzero(open_[pair])
                p, q, pair = p[use], q[use], pair[use]
                dx, dy = xt[q] - xs[p], yt[q] - ys[p]
                d = dx * dx + dy * dy
                while len(use := np.flatnonzero(d < flat[pair])):
                    # of several for one pair any may be written; the rest come again
                    pair, d = pair[use], d[use]
                    flat[pair] = d
        left &= ~(np.sqrt(best) <= r)
    best[np.sqrt(best) > radius] = np.inf
    return best
