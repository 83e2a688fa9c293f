"""Average linkage of many series by 1 less their absolute correlation, without a matrix that has a row and a column a series.

A window's series are held as the values they have; dense rows are made a block at a time. Series that are equal up to a
factor have distance 0, so they are one with a weight from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd

#: Clusters whose distances are held as a matrix.
ROOM = 4096
#: Rows of a block of products, and columns of it.
ROWS, COLUMNS = 256, 1024
#: Digits to which series of length 1 are equal; their distance is then below 1e-15.
SAME = 9
#: Digits in which mean distances are compared.
DIGITS = 12


@dataclass
class Packed:
    """Rows of values over so many dates: row i has x[edges[i]:edges[i + 1]] on dates ``at``, and 0 on the others."""

    edges: np.ndarray
    at: np.ndarray
    x: np.ndarray
    dates: int

    @classmethod
    def of(cls, at: list[np.ndarray], x: list[np.ndarray], dates: int) -> Packed:
        flat = lambda v, kind: np.concatenate(v).astype(kind, copy=False) if v else np.empty(0, kind)
        return cls(np.r_[0, np.cumsum([len(v) for v in x], dtype=np.int64)], flat(at, np.int32), flat(x, float), dates)

    def __len__(self) -> int:
        return len(self.edges) - 1

    def take(self, rows: np.ndarray) -> Packed:
        size = np.diff(self.edges)[rows]
        edges = np.r_[0, np.cumsum(size)]
        flat = np.arange(edges[-1]) + np.repeat(self.edges[:-1][rows] - edges[:-1], size)
        return Packed(edges, self.at[flat], self.x[flat], self.dates)

    def dense(self, low: int, high: int) -> np.ndarray:
        """Rows as they are."""
        own = slice(self.edges[low], self.edges[high])
        out = np.zeros((high - low, self.dates))
        out[np.repeat(np.arange(high - low), np.diff(self.edges[low : high + 1])), self.at[own]] = self.x[own]
        return out

    def centred(self, low: int, high: int) -> np.ndarray:
        """Rows less their means; those that don't vary are 0."""
        v = self.dense(low, high)
        z = v - v.mean(1, keepdims=True) if self.dates else v
        z[(v == v[:, :1]).all(1)] = 0.0
        return z

    def unit(self, low: int, high: int) -> np.ndarray:
        """Centred rows of length 1, or 0."""
        z = self.centred(low, high)
        length = np.sqrt((z * z).sum(1, keepdims=True))
        return np.divide(z, length, out=z, where=length > 0)


def grouped(batches: Iterator[pd.DataFrame], key: str, made: Callable[[object, pd.DataFrame], pd.DataFrame | Iterator[pd.DataFrame]]) -> Iterator[pd.DataFrame]:
    """The frame or frames ``made`` of each key's rows, from batches in which a key's rows lie together."""
    held: list[pd.DataFrame] = []
    last = None

    def out() -> Iterator[pd.DataFrame]:
        if held:
            got = made(last, pd.concat(held, ignore_index=True))
            held.clear()
            yield from (x for x in ([got] if isinstance(got, pd.DataFrame) else got) if len(x))

    for pdf in batches:
        k = pdf[key].to_numpy()
        edges = [0, *(np.flatnonzero([a != b for a, b in zip(k[1:], k[:-1], strict=True)]) + 1), len(k)] if len(k) else []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if held and k[low] != last:
                yield from out()
            last = k[low]
            held.append(pdf.iloc[low:high])
    yield from out()


def alike(p: Packed) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each set of rows with distance 0, each row's set). Rows that don't vary are far from all others."""
    seen: dict = {}
    first: list[int] = []
    own = np.empty(len(p), np.int64)
    for low in range(0, len(p), COLUMNS):
        high = min(low + COLUMNS, len(p))
        z = np.round(p.unit(low, high), SAME)
        some = z != 0
        lead = z[np.arange(len(z)), some.argmax(1)] if p.dates else np.zeros(len(z))
        z = np.where(lead[:, None] < 0, -z, z) + 0.0
        for i in range(low, high):
            key = blake2b(z[i - low].tobytes(), digest_size=16).digest() if lead[i - low] else i
            own[i] = seen.setdefault(key, len(first))
            if own[i] == len(first):
                first.append(i)
    return np.array(first, np.int64), own


def merges(d: np.ndarray, k: int, size: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(i, j, distance): clusters of so many items are merged, the nearest first, until k are left; j becomes part of i < j.

    Distances are overwritten. Ties go to the first pair. Each row's nearest is kept and searched again only where it was
    merged, so all merges together take about n² steps.
    """
    n, size = len(d), size.astype(float)
    np.fill_diagonal(d, np.inf)
    at, alive = np.arange(n), np.ones(n, bool)
    near = d.argmin(1)
    least = d[at, near]
    for _ in range(n - max(1, min(k, n))):
        r = int(least.argmin())
        i, j = sorted((r, int(near[r])))
        yield i, j, float(d[i, j])
        mean = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        mean[i] = np.inf
        d[i], d[:, i] = mean, mean
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j], least[j] = False, np.inf
        stale = alive & ((near == i) | (near == j))
        closer = alive & ~stale & ((mean < least) | ((mean == least) & (i < near)))
        stale[i], closer[i] = True, False
        near[closer], least[closer] = i, mean[closer]
        for row in np.flatnonzero(stale):
            near[row] = d[row].argmin()
            least[row] = d[row, near[row]]


def _chunks(clusters: np.ndarray, edges: np.ndarray) -> Iterator[list[int]]:
    """Clusters of so many rows together, or one."""
    held, count = [], 0
    for c in clusters:
        n = edges[c + 1] - edges[c]
        if held and count + n > ROWS:
            yield held
            held, count = [], 0
        held.append(int(c))
        count += n
    if held:
        yield held


def _similar(p: Packed, weight: np.ndarray, label: np.ndarray, clusters: list[int], edges: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Weighted mean absolute correlations of a chunk of clusters with all; rows lie by cluster, which begin at the edges."""
    rows = [(c, low, min(low + ROWS, edges[c + 1])) for c in clusters for low in range(edges[c], edges[c + 1], ROWS)]
    out = np.zeros((len(clusters), len(edges) - 1))
    for batch in [rows] if len(clusters) > 1 else [[r] for r in rows]:
        z = np.concatenate([p.unit(low, high) * weight[low:high, None] for _, low, high in batch])
        begin, place = np.r_[0, np.cumsum([high - low for _, low, high in batch])[:-1]], np.searchsorted(clusters, [c for c, _, _ in batch])
        for low in range(0, len(p), COLUMNS):
            high = min(low + COLUMNS, len(p))
            s = z @ p.unit(low, high).T
            np.abs(s, out=s)
            s *= weight[low:high]
            own = label[low:high]
            if own[-1] - own[0] + 1 < len(own):
                s = np.add.reduceat(s, np.flatnonzero(np.r_[True, own[1:] != own[:-1]]), axis=1)
            out[place, own[0] : own[-1] + 1] += np.add.reduceat(s, begin, axis=0) if len(begin) < len(s) else s
    out /= whole[clusters, None]
    out /= whole
    return out


def linkage(p: Packed, weight: np.ndarray, k: int) -> np.ndarray:
    """Cluster of each row by average linkage with weights, numbered by first member.

    Up to ROOM rows, a matrix is merged pair by pair. Above, clusters that are each other's nearest are merged, round by
    round, which all belong to the same tree, as a merged cluster is never nearer than the nearer of its parts; only rows whose
    nearest was merged are searched again. The rest is a matrix of clusters, and the tree is cut by its merges' distances.
    """
    n = len(p)
    rep, label, weight = np.arange(n), np.arange(n), weight.astype(float)
    tree: list[tuple[int, int, float]] = []
    near, least, stale = np.full(n, -1), np.full(n, np.inf), np.ones(n, bool)

    def laid() -> tuple:
        order = np.argsort(label, kind="stable")
        q, own = p.take(order), label[order]
        edges = np.searchsorted(own, np.arange(len(rep) + 1))
        return q, weight[order], own, edges, np.add.reduceat(weight[order], edges[:-1])

    while len(rep) > max(ROOM, 1):
        q, w, own, edges, whole = laid()
        for part in _chunks(np.flatnonzero(stale), edges):
            d = np.round(1.0 - _similar(q, w, own, part, edges, whole), DIGITS)
            d[np.arange(len(part)), part] = np.inf
            near[part] = d.argmin(1)
            least[part] = d[np.arange(len(part)), near[part]]
        del q, w
        c = np.arange(len(rep))
        low = np.flatnonzero((near[near] == c) & (c < near))
        high = near[low]
        if not len(low):  # distances that differ in their last digits by side
            i = int(least.argmin())
            low, high = np.sort([[i], [int(near[i])]], axis=0)
        tree += [(int(rep[i]), int(rep[j]), float(least[i])) for i, j in zip(low, high, strict=True)]
        touched, to = np.zeros(len(rep), bool), c.copy()
        touched[low] = touched[high] = True
        to[high] = low
        keep = np.ones(len(rep), bool)
        keep[high] = False
        to = (np.cumsum(keep) - 1)[to]
        stale = (touched | touched[near])[keep]
        label, rep, near, least = to[label], rep[keep], to[near][keep], least[keep]
    q, w, own, edges, whole = laid()
    d = np.empty((len(rep), len(rep)))
    for part in _chunks(np.arange(len(rep)), edges):
        d[part] = _similar(q, w, own, part, edges, whole)
    del q, w
    np.subtract(1.0, d, out=d)
    np.clip(d, 0, 2, out=d)
    if tree:
        for low in range(0, len(d), 512):  # both sides alike
            d[low:, low : low + 512] = d[low : low + 512, low:].T
    tree += [(int(rep[i]), int(rep[j]), h) for i, j, h in merges(d, 1 if tree else k, whole)]
    height, reach = np.empty(len(tree)), np.zeros(n)
    for at, (i, j, h) in enumerate(tree):
        height[at] = reach[i] = max(h, reach[i], reach[j])
    up = np.arange(n)
    for at in np.argsort(height, kind="stable")[: n - max(1, min(k, n))]:
        up[tree[at][1]] = tree[at][0]
    while (up != up[up]).any():
        up = up[up]
    return np.unique(up, return_inverse=True)[1]


def clustered(p: Packed, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(cluster of each row, its set of rows with distance 0): average linkage into k clusters."""
    first, own = alike(p)
    n, k = len(p), max(1, min(k, len(p)))
    if len(first) > k:
        weight = np.bincount(own, minlength=len(first))
        return np.unique(linkage(p.take(first), weight, k)[own], return_inverse=True)[1], own
    label, rest = np.arange(n), np.flatnonzero(first[own] != np.arange(n))
    rest = rest[np.argsort(own[rest], kind="stable")][: n - k]  # sets are merged one after another, as the first pair is
    label[rest] = first[own[rest]]
    return np.unique(label, return_inverse=True)[1], own


def central(p: Packed, k: int) -> list[int]:
    """One row of each of k clusters: that with the least mean distance to its cluster."""
    label, own = clustered(p, k)
    out = []
    for c in range(label.max() + 1):
        rows = np.flatnonzero(label == c)
        _, lead, size = np.unique(own[rows], return_index=True, return_counts=True)
        lead = rows[lead]
        part, mean = p.take(lead), np.empty(len(lead))
        for low in range(0, len(part), ROWS):
            high, total = min(low + ROWS, len(part)), 0.0
            z = part.unit(low, high)
            for at in range(0, len(part), COLUMNS):
                end = min(at + COLUMNS, len(part))
                d = np.clip(1 - np.abs(z @ part.unit(at, end).T), 0, 2)
                both = np.arange(max(low, at), min(high, end))
                d[both - low, both - at] = 0.0
                total = total + d @ size[at:end]
            mean[low:high] = total / size.sum()
        out.append(int(lead[mean.argmin()]))
    return sorted(out)


#: Nearest rows that are kept for each row where there is no matrix.
NEAREST = 64


class _Near:
    """For each set of equal rows, the set whose shrunk correlation with it is greatest among those with rows left."""

    def __init__(self, p: Packed, scale: np.ndarray, own: np.ndarray):
        self.p, self.scale, self.own, self.matrix, self.built = p, scale, own, None, 0
        if len(p) <= ROOM:
            self.matrix = np.empty((len(p), len(p)))
            for low in range(0, len(p), ROWS):
                self.matrix[low : low + ROWS] = self.rows(np.arange(low, min(low + ROWS, len(p))), np.arange(len(p)))

    def rows(self, of: np.ndarray, among: np.ndarray) -> np.ndarray:
        q = self.p.take(of)
        z, out = q.centred(0, len(q)) * self.scale[of, None], np.empty((len(of), len(among)))
        for low in range(0, len(among), COLUMNS):
            at = among[low : low + COLUMNS]
            part = self.p.take(at)
            out[:, low : low + COLUMNS] = z @ (part.centred(0, len(part)) * self.scale[at, None]).T
        i, j = np.nonzero(of[:, None] == among)
        out[i, j] = self.own[of[i]]
        return np.round(out, DIGITS)

    def build(self, active: np.ndarray, first: np.ndarray) -> None:
        """Lists of the nearest: the greatest correlation first, then the first name."""
        self.built, k = len(active), min(NEAREST, len(active))
        self.list = np.empty((len(self.p), k), np.int32)
        for low in range(0, len(active), ROWS):
            c = self.rows(active[low : low + ROWS], active)
            edge = np.partition(c, -k, axis=1)[:, -k]
            for r, row, least in zip(active[low : low + ROWS], c, edge, strict=True):
                at = np.flatnonzero(row >= least)
                self.list[r] = active[at[np.lexsort((first[active[at]], -row[at]))[:k]]]

    def next(self, g: int, left: np.ndarray, first: np.ndarray) -> int:
        """The set that comes after g; ``first``: the next row of each set."""
        if self.matrix is not None:
            row = np.where(left > 0, self.matrix[g], -np.inf)
            at = np.flatnonzero(row == row.max())
            return int(at[first[at].argmin()])
        active = np.flatnonzero(left > 0)
        if self.built == 0 or len(active) < self.built / 2:
            self.build(np.union1d(active, [g]), first)
        for h in self.list[g]:
            if left[h] > 0:
                return int(h)
        row = self.rows(np.array([g]), active)[0]
        at = active[row == row.max()]
        return int(at[first[at].argmin()])


def hierarchical(p: Packed) -> np.ndarray:
    """Shares by recursive bisection of risk, in an order in which each row is followed by the nearest that is left.

    The covariance is 0.9 of the sample's and 0.1 of the mean variance on the diagonal. Equal rows are taken together while
    the order is sought; a half's risk comes from the sum of its rows, so no matrix of all rows is needed.
    """
    n, t = len(p), p.dates
    seen: dict = {}
    sets: list[list[int]] = []
    for i in range(n):
        own = slice(p.edges[i], p.edges[i + 1])
        g = seen.setdefault((p.at[own].tobytes(), p.x[own].tobytes()), len(sets))
        if g == len(sets):
            sets.append([])
        sets[g].append(i)
    q = p.take(np.array([s[0] for s in sets]))
    var = np.concatenate([(q.centred(low, min(low + ROWS, len(q))) ** 2).sum(1) for low in range(0, len(q), ROWS)]) / (t - 1)
    size = np.array([len(s) for s in sets])
    shrink = 0.1 * (var @ size) / n
    total = 0.9 * var + shrink
    scale = np.divide(np.sqrt(0.9 / (t - 1)), np.sqrt(total), out=np.zeros(len(q)), where=total > 0)
    near = _Near(q, scale, np.divide(0.9 * var, total, out=np.zeros(len(q)), where=total > 0))
    left, first, order = size.copy(), np.array([s[0] for s in sets]), np.empty(n, np.int64)
    g = min(np.flatnonzero(total == total.min()), key=lambda h: first[h])
    for at in range(n):
        if at:
            g = near.next(g, left, first)
        order[at] = g
        left[g] -= 1
        if left[g]:
            first[g] = sets[g][size[g] - left[g]]
    used = np.zeros(len(q), np.int64)
    names = np.empty(n, np.int64)
    for at, g in enumerate(order):
        names[at] = sets[g][used[g]]
        used[g] += 1
    del near
    u, w = np.divide(1.0, total, out=np.ones(len(q)), where=total > 0), np.ones(n)

    def bisected(low: int, high: int, block: tuple[int, np.ndarray] | None) -> tuple[np.ndarray, float, float]:
        """Sums over a part of the order: of rows over their variances, of 1 over these, and of its square."""
        if block is None and high - low <= ROWS:
            part = q.take(order[low:high])
            block = (low, part.centred(0, len(part)) * u[order[low:high], None])
        if high - low == 1:
            a = u[order[low]]
            return block[1][low - block[0]], a, a * a
        mid = low + (high - low) // 2
        one, two = bisected(low, mid, block), bisected(mid, high, block)
        risk = [(0.9 * (z @ z) / (t - 1) + shrink * square) / (a * a) for z, a, square in (one, two)]
        share = 1 - risk[0] / max(sum(risk), 1e-18)
        w[low:mid] *= share
        w[mid:high] *= 1 - share
        return one[0] + two[0], one[1] + two[1], one[2] + two[2]

    bisected(0, n, None)
    out = np.empty(n)
    out[names] = w
    return out
