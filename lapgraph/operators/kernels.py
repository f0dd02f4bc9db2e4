"""Factorization and solution of single blocks, on arrays.

Blocks come as a diagonal and edges in local numbers. The exact kernel works on many blocks of one size at once. The
approximate kernel eliminates one vertex after the other, least degree first, replacing each star by a sampled forest of
about as many edges; draws are hashes of (seed, block, step, entry, copy), so that no order of execution changes them.

A step keeps the pivot, the reciprocal of its column sum and the share of each neighbour. With that, both passes of a
solve are plain sums: forward ``y[u] += share * y[v]``, backward ``x[v] = y[v] / total + sum(share * x[u])``.

Blocks of more than WIDE edges are eliminated in rounds of vertices that do not touch each other, on flat arrays (about 150
bytes an edge); once DENSE vertices or fewer are left, these are eliminated one by one in a full matrix.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from lapgraph.model import DenseFailure

_MASK = (1 << 64) - 1
SMALL = 40  #: stars up to this size are sampled without arrays
WIDE, DENSE = 20_000, 2048


def degree_bucket(degree: int, base: int) -> int:
    """Degrees up to base have a bucket each, greater ones share buckets, 2 * base + 1 in all."""
    return degree if degree <= base else min(base + degree // base, 2 * base)


def mix(x):
    """A 64-bit hash of a 64-bit value, for arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(seed: int, *keys: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on the keys alone."""
    h = np.full(np.broadcast_shapes(*[np.shape(k) for k in keys]), seed & _MASK, np.uint64)
    with np.errstate(over="ignore"):
        for k in keys:
            h = mix(h + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(k).astype(np.uint64) + np.uint64(1)))
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


# ---- exact ----------------------------------------------------------------------------------------------------------


def dense(diagonal: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The block's matrix without its last vertex."""
    m = len(diagonal) - 1
    a = np.zeros((m, m))
    a[np.arange(m), np.arange(m)] = diagonal[:m]
    own = v < m
    a[u[own], v[own]] = a[v[own], u[own]] = -w[own]
    return a


def cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower factors of a stack of matrices; of each the first unusable pivot (-1: none), and whether it was not finite."""
    low, m = a.copy(), a.shape[1]
    failed, infinite = np.full(len(a), -1), np.zeros(len(a), bool)
    with np.errstate(all="ignore"):
        for i in range(m):
            pivot = low[:, i, i] - (low[:, i, :i] ** 2).sum(1)
            bad = ~np.isfinite(pivot)
            unusable = (bad | (pivot <= 0)) & (failed < 0)
            failed[unusable], infinite[unusable] = i, bad[unusable]
            root = np.sqrt(np.where(unusable | (failed >= 0), 1.0, pivot))
            below = (low[:, i + 1 :, i] - np.einsum("bij,bj->bi", low[:, i + 1 :, :i], low[:, i, :i])) / root[:, None]
            low[:, i, i], low[:, i + 1 :, i], low[:, i, i + 1 :] = root, below, 0
    return low, failed, infinite


def pack(low: np.ndarray) -> np.ndarray:
    """Rows of a lower triangle, one after the other."""
    return low[np.tril_indices(len(low))]


def unpack(rows: np.ndarray, m: int) -> np.ndarray:
    low = np.zeros((m, m))
    low[np.tril_indices(m)] = rows
    return low


def exact_solve(low: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Solutions of L L' x = y for a stack of factors (b, m, m) and right sides (b, m + 1, s); the last variable is 0."""
    m, x = low.shape[1], y.copy()
    for i in range(m):
        x[:, i] = (x[:, i] - np.einsum("bj,bjs->bs", low[:, i, :i], x[:, :i])) / low[:, i, i, None]
    for i in range(m - 1, -1, -1):
        x[:, i] = (x[:, i] - np.einsum("bj,bjs->bs", low[:, i + 1 :, i], x[:, i + 1 : m])) / low[:, i, i, None]
    x[:, m] = 0
    return x


# ---- approximate ----------------------------------------------------------------------------------------------------


@dataclass
class Steps:
    """``pivots`` in order, ``inverse`` (of the column sum), ``ends`` into ``to`` and ``share``; one vertex is left."""

    pivots: list[int] | np.ndarray
    inverse: list[float] | np.ndarray
    ends: list[int] | np.ndarray
    to: list[int] | np.ndarray
    share: list[float] | np.ndarray
    uneliminated: int


def _reciprocal(x: float) -> float:
    inverse = 1.0 / x if x else np.inf
    return inverse if np.isfinite(inverse) else 1.0


def eliminate(diagonal: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, seed: int, first: int, copies: int = 1) -> Steps:
    """Eliminate all vertices but one.

    ``first``: the block's least vertex, which sets its draws apart. ``copies``: how often each edge is split.
    """
    n = len(diagonal)
    if len(u) > WIDE:
        return _eliminate_wide(n, u, v, w, seed, first, copies)
    return _eliminate_narrow(n, diagonal, u, v, w, seed, first, [copies] * len(u), copies)


def _eliminate_narrow(n: int, diagonal, u, v, w, seed: int, first: int, split: list[int], copies: int) -> Steps:
    """One vertex after the other; ``split``: the copies that each edge stands for at first."""
    diag = [float(x) for x in diagonal]
    near: list[dict[int, list]] = [{} for _ in range(n)]  # neighbour: [weight, copies]
    for a, b, x, c in zip(u.tolist(), v.tolist(), w.tolist(), split, strict=True):
        near[a][b], near[b][a] = [x, c], [x, c]
    key = [sum(x[1] for x in own.values()) for own in near]
    base = max(1, copies * n)
    bucket = [degree_bucket(k, base) for k in key]
    heap = [(bucket[i], -i, i) for i in range(n)]  # the latest first within a bucket
    heapq.heapify(heap)
    stamp, entry = n, {i: (bucket[i], -i, i) for i in range(n)}

    def moved(i: int) -> None:
        nonlocal stamp
        key[i] = max(0, key[i])
        b = degree_bucket(key[i], base)
        if b != bucket[i]:
            bucket[i] = b
            entry[i] = (b, -stamp, i)
            stamp += 1
            heapq.heappush(heap, entry[i])

    out = Steps([], [], [], [], [], -1)
    for step in range(n - 1):
        while True:
            item = heapq.heappop(heap)
            p = item[2]
            if entry.get(p) == item:
                del entry[p]
                break
        star = []
        for q, (x, c) in near[p].items():
            del near[q][p]
            if x > 0:
                kept = min(c, copies)
                if c > kept:
                    key[q] = max(0, key[q] - (c - kept))
                star.append((x / kept, q, kept, x))
        near[p] = {}
        star.sort()
        out.pivots.append(p)
        if not star:
            out.inverse.append(_reciprocal(diag[p]))
            out.ends.append(len(out.to))
            continue
        if len(star) == 1:
            _, q, kept, x = star[0]
            out.inverse.append(_reciprocal(diag[p]))
            out.to.append(q)
            out.share.append(1.0)
            out.ends.append(len(out.to))
            diag[q] -= x
            key[q] -= kept
            moved(q)
            continue
        small = len(star) <= SMALL
        weight = [s[3] for s in star] if small else np.array([s[3] for s in star])
        total = sum(weight) if small else float(weight.sum())
        out.to += [s[1] for s in star]
        change = [-s[2] for s in star]
        for _, q, _, x in star:
            diag[q] -= x
        if not 0 < total < np.inf:
            out.inverse.append(_reciprocal(diag[p]))
            out.share += [1.0 / len(star)] * len(star)
        else:
            out.inverse.append(_reciprocal(total))
            out.share += [x / total for x in weight] if small else (weight / total).tolist()
            drawn = small_star_edges(star, seed, first, step) if small else star_edges(weight, np.array([s[2] for s in star]), seed, first, step)
            for i, j, x in drawn:
                a, b = star[i][1], star[j][1]
                diag[a] += x
                diag[b] += x
                change[i] += 1
                change[j] += 1
                own = near[a].get(b)
                if own is None:
                    near[a][b], near[b][a] = [x, 1], [x, 1]
                else:
                    own[0] += x
                    own[1] += 1
                    near[b][a] = list(own)
        out.ends.append(len(out.to))
        for (_, q, _, _), d in zip(star, change, strict=True):
            key[q] += d
            moved(q)
    out.uneliminated = next(iter(entry)) if entry else -1
    return out


def _suffixes(x: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums from each entry to the end of its run, whose last entry is ``last``; doubled spans keep them accurate."""
    s, at, d = x.copy(), np.arange(len(x)), 1
    span = int((last - at).max()) + 1 if len(x) else 0
    while d < span:
        inside = at + d <= last
        s[inside] += s[at[inside] + d].copy()
        d *= 2
    return s


def _fill(p: np.ndarray, x: np.ndarray, kept: np.ndarray, start: np.ndarray, last: np.ndarray, seed: int, first: int):
    """``star_edges`` of many stars, entries of a star standing together: totals by entry, and (entry, later entry, weight)."""
    suffix = _suffixes(x, last)
    total = suffix[start]
    at = np.arange(len(x))
    upper = np.where(at < last, suffix[np.minimum(at + 1, len(x) - 1)], 0.0)
    with np.errstate(invalid="ignore"):
        weight = x * (upper / total) / kept
    live = np.flatnonzero((weight > 0) & (total < np.inf))
    of = np.repeat(live, kept[live])
    copy = np.arange(len(of)) - np.repeat(np.cumsum(kept[live]) - kept[live], kept[live])
    r = upper[of] * (1.0 - uniform(seed, np.int64(first), p[of], of - start[of], copy))
    low, high = of + 1, last[of]
    while (low < high).any():
        mid = (low + high + 1) // 2
        reaches = suffix[mid] >= r
        low, high = np.where(reaches, mid, low), np.where(reaches, high, mid - 1)
    return total, of, low, weight[of]


def _merged(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray):
    """Parallel edges summed, weights and copies."""
    key = np.minimum(u, v) * np.int64(n) + np.maximum(u, v)
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    if not len(at):
        return key, key, w, c
    return key[at] // n, key[at] % n, np.add.reduceat(w[order], at), np.add.reduceat(c[order], at)


def _eliminate_wide(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, seed: int, first: int, copies: int, cap: int = 64) -> Steps:
    """Elimination in rounds: each takes the vertices that precede all their neighbours by degree, then by a hash.

    From a tree or a single cycle only vertices of degree 1 and 2 are taken, so that nothing is sampled.
    """
    u, v, w, c = _merged(n, np.asarray(u, np.int64), np.asarray(v, np.int64), np.asarray(w, np.float64), np.full(len(u), copies, np.int64))
    alive, parts, turn = np.ones(n, bool), [], 0
    while len(u):
        if (left := int(alive.sum())) <= DENSE:
            break
        degree = np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
        h = uniform(seed, np.int64(first), np.int64(turn), np.arange(n))
        du, dv = degree[u], degree[v]
        later = (du > dv) | ((du == dv) & ((h[u] > h[v]) | ((h[u] == h[v]) & (u > v))))
        early, late = np.where(later, v, u), np.where(later, u, v)
        free = alive & (degree > 0) & (degree <= (2 if len(u) <= left else cap))
        free[late] = False
        pivots = int(free.sum())
        turn += 1
        if not pivots and cap < n:
            cap *= 2
            continue
        if pivots * 500 < left:  # few vertices stand apart: the rest is taken one by one
            break
        mine = free[early]
        p, q, x, kept = early[mine], late[mine], w[mine], np.minimum(c[mine], copies)
        order = np.lexsort((q, x / kept, p))
        p, q, x, kept = p[order], q[order], x[order], kept[order]
        begin = np.flatnonzero(np.diff(p, prepend=-1))
        size = np.diff(np.append(begin, len(p)))
        start = np.repeat(begin, size)
        last = start + np.repeat(size, size) - 1
        total, i, j, weight = _fill(p, x, kept, start, last, seed, first)
        sound = total < np.inf
        share = np.where(sound, x / np.where(sound, total, 1.0), 1.0 / (last - start + 1))
        inverse = np.array(1.0) / total[begin]
        inverse[~(np.isfinite(inverse) & (inverse > 0))] = 1.0
        parts.append((p[begin], inverse, size, q, share))
        alive[p[begin]] = False
        u, v, w, c = _merged(n, *(np.concatenate(x) for x in ((u[~mine], q[i]), (v[~mine], q[j]), (w[~mine], weight), (c[~mine], np.ones(len(i), np.int64)))))
    names = np.flatnonzero(alive)
    u, v = np.searchsorted(names, u), np.searchsorted(names, v)
    if len(names) <= DENSE:
        rest = _eliminate_dense(len(names), u, v, w, c, seed, first, copies)
    else:
        diagonal = np.bincount(u, w, len(names)) + np.bincount(v, w, len(names))
        rest = _eliminate_narrow(len(names), diagonal, u, v, w, seed, first, c.tolist(), copies)
    parts.append((names[np.asarray(rest.pivots, np.int64)], rest.inverse, np.diff(rest.ends, prepend=0), names[np.asarray(rest.to, np.int64)], rest.share))
    pivots, inverse, size, to, share = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Steps(pivots, inverse, np.cumsum(size), to, share, int(names[rest.uneliminated]))


def _eliminate_dense(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray, seed: int, first: int, copies: int) -> Steps:
    """One vertex after the other, the one with the fewest neighbours first, in full matrices of weights and copies."""
    a, k = np.zeros((n, n)), np.zeros((n, n), np.int64)
    a[u, v] = a[v, u] = w
    k[u, v] = k[v, u] = c
    degree, parts = np.count_nonzero(a, axis=1).astype(np.int64), []
    for step in range(n - 1):
        p = int(degree.argmin())
        q = np.flatnonzero(a[p])
        x, kept = a[p, q], np.minimum(k[p, q], copies)
        order = np.lexsort((q, x / np.maximum(kept, 1)))
        q, x, kept = q[order], x[order], kept[order]
        a[p, q] = a[q, p] = 0.0
        degree[q] -= 1
        degree[p] = n + 1
        total = float(x.sum())
        sound = 0 < total < np.inf
        parts.append((p, _reciprocal(total) if sound else 1.0, len(q), q, x / total if sound else np.full(len(q), 1.0 / max(1, len(q)))))
        drawn = star_edges(x, kept, seed, first, n + step) if sound and len(q) > 1 else []
        if drawn:
            i, j, weight = (np.array(y) for y in zip(*drawn, strict=True))
            i, j = q[i], q[j]
            fresh = np.unique(np.minimum(i, j) * np.int64(n) + np.maximum(i, j))
            fresh = fresh[a[fresh // n, fresh % n] == 0]
            for s, t in ((i, j), (j, i)):
                np.add.at(a, (s, t), weight)
                np.add.at(k, (s, t), 1)
            np.add.at(degree, fresh // n, 1)
            np.add.at(degree, fresh % n, 1)
    left = np.flatnonzero(degree <= n)
    empty = [np.zeros(0, np.int64)]
    return Steps(
        np.array([x[0] for x in parts], np.int64), np.array([x[1] for x in parts]), np.cumsum([x[2] for x in parts], dtype=np.int64),
        np.concatenate([*empty, *(x[3] for x in parts)]), np.concatenate([np.zeros(0), *(x[4] for x in parts)]), int(left[0]),
    )


def _mixed(x: int) -> int:
    """``mix`` of one number."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def small_star_edges(star: list[tuple], seed: int, first: int, step: int) -> list[tuple[int, int, float]]:
    """``star_edges`` of a short star (weight per copy, neighbour, copies, weight), with the same draws in plain numbers."""
    m, out = len(star), []
    suffix = [0.0] * (m + 1)
    for i in range(m - 1, -1, -1):
        suffix[i] = suffix[i + 1] + star[i][3]
    total, gold = suffix[0], 0x9E3779B97F4A7C15
    base = seed & _MASK
    if m > 2:
        for k in (first, step):
            base = _mixed((base + gold * (k + 1)) & _MASK)
    for i in range(m - 1):
        kept, upper = star[i][2], suffix[i + 1]
        x = star[i][3] * (upper / total) / kept
        if not x > 0:
            continue
        own = _mixed((base + gold * (i + 1)) & _MASK) if m > 2 else 0
        for c in range(kept):
            j = i + 1
            if j < m - 1:
                r = upper * (1.0 - (_mixed((own + gold * (c + 1)) & _MASK) >> 11) * 2.0**-53)
                while j < m - 1 and suffix[j + 1] >= r:
                    j += 1
            out.append((i, j, x))
    return out


def star_edges(weight: np.ndarray, kept: np.ndarray, seed: int, first: int, step: int) -> list[tuple[int, int, float]]:
    """The sampled edges (entry, later entry, weight) of a star in ascending order.

    Entry i meets ``kept[i]`` later entries, each drawn by weight; the edges' expectation is w_i * w_j / sum(w).
    """
    suffix = np.cumsum(weight[::-1])[::-1]
    upper = np.append(suffix[1:], 0.0)
    of = np.repeat(np.arange(len(weight) - 1), kept[:-1])
    copy = np.arange(len(of)) - np.repeat(np.cumsum(kept[:-1]) - kept[:-1], kept[:-1])
    x = weight[of] * (upper[of] / suffix[0]) / kept[of]
    if len(weight) == 2:
        to = np.ones(len(of), np.int64)
    else:
        # the later entry whose share of the suffix the draw falls in, counted from the greatest: sums stay accurate
        r = upper[of] * (1.0 - uniform(seed, np.int64(first), np.int64(step), of, copy))
        to = len(weight) - 1 - np.searchsorted(suffix[::-1], r, side="left")
        to = np.minimum(np.maximum(to, of + 1), len(weight) - 1)
    live = x > 0
    return list(zip(of[live].tolist(), to[live].tolist(), x[live].tolist(), strict=True))


def approximate_solve(pivots: np.ndarray, inverse: np.ndarray, ends: np.ndarray, to: np.ndarray, share: np.ndarray, uneliminated: int, y: np.ndarray) -> np.ndarray:
    """One pass down and one up over the steps, for right sides (n, s)."""
    x = y.copy()
    starts = np.concatenate([[0], ends])[: len(ends)].astype(np.int64)
    if y.shape[1] == 1:  # plain numbers are faster than short arrays
        z, t, s = x[:, 0].tolist(), to.tolist(), share.tolist()
        spans = list(zip(pivots.tolist(), inverse.tolist(), starts.tolist(), ends.tolist(), strict=True))
        for p, _, a, b in spans:
            own = z[p]
            for i in range(a, b):
                z[t[i]] += s[i] * own
        if uneliminated >= 0:
            z[uneliminated] = 0.0
        for p, inv, a, b in reversed(spans):
            total = z[p] * inv
            for i in range(a, b):
                total += s[i] * z[t[i]]
            z[p] = total
        return np.array(z)[:, None]
    for p, a, b in zip(pivots, starts, ends, strict=True):
        x[to[a:b]] += share[a:b, None] * x[p]
    if uneliminated >= 0:
        x[uneliminated] = 0
    for i in range(len(pivots) - 1, -1, -1):
        a, b = starts[i], ends[i]
        x[pivots[i]] = x[pivots[i]] * inverse[i] + share[a:b] @ x[to[a:b]]
    return x


class Levels:
    """Steps for repeated solves, in runs of pivots that do not touch each other."""

    def __init__(self, pivots, inverse, ends, to, share, uneliminated: int, n: int):
        self.pivots, self.inverse, self.to, self.share, self.left = pivots, inverse, to, share, uneliminated
        self.ends = np.concatenate([[0], ends]).astype(np.int64)
        self.size = np.diff(self.ends)
        touched = np.full(n, -1)
        np.maximum.at(touched, to, np.repeat(np.arange(len(pivots)), self.size))
        self.cuts, start = [0], 0
        for i, at in enumerate(touched[pivots].tolist()):
            if at >= start and i > start:
                self.cuts.append(i)
                start = i
        self.cuts.append(len(pivots))

    def solve(self, y: np.ndarray) -> np.ndarray:
        """``approximate_solve`` for one right side."""
        x, runs = y.copy(), [(a, b, self.ends[a], self.ends[b]) for a, b in zip(self.cuts, self.cuts[1:], strict=False) if b > a]
        for a, b, lo, hi in runs:
            np.add.at(x, self.to[lo:hi], self.share[lo:hi] * np.repeat(x[self.pivots[a:b]], self.size[a:b]))
        if self.left >= 0:
            x[self.left] = 0.0
        for a, b, lo, hi in reversed(runs):
            back = np.bincount(np.repeat(np.arange(b - a), self.size[a:b]), self.share[lo:hi] * x[self.to[lo:hi]], b - a)
            x[self.pivots[a:b]] = x[self.pivots[a:b]] * self.inverse[a:b] + back
        return x


def prepared(y: np.ndarray, grounded: bool) -> np.ndarray:
    """Right sides (n, s) that the block can answer: the ground takes what is left over; without one the mean goes."""
    if grounded:
        y = y.copy()
        y[-1] = -y[:-1].sum(0)
        return y
    return y - y.mean(0)


def gradients(matrix: tuple, grounded: bool, apply, b: np.ndarray, tolerance: float, most: int) -> tuple[np.ndarray, int, float, float]:
    """Conjugate gradients on one block (diagonal, u, v, w): solution, iterations, squares of the residual and of ``b``.

    ``apply`` preconditions; the ground, the last vertex of a grounded block, stays at 0.
    """
    diagonal, u, v, w = matrix
    n = len(diagonal)

    def times(x: np.ndarray) -> np.ndarray:
        y = diagonal * x - np.bincount(u, w * x[v], n) - np.bincount(v, w * x[u], n)
        if grounded:
            y[-1] = 0.0
        return y

    x, r, size = np.zeros(n), b.copy(), float(b @ b)
    if size == 0:
        return x, 0, 0.0, 0.0
    left = size
    p, rz = None, 1.0
    for i in range(1, most + 1):
        z = apply(r)
        rz, before = float(r @ z), rz
        p = z if p is None else z + (rz / before) * p
        ap = times(p)
        curve = float(p @ ap)
        if not (curve > 0 and np.isfinite(rz)) or rz == 0:
            return x, i - 1, left, size
        x = x + (rz / curve) * p
        r = r - (rz / curve) * ap
        left = float(r @ r)
        if left <= tolerance * tolerance * size:
            break
    return x, i, left, size


def recovered(x: np.ndarray, grounded: bool, canonical: bool = True) -> np.ndarray:
    """Solutions with the last variable at 0; centred if the block floats and ``canonical`` is asked for."""
    x = x - x[-1]
    return x - x.mean(0) if canonical and not grounded else x


def failure_kind(infinite: bool) -> DenseFailure:
    return DenseFailure.NON_FINITE if infinite else DenseFailure.NON_POSITIVE
