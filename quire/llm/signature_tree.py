"""Signature trees: sets are compared node pair by node pair, from the roots down.

A leaf holds a few sets, in order of size; an inner node a few nodes. Each has the OR of its sets' token bitmaps, the range
of their sizes, and the most tokens by which a set outnumbers the bits of its bitmap. Two nodes' sets cannot have more
tokens in common than their bitmaps have bits in common plus the lesser of those excesses; node pairs for which that,
or the size ranges, rule out every link are pruned, and so are pairs whose sets are all in one component already.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LEAF, FAN = 16, 4


def width(n: int) -> int:
    """The bits of the bitmap of a set of ``n`` tokens: a power of two that leaves a third of them empty or more."""
    return max(256, 1 << (n - 1).bit_length())


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """A set's bitmap: bit h mod ``bits`` for each token hash. The OR of its halves is the bitmap of half the bits."""
    out = np.zeros(bits, dtype=np.uint8)
    out[(tokens % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(out).view(np.uint64)


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Tokens that two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


class _Roots:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def link(sizes: np.ndarray, bitmaps: np.ndarray, num: int, den: int, linked: Callable[[int, int], bool] | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, root) that join all sets into their components under Jaccard similarity >= num / den.

    ``linked`` decides a pair that the bitmaps allow; without it all those count as linked, which can only join more.
    Sets of equal ``known`` are in one component from the start. Sets must not be empty. Every pair is compared or ruled
    out, but for pairs that others have joined before.
    """
    m = len(sizes)
    if m < 2:
        return []
    order = np.lexsort((bitmaps[:, 0], sizes))
    n, sig = sizes[order].astype(np.int64), bitmaps[order]
    excess, roots = n - np.bitwise_count(sig).sum(axis=1, dtype=np.int64), _Roots(m)
    if known is not None:
        _, head, which = np.unique(known[order], return_index=True, return_inverse=True)
        roots.up = head[which].tolist()

    # levels[0] are the leaves; each level: OR bitmap, least and greatest size, greatest excess, first and last set
    first = np.arange(0, m, LEAF)
    levels = [(np.bitwise_or.reduceat(sig, first), n[first], np.maximum.reduceat(n, first), np.maximum.reduceat(excess, first), first, np.append(first[1:], m))]
    while len(levels[-1][0]) > 1:
        o, lo, hi, ex, beg, end = levels[-1]
        at = np.arange(0, len(o), FAN)
        levels.append((np.bitwise_or.reduceat(o, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at), beg[at], end[np.append(at[1:], len(o)) - 1]))
    joined: set[tuple[int, int]] = set()

    def one(level: int, k: int) -> int:
        """The component that all of a node's sets are in, or -1."""
        beg, end = int(levels[level][4][k]), int(levels[level][5][k])
        root = roots.find(beg)
        if (level, k) not in joined:
            if any(roots.find(i) != root for i in range(beg, end)):
                return -1
            joined.add((level, k))  # components only grow
        return root

    def possible(level: int, x: int, y: int) -> bool:
        o, lo, hi, ex, _, _ = levels[level]
        if hi[x] * den < lo[y] * num or hi[y] * den < lo[x] * num:
            return False
        most = int(np.bitwise_count(o[x] & o[y]).sum()) + int(min(ex[x], ex[y]))
        return most * (num + den) >= num * int(lo[x] + lo[y])

    stack = [(len(levels) - 1, 0, 0)]
    while stack:
        level, x, y = stack.pop()
        if x != y and not possible(level, x, y):
            continue
        if (r := one(level, x)) >= 0 and (x == y or one(level, y) == r):
            continue
        if level:
            kids = [range(FAN * k, min(FAN * (k + 1), len(levels[level - 1][0]))) for k in (x, y)]
            stack += [(level - 1, i, j) for i in kids[0] for j in kids[1] if x != y or i <= j][::-1]
            continue
        _, _, _, _, beg, end = levels[0]
        a, b = np.arange(beg[x], end[x]), np.arange(beg[y], end[y])
        na, nb, sa, sb = n[a][:, None], n[b][None], sig[a][:, None], sig[b][None]
        most = np.minimum(np.bitwise_count(sa & sb).sum(axis=2, dtype=np.int64) + np.minimum(excess[a][:, None], excess[b][None]), (na + nb - np.bitwise_count(sa ^ sb).sum(axis=2, dtype=np.int64)) // 2)
        ok = (most * (num + den) >= num * (na + nb)) & (na * den >= nb * num) & (nb * den >= na * num)
        if x == y:
            ok = np.triu(ok, 1)
        for i, j in zip(*(q.tolist() for q in np.nonzero(ok)), strict=True):
            i, j = int(a[i]), int(b[j])
            if roots.find(i) != roots.find(j) and (linked is None or linked(int(order[i]), int(order[j]))):
                roots.union(i, j)
    return [(int(order[i]), int(order[r])) for i in range(m) if (r := roots.find(i)) != i]


def link_any(sizes: np.ndarray, bitmaps: list[bytes], num: int, den: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """:func:`link` without ``linked``, for bitmaps of different widths (those of :func:`width`).

    Sets that can link differ in width by one step at most: each width is taken alone, with the sets of the next one that
    are small enough, folded to it.
    """
    bits = np.array([8 * len(b) for b in bitmaps])
    out = []
    for w in np.unique(bits).tolist():
        mine = np.flatnonzero(bits == w)
        above = np.flatnonzero((bits == 2 * w) & (sizes * num <= den * sizes[mine].max()))
        if len(mine) + len(above) < 2:
            continue
        sig = [np.frombuffer(b"".join(bitmaps[i] for i in mine), dtype=np.uint64).reshape(len(mine), -1)]
        if len(above):
            wide = np.frombuffer(b"".join(bitmaps[i] for i in above), dtype=np.uint64).reshape(len(above), 2, -1)
            sig.append(wide[:, 0] | wide[:, 1])
        at = np.concatenate([mine, above])
        out += [(int(at[i]), int(at[j])) for i, j in link(sizes[at], np.concatenate(sig), num, den, known=None if known is None else known[at])]
    return out
