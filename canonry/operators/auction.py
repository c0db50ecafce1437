"""Exact maximum-weight matching of a large graph of two sides, in flat arrays.

The nodes of the smaller side bid for those of the other, whose prices begin at
nothing: each round every node without a partner offers for its best one what makes its
second best as good, and for one that is taken a small step more at least, so bids
end.  What is left is made exact: the profit of a bidder is the best that prices leave
it, pairs that are not worth that are parted, and from each node with a price and no
partner the nearest end of an alternating way is searched, as in ``solver`` but without
blossoms.  Prices are near their last by then, so searches are short.  At the end every
node without a partner has no price, which proves the matching heaviest."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np

#: The least step of a bid, as a part of the greatest weight.
STEPS = 1000
#: Rounds of bids at most, and bidders without partners that are left to the search.
BIDS, FEW = 4_000, 32
#: Edges that a round looks at together.
AT_ONCE = 1_000_000


def sides(u: np.ndarray, v: np.ndarray) -> np.ndarray | None:
    """The side of each node, by number; None if a cycle is odd."""
    n = int(max(u.max(), v.max())) + 1
    left, right = np.zeros(n, bool), np.zeros(n, bool)
    left[u], right[v] = True, True
    if not (left & right).any():
        return right
    src, dst = np.concatenate((u, v)), np.concatenate((v, u))
    dst, ptr = dst[np.argsort(src, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(src, minlength=n))))
    side = np.full(n, -1, np.int8)
    for start in range(n):
        if side[start] >= 0:
            continue
        side[start], now = 0, np.array([start])
        while len(now):
            size = ptr[now + 1] - ptr[now]
            near = dst[np.repeat(ptr[now] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            fresh = np.unique(near[side[near] < 0])
            side[fresh] = 1 - side[now[0]]
            now = fresh
    return side.astype(bool) if (side[u] != side[v]).all() else None


class TwoSided:
    """Edges from bidders ``b`` to objects ``a``, both numbered from 0, of positive whole
    weights and in order of ``b``."""

    def __init__(self, b: np.ndarray, a: np.ndarray, w: np.ndarray):
        self.b, self.a, self.w = b, a, w
        self.ptr = np.concatenate(([0], np.cumsum(np.bincount(b))))
        self.n, self.objects = len(self.ptr) - 1, int(a.max()) + 1
        self.price = np.zeros(self.objects, np.int64)
        self.owner, self.mate = np.full(self.objects, -1, np.int32), np.full(self.n, -1, np.int32)

    def _parts(self, active: np.ndarray):
        """Bidders with their edges, and where each one's begin, so many at a time."""
        size = self.ptr[active + 1] - self.ptr[active]
        cut = np.flatnonzero(np.diff(np.cumsum(size) // AT_ONCE)) + 1
        for own, n in zip(np.split(active, cut), np.split(size, cut), strict=True):
            first = np.cumsum(n) - n
            yield own, n, first, np.repeat(self.ptr[own] - first, n) + np.arange(n.sum())

    def _offers(self, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best object of each bidder, the least of equal ones, and what it and the next best are worth."""
        best, most, next_ = [], [], []
        for own, n, first, at in self._parts(active):
            worth = self.w[at] - self.price[self.a[at]]
            top = np.maximum.reduceat(worth, first)
            hit = np.flatnonzero(worth == np.repeat(top, n))
            hit = hit[np.flatnonzero(np.diff(np.repeat(np.arange(len(own)), n)[hit], prepend=-1))]
            worth[hit] = 0
            best.append(self.a[at[hit]])
            most.append(top)
            next_.append(np.maximum(np.maximum.reduceat(worth, first), 0))
        return np.concatenate(best), np.concatenate(most), np.concatenate(next_)

    def bid(self) -> None:
        step, active = max(1, int(self.w.max()) // STEPS), np.arange(self.n)
        for _ in range(BIDS):
            if len(active) <= FEW:
                return
            a, most, next_ = self._offers(active)
            go = most > 0
            b, a = active[go], a[go]
            offer = self.price[a] + np.maximum((most - next_)[go], np.where(self.owner[a] >= 0, step, 0))
            # The highest offer for an object has it, the first bidder's of equal ones.
            order = np.lexsort((b, -offer, a))
            order = order[np.flatnonzero(np.diff(a[order], prepend=-1))]
            got, by = a[order], b[order]
            out = self.owner[got]
            out = out[out >= 0]
            self.mate[out] = -1
            self.owner[got], self.mate[by], self.price[got] = by, got, offer[order]
            active = np.sort(np.concatenate((b[self.mate[b] != a], out)))

    def part(self) -> np.ndarray:
        """Profits of bidders; pairs that are not worth their prices are parted."""
        profit = np.zeros(self.n, np.int64)
        for own, n, first, at in self._parts(np.arange(self.n)):
            worth = self.w[at] - self.price[self.a[at]]
            profit[own] = np.maximum(np.maximum.reduceat(worth, first), 0)
            b, a = self.b[at], self.a[at]
            loose = np.flatnonzero((self.mate[b] == a) & (worth < profit[b]))
            self.mate[b[loose]], self.owner[a[loose]] = -1, -1
        return profit

    def solve(self) -> np.ndarray:
        """Which edges are in the matching."""
        self.bid()
        price = self.part().tolist() + self.price.tolist()
        n, w, to, by = self.n, self.w, self.a, self.b
        mate = np.where(self.mate >= 0, self.mate + n, -1).tolist() + self.owner.tolist()
        back, own = np.argsort(to, kind="stable").astype(np.int32), self.ptr.tolist()
        theirs = np.concatenate(([0], np.cumsum(np.bincount(to)))).tolist()
        for root in range(len(mate)):
            if mate[root] < 0 and price[root] > 0:
                self._search(root, price, mate, own, theirs, back)
        # Of several edges of a pair all are told.
        return (np.array(mate[:n], np.int32) - n)[by] == to

    def _search(self, root: int, price: list, mate: list, own: list, theirs: list, back: np.ndarray) -> None:
        n, w, to, by = self.n, self.w, self.a, self.b
        far, reached, via, done, heap = {root: 0}, {}, {}, [], []
        # The nearest end of a way: a node without a partner, or one of the root's side that goes without.
        best, end, alone = price[root], root, True
        x, d = root, 0
        while x >= 0:
            if x < n:
                lo, hi = own[x], own[x + 1]
                near, weight = (to[lo:hi] + n).tolist(), w[lo:hi].tolist()
            else:
                at = back[theirs[x - n] : theirs[x - n + 1]]
                near, weight = by[at].tolist(), w[at].tolist()
            base = d + price[x]
            for y, much in zip(near, weight, strict=True):
                there = base + price[y] - much
                if there < best and there < reached.get(y, best):
                    reached[y], via[y] = there, x
                    if mate[y] < 0:
                        best, end, alone = there, y, False
                    else:
                        heappush(heap, (there, y))
            x = -1
            while heap:
                there, y = heappop(heap)
                if there >= best:
                    break
                if mate[y] not in far:
                    x, d = mate[y], there
                    far[x] = there
                    done.append(y)
                    if there + price[x] < best:
                        best, end, alone = there + price[x], x, True
                    break
        for x, there in far.items():
            price[x] -= max(0, best - there)
        for y in done:
            price[y] += max(0, best - reached[y])
        if end == root:
            return
        y = end
        if alone:
            y, mate[end] = mate[end], -1
        while True:
            x = via[y]
            before, mate[x], mate[y] = mate[x], y, x
            if x == root:
                return
            y = before


def matching(edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
    """The ends of those of ``edges`` ([u, v, w]: numbers of nodes, and whole weights) that
    are in a matching of greatest total weight; None if the graph has an odd cycle, else
    the list is emptied, so that edges are held once.  Equal inputs give equal outputs, in
    any order of edges."""
    u, v, w = edges
    if not (w > 0).all():
        u, v, w = (x[w > 0] for x in (u, v, w))
    if not len(w):
        return u, v
    side = sides(u, v)
    if side is None:
        return None
    edges.clear()
    # Numbers of their own for the nodes of each side that have edges; the smaller side bids.
    used = np.zeros(len(side), bool)
    used[u] = used[v] = True
    right = bool((used & side).sum() < (used & ~side).sum())
    bids = side == right
    place = (np.where(bids, np.cumsum(used & bids), np.cumsum(used & ~bids)) - 1).astype(np.int32)
    names = [np.flatnonzero(used & of).astype(np.int32) for of in (bids, ~bids)]
    first = bids[u]
    b, a = place[np.where(first, u, v)], place[np.where(first, v, u)]
    del u, v, first
    order = np.lexsort((a, b))
    b, a = b[order], a[order]
    w = w[order]
    del order
    found = TwoSided(b, a, w).solve()
    x, y = names[0][b[found]], names[1][a[found]]
    return np.minimum(x, y), np.maximum(x, y)
