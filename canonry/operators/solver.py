"""Exact maximum-weight matching of one graph, whatever its cycles.

Every node has a price, and an edge's slack is what its ends' prices (and those of
the odd sets, the blossoms, that hold both) exceed twice its weight by.  Prices
begin at each node's best weight, so slack is never negative, and edges that are
the best of both ends are matched at once.  From each node that is left an
alternating tree of edges without slack grows: prices fall on its outer nodes and
rise on its inner ones until the next edge loses its slack, an outer node's price
is nothing (it may stay alone), an odd cycle closes (it is shrunk to a blossom), or
an inner blossom's price is nothing (it is opened).  What happens next comes from a
heap, and trees reach no further than they must, so long chains cost little.  At
the end every unmatched node has no price, which proves the matching heaviest.
Nothing recurses.
"""

from __future__ import annotations

import heapq

#: Weights are compared as whole numbers of this fraction.
SCALE = 10**10

_OUTER, _INNER = 1, 2
_ALONE, _GROW, _SHRINK, _OPEN = range(4)


class Blossoms:
    """``near[u]``: neighbours of node u with positive whole weights."""

    def __init__(self, near: list[dict[int, int]]):
        self.near, n = near, len(near)
        self.n = n
        self.mate = [-1] * n
        self.price = [max(d.values(), default=0) for d in near]
        #: Outermost blossom (or node) of each node.
        self.top = list(range(n))
        # Of nodes and blossoms: enclosing blossom, base, members in a ring from the
        # base on, edges from each member to the next, price.
        self.within: dict[int, int] = {}
        self.base = dict(enumerate(range(n)))
        self.ring: dict[int, list[int]] = {}
        self.links: dict[int, list[tuple[int, int]]] = {}
        self.worth: dict[int, int] = {}
        self.next_id = n
        for u in range(n):
            if self.mate[u] < 0:
                v = next((v for v in near[u] if self.mate[v] < 0 and near[u][v] == self.price[u] == self.price[v]), -1)
                if v >= 0:
                    self.mate[u], self.mate[v] = v, u

    def nodes(self, b: int) -> list[int]:
        out, open_ = [], [b]
        while open_:
            x = open_.pop()
            if x < self.n:
                out.append(x)
            else:
                open_ += self.ring[x]
        return out

    def solve(self) -> list[int]:
        # Dear nodes first: later trees end sooner, where prices are low.
        for root in sorted(range(self.n), key=lambda u: (-self.price[u], u)):
            if self.mate[root] < 0 and self.price[root] > 0:
                self._search(root)
        return self.mate

    # -- one tree -------------------------------------------------------------

    def _search(self, root: int) -> None:
        self.now = 0
        self.events: list[tuple[int, int, int, int]] = []
        #: Outer or inner, for outermost blossoms in the tree, and the edge by
        #: which each was reached, from its parent's node to its own.
        self.mark: dict[int, int] = {}
        self.via: dict[int, tuple[int, int] | None] = {}
        # How prices change as time goes by, and when they were last written down.
        self.rate: dict[int, int] = {}
        self.since: dict[int, int] = {}
        self._outer(self.top[root], None)
        while True:
            self.now, kind, a, b = heapq.heappop(self.events)
            if kind == _ALONE:
                self._flip(a, -1)
                break
            if kind == _OPEN:
                if self.mark.get(a) == _INNER and a not in self.within and self._worth(a) == 0:
                    self._open(a)
                continue
            x, y = self.top[a], self.top[b]
            if x == y or self._slack(a, b):
                continue
            if kind == _SHRINK:
                self._shrink(a, b)
            elif y not in self.mark:
                tip = self.base[y]
                if self.mate[tip] < 0:
                    self._turn(y, b)
                    self.mate[b] = a
                    self._flip(a, b)
                    break
                self._inner(y, (a, b))
                self._outer(self.top[self.mate[tip]], (tip, self.mate[tip]))
        for x in list(self.rate):
            self._pace(x, 0)

    def _price(self, u: int) -> int:
        return self.price[u] + self.rate.get(u, 0) * (self.now - self.since.get(u, 0))

    def _worth(self, b: int) -> int:
        return self.worth[b] + self.rate.get(b, 0) * (self.now - self.since.get(b, 0))

    def _slack(self, u: int, v: int) -> int:
        return self._price(u) + self._price(v) - 2 * self.near[u][v]

    def _pace(self, x: int, rate: int) -> None:
        """Write a price down; from now on it changes at another rate."""
        if x < self.n:
            self.price[x] = self._price(x)
        elif x in self.worth:
            self.worth[x] = self._worth(x)
        self.rate[x], self.since[x] = rate, self.now

    def _outer(self, b: int, via: tuple[int, int] | None) -> None:
        self.mark[b], self.via[b] = _OUTER, via
        if b >= self.n:
            self._pace(b, 2)
        self._reach(self.nodes(b))

    def _reach(self, fresh: list[int]) -> None:
        """Nodes that have become outer: what their edges may lead to, and when."""
        for u in fresh:
            self._pace(u, -1)
            heapq.heappush(self.events, (self.now + self.price[u], _ALONE, u, 0))
        for u in fresh:
            for v in self.near[u]:
                if self.top[v] != self.top[u]:
                    self._watch(u, v)

    def _watch(self, u: int, v: int) -> None:
        """An edge from an outer node, unless it leads to an inner one."""
        mark = self.mark.get(self.top[v])
        if mark == _OUTER:
            heapq.heappush(self.events, (self.now + self._slack(u, v) // 2, _SHRINK, u, v))
        elif mark is None:
            heapq.heappush(self.events, (self.now + self._slack(u, v), _GROW, u, v))

    def _inner(self, b: int, via: tuple[int, int]) -> None:
        self.mark[b], self.via[b] = _INNER, via
        for u in self.nodes(b):
            self._pace(u, 1)
        if b >= self.n:
            self._pace(b, -2)
            heapq.heappush(self.events, (self.now + self.worth[b] // 2, _OPEN, b, 0))

    def _up(self, b: int) -> list[int]:
        """From a blossom to the root."""
        out = [b]
        while (via := self.via[out[-1]]) is not None:
            out.append(self.top[via[0]])
        return out

    def _shrink(self, u: int, v: int) -> None:
        left, right = self._up(self.top[u]), self._up(self.top[v])
        while len(left) > 1 and len(right) > 1 and left[-2] == right[-2]:
            left.pop()
            right.pop()
        # From the common ancestor down to u, over to v, and up again.
        ring = left[::-1] + right[:-1]
        links = [self.via[x] for x in left[-2::-1]] + [(u, v)] + [self.via[x][::-1] for x in right[:-1]]
        b = self.next_id
        self.next_id += 1
        self.ring[b], self.links[b], self.base[b], self.worth[b] = ring, links, self.base[ring[0]], 0
        self.mark[b], self.via[b] = _OUTER, self.via[ring[0]]
        fresh = []
        for x in ring:
            nodes = self.nodes(x)
            if self.mark.pop(x) == _INNER:
                fresh += nodes
            if x >= self.n:
                self._pace(x, 0)
            self.within[x] = b
            for w in nodes:
                self.top[w] = b
        self._pace(b, 2)
        self._reach(fresh)

    def _open(self, b: int) -> None:
        """Take an inner blossom apart: the even way round from where the tree enters
        to the base stays in the tree, all else leaves it."""
        ring, links, via = self.ring.pop(b), self.links.pop(b), self.via.pop(b)
        del self.mark[b], self.worth[b], self.base[b], self.rate[b]
        for x in ring:
            del self.within[x]
            for w in self.nodes(x):
                self.top[w] = x
        k = ring.index(self.top[via[1]])
        out = set(ring)
        fresh: list[tuple[int, tuple[int, int]]] = []
        while True:
            self._inner(ring[k], via)
            out.discard(ring[k])
            if k == 0:
                break
            on = 1 if k % 2 else -1
            for outer in (True, False):
                edge = links[k] if on == 1 else links[k - 1][::-1]
                k = (k + on) % len(ring)
                if outer:
                    fresh.append((ring[k], edge))
                    self.mark[ring[k]] = _OUTER
                    out.discard(ring[k])
                else:
                    via = edge
        for x in out:
            for w in self.nodes(x):
                self._pace(w, 0)
        for x, edge in fresh:
            self._outer(x, edge)
        for x in out:
            for w in self.nodes(x):
                for v in self.near[w]:
                    if self.mark.get(self.top[v]) == _OUTER:
                        self._watch(v, w)

    # -- matched edges --------------------------------------------------------

    def _flip(self, u: int, partner: int) -> None:
        """Match outer node u anew, and all along the way to the root."""
        while True:
            b = self.top[u]
            via = self.via[b]
            self._turn(b, u)
            self.mate[u] = partner
            if via is None:
                return
            inner = self.top[via[0]]
            u, partner = self.via[inner]
            self._turn(inner, partner)
            self.mate[partner] = u

    def _turn(self, b: int, u: int) -> None:
        """Make node u the base of blossom b; its other members pair up."""
        todo = [(b, u)]
        while todo:
            b, u = todo.pop()
            if b < self.n or self.base[b] == u:
                continue
            x = u
            while self.within[x] != b:
                x = self.within[x]
            ring, links = self.ring[b], self.links[b]
            k, size = ring.index(x), len(ring)
            todo.append((x, u))
            pairs = range(k + 1, size, 2) if k % 2 else range(0, k, 2)
            for i in pairs:
                p, q = links[i]
                self.mate[p], self.mate[q] = q, p
                todo += [(ring[i], p), (ring[(i + 1) % size], q)]
            self.ring[b], self.links[b], self.base[b] = ring[k:] + ring[:k], links[k:] + links[:k], u


def heaviest(best: dict[tuple, int]) -> set[tuple]:
    """Pairs of a matching of greatest total weight; ``best``: positive whole weights of
    pairs (u, v), u < v."""
    names = sorted({x for pair in best for x in pair})
    place = {x: i for i, x in enumerate(names)}
    near: list[dict[int, int]] = [{} for _ in names]
    for (u, v), w in sorted(best.items()):
        near[place[u]][place[v]] = near[place[v]][place[u]] = w
    mate = Blossoms(near).solve()
    return {(names[u], names[v]) for u, v in enumerate(mate) if u < v}


def matching(edges: list[tuple]) -> set[tuple]:
    """Pairs (u, v), u < v, of a matching of greatest total weight; weights are
    rounded to ``1 / SCALE`` and edges of no weight are left out.  Equal inputs
    give equal outputs, in any order of edges."""
    best: dict[tuple, int] = {}
    for u, v, w in edges:
        pair, whole = (min(u, v), max(u, v)), round(w * SCALE)
        if u != v and whole > 0:
            best[pair] = max(whole, best.get(pair, 0))
    return heaviest(best)
