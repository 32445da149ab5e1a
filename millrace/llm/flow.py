"""Minimum-cost flow on a small network."""

from __future__ import annotations

import heapq


class Network:
    """Arcs with whole capacities and costs of at least zero."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.left: list[int] = []  # capacity left; arc k ^ 1 runs against arc k
        self.cost: list[int] = []

    def arc(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        number = len(self.head)
        for at, to, left, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[at].append(len(self.head))
            self.head.append(to)
            self.left.append(left)
            self.cost.append(price)
        return number

    def flow(self, arc: int) -> int:
        return self.left[arc ^ 1]

    def solve(self, source: int, sink: int) -> int:
        """Send as much as will go, at the least cost, by cheapest paths; how much went."""
        nodes, sent = len(self.out), 0
        potential = [0] * nodes
        while True:
            distance: list[float] = [float("inf")] * nodes
            distance[source], via, queue = 0, [-1] * nodes, [(0, source)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > distance[a]:
                    continue
                for k in self.out[a]:
                    b = self.head[k]
                    price = d + self.cost[k] + potential[a] - potential[b]
                    if self.left[k] > 0 and price < distance[b]:
                        distance[b], via[b] = price, k
                        heapq.heappush(queue, (price, b))
            if via[sink] < 0:
                return sent
            potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, distance, strict=True)]
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.head[via[at] ^ 1]
            amount = min(self.left[k] for k in path)
            for k in path:
                self.left[k] -= amount
                self.left[k ^ 1] += amount
            sent += amount


def route(
    capacities: dict[tuple, int], quotas: dict, copies: int
) -> dict[tuple, dict]:
    """Tokens each pattern (a tuple of the sources its documents belong to) gives each source.

    As much of the quotas is met as can be, and the k-th copy of a pattern costs k - 1 a token, so
    nothing is repeated where something unused would do, and repeats are spread.
    """
    patterns, sources = list(capacities), list(quotas)
    net = Network(2 + len(patterns) + len(sources))
    place = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
    routes = {}
    for i, pattern in enumerate(patterns):
        for k in range(copies):
            net.arc(0, 2 + i, capacities[pattern], k)
        for s in pattern:
            if s in place:
                routes[pattern, s] = net.arc(2 + i, place[s], copies * capacities[pattern])
    for s in sources:
        net.arc(place[s], 1, quotas[s])
    net.solve(0, 1)
    given: dict[tuple, dict] = {pattern: {} for pattern in patterns}
    for (pattern, s), arc in routes.items():
        given[pattern][s] = net.flow(arc)
    return given
