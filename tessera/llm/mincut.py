"""Minimum cuts of small undirected graphs with terminals."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

TINY = 1e-9


def source_side(to_source: Sequence[float], to_sink: Sequence[float], edges: Sequence[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in the minimum cut.

    Node i has an arc from the source of capacity ``to_source[i]`` and one to the sink of ``to_sink[i]``; edges have
    their capacity both ways. Maximum flow by blocking flows on level graphs; what the source still reaches is its side.
    """
    n = len(to_source)
    s, t = n, n + 1
    head: list[int] = []
    room: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, forth: float, back: float) -> None:
        arcs[a].append(len(head))
        arcs[b].append(len(head) + 1)
        head.extend((b, a))
        room.extend((forth, back))

    for i in range(n):
        both = min(to_source[i], to_sink[i])  # flows straight through
        if to_source[i] - both > TINY:
            add(s, i, to_source[i] - both, 0.0)
        if to_sink[i] - both > TINY:
            add(i, t, to_sink[i] - both, 0.0)
    for a, b, c in edges:
        if a != b and c > TINY:
            add(a, b, c, c)

    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        todo = deque([s])
        while todo:
            a = todo.popleft()
            for e in arcs[a]:
                if room[e] > TINY and level[head[e]] < 0:
                    level[head[e]] = level[a] + 1
                    todo.append(head[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        node = s
        while True:
            if node == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(i for i, e in enumerate(path) if room[e] <= TINY)
                node = head[path[full] ^ 1]
                del path[full:]
                continue
            while at[node] < len(arcs[node]):
                e = arcs[node][at[node]]
                if room[e] > TINY and level[head[e]] == level[node] + 1:
                    break
                at[node] += 1
            if at[node] < len(arcs[node]):
                path.append(e)
                node = head[e]
            elif node == s:
                break
            else:
                node = head[path.pop() ^ 1]
                at[node] += 1
