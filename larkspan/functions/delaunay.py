"""Delaunay triangulation of integer points, exact, by incremental insertion."""

from __future__ import annotations


def _turn(a, b, c) -> int:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _inside(a, b, c, p) -> bool:
    """Whether p lies strictly inside the circle of the counter-clockwise triangle a b c."""
    rows = [(q[0] - p[0], q[1] - p[1]) for q in (a, b, c)]
    (ax, ay), (bx, by), (cx, cy) = rows
    a2, b2, c2 = (x * x + y * y for x, y in rows)
    return ax * (by * c2 - b2 * cy) - ay * (bx * c2 - b2 * cx) + a2 * (bx * cy - by * cx) > 0


def triangulate(points: list[tuple[int, int]]) -> set[tuple[int, int, int]]:
    """Faces as sorted index triples; none for fewer than three points or if all are on one line.

    Points are inserted in lexicographic order, each seeing the hull from outside: new triangles join it to the
    visible hull edges, then edges are flipped until every circle is empty. Equal points count once (the first index).
    """
    first: dict[tuple[int, int], int] = {}
    for i, p in enumerate(points):
        first.setdefault(tuple(p), i)
    order = sorted(first)
    if len(order) < 3:
        return set()
    # The points before the first that leaves the line of its predecessors form a fan with it.
    k = 2
    while k < len(order) and _turn(order[0], order[1], order[k]) == 0:
        k += 1
    if k == len(order):
        return set()
    across: dict[tuple, tuple] = {}  # directed edge (u, v) of a counter-clockwise triangle -> its third point

    def add(a, b, c) -> None:
        across[a, b], across[b, c], across[c, a] = c, a, b

    def drop(a, b, c) -> None:
        for e in ((a, b), (b, c), (c, a)):
            del across[e]

    def settle(edges: list) -> None:
        while edges:
            a, b = edges.pop()
            c, d = across.get((a, b)), across.get((b, a))
            if c is None or d is None or not _inside(a, b, c, d):
                continue
            drop(a, b, c)
            drop(b, a, d)
            add(a, d, c)
            add(d, b, c)
            edges += [(a, d), (d, b), (b, c), (c, a)]

    line, apex = order[:k], order[k]
    left = _turn(line[0], line[1], apex) > 0
    hull = [*line, apex] if left else [*reversed(line), apex]  # counter-clockwise
    for a, b in zip(hull[:-1], hull[1:-1], strict=False):
        add(a, b, apex)
    settle([(a, b) for a, b in list(across)])
    for p in order[k + 1 :]:
        n = len(hull)
        visible = [_turn(hull[i], hull[(i + 1) % n], p) < 0 for i in range(n)]
        start = next(i for i in range(n) if visible[i] and not visible[i - 1])
        i, fresh = start, []
        while visible[i % n] and i - start < n:
            a, b = hull[i % n], hull[(i + 1) % n]
            add(b, a, p)
            fresh.append((b, a))
            i += 1
        rest = [hull[j % n] for j in range(i, start + n + 1)]
        hull = [*rest, p]
        settle(fresh)
    return {tuple(sorted((first[a], first[b], first[c]))) for (a, b), c in across.items()}
