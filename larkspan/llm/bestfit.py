"""Best-fit decreasing over counts of equal sizes.

Items of one size are alike, and so are bins with the same room left. So the state is a count per size
and, for every room, runs of bins that have it; a balanced tree finds the tightest room that holds a
size. The work depends on the number of different sizes, not on the number of items.
"""

from __future__ import annotations


class _Node:
    __slots__ = ("key", "runs", "left", "right", "height")

    def __init__(self, key: int):
        self.key, self.runs, self.left, self.right, self.height = key, [], None, None, 1


def _height(n: _Node | None) -> int:
    return n.height if n else 0


def _turn(n: _Node, up: str, other: str) -> _Node:
    """Rotate the child at ``up`` above ``n``."""
    child = getattr(n, up)
    setattr(n, up, getattr(child, other))
    setattr(child, other, n)
    n.height = 1 + max(_height(n.left), _height(n.right))
    child.height = 1 + max(_height(child.left), _height(child.right))
    return child


def _balanced(n: _Node) -> _Node:
    lean = _height(n.left) - _height(n.right)
    if lean > 1:
        if _height(n.left.left) < _height(n.left.right):
            n.left = _turn(n.left, "right", "left")
        return _turn(n, "left", "right")
    if lean < -1:
        if _height(n.right.right) < _height(n.right.left):
            n.right = _turn(n.right, "left", "right")
        return _turn(n, "right", "left")
    n.height = 1 + max(_height(n.left), _height(n.right))
    return n


class RoomTree:
    """A balanced (AVL) tree from room left to the runs of bins, (first bin, number), that have it."""

    def __init__(self):
        self.root: _Node | None = None

    def add(self, room: int, first: int, n: int) -> None:
        if not room or not n:
            return

        def put(node: _Node | None) -> _Node:
            if node is None:
                node = _Node(room)
            if room == node.key:
                node.runs.append((first, n))
                return node
            if room < node.key:
                node.left = put(node.left)
            else:
                node.right = put(node.right)
            return _balanced(node)

        self.root = put(self.root)

    def take(self, size: int) -> tuple[int, int, int] | None:
        """Remove and return a run with the least room of ``size`` at least: (room, first, number)."""
        node, best = self.root, None
        while node:
            if node.key >= size:
                node, best = node.left, node
            else:
                node = node.right
        if best is None:
            return None
        room = best.key  # the node may hold another key after a removal
        first, n = best.runs.pop()
        if not best.runs:
            self.root = self._drop(self.root, room)
        return room, first, n

    def _drop(self, node: _Node, key: int) -> _Node | None:
        if key < node.key:
            node.left = self._drop(node.left, key)
        elif key > node.key:
            node.right = self._drop(node.right, key)
        elif node.left and node.right:
            low = node.right
            while low.left:
                low = low.left
            node.key, node.runs = low.key, low.runs
            node.right = self._drop(node.right, low.key)
        else:
            return node.left or node.right
        return _balanced(node)


def best_fit_decreasing(counts: dict[int, int], capacity: int, bins: int | None = None):
    """Put counts[size] items of every size into bins of ``capacity``.

    bins: None opens bins as needed; a number opens that many and no more.
    Returns (intervals, number of bins), or None if the given bins do not suffice. An interval
    (size, rank, bin, each, used) begins at the rank-th item of its size: item rank + i goes to bin
    + i // each, behind ``used`` and i % each items of its size.
    """
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        if bins is not None:
            return None
        raise ValueError("sizes must lie between 1 and the capacity")
    tree, opened, out = RoomTree(), bins or 0, []
    tree.add(capacity, 0, opened)
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            found = tree.take(size)
            if found is None:
                if bins is not None:
                    return None
                new = -(-left // (capacity // size))
                tree.add(capacity, opened, new)
                opened += new
                continue
            room, first, n = found
            each = room // size
            full, rest = divmod(min(left, n * each), each)
            out.append((size, rank, first, each, capacity - room))
            tree.add(room - each * size, first, full)
            if rest:
                tree.add(room - rest * size, first + full, 1)
            tree.add(room, first + full + bool(rest), n - full - bool(rest))
            rank += full * each + rest
            left -= full * each + rest
    return sorted(out), opened


def least_capacity(counts: dict[int, int], bins: int) -> tuple[int, list]:
    """The smallest capacity, by bisection, at which ``bins`` bins suffice, and its intervals."""
    total = sum(size * n for size, n in counts.items())
    low = max([-(-total // bins), *counts, 1])
    high, best = low, None
    step = max(1, low // 1000)
    while (best := best_fit_decreasing(counts, high, bins)) is None:
        low, high, step = high + 1, high + step, step * 2
    while low < high:
        mid = (low + high) // 2
        if (found := best_fit_decreasing(counts, mid, bins)) is None:
            low = mid + 1
        else:
            high, best = mid, found
    return high, best[0]
