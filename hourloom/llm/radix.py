"""An adaptive radix tree: byte keys, nodes that grow from 4 over 16 and 48 to 256 children, compressed paths.

A node holds the bytes of the path that leads to it from its parent (the branch byte first), and a value where a key ends.
Nodes of 4 and 16 keep their branch bytes sorted beside their children; of 48 an index of 256 bytes says where a child
stands; of 256 children stand at their byte.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

# The four node sizes.
LAYOUTS = (4, 16, 48, 256)


class Node:
    __slots__ = ("path", "value", "size", "index", "children")

    def __init__(self, path: bytes, value: int | None = None):
        self.path, self.value = path, value
        self.size, self.index, self.children = LAYOUTS[0], bytearray(), []

    def find(self, byte: int) -> Node | None:
        if self.size <= 16:
            at = bisect_left(self.index, byte)
            return self.children[at] if at < len(self.index) and self.index[at] == byte else None
        if self.size == 48:
            at = self.index[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, byte: int, child: Node) -> None:
        """Add a child, or replace the one at this byte."""
        if self.size <= 16:
            at = bisect_left(self.index, byte)
            if at < len(self.index) and self.index[at] == byte:
                self.children[at] = child
            elif len(self.index) < self.size:
                self.index.insert(at, byte)
                self.children.insert(at, child)
            else:
                self._grow()
                self.put(byte, child)
        elif self.size == 48:
            if self.index[byte]:
                self.children[self.index[byte] - 1] = child
            elif len(self.children) < 48:
                self.children.append(child)
                self.index[byte] = len(self.children)
            else:
                self._grow()
                self.put(byte, child)
        else:
            self.children[byte] = child

    def _grow(self) -> None:
        held = list(self.items())
        self.size = LAYOUTS[LAYOUTS.index(self.size) + 1]
        if self.size == 48:
            self.index = bytearray(256)
            for at, (byte, _) in enumerate(held):
                self.index[byte] = at + 1
            self.children = [c for _, c in held]
        elif self.size == 256:
            self.index, self.children = bytearray(), [None] * 256
            for byte, c in held:
                self.children[byte] = c

    def items(self) -> Iterator[tuple[int, Node]]:
        """(byte, child) by rising byte."""
        if self.size <= 16:
            yield from zip(self.index, self.children)
        elif self.size == 48:
            yield from ((b, self.children[at - 1]) for b, at in enumerate(self.index) if at)
        else:
            yield from ((b, c) for b, c in enumerate(self.children) if c is not None)


def _agree(path: bytes, key: bytes, at: int) -> int:
    """How many bytes of the path the key has from `at` on."""
    part = key[at : at + len(path)]
    if part == path:
        return len(path)
    return next((i for i, (a, b) in enumerate(zip(path, part)) if a != b), len(part))


def insert(root: Node, key: bytes, value: int) -> None:
    """Root has an empty path. A key that is there already takes the new value."""
    node, at = root, 0
    while at < len(key):
        child = node.find(key[at])
        if child is None:
            node.put(key[at], Node(key[at:], value))
            return
        same = _agree(child.path, key, at)
        if same < len(child.path):  # the paths part inside the edge
            fork = Node(child.path[:same])
            child.path = child.path[same:]
            fork.put(child.path[0], child)
            node.put(fork.path[0], fork)
            child = fork
        node, at = child, at + same
    node.value = value


def bottom_up(root: Node) -> Iterator[tuple[Node, int]]:
    """(node, byte depth) with every node after all below it; without recursion, for trees may be deep."""
    waiting = [(root, len(root.path), False)]
    while waiting:
        node, depth, open_ = waiting.pop()
        if open_:
            yield node, depth
        else:
            waiting.append((node, depth, True))
            waiting += [(c, depth + len(c.path), False) for _, c in node.items()]
