"""An adaptive radix tree over byte strings, with path compression.

An inner node's layout grows with its children: sorted keys for up to 4 and up to 16 of them, an
index of 256 bytes for up to 48, a plain table of 256 beyond.  A node carries the bytes that all
keys below it share (its prefix), so a chain of single children is one node.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Sorted:
    """Children in the order of their key bytes; as many as ``room``."""

    __slots__ = ("keys", "kids", "room")

    def __init__(self, room: int = 4):
        self.keys, self.kids, self.room = bytearray(), [], room

    def get(self, byte: int):
        at = self.keys.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, node: Node):
        """Set a child; the layout to use from now on."""
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.kids[at] = node
            return self
        if len(self.keys) == self.room:
            return (Sorted(16).filled(self) if self.room == 4 else Indexed().filled(self)).put(byte, node)
        self.keys.insert(at, byte)
        self.kids.insert(at, node)
        return self

    def filled(self, other: Sorted) -> Sorted:
        self.keys, self.kids = other.keys, other.kids
        return self

    def items(self) -> Iterator[Node]:
        return iter(self.kids)


class Indexed:
    """Up to 48 children behind an index of 256 bytes."""

    __slots__ = ("index", "kids")
    NONE = 255

    def __init__(self):
        self.index, self.kids = bytearray([self.NONE]) * 256, []

    def get(self, byte: int):
        at = self.index[byte]
        return self.kids[at] if at != self.NONE else None

    def put(self, byte: int, node: Node):
        at = self.index[byte]
        if at != self.NONE:
            self.kids[at] = node
            return self
        if len(self.kids) == 48:
            return Direct().filled(self).put(byte, node)
        self.index[byte] = len(self.kids)
        self.kids.append(node)
        return self

    def filled(self, other: Sorted) -> Indexed:
        for byte, node in zip(other.keys, other.kids, strict=True):
            self.put(byte, node)
        return self

    def items(self) -> Iterator[Node]:
        return (self.kids[at] for at in self.index if at != self.NONE)


class Direct:
    """A child for every byte."""

    __slots__ = ("kids",)

    def __init__(self):
        self.kids = [None] * 256

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, node: Node):
        self.kids[byte] = node
        return self

    def filled(self, other: Indexed) -> Direct:
        for byte, at in enumerate(other.index):
            if at != other.NONE:
                self.kids[byte] = other.kids[at]
        return self

    def items(self) -> Iterator[Node]:
        return (node for node in self.kids if node is not None)


class Node:
    """``start`` to ``end`` are the byte depths of its prefix; the bytes are those of ``key``, a key
    that passes through it.  ``value`` belongs to the key that ends here, if one does."""

    __slots__ = ("key", "start", "end", "value", "children")

    def __init__(self, key: bytes, start: int, end: int, value=None):
        self.key, self.start, self.end, self.value = key, start, end, value
        self.children = None

    def add(self, node: Node) -> None:
        if self.children is None:
            self.children = Sorted()
        self.children = self.children.put(node.key[node.start], node)

    def kids(self) -> Iterator[Node]:
        return self.children.items() if self.children is not None else iter(())


def shared(a: bytes, b: bytes, start: int, end: int) -> int:
    """The first depth from ``start`` on where two keys differ, or ``end``."""
    if a[start:end] == b[start:end]:
        return end
    low, high = start, end
    while high - low > 1:  # equal up to low, different before high
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Tree:
    """Keys with values; ``merge(old, new)`` joins values of equal keys."""

    def __init__(self, merge):
        self.root, self.merge = Node(b"", 0, 0), merge

    def put(self, key: bytes, value) -> None:
        node = self.root
        while True:
            if len(key) == node.end:
                node.value = value if node.value is None else self.merge(node.value, value)
                return
            below = node.children.get(key[node.end]) if node.children is not None else None
            if below is None:
                node.add(Node(key, node.end, len(key), value))
                return
            same = shared(key, below.key, below.start, min(below.end, len(key)))
            if same < below.end:  # the key leaves inside the prefix: split it there
                upper = Node(below.key, below.start, same)
                node.add(upper)
                below.start = same
                upper.add(below)
                below = upper
            node = below
