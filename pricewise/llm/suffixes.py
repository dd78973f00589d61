"""Deep-shallow suffix sorting of equal-length byte strings inside one task.

Multikey quicksort orders the strings by 8-byte super-characters down to a shallow depth and sets
aside every string that is alone by then; the groups that still share a prefix are ordered
by blind tries: compact tries that branch on single bytes, are descended without comparing
what lies between, and compare each new string once with one leaf.
"""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort looks at.
SHALLOW = 24


def _words(data: bytes) -> np.ndarray:
    """The big-endian 8-byte word at every offset (``data`` has 8 spare bytes)."""
    return np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))


def multikey(data: bytes, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of ``starts`` by their first ``depth`` bytes, group bounds): bounds[i] is true where
    a string differs from the one before it."""
    words = _words(data)
    order = np.arange(len(starts))
    new = np.zeros(len(starts), bool)
    if not len(starts):
        return order, new
    new[0] = True
    for at in range(0, depth, 8):
        group = np.cumsum(new)
        open_ = ~(new & np.r_[new[1:], True])  # strings that are not alone
        if not open_.any():
            break
        where = np.flatnonzero(open_)
        keys = words[starts[order[where]] + at].astype(np.uint64)
        if depth - at < 8:
            keys &= np.uint64(0xFFFFFFFFFFFFFFFF ^ ((1 << 8 * (8 - depth + at)) - 1))
        by = np.lexsort((keys, group[where]))
        order[where] = order[where][by]
        keys = keys[by]
        g = group[where]
        new[where] |= np.r_[True, (keys[1:] != keys[:-1]) | (g[1:] != g[:-1])]
    return order, new


class BlindTrie:
    """Strings of ``length`` bytes of ``data``; a node is [depth, {byte: child}], a leaf the
    list of the starts of equal strings."""

    def __init__(self, data: bytes, length: int):
        self.data, self.length, self.root = data, length, None

    def insert(self, start: int) -> None:
        data, length = self.data, self.length
        if self.root is None:
            self.root = [start]
            return
        node = self.root
        while len(node) == 2 and isinstance(node[1], dict):  # blind descent to any leaf
            node = node[1].get(data[start + node[0]]) or next(iter(node[1].values()))
        lcp = self._lcp(start, node[0])
        if lcp == length:
            node.append(start)
            return
        parent, byte, node = None, -1, self.root
        while len(node) == 2 and isinstance(node[1], dict) and node[0] < lcp:
            parent, byte = node, data[start + node[0]]
            node = node[1][byte]
        if len(node) == 2 and isinstance(node[1], dict) and node[0] == lcp:
            node[1][data[start + lcp]] = [start]
            return
        fork = [lcp, {self._byte(node, lcp): node, data[start + lcp]: [start]}]
        if parent is None:
            self.root = fork
        else:
            parent[1][byte] = fork

    def _byte(self, node, depth: int) -> int:
        while len(node) == 2 and isinstance(node[1], dict):
            node = next(iter(node[1].values()))
        return self.data[node[0] + depth]

    def _lcp(self, a: int, b: int) -> int:
        x, y = self.data[a:a + self.length], self.data[b:b + self.length]
        if x == y:
            return self.length
        diff = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        return self.length - (diff.bit_length() + 7) // 8

    def leaves(self):
        """Lists of equal strings, in order."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if len(node) == 2 and isinstance(node[1], dict):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                yield node


def sort_strings(data: bytes, starts: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): indexes of ``starts`` sorted by the ``length`` bytes from there, and for each
    place in that order the number of its class of equal strings.  ``data`` needs 8 spare bytes."""
    order, new = multikey(data, starts, min(shallow, length))
    if length <= shallow:
        return order, np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    sizes = np.diff(np.r_[heads, len(order)])
    again = _differing(data, starts, order, heads, sizes, length)
    for a, n in zip(heads[again].tolist(), sizes[again].tolist()):
        members = order[a:a + n].tolist()
        at: dict[int, list[int]] = {}
        trie = BlindTrie(data, length)
        for i in members:
            s = int(starts[i])
            if s not in at:
                trie.insert(s)
            at.setdefault(s, []).append(i)
        place = a
        for leaf in trie.leaves():
            new[place] = True
            for s in leaf:
                order[place:place + len(at[s])] = at[s]
                place += len(at[s])
    return order, np.cumsum(new) - 1


def _differing(data, starts, order, heads, sizes, length) -> np.ndarray:
    """Which groups are not made of equal strings only (word by word against their first)."""
    words = _words(data)
    group = np.repeat(np.arange(len(heads)), sizes)
    keep = np.flatnonzero(sizes[group] > 1)
    own, first = starts[order[keep]], starts[order[heads[group[keep]]]]
    differs = np.zeros(len(heads), bool)
    for at in [*range(0, length - 8, 8), length - 8]:
        differs[group[keep][words[own + at] != words[first + at]]] = True
    return differs
