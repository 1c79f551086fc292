"""Deep-shallow sorting of short byte strings, in numpy.

Shallow: multikey quicksort with characters of eight bytes; only groups that are
still equal go on to the next character.  Deep: what has a long common prefix
is ordered by a blind trie, which compares a string with one member of its group
and then needs branching bytes alone.
"""

from __future__ import annotations

import numpy as np

#: Eight-byte characters of the shallow sort.
SHALLOW = 3


def padded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, backwards: bool = False) -> np.ndarray:
    """One row of ``width`` bytes per string, zeros behind its end; ``backwards`` reads from ``starts`` to the left."""
    if backwards:
        data, starts = data[::-1], len(data) - 1 - starts
    held = np.concatenate([data, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(held, width)[starts]
    rows *= np.arange(width) < lengths[:, None]
    return rows


class BlindTrie:
    """Patricia trie over rows: inner nodes hold a depth and children by byte, leaves the rows of one string."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list | None = None

    @staticmethod
    def _byte(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    @staticmethod
    def common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        return n - (differ.bit_length() + 7) // 8

    def add(self, i: int) -> None:
        """Blind descent to some leaf, one comparison with it, then the branch at the first differing byte."""
        s = self.strings[i]
        if self.root is None:
            self.root = [None, [i]]
            return
        node = self.root
        while node[0] is not None:
            node = node[1].get(self._byte(s, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        if s == other:
            node[1].append(i)
            return
        depth = self.common(s, other)
        parent, node = None, self.root
        while node[0] is not None and node[0] < depth:
            parent, node = node, node[1][self._byte(s, node[0])]
        if node[0] == depth:
            node[1][self._byte(s, depth)] = [None, [i]]
            return
        branch = [depth, {self._byte(other, depth): node, self._byte(s, depth): [None, [i]]}]
        if parent is None:
            self.root = branch
        else:
            parent[1][self._byte(s, parent[0])] = branch

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            depth, held = stack.pop()
            if depth is None:
                out += held
            else:
                stack += [held[c] for c in sorted(held, reverse=True)]
        return out


def deep_shallow(rows: np.ndarray, lengths: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of padded strings: by bytes, a prefix before what it begins."""
    n, width = rows.shape
    order = np.arange(n)
    if n < 2:
        return order
    whole = -(-width // 8) * 8
    if whole != width:
        rows = np.concatenate([rows, np.zeros((n, whole - width), np.uint8)], axis=1)
    characters = np.ascontiguousarray(rows).view(">u8")
    group = np.zeros(n, np.int64)
    open_at = np.arange(n)
    for level in range(min(shallow, characters.shape[1])):
        sub = order[open_at]
        word, of = characters[sub, level].astype(np.uint64), group[open_at]
        by = np.argsort(word, kind="stable") if level == 0 else np.lexsort((word, of))
        order[open_at] = sub[by]
        word, of = word[by], of[by]
        starts = np.concatenate([[True], (word[1:] != word[:-1]) | (of[1:] != of[:-1])])
        group[open_at] = open_at[np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))]
        alone = starts & np.concatenate([starts[1:], [True]])
        open_at = open_at[~alone]
        if not len(open_at):
            return order
    # groups of one string only (their bytes are compared whole) are in order
    of, sub = group[open_at], order[open_at]
    first = np.concatenate([[True], of[1:] != of[:-1]])
    head = sub[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
    differ = (characters[sub] != characters[head]).any(1) | (lengths[sub] != lengths[head])
    bounds = np.flatnonzero(np.concatenate([first, [True]]))
    mixed = np.flatnonzero(np.add.reduceat(differ, bounds[:-1]))
    for g in mixed:
        lo, hi = bounds[g], bounds[g + 1]
        members = sub[lo:hi]
        trie = BlindTrie([rows[i, : lengths[i]].tobytes() for i in members])
        for i in range(hi - lo):
            trie.add(i)
        order[open_at[lo:hi]] = members[trie.ordered()]
    return order


def common_prefixes(rows: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each string shares with the one before it in ``order`` (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 1 << 16):
        hi = min(lo + (1 << 16), len(order))
        a, b = order[lo - 1 : hi - 1], order[lo:hi]
        differ = rows[a] != rows[b]
        same = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[lo:hi] = np.minimum(same, np.minimum(lengths[a], lengths[b]))
    return out
