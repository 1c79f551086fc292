"""Four bits of each least hash of a set: enough to give up pairs that are far from alike."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa

from nightspark.llm.common import mixed

#: Chance that a pair at the threshold is given up.
MISSED = 1e-8
#: Least hashes of a key that parts a large bucket.
PART = 3
#: Pairs compared at once.
PAIRS = 1 << 16


def sketch_of(least: np.ndarray) -> np.ndarray:
    """A row of packed half bytes a set, from its least hashes (one row a hash, an even number; one column a set)."""
    half = (mixed(least.astype(np.uint64)) >> np.uint64(60)).astype(np.uint8)
    return np.ascontiguousarray((half[::2] << np.uint8(4) | half[1::2]).T)


def least_same(n: int, percent: int) -> int:
    """Equal half bytes of ``n`` below which a pair of ``percent`` similarity falls with a chance of ``MISSED`` at most."""
    p, below, k = percent / 100 + (1 - percent / 100) / 16, 0.0, 0
    while True:
        below += comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > MISSED:
            return k
        k += 1


def loaded(column: pa.Array, n: int) -> np.ndarray:
    """Sketches as 64-bit words, filled up with zeros."""
    out = np.zeros((len(column), -(-n // 16) * 8), np.uint8)
    out[:, : n // 2] = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), n // 2)
    return out.view(np.uint64)


def same(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """How many half bytes are equal, row by row."""
    z = x ^ y
    z |= z >> np.uint64(2)
    z |= z >> np.uint64(1)
    return n - np.bitwise_count(z & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)


def part_keys(key: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """A row of keys a member: its bucket's and ``PART`` of its half bytes."""
    data = words.view(np.uint8).reshape(len(words), -1)[:, : n // 2]
    half = np.stack([data >> np.uint8(4), data & np.uint8(15)], 2).reshape(len(data), n).astype(np.uint64)
    parts = n // PART
    at = np.zeros((len(data), parts), np.uint64)
    for k in range(PART):
        at = at * np.uint64(16) + half[:, k : parts * PART : PART]
    with np.errstate(over="ignore"):
        place = mixed(at + np.arange(1, parts + 1, dtype=np.uint64) * np.uint64(1 << 20))
        return mixed(mixed(key.astype(np.uint64))[:, None] + place).view(np.int64)


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``key``, cut between buckets; a bucket is no larger than what a task can hold."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = batch.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1], "left"))
        if last:
            yield batch.slice(0, last)
        held = batch.slice(last)
    if held is not None:
        yield held


def pairs_of(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first, second) row of all pairs in a bucket, some at a time; rows are sorted by ``key``."""
    end = np.searchsorted(key, key, "right")
    after = end - np.arange(len(key)) - 1
    upto, lo = np.cumsum(after), 0
    while lo < len(key):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
        some = after[lo:hi]
        i = np.repeat(np.arange(lo, hi), some)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
        lo = hi


#: Members times elements that are spread out before they become bits.
MARKS = 1 << 25


def marked(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets as bits of the elements that several of them hold (a row a set), some elements at a time."""
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    many = count > 1
    keep = many[at]
    member, at, size, out = member[keep], (np.cumsum(many) - 1)[at[keep]], int(many.sum()), []
    width = max(64, (MARKS // len(sets)) // 64 * 64)
    for lo in range(0, size, width):
        here = (at >= lo) & (at < lo + width)
        marks = np.zeros((len(sets), -(-min(width, size - lo) // 64) * 64), bool)
        marks[member[here], at[here] - lo] = True
        out.append(np.packbits(marks, axis=1).view(np.uint64))
    return out


def overlaps(marks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many elements the sets of each pair share."""
    both = np.zeros(len(i), np.int64)
    for words in marks:
        step = max(1, (1 << 20) // words.shape[1])
        for k in range(0, len(i), step):
            both[k : k + step] += np.bitwise_count(words[i[k : k + step]] & words[j[k : k + step]]).sum(axis=1, dtype=np.int64)
    return both


def joining(sets: list[np.ndarray], group: np.ndarray, words: np.ndarray, n: int, enough: int, percent: int) -> list[tuple[int, int]]:
    """Links of ``percent`` Jaccard similarity that join the components of a bucket's members, no more than needed."""
    size, out, marks = np.array([len(s) for s in sets]), [], None
    group = np.unique(group, return_inverse=True)[1]
    for i, j in pairs_of(np.zeros(len(sets), np.int64)):
        two = (group[i] != group[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
        i, j = i[two], j[two]
        fine = same(words[i], words[j], n) >= enough
        i, j = i[fine], j[fine]
        if not len(i):
            continue
        marks = marked(sets) if marks is None else marks
        both = overlaps(marks, i, j)
        true = 100 * both >= percent * (size[i] + size[j] - both)
        i, j = i[true], j[true]
        # one link for each two components is enough
        first = np.unique(np.minimum(group[i], group[j]) * len(group) + np.maximum(group[i], group[j]), return_index=True)[1]
        for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
            if group[a] != group[b]:
                out.append((a, b))
                group[group == group[b]] = group[a]
    return out
