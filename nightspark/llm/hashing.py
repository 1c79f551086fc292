"""Vectorised 64-bit hashes of words and shingles over the bytes of many texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

from nightspark.llm.common import mixed

BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at once; a longer word is hashed on its own.
CHUNK = 1 << 18


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


@cache
def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers, the same everywhere."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 0x1000)) * np.uint64(BASE)) | np.uint64(1)


def word_hashes(texts: list[bytes | None], table: bytes) -> list[np.ndarray]:
    """Hashes of the words of each text, in order; ``table`` maps bytes, blanks part words."""
    joined = b" ".join([t or b"" for t in texts]).translate(table) + b" "
    lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(joined):
        end = joined.find(b" ", at + CHUNK)
        end = len(joined) if end < 0 else end
        data = np.frombuffer(joined, np.uint8, end - at, at)
        word = data != 0x20
        edges = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if len(first):
            size = last - first
            begin = np.cumsum(size) - size
            place = np.arange(size.sum()) - np.repeat(begin, size)
            with np.errstate(over="ignore"):
                value = (data[word].astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[place]
                hashes.append(mixed(np.add.reduceat(value, begin) + size.astype(np.uint64)))
            starts.append(first + at)
        at = end
    cuts = np.searchsorted(np.concatenate(starts), np.cumsum(lengths)[:-1])
    return np.split(np.concatenate(hashes), cuts)


def word_shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of ``size`` words in a row; of fewer words, the whole as one."""
    if not len(words):
        return words
    n = min(size, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - n + 1, n, np.uint64)
        for k, m in enumerate(multipliers(n, 3)):
            total += words[k : len(words) - n + 1 + k] * m
    return np.unique(mixed(total))


def char_shingles(line: str, size: int) -> np.ndarray:
    """Distinct hashes of ``size`` characters in a row; of fewer characters, the whole as one."""
    chars = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return word_shingles(mixed(chars + np.uint64(1)), size)


def minima(shingles: np.ndarray, factors: np.ndarray, block: int = 256) -> np.ndarray:
    """For each factor the least value of shingle times factor (mod 2^64): one independent hash each."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), block):
            np.minimum(least, (factors[:, None] * shingles[None, i : i + block]).min(axis=1), out=least)
    return least


def some_bytes(texts: list[bytes | None], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, one row at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or b"") > limit:
            yield start, i
            start, size = i, 0
        size += len(t or b"")
    if start < len(texts):
        yield start, len(texts)


def line_minima(lines: list[bytes], size: int, factors: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """Least 32-bit hashes (one row a factor, one column a line) of the character shingles of lines; no line is empty.

    Lines go through in blocks of about ``block`` bytes that stay in the cache.
    """
    out, some, held = [], [], 0
    for line in lines:
        if some and held + len(line) > block:
            out.append(_block_minima(some, size, factors))
            some, held = [], 0
        some.append(line)
        held += len(line)
    if some:
        out.append(_block_minima(some, size, factors))
    return np.concatenate(out, axis=1) if out else np.empty((len(factors), 0), np.uint32)


def line_shingles(lines: list[bytes], size: int, block: int = 1 << 15) -> list[np.ndarray]:
    """Sorted distinct character-shingle hashes of each line; no line is empty."""
    out, some, held = [], [], 0
    for line in [*lines, None]:
        if some and (line is None or held + len(line) > block):
            flat, begin = _block_shingles(some, size)
            out += [np.unique(x) for x in np.split(flat, begin[1:])]
            some, held = [], 0
        if line is not None:
            some.append(line)
            held += len(line)
    return out


def _block_minima(lines: list[bytes], size: int, factors: np.ndarray) -> np.ndarray:
    flat, begin = _block_shingles(lines, size)
    # upper halves: products of 32 bits take a third of the time
    flat, factors = (flat >> np.uint64(32)).astype(np.uint32), (factors >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    with np.errstate(over="ignore"):
        return np.stack([np.minimum.reduceat(flat * f, begin) for f in factors])


def _block_shingles(lines: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all lines in a row, and where each line's begin."""
    joined = (b"\n".join(lines) + b"\n" + b" " * size).decode()
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(chars == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    length = ends - starts
    with np.errstate(over="ignore"):
        value = mixed(chars.astype(np.uint64) + np.uint64(1))
        total = np.full(len(chars) - size + 1, size, np.uint64)
        for k, m in enumerate(multipliers(size, 3)):
            total += value[k : len(chars) - size + 1 + k] * m
    shingles = mixed(total)
    count = np.maximum(length - size + 1, 1)
    begin = np.cumsum(count) - count
    flat = shingles[np.repeat(starts - begin, count) + np.arange(count.sum())]
    for i in np.flatnonzero(length < size):
        flat[begin[i]] = char_shingles(lines[i].decode(), size)[0]
    return flat, begin
