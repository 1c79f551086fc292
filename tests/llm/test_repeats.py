from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from nightspark.llm import repeats, suffixes


def brute(rows, length=50):
    least = {}
    big = 2**63 - 1
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            least[w] = min(least.get(w, big), big if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < (big if i is None else i):
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), len(repeats.spans(gone)[0]), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 7))) for _ in range(60)]
    phrase = lambda n: " ".join(rng.choices(words, k=n))
    shared = [phrase(30) for _ in range(5)]
    rows = [(i, phrase(rng.randrange(1, 60)) + rng.choice(["", *shared]) + phrase(rng.randrange(0, 30)) + rng.choice(["", "", *shared])) for i in range(120)]
    rows += [(200 + i, rows[i % 7][1]) for i in range(30)]
    rows += [(300 + i, rows[50][1][:200] + str(i) + rows[50][1][200:]) for i in range(20)]
    rows += [(400, "a" * 500), (401, "a" * 49), (402, "a" * 50), (403, "ab" * 300), (404, "b" + "ab" * 40), (399, shared[0] * 20)]
    rng.shuffle(rows)
    return rows


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize(("seed", "unit", "hot"), [(1, repeats.UNIT, repeats.HOT), (2, 1, repeats.HOT), (3, 3000, 5), (4, 1, 0), (5, repeats.UNIT, 0)])
def test_removed_bytes_against_brute_force(documents, seed, unit, hot):
    rows = texts(seed)
    got = Counter(tuple(r) for r in repeats.repeats(documents(rows).repartition(3), unit=unit, hot=hot).select(*COLUMNS).collect())
    assert got == brute(rows)


def test_odd_rows(documents, edge_rows):
    rows = [(i, t if len(t or "") < 50_000 else t[:9000]) for i, t in edge_rows]
    long = "".join(random.Random(1).choices("ab", k=60)) * 200
    rows += [(50, long), (51, long + "c"), (None, long)]
    got = Counter(tuple(r) for r in repeats.repeats(documents(rows)).select(*COLUMNS).collect())
    assert got == brute(rows)
    assert repeats.repeats(documents([])).collect() == []
    assert [r.n_removed for r in repeats.repeats(documents([(1, None), (2, "")])).collect()] == [0, 0]


@pytest.mark.parametrize("length", [2, 7, 101])
def test_other_lengths_and_spans(documents, length):
    rows = texts(9)[:60]
    got = repeats.repeated_spans(documents(rows), length=length).collect()
    held = dict(rows)
    made = Counter((r.doc_id, len(held[r.doc_id].encode()), sum(x.end - x.start for x in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got)
    assert made == brute(rows, length)


def test_steps_of_anchors_keep_every_string(monkeypatch):
    data = np.frombuffer("".join(random.Random(3).choices("abc", k=5000)).encode(), np.uint8)
    ends = np.where(np.arange(5000) < 2000, 2000, 5000)
    for step in (7, 1 << 20):
        monkeypatch.setattr(repeats, "STEP", step)
        key, at, first, last = repeats.anchors(data, ends, 50)
        owned = sorted(p for a, b in zip(first, last, strict=True) for p in range(a, b + 1))
        assert owned == [*range(1951), *range(2000, 4951)]
        where = {bytes(data[p : p + 50]): a - p for a, lo, hi in zip(at, first, last, strict=True) for p in range(lo, hi + 1)}
        assert all(0 <= x <= 30 for x in where.values())


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh"])
@pytest.mark.parametrize("shallow", [1, 3])
def test_deep_shallow_sorts_bytes(alphabet, shallow):
    rng = random.Random(7)
    base = ["".join(rng.choices(alphabet, k=rng.randrange(0, 45))) for _ in range(60)]
    strings = [(rng.choice(base) + "".join(rng.choices(alphabet, k=9))).encode()[:50] for _ in range(3000)] + [b"", b"\0", b"\0\0"]
    data = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.array([len(s) for s in strings])
    rows = suffixes.padded(data, np.cumsum(lengths) - lengths, lengths, 50)
    order = suffixes.deep_shallow(rows, lengths, shallow)
    assert sorted(order.tolist()) == list(range(len(strings)))
    key = [(bytes(rows[i]), lengths[i]) for i in order]
    assert [k[0] for k in key] == sorted(k[0] for k in key)
    shared = suffixes.common_prefixes(rows, lengths, order)
    for a, b, n in zip(order[:-1], order[1:], shared[1:], strict=True):
        x, y = strings[a], strings[b]
        assert n == next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
