from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np

from nightspark.llm import hashing, near
from nightspark.llm.components import connected_components


def sets_of(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def expected(rows, size, percent):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, sets_of(t, size)) for i, t in rows]
    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def family(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_equal_brute_force_in_a_family(spark, documents):
    """Copies with few and many edits: some linked to the centre, some only to each other, some to none."""
    rng = random.Random(1)
    base = [f"b{rng.randrange(500)}" for _ in range(120)]
    rows = [(i, family(rng, base, rng.choice((1, 2, 3, 5, 8, 12)))) for i in range(90)]
    far = family(rng, base, 14).split()
    rows += [(100 + i, family(rng, far, rng.choice((0, 1, 2)))) for i in range(12)]
    rows += [(200 + i, rows[i][1].upper()) for i in range(10)]
    got = {r.doc_id: r for r in near.near_duplicates(documents(rows), shingle=3, percent=85).collect()}
    want = expected(rows, 3, 85)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(sets_of(t, 3)) and got[i].kept == (want[i] == i) for i, t in rows)


def test_near_duplicates_edges(documents, edge_rows):
    out = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(documents(edge_rows)).collect()]
    assert len(out) == len(edge_rows)
    assert {(2, 0, 2, True), (3, 0, 3, True), (1, 0, 1, True), (6, 1, 6, True), (7, 1, 7, True)} <= set(out)
    assert (None, 76, None, True) in out and out.count((5, 77, 5, True)) == 2
    assert (9, 76, 5, False) in out
    assert near.near_duplicates(documents([])).collect() == []


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(3)
    factors = hashing.multipliers(160, 5)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    a, b = pool[:2000], pool[1000:]
    ra, rb = near.registers(a, factors), near.registers(b, factors)
    assert abs((ra == rb).mean() - 1 / 3) < 0.12
    assert (near.merge(ra, rb) == near.registers(pool, factors)).all()
    n = np.array([2000.0])
    assert not near.likely(ra[None], rb[None], n, n, 0.85)[0]
    c = np.concatenate((a[:1900], pool[2900:]))
    assert near.likely(ra[None], near.registers(c, factors)[None], n, n, 0.85)[0]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200, 260)]
    star = [(50, i) for i in range(51, 120)] + [(3, 119), (7, 7), (None, 4)]
    got = dict(connected_components(spark.createDataFrame(chain + star, "a long, b long")).collect())
    assert got == {i: 200 for i in range(200, 261)} | {i: 3 for i in (3, *range(50, 120))}


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcé", k=rng.randrange(1, 9))) for _ in range(rng.randrange(0, 60))).encode() for _ in range(40)] + [b"", None]
    whole = hashing.word_hashes(texts, near.SPACES)
    monkeypatch.setattr(hashing, "CHUNK", 7)
    assert all((x == y).all() for x, y in zip(whole, hashing.word_hashes(texts, near.SPACES), strict=True))
    assert [len(x) for x in whole] == [len((t or b"").split()) for t in texts]


def test_a_large_group_of_near_copies_lists_few_pairs(documents, monkeypatch):
    """Its members all lack what the centre alone has, so nearly every pair of them met."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    base, rows = [rng.choice(words) for _ in range(120)], []
    for i in range(200):
        text = list(base)
        for _ in range(rng.randrange(1, 6)):
            text[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    counts, linked = [], near.linked

    def counting(bands, texts_of, sets_of, percent, name, likely):
        def counted(pairs):
            counts.append(pairs.count())
            return likely(pairs)

        return linked(bands, texts_of, sets_of, percent, name, counted)

    monkeypatch.setattr(near, "linked", counting)
    near.near_duplicates(documents(rows), shingle=3, percent=85).collect()
    assert max(counts) < 4000
