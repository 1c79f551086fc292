from __future__ import annotations

import hashlib
import random
import re

from nightspark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(text, items, size=10):
    own, hit, ids = words(text), set(), set()
    for item, body in items:
        w = words(body)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for i in range(len(own) - n + 1):
                if own[i : i + n] == w[k : k + n]:
                    hit |= set(range(i, i + n))
                    ids |= set() if item is None else {str(item)}
    return len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_contamination_equals_brute_force_in_one_and_many_blocks(spark, documents, edge_rows):
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(40)] + ["été", "naïve", "日本"]
    items = [(i, " ".join(rng.choices(pool, k=rng.randrange(1, 25)))) for i in range(8, 20)] + [
        (3, None), (4, "..."), (None, "null item"), (5, "w1 w2"), (5, "W3-w4"), (6, "w1 w2")]
    rows = []
    for i in range(60):
        text = rng.choices(pool, k=rng.randrange(0, 40))
        if i % 3 == 0:
            text[len(text) // 2 : len(text) // 2] = words(rng.choice(items)[1])
        rows.append((200 + i, ", ".join(text).title()))
    rows += [r for r in edge_rows if len(r[1] or "") < 10_000] + [(70, "x null\nITEM y")]
    table = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, body string")
    for size in (1 << 20, 200):
        out = decontaminate.contamination(documents(rows), table, block_bytes=size).collect()
        got = sorted((str(r[0]), *r[1:6]) for r in out)
        assert got == sorted((str(i), *expected(t, items)) for i, t in rows)
    texts = {i: t for i, t in rows if i is not None and i >= 200}
    for r in out:
        if r.doc_id is not None and r.doc_id >= 200:
            assert sum(len(words(texts[r.doc_id][s.start : s.end])) for s in r.hit_spans) == r.n_hit


def test_contamination_without_items_or_documents(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.contamination(documents([(1, "a b")]), none).collect()] == [0]
    assert decontaminate.contamination(documents([]), none).collect() == []
