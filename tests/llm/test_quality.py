from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from nightspark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    again = {p for i, g in enumerate(grams) if often[g] > 1 for p in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(quality.SYMBOLS, text)), len(lines) - len(set(lines)), len(again))


def expected(rows, most):
    """rows: (id, host, text)."""
    texts, first = defaultdict(set), {}
    name = lambda x: " ".join(WORD.findall(ascii_lower(x)))
    split = lambda t: [x for x in (t or "").split("\n") if WORD.search(x)]
    for i, host, t in rows:
        for x in split(t):
            texts[host, name(x)].add(t)
            if i is not None:
                first[host, name(x)] = min(i, first.get((host, name(x)), i))
    out = []
    for i, host, t in rows:
        stats = base(t)
        n = stats[0]
        lost = sum(len(WORD.findall(x)) for x in split(t) if len(texts[host, name(x)]) > most and (i is None or first.get((host, name(x))) != i))
        failed = n < 50 or 100 * stats[4] > 50 * n
        out.append((i, *stats, lost, failed, not failed and not (lost and (100 * lost > 50 * n or n - lost < 50))))
    return out


def test_quality_equals_brute_force(spark, documents, edge_rows):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "#tag", "a|b", "é"]
    common = [" ".join(rng.choices(words, k=k)) for k in (3, 8, 30, 60)]
    rows = []
    for i in range(90):
        lines = [" ".join(rng.choices(words[: rng.choice((4, 30, 305))], k=rng.randrange(0, 40))) for _ in range(rng.randrange(0, 6))]
        lines += [rng.choice((str.upper, str))(x) for x in common if rng.random() < 0.4]
        if lines and rng.random() < 0.3:
            lines.append(lines[0])
        rng.shuffle(lines)
        rows.append((100 + i, "\n".join(lines)))
    rows += edge_rows + rows[:5]
    docs = documents(rows)
    out = quality.judged(docs, max_texts=4).drop("_removed", "_carry").collect()
    hosts = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, out), key=key) == sorted(expected(hosts, 4), key=key)
    assert sum(not r.base_failed and not r.kept for r in out) > 3 and sum(r.n_frequent_words > 0 and r.kept for r in out) > 3
    assert quality.judged(documents([])).collect() == []


def test_removed_lines_leave_the_text(documents):
    rows = [(i, f"shared line\nown {i} " + "x " * 60) for i in range(6)]
    out = quality.judged(documents(rows), max_texts=3, carry=("text", "line"))
    text = quality.without_lines(F.col("_carry.text"), F.col("_removed"))
    got = {r.doc_id: r.t for r in out.select("doc_id", text.alias("t")).collect()}
    kept = {i for i, t in rows if got[i] == t}
    # the smallest id of its host keeps the line; row 4 stands in the null host alone
    assert kept == {0, 4} and got[1] == rows[1][1].split("\n")[1]
