from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from nightspark.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TRICKY = ["a▁b", "x<|endoftext|>y", "<s> a </s> <unk> <0x41>", "tab\tand\n\n lines  ", "  two", "日本語 ü é ́ 😀", "x\0y", "1234567 89", " ", "don't we'll"]


@pytest.fixture(scope="module")
def brute():
    """Rows by the contract: token byte ranges compared one by one."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def bytes_b(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:-1], 16)]) if name.startswith("<0x") and name.endswith(">") and len(name) == 6 else name.replace("▁", " ").encode()

    def ranges(ids, piece):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(piece(i))))
            at = out[-1][2]
        return out

    def sides(text):
        if not text:
            return [], []
        whole = (" " + text).encode()
        x = ranges(a.encode(" " + text, add_special_tokens=False).ids, lambda i: alignment.byte_level(a.id_to_token(i)))
        y = ranges(b.encode(text), bytes_b)
        if b"".join(alignment.byte_level(a.id_to_token(i)) for i, _, _ in x) != whole or b"".join(bytes_b(i) for i, _, _ in y) != whole:
            return [], []
        return x, y

    def links(x, y):
        j, out = 0, []
        for i, lo, hi in x:
            while j and y[j][1] >= lo:
                j -= 1
            while j < len(y) and y[j][1] < hi:
                if y[j][2] > lo:
                    out.append((i, y[j][0]))
                j += 1
            j = max(0, j - 1)
        return out

    def rows(texts):
        both = [sides(t) for _, t in texts]
        linked = [links(*s) for s in both]
        n = Counter(p for each in linked for p in set(each))
        top = {}
        for (i, _), c in n.items():
            top[i] = max(top.get(i, 0), c)
        out = []
        for (doc_id, _), (x, y), each in zip(texts, both, linked, strict=True):
            ends = sorted({hi for _, _, hi in x} & {hi for _, _, hi in y})
            groups = ";".join(
                ",".join(str(i) for i, _, hi in x if lo < hi <= up) + "|" + ",".join(str(i) for i, _, hi in y if lo < hi <= up)
                for lo, up in zip([0, *ends], ends, strict=False))
            out.append((doc_id, len(x), len(y), len(ends), len(each), sum(n[p] == top[p[0]] for p in each), sum(n[p] for p in each),
                        hashlib.sha256(groups.encode()).hexdigest() if x else ""))
        return Counter(out), n

    return rows


def test_alignment_against_brute_force(documents, edge_rows, brute):
    rng = random.Random(2)
    words = ["the", "tion", "Ärger", "a,b", "x1", "\n", "re-entry", "mañana"]
    texts = [(i, t if len(t or "") < 10_000 else t[:3000]) for i, t in edge_rows] + [(100 + i, t) for i, t in enumerate(TRICKY)]
    texts += [(200 + i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(60)]
    texts += [(300 + i, "a copy that many documents hold") for i in range(40)]
    want, n = brute(texts)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for unit in (1, alignment.UNIT):
        got = Counter(tuple(r) for r in alignment.align(documents(texts).repartition(3), A, B, unit=unit).select(*columns).collect())
        assert got == want
    assert {(r.a, r.b): r.n for r in alignment.pair_counts(documents(texts), A, B).collect()} == n


def test_empty_tables(documents):
    assert alignment.align(documents([]), A, B).collect() == []
    assert [tuple(r) for r in alignment.align(documents([(1, None), (None, "")]), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]


def test_both_ways_of_byte_tokens_agree(monkeypatch):
    t = alignment.tokenizers(A, B)
    rng = random.Random(4)
    texts = TRICKY + ["".join(rng.choices("ab 1.é\n'", k=rng.randrange(1, 300))) for _ in range(300)]
    fast = [t.encode_a(" " + x).tolist() for x in texts]
    monkeypatch.setattr(alignment, "LONG_RUN", 0)
    assert [t.encode_a(" " + x).tolist() for x in texts] == fast
