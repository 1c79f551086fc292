from __future__ import annotations

import random
import re

from nightspark.llm import licenses, urls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    w = words(text)
    found = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), {x for _, x in found}


def whole(text):
    """Labels of templates that stand word by word in the text."""
    w = words(text)
    return {t.label for t in licenses.TEMPLATES for b in [words(t.text)] if any(w[i : i + len(b)] == b for i in range(len(w) - len(b) + 1))}


def test_license_scan(documents, edge_rows):
    rng = random.Random(8)
    filler = ["The", "general", "public", "mit", "License,", "software", "x", "of", "Apache", "version", "2.0"]
    rows = list(edge_rows)
    for i in range(120):
        parts = rng.choices(filler, k=rng.randrange(0, 30))
        for _ in range(rng.randrange(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(licenses.TEMPLATES).text)
        rows.append((100 + i, " ".join(parts)))
    out = licenses.license_scan(documents(rows)).collect()
    want = {(i, base(t)[0]): (base(t), whole(t)) for i, t in rows}
    assert len(out) == len(rows)
    for r in out:
        b, full = want[r.doc_id, r.n_words]
        got = set(r.labels.split(",")) - {""}
        assert (r.n_words, r.n_base, r.first_word, r.last_word, set(r.base_labels.split(",")) - {""}) == b
        assert b[4] | full <= got and 0 <= r.score <= 1 and (r.score == 1.0) >= bool(full)
        assert r.labels == ",".join(sorted(got))
    assert licenses.license_scan(documents([])).collect() == []


def test_license_needs_its_phrase_in_place(documents):
    near = "permission is hereby granted free of charge to any human obtaining one copy of this software and associated documentation files"
    out = {r.doc_id: r for r in licenses.license_scan(documents([(1, near), (2, near.replace("granted", "given")), (3, "plain")])).collect()}
    assert out[1].labels == "mit-notice" and 0.85 < out[1].score < 1 and out[2].labels == "" and out[2].score == 0


def test_license_with_words_put_in_left_out_and_scattered(documents):
    rng = random.Random(4)
    rows, want = [], {}
    for t in licenses.TEMPLATES:
        body = licenses.template_words(t.text)
        kept = {w for p in t.phrases for w in licenses.template_words(p)}
        for k in range(6):
            own = list(body)
            free = [i for i in range(len(own)) if not any(own[j : j + len(p)] == p and j < i < j + len(p) for p in map(
                licenses.template_words, t.phrases) for j in range(len(own)))]
            own.insert(rng.choice(free), "hereby")
            if len(body) > 15:
                gone = rng.choice([i for i, w in enumerate(own) if w not in kept])
                del own[gone]
            # the rarest words stand elsewhere too
            rows.append((len(rows), " ".join([*rng.sample(body, len(body) // 2), "x", *["y"] * 20, *own, "z", *rng.sample(body, 2)])))
            want[len(rows) - 1] = t.label
    out = {r.doc_id: r for r in licenses.license_scan(documents(rows)).collect()}
    for i, label in want.items():
        assert label in out[i].labels.split(",") and out[i].score > 0.8, (label, rows[i])


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def given(host, path):
    fits = [(len(r.host + r.path), r.host + r.path, r.verdict) for r in urls.RULES
            if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits)[1:] if fits else None


CASES = [None, "", "no scheme", "http://NET/", "http://a.net", "http://a.net?x=/", "http://a.Example.net/en/1", "https://example.net/EN/", "http://xexample.com/de/",
         "http://example.com/de/x#y", "ftp://w.org/fr/?q", "x://://a.net/", "http://b.org/fr", "http://É.net/ü/", "http://a.net\n/b"]


def test_url_filter(spark):
    rng = random.Random(9)
    made = [f"http://{rng.choice(('good', 'ok'))}{rng.choice(('', '', '.shop'))}.info/{rng.choice(('win', 'news', 'a', 'b'))}/{rng.randrange(99)}?{rng.choice(('ref', 'id'))}=1" for _ in range(600)]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*CASES, *made])] + [(None, made[0], "x", "y")] * 2, "page_id long, url string, tokens string, rule string")
    bad = lambda u: ".shop" in u and "/win/" in u
    marks = [(len(CASES) + i, 0 if bad(u) else 1, None) for i, u in enumerate(made[:400])] + [(None, 0, 1), (3, None, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = urls.judge_urls(pages, labels).collect()
    assert len(out) == len(CASES) + len(made) + 2
    known = dict(enumerate([*CASES, *made]))
    for r in out:
        url = made[0] if r.page_id is None else known[r.page_id]
        rule = given(*parse(url))
        assert (r.host, r.path) == parse(url)
        assert (r.rule, r.verdict) == (rule or (None, "block" if url in made and bad(url) else "allow"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.verdict for r in urls.judge_urls(pages.filter("url LIKE '%info%'"), none).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), labels).collect() == []


def test_mined_rules_equal_counts(spark):
    rng = random.Random(10)
    rows = [([t for t in "abcdef" if rng.random() < 0.4], rng.random() < 0.3) for _ in range(300)]
    rows = [(t, b or {"a", "b"} <= set(t)) for t, b in rows]
    got = {tuple(r.tokens): (round(r.confidence, 6), round(r.support, 6)) for r in urls.mine_rules(
        spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_support=0.05).collect()}
    from itertools import combinations

    rate, want = sum(b for _, b in rows) / len(rows), {}
    for k in range(1, 7):
        for s in combinations("abcdef", k):
            own = [b for t, b in rows if set(s) <= set(t)]
            if own and sum(own) >= 20 and sum(own) / len(own) >= 0.5 and sum(own) / len(own) / rate >= 1.2:
                want[s] = (round(sum(own) / len(own), 6), round(sum(own) / len(rows), 6))
    assert got == want and ("a", "b") in want


def test_forty_parts_of_one_path_are_one_item(spark):
    path = "/".join(f"p{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    made = [f"http://a.info/{path}"] * 60 + [f"http://b.info/{c}" for c in "xyz"] * 40
    pages = spark.createDataFrame(list(enumerate([*made, "http://c.info/pab/other"])), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 60), 0) for i in range(180)], "doc_id long, quality int, toxic int")
    tokens = pages.filter("page_id < 180").select(urls.url_tokens(urls.F.col("url")).alias("tokens"), (urls.F.col("page_id") < 60).alias("bad"))
    rule, = urls.mine_rules(tokens).collect()
    assert len(rule.classes) == 1 and len(rule.classes[0]) == 41 and rule.confidence == 1
    out = {r.page_id: r.verdict for r in urls.judge_urls(pages, labels).collect()}
    # one of the tokens is enough, as a rule of its own would be
    assert {i for i, v in out.items() if v == "block"} == {*range(60), 180}
