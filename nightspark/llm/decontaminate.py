"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton holds the normalised windows of all benchmark items, so each
text is scanned once whatever their number.  A text is normalised byte by byte
(its length stays), its words are joined by single blanks, and matches are
mapped back to words and to characters of the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightspark.llm.common import binary_texts, plain_table, sql_ascii_lower, table, type_of

PLAIN = plain_table()
#: One automaton holds the items of a block; a block's texts have so many bytes at most (or one item).
BLOCK_BYTES = 32 << 20
_BUILT: dict[str, ahocorasick.Automaton] = {}


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN).split() if text else []


def item_windows(items: list[tuple[str | None, bytes | None]], size: int) -> dict[str, list[str]]:
    """Pattern (words between blanks, one character a byte) -> ids of its items."""
    found: dict[str, set[str]] = {}
    for item, text in items:
        words = normal_words(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            pattern = b" " + b" ".join(words[i : i + size]) + b" "
            found.setdefault(pattern.decode("latin-1"), set()).update(() if item is None else (item,))
    return {k: sorted(v) for k, v in found.items()}


def automaton(key: str, patterns: dict[str, list[str]]) -> ahocorasick.Automaton:
    """Built once per Python worker and block; the last one is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        built = ahocorasick.Automaton()
        for pattern, ids in patterns.items():
            built.add_word(pattern, (len(pattern), ids))
        built.make_automaton()
        _BUILT[key] = built
    return _BUILT[key]


def matches(built: ahocorasick.Automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges [first, end) of all occurrences, merged, and the ids of their items."""
    hay = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = [(end - size + 1, end, ids) for end, (size, ids) in built.iter(hay)]
    if not found:
        return [], set()
    # character of the blank before each word, and of the last blank
    blanks = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
    first = np.searchsorted(blanks, [x[0] for x in found])
    last = np.searchsorted(blanks, [x[1] for x in found])
    return merged(list(zip(first.tolist(), last.tolist(), strict=True))), {i for x in found for i in x[2]}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Character ranges of the original text for ranges of words."""
    plain = np.frombuffer(text.translate(PLAIN), np.uint8) != 0x20
    edges = np.diff(np.concatenate(([False], plain, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(chars[starts[a]]), "end": int(chars[ends[b - 1]])} for a, b in ranges]


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: which of its words stand in a window of an item.

    Columns: the id, n_words, n_hit, n_items, items_sha256, contaminated, and
    hit_spans (character ranges of the original text, merged).

    Null or empty texts have no words: zeros, the hash of the empty string, no
    spans.  A null id is kept.  Items without words match nothing; an item with
    a null id marks words but is no named item.  Repeated documents are judged
    one by one, repeated items count once per id, and other columns of either
    table are ignored.  No documents: no rows; no items: no hits.

    The items are the stated query set: blocks of at most ``block_bytes`` of
    their text reach the driver and the tasks, one automaton a block; documents
    are never shuffled.
    """
    spark = docs.sparkSession
    query = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("binary").alias("body")).filter(
        "body IS NOT NULL")
    total = query.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = docs.select(
        F.col(doc_id).alias("doc"), F.col(text).alias("body"), F.lit(None).cast("array<int>").alias("ranges"),
        F.lit(None).cast("array<string>").alias("items"))
    for k in range(blocks):
        block = query.filter(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k) if blocks > 1 else query
        patterns = item_windows([(r.item, bytes(r.body)) for r in block.toLocalIterator()], window)
        sent = spark.sparkContext.broadcast(patterns)
        key = hashlib.sha256(repr(sorted(patterns)).encode()).hexdigest()

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                built = automaton(key, sent.value) if sent.value else None
                ranges, found = batch.column("ranges").to_pylist(), batch.column("items").to_pylist()
                for i, body in enumerate(binary_texts(batch, "body")):
                    words = normal_words(body)
                    if words and built is not None:
                        at, ids = matches(built, words)
                        ranges[i] = (ranges[i] or []) + [x for pair in at for x in pair]
                        found[i] = sorted({*(found[i] or ()), *ids})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), batch.column("body"), pa.array(ranges, pa.list_(pa.int32())),
                     pa.array(found, pa.list_(pa.string()))], ["doc", "body", "ranges", "items"])

        if patterns:
            out = out.mapInArrow(scan, out.schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, flat, ids in zip(
                    binary_texts(batch, "body"), batch.column("ranges").to_pylist(), batch.column("items").to_pylist(),
                    strict=True):
                at, ids = merged(list(zip((flat or [])[::2], (flat or [])[1::2], strict=True))), sorted(ids or ())
                rows.append((
                    len(normal_words(body)), sum(b - a for a, b in at), len(ids),
                    hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(at), spans(body, at) if at else []))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), span)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                [doc_id, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"])

    return out.mapInArrow(
        digest, f"`{doc_id}` {type_of(docs, doc_id)}, n_words long, n_hit long, n_items long, items_sha256 string, "
        "contaminated boolean, hit_spans array<struct<start: int, end: int>>")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(sql_ascii_lower("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(sql_ascii_lower("coalesce(text, '')"))} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
       FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
m AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM m), unnest(range(i, i + k)) AS t(p) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
