"""Alignment of two tokenizers over the same bytes, each distinct text once.

Texts are shuffled whole and counted; every distinct one is encoded by both
tokenizers and aligned on its bytes.  The ends of all tokens cut the bytes into
stretches: each stretch lies in one token of either side, so stretches are the
overlapping token pairs, and ends shared by both sides close a group.  Counts of
id pairs weigh a text by how often it occurs.  They are summed per unit of some
MB of text, so what travels are a unit's distinct pairs, not its links; counts
come back to the unit in the same way, and measures go to documents by the
digest of the text.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightspark.llm.common import cut, table

#: Bytes of text in a unit, and in one step of aligning.
UNIT, STEP = 8 << 20, 1 << 20
#: How the byte-level vocabulary splits text before merging (fixed value of the vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space or of one kind of character that go to the slower library, whose expressions need no stack.
LONG_RUN = 100_000
_LOADED: dict[tuple[str, str], Tokenizers] = {}

MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
UNITS = f"unit long, digest binary, weight long, {MEASURES}, held binary, pairs array<long>, weights array<long>"


def byte_level(token: str) -> bytes:
    """Bytes of a vocabulary entry: printable Latin-1 characters stand for themselves, the others from U+0100 on."""
    if not byte_level.table:
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(own)]
        byte_level.table = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}
    return bytes(byte_level.table[c] for c in token)


byte_level.table = {}


class Tokenizers:
    """Both tokenizers with the bytes, byte lengths and printed ids of their entries."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)
        special = {x["content"] for x in vocabulary["added_tokens"]}
        ranks = {byte_level(t): i for t, i in vocabulary["model"]["vocab"].items() if t not in special}
        # ids of this vocabulary are in the order of its merges
        self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(path_a)
        self.slow.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(x) for x in side]) for side in (self.bytes_a, self.bytes_b))
        self.shown_a, self.shown_b = self._shown(len(self.bytes_a), b"|"), self._shown(len(self.bytes_b), b";")

    def _piece(self, i: int) -> bytes:
        if self.pieces.is_control(i) or self.pieces.is_unknown(i):
            return b""
        name = self.pieces.id_to_piece(i)
        return bytes([int(name[1:-1], 16)]) if self.pieces.is_byte(i) else name.replace("▁", " ").encode()

    @staticmethod
    def _shown(n: int, end: bytes) -> np.ndarray:
        """Printed ids, first with a comma behind, then with the mark that ends a group's side."""
        out = np.empty(2 * n, object)
        out[:] = [b"%d," % i for i in range(n)] + [b"%d%s" % (i, end) for i in range(n)]
        return out

    def encode_a(self, text: str) -> np.ndarray:
        if len(text) > LONG_RUN:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)
        return np.array(self.fast.encode_ordinary(text), np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides; None where a side does not give back the text."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1), strict=True):
            a, whole = self.encode_a(" " + text), (" " + text).encode()
            same = b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole
            out.append((a, np.array(b, np.int64)) if same else None)
        return out


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One per Python worker and pair of files."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Tokenizers(path_a, path_b)
    return _LOADED[path_a, path_b]


def per_text(bounds: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """How many marks lie in each text."""
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[bounds[1:]] - total[bounds[:-1]]


def aligned(t: Tokenizers, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Measures of each text; then (text << 32 | pair) of its distinct pairs, sorted, and how often each is linked."""
    both = t.encode(texts)
    empty = np.zeros(0, np.int64)
    sides = [[x[k] if x else empty for x in both] for k in (0, 1)]
    a, b = (np.concatenate(side) for side in sides)
    end_a, end_b = np.cumsum(t.length_a[a]), np.cumsum(t.length_b[b])
    total = int(end_a[-1]) if len(a) else 0
    ends = np.zeros(total + 1, np.uint8)
    ends[end_a] |= 1
    ends[end_b] |= 2
    at = np.flatnonzero(ends)
    kind = ends[at]
    is_a, is_b, is_both = (kind & 1).astype(np.int64), (kind >> 1).astype(np.int64), kind == 3
    # tokens that a stretch lies in: those with as many ends before
    in_a, in_b = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b
    group = np.cumsum(is_both) - is_both
    tokens_a, tokens_b = (np.concatenate([[0], np.cumsum([len(x) for x in side])]) for side in sides)
    last_byte = np.concatenate([[0], end_a])[tokens_a]
    bounds = np.searchsorted(at, last_byte, "right")
    bounds[0] = 0
    links, groups = np.diff(bounds), per_text(bounds, is_both)
    # printed groups: the tokens of one side, then those of the other
    group_a, group_b = group[is_a == 1], group[is_b == 1]
    before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=int(groups.sum())))])
    upto_a = np.cumsum(np.bincount(group_a, minlength=int(groups.sum())))
    shown = np.empty(len(a) + len(b), object)
    shown[np.arange(len(a)) + before_b[group_a]] = t.shown_a[a + len(t.bytes_a) * is_both[is_a == 1]]
    shown[np.arange(len(b)) + upto_a[group_b]] = t.shown_b[b + len(t.bytes_b) * is_both[is_b == 1]]
    measures = []
    for k in range(len(texts)):
        lo, hi = tokens_a[k] + tokens_b[k], tokens_a[k + 1] + tokens_b[k + 1]
        name = hashlib.sha256(b"".join(shown[lo:hi].tolist())[:-1]).hexdigest() if hi > lo else ""
        measures.append((int(tokens_a[k + 1] - tokens_a[k]), int(tokens_b[k + 1] - tokens_b[k]), int(groups[k]), int(links[k]), name))
    key = (np.repeat(np.arange(len(texts), dtype=np.uint64), links) << np.uint64(32)) | (a[in_a] << 16 | b[in_b]).astype(np.uint64)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return measures, key[first], np.diff(np.concatenate([first, [len(key)]])) if len(key) else first


def packed(places: np.ndarray, times: np.ndarray) -> bytes:
    """Rising places as steps, then how often each counts; byte planes compress well."""
    steps = np.diff(places, prepend=0).astype("<u4")
    return zlib.compress(np.concatenate([steps, times.astype("<u4")]).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8)
    both = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
    half = len(both) // 2
    return np.cumsum(both[:half], dtype=np.int64), both[half:].astype(np.int64)


def in_steps(rows: Iterator[tuple[str, bytes, int]], limit: int) -> Iterator[list[tuple[str, bytes, int]]]:
    """Rows by about ``limit`` bytes of text, one row at least."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row[0]) > limit:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[0])
    if held:
        yield held


def units(texts: DataFrame, path_a: str, path_b: str, unit: int = UNIT, step: int = STEP) -> DataFrame:
    """Per distinct text a row of measures with its packed pairs; per unit a row of its pairs and their weights."""
    names = [x.split()[0] for x in UNITS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, number = tokenizers(path_a, path_b), TaskContext.get().partitionId() << 33
        rows = (x for batch in batches for x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        for held in in_steps(rows, unit):
            measures, keys, times = [], [], []
            for some in in_steps(iter(held), step):
                m, k, n = aligned(t, [x[0] for x in some])
                keys.append(k + (np.uint64(len(measures)) << np.uint64(32)))
                times.append(n)
                measures += m
            key, n = np.concatenate(keys), np.concatenate(times)
            pair, text = (key & np.uint64(0xFFFFFFFF)).astype(np.int64), (key >> np.uint64(32)).astype(np.int64)
            pairs, place = np.unique(pair, return_inverse=True)
            weights = np.zeros(len(pairs), np.int64)
            np.add.at(weights, place, np.array([x[2] for x in held])[text])
            bound = np.searchsorted(text, np.arange(len(held) + 1))
            stored = [packed(place[lo:hi], n[lo:hi]) for lo, hi in zip(bound[:-1], bound[1:], strict=True)]
            blank = [None]
            columns = [[number] * (len(held) + 1), [x[1] for x in held] + blank, [x[2] for x in held] + blank,
                       *[[m[k] for m in measures] + blank for k in range(5)], stored + blank]
            arrays = [pa.array(c, f) for c, f in zip(columns, (pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.string(), pa.binary()), strict=True)]
            whole = [pa.array([None] * len(held) + [x], pa.list_(pa.int64())) for x in (pairs, weights)]
            yield pa.RecordBatch.from_arrays([*arrays, *whole], names)
            number += 1

    return texts.mapInArrow(work, UNITS)


def counted(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(of_unit, place, pair) of all units, and (pair, n, best): documents that hold the pair linked, and whether no pair of its A id has more."""
    parts = held.filter("pairs IS NOT NULL").select(F.col("unit").alias("of_unit"), F.posexplode(F.arrays_zip("pairs", "weights")).alias("place", "x")).select(
        "of_unit", "place", F.col("x.pairs").alias("pair"), F.col("x.weights").alias("w"))
    n = cut(parts.groupBy("pair").agg(F.sum("w").alias("n")), "pair-counts")
    a = F.shiftright("pair", 16)
    # a row per id of the first vocabulary, 65,536 at most
    top = F.broadcast(n.groupBy(a.alias("a")).agg(F.max("n").alias("top")))
    return parts.drop("w"), n.join(top, a == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """(a, b, n, best): id pairs that are linked somewhere and how many documents hold them."""
    _, n = counted(cut(units(distinct_texts(docs, text), path_a, path_b), "aligned"))
    return n.select(F.shiftright("pair", 16).alias("a"), F.col("pair").bitwiseAND(0xFFFF).alias("b"), "n", "best")


def digest(text: str) -> F.Column:
    return F.unhex(F.sha2(F.col(text), 256))


def distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """(text, digest, weight): one row per distinct text with a character; copies are counted before the shuffle."""
    return docs.filter(F.length(text) > 0).groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("weight")).select(
        "text", digest("text").alias("digest"), "weight")


def align(
    docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", unit: int = UNIT,
) -> DataFrame:
    """A row per row of ``docs``: tokens, groups and links of both tokenizers, and the corpus-wide counts of its pairs.

    Null and empty texts, and those that a tokenizer does not give back byte by
    byte, have no tokens: zeros and an empty digest.  Equal texts have equal
    rows; ids may be null or repeated and are only carried.  Other columns are
    ignored.  Vocabularies have at most 65,536 ids.
    """
    held = cut(units(distinct_texts(docs, text), path_a, path_b, unit), "aligned")
    parts, counts = counted(held)
    back = parts.join(counts, "pair").select("of_unit", "place", "n", "best")
    texts = held.filter("digest IS NOT NULL").select("unit", "digest", *[x.split()[0] for x in MEASURES.split(", ")], "held")
    out = f"digest binary, {MEASURES}, n_best long, count_sum long"

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("place").to_numpy())
        n = right.column("n").to_numpy()[order]
        best = right.column("best").to_numpy(zero_copy_only=False)[order]
        n_best, count_sum = [], []
        for raw in left.column("held").to_pylist():
            place, times = unpacked(raw)
            n_best.append(int(times[best[place]].sum()))
            count_sum.append(int((times * n[place]).sum()))
        return left.drop_columns(["unit", "held"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    measured = cut(texts.groupBy("unit").cogroup(back.groupBy("of_unit")).applyInArrow(measure, out), "measured")
    ids = docs.select(F.col(doc_id).alias("_id"), F.when(F.length(text) > 0, digest(text)).alias("_digest"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return ids.join(measured, F.col("_digest") == F.col("digest"), "left").select(
        F.col("_id").alias(doc_id), *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return align(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
