"""Packing of token sequences by patterns of few documents.

All lengths are at most the sequence length, so the histogram of lengths is a
table of fixed size whatever the corpus.  The plan is made on it alone: repeat
counts of patterns of up to three length classes are fitted to the histogram
by non-negative least squares and rounded down, what is left is placed by best
fit.  Pieces then find their place by their rank among those of equal length.
"""

from __future__ import annotations

import re
import string
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightspark.llm.common import cut, table, type_of
from nightspark.operators.ordering import order_rows

SEQUENCE = 4096
END_ID = 1
#: Words held by a Python worker with their ids; then it starts anew.
CACHE_WORDS = 500_000
#: Parts that are tokenised in one call, and what stands between those that are not plain letters; its id is no other text's.
TOGETHER = 2000
MARK = "|"
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
PUNCTUATION = string.punctuation
#: White space of str.split that is none to the tokenizer (all code points were compared); each has ids of its own.
NO_SPACE = "\x1c\x1d\x1e\x1f"
PART = re.compile(rf"[\S{NO_SPACE}]+")
_LOADED: dict[str, WordIds] = {}


def text_parts(text: str) -> list[str]:
    """What stands between the tokenizer's white space."""
    return PART.findall(text) if any(c in text for c in NO_SPACE) else text.split()


class WordIds:
    """Ids of a text as the tokenizer gives them, with a cache of white-space-separated parts.

    The tokenizer neither joins text over white space nor lets it change what
    stands beside it, so a text's ids are its parts' ids in a row.  New parts
    are tokenised many in one call: words of Latin-1 letters, which the tokenizer
    parts from ASCII punctuation behind them, are told apart by the ids at which
    words end, other parts by a mark between them.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # small letters of Latin-1 and single blanks are left as they are by the normaliser and parted at the blanks
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.size = max(self.tokenizer.get_vocab().values()) + 1
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.size)])
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else -1
        self.known: dict[str, bytes] = {}

    def _exact(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, parts: list[str], tokenizer, text: str, last: Callable[[np.ndarray], np.ndarray], marks: int) -> None:
        """Learn parts from the ids of one text; ``last`` tells where parts end, ``marks`` ids behind each are not its own."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(last(ids)) + 1)).tolist()
        if len(cuts) == len(parts):
            raw = ids.tobytes()
            self.known.update(zip(parts, [raw[a : b - 4 * marks] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
        else:
            self.known.update((x, self._exact(x)) for x in parts)

    def _learn(self, parts: set[str]) -> None:
        plain: dict[str, list[str]] = defaultdict(list)
        other = []
        for part in parts:
            body = part.rstrip(PUNCTUATION)
            if body.isalpha() and (body.isascii() or LATIN.fullmatch(body)):
                plain[body.lower()].append(part)
            elif MARK in part:
                self.known[part] = self._exact(part)
            else:
                other.append(part)
        for i in range(0, len(other), TOGETHER):
            some = other[i : i + TOGETHER]
            self._together(some, self.tokenizer, "".join([f"{x} {MARK} " for x in some]), lambda ids: ids == self.mark, 1)
        words = [w for w in plain if w not in self.known]
        for i in range(0, len(words), TOGETHER):
            some = words[i : i + TOGETHER]
            self._together(some, self.letters, " ".join(some), lambda ids: self.ends[ids], 0)
        known = self.known
        for word, uses in plain.items():
            n, own = len(word), known[word]
            for part in uses:
                if len(part) == n:
                    known[part] = own
                    continue
                tail = part[n:]
                if tail not in known:
                    known[tail] = self._exact(tail)
                known[part] = own + known[tail]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [text_parts(t or "") for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new: set[str] = set()
        for p in parts:
            new.update(p)
        new.difference_update(self.known)
        if new:
            self._learn(new)
        known = self.known
        return [b"".join([known[x] for x in p]) for p in parts]


def word_ids(path: str) -> WordIds:
    """One per Python worker and vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def some_texts(texts: list[str | None], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` characters, one row at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or "") > limit:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = SEQUENCE) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32.

    A document is its ids and an end id; only longer ones are cut.  Null text
    is empty text: a piece of the end id alone.
    """
    end = np.array([END_ID], "<u4").tobytes()
    names = [doc_id, "piece", "start", "length", "ids_crc32"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in some_texts(texts):
                row, part, length, crc = [], [], [], []
                for i, ids in enumerate(word_ids(tokenizer).ids(texts[lo:hi]), lo):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * limit)):
                        piece = ids[at : at + 4 * limit]
                        row.append(i)
                        part.append(k)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                k = np.array(part, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int32())), pa.array(k), pa.array(k.astype(np.int64) * limit),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names)

    return docs.select(doc_id, text).mapInArrow(
        split, f"`{doc_id}` {type_of(docs, doc_id)}, piece int, start long, length long, ids_crc32 long")


def nnls(matrix: np.ndarray, target: np.ndarray, steps: int = 600) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient steps; columns are patterns."""
    gram, right = matrix.T @ matrix, matrix.T @ target
    rate = 1.0 / max(np.linalg.norm(gram, 2), 1e-9)
    x = y = np.zeros(matrix.shape[1])
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - rate * (gram @ y - right))
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / later * (new - x), new, later
    return x


def patterns(classes: int) -> list[tuple[int, ...]]:
    """All ways to fill ``classes`` units with one, two or three lengths (largest first)."""
    out: list[tuple[int, ...]] = [(classes,)]
    for a in range(classes - 1, 0, -1):
        if a >= classes - a:
            out.append((a, classes - a))
        for b in range(min(a, classes - a - 1), 0, -1):
            if 1 <= classes - a - b <= b:
                out.append((a, b, classes - a - b))
    return out


class Plan:
    """Sequences of equal lengths, by groups: a list of lengths and how many sequences hold them."""

    def __init__(self, histogram: dict[int, int], limit: int) -> None:
        self.left, self.limit = dict(histogram), limit
        self.groups: list[tuple[tuple[int, ...], int]] = []

    def take(self, ranges: list[range], repeats: int) -> None:
        """Fill up to ``repeats`` sequences to the last token: a length of each range but the last, and what is then missing.

        Pieces of a range that find no partner of the right length stay for the best fit.
        """
        *free, last = ranges
        if not repeats:
            return
        for head in product(*[[n for n in r if self.left.get(n)] for r in free]):
            rest = self.limit - sum(head)
            if rest not in last or not self.left.get(rest):
                continue
            lengths = (*head, rest)
            n = min(repeats, *[self.left[x] // lengths.count(x) for x in lengths])
            if n:
                self.groups.append((lengths, n))
                repeats -= n
                for x in lengths:
                    self.left[x] -= n
            if not repeats:
                return

    def best_fit(self) -> None:
        """Place what is left, longest first, where the least room stays; open new sequences where none is left."""
        rooms: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
        for lengths, n in self.groups:
            rooms[self.limit - sum(lengths)].append((lengths, n))
        sizes = sorted(rooms)
        for length in sorted((n for n, c in self.left.items() if c), reverse=True):
            count = self.left[length]
            while count:
                k = bisect_left(sizes, length)
                if k == len(sizes):
                    per = self.limit // length
                    full, rest = divmod(count, per)
                    for held, n in ((per, full), (rest, 1 if rest else 0)):
                        if n:
                            room = self.limit - held * length
                            if room not in rooms:
                                insort(sizes, room)
                            rooms[room].append(((length,) * held, n))
                    break
                room = sizes[k]
                lengths, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], sizes[k]
                # several of this length may go into one sequence's room
                per = min(room // length, -(-count // n)) if count >= n else 1
                used = min(n, count // per)
                if used < n:
                    if room not in rooms:
                        insort(sizes, room)
                    rooms[room].append((lengths, n - used))
                after = room - per * length
                if after not in rooms:
                    insort(sizes, after)
                rooms[after].append((lengths + (length,) * per, used))
                count -= per * used
            self.left[length] = 0
        self.groups = [x for room in sorted(rooms) for x in rooms[room]]

    def slots(self) -> pd.DataFrame:
        """Rows (length, from_rank, to_rank, sequence, offset): pieces of these ranks go to sequence + rank - from_rank."""
        rows, taken, base = [], defaultdict(int), 0
        for lengths, n in self.groups:
            offset = 0
            for length in lengths:
                rows.append((length, taken[length], taken[length] + n, base, offset))
                taken[length] += n
                offset += length
            base += n
        return pd.DataFrame(rows, columns=["length", "from_rank", "to_rank", "sequence", "offset"])


#: Shares of the fitted pattern counts that are tried.
SHARES = (1.0, 0.75, 0.5, 0.25)


def pattern_plan(histogram: dict[int, int], limit: int, classes: int, shares: tuple[float, ...]) -> Plan:
    """The plan with the fewest sequences among those that take these ``shares`` of the fitted counts."""
    counts: list[tuple[list[range], float]] = []
    classes = min(classes, limit)
    width = -(-limit // classes)
    classes = -(-limit // width)
    near = lambda n: max(1, (n + width // 2) // width)
    target = np.zeros(classes)
    for length, n in histogram.items():
        target[near(length) - 1] += n
    ways = [p for p in patterns(classes) if all(target[c - 1] for c in p)]
    if ways and limit % width == 0:
        matrix = np.zeros((classes, len(ways)))
        for j, p in enumerate(ways):
            for c in p:
                matrix[c - 1, j] += 1
        # a long piece misplaced costs more than a short one
        weight = np.arange(1, classes + 1) / classes
        fit = nnls(matrix * weight[:, None], target * weight)
        # lengths of a class, in whose middle it is named; the last piece makes up for what the others round away
        span = lambda c, more: range(max(1, c * width - width // 2 - more), min(limit, c * width + width // 2 - 1 + more) + 1)
        # pairs first: their pieces are the longest and have the fewest partners
        chosen = sorted(np.flatnonzero(fit >= 1), key=lambda j: (len(ways[j]), -fit[j]))
        counts = [([*[span(c, 0) for c in ways[j][:-1]], span(ways[j][-1], width)], fit[j]) for j in chosen]
    plans = []
    for share in shares:
        plan = Plan(histogram, limit)
        for ranges, repeats in counts:
            plan.take(ranges, int(share * repeats))
        plan.best_fit()
        plans.append(plan)
    return min(plans, key=lambda p: sum(n for _, n in p.groups))


def make_plan(histogram: dict[int, int], limit: int = SEQUENCE, classes: int = 64) -> Plan:
    """Fit pattern counts to the histogram, round down, fill them with lengths that leave no room, place the rest by best fit.

    Patterns name classes of like length; a sequence of one counts only if its
    pieces sum to ``limit``, so patterns waste nothing and what they cannot
    fill is left to the best fit.  How much the best fit should get depends on
    the histogram: the share of the counts with the fewest sequences is taken.
    """
    return pattern_plan(histogram, limit, classes, SHARES)


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = SEQUENCE,
) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; sequences hold ``limit`` tokens at most, without gaps.

    Every row of ``docs`` is packed, repeated ones and null ids too; ties are
    broken by id, piece and checksum.  Other columns are ignored.  No documents
    give no rows.  The driver holds the histogram (``limit`` counts) and the
    plan, whose size depends on ``limit`` alone.
    """
    spark = docs.sparkSession
    cutted = cut(pieces(docs, tokenizer, doc_id, text, limit), "pieces")
    histogram = {r.length: r.n for r in cutted.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = make_plan(histogram, limit).slots().sort_values(["length", "from_rank"], kind="stable")
    # two numbers a row find the slot: ranks of one length follow each other without holes
    sent = spark.sparkContext.broadcast({n: g.reset_index(drop=True) for n, g in slots.groupby("length")})
    ranked = order_rows(cutted, ["length"], [doc_id, "piece", "ids_crc32"], "_rank")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            for n in np.unique(length):
                mine, rows = np.flatnonzero(length == n), sent.value[n]
                at = np.searchsorted(rows["from_rank"].to_numpy(), rank[mine], "right") - 1
                sequence[mine] = rows["sequence"].to_numpy()[at] + rank[mine] - rows["from_rank"].to_numpy()[at]
                offset[mine] = rows["offset"].to_numpy()[at]
            yield batch.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    if not histogram:
        return cutted.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    schema = f"`{doc_id}` {type_of(docs, doc_id)}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInPandas(place, schema)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
