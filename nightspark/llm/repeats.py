"""Removal of byte strings that also start in a document with a smaller id.

A string of ``length`` bytes that two documents share holds an anchor at the
same place in both: the first minimum of a hash over its grams.  So only anchors
travel, one for some 16 bytes of text, and of these only those whose gram
stands in another document too, with the strings they own around them.  In
their bucket the text from the anchor on is ordered by deep-shallow sorting, the
text before it likewise backwards; common prefixes of neighbours then tell which
strings are equal, and the smallest id of each is known.

Texts are kept in units of some MB in a table that is bucketed by unit, so that
what is learned of anchors meets them again without another shuffle of text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightspark.llm.common import binary_texts, cut, fresh_path, mixed, table
from nightspark.llm.suffixes import common_prefixes, deep_shallow, padded

LENGTH = 50
#: Bytes of text in a unit, and in the two kinds of buckets.
UNIT, KEY_BUCKET, BUCKET = 8 << 20, 32 << 20, 4 << 20
#: Grams with more occurrences are not met as a whole: each string around them goes its own way.
HOT = 100_000
STEP = 1 << 20


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value; byte planes of numbers compress well."""
    out = [np.array([len(arrays)], "<i8").tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(np.array([len(a), a.dtype.num], "<i8").tobytes())
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
    return zstandard.compress(b"".join(out), 3)


def unpacked(raw: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(raw)
    (many,) = np.frombuffer(data, "<i8", 1)
    at, out = 8, []
    for _ in range(many):
        n, num = np.frombuffer(data, "<i8", 2, at)
        kind = np.dtype(next(t for t in "bBhHiIlLqQ?" if np.dtype(t).num == num))
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at + 16)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel())
        at += 16 + n * kind.itemsize
    return out


def rising(keys: np.ndarray) -> np.ndarray:
    """Steps between rising numbers; cumsum undoes it."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place on; doubled from halves."""
    table_ = mixed(np.arange(1, 257, dtype=np.uint64))
    with np.errstate(over="ignore"):
        part, size, out, have = table_[data], 1, None, 0
        while True:
            if gram & size:
                if out is None:
                    out = part.copy()
                else:
                    out = out[: len(part) - have] * np.uint64(0x9E3779B97F4A7C15) ^ part[have:][: len(out)]
                    out ^= out >> np.uint64(29)
                have += size
            if 2 * size > gram:
                return mixed(out)
            left, right = part[:-size], part[size:]
            part = left * np.uint64(0xD6E8FEB86659FD93) + right
            part ^= part >> np.uint64(32)
            size *= 2


def shape(length: int) -> tuple[int, int]:
    """(gram, anchors a string may have): a string has that many grams; the first of the least hash is its anchor."""
    places = max(1, min(64, length * 5 // 8))
    return length - places + 1, places


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(hash, place, first string, last string) of all anchors; ``ends`` has the end of the text that each byte lies in.

    Long runs are cut at steps; a cut anchor comes twice, with strings of its own.
    """
    gram, places = shape(length)
    out = []
    for lo in range(0, max(0, len(data) - length + 1), STEP):
        hi = min(lo + STEP, len(data) - length + 1)
        fine = np.flatnonzero(ends[lo:hi] >= np.arange(lo, hi) + length)
        if not len(fine):
            continue
        h = gram_hashes(data[lo : hi + length - 1], gram)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= places:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < places:
            least = np.minimum(least[: len(least) - (places - size)], least[places - size :])
        own = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[fine]
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        last = np.concatenate([start[1:], [len(own)]]) - 1
        out.append((h[own[start]], own[start] + lo, fine[start] + lo, fine[last] + lo))
    if not out:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Unit:
    """Rows of some MB of text: their ids, bytes and anchors."""

    def __init__(self, ids: list[int | None], lengths: np.ndarray, blob: bytes, length: int) -> None:
        self.ids, self.lengths, self.length = ids, lengths.astype(np.int64), length
        self.data = np.frombuffer(blob, np.uint8)
        self.stops = np.cumsum(self.lengths)
        self.starts = self.stops - self.lengths
        self.key, self.at, self.first, self.last = anchors(self.data, np.repeat(self.stops, self.lengths), length)
        # order of ids; a null id is as large as the largest
        rank = [2**64 - 1 if i is None else i + 2**63 for i in ids]
        self.row = np.searchsorted(self.stops, self.at, "right")
        self.rank = np.array(rank, np.uint64)[self.row] if len(self.row) else np.zeros(0, np.uint64)

    def keys(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shortened hashes, rising; the place of each anchor's among them; how often each occurs."""
        short, place, n = np.unique(self.key >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        return short, place, n


def sized(docs: DataFrame, text: str) -> int:
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


class Layout:
    """Numbers that follow from the bytes of the corpus: bits of a shortened hash, buckets of hashes and of anchors."""

    def __init__(self, spark: SparkSession, size: int, length: int, unit: int, hot: int) -> None:
        self.length, self.unit, self.hot = length, unit, hot
        # one of 16,000 lone anchors shares its shortened hash by chance
        self.bits = min(64, max(1, size // 16).bit_length() + 14)
        least = max(256, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.key_buckets = max(least, size // KEY_BUCKET)
        self.buckets = max(least, size // BUCKET)
        self.tables = max(least, size // KEY_BUCKET)

    def key_bucket(self, short: np.ndarray) -> np.ndarray:
        return (short.astype(np.float64) * (self.key_buckets / 2.0**self.bits)).astype(np.int64)

    def bucket(self, key: np.ndarray) -> np.ndarray:
        return (mixed(key.copy()) % np.uint64(self.buckets)).astype(np.int64)


UNITS = "unit long, ids array<long>, lengths array<long>, blob binary, keys array<struct<bucket:long,held:binary>>"


def units(docs: DataFrame, doc_id: str, text: str, layout: Layout) -> DataFrame:
    """Texts by units, with the distinct shortened anchor hashes of each; stored in buckets of units."""

    def one(number: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        lengths = np.array([len(t) for t in texts], np.int64)
        blob = b"".join(texts)
        short, _, n = Unit(ids, lengths, blob, layout.length).keys(layout.bits)
        bucket = layout.key_bucket(short)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(short) else np.zeros(1, np.int64)
        keys = [{"bucket": int(bucket[a]), "held": packed(rising(short[a:b]), n[a:b])} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        kind = pa.list_(pa.struct([("bucket", pa.int64()), ("held", pa.binary())]))
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
             pa.array([zstandard.compress(blob, 3)], pa.binary()), pa.array([keys], kind)], ["unit", "ids", "lengths", "blob", "keys"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 33, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), binary_texts(batch, batch.schema.names[1]), strict=True):
                if texts and size + len(t or b"") > layout.unit:
                    yield one(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i)
                texts.append(t or b"")
                size += len(t or b"")
        if texts:
            yield one(number, ids, texts)

    spark = docs.sparkSession
    name, path = f"units_{uuid.uuid4().hex}", fresh_path(spark, "units")
    found = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(work, UNITS)
    found.write.bucketBy(layout.tables, "unit").option("path", path).saveAsTable(name)
    return spark.table(name)


def shared_keys(held: DataFrame, layout: Layout) -> DataFrame:
    """(unit, marks): per unit and bucket of hashes, which of its hashes other units have too (1), or very often (2)."""

    def meet(group: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in group.column("held").to_pylist()]
        keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        times = np.concatenate([p[1] for p in parts])
        by = np.argsort(keys)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(keys[by]) > 0]))
        spread = np.diff(np.concatenate([starts, [len(by)]]))
        mark = (spread > 1).astype(np.uint8)
        mark[np.add.reduceat(times[by], starts) > layout.hot] = 2
        marks = np.empty(len(by), np.uint8)
        marks[by] = np.repeat(mark, spread)
        ends = np.cumsum([len(p[0]) for p in parts])
        return pa.table({"of_unit": group.column("unit"), "bucket": group.column("bucket"),
                         "marks": pa.array([packed(m) for m in np.split(marks, ends[:-1])], pa.binary())})

    spread = held.select("unit", F.explode("keys").alias("k")).select("unit", "k.bucket", "k.held")
    return spread.groupBy("bucket").applyInArrow(meet, "of_unit long, bucket long, marks binary")


def gathered(parts: DataFrame, *columns: str) -> DataFrame:
    """One row per unit: as many values as the unit has buckets, of no more bytes than its text."""
    return parts.groupBy("of_unit").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("parts"))


def leaders(rows: np.ndarray, lengths: np.ndarray, before: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each string the one that stands for it: equal bytes, anchor at the same place, smallest id; itself if it is that one."""
    n = len(rows)
    if not n:
        return np.zeros(0, np.int64)
    wide = np.zeros((n, -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view(np.uint64)
    h = mixed((lengths * 256 + before).astype(np.uint64))
    for j in range(words.shape[1]):
        h = mixed(h ^ words[:, j])
    by = np.lexsort((rank, h))
    head = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(h[by]) != 0]), np.arange(n), 0))
    lead = by[head]
    same = (words[by] == words[lead]).all(1) & (lengths[by] == lengths[lead]) & (before[by] == before[lead])
    out = np.empty(n, np.int64)
    out[by] = np.where(same, lead, by)
    return out


FOUND = "of_unit long, kind int, found binary"


def candidates(unit: Unit, number: int, marks: list[bytes], layout: Layout) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(unit, bucket, kind, numbers, bytes): anchors that go to their buckets (kind 0), and what the unit decides alone.

    Of equal strings around anchors one goes, that of the smallest id.  Those of
    larger ids are removed whole (kind 1), others of the same id follow it (kind 2).
    """
    _, place, n = unit.keys(layout.bits)
    mark = np.concatenate([unpacked(m)[0] for m in marks]) if marks else np.zeros(0, np.uint8)
    # more than one text of the unit has it
    by = np.lexsort((unit.row, place))
    more = np.zeros(len(n), bool)
    more[place[by[1:]][(np.diff(place[by]) == 0) & (np.diff(unit.row[by]) > 0)]] = True
    mine = np.flatnonzero((mark[place] > 0) | more[place]) if len(place) else np.zeros(0, np.int64)
    hot = mark[place[mine]] == 2
    length, pick = layout.length, mine[~hot]
    at, first, last = unit.at[pick], unit.first[pick], unit.last[pick]
    key, row, rank = unit.key[pick], unit.row[pick], unit.rank[pick]
    if hot.any():
        # every string around a hot gram on its own: its anchor is its start, its key its own hash
        spots = mine[hot]
        many = unit.last[spots] - unit.first[spots] + 1
        start = np.repeat(unit.first[spots] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        h = mixed(np.full(len(start), length, np.uint64))
        rows = padded(unit.data, start, np.full(len(start), length), -(-length // 8) * 8)
        for j in range(rows.shape[1] // 8):
            h = mixed(h ^ rows.view(np.uint64)[:, j])
        at, first, last = (np.concatenate([x, start]) for x in (at, first, last))
        key, row, rank = np.concatenate([key, h]), np.concatenate([row, np.repeat(unit.row[spots], many)]), np.concatenate([rank, np.repeat(unit.rank[spots], many)])
    if not len(at):
        return
    size, before = last - first + length, at - first
    width = int(size.max())
    rows = padded(unit.data, first, size, width)
    lead = leaders(rows, size, before, rank)
    spot = at - unit.starts[row]
    own = (last - first + 1).astype(np.int64)
    whole = np.where(own >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(own, 63).astype(np.uint64)) - np.uint64(1))
    mask = whole << (at - last).astype(np.uint64)
    gone, follow = np.flatnonzero(rank > rank[lead]), np.flatnonzero((rank == rank[lead]) & (lead != np.arange(len(lead))))
    if len(gone):
        yield number, -1 - number % layout.buckets, 1, packed(row[gone].astype(np.int32), spot[gone], mask[gone]), b""
    if len(follow):
        lead_of = lead[follow]
        yield number, -1 - number % layout.buckets, 2, packed(
            row[follow].astype(np.int32), spot[follow], mask[follow], row[lead_of].astype(np.int32), spot[lead_of]), b""
    go = np.flatnonzero(lead == np.arange(len(lead)))
    bucket = layout.bucket(key[go])
    go = go[np.lexsort((key[go], bucket))]
    bucket = layout.bucket(key[go])
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0, [True]])) if len(go) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        x = go[a:b]
        inside = rows[x][np.arange(width) < size[x][:, None]]
        yield number, int(bucket[a]), 0, packed(
            row[x].astype(np.int32), spot[x], before[x].astype(np.uint16), size[x].astype(np.uint16), rank[x]), zstandard.compress(inside.tobytes(), 3)


def removed(data: np.ndarray, size: np.ndarray, before: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Bit i of an anchor's mask: the string that starts i bytes before it stands with a smaller id too.

    ``data`` holds the anchors' strings one after the other.
    """
    _, places = shape(length)
    start = np.cumsum(size) - size
    at, n = start + before, len(size)
    after = size - before
    mask = np.zeros(n, np.uint64)
    rows = padded(data, at, np.minimum(after, length), length)
    order = deep_shallow(rows, np.minimum(after, length))
    shared = common_prefixes(rows, np.minimum(after, length), order)
    back_rows = padded(data, at - 1, before, max(places - 1, 1), backwards=True)
    back = deep_shallow(back_rows, before)
    back_shared = common_prefixes(back_rows, before, back)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in range(places):
        own = np.flatnonzero((before >= i) & (size - before >= length - i) & (before - (size - length) <= i))
        if len(own) < 2:
            continue
        # classes of equal text behind and before the anchor; equal strings agree in both
        right[order] = np.cumsum(shared < length - i)
        left[back] = np.cumsum(back_shared < i)
        kind = right[own] * (n + 1) + left[own]
        by = np.argsort(kind)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(kind[by]) != 0]))
        if len(starts) == len(own):
            continue
        least = np.repeat(np.minimum.reduceat(rank[own[by]], starts), np.diff(np.concatenate([starts, [len(by)]])))
        mask[own[by][rank[own[by]] > least]] |= np.uint64(1 << i)
    return mask


def found_in(buckets: DataFrame, layout: Layout) -> DataFrame:
    """(unit, kind, found): removed strings by anchors (kind 1) and anchors that follow others (kind 2)."""

    def meet(group: pa.Table) -> pa.Table:
        kinds, number = group.column("kind").to_pylist(), group.column("unit").to_pylist()
        heads = group.column("head").to_pylist()
        if kinds[0]:
            return pa.table({"of_unit": group.column("unit"), "kind": group.column("kind"), "found": group.column("head")})
        parts = [unpacked(x) for x in heads]
        row, spot, before, size, rank = (np.concatenate(x) for x in zip(*parts, strict=True))
        data = np.frombuffer(b"".join(zstandard.decompress(x) for x in group.column("body").to_pylist()), np.uint8)
        before, size = before.astype(np.int64), size.astype(np.int64)
        mask = removed(data, size, before, rank, layout.length)
        out, lo = [], 0
        for p in parts:
            hi = lo + len(p[0])
            hit = np.flatnonzero(mask[lo:hi]) + lo
            out.append(packed(row[hit], spot[hit], mask[hit]) if len(hit) else None)
            lo = hi
        keep = [k for k, x in enumerate(out) if x is not None]
        return pa.table({"of_unit": pa.array([number[k] for k in keep], pa.int64()), "kind": pa.array([1] * len(keep), pa.int32()),
                         "found": pa.array([out[k] for k in keep], pa.binary())})

    return buckets.groupBy("bucket").applyInArrow(meet, FOUND)


def coverage(unit: Unit, parts: list[tuple[int, bytes]]) -> np.ndarray:
    """Which bytes of the unit are removed."""
    shown = {kind: [np.concatenate(x) for x in zip(*(unpacked(raw) for k, raw in parts if k == kind), strict=True)] for kind in (1, 2)}
    gone = np.zeros(len(unit.data), bool)
    if not shown[1]:
        return gone
    row, spot, mask = shown[1]
    place = unit.starts[row] + spot
    by = np.argsort(place)
    first = np.flatnonzero(np.concatenate([[True], np.diff(place[by]) > 0]))
    place, mask = place[by][first], np.bitwise_or.reduceat(mask[by], first)
    if shown[2]:
        row, spot, own, lead_row, lead_spot = shown[2]
        lead = unit.starts[lead_row] + lead_spot
        at = np.minimum(np.searchsorted(place, lead), len(place) - 1)
        same = np.where(place[at] == lead, mask[at] & own, np.uint64(0))
        place, mask = np.concatenate([place, unit.starts[row] + spot]), np.concatenate([mask, same])
    for i in range(64):
        gone[place[(mask >> np.uint64(i)) & np.uint64(1) == 1] - i] = True
    # a byte is removed if a removed string starts at it or less than a length before it
    starts = np.concatenate([[0], np.cumsum(gone)])
    return starts[1:] > np.concatenate([np.zeros(unit.length, np.int64), starts[1:]])[: len(gone)]


def spans(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs."""
    edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def digests(unit: Unit, gone: np.ndarray) -> dict[str, list]:
    """Sizes and the digest of what is kept, per row."""
    out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
    for lo, hi in zip(unit.starts, unit.stops, strict=True):
        mine = gone[lo:hi]
        out["n_bytes"].append(int(hi - lo))
        out["n_removed"].append(int(mine.sum()))
        out["n_spans"].append(len(spans(mine)[0]))
        out["kept_sha256"].append(hashlib.sha256(unit.data[lo:hi][~mine] if mine.any() else unit.data[lo:hi]).hexdigest())
    return out


def removals(unit: Unit, gone: np.ndarray) -> dict[str, list]:
    """Removed runs and what is kept, per row."""
    out: dict[str, list] = {"spans": [], "kept": []}
    for lo, hi in zip(unit.starts, unit.stops, strict=True):
        out["spans"].append([{"start": int(a), "end": int(b)} for a, b in zip(*spans(gone[lo:hi]), strict=True)])
        out["kept"].append(unit.data[lo:hi][~gone[lo:hi]].tobytes())
    return out


DIGESTS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
REMOVALS = "spans array<struct<start:long,end:long>>, kept binary"


def repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
    show: Callable[[Unit, np.ndarray], dict[str, list]] = digests, schema: str = DIGESTS,
    unit: int = UNIT, hot: int = HOT,
) -> DataFrame:
    """A row per row of ``docs``: what ``show`` tells of its bytes and of those that are removed.

    A byte goes if a string of ``length`` bytes around it, within the text, also
    starts in a text with a smaller id.  Null text is empty; texts shorter than
    ``length`` keep all.  Ids are whole numbers; rows with equal ids are not
    smaller than each other; a null id counts as the largest one.  Repeated rows
    are answered each.  Other columns are ignored.  ``length`` is 2 to 190.
    """
    if not 2 <= length <= 190:
        raise ValueError("length must be 2 to 190")
    spark = docs.sparkSession
    layout = Layout(spark, sized(docs, text), length, unit, hot)
    held = units(docs, doc_id, text, layout)
    marks = gathered(shared_keys(held, layout), "bucket", "marks")

    def unit_of(ids: list, lengths: list, blob: bytes) -> Unit:
        return Unit(ids, np.array(lengths, np.int64), zstandard.decompress(blob), length)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                number, ids, lengths, blob, parts = (batch.column(c)[k].as_py() for c in range(5))
                rows = list(candidates(unit_of(ids, lengths, blob), number, [x["marks"] for x in parts or []], layout))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                        ["unit", "bucket", "kind", "head", "body"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, lengths, blob, parts = (batch.column(c)[k].as_py() for c in range(1, 5))
                mine = Unit.__new__(Unit)
                mine.stops = np.cumsum(np.array(lengths, np.int64))
                mine.starts, mine.length = mine.stops - np.array(lengths, np.int64), length
                mine.data = np.frombuffer(zstandard.decompress(blob), np.uint8)
                gone = coverage(mine, [(x["kind"], x["found"]) for x in parts or []])
                yield pa.RecordBatch.from_pylist([{"id": i, **dict(zip(shown, x, strict=True))} for shown in [show(mine, gone)]
                                                  for i, x in zip(ids, zip(*shown.values(), strict=True), strict=True)], shape_of)

    text_of = held.select("unit", "ids", "lengths", "blob")
    chosen = text_of.join(marks, text_of.unit == marks.of_unit, "left").select("unit", "ids", "lengths", "blob", "parts").mapInArrow(
        choose, "unit long, bucket long, kind int, head binary, body binary")
    found = gathered(cut(found_in(chosen, layout), "found"), "kind", "found")
    back = text_of.join(found, text_of.unit == found.of_unit, "left").select("unit", "ids", "lengths", "blob", "parts")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    shape_of = to_arrow_schema(_parse_datatype_string(f"id long, {schema}"))
    return back.mapInArrow(answer, f"id long, {schema}").withColumnRenamed("id", doc_id)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, spans, kept): removed byte runs of each text, and the bytes that are left."""
    return repeats(docs, doc_id, text, length, removals, REMOVALS)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
