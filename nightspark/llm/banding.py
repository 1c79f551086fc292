"""Candidate search and linking shared by the near-duplicate operators.

Rows (key, id) say that an item fell into a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightspark.llm.common import cut, drop
from nightspark.llm.components import connected_components
from nightspark.llm.sketches import joining, least_same, loaded, pairs_of, part_keys, same, whole_buckets


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: those whose key stands twice or more (sure), and the first and last key (not sure)."""

    def out(key: np.ndarray, ids: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(sure)], ["key", "id", "sure"])

    held_key, held_id, first = np.empty(0, np.int64), np.empty(0, np.int64), True
    for batch in batches:
        key = np.concatenate((held_key, batch.column("key").to_numpy(zero_copy_only=False)))
        ids = np.concatenate((held_id, batch.column("id").to_numpy(zero_copy_only=False)))
        if not len(key):
            continue
        # equal rows stand side by side and count once
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])))
        key, ids = key[fresh], ids[fresh]
        same = key[1:] == key[:-1]
        many = np.concatenate((same, [False])) | np.concatenate(([False], same))
        keep = many.copy()
        if first:
            keep[0], first = True, False
        elif len(held_key):  # it was given out already if it was sure or the very first
            keep[0] = keep[0] and not held_out
            many[0] = many[0] or held_out
        held_out = bool(keep[-1]) or (len(key) == 1 and len(held_key) and held_out)
        held_key, held_id = key[-1:], ids[-1:]
        if keep.any():
            yield out(key[keep], ids[keep], many[keep])
    if len(held_key) and not held_out:
        yield out(held_key, held_id, np.array([False]))


def shared_buckets(bands: DataFrame, name: str) -> DataFrame:
    """A table of the distinct rows (key, id) of keys that several ids share; ``bands`` is read from a table.

    Rows are dealt by (key, id), so a bucket with a third of all rows is spread
    over a third of the partitions; a run that a partition border cuts is put
    together by its key.
    """
    runs = cut(bands.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(
        _runs, "key long, id long, sure boolean"), "buckets")
    # the keys at partition borders: two a partition at most
    border = runs.filter("NOT sure").select("key").distinct()
    spread = runs.join(border, "key", "left_semi").select("key", "id").distinct()
    wide = spread.groupBy("key").count().filter("count > 1").select("key")
    out = cut(runs.filter("sure").join(border, "key", "left_anti").select("key", "id").union(
        spread.join(wide, "key", "left_semi")), name)
    drop(runs)
    return out


#: Buckets of so many members (besides the centre) or fewer are compared pair by pair.
FEW = 8
#: Buckets of so many members or fewer are compared pair by pair where sketches tell which pairs can be links.
CLOSE = 4096
#: Further centres that a larger bucket of several components gets, one a round, before differences are listed.
STARS = 3


#: Members of a larger group that are asked for elements by which many differ from the centre, and how many of them "many" are.
ASKED, OFTEN = 64, 8


def difference(centre: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Elements that only one of two sets holds, those that the centre lacks first."""
    return np.concatenate((np.setdiff1d(member, centre, assume_unique=True), np.setdiff1d(centre, member, assume_unique=True)))


def rare_first(elements: np.ndarray, often: list[dict] | None) -> np.ndarray:
    """Elements in rising order of how many members hold them (``often``: e, k), else as they stand."""
    if not often:
        return elements
    held = {x["e"]: x["k"] for x in often}
    return elements[np.argsort([held.get(e, 0) for e in elements.view(np.int64).tolist()], kind="stable")]


def held_sets(sets_of: Callable[[list[bytes]], list[np.ndarray]]) -> Callable[[list, list[bytes]], dict]:
    def sets(ids: list, bodies: list[bytes]) -> dict:
        own = dict(zip(ids, bodies, strict=True))
        return dict(zip(own, sets_of(list(own.values())), strict=True))

    return sets


def confirmed(sets: Callable[[list, list[bytes]], dict], percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the pairs (a, b; texts ta, tb) of ``percent`` similarity or more."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                a, b = (list(zip(batch.column(x).to_pylist(), batch.column(y).to_pylist(), strict=True)) for x, y in (("a", "ta"), ("b", "tb")))
                held = sets([*a, *b], [x[1] for x in (*a, *b)])
                keep = []
                for x, y in zip(a, b, strict=True):
                    small, large = sorted((len(held[x]), len(held[y])))
                    both = len(np.intersect1d(held[x], held[y], assume_unique=True)) if 100 * small >= percent * large else 0
                    keep.append(100 * both >= percent * (small + large - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def linked(
    bands: DataFrame, texts_of: Callable[[DataFrame], DataFrame], sets_of: Callable[[list[bytes]], list[np.ndarray]],
    percent: int, name: str, likely: Callable[[DataFrame], DataFrame] | None = None, release: tuple[DataFrame, ...] = (),
) -> DataFrame:
    """Components (node, component) under links of ``percent`` Jaccard similarity between ids that share a bucket.

    ``texts_of`` gives (id, body) for ids, ``sets_of`` the sorted distinct
    hashes of bodies; ``likely`` may drop pairs (a, b) that cannot be links.
    Tables of ``release`` hold nothing but ``bands`` and are deleted when these
    are read; tables of this function are as soon as nothing reads them.

    First all members of a bucket are compared with its smallest id, the
    centre.  Larger buckets that then still hold several components get up to
    ``STARS`` further centres, drawn by hash apart in each bucket, so a group of
    near copies of which many miss the centre grows together at the cost of one
    pair a member.  Where a bucket still holds several components, its members are
    compared directly if they are ``FEW`` at most; of a larger bucket, each member is
    written as its difference to the centre.  Two members in different
    components can be linked only if their differences overlap by more than a
    known number of elements, so they share one early in a fixed order of the
    centre (elements by which many of its members differ last, and before that
    those it lacks first): those meet by a join on (centre, element).  No bucket is too large, no link is lost to one, and the pairs of
    a bucket are never all listed.
    """
    cap = (100 - percent) / (100 + percent)

    sets = held_sets(sets_of)
    confirm = confirmed(sets, percent)

    def some_differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                a, b = (list(zip(batch.column(x).to_pylist(), batch.column(y).to_pylist(), strict=True)) for x, y in (("a", "ta"), ("b", "tb")))
                held = sets([*a, *b], [x[1] for x in (*a, *b)])
                found = [difference(held[x], held[y]) for x, y in zip(a, b, strict=True)]
                at = pa.array(np.repeat(np.arange(len(found), dtype=np.int32), [len(d) for d in found]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a").take(at), pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], ["a", "e"])

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                a, b = (list(zip(batch.column(x).to_pylist(), batch.column(y).to_pylist(), strict=True)) for x, y in (("a", "ta"), ("b", "tb")))
                held = sets([*a, *b], [x[1] for x in (*a, *b)])
                inside, often = batch.column("inside").to_pylist(), batch.column("often").to_pylist()
                rows, elements, sizes, places, small, own = [], [], [], [], [], []
                for i, (x, y) in enumerate(zip(a, b, strict=True)):
                    d = rare_first(difference(held[x], held[y]), often[i])
                    # a link to a member outside the centre's component needs more than half of an inside one's difference
                    most = len(d) * (1 + cap) / 2 if inside[i] else len(d)
                    room = len(held[y]) * (100 - percent) // percent
                    n = int(min(len(d), room + 1, np.ceil(most)))
                    rows += [i] * n
                    elements.append(d[:n])
                    sizes += [len(d)] * n
                    places.append(np.arange(n))
                    small.append(np.arange(n) <= room / 2)
                    own += [len(held[y])] * n
                if rows:
                    at = pa.array(rows, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("a").take(at), batch.column("b").take(at), batch.column("group").take(at),
                         pa.array(np.concatenate(elements).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(own, pa.int32()),
                         pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(small))],
                        ["a", "b", "group", "e", "nd", "n", "place", "small"])

    shared = shared_buckets(bands, f"{name}-shared")
    if release:
        drop(*release)
    texts = cut(texts_of(shared.select("id").distinct()), f"{name}-texts")

    def with_texts(pairs: DataFrame) -> DataFrame:
        return pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def components(of: DataFrame) -> DataFrame:
        return cut(connected_components(of), f"{name}-groups")

    def verified(pairs: DataFrame) -> DataFrame:
        return cut(with_texts(likely(pairs) if likely else pairs).mapInArrow(confirm, "a long, b long"), f"{name}-links")

    centre = shared.groupBy("key").agg(F.min("id").alias("a"))
    starred = cut(shared.join(centre, "key").filter("id <> a").select("key", "a", F.col("id").alias("b")), f"{name}-stars")
    drop(shared)
    links = verified(starred.select("a", "b").distinct())
    groups = components(links)

    def of_groups() -> tuple[DataFrame, DataFrame]:
        """Bucket members with their components, and the keys (with members) of buckets that hold several."""
        named = starred.join(groups.toDF("b", "group"), "b", "left").withColumn("group", F.coalesce("group", "b"))
        named = cut(named, f"{name}-named")
        mixed = cut(named.groupBy("key").agg(
            F.min("group").alias("lo"), F.max("group").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi").select("key", "n"), f"{name}-mixed")
        return named, mixed

    named, mixed = of_groups()
    for turn in range(STARS):
        large = mixed.filter(F.col("n") > FEW).select("key")
        if large.isEmpty():
            break
        members = named.join(large, "key", "left_semi").select("key", "b", "group")
        hubs = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "b", F.lit(turn)), "b", "group")).alias("_hub"))
        pairs = members.join(hubs, "key").filter("_hub.group <> group").select(
            F.least("_hub.b", "b").alias("a"), F.greatest("_hub.b", "b").alias("b")).distinct()
        more = verified(pairs)
        if more.isEmpty():
            drop(more)
            break
        both = cut(links.union(more), f"{name}-links")
        drop(links, more, groups, named, mixed)
        links, groups = both, components(both)
        named, mixed = of_groups()
    drop(starred)
    few = named.join(mixed.filter(F.col("n") <= FEW).select("key"), "key", "left_semi").select("key", "b", "group")
    direct = few.select("key", F.col("b").alias("_a"), F.col("group").alias("_group")).join(few, "key").filter(
        "_a < b AND _group <> group").select(F.col("_a").alias("a"), "b").distinct()
    rest = named.join(mixed.filter(F.col("n") > FEW).select("key"), "key", "left_semi").select("a", "b", "group").distinct()
    rest = rest.join(groups.toDF("a", "_ga"), "a", "left").withColumn("inside", F.col("group") == F.coalesce("_ga", "a")).drop("_ga")
    rest = cut(rest, f"{name}-rest")
    if mixed.isEmpty():
        drop(texts, links, named, mixed, rest)
        return groups
    # which elements many members of a large group differ by from the centre: known from some members, used for the order alone
    sizes = rest.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > ASKED)
    asked = rest.join(sizes, "a").filter(F.pmod(F.xxhash64("a", "b"), F.col("n")) < ASKED).select("a", "b")
    often = cut(with_texts(asked).mapInArrow(some_differences, "a long, e long").groupBy("a", "e").agg(F.count(F.lit(1)).cast("int").alias("k")).filter(
        F.col("k") >= OFTEN).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("e", "k"))).alias("often")), f"{name}-often")
    spread = cut(with_texts(rest).join(often, "a", "left").mapInArrow(
        differences, "a long, b long, group long, e long, nd int, n int, place int, small boolean"), f"{name}-differences")
    drop(rest, often)
    x, y = (spread.select(*[F.col(c).alias(f"{side}_{c}") for c in spread.columns]) for side in "xy")
    need = F.col("x_nd") + F.col("y_nd") - cap * (F.col("x_n") + F.col("y_n")) - 1e-9
    meet = x.filter("x_small").join(y, (F.col("x_a") == F.col("y_a")) & (F.col("x_e") == F.col("y_e")) & (F.col("x_group") != F.col("y_group")) & (
        (F.col("x_nd") < F.col("y_nd")) | ((F.col("x_nd") == F.col("y_nd")) & (F.col("x_b") != F.col("y_b")))) & (
        2 * (F.col("x_nd") - F.col("x_place")) >= need) & (2 * (F.col("y_nd") - F.col("y_place")) >= need))
    pairs = meet.select(F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b")).union(direct).distinct()
    found = verified(pairs)
    drop(spread, texts, named, mixed)
    if found.isEmpty():
        drop(links, found)
        return groups
    out = components(links.union(found))
    drop(links, found, groups)
    return out


def linked_by_sketches(
    bands: DataFrame, sketches: DataFrame, n: int, texts_of: Callable[[DataFrame], DataFrame], sets_of: Callable[[list[bytes]], list[np.ndarray]],
    percent: int, name: str, release: tuple[DataFrame, ...] = (), parted: bool = False,
) -> DataFrame:
    """What ``linked`` gives, where ``sketches`` (id, sketch: ``n`` half bytes, see ``sketch_of``) tell which pairs can be links.

    Buckets of up to ``CLOSE`` members are compared pair by pair on sketches
    (a link is given up once in 10^8), so members alike to nobody go before any
    text is read; then alike pairs with the centre are verified on full sets,
    and members alike to one of another component are compared in their bucket,
    which gives out no more links than join its components.  A larger bucket that
    its centre does not join is parted by half bytes of the sketches (two
    members at the threshold share no part twice in 10^7); what is then still
    larger goes to ``linked``.
    """
    enough, confirm = least_same(n, percent), confirmed(held_sets(sets_of), percent)
    shared = shared_buckets(bands, f"{name}-shared")
    if release:
        drop(*release)
    wide = cut(shared.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > CLOSE).select("key", "a"), f"{name}-wide")

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", "id")

    def alike_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_buckets(batches):
            key, ids, words = batch.column("key").to_numpy(), batch.column("id").to_numpy(), loaded(batch.column("sketch"), n)
            first = np.searchsorted(key, key, "left")
            some, star = np.zeros(len(key), bool), np.zeros(len(key), bool)
            for i, j in pairs_of(key):
                fine = same(words[i], words[j], n) >= enough
                some[i[fine]] = some[j[fine]] = True
                star[j[fine & (first[i] == i)]] = True
            keep = pa.array(some)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).filter(keep) for c in ("key", "id", "sketch")], pa.array(ids[first][some]), pa.array(star[some])], ["key", "id", "sketch", "a", "star"])

    def alike_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fine = same(loaded(batch.column("sa"), n), loaded(batch.column("sb"), n), n) >= enough
                yield batch.select(["a", "b"]).filter(pa.array(fine))

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members alike to one of another component."""
        for batch in whole_buckets(batches):
            group, words = batch.column("group").to_numpy(), loaded(batch.column("sketch"), n)
            some = np.zeros(len(group), bool)
            for i, j in pairs_of(batch.column("key").to_numpy()):
                two = group[i] != group[j]
                i, j = i[two], j[two]
                fine = same(words[i], words[j], n) >= enough
                some[i[fine]] = some[j[fine]] = True
            yield batch.filter(pa.array(some))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the links between components of a bucket those that join them: fewer than it has members."""
        for batch in whole_buckets(batches):
            key, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
            edges = [*np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                links = joining(sets_of(part.column("body").to_pylist()), part.column("group").to_numpy(), loaded(part.column("sketch"), n), n, enough, percent)
                if links:
                    i, j = (ids[lo:hi][list(x)] for x in zip(*links, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = part_keys(batch.column("key").to_numpy(), loaded(batch.column("sketch"), n), n)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("id").to_numpy(), keys.shape[1]))], ["key", "id"])

    def likely(pairs: DataFrame) -> DataFrame:
        return pairs.join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b").mapInArrow(alike_pairs, "a long, b long")

    def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
        return rows.join(groups.toDF("id", "group"), "id", "left").withColumn("group", F.coalesce("group", "id"))

    near = shared.join(wide, "key", "left_anti").join(sketches, "id").select("key", "id", "sketch")
    near = cut(in_order(near).mapInArrow(alike_members, "key long, id long, sketch binary, a long, star boolean"), f"{name}-near")
    any_wide = not wide.isEmpty()
    if not any_wide:
        drop(shared)
    stars, wanted = near.filter("star").select("a", F.col("id").alias("b")), near.select("id")
    if any_wide:
        hopeful = cut(likely(shared.join(wide, "key").filter("id <> a").select("a", F.col("id").alias("b")).distinct()), f"{name}-hopeful")
        stars, wanted = stars.union(hopeful), wanted.union(hopeful.select("a")).union(hopeful.select("b"))
    # texts lie in the documents, all of which are read and dealt for them: once
    texts = cut(texts_of(wanted.distinct()), f"{name}-texts")
    links = cut(stars.distinct().join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").mapInArrow(confirm, "a long, b long"), f"{name}-links")
    groups = cut(connected_components(links), f"{name}-groups")
    members = "key long, id long, sketch binary, group long"
    open_ = cut(in_order(with_groups(near.select("key", "id", "sketch"), groups)).select("key", "id", "sketch", "group").mapInArrow(apart, members), f"{name}-open")
    more = cut(in_order(open_.join(texts, "id").select("key", "id", "sketch", "group", "body")).mapInArrow(joined, "a long, b long").distinct(), f"{name}-links")
    both = cut(links.union(more), f"{name}-links")
    drop(near, links, more, open_, texts, *([hopeful] if any_wide else []))
    if any_wide:
        members = with_groups(shared.join(wide.select("key"), "key"), groups)
        mixed = cut(members.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo <> hi").select("key"), f"{name}-mixed")
        rest = shared.join(mixed, "key", "left_semi")
        if mixed.isEmpty():
            found = None
        elif parted:
            found = linked(rest, texts_of, sets_of, percent, name, likely)
        else:
            again = cut(rest.join(sketches, "id").select("key", "id", "sketch").mapInArrow(parts, "key long, id long"), f"{name}-parts")
            found = linked_by_sketches(again, sketches, n, texts_of, sets_of, percent, name, (again,), True)
        if found is not None:
            both = cut(both.union(found.toDF("a", "b")), f"{name}-links")
        drop(mixed, shared)
    drop(wide, groups)
    out = cut(connected_components(both), f"{name}-groups")
    drop(both)
    return out
