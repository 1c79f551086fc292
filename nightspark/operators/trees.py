"""Boosted and bagged trees of all left-out folds, grown from shared histograms.

A feature is cut into bins once; a level of all trees of all folds then needs one
aggregate of sums per (model, node, feature, bin), from which the best splits
follow.  Up to ``SMALL_ROWS`` training rows (boosted: different ones) the bins are
sent to the tasks and each grows whole models by the same rules; beyond that, rows
stay where they are and a level is one Spark job for every model at once.  Both
ways grow the same trees; the choice follows the measured number of rows.  Deep
bagged trees outgrow the driver, so the task that grew some scores the held-out
rows by them and gives out sums, not trees.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightspark.operators.folds import MAX_FOLDS
from nightspark.operators.ordering import stable
from nightspark.operators.workers import numbers, visible

#: Rows that a task holds: some 30 bytes each, and 200 while a model grows.
SMALL_ROWS = 2_000_000
#: Rounds after which the scores so far are written, so that a job replays few trees.
REPLAY = 8
#: Bagged trees that are grown together in the distributed way.
TREES_AT_ONCE = 20


@dataclass(frozen=True)
class Growth:
    """How trees grow: ``boosted`` on a binary target, or bagged on ``classes``."""

    boosted: bool = True
    classes: int = 2
    trees: int = 300
    depth: int = 5
    rate: float = 0.05
    leaf_rows: int = 20
    leaf_curvature: float = 1e-3
    share: float = 0.8  # of the features, drawn per tree (boosted) or per node (bagged)
    bins: int = 64
    seed: int = 42

    @property
    def sums(self) -> int:
        return 3 if self.boosted else self.classes + 1

    def drawn(self, features: int) -> int:
        return max(1, min(features, int(np.ceil(self.share * features - 1e-9))))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of whole numbers well spread; the draws below are functions of it and repeat anywhere."""
    x = np.array(x, np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def seeded(*parts: int) -> int:
    value = 0
    for p in parts:
        value = int(mixed((value + p + 0x9E3779B97F4A7C15) % 2**64))
    return value


def bagged_weights(rows: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) draws of rows, by their hash."""
    u = mixed(rows.astype(np.uint64) ^ np.uint64(seed)) / 2.0**64
    steps = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))
    return np.searchsorted(steps, u, "right").astype(float)


class Tree:
    """Inner nodes hold a feature and the last bin that goes left; ``value`` is that of a leaf."""

    def __init__(self, seed: int, width: int) -> None:
        self.seed = seed
        self.feature, self.cut, self.left, self.right = [-1], [0], [0], [0]
        self.value: list[np.ndarray] = [np.zeros(width)]
        self.gain = [0.0]
        self.name = [1]
        self.front = [0]

    def frozen(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature, np.int16), np.array(self.cut, np.int16), np.array(self.left, np.int32),
                np.array(self.right, np.int32), np.array(self.value, np.float64), np.array(self.gain, np.float64))

    def allowed(self, features: int, growth: Growth) -> np.ndarray:
        """Features open to each node of the front."""
        names = np.zeros(len(self.front), np.uint64) if growth.boosted else np.array([self.name[i] for i in self.front], np.uint64)
        # seeded(self.seed, name) of all names at once
        with np.errstate(over="ignore"):
            drawn = mixed(np.uint64(seeded(self.seed)) + names + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(2**60)
        out = np.zeros((len(names), features), bool)
        np.put_along_axis(out, np.argsort(mixed(drawn[:, None] + np.arange(features, dtype=np.uint64)), axis=1)[:, : growth.drawn(features)], True, 1)
        return out

    def grow(self, splits: Splits, growth: Growth) -> None:
        """Split the front; its children are the next front."""
        if self.front[:1] == [0]:
            self.value[0] = leaf_values(splits.total[:1], growth)[0]
        found = np.flatnonzero(splits.feature >= 0)
        first = len(self.feature)
        for n, k in enumerate(found.tolist()):
            i = self.front[k]
            self.feature[i], self.cut[i], self.gain[i] = int(splits.feature[k]), int(splits.cut[k]), float(splits.gain[k])
            self.left[i], self.right[i] = first + 2 * n, first + 2 * n + 1
            self.name += (2 * self.name[i], 2 * self.name[i] + 1)
        left = splits.left[found]
        sides = np.stack([left, splits.total[found] - left], 1).reshape(-1, splits.total.shape[1])
        self.value += list(leaf_values(sides, growth))
        for held, value in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.gain, 0.0)):
            held += [value] * len(sides)
        self.front = list(range(first, first + len(sides)))


def leaf_values(sums: np.ndarray, growth: Growth) -> np.ndarray:
    if growth.boosted:
        return -growth.rate * sums[:, :1] / np.maximum(sums[:, 1:2], 1e-12)
    total = sums[:, : growth.classes].sum(1, keepdims=True)
    return np.where(total > 0, sums[:, : growth.classes] / np.where(total > 0, total, 1), 1.0 / growth.classes)


def walk(tree: tuple[np.ndarray, ...], codes: np.ndarray) -> np.ndarray:
    """Node in which each row ends."""
    feature, cut, left, right = tree[:4]
    at = np.zeros(len(codes), np.int32)
    live = np.flatnonzero(feature[at] >= 0)
    while len(live):
        node = at[live]
        at[live] = np.where(codes[live, feature[node]] > cut[node], right[node], left[node])
        live = live[feature[at[live]] >= 0]
    return at


@dataclass(frozen=True)
class Splits:
    """Per node of a front: feature (-1: none), cut, sums of its rows and of those that go left, gain."""

    feature: np.ndarray
    cut: np.ndarray
    total: np.ndarray
    left: np.ndarray
    gain: np.ndarray


def histogram(codes: np.ndarray, slot: np.ndarray, sums: np.ndarray, nodes: int, bins: int, features: Sequence[int] | None = None) -> np.ndarray:
    """(node, feature, bin, sum) of rows; ``slot`` is a row's node in the front.  Of features other than ``features`` nothing is summed."""
    n, d = codes.shape
    out = np.zeros((nodes, d, bins, sums.shape[1]))
    weights = np.ascontiguousarray(sums.T)
    for j in range(d) if features is None else features:
        at = slot * bins + codes[:, j]
        for s, w in enumerate(weights):
            out[:, j, :, s] = np.bincount(at, w, nodes * bins).reshape(nodes, bins)
    return out


def best_splits(hist: np.ndarray, allowed: np.ndarray, growth: Growth, summed: int = 0) -> Splits:
    """``summed`` is a feature whose bins hold all rows of a node."""

    def score(s: np.ndarray) -> np.ndarray:
        if growth.boosted:
            return s[..., 0] ** 2 / np.maximum(s[..., 1], 1e-12)
        c = s[..., : growth.classes]
        return (c**2).sum(-1) / np.maximum(c.sum(-1), 1e-12)

    def enough(s: np.ndarray) -> np.ndarray:
        fine = s[..., -1] >= growth.leaf_rows - 1e-9
        return fine & (s[..., 1] >= growth.leaf_curvature) if growth.boosted else fine

    total = hist[:, summed].sum(1)
    left = hist.cumsum(2)[:, :, :-1]
    right = total[:, None, None] - left
    gain = score(left) + score(right) - score(total)[:, None, None]
    gain = np.where(enough(left) & enough(right) & allowed[:, :, None], gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    # gains that differ by rounding alone are equal: the first feature and bin wins
    top = flat.max(1)
    pick = (flat >= (top - 1e-9 * np.maximum(1.0, np.abs(top)))[:, None]).argmax(1)
    found = top > 1e-9
    width = gain.shape[2]
    feature, cut = pick // width, pick % width
    rows = np.arange(len(gain))
    return Splits(np.where(found, feature, -1), cut, total, left[rows, feature, cut], top)


def bagged_splits(codes: np.ndarray, slot: np.ndarray, y: np.ndarray, times: np.ndarray, picks: np.ndarray, weight: np.ndarray, growth: Growth) -> Splits:
    """``best_splits`` of bagged rows over the bins they fill: work goes by rows, however many nodes a deep front has.

    ``picks`` are the open features of each node, rising.  Cumulated draws are
    whole numbers, so no sum is rounded before it is weighted.
    """
    nodes, k = picks.shape
    c = growth.classes
    if not len(slot):
        zero = np.zeros((nodes, c + 1))
        return Splits(np.full(nodes, -1), np.zeros(nodes, int), zero, zero, np.full(nodes, -np.inf))
    key = (slot[:, None] * k + np.arange(k)) * growth.bins + codes[np.arange(len(slot))[:, None], picks[slot]]
    entries = np.sort((((key * c + y[:, None]) << 4) + times.astype(np.int64)[:, None]).ravel())
    key, kind = np.divmod(entries >> 4, c)
    count = np.zeros((len(key), c))
    count[np.arange(len(key)), kind] = entries & 15
    last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
    upto, key = count.cumsum(0)[last], key[last]
    part = key // growth.bins
    start = np.searchsorted(part, np.arange(nodes * k))
    before = np.concatenate([np.zeros((1, c)), upto])[start]
    whole = upto[np.append(start[1:], len(part)) - 1] - before
    left = upto - before[part]
    right = whole[part] - left

    def score(n: np.ndarray) -> np.ndarray:
        s = n * weight
        return (s**2).sum(1) / np.maximum(s.sum(1), 1e-12)

    fine = (left.sum(1) >= growth.leaf_rows) & (right.sum(1) >= growth.leaf_rows)
    gain = np.where(fine, score(left) + score(right) - score(whole)[part], -np.inf)
    node = part // k
    top = np.maximum.reduceat(gain, start[::k])
    near = np.flatnonzero(gain >= (top - 1e-9 * np.maximum(1.0, np.abs(top)))[node])
    pick = near[np.searchsorted(node[near], np.arange(nodes))]
    feature = np.where(top > 1e-9, picks[np.arange(nodes), part[pick] % k], -1)

    def sums(n: np.ndarray) -> np.ndarray:
        return np.column_stack([n * weight, n.sum(1)])

    return Splits(feature, key[pick] % growth.bins, sums(whole[::k]), sums(left[pick]), top)


@dataclass(frozen=True)
class Model:
    """One fold of one target: rows of fold ``out`` are held out; weights per class."""

    target: int
    out: int
    weight: tuple[float, ...]
    number: int


def row_sums(growth: Growth, y: np.ndarray, weight: np.ndarray, score: np.ndarray | None, times: np.ndarray | None) -> np.ndarray:
    """What a row adds to its bins."""
    w = weight[y]
    if growth.boosted:
        p = 1 / (1 + np.exp(-score))
        w = w * times
        return np.stack([w * (p - y), w * p * (1 - p), times], 1)
    out = np.zeros((len(y), growth.classes + 1))
    out[np.arange(len(y)), y] = w * times
    out[:, -1] = times
    return out


def moved(tree: tuple[np.ndarray, ...], codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows one level further down."""
    feature, cut, left, right = tree[:4]
    go = np.flatnonzero(feature[at] >= 0)
    node = at[go]
    at[go] = np.where(codes[go, feature[node]] > cut[node], right[node], left[node])
    return at


def boosted_tree(tree: Tree, codes: np.ndarray, sums: np.ndarray, growth: Growth) -> np.ndarray:
    """Grows ``tree``; gives the node in which each row ends.  Of two children the smaller one is summed, the other is the rest."""
    at = np.zeros(len(codes), np.int32)
    # a boosted tree draws its features once
    drawn = np.flatnonzero(tree.allowed(codes.shape[1], growth)[0])
    hist = histogram(codes, np.zeros(len(codes), int), sums, 1, growth.bins, drawn)
    for level in range(growth.depth):
        splits = best_splits(hist, tree.allowed(codes.shape[1], growth), growth, drawn[0])
        tree.grow(splits, growth)
        if not tree.front:
            break
        at = moved(tree.frozen(), codes, at)
        if level + 1 < growth.depth:
            found = np.flatnonzero(splits.feature >= 0)
            small = (2 * splits.left[found, -1] > splits.total[found, -1]).astype(int)
            children = np.array(tree.front).reshape(-1, 2)
            slot_of = np.full(len(tree.feature), -1)
            slot_of[children[np.arange(len(found)), small]] = np.arange(len(found))
            slot = slot_of[at]
            rows = np.flatnonzero(slot >= 0)
            part = histogram(codes[rows], slot[rows], sums[rows], len(found), growth.bins, drawn)
            both = np.stack([part, hist[found] - part], 1)
            both[small == 1] = both[small == 1][:, ::-1]
            hist = both.reshape(-1, *hist.shape[1:])
    return at


def bagged_tree(tree: Tree, codes: np.ndarray, y: np.ndarray, times: np.ndarray, weight: np.ndarray, growth: Growth) -> None:
    at = np.zeros(len(codes), np.int32)
    for _ in range(growth.depth):
        slot_of = np.full(len(tree.feature), -1)
        slot_of[tree.front] = np.arange(len(tree.front))
        slot = slot_of[at]
        live = np.flatnonzero(slot >= 0)
        codes, y, times, at, slot = codes[live], y[live], times[live], at[live], slot[live]
        picks = np.nonzero(tree.allowed(codes.shape[1], growth))[1].reshape(len(tree.front), -1)
        tree.grow(bagged_splits(codes, slot, y, times, picks, weight, growth), growth)
        if not tree.front:
            break
        at = moved(tree.frozen(), codes, at)


def trained(model: Model, codes: np.ndarray, fold: np.ndarray, label: np.ndarray, row: np.ndarray, growth: Growth, some: range | None = None) -> Iterator[tuple]:
    """The trees of a model (of a bagged one, those numbered ``some``) from rows in memory, one after the other."""
    mine = np.flatnonzero((fold != model.out) & (label[:, model.target] >= 0))
    codes, y, row = codes[mine], label[mine, model.target].astype(int), row[mine]
    weight = np.array(model.weight)
    if growth.boosted:
        # a score depends on the bins alone: rows of equal bins, of whatever fold and class, are one row
        order = np.lexsort(codes.T)
        codes, y, row = codes[order], y[order], row[order].astype(float)
        first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]).any(1))) if len(codes) else np.zeros(0, int)
        each = np.stack([np.add.reduceat(np.where(y == c, row, 0.0), first) if len(first) else np.zeros(0) for c in range(2)], 1)
        codes, times, heavy = codes[first], each.sum(1), each * weight
        whole, score = heavy.sum(1), np.zeros(len(first))
    for t in some or range(growth.trees):
        tree = Tree(seeded(growth.seed, model.number, t), 1 if growth.boosted else growth.classes)
        if growth.boosted:
            p = 1 / (1 + np.exp(-score))
            at = boosted_tree(tree, codes, np.stack([whole * p - heavy[:, 1], whole * p * (1 - p), times], 1), growth)
            out = tree.frozen()
            score += out[4][at, 0]
        else:
            times = bagged_weights(row, tree.seed)
            used = np.flatnonzero(times)
            bagged_tree(tree, codes[used], y[used], times[used], weight, growth)
            out = tree.frozen()
        yield out


def replayed(score: np.ndarray, trees: dict[int, list], models: Sequence[Model], codes: np.ndarray) -> np.ndarray:
    """Scores after some more trees of each model."""
    for k, m in enumerate(models):
        for tree in trees[m.number]:
            score[:, k] += tree[4][walk(tree, codes), 0]
    return score


def grown(data: DataFrame, models: Sequence[Model], growth: Growth, features: int) -> dict[int, list[tuple]]:
    """The same trees as ``trained`` gives, from rows that stay distributed: one job per level."""
    done: dict[int, list[tuple]] = {m.number: [] for m in models}
    if growth.boosted:
        held, behind = data.withColumn("_score", F.lit(None).cast("binary")), {m.number: [] for m in models}
        for t in range(growth.trees):
            new = level_by_level(held, models, {m.number: [Tree(seeded(growth.seed, m.number, t), 1)] for m in models}, behind, growth, features)
            for m in models:
                done[m.number] += new[m.number]
                behind[m.number] = behind[m.number] + new[m.number]
            if (t + 1) % REPLAY == 0 and t + 1 < growth.trees:
                held = stable(with_scores(held, models, behind))
                behind = {m.number: [] for m in models}
        return done
    for start in range(0, growth.trees, TREES_AT_ONCE):
        some = range(start, min(start + TREES_AT_ONCE, growth.trees))
        new = level_by_level(data.withColumn("_score", F.lit(None).cast("binary")), models,
                             {m.number: [Tree(seeded(growth.seed, m.number, t), growth.classes) for t in some] for m in models}, done, growth, features)
        for m in models:
            done[m.number] += new[m.number]
    return done


ROWS = "_f int, _codes binary, _labels binary, _row long, _score binary"


def rows_of(batch: pa.RecordBatch, features: int, models: int) -> tuple[np.ndarray, ...]:
    n = batch.num_rows
    codes = np.frombuffer(b"".join(batch.column("_codes").to_pylist()), np.uint8).reshape(n, features)
    labels = np.frombuffer(b"".join(batch.column("_labels").to_pylist()), np.int8).reshape(n, -1)
    held = batch.column("_score").to_pylist() if "_score" in batch.schema.names else []
    score = np.frombuffer(b"".join(held), np.float64).reshape(n, models).copy() if held and held[0] is not None else np.zeros((n, models))
    return batch.column("_f").to_numpy(), codes, labels, batch.column("_row").to_numpy(), score


def with_scores(held: DataFrame, models: Sequence[Model], behind: dict[int, list]) -> DataFrame:
    sent = held.sparkSession.sparkContext.broadcast((behind, models))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, ms = sent.value
        for batch in batches:
            features = len(batch.column("_codes")[0].as_py()) if batch.num_rows else 1
            *_, score = rows_of(batch, features, len(ms))
            score = replayed(score, trees, ms, rows_of(batch, features, len(ms))[1])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("_f", "_codes", "_labels", "_row")], pa.array([s.tobytes() for s in score], pa.binary())],
                ["_f", "_codes", "_labels", "_row", "_score"])

    return held.select("_f", "_codes", "_labels", "_row", "_score").mapInArrow(work, ROWS)


def level_by_level(held: DataFrame, models: Sequence[Model], trees: dict[int, list[Tree]], behind: dict[int, list], growth: Growth, features: int) -> dict[int, list[tuple]]:
    for _ in range(growth.depth):
        if not any(t.front for ts in trees.values() for t in ts):
            break
        sent = held.sparkSession.sparkContext.broadcast((models, behind, {
            n: [(t.frozen(), t.front, t.seed, t.allowed(features, growth)) for t in ts] for n, ts in trees.items()}))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ms, before, now = sent.value
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                fold, codes, labels, row, score = rows_of(batch, features, len(ms))
                if growth.boosted:
                    score = replayed(score, before, ms, codes)
                for k, m in enumerate(ms):
                    mine = np.flatnonzero((fold != m.out) & (labels[:, m.target] >= 0))
                    y = labels[mine, m.target].astype(int)
                    for i, (tree, front, seed, _) in enumerate(now[m.number]):
                        if not front:
                            continue
                        times = row[mine].astype(float) if growth.boosted else bagged_weights(row[mine], seed)
                        sums = row_sums(growth, y, np.array(m.weight), score[mine, k], times)
                        slot_of = np.full(len(tree[0]), -1)
                        slot_of[front] = np.arange(len(front))
                        slot = slot_of[walk(tree, codes[mine])]
                        live = np.flatnonzero((slot >= 0) & (sums[:, -1] > 0))
                        h = histogram(codes[mine[live]], slot[live], sums[live], len(front), growth.bins)
                        total[m.number, i] = total[m.number, i] + h if (m.number, i) in total else h
            for (number, i), h in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([i]), pa.array([h.tobytes()], pa.binary())], ["model", "tree", "sums"])

        def choose(group: pa.Table) -> pa.Table:
            number, i = group.column("model")[0].as_py(), group.column("tree")[0].as_py()
            allowed = sent.value[2][number][i][3]
            shape = (len(allowed), features, growth.bins, growth.sums)
            hist = np.zeros(shape)
            for raw in group.column("sums").to_pylist():
                hist += np.frombuffer(raw).reshape(shape)
            return pa.table({"model": [number], "tree": [i], "splits": pa.array([pickle.dumps(best_splits(hist, allowed, growth))], pa.binary())})

        found = held.mapInArrow(partial, "model long, tree long, sums binary").groupBy("model", "tree").applyInArrow(
            choose, "model long, tree long, splits binary").collect()
        got = {(r.model, r.tree): pickle.loads(r.splits) for r in found}
        sent.unpersist()
        for n, ts in trees.items():
            for i, t in enumerate(ts):
                if t.front:
                    if (n, i) in got:
                        t.grow(got[n, i], growth)
                    else:
                        t.front = []
    return {n: [t.frozen() for t in ts] for n, ts in trees.items()}


def edges_of(data: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """Rising bin borders per column at equal shares of its rows (a mergeable sketch, error under 1 / 100,000 of the rows)."""
    probs = [float(p) for p in np.linspace(0, 1, bins - 1)[1:-1]]
    row = data.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), F.array(*[F.lit(p) for p in probs]), F.lit(100_000)).alias(c) for c in columns]).first()
    return [np.unique(np.array(row[c] or [], float)) for c in columns]


def out_of_fold(
    df: DataFrame, features: Sequence[str], labels: Sequence[str], owner: str, keep: Sequence[str],
    growth: Growth, folds: int | None = None, small: int = SMALL_ROWS, balanced: bool = True,
) -> tuple[DataFrame, Mapping[tuple, list[tuple]]]:
    """Each row scored, per label, by trees that never saw its owner; trees by (label, fold).

    Gives ``keep``, the owner, ``target`` (label's name), ``_label``,
    ``prediction``, ``probability`` and ``fold_status`` ("one_class" where the
    other folds hold one class, which its rows then get).  Missing feature
    values have a bin of their own before all others.  Rows without a label
    train nothing and are scored; rows without an owner are left out.  Bin
    borders come from all rows, labels are never looked at for them.
    """
    spark = df.sparkSession
    visible(spark)
    cols = list(dict.fromkeys([*keep, owner]))
    group = F.pmod(F.xxhash64(owner), F.lit(folds)) if folds else F.col(owner)
    data = df.filter(F.col(owner).isNotNull()).select(
        *cols, group.alias("_fold"), F.xxhash64(*cols, *features).alias("_row"),
        *[F.col(c).cast("double").alias(f"_y{i}") for i, c in enumerate(labels)], *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    names = [r[0] for r in data.select("_fold").distinct().limit(MAX_FOLDS + 1).collect()]
    if len(names) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} owners: give the number of folds")
    names.sort()
    kind = data.schema["_fold"].dataType.simpleString()
    data = data.join(spark.createDataFrame(list(enumerate(names)), f"_f int, _name {kind}"), F.col("_fold") == F.col("_name")).drop("_name", "_fold")
    data = stable(data)
    x, y = [f"_x{i}" for i in range(len(features))], [f"_y{i}" for i in range(len(labels))]
    edges = edges_of(data, x, growth.bins)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, t = numbers(batch, x), numbers(batch, y)
            codes = np.zeros(v.shape, np.uint8)
            for j, e in enumerate(edges):
                codes[:, j] = np.where(np.isnan(v[:, j]), 0, 1 + np.searchsorted(e, v[:, j], "left"))
            # labels are class numbers; anything else is no label
            fine = (t >= 0) & (t < growth.classes) & (t == np.floor(t))
            known = np.where(fine, np.nan_to_num(t), -1).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in (*cols, *y)], batch.column("_f"), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array([k.tobytes() for k in known], pa.binary()), batch.column("_row")], [*cols, *y, "_f", "_codes", "_labels", "_row"])

    kinds = ", ".join(f"`{c}` {data.schema[c].dataType.simpleString()}" for c in [*cols, *y])
    ready = stable(data.mapInArrow(coded, f"{kinds}, _f int, _codes binary, _labels binary, _row long"))
    counts = np.zeros((len(labels), len(names), growth.classes), np.int64)
    per = [F.count_if(F.col(c) == float(k)).alias(f"{c}_{k}") for c in y for k in range(growth.classes)]
    rows = 0
    for r in ready.groupBy("_f").agg(F.count(F.lit(1)).alias("n"), *per).collect():
        rows += r.n
        counts[:, r["_f"]] = np.array(list(r)[2:]).reshape(len(labels), growth.classes)
    models, status = [], {}
    for t in range(len(labels)):
        for k in range(len(names)):
            left = counts[t].sum(0) - counts[t, k]
            seen = np.flatnonzero(left)
            status[t, k] = int(seen[0]) if len(seen) == 1 else (-1 if not len(seen) else -2)
            if len(seen) > 1:
                w = np.where(left > 0, left.sum() / (len(seen) * np.maximum(left, 1)), 0.0) if balanced else np.ones(growth.classes)
                models.append(Model(t, k, tuple(float(v) for v in w), t * MAX_FOLDS + k))
    train = ready.select("_f", "_codes", "_labels", "_row")
    if growth.boosted:
        # rows of a fold with equal bins and labels bear one score: they are one row, and ``_row`` says how many they are
        train = stable(train.groupBy("_f", "_codes", "_labels").agg(F.count(F.lit(1)).alias("_row")))
        rows = train.count()
    trees = (in_tasks if rows <= small else grown)(train, models, growth, len(features))
    name = {(m.target, m.out): (labels[m.target], names[m.out]) for m in models}
    if isinstance(trees, Bagged):
        by = Bagged({name[m.target, m.out]: m for m in models}, trees.sums, trees.shares, trees.grow)
        return stable(averaged(ready, cols, y, labels, trees.sums, status, growth)), by
    by = {(m.target, m.out): trees[m.number] for m in models}
    return stable(scored(ready, cols, y, labels, by, status, growth, len(features))), {name[k]: v for k, v in by.items()}


class Bagged(Mapping):
    """Bagged trees by model, grown again when asked for: what fits in no driver is held as ``sums`` of the held-out
    rows (``_f``, ``_codes``, target, part, sums over its trees) and ``shares`` (per model number: a tree's gains and splits by feature)."""

    def __init__(self, models: dict, sums: DataFrame, shares: dict[int, list[np.ndarray]], grow: Callable[[Model], list[tuple]]) -> None:
        self.models, self.sums, self.shares, self.grow = models, sums, shares, grow

    def __getitem__(self, key) -> list[tuple]:
        return self.grow(self.models[key])

    def __iter__(self) -> Iterator:
        return iter(self.models)

    def __len__(self) -> int:
        return len(self.models)


def used(tree: tuple[np.ndarray, ...], features: int) -> np.ndarray:
    """Gains and numbers of the splits of a tree by feature."""
    inner = tree[0] >= 0
    return np.stack([np.bincount(tree[0][inner], w, features) for w in (tree[5][inner], None)])


def in_memory(data: DataFrame, features: int) -> tuple[np.ndarray, ...]:
    """(fold, codes, labels, row) of all rows; they come as a few packed cells."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fold, codes, labels, row, _ = rows_of(batch, features, 0)
                cells = (fold.astype(np.int32), codes, labels, row.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["f", "c", "l", "r"])

    parts = data.select("_f", "_codes", "_labels", "_row").mapInArrow(pack, "f binary, c binary, l binary, r binary").toArrow()
    fold, codes, labels, row = (np.frombuffer(b"".join(parts.column(c).to_pylist()), t) for c, t in (("f", np.int32), ("c", np.uint8), ("l", np.int8), ("r", np.int64)))
    return fold, codes.reshape(len(fold), features), labels.reshape(len(fold), -1 if len(fold) else 1), row


def in_tasks(data: DataFrame, models: Sequence[Model], growth: Growth, features: int) -> Mapping[int, list[tuple]]:
    """``SMALL_ROWS`` rows at most go to every task; each grows models of its own."""
    spark = data.sparkSession
    if not models or not growth.trees:
        return {m.number: [] for m in models}
    sent = spark.sparkContext.broadcast(in_memory(data, features))

    # bagged trees do not need each other, so a model is cut into tasks
    length = growth.trees if growth.boosted else TREES_AT_ONCE

    def units_of(some: Sequence[Model]) -> list[tuple[Model, range]]:
        return [(m, range(t, min(t + length, growth.trees))) for m in some for t in range(0, growth.trees, length)]

    def over(units: list, work: Callable, schema: str) -> DataFrame:
        return spark.range(0, len(units), 1, len(units)).select(F.col("id").alias("i")).mapInArrow(work, schema)

    def grow(some: Sequence[Model]) -> dict[int, list[tuple]]:
        units = units_of(some)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f, c, lab, r = sent.value
            for b in batches:
                for i in b.column("i").to_pylist():
                    m, part = units[i]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i]), pa.array([pickle.dumps(list(trained(m, c, f, lab, r, growth, part)))], pa.binary())], ["unit", "trees"])

        got = {r.unit: pickle.loads(r.trees) for r in over(units, work, "unit long, trees binary").collect()}
        out: dict[int, list[tuple]] = {m.number: [] for m in some}
        for i, (m, _) in enumerate(units):
            out[m.number] += got[i]
        return out

    if growth.boosted:
        out = grow(models)
        sent.unpersist()
        return out
    units = units_of(models)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, c, lab, r = sent.value
        for b in batches:
            for i in b.column("i").to_pylist():
                m, part = units[i]
                held = np.unique(c[f == m.out], axis=0)
                total, shares = np.zeros((len(held), growth.classes)), []
                for tree in trained(m, c, f, lab, r, growth, part):
                    total += tree[4][walk(tree, held)]
                    shares.append(used(tree, features))
                n = len(held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n + 1, i)), pa.array([m.out] * n + [None], pa.int32()), pa.array([x.tobytes() for x in held] + [None], pa.binary()),
                     pa.array(np.full(n + 1, m.target, np.int32)), pa.array([x.tobytes() for x in total] + [np.stack(shares).tobytes()], pa.binary())],
                    ["part", "_f", "_codes", "_t", "sums"])

    found = stable(over(units, sums, "part long, _f int, _codes binary, _t int, sums binary"))
    shares: dict[int, list[np.ndarray]] = {m.number: [] for m in models}
    for row in found.filter("_codes IS NULL").orderBy("part").collect():
        shares[units[row.part][0].number] += list(np.frombuffer(row.sums).reshape(-1, 2, features))
    return Bagged({m.number: m for m in models}, found.filter("_codes IS NOT NULL"), shares, lambda m: grow([m])[m.number])


def averaged(ready: DataFrame, cols: list[str], y: list[str], labels: Sequence[str], sums: DataFrame, status: dict, growth: Growth) -> DataFrame:
    """Rows scored by the sums that the tasks gave out for their fold and bins, parts added in order."""
    names = list(labels)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("_t"), F.col(c).alias("_label")) for t, c in enumerate(y)]))
    rows = ready.select(*cols, "_f", "_codes", each.alias("_e")).select(*cols, "_f", "_codes", "_e.*")
    parts = sums.groupBy("_f", "_codes", "_t").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "sums"))), lambda x: x["sums"]).alias("_parts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, target = batch.column("_f").to_pylist(), batch.column("_t").to_pylist()
            p, state = np.full((batch.num_rows, growth.classes), np.nan), []
            for i, (k, t, found) in enumerate(zip(fold, target, batch.column("_parts").to_pylist(), strict=True)):
                state.append("fitted" if status[t, k] == -2 else "one_class")
                if status[t, k] == -2:
                    p[i] = np.sum([np.frombuffer(x) for x in found], axis=0) / growth.trees
                elif status[t, k] >= 0:
                    p[i] = np.eye(growth.classes)[status[t, k]]
            empty = np.isnan(p[:, 0])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in cols], pa.array([names[t] for t in target], pa.string()), batch.column("_label"),
                 pa.array(np.where(empty, 0, np.nan_to_num(p).argmax(1)).astype(float), mask=empty),
                 pa.array([None if z else v for v, z in zip(p.tolist(), empty, strict=True)], pa.list_(pa.float64())), pa.array(state, pa.string())],
                [*cols, "target", "_label", "prediction", "probability", "fold_status"])

    kinds = ", ".join(f"`{c}` {ready.schema[c].dataType.simpleString()}" for c in cols)
    return rows.join(parts, ["_f", "_codes", "_t"], "left").mapInArrow(
        work, f"{kinds}, target string, _label double, prediction double, probability array<double>, fold_status string")


def scored(ready: DataFrame, cols: list[str], y: list[str], labels: Sequence[str], by: dict, status: dict, growth: Growth, features: int) -> DataFrame:
    sent = ready.sparkSession.sparkContext.broadcast(by)
    names = list(labels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, codes, *_ = rows_of(batch, features, 0)
            n = len(fold)
            for t, name in enumerate(names):
                p = np.full((n, growth.classes), np.nan)
                for k in np.unique(fold):
                    mine = np.flatnonzero(fold == k)
                    if status[t, k] == -2:
                        each = [tree[4][walk(tree, codes[mine])] for tree in sent.value[t, k]]
                        total = np.sum(each, axis=0)
                        if growth.boosted:
                            q = 1 / (1 + np.exp(-total[:, 0]))
                            p[mine] = np.stack([1 - q, q], 1)
                        else:
                            p[mine] = total / len(each)
                    elif status[t, k] >= 0:
                        p[mine] = np.eye(growth.classes)[status[t, k]]
                empty = np.isnan(p[:, 0])
                state = np.array(["fitted" if status[t, k] == -2 else "one_class" for k in fold], object)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in cols], pa.array([name] * n), batch.column(y[t]),
                     pa.array(np.where(empty, 0, np.nan_to_num(p).argmax(1)).astype(float), mask=empty),
                     pa.array([None if z else v for v, z in zip(p.tolist(), empty, strict=True)], pa.list_(pa.float64())), pa.array(state, pa.string())],
                    [*cols, "target", "_label", "prediction", "probability", "fold_status"])

    kinds = ", ".join(f"`{c}` {ready.schema[c].dataType.simpleString()}" for c in cols)
    return ready.mapInArrow(work, f"{kinds}, target string, _label double, prediction double, probability array<double>, fold_status string")


def importances(spark, trees: Mapping[tuple, list[tuple]], features: Sequence[str], groups: dict[str, Sequence[str]] | None = None, by_gain: bool = True) -> DataFrame:
    """(feature, mean, sd) over folds: a feature's share of the gain of each tree, or of its splits; with ``groups``, of their sums."""
    rows = []
    bagged = isinstance(trees, Bagged)
    for label, fold in trees:
        of_trees = trees.shares[trees.models[label, fold].number] if bagged else [used(t, len(features)) for t in trees[label, fold]]
        each = [u[0] if by_gain else u[1] for u in of_trees]
        shares = [u / u.sum() for u in each if u.sum() > 0]
        named = dict(zip(features, np.mean(shares, axis=0) if shares else np.zeros(len(features)), strict=True))
        for name, members in (groups or {f: [f] for f in features}).items():
            rows.append((str(fold), name, float(sum(named[f] for f in members))))
    df = spark.createDataFrame(rows, "fold string, feature string, share double")
    return df.groupBy("feature").agg(F.avg("share").alias("mean"), F.stddev_samp("share").alias("sd"))
