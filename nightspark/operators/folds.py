"""Leave-one-owner-out logistic models of all folds in the same scans.

Each scan evaluates every row under the coefficients of all folds but its own
and sums gradient and curvature per fold, so the number of scans is that of
Newton's steps and does not grow with the owners.  Sums are taken over raw
columns beside marks of missing values; what a fold fills in and how it scales
are linear in them and are applied to the sums.  Medians, moments and class
sizes of a training set are those of all rows minus the owner's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightspark.operators.ordering import stable
from nightspark.operators.ranks import rank_table
from nightspark.operators.workers import PARTIAL, numbers, partial, summed, visible

#: Folds of one fit: their coefficients are held by the driver and by every task.
MAX_FOLDS = 10_000
#: Numbers of a block of rows times folds in a task.
BLOCK = 1 << 21


@dataclass(frozen=True)
class FoldModels:
    """One model per fold, and last the one over all rows."""

    names: list
    features: tuple[str, ...]
    median: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    coef: np.ndarray  # intercept first, of standardised features
    only_class: np.ndarray  # class of a training set that has one alone, -1 if it has none, else -2

    def lines(self, shift: np.ndarray) -> np.ndarray:
        """Coefficients of (1, x - shift or 0, missing) per model."""
        return np.einsum("fi,fiu->fu", self.coef, reparameterised(self.median, self.mean, self.std, shift))


def reparameterised(median: np.ndarray, mean: np.ndarray, std: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Per fold the matrix that turns (1, x - shift or 0, missing) into (1, standardised filled features)."""
    folds, d = mean.shape
    out = np.zeros((folds, d + 1, 2 * d + 1))
    out[:, 0, 0] = 1
    i = np.arange(d)
    out[:, i + 1, 0] = (shift - mean) / std
    out[:, i + 1, i + 1] = 1 / std
    out[:, i + 1, i + 1 + d] = (median - shift) / std
    return out


def leave_out_medians(data: DataFrame, features: Sequence[str], folds: int, fold: str = "_f") -> np.ndarray:
    """Median of each feature over the rows of all other folds, in a row per fold; the last row is of all rows.

    A fold's count below a value is the total count minus its own, so between
    two of its own values the wanted row is that of all rows a fixed number
    further on: its own distinct values tell how many.
    """
    visible(data.sparkSession)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("metric"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)]))
    hist = stable(data.select(fold, pairs.alias("p")).select(fold, "p.*").filter(F.col("value").isNotNull() & ~F.isnan("value"))
                  .groupBy("metric", fold, "value").agg(F.count(F.lit(1)).alias("k0")))
    total = stable(rank_table(hist, ["metric"], "value", {"k": F.col("k0")}))
    own = rank_table(hist, ["metric", fold], "value", {"k": F.col("k0")})
    sizes = np.zeros(len(features), np.int64)
    for r in total.groupBy("metric").agg(F.max("k_total").alias("n")).collect():
        sizes[r.metric] = r.n
    t = total.select(F.col("metric").alias("_m"), F.col("value").alias("_v"), F.col("k").alias("_k"), F.col("k_below").alias("_b"), F.col("k_total").alias("_n"))
    both = own.join(t, (F.col("metric") == F.col("_m")) & (F.col("value") == F.col("_v")))
    below, upto = F.col("_b") - F.col("k_below"), F.col("_b") + F.col("_k") - F.col("k_below") - F.col("k")
    left = F.col("_n") - F.col("k_total")
    ranks = {"lo": F.floor((left - 1) / 2), "hi": F.ceil((left - 1) / 2)}
    found = both.groupBy("metric", fold).agg(
        F.max(left).alias("left"),
        *[F.max(F.when(upto <= r, F.col("k_below") + F.col("k"))).alias(f"{n}_own") for n, r in ranks.items()],
        *[F.max(F.when((below <= r) & (r < upto), F.col("value"))).alias(f"{n}_value") for n, r in ranks.items()])
    value = np.full((2, folds + 1, len(features)), np.nan)
    rank = np.repeat(np.stack([(sizes - 1) // 2, sizes // 2])[:, None, :], folds + 1, axis=1)
    rank[:, :, sizes == 0] = -1
    # a row per fold and feature
    for r in found.collect():
        at = (r[fold], r.metric)
        for side, (own_rows, v) in enumerate(((r.lo_own, r.lo_value), (r.hi_own, r.hi_value))):
            if r.left <= 0:
                rank[side][at] = -1
            elif v is not None:
                value[side][at], rank[side][at] = v, -1
            else:
                rank[side][at] = (r.left - 1 + side) // 2 + (own_rows or 0)
    wanted = {m: np.unique(rank[:, :, m][rank[:, :, m] >= 0]) for m in range(len(features))}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            metric, lo = batch.column("metric").to_numpy(), batch.column("k_below").to_numpy()
            hi = lo + batch.column("k").to_numpy()
            for m in np.unique(metric):
                mine = np.flatnonzero(metric == m)
                a, b = (np.searchsorted(wanted[m], x[mine]) for x in (lo, hi))
                many = b - a
                row = np.repeat(mine, many)
                at = np.repeat(a - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), m, np.int32)), pa.array(wanted[m][at]), batch.column("value").take(pa.array(row))], ["metric", "rank", "value"])

    for r in total.select("metric", "k_below", "k", "value").mapInArrow(look_up, "metric int, rank long, value double").collect():
        value[:, :, r.metric][rank[:, :, r.metric] == r.rank] = r.value
    return value.mean(axis=0)


def moments(data: DataFrame, features: Sequence[str], folds: int, shift: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per training set: rows per class (folds + 1, 2), then rows, sums and sums of squares of present shifted values."""
    aggs = [F.count_if(F.col("_label") == c).alias(f"c{c}") for c in (0, 1)]
    for i, f in enumerate(features):
        x = F.when(~F.isnan(f), F.col(f) - float(shift[i]))
        aggs += [F.count(x).alias(f"n{i}"), F.coalesce(F.sum(x), F.lit(0.0)).alias(f"s{i}"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias(f"q{i}")]
    d = len(features)
    own = np.zeros((folds + 1, 2 + 3 * d))
    for r in data.groupBy("_f").agg(*aggs).collect():
        own[r["_f"]] = list(r)[1:]
    left = own.sum(0) - own
    return left[:, :2], left[:, 2::3], left[:, 3::3], left[:, 4::3]


def fit_folds(data: DataFrame, features: Sequence[str], names: list, c: float = 1.0, steps: int = 60, tolerance: float = 1e-9) -> FoldModels:
    """Balanced L2 logistic regressions (penalty 1 / (2 c) on standardised coefficients), one per left-out fold.

    ``data`` has ``_f`` (0 .. folds - 1), ``_label`` (0, 1) and double
    ``features``.  Missing values are filled by the training median; features
    are scaled by mean and population deviation of the filled training rows.
    """
    visible(data.sparkSession)
    folds, d = len(names), len(features)
    columns = list(features)
    means = data.agg(*[F.coalesce(F.avg(F.when(~F.isnan(f), F.col(f))), F.lit(0.0)) for f in features]).first()
    shift = np.array(list(means), float)
    classes, present, total, squares = moments(data, features, folds, shift)
    n = classes.sum(1)
    median = np.nan_to_num(leave_out_medians(data, features, folds), nan=0.0)
    absent = n[:, None] - present
    safe = np.maximum(n, 1)[:, None]
    gap = median - shift
    offset = (total + absent * gap) / safe
    variance = np.maximum((squares + absent * gap**2) / safe - offset**2, 0.0)
    std = np.sqrt(variance)
    std[std < 1e-12] = 1.0
    mean = shift + offset
    only = np.where(n == 0, -1, np.where(classes[:, 0] == 0, 1, np.where(classes[:, 1] == 0, 0, -2)))
    weight = n[:, None] / (2 * np.maximum(classes, 1))
    to_z = reparameterised(median, mean, std, shift)
    wide = 2 * d + 1
    a, b = np.triu_indices(wide)

    def sums(lines: np.ndarray):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((folds + 1, 1 + wide + len(a)))
            for batch in batches:
                x, y = numbers(batch, columns), batch.column("_label").to_numpy().astype(int)
                own = batch.column("_f").to_numpy()
                for lo in range(0, len(y), max(1, BLOCK // (folds + 1))):
                    s = slice(lo, lo + max(1, BLOCK // (folds + 1)))
                    missing = np.isnan(x[s])
                    u = np.concatenate([np.ones((len(missing), 1)), np.where(missing, 0.0, x[s] - shift), missing], axis=1)
                    eta = u @ lines.T
                    w = weight.T[y[s]]
                    w[np.arange(len(w)), own[s]] = 0.0
                    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                    out[:, 0] += (w * (np.logaddexp(0, eta) - y[s][:, None] * eta)).sum(0)
                    out[:, 1 : 1 + wide] += (w * (p - y[s][:, None])).T @ u
                    out[:, 1 + wide :] += (w * p * (1 - p)).T @ (u[:, a] * u[:, b])
            yield partial(out)

        return summed(data.select("_f", "_label", *columns).mapInArrow(work, PARTIAL), folds + 1, 1 + wide + len(a))

    penalty = np.concatenate([[0.0], np.full(d, 1 / c)])
    coef = np.zeros((folds + 1, d + 1))
    good, loss = coef.copy(), np.full(folds + 1, np.inf)
    step = np.zeros_like(coef)
    todo = only == -2
    for _ in range(steps):
        out = sums(np.einsum("fi,fiu->fu", coef, to_z))
        now = out[:, 0] + 0.5 * (penalty * coef**2).sum(1)
        worse = todo & ~(now <= loss + 1e-9 * np.abs(loss))
        worse &= np.isfinite(loss)
        grad = np.einsum("fiu,fu->fi", to_z, out[:, 1 : 1 + wide]) + penalty * coef
        square = np.zeros((folds + 1, wide, wide))
        square[:, a, b] = out[:, 1 + wide :]
        square[:, b, a] = out[:, 1 + wide :]
        curve = to_z @ square @ to_z.transpose(0, 2, 1) + np.diag(penalty) + 1e-12 * np.eye(d + 1)
        better = todo & ~worse
        good[better], loss[better] = coef[better], now[better]
        step[better] = -np.linalg.solve(curve[better], grad[better][..., None])[..., 0]
        step[worse] /= 2
        todo &= np.abs(step).max(1) > tolerance
        if not todo.any():
            # the last step is below the tolerance: it is taken without another scan
            coef = good + step
            break
        coef = good + step
    return FoldModels(list(names), tuple(features), median, mean, std, coef, only)


def out_of_fold(
    df: DataFrame, features: Sequence[str], label: str, owner: str, keep: Sequence[str], folds: int | None = None, c: float = 1.0,
) -> tuple[DataFrame, FoldModels]:
    """Every row scored by the model that never saw its owner; the models.

    Gives ``keep``, the owner, ``_label``, ``prediction``, ``probability`` (two
    classes) and ``fold_status``: "fitted", or "one_class" where the other
    folds hold one class: its rows then get that class.  Rows without a label
    train nothing and are scored; rows without an owner are left out.
    ``folds`` groups owners; more than ``MAX_FOLDS`` models are refused.
    """
    visible(df.sparkSession)
    cols = list(dict.fromkeys([*keep, owner]))
    group = F.pmod(F.xxhash64(owner), F.lit(folds)) if folds else F.col(owner)
    data = df.filter(F.col(owner).isNotNull()).select(*cols, group.alias("_fold"), F.col(label).cast("double").alias("_label"),
                                                      *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    names = [r[0] for r in data.select("_fold").distinct().limit(MAX_FOLDS + 1).collect()]
    if len(names) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} owners: give the number of folds")
    names.sort()
    x = [f"_x{i}" for i in range(len(features))]
    numbered = df.sparkSession.createDataFrame(list(enumerate(names)), f"_f int, _name {data.schema['_fold'].dataType.simpleString()}")
    data = stable(data.join(numbered, F.col("_fold") == F.col("_name")).drop("_name", "_fold"))
    known = data.filter(F.col("_label").isin(0.0, 1.0))
    models = fit_folds(known.select("_f", "_label", *x), x, names, c)
    models = FoldModels(names, tuple(features), models.median, models.mean, models.std, models.coef, models.only_class)
    shift = models.mean.mean(0)
    lines, only = models.lines(shift), models.only_class

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, f = numbers(batch, x), batch.column("_f").to_numpy()
            missing = np.isnan(v)
            eta = lines[f, 0] + (np.where(missing, 0.0, v - shift) * lines[f, 1 : 1 + len(x)]).sum(1) + (missing * lines[f, 1 + len(x) :]).sum(1)
            p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
            p = np.where(only[f] >= 0, only[f], p)
            nothing = only[f] == -1
            kept = [batch.column(k) for k in range(len(cols) + 1)]
            both = pa.array([None if z else [1 - q, q] for q, z in zip(p, nothing, strict=True)], pa.list_(pa.float64()))
            guess = pa.array((p > 0.5).astype(float), mask=nothing)
            status = pa.array(np.where(only[f] == -2, "fitted", "one_class"))
            yield pa.RecordBatch.from_arrays([*kept, guess, both, status], [*cols, "_label", "prediction", "probability", "fold_status"])

    kinds = ", ".join(f"`{k}` {data.schema[k].dataType.simpleString()}" for k in [*cols, "_label"])
    scored = data.select(*cols, "_label", "_f", *x).mapInArrow(score, f"{kinds}, prediction double, probability array<double>, fold_status string")
    return stable(scored), models


def coefficients(spark, models: FoldModels) -> DataFrame:
    """(fold, feature, coefficient) of standardised features; fold null is the model over all rows."""
    rows = [(None if k == len(models.names) else str(models.names[k]), f, float(v))
            for k in range(len(models.names) + 1) if models.only_class[k] == -2
            for f, v in zip(("intercept", *models.features), models.coef[k], strict=True)]
    return spark.createDataFrame(rows, "fold string, feature string, coefficient double")
