"""Replicates: bootstraps and subsamples whose cost does not grow with copies of the rows.

Draws are functions of (replicate, key), so a lost task repeats them.  What a
replicate needs is drawn directly: of a median the places of its middle rows,
of an owner bootstrap the owners' moments, of a subsample the first few rows by
hash, which the window's limit keeps small before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightspark.operators.ordering import order_rows, stable
from nightspark.operators.ranks import exact_percentiles, rank_table, with_scalars
from nightspark.operators.trees import seeded
from nightspark.operators.workers import visible

#: Percentiles of a replicate distribution.
INTERVAL = {"p025": 0.025, "median": 0.5, "p975": 0.975}


def hash_unit(*parts: Column) -> Column:
    """A repeatable draw in [0, 1) from the md5 of its parts."""
    text = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def median_places(n: int, replicates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """0-based places, among n sorted rows, of the two middle rows of bootstrap samples of n rows.

    The k-th of n sorted uniform draws is a beta draw; the next one is the least
    of the n - k draws that are left above it.  A sample's row is the place that
    its draw falls on.
    """
    rng = np.random.default_rng(seed)
    k = (n + 1) // 2
    low = rng.beta(k, n - k + 1, replicates)
    high = low if n % 2 else low + (1 - low) * (1 - (1 - rng.random(replicates)) ** (1 / (n - k)))
    return tuple(np.minimum((u * n).astype(np.int64), n - 1) for u in (low, high))


def bootstrap_median(df: DataFrame, group: str, value: str, replicates: int, cell: int = 1024, seed: int = 42) -> DataFrame:
    """2.5, 50 and 97.5 percentiles of the bootstrap median per group.

    Two places a replicate are looked up in the table of distinct values by
    (group, cell of places), so neither rows nor replicates of rows are built.
    Null groups are a group; null values are left out.
    """
    visible(df.sparkSession)
    table = stable(rank_table(df, [group], value))
    sizes = table.groupBy(group).agg(F.max("total").alias("n")).withColumn("_seed", F.xxhash64(F.col(group).cast("string")))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = median_places(batch.column(1)[k].as_py(), replicates, seeded(seed, batch.column(2)[k].as_py()))
                rows = pa.array(np.full(2 * replicates, k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), pa.array(np.tile(np.arange(replicates), 2)), pa.array(np.concatenate([a, b]))], ["_g", "rep", "_place"])

    kind = df.schema[group].dataType.simpleString()
    asked = sizes.select(group, "n", "_seed").mapInArrow(draw, f"_g {kind}, rep long, _place long").withColumn("_cell", F.floor(F.col("_place") / cell))
    lo, hi = F.floor(F.col("below") / cell), F.floor((F.col("below") + F.col("n") - 1) / cell)
    held = table.withColumn("_c", F.explode(F.sequence(lo, hi)))
    inside = (F.col("_place") >= F.col("below")) & (F.col("_place") < F.col("below") + F.col("n"))
    met = asked.join(held, F.col("_g").eqNullSafe(F.col(group)) & (F.col("_cell") == F.col("_c")) & inside)
    med = met.groupBy(group, "rep").agg(F.avg(value).alias("med"))
    return exact_percentiles(med, [group], ["med"], {"lo": 0.025, "mid": 0.5, "hi": 0.975})


def interval(replicates: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, p025, median, p975) of columns of replicates; nulls are left out."""
    wide = exact_percentiles(replicates, [], metrics, INTERVAL)
    parts = [F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}_{p}").alias(p) for p in INTERVAL]) for m in metrics]
    return wide.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def bootstrap_icc_cv(df: DataFrame, owner: str, value: str, replicates: int) -> DataFrame:
    """Per replicate: ICC(1,1), ICC(1,k), mean and median coefficient of variation of owners drawn with replacement.

    An owner that is drawn twice counts as two.  Which owner a slot gets is a
    hash of (replicate, slot); only the owners' moments are used, so the rows
    are read once.
    """
    g = df.filter(F.col(value).isNotNull()).groupBy(owner).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"),
        (F.when(F.count(value) > 1, F.stddev_samp(value)) / F.nullif(F.avg(value), F.lit(0.0))).alias("_cv"))
    g = stable(order_rows(g.withColumn("_all", F.lit(0)), ["_all"], [owner], out="_i"))
    size = g.agg(F.count(F.lit(1)).alias("_k"))
    slots = with_scalars(g.select(F.col("_i").alias("_slot")), size).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    slots = slots.withColumn("_i", F.floor(hash_unit(F.col("rep"), F.col("_slot")) * F.col("_k")).cast("long"))
    drawn = stable(slots.select("rep", "_slot", "_i").join(g.select("_i", "_n", "_m", "_v", "_cv"), "_i"))
    n, k = F.sum("_n"), F.count(F.lit(1))
    grand = F.sum(F.col("_n") * F.col("_m")) / n
    a = drawn.groupBy("rep").agg(
        ((F.sum(F.col("_n") * F.col("_m") * F.col("_m")) - n * grand * grand) / F.nullif(k - 1, F.lit(0))).alias("_b"),
        (F.sum(F.col("_n") * F.col("_v")) / F.nullif(n - k, F.lit(0))).alias("_w"), (n / k).alias("_km"), F.avg("_cv").alias("cv_mean"))
    b, w = F.col("_b"), F.col("_w")
    out = a.select("rep", ((b - w) / F.nullif(b + (F.col("_km") - 1) * w, F.lit(0.0))).alias("icc_1_1"), ((b - w) / F.nullif(b, F.lit(0.0))).alias("icc_1_k"), "cv_mean")
    mid = exact_percentiles(drawn, ["rep"], ["_cv"], {"p50": 0.5}).withColumnRenamed("_cv_p50", "cv_median")
    return out.join(mid, "rep")


def severity_class(x: Column, limits: Sequence[float]) -> Column:
    out = F.lit(len(limits))
    for i in reversed(range(len(limits))):
        out = F.when(x < limits[i], i).otherwise(out)
    return F.when(x.isNotNull(), out)


def stabilization_curve(
    df: DataFrame, owner: str, night: str, value: str, ks: Sequence[int], replicates: int, min_nights: int,
    limits: Sequence[float] = (5.0, 15.0, 30.0),
) -> DataFrame:
    """Error of the mean of k random nights against the owner's full mean, over owners with enough nights.

    Per k: median and 2.5 / 97.5 percentiles over replicates of the mean
    absolute error, of the correlation and of the agreement of classes, the
    median root mean square error, and the owners.  Nights are drawn without
    replacement in the order of a hash; a replicate keeps the first max(k) of
    each owner, which the ranking limit already does before the shuffle.
    """
    rows = df.filter(F.col(value).isNotNull()).select(owner, night, F.col(value).cast("double").alias(value))
    full = rows.groupBy(owner).agg(F.avg(value).alias("_ref"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_nights)
    base = stable(rows.join(full, owner, "left_semi"))
    draws = base.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draws = draws.withColumn("_h", F.md5(F.concat_ws("|", F.col("rep").cast("string"), F.col(night))))
    order = Window.partitionBy(owner, "rep").orderBy("_h", night)
    picked = draws.withColumn("_pick", F.row_number().over(order)).filter(F.col("_pick") <= max(ks))
    per_k = picked.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).filter(F.col("_pick") <= F.col("k"))
    mean = per_k.groupBy(owner, "rep", "k").agg(F.avg(value).alias("_p"), F.count(F.lit(1)).alias("_got")).filter(F.col("_got") == F.col("k"))
    pred = mean.join(full.select(owner, "_ref"), owner)
    err = F.col("_p") - F.col("_ref")
    same = severity_class(F.col("_p"), limits) == severity_class(F.col("_ref"), limits)
    by_rep = stable(pred.groupBy("k", "rep").agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.corr("_p", "_ref").alias("corr"),
        F.avg(same.cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n_patients")))
    by_rep = by_rep.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))
    wide = exact_percentiles(by_rep, ["k"], ["mae", "rmse", "corr", "agreement", "n_patients"], INTERVAL)
    keep = [f"{m}_{p}" for m in ("mae", "corr", "agreement") for p in ("median", "p025", "p975")]
    return wide.select(F.col("k").cast("long").alias("k"), *keep, "rmse_median", F.col("n_patients_median").alias("n_patients"))


def simulated_agreement(df: DataFrame, owner: str, night: str, value: str, draws: int = 200, min_nights: int = 3) -> DataFrame:
    """One random night against its owner's mean, ``draws`` times per owner: bias, sd and 95 % limits.

    Nights are numbered inside their owner; a draw is a number by hash, met on
    (owner, number).
    """
    rows = df.filter(F.col(value).isNotNull()).select(owner, night, value)
    numbered = stable(order_rows(rows, [owner], [night], out="_i"))
    full = numbered.groupBy(owner).agg(F.avg(value).alias("_mean"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_nights)
    asked = full.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn(
        "_i", F.floor(hash_unit(F.col("rep"), F.col(owner)) * F.col("_n")).cast("long"))
    gap = asked.join(numbered.select(owner, "_i", value), [owner, "_i"]).select((F.col(value) - F.col("_mean")).alias("_d"))
    out = gap.agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("bias"), F.stddev_samp("_d").alias("sd"))
    return out.withColumns({"loa_low": F.col("bias") - 1.96 * F.col("sd"), "loa_high": F.col("bias") + 1.96 * F.col("sd")})
