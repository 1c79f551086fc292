"""Fixed-length curves as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill_both_ways(values: Column, first: Column | None = None) -> Column:
    """Forward fill; leading nulls take ``first`` (default: first non-null)."""
    blank = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("out"))
    if first is None:
        first = F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))
    forward = F.aggregate(
        values, blank,
        lambda acc, x: F.struct(
            F.coalesce(x, acc["last"]).alias("last"),
            F.array_append(acc["out"], F.coalesce(x, acc["last"], first)).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    # arrays without nulls, nearly all of them, skip the fold
    return F.when(F.exists(values, lambda x: x.isNull()), forward).otherwise(values)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` (a lambda binds it)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grid_position(i: Column, n: Column, points: int) -> Column:
    return i.cast("double") * (n - 1) / F.lit(float(points - 1))


def resample(values: Column, points: int) -> Column:
    """Linear interpolation to ``points`` values over the whole length."""
    grid = F.sequence(F.lit(0), F.lit(points - 1))
    empty = F.array_repeat(F.lit(None).cast("double"), points)

    def interpolate(filled: Column) -> Column:
        n = F.size(filled)

        def at(i: Column) -> Column:
            x = _grid_position(i, n, points)
            lo = F.least(F.floor(x).cast("int"), n - 1)
            a, b = F.get(filled, lo), F.get(filled, F.least(lo + 1, n - 1))
            return a + (b - a) * (x - lo)

        return F.when(n == 0, empty).when(n == points, filled).otherwise(F.transform(grid, at))

    return let(fill_both_ways(values), interpolate)


def needed_offsets(n: Column, points: int) -> Column:
    """Offsets a resampling reads: the two neighbours of every grid point."""
    pair = F.sequence(F.lit(0), F.lit(2 * points - 1))

    def offset(j: Column) -> Column:
        lo = F.floor(_grid_position(F.floor(j / 2), n, points)).cast("long")
        return F.least(lo + j % 2, n - 1)

    return F.transform(pair, offset)


def resample_pairs(needed: Column, first: Column, n: Column, points: int) -> Column:
    """``resample`` from the values at ``needed_offsets`` alone."""
    def interpolate(filled: Column) -> Column:
        def at(i: Column) -> Column:
            x = _grid_position(i, n, points)
            a, b = F.get(filled, 2 * i), F.get(filled, 2 * i + 1)
            return a + (b - a) * (x - F.floor(x))

        return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)

    return let(fill_both_ways(needed, first), interpolate)


def minus(values: Column, base: Column) -> Column:
    return F.transform(values, lambda x: x - base)


def has_null(values: Column) -> Column:
    return F.exists(values, lambda x: x.isNull())
