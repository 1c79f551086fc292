"""Exact ranks and percentiles that hold for hot groups.

Values are first collapsed to one row per (group, distinct value), so ties
cost nothing.  The size of the largest group of distinct values is then
measured: small groups go through one window or one ``percentile`` per group;
beyond the limit the distinct values are numbered with ``order_rows`` and their
counts scanned with ``running``, so no group is ever sorted in one task.  Both
ways give the same exact result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightspark.config import Layout
from nightspark.operators.ordering import order_rows, stable
from nightspark.operators.scans import framed, running, with_constants

SMALL_GROUP = 200_000  # distinct values of one group that fit easily in a task


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table as scalar-subquery values."""
    cols = one_row.columns
    packed = one_row.select(F.struct(*cols).alias("_one")).scalar()
    return df.withColumn("_one", packed).select(*df.columns, *[F.col(f"_one.{c}").alias(c) for c in cols])


def _histogram(df: DataFrame, groups: Sequence[str], value: str, measures: dict[str, Column]) -> DataFrame:
    return stable(
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(*[F.sum(m).alias(name) for name, m in measures.items()])
        .withColumn("_group", F.to_json(F.struct(*groups)) if groups else F.lit(""))
    )


def _largest(hist: DataFrame) -> int:
    sizes = hist.groupBy("_group").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def rank_table(
    df: DataFrame, groups: Sequence[str], value: str, measures: dict[str, Column] | None = None,
    descending: bool = False, chunk_rows: int = 65536, small: int = SMALL_GROUP,
) -> DataFrame:
    """One row per (group, distinct non-null value) with running counts.

    ``n`` rows hold the value, ``below`` rows sort before it, ``total`` rows
    are in the group; each extra measure ``m`` (a summable column) gives
    ``m``, ``m_below`` and ``m_total``.
    """
    measures = {"n": F.lit(1), **(measures or {})}
    hist = _histogram(df, groups, value, measures)
    order = F.col(value).desc() if descending else F.col(value).asc()
    if _largest(hist) <= small:
        upto = Window.partitionBy("_group").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy("_group")
        out = hist.withColumns({
            **{f"_upto_{m}": F.sum(m).over(upto) for m in measures}, **{f"_all_{m}": F.sum(m).over(whole) for m in measures}})
    else:
        numbered = order_rows(hist, ["_group"], [order], out="_rank_seq")
        layout = Layout(key="_group", seq="_rank_seq", chunk_rows=chunk_rows)
        scanned = running(numbered, layout, {f"_upto_{m}": ("sum", F.col(m)) for m in measures})
        totals = numbered.groupBy("_group").agg(*[F.sum(m).alias(f"_all_{m}") for m in measures])
        out = scanned.join(totals, "_group")
    cols = [*[F.col(g) for g in groups], F.col(value)]
    for m in measures:
        prefix = "" if m == "n" else f"{m}_"
        cols += [F.col(m), (F.col(f"_upto_{m}") - F.col(m)).alias(f"{prefix}below"), F.col(f"_all_{m}").alias(f"{prefix}total")]
    return out.select(*cols)


def exact_percentiles(
    df: DataFrame, groups: Sequence[str], columns: Sequence[str], probs: dict[str, float], small: int = SMALL_GROUP,
) -> DataFrame:
    """Linear-interpolation percentiles, wide: ``{column}_{name}`` per prob.

    Null values are skipped; a group whose column is all null gets null.
    """
    groups = list(groups)
    keys = [f"_g_{g}" for g in groups]
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("_metric"), F.col(c).cast("double").alias("_value")) for c in columns])).alias("_p")
    # null values stay in as a zero count, so that every group keeps a row
    long = df.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], pairs).select(*keys, "_p.*")
    hist = stable(long.groupBy(*keys, "_metric", "_value").agg(F.count("_value").alias("n")).withColumn(
        "_group", F.to_json(F.struct(*keys, "_metric"))))
    names = [F.col(k).alias(g) for k, g in zip(keys, groups)]
    present = [f"{c}_{name}" for c in columns for name in probs]
    is_c = {c: F.col("_metric") == c for c in columns}
    if _largest(hist) <= small:
        aggs = [
            F.percentile(F.when(is_c[c], F.col("_value")), p, F.col("n")).alias(f"{c}_{name}")
            for c in columns for name, p in probs.items()]
        return hist.groupBy(*keys).agg(*aggs).select(*names, *present)
    table = rank_table(
        hist.filter(F.col("n") > 0).select(*keys, "_metric", "_value", F.col("n").alias("_k")),
        [*keys, "_metric"], "_value", {"k": F.col("_k")}, small=small)
    aggs = []
    for c in columns:
        for name, p in probs.items():
            pos = (F.col("k_total") - 1) * F.lit(float(p))
            lo, hi = F.floor(pos), F.ceil(pos)
            at = lambda i: F.max(F.when(
                is_c[c] & (F.col("k_below") <= i) & (i < F.col("k_below") + F.col("k")), F.col("_value")))
            frac = F.max(F.when(is_c[c], pos - lo))
            aggs.append((at(lo) + (at(hi) - at(lo)) * frac).alias(f"{c}_{name}"))
    out = table.groupBy(*keys).agg(*aggs)
    if not groups:
        return out.select(*present)
    base = hist.select(*[F.col(k).alias(f"_b{k}") for k in keys]).distinct()
    cond = [F.col(f"_b{k}").eqNullSafe(F.col(k)) for k in keys]
    return base.join(out, cond, "left").select(*[F.col(f"_b{k}").alias(g) for k, g in zip(keys, groups)], *present)


def average_rank(
    df: DataFrame, groups: Sequence[str], value: str, out: str, chunk_rows: int = 65536,
) -> DataFrame:
    """Add the 1-based average rank of ``value`` (null stays null).

    As long as no value is borne by more than ``chunk_rows`` rows of a group,
    rows meet the ranks of their value; beyond that, ranks are carried along
    the ordered rows in chunks, so that no value has a task of its own.
    """
    table = stable(rank_table(df, groups, value))
    if (table.agg(F.max("n")).first()[0] or 0) > chunk_rows:
        return carried_rank(df, groups, value, out, chunk_rows)
    ranks = table.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups], F.col(value).alias("_value"),
        (F.col("below") + (F.col("n") + 1) / 2.0).alias(out),
    )
    cond = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups] + [F.col(value) == F.col("_value")]
    return df.join(ranks, cond, "left").select(*df.columns, out)


def carried_rank(df: DataFrame, groups: Sequence[str], value: str, out: str, chunk_rows: int = 65536) -> DataFrame:
    """``average_rank`` from the order of the rows alone: first and last place of each row's tie run, carried in chunks."""
    names = df.columns
    group = F.to_json(F.struct(*groups)) if groups else F.lit("")
    rows = df.filter(F.col(value).isNotNull()).withColumns({"_group": group, "_tie": F.monotonically_increasing_id()})
    # equal values are spread over partitions by the tie-breaker
    placed = stable(order_rows(stable(rows), ["_group"], [value, "_tie"], out="_place"))
    layout = Layout(key="_group", seq="_place", chunk_rows=chunk_rows).sized(placed)
    marked = framed(placed, layout, before=1, after=0, exprs=lambda w: {
        "_starts": F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(True))})
    marked = stable(marked.withColumn("_start", F.when(F.col("_starts"), F.col("_place"))))
    first = running(marked, layout, {"_first": ("last", F.col("_start"))})
    both = running(first, layout, {"_next": ("last", F.col("_start"))}, reverse=True, inclusive=False)
    sizes = placed.groupBy("_group").agg(F.count(F.lit(1)).alias("_size"))
    last = F.coalesce(F.col("_next"), F.col("_size")) - 1
    ranked = with_constants(both, sizes, layout).select(*names, ((F.col("_first") + last) / 2.0 + 1).alias(out))
    return ranked.unionByName(df.filter(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double")))
