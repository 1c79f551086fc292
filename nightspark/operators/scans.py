"""Bounded frames, running scans and runs over densely numbered records.

All functions work on rows that carry a dense ``seq`` per record (see
``ordering.order_rows``) and partition by (record, chunk of ``seq``), never by
record alone.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from nightspark.config import Layout
from nightspark.operators.ordering import stable

Spec = tuple[str, Column]


def _div(col: Column, n: int) -> Column:
    return F.floor(col / F.lit(n)).cast("long")


def framed(
    df: DataFrame,
    layout: Layout,
    before: int,
    after: int,
    exprs: Callable[[WindowSpec], Mapping[str, Column]],
) -> DataFrame:
    """Evaluate window expressions that look at most ``before`` rows back and
    ``after`` rows ahead.

    Each row goes to its own chunk and, as context, to the neighbouring chunks
    whose rows can see it; context rows are dropped after evaluation.
    """
    seq = F.col(layout.seq)
    own = _div(seq, layout.chunk_rows)
    lo = F.greatest(_div(seq - after, layout.chunk_rows), F.lit(0).cast("long"))
    hi = _div(seq + before, layout.chunk_rows)
    spread = df.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(lo, hi)))
    window = Window.partitionBy(layout.key, "_chunk").orderBy(layout.seq)
    return (
        spread.withColumns(dict(exprs(window)))
        .filter(F.col("_chunk") == F.col("_own"))
        .drop("_own", "_chunk")
    )


def _local(kind: str, value: Column, window: WindowSpec) -> Column:
    if kind == "sum":
        return F.sum(value).over(window)
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    if kind == "max":
        return F.max(value).over(window)
    if kind == "min":
        return F.min(value).over(window)
    raise ValueError(f"unknown scan kind {kind!r}")


def _total(kind: str, value: Column, order: Column, reverse: bool) -> Column:
    if kind == "sum":
        return F.sum(value)
    if kind == "last":
        pick = F.min_by if reverse else F.max_by
        return pick(value, F.when(value.isNotNull(), order))
    return F.max(value) if kind == "max" else F.min(value)


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "last":
        return F.coalesce(local, carried)
    return F.greatest(carried, local) if kind == "max" else F.least(carried, local)


def _scan_level(
    df: DataFrame,
    key: str,
    index: str,
    sizes: list[int],
    specs: Mapping[str, Spec],
    reverse: bool,
    inclusive: bool,
) -> DataFrame:
    order = F.col(index).desc() if reverse else F.col(index).asc()
    last_row = 0 if inclusive else -1
    if not sizes:
        window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, last_row)
        return df.withColumns({
            name: _merge(kind, F.lit(None), _local(kind, value, window)) if kind == "sum"
            else _local(kind, value, window)
            for name, (kind, value) in specs.items()
        })
    cell = f"_{index}_cell"
    df = df.withColumn(cell, _div(F.col(index), sizes[0]))
    window = Window.partitionBy(key, cell).orderBy(order).rowsBetween(Window.unboundedPreceding, last_row)
    totals = df.groupBy(key, cell).agg(
        *[_total(kind, value, F.col(index), reverse).alias(name) for name, (kind, value) in specs.items()]
    )
    carried = _scan_level(
        totals, key, cell, sizes[1:],
        {f"_c_{name}": (kind, F.col(name)) for name, (kind, _) in specs.items()},
        reverse, inclusive=False,
    ).select(key, cell, *[f"_c_{name}" for name in specs])
    local = df.withColumns({f"_l_{name}": _local(kind, value, window) for name, (kind, value) in specs.items()})
    joined = local.join(carried, [key, cell], "left")
    return joined.withColumns(
        {name: _merge(kind, F.col(f"_c_{name}"), F.col(f"_l_{name}")) for name, (kind, _) in specs.items()}
    ).drop(cell, *[f"_c_{n}" for n in specs], *[f"_l_{n}" for n in specs])


def running(
    df: DataFrame,
    layout: Layout,
    specs: Mapping[str, Spec],
    reverse: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum`` / ``last`` non-null / ``max`` / ``min`` along a record.

    Up to three levels, as many as the longest record needs: rows inside a
    chunk, chunk totals inside a block, block totals inside the record.  ``reverse`` scans from the end (so ``last``
    becomes "next"), ``inclusive=False`` leaves out the current row.
    """
    return _scan_level(
        df, layout.key, layout.seq, layout.levels, specs, reverse, inclusive
    )


def with_constants(rows: DataFrame, constants: DataFrame, layout: Layout) -> DataFrame:
    """Columns of a table with one row per record beside the record's rows (records in both).

    The constants are copied to every chunk of their record and met on (record,
    chunk), so a record's rows never meet in one task; where every record fits
    into a chunk, the record alone will do.
    """
    key, seq = layout.key, layout.seq
    if not layout.levels:
        return rows.join(constants, key)
    chunk = _div(F.col(seq), layout.chunk_rows)
    ends = rows.groupBy(key).agg(F.min(chunk).alias("_first_chunk"), F.max(chunk).alias("_last_chunk"))
    copies = constants.join(ends, key).withColumn("_chunk", F.explode(F.sequence("_first_chunk", "_last_chunk"))).drop("_first_chunk", "_last_chunk")
    # rows in small files are not collected in the driver to be broadcast
    return rows.withColumn("_chunk", chunk).hint("merge").join(copies, [key, "_chunk"]).drop("_chunk")


def run_bounds(df: DataFrame, layout: Layout, value: Column, rows: DataFrame | None = None) -> DataFrame:
    """First rows of maximal runs of equal ``value`` with their length.

    Returns every column of the run's first row plus ``run_value``,
    ``run_start``, ``run_end`` (inclusive) and ``run_rows``.  ``rows`` is a
    cheaper table with the same (key, seq) pairs, to find where records end.
    """
    key, seq = layout.key, layout.seq
    marked = framed(
        df.withColumn("run_value", value), layout, before=1, after=0,
        exprs=lambda w: {
            "_starts": ~F.lag("run_value").over(w).eqNullSafe(F.col("run_value"))
            | F.lag(F.col(seq)).over(w).isNull()
        },
    )
    starts = stable(marked.filter("_starts").drop("_starts"))
    starts = running(
        starts, layout, {"_next": ("last", F.col(seq))}, reverse=True, inclusive=False
    )
    ends = (df if rows is None else rows).groupBy(key).agg(F.max(seq).alias("_last_seq"))
    return (
        with_constants(starts, ends, layout)
        .withColumn("run_start", F.col(seq))
        .withColumn("run_end", F.coalesce(F.col("_next") - 1, F.col("_last_seq")))
        .withColumn("run_rows", F.col("run_end") - F.col("run_start") + 1)
        .drop("_next", "_last_seq")
    )


def next_at_least(
    queries: DataFrame, rows: DataFrame, layout: Layout, after: str, threshold: str, value: str, out: str,
    fan: int = 32,
) -> DataFrame:
    """Add ``out`` = first seq > ``after`` whose ``value`` >= ``threshold``.

    A pyramid of maxima with ``fan`` children per cell: look among the later
    rows of the own cell; the unresolved look among the later cells of their
    parent, and so on up; a hit comes back down one level at a time.  Every
    step joins on (record, cell), where a query meets at most ``fan`` entries.
    """
    key, seq = layout.key, layout.seq
    base = rows.select(F.col(key), F.col(seq).alias("_p"), F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    top = layout.max_seq if layout.max_seq is not None else rows.agg(F.max(seq)).first()[0] or 0
    tables = [base]

    def table(level: int) -> DataFrame:
        while len(tables) <= level:
            below = tables[-1].withColumn("_p", _div(F.col("_p"), fan))
            tables.append(stable(below.groupBy(key, "_p").agg(F.max("_v").alias("_v"))))
        return tables[level].withColumn("_cell", _div(F.col("_p"), fan))

    def first(q: DataFrame, level: int) -> DataFrame:
        """``q`` (_id, _thr, _cell, _low) with ``_hit`` in the level's table."""
        hit = F.when((F.col("_p") > F.col("_low")) & (F.col("_v") >= F.col("_thr")), F.col("_p"))
        joined = q.join(table(level), [key, "_cell"], "left")
        return stable(joined.groupBy(*q.columns).agg(F.min(hit).alias("_hit")))

    q_cols = [key, "_id", "_thr"]
    asked = queries.select(key, F.col(after).alias("_id"), F.col(threshold).alias("_thr")).distinct()
    found = None
    waiting: list[tuple[int, DataFrame]] = []
    level, low = 0, asked.withColumn("_low", F.col("_id"))
    while True:
        seen = first(low.withColumn("_cell", _div(F.col("_low"), fan)), level)
        hits = seen.filter("_hit is not null").select(*q_cols, "_hit")
        if level == 0:
            found = hits
        else:
            waiting.append((level, hits))
        rest = seen.filter("_hit is null").select(*q_cols, F.col("_cell").alias("_low"))
        level += 1
        if fan**level > top or rest.isEmpty():
            break
        low = rest
    for start, hits in waiting:
        if hits.isEmpty():
            continue
        for down in range(start - 1, -1, -1):
            q = hits.select(*q_cols, F.col("_hit").alias("_cell"), F.lit(-1).cast("long").alias("_low"))
            hits = first(q, down).select(*q_cols, "_hit")
        found = found.unionByName(hits)
    found = found.select(key, F.col("_id").alias(after), F.col("_thr").alias(threshold), F.col("_hit").alias(out))
    return queries.join(found, [key, after, threshold], "left")
