"""Whitening of embeddings by shifted CholeskyQR.

Vectors are quantised to whole numbers; each distinct one counts once in the
fit.  Every pass over the fit list sums one Gram matrix of the centred rows
after triangular solves with the factor so far, R; the Cholesky factor of that
sum is multiplied into R.  The first pass adds a shift to the diagonal, so that
it ends for rows of any condition, the later ones bring the rows to
orthogonality.  The SVD of R gives the components.  The driver holds matrices
of d x d numbers for vectors of d entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightspark.llm.common import cut, table, type_of

SCALE = 256.0
COMPONENTS = 4
#: Passes at most; a pass that finds rows orthogonal to this error is the last.
PASSES, ORTHOGONAL = 7, 1e-13
_LOW, _HIGH = -(2.0**63), 2.0**63


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(256 c) as int64, held at the ends of its range."""
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * values)
    out = np.where(x >= _HIGH, np.iinfo(np.int64).max, np.clip(x, _LOW, np.nextafter(_HIGH, 0)).astype(np.int64))
    return out.astype(np.int64)


def quantised(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, _d, _x): length and quantised entries of rows whose entries are all finite numbers."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            keep = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            column = column.take(pa.array(keep))
            flat = column.flatten()
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
            fine = flat.is_valid().to_numpy(zero_copy_only=False) & np.isfinite(values)
            ends = np.cumsum(np.diff(column.offsets.to_numpy()))
            bad = np.concatenate([[0], np.cumsum(~fine)])
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            good = np.flatnonzero((bad[ends] == bad[starts]) & (ends > starts))
            raw = whole_numbers(np.where(fine, values, 0.0)).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(keep[good])), pa.array((ends - starts)[good].astype(np.int32)),
                pa.array([raw[8 * a : 8 * b] for a, b in zip(starts[good], ends[good], strict=True)], pa.binary())],
                [vec_id, "_d", "_x"])

    kind = type_of(df, vec_id)
    return df.select(vec_id, vector).mapInArrow(turn, f"`{vec_id}` {kind}, _d int, _x binary")


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of int64 entries from a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension; halves of 32 bits are summed apart."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for batch in batches:
            x = matrix(batch.column(0), d)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
            n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d, dtype=np.int32)), pa.array(high), pa.array(low), pa.array(np.full(d, n))], ["i", "high", "low", "n"])

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")]
    rows = fit.select("_x").mapInArrow(part, "i int, high long, low long, n long").groupBy("i").agg(*wide).collect()
    by = {r.i: (int(r.high) << 32) + int(r.low) for r in rows}
    return (int(rows[0].n) if rows else 0), [by.get(i, 0) for i in range(d)]


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular matrix, by forward substitution over blocks of columns."""
    d = len(r)
    out = rows.copy()
    for a in range(0, d, 32):
        b = min(a + 32, d)
        if a:
            out[:, a:b] -= out[:, :a] @ r[:a, a:b]
        for j in range(a, b):
            if j > a:
                out[:, j] -= out[:, a:j] @ r[a:j, j]
            out[:, j] /= r[j, j]
    return out


def gram(fit: DataFrame, d: int, mean: np.ndarray, scale: np.ndarray, r: np.ndarray | None, after: np.ndarray | None = None) -> np.ndarray:
    """Gram matrix over the fit list of (x - mean) / scale, solved with ``r`` and multiplied by ``after``."""
    width = d if after is None else after.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = (matrix(batch.column(0), d) - mean) / scale
            if r is not None:
                rows = solved(rows, r)
            if after is not None:
                rows = rows @ after
            total += rows.T @ rows
        i = np.arange(width, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.repeat(width)), pa.array(np.tile(i, width)), pa.array(total.ravel())], ["i", "j", "v"])

    out = np.zeros((width, width))
    for x in fit.select("_x").mapInArrow(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[x.i, x.j] = x.v
    return (out + out.T) / 2


def factor(fit: DataFrame, d: int, mean: np.ndarray) -> np.ndarray:
    """F with F'F = the Gram matrix of the centred rows, found without squaring their condition."""
    eps = np.finfo(float).eps
    first = gram(fit, d, mean, np.ones(d), None)
    scale = np.sqrt(np.diag(first))
    scale[scale == 0] = 1.0
    g, r = first / np.outer(scale, scale), None
    for step in range(PASSES):
        if step:
            g = gram(fit, d, mean, scale, r)
            if np.abs(g - np.eye(d)).max() <= ORTHOGONAL * d:
                break
        shift = 100 * d * eps * np.trace(g) if step == 0 else 0.0
        while True:
            try:
                lower = np.linalg.cholesky(g + shift * np.eye(d))
                break
            except np.linalg.LinAlgError:
                shift = max(10 * shift, 100 * d * eps * max(np.trace(g), eps))
        r = lower.T if r is None else lower.T @ r
    else:
        g = gram(fit, d, mean, scale, r)
    # directions in which the rows have no extent never get orthonormal: what is left of them counts
    size, turn = np.linalg.eigh(g)
    return np.sqrt(np.maximum(size, 0.0))[:, None] * turn.T @ (r * scale)


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Exact sum of (n x - S)^2 per row; null where it is beyond a long."""
    s = np.array(total, object)
    if len(x) and max(n * abs(int(x.max())), n * abs(int(x.min())), 1) + max(map(abs, total)) < 2**31 // max(1, x.shape[1]):
        t = n * x - s.astype(np.int64)
        return (t * t).sum(1).tolist()
    t = x.astype(object) * n - s
    return [v if v < 2**63 else None for v in (t * t).sum(1).tolist()] if len(x) else []


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per remaining vector and component: its whitened coordinate, and the fit's measures.

    Null vectors, empty ones and those with a null, NaN or infinite entry are
    left out; so are vectors of another length than most (the longer of equally
    frequent lengths counts).  Ids may be null or repeated: each row is
    answered.  Components without variance are left out, so equal vectors, one
    vector or no rows give no rows.  Entries beyond a long stop at its ends;
    ``deviation`` is null where it is beyond a long.  Other columns are ignored.
    """
    spark = df.sparkSession
    rows = cut(quantised(df, vec_id, vector), "quantised")
    usual = rows.groupBy("_d").count().agg(F.max_by("_d", F.struct("count", "_d")).alias("d")).first().d
    kind = type_of(df, vec_id)
    schema = f"`{vec_id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if usual is None:
        return spark.createDataFrame([], schema)
    d = int(usual)
    rows = rows.filter(F.col("_d") == d)
    fit = cut(rows.select("_x").distinct(), "fit-list")
    n, total = sums(fit, d)
    # whole and rest apart: S / n to double precision for large sums too
    mean = np.array([s // n + (s % n) / n for s in total])
    _, size, right = np.linalg.svd(factor(fit, d, mean))
    variance = size**2 / n
    many = int((variance[:components] > 1e-16 * max(variance[0], np.finfo(float).tiny)).sum())
    if not many:
        return spark.createDataFrame([], schema)
    turn = right[:many].T / np.sqrt(variance[:many])
    explained = variance[:many] / variance.sum()
    error = float(np.abs(gram(fit, d, mean, np.ones(d), None, turn) / n - np.eye(many)).max())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), d)
            k = len(x)
            each = pa.array(np.arange(k).repeat(many))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), k)),
                pa.array(np.full(k * many, n, np.int64)), pa.array(deviations(x, n, total), pa.int64()).take(each),
                pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * many, error))],
                [vec_id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(vec_id, "_x").mapInArrow(answer, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
