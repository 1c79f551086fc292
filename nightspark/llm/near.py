"""Near-duplicate documents by SetSketch registers.

A register is the smallest of a document's exponential hashes, rounded down to
a power of a base: b = 1.001 and 16 bits, as in the paper.  Registers of two
sets agree with a probability close to their Jaccard similarity; the larger of
two registers is the register of the union.  Registers in bands find
candidates, a joint likelihood of all registers and the known set sizes drops
those far from the threshold, and full shingle sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightspark.llm.banding import linked
from nightspark.llm.common import binary_texts, cut, mixed, space_table, table, type_of
from nightspark.llm.hashing import minima, multipliers, some_bytes, word_hashes, word_shingles

SPACES = space_table()
#: 32 bands of 5 registers: a pair at 0.85 meets in no band once in 10^8, one at 0.80 once in 3 * 10^5.
BANDS, ROWS = 32, 5
SKETCH_BASE, RATE, TOP = 1.001, 20.0, 65534
#: A pair goes on unless its registers are e^15 times likelier at another, lower similarity.
LIKELY = 15.0


def registers(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set that is not empty."""
    uniform = (minima(shingles, factors).astype(np.float64) + 0.5) / 2.0**64
    least = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(SKETCH_BASE)), 0, TOP + 1).astype(np.uint16)


def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(left, right)


def likely(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, least: float, grid: int = 64) -> np.ndarray:
    """Which rows may have similarity ``least``, by the joint likelihood of how registers compare.

    With relative sizes u and v, a register is larger on the left with
    probability p(u - v J), on the right with p(v - u J), where
    p(x) = -log_b(1 - x (b - 1) / b).
    """
    up, down = (left > right).sum(axis=1), (left < right).sum(axis=1)
    same = left.shape[1] - up - down
    u = n_left / (n_left + n_right)
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def fit(j: np.ndarray) -> np.ndarray:
        p = [-np.log(np.maximum(1 - np.maximum(x, 1e-12) * (SKETCH_BASE - 1) / SKETCH_BASE, 1e-300)) / np.log(SKETCH_BASE)
             for x in (u - v * j, v - u * j)]
        return up * np.log(p[0]) + down * np.log(p[1]) + same * np.log(np.maximum(1 - p[0] - p[1], 1e-12))

    below = np.max([fit(np.minimum(most, least) * k / grid) for k in range(grid + 1)], axis=0)
    at = np.max([fit(np.maximum(np.minimum(most, least), most * (least + (1 - least) * k / grid))) for k in range(grid + 1)], axis=0)
    return (most >= least - 1e-9) & (below - at <= LIKELY)


def document_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text."""
    out = []
    for lo, hi in some_bytes(texts):
        out += [word_shingles(w, size) for w in word_hashes(texts[lo:hi], SPACES)]
    return out


def set_name(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        return np.array([shingles.sum(), mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64).tobytes()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Two documents are linked if their word-shingle sets have a Jaccard
    similarity of ``percent`` or more, checked on the full sets; component_id is
    the smallest id reachable over links.  Null, empty and blank texts have no
    set: linked with nothing, kept.  Documents of fewer than ``shingle`` words
    have the whole sequence as their one shingle.  A null id is linked with
    nothing, kept, its component null.  Rows that repeat an id are judged each
    by its own text; links of either count for the id.  Equal sets are one
    class, named by its smallest id, and only classes are compared.  Other
    columns are ignored, no rows give no rows.  The id is a whole number.
    """
    factors = multipliers(BANDS * ROWS, 5)
    weights = multipliers(ROWS, 7)
    kind = type_of(docs, doc_id)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = binary_texts(batch, "body")
            for lo, hi in some_bytes(bodies):
                found = document_sets(bodies[lo:hi], shingle)
                full = np.array([len(s) > 0 for s in found])
                regs = np.stack([registers(s, factors) for s in found if len(s)]) if full.any() else np.empty((0, len(factors)), np.uint16)
                with np.errstate(over="ignore"):
                    key = (regs.reshape(-1, BANDS, ROWS).astype(np.uint64) * weights).sum(axis=2)
                    key = mixed(mixed(key) + np.arange(1, BANDS + 1, dtype=np.uint64))
                at = iter(zip(regs, key.view(np.int64), strict=True))
                rows = [next(at) if f else (None, None) for f in full]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(lo, hi - lo), pa.array([len(s) for s in found], pa.int64()),
                     pa.array([set_name(s) if len(s) else None for s in found], pa.binary()),
                     pa.array([None if r is None else r.tobytes() for r, _ in rows], pa.binary()),
                     pa.array([k for _, k in rows], pa.list_(pa.int64()))], ["doc", "n", "name", "regs", "bands"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("body"))
    sketches = cut(source.mapInArrow(sketch, "doc long, n long, name binary, regs binary, bands array<long>"), "sketches")
    classes = cut(sketches.filter("doc IS NOT NULL AND name IS NOT NULL").groupBy("name", "n").agg(
        F.min("doc").alias("id"), F.count(F.lit(1)).alias("members"), F.first("regs").alias("regs"),
        F.first("bands").alias("bands")), "classes")
    bands = classes.select(F.explode("bands").alias("key"), "id")

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, len(factors)) for c in ("ra", "rb"))
                na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
                yield batch.select(["a", "b"]).filter(pa.array(likely(left, right, na, nb, percent / 100)))

    def likely_pairs(pairs: DataFrame) -> DataFrame:
        side = classes.select("id", "n", "regs")
        sized = pairs.join(side.toDF("a", "na", "ra"), "a").join(side.toDF("b", "nb", "rb"), "b").filter(
            100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return sized.mapInArrow(hopeful, "a long, b long").distinct()

    def right_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = binary_texts(batch, "body")
            for lo, hi in some_bytes(bodies):
                names = [set_name(s) if len(s) else None for s in document_sets(bodies[lo:hi], shingle)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(lo, hi - lo), pa.array(names, pa.binary()), pa.array(bodies[lo:hi], pa.binary())], ["id", "name", "body"])

    def texts_of(ids: DataFrame) -> DataFrame:
        """A text of each class, under the class's id."""
        asked = classes.select("id", "name").join(ids, "id", "left_semi")
        own = source.join(ids.toDF("doc"), "doc", "left_semi").mapInArrow(right_texts, "id long, name binary, body binary")
        return own.join(asked, ["id", "name"], "left_semi").dropDuplicates(["id", "name"]).select("id", "body")

    groups = linked(bands, texts_of, lambda bodies: document_sets(bodies, shingle), percent, "near", likely_pairs)
    named = classes.join(groups, classes["id"] == groups["node"], "left").select(
        F.col("name").alias("_name"), F.col("n").alias("_n"), "members", "id", F.coalesce("component", "id").alias("component")).filter(
        "members > 1 OR component <> id").select("_name", "_n", "component")
    out = sketches.select("doc", "n", "name").join(
        named, (F.col("name") == F.col("_name")) & (F.col("n") == F.col("_n")), "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return out.select(
        F.col("doc").cast(kind).alias(doc_id), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"),
        F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


