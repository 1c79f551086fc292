"""Versioned store of fitted centroid models.

A version holds the centroids (z-space and original space), the scaling they
were fitted in, sizes, labels, the corpus it saw and a fingerprint.  It is
written beside its place and moved there in one step, so a reader sees whole
versions only; versions are never changed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightspark.operators import labels as LB


@dataclass(frozen=True)
class Stored:
    """One version: models by scale, and what is known of them."""

    version: int
    models: dict[str, LB.CentroidModel]
    counts: dict[str, tuple[int, ...]]
    meta: dict

    def table(self, spark: SparkSession) -> DataFrame:
        """(scale, cluster, label, feature, z, value, mean, std, n_training): K x features rows per scale."""
        return spark.createDataFrame(rows_of(self.models, self.counts), SCHEMA)


SCHEMA = "scale string, cluster long, label string, feature string, z double, value double, mean double, std double, n_training long"


def rows_of(models: Mapping[str, LB.CentroidModel], counts: Mapping[str, Sequence[int]]) -> list[tuple]:
    out = []
    for scale, m in models.items():
        for k, row in enumerate(m.centroids):
            if counts[scale][k]:
                out += [(scale, k, m.labels[k], f, float(z), float(z * s + mu), float(mu), float(s), int(counts[scale][k]))
                        for f, z, mu, s in zip(m.features, row, m.mean, m.std, strict=True)]
    return out


def fingerprint(rows: Sequence[tuple]) -> str:
    """16 hex digits over the centroids, to the fourth digit."""
    text = "|".join(sorted(f"{r[0]}:{r[1]}:{r[3]}:{int(r[4] * 10000 + (0.5 if r[4] >= 0 else -0.5))}" for r in rows))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def group_means(rows: DataFrame, model: LB.CentroidModel, cluster: str = "cluster_int") -> tuple[LB.CentroidModel, tuple[int, ...]]:
    """The model with each centroid replaced by the mean of the rows that bear its number, and their counts.

    One aggregate gives a row per cluster.  A number that no row bears keeps its
    centroid with a count of zero.
    """
    z = LB.apply_zscore(model.features, model.mean, model.std)
    got = {r[cluster]: r for r in rows.filter(F.col(cluster) >= 0).groupBy(cluster).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_z{i}") for i, c in enumerate(z)]).collect()}
    centroids = tuple(
        tuple(got[k][f"_z{i}"] for i in range(len(model.features))) if k in got else row for k, row in enumerate(model.centroids))
    new = LB.CentroidModel(model.features, model.mean, model.std, centroids, model.labels)
    return new, tuple(int(got[k]["_n"]) if k in got else 0 for k in range(len(model.centroids)))


def snapshot(records: DataFrame, record: str, owner: str) -> dict:
    """What a model has seen: records, owners, first and last record."""
    r = records.agg(F.count_distinct(record).alias("n_records"), F.count_distinct(owner).alias("n_owners"),
                    F.min(record).alias("first"), F.max(record).alias("last")).first()
    return r.asDict()


class Store:
    """Versions of one model under ``root`` (a folder that all executors share)."""

    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def save(self, models: Mapping[str, LB.CentroidModel], counts: Mapping[str, Sequence[int]], meta: Mapping) -> int:
        """Write the next version; a writer that comes second takes the number after."""
        rows = rows_of(models, counts)
        full = {**meta, "fingerprint": fingerprint(rows), "k": {s: len(m.centroids) for s, m in models.items()},
                "features": {s: list(m.features) for s, m in models.items()}, "labels": {s: list(m.labels) for s, m in models.items()},
                "mean": {s: list(m.mean) for s, m in models.items()}, "std": {s: list(m.std) for s, m in models.items()},
                "centroids": {s: [list(c) for c in m.centroids] for s, m in models.items()}, "counts": {s: list(c) for s, c in counts.items()}}
        beside = f"{self.path}/.{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{beside}/centroids")
        self.spark.createDataFrame([(json.dumps(full, sort_keys=True),)], "value string").coalesce(1).write.text(f"{beside}/meta")
        source, fs = self._fs(beside)
        while True:
            version = (self.versions() or [0])[-1] + 1
            target, _ = self._fs(f"{self.path}/v{version}")
            if not fs.exists(target) and fs.rename(source, target):
                return version

    def load(self, version: int | None = None) -> Stored:
        """A version, the latest if none is named."""
        have = self.versions()
        version = have[-1] if version is None and have else version
        if version not in have:
            raise FileNotFoundError(f"{self.path} has no version {version}")
        meta = json.loads(self.spark.read.text(f"{self.path}/v{version}/meta").first()[0])
        models = {s: LB.CentroidModel(tuple(meta["features"][s]), tuple(meta["mean"][s]), tuple(meta["std"][s]),
                                      tuple(map(tuple, meta["centroids"][s])), tuple(meta["labels"][s])) for s in meta["k"]}
        return Stored(version, models, {s: tuple(c) for s, c in meta["counts"].items()},
                      {k: v for k, v in meta.items() if k not in ("features", "mean", "std", "centroids", "counts")})

    def centroids(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version}/centroids")


def fingerprint_column(scale: Column, cluster: Column, feature: Column, z: Column) -> Column:
    """The same digits as ``fingerprint``, as an aggregate over a centroid table."""
    whole = F.when(z >= 0, F.floor(z * 10000 + 0.5)).otherwise(F.ceil(z * 10000 - 0.5)).cast("long")
    text = F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(":", scale, cluster.cast("string"), feature, whole.cast("string")))))
    return F.substring(F.sha2(text, 256), 1, 16)
