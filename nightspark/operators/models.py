"""Components, pipelines and scores of models; folds are fitted in ``folds`` and ``trees``, clusters in ``lloyd``.

Rows stay distributed; only fitted parameters and rows of metrics reach the
driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightspark.operators import folds
from nightspark.operators.ranks import with_scalars
from nightspark.operators.stats import average_precision, confusion_metrics, roc_auc, youden_threshold


def choose_k(sweep: DataFrame) -> DataFrame:
    """k with the largest silhouette - 0.5 * min-max scaled Davies-Bouldin."""
    sweep = sweep.filter("silhouette is not null and davies_bouldin is not null")
    span = sweep.agg(F.min("davies_bouldin").alias("_lo"), F.max("davies_bouldin").alias("_hi"))
    scaled = F.coalesce((F.col("davies_bouldin") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0))
    scored = with_scalars(sweep, span).withColumn("_s", F.col("silhouette") - 0.5 * scaled)
    return scored.agg(F.max_by("k", F.struct("_s", -F.col("k"))).alias("k"))


def best_assignment(counts: dict[tuple[int, int], int], k: int) -> dict[int, int]:
    """Relabelling with the most agreement, from a K x K count table."""
    best: dict[int, tuple[int, tuple[int, ...]]] = {0: (0, ())}
    for i in range(k):
        step: dict[int, tuple[int, tuple[int, ...]]] = {}
        for used, (score, chosen) in best.items():
            for j in range(k):
                if used & (1 << j):
                    continue
                cand = (score + counts.get((i, j), 0), (*chosen, j))
                key = used | (1 << j)
                if key not in step or cand[0] > step[key][0]:
                    step[key] = cand
        best = step
    return dict(enumerate(best[(1 << k) - 1][1]))


def pca_scores(df: DataFrame, features: Sequence[str], k: int, keep: Sequence[str]) -> tuple[DataFrame, list[float]]:
    """Component scores of standardized complete rows, and explained variance."""
    rows = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df.dropna(subset=list(features)).select(*keep, *features))
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_s").fit(rows).transform(rows)
    model = PCA(k=k, inputCol="_s", outputCol="_p").fit(scaled)
    parts = vector_to_array("_p")
    out = model.transform(scaled).select(*keep, *[parts[i].alias(f"pc{i + 1}") for i in range(k)])
    return out, [float(v) for v in model.explainedVariance]


def pca_loadings(df: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """(component, feature, loading, explained) of standardized complete rows; a component's sign is that of its largest loading."""
    rows = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df.dropna(subset=list(features)).select(*features))
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_s").fit(rows).transform(rows)
    model = PCA(k=min(k, len(features)), inputCol="_s", outputCol="_p").fit(scaled)
    out = []
    for i, column in enumerate(model.pc.toArray().T):
        sign = 1.0 if column[abs(column).argmax()] >= 0 else -1.0
        out += [(i + 1, f, float(sign * v), float(model.explainedVariance[i])) for f, v in zip(features, column, strict=True)]
    return df.sparkSession.createDataFrame(out, "component long, feature string, loading double, explained double")


def balanced_weights(train: DataFrame, label: str) -> DataFrame:
    """``_w`` = rows / (classes * rows of the class).

    Rows without a label carry no information for a fit and are left out here;
    they are still scored.  The table of weights has a row per class.
    """
    known = train.filter(F.col(label).isNotNull())
    n = known.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    w = with_scalars(n, total).select(F.col(label).alias("_y"), (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("_w"))
    return known.join(w, F.col(label) == F.col("_y")).drop("_y")


def pipeline(features: Sequence[str], classifier, scale: bool = True) -> Pipeline:
    filled = [f"_f_{f}" for f in features]
    stages = [
        Imputer(strategy="median", relativeError=0.0, inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw" if scale else "features"),
    ]
    if scale:
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="features"))
    return Pipeline(stages=[*stages, classifier])


def logistic(label: str, rows: int = 0) -> LogisticRegression:
    """Balanced L2 logistic regression with C = 1: a penalty of 1 / rows on the mean loss."""
    return LogisticRegression(featuresCol="features", labelCol=label, weightCol="_w", maxIter=100, regParam=1.0 / rows if rows else 1e-4)


def fold_scores(predictions: DataFrame, owner: str) -> DataFrame:
    """AUC per held-out owner beside its rows and positives."""
    p = predictions.withColumn("score", F.round(F.col("probability")[1], 9))
    n = p.groupBy(owner).agg(F.count(F.lit(1)).alias("n"), F.sum("_label").cast("long").alias("n_pos"))
    return n.join(roc_auc(p, [owner], "score", "_label"), owner)


def multiclass_scores(predictions: DataFrame) -> DataFrame:
    return confusion_metrics(predictions, "_label", "prediction")


def horizon_scores(predictions: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per group: rows, positives, prevalence, AUC, average precision, Youden's threshold."""
    p = predictions.filter(F.col("_label").isNotNull() & F.col("probability").isNotNull()).withColumn("score", F.round(F.col("probability")[1], 9))
    n = p.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sum("_label").cast("long").alias("n_pos"), F.avg("_label").alias("prevalence"))
    out = n.join(roc_auc(p, groups, "score", "_label"), list(groups)).join(average_precision(p, groups, "score", "_label"), list(groups))
    return out.join(youden_threshold(p, groups, "score", "_label"), list(groups))


def ablation(df: DataFrame, groups: dict[str, Sequence[str]], labels: Sequence[str], owner: str, keep: Sequence[str]) -> DataFrame:
    """Overall AUC of the same leave-one-owner-out logistic evaluation per feature group and label."""
    out = None
    for label in labels:
        for name, features in groups.items():
            p, _ = folds.out_of_fold(df, features, label, owner, keep)
            auc = roc_auc(p.filter("_label is not null").withColumn("score", F.round(F.col("probability")[1], 9)), [], "score", "_label")
            one = auc.select(F.lit(label).alias("label"), F.lit(name).alias("features"), F.lit(len(features)).cast("long").alias("n_features"), "auc")
            out = one if out is None else out.union(one)
    return out


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
