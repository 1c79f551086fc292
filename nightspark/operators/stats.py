"""Statistics as Spark aggregates: ranks, variance parts, scores.

Global ranks go through ``rank_table``; every figure is an aggregate over
distinct values or over groups, never a collected sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightspark.operators.ordering import stable
from nightspark.operators.ranks import average_rank, rank_table, with_scalars


def spearman(df: DataFrame, groups: Sequence[str], a: str, b: str, min_n: int = 0) -> DataFrame:
    """Rank correlation per group over rows where both are present: ``rho``."""
    both = stable(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*groups, a, b))
    ranked = average_rank(average_rank(both, groups, a, "_ra"), groups, b, "_rb")
    rho = F.when(F.count(F.lit(1)) >= min_n, F.corr("_ra", "_rb")).alias("rho")
    return ranked.groupBy(*groups).agg(rho) if groups else ranked.agg(rho)


def correlation_pairs(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Long correlation matrix (a < b), pairwise complete rows; all Pearson pairs come from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    if method == "pearson":
        both = {f"_r{i}": F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))) for i, (a, b) in enumerate(pairs)}
        row = df.agg(*[c.alias(n) for n, c in both.items()])
        cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
        return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    parts = None
    for a, b in pairs:
        one = spearman(df, [], a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("rho").alias("r"))
        parts = one if parts is None else parts.union(one)
    return parts


def chi2_cramers_v(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Chi-square, degrees of freedom, Cramer's V from the cell counts."""
    cells = stable(df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(rows, columns).agg(F.count(F.lit(1)).alias("n")))
    r = cells.groupBy(rows).agg(F.sum("n").alias("_r"))
    c = cells.groupBy(columns).agg(F.sum("n").alias("_c"))
    # sum (o - e)^2 / e over the whole grid equals n (sum o^2 / (r c) - 1):
    # empty cells need no row
    part = F.col("n") * F.col("n") / (F.col("_r") * F.col("_c"))
    out = cells.join(r, rows).join(c, columns).agg(
        F.sum(part).alias("_q"), F.sum("n").alias("n"), F.count_distinct(rows).alias("_a"), F.count_distinct(columns).alias("_b"))
    chi2, k = F.col("n") * (F.col("_q") - 1), F.least("_a", "_b") - 1
    return out.select(
        chi2.alias("chi2"), ((F.col("_a") - 1) * (F.col("_b") - 1)).alias("dof"), "n",
        F.sqrt(F.greatest(chi2, F.lit(0.0)) / (F.col("n") * F.nullif(k, F.lit(0)))).alias("cramers_v"))


def kruskal_h(df: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with the tie correction."""
    rows = stable(df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, value))
    ranked = average_rank(rows, [], value, "_r")
    per = ranked.groupBy(group).agg(F.sum("_r").alias("_s"), F.count(F.lit(1)).alias("_k"))
    ties = rank_table(rows, [], value).agg(F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("_t"))
    agg = per.agg(F.sum(F.col("_s") * F.col("_s") / F.col("_k")).alias("_q"), F.sum("_k").alias("n"), F.count(F.lit(1)).alias("n_groups"))
    n = F.col("n").cast("double")
    h = 12.0 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)
    return with_scalars(agg, ties).select("n", "n_groups", (h / (1 - F.col("_t") / (n * n * n - n))).alias("h"))


def mann_whitney(df: DataFrame, groups: Sequence[str], side: str, value: str) -> DataFrame:
    """U of the rows where ``side`` holds, with the normal approximation z
    (tie-corrected), per group."""
    rows = stable(df.filter(F.col(value).isNotNull() & F.col(side).isNotNull()).select(*groups, side, value))
    ranked = average_rank(rows, groups, value, "_r")
    ties = rank_table(rows, groups, value).groupBy(*groups).agg(F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("_t"))
    n1, n2 = F.count_if(F.col(side)), F.count_if(~F.col(side))
    agg = ranked.groupBy(*groups).agg(n1.alias("n1"), n2.alias("n2"), F.sum(F.when(F.col(side), F.col("_r"))).alias("_s"))
    joined = agg.join(ties, list(groups)) if groups else with_scalars(agg, ties)
    n, a, b = (F.col("n1") + F.col("n2")).cast("double"), F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("_s") - a * (a + 1) / 2
    var = a * b / 12 * ((n + 1) - F.col("_t") / (n * (n - 1)))
    return joined.select(*groups, "n1", "n2", u.alias("u"), ((u - a * b / 2) / F.sqrt(F.when(var > 0, var))).alias("z"))


def mean_squares(df: DataFrame, owner: str, value: str, extra: Sequence[str] = ()) -> DataFrame:
    """One-way variance table from per-owner moments (two-level aggregate)."""
    g = df.filter(F.col(value).isNotNull()).groupBy(*extra, owner).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    n, k = F.sum("_n"), F.count(F.lit(1))
    grand = F.sum(F.col("_n") * F.col("_m")) / n
    ss_b = F.sum(F.col("_n") * F.col("_m") * F.col("_m")) - n * grand * grand
    agg = [ss_b.alias("_ssb"), F.sum(F.col("_n") * F.col("_v")).alias("_ssw"), n.alias("n_total"), k.alias("n_groups"),
           F.sum(F.col("_n") * F.col("_n")).alias("_n2")]
    out = g.groupBy(*extra).agg(*agg) if extra else g.agg(*agg)
    return out.withColumns({
        "ms_between": F.col("_ssb") / F.nullif(F.col("n_groups") - 1, F.lit(0)),
        "ms_within": F.col("_ssw") / F.nullif(F.col("n_total") - F.col("n_groups"), F.lit(0)),
        "k_mean": F.col("n_total") / F.col("n_groups"),
        "n0": (F.col("n_total") - F.col("_n2") / F.col("n_total")) / F.nullif(F.col("n_groups") - 1, F.lit(0)),
    }).drop("_ssb", "_ssw", "_n2")


def icc(df: DataFrame, owner: str, value: str, extra: Sequence[str] = ()) -> DataFrame:
    """Intraclass correlation in its variants: mean group size (1,1) and (1,k),
    size-corrected (n0), and the clipped variance ratio, with variance shares."""
    t = mean_squares(df, owner, value, extra)
    b, w, k, n0 = F.col("ms_between"), F.col("ms_within"), F.col("k_mean"), F.col("n0")
    between = F.greatest((b - w) / k, F.lit(0.0))
    total = F.nullif(between + w, F.lit(0.0))
    return t.withColumns({
        "icc_1_1": (b - w) / F.nullif(b + (k - 1) * w, F.lit(0.0)), "icc_1_k": (b - w) / F.nullif(b, F.lit(0.0)),
        "icc_n0": (b - w) / F.nullif(b + (n0 - 1) * w, F.lit(0.0)), "icc_ratio": between / total,
        "share_between": between / total, "share_within": w / total,
    })


def spearman_brown(icc_value: Column, k: Column) -> Column:
    return k * icc_value / (1 + (k - 1) * icc_value)


def variance_parts(df: DataFrame, owner: str, value: str) -> DataFrame:
    """Variance of owner means, mean of owner variances, mean intra-owner cv
    (population sd, owners with >= 3 values and a positive mean)."""
    g = df.filter(F.col(value).isNotNull()).groupBy(owner).agg(
        F.avg(value).alias("_m"), F.when(F.count(value) > 1, F.var_samp(value)).alias("_v"),
        F.when((F.count(value) >= 3) & (F.avg(value) > 0), F.stddev_pop(value) / F.avg(value)).alias("_cv"))
    return g.agg(F.var_samp("_m").alias("between"), F.avg("_v").alias("within"), F.avg("_cv").alias("cv_intra"))


def bland_altman(df: DataFrame, owner: str, value: str) -> DataFrame:
    """Each value against its owner's mean: bias, sd and 95 % limits."""
    mean = df.filter(F.col(value).isNotNull()).groupBy(owner).agg(F.avg(value).alias("_m"))
    gap = df.filter(F.col(value).isNotNull()).join(mean, owner).select((F.col(value) - F.col("_m")).alias("_d"))
    out = gap.agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("bias"), F.stddev_samp("_d").alias("sd"))
    return out.withColumns({"loa_low": F.col("bias") - 1.96 * F.col("sd"), "loa_high": F.col("bias") + 1.96 * F.col("sd")})


def incremental_r2(df: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """R2 of y on x1, on x1 and x2, and the gain, from covariances in one pass."""
    d = df.dropna(subset=[y, x1, x2])
    cols = {"_1y": (x1, y), "_2y": (x2, y), "_12": (x1, x2)}
    a = d.agg(
        F.count(F.lit(1)).alias("n"), F.var_pop(y).alias("_yy"), F.var_pop(x1).alias("_11"), F.var_pop(x2).alias("_22"),
        *[F.covar_pop(p, q).alias(name) for name, (p, q) in cols.items()])
    c = lambda n: F.col(n)
    r1 = c("_1y") * c("_1y") / F.nullif(c("_11") * c("_yy"), F.lit(0.0))
    det = F.nullif(c("_11") * c("_22") - c("_12") * c("_12"), F.lit(0.0))
    b1 = (c("_22") * c("_1y") - c("_12") * c("_2y")) / det
    b2 = (c("_11") * c("_2y") - c("_12") * c("_1y")) / det
    r2 = (b1 * c("_1y") + b2 * c("_2y")) / F.nullif(c("_yy"), F.lit(0.0))
    return a.select("n", r1.alias("r2_one"), r2.alias("r2_two"), (r2 - r1).alias("r2_gain"))


# --- scores against a binary label -----------------------------------------


def score_table(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """One row per (group, distinct score), best first, with cumulative counts
    ``tp`` / ``fp`` at that threshold and totals ``pos`` / ``neg``."""
    t = rank_table(df, groups, score, {"p": F.col(label).cast("long")}, descending=True)
    return t.select(
        *groups, score, F.col("p").alias("dp"), F.col("n").alias("dn"), (F.col("p_below") + F.col("p")).alias("tp"),
        (F.col("below") + F.col("n") - F.col("p_below") - F.col("p")).alias("fp"),
        F.col("p_total").alias("pos"), (F.col("total") - F.col("p_total")).alias("neg"))


def roc_auc(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve: trapezoids over distinct scores."""
    t = score_table(df, groups, score, label)
    dfp = F.col("dn") - F.col("dp")
    area = F.sum(dfp * (F.col("tp") - F.col("dp") / 2.0)) / F.nullif(F.max("pos") * F.max("neg"), F.lit(0))
    return t.groupBy(*groups).agg(area.alias("auc")) if groups else t.agg(area.alias("auc"))


def average_precision(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    t = score_table(df, groups, score, label)
    ap = F.sum(F.col("dp") / F.nullif(F.col("pos"), F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp")))
    return t.groupBy(*groups).agg(ap.alias("ap")) if groups else t.agg(ap.alias("ap"))


def youden_threshold(df: DataFrame, groups: Sequence[str], score: str, label: str, min_class: int = 0) -> DataFrame:
    """Score with the largest tpr - fpr (the highest one on a tie); null when a
    class has fewer than ``min_class`` rows."""
    t = score_table(df, groups, score, label)
    j = F.col("tp") / F.nullif(F.col("pos"), F.lit(0)) - F.col("fp") / F.nullif(F.col("neg"), F.lit(0))
    best = F.max_by(score, F.struct(F.round(j, 12), F.col(score)))
    pick = F.when((F.max("pos") >= min_class) & (F.max("neg") >= min_class), best).alias("threshold")
    return t.groupBy(*groups).agg(pick) if groups else t.agg(pick)


def sensitivity_at_specificity(df: DataFrame, score: str, label: str, specificity: float = 0.80) -> DataFrame:
    t = score_table(df, [], score, label)
    ok = 1 - F.col("fp") / F.col("neg") >= specificity
    return t.agg(F.coalesce(F.max(F.when(ok, F.col("tp") / F.col("pos"))), F.lit(0.0)).alias("sensitivity"))


def threshold_metrics(df: DataFrame, groups: Sequence[str], predicted: Column, label: str) -> DataFrame:
    """tp, fp, fn, sensitivity, precision, fp/tp ratio, activations."""
    y = F.col(label).cast("boolean")
    p = F.coalesce(predicted, F.lit(False))
    aggs = [F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(p).alias("activations")]
    a = df.groupBy(*groups).agg(*aggs) if groups else df.agg(*aggs)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return a.withColumns({
        "sens": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0), "ppv": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0),
        "ratio": F.when(tp > 0, fp / tp).otherwise(F.lit(float("inf")))})


def confusion_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, balanced accuracy, Cohen's kappa, weighted F1 from cell counts."""
    cells = stable(df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n")))
    rows = cells.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("_r"), F.sum(F.when(F.col("t").eqNullSafe(F.col("p")), F.col("n")).otherwise(0)).alias("_d"))
    cols = cells.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("_c"))
    per = rows.join(cols, "c", "full_outer").fillna(0)
    total = cells.agg(F.sum("n").alias("_n"))
    r, c, d, n = F.col("_r"), F.col("_c"), F.col("_d"), F.col("_n")
    f1 = F.when(r + c > 0, 2 * d / (r + c)).otherwise(0.0)
    a = with_scalars(per, total).agg(
        F.max("_n").alias("n"), (F.sum(d) / F.max(n)).alias("accuracy"), F.avg(F.when(r > 0, d / r)).alias("balanced_accuracy"),
        (F.sum(r * c) / F.max(n * n)).alias("_pe"), (F.sum(f1 * r) / F.max(n)).alias("weighted_f1"))
    return a.withColumn("kappa", (F.col("accuracy") - F.col("_pe")) / F.nullif(1 - F.col("_pe"), F.lit(0.0))).drop("_pe")


def davies_bouldin(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Mean over clusters of the worst (scatter_i + scatter_j) / distance_ij.

    Rows are only aggregated; the pair join runs over the K centroids.
    """
    rows = df.dropna(subset=[label, *features])
    cent = stable(rows.groupBy(label).agg(*[F.avg(f).alias(f"_c_{f}") for f in features]))
    d2 = F.lit(0.0)
    for f in features:
        d2 = d2 + (F.col(f) - F.col(f"_c_{f}")) * (F.col(f) - F.col(f"_c_{f}"))
    scatter = rows.join(cent, label).groupBy(label).agg(F.avg(F.sqrt(d2)).alias("_s"))
    c = stable(cent.join(scatter, label))
    a = c.select(F.col(label).alias("i"), F.col("_s").alias("si"), *[F.col(f"_c_{f}").alias(f"a_{f}") for f in features])
    b = c.select(F.col(label).alias("j"), F.col("_s").alias("sj"), *[F.col(f"_c_{f}").alias(f"b_{f}") for f in features])
    m2 = F.lit(0.0)
    for f in features:
        m2 = m2 + (F.col(f"a_{f}") - F.col(f"b_{f}")) * (F.col(f"a_{f}") - F.col(f"b_{f}"))
    worst = a.join(b, F.col("i") != F.col("j")).groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / F.sqrt(m2)).alias("_w"))
    return worst.agg(F.avg("_w").alias("davies_bouldin"))
