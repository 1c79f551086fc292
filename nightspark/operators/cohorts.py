"""Cohorts as id tables: set algebra, flags, sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightspark.operators.ranks import with_scalars

KEY = "night_record_id"


def with_user(df: DataFrame, owners: DataFrame) -> DataFrame:
    """Look up user and patient of each record."""
    return df.join(owners, KEY, "left")


def quality(all_ids: DataFrame, b2_fail: DataFrame) -> DataFrame:
    return all_ids.select(KEY).distinct().exceptAll(b2_fail.select(KEY).distinct().intersect(all_ids.select(KEY)))


def strict(quality_ids: DataFrame, review: DataFrame) -> DataFrame:
    return quality_ids.select(KEY).subtract(review.select(KEY))


def high_tst(quality_ids: DataFrame, sleep: DataFrame, min_s: float) -> DataFrame:
    return sleep.filter(F.col("tst_s") >= min_s).select(KEY).intersect(quality_ids.select(KEY))


def with_clinical(quality_ids: DataFrame, owners: DataFrame, clinical: DataFrame, owner: str = "patient_id") -> DataFrame:
    covered = owners.join(clinical.select(owner).distinct(), owner, "left_semi")
    return covered.select(KEY).intersect(quality_ids.select(KEY))


def cohort_flags(
    all_ids: DataFrame, b2_fail: DataFrame, review: DataFrame, sleep: DataFrame, high_tst_s: float,
    owners: DataFrame, clinical: DataFrame,
) -> DataFrame:
    """One row per record with the cohort booleans (left joins, no id lists)."""
    q = quality(all_ids, b2_fail)
    sets = {
        "in_quality": q,
        "in_strict": strict(q, review),
        "in_high_tst": high_tst(q, sleep, high_tst_s),
        "with_clinical": with_clinical(q, owners, clinical),
        "flag_for_review": review,
        "b2_fail": b2_fail,
    }
    out = all_ids.select(KEY).distinct()
    for name, ids in sets.items():
        marked = ids.select(KEY).distinct().withColumn(name, F.lit(True))
        out = out.join(marked, KEY, "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in sets})


def cohort_sizes(flags: DataFrame) -> DataFrame:
    """Long table of cohort name and size."""
    names = {
        "all": F.lit(True), "quality": F.col("in_quality"), "strict": F.col("in_strict"),
        "high_tst": F.col("in_high_tst"), "with_clinical": F.col("with_clinical"),
    }
    wide = flags.agg(*[F.count_if(c).alias(n) for n, c in names.items()])
    return wide.unpivot([], list(names), "cohort", "n")


def with_enough_nights(nights: DataFrame, owner: str, minimum: int) -> DataFrame:
    """Records whose owner has at least ``minimum`` records in the table."""
    enough = nights.groupBy(owner).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum)
    return nights.join(enough.select(owner), owner, "left_semi")


def snapshot(ids: DataFrame, name: str) -> DataFrame:
    """The stored form of a cohort: its name and size beside every id."""
    ids = ids.select(KEY).distinct()
    return with_scalars(ids.withColumn("cohort", F.lit(name)), ids.agg(F.count(F.lit(1)).alias("n")))


def clinical_coverage(owners: DataFrame, clinical: DataFrame, owner: str = "patient_id") -> DataFrame:
    """How many records and owners the clinical table covers."""
    per_owner = owners.groupBy(owner).agg(F.count(F.lit(1)).alias("_n"))
    known = clinical.select(owner).distinct().withColumn("_known", F.lit(True))
    j = per_owner.join(known, owner, "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    n_users, covered = F.count(F.lit(1)), F.count_if("_known")
    return j.agg(
        F.sum("_n").alias("n_nights"),
        F.coalesce(F.sum(F.when(F.col("_known"), F.col("_n"))), F.lit(0)).alias("n_nights_covered"),
        n_users.alias("n_users"), covered.alias("n_users_covered"), (n_users - covered).alias("n_users_missing"))


def clinical_rows(owners: DataFrame, clinical: DataFrame, fields: Sequence[str], owner: str = "patient_id") -> DataFrame:
    """Every owner with its records, the clinical fields it lacks and whether its row is complete, partial or missing."""
    per = owners.groupBy(owner).agg(F.count(F.lit(1)).alias("n_records"))
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    one = clinical.groupBy(owner).agg(*[F.max(c).alias(c) for c in fields]).withColumn("_has", F.lit(True))
    lacks = F.concat_ws(",", *[F.when(blank(c), F.lit(c)) for c in fields])
    status = F.when(F.col("_has").isNull(), "missing").when(lacks != "", "partial").otherwise("complete")
    return per.join(one, owner, "left").select(owner, "n_records", lacks.alias("missing"), status.alias("status"))
