"""Test-validity checks on the cleaned events (V1–V3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import params as P


def cohort_size(base: DataFrame) -> DataFrame:
    """V1: distinct users per cohort, largest first. Exact duplicates do not matter."""
    return (base.groupBy("cohort").agg(F.count_distinct("user_id").alias("user_count"))
            .orderBy(F.desc("user_count"), "cohort"))


def cohort_balance(base: DataFrame, dim: str, control: str = P.CONTROL) -> DataFrame:
    """V2: per value of ``dim``, Control and Variation users, their share of the cohort total
    (percent, rounded to 2) and the difference of the rounded shares; largest gaps first.

    Totals are exact distinct counts over the whole table (a user can fall under several
    values). Rows are first reduced to distinct (value, side, user), so only those are shuffled
    and no counts expand the rows; exact duplicates do not matter. "Variation" is
    ``cohort != control``, so null cohorts count in neither, but their values are listed.
    """
    side = F.when(F.col("cohort") == F.lit(control), F.lit("c")).when(F.col("cohort") != F.lit(control), F.lit("v"))
    users = base.select(dim, side.alias("_side"), "user_id").distinct()
    known = F.col("user_id").isNotNull()
    by_side = users.filter(known & F.col("_side").isNotNull()).select("_side", "user_id").distinct()
    tot = by_side.select(F.struct(F.count_if(F.col("_side") == "c").alias("c"),
                                  F.count_if(F.col("_side") == "v").alias("v"))).scalar()
    g = users.groupBy(dim).agg(F.count_if(known & (F.col("_side") == "c")).alias("control_users"),
                               F.count_if(known & (F.col("_side") == "v")).alias("variation_users"))
    # the subquery result is attached once as a column and referenced by name below
    g = g.withColumn("_tot", tot)
    tot_c, tot_v = F.col("_tot.c"), F.col("_tot.v")
    c_perc = F.round(F.try_divide(F.lit(100.0) * F.col("control_users"), tot_c), 2)
    v_perc = F.round(F.try_divide(F.lit(100.0) * F.col("variation_users"), tot_v), 2)
    out = g.select(
        dim, "control_users", tot_c.alias("total_control_users"),
        c_perc.alias("control_users_perc"), "variation_users",
        tot_v.alias("total_variation_users"), v_perc.alias("variation_users_perc"),
        F.round(c_perc - v_perc, 2).alias("perc_diff"))
    return out.orderBy(F.abs(F.col("perc_diff")).desc_nulls_last(), dim)


def distinct_values(base: DataFrame, col: str) -> DataFrame:
    """V3: distinct values of a column."""
    return base.select(col).distinct()
