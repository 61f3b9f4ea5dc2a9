"""Significance tests (S1–S5), re-aimed: Spark reduces sessions to sufficient statistics
(sums, counts, means, variances per variant); the closed-form test runs on those few rows.
Nothing is pulled to the driver.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import params as P
from cohortlens.functions.stats import p_value_col

RESULT_COLUMNS = ["test_name", "metric", "metric_type", "variant", "value", "sample_size",
                  "statistic", "p_value", "is_significant", "run_date"]


def test_input(session_funnel: DataFrame) -> DataFrame:
    """Sessions that reached search activation; steps 4 and 5 recoded to 0/1 (implied
    steps count as conversions), step 6 as is."""
    x = session_funnel.filter(F.col("step_2_flg") > 0)
    return x.select(F.col("cohort").alias("variant"), "user_id", "session_id", "step_3_flg",
                    "event_count_Search_Sub", _reached("step_4_flg"), _reached("step_5_flg"),
                    "step_6_flg")


def _reached(flag: str) -> Column:
    """1 when the step was seen or implied by a later one (flag 1 or 2), else 0."""
    return F.when(F.col(flag) > 0, F.lit(1)).otherwise(F.lit(0)).alias(flag)


def conversion_summary(ti: DataFrame, metrics: Sequence[str] = P.CONVERSION_METRICS) -> DataFrame:
    """Per metric × variant: conversions (sum), total_sessions (non-null count), value.

    One grouping for all metrics, then unpivot. Rows without a variant do not count."""
    aggs = []
    for m in metrics:
        aggs += [F.sum(m).alias(f"x__{m}"), F.count(m).alias(f"n__{m}")]
    g = ti.filter(F.col("variant").isNotNull()).groupBy("variant").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"x__{m}").cast("long").alias("conversions"),
                              F.col(f"n__{m}").alias("total_sessions")) for m in metrics])
    u = g.select("variant", F.explode(rows).alias("_r")).select("_r.metric", "variant",
                                                                "_r.conversions", "_r.total_sessions")
    return u.withColumn("value", F.try_divide(F.col("conversions"), F.col("total_sessions")))


def _pair(col: str, is_a: Column, w) -> tuple[Column, Column]:
    """Values of ``col`` for the first (a) and second (b) variant, on every row of the group."""
    return (F.max(F.when(is_a, F.col(col))).over(w), F.max(F.when(~is_a, F.col(col))).over(w))


def proportion_ztest(summary: DataFrame) -> DataFrame:
    """Pooled two-proportion z test per metric, two-sided; one row per metric × variant.

    Variants in alphabetical order (first = Control): z = (p_first − p_second) / SE.
    Zero pooled variance gives a null statistic and p, and so does any number of variants but
    two: it is a two-sample test. The input has one row per metric × variant, so the per-metric
    window holds a few rows.
    """
    w = Window.partitionBy("metric")
    is_a = F.col("variant") == F.min("variant").over(w)
    x1, x2 = _pair("conversions", is_a, w)
    n1, n2 = _pair("total_sessions", is_a, w)
    pooled = (x1 + x2) / (n1 + n2)
    se = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    z = F.try_divide(x1 / n1 - x2 / n2, F.nullif(se, F.lit(0.0)))
    z = F.when(F.count(F.lit(1)).over(w) == 2, z)
    return summary.withColumn("statistic", z).withColumn("dof", F.lit(None).cast("double"))


def user_totals(ti: DataFrame, metric: str = "event_count_Search_Sub") -> DataFrame:
    """Per variant × user, the metric summed over sessions with step 3 seen."""
    x = ti.filter((F.col("step_3_flg") == 1) & F.col("variant").isNotNull())
    return x.groupBy("variant", "user_id").agg(F.coalesce(F.sum(metric), F.lit(0)).alias("total"))


def user_summary(ti: DataFrame, metric: str = "event_count_Search_Sub") -> DataFrame:
    """Per variant: total events, distinct users, events per user."""
    x = ti.filter((F.col("step_3_flg") == 1) & F.col("variant").isNotNull())
    g = x.groupBy("variant").agg(F.sum(metric).alias("total_events"),
                                 F.count_distinct("user_id").alias("unique_users"))
    return g.withColumn("value", F.try_divide(F.col("total_events"), F.col("unique_users")))


def welch_ttest(totals: DataFrame, metric: str = "event_count_Search_Sub",
                a: str = P.VARIATION, b: str = P.CONTROL) -> DataFrame:
    """Welch's unequal-variance t test on user totals, t = (mean_a − mean_b) / SE.

    The sign is opposite to the z test's (Variation first here). One global aggregation
    (partial per task) yields both variants' count, mean and sample variance in one row;
    the statistic and the Welch–Satterthwaite dof are computed on it and the row is then
    split into one row per variant (sample size = users, value = mean per user).
    """
    def stats(v: str, tag: str) -> list[Column]:
        x = F.when(F.col("variant") == F.lit(v), F.col("total"))
        return [F.count(x).alias(f"n{tag}"), F.avg(x).alias(f"m{tag}"),
                F.var_samp(x).alias(f"s{tag}")]

    g = totals.agg(*stats(a, "a"), *stats(b, "b"))
    va, vb = F.col("sa") / F.col("na"), F.col("sb") / F.col("nb")
    stat = F.try_divide(F.col("ma") - F.col("mb"), F.nullif(F.sqrt(va + vb), F.lit(0.0)))
    dof = F.try_divide((va + vb) * (va + vb),
                       va * va / (F.col("na") - 1) + vb * vb / (F.col("nb") - 1))
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"n{t}").alias("sample_size"),
                              F.col(f"m{t}").alias("value")) for v, t in ((a, "a"), (b, "b"))])
    x = g.select(stat.alias("statistic"), dof.alias("dof"), F.explode(rows).alias("_v"))
    return x.filter(F.col("_v.sample_size") > 0).select(
        F.lit(metric).alias("metric"), "_v.variant", "_v.sample_size", "_v.value",
        "statistic", "dof")


def _finish(rows: DataFrame, test_name: str, alpha: float, run_date) -> DataFrame:
    p = p_value_col(F.col("_kind"), F.col("statistic"), F.col("dof"))
    x = rows.withColumn("p_value", p)
    return x.select(
        F.lit(test_name).alias("test_name"), "metric", "metric_type", "variant",
        F.col("value").cast("double").alias("value"),
        F.col("sample_size").cast("long").alias("sample_size"),
        F.col("statistic").cast("double").alias("statistic"), "p_value",
        (F.col("p_value") < F.lit(alpha)).alias("is_significant"),
        F.lit(run_date).cast("date").alias("run_date"))


def significance(session_funnel: DataFrame, *, test_name: str = P.TEST_NAME,
                 alpha: float = P.ALPHA, run_date: dt.date | str | None = None,
                 conversion_metrics: Sequence[str] = P.CONVERSION_METRICS,
                 average_metrics: Sequence[str] = P.AVERAGE_METRICS) -> DataFrame:
    """Z-test rows (one per metric × variant) and Welch rows (Variation, Control per metric),
    ``is_significant = p < alpha``."""
    run_date = run_date or dt.date.today()
    ti = test_input(session_funnel)
    out = None
    if conversion_metrics:
        summ = conversion_summary(ti, conversion_metrics)
        conv = proportion_ztest(summ).select(
            "metric", F.lit("conversion_rate").alias("metric_type"), "variant", "value",
            F.col("total_sessions").alias("sample_size"), "statistic", "dof",
            F.lit("z").alias("_kind"))
        out = conv
    for m in average_metrics:
        rows = welch_ttest(user_totals(ti, m), m).select(
            "metric", F.lit("avg_events_per_user").alias("metric_type"), "variant", "value",
            "sample_size", "statistic", "dof", F.lit("t").alias("_kind"))
        out = rows if out is None else out.unionByName(rows)
    return _finish(out, test_name, alpha, run_date)
