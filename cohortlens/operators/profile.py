"""User profiles: what the profiling and validity questions need of each user, without event rows.

Most of DQ3–DQ12 and V1–V3 ask about users, cohorts and a few values, not about events. Event rows are
first reduced to the distinct combinations asked for (partial aggregation, so a bot's million
events are one row per task and combination) and only those are shuffled; the rule that drops users
seen in two cohorts (CL4) is then a window over a user's few combinations, in place of an anti join of
events. Exact duplicates cannot change any of these answers.

``user_facets`` holds all facets of all users in one such table, made in one pass over the events and
stored by ``Pipeline.user_facets``; ``facet`` gives one facet's rows for the operators of ``quality``
and ``validity``, which accept any rows with the columns they read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import params as P
from cohortlens.functions.columns import event_label
from cohortlens.operators.cleaning import drop_staging

FACETS = ("ip_country", "login_status", "app_language", "release_version", "platform")


def _one_cohort(user: str, cohort: Column) -> Column:
    """The user (null users are one) has at most one non-null value of ``cohort``."""
    w = Window.partitionBy(F.struct(F.col(user)))
    return F.coalesce(F.max(cohort).over(w) == F.min(cohort).over(w), F.lit(True))


def kept_values(raw: DataFrame, *cols: str, user: str = "user_id", cohort: str = "cohort") -> DataFrame:
    """Distinct (user, cohort, *cols) of events on released builds (CL1), of users seen in fewer than
    two cohorts there (CL4)."""
    keys = list(dict.fromkeys([user, cohort, *cols]))
    x = drop_staging(raw).groupBy(*keys).agg(F.count(F.lit(1)).alias("events"))
    return x.withColumn("_one", _one_cohort(user, F.col(cohort))).filter("_one").drop("_one")


def landing_events(raw: DataFrame, user: str = "user_id", cohort: str = "cohort", ts: str = "event_datetime") -> DataFrame:
    """DQ11 on the cleaned base: first event label (by time, then event_id) of each user kept, counted.
    The cohort range and the first label are one partial aggregate per user."""
    first = drop_staging(raw).groupBy(user).agg(
        F.min(cohort).alias("_lo"), F.max(cohort).alias("_hi"),
        F.min_by(event_label(), F.struct(F.col(ts), F.col("event_id"))).alias("event"))
    kept = first.filter(F.coalesce(F.col("_lo") == F.col("_hi"), F.lit(True)))
    return kept.groupBy("event").agg(F.count(F.lit(1)).alias("occur")).orderBy(F.desc("occur"), "event")


def user_facets(raw: DataFrame, facets: Sequence[str] = FACETS, user: str = "user_id", cohort: str = "cohort",
                marker: str = P.STAGING_MARKER) -> DataFrame:
    """(user, cohort, facet, value, released, kept, events): one row per distinct combination, of all
    events. ``released``: the events were on released builds; ``kept``: so they were, and the user
    was seen in fewer than two cohorts on released builds."""
    released = F.coalesce(~F.col("release_version").contains(marker), F.lit(False))
    each = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])
    x = raw.select(user, cohort, released.alias("released"), F.explode(each).alias("_f"))
    keys = [user, cohort, "released"]
    x = x.groupBy(*keys, F.col("_f.facet").alias("facet"), F.col("_f.value").alias("value")).agg(F.count(F.lit(1)).alias("events"))
    one = _one_cohort(user, F.when(F.col("released"), F.col(cohort)))
    return x.withColumn("kept", F.col("released") & one)


def facet(profile: DataFrame, name: str, kept: bool = True, user: str = "user_id", cohort: str = "cohort") -> DataFrame:
    """(user, cohort, <name>) of one facet of ``user_facets``: of users kept, or of all events."""
    x = profile.filter(F.col("facet") == name)
    return (x.filter("kept") if kept else x).select(user, cohort, F.col("value").alias(name))
