"""Data-quality profiling of raw events (DQ1–DQ12). DQ10 lives in cleaning.session_trace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlens import params as P
from cohortlens.functions.columns import epoch_seconds, event_label
from cohortlens.operators import timeline as TL
from cohortlens.operators.cleaning import zone_lookup

NULL_CHECK_COLUMNS = ["event_date", "event_datetime", "user_id", "event_name", "login_status",
                      "platform", "cohort"]


def date_range(df: DataFrame, col: str = "event_date") -> DataFrame:
    """DQ1: first and last event date (one row)."""
    return df.agg(F.min(col).alias("first_event_date"), F.max(col).alias("last_event_date"))


def null_counts(df: DataFrame, cols: Sequence[str] = NULL_CHECK_COLUMNS) -> DataFrame:
    """DQ2: null count per column, one pass, one row (``<col>_null``)."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in cols])


def stored_profile(spark: SparkSession, path: str, schema: StructType, dates: str = "event_date",
                   cols: Sequence[str] = NULL_CHECK_COLUMNS) -> DataFrame:
    """DQ1 and DQ2 of a stored Parquet table, from its file footers: first and last date, row count and
    null count per column (one row). The reader answers minimum, maximum and counts from the
    footers' statistics, so no row is read. Footers hold no bounds for strings; ``dates`` is a date or
    number. The result belongs to a session of its own, in which aggregates are pushed down."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    got = own.read.schema(schema).parquet(path).agg(
        F.min(dates).alias("first_event_date"), F.max(dates).alias("last_event_date"), F.count(F.lit(1)).alias("rows_"),
        *[F.count(c).alias(f"_{c}") for c in cols])
    # where no file has rows the reader gives nulls, in a column said to have none
    n = {c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(0)) for c in got.columns if c not in ("first_event_date", "last_event_date")}
    return got.select("first_event_date", "last_event_date", n["rows_"].alias("rows_"),
                      *[(n["rows_"] - n[f"_{c}"]).alias(f"{c}_null") for c in cols])


def users_by(df: DataFrame, dims: Sequence[str], user: str = "user_id",
             name: str = "users") -> DataFrame:
    """DQ3: distinct users per combination of ``dims`` (exact distinct count), in their order."""
    return df.groupBy(*dims).agg(F.count_distinct(user).alias(name)).orderBy(*dims)


def event_combinations(df: DataFrame) -> DataFrame:
    """DQ4: rows per event_name × action × page_type; nulls form their own groups."""
    keys = ["event_name", "action", "page_type"]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count")).orderBy(*keys)


def cross_exposed(df: DataFrame, user: str = "user_id", cohort: str = "cohort") -> DataFrame:
    """DQ5: users seen in more than one cohort, with the number of cohorts."""
    return (df.groupBy(user).agg(F.count_distinct(cohort).alias("cohort_count"))
              .filter(F.col("cohort_count") > 1))


def _same_second(df: DataFrame, ts: str = "event_datetime") -> DataFrame:
    return df.withColumn("_sec", epoch_seconds(ts))


def simultaneous_users(df: DataFrame, user: str = "user_id",
                       ts: str = "event_datetime") -> DataFrame:
    """Users with two consecutive events 0 s apart (same second), as a key list.

    Consecutive events share a second exactly when some second holds two events of the user,
    so this is a grouping on (user, second): partial aggregation, no window over the user.
    An event without a time is 0 s from nothing.
    """
    return (_same_second(df.filter(F.col(ts).isNotNull()), ts).groupBy(user, "_sec").agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > 1).select(user).distinct())


def events_of_simultaneous_users(df: DataFrame, user: str = "user_id",
                                 ts: str = "event_datetime") -> DataFrame:
    """DQ6: every row of the users above (a semi join: duplicates stay, none are added)."""
    return df.join(simultaneous_users(df, user, ts), on=user, how="left_semi")  # null users match none, as with IN


def simultaneous_pairs(df: DataFrame, user: str = "user_id", ts: str = "event_datetime",
                       **slice_opts) -> DataFrame:
    """DQ7: frequency of (event, previous event) pairs 0 s apart, counting each distinct
    (user, date, event, time, previous time, previous event) once.

    Order within a user: (time, event_id, event_name, event_date). Exact copies collapse
    first (partial aggregation, before any shuffle); a copy's predecessor is its twin. The
    previous event comes from the skew-safe per-user sequence, so neither a hot user nor a
    burst within one second is processed as one group (``slice_opts``: rows_per_slice,
    max_hot_users, slicing).
    """
    keys = [user, ts, "event_id", "event_name", "event_date"]
    red = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    seq = TL.sequence(red, user=user, ts=ts, tiebreak=("event_id", "event_name", "event_date"),
                      carry=("event_name",), profile=df.select(user, ts), **slice_opts)
    after_other = seq.filter(F.col("date_diff_seconds") == 0).select(
        user, "event_date", "event_name", ts, F.col("prev_ts").alias("last_event_time"),
        F.col("prev_event_name").alias("last_event"))
    after_twin = seq.filter((F.col("_m") > 1) & F.col(ts).isNotNull()).select(
        user, "event_date", "event_name", ts, F.col(ts).alias("last_event_time"),
        F.col("event_name").alias("last_event"))
    pairs = after_other.unionByName(after_twin).distinct()
    out = pairs.groupBy("event_name", "last_event").agg(F.count(F.lit(1)).alias("frequency"))
    return out.orderBy(F.desc("frequency"), "event_name", "last_event")


def row_digest(key: Sequence[str], seed: int) -> Column:
    """64-bit digest of the columns; which of them are null counts too."""
    cols = [F.col(c) for c in key]
    return F.xxhash64(F.lit(seed), *[c.isNull() for c in cols], *cols)


def duplicate_histogram(df: DataFrame, key: Sequence[str] = P.RAW_KEY, exact: bool = False) -> DataFrame:
    """DQ8: groups of identical key tuples with more than one row, counted per multiplicity.

    Rows are grouped by a 128-bit digest of the key, so 16 bytes a row are shuffled in place of a
    dozen columns. A third digest checks every group: two tuples of one digest would end the
    query with an error, never in a wrong count; ``exact`` groups by the columns themselves.
    """
    n = F.count(F.lit(1)).alias("dups_flg")
    if exact:
        g = df.groupBy(*key).agg(n)
    else:
        x = df.select(*[row_digest(key, k).alias(f"_{k}") for k in range(3)])
        g = x.groupBy("_0", "_1").agg(n, F.min("_2").alias("_lo"), F.max("_2").alias("_hi"))
        fail = F.raise_error(F.lit("two rows share a digest: use exact=True")).cast("long")
        g = g.select(F.when(F.col("_lo") == F.col("_hi"), F.col("dups_flg")).otherwise(fail).alias("dups_flg"))
    return g.filter(F.col("dups_flg") > 1).groupBy("dups_flg").agg(F.count(F.lit(1)).alias("groups"))


def staging_profile(df: DataFrame, col: str = "release_version",
                    marker: str = P.STAGING_MARKER) -> DataFrame:
    """DQ9: users and rows on test builds; no row when there are none."""
    return (df.filter(F.col(col).contains(marker)).groupBy(F.lit(1).alias("release_version"))
              .agg(F.count_distinct("user_id").alias("users"),
                   F.count(F.lit(1)).alias("rows_")))


def landing_events(df: DataFrame, user: str = "user_id", ts: str = "event_datetime") -> DataFrame:
    """DQ11: each user's first event label (by time, then event_id), counted per label.

    ``min_by`` per user is a partial aggregation: no window, no per-user task.
    """
    first = df.groupBy(user).agg(
        F.min_by(event_label(), F.struct(F.col(ts), F.col("event_id"))).alias("event"))
    return first.groupBy("event").agg(F.count(F.lit(1)).alias("occur")).orderBy(F.desc("occur"), "event")


def lookup_coverage(df: DataFrame, lookup: DataFrame, country: str = "ip_country") -> DataFrame:
    """DQ12: distinct countries; how many the lookup knows (and with a usable zone); the
    missing ones as a sorted comma list, null when none is missing. Countries are reduced to distinct values first."""
    c = df.select(F.col(country).alias("_c")).filter(F.col("_c").isNotNull()).distinct()
    z = zone_lookup(lookup)
    j = c.join(z, F.col("_c") == F.col("_lk_country"), "left")
    found = F.col("_lk_country").isNotNull()
    return j.agg(
        F.count(F.lit(1)).alias("countries"),
        F.count_if(found).alias("countries_in_lookup"),
        F.count_if(F.col("_lk_zone").isNotNull()).alias("countries_with_zone"),
        F.expr("listagg(CASE WHEN _lk_country IS NULL THEN _c END, ', ') WITHIN GROUP (ORDER BY CASE WHEN _lk_country IS NULL THEN _c END)")
        .alias("missing_countries"))
