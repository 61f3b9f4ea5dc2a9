"""Cleaning and sessionizing (CL1–CL9).

Order of application (see SURVEY §2.8 #4): drop staging builds → drop exact duplicates →
drop cross-exposed users → attach local time → gaps → sessions → drop multi-country sessions.
Gaps and ordering use the UTC instant; local time is only used for dates and labels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import params as P
from cohortlens.functions.columns import event_label, local_time, zone_or_default
from cohortlens.operators import timeline as TL
from cohortlens.sources import sinks

CLEAN_COLUMNS = [
    "session_id", "user_id", "cohort", "event_date", "event_name", "action", "page_type",
    "event_datetime", "timezone", "ip_country", "platform", "login_status", "app_language",
    "release_version", "date_diff_seconds",
]
# kept beside the public columns: ordering downstream, and the user key whose partitioning
# the session groupings reuse
INTERNAL_COLUMNS = ["event_id", "event_ts", "session_no", "_uk"]
#: Part of a split user's timeline in UTC order (0 for other users): long sessions are put together
#: from their parts, and stored tables are laid out by it.
PIECE = "_piece"


def in_pieces(clean: DataFrame) -> bool:
    """May some user's events be in several parts? Not where the sequence found no user to split."""
    return PIECE in clean.columns and clean.schema[PIECE].metadata != TL.WHOLE


def drop_staging(df: DataFrame, col: str = "release_version",
                 marker: str = P.STAGING_MARKER) -> DataFrame:
    """CL1: drop test builds. A null version is dropped too (``not like`` on null is null)."""
    return df.filter(~F.col(col).contains(marker))


def dedup_exact(df: DataFrame, key: Sequence[str] = P.RAW_KEY, keep: str = "event_id") -> DataFrame:
    """CL3: one row per identical key tuple, keeping the smallest ``keep`` value.

    A grouping, so partial aggregation collapses copies before the shuffle: a group of copies
    holding a large share of all rows costs one row per map task, not a hot partition.
    """
    extra = [c for c in (TL.UKEY, TL.HOT, TL.SLICE) if c in df.columns]
    return df.groupBy(*key, *extra).agg(F.min(keep).alias(keep))


def cohort_mixed_users(df: DataFrame, user: str = "user_id", cohort: str = "cohort") -> DataFrame:
    """Users seen in two or more (non-null) cohorts, as a key list (partial aggregation)."""
    return (df.groupBy(user).agg(F.min(cohort).alias("_lo"), F.max(cohort).alias("_hi"))
              .filter(F.col("_hi") > F.col("_lo")).select(user))


def drop_cross_exposed(df: DataFrame, user: str = "user_id", cohort: str = "cohort") -> DataFrame:
    """CL4: keep users with fewer than two distinct cohorts (null cohorts do not count; null
    users are one group, as in the windows of CL8).

    Anti join against the per-user aggregate; AQE splits a skewed user's partition.
    """
    mixed = cohort_mixed_users(df, user, cohort).select(F.struct(F.col(user)).alias("_mixed_user"))
    return df.join(mixed, F.struct(F.col(user)) == F.col("_mixed_user"), "left_anti")


def zone_lookup(lookup: DataFrame, country: str = "country", zone: str = "timezone") -> DataFrame:
    """One trimmed zone per country (a country listed twice cannot fan rows out)."""
    return lookup.groupBy(F.col(country).alias("_lk_country")).agg(
        F.min(F.nullif(F.trim(F.col(zone)), F.lit(""))).alias("_lk_zone"))


def localize(df: DataFrame, lookup: DataFrame, country: str = "ip_country",
             ts: str = "event_datetime") -> DataFrame:
    """CL2: attach the country's zone; local ``event_datetime`` / ``event_date``.

    The UTC instant is kept as ``event_ts``. The lookup is tiny (one row per country), so the
    planner broadcasts it under the size threshold; no shuffle of the events.
    """
    z = zone_lookup(lookup)
    j = df.join(z, F.col(country) == F.col("_lk_country"), "left")
    zone = zone_or_default("_lk_zone")
    local = local_time(F.col(ts), zone)
    return (j.withColumns({"timezone": zone, "event_ts": F.col(ts), "event_datetime": local,
                           "event_date": F.to_date(local)})
             .drop("_lk_country", "_lk_zone"))


def session_id(user: str = "user_id", number: str = "session_no", sep: str = "#"):
    """Hex md5 of user ‖ sep ‖ number; ``sep=''`` reproduces the separator-less key."""
    return F.md5(F.concat(F.col(user).cast("string"), F.lit(sep), F.col(number).cast("string")))


def deduplicated(raw: DataFrame, materialize: bool = True) -> DataFrame:
    """CL1 + CL3, written once when ``materialize`` (it feeds several consumers)."""
    dd = dedup_exact(drop_staging(raw))
    return sinks.materialize(dd, "dedup") if materialize else dd


def build_base(raw: DataFrame, materialize: bool = True) -> DataFrame:
    """CL1 + CL3 + CL4: the cleaned events before sessionizing (raw columns + event_id)."""
    base = drop_cross_exposed(deduplicated(raw, materialize))
    return sinks.materialize(base, "base") if materialize else base


def profile_base(raw: DataFrame) -> DataFrame:
    """CL1 + CL4 as event rows, for answers that exact duplicates cannot change. Where an answer needs
    only users and a few values, ``profile.kept_values`` shuffles those instead of events."""
    return drop_cross_exposed(drop_staging(raw))


def _checked(raw: DataFrame, lookup: DataFrame, gap_seconds: int, gap_basis: str, **slice_opts) -> DataFrame:
    """CL1–CL6 with the flags of CL4 (``cohort_user_mixed``) and CL7 (``ip_country_mixed``), and PIECE."""
    if gap_basis not in ("utc", "local"):
        raise ValueError("gap_basis must be 'utc' or 'local'")
    kept = drop_staging(raw)
    prof = kept.select("user_id", F.col("event_datetime").alias("event_ts"))
    checks = dict(single_valued=("ip_country",), user_single_valued=("cohort",))
    opts = dict(user="user_id", tiebreak=("event_id",), gap_seconds=gap_seconds, profile=prof, **slice_opts)

    def prepare(x: DataFrame) -> DataFrame:
        return localize(dedup_exact(x), lookup)

    if gap_basis == "utc":
        x = TL.sequence(kept, ts="event_ts", prepare=prepare, **opts, **checks)
        return x.withColumn(PIECE, F.col(TL.SLICE))
    x = TL.sequence(kept, ts="event_ts", prepare=prepare, gap_col="event_datetime", **opts)
    x = x.withColumn(PIECE, F.col(TL.SLICE))  # the second pass slices by local time
    opts["profile"] = prof.withColumnRenamed("event_ts", "event_datetime")
    return TL.sequence(x.drop("session_no", TL.HOT, TL.SLICE), ts="event_datetime",
                       gap_values="date_diff_seconds", **opts, **checks)


def build_clean_events(raw: DataFrame, lookup: DataFrame, *,
                       gap_seconds: int = P.SESSION_GAP_SECONDS, sep: str = "#",
                       internal: bool = True, gap_basis: str = "utc", **slice_opts) -> DataFrame:
    """CL8: CL1–CL7 in order, skew-safe (``slice_opts``: rows_per_slice, max_hot_users, slicing).

    Event rows are exchanged once, on the user key; the dedupe grouping, the sequence windows,
    cross-exposure (CL4) and the multi-country rule (CL7) all work within that partitioning.
    Hot users are found on a narrow scan of (user, time) of the input and split off first; their
    rows are deduplicated by a grouping on the whole key (copies collapse before the shuffle)
    and sliced in time.

    ``gap_basis='local'`` is the analysed pipeline's own rule: gaps are differences of local
    wall-clock times (wrong or negative across zones and DST) of events in UTC order, and the
    running session count follows local time.
    """
    x = _checked(raw, lookup, gap_seconds, gap_basis, **slice_opts)
    x = x.filter(~F.col("cohort_user_mixed") & ~F.col("ip_country_mixed"))
    cols = [session_id(sep=sep).alias("session_id")] + CLEAN_COLUMNS[1:]
    return x.select(*cols, *([*INTERNAL_COLUMNS, PIECE] if internal else []))


def session_trace(base: DataFrame, lookup: DataFrame, *,
                  gap_seconds: int = P.SESSION_GAP_SECONDS, **slice_opts) -> DataFrame:
    """DQ10: per event local date/time, label, previous label and time, gap, running session.

    ``select distinct`` as in the profiling query; ordering by (UTC time, event_id).
    """
    x = localize(base, lookup).withColumn("event", event_label())
    x = TL.sequence(x, user="user_id", ts="event_ts", tiebreak=("event_id",),
                    gap_seconds=gap_seconds, carry=("event", "event_datetime"), **slice_opts)
    return _trace(x)


def trace_raw(raw: DataFrame, lookup: DataFrame, *,
              gap_seconds: int = P.SESSION_GAP_SECONDS, **slice_opts) -> DataFrame:
    """DQ10 from raw events: CL1, CL3 and CL4 within the sequence's one exchange on the user key, as in
    ``build_clean_events``; no table of cleaned events is written first."""
    kept = drop_staging(raw)
    x = TL.sequence(kept, user="user_id", ts="event_ts", tiebreak=("event_id",), gap_seconds=gap_seconds,
                    carry=("event", "event_datetime"), user_single_valued=("cohort",),
                    profile=kept.select("user_id", F.col("event_datetime").alias("event_ts")),
                    prepare=lambda e: localize(dedup_exact(e), lookup).withColumn("event", event_label()), **slice_opts)
    return _trace(x.filter(~F.col("cohort_user_mixed")))


def _trace(x: DataFrame) -> DataFrame:
    cols = ["user_id", "event_date", "event", "event_datetime",
            F.col("prev_event_datetime").alias("last_event_time"),
            F.col("prev_event").alias("last_event"), "date_diff_seconds", "session_no"]
    # the user key is a function of the user: with it the grouping reuses the sequence's
    # partitioning instead of shuffling the wide rows again
    out = x.select(TL.UKEY, *cols).groupBy(TL.UKEY, "user_id", "event_date", "event", "event_datetime",
                                           "last_event_time", "last_event", "date_diff_seconds", "session_no").agg(F.count(F.lit(1)).alias("_n"))
    return out.drop(TL.UKEY, "_n")


def reconcile(stages: Mapping[str, DataFrame], user: str = "user_id") -> DataFrame:
    """CL9: users and rows per pipeline stage, one row per stage."""
    out = None
    for name, df in stages.items():
        row = df.agg(F.count_distinct(user).alias("total_users"),
                     F.count(F.lit(1)).alias("rows_")).select(
            F.lit(name).alias("table_name"), "total_users", "rows_")
        out = row if out is None else out.unionByName(row)
    return out


def reconcile_chain(raw: DataFrame, lookup: DataFrame, *, gap_seconds: int = P.SESSION_GAP_SECONDS,
                    gap_basis: str = "utc", names: Sequence[str] = ("Base Clean", "Base Clean 2", "Base Original"),
                    **slice_opts) -> DataFrame:
    """CL9 of the whole chain: users and rows after CL4, after CL7, and of the raw events. The first two
    are counts over one pass of the sequence, per user on its own partitioning and then in total."""
    x = _checked(raw, lookup, gap_seconds, gap_basis, **slice_opts)
    base = ~F.col("cohort_user_mixed")
    users = x.groupBy(TL.UKEY, "user_id").agg(F.count_if(base).alias("_0"), F.count_if(base & ~F.col("ip_country_mixed")).alias("_1"))
    whole = raw.groupBy("user_id").agg(F.count(F.lit(1)).alias("_2"))
    known = F.col("user_id").isNotNull()

    def totals(of: DataFrame, stages: dict[str, str]) -> DataFrame:
        sums = of.agg(*[F.struct(F.lit(n).alias("table_name"), F.count_if(known & (F.col(c) > 0)).alias("total_users"),
                                 F.coalesce(F.sum(c), F.lit(0)).alias("rows_")).alias(c) for c, n in stages.items()])
        return sums.select(F.inline(F.array(*stages)))

    return totals(users, {"_0": names[0], "_1": names[1]}).unionByName(totals(whole, {"_2": names[2]}))
