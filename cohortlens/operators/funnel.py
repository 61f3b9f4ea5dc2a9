"""Sessions, per-session funnel flags and the daily funnel report."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import params as P
from cohortlens.functions.columns import event_label, seconds_between
from cohortlens.operators.cleaning import PIECE, in_pieces
from cohortlens.sources.sinks import materialize

SESSION_KEY = ["cohort", "user_id", "session_id", "ip_country", "timezone"]
SESSIONS_KEY = ["cohort", "user_id", "session_id", "app_language", "ip_country",
                "release_version", "timezone"]
UKEY = "_uk"


def _by_session(clean: DataFrame, key: list[str]):
    """Group by ``key``, plus the user key when present: it is a function of user_id, so the
    grouping is unchanged, and the events' partitioning on it (from the sequence windows)
    satisfies the grouping without another exchange."""
    extra = [UKEY] if UKEY in clean.columns else []
    return clean.groupBy(*extra, *key)


def build_sessions(clean: DataFrame, sep: str = P.SEQ_SEPARATOR) -> DataFrame:
    """One row per session × language × country × version × zone.

    Dates and first/last times are local; the duration counts second boundaries between the
    first and last UTC instants (DST-proof). ``session_seq`` joins event labels in time order.

    Where the events carry the parts of split users' timelines (``_piece``), labels are joined in
    two levels: per part, a task's share of bounded rows, then the parts' strings in their order.
    So an endless session of one user is sorted and joined by many tasks; the last one only
    chains as many strings as the session has parts.
    """
    x = clean.withColumn("_label", event_label())
    piece = [PIECE] if in_pieces(clean) else []
    parts = _by_session(x, [*piece, *SESSIONS_KEY]).agg(
        F.min("event_date").alias("session_start_date"),
        F.max("event_date").alias("session_end_date"),
        F.min("event_datetime").alias("first_datetime"),
        F.max("event_datetime").alias("last_datetime"),
        F.min("event_ts").alias("_from"), F.max("event_ts").alias("_to"),
        _joined("_label", sep, "event_ts, event_id").alias("session_seq"))
    if piece:
        parts = _by_session(parts, SESSIONS_KEY).agg(
            F.min("session_start_date").alias("session_start_date"),
            F.max("session_end_date").alias("session_end_date"),
            F.min("first_datetime").alias("first_datetime"),
            F.max("last_datetime").alias("last_datetime"),
            F.min("_from").alias("_from"), F.max("_to").alias("_to"),
            _joined("session_seq", sep, PIECE).alias("session_seq"))
    return parts.select(*SESSIONS_KEY, "session_start_date", "session_end_date", "first_datetime", "last_datetime",
                        seconds_between("_from", "_to").alias("session_duration_seconds"), "session_seq")


def _joined(col: str, sep: str, order: str) -> Column:
    return F.expr(f"listagg({col}, '{sep}') WITHIN GROUP (ORDER BY {order})")


def build_session_starts(clean: DataFrame) -> DataFrame:
    """R2a (step 1): every session with a session id: events, start/end date, duration."""
    return _by_session(clean.filter(F.col("session_id").isNotNull()), SESSION_KEY).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("event_date").alias("session_start_date"),
        F.max("event_date").alias("session_end_date"),
        seconds_between(F.min("event_ts"), F.max("event_ts")).alias("session_duration_seconds")
    ).drop(UKEY)


def ghost_flags(steps: Sequence[P.FunnelStep] = P.FUNNEL_STEPS) -> list[Column]:
    """Per step 1 = seen, 2 = not seen but a later step was, 0 = neither; last step 0/1.

    Generated from the ordered step list; a step's presence is a non-null event count.
    """
    out = []
    for i, s in enumerate(steps):
        seen = F.col(s.count_col).isNotNull()
        later = [F.col(t.count_col).isNotNull() for t in steps[i + 1:]]
        flag = F.when(seen, F.lit(1))
        if later:
            any_later = later[0]
            for c in later[1:]:
                any_later = any_later | c
            flag = flag.when(any_later, F.lit(2))
        out.append(flag.otherwise(F.lit(0)).alias(s.flag_col))
    return out


def build_session_funnel(clean: DataFrame,
                         steps: Sequence[P.FunnelStep] = P.FUNNEL_STEPS) -> DataFrame:
    """R2 + R3 + R4: per session, event counts per funnel step (null when absent) and flags.

    One grouping with conditional counts replaces six scans and five joins; all aggregates are
    partial, so a huge session costs one row per map task before the shuffle. A session with
    null countries or cohorts beside others has several key rows; counts and flags are facts of
    the session, so each of its rows carries the session's (a window over the few key rows, on
    the same partitioning). Where the joins would repeat a row for a step seen under two keys,
    there is one row here.
    """
    counts = [F.nullif(F.count_if(s.predicate()), F.lit(0)).alias(s.count_col) for s in steps]
    g = _by_session(clean.filter(F.col("session_id").isNotNull()), SESSION_KEY).agg(
        F.min("event_date").alias("session_start_date"),
        F.max("event_date").alias("session_end_date"),
        seconds_between(F.min("event_ts"), F.max("event_ts")).alias("session_duration_seconds"),
        *counts)
    whole = Window.partitionBy(*([UKEY] if UKEY in g.columns else []), "user_id", "session_id")
    g = g.withColumns({s.count_col: F.sum(s.count_col).over(whole) for s in steps})
    return g.select(*SESSION_KEY, "session_start_date", "session_end_date",
                    "session_duration_seconds", *[s.count_col for s in steps], *ghost_flags(steps))


def _reached_steps(session_funnel: DataFrame, report_steps) -> DataFrame:
    """One row (``_s``: step_id, step, _ev) per session row and report step it reaches."""
    elems = []
    for step_id, label, flag, rule, count_col in report_steps:
        ev = F.lit(0).cast("long") if count_col is None else F.col(count_col).cast("long")
        e = F.struct(F.lit(step_id).alias("step_id"), F.lit(label).alias("step"),
                     ev.alias("_ev"))
        if flag is None:
            elems.append(e)
        else:
            cond = F.col(flag) > F.lit(0) if rule == "any" else F.col(flag) == F.lit(1)
            elems.append(F.when(cond, e))
    return session_funnel.select(
        "session_start_date", "cohort", "ip_country", "timezone", "user_id", "session_id",
        "session_duration_seconds", *[c for c in ("_no",) if c in session_funnel.columns],
        F.explode(F.filter(F.array(*elems), lambda e: e.isNotNull())).alias("_s"))


def build_funnel_report(session_funnel: DataFrame, experiment: str = P.EXPERIMENT,
                        report_steps=P.REPORT_STEPS, unique_sessions: bool = False) -> DataFrame:
    """Per step × start date × cohort × country × zone: events, users, sessions, duration.

    Each session emits one element per step it reaches (``F.explode``), so the seven-branch
    union becomes one scan and one grouping. With ``unique_sessions`` (session ids cannot
    repeat across users, true for a non-empty key separator) sessions are counted directly,
    leaving one distinct count (users) and no Expand of the rows before the shuffle.
    """
    x = _reached_steps(session_funnel, report_steps)
    return (x.groupBy(F.col("_s.step_id").alias("step_id"), F.col("_s.step").alias("step"),
                      "session_start_date", F.lit(experiment).alias("experiment"), "cohort",
                      "ip_country", "timezone")
             .agg(F.sum("_s._ev").alias("event_count"),
                  F.count_distinct("user_id").alias("users"),
                  (F.count(F.lit(1)) if unique_sessions else F.count_distinct("session_id"))
                  .alias("sessions"),
                  F.sum("session_duration_seconds").alias("total_session_duration")))


def numbered_users(session_funnel: DataFrame) -> DataFrame:
    """(user_id, _no): the distinct users, numbered without gaps. A number is the place in a written
    partition plus the users of the partitions before; only those counts, one per partition, pass
    the driver."""
    x = session_funnel.select("user_id").filter(F.col("user_id").isNotNull()).distinct()
    x = materialize(x.withColumn("_at", F.monotonically_increasing_id()), "user_numbers")
    x = x.withColumn("_part", F.shiftright("_at", 33))
    sizes = sorted(x.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before = itertools.accumulate((r["n"] for r in sizes), initial=0)
    offsets = x.sparkSession.createDataFrame([(r["_part"], b) for r, b in zip(sizes, before)], "_part long, _before long")
    x = x.join(F.broadcast(offsets), "_part")  # one row per partition
    return x.select("user_id", (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("_no"))


def report_bitmaps(session_funnel: DataFrame, experiment: str = P.EXPERIMENT, report_steps=P.REPORT_STEPS) -> DataFrame:
    """R5 in a form that rolls up: per step × start date × cohort × country × zone, and per ``bucket``
    of user numbers, the users as a bitmap beside sums of events, session rows and durations.

    Distinct users cannot be added over dates or countries, bitmaps can (``roll_up``), exactly.
    Rows of sessions without a user have a null bucket.
    """
    x = session_funnel.join(numbered_users(session_funnel), "user_id", "left")
    x = _reached_steps(x, report_steps)
    return (x.groupBy(F.col("_s.step_id").alias("step_id"), F.col("_s.step").alias("step"), "session_start_date",
                      F.lit(experiment).alias("experiment"), "cohort", "ip_country", "timezone",
                      F.bitmap_bucket_number("_no").alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_no")).alias("users"),
                  F.sum("_s._ev").alias("event_count"), F.count(F.lit(1)).alias("sessions"),
                  F.sum("session_duration_seconds").alias("total_session_duration")))


def roll_up(bitmaps: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The report of ``report_bitmaps`` over ``dims`` (any of its dimensions): exact distinct users, and
    sums; ``sessions`` counts session rows, which differ from sessions where one has several keys."""
    per_bucket = bitmaps.groupBy(*dims, "bucket").agg(
        F.bitmap_or_agg("users").alias("users"), *[F.sum(c).alias(c) for c in ("event_count", "sessions", "total_session_duration")])
    users = F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("users")).otherwise(0))
    return per_bucket.groupBy(*dims).agg(users.alias("users"), *[F.sum(c).alias(c) for c in ("event_count", "sessions", "total_session_duration")])


def conversion_rates(session_funnel: DataFrame) -> DataFrame:
    """Per cohort, of sessions that reached search activation (flag > 0): share that
    reached results (step 4 > 0), a property page (step 5 > 0) and a booking (step 6 = 1)."""
    x = session_funnel.filter(F.col("step_2_flg") > 0)
    n = F.count(F.lit(1))
    res = F.count_if(F.col("step_4_flg") > 0)
    prop = F.count_if(F.col("step_5_flg") > 0)
    book = F.count_if(F.col("step_6_flg") == 1)
    g = x.groupBy("cohort").agg(n.alias("sessions"), res.alias("results_sessions"),
                                prop.alias("property_sessions"), book.alias("booking_sessions"))
    return g.select("cohort", "sessions", "results_sessions", "property_sessions",
                    "booking_sessions",
                    (F.col("results_sessions") / F.col("sessions")).alias("results_rate"),
                    (F.col("property_sessions") / F.col("sessions")).alias("property_rate"),
                    (F.col("booking_sessions") / F.col("sessions")).alias("booking_rate"))


def searches_per_searcher(session_funnel: DataFrame,
                          count_col: str = "event_count_Search_Act") -> DataFrame:
    """R7a (documented primary metric): per cohort, mean search activations per user with at
    least one. Two partial aggregations: per user, then per cohort."""
    per_user = (session_funnel.groupBy("cohort", "user_id")
                .agg(F.sum(count_col).alias("_n")).filter(F.col("_n") > 0))
    return per_user.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("searchers"), F.sum("_n").alias("events"),
        (F.sum("_n") / F.count(F.lit(1))).alias("per_searcher"))


def submits_per_searcher(session_funnel: DataFrame) -> DataFrame:
    """R7b (what the significance step computes): Search Submitted events per distinct user
    over sessions with step 3 seen (flag = 1), among sessions with step 2 reached."""
    x = session_funnel.filter((F.col("step_2_flg") > 0) & (F.col("step_3_flg") == 1))
    per_user = x.groupBy("cohort", "user_id").agg(F.sum("event_count_Search_Sub").alias("_n"))
    return per_user.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("searchers"), F.sum("_n").alias("events"),
        (F.sum("_n") / F.count(F.lit(1))).alias("per_searcher"))
