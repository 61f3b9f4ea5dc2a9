"""Per-user event sequences without a per-user task: previous event, gaps, inactivity sessions.

A window partitioned by user alone sends a user's whole history to one task. One user (a bot, a
load test, a shared device id) may hold a large share of all rows, so ``sequence``:

1. profiles rows per user (partial aggregation, one row per user) and keeps the users above
   max(rows_per_slice, total / max_hot_users) rows as "hot". That table has fewer than
   ``max_hot_users`` rows by construction, so it may be broadcast (with a larger bound than the
   default one, the planner decides by its size). If it is empty (the usual case) only step 2 is
   planned.
2. ordinary users: one exchange on the user key; lag, gaps, the running session count and the
   per-session / per-user value checks are windows over the user in one pass.
3. hot users: their rows are cut into slices of about ``rows_per_slice`` rows, equi-depth in
   (user, time, tiebreak) order (default) or equal-width in time; every
   window runs per (user, slice). A per-slice summary, computed on the same partitioning, is
   windowed per user to stitch the slices: the previous event across a border, session
   number offsets, and the value range of sessions that straddle borders. The summary is
   joined back on (user, slice), where the event side is already partitioned.

The results equal a plain ``Window.partitionBy(user).orderBy(ts, *tiebreak)`` computation
(checked against a brute-force scan in the tests).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import params as P
from cohortlens.functions.columns import epoch_micros, seconds_between
from cohortlens.sources import sinks

SLICE = "_slice"
UKEY = "_uk"  # struct(user): a non-null key under which null users still form one group
HOT = "_hot"
WHOLE = {"whole": True}  # metadata of a slice column that is 0 throughout: no user is split


def _ukey(user: str) -> Column:
    return F.struct(F.col(user).alias("u"))


def hot_users(df: DataFrame, ts: str, rows_per_slice: int = P.ROWS_PER_SLICE,
              max_hot_users: int = P.MAX_HOT_USERS) -> DataFrame:
    """Users to split, with slice origin ``_t0`` and width ``_w`` (µs). ``df`` has ``_uk``.

    A user is hot above max(rows_per_slice, total / max_hot_users) rows, so the result has
    fewer than ``max_hot_users`` rows: a proven bound for a broadcast (``_joinable``).
    """
    us = epoch_micros(ts)
    prof = df.groupBy(UKEY).agg(F.count(F.lit(1)).alias("_n"), F.min(us).alias("_t0"),
                                F.max(us).alias("_t1"))
    # one row per user, written once: the total and the filter read it, not the input again
    prof = sinks.materialize(prof, "user_profile")
    total = prof.agg(F.sum("_n")).first()[0] or 0
    threshold = max(rows_per_slice, total / max_hot_users)
    n_slices = F.ceil(F.col("_n") / F.lit(rows_per_slice))
    return prof.filter(F.col("_n") > threshold).select(
        F.col(UKEY).alias("_hot_uk"), "_n", "_t0",
        (F.floor((F.col("_t1") - F.col("_t0")) / n_slices) + F.lit(1)).alias("_w"))


def _joinable(hot: DataFrame, max_hot_users: int) -> DataFrame:
    """``hot`` as a join's side: broadcast under the default bound. A larger bound is no bound for the
    driver's memory, so the planner then goes by the table's size."""
    return F.broadcast(hot) if max_hot_users <= P.MAX_HOT_USERS else hot


def add_slices(df: DataFrame, user: str = "user_id", ts: str = "event_ts",
               rows_per_slice: int = P.ROWS_PER_SLICE, max_hot_users: int = P.MAX_HOT_USERS,
               hot: DataFrame | None = None) -> DataFrame:
    """Add ``_uk`` (user key), ``_hot`` (user is split) and ``_slice`` (time slice, else 0)."""
    if UKEY not in df.columns:
        df = df.withColumn(UKEY, _ukey(user))
    if hot is None:
        hot = hot_users(df, ts, rows_per_slice, max_hot_users)
    j = df.join(_joinable(hot.select("_hot_uk", "_t0", "_w"), max_hot_users),
                F.col(UKEY) == F.col("_hot_uk"), "left")
    us = epoch_micros(ts)
    return j.withColumns({
        HOT: F.col("_hot_uk").isNotNull(),
        SLICE: F.coalesce(F.floor((us - F.col("_t0")) / F.col("_w")), F.lit(0)).cast("long"),
    }).drop("_hot_uk", "_t0", "_w")


def rank_slices(df: DataFrame, ts: str, tiebreak: Sequence[str], hot: DataFrame,
                rows_per_slice: int = P.ROWS_PER_SLICE) -> DataFrame:
    """Equi-depth slices: rows of hot users with ``_slice``.

    The rows are range-partitioned and sorted on (user, time, *tiebreak) and cut at every
    ``rows_per_slice``-th row, so a slice's number increases along each user's timeline. A task
    cuts many slices where they are small: there are as many tasks as a shuffle has, more above
    ``ROWS_PER_SLICE`` rows a task, never more than slices. Bursts and same-instant tie groups
    are split too; rows equal in all of the key stay together. The rows are written once with
    their slice, so every consumer sees the same assignment.
    """
    n_hot = hot.agg(F.sum("_n")).first()[0] or 0
    slices = -(-n_hot // rows_per_slice)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_hot // P.ROWS_PER_SLICE))
    key = [F.col(UKEY), F.col(ts), *[F.col(c) for c in tiebreak]]
    x = df.repartitionByRange(max(1, min(slices, tasks)), *key).sortWithinPartitions(*key)
    # row numbers in that order (the task in the upper bits); the window finds its rows as sorted
    x = x.withColumn(SLICE, F.monotonically_increasing_id())
    first = F.min(SLICE).over(Window.partitionBy(*key))
    x = x.withColumns({HOT: F.lit(True), SLICE: first - first % F.lit(rows_per_slice)})
    return sinks.materialize(x, "hot_rows")


def sequence(df: DataFrame, *, user: str = "user_id", ts: str = "event_ts",
             tiebreak: Sequence[str] = ("event_id",), gap_seconds: int = P.SESSION_GAP_SECONDS,
             carry: Sequence[str] = (), single_valued: Sequence[str] = (),
             user_single_valued: Sequence[str] = (), gap_col: str | None = None,
             gap_values: str | None = None, rows_per_slice: int = P.ROWS_PER_SLICE,
             max_hot_users: int = P.MAX_HOT_USERS, slicing: str = "rank",
             profile: DataFrame | None = None,
             prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Per-user sequence columns, ordered by (ts, *tiebreak), null times first.

    ``profile`` (columns ``user`` and ``ts``) is what hot users are counted on; default
    ``df``. Any superset of ``df``'s rows works (counts are then upper bounds and the bound on
    the hot table still holds), e.g. a narrow scan of the input before deduplication.

    ``prepare`` turns rows of ``df`` (each user's rows together) into rows with ``ts``, e.g.
    deduplication and local time. It runs after hot users are split off and, for the others,
    after the one exchange on the user key, so its groupings can reuse that partitioning.

    Gaps are measured on ``gap_col`` (default ``ts``) between consecutive events in that order;
    e.g. local wall-clock times, which can run backwards across zones or DST. With
    ``gap_values`` the gaps are taken from that column instead and only the session columns are
    added: a running count in another order than the gaps'.

    Adds:
      ``prev_ts``            previous event time of the user, null for the first event
      ``date_diff_seconds``  second boundaries from ``prev_ts`` to ``ts`` (long)
      ``prev_<c>``           the previous event's value of each ``carry`` column
      ``session_no``         number of events up to this time whose gap is > ``gap_seconds`` or
                             null (a user's first event starts session 1; so does every event
                             next to a null time). Equal times share the number (RANGE frame),
                             as ``countif(...) over (order by ts)`` does.
      ``<v>_mixed``          for each ``single_valued`` column: the whole session holds two or
                             more distinct non-null values
      ``<u>_user_mixed``     for each ``user_single_valued`` column: the same over the user's
                             whole history
    Ordinary users take one windowed pass; only split ("hot") users go through the stitching
    of slices, with the same results. When no user is hot (checked with a one-row job on the
    per-user profile) only the plain pass is planned. ``slicing='time'`` cuts a hot user's
    timeline into equal-width slices (one shuffle of its rows); ``slicing='rank'`` into
    equi-depth slices by range partitioning (also splits bursts and tie groups; one more
    shuffle and a write of the hot rows). Keeps ``_uk``, ``_hot`` and ``_slice``.
    """
    if slicing not in ("time", "rank"):
        raise ValueError("slicing must be 'time' or 'rank'")
    kw = dict(ts=ts, tiebreak=tiebreak, gap_seconds=gap_seconds, carry=carry,
              single_valued=single_valued, user_single_valued=user_single_valued,
              gap_col=gap_col or ts, gap_values=gap_values)
    whole = {HOT: F.lit(False), SLICE: F.lit(0).cast("long")}
    if SLICE in df.columns:
        return (_sequence_plain(df.filter(~F.col(HOT)), **kw)
                .unionByName(_sequence_sliced(df.filter(F.col(HOT)), **kw)))
    if UKEY not in df.columns:
        df = df.withColumn(UKEY, _ukey(user))
    prof_src = df if profile is None else profile.withColumn(UKEY, _ukey(user))
    hot = sinks.materialize(hot_users(prof_src, ts, rows_per_slice, max_hot_users), "hot_users")
    ready = (lambda x: prepare(x.repartition(UKEY))) if prepare else (lambda x: x)
    if hot.isEmpty():
        return _sequence_plain(ready(df).withColumns(whole).withMetadata(SLICE, WHOLE), **kw)
    keys, on = _joinable(hot.select("_hot_uk"), max_hot_users), F.col(UKEY) == F.col("_hot_uk")
    plain = ready(df.join(keys, on, "left_anti")).withColumns(whole)
    rows = df.join(keys, on, "left_semi")
    rows = prepare(rows) if prepare else rows
    if slicing == "rank":
        rows = rank_slices(rows, ts, tiebreak, hot, rows_per_slice)
    else:
        rows = add_slices(rows, user, ts, max_hot_users=max_hot_users, hot=hot)
    return _sequence_plain(plain, **kw).unionByName(_sequence_sliced(rows, **kw))


def _windows(ts: str, tiebreak: Sequence[str]):
    part = [UKEY, SLICE]
    order = [F.col(ts)] + [F.col(c) for c in tiebreak]
    return part, order, Window.partitionBy(*part).orderBy(*order), \
        Window.partitionBy(*part).orderBy(F.col(ts))


def _is_start(gap: Column, gap_seconds: int) -> Column:
    return gap.isNull() | (gap > F.lit(gap_seconds))


def _mixed(v: str, w) -> Column:
    return F.coalesce(F.max(v).over(w) > F.min(v).over(w), F.lit(False))


def _sequence_plain(df: DataFrame, *, ts, tiebreak, gap_seconds, carry, single_valued,
                    user_single_valued, gap_col, gap_values) -> DataFrame:
    """Users in one slice: every result is a window over the user, in one pass."""
    part, _, w_row, w_rng = _windows(ts, tiebreak)
    gap = gap_values or "date_diff_seconds"
    cols = {}
    if gap_values is None:
        prev = F.lag(ts).over(w_row)
        prev_g = prev if gap_col == ts else F.lag(gap_col).over(w_row)
        cols = {"prev_ts": prev, "date_diff_seconds": seconds_between(prev_g, gap_col)}
    cols.update({f"prev_{c}": F.lag(c).over(w_row) for c in carry})
    x = df.withColumns(cols) if cols else df
    starts = F.count_if(_is_start(F.col(gap), gap_seconds)).over(w_rng)
    x = x.withColumn("session_no", starts.cast("long"))
    w_sess = Window.partitionBy(*part, "session_no")
    w_user = Window.partitionBy(*part)
    cols = {f"{v}_mixed": _mixed(v, w_sess) for v in single_valued}
    cols.update({f"{u}_user_mixed": _mixed(u, w_user) for u in user_single_valued})
    return x.withColumns(cols) if cols else x


def _sequence_sliced(df: DataFrame, *, ts, tiebreak, gap_seconds, carry, single_valued,
                     user_single_valued, gap_col, gap_values) -> DataFrame:
    """Split users: windows per (user, slice), then a per-slice summary stitches the slices.

    A slice's first row is known by its row number, not by a missing predecessor, so null times
    and values pass through as in the plain path. A group of equal times cut by a border counts
    the starts of its later part too (``_extra``), as the RANGE frame does.
    """
    part, order, w_row, w_rng = _windows(ts, tiebreak)
    inner = {"_rn": F.row_number().over(w_row), "_pt": F.lag(ts).over(w_row), "_pg": F.lag(gap_col).over(w_row)}
    inner.update({f"_p_{c}": F.lag(c).over(w_row) for c in carry})
    x = df.withColumns(inner)
    gap_in = F.col(gap_values) if gap_values else seconds_between("_pg", gap_col)
    start_in = (F.col("_rn") > 1) & _is_start(gap_in, gap_seconds)
    x = x.withColumn("_local", F.count_if(start_in).over(w_rng))

    # per-slice summary, on the same partitioning as x (no exchange)
    at = F.struct(*order)
    aggs = [F.min_by(F.col(ts), at).alias("_first_ts"), F.max_by(F.col(ts), at).alias("_last_ts"),
            F.min_by(F.col(gap_values or gap_col), at).alias("_first_g"),
            F.max_by(F.col(gap_col), at).alias("_last_g"),
            F.min("_local").alias("_head"), F.max("_local").alias("_n")]
    aggs += [F.max_by(F.col(c), at).alias(f"_last_{c}") for c in carry]
    for u in user_single_valued:
        aggs += [F.min(u).alias(f"_ulo_{u}"), F.max(u).alias(f"_uhi_{u}")]
    st = x.groupBy(*part).agg(*aggs)

    # stitch: windows over the summary, per user
    wu = Window.partitionBy(UKEY).orderBy(SLICE)
    w_user = Window.partitionBy(UKEY)
    cols = {"_follows": F.lag(F.lit(1)).over(wu).isNotNull(), "_q_ts": F.lag("_last_ts").over(wu),
            "_q_g": F.lag("_last_g").over(wu)}
    cols.update({f"_q_{c}": F.lag(f"_last_{c}").over(wu) for c in carry})
    cols.update({f"_umx_{u}": F.coalesce(F.max(f"_uhi_{u}").over(w_user)
                                         > F.min(f"_ulo_{u}").over(w_user), F.lit(False))
                 for u in user_single_valued})
    st = st.withColumns(cols)
    first_gap = F.col("_first_g") if gap_values else seconds_between("_q_g", "_first_g")
    fs = F.when(F.col("_follows") | F.lit(gap_values is not None), _is_start(first_gap, gap_seconds)).otherwise(True)
    st = st.withColumn("_fs", fs.cast("long"))
    before = F.sum(F.col("_fs") + F.col("_n")).over(wu.rowsBetween(Window.unboundedPreceding, -1))
    # starts at a slice's first instant, there and in the slices after it that begin with it
    w_tie = (Window.partitionBy(UKEY, F.struct("_first_ts")).orderBy(SLICE)
             .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    st = st.withColumns({"_base": F.coalesce(before, F.lit(0)) + F.col("_fs"),
                         "_tie": F.sum(F.col("_fs") + F.col("_head")).over(w_tie)})
    goes_on = F.lead(F.struct("_first_ts")).over(wu) == F.struct(F.col("_last_ts").alias("_first_ts"))
    st = st.withColumn("_extra", F.when(goes_on, F.lead("_tie").over(wu)).otherwise(F.lit(0)))
    one_instant = F.col("_first_ts").eqNullSafe(F.col("_last_ts"))
    st = st.withColumns({"_first_no": F.col("_base") + F.col("_head") + F.when(one_instant, F.col("_extra")).otherwise(0),
                         "_last_no": F.col("_base") + F.col("_n") + F.col("_extra")})
    keep = ["_last_ts", "_q_ts", "_q_g", "_base", "_extra", "_first_no", "_last_no"]
    keep += [f"_q_{c}" for c in carry] + [f"_umx_{u}" for u in user_single_valued]

    # join back on (user, slice). One summary row per slice of a split user (at most
    # total / rows_per_slice + max_hot_users rows). No hint: the planner / AQE broadcast it
    # under the size threshold; otherwise a sort-merge join shuffles only the summary, since
    # the event side is already partitioned on (user, slice).
    y = x.join(st.select(*part, *keep), on=part, how="inner")
    inside = F.col("_rn") > 1
    cols = {}
    if gap_values is None:
        prev_g = F.when(inside, F.col("_pg")).otherwise(F.col("_q_g"))
        cols = {"prev_ts": F.when(inside, F.col("_pt")).otherwise(F.col("_q_ts")),
                "date_diff_seconds": seconds_between(prev_g, gap_col)}
    tie = F.when(F.col(ts).eqNullSafe(F.col("_last_ts")), F.col("_extra")).otherwise(F.lit(0))
    cols["session_no"] = (F.col("_base") + F.col("_local") + tie).cast("long")
    cols.update({f"prev_{c}": F.when(inside, F.col(f"_p_{c}")).otherwise(F.col(f"_q_{c}")) for c in carry})
    cols.update({f"{u}_user_mixed": F.col(f"_umx_{u}") for u in user_single_valued})
    y = y.withColumns(cols)
    if single_valued:
        y = _straddling(y, part, single_valued)
    helpers = ["_rn", "_pt", "_pg", "_local", *keep, *[f"_p_{c}" for c in carry]]
    return y.drop(*helpers)


def _straddling(y: DataFrame, part: list[str], single_valued: Sequence[str]) -> DataFrame:
    """``<v>_mixed`` of split users. Only a slice's first and last session can reach into another
    slice; their value ranges (two rows a slice) are combined per (user, session number)."""
    edge = F.col("session_no").isin(F.col("_first_no"), F.col("_last_no"))
    rng = []
    for v in single_valued:
        rng += [F.min(v).alias(f"_lo_{v}"), F.max(v).alias(f"_hi_{v}")]
    pieces = y.filter(edge).groupBy(*part, "session_no").agg(
        F.first("_first_no").alias("_f"), F.first("_last_no").alias("_l"), *rng)
    w_no = Window.partitionBy(UKEY, "session_no")
    pieces = pieces.withColumns({f"_mx_{v}": F.coalesce(
        F.max(f"_hi_{v}").over(w_no) > F.min(f"_lo_{v}").over(w_no), F.lit(False)) for v in single_valued})
    ends = []
    for v in single_valued:
        ends += [F.max(F.when(F.col("session_no") == F.col("_f"), F.col(f"_mx_{v}"))).alias(f"_fmx_{v}"),
                 F.max(F.when(F.col("session_no") == F.col("_l"), F.col(f"_mx_{v}"))).alias(f"_lmx_{v}")]
    y = y.join(pieces.groupBy(*part).agg(*ends), on=part, how="inner")
    w_sess = Window.partitionBy(*part, "session_no")
    y = y.withColumns({f"{v}_mixed": F.when(F.col("session_no") == F.col("_first_no"), F.col(f"_fmx_{v}"))
                       .when(F.col("session_no") == F.col("_last_no"), F.col(f"_lmx_{v}"))
                       .otherwise(_mixed(v, w_sess)) for v in single_valued})
    return y.drop(*[f"_{k}mx_{v}" for v in single_valued for k in "fl"])
