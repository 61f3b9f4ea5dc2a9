"""The skew-safe sequence operator equals a brute-force per-user scan, for any slicing."""

import datetime as dt
import math
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators import timeline as TL

T0 = dt.datetime(2024, 1, 1)
GAP = 100


def brute(rows, local=False):
    """rows: (id, user, ts, country, cohort) -> {id: (prev_ts, gap, session_no, mixed, umixed, prev
    country)}. Null times come first. With ``local``, gaps are taken on local wall-clock times."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    out = {}
    for user, rs in by.items():
        rs.sort(key=lambda r: (r[2] is not None, r[2] or T0, r[0]))
        secs = [None if r[2] is None else
                math.floor((r[2] - dt.datetime(1970, 1, 1)).total_seconds()) + (SHIFT[r[3]] if local else 0)
                for r in rs]
        starts, prev = [], []
        for i, r in enumerate(rs):
            g = None if i == 0 or secs[i] is None or secs[i - 1] is None else secs[i] - secs[i - 1]
            prev.append((None if i == 0 else rs[i - 1][2], g, None if i == 0 else rs[i - 1][3]))
            starts.append(g is None or g > GAP)
        upto = lambda a, b: a is None or (b is not None and a <= b)
        sess = []
        for i, r in enumerate(rs):  # RANGE frame: all rows with ts <= current ts
            sess.append(sum(s for j, s in enumerate(starts) if upto(rs[j][2], r[2])))
        countries = defaultdict(set)
        for r, s in zip(rs, sess):
            if r[3] is not None:
                countries[s].add(r[3])
        cohorts = {r[4] for r in rs if r[4] is not None}
        for r, p, s in zip(rs, prev, sess):
            out[r[0]] = (p[0], p[1], s, len(countries[s]) > 1, len(cohorts) > 1, p[2])
    return out


SHIFT = {"P": 0, "E": 3600, None: -300}
SCHEMA = "event_id long, user_id string, event_ts timestamp_ntz, country string, cohort string"
COLUMNS = ("prev_ts", "date_diff_seconds", "session_no", "country_mixed", "cohort_user_mixed", "prev_country")


def sequenced(spark, rows, local=False, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    shift = F.when(F.col("country") == "P", 0).when(F.col("country") == "E", 3600).otherwise(-300)
    df = df.withColumn("local", F.timestamp_add("SECOND", shift, F.col("event_ts")))
    got = TL.sequence(df, gap_seconds=GAP, carry=("country",), single_valued=("country",),
                      user_single_valued=("cohort",), max_hot_users=10**9,
                      gap_col="local" if local else None, **kw)
    return {r.event_id: tuple(r[c] for c in COLUMNS) for r in got.collect()}


event = st.tuples(
    st.sampled_from(["a", "b", None]),
    st.one_of(st.none(), st.integers(0, 600), st.sampled_from([10, 10, 500])),  # seconds, with ties
    st.sampled_from([0, 0, 400_000, 999_999]),  # microseconds
    st.sampled_from(["P", "E", None]),
    st.sampled_from(["Control", "Variation", None]))


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(event, min_size=1, max_size=40), st.integers(1, 6), st.booleans(), st.booleans(),
       st.sampled_from(["time", "rank"]))
def test_sequence_matches_brute_force(spark, evs, rows_per_slice, single_cohort, local, slicing):
    rows = []
    for i, (u, s, us, c, coh) in enumerate(evs):
        when = None if s is None else T0 + dt.timedelta(seconds=s, microseconds=us)
        rows.append((i, u, when, c, "Control" if single_cohort else coh))
    assert sequenced(spark, rows, local, rows_per_slice=rows_per_slice, slicing=slicing) == brute(rows, local)


@pytest.mark.parametrize("slicing", ["time", "rank"])
@pytest.mark.parametrize("local", [False, True])
def test_ties_across_borders_with_changing_zones(spark, slicing, local):
    """One user, ties of 20 rows whose zones differ, and a run of null times; slices of 7 rows."""
    rows = [(i, "u", T0 + dt.timedelta(seconds=60 * (i // 20)), "PE"[i % 2] if i % 3 else None, "Control") for i in range(80)]
    rows += [(100 + i, "u", None, "P", "Control") for i in range(9)]
    want = brute(rows, local)
    assert sequenced(spark, rows, local, rows_per_slice=7, slicing=slicing) == want
    assert sequenced(spark, rows, local) == want


def test_sliced_equals_plain_on_fixture(spark):
    from helpers import SF_MID
    from cohortlens.operators import cleaning
    from cohortlens.sources import fixture

    base = cleaning.localize(cleaning.build_base(fixture.raw_events(spark, SF_MID)),
                             fixture.country_timezone(spark, SF_MID))
    kw = dict(carry=("event_name",), single_valued=("ip_country",), user_single_valued=("cohort",))
    cols = ["event_id", "prev_ts", "date_diff_seconds", "prev_event_name", "session_no",
            "ip_country_mixed", "cohort_user_mixed"]
    plain = TL.sequence(base, **kw).select(*cols)
    sliced_df = TL.add_slices(base, "user_id", "event_ts", rows_per_slice=7, max_hot_users=10**9)
    assert sliced_df.filter(F.col("_hot")).count() == base.count()
    sliced = TL.sequence(sliced_df, **kw).select(*cols)
    assert plain.exceptAll(sliced).count() == 0 and sliced.exceptAll(plain).count() == 0


def test_hot_users_bounded(spark):
    # one user with most rows is split; the hot table is bounded by max_hot_users
    rows = [(i, "hot" if i % 4 else f"u{i}", T0 + dt.timedelta(seconds=i)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, user_id string, event_ts timestamp_ntz")
    s = TL.add_slices(df, "user_id", "event_ts", rows_per_slice=50, max_hot_users=1000)
    hot = s.filter(F.col("_hot"))
    assert {r.user_id for r in hot.select("user_id").distinct().collect()} == {"hot"}
    assert hot.select("_slice").distinct().count() == 6  # 300 rows / 50 per slice


@pytest.mark.parametrize("slicing", ["time", "rank"])
def test_clean_chain_with_a_hot_user(spark, slicing):
    """A third of all events belong to one user: that user is split, the result is unchanged."""
    from helpers import SF_MID
    from cohortlens.operators import cleaning
    from cohortlens.sources import fixture

    raw = fixture.raw_events(spark, SF_MID)
    raw = raw.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit("u_hot"))
                         .otherwise(F.col("user_id")))
    is_hot = F.col("user_id") == "u_hot"
    raw = raw.withColumns({"cohort": F.when(is_hot, F.lit("Variation")).otherwise(F.col("cohort")),
                           "ip_country": F.when(is_hot, F.lit("NATION_1"))
                           .otherwise(F.col("ip_country"))})
    lk = fixture.country_timezone(spark, SF_MID)
    hot = TL.hot_users(raw.withColumn(TL.UKEY, TL._ukey("user_id")), "event_datetime",
                       rows_per_slice=400, max_hot_users=10**9)
    assert hot.count() == 1
    cols = cleaning.CLEAN_COLUMNS + cleaning.INTERNAL_COLUMNS
    split = cleaning.build_clean_events(raw, lk, rows_per_slice=400, max_hot_users=10**9, slicing=slicing).select(*cols)
    whole = cleaning.build_clean_events(raw, lk).select(*cols)
    assert split.filter(F.col("user_id") == "u_hot").count() > 1000
    assert split.exceptAll(whole).count() == 0 and whole.exceptAll(split).count() == 0


def test_rank_slicing_splits_a_tie_group(spark):
    """400 events of one user at one instant: equi-depth slices split them, results hold."""
    rows = [(i, "bot", T0, "P", "Control") for i in range(400)]
    rows += [(1000 + i, "bot", T0 + dt.timedelta(seconds=5000 + i), "E", "Control") for i in range(50)]
    df = spark.createDataFrame(rows, "event_id long, user_id string, event_ts timestamp_ntz, "
                                     "country string, cohort string")
    got = TL.sequence(df, gap_seconds=GAP, single_valued=("country",), user_single_valued=("cohort",),
                      carry=("country",), rows_per_slice=60, max_hot_users=10**9, slicing="rank")
    assert {r.event_id: tuple(r[c] for c in COLUMNS) for r in got.collect()} == brute(rows)
    assert got.select("_slice").distinct().count() >= 6


def test_hot_threshold_keeps_the_bound(spark):
    """Hot means more than max(rows_per_slice, total / max_hot_users) rows: < max_hot_users users."""
    big = [(i, "big", T0 + dt.timedelta(seconds=i)) for i in range(900)]
    small = [(1000 + i, f"s{i % 10}", T0 + dt.timedelta(seconds=i)) for i in range(100)]
    df = spark.createDataFrame(big + small, "event_id long, user_id string, event_ts timestamp_ntz")
    df = df.withColumn(TL.UKEY, TL._ukey("user_id"))
    # rows_per_slice 5 alone would make all 11 users hot; total / 3 = 333 keeps only "big"
    hot = TL.hot_users(df, "event_ts", rows_per_slice=5, max_hot_users=3).collect()
    assert [r._hot_uk.u for r in hot] == ["big"] and hot[0]._n == 900


def test_small_slices_need_no_task_each(spark):
    """1,500 rows cut at every 3rd row: as many tasks as a shuffle has write them, slices keep to their
    size, run along each user's timeline and hold rows of one key together."""
    rows = [(i // 2 if i < 40 else i, "ab"[i % 7 == 0], T0 + dt.timedelta(seconds=50 * (i // 4)), "P", "Control") for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn(TL.UKEY, TL._ukey("user_id"))
    hot = TL.hot_users(df, "event_ts", rows_per_slice=3, max_hot_users=10**9)
    cut = TL.rank_slices(df, "event_ts", ("event_id",), hot, rows_per_slice=3)
    assert len(cut.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = sorted((r.user_id, r.event_ts, r.event_id, r[TL.SLICE]) for r in cut.collect())
    assert [g[:3] for g in got] == sorted((r[1], r[2], r[0]) for r in rows)
    sizes = {}
    for (u, t, e, k), (u2, t2, e2, k2) in zip(got, got[1:]):
        assert u != u2 or k <= k2
        assert (u, t, e) != (u2, t2, e2) or k == k2
    for g in got:
        sizes[g[0], g[3]] = sizes.get((g[0], g[3]), 0) + 1
    assert max(sizes.values()) <= 4 and len(sizes) >= 500  # 3 rows and a second one of the last key


def test_sequence_in_many_small_slices(spark):
    rows = [(i, "abc"[i % 3], T0 + dt.timedelta(seconds=(i * i) % 997 // 3 * 40), "PE"[i % 11 == 0], "Control") for i in range(600)]
    assert sequenced(spark, rows, rows_per_slice=1) == brute(rows)
