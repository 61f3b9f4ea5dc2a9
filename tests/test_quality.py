"""Data-quality operators on hand-made frames."""

import datetime as dt

from cohortlens.operators import quality
from helpers import T0, ev, lookup_df, raw_df


def test_simultaneous_pairs_counts_distinct_tuples(spark):
    half = dt.timedelta(microseconds=500_000)
    rows = [ev(1, 0, name="Homepage_Viewed"),
            ev(2, 0, name="Search_Event", when=T0 + half),          # same second as 1
            ev(2, 0, name="Search_Event", when=T0 + half),          # exact copy of 2
            ev(3, 1, name="view_item"),                              # next second: no pair
            ev(4, 5, user="u2", name="purchase"), ev(5, 5, user="u2", name="purchase")]
    out = {(r.event_name, r.last_event): r.frequency
           for r in quality.simultaneous_pairs(raw_df(spark, rows)).collect()}
    assert out == {("Search_Event", "Homepage_Viewed"): 1, ("Search_Event", "Search_Event"): 1,
                   ("purchase", "purchase"): 1}


def test_events_of_simultaneous_users_is_a_semi_join(spark):
    rows = [ev(1, 0), ev(2, 0, name="view_item"), ev(2, 0, name="view_item"),
            ev(3, 0, user="b"), ev(4, 3, user="b")]
    out = quality.events_of_simultaneous_users(raw_df(spark, rows)).collect()
    assert sorted(r.event_id for r in out) == [1, 2, 2]


def test_landing_event_uses_time_then_event_id(spark):
    rows = [ev(9, 0, user="a", name="view_item"), ev(3, 0, user="a", name="Search_Event",
                                                       action="Search Activated"),
            ev(1, 5, user="b", name="purchase")]
    out = {r.event: r.occur for r in quality.landing_events(raw_df(spark, rows)).collect()}
    assert out == {None: 1, "purchase": 1}  # action with null page_type → null label


def test_lookup_coverage(spark):
    rows = [ev(1, 0, country="PT"), ev(2, 0, country="ES"), ev(3, 0, country="XX"),
            ev(4, 0, country="AA"), ev(5, 0, country=None)]
    lk = lookup_df(spark, [("PT", "Europe/Lisbon"), ("ES", None)])
    r = quality.lookup_coverage(raw_df(spark, rows), lk).first()
    assert (r.countries, r.countries_in_lookup, r.countries_with_zone) == (4, 2, 1)
    assert r.missing_countries == "AA, XX"


def test_staging_profile_and_nulls(spark):
    rows = [ev(1, 0), ev(2, 0, user="b", version="staging-9"), ev(3, 1, user="b", version="x-staging")]
    p = quality.staging_profile(raw_df(spark, rows)).collect()
    assert [(r.release_version, r.users, r.rows_) for r in p] == [(1, 1, 2)]
    none = quality.staging_profile(raw_df(spark, [ev(1, 0)])).collect()
    assert none == []
    n = quality.null_counts(raw_df(spark, [ev(1, 0, cohort=None), ev(2, 0, user=None)])).first()
    assert (n.cohort_null, n.user_id_null, n.event_date_null) == (1, 1, 0)


def test_duplicate_histogram_and_cross_exposed(spark):
    rows = [ev(1, 0), ev(2, 0), ev(3, 0), ev(4, 9), ev(5, 9), ev(6, 20, cohort="Variation")]
    h = {r.dups_flg: r.groups for r in quality.duplicate_histogram(raw_df(spark, rows)).collect()}
    assert h == {3: 1, 2: 1}
    x = quality.cross_exposed(raw_df(spark, rows)).collect()
    assert [(r.user_id, r.cohort_count) for r in x] == [("u1", 2)]


def test_simultaneous_pairs_sliced_equals_plain(spark):
    from helpers import SF_MID
    from cohortlens.sources import fixture

    raw = fixture.raw_events(spark, SF_MID)
    plain = quality.simultaneous_pairs(raw)
    for slicing in ("rank", "time"):
        sliced = quality.simultaneous_pairs(raw, rows_per_slice=9, max_hot_users=10**9,
                                            slicing=slicing)
        assert plain.exceptAll(sliced).count() == 0 and sliced.exceptAll(plain).count() == 0
