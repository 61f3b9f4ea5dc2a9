"""Funnel flags, report and conversion semantics."""

from pyspark.sql import functions as F

from cohortlens import params as P
from cohortlens.operators import cleaning, funnel
from helpers import ev, lookup_df, raw_df

ACT = dict(name="Search_Event", action="Search Activated", page_type="Destination Search")
SUB = dict(name="Search_Event", action="Search Submitted", page_type="Destination Search")


def session_funnel(spark, rows):
    c = cleaning.build_clean_events(raw_df(spark, rows), lookup_df(spark))
    return funnel.build_session_funnel(c)


def test_ghost_flags(spark):
    rows = [ev(1, 0, user="a", name="purchase"),                                # only step 6
            ev(2, 0, user="b", **ACT), ev(3, 10, user="b", name="view_item"),   # 2 and 5
            ev(4, 0, user="c", name="Search_Event", action="Search Activated",
               page_type="Homepage")]                                           # not a search
    out = {r.user_id: r for r in session_funnel(spark, rows).collect()}
    flags = lambda r: tuple(r[f"step_{k}_flg"] for k in range(2, 7))
    assert flags(out["a"]) == (2, 2, 2, 2, 1)
    assert flags(out["b"]) == (1, 2, 2, 1, 0)
    assert flags(out["c"]) == (0, 0, 0, 0, 0)
    assert out["a"]["event_count_Search_Act"] is None
    assert out["b"]["event_count_Search_Act"] == 1


def test_report_steps_and_ghost_rows(spark):
    rows = [ev(1, 0, user="a", name="purchase"), ev(2, 0, user="b", **ACT),
            ev(3, 5, user="b", **ACT), ev(4, 9, user="b", **SUB)]
    rep = funnel.build_funnel_report(session_funnel(spark, rows)).collect()
    by = {r.step_id: r for r in rep}
    assert set(by) == {1, 2, 99, 3, 4, 5, 6}
    assert by[1].sessions == 2 and by[1].event_count == 0
    assert by[2].sessions == 2 and by[2].event_count == 2     # ghost of a counts, with null events
    assert by[99].sessions == 1 and by[99].event_count == 2   # only seen activations
    assert by[3].sessions == 2 and by[3].event_count == 1
    assert by[6].sessions == 1 and by[6].users == 1
    assert all(r.experiment == P.EXPERIMENT for r in rep)


def test_sessions_sequence_ordered(spark):
    rows = [ev(2, 10, name="view_item"), ev(1, 0, **ACT), ev(3, 20, name="Search_Event",
                                                               action="Search Submitted")]
    c = cleaning.build_clean_events(raw_df(spark, rows), lookup_df(spark))
    s = funnel.build_sessions(c).collect()
    assert len(s) == 1
    # the label of an action with a null page_type is null and is skipped
    assert s[0].session_seq == "Search Activated-Destination Search|*|view_item"


def test_funnel_monotone_on_fixture(spark):
    from helpers import SF_MID
    from cohortlens.plans import Pipeline

    sf = Pipeline.from_testdata(spark, SF_MID).session_funnel
    counts = sf.agg(*[F.count_if(F.col(f"step_{k}_flg") > 0).alias(f"s{k}") for k in range(2, 7)]).first()
    seq = [counts[f"s{k}"] for k in range(2, 7)]
    assert seq == sorted(seq, reverse=True)


def test_conversion_and_searchers(spark):
    rows = [ev(1, 0, user="a", **ACT), ev(2, 5, user="a", **ACT), ev(3, 9, user="a", name="purchase"),
            ev(4, 0, user="b", cohort="Variation", **ACT),
            ev(5, 0, user="c", cohort="Variation", name="Homepage_Viewed")]
    sf = session_funnel(spark, rows)
    conv = {r.cohort: r for r in funnel.conversion_rates(sf).collect()}
    assert conv["Control"].sessions == 1 and conv["Control"].booking_rate == 1.0
    assert conv["Variation"].sessions == 1 and conv["Variation"].results_rate == 0.0
    sps = {r.cohort: (r.searchers, r.events) for r in funnel.searches_per_searcher(sf).collect()}
    assert sps == {"Control": (1, 2), "Variation": (1, 1)}


def test_report_session_counts_with_and_without_key_separator(spark):
    from cohortlens.plans import Pipeline
    import datetime as dt
    from helpers import T0

    day = T0.replace(hour=0)
    rows = [ev(i, 0, user="u1", when=day + dt.timedelta(hours=2 * i)) for i in range(11)]
    rows.append(ev(100, 0, user="u11", when=day + dt.timedelta(hours=23)))
    raw, lk = raw_df(spark, rows), lookup_df(spark, (("PT", "UTC"),))
    for sep, sessions in (("#", 12), ("", 11)):   # 'u1'+'11' == 'u11'+'1' without a separator
        p = Pipeline(raw, lk, sep=sep, materialize=False)
        step1 = [r for r in p.funnel_report.collect() if r.step_id == 1]
        assert len(step1) == 1 and step1[0].users == 2 and step1[0].sessions == sessions
