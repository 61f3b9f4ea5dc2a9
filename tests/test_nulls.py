"""Null users, cohorts, countries, times and variants; guards of the significance step; sinks."""


import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cleaning, funnel, quality, significance
from cohortlens.plans import Pipeline
from cohortlens.session import ensure_checkpoint_dir
from cohortlens.sources import sinks
from helpers import ev, lookup_df, raw_df


def no_time(row):
    return row[:5] + (None,) + row[6:]


def test_null_users_in_two_cohorts_are_dropped_everywhere(spark):
    raw = raw_df(spark, [ev(1, 0, user=None), ev(2, 9, user=None, cohort="Variation"), ev(3, 0, user="a")])
    assert [r.event_id for r in cleaning.build_base(raw).collect()] == [3]
    assert [r.event_id for r in cleaning.profile_base(raw).collect()] == [3]
    assert cleaning.build_clean_events(raw, lookup_df(spark)).count() == 1


def test_null_users_of_one_cohort_stay(spark):
    raw = raw_df(spark, [ev(1, 0, user=None), ev(2, 9, user=None)])
    assert cleaning.build_base(raw).count() == cleaning.build_clean_events(raw, lookup_df(spark)).count() == 2


def test_flags_and_counts_are_facts_of_the_session(spark):
    raw = raw_df(spark, [
        ev(1, 0, name="Search_Event", action="Search Activated", page_type="Destination Search"),
        ev(2, 5, name="view_item", country=None), ev(3, 9, user="b", name="purchase", cohort=None), ev(4, 12, user="b")])
    rows = funnel.build_session_funnel(cleaning.build_clean_events(raw, lookup_df(spark))).collect()
    a = {r.ip_country: (r.step_2_flg, r.step_5_flg, r.event_count_Search_Act, r.event_count_view_item) for r in rows if r.user_id == "u1"}
    assert a == {"PT": (1, 1, 1, 1), None: (1, 1, 1, 1)}
    b = {r.cohort: (r.step_6_flg, r.event_count_purchase) for r in rows if r.user_id == "b"}
    assert b == {"Control": (1, 1), None: (1, 1)}


def test_events_without_a_time_are_not_simultaneous(spark):
    raw = raw_df(spark, [no_time(ev(1, 0)), no_time(ev(2, 0)), no_time(ev(2, 0)), ev(3, 0, user="b"), ev(4, 0, user="b")])
    assert {r.user_id for r in quality.events_of_simultaneous_users(raw).collect()} == {"b"}
    assert sum(r.frequency for r in quality.simultaneous_pairs(raw).collect()) == 1


def test_lookup_coverage_is_null_when_nothing_is_missing(spark):
    assert quality.lookup_coverage(raw_df(spark, [ev(1, 0)]), lookup_df(spark)).first().missing_countries is None
    two = raw_df(spark, [ev(1, 0), ev(2, 0, country="ZZ"), ev(3, 0, country="AA")])
    assert quality.lookup_coverage(two, lookup_df(spark)).first().missing_countries == "AA, ZZ"


def inputs(spark, variants):
    rows = [(v, f"{v}{i}", f"{v}{i}", 1, 2, int(i < hits), 0, 0) for v, hits, n in variants for i in range(n)]
    return spark.createDataFrame(rows, "variant string, user_id string, session_id string, step_3_flg int, "
                                       "event_count_Search_Sub long, step_4_flg int, step_5_flg int, step_6_flg int")


def test_z_test_needs_two_variants(spark):
    z = lambda v: {r.statistic for r in significance.proportion_ztest(
        significance.conversion_summary(inputs(spark, v), ["step_4_flg"])).collect()}
    two = z([("Control", 5, 10), ("Variation", 9, 10)])
    assert len(two) == 1 and None not in two
    assert z([("Control", 5, 10), ("V1", 9, 10), ("V2", 5, 100)]) == {None}
    assert z([("Control", 5, 10)]) == {None}


def test_rows_without_a_variant_do_not_count(spark):
    ti = inputs(spark, [("Control", 5, 10), ("Variation", 9, 10), (None, 3, 4)])
    for df in (significance.conversion_summary(ti), significance.user_totals(ti), significance.user_summary(ti)):
        assert {r.variant for r in df.collect()} == {"Control", "Variation"}


@pytest.mark.parametrize("sep, unique", [("#", True), ("", False), ("12", False), ("1#", True)])
def test_unique_session_ids_need_a_separator_that_is_no_digit(sep, unique):
    assert Pipeline(None, None, sep=sep)._unique_sessions is unique


def test_overwrite_replaces_only_when_complete(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite(spark.range(3), path)
    bad = spark.range(2).withColumn("x", F.raise_error(F.lit("stop")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        sinks.overwrite(bad, path)
    assert spark.read.parquet(path).count() == 3
    sinks.overwrite(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    assert [p.name for p in tmp_path.iterdir() if ".old-" in p.name] == []


def test_intermediates_go_at_the_end(spark):
    from pathlib import Path

    with sinks.intermediates(spark):
        kept = Path(sinks.materialize(spark.range(3), "x").inputFiles()[0].removeprefix("file:")).parent
        assert kept.exists()
    assert not kept.exists()


def test_checkpoint_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Spark:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Spark())


def test_results_are_ordered(spark):
    raw = raw_df(spark, [ev(i, 0, user=f"u{i}", name="b" if i else "a", version=f"9.{9 - i}") for i in range(4)])
    assert [r.event_name for r in quality.event_combinations(raw).collect()] == ["a", "b"]
    assert [r.release_version for r in quality.users_by(raw, ["release_version", "cohort"]).collect()] == sorted(f"9.{9 - i}" for i in range(4))
    assert [r.occur for r in quality.landing_events(raw).collect()] == [3, 1]
