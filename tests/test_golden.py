"""Golden values at sf0.01 (FIXTURES.md §4), computed by the DuckDB oracle."""

import pytest
from pyspark.sql import functions as F

from cohortlens.plans import Pipeline
from cohortlens.operators import quality
from cohortlens.sources import fixture
from helpers import SF_MID

GOLDEN = {
    1800: dict(rows=9023, users=135, sessions=8370, report=8856,
               flags={"Control": (2282, 222, 1545, 154, 1409, 505, 920, 497, 440, 449),
                      "Variation": (6054, 661, 3979, 384, 3629, 1234, 2418, 1241, 1208, 1236),
                      None: (52, 4, 38, 5, 33, 9, 25, 11, 14, 15)},
               z={"step_4_flg": (1.709576, 0.087344), "step_5_flg": (0.177404, 0.859191),
                  "step_6_flg": (-0.997492, 0.318526)},
               welch=(0.190478, 0.849561), users_mean={"Control": (38, 4.052632),
                                                        "Variation": (93, 4.129032)}),
    43200: dict(rows=8684, users=135, sessions=2943, report=8053,
                flags={"Control": (844, 190, 546, 128, 570, 355, 321, 345, 197, 345),
                       "Variation": (2173, 551, 1423, 356, 1501, 904, 874, 936, 512, 902),
                       None: (51, 19, 30, 14, 34, 31, 15, 32, 8, 32)},
                z={"step_4_flg": (1.406708, 0.159514), "step_5_flg": (0.150819, 0.880119),
                   "step_6_flg": (0.548635, 0.583256)},
                welch=(0.347287, 0.729544), users_mean={"Control": (38, 4.078947),
                                                         "Variation": (93, 4.215054)}),
}


@pytest.mark.parametrize("gap", [1800, 43200])
def test_clean_chain_golden(spark, gap):
    g = GOLDEN[gap]
    p = Pipeline.from_testdata(spark, SF_MID, gap_seconds=gap, run_date="2024-02-01")
    c = p.clean_events.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("u"),
                           F.count_distinct("session_id").alias("s")).first()
    assert (c.n, c.u, c.s) == (g["rows"], g["users"], g["sessions"])
    flags = [F.count(F.lit(1))]
    for k in (2, 3, 4, 5):
        flags += [F.count_if(F.col(f"step_{k}_flg") == 1), F.count_if(F.col(f"step_{k}_flg") == 2)]
    flags.append(F.count_if(F.col("step_6_flg") == 1))
    by = {r[0]: tuple(r[1:]) for r in p.session_funnel.groupBy("cohort").agg(*flags).collect()}
    assert by == g["flags"]
    assert p.funnel_report.count() == g["report"]
    res = p.significance_results.collect()
    for r in res:
        if r.metric_type == "conversion_rate":
            z, pv = g["z"][r.metric]
        else:
            z, pv = g["welch"]
            assert (r.sample_size, round(r.value, 6)) == g["users_mean"][r.variant]
        assert round(r.statistic, 6) == pytest.approx(z, abs=1e-6)
        assert round(r.p_value, 6) == pytest.approx(pv, abs=1e-6)
        assert r.is_significant is False


def test_raw_fixture_golden(spark):
    raw = fixture.raw_events(spark, SF_MID)
    assert raw.count() == 10600
    assert raw.select("user_id").distinct().count() == 151  # 150 and null
    assert quality.cross_exposed(raw).count() == 16  # null users are one group
    hist = quality.duplicate_histogram(raw).collect()
    assert [(r.dups_flg, r.groups) for r in hist] == [(2, 286)]
    cov = quality.lookup_coverage(raw, fixture.country_timezone(spark, SF_MID)).first()
    assert (cov.countries, cov.countries_in_lookup, cov.countries_with_zone) == (25, 21, 17)
    assert raw.filter(F.col("release_version").contains("staging")).count() == 105
    nulls = [raw.filter(F.col(c).isNull()).count() for c in ("release_version", "user_id", "cohort", "ip_country", "event_datetime")]
    assert nulls == [99, 51, 62, 111, 35]
