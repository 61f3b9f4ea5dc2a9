"""p-values: closed forms, continued fractions in Spark vs series, test statistics."""

import math

import pytest
from pyspark.sql import functions as F

from closed_forms import beta_share, normal_p, student_p
from cohortlens.functions import stats as S
from cohortlens.operators import significance as SG


@pytest.mark.parametrize("t", [0.0, 0.3, 1.3, 4.0, 50.0])
def test_closed_forms(t):
    assert student_p(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(abs(t)), abs=1e-12)
    assert student_p(t, 2) == pytest.approx(1 - abs(t) / math.sqrt(t * t + 2), abs=1e-12)


def test_critical_values():
    assert normal_p(1.959964) == pytest.approx(0.05, abs=1e-7)
    assert student_p(2.228139, 10) == pytest.approx(0.05, abs=1e-7)


def test_jvm_p_values_match_exact(spark):
    pts = [(z, v) for z in (0.0, 0.18, 1.96, 3.3, 8.0, 40.0) for v in (1.0, 2.5, 9.0, 62.0, 5e5)]
    df = spark.createDataFrame(pts, "s double, v double")
    out = df.select("s", "v", S.normal_p_col(F.col("s")).alias("pz"),
                    S.student_p_col(F.col("s"), F.col("v")).alias("pt")).collect()
    for r in out:
        assert r.pz == pytest.approx(normal_p(r.s), abs=1e-9)
        assert r.pt == pytest.approx(student_p(r.s, r.v), abs=1e-8)


def test_small_p_values_keep_their_digits(spark):
    """Relative error below 1e-9 down to 1e-30: erfc, and Student's t of 1, 2 and 4 degrees of
    freedom in closed form, of others by a series without cancellation."""
    zs = [0.0, 0.5, 1.9999, 2.0, 2.5, 4.0, 7.0, 9.0, 11.4]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", S.normal_p_col(F.col("z")).alias("p")).collect()
    assert len(got) == len(zs)
    for r in got:
        assert r.p == pytest.approx(normal_p(r.z), rel=1e-9)
    assert normal_p(11.4) < 1e-29

    def tail(t, v):  # one minus the body, written without the subtraction
        if v == 1:
            return 2 / math.pi * math.atan(1 / t)
        q = 1 / math.sqrt(1 + v / t**2)  # t / sqrt(t^2 + v)
        gap = (v / t**2) * q * q / (1 + q)  # 1 - q
        return gap if v == 2 else gap**2 * (2 + q) / 2

    pts = [(t, float(v)) for v in (1, 2, 4) for t in (1.0, 50.0, 1e4, 3e7)]
    pts += [(t, v) for v in (3.7, 30.0, 400.0, 9_999.0) for t in (0.2, 1.7, 2.5, 9.0, 13.0)]
    pts += [(t, v) for v in (10_001.0, 1e6, 3e8) for t in (0.2, 2.5, 6.0)]
    got = spark.createDataFrame(pts, "t double, v double").select("t", "v", S.student_p_col(F.col("t"), F.col("v")).alias("p")).collect()
    for r in got:
        if r.v in (1, 2, 4):
            assert r.p == pytest.approx(tail(r.t, r.v), rel=1e-9), r
        elif r.v <= 10_001:
            assert r.p == pytest.approx(student_p(r.t, r.v), rel=1e-9), r
        else:  # the first correction of the normal law in 1 / v
            dens = math.exp(-r.t**2 / 2) / math.sqrt(2 * math.pi)
            assert r.p == pytest.approx(normal_p(r.t) + dens * (r.t**3 + r.t) / (2 * r.v), rel=1e-9 + (r.t + 1)**8 / r.v**2), r


def test_beta_share(spark):
    pts = [(x, a, b) for a in (0.03, 0.5, 3.0, 800.0) for b in (0.02, 1.0, 40.0, 6000.0) for x in (0.0, 1e-6, 0.1, 0.5, 0.97, 1.0)]
    got = spark.createDataFrame(pts, "x double, a double, b double").select(
        "*", S.beta_share_col(F.col("x"), F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(beta_share(r.x, r.a, r.b), rel=1e-9, abs=1e-12), r
    big = spark.range(1).select(S.beta_share_col(F.lit(0.21), F.lit(2.0e6), F.lit(8.0e6)).alias("hi"),
                                S.beta_share_col(F.lit(0.2), F.lit(2.0e6), F.lit(8.0e6)).alias("mid")).first()
    assert big.hi == pytest.approx(1.0) and big.mid == pytest.approx(0.5, abs=1e-3)


def test_ztest_sign_and_symmetry(spark):
    summ = spark.createDataFrame([("m", "Control", 30, 100), ("m", "Variation", 20, 100)],
                                 "metric string, variant string, conversions long, total_sessions long")
    z = {r.variant: r.statistic for r in SG.proportion_ztest(summ).collect()}
    p = 0.25
    expect = (0.3 - 0.2) / math.sqrt(p * (1 - p) * (2 / 100))
    assert z["Control"] == pytest.approx(expect) and z["Variation"] == pytest.approx(expect)


def test_ztest_zero_variance_is_null(spark):
    summ = spark.createDataFrame([("m", "Control", 0, 10), ("m", "Variation", 0, 10)],
                                 "metric string, variant string, conversions long, total_sessions long")
    assert all(r.statistic is None for r in SG.proportion_ztest(summ).collect())


def test_welch_matches_formula(spark):
    a = [1, 2, 3, 4, 10]
    b = [2, 2, 3]
    rows = [("Variation", f"a{i}", x) for i, x in enumerate(a)] + \
           [("Control", f"b{i}", x) for i, x in enumerate(b)]
    tot = spark.createDataFrame(rows, "variant string, user_id string, total long")
    out = {r.variant: r for r in SG.welch_ttest(tot).collect()}

    def mv(x):
        m = sum(x) / len(x)
        return m, sum((y - m) ** 2 for y in x) / (len(x) - 1)

    (ma, va), (mb, vb) = mv(a), mv(b)
    se2 = va / len(a) + vb / len(b)
    t = (ma - mb) / math.sqrt(se2)
    dof = se2 ** 2 / ((va / len(a)) ** 2 / (len(a) - 1) + (vb / len(b)) ** 2 / (len(b) - 1))
    assert out["Variation"].statistic == pytest.approx(t)
    assert out["Control"].dof == pytest.approx(dof)
    assert out["Variation"].value == pytest.approx(ma) and out["Control"].sample_size == 3


def test_chi_square_cross_check(spark):
    """z² of the pooled two-proportion test equals Pearson's 2×2 chi-square."""
    x1, n1, x2, n2 = 457, 1781, 1245, 4679
    p = (x1 + x2) / (n1 + n2)
    z = (x1 / n1 - x2 / n2) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    obs = [[x1, n1 - x1], [x2, n2 - x2]]
    tot = n1 + n2
    cols = [x1 + x2, tot - x1 - x2]
    chi2 = sum((obs[i][j] - [n1, n2][i] * cols[j] / tot) ** 2 / ([n1, n2][i] * cols[j] / tot)
               for i in range(2) for j in range(2))
    assert z * z == pytest.approx(chi2)


def test_ztest_matches_spark_ml_chi_square(spark):
    """z² of the pooled test equals Pearson's χ² from pyspark.ml on the same 2×2 table."""
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.stat import ChiSquareTest

    x1, n1, x2, n2 = 45, 178, 124, 467
    rows = ([(0.0, Vectors.dense([0.0]))] * x1 + [(1.0, Vectors.dense([0.0]))] * (n1 - x1)
            + [(0.0, Vectors.dense([1.0]))] * x2 + [(1.0, Vectors.dense([1.0]))] * (n2 - x2))
    chi = ChiSquareTest.test(spark.createDataFrame(rows, ["label", "features"]),
                             "features", "label").first()
    summ = spark.createDataFrame([("m", "Control", x1, n1), ("m", "Variation", x2, n2)],
                                 "metric string, variant string, conversions long, total_sessions long")
    z = SG.proportion_ztest(summ).first().statistic
    assert z * z == pytest.approx(chi.statistics[0], rel=1e-9)
    assert normal_p(z) == pytest.approx(chi.pValues[0], abs=1e-9)


def test_swapping_variants_flips_sign_keeps_p(spark):
    a, b = [1, 5, 2, 8, 3], [4, 4, 6, 9]
    rows = [("Variation", f"a{i}", x) for i, x in enumerate(a)] + \
           [("Control", f"b{i}", x) for i, x in enumerate(b)]
    tot = spark.createDataFrame(rows, "variant string, user_id string, total long")
    t1 = SG.welch_ttest(tot).first()
    t2 = SG.welch_ttest(tot, a="Control", b="Variation").first()
    assert t1.statistic == pytest.approx(-t2.statistic) and t1.dof == pytest.approx(t2.dof)
    assert student_p(t1.statistic, t1.dof) == pytest.approx(
        student_p(t2.statistic, t2.dof))
