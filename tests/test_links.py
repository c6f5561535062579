"""Links by the incomplete gamma function: known values, both tails, the inverse, and Columns against arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefscale.functions.links import gennorm, log_normal_cdf, log_upper_gamma, normal_cdf, np_log_upper_gamma, probit

Y = [0.0, 1e-8, 0.1, 0.7, 1.4, 1.6, 2.4, 2.6, 5.0, 30.0, 300.0]
#: Closed forms of Q(a, y).
KNOWN = {
    0.5: lambda y: math.erfc(math.sqrt(y)),
    1.0: lambda y: math.exp(-y),
    1.5: lambda y: math.erfc(math.sqrt(y)) + 2 * math.sqrt(y / math.pi) * math.exp(-y),
    2.0: lambda y: (1 + y) * math.exp(-y),
    3.0: lambda y: (1 + y + y * y / 2) * math.exp(-y),
}


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame([(float(y),) for y in Y], "y double").coalesce(1)


@pytest.mark.parametrize("a", KNOWN)
def test_known_values(places, a):
    want = np.array([KNOWN[a](y) for y in Y])
    got = np.array([r[0] for r in places.select(F.exp(log_upper_gamma(a, F.col("y")))).collect()])
    assert got == pytest.approx(want, rel=1e-10, abs=1e-300)
    assert np.exp(np_log_upper_gamma(a, np.array(Y))) == pytest.approx(want, rel=1e-10, abs=1e-300)


def test_tails_beyond_the_smallest_double(places):
    got = [r[0] for r in places.select(log_upper_gamma(1.0, 100 * F.col("y"))).collect()]
    assert got == pytest.approx([-100 * y for y in Y], rel=1e-10, abs=1e-10)


@pytest.mark.parametrize("beta", [0.5, 0.8, 1.5, 2.0, 4.0])
@pytest.mark.parametrize("sigma", [1.0, 2.5])
def test_inverse(spark, beta, sigma):
    p = [1e-200, 1e-30, 1e-6, 0.01, 0.3, 0.4999, 0.5, 0.5001, 0.8, 0.999]
    link = gennorm(beta, sigma)
    rows = spark.createDataFrame([(x,) for x in p], "p double").coalesce(1).select("p", link.phi(F.col("p")).alias("x"))
    rows = rows.select("p", "x", link.cdf(F.col("x")).alias("back"), link.pdf(F.col("x")).alias("pdf")).collect()
    x = np.array([r["x"] for r in rows])
    assert [r["back"] for r in rows] == pytest.approx(p, rel=1e-9, abs=0)
    assert x == pytest.approx(link.np_phi(np.array(p)), rel=1e-10, abs=1e-10) and (np.diff(x) > 0).all()
    assert link.np_cdf(x) == pytest.approx(p, rel=1e-9, abs=0)
    assert [r["pdf"] for r in rows] == pytest.approx(link.np_pdf(x), rel=1e-10, abs=0)


def test_probit_is_the_normal(spark):
    p = [0.001, 0.2, 0.5, 0.9]
    rows = spark.createDataFrame([(x,) for x in p], "p double").coalesce(1).select(probit(1.3).phi(F.col("p")).alias("x"), probit(1.3).cdf(F.col("p")).alias("c"), probit(1.3).pdf(F.col("p")).alias("d")).collect()
    own, at = probit(1.3), np.array(p)
    assert [r["x"] for r in rows] == pytest.approx(own.np_phi(at), abs=1e-10)
    assert [r["c"] for r in rows] == pytest.approx(own.np_cdf(at), abs=1e-12) and [r["d"] for r in rows] == pytest.approx(own.np_pdf(at), abs=1e-12)


def test_log_normal_cdf_column(spark):
    z = [-300.0, -40.0, -5.0, -0.5, 0.0, 1.0, 8.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").coalesce(1).select(log_normal_cdf(F.col("z"))).collect()]
    assert got[2:] == pytest.approx([math.log(float(normal_cdf(np.array(x)))) for x in z[2:]], rel=1e-10, abs=1e-14)
    assert got[0] == pytest.approx(-45000 - math.log(300 * math.sqrt(2 * math.pi)), rel=1e-8) and got[1] == pytest.approx(-804.60844201, abs=1e-6)


def test_links_stay_in_the_jvm(spark, capsys):
    spark.range(3).select(gennorm(1.5).phi((F.col("id") + 1) / 5), probit().cdf(F.col("id").cast("double"))).explain()
    assert "Python" not in capsys.readouterr().out


def test_nulls_stay_null(spark):
    rows = spark.createDataFrame([(None,), (0.3,)], "p double").select(gennorm(1.5).phi(F.col("p")), probit().cdf(F.col("p"))).collect()
    assert [v is None for r in rows for v in r] == [True, True, False, False]
