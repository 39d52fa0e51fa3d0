"""Distribution tails against closed forms and tables; names and labels on the cases that matter."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygrid.functions import dist, names


@pytest.mark.parametrize("df, p", [(1, 0.2951672353), (1.3, None), (2, 0.1835034191), (10, None), (1e3, None), (1e6, 0.0455004), (1e8, 0.0455003)])
def test_t_tail(df, p):
    got = dist.t_two_sided([2.0], [df])[0]
    if p is None:  # by quadrature of the density
        x = np.tan(np.linspace(math.atan(2 / math.sqrt(df)), math.pi / 2, 400001)[:-1]) * math.sqrt(df)
        dens = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        p = 2 * float(np.trapezoid(dens, x)) + 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi) / df * (math.sqrt(df) / x[-1]) ** df
    assert got == pytest.approx(p, rel=2e-5)


def test_chi_square_tail_at_its_mean_and_far_out():
    assert dist.gamma_upper([5e5, 5e6], [5e5, 5e6]) == pytest.approx([0.4998, 0.49994], abs=1e-4)
    assert dist.gamma_upper([2], [50])[0] == pytest.approx(51 * math.exp(-50), rel=1e-9)


def test_studentised_range_product_and_hypergeometric():
    assert dist.range_tail([3.773], [3], [12])[0] == pytest.approx(0.05, abs=2e-4)
    assert dist.product_tail([1.0], [0.99])[0] == pytest.approx(0.3145, abs=1.5e-3)
    assert dist.product_tail([1.0], [1.0])[0] == pytest.approx(0.31731, abs=1e-4)
    want = sum(math.comb(5, k) * math.comb(15, 7 - k) for k in range(3, 6)) / math.comb(20, 7)
    assert dist.hyper_tail([3], [20], [5], [7])[0] == pytest.approx(want, rel=1e-12)


def test_product_tails_are_taken_for_all_rows_at_once(monkeypatch):
    z = np.r_[np.linspace(-8, 26, 2001), 0.0, 1e-300]
    assert dist.erfc_array(z) == pytest.approx([math.erfc(x) for x in z], rel=1e-12)
    assert dist.erfc_array(np.array([np.inf, -np.inf, 1e200])).tolist() == [0, 2, 0]
    rng = np.random.default_rng(3)
    c, rho = 3 * rng.normal(size=200) * rng.normal(size=200), rng.uniform(-1, 1, 200)
    u, w = np.polynomial.legendre.leggauss(400)
    x, want = 6 * u + 6, []
    for ci, ri in zip(np.abs(c), rho):
        s = math.sqrt(2 * (1 - ri * ri))
        tails = [0.5 * (math.erfc((ci / v - ri * v) / s) + math.erfc((ci / v + ri * v) / s)) for v in x]
        want.append(min(1.0, 2 * (6 * w * np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * tails).sum()))
    monkeypatch.setattr(dist.math, "erfc", None)  # one call for each node of each row took most of a query's time
    assert dist.product_tail(c, rho) == pytest.approx(want, rel=1e-11)
    odd = dist.product_tail([np.nan, np.inf, 0.0], [0.0, 0.5, np.nan])
    assert np.isnan(odd[0]) and odd[1] == 0 and odd[2] == pytest.approx(1)


def test_exact_mann_whitney_always_gives_a_p():
    assert dist.mwu_tail([0.0], [4], [5])[0] == pytest.approx(2 / math.comb(9, 4))
    assert 0 < dist.mwu_tail([10.0], [9], [9])[0] < 0.01
    counts = dist._u_counts(8, 60)
    assert sum(counts) == math.comb(68, 8) and min(counts) >= 1


def test_tails_on_workers_keep_null(spark):
    df = spark.createDataFrame([(None, 3.0)], "x double, y double")
    tails = {
        "t": dist.t_sf("x", "y"), "tq": dist.t_ppf("x", "y"), "f": dist.f_sf("x", "y", "y"), "b": dist.beta_cdf("x", "y", "y"), "c": dist.chi2_sf("x", "y"),
        "n": dist.norm_sf("x"), "u": dist.norm_upper("x"), "nq": dist.norm_ppf("x"), "h": dist.hyper_sf("x", "y", "y", "y"),
        "s": dist.srange_sf("x", "y", "y"), "p": dist.product_normal_sf("x", "y"), "m": dist.mwu_exact_sf("x", "y", "y"),
    }
    row = df.select(*[c.alias(k) for k, c in tails.items()]).first()
    assert all(v is None or v != v for v in row)


def test_labels(spark):
    df = spark.createDataFrame([("M+3", "30 min", "C6H12O6", "(R)-Lactic acid"), ("13C2", "1.5", "CH3COOH", "β-Alanine"), ("x", "soon", "", None)], "a string, b string, c string, d string")
    rows = df.select(
        names.isotopologue(F.col("a")).alias("a"), names.hours(F.col("b")).alias("b"), names.formula_elements(F.col("c")).alias("c"), names.name_variants(F.col("d")).alias("d")
    ).collect()
    assert [r.a for r in rows] == [3, 2, None]
    assert [r.b for r in rows] == [0.5, 1.5, None]
    assert {x.element: x["count"] for x in rows[1].c} == {"C": 2, "H": 4, "O": 2}
    assert any(x.endswith("lactate") for x in rows[0].d)
    assert "betaalanine" in rows[1].d
