"""Adjustments, ranks and quantiles: missing values, families with a NULL key, plan shape."""

import pytest
from pyspark.sql import functions as F

from assaygrid.operators.base import mid_ranks, p_adjust, quantiles
from assaygrid.operators import clean, comparisons

ROWS = [("a", 0.01), ("a", 0.02), ("a", 0.02), ("a", None), ("a", float("nan")), ("b", 0.5), (None, 0.04), (None, 0.2)]


@pytest.fixture(scope="module")
def ps(spark):
    return spark.createDataFrame(ROWS, "k string, p double")


def got(df):
    return sorted(((r.k or "", r.p if r.p == r.p else None, None if r.q is None else round(r.q, 6)) for r in df.collect()), key=str)


@pytest.mark.parametrize("bounded", [False, True])
@pytest.mark.parametrize(
    "method, want", [("bh", [0.02, 0.02, 0.02]), ("holm", [0.03, 0.04, 0.04]), ("bonferroni", [0.03, 0.06, 0.06]), ("by", [0.036667, 0.036667, 0.036667])]
)
def test_adjustment(ps, method, want, bounded):
    rows = got(p_adjust(ps, "p", ["k"], method, bounded=bounded))
    assert [q for k, p, q in rows if k == "a" and p is not None] == want
    assert [q for k, p, q in rows if k == "a" and p is None] == [None, None]
    assert len([q for k, p, q in rows if k == "" and q is not None]) == 2  # a NULL key is a family


def test_unknown_method_is_refused(ps):
    with pytest.raises(ValueError):
        p_adjust(ps, "p", ["k"], "tukey")


def test_global_families_have_no_product(ps):
    for df in (p_adjust(ps, "p"), mid_ranks(ps, (), "p"), quantiles(ps, (), "p", [0.5], ["m"])):
        assert "CartesianProduct" not in df._jdf.queryExecution().toString()


def test_quantiles_leave_nan_out(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (None,)], "v double")
    assert quantiles(df, (), "v", [0.25, 0.5], ["q", "m"]).first() == (1.5, 2.0)


def test_mid_rank_of_many_ties(spark):
    df = spark.range(5000).select((F.col("id") % 7).cast("double").alias("v"))
    w = mid_ranks(df, (), "v").groupBy("v").agg(F.min("mid_rank").alias("lo"), F.max("mid_rank").alias("hi"), F.count("*").alias("n")).orderBy("v").collect()
    below = 0
    for r in w:
        assert r.lo == r.hi == below + (r.n + 1) / 2
        below += r.n


def test_welch_edges(spark):
    rows = [("one", "A", 1.0), ("one", "B", 2.0), ("one", "B", 3.0), ("flat", "A", 1.0), ("flat", "A", 1.0), ("flat", "B", 2.0), ("flat", "B", 4.0), ("same", "A", 1.0), ("same", "A", 1.0), ("same", "B", 1.0), ("same", "B", 1.0)]
    t = {r.feature: r for r in comparisons.welch_table(spark.createDataFrame(rows, "feature string, grp string, value double"), "A", "B").collect()}
    assert t["one"].p is None and t["one"].q is None and t["one"].warning == "low_n"
    assert t["flat"].warning == "zero_variance" and t["flat"].p is not None
    assert t["same"].t is None and t["same"].p is None


def test_mann_whitney_exact_and_normal(spark):
    rows = [("small", "A", float(i)) for i in range(4)] + [("small", "B", float(i + 10)) for i in range(5)]
    rows += [("large", "A", float(i)) for i in range(12)] + [("large", "B", i + 0.5) for i in range(12)]
    t = {r.feature: r for r in comparisons.mann_whitney(spark.createDataFrame(rows, "feature string, grp string, value double"), "A", "B").collect()}
    assert t["small"].exact and t["small"].p == pytest.approx(2 / 126)
    assert not t["large"].exact and 0.7 < t["large"].p < 1


def test_missing_counts_absent_cells(spark):
    m = spark.createDataFrame([("f", "1", 5.0), ("f", "2", 0.0), ("g", "1", None)], "feature string, sample string, value double")
    s = spark.createDataFrame([("1",), ("2",), ("3",)], "sample string")
    t = {r.feature: r.n_missing for r in clean.missingness(m, s).collect()}
    assert t == {"f": 2, "g": 3}
    filled = clean.impute(m, s, "half_min").filter("feature = 'f'").collect()
    assert sorted((r["sample"], r.value) for r in filled) == [("1", 5.0), ("2", 0.0), ("3", 0.0)]
