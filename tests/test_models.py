"""PCA against numpy, files round trip, permutation and censored draws as functions of their seed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygrid.functions import dist
from assaygrid.operators import comparisons, joins, layers, models, pairs, scans, sinks


@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 6)) @ rng.normal(size=(6, 6)) + 5
    rows = [(f"f{j}", f"s{i:02d}", "A" if i % 2 else "B", float(x[i, j])) for i in range(30) for j in range(6)]
    return x, spark.createDataFrame(rows, "feature string, sample string, grp string, value double")


def test_pca(grid):
    x, m = grid
    scores, loadings, shares = models.pca(m, 2)
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert shares == pytest.approx((s**2 / np.sum(s**2))[:2])
    got = {(r["sample"], r.pc): r.score for r in scores.collect()}
    for c in range(2):
        sign = np.sign(vt[c][np.abs(vt[c]).argmax()])
        assert [got[f"s{i:02d}", c + 1] for i in range(30)] == pytest.approx(list(u[:, c] * s[c] * sign))
    size = {r.feature: r["size"] for r in models.top_loadings(loadings, 3).collect()}
    want = np.hypot(vt[0], vt[1])
    assert list(size) == [f"f{j}" for j in np.argsort(-want)[:3]]
    with pytest.raises(ValueError):
        models.pca(m, 2, most_features=3)


def test_outliers_equal_the_mean_correlation(grid):
    x, m = grid
    r = np.corrcoef(x)
    want = {f"s{i:02d}": (r[i].sum() - 1) / 29 for i in range(30)}
    assert {q["sample"]: q.mean_r for q in models.outlier_samples(m).collect()} == pytest.approx(want)


def test_permutations_keep_group_sizes_and_repeat(grid):
    _, m = grid
    s = m.select("sample", "grp").distinct()
    a, b = (sorted(map(tuple, pairs.permuted_groups(s, 3, 7).collect())) for _ in range(2))
    assert a == b
    assert {r["count"] for r in pairs.permuted_groups(s, 3, 7).groupBy("round", "grp").count().collect()} == {15}


def test_censored_draws_stay_below_the_lower_quartile(spark, grid):
    _, m = grid
    holes = m.filter("not (feature = 'f1' and sample in ('s03', 's04'))").select("feature", "sample", "value")
    samples = m.select("sample").distinct()
    out = models.censored_draws(holes, samples).filter("imputed").collect()
    low = np.quantile([r.value for r in holes.filter("feature = 'f1'").collect()], 0.25)
    assert len(out) == 2 and all(0 <= r.value <= low + 1e-9 for r in out)


def test_sinks_round_trip(spark, grid, tmp_path):
    _, m = grid
    sinks.write_matrix(m, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).exceptAll(m.select("feature", "sample", "value")).count() == 0
    sinks.write_matrix(m, str(tmp_path / "t"), text=True)
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).count() == m.count()
    edges = spark.createDataFrame([("a", "b"), ("b", "x")], "src string, dst string")
    sinks.write_graph(spark.createDataFrame([("a",), ("b",)], "node string"), edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).select("src", "dst").collect() == [("a", "b")]


def test_band_join_at_the_edge_of_a_band(spark):
    a = spark.createDataFrame([("k", 1, 0.99), ("k", 2, -0.2)], "key string, id int, rt double")
    b = spark.createDataFrame([("k", 8, 1.49), ("k", 9, 1.51), ("k", 7, 0.3)], "key string, id int, rt double")
    got = {(r.id, r.id_r) for r in joins.band_join(a, b, ("key",), "rt", 0.5).collect()}
    assert got == {(1, 8), (2, 7)}


def test_blank_and_broken_lines(spark):
    lines = spark.createDataFrame([("﻿a,1,x",), ("",), (None,), ("# c",), ("b,N/A",), ("c, 2.5 ,y,extra",)], "line string")
    rows = scans.delimited(lines, ["id", "value", "note"]).collect()
    assert [tuple(r) for r in rows] == [("a", "1", "x"), ("b", None, None), ("c", "2.5", "y")]


def test_batch_correction_keeps_groups(spark):
    rng = np.random.default_rng(5)
    rows, design = [], []
    for i in range(40):
        g, b = i % 2, (i // 2) % 3
        design.append((f"s{i}", f"g{g}", f"b{b}"))
        rows += [(f"f{j}", f"s{i}", float(2 * g + 3 * b + rng.normal() * (1 + b))) for j in range(3)]
    m = spark.createDataFrame(rows, "feature string, sample string, value double")
    d = spark.createDataFrame(design, "sample string, grp string, batch string")
    t = models.batch_corrected(m, d).join(d, "sample").toPandas()
    for _, f in t.groupby("feature"):
        x = np.array([[1, g == "g1", b == "b1", b == "b2"] for g, b in zip(f.grp, f.batch)], float)
        beta = np.linalg.lstsq(x, f.value.to_numpy(), rcond=None)[0]
        assert abs(beta[2]) < 1.2 and abs(beta[3]) < 1.2 and 0.5 < beta[1] < 3.5
        res = f.value - x @ beta
        spread = res.groupby(f.batch.to_numpy()).std()
        assert spread.max() / spread.min() < 1.6


def test_natural_correction_inverts_the_natural_spread(spark):
    from math import comb

    from assaygrid.operators import isotopes

    true, n, r = [0.5, 0.0, 0.3, 0.2], 3, 0.0107
    seen = [sum(true[j] * comb(n - j, i - j) * r ** (i - j) * (1 - r) ** (n - i) for j in range(i + 1)) for i in range(n + 1)]
    df = spark.createDataFrame([("c", "s", i, n, 1000 * v) for i, v in enumerate(seen)], "compound string, sample string, i int, n int, area double")
    got = {x.i: x.fraction for x in isotopes.natural_correction(df).collect()}
    assert [got[i] for i in range(n + 1)] == pytest.approx(true, abs=1e-9)


def test_permutation_q(spark):
    obs = [("a", "b", 3.0), ("a", "c", -2.0), ("a", "d", 1.0), ("a", "e", 0.5)]
    perm = [0.2, 0.6, 1.1, 2.0, 0.4, 0.3, 0.9, 1.5]  # two rounds
    got = {x.f2: x.q for x in pairs.permutation_q(spark.createDataFrame(obs, "f1 string, f2 string, z double"), spark.createDataFrame([(p,) for p in perm], "z double"), 2).collect()}
    raw = [sum(p >= abs(z) for p in perm) / 2 / sum(abs(y) >= abs(z) for *_, y in obs) for *_, z in obs]
    want = [min(1, min(raw[i:])) for i in range(4)]
    assert [got[k] for k in "bcde"] == pytest.approx(want)


def test_designs_of_any_size_stay_off_the_driver(spark):
    n = 100_002
    d = spark.range(n).select(F.col("id").cast("string").alias("sample"), (F.col("id") % 2).alias("g"), (F.col("id") % 7).alias("c"))
    noise = F.when(F.col("sample").cast("int") % 4 < 2, 0.5).otherwise(-0.5)
    m = d.select(F.lit("f").alias("feature"), "sample", (3 + 2 * F.col("g") - F.col("c") + noise).alias("value"))
    got = models.linear_model(m, d, "g", ["c"]).collect()
    assert len(got) == 1 and got[0].n == n and abs(got[0].beta - 2) < 1e-2
    named = d.select("sample", F.concat(F.lit("g"), "g").alias("grp"), F.concat(F.lit("b"), "c").alias("batch"))
    means = models.batch_corrected(m, named).join(named, "sample").groupBy("grp", "batch").agg(F.avg("value").alias("v")).collect()
    assert len(means) == 14
    for g in ("g0", "g1"):
        at = [r.v for r in means if r.grp == g]
        assert max(at) - min(at) < 1e-2


def test_moderated_t_equals_brute_force(spark):
    """Against the moments of the log variances, written out."""
    rng = np.random.default_rng(4)
    sd = np.sqrt(4 * 0.5 / rng.chisquare(4, 60))
    x = rng.normal(0, 1, (60, 10)) * sd[:, None]
    x[0, :5] += 4 * sd[0]
    rows = [(f"f{i:02d}", f"s{j}", "A" if j < 5 else "B", float(x[i, j])) for i in range(60) for j in range(10)]
    got = {r.feature: r for r in comparisons.moderated_t(spark.createDataFrame(rows, "feature string, sample string, grp string, value double"), "A", "B").collect()}
    s2 = (x[:, :5].var(axis=1, ddof=1) + x[:, 5:].var(axis=1, ddof=1)) / 2
    e = np.log(s2) - dist.digamma(4.0) + np.log(4.0)
    over = e.var(ddof=1) - dist.polygamma_series(4.0, 1)
    assert over > 0
    d0 = 2 * dist.trigamma_inverse(over)
    s02 = np.exp(e.mean() + dist.digamma(d0 / 2) - np.log(d0 / 2))
    post = (d0 * s02 + 8 * s2) / (d0 + 8)
    t = (x[:, :5].mean(axis=1) - x[:, 5:].mean(axis=1)) / np.sqrt(post * 0.4)
    for i in range(60):
        r = got[f"f{i:02d}"]
        assert r.s2_post == pytest.approx(post[i]) and r.t_mod == pytest.approx(t[i]) and r.df_total == pytest.approx(8 + d0)
        assert r.p_mod == pytest.approx(float(dist.t_two_sided(np.array([t[i]]), np.array([8 + d0]))[0]))
        assert np.sign(r.z_mod) == np.sign(t[i]) and 2 * float(dist.norm_tail(np.array([abs(r.z_mod)]))[0]) == pytest.approx(r.p_mod, rel=1e-6)
    assert min(got.values(), key=lambda r: r.p_mod).feature == "f00"


def test_studentised_range_of_groups(spark):
    """Published upper points of the studentised range, and both post hoc tests through them."""
    for q, k, df, p in ((3.877, 3, 10, 0.05), (3.958, 4, 20, 0.05), (4.82, 5, 60, 0.01), (3.63, 3, 1e6, 0.0278)):
        assert float(dist.range_tail(np.array([q]), np.array([float(k)]), np.array([float(df)]))[0]) == pytest.approx(p, rel=0.02)
    rng = np.random.default_rng(5)
    rows = [("f", f"s{j}", "abc"[j % 3], float(rng.normal(2.0 * (j % 3 == 2), 1))) for j in range(30)]
    df = spark.createDataFrame(rows, "feature string, sample string, grp string, value double")
    for f in (comparisons.tukey_kramer, comparisons.games_howell):
        got = {(r.grp_a, r.grp_b): r for r in f(df).collect()}
        assert got["a", "b"].p > 0.05 > max(got["a", "c"].p, got["b", "c"].p)
        r = got["a", "c"]
        assert r.p == pytest.approx(float(dist.range_tail(np.array([r.q_stat]), np.array([3.0]), np.array([float(getattr(r, "df2", None) or r.df)]))[0]), rel=1e-6)


def test_pairwise_contrasts_equal_the_two_group_test(spark):
    rng = np.random.default_rng(6)
    rows = [(f"f{i}", f"s{j}", "abc"[j % 3], float(rng.normal(j % 3, 1 + i))) for i in range(4) for j in range(18)]
    df = spark.createDataFrame(rows, "feature string, sample string, grp string, value double")
    every = {(r.feature, r.grp_a, r.grp_b): r for r in comparisons.pairwise_welch(df).collect()}
    assert len(every) == 12
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        for r in comparisons.welch(df.filter(F.col("grp").isin(a, b)), a, b).collect():
            mine = every[r.feature, a, b]
            assert mine.t == pytest.approx(r.t) and mine.df == pytest.approx(r.df)


def test_layers(spark):
    f = spark.createDataFrame([("k1", "a", 1.0), ("k1", "b", 2.0), ("k1", "c", 2.0), ("k2", "d", None), ("", "e", 1.0), (None, "f", 1.0)], "key string, feature string, mean double")
    assert {(r.key, r.feature) for r in layers.representative(f).collect()} == {("k1", "b"), ("k2", "d")}
    rng = np.random.default_rng(7)
    x = rng.normal(0, 2, 80)
    y = 0.6 * x + rng.normal(0, 0.5, 80)
    y[0] = -6.0
    q = lambda v: np.where(np.abs(v) > 2, 0.01, 0.5)
    frame = lambda v: spark.createDataFrame([(f"k{i}", float(v[i]), float(q(v)[i])) for i in range(80)] + [("nan", None, 0.1)], "key string, z double, q double")
    got = {r.key: r for r in layers.concordance(frame(x), frame(y)).collect() if r.z_first is not None}
    sxx, syy, sxy = x.var(ddof=1), y.var(ddof=1), np.cov(x, y)[0, 1]
    beta = (syy - sxx + np.sqrt((syy - sxx) ** 2 + 4 * sxy**2)) / (2 * sxy)
    for i in range(80):
        r = got[f"k{i}"]
        assert r.beta == pytest.approx(beta) and r.coupling == pytest.approx(np.corrcoef(x, y)[0, 1])
        assert r.discordance == pytest.approx((y[i] - beta * x[i]) / np.sqrt(1 + beta**2))
        a, b = abs(x[i]) > 2, abs(y[i]) > 2
        assert r["class"] == ("Coupled" if a and b and x[i] * y[i] > 0 else "Opposing" if a and b else "Protein-only (post-transcriptional)" if b else "mRNA-only (buffered)" if a else "Unchanged")
    assert min(got.values(), key=lambda r: r.p).key == "k0"
    cells = lambda s: spark.createDataFrame([(k, f"s{j}", "AB"[j % 2], float(rng.normal() if k == "n" else j // 2 * s + 5 * (j % 2))) for k in ("n", "c") for j in range(16)], "key string, sample string, grp string, value double")
    w = {r.key: r for r in layers.within_sample_coupling(cells(1.0), cells(-2.0)).collect()}
    assert w["c"].rho == pytest.approx(-1.0) and abs(w["n"].rho) < 0.8 and w["c"].n == 16


def test_regulators_equal_least_squares(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(0, 1, 120)
    z[:10] += 2
    t = [("up", f"g{i}", 1) for i in range(10)] + [("mix", f"g{i}", (-1) ** i) for i in range(40, 70)] + [("few", f"g{i}", 1) for i in range(3)] + [("up", "absent", 1)]
    s = spark.createDataFrame([(f"g{i}", float(z[i])) for i in range(120)] + [("x", None)], "member string, z double")
    got = {r.regulator: r for r in pairs.regulator_activity(spark.createDataFrame(t, "regulator string, member string, sign int"), s).collect()}
    assert got.keys() == {"up", "mix"}
    for name, r in got.items():
        w = np.zeros(120)
        for g, m, sign in t:
            if g == name and m != "absent":
                w[int(m[1:])] = sign
        X = np.column_stack([np.ones(120), w])
        beta = np.linalg.lstsq(X, z, rcond=None)[0]
        se = np.sqrt(((z - X @ beta) ** 2).sum() / 118 * np.linalg.inv(X.T @ X)[1, 1])
        assert r.slope == pytest.approx(beta[1]) and r.t == pytest.approx(beta[1] / se)
