"""Imputation from other samples, peak numbering and choice, modules, factors and fused classifiers against brute force."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygrid.operators import factors, fill, modules, peaks

MATRIX = "feature string, sample string, value double"


def holes(seed, n_features=14, n_samples=23, share=0.25, rank=2):
    rng = np.random.default_rng(seed)
    full = 50 + rng.normal(0, 5, (n_features, rank)) @ rng.normal(0, 2, (rank, n_samples)) + rng.normal(0, 0.3, (n_features, n_samples))
    seen = rng.random(full.shape) > share
    return full, seen


def frame(spark, full, seen):
    rows = [(f"f{i:02d}", f"s{j:02d}", float(full[i, j])) for i in range(full.shape[0]) for j in range(full.shape[1]) if seen[i, j]]
    samples = spark.createDataFrame([(f"s{j:02d}",) for j in range(full.shape[1])], "sample string")
    return spark.createDataFrame(rows, MATRIX), samples


def test_nearest_samples_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fill, "TILE", 7)  # several tiles
    full, seen = holes(1)
    seen[:, 5] = False  # a sample without values
    seen[3] = False
    seen[3, :2] = True  # fewer donors than k
    seen[4] = False  # a feature without values
    m, samples = frame(spark, full, seen)
    m = m.union(spark.createDataFrame([("f04", "s00", None), ("f00", "other", 3.0)], MATRIX))
    got = {(r.feature, r.sample): (r.value, r.imputed) for r in fill.nearest_sample_impute(m, samples, 4).collect()}
    d = full.shape[0]
    want = {}
    for i, j in itertools.product(range(d), range(full.shape[1])):
        if seen[i, j]:
            want[f"f{i:02d}", f"s{j:02d}"] = (full[i, j], None)
            continue
        near = []
        for q in range(full.shape[1]):
            both = seen[:, j] & seen[:, q]
            if q != j and seen[i, q] and both.any():
                near.append((np.sum((full[both, j] - full[both, q]) ** 2) * d / both.sum(), f"s{q:02d}", full[i, q]))
        if near:
            want[f"f{i:02d}", f"s{j:02d}"] = (np.mean([v for _, _, v in sorted(near)[:4]]), "knn")
        elif seen[i].any():
            want[f"f{i:02d}", f"s{j:02d}"] = (full[i, seen[i]].mean(), "knn")
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    with pytest.raises(ValueError):
        fill.nearest_sample_impute(m, samples, most_features=3)


def test_low_rank_beats_the_mean_on_held_out_cells(spark):
    full, seen = holes(2, 30, 40, 0.2)
    m, samples = frame(spark, full, seen)
    a = {(r.feature, r.sample): r for r in fill.low_rank_impute(m, samples, rank=2).collect()}
    b = {(r.feature, r.sample): r.value for r in fill.low_rank_impute(m, samples, rank=2).collect()}
    gap = [(i, j) for i in range(30) for j in range(40) if not seen[i, j]]
    err = [a[f"f{i:02d}", f"s{j:02d}"].value - full[i, j] for i, j in gap]
    mean = [full[i, seen[i]].mean() - full[i, j] for i, j in gap]
    assert np.mean(np.square(err)) < 0.3 * np.mean(np.square(mean))
    assert len(a) == 1200 and all(abs(a[k].value - v) < 1e-4 for k, v in b.items()) and all(r.value >= 0 for r in a.values() if r.imputed)


def test_peak_numbers_equal_brute_force(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for name in "abcde":
        places = sorted(rng.sample(range(2, 40, 2), rng.randrange(1, 5)))
        for s in range(9):
            keep = [p for p in places if s < 3 or rng.random() < 0.7]
            rows += [(name, f"s{s}", p + rng.uniform(-1.4, 1.4), i) for i, p in enumerate(keep)]
    by = defaultdict(list)
    for n, s, rt, _ in rows:
        by[n, s].append(rt)
    for name in "abcde":
        mine = {s: sorted(v) for (n, s), v in by.items() if n == name}
        k = max(map(len, mine.values()))
        refs = np.median([v for v in mine.values() if len(v) == k], axis=0)
        for s, v in mine.items():
            best = min(itertools.combinations(range(k), len(v)), key=lambda c: (round(sum(abs(refs[j] - x) for j, x in zip(c, v)), 9), c))
            for j, x in zip(best, v):
                want[name, s, x] = (j + 1, k)
    got = peaks.number_peaks(spark.createDataFrame(rows, "name string, sample string, rt double, i int")).collect()
    assert {(r.name, r.sample, r.rt): (r.peak, r.n_peaks) for r in got} == want
    assert all(r.peak_label == f"{r.peak} of {r.n_peaks}" for r in got)
    mean = defaultdict(list)
    for (n, _, x), (p, _) in want.items():
        mean[n, p].append(x)
    assert all(abs(r.rt_mean - np.mean(mean[r.name, r.peak])) < 0.0051 for r in got)
    odd = peaks.number_peaks(spark.createDataFrame([("x", "s", None, 1), ("x", "s", 1.0, 2), ("x", "t", 1.0, 1), (None, "s", 2.0, 1)], "name string, sample string, rt double, i int")).collect()
    assert len(odd) == 4 and len({(r.name, r.sample, r.peak) for r in odd}) == 4


def test_places_of_many_rows_at_once():
    """Against the rule in lists: least total, then the earlier references; more than 62 references, ties and endless times among them."""

    def one(times, refs):
        state = [(0.0, [])] + [(np.inf, [])] * len(times)
        for j, r in enumerate(refs):
            state = [state[0]] + [min(state[i], (state[i - 1][0] + abs(times[i - 1] - r), state[i - 1][1] + [j])) for i in range(1, len(state))]
        return state[-1][1]

    rng = np.random.default_rng(5)
    rows = []
    for n in (130, 70, 64, 9, 6, 5, 4, 4, 3, 1, 0):
        m = int(rng.integers(0, n + 1)) if n else 0
        rows.append((np.sort(rng.integers(0, max(2, n // 2), m).astype(float)), np.sort(rng.integers(0, max(2, n // 2), n).astype(float))))
    rows[6] = (np.array([1.0, np.inf]), rows[6][1])
    m, n = (np.array([len(r[i]) for r in rows]) for i in (0, 1))
    times, refs = np.zeros((len(rows), m.max())), np.zeros((len(rows), n.max()))
    for k, (t, r) in enumerate(rows):
        times[k, : len(t)], refs[k, : len(r)] = t, r
    row, ref = peaks.assigned_places(times, m, refs, n)
    assert [ref[row == k].tolist() for k in range(len(rows))] == [one(*r) for r in rows]


def test_peaks_are_numbered_without_a_loop_in_expressions(spark):
    rows = [("x", s, float(p) + d, "note") for s, d in (("s", 0.0), ("t", 0.3), ("u", -0.2)) for p in range(70) if s != "u" or p % 7]
    df = peaks.number_peaks(spark.createDataFrame(rows + [("y", "s", None, None), (None, "s", float("nan"), "z")], "name string, sample string, rt double, a string"))
    assert "aggregate(" not in df._jdf.queryExecution().toString().lower().replace("hashaggregate(", "").replace("sortaggregate(", "")
    got = {(r.name, r.sample, r.rt): r for r in df.collect() if r.name == "x"}
    assert len(got) == len(rows) and all(r.peak == round(rt) + 1 and r.n_peaks == 70 for (_, _, rt), r in got.items())


def test_one_peak_stays(spark):
    cols = "key string, place int, method string, compound string, peak string, co_elutes string, detected int, n_samples int, labelled int, median_area double, warnings int"
    rows = [
        ("k1", 1, "pos", "a", "1 of 1", "Glucose (RT 1; -H2O)", 9, 9, 5, 900.0, 0), ("k1", 2, "neg", "a", "1 of 1", "", 5, 9, 1, 10.0, 3),
        ("k2", 1, "pos", "b", "1 of 2", "", 8, 9, 2, 100.0, 0), ("k2", 2, "pos", "b", "2 of 2", "", 9, 9, 2, 10.0, 0),
        ("k3", 1, "pos", "c", "1 of 2", "", 9, 9, 2, 100.0, 2), ("k3", 2, "pos", "c", "2 of 2", "", 9, 9, 2, 120.0, 1), ("k3", 3, "neg", "c", "1 of 1", "", 9, 9, 2, 160.0, 5),
        ("k4", 1, "pos", "d", "1 of 1", None, 1, 9, 0, 0.0, 0), ("k5", 1, "pos", "e", "1 of 1", "", 9, 9, 1, 0.0, 0), ("k5", 2, "neg", "e", "1 of 1", "", 9, 9, 1, 5.0, 0),
        ("k6", 1, "pos", "g", "1 of 1", "", 9, 9, 1, 10.0, 0), ("k6", 2, "neg", "g", "1 of 1", "", 9, 9, 1, 11.0, 0), ("k7", 1, "pos", "h", "1", "", 1, 9, 3, 1.0, 0), ("k7", 2, "neg", "h", "1", "", 1, 9, 4, 1.0, 0),
        ("k8", 1, "pos", "i", "1", "", 1, 9, 4, 1.0, 0), ("k8", 2, "neg", "i", "1", "", 1, 9, 4, 2.5, 3),
    ]
    t = {(r.key, r.place): r for r in peaks.one_peak_per_compound(spark.createDataFrame(rows, cols)).collect()}
    assert {k for k, r in t.items() if r.kept} == {("k1", 2), ("k2", 2), ("k3", 2), ("k4", 1), ("k5", 2), ("k6", 2), ("k7", 2), ("k8", 2)}
    why = {k: r.reason for k, r in t.items()}
    assert why["k1", 1] == "other peak co-elutes with Glucose (possible in-source fragment)" and why["k2", 1] == "detected in more samples (9/9 vs 8/9)"
    assert why["k3", 1] == "fewer peak warnings (1 vs 2); signal similar (1.2x)" and why["k3", 3] == "fewer peak warnings (1 vs 5); signal similar (1.3x)"
    assert why["k8", 1] == "higher signal (2.5x median area)"
    assert why["k5", 1] == "higher signal (infx median area)" and why["k6", 1] == "signal slightly higher (1.10x); all other checks equal" and why["k7", 1] == "more labeled isotopologues (4 vs 3)"
    forced = {(r.key, r.place): r for r in peaks.one_peak_per_compound(spark.createDataFrame(rows, cols), {"c": "pos", "d": "neg"}).collect()}
    assert forced["k3", 2].kept and forced["k3", 3].reason == "manual choice (PREFER)" and forced["k4", 1].kept


def module_data(spark, na=18, nb=20):
    """Features 0..3 correlated in group b only; 4, 5 by one outlier; the rest noise."""
    rng = np.random.default_rng(6)
    grp = np.array(["A"] * na + ["B"] * nb)
    n = na + nb
    x = rng.normal(0, 1, (8, n))
    base = rng.normal(0, 1, n)
    x[:4, grp == "B"] = base[grp == "B"] + 0.4 * x[:4, grp == "B"]
    x[4:6, n - 1] = 12.0
    imputed = rng.random((8, n)) < 0.15
    batch = np.where(np.arange(n) % 2, "b1", "b2")
    rows = [(f"f{i}", f"s{j:02d}", grp[j].item(), float(x[i, j]), batch[j].item(), bool(imputed[i, j])) for i in range(8) for j in range(n)]
    m = spark.createDataFrame(rows, "feature string, sample string, grp string, value double, batch string, imputed boolean")
    r = lambda i, j, g: np.corrcoef(x[i, grp == g], x[j, grp == g])[0, 1]
    pairs = [(f"f{i}", f"f{j}", sa, sb, "gained", float(r(i, j, "B") - r(i, j, "A")), i == 0) for sa, sb, i, j in [("p", "q", 0, 1), ("q", "p", 0, 2), ("p", "q", 1, 3), ("u", "v", 4, 5), ("w", "w", 6, 7)]]
    return x, grp, imputed, batch, m, spark.createDataFrame(pairs, "f1 string, f2 string, set_a string, set_b string, class string, delta double, linked boolean"), pairs


def test_module_checks_equal_brute_force(spark):
    x, grp, imputed, batch, m, p, pairs = module_data(spark)
    got = {(r.set_a, r.set_b): r for r in modules.score_modules(m, p, "A", "B", rounds=100).collect()}
    rank = lambda v: np.argsort(np.argsort(v)).astype(float)  # noqa: E731  (no ties)
    corr = lambda a, b: float(np.corrcoef(a, b)[0, 1])
    members = defaultdict(list)
    for f1, f2, sa, sb, _, delta, _ in pairs:
        members[min(sa, sb), max(sa, sb)].append((int(f1[1]), int(f2[1]), np.sign(delta)))
    for key, mine in members.items():
        stat = lambda pick, f=lambda v: v: np.mean([s * (corr(f(x[i, pick(i, j, "B")]), f(x[j, pick(i, j, "B")])) - corr(f(x[i, pick(i, j, "A")]), f(x[j, pick(i, j, "A")]))) for i, j, s in mine])
        r = got[key]
        assert r.n_pairs == len(mine) and abs(r.observed - stat(lambda i, j, g: grp == g)) < 1e-9
        assert abs(r.ranked - stat(lambda i, j, g: grp == g, rank)) < 1e-9
        assert abs(r.complete - stat(lambda i, j, g: (grp == g) & ~imputed[i] & ~imputed[j])) < 1e-9
        assert abs(r.batch_least - min(stat(lambda i, j, g, b=b: (grp == g) & (batch == b)) for b in ("b1", "b2"))) < 1e-9
        out = np.zeros(len(grp), bool)
        for g in "AB":
            v = x[sorted({k for i, j, _ in mine for k in (i, j)})][:, grp == g]
            med = np.median(v, axis=1, keepdims=True)
            far = (np.abs(v - med) / (1.4826 * np.median(np.abs(v - med), axis=1, keepdims=True))).max(axis=0)
            worst = [k for k in np.argsort(-far) if far[k] > 4][: max(1, int(0.2 * (grp == g).sum()))]
            out[np.flatnonzero(grp == g)[worst]] = True
        assert r.n_dropped == out.sum() and abs(r.kept - stat(lambda i, j, g: (grp == g) & ~out)) < 1e-9
    weights = modules.bootstrap_weights(m.select("sample", "grp"), 100).collect()
    w = np.zeros((101, len(grp)))
    for r in weights:
        w[r["round"], int(r.sample[1:])] = r.w
    assert all(w[b, grp == g].sum() == (grp == g).sum() for b in range(1, 101) for g in "AB")
    wc = lambda i, j, v: np.cov(x[i], x[j], aweights=v)[0, 1] / np.sqrt(np.cov(x[i], x[i], aweights=v)[0, 1] * np.cov(x[j], x[j], aweights=v)[0, 1])
    for key, mine in members.items():
        s = [np.mean([sg * (wc(i, j, w[b] * (grp == "B")) - wc(i, j, w[b] * (grp == "A"))) for i, j, sg in mine]) for b in range(1, 101)]
        assert abs(got[key].stability - np.mean(np.array(s) >= 0.2)) < 1e-9
    assert got["p", "q"].verdict == "robust" and got["u", "v"].influence_ok is False and got["u", "v"].verdict != "robust"
    few = {(r.set_a, r.set_b): r for r in modules.score_modules(m.filter("grp = 'B' or sample < 's04'"), p, "A", "B", max_modules=2).collect()}
    assert len(few) == 2 and all(r.stability is None and r.influence_ok is None and r.verdict in ("exploratory", "fragile") for r in few.values())


def test_block_factors_equal_svd(spark):
    rng = np.random.default_rng(9)
    z = rng.normal(0, 1, (60, 2))
    a = z @ rng.normal(0, 3, (2, 6)) + rng.normal(0, 0.5, (60, 6)) + 7
    b = z[:, :1] @ rng.normal(0, 30, (1, 4)) + rng.normal(0, 9, (60, 4))
    rows = [("a", f"a{j}", f"s{i:02d}", float(a[i, j])) for i in range(60) for j in range(6)] + [("b", f"b{j}", f"s{i:02d}", float(b[i, j])) for i in range(60) for j in range(4)]
    rows += [("a", "a0", "part", 1.0), ("b", "b0", "part", None)]
    m = spark.createDataFrame(rows, "block string, feature string, sample string, value double")
    scores, loadings, r2 = factors.block_factors(m, k=5)
    ac, bc = a - a.mean(0), b - b.mean(0)
    x = np.hstack([ac / np.linalg.norm(ac), bc / np.linalg.norm(bc)])
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    share = np.array([[(s[k] ** 2) * (vt[k, c] ** 2).sum() for k in range(5)] for c in (slice(0, 6), slice(6, 10))])
    keep = [k for k in np.argsort(-share.sum(0)) if share[:, k].max() >= 0.02]
    got = {(r.block, r.factor): r.r2 for r in r2.collect()}
    assert all(abs(got[c, j + 1] - share[i, k]) < 1e-9 for i, c in enumerate("ab") for j, k in enumerate(keep)) and len(got) == 2 * len(keep)
    sign = [np.sign(vt[k][np.abs(vt[k]).argmax()]) for k in range(5)]
    sc = {(r.sample, r.factor): r.score for r in scores.collect()}
    assert len(sc) == 60 * len(keep) and all(abs(sc[f"s{i:02d}", j + 1] - u[i, k] * s[k] * sign[k]) < 1e-8 for i in range(60) for j, k in enumerate(keep))
    ld = {(r.feature, r.factor): r.loading for r in loadings.collect()}
    assert all(abs(ld[f"b{q}", j + 1] - vt[k, 6 + q] * sign[k]) < 1e-8 for q in range(4) for j, k in enumerate(keep))
    with pytest.raises(ValueError):
        factors.block_factors(m, most_features=9)
    assert all(t.count() == 0 for t in factors.block_factors(m.limit(0)))
    cov = spark.createDataFrame([(f"s{i:02d}", "num", None, float(z[i, 0])) for i in range(60)] + [(f"s{i:02d}", "two", "hi" if z[i, 0] > 0 else "lo", None) for i in range(60)] + [(f"s{i:02d}", "three", f"t{i % 3}", None) for i in range(60)], "sample string, covariate string, text string, number double")
    t = {(r.factor, r.covariate): r for r in factors.factor_associations(scores, cov).collect()}
    first = np.array([sc[f"s{i:02d}", 1] for i in range(60)])
    order = lambda v: np.argsort(np.argsort(v))
    assert abs(t[1, "num"].statistic - np.corrcoef(order(first), order(z[:, 0]))[0, 1]) < 1e-9 and t[1, "num"].p < 1e-6
    hi, lo = first[z[:, 0] > 0], first[z[:, 0] <= 0]
    assert abs(t[1, "two"].statistic - (hi.mean() - lo.mean()) / np.sqrt(hi.var(ddof=1) / len(hi) + lo.var(ddof=1) / len(lo))) < 1e-9
    ranks = order(first) + 1
    h = 12 / (60 * 61) * sum(ranks[g::3].sum() ** 2 / 20 for g in range(3)) - 3 * 61
    assert abs(t[1, "three"].statistic - h) < 1e-9 and t[1, "three"].kind == "kruskal"


def test_loading_enrichment_finds_the_planted_set(spark):
    rng = random.Random(10)
    load = [("b", f"f{i:03d}", 1, rng.gauss(0, 1) + (2 if i < 10 else 0)) for i in range(120)]
    sets = [("hit", f"f{i:03d}") for i in range(10)] + [("none", f"f{i:03d}") for i in range(50, 70)] + [("few", "f001"), ("few", "x")]
    frames = spark.createDataFrame(load, "block string, feature string, factor int, loading double"), spark.createDataFrame(sets, "set_id string, member string")
    got = {r.set_id: r for r in factors.loading_enrichment(*frames, rounds=300).collect()}
    v = np.array([x[3] for x in load])
    z = (v - v.mean()) / v.std()
    assert got.keys() == {"hit", "none"} and abs(got["hit"].mean - z[:10].mean()) < 1e-6
    sd = lambda k: np.sqrt((1 - (k - 1) / 119) / k)  # noqa: E731  (without replacement)
    assert abs(got["hit"].z - z[:10].mean() / sd(10)) < 0.9 and got["hit"].q < 0.001 < got["none"].p


def test_fused_classifier_and_no_leakage(spark):
    rng = np.random.default_rng(12)
    y = np.arange(60) % 2
    x = rng.normal(0, 1, (60, 12))
    x[:, 0] += 1.5 * y
    x[:, 6] += 1.5 * y
    rows = [("ab"[j // 6], f"f{j:02d}", f"s{i:02d}", float(x[i, j])) for i in range(60) for j in range(12)]
    m = spark.createDataFrame(rows, "block string, feature string, sample string, value double")
    lab = lambda v: spark.createDataFrame([(f"s{i:02d}", int(v[i])) for i in range(60)], "sample string, y int")
    p, a = factors.late_fusion(m, lab(y))
    a = {r.block: r.auc for r in a.collect()}
    assert a["a"] > 0.7 and a["b"] > 0.7 and a["fused"] > max(a["a"], a["b"]) - 0.05
    by = defaultdict(list)
    for r in p.collect():
        by[r.block].append((r.score, r.y))
    for block, v in by.items():
        pos, neg = [s for s, c in v if c], [s for s, c in v if not c]
        assert len(v) == 60 and abs(a[block] - np.mean([(s > q) + 0.5 * (s == q) for s in pos for q in neg])) < 1e-9
    none = np.mean([r.auc for r in factors.late_fusion(m, lab(rng.permutation(y)))[1].collect()])
    assert none < 0.7
