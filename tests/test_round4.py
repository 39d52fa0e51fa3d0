"""Evidence as arrays over the permutations against rows for each permutation, and what else the third round asked for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygrid.operators import cascade


def close(a, b, tol=1e-9):
    return (a is None) == (b is None) and (a is None or abs(a - b) <= tol * max(1, abs(b)))


def same_rows(one, two, *keys):
    one, two = ({tuple(r[k] for k in keys): r.asDict() for r in t.collect()} for t in (one, two))
    assert one.keys() == two.keys() and one
    for k, r in one.items():
        for c, v in r.items():
            assert (close(v, two[k][c]) if isinstance(v, float) or isinstance(two[k][c], float) else v == two[k][c]), (k, c, v, two[k][c])


@pytest.fixture(scope="module")
def evidence(spark):
    """Rules, stoichiometry with repeated and one-sided rows, and arrays of 21 draws with undefined values."""
    rng = np.random.default_rng(4)
    rules = [(int(r), f"c{c}", f"g{g}") for r in range(60) for c in range(rng.integers(1, 4)) for g in rng.choice(30, rng.integers(1, 4), replace=False)]
    stoich = [(int(r), f"m{m}", float(rng.choice([-1, 1]))) for r in range(3, 62) for m in rng.choice(15, rng.integers(1, 5), replace=False)]
    g = [(f"g{i}", [float("nan") if rng.random() < 0.1 else float(x) for x in rng.normal(0, 2, 21)]) for i in range(25)]
    m = [(f"m{i}", [float("nan") if i == 2 else float(x) for x in rng.normal(0, 1, 21)]) for i in range(12)]
    frame = spark.createDataFrame
    return (
        frame(rules + rules[:9], "rxn int, complex_id string, gene string"), frame(stoich + stoich[:9], "rxn int, met string, coef double"),
        frame(g, "gene string, e array<double>"), frame(m, "met string, z array<double>"), frame([(f"g{i}", float(i % 4)) for i in range(22)], "gene string, amount double"),
    )


def long(t, key, value):
    return t.select(key, F.posexplode(value).alias("perm", value))


def test_draws_of_a_feature_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    samples = [f"s{i}" for i in range(9)]
    deals = {s: [("A", "B", "C")[int(x)] for x in rng.integers(0, 3 if s == "s0" else 2, 7)] for s in samples}
    cells = {(f"f{f}", s): (5.0 if f == 1 else float(rng.normal())) for f in range(6) for s in samples if f != 5 or s < "s2"}
    groups = spark.createDataFrame([(s, p, g) for s, gs in deals.items() for p, g in enumerate(gs)], "sample string, perm int, grp string")
    matrix = spark.createDataFrame([(f, s, v) for (f, s), v in cells.items()] + [("f0", "other", 1.0)], "feature string, sample string, value double")
    got = {r.feature: r.z for r in cascade.draw_arrays(matrix, groups, "A", "B").collect()}
    assert got.keys() == {f for f, _ in cells}
    for f, zs in got.items():
        assert len(zs) == 7
        for p, z in enumerate(zs):
            a, b = ([v for (g, s), v in cells.items() if g == f and deals[s][p] == k] for k in "AB")
            se = np.sqrt(np.var(a, ddof=1) / len(a) + np.var(b, ddof=1) / len(b)) if len(a) > 1 and len(b) > 1 else 0
            assert close(z, (np.mean(a) - np.mean(b)) / se) if se > 0 else np.isnan(z)


def test_layer_activity_of_arrays_equals_rows(spark):
    rng = np.random.default_rng(8)
    z = spark.createDataFrame([(layer, f"m{i}", [float(x) for x in rng.normal(0, 1, 21)]) for layer in "ab" for i in range(20)], "layer string, member string, z array<double>")
    sets = spark.createDataFrame([(f"s{i // 6}", layer, f"m{i}") for layer in "ab" for i in range(20)], "set_id string, layer string, member string")
    rows = z.select("layer", "member", F.posexplode("z").alias("perm", "z"))
    for one, two, keys in zip(cascade.layer_activity(sets, z), cascade.layer_activity(sets, rows), (("set_id", "layer"), ("set_id",))):
        same_rows(one, two, *keys)


@pytest.mark.parametrize("small", [True, False])
def test_reporters_of_arrays_equal_rows(spark, evidence, monkeypatch, small):
    rules, stoich, g, m, amount = evidence
    monkeypatch.setattr(cascade, "BUCKET_VALUES", 2000)
    if not small:
        monkeypatch.setattr(cascade, "BROADCAST_BYTES", 0)
    z = cascade.over_reactions(rules, stoich, g, m, cascade.standard_columns, "z array<double>", amount)
    rows = cascade.cascade_scores(rules, stoich, long(g, "gene", "e"), long(m, "met", "z"), amount)
    same_rows(cascade.reporter_metabolites(stoich, z), cascade.reporter_metabolites(stoich, rows), "met")


@pytest.mark.parametrize("weighted", [True, False])
def test_calibration_of_arrays_equals_rows(spark, evidence, monkeypatch, weighted):
    rules, stoich, g, m, amount = evidence
    amount = amount if weighted else None
    monkeypatch.setattr(cascade, "BUCKET_VALUES", 2000)
    gl, ml = long(g, "gene", "e"), long(m, "met", "z")
    label = cascade.cascade_scores(rules, stoich, gl, ml, amount)
    topology = cascade.cascade_scores(rules, stoich, *cascade.topology_null(rules, stoich, gl, ml, 20), amount)
    same_rows(cascade.calibrated_arrays(rules, stoich, g, m, 20, amount), cascade.calibrated_reactions(label, topology), "rxn")


def test_four_families_are_adjusted_at_once(spark, evidence, monkeypatch):
    rules, stoich, g, m, amount = evidence
    calls, plain = [], cascade.p_adjust
    monkeypatch.setattr(cascade, "p_adjust", lambda *a, **k: calls.append(1) or plain(*a, **k))
    t = cascade.calibrated_arrays(rules, stoich, g, m, 20, amount).toPandas()
    assert len(calls) == 1  # each one wrote and joined the whole table
    for k in ("label", "topology", "balance", "enzyme"):
        p = t[f"p_{k}"].dropna().sort_values(ascending=False)
        want = (p * len(p) / np.arange(len(p), 0, -1)).cummin().clip(upper=1)
        assert len(p) and t[f"q_{k}"].notna().sum() == len(p)
        assert t[f"q_{k}"][want.index].to_numpy() == pytest.approx(want.to_numpy(), rel=1e-9)


def test_observed_scores_equal_rows(spark, evidence):
    rules, stoich, g, m, amount = evidence
    rows = cascade.cascade_scores(rules, stoich, long(g, "gene", "e"), long(m, "met", "z"), amount).filter("perm = 0").drop("perm")
    same_rows(cascade.observed_scores(rules, stoich, g, m, amount), rows, "rxn")


@pytest.mark.parametrize("small", [True, False])
def test_repeated_sides_travel_once(spark, evidence, monkeypatch, small):
    rules, stoich, g, m, amount = evidence
    if not small:
        monkeypatch.setattr(cascade, "BROADCAST_BYTES", 0)
    twice = stoich.union(stoich).union(stoich.withColumn("coef", F.col("coef") * 2))
    t = cascade.observed_scores(rules, twice, g, m, amount)
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(rxn" not in plan and "Keys: [rxn" not in plan  # a shuffle of its own to tell the sides apart
    same_rows(t, cascade.observed_scores(rules, stoich, g, m, amount), "rxn")


def test_orders_are_met_once_for_parts_and_suppliers(spark):
    from assaygrid.plans import registry_network as registry

    t = registry._amounts(spark, "/root/testdata/sf0.001")
    assert t._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    both = t.groupBy(F.substring("feature", 1, 1).alias("k")).agg(F.sum("value").alias("v"), F.countDistinct("feature").alias("n")).collect()
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    sales, parts, suppliers = li.agg(F.sum("l_extendedprice"), F.countDistinct("l_partkey"), F.countDistinct("l_suppkey")).first()
    assert {r.k: r.n for r in both} == {"g": parts, "m": suppliers} and all(r.v == pytest.approx(sales) for r in both)


def test_band_join_pairs_prices(spark):
    from assaygrid.plans.registry_joins import QUERIES

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_brand", "p_retailprice").collect()
    want = {(a.p_partkey, b.p_partkey) for a in part for b in part if a.p_brand == b.p_brand and abs(a.p_retailprice - b.p_retailprice) <= 1.5 and a.p_partkey < b.p_partkey}
    got = [(r.p_partkey, r.p_partkey_r) for r in QUERIES["band_join"](spark, "/root/testdata/sf0.001").collect()]
    assert want and len(got) == len(want) and set(got) == want


def test_walks_over_several_parts_and_chunks(spark, monkeypatch):
    from assaygrid.operators import network

    for name, value in (("WALKERS", 3), ("CHUNK", 4), ("LINKS", 7), ("TILE_LINKS", 12)):
        monkeypatch.setattr(network, name, value)
    rng = np.random.default_rng(9)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 25, (60, 2))})
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    names = sorted({x for a, b in pairs if a != b for x in (a, b)})
    at = {x: i for i, x in enumerate(names)}
    link = np.zeros((len(names), len(names)))
    for a, b in pairs:
        if a != b:
            link[at[a], at[b]] = link[at[b], at[a]] = 1
    start = {x: float(rng.normal()) for x in names[:9]}
    nodes, seeds = network.walk_seeds(edges, spark.createDataFrame([(f"n{x}", v) for x, v in start.items()], "node string, value double"), 4)
    s = np.zeros((len(names), 5))
    for r in seeds.collect():
        s[at[int(r.node[1:])], r.perm] = r.value
    want = np.linalg.solve(np.eye(len(names)) - 0.7 * link / link.sum(0), 0.3 * s / s.sum(0))
    got = network.walks(edges, nodes, seeds, 5, tolerance=1e-9).collect()
    assert len(got) == 2 * len(names)
    for r in got:
        for k in range(3):
            perm = r.block * 3 + k
            assert abs(r[f"r{k}"] - (want[at[int(r.node[1:])], perm] if perm < 5 else 0.0)) < 1e-9


def test_a_gap_travels_once_for_a_large_tile_of_donors(spark, monkeypatch):
    from assaygrid.operators import fill

    rng = np.random.default_rng(3)
    cells = [(f"f{f}", f"s{s}", float(rng.normal())) for f in range(6) for s in range(90) if rng.random() < (0.06 if f == 0 else 0.8)]
    matrix = spark.createDataFrame(cells, "feature string, sample string, value double")
    samples = matrix.select("sample").distinct()
    whole = fill.nearest_sample_impute(matrix, samples, 3)
    monkeypatch.setattr(fill, "TILE", 20)
    monkeypatch.setattr(fill, "NEAR", 4)
    monkeypatch.setattr(fill, "DONOR_TILES", 2)
    monkeypatch.setattr(fill, "PAIRS", 100)
    same_rows(fill.nearest_sample_impute(matrix, samples, 3), whole, "feature", "sample")


def test_two_step_links_equal_brute_force(spark, monkeypatch):
    from assaygrid.operators import pairs

    monkeypatch.setattr(pairs, "LIST", 3)
    monkeypatch.setattr(pairs, "PAIRS", 10)
    rng = np.random.default_rng(5)
    edges = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 30, (70, 2))]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for most in (None, 5):
        want = {(x, y) for m, l in near.items() if most is None or len(l) <= most for x in l for y in l if x < y and y not in near[x]}
        got = [(r.f1, r.f2) for r in pairs.two_step_links(spark.createDataFrame(edges, "src string, dst string"), most).collect()]
        assert len(got) == len(want) and set(got) == want


def test_few_modules_are_broadcast(spark, monkeypatch):
    from assaygrid.operators import modules

    t = spark.createDataFrame([(i % 3, i) for i in range(50)], "k int, v int")
    plan = lambda n: (monkeypatch.setattr(modules, "FEW", n), t.join(modules.few(t.select("k").distinct()), "k")._jdf.queryExecution().optimizedPlan().toString())[1]
    assert "broadcast" in plan(3) and "broadcast" not in plan(2)
