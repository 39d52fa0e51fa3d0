"""What the findings of round 4 asked: plans that hold at size, with the same results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaygrid.operators import cascade, joins
from assaygrid.plans.registry_network import QUERIES
from assaygrid.session import cut_lineage


@pytest.fixture
def plans(monkeypatch):
    """Plans of the tables that ``cascade`` writes."""
    out = []

    def cut(df):
        out.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df)

    monkeypatch.setattr(cascade, "cut_lineage", cut)
    return out


def test_layer_activity_never_broadcasts_sets(spark, plans):
    """Sets are many rows though they look small to the planner; repeated rows count once, a set without a name is a set."""
    sets = spark.range(24).select(F.when(F.col("id") % 4 > 0, F.concat(F.lit("s"), F.col("id") % 4)).alias("set_id"), F.lit("R").alias("layer"), (F.col("id") % 12).cast("string").alias("member"))
    z = spark.range(12).select(F.lit("R").alias("layer"), F.col("id").cast("string").alias("member"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.sin(F.col("id") * 3 + i * i)).alias("z"))
    one, classes = cascade.layer_activity(sets, z)
    assert {r.set_id: r.n for r in one.collect()} == {"s1": 3, "s2": 3, "s3": 3, None: 3}
    assert classes.count() >= 3
    joins = [p for p in plans if "member" in p and "Join" in p]
    assert joins and not any("BroadcastHashJoin" in p for p in joins)


def test_band_pairs_against_brute_force(spark):
    """Equal positions, the edge of the tolerance, repeated names, NULL and NaN; the pairs are made by many tasks."""
    rows = [(i % 40, "ab"[i % 2] if i % 7 else None, None if i % 11 == 0 else float("nan") if i % 13 == 0 else (i * i % 23) * 0.5) for i in range(90)]
    got = joins.band_pairs(spark.createDataFrame(rows, "id int, key string, rt double"), ("key",), "rt", 1.5, "id").collect()
    want = [(k, i, j) for i, k, x in rows for j, m, y in rows if k is not None and k == m and i < j and None not in (x, y) and abs(x - y) <= 1.5]
    assert sorted((r.key, r.id, r.id_r) for r in got) == sorted(want) and len(want) > 100
    assert QUERIES["band_join"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("broadcast", [True, False])
def test_reactions_bring_their_metabolites(spark, plans, monkeypatch, broadcast):
    """Scores that hold their metabolites, measured or not, give what a join with the stoichiometry gives, and nothing is joined or written for it."""
    monkeypatch.setattr(cascade, "BROADCAST_BYTES", cascade.BROADCAST_BYTES if broadcast else 0)
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame
    rules = frame([(r, f"c{c}", f"g{rng.integers(20)}") for r in range(50) for c in range(2)], "rxn int, complex_id string, gene string")
    sides = [(int(r), f"m{m}", float(rng.choice([-1, 0, 1]))) for r in range(3, 55) for m in rng.integers(0, 12, 4)]
    stoich = frame([*sides, (7, None, 1.0), (9, None, -1.0), (8, "m1", 1.0), (8, "m1", -1.0)], "rxn int, met string, coef double")
    g = frame([(f"g{i}", [float(x) for x in rng.normal(0, 2, 11)]) for i in range(18)], "gene string, e array<double>")
    m = frame([(f"m{i}", [float(x) for x in rng.normal(0, 1, 11)]) for i in range(9)], "met string, z array<double>")  # m9 to m11 are not measured
    scores = [cascade.over_reactions(rules, stoich, g, m, cascade.standard_columns, "z array<double>", around=x) for x in (False, True)]
    want = {r.met: r for r in cascade.reporter_metabolites(stoich, scores[0]).collect()}
    plans.clear()
    got = {r.met: r for r in cascade.reporter_metabolites(None, scores[1], perms=11).collect()}
    assert not plans and got.keys() == want.keys() and {None, "m9", "m10", "m11"} <= got.keys()
    for met, r in want.items():
        assert got[met].n_reactions == r.n_reactions and got[met].reporter_z == pytest.approx(r.reporter_z) and got[met].q == pytest.approx(r.q)
