"""Joins of measurement tables: range joins, overrides, re-keying, network scoping, orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.operators.base import join_same
from assaygrid.session import cut_lineage

PAIRS = 1_500_000  # pairs that a task of ``band_pairs`` makes


def band_join(left: DataFrame, right: DataFrame, keys, position: str, tolerance: float) -> DataFrame:
    """Pairs with equal keys and |left - right| <= tolerance: each right row stands in its own and both neighbouring bands of
    that width, so the join is on (keys, band).  Right columns get the suffix ``_r``."""
    keys = list(keys)
    band = F.floor(F.col(position) / tolerance)
    a = left.withColumn("_band", band)
    b = right.withColumn("_band", F.explode(F.array(band - 1, band, band + 1)))
    b = b.withColumnsRenamed({c: f"{c}_r" for c in right.columns if c not in keys})
    return a.join(b, [*keys, "_band"]).filter(F.abs(F.col(position) - F.col(f"{position}_r")) <= tolerance).drop("_band")


def band_pairs(table: DataFrame, keys, position: str, tolerance: float, name: str) -> DataFrame:
    """(keys, name, name_r): the pairs of ``table`` with equal keys and positions at most ``tolerance`` apart, each once, name < name_r.

    As ``band_join`` of the table with itself, but the names at one position travel and meet as one list: positions are
    compared once whatever the number of rows there, and only pairs that are close are made, many tasks at a time.
    """
    keys = list(keys)
    at = table.groupBy(*keys, position).agg(F.collect_list(name).alias("names"))
    at = cut_lineage(at.withColumn("_band", F.floor(F.col(position) / tolerance)))
    above = at.withColumn("_band", F.explode(F.array("_band", F.col("_band") - 1))).withColumnsRenamed({position: "_above", "names": "names_r"})
    near = lambda a, b: a.join(b, [*keys, "_band"]).filter((F.col("_above") >= F.col(position)) & (F.abs(F.col(position) - F.col("_above")) <= tolerance))
    pairs = near(at, above).agg(F.sum(F.size("names").cast("bigint") * F.size("names_r"))).first()[0] or 0
    parts = max(table.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS))  # lists are small beside their pairs: tasks go by pairs
    met = near(at.repartition(parts, *keys, "_band"), above.repartition(parts, *keys, "_band"))
    met = met.select(*keys, "names_r", (F.col(position) < F.col("_above")).alias("_apart"), F.explode("names").alias("_x"))
    met = met.select(*keys, "_apart", "_x", F.explode("names_r").alias("_y")).filter("_x < _y or (_apart and _x <> _y)")
    return met.select(*keys, F.least("_x", "_y").alias(name), F.greatest("_x", "_y").alias(f"{name}_r"))


def with_overrides(table: DataFrame, overrides: DataFrame, keys, columns) -> DataFrame:
    """Values of ``overrides`` take the place of the table's where they are not NULL."""
    o = overrides.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    t = join_same(table, o, keys, "left")
    return t.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def rekeyed(matrix: DataFrame, mapping: DataFrame, how: str = "mean") -> DataFrame:
    """Matrix under the mapped key (feature -> key); features that meet are joined by mean, max or sum, unmapped ones go."""
    f = {"mean": F.avg, "max": F.max, "sum": F.sum}[how]
    return matrix.join(mapping.select("feature", "key"), "feature").groupBy(F.col("key").alias("feature"), "sample").agg(f("value").alias("value"))


def prefix_lookup(features: DataFrame, annotation: DataFrame, separator: str = "-") -> DataFrame:
    """(feature, note): the annotation of the whole name, else of the part before the separator."""
    a = annotation.groupBy("key").agg(F.min("note").alias("note"))
    whole = features.join(a.withColumnsRenamed({"key": "feature", "note": "_whole"}), "feature", "left")
    t = whole.withColumn("_p", F.substring_index("feature", separator, 1)).join(a.withColumnsRenamed({"key": "_p", "note": "_part"}), "_p", "left")
    return t.select("feature", F.coalesce("_whole", "_part").alias("note"))


def observability(reactions: DataFrame, measured: DataFrame) -> DataFrame:
    """(rxn, role, member) -> per reaction how many members of each role are measured, and whether every role has one."""
    m = measured.select("member").distinct().withColumn("_m", F.lit(1))
    t = reactions.distinct().join(m, "member", "left").groupBy("rxn", "role").agg(F.count(F.lit(1)).alias("n"), F.count("_m").alias("k"))
    return t.groupBy("rxn").agg(F.sum("n").alias("n_members"), F.sum("k").alias("n_measured"), F.bool_and(F.col("k") > 0).alias("observable"))


def subgraph(edges: DataFrame, seeds: DataFrame, steps: int) -> DataFrame:
    """(node, distance) of the nodes within ``steps`` undirected steps of the seeds."""
    both = cut_lineage(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct())
    got = seeds.select("node").distinct().withColumn("distance", F.lit(0))
    for i in range(1, steps + 1):
        front = got.filter(F.col("distance") == i - 1).join(both, got["node"] == both["a"]).select(F.col("b").alias("node")).distinct()
        got = cut_lineage(got.union(front.join(got, "node", "left_anti").withColumn("distance", F.lit(i))))
    return got


def significant_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between two nodes of ``nodes``."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def sample_order(samples: DataFrame, control: str) -> DataFrame:
    """(sample, position): control group first, then group, time and the number in the name; samples are bounded by the design."""
    digits = F.regexp_extract("sample", "([0-9]+)$", 1)
    number = F.when(digits != "", digits.cast("bigint"))
    keys = (F.when(F.col("grp") == control, 0).otherwise(1), F.col("grp"), F.col("hours").asc_nulls_last(), number.asc_nulls_last(), F.col("sample"))
    return samples.withColumn("position", F.row_number().over(Window.orderBy(*keys)).cast("bigint")).select("sample", "position")


def isotopologue_order(iso: DataFrame) -> DataFrame:
    """(compound, i, place): inside a compound channels with a positive area first, each part by i."""
    seen = iso.groupBy("compound", "i").agg(F.max("area").alias("_top"))
    first = F.when(F.coalesce(F.col("_top"), F.lit(0.0)) > 0, 0).otherwise(1)
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("compound").orderBy(first, "i")).cast("bigint")).select("compound", "i", "place")


def natural_carbon(n: Column, most: int = 3, rate: float = 0.0107) -> Column:
    """Natural abundance of M+0 … M+most for n carbon atoms (binomial; 1.07 % of carbon is 13C), as an array."""
    first = F.pow(F.lit(1 - rate), n)
    start = F.struct(F.array(first).alias("p"), first.alias("last"))
    odds = rate / (1 - rate)
    step = lambda s, j: F.struct(
        F.concat(s["p"], F.array(s["last"] * (n - j + 1) / j * odds)).alias("p"), (s["last"] * (n - j + 1) / j * odds).alias("last")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["p"])
