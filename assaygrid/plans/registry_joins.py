"""More registered queries: range joins, overrides, re-keying, network scoping, scans of typed line tables, orderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaygrid.functions import dist, names
from assaygrid.operators import comparisons, joins, scans
from assaygrid.operators.base import attach_scalars, div, p_adjust
from assaygrid.plans import views as V
from assaygrid.plans.registry import PAIRS, QUERIES, SQL, R, _hits, _regions, query, rounded, sql
from assaygrid.plans.registry_links import EDGES, _edges

__all__ = ["QUERIES", "SQL"]


@query("""SELECT a.p_partkey, b.p_partkey AS p_partkey_r, a.p_brand FROM part a JOIN part b ON a.p_brand = b.p_brand AND abs(a.p_retailprice - b.p_retailprice) <= 1.5 AND a.p_partkey < b.p_partkey""")
def band_join(spark, sf):
    """All pairs of a brand's parts within 1.5 of each other's price; as many as the square of the parts in a band."""
    part = V.table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return joins.band_pairs(part, ("p_brand",), "p_retailprice", 1.5, "p_partkey").select("p_partkey", "p_partkey_r", "p_brand")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'VIP' END, c_mktsegment) AS c_mktsegment FROM customer")
def override_merge(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    o = c.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "VIP").alias("c_mktsegment"))
    return joins.with_overrides(c, o, ("c_custkey",), ("c_mktsegment",))


@query(sql("matrix", f"SELECT split_part(feature, '-', 1) AS feature, sample, {R('avg(value)')} AS value FROM matrix WHERE feature NOT LIKE '%-4' GROUP BY 1, 2"))
def rekeyed_matrix(spark, sf):
    m = V.matrix_sales(spark, sf)
    mapping = m.select("feature").distinct().filter("feature not like '%-4'").withColumn("key", F.substring_index("feature", "-", 1))
    return rounded(joins.rekeyed(m, mapping))


@query(sql("matrix", """SELECT feature, CASE WHEN feature LIKE '%-2' THEN 'whole ' || feature WHEN split_part(feature, '-', 1) <> 'Brand#11' THEN 'part ' || split_part(feature, '-', 1) END AS note FROM (SELECT DISTINCT feature FROM matrix)"""))
def annotation_lookup(spark, sf):
    f = V.matrix_sales(spark, sf).select("feature").distinct()
    brand = F.substring_index("feature", "-", 1)
    notes = f.filter("feature like '%-2'").select(F.col("feature").alias("key"), F.concat(F.lit("whole "), "feature").alias("note"))
    notes = notes.union(f.select(brand.alias("key"), F.concat(F.lit("part "), brand)).filter("key <> 'Brand#11'").distinct())
    return joins.prefix_lookup(f, notes)


@query("""SELECT rxn, CAST(sum(n) AS BIGINT) AS n_members, CAST(sum(k) AS BIGINT) AS n_measured, bool_and(k > 0) AS observable FROM (SELECT rxn, role, count(*) AS n, count(*) FILTER (member % 3 = 0) AS k FROM (
    SELECT DISTINCT l_orderkey AS rxn, l_returnflag AS role, l_partkey AS member FROM lineitem) GROUP BY 1, 2) GROUP BY 1""")
def reaction_observability(spark, sf):
    li = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rxn"), F.col("l_returnflag").alias("role"), F.col("l_partkey").alias("member"))
    measured = V.table(spark, sf, "part").select(F.col("p_partkey").alias("member")).filter("member % 3 = 0")
    return joins.observability(li, measured)


BOTH = EDGES + ", bo AS (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"


@query(sql("", """SELECT node, min(d) AS distance FROM (SELECT 'p7' AS node, 0 AS d UNION ALL SELECT b, 1 FROM bo WHERE a = 'p7' UNION ALL SELECT y.b, 2 FROM bo x JOIN bo y ON x.b = y.a WHERE x.a = 'p7') GROUP BY 1""", BOTH))
def subgraph_within_two(spark, sf):
    e = _edges(spark, sf)
    return joins.subgraph(e, e.filter("dst = 'p7'").select(F.col("dst").alias("node")), 2)


@query(sql("score", """SELECT src, dst FROM edges WHERE src IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier))
    AND dst IN (SELECT 'p' || member FROM score WHERE score >= (SELECT quantile_cont(score, 0.9) FROM score))""", EDGES))
def significant_subnetwork(spark, sf):
    """Links between suppliers of more than the mean balance and parts in the top tenth of revenue."""
    s = V.table(spark, sf, "supplier")
    rich = attach_scalars(s, s.agg(F.avg("s_acctbal").alias("m"))).filter("s_acctbal > m").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    nodes = rich.union(_hits(spark, sf).select(F.concat(F.lit("p"), "member")))
    return joins.significant_edges(_edges(spark, sf), nodes).select("src", "dst")


@query(sql("design", "SELECT sample, row_number() OVER (ORDER BY CASE WHEN grp = 'B' THEN 0 ELSE 1 END, grp, hours NULLS LAST, CAST(sample AS BIGINT), sample) AS position FROM design"))
def sample_order(spark, sf):
    return joins.sample_order(V.design_mid(spark, sf), "B")


@query(sql("mid", "SELECT compound, i, row_number() OVER (PARTITION BY compound ORDER BY CASE WHEN i % 2 = 0 THEN 0 ELSE 1 END, i) AS place FROM (SELECT DISTINCT compound, i FROM mid)"))
def isotopologue_order(spark, sf):
    m = V.mid(spark, sf).withColumn("area", F.when(F.col("i") % 2 == 0, F.col("area")).otherwise(0.0))
    return joins.isotopologue_order(m)


@query("SELECT p_partkey, " + R("pow(1 - 0.0107, p_size)", 9) + " AS m0, " + R("p_size * 0.0107 * pow(1 - 0.0107, p_size - 1)", 9) + " AS m1, " + R("p_size * (p_size - 1) / 2.0 * pow(0.0107, 2) * pow(1 - 0.0107, p_size - 2)", 9) + " AS m2 FROM part")
def natural_abundance(spark, sf):
    p = joins.natural_carbon(F.col("p_size").cast("double"))
    return rounded(V.table(spark, sf, "part").select("p_partkey", *[p[i].alias(f"m{i}") for i in range(3)]), 9)


@query(sql("cmatrix", "SELECT feature, sample, value FROM cmatrix"))
def count_table_scan(spark, sf):
    c = V.count_matrix(spark, sf)
    lines = c.select(F.concat_ws("\t", "feature", "sample", F.concat(F.col("value").cast("string"), F.lit(" "))).alias("line"))
    return scans.delimited(lines, ["feature", "sample", "value"], "\t").withColumn("value", F.col("value").try_cast("bigint"))


@query(sql("mid", f"SELECT compound, CAST(i AS INTEGER) AS i, sample, {R('area', 2)} AS area FROM mid"))
def isotopologue_table_scan(spark, sf):
    m = V.mid(spark, sf)
    lines = m.select(F.concat_ws(";", "compound", F.concat(F.lit("m+"), "i"), "sample", F.format_string("%.4f", "area")).alias("line"))
    t = scans.delimited(lines, ["compound", "label", "sample", "area"], ";")
    return rounded(t.select("compound", names.isotopologue(F.col("label")).alias("i"), "sample", scans.number_or_null(F.col("area")).alias("area")), 2)


@query(sql("design", f"SELECT sample, grp, {R('hours')} AS hours FROM design"))
def time_course_scan(spark, sf):
    d = V.design_mid(spark, sf)
    lines = d.select(F.concat_ws(",", "sample", "grp", F.concat((F.col("hours") * 60).cast("int").cast("string"), F.lit(" min"))).alias("line"))
    t = scans.delimited(lines, ["sample", "grp", "time"])
    return rounded(t.select("sample", "grp", names.hours(F.col("time")).alias("hours")))


@query(sql("mlog", f"SELECT feature, grp_a, grp_b, {R('abs(diff) / nullif(sqrt((va + vb) / 2), 0)', 5)} AS q_stat, {R('pow(va + vb, 2) / (va * va / (n_a - 1) + vb * vb / (n_b - 1))', 4)} AS df FROM pw", PAIRS))
def games_howell(spark, sf):
    t = comparisons.pairwise_welch(_regions(spark, sf))
    q = div(F.abs("diff"), F.sqrt((F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b")) / 2))
    return t.select("feature", "grp_a", "grp_b", (F.round(q, 5) + 0.0).alias("q_stat"), (F.round("df", 4) + 0.0).alias("df"))


@query(None)
def pairwise_contrasts(spark, sf):
    """All pairs of regions, adjusted within each feature."""
    t = comparisons.pairwise_welch(_regions(spark, sf)).withColumn("p", dist.t_sf("t", "df"))
    return rounded(p_adjust(t, "p", ("feature",), "holm", "q", bounded=True).select("feature", "grp_a", "grp_b", "diff", "t", "df", "p", "q"))
