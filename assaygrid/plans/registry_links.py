"""More registered queries: text scans, mappings, linked pairs, networks and models over samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.functions import names
from assaygrid.operators import isotopes, models, pairs, scans
from assaygrid.plans import views as V
from assaygrid.plans.registry import QUERIES, SQL, R, _hits, query, rounded, sql
from assaygrid.plans.views import sql_t_p

__all__ = ["QUERIES", "SQL"]


def _lines(spark, sf) -> DataFrame:
    """Line items as comma-separated text with missing-value words, a comment and blanks."""
    li = V.table(spark, sf, "lineitem")
    price = F.when(F.col("l_linenumber") == 3, "n/a").when(F.col("l_linenumber") == 4, "").otherwise(F.format_string("%.2f", "l_extendedprice"))
    line = F.concat_ws(",", F.col("l_orderkey"), F.concat(F.lit(" "), F.col("l_linenumber")), price, "l_returnflag")
    return li.select(F.explode(F.array(line, F.when(F.col("l_linenumber") == 1, F.lit("# note")).otherwise("  "))).alias("line"))


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(l_linenumber AS VARCHAR) AS pos, {R('CASE WHEN l_linenumber IN (3, 4) THEN NULL ELSE l_extendedprice END', 2)} AS price, l_returnflag AS flag FROM lineitem")
def delimited_scan(spark, sf):
    t = scans.delimited(_lines(spark, sf), ["id", "pos", "price", "flag"])
    return rounded(t.withColumn("price", scans.number_or_null(F.col("price"))), 2)


@query(f"""SELECT CAST(p_partkey AS VARCHAR) AS feature, sample, {R('value', 2)} AS value FROM (SELECT p_partkey, 'p_size' AS sample, CAST(p_size AS DOUBLE) AS value FROM part
    UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part UNION ALL SELECT p_partkey, 'p_brand', NULL FROM part)""")
def wide_to_long(spark, sf):
    return rounded(scans.wide_to_long(V.table(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice", "p_brand"]), 2)


@query("SELECT c AS \"column\", s AS share, s >= 0.8 AS is_sample FROM (VALUES ('p_partkey', 1.0::DOUBLE), ('p_size', 1.0), ('p_retailprice', 1.0), ('p_name', 0.0), ('p_brand', 0.0), ('p_type', 0.0)) AS t(c, s) WHERE (SELECT count(*) FROM part) > 0")
def sample_column_detection(spark, sf):
    return scans.sample_columns(V.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_name", "p_brand", "p_type"))


@query("""SELECT coalesce(a, b) AS sample, a IS NOT NULL AS in_matrix, b IS NOT NULL AS in_meta FROM (SELECT DISTINCT ' S' || l_partkey AS a, l_partkey AS k FROM lineitem)
    FULL JOIN (SELECT 's' || o_custkey || ' ' AS b, o_custkey AS k FROM orders GROUP BY 1, 2) USING (k)""")
def sample_alignment(spark, sf):
    """Numbers of parts sold against numbers of customers that ordered."""
    a = V.table(spark, sf, "lineitem").select(F.concat(F.lit(" S"), "l_partkey").alias("sample"))
    b = V.table(spark, sf, "orders").select(F.concat(F.lit("s"), "o_custkey", F.lit(" ")).alias("sample"))
    return scans.align_samples(a, b)


@query("SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS set_id, upper(unnest(string_split(p_name, ' '))) AS member FROM part")
def set_file_scan(spark, sf):
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_brand", F.replace("p_name", F.lit(" "), F.lit("\t")), F.lit(""))
    return scans.set_lines(V.table(spark, sf, "part").select(line.alias("line")))


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS member FROM part")
def id_list_scan(spark, sf):
    return scans.id_list(V.table(spark, sf, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("; ")), F.lit("  # of "), "p_brand").alias("line")))


@query("""SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, split_part(url, '://', 1) AS scheme, CASE WHEN regexp_matches(url, '[?]page=[0-9]+') THEN regexp_extract(url, '[?]page=([0-9]+)', 1) END AS page FROM pages""")
def attributes_from_names(spark, sf):
    p = V.table(spark, sf, "pages").select("page_id", "url")
    return scans.name_attributes(p, "url", {"host": "://([^/]+)", "scheme": "^([a-z]+)://", "page": "[?]page=([0-9]+)"}).drop("url")


@query(sql("meta", """SELECT c AS "column", n AS n_levels, CASE WHEN n < 2 THEN 'single' WHEN t OR n <= 15 THEN 'grouping' ELSE 'continuous' END AS kind FROM (SELECT 'grp' AS c, count(DISTINCT grp) AS n, true AS t FROM meta
    UNION ALL SELECT 'region', count(DISTINCT region), true FROM meta UNION ALL SELECT 'batch', count(DISTINCT batch), true FROM meta UNION ALL SELECT 'is_qc', count(DISTINCT is_qc), true FROM meta
    UNION ALL SELECT 'balance', count(DISTINCT balance), false FROM meta)"""))
def grouping_columns(spark, sf):
    return scans.grouping_columns(V.meta_sales(spark, sf).drop("sample"))


@query(sql("meta", "SELECT x.region || ' vs ' || y.region AS contrast, x.region AS a, y.region AS b FROM (SELECT DISTINCT region FROM meta) x JOIN (SELECT DISTINCT region FROM meta) y ON x.region < y.region"))
def all_contrasts(spark, sf):
    return scans.contrast_table(V.meta_sales(spark, sf).select(F.col("region").alias("grp")))


@query(sql("meta", "SELECT DISTINCT region || ' vs ASIA' AS contrast, region AS a, 'ASIA' AS b FROM meta WHERE region <> 'ASIA'"))
def reference_contrasts(spark, sf):
    return scans.contrast_table(V.meta_sales(spark, sf).select(F.col("region").alias("grp")), "ASIA")


@query(sql("design", """SELECT replicate, max(sample) FILTER (arm = 'A') AS sample_a, max(sample) FILTER (arm = 'B') AS sample_b FROM (SELECT grp AS arm, sample, row_number() OVER (PARTITION BY grp ORDER BY sample) AS replicate FROM design)
    GROUP BY replicate HAVING count(DISTINCT arm) = 2"""))
def replicate_pairs(spark, sf):
    d = V.design_mid(spark, sf).withColumn("replicate", F.row_number().over(Window.partitionBy("grp").orderBy("sample")).cast("bigint"))
    return scans.replicate_pairs(d, "A", "B")


@query("""SELECT item, coalesce(a, b) AS target, CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 END AS priority FROM (SELECT p_partkey AS item, (SELECT min(q.p_partkey) FROM part q WHERE q.p_name = p.p_name AND q.p_size <= 20) AS a,
    (SELECT min(q.p_partkey) FROM part q WHERE split_part(q.p_name, ' ', 1) = split_part(p.p_name, ' ', 1) AND q.p_size <= 20) AS b FROM part p)""")
def name_mapping(spark, sf):
    part = V.table(spark, sf, "part")
    first = F.substring_index("p_name", " ", 1)
    items = part.select(F.col("p_partkey").alias("item"), F.upper("p_name").alias("name"), first.alias("first"))
    known = part.filter("p_size <= 20")
    library = known.select(names.name_key(F.col("p_name")).alias("key"), F.col("p_partkey").alias("target"))
    library = library.union(known.select(F.concat(F.lit("first:"), first), "p_partkey"))
    return scans.map_by_priority(items, [names.name_key(F.col("name")), F.concat(F.lit("first:"), "first")], library)


# -- pairs and networks -----------------------------------------------------------------------------------------------

EDGES = "edges AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"
DIRECT = EDGES + ", direct AS (SELECT least(src, dst) AS f1, greatest(src, dst) AS f2 FROM edges), both_ AS (SELECT f1 AS a, f2 AS b FROM direct UNION ALL SELECT f2, f1 FROM direct)"
HUB = 100  # nodes with more links than this link no two others


def _edges(spark, sf):
    """Which supplier sold which part, over all line items."""
    li = V.table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()


@query(sql("", "SELECT f1, f2, 1 AS steps FROM direct", DIRECT))
def direct_links(spark, sf):
    return pairs.direct_links(_edges(spark, sf))


@query(sql("", f"""SELECT DISTINCT x.b AS f1, y.b AS f2, 2 AS steps FROM both_ x JOIN both_ y ON x.a = y.a AND x.b < y.b WHERE (x.b, y.b) NOT IN (SELECT (f1, f2) FROM direct)
    AND x.a IN (SELECT a FROM both_ GROUP BY 1 HAVING count(*) <= {HUB})""", DIRECT))
def two_step_links(spark, sf):
    """Nodes that share a neighbour; hubs above ``HUB`` links are left out by the operator's argument."""
    return pairs.two_step_links(_edges(spark, sf), most_degree=HUB)


VECP = """vp AS (SELECT x.feature AS f1, y.feature AS f2, x.grp, x.value AS x, y.value AS y FROM vec x JOIN vec y ON x.sample = y.sample AND CAST(substr(y.feature, 2) AS INT) - CAST(substr(x.feature, 2) AS INT) IN (1, 2)),
    dc AS (SELECT f1, f2, count(*) FILTER (grp = 'A') AS n_a, count(*) FILTER (grp = 'B') AS n_b, corr(x, y) FILTER (grp = 'A') AS r_a, corr(x, y) FILTER (grp = 'B') AS r_b FROM vp GROUP BY 1, 2)"""


def _vec(spark, sf):
    return V.matrix_vec(spark, sf).join(V.meta_vec(spark, sf).select("sample", "grp", "label", "batch"), "sample")


def _near(spark, sf):
    f = V.matrix_vec(spark, sf).select("feature").distinct().withColumn("i", F.substring("feature", 2, 9).cast("int"))
    step = f.select(F.col("feature").alias("f1"), F.explode(F.array(F.col("i") + 1, F.col("i") + 2)).alias("i"))
    return step.join(f.withColumnRenamed("feature", "f2"), "i").select("f1", "f2")


@query(sql("vec", f"""SELECT f1, f2, n_a, n_b, {R('r_a')} AS r_a, {R('r_b')} AS r_b, {R('(atanh(r_a) - atanh(r_b)) / sqrt(1.0 / (n_a - 3) + 1.0 / (n_b - 3))', 5)} AS z,
    CASE WHEN r_a * r_b < 0 AND abs(r_a) >= 0.4 AND abs(r_b) >= 0.4 THEN 'flipped' WHEN r_a * r_b > 0 AND abs(r_a) >= 0.6 AND abs(r_b) >= 0.6 THEN 'intact' WHEN abs(r_a) > abs(r_b) THEN 'lost' ELSE 'gained' END AS class FROM dc""", VECP))
def differential_correlation(spark, sf):
    t = pairs.differential_correlation(_vec(spark, sf), _near(spark, sf), "A", "B")
    return t.select("f1", "f2", "n_a", "n_b", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("r_a", 6), ("r_b", 6), ("z", 5))], "class")


@query(None)
def differential_correlation_permuted(spark, sf):
    return pairs.permutation_p(_vec(spark, sf), _near(spark, sf), "A", "B", 20)


@query(sql("vec", """SELECT set_id, count(*) AS n_pairs, count(*) FILTER (abs(r_a - r_b) >= 0.05) AS n_rewired FROM dc JOIN (SELECT DISTINCT feature AS f1, 'set' || CAST(substr(feature, 2) AS INT) // 8 AS set_id FROM vec) USING (f1)
    WHERE CAST(substr(f1, 2) AS INT) // 8 = CAST(substr(f2, 2) AS INT) // 8 GROUP BY 1""", VECP))
def rewired_sets(spark, sf):
    t = pairs.differential_correlation(_vec(spark, sf), _near(spark, sf), "A", "B")
    members = V.matrix_vec(spark, sf).select(F.col("feature").alias("member")).distinct()
    s = members.withColumn("set_id", F.concat(F.lit("set"), F.floor(F.substring("member", 2, 9).cast("int") / 8)))
    return pairs.rewired_sets(t, s, 0.05)


LAY = """ly AS (SELECT CAST(l_partkey AS VARCHAR) AS member, l_returnflag AS layer, avg(l_quantity) / 10 - 2.55 AS z FROM lineitem GROUP BY 1, 2)"""


def _layers(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_partkey").cast("string").alias("member"), F.col("l_returnflag").alias("layer")).agg((F.avg("l_quantity") / 10 - 2.55).alias("z"))


@query(sql("sets", f"""SELECT set_id, layer, n, {R('m')} AS mean_z, {R('st')} AS stouffer, {R('CASE WHEN q > 1e-12 THEN greatest(0, (q - (k - 1)) / q) ELSE 0 END')} AS i2 FROM (SELECT *, count(*) OVER s AS k, sum(n * m * m) OVER s - pow(sum(n * m) OVER s, 2) / sum(n) OVER s AS q
    FROM (SELECT set_id, layer, count(*) AS n, avg(z) AS m, sum(z) / sqrt(count(*)) AS st FROM sets JOIN ly USING (member) GROUP BY 1, 2) WINDOW s AS (PARTITION BY set_id))""", LAY))
def set_activity(spark, sf):
    return rounded(pairs.set_activity(V.part_sets(spark, sf), _layers(spark, sf)))


REG = LAY + """, zr AS (SELECT member, z FROM ly WHERE layer = 'R'), al AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(z) AS y, sum(z * z) AS yy FROM zr),
    rg AS (SELECT set_id AS regulator, count(*) AS k, sum(sg) AS x, CAST(count(*) AS DOUBLE) AS xx, sum(sg * z) AS xy FROM (SELECT set_id, member, CASE WHEN CAST(member AS BIGINT) % 3 = 0 THEN -1.0::DOUBLE ELSE 1 END AS sg FROM sets) JOIN zr USING (member) GROUP BY 1 HAVING count(*) >= 5),
    rs AS (SELECT regulator, k, n, xx - x * x / n AS sxx, xy - x * y / n AS sxy, yy - y * y / n AS syy FROM rg, al),
    rt AS (SELECT regulator, k AS n, sxy / sxx AS slope, sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS t, n - 2 AS df FROM rs),
    """


@query(sql("sets", f"SELECT regulator, n, {R('slope')} AS slope, {R('t', 5)} AS t, {R('p', 5)} AS p FROM rp", REG + f"rp AS (SELECT *, {sql_t_p('t', 'df')} AS p FROM rt)"))
def regulator_activity(spark, sf):
    t = V.part_sets(spark, sf).select(F.col("set_id").alias("regulator"), "member", F.when(F.col("member").cast("bigint") % 3 == 0, -1).otherwise(1).alias("sign"))
    t = pairs.regulator_activity(t, _layers(spark, sf).filter("layer = 'R'"))
    return t.select("regulator", "n", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("slope", 6), ("t", 5), ("p", 5))])


@query(sql("sets", f"SELECT node, k, {R('(a - (SELECT avg(z) FROM ly)) / (SELECT stddev_samp(z) FROM ly) * sqrt(k)')} AS reporter_z FROM (SELECT set_id AS node, count(*) AS k, avg(z) AS a FROM sets JOIN ly USING (member) GROUP BY 1)", LAY))
def reporter_scores(spark, sf):
    return rounded(pairs.reporter_scores(V.part_sets(spark, sf).withColumnRenamed("set_id", "node"), _layers(spark, sf)))


@query(sql("sets", f"""SELECT a, b, c AS n_common, {R('c / CAST(x.n + y.n - c AS DOUBLE)')} AS jaccard FROM (SELECT s.set_id AS a, t.set_id AS b, count(*) AS c FROM sets s JOIN sets t USING (member) WHERE s.set_id < t.set_id GROUP BY 1, 2)
    JOIN (SELECT set_id AS a, count(*) AS n FROM sets GROUP BY 1) x USING (a) JOIN (SELECT set_id AS b, count(*) AS n FROM sets GROUP BY 1) y USING (b)"""))
def set_overlaps(spark, sf):
    return rounded(pairs.set_overlaps(V.part_sets(spark, sf)))


@query(sql("", f"""SELECT member, {R('x')} AS first, {R('y')} AS second, CASE WHEN abs(x) >= 0.5 AND abs(y) >= 0.5 AND x * y > 0 THEN 'coupled' WHEN abs(x) >= 0.5 AND abs(y) >= 0.5 THEN 'opposing' WHEN abs(x) >= 0.5 THEN 'first_only'
    WHEN abs(y) >= 0.5 THEN 'second_only' ELSE 'unchanged' END AS class FROM (SELECT member, max(z) FILTER (layer = 'R') AS x, max(z) FILTER (layer = 'N') AS y FROM ly GROUP BY 1) WHERE x IS NOT NULL AND y IS NOT NULL""", LAY))
def concordance(spark, sf):
    t = _layers(spark, sf).groupBy("member").agg(F.max(F.when(F.col("layer") == "R", F.col("z"))).alias("first"), F.max(F.when(F.col("layer") == "N", F.col("z"))).alias("second"))
    t = t.filter("first is not null and second is not null")
    return rounded(t.withColumn("class", pairs.concordance_class("first", "second", 0.5)))


# -- models over samples ----------------------------------------------------------------------------------------------

OLS = """ols AS (SELECT feature, count(*) AS n, avg(value) AS ym, var_pop(value) * count(*) AS syy, var_pop(g) * count(*) AS s11, var_pop(b) * count(*) AS s22, covar_pop(g, b) * count(*) AS s12, covar_pop(g, value) * count(*) AS s1y, covar_pop(b, value) * count(*) AS s2y
    FROM (SELECT *, CASE WHEN grp = 'A' THEN 1.0 ELSE 0.0 END AS g, CASE WHEN batch = 'b1' THEN 1.0 ELSE 0.0 END AS b FROM vec) GROUP BY feature),
    co AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM ols)"""


@query(sql("vec", f"SELECT feature, n, {R('ym')} AS base_mean, {R('b1')} AS beta, {R('se')} AS se, {R('b1 / se', 5)} AS z FROM (SELECT *, sqrt((syy - b1 * s1y - b2 * s2y) / (n - 3) * s22 / det) AS se FROM co)", OLS))
def linear_model(spark, sf):
    design = V.meta_vec(spark, sf).select("sample", (F.col("grp") == "A").cast("int").alias("g"), (F.col("batch") == "b1").cast("int").alias("b"))
    t = models.linear_model(V.matrix_vec(spark, sf), design, "g", ["b"])
    return t.select("feature", "n", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("base_mean", 6), ("beta", 6), ("se", 6), ("z", 5))])


@query(sql("vec", f"""SELECT x.sample AS sample, {R('(sum(c) - 1) / (count(*) - 1)')} AS mean_r FROM (SELECT a.sample, b.sample AS other, corr(a.value, b.value) AS c FROM vec a JOIN vec b USING (feature) GROUP BY 1, 2) x GROUP BY 1"""))
def outlier_samples(spark, sf):
    return rounded(models.outlier_samples(V.matrix_vec(spark, sf)))


@query(None)
def impute_censored(spark, sf):
    return rounded(models.censored_draws(V.matrix_sales(spark, sf), V.meta_sales(spark, sf)))


FOLDS = """fo AS (SELECT f AS fold, sample FROM (SELECT DISTINCT sample FROM vec), range(0, 5) AS g(f) WHERE CAST(sample AS BIGINT) % 5 <> f),
    ft AS (SELECT fold, feature, abs((avg(value) FILTER (grp = 'A') - avg(value) FILTER (grp = 'B')) / sqrt(var_samp(value) FILTER (grp = 'A') / count(*) FILTER (grp = 'A') + var_samp(value) FILTER (grp = 'B') / count(*) FILTER (grp = 'B'))) AS t
    FROM vec JOIN fo USING (sample) GROUP BY 1, 2)"""


@query(sql("vec", "SELECT feature, count(*) AS picked, count(*) / 5.0::DOUBLE AS frequency FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY t DESC, feature) AS n FROM ft) WHERE n <= 10 GROUP BY 1", FOLDS))
def marker_panel(spark, sf):
    folds = V.meta_vec(spark, sf).select("sample", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("split")).filter("cast(sample as bigint) % 5 <> split")
    return models.stable_panel(_vec(spark, sf).select("feature", "sample", "grp", "value"), folds, "A", "B")


DEFAULT = """ms AS (SELECT feature, (count(*) - count(CASE WHEN value <> 0 THEN 1 END)) * 100.0 / count(*) AS pct FROM grid GROUP BY 1),
    im AS (SELECT feature, sample, log2(coalesce(value, (SELECT min(value) * 0.5 FROM matrix m WHERE m.feature = g.feature))) AS v FROM grid g WHERE feature IN (SELECT feature FROM ms WHERE pct <= 30)),
    st AS (SELECT sample, quantile_cont(log2(value), 0.25) AS q1, median(log2(value)) AS q2, quantile_cont(log2(value), 0.75) AS q3 FROM matrix GROUP BY 1)"""


@query(sql("grid", f"SELECT feature, sample, {R('(v - q2) / nullif(q3 - q1, 0)')} AS value FROM im JOIN st USING (sample)", DEFAULT))
def default_pipeline(spark, sf):
    return rounded(models.default_pipeline(V.matrix_sales(spark, sf), V.meta_sales(spark, sf)).select("feature", "sample", "value"))


@query(sql("mid design", f"""SELECT compound, i, {R('max(pct)')} AS peak FROM (SELECT compound, i, hours, avg(f) * 100 AS pct FROM (SELECT compound, i, sample, area / sum(area) OVER (PARTITION BY compound, sample) AS f FROM mid)
    JOIN design USING (sample) WHERE sample_type = 'labelled' AND include GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING max(pct) >= 15"""))
def channel_race(spark, sf):
    t = isotopes.channel_race(V.mid(spark, sf), isotopes.analysed(V.design_mid(spark, sf)), 15)
    return rounded(t.select("compound", "i", "peak"))


@query(sql("mid design", f"""SELECT n AS n_compounds, {R('m')} AS median_ratio, CASE WHEN n < 5 THEN 'unclear' WHEN m < 0.35 THEN 'corrected' WHEN m > 0.7 THEN 'uncorrected' ELSE 'unclear' END AS status FROM (SELECT count(*) AS n, median(o / 0.9) AS m FROM (
    SELECT compound, avg(m1 / m0) AS o FROM (SELECT compound, sample, max(area) FILTER (i = 0) AS m0, max(area) FILTER (i = 1) AS m1 FROM mid JOIN design USING (sample) WHERE sample_type = 'reference' GROUP BY 1, 2) GROUP BY 1) WHERE o IS NOT NULL)"""))
def reference_m1(spark, sf):
    m = V.mid(spark, sf)
    expected = m.select("compound").distinct().withColumn("expected", F.lit(0.9))
    return rounded(isotopes.reference_m1(m, V.design_mid(spark, sf), expected))


@query(sql("sets score", "SELECT set_id, count(*) AS n_hits FROM sets WHERE member IN (SELECT member FROM score WHERE score >= (SELECT quantile_cont(score, 0.9) FROM score)) GROUP BY 1"))
def set_intersections(spark, sf):
    return V.part_sets(spark, sf).join(_hits(spark, sf), "member", "left_semi").groupBy("set_id").agg(F.count(F.lit(1)).alias("n_hits"))



@query(None)
def pca_scores(spark, sf):
    return rounded(models.pca(V.matrix_vec(spark, sf), 2)[0])


@query(None)
def top_loadings(spark, sf):
    return rounded(models.top_loadings(models.pca(V.matrix_vec(spark, sf), 2)[1], 10))


@query(None)
def differential_correlation_q(spark, sf):
    m, p = _vec(spark, sf), _near(spark, sf)
    return rounded(pairs.permutation_q(pairs.differential_correlation(m, p, "A", "B"), pairs.permuted_z(m, p, "A", "B", 20), 20))


@query(None)
def batch_correction(spark, sf):
    return rounded(models.batch_corrected(V.matrix_vec(spark, sf), V.meta_vec(spark, sf)))


@query(None)
def isotope_correction(spark, sf):
    return rounded(isotopes.natural_correction(V.mid(spark, sf)))
