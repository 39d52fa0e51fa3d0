"""Registered queries of cascades, set statistics with a null, walks on networks, rank aggregation and reaction pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assaygrid.functions import dist
from assaygrid.operators import cascade, factors, fill, layers, modules, network, pairs, peaks, sets
from assaygrid.operators.base import p_adjust
from assaygrid.plans import views as V
from assaygrid.plans.registry import query, rounded, sql
from assaygrid.plans.registry_joins import QUERIES, SQL
from assaygrid.plans.registry_links import LAY, R, _layers, _near
from assaygrid.plans.views import sql_bh, sql_norm_p
from assaygrid.session import cut_lineage

__all__ = ["QUERIES", "SQL"]

# -- orders as reactions: parts are genes and suppliers metabolites, in 24 samples (customers' numbers) of two groups ------


def _samples(spark, sf):
    k = V.table(spark, sf, "orders").select((F.col("o_custkey") % 24).alias("k")).distinct()
    return k.select(F.col("k").cast("string").alias("sample"), F.when(F.col("k") % 2 == 0, "A").otherwise("B").alias("grp"))


def _amounts(spark, sf):
    """Sales of parts (g...) and suppliers (m...) in the samples; orders are met once for both."""
    o = V.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 24).cast("string").alias("sample"))
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    both = F.explode(F.array(F.concat(F.lit("g"), "l_partkey"), F.concat(F.lit("m"), "l_suppkey"))).alias("feature")
    return li.select(both, "sample", "l_extendedprice").filter("feature is not null").groupBy("feature", "sample").agg(F.sum("l_extendedprice").alias("value"))


def _rules(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("rxn"), F.concat("l_returnflag", "l_linestatus").alias("complex_id"), F.col("l_partkey").cast("string").alias("gene"))


def _stoich(spark, sf, met="l_suppkey"):
    li = V.table(spark, sf, "lineitem")
    made = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    return li.select(F.col("l_orderkey").alias("rxn"), F.col(met).cast("string").alias("met"), made.alias("coef"))


def _evidence(spark, sf, groups):
    """Evidence of parts and suppliers, each with an array over the perms of ``groups``."""
    t = cut_lineage(cascade.draw_arrays(_amounts(spark, sf), groups, "A", "B"))
    of = lambda kind: t.filter(F.col("feature").startswith(kind)).withColumn("feature", F.expr("substring(feature, 2)"))
    return of("g").select(F.col("feature").alias("gene"), F.col("z").alias("e")), of("m").select(F.col("feature").alias("met"), "z")


def _abundance(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("gene")).agg(F.sum("l_quantity").alias("amount"))


def _z_sql(name: str, key: str, value: str) -> str:
    return f"""{name} AS (SELECT f AS {key}, CASE WHEN count(v) FILTER (a) > 1 AND count(v) FILTER (NOT a) > 1 AND var_samp(v) FILTER (a) / count(*) FILTER (a) + var_samp(v) FILTER (NOT a) / count(*) FILTER (NOT a) > 0
        THEN (avg(v) FILTER (a) - avg(v) FILTER (NOT a)) / sqrt(var_samp(v) FILTER (a) / count(*) FILTER (a) + var_samp(v) FILTER (NOT a) / count(*) FILTER (NOT a)) END AS {value}
        FROM (SELECT CAST({'l_partkey' if key == 'gene' else 'l_suppkey'} AS VARCHAR) AS f, o_custkey % 24 AS s, (o_custkey % 24) % 2 = 0 AS a, sum(l_extendedprice) AS v
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3) GROUP BY 1)"""


_STATE = lambda x: f"CASE WHEN {x} >= 1.5 THEN 'up' WHEN {x} <= -1.5 THEN 'down' ELSE 'quiet' END"
_NAMES = ", ".join(f"('{k}', '{name}')" for name, keys in cascade.PATTERNS.items() for k in keys)
CASCADE = f"""{_z_sql('ge', 'gene', 'e')}, {_z_sql('mz', 'met', 'z')},
    rules AS (SELECT DISTINCT l_orderkey AS rxn, l_returnflag || l_linestatus AS complex_id, CAST(l_partkey AS VARCHAR) AS gene FROM lineitem),
    cpx AS (SELECT rxn, complex_id, min(amount) AS w, CASE WHEN count(e) = 0 THEN 0 WHEN count(*) FILTER (e > 0) = count(e) THEN min(abs(e)) WHEN count(*) FILTER (e < 0) = count(e) THEN -min(abs(e)) ELSE 0 END AS ec
        FROM rules JOIN ge USING (gene) JOIN (SELECT CAST(l_partkey AS VARCHAR) AS gene, sum(l_quantity) AS amount FROM lineitem GROUP BY 1) USING (gene) GROUP BY 1, 2),
    enz AS (SELECT rxn, sum(w * ec) / sum(w) AS e FROM cpx GROUP BY 1),
    bal AS (SELECT rxn, avg(z) FILTER (NOT made) AS s, avg(z) FILTER (made) AS p FROM (SELECT DISTINCT l_orderkey AS rxn, CAST(l_suppkey AS VARCHAR) AS met, l_linenumber % 2 = 0 AS made FROM lineitem)
        JOIN (SELECT met, coalesce(z, 0) AS z FROM mz) USING (met) GROUP BY 1),
    cas AS (SELECT rxn, e, s, p, coalesce((p - s) / sqrt(2), p, -s) AS m FROM enz JOIN bal USING (rxn)),
    names(key, name) AS (VALUES {_NAMES})"""


@query(sql("", f"""SELECT rxn, {R('e')} AS e, {R('s')} AS s, {R('p')} AS p, {R('m')} AS m, {R('e * m')} AS c, coalesce(name, 'No clear pattern') AS pattern
    FROM cas LEFT JOIN names ON key = {_STATE('e')} || ' ' || {_STATE('s')} || ' ' || {_STATE('p')}""", CASCADE))
def cascade_scores(spark, sf):
    g, m = _evidence(spark, sf, _samples(spark, sf).withColumn("perm", F.lit(0)))
    t = cascade.observed_scores(_rules(spark, sf), _stoich(spark, sf), g, m, _abundance(spark, sf))
    return rounded(t.withColumn("pattern", cascade.reaction_pattern("e", "s", "p")))


@query(None)
def calibrated_reactions(spark, sf):
    """40 permuted labels and 40 shuffles inside degree bins of all orders."""
    g, m = _evidence(spark, sf, cascade.permuted_labels(_samples(spark, sf), 40))
    t = cascade.calibrated_arrays(_rules(spark, sf), _stoich(spark, sf), g, m, 40, _abundance(spark, sf))
    return rounded(t.select("rxn", "e", "m", "c", "c_std", "rho", "p_empirical", "p_label", "q_label", "p_topology", "q_topology", "q_balance", "significant", "metabolite_driven", "pattern", "call"))


@query(None)
def set_enrichment_null(spark, sf):
    """Running sums of the part sets against 200 random sets of each size."""
    return rounded(sets.gsea(V.part_sets(spark, sf), V.part_score(spark, sf), rounds=200).drop("leading_members"))


# -- suppliers and parts as a network -------------------------------------------------------------------------------------


def _graph(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()


def _start(spark, sf):
    return V.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_acctbal").alias("value"))


def _walk_sql(steps: int, restart: float) -> str:
    parts = ["edges AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)", "both_ AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges)",
             "wt AS (SELECT a, b, 1.0::DOUBLE / count(*) OVER (PARTITION BY a) AS w FROM both_)",
             "nd AS (SELECT a AS node, count(*) AS degree, coalesce(any_value(v), 0) AS v FROM both_ LEFT JOIN (SELECT 's' || s_suppkey AS node, abs(s_acctbal) AS v FROM supplier) x ON x.node = a GROUP BY 1)",
             "r0 AS (SELECT node, degree, v / sum(v) OVER () AS s, v / sum(v) OVER () AS r FROM nd)"]
    for i in range(steps):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT x.node, degree, s, {1 - restart} * coalesce(g, 0) + {restart} * s AS r FROM r0 x LEFT JOIN (SELECT b AS node, sum(w * r) AS g FROM wt JOIN r{i} y ON a = y.node GROUP BY 1) z ON x.node = z.node)")
    return sql("", f"SELECT node, degree, {R('r', 8)} AS score FROM r{steps}", ", ".join(parts))


@query(_walk_sql(40, 0.5))
def network_propagation(spark, sf):
    """Balances of the suppliers walk over all supplier-part links until they stand still."""
    nodes, seeds = network.walk_seeds(_graph(spark, sf), _start(spark, sf), 0)
    r = network.walks(_graph(spark, sf), nodes, seeds, 1, restart=0.5, tolerance=1e-9)
    return rounded(r.select("node", F.col("r0").alias("score")).join(nodes.select("node", "degree"), "node"), 8).select("node", "degree", "score")


@query(None)
def network_propagation_null(spark, sf):
    """The same walk against 49 shuffles of the seeds inside degree bins."""
    t = network.propagation_scores(_graph(spark, sf), _start(spark, sf), rounds=49, restart=0.5, tolerance=1e-7)
    return t.select("node", "degree", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("score", 8), ("z", 4), ("p", 6), ("q", 6))])


@query("""SELECT rxn, count(*) FILTER (NOT made) AS n_consumed, count(*) FILTER (made) AS n_produced FROM (SELECT met, made, min(rxn) AS rxn FROM (SELECT rxn, met, sum(coef) > 0 AS made FROM
    (SELECT l_orderkey AS rxn, l_partkey || l_returnflag AS met, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE -l_quantity END AS coef FROM lineitem) GROUP BY 1, 2 HAVING abs(sum(coef)) > 1e-9) GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY 1""")
def choke_points(spark, sf):
    """Orders that alone consume or produce a part of one return flag."""
    flagged = V.table(spark, sf, "lineitem").withColumn("l_met", F.concat(F.col("l_partkey").cast("string"), F.col("l_returnflag")))
    made = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    return pairs.choke_points(flagged.select(F.col("l_orderkey").alias("rxn"), F.col("l_met").alias("met"), made.alias("coef")))


RANKS = f"""wide AS (SELECT member, max(z) FILTER (layer = 'R') AS x, max(z) FILTER (layer = 'N') AS y, max(z) FILTER (layer = 'A') AS a FROM ly GROUP BY 1),
    sole AS (SELECT DISTINCT member FROM (SELECT CAST(l_partkey AS VARCHAR) AS member, count(*) OVER (PARTITION BY l_suppkey, l_partkey % 5, l_returnflag) AS k FROM lineitem) WHERE k = 1),
    it AS (SELECT member, CASE WHEN x * y > 0 THEN least(abs(x), abs(y)) WHEN x IS NOT NULL AND y IS NOT NULL THEN 0 END AS consistency, abs(a) AS strength, score, member IN (SELECT member FROM sole) AS choke FROM wide JOIN score USING (member)),
    rk AS (SELECT *, count(*) OVER () AS n, {', '.join(f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {c} DESC NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE) / count(*) OVER () END AS r_{c}" for c in ('consistency', 'strength', 'score'))},
        CASE WHEN choke THEN 0.5::DOUBLE * count(*) FILTER (choke) OVER () / count(*) OVER () END AS r_choke FROM it),
    ar AS (SELECT *, list_sort(list_filter([r_consistency, r_strength, r_score, r_choke], lambda x: x IS NOT NULL)) AS rs FROM rk),
    rh AS (SELECT *, least(1.0, len(rs) * list_min(list_transform(range(1, len(rs) + 1), lambda k: list_sum(list_transform(range(k, len(rs) + 1), lambda j: exp(lgamma(len(rs) + 1.0) - lgamma(j + 1.0) - lgamma(len(rs) - j + 1.0)) * pow(rs[k], j) * pow(1 - rs[k], len(rs) - j)))))) AS rho FROM ar)"""


@query(sql("score", f"SELECT member, {R('r_consistency')} AS rank_consistency, {R('r_strength')} AS rank_strength, {R('r_score')} AS rank_score, {R('r_choke')} AS rank_choke, {R('rho')} AS rho, {R('q')} AS q FROM {sql_bh('rh', 'rho', '')}", LAY + ", " + RANKS))
def target_ranking(spark, sf):
    """Parts by agreement of two layers, strength of a third, revenue, and whether a supplier sells them alone in their class."""
    at = lambda layer: F.max(F.when(F.col("layer") == layer, F.col("z")))
    wide = _layers(spark, sf).groupBy("member").agg(at("R").alias("x"), at("N").alias("y"), at("A").alias("a"))
    agree = F.when(F.col("x") * F.col("y") > 0, F.least(F.abs("x"), F.abs("y"))).when(F.col("x").isNotNull() & F.col("y").isNotNull(), 0.0)
    li = V.table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") % 5).alias("kind"), "l_returnflag", F.col("l_partkey").cast("string").alias("member"))
    sole = li.groupBy("l_suppkey", "kind", "l_returnflag").agg(F.count(F.lit(1)).alias("k"), F.min("member").alias("member")).filter("k = 1").select("member", F.lit(True).alias("choke")).distinct()
    t = wide.join(V.part_score(spark, sf), "member").join(sole, "member", "left").select(
        "member", agree.alias("consistency"), F.abs("a").alias("strength"), "score", F.coalesce("choke", F.lit(False)).alias("choke")
    )
    t = network.rank_aggregation(t, ["consistency", "strength", "score"], ["choke"])
    return rounded(t.select("member", *[f"rank_{c}" for c in ("consistency", "strength", "score", "choke")], "rho", "q"))


# -- reaction pairs: parts change into parts inside an order --------------------------------------------------------------

# parts of one type are a family of carriers, the cheapest tenth of the price list is currency
PAIRS = """net AS (SELECT l_orderkey AS rxn, CAST(l_partkey AS VARCHAR) AS met, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE -l_quantity END) AS coef FROM lineitem GROUP BY 1, 2 HAVING abs(coef) > 1e-9),
    fam AS (SELECT net.*, p_type, coef > 0 AS made FROM net JOIN part ON CAST(p_partkey AS VARCHAR) = met),
    kept AS (SELECT * FROM (SELECT *, min(coef) OVER (PARTITION BY rxn, p_type) AS lo, max(coef) OVER (PARTITION BY rxn, p_type) AS hi FROM fam) WHERE NOT (lo < 0 AND hi > 0)
        AND met NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_retailprice < (SELECT quantile_cont(p_retailprice, 0.1) FROM part))),
    few AS (SELECT rxn FROM kept GROUP BY 1 HAVING least(count(*) FILTER (made), count(*) FILTER (NOT made)) = 1),
    rp AS (SELECT s.met AS substrate, p.met AS product, rxn, o_orderpriority < '3' AS reversible FROM kept s JOIN kept p USING (rxn) JOIN few USING (rxn) JOIN orders ON o_orderkey = rxn WHERE NOT s.made AND p.made)"""


def _pairs(spark, sf):
    part = V.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("met"), "p_type", "p_retailprice", "p_name")
    cheap = part.agg(F.percentile("p_retailprice", F.lit(0.1)).alias("cut"))
    currency = part.join(F.broadcast(cheap), part.p_retailprice < cheap.cut).select("met")  # one row is broadcast
    reactions = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("rxn"), (F.col("o_orderpriority") < "3").alias("reversible"))
    return network.reaction_pairs(_stoich(spark, sf, "l_partkey"), reactions, currency, part.select("met", F.col("p_type").alias("family")))


@query(sql("", "SELECT substrate, product, rxn, reversible FROM rp", PAIRS))
def reaction_pairs(spark, sf):
    return _pairs(spark, sf)


BOUND = "bd AS (SELECT CAST(p_partkey AS VARCHAR) AS node FROM part WHERE p_name LIKE 'old gizmo%'), "
ROUTES = (
    PAIRS + ", " + BOUND + """st AS (SELECT DISTINCT substrate AS a, product AS b, CAST(rxn AS VARCHAR) AS rxn, reversible AS f FROM rp UNION SELECT product, substrate, CAST(rxn AS VARCHAR), reversible FROM rp WHERE reversible),
    ib AS (SELECT st.*, a IN (SELECT node FROM bd) AS ab, b IN (SELECT node FROM bd) AS bb FROM st),
    r1 AS (SELECT a AS src, b AS here, min({'c': rxn, 'f': f}) AS x FROM ib WHERE bb AND NOT ab GROUP BY 1, 2),
    n1 AS (SELECT src, b AS dst, bb, min({'c': x.c || '+' || rxn, 'f': x.f AND f}) AS x FROM r1 JOIN ib ON here = a WHERE b <> src GROUP BY 1, 2, 3),
    n2 AS (SELECT src, b AS dst, ib.bb, min({'c': x.c || '+' || rxn, 'f': x.f AND f}) AS x FROM (SELECT * FROM n1 WHERE n1.bb AND (src, dst) NOT IN (SELECT (src, here) FROM r1)) n JOIN ib ON dst = a WHERE b <> src GROUP BY 1, 2, 3),
    nw AS (SELECT src, dst, min({'t': t, 'c': x.c, 'f': x.f}) AS y FROM (SELECT src, dst, 1 AS t, x FROM n1 WHERE NOT bb UNION ALL SELECT src, dst, 2, x FROM n2 WHERE NOT bb) GROUP BY 1, 2),
    ct AS (SELECT a AS substrate, b AS product, rxn, f AS reversible, 0 AS through FROM (SELECT DISTINCT substrate AS a, product AS b, CAST(rxn AS VARCHAR) AS rxn, reversible AS f FROM rp) WHERE a NOT IN (SELECT node FROM bd) AND b NOT IN (SELECT node FROM bd)
        UNION ALL SELECT src, dst, y.c, y.f, y.t FROM nw)"""
)


def _contracted(spark, sf):
    links = _pairs(spark, sf).withColumn("rxn", F.col("rxn").cast("string"))
    bound = V.table(spark, sf, "part").filter("p_name like 'old gizmo%'").select(F.col("p_partkey").cast("string").alias("node"))
    return network.contracted(links, bound, most=2)


@query(sql("", "SELECT substrate, product, rxn, reversible, through FROM ct", ROUTES))
def contracted_links(spark, sf):
    return _contracted(spark, sf)


@query(sql("", """SELECT least(substrate, product) AS met_a, greatest(substrate, product) AS met_b, CASE WHEN bool_or(substrate < product OR reversible) AND bool_or(substrate > product OR reversible) THEN 'both' WHEN bool_or(substrate < product) THEN 'a>b' ELSE 'b>a' END AS direction,
    count(DISTINCT rxn) AS n_reactions, array_to_string(list_sort(list(DISTINCT rxn)), ';') AS reactions FROM ct GROUP BY 1, 2""", ROUTES))
def collapsed_pairs(spark, sf):
    return network.collapsed_pairs(_contracted(spark, sf))


def _layer_z(spark, sf, layer):
    """z and q of parts in a layer: the mean quantity of a return flag, standardised."""
    t = _layers(spark, sf).filter(F.col("layer") == layer).select(F.col("member").alias("key"), "z")
    return p_adjust(t.withColumn("p", dist.norm_sf(F.col("z") * 2)), "p", (), "bh", "q")


def _lz_sql(name: str, layer: str) -> str:
    return f"{name}p AS (SELECT member AS key, z, {sql_norm_p('z * 2')} AS p FROM ly WHERE layer = '{layer}'), {name} AS (SELECT * FROM {sql_bh(name + 'p', 'p', '')})"


CONC = f"""{LAY}, {_lz_sql('la', 'R')}, {_lz_sql('lb', 'N')}, bo AS (SELECT key, la.z AS x, lb.z AS y, la.q AS qx, lb.q AS qy FROM la JOIN lb USING (key)),
    mo AS (SELECT count(*) AS n, var_samp(x) AS sxx, var_samp(y) AS syy, covar_samp(x, y) AS sxy, corr(x, y) AS r FROM bo),
    be AS (SELECT (syy - sxx + sqrt(pow(syy - sxx, 2) + 4 * sxy * sxy)) / (2 * sxy) AS beta, greatest(0.2, least(1.0, r)) AS coupling FROM mo)"""


@query(sql("", f"""SELECT key, {R('(y - beta * x) / sqrt(1 + beta * beta)')} AS discordance, {R('coupling')} AS coupling, CASE WHEN qx < 0.2 AND qy < 0.2 AND x * y > 0 THEN 'Coupled' WHEN qx < 0.2 AND qy < 0.2 THEN 'Opposing'
    WHEN qy < 0.2 THEN 'Protein-only (post-transcriptional)' WHEN qx < 0.2 THEN 'mRNA-only (buffered)' ELSE 'Unchanged' END AS class FROM bo, be""", CONC))
def translation_concordance(spark, sf):
    t = layers.concordance(_layer_z(spark, sf, "R"), _layer_z(spark, sf, "N"), 0.2)
    return rounded(t.select("key", "discordance", "coupling", "class"))


# -- imputation, peaks, modules, factors ----------------------------------------------------------------------------------


def _brands(spark, sf):
    return V.matrix_sales(spark, sf), V.meta_sales(spark, sf).select("sample")


@query(None)
def impute_nearest(spark, sf):
    """Sales of brand and size classes: gaps from the five nearest suppliers."""
    return rounded(fill.nearest_sample_impute(*_brands(spark, sf)), 4)


@query(None)
def impute_low_rank(spark, sf):
    return rounded(fill.low_rank_impute(*_brands(spark, sf)), 0)


def _peaks(spark, sf):
    """Line items of a part as peaks of a compound, flag and status as sample, the price as retention time."""
    li = V.table(spark, sf, "lineitem")
    return li.select(
        F.col("l_partkey").alias("name"), F.concat("l_returnflag", "l_linestatus").alias("sample"), (F.col("l_extendedprice") / 10000).alias("rt"), "l_orderkey", "l_linenumber"
    )


@query(None)
def peak_numbers(spark, sf):
    return rounded(peaks.number_peaks(_peaks(spark, sf)).drop("peak_label"))


# line items of an order as candidate peaks of one compound
_CAND = """cand AS (SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, l_returnflag AS method, l_linestatus AS compound, CAST(l_linenumber AS VARCHAR) AS peak,
    CASE WHEN l_discount > 0.08 THEN 'part (RT 1)' ELSE '' END AS co, CAST(l_quantity AS BIGINT) // 10 AS det, l_linenumber // 4 AS lab, l_extendedprice AS area, CAST(round(l_tax * 100) AS BIGINT) AS warn FROM lineitem)"""
_HIGH = "CASE WHEN {0}.area >= {1}.area THEN {0} ELSE {1} END"
_FOLD = "(CASE WHEN least(w.area, x.area) > 0 THEN greatest(w.area, x.area) / least(w.area, x.area) ELSE 1e300 END)"
_WIN = f"""CASE WHEN (w.co = '') <> (x.co = '') THEN CASE WHEN w.co = '' THEN w ELSE x END WHEN w.det <> x.det THEN CASE WHEN w.det > x.det THEN w ELSE x END WHEN w.lab <> x.lab THEN CASE WHEN w.lab > x.lab THEN w ELSE x END
    WHEN {_FOLD} >= 1.5 THEN {_HIGH.format('w', 'x')} WHEN w.warn <> x.warn THEN CASE WHEN w.warn < x.warn THEN w ELSE x END ELSE {_HIGH.format('w', 'x')} END"""
_WHY = f"""CASE WHEN (w.co = '') <> (x.co = '') THEN 'co-elutes' WHEN w.det <> x.det THEN 'samples' WHEN w.lab <> x.lab THEN 'labelled' WHEN {_FOLD} >= 1.5 THEN 'signal' WHEN w.warn <> x.warn THEN 'warnings' ELSE 'equal' END"""


@query(sql("", f"""SELECT key, x.place AS place, x.place = w.place AS kept, CASE WHEN x.place = w.place THEN 'chosen' ELSE {_WHY} END AS why, w.place AS winner FROM (
    SELECT key, w, unnest(l) AS x FROM (SELECT key, l, list_reduce(l, lambda w, x: {_WIN}) AS w FROM (SELECT key, list({{'place': place, 'co': co, 'det': det, 'lab': lab, 'area': area, 'warn': warn}} ORDER BY place) AS l FROM cand GROUP BY 1)))""", _CAND))
def peak_choice(spark, sf):
    li = V.table(spark, sf, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    c = li.select(
        F.col("l_orderkey").alias("key"), place.cast("bigint").alias("place"), F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("compound"), F.col("l_linenumber").cast("string").alias("peak"),
        F.when(F.col("l_discount") > 0.08, "part (RT 1)").otherwise("").alias("co_elutes"), F.expr("cast(l_quantity as bigint) div 10").alias("detected"), F.lit(5).alias("n_samples"),
        F.expr("l_linenumber div 4").alias("labelled"), F.col("l_extendedprice").alias("median_area"), F.round(F.col("l_tax") * 100).cast("bigint").alias("warnings"),
    )
    t = peaks.one_peak_per_compound(c)
    short = {"chosen": "chosen", "other peak": "co-elutes", "detected": "samples", "more labeled": "labelled", "higher signal": "signal", "fewer": "warnings", "signal slightly": "equal"}
    why = F.lit(None).cast("string")
    for start, name in short.items():
        why = F.when(F.col("reason").startswith(start), name).otherwise(why)
    return t.select("key", "place", "kept", why.alias("why"), F.col("winner.place").alias("winner"))


def _vectors(spark, sf):
    return V.matrix_vec(spark, sf).join(V.meta_vec(spark, sf).select("sample", "grp", "batch"), "sample")


@query(None)
def module_scores(spark, sf):
    """Neighbouring dimensions as pairs, eights of dimensions as sets; 100 bootstrap rounds."""
    d = pairs.differential_correlation(_vectors(spark, sf), _near(spark, sf), "A", "B")
    eight = lambda c: F.concat(F.lit("set"), F.expr(f"cast(substring({c}, 2) as int) div 8"))
    p = d.select("f1", "f2", eight("f1").alias("set_a"), eight("f2").alias("set_b"), "class", (-F.col("delta")).alias("delta"))  # group b less group a
    t = modules.score_modules(_vectors(spark, sf), p, "A", "B", rounds=100, robust=0.02)
    return rounded(t)


def _blocks(spark, sf):
    return V.matrix_vec(spark, sf).withColumn("block", F.when(F.col("feature") < "d32", "low").otherwise("high"))


@query(None)
def block_factor_shares(spark, sf):
    return rounded(factors.block_factors(_blocks(spark, sf))[2])


@query(None)
def factor_associations(spark, sf):
    scores, _, _ = factors.block_factors(_blocks(spark, sf))
    meta = V.meta_vec(spark, sf).join(V.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("sample"), F.col("label").alias("number")), "sample")
    text = lambda c: F.struct(F.lit(c).alias("covariate"), F.col(c).alias("text"), F.lit(None).cast("double").alias("number"))
    rows = F.array(text("grp"), text("batch"), text("label"), F.struct(F.lit("number").alias("covariate"), F.lit(None).cast("string").alias("text"), F.col("number").cast("double").alias("number")))
    return rounded(factors.factor_associations(scores, meta.select("sample", F.explode(rows).alias("x")).select("sample", "x.*")))


@query(None)
def loading_enrichment(spark, sf):
    _, loadings, _ = factors.block_factors(_blocks(spark, sf))
    sets_ = loadings.select("feature").distinct().select(F.concat(F.lit("set"), F.expr("cast(substring(feature, 2) as int) div 8")).alias("set_id"), F.col("feature").alias("member"))
    return rounded(factors.loading_enrichment(loadings, sets_, rounds=100))


@query(None)
def fused_classifier(spark, sf):
    y = V.meta_vec(spark, sf).select("sample", (F.col("grp") == "A").cast("int").alias("y"))
    return rounded(factors.late_fusion(_blocks(spark, sf), y)[1])


# -- permuted labels for metabolites and sets ------------------------------------------------------------------------------


@query(None)
def reporter_metabolites(spark, sf):
    """Suppliers by the coherence of their orders, 20 permuted labels."""
    g, m = _evidence(spark, sf, cascade.permuted_labels(_samples(spark, sf), 20))
    scores = cascade.over_reactions(_rules(spark, sf), _stoich(spark, sf), g, m, cascade.standard_columns, "z array<double>", _abundance(spark, sf), around=True)
    return rounded(cascade.reporter_metabolites(None, scores, perms=21))


def _layer_evidence(spark, sf):
    """z of every part in each return flag under 30 permuted labels."""
    o = V.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 24).cast("string").alias("sample"))
    li = V.table(spark, sf, "lineitem").select("l_orderkey", F.struct(F.col("l_returnflag").alias("layer"), F.col("l_partkey").cast("string").alias("member")).alias("feature"), "l_extendedprice")
    cells = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("feature", "sample").agg(F.sum("l_extendedprice").alias("value"))
    z = cascade.draw_arrays(cells, cascade.permuted_labels(_samples(spark, sf), 30), "A", "B")
    return z.select("feature.layer", "feature.member", "z")


def _activity(spark, sf):
    flags = F.explode(F.array(*[F.lit(x) for x in "ANR"])).alias("layer")
    return cascade.layer_activity(V.part_sets(spark, sf).select("set_id", "member", flags), _layer_evidence(spark, sf))


@query(None)
def layer_activity(spark, sf):
    return rounded(_activity(spark, sf)[0])


@query(None)
def set_activity_classes(spark, sf):
    return rounded(_activity(spark, sf)[1])
