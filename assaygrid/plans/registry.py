"""Registered queries: each operator applied to the driver tables, with the same computation in SQL.

Doubles are rounded on both sides; ``SQL`` is written from the definitions, not from the Spark plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.functions import dist, names
from assaygrid.operators import clean, comparisons, isotopes, normalize, results, sets
from assaygrid.operators.base import attach_scalars, mid_ranks, p_adjust, quantiles, top_k
from assaygrid.plans import views
from assaygrid.plans.views import R, sql, sql_bh, sql_chi2_p, sql_hyper_p, sql_norm_p, sql_t_p

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    """Registers a function (spark, sf) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, without negative zeros."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def tidy(select: str, digits: int = 6) -> str:
    """A SQL select list with ``name = expression`` items rounded where marked by ``~``."""
    out = []
    for item in select.split(";"):
        name, expr = (x.strip() for x in item.split("=", 1))
        out.append(f"{R(expr, digits)} AS {name[1:]}" if name.startswith("~") else f"{expr} AS {name}")
    return ", ".join(out)


V = views
two = ("A", "B")

#: Group moments of the log matrix and Welch statistics in SQL.
MOM = """mom AS (SELECT feature, count(*) FILTER (grp = 'A') AS n_a, count(*) FILTER (grp = 'B') AS n_b, avg(value) FILTER (grp = 'A') AS mean_a,
    avg(value) FILTER (grp = 'B') AS mean_b, var_samp(value) FILTER (grp = 'A') AS var_a, var_samp(value) FILTER (grp = 'B') AS var_b FROM mlog GROUP BY feature)"""
WELCH = MOM + """, wel AS (SELECT *, mean_a - mean_b AS log2fc, sqrt(var_a / n_a + var_b / n_b) AS se,
    CASE WHEN n_a >= 2 AND n_b >= 2 AND var_a / n_a + var_b / n_b > 0 THEN (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) END AS t,
    CASE WHEN n_a >= 2 AND n_b >= 2 AND var_a / n_a + var_b / n_b > 0 THEN pow(var_a / n_a + var_b / n_b, 2)
      / (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1)) END AS df FROM mom)"""
WELCH_P = WELCH + f", welp AS (SELECT *, {sql_t_p('t', 'df')} AS p FROM wel)"
WELCH_Q = WELCH_P + f", welq AS (SELECT * FROM {sql_bh('welp', 'p', '')})"


def _welch(spark, sf) -> DataFrame:
    return comparisons.welch_table(V.log_matrix(spark, sf), *two)


# -- cleaning ---------------------------------------------------------------------------------------------------------


@query(sql("matrix meta", "SELECT feature, sample, " + R("value") + " AS value FROM matrix WHERE sample IN (SELECT sample FROM meta WHERE NOT is_qc)"))
def qc_split(spark, sf):
    return rounded(clean.split_qc(V.matrix_sales(spark, sf), V.meta_sales(spark, sf), False).select("feature", "sample", "value"))


@query(sql("matrix", "SELECT feature, sample, " + R("CASE WHEN value - 50000 > 0 THEN log2(value - 50000) END") + " AS value FROM matrix"))
def log2_strict(spark, sf):
    return rounded(clean.strict_log2(V.matrix_sales(spark, sf).withColumn("value", F.col("value") - 50000)))


@query(sql("matrix", "SELECT feature, sample, " + R("CASE WHEN (SELECT max(value) FROM matrix) < 100 THEN value WHEN value > 0 THEN log2(value) END") + " AS value FROM matrix"))
def log2_auto(spark, sf):
    return rounded(clean.auto_log2(V.matrix_sales(spark, sf)))


@query(sql("matrix", """SELECT feature, sample, """ + R("log2(value - 50000 + (SELECT CASE WHEN min(value) - 50000 <= 0 THEN abs(min(value) - 50000) + greatest(abs(min(value) - 50000) * 0.01, 1e-3) ELSE 0 END FROM matrix))") + " AS value FROM matrix"))
def log2_shifted(spark, sf):
    return rounded(clean.shift_log2(V.matrix_sales(spark, sf).withColumn("value", F.col("value") - 50000)))


MISSING = """miss AS (SELECT feature, count(*) AS n_samples, count(*) - count(CASE WHEN value <> 0 THEN 1 END) AS n_missing FROM grid GROUP BY feature),
    missp AS (SELECT *, n_missing * 100.0 / n_samples AS pct FROM miss)"""


@query(sql("grid", f"""SELECT feature, n_samples, n_missing, {R('pct')} AS pct_missing, CASE WHEN pct < 20 THEN 'good' WHEN pct < 50 THEN 'fair'
    WHEN pct < 70 THEN 'poor' ELSE 'bad' END AS quality FROM missp""", MISSING))
def missing_values(spark, sf):
    return rounded(clean.missingness(V.matrix_sales(spark, sf), V.meta_sales(spark, sf)))


@query(sql("grid", f"SELECT feature, sample, {R('value')} AS value FROM matrix WHERE feature IN (SELECT feature FROM missp WHERE pct <= 8)", MISSING))
def missing_filter(spark, sf):
    m, meta = V.matrix_sales(spark, sf), V.meta_sales(spark, sf)
    return rounded(clean.filter_missing(m, clean.missingness(m, meta), 8))


def _group_missing(need: str) -> str:
    return sql("grid", f"""SELECT feature, sample, {R('value')} AS value FROM matrix WHERE feature IN (SELECT feature FROM (
        SELECT feature, grp, 1 - count(value) * 1.0 / count(*) <= 0.08 AS ok FROM grid GROUP BY feature, grp) GROUP BY feature HAVING bool_{need}(ok))""")


@query(_group_missing("or"))
def missing_filter_any_group(spark, sf):
    return rounded(clean.filter_missing_by_group(V.matrix_sales(spark, sf), V.meta_sales(spark, sf), 0.08, "any"))


@query(_group_missing("and"))
def missing_filter_all_groups(spark, sf):
    return rounded(clean.filter_missing_by_group(V.matrix_sales(spark, sf), V.meta_sales(spark, sf), 0.08, "all"))


@query(sql("matrix meta", f"""SELECT feature, sample, {R('value')} AS value FROM matrix WHERE feature IN (SELECT feature FROM (
    SELECT feature, grp, coalesce(stddev_samp(value), 0) AS sd FROM matrix JOIN meta USING (sample) GROUP BY 1, 2) GROUP BY feature HAVING min(sd) > 1e-10)"""))
def constant_features(spark, sf):
    return rounded(clean.drop_constant(V.matrix_sales(spark, sf), V.meta_sales(spark, sf), 1e-10))


def _imputed(fill: str) -> str:
    return sql("grid", f"""SELECT feature, sample, {R('coalesce(value, fill)')} AS value, value IS NULL AS imputed FROM grid
        JOIN (SELECT feature, {fill} AS fill FROM matrix GROUP BY feature) USING (feature)""")


def _impute(how):
    return lambda spark, sf: rounded(clean.impute(V.matrix_sales(spark, sf), V.meta_sales(spark, sf), how))


for _how, _fill in (("half_min", "min(value) * 0.5"), ("mean", "avg(value)"), ("median", "median(value)"), ("log_min", "min(value) - 1")):
    QUERIES[f"impute_{_how}"], SQL[f"impute_{_how}"] = _impute(_how), _imputed(_fill)


@query(sql("grid", f"SELECT feature, sample, {R('coalesce(value, (SELECT min(value) * 0.5 FROM matrix))')} AS value, value IS NULL AS imputed FROM grid"))
def impute_global_min(spark, sf):
    return rounded(clean.impute(V.matrix_sales(spark, sf), V.meta_sales(spark, sf), "global_min"))


def _z(axis: str) -> str:
    return sql("matrix", f"""SELECT feature, sample, {R('greatest(-3.0, least(3.0, (value - m) / nullif(s, 0)))')} AS z FROM matrix
        JOIN (SELECT {axis}, avg(value) AS m, stddev_samp(value) AS s FROM matrix GROUP BY 1) USING ({axis}) WHERE s > 0""")


@query(_z("feature"))
def zscore_features(spark, sf):
    return rounded(clean.zscores(V.matrix_sales(spark, sf)).filter("z is not null").select("feature", "sample", "z"))


@query(_z("sample"))
def zscore_samples(spark, sf):
    return rounded(clean.zscores(V.matrix_sales(spark, sf), "sample").filter("z is not null").select("feature", "sample", "z"))


@query(sql("matrix meta", f"SELECT feature, sample, {R('value / coalesce(CASE WHEN is_qc THEN NULL ELSE abs(balance) + 1 END, 1.0)')} AS value FROM matrix JOIN meta USING (sample)"))
def sample_factor(spark, sf):
    factors = V.meta_sales(spark, sf).filter(~F.col("is_qc")).select("sample", (F.abs("balance") + 1).alias("factor"))
    return rounded(clean.divide_by_factor(V.matrix_sales(spark, sf), factors).select("feature", "sample", "value"))


CV = "cv AS (SELECT feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, stddev_samp(value) * 100 / avg(value) AS cv FROM matrix JOIN meta USING (sample) WHERE is_qc GROUP BY feature)"


@query(sql("matrix meta", f"SELECT feature, n, {R('mean')} AS mean, {R('sd')} AS sd, {R('cv')} AS cv, coalesce(cv <= 20, false) AS acceptable FROM cv", CV))
def cv_of_qc(spark, sf):
    return rounded(clean.cv_table(clean.split_qc(V.matrix_sales(spark, sf), V.meta_sales(spark, sf), True)))


@query(sql("matrix meta", f"SELECT feature, sample, {R('value')} AS value FROM matrix WHERE feature IN (SELECT feature FROM cv WHERE cv <= 40) OR feature LIKE '%-0'", CV))
def cv_filter_keeps_standards(spark, sf):
    m = V.matrix_sales(spark, sf)
    cv = clean.cv_table(clean.split_qc(m, V.meta_sales(spark, sf), True))
    return rounded(clean.filter_cv(m, cv, normalize.find_standards(m, "-0$"), 40))


@query(sql("matrix meta", f"""SELECT split_part(feature, '-', 2) AS dataset, count(*) AS n_features, {R('avg(CASE WHEN coalesce(cv <= 20, false) THEN 100.0 ELSE 0 END)')} AS pct_acceptable,
    {R('median(cv)')} AS median_cv FROM cv GROUP BY 1""", CV))
def cv_by_dataset(spark, sf):
    cv = clean.cv_table(clean.split_qc(V.matrix_sales(spark, sf), V.meta_sales(spark, sf), True))
    return rounded(clean.cv_summary(cv.withColumn("dataset", F.substring_index("feature", "-", -1))))


@query(sql("matrix", """SELECT CAST(least(coalesce(floor((value - lo) * 30 / nullif(hi - lo, 0)), 0), 29) AS BIGINT) AS bin, count(*) AS n
    FROM matrix, (SELECT min(value) AS lo, max(value) AS hi FROM matrix) GROUP BY 1"""))
def value_histogram(spark, sf):
    return clean.histogram(V.matrix_sales(spark, sf), "value")


@query(sql("matrix", "SELECT sample, " + tidy("~low = min(value); ~q1 = quantile_cont(value, 0.25); ~median = median(value); ~q3 = quantile_cont(value, 0.75); ~high = max(value)") + " FROM matrix GROUP BY sample"))
def sample_boxes(spark, sf):
    return rounded(clean.sample_boxes(V.matrix_sales(spark, sf)))


@query(sql("matrix cmatrix", f"""SELECT 'sales::' || feature AS feature, sample, {R('value')} AS value, 'sales' AS dataset FROM matrix
    UNION ALL SELECT 'counts::' || feature, sample, {R('CAST(value AS DOUBLE)')}, 'counts' FROM cmatrix"""))
def union_of_datasets(spark, sf):
    counts = V.count_matrix(spark, sf).withColumn("value", F.col("value").cast("double"))
    return rounded(clean.union_datasets({"sales": V.matrix_sales(spark, sf), "counts": counts}))


@query("""SELECT p_partkey AS pos, 'd::' || p_name AS feature, CASE WHEN n = 1 THEN p_name ELSE p_name || ' (' || n || ')' END AS display
    FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""")
def display_names(spark, sf):
    part = V.table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("d::"), "p_name").alias("feature"))
    return clean.display_names(part)


@query(sql("matrix", f"""SELECT feature, {R('var', 2)} AS var FROM (SELECT feature, var_samp(value) AS var FROM matrix GROUP BY feature) v
    WHERE var >= (SELECT quantile_cont(var_samp, 0.25) FROM (SELECT var_samp(value) AS var_samp FROM matrix GROUP BY feature))"""))
def low_variance_filter(spark, sf):
    return rounded(clean.low_variance(V.matrix_sales(spark, sf), 25).select("feature", "var"), 2)


@query(sql("matrix", f"SELECT feature, {R('var_samp(value)', 2)} AS var FROM matrix GROUP BY feature ORDER BY var_samp(value) DESC, feature LIMIT 50"))
def top_variance_features(spark, sf):
    return rounded(clean.top_variance(V.matrix_sales(spark, sf), 50), 2)


# -- normalisation ----------------------------------------------------------------------------------------------------

QS = "qs AS (SELECT sample, quantile_cont(value, 0.25) AS q1, median(value) AS q2, quantile_cont(value, 0.75) AS q3 FROM matrix GROUP BY sample)"


@query(sql("matrix", f"SELECT feature, sample, {R('(value - q2) / nullif(q3 - q1, 0)')} AS value FROM matrix JOIN qs USING (sample)", QS))
def median_iqr_samples(spark, sf):
    return rounded(normalize.median_iqr(V.matrix_sales(spark, sf)).select("feature", "sample", "value"))


@query(sql("matrix meta", f"""SELECT feature, sample, batch, {R('(value - q2) / nullif(q3 - q1, 0)')} AS value FROM matrix JOIN meta USING (sample) JOIN (
    SELECT feature, batch, quantile_cont(value, 0.25) AS q1, median(value) AS q2, quantile_cont(value, 0.75) AS q3 FROM matrix JOIN meta USING (sample) GROUP BY 1, 2) USING (feature, batch)"""))
def median_iqr_feature_batches(spark, sf):
    m = V.matrix_sales(spark, sf).join(V.meta_sales(spark, sf).select("sample", "batch"), "sample")
    return rounded(normalize.median_iqr(m, ("feature", "batch")).select("feature", "sample", "batch", "value"))


LQ = "lq AS (SELECT sample, quantile_cont(value, 0.25) AS q1, median(value) AS q2, quantile_cont(value, 0.75) AS q3 FROM mlog GROUP BY sample)"


@query(sql("mlog", f"""SELECT feature, sample, {R('(value - q2) / nullif(q3 - q1, 0) * (SELECT median(q3 - q1) FROM lq) + (SELECT median(q2) FROM lq)')} AS value
    FROM mlog JOIN lq USING (sample)""", LQ))
def robust_iqr_log(spark, sf):
    return rounded(normalize.robust_iqr(V.log_matrix(spark, sf).select("feature", "sample", "value")))


@query(sql("mlog", f"SELECT feature, sample, {R('value - q2 + (SELECT median(q2) FROM lq)')} AS value FROM mlog JOIN lq USING (sample)", LQ))
def median_centred(spark, sf):
    return rounded(normalize.median_centre(V.log_matrix(spark, sf).select("feature", "sample", "value"), True))


@query(sql("mlog", f"""SELECT feature, sample, {R('value / (CASE WHEN m = 0 THEN 1.0 ELSE m * 1.4826 END)')} AS value FROM mlog,
    (SELECT median(abs(value - (SELECT median(value) FROM mlog))) AS m FROM mlog)"""))
def mad_scaled(spark, sf):
    return rounded(normalize.mad_scale(V.log_matrix(spark, sf).select("feature", "sample", "value")))


@query(sql("matrix meta", f"""SELECT feature, sample, batch, {R('value / nullif(r, 0)')} AS value FROM matrix JOIN meta USING (sample) LEFT JOIN (
    SELECT feature, batch, avg(value) AS r FROM matrix JOIN meta USING (sample) WHERE is_qc GROUP BY 1, 2) USING (feature, batch) WHERE NOT is_qc"""))
def reference_channel(spark, sf):
    return rounded(normalize.reference_ratio(V.matrix_sales(spark, sf), V.meta_sales(spark, sf), F.col("is_qc")))


STD = """feat AS (SELECT DISTINCT feature, split_part(feature, '-', 1) AS cls FROM matrix), std AS (SELECT * FROM feat WHERE feature LIKE '%-1'),
    mapped AS (SELECT feature, cls, coalesce((SELECT min(feature) FROM std s WHERE s.cls = f.cls), (SELECT min(feature) FROM std)) AS standard FROM feat f)"""


def _features(spark, sf):
    return V.matrix_sales(spark, sf).select("feature").distinct().withColumn("cls", F.substring_index("feature", "-", 1))


def _mapping(spark, sf):
    f = _features(spark, sf)
    return normalize.map_standards(f, f.join(normalize.find_standards(f, "-1$"), "feature", "left_semi"))


@query(sql("matrix", "SELECT feature FROM std", STD))
def internal_standards(spark, sf):
    return normalize.find_standards(_features(spark, sf), "-1$")


@query(sql("matrix", "SELECT feature, cls, standard FROM mapped", STD))
def standard_mapping(spark, sf):
    return _mapping(spark, sf)


@query(sql("matrix", f"""SELECT m.feature, m.sample, standard, {R('log2(m.value / s.value)')} AS value FROM matrix m JOIN mapped USING (feature)
    LEFT JOIN matrix s ON s.feature = standard AND s.sample = m.sample""", STD))
def standard_ratio(spark, sf):
    return rounded(normalize.standard_ratio(V.matrix_sales(spark, sf), _mapping(spark, sf)))


@query(sql("matrix", f"""SELECT feature, count(*) AS n, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS sd, {R('stddev_samp(value) * 100 / avg(value)')} AS cv
    FROM matrix WHERE feature IN (SELECT feature FROM std) AND value > 0 GROUP BY feature""", STD))
def standard_summary(spark, sf):
    return rounded(normalize.standard_summary(V.matrix_sales(spark, sf), normalize.find_standards(_features(spark, sf), "-1$")))


# -- counts -----------------------------------------------------------------------------------------------------------

TOTALS = "tot AS (SELECT sample, CAST(sum(value) AS BIGINT) AS total, count(CASE WHEN value > 0 THEN 1 END) AS detected FROM counts GROUP BY sample)"


@query(sql("counts", f"SELECT sample, total, detected, {R('total * 100.0 / (SELECT median(total) FROM tot)')} AS pct_of_median FROM tot", TOTALS))
def library_sizes(spark, sf):
    return rounded(normalize.library_size(V.counts(spark, sf)))


@query(sql("counts", f"SELECT feature, sample, {R('value * 1e6 / total')} AS value FROM counts JOIN tot USING (sample)", TOTALS))
def counts_per_million(spark, sf):
    return rounded(normalize.cpm(V.counts(spark, sf)).select("feature", "sample", "value"))


@query(sql("counts", f"SELECT feature, sample, {R('log2(value * 1e6 / total + 1)')} AS value FROM counts JOIN tot USING (sample)", TOTALS))
def log2_cpm(spark, sf):
    return rounded(normalize.cpm(V.counts(spark, sf), True).select("feature", "sample", "value"))


@query(sql("cmatrix", f"""SELECT sample, {R('exp(median(ln(value) - m))')} AS factor FROM cmatrix JOIN (SELECT feature, avg(ln(value)) AS m FROM cmatrix WHERE value > 0
    GROUP BY feature HAVING count(*) = (SELECT count(DISTINCT sample) FROM cmatrix)) USING (feature) GROUP BY sample"""))
def size_factors(spark, sf):
    return rounded(normalize.size_factors(V.count_matrix(spark, sf)))


@query(sql("counts", f"""SELECT feature, {R('sum(value * 1e6 / total) / (SELECT count(*) FROM tot)')} AS mean_cpm, count(CASE WHEN value * 1e6 / total >= 1 THEN 1 END) AS n_detected,
    count(CASE WHEN value * 1e6 / total >= 1 THEN 1 END) >= ceil((SELECT count(*) FROM tot) * 0.2) AS kept FROM counts JOIN tot USING (sample) GROUP BY feature""", TOTALS))
def low_expression(spark, sf):
    return rounded(normalize.low_expression(V.counts(spark, sf)))


# -- group tests ------------------------------------------------------------------------------------------------------


@query(sql("mlog", "SELECT feature, n_a, n_b, " + tidy("~mean_a = mean_a; ~mean_b = mean_b; ~log2fc = log2fc; ~fold = pow(2.0, log2fc); ~se = se; ~t = t; ~df = df")
    + """, CASE WHEN n_a < 2 OR n_b < 2 THEN 'low_n' WHEN var_a = 0 OR var_b = 0 THEN 'zero_variance' WHEN greatest(var_a, var_b) / least(var_a, var_b) > 16 THEN 'variances_differ'
    WHEN df < 2 THEN 'low_df' ELSE '' END AS warning FROM wel""", WELCH))
def welch_stats(spark, sf):
    t = comparisons.welch(V.log_matrix(spark, sf), *two)
    return rounded(t.select("feature", "n_a", "n_b", "mean_a", "mean_b", "log2fc", "fold", "se", "t", "df", "warning"))


@query(sql("mlog", "SELECT feature, n_a, n_b, " + tidy("~log2fc = log2fc; ~t = t; ~df = df; ~p = p; ~q = q") + " FROM welq", WELCH_Q))
def welch_full(spark, sf):
    return rounded(_welch(spark, sf).select("feature", "n_a", "n_b", "log2fc", "t", "df", "p", "q").orderBy(F.col("q").asc_nulls_last(), "feature"))


@query(sql("mlog", "SELECT feature, n_a, n_b, CAST(n_a + n_b - 2 AS BIGINT) AS df, " + R("""CASE WHEN n_a >= 2 AND n_b >= 2 THEN (mean_a - mean_b) / nullif(sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b)
    / (n_a + n_b - 2) * (1.0 / n_a + 1.0 / n_b)), 0) END""") + " AS t FROM mom", MOM))
def student_stats(spark, sf):
    return rounded(comparisons.student(V.log_matrix(spark, sf), *two).select("feature", "n_a", "n_b", "df", "t"))


@query(sql("mlog", f"""SELECT feature, count(*) AS n, {R('avg(x.value - y.value)')} AS mean_diff, {R('stddev_samp(x.value - y.value)')} AS sd, count(*) - 1 AS df,
    {R('CASE WHEN count(*) >= 2 THEN avg(x.value - y.value) / nullif(stddev_samp(x.value - y.value) / sqrt(count(*)), 0) END')} AS t
    FROM mlog x JOIN mlog y USING (feature) WHERE x.grp = 'A' AND CAST(y.sample AS BIGINT) = CAST(x.sample AS BIGINT) + 1 GROUP BY feature"""))
def paired_stats(spark, sf):
    m = V.log_matrix(spark, sf)
    pairs = V.meta_sales(spark, sf).filter("grp = 'A'").select(F.col("sample").alias("sample_a"), (F.col("sample").cast("bigint") + 1).cast("string").alias("sample_b"))
    return rounded(comparisons.paired(m, pairs))


REG = "reg AS (SELECT feature, region AS grp, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM mlog GROUP BY 1, 2 HAVING count(*) >= 2)"


def _regions(spark, sf):
    return V.log_matrix(spark, sf).withColumn("grp", F.col("region"))


ANOVA = """SELECT feature, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum((n - 1) * var) AS ss_within, sum(n * mean * mean) - pow(sum(n * mean), 2) / sum(n) AS ss_between FROM {} GROUP BY feature"""


@query(sql("mlog", f"""SELECT feature, k, n, {R('ss_within')} AS ss_within, {R('ss_between')} AS ss_between, k - 1 AS df1, n - k AS df2,
    {R('CASE WHEN k > 1 THEN (ss_between / (k - 1)) / nullif(ss_within / nullif(n - k, 0), 0) END', 5)} AS f FROM ({ANOVA.format('reg')})""", REG))
def anova_stats(spark, sf):
    return rounded(comparisons.anova(_regions(spark, sf)).withColumn("f", F.round("f", 5)))


@query(sql("mlog", f"""SELECT feature, k, n, {R('CASE WHEN k > 1 THEN (ss_between / (k - 1)) / nullif(ss_within / nullif(n - k, 0), 0) END', 5)} AS f FROM ({ANOVA.format('bf')})""",
    """bf AS (SELECT feature, grp, count(*) AS n, avg(d) AS mean, var_samp(d) AS var FROM (SELECT feature, region AS grp, abs(value - median(value) OVER (PARTITION BY feature, region)) AS d
    FROM mlog) GROUP BY 1, 2 HAVING count(*) >= 2)"""))
def brown_forsythe_stats(spark, sf):
    return rounded(comparisons.brown_forsythe(_regions(spark, sf)).select("feature", "k", "n", "f"), 5)


@query(sql("mlog", f"""SELECT feature, k, {R('CASE WHEN k >= 2 THEN (a / (k - 1)) / (1 + r * 2 * (k - 2) / (k * k - 1)) END', 5)} AS f, k - 1 AS df1, {R('CASE WHEN k >= 2 THEN (k * k - 1) / (3 * r) END', 4)} AS df2 FROM (
    SELECT feature, max(k) AS k, sum(w * pow(mean - gm, 2)) AS a, sum(pow(1 - w / sw, 2) / (n - 1)) AS r FROM (SELECT *, n / var AS w, sum(n / var) OVER f AS sw, sum(n / var * mean) OVER f / sum(n / var) OVER f AS gm,
    count(*) OVER f AS k FROM reg WHERE var > 0 WINDOW f AS (PARTITION BY feature)) GROUP BY feature)""", REG))
def welch_anova_stats(spark, sf):
    return comparisons.welch_anova(_regions(spark, sf)).select("feature", "k", (F.round("f", 5) + 0.0).alias("f"), "df1", (F.round("df2", 4) + 0.0).alias("df2"))


RANKED = """rk AS (SELECT feature, {g} AS grp, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM mlog),
    ti AS (SELECT feature, sum(pow(c, 3) - c) AS ties FROM (SELECT feature, value, CAST(count(*) AS DOUBLE) AS c FROM mlog GROUP BY 1, 2) GROUP BY 1)"""
KRUSKAL = RANKED.format(g="region") + """, kw AS (SELECT feature, count(*) AS k, sum(c) AS n, (12.0 * sum(s * s / c) / (sum(c) * (sum(c) + 1)) - 3 * (sum(c) + 1))
    / (1 - max(ties) / (pow(sum(c), 3) - sum(c))) AS h FROM (SELECT feature, grp, count(*) AS c, sum(r) AS s FROM rk GROUP BY 1, 2) JOIN ti USING (feature) GROUP BY feature)"""


@query(sql("mlog", f"SELECT feature, k, CAST(n AS BIGINT) AS n, {R('h', 5)} AS h, k - 1 AS df FROM kw WHERE k >= 2", KRUSKAL))
def kruskal_stats(spark, sf):
    return rounded(comparisons.kruskal(_regions(spark, sf)).filter("k >= 2"), 5)


@query(sql("mlog", f"SELECT feature, {R('h', 5)} AS h, {R(sql_chi2_p('h', '(k - 1)'), 5)} AS p FROM kw WHERE k >= 3", KRUSKAL))
def kruskal_full(spark, sf):
    t = comparisons.kruskal(_regions(spark, sf)).filter("k >= 3")
    return rounded(t.select("feature", "h", dist.chi2_sf("h", F.col("df").cast("double")).alias("p")), 5)


@query(sql("mlog", f"""SELECT feature, n_a, n_b, {R('u')} AS u, {R('z')} AS z, ties = 0 AND least(n_a, n_b) <= 8 AS exact, {R(sql_norm_p('z'))} AS p FROM (
    SELECT *, greatest(abs(u - n_a * n_b / 2.0) - 0.5, 0) / sqrt(n_a * n_b / 12.0 * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1.0)))) AS z FROM (
    SELECT feature, count(*) FILTER (grp = 'A') AS n_a, count(*) FILTER (grp = 'B') AS n_b, sum(r) FILTER (grp = 'A') - count(*) FILTER (grp = 'A') * (count(*) FILTER (grp = 'A') + 1) / 2.0 AS u,
    max(ties) AS ties FROM rk JOIN ti USING (feature) GROUP BY feature)) WHERE least(n_a, n_b) > 8""", RANKED.format(g="grp")))
def mann_whitney_full(spark, sf):
    return rounded(comparisons.mann_whitney(V.log_matrix(spark, sf), *two).filter("least(n_a, n_b) > 8"))


PAIRS = REG + """, pw AS (SELECT feature, x.grp AS grp_a, y.grp AS grp_b, x.n AS n_a, y.n AS n_b, x.mean - y.mean AS diff, x.var / x.n AS va, y.var / y.n AS vb
    FROM reg x JOIN reg y USING (feature) WHERE x.grp < y.grp)"""


@query(sql("mlog", f"""SELECT feature, grp_a, grp_b, {R('diff')} AS diff, {R('diff / nullif(sqrt(va + vb), 0)', 5)} AS t,
    {R('pow(va + vb, 2) / (va * va / (n_a - 1) + vb * vb / (n_b - 1))', 4)} AS df FROM pw""", PAIRS))
def pairwise_welch(spark, sf):
    t = comparisons.pairwise_welch(_regions(spark, sf))
    return t.select("feature", "grp_a", "grp_b", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("diff", 6), ("t", 5), ("df", 4))])


@query(sql("mlog", f"""SELECT feature, grp_a, grp_b, {R('diff')} AS diff, k, n - k AS df2, {R('abs(diff) / nullif(sqrt(ss_within / (n - k) / 2 * (1.0 / n_a + 1.0 / n_b)), 0)', 5)} AS q_stat
    FROM pw JOIN ({ANOVA.format('reg')}) USING (feature)""", PAIRS))
def tukey_kramer(spark, sf):
    t = comparisons.tukey_kramer(_regions(spark, sf))
    return t.select("feature", "grp_a", "grp_b", (F.round("diff", 6) + 0.0).alias("diff"), "k", "df2", (F.round("q_stat", 5) + 0.0).alias("q_stat"))


@query(sql("mlog", f"""SELECT region AS contrast, feature, count(*) FILTER (grp = 'A') AS n_a, count(*) FILTER (grp = 'B') AS n_b, {R("avg(value) FILTER (grp = 'A') - avg(value) FILTER (grp = 'B')")} AS log2fc,
    {R("(avg(value) FILTER (grp = 'A') - avg(value) FILTER (grp = 'B')) / nullif(sqrt(var_samp(value) FILTER (grp = 'A') / count(*) FILTER (grp = 'A') + var_samp(value) FILTER (grp = 'B') / count(*) FILTER (grp = 'B')), 0)", 5)} AS t
    FROM mlog GROUP BY 1, 2 HAVING count(*) FILTER (grp = 'A') >= 2 AND count(*) FILTER (grp = 'B') >= 2"""))
def contrast_runner(spark, sf):
    meta = V.meta_sales(spark, sf).select(F.col("region").alias("contrast"), "sample", F.lower("grp").alias("side"))
    t = comparisons.contrasts(V.log_matrix(spark, sf).select("feature", "sample", "value"), meta).filter("n_a >= 2 and n_b >= 2")
    return t.select("contrast", "feature", "n_a", "n_b", (F.round("log2fc", 6) + 0.0).alias("log2fc"), (F.round("t", 5) + 0.0).alias("t"))


@query(None)
def moderated_t(spark, sf):
    return rounded(comparisons.moderated_t(V.log_matrix(spark, sf), *two).select("feature", "s2", "s2_post", "df_total", "t_mod", "p_mod", "z_mod"))


TWO_WAY = """cl AS (SELECT feature, grp, batch, CAST(count(*) AS DOUBLE) AS n, avg(value) AS m, coalesce(var_samp(value), 0) AS v FROM mlog GROUP BY 1, 2, 3),
    st AS (SELECT feature, batch, max(n) FILTER (grp = 'A') AS n1, max(n) FILTER (grp = 'B') AS n2, max(m) FILTER (grp = 'A') AS m1, max(m) FILTER (grp = 'B') AS m2,
      sum((n - 1) * v) AS sse, sum(n * m) AS s, sum(n * m * m) AS q, sum(n) AS nb FROM cl GROUP BY 1, 2),
    tw AS (SELECT feature, count(*) AS lb, count(n1 * n2) AS full_, sum(nb) AS n, sum(sse) AS sse, pow(sum(n1 * n2 / (n1 + n2) * (m1 - m2)), 2) / sum(n1 * n2 / (n1 + n2)) AS ab,
      sum(s * s / nb) - pow(sum(s), 2) / sum(nb) AS sb, pow(sum(n1 * m1), 2) / sum(n1) + pow(sum(n2 * m2), 2) / sum(n2) - pow(sum(s), 2) / sum(nb) AS sa, sum(q) - pow(sum(s), 2) / sum(nb) AS cells FROM st GROUP BY 1)"""


@query(sql("mlog", f"""SELECT feature, {R('ab')} AS ss_a, {R('sb + ab - sa')} AS ss_b, {R('cells - sb - ab')} AS ss_ab, {R('sse')} AS ss_error, {R('ab / (sse / (n - 2 * lb))', 5)} AS f_a,
    {R('(n - 2 * lb)')} AS df_error FROM tw WHERE full_ = lb AND n - 2 * lb > 0 AND lb >= 2""", TWO_WAY))
def two_way_anova(spark, sf):
    t = comparisons.two_way(V.log_matrix(spark, sf), "grp", "batch").filter("ss_a is not null")
    return rounded(t.select("feature", "ss_a", "ss_b", "ss_ab", "ss_error", F.round("f_a", 5).alias("f_a"), "df_error"))


@query(sql("meta", f"""SELECT {R('n * (s - 1)')} AS chi2, {R('sqrt(n * (s - 1) / (n * (least(kx, ky) - 1)))')} AS v, kx, ky FROM (SELECT sum(c * c / (rx * ry)) AS s, max(n) AS n, count(DISTINCT x) AS kx, count(DISTINCT y) AS ky FROM (
    SELECT grp AS x, region AS y, CAST(count(*) AS DOUBLE) AS c, sum(count(*)) OVER (PARTITION BY grp) AS rx, sum(count(*)) OVER (PARTITION BY region) AS ry, sum(count(*)) OVER () AS n FROM meta GROUP BY 1, 2))"""))
def cramers_v(spark, sf):
    return rounded(comparisons.cramers_v(V.meta_sales(spark, sf), "grp", "region"))


LAYERS = """lay AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS sample, l_returnflag AS layer FROM lineitem)"""


@query(sql("", "SELECT sample, n_layers, CASE WHEN n_layers = (SELECT count(DISTINCT layer) FROM lay) THEN 'all' WHEN n_layers > 1 THEN 'some' ELSE 'one' END AS tier FROM (SELECT sample, count(*) AS n_layers FROM lay GROUP BY 1)", LAYERS))
def design_tiers(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return comparisons.design_tiers(li.select(F.col("l_orderkey").cast("string").alias("sample"), F.col("l_returnflag").alias("layer")))


@query(sql("design", """SELECT grp, hours, count(*) AS n, max(nt) AS n_times, CASE WHEN hours IS NULL THEN 'missing_time' WHEN count(*) < 5 THEN 'few_replicates' WHEN max(nt) < 5 THEN 'few_times' ELSE '' END AS warning
    FROM design JOIN (SELECT grp, count(DISTINCT hours) AS nt FROM design GROUP BY 1) USING (grp) GROUP BY 1, 2"""))
def design_warnings(spark, sf):
    return comparisons.design_warnings(V.design_mid(spark, sf), 5)


# -- adjustment, ranks, quantiles -------------------------------------------------------------------------------------

ADJ = "adj AS (SELECT p_partkey AS feature, p_brand AS fam, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice % 97 / 97.0 END AS p FROM part)"


def _p_values(spark, sf):
    p = F.when(F.col("p_size") % 7 == 0, None).otherwise(F.col("p_retailprice") % 97 / 97.0)
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("feature"), F.col("p_brand").alias("fam"), p.alias("p"))


def _adjust_sql(method: str, keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    m, le = f"count(p) OVER ({part})", f"count(p) OVER ({part} ORDER BY p NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    same = f"count(p) OVER (PARTITION BY {keys + ',' if keys else ''} p)"
    base = f"SELECT *, CAST({m} AS DOUBLE) AS m, {le} AS le, {le} - {same} AS lt FROM adj"
    down, up = f"({part} ORDER BY p DESC NULLS LAST ROWS UNBOUNDED PRECEDING)", f"({part} ORDER BY p NULLS LAST ROWS UNBOUNDED PRECEDING)"
    value = {
        "bh": f"min(p * m / le) OVER {down}", "by": f"min(p * m * (SELECT list_sum(list_transform(range(1, CAST(m AS BIGINT) + 1), lambda i: 1.0 / i))) / le) OVER {down}",
        "holm": f"max(p * (m - lt)) OVER {up}", "bonferroni": "p * m",
    }[method]
    return sql("", f"SELECT feature, fam, {R('p')} AS p, {R(f'CASE WHEN p IS NOT NULL THEN least(1.0, {value}) END')} AS q FROM ({base})", ADJ)


def _adjust(method: str, keys, bounded: bool):
    return lambda spark, sf: rounded(p_adjust(_p_values(spark, sf), "p", keys, method, "q", bounded=bounded))


for _m in ("bh", "by", "holm", "bonferroni"):
    QUERIES[f"adjust_{_m}"], SQL[f"adjust_{_m}"] = _adjust(_m, (), False), _adjust_sql(_m, "")
    QUERIES[f"adjust_{_m}_families"], SQL[f"adjust_{_m}_families"] = _adjust(_m, ("fam",), False), _adjust_sql(_m, "fam")
QUERIES["adjust_bh_bounded"], SQL["adjust_bh_bounded"] = _adjust("bh", ("fam",), True), _adjust_sql("bh", "fam")


@query("SELECT l_orderkey, l_linenumber, l_quantity, " + R("rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0") + " AS mid_rank FROM lineitem")
def mid_rank_global(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(mid_ranks(li, (), "l_quantity"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, " + R("rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0") + " AS mid_rank FROM lineitem")
def mid_rank_keyed(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return rounded(mid_ranks(li, ("l_returnflag",), "l_quantity"))


@query(f"SELECT {tidy('~q1 = quantile_cont(l_extendedprice, 0.25); ~med = median(l_extendedprice); ~q99 = quantile_cont(l_extendedprice, 0.99)')} FROM lineitem")
def quantiles_global(spark, sf):
    return rounded(quantiles(V.table(spark, sf, "lineitem"), (), "l_extendedprice", [0.25, 0.5, 0.99], ["q1", "med", "q99"]))


@query(f"SELECT l_returnflag, {tidy('~q1 = quantile_cont(l_extendedprice, 0.25); ~med = median(l_extendedprice); ~q99 = quantile_cont(l_extendedprice, 0.99)')} FROM lineitem GROUP BY 1")
def quantiles_keyed(spark, sf):
    return rounded(quantiles(V.table(spark, sf, "lineitem"), ("l_returnflag",), "l_extendedprice", [0.25, 0.5, 0.99], ["q1", "med", "q99"]))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem) WHERE place <= 3""")
def top_k_per_key(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return top_k(li, ("l_suppkey",), (F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")), 3).withColumn("place", F.col("place").cast("bigint"))


# -- result views -----------------------------------------------------------------------------------------------------

SHOW = "feature, " + tidy("~log2fc = log2fc; ~p = p; ~q = q")


def _shown(df: DataFrame, *more) -> DataFrame:
    return rounded(df.select("feature", "log2fc", "p", "q", *more))


@query(sql("mlog", f"SELECT {SHOW}, CASE WHEN log2fc > 0 THEN 'Up' ELSE 'Down' END AS direction FROM welq WHERE p < 0.2 AND q < 0.9", WELCH_Q))
def marker_selection(spark, sf):
    return _shown(results.markers(_welch(spark, sf), "both", 0.2, 0.9), "direction")


@query(sql("mlog", f"SELECT {SHOW} FROM welq WHERE p <= 0.3 AND log2fc > 0", WELCH_Q))
def enrichment_selection(spark, sf):
    return _shown(results.select_for_enrichment(_welch(spark, sf), "p", 0.3, "up"))


@query(sql("mlog", f"SELECT {SHOW}, coalesce(p < 0.1, false) OR coalesce(q < 0.1, false) AS significant FROM welq", WELCH_Q))
def significance_flags(spark, sf):
    return _shown(_welch(spark, sf), results.significant(cut=0.1).alias("significant"))


@query(sql("mlog", f"""SELECT {SHOW}, {R('-log10(greatest(p, 1e-300))', 4)} AS neglog10_p, CASE WHEN p < 0.2 AND log2fc >= 0.1 THEN 'Up' WHEN p < 0.2 AND log2fc <= -0.1 THEN 'Down' ELSE 'NS' END AS direction FROM welq""", WELCH_Q))
def volcano_directions(spark, sf):
    return _shown(results.directions(_welch(spark, sf), 0.2, 0.1), F.round("neglog10_p", 4).alias("neglog10_p"), "direction")


@query(sql("mlog", f"SELECT {SHOW} FROM welq WHERE p <= 0.25", WELCH_Q))
def result_filter(spark, sf):
    return _shown(_welch(spark, sf).filter(results.passes("p", 0.25)))


@query(sql("mlog", "SELECT feature, " + tidy("~p = p; ~fdr = q; ~log2fc = log2fc; ~fc = pow(2.0, log2fc)") + ", coalesce(q <= 0.5, false) AS significant, CASE WHEN log2fc > 0 THEN 'A' WHEN log2fc < 0 THEN 'B' ELSE '' END AS higher_in FROM welq", WELCH_Q))
def standard_projection(spark, sf):
    return rounded(results.standard_view(_welch(spark, sf), *two, 0.5))


@query(sql("mlog", f"SELECT {SHOW} FROM welq ORDER BY p NULLS LAST, feature LIMIT 20", WELCH_Q))
def top_results(spark, sf):
    return _shown(results.first_rows(_welch(spark, sf), "p", 20))


# -- sets -------------------------------------------------------------------------------------------------------------

SETS = """uni AS (SELECT DISTINCT member FROM score), cut AS (SELECT quantile_cont(score, 0.9) AS c FROM score), hit AS (SELECT member FROM score, cut WHERE score >= c),
    us AS (SELECT set_id, member, member IN (SELECT member FROM hit) AS h FROM sets WHERE member IN (SELECT member FROM uni)),
    oc AS (SELECT set_id, (SELECT count(*) FROM uni) AS n_universe, count(*) AS set_size, (SELECT count(*) FROM hit) AS n_hits, count(*) FILTER (h) AS hits FROM us GROUP BY 1)"""


def _hits(spark, sf):
    s = V.part_score(spark, sf)
    return attach_scalars(s, quantiles(s, (), "score", [0.9], ["_c"])).filter("score >= _c").select("member")


def _ora(spark, sf, f=sets.ora, **how):
    return f(V.part_sets(spark, sf), V.part_score(spark, sf), _hits(spark, sf), **how)


@query(sql("sets score", f"SELECT set_id, n_universe, set_size, n_hits, hits, {R('n_hits * set_size * 1.0 / n_universe')} AS expected, {R('hits / (n_hits * set_size * 1.0 / n_universe)')} AS fold FROM oc", SETS))
def set_counts(spark, sf):
    return rounded(_ora(spark, sf, sets.ora_counts))


ORA_P = SETS + f", op AS (SELECT *, {sql_hyper_p('hits', 'n_universe', 'set_size', 'n_hits')} AS p FROM oc)"


@query(sql("sets score", f"SELECT set_id, set_size, hits, {R('p')} AS p, {R('q')} AS q FROM {sql_bh('op', 'p', '')}", ORA_P))
def over_representation(spark, sf):
    return rounded(_ora(spark, sf).select("set_id", "set_size", "hits", "p", "q"))


@query(sql("sets score", f"""SELECT set_id, CAST(5000 AS BIGINT) AS n_universe, K2 AS set_size, n_hits, hits, {R('n_hits * K2 * 1.0 / 5000')} AS expected, {R('hits / (n_hits * K2 * 1.0 / 5000)')} AS fold
    FROM (SELECT *, CASE WHEN set_id LIKE 'type:%' THEN greatest(2 * set_size, hits) ELSE set_size END AS K2 FROM oc)""", SETS))
def set_counts_calibrated(spark, sf):
    have = V.part_sets(spark, sf).join(V.part_score(spark, sf), "member", "left_semi").filter("set_id like 'type:%'")
    sizes = have.groupBy("set_id").agg((2 * F.count(F.lit(1))).alias("size"))
    return rounded(_ora(spark, sf, sets.ora_counts, sizes=sizes, total=5000))


CALLS = """cal AS (SELECT l_partkey, CAST(l_partkey AS VARCHAR) AS member, CASE WHEN l_returnflag = 'R' THEN 'protein' ELSE 'mrna' END AS layer, avg(l_discount) AS p, avg(l_quantity) - 25 AS d FROM lineitem GROUP BY 1, 2, 3),
    one AS (SELECT member, layer, d FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY CASE layer WHEN 'protein' THEN 0 ELSE 1 END, p, layer) AS n FROM cal) WHERE n = 1)"""


def _calls(spark, sf):
    li = V.table(spark, sf, "lineitem")
    layer = F.when(F.col("l_returnflag") == "R", "protein").otherwise("mrna")
    t = li.groupBy(F.col("l_partkey").cast("string").alias("member"), layer.alias("layer")).agg(F.avg("l_discount").alias("p"), (F.avg("l_quantity") - 25).alias("direction"))
    return sets.molecule_calls(t, {"protein": 0, "mrna": 1})


@query(sql("", f"SELECT member, layer, {R('d')} AS direction FROM one", CALLS))
def molecule_calls(spark, sf):
    return rounded(_calls(spark, sf).select("member", "layer", "direction"))


@query(sql("sets", f"""SELECT set_id, up, down, {R('CASE WHEN up + down >= 4 THEN (up - down) / sqrt(up + down) END')} AS z, CASE WHEN up + down >= 4 AND (up - down) / sqrt(up + down) >= 2 THEN 'activated'
    WHEN up + down >= 4 AND (up - down) / sqrt(up + down) <= -2 THEN 'inhibited' ELSE '' END AS state FROM (SELECT set_id, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down FROM sets JOIN one USING (member) GROUP BY 1)""", CALLS))
def set_directions(spark, sf):
    return rounded(sets.directional(V.part_sets(spark, sf), _calls(spark, sf)))


@query(sql("sets score", """SELECT member, set_id, measured, size FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY CASE WHEN measured >= 3 THEN 0 WHEN measured = 2 THEN 1 ELSE 2 END,
    -(measured * measured / CAST(size AS DOUBLE)), size, set_id) AS n FROM (SELECT set_id, size, measured FROM (SELECT set_id, count(*) AS size, count(*) FILTER (member IN (SELECT member FROM hit)) AS measured FROM sets GROUP BY 1))
    JOIN sets USING (set_id) WHERE member IN (SELECT member FROM hit)) WHERE n = 1""", SETS))
def best_covered_sets(spark, sf):
    return sets.best_covered_set(V.part_sets(spark, sf), _hits(spark, sf))


@query(sql("sets score", """SELECT member, CASE WHEN c >= 2 THEN set_id ELSE 'Other' END AS label FROM (SELECT *, count(*) OVER (PARTITION BY set_id) AS c FROM (
    SELECT member, set_id, row_number() OVER (PARTITION BY member ORDER BY r) AS n FROM sets JOIN (SELECT set_id, row_number() OVER (ORDER BY round(p, 9), set_id) AS r FROM op ORDER BY round(p, 9), set_id LIMIT 8) USING (set_id)) WHERE n = 1)""", ORA_P))
def top_set_labels(spark, sf):
    return sets.top_set_label(V.part_sets(spark, sf), _ora(spark, sf).withColumn("p", F.round("p", 9)))


@query(sql("sets score", f"""SELECT set_id, hits, {R('CASE WHEN abs(up) >= abs(lo) THEN up ELSE lo END')} AS es FROM (SELECT set_id, count(*) AS hits, max(run) AS up, min(run - w / sw) AS lo FROM (
    SELECT set_id, w, sum(w) OVER s AS sw, sum(w) OVER (s ORDER BY rank ROWS UNBOUNDED PRECEDING) / sum(w) OVER s - (rank - row_number() OVER (s ORDER BY rank)) / CAST(nn - count(*) OVER s AS DOUBLE) AS run
    FROM (SELECT set_id, abs(sc) AS w, rank, nn FROM sets JOIN (SELECT member, sc, row_number() OVER (ORDER BY sc DESC, member) AS rank, count(*) OVER () AS nn FROM
    (SELECT member, round(score - (SELECT median(score) FROM score), 2) AS sc FROM score)) USING (member)) WINDOW s AS (PARTITION BY set_id)) GROUP BY set_id)"""))
def enrichment_scores(spark, sf):
    s = V.part_score(spark, sf)
    s = attach_scalars(s, quantiles(s, (), "score", [0.5], ["_m"])).select("member", F.round(F.col("score") - F.col("_m"), 2).alias("score"))
    return rounded(sets.enrichment_score(V.part_sets(spark, sf), s).select("set_id", "hits", "es"))


@query(sql("sets score", "SELECT DISTINCT member FROM sets WHERE member NOT IN (SELECT member FROM hit)", SETS))
def unmatched_members(spark, sf):
    return sets.unmatched(V.part_sets(spark, sf), _hits(spark, sf))


# -- isotopes and time courses ----------------------------------------------------------------------------------------

FR = "fr AS (SELECT compound, i, sample, n, area / sum(area) OVER (PARTITION BY compound, sample) AS f FROM mid), la AS (SELECT compound, sample, max(n) AS n, 100 * (1 - max(f) FILTER (i = 0)) AS inc, sum(i * f) AS ml FROM fr GROUP BY 1, 2)"


@query(sql("mid", f"SELECT compound, i, sample, {R('f')} AS fraction FROM fr", FR))
def isotope_fractions(spark, sf):
    return rounded(isotopes.fractions(V.mid(spark, sf)).select("compound", "i", "sample", "fraction"))


@query(sql("mid", f"SELECT compound, sample, {R('inc')} AS incorporation, {R('ml')} AS mean_labels, {R('ml * 100 / n')} AS enrichment FROM la", FR))
def labelling_summary(spark, sf):
    return rounded(isotopes.labelling(V.mid(spark, sf)).select("compound", "sample", "incorporation", "mean_labels", "enrichment"))


LOW = """lowr AS (SELECT compound, i, bool_or(area < 150000) AS low FROM mid WHERE sample IN (SELECT sample FROM design WHERE sample_type = 'labelled' AND include) GROUP BY 1, 2)"""


@query(sql("mid design", f"""SELECT compound, i, sample, {R('area')} AS area FROM mid WHERE compound NOT IN (SELECT compound FROM lowr WHERE low AND i = 0)
    AND (compound, i) NOT IN (SELECT (compound, i) FROM lowr WHERE low AND i > 0)""", LOW))
def zero_rule(spark, sf):
    t = isotopes.zero_rule(V.mid(spark, sf), isotopes.analysed(V.design_mid(spark, sf)), 150000)
    return rounded(t.select("compound", "i", "sample", "area"))


@query(sql("mid", f"SELECT compound, i, sample, {R('area')} AS area FROM mid WHERE i < CASE WHEN compound = 'Brand#11' THEN 1 ELSE 99 END AND compound <> 'Brand#11'"))
def unlabelled_only(spark, sf):
    m = V.mid(spark, sf).filter("compound <> 'Brand#11' or i = 0")
    return rounded(isotopes.drop_unlabelled_only(m).select("compound", "i", "sample", "area"))


@query(sql("mid design", f"SELECT compound, {R('max(inc)')} AS highest FROM la WHERE sample IN (SELECT sample FROM design WHERE sample_type = 'reference') GROUP BY 1 HAVING max(inc) > 76", FR))
def interference(spark, sf):
    return rounded(isotopes.interference(isotopes.labelling(V.mid(spark, sf)), V.design_mid(spark, sf), 76))


COND = "cond AS (SELECT sample, grp || ' ' || treatment || ' ' || CAST(hours AS VARCHAR) || 'h' AS condition FROM design WHERE sample_type = 'labelled' AND include)"


@query(sql("mid design", f"SELECT compound, {R('max(m)')} AS highest FROM (SELECT compound, condition, avg(inc) AS m FROM la JOIN cond USING (sample) GROUP BY 1, 2) GROUP BY 1 HAVING max(m) >= 74", FR + ", " + COND))
def labelled_compounds(spark, sf):
    return rounded(isotopes.labelled_compounds(isotopes.labelling(V.mid(spark, sf)), V.design_mid(spark, sf), 74))


@query(sql("mid design", f"""SELECT compound, measure, condition, count(v) AS n, {R('avg(v)')} AS mean, {R('stddev_samp(v)')} AS sd FROM (SELECT compound, sample, 'M+' || i AS measure, f AS v FROM fr UNION ALL SELECT compound, sample, 'incorporation', inc FROM la
    UNION ALL SELECT compound, sample, 'mean_labels', ml FROM la UNION ALL SELECT compound, sample, 'enrichment', ml * 100 / n FROM la) JOIN cond USING (sample) GROUP BY 1, 2, 3""", FR + ", " + COND))
def incorporation_table(spark, sf):
    return rounded(isotopes.incorporation_table(V.mid(spark, sf), V.design_mid(spark, sf)))


@query(sql("design", "SELECT sample, grp || ' ' || treatment AS arm, grp || ' ' || treatment || ' ' || CAST(hours AS VARCHAR) || 'h' AS condition, row_number() OVER (PARTITION BY grp, treatment, hours ORDER BY sample) AS replicate FROM design"))
def design_columns(spark, sf):
    t = isotopes.with_conditions(V.design_mid(spark, sf))
    return t.select("sample", "arm", "condition", F.col("replicate").cast("bigint").alias("replicate"))


@query(sql("design", "SELECT sample, grp, treatment, hours FROM design WHERE sample_type = 'labelled' AND include"))
def analysed_samples(spark, sf):
    return isotopes.analysed(V.design_mid(spark, sf)).select("sample", "grp", "treatment", "hours")


TS = "ts AS (SELECT compound, grp, hours, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, stddev_samp(value) / sqrt(count(value)) AS sem FROM tc GROUP BY 1, 2, 3)"


def _times(spark, sf):
    return isotopes.time_summary(V.timecourse(spark, sf))


@query(sql("tc", "SELECT compound, grp, hours, n, " + tidy("~mean = mean; ~sd = sd; ~sem = sem") + " FROM ts", TS))
def time_summaries(spark, sf):
    return rounded(_times(spark, sf))


@query(sql("tc", f"""SELECT compound, grp, h0 AS from_hours, hours AS to_hours, {R('(mean - m0) / (hours - h0)')} AS slope, {R('sqrt(sem * sem + s0 * s0) / (hours - h0)')} AS se FROM (
    SELECT *, lag(hours) OVER w AS h0, lag(mean) OVER w AS m0, lag(sem) OVER w AS s0 FROM ts WINDOW w AS (PARTITION BY compound, grp ORDER BY hours)) WHERE h0 IS NOT NULL""", TS))
def consecutive_slopes(spark, sf):
    return rounded(isotopes.slopes(_times(spark, sf)))


@query(sql("tc", """SELECT compound, grp, count(*) AS n_times, NOT bool_or(coalesce(m0 - mean > greatest(m0 * 0.05, 0.5), false)) AS monotone FROM (
    SELECT *, lag(mean) OVER (PARTITION BY compound, grp ORDER BY hours) AS m0 FROM ts) GROUP BY 1, 2""", TS))
def monotone_curves(spark, sf):
    return isotopes.monotone(_times(spark, sf))


GRID = "0.001 * pow(pow(50000.0, 1.0 / 399), j)"
FIT = f"""fit AS (SELECT compound, grp, k, e, nt, n, yy - 2 * e * yb + e * e * bb AS rss, yy - y * y / n AS tss FROM (SELECT *, least(100.0, greatest(0.0, yb / bb)) AS e FROM (
    SELECT compound, grp, k, count(DISTINCT hours) AS nt, count(*) AS n, sum(value * (1 - exp(-k * hours))) AS yb, sum(pow(1 - exp(-k * hours), 2)) AS bb, sum(value * value) AS yy, sum(value) AS y
    FROM (SELECT *, {GRID} AS k FROM tc, range(0, 400) AS g(j) WHERE hours > 0) GROUP BY 1, 2, 3) WHERE nt >= 3)),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY compound, grp ORDER BY k) AS o FROM (SELECT *, min(rss) OVER (PARTITION BY compound, grp) AS lr FROM fit) WHERE rss <= lr * (1 + 1e-6) + 1e-12) WHERE o = 1)"""


@query(sql("tc", f"SELECT compound, grp, nt AS n_times, n, {R('k')} AS k, {R('e', 4)} AS e_inf, {R('rss', 2)} AS rss, {R('1 - rss / tss', 5)} AS r2 FROM best", FIT))
def labelling_fits(spark, sf):
    t = isotopes.first_order_fit(V.timecourse(spark, sf))
    return t.select("compound", "grp", "n_times", "n", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("k", 6), ("e_inf", 4), ("rss", 2), ("r2", 5))])


@query(sql("tc", "SELECT compound, grp, row_number() OVER (PARTITION BY grp ORDER BY ln(2.0) / k, compound) AS place FROM best WHERE 1 - rss / tss >= -1", FIT))
def speed_ranks(spark, sf):
    t = isotopes.speed_ranking(isotopes.first_order_fit(V.timecourse(spark, sf)), -1)
    return t.select("compound", "grp", F.col("place").cast("bigint").alias("place"))


# -- names and labels -------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part")
def name_keys(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", names.name_key(F.col("p_name")).alias("key"))


@query("SELECT c_custkey, 'C' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS id FROM customer")
def padded_ids(spark, sf):
    return V.table(spark, sf, "customer").select("c_custkey", names.padded_id(F.concat(F.lit(" c00"), "c_custkey"), "C", 7).alias("id"))


@query("SELECT p_partkey, regexp_matches(upper(split_part(p_name, ' ', 1)), '^[A-Z][A-Z0-9-]{1,14}$') AS symbol FROM part")
def gene_symbols(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", names.gene_symbol(F.upper(F.substring_index("p_name", " ", 1))).alias("symbol"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS i FROM lineitem")
def isotopologue_labels(spark, sf):
    li = V.table(spark, sf, "lineitem")
    styles = F.array(*[F.lit(x) for x in ("M+", "m", "M_", "ISO", "13C", "Glucose M+", " m + ")])
    style = F.get(styles, (F.col("l_quantity") % 7).cast("int"))
    return li.select("l_orderkey", "l_linenumber", names.isotopologue(F.concat(style, F.col("l_linenumber") - 1)).alias("i"))


@query(f"SELECT l_orderkey, l_linenumber, {R('l_quantity * CASE l_linenumber % 3 WHEN 0 THEN 1.0 / 60 WHEN 1 THEN 1 ELSE 24 END')} AS hours FROM lineitem")
def time_texts(spark, sf):
    words = [F.array(*[F.lit(x) for x in w]) for w in ((" min", "mins", " minutes", "m"), ("h", " hours", " hr", "hour"), (" d", "day", " days", "d"))]
    style = (F.col("l_orderkey") % 4).cast("int")
    unit = F.when(F.col("l_linenumber") % 3 == 0, F.get(words[0], style)).when(F.col("l_linenumber") % 3 == 1, F.get(words[1], style)).otherwise(F.get(words[2], style))
    li = V.table(spark, sf, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", names.hours(F.concat(F.col("l_quantity").cast("string"), unit)).alias("hours")))


@query("SELECT p_partkey, CAST(6 * (p_size % 5 + 1) AS INTEGER) AS carbon, CAST(12 * (p_size % 5 + 1) + 1 AS INTEGER) AS hydrogen FROM part")
def formula_counts(spark, sf):
    c = F.col("p_size") % 5 + 1
    f = F.concat(F.lit("C"), 6 * c, F.lit("H"), 12 * c, F.lit("OH"))
    e = names.formula_elements(f)
    of = lambda x: F.aggregate(e, F.lit(0), lambda s, y: s + F.when(y["element"] == x, y["count"]).otherwise(0))
    return V.table(spark, sf, "part").select("p_partkey", of("C").alias("carbon"), of("H").alias("hydrogen"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'SFA' WHEN 1 THEN 'SFA|MUFA' ELSE 'SFA|PUFA|C22+' END AS classes FROM part")
def acyl_classes(spark, sf):
    second = F.when(F.col("p_size") % 3 == 0, "18:0").when(F.col("p_size") % 3 == 1, "18:1").otherwise("22:6")
    return V.table(spark, sf, "part").select("p_partkey", F.array_join(names.acyl_classes(F.concat(F.lit("PC 16:0_"), second)), "|").alias("classes"))

