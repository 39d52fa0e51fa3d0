"""Group comparisons on long matrices: everything is derived from one table of group moments per feature.

Input is a long table with columns feature, grp, value (and sample where pairs or ranks need it).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaygrid.functions import dist
from assaygrid.operators.base import attach_scalars, count_if, div, join_same, mid_ranks, number, p_adjust, quantiles
from assaygrid.session import cut_lineage


EXACT_PRODUCT = 20_000  # the exact counts of U are as many numbers


def with_groups(matrix: DataFrame, meta: DataFrame, column: str = "grp", *more: str) -> DataFrame:
    return matrix.join(meta.select("sample", F.col(column).alias("grp"), *more), "sample").filter("grp is not null")


def moments(rows: DataFrame, keys=("feature",)) -> DataFrame:
    """n, mean, variance and sd of each group; NULL and NaN values are left out."""
    v = number(F.col("value").cast("double"))
    return rows.groupBy(*keys, "grp").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))


def two_groups(m: DataFrame, a: str, b: str, keys=("feature",)) -> DataFrame:
    """Moments of groups a and b side by side; a group without values has n 0."""
    def pick(g: str, c: str) -> Column:
        return F.max(F.when(F.col("grp") == g, F.col(c)))

    return m.filter(F.col("grp").isin(a, b)).groupBy(*keys).agg(
        *[F.coalesce(pick(g, "n"), F.lit(0)).alias(f"n_{x}") for g, x in ((a, "a"), (b, "b"))],
        *[pick(g, c).alias(f"{c}_{x}") for c in ("mean", "var") for g, x in ((a, "a"), (b, "b"))],
    )


def welch(rows: DataFrame, a: str, b: str, keys=("feature",), direction: str = "a-b") -> DataFrame:
    """Welch statistics per feature on log2 values: difference, fold change, t, degrees of freedom, standard error, warning."""
    t = two_groups(moments(rows, keys), a, b, keys)
    va, vb = div("var_a", "n_a"), div("var_b", "n_b")
    diff = F.col("mean_a") - F.col("mean_b") if direction == "a-b" else F.col("mean_b") - F.col("mean_a")
    t = t.withColumn("log2fc", diff).withColumn("fold", F.pow(F.lit(2.0), "log2fc")).withColumn("se", F.sqrt(va + vb))
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    df = div(F.pow(va + vb, F.lit(2)), div(va * va, F.col("n_a") - 1) + div(vb * vb, F.col("n_b") - 1))
    t = t.withColumn("t", F.when(enough, div("log2fc", "se"))).withColumn("df", F.when(enough, df))
    ratio = div(F.greatest("var_a", "var_b"), F.least("var_a", "var_b"))
    warn = (
        F.when(~enough, "low_n")
        .when((F.col("var_a") == 0) | (F.col("var_b") == 0), "zero_variance")
        .when(ratio > 16, "variances_differ")
        .when(F.col("df") < 2, "low_df")
        .otherwise("")
    )
    return t.withColumn("warning", warn)


def welch_table(rows: DataFrame, a: str, b: str, keys=("feature",), direction: str = "a-b", family=()) -> DataFrame:
    """``welch`` with two-sided p, adjusted p over the family and the 95 % confidence interval."""
    t = welch(rows, a, b, keys, direction).withColumn("p", dist.t_sf("t", "df"))
    half = dist.t_ppf(F.when(F.col("df").isNotNull(), F.lit(0.975)), "df") * F.col("se")
    t = t.withColumn("ci_low", F.col("log2fc") - half).withColumn("ci_high", F.col("log2fc") + half)
    return p_adjust(t, "p", family, "bh", "q")


def student(rows: DataFrame, a: str, b: str, keys=("feature",)) -> DataFrame:
    """Pooled-variance t per feature."""
    t = two_groups(moments(rows, keys), a, b, keys)
    df = F.col("n_a") + F.col("n_b") - 2
    pooled = div((F.col("n_a") - 1) * F.coalesce("var_a", F.lit(0.0)) + (F.col("n_b") - 1) * F.coalesce("var_b", F.lit(0.0)), df)
    se = F.sqrt(pooled * (div(F.lit(1.0), "n_a") + div(F.lit(1.0), "n_b")))
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    return t.withColumn("df", df).withColumn("t", F.when(enough, div(F.col("mean_a") - F.col("mean_b"), se)))


def paired(rows: DataFrame, pairs: DataFrame, keys=("feature",)) -> DataFrame:
    """t of the differences of paired samples; ``pairs`` has sample_a and sample_b."""
    v = rows.select(*keys, "sample", "value")
    d = v.withColumnsRenamed({"sample": "sample_a", "value": "_a"}).join(pairs, "sample_a").join(
        v.withColumnsRenamed({"sample": "sample_b", "value": "_b"}), [*keys, "sample_b"]
    )
    d = d.withColumn("_d", F.col("_a") - F.col("_b"))
    t = d.groupBy(*keys).agg(F.count("_d").alias("n"), F.avg("_d").alias("mean_diff"), F.stddev_samp("_d").alias("sd"))
    return t.withColumn("df", F.col("n") - 1).withColumn("t", F.when(F.col("n") >= 2, div("mean_diff", F.col("sd") / F.sqrt("n"))))


def anova(rows: DataFrame, keys=("feature",)) -> DataFrame:
    """One-way analysis of variance over groups with two values or more."""
    m = moments(rows, keys).filter("n >= 2")
    t = m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("_s"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_q"), F.sum((F.col("n") - 1) * F.col("var")).alias("ss_within"),
    )
    t = t.withColumn("ss_between", F.col("_q") - F.col("_s") * F.col("_s") / F.col("n")).drop("_s", "_q")
    t = t.withColumn("df1", F.col("k") - 1).withColumn("df2", F.col("n") - F.col("k"))
    return t.withColumn("f", F.when(F.col("df1") > 0, div(div("ss_between", "df1"), div("ss_within", "df2"))))


def brown_forsythe(rows: DataFrame, keys=("feature",)) -> DataFrame:
    """``anova`` of the absolute distances from the group medians."""
    med = quantiles(rows, [*keys, "grp"], "value", [0.5], ["_m"])
    return anova(join_same(rows, med, [*keys, "grp"]).withColumn("value", F.abs(F.col("value") - F.col("_m"))), keys)


def welch_anova(rows: DataFrame, keys=("feature",)) -> DataFrame:
    """Welch's analysis of variance without equal variances."""
    m = moments(rows, keys).filter("n >= 2 and var > 0").withColumn("_w", F.col("n") / F.col("var"))
    s = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col("mean")).alias("_swm"))
    j = join_same(m, s, keys).withColumn("_gm", F.col("_swm") / F.col("_sw"))
    r = F.pow(1 - F.col("_w") / F.col("_sw"), F.lit(2)) / (F.col("n") - 1)
    t = j.groupBy(*keys).agg(F.max("k").alias("k"), F.sum(F.col("_w") * F.pow(F.col("mean") - F.col("_gm"), F.lit(2))).alias("_a"), F.sum(r).alias("_r"))
    k = F.col("k")
    lower = 1 + F.col("_r") * 2 * (k - 2) / (k * k - 1)
    f = F.when(k >= 2, (F.col("_a") / (k - 1)) / lower)
    return t.select(*keys, "k", f.alias("f"), (k - 1).alias("df1"), F.when(k >= 2, (k * k - 1) / (3 * F.col("_r"))).alias("df2"))


def kruskal(rows: DataFrame, keys=("feature",)) -> DataFrame:
    """Kruskal-Wallis H with correction for ties."""
    r = mid_ranks(rows.filter("value is not null"), keys, "value", "_r")
    ties = r.groupBy(*keys, "value").agg(F.count(F.lit(1)).cast("double").alias("_t")).groupBy(*keys).agg(F.sum(F.pow("_t", F.lit(3)) - F.col("_t")).alias("_ties"))
    g = r.groupBy(*keys, "grp").agg(F.count(F.lit(1)).alias("_n"), F.sum("_r").alias("_s"))
    t = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum("_n").cast("double").alias("n"), F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("_q"))
    n = F.col("n")
    h = div(div(F.lit(12.0) * F.col("_q"), n * (n + 1)) - 3 * (n + 1), 1 - div("_ties", F.pow(n, F.lit(3)) - n))
    return join_same(t, ties, keys).select(*keys, "k", n.cast("bigint").alias("n"), F.when(F.col("k") >= 2, h).alias("h"), (F.col("k") - 1).alias("df"))


def mann_whitney(rows: DataFrame, a: str, b: str, keys=("feature",), exact_up_to: int = 8) -> DataFrame:
    """U of group a and two-sided p: exact without ties when the smaller group has at most ``exact_up_to`` values and the groups'
    product is at most ``EXACT_PRODUCT``, else the normal tail with corrections for ties and continuity."""
    r = mid_ranks(rows.filter("value is not null").filter(F.col("grp").isin(a, b)), keys, "value", "_r")
    ties = r.groupBy(*keys, "value").agg(F.count(F.lit(1)).cast("double").alias("_t")).groupBy(*keys).agg(F.sum(F.pow("_t", F.lit(3)) - F.col("_t")).alias("_ties"))
    t = r.groupBy(*keys).agg(
        count_if(F.col("grp") == a).alias("n_a"), count_if(F.col("grp") == b).alias("n_b"), F.sum(F.when(F.col("grp") == a, F.col("_r"))).alias("_s")
    )
    na, nb = F.col("n_a"), F.col("n_b")
    n = (na + nb).cast("double")
    t = join_same(t, ties, keys).withColumn("u", F.col("_s") - na * (na + 1) / 2)
    sd = F.sqrt(na * nb / 12.0 * (n + 1 - div("_ties", n * (n - 1))))
    z = div(F.greatest(F.abs(F.col("u") - na * nb / 2) - 0.5, F.lit(0.0)), sd)
    exact = (F.col("_ties") == 0) & (F.least("n_a", "n_b") <= exact_up_to) & (na * nb <= EXACT_PRODUCT)
    some = (na > 0) & (nb > 0)
    t = t.withColumn("z", F.when(some, z)).withColumn("exact", exact)
    p = F.when(exact, dist.mwu_exact_sf(F.when(exact & some, F.col("u")), "n_a", "n_b")).otherwise(dist.norm_sf("z"))
    return t.withColumn("p", F.when(some, p)).select(*keys, "n_a", "n_b", "u", "z", "exact", "p")


def pairwise_welch(rows: DataFrame, keys=("feature",)) -> DataFrame:
    """Welch t of every pair of groups of a feature (levels of a factor: few)."""
    m = moments(rows, keys).filter("n >= 2")
    x = m.select(*keys, *[F.col(c).alias(f"{c}_a") for c in ("grp", "n", "mean", "var")])
    y = m.select(*keys, *[F.col(c).alias(f"{c}_b") for c in ("grp", "n", "mean", "var")])
    t = join_same(x, y, keys).filter("grp_a < grp_b")
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = t.withColumn("diff", F.col("mean_a") - F.col("mean_b")).withColumn("t", div("diff", F.sqrt(va + vb)))
    return t.withColumn("df", div(F.pow(va + vb, F.lit(2)), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1)))


def tukey_kramer(rows: DataFrame, keys=("feature",)) -> DataFrame:
    """Studentised range statistic and p of every pair of groups with the pooled variance."""
    a = anova(rows, keys).select(*keys, "k", "df2", div("ss_within", "df2").alias("_mse"))
    t = join_same(pairwise_welch(rows, keys).select(*keys, "grp_a", "grp_b", "n_a", "n_b", "diff"), a, keys)
    se = F.sqrt(F.col("_mse") / 2 * (1 / F.col("n_a") + 1 / F.col("n_b")))
    t = t.withColumn("q_stat", div(F.abs("diff"), se)).drop("_mse")
    return t.withColumn("p", dist.srange_sf("q_stat", F.col("k").cast("double"), F.col("df2").cast("double")))


def games_howell(rows: DataFrame, keys=("feature",)) -> DataFrame:
    """Studentised range statistic and p of every pair of groups with the groups' own variances."""
    groups = rows.filter(F.col("value").isNotNull()).groupBy(*keys).agg(F.count_distinct("grp").cast("double").alias("k"))
    t = join_same(pairwise_welch(rows, keys), groups, keys)
    t = t.withColumn("q_stat", div(F.abs("diff"), F.sqrt((F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b")) / 2)))
    return t.withColumn("p", dist.srange_sf("q_stat", "k", "df"))


def contrasts(matrix: DataFrame, members: DataFrame, method: str = "welch", family=("contrast",)) -> DataFrame:
    """A two-group test for every contrast; ``members`` has contrast, sample and side (a or b)."""
    rows = matrix.join(members.withColumnRenamed("side", "grp"), "sample")
    keys = ("contrast", "feature")
    t = welch(rows, "a", "b", keys) if method == "welch" else student(rows, "a", "b", keys)
    return p_adjust(t.withColumn("p", dist.t_sf("t", F.col("df").cast("double"))), "p", family)


def two_way(rows: DataFrame, a: str, b: str, keys=("feature",)) -> DataFrame:
    """Type II sums of squares for a two-level factor a and any factor b, from cell moments.

    SS(A|B) = (sum w d)^2 / sum w over the levels of b, w = n1 n2 / (n1 + n2), d the difference of the cell means;
    SS(B|A) = SS(B) + SS(A|B) - SS(A).  Features with an empty cell or without residual degrees get NULL.
    """
    cell = rows.groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(
        F.count("value").cast("double").alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v")
    ).filter("n > 0")
    levels = rows.select(F.col(a).alias("_a")).distinct().agg(F.min("_a").alias("_l1"), F.max("_a").alias("_l2"))
    cell = attach_scalars(cell, levels)
    one, two = F.col("_a") == F.col("_l1"), F.col("_a") == F.col("_l2")
    strata = cell.groupBy(*keys, "_b").agg(
        *[F.sum(F.when(s, F.col(c))).alias(f"{c}{i}") for c in ("n", "m") for i, s in ((1, one), (2, two))],
        F.sum((F.col("n") - 1) * F.col("v")).alias("sse"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum("n").alias("nb"),
    )
    w = F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))
    d = F.col("m1") - F.col("m2")
    t = strata.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("levels_b"), count_if(F.col("n1").isNotNull() & F.col("n2").isNotNull()).alias("full"), F.sum("nb").alias("n"),
        F.sum("sse").alias("ss_error"), F.sum(w * d).alias("_wd"), F.sum(w).alias("_w"), F.sum("q").alias("_q"), F.sum("s").alias("_s"),
        F.sum(F.col("s") * F.col("s") / F.col("nb")).alias("_sb"), F.sum("n1").alias("_n1"), F.sum("n2").alias("_n2"),
        F.sum(F.col("n1") * F.col("m1")).alias("_s1"), F.sum(F.col("n2") * F.col("m2")).alias("_s2"),
    )
    grand = F.col("_s") * F.col("_s") / F.col("n")
    ss_b, ss_a = F.col("_sb") - grand, F.col("_s1") * F.col("_s1") / F.col("_n1") + F.col("_s2") * F.col("_s2") / F.col("_n2") - grand
    a_b = F.col("_wd") * F.col("_wd") / F.col("_w")
    inter = (F.col("_q") - grand) - ss_b - a_b
    df_e = F.col("n") - 2 * F.col("levels_b")
    ok = (F.col("full") == F.col("levels_b")) & (df_e > 0) & (F.col("levels_b") >= 2)
    mse = div("ss_error", df_e)
    return t.select(
        *keys, F.when(ok, a_b).alias("ss_a"), F.when(ok, ss_b + a_b - ss_a).alias("ss_b"), F.when(ok, inter).alias("ss_ab"), F.when(ok, F.col("ss_error")).alias("ss_error"),
        F.when(ok, div(a_b, mse)).alias("f_a"), F.when(ok, div((ss_b + a_b - ss_a) / (F.col("levels_b") - 1), mse)).alias("f_b"),
        F.when(ok, div(inter / (F.col("levels_b") - 1), mse)).alias("f_ab"), F.when(ok, df_e).alias("df_error"),
    )


def moderated_t(rows: DataFrame, a: str, b: str, keys=("feature",)) -> DataFrame:
    """Pooled variances shrunk to a common prior (moments of the log variances), moderated t with d0 + df degrees, its p and signed normal z."""
    t = student(rows, a, b, keys)
    se2 = div(F.pow(div(F.col("mean_a") - F.col("mean_b"), "t"), F.lit(2)), div(F.lit(1.0), "n_a") + div(F.lit(1.0), "n_b"))
    t = cut_lineage(t.withColumn("s2", se2).withColumn("df", F.col("df").cast("double")))
    digammas = {r.df: dist.digamma(r.df / 2) for r in t.select("df").distinct().collect() if r.df and r.df > 0}  # sample counts of a design
    trigammas = {d: dist.polygamma_series(d / 2, 1) for d in digammas}
    lookup = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("df")] if m else F.lit(None).cast("double")
    e = F.when(F.col("s2") > 0, F.log("s2") - lookup(digammas) + F.log(F.col("df") / 2))
    got = t.select(e.alias("e"), lookup(trigammas).alias("tri")).filter("e is not null").agg(F.avg("e").alias("m"), F.var_samp("e").alias("v"), F.avg("tri").alias("tri")).first()
    if got.v is None or got.v <= got.tri:
        d0, s02 = float("inf"), None if got.m is None else math.exp(got.m)
    else:
        d0 = 2 * dist.trigamma_inverse(got.v - got.tri)
        s02 = math.exp(got.m + dist.digamma(d0 / 2) - math.log(d0 / 2))
    if s02 is None:
        post, df_all = F.col("s2"), F.col("df")
    elif d0 == float("inf"):
        post, df_all = F.lit(s02), F.lit(float("inf"))
    else:
        post, df_all = (F.lit(d0 * s02) + F.col("df") * F.col("s2")) / (F.lit(d0) + F.col("df")), F.col("df") + d0
    se = F.sqrt(post * (div(F.lit(1.0), "n_a") + div(F.lit(1.0), "n_b")))
    t = t.withColumn("s2_post", post).withColumn("df_total", df_all).withColumn("t_mod", div(F.col("mean_a") - F.col("mean_b"), se)).drop("t")
    normal = F.col("df_total") == float("inf")
    p = F.when(normal, dist.norm_sf("t_mod")).otherwise(dist.t_sf("t_mod", F.when(~normal, F.col("df_total")).otherwise(1.0)))
    t = t.withColumn("p_mod", p)
    return t.withColumn("z_mod", -F.signum("t_mod") * dist.norm_ppf(F.greatest(F.col("p_mod") / 2, F.lit(1e-300))))


def cramers_v(meta: DataFrame, x: str, y: str) -> DataFrame:
    """One row: chi-square of the contingency table and Cramer's V."""
    c = meta.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    rx, ry = c.groupBy("x").agg(F.sum("c").alias("rx")), c.groupBy("y").agg(F.sum("c").alias("ry"))
    n = c.agg(F.sum("c").alias("n"))
    t = attach_scalars(c.join(rx, "x").join(ry, "y"), n)
    # cells without rows add their expected count: the sum of c^2 / (rx ry) covers them
    s = t.agg(F.sum(F.col("c") * F.col("c") / (F.col("rx") * F.col("ry"))).alias("s"), F.max("n").alias("n"), F.count_distinct("x").alias("kx"), F.count_distinct("y").alias("ky"))
    chi2 = F.col("n") * (F.col("s") - 1)
    return s.select(chi2.alias("chi2"), F.sqrt(div(chi2, F.col("n") * (F.least("kx", "ky") - 1))).alias("v"), "kx", "ky")


def design_tiers(layers: DataFrame) -> DataFrame:
    """(sample, layer) -> per sample the number of layers it is in and its tier: all, some or one."""
    total = layers.agg(F.count_distinct("layer").alias("_all"))
    t = attach_scalars(layers.groupBy("sample").agg(F.count_distinct("layer").alias("n_layers")), total)
    return t.select("sample", "n_layers", F.when(F.col("n_layers") == F.col("_all"), "all").when(F.col("n_layers") > 1, "some").otherwise("one").alias("tier"))


def design_warnings(design: DataFrame, least: int = 3) -> DataFrame:
    """(grp, hours, n, warning) of the cells of a time-course design; times per group below ``least`` are named too."""
    c = design.groupBy("grp", "hours").agg(F.count(F.lit(1)).alias("n"))
    times = design.groupBy("grp").agg(F.count_distinct("hours").alias("n_times"))
    warn = F.when(F.col("hours").isNull(), "missing_time").when(F.col("n") < least, "few_replicates").when(F.col("n_times") < least, "few_times").otherwise("")
    return join_same(c, times, ["grp"]).select("grp", "hours", "n", "n_times", warn.alias("warning"))
