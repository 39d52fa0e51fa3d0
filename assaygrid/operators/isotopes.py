"""Isotope tracing on long tables (compound, i, sample, area, n): fractions, labelling, time courses.

i counts labelled atoms (0 to n); a design row gives a sample's type, group, hours and whether it is included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.operators.base import attach_scalars, div, join_same, quantiles


def analysed(design: DataFrame) -> DataFrame:
    """Labelled and included samples."""
    return design.filter("sample_type = 'labelled' and coalesce(include, true)")


def with_conditions(design: DataFrame) -> DataFrame:
    """Derived columns: arm, condition and the replicate's number inside (group, treatment, hours)."""
    arm = F.concat_ws(" ", "grp", F.col("treatment"))
    n = F.row_number().over(Window.partitionBy("grp", "treatment", "hours").orderBy("sample"))
    return design.withColumn("arm", arm).withColumn("condition", F.concat(arm, F.lit(" "), F.col("hours"), F.lit("h"))).withColumn("replicate", n)


def zero_rule(iso: DataFrame, samples: DataFrame, min_area: float = 0.0, keep_partial: bool = False) -> DataFrame:
    """A labelled sample whose M+0 is zero (or below ``min_area``) removes the compound, another channel that is low removes
    that channel; NULL does not count.  ``keep_partial``: only what is low in all samples goes."""
    v = F.col("area")
    low = (v == 0) | (v < min_area)
    rows = iso.filter(v.isNotNull()).join(samples.select("sample"), "sample", "left_semi").groupBy("compound", "i").agg((F.bool_and(low) if keep_partial else F.bool_or(low)).alias("low"))
    bad = rows.filter("low")
    gone = bad.filter("i = 0").select("compound")
    return iso.join(gone, "compound", "left_anti").join(bad.filter("i > 0").select("compound", "i"), ["compound", "i"], "left_anti")


def drop_unlabelled_only(iso: DataFrame) -> DataFrame:
    """Compounds whose only channel is M+0 go."""
    keep = iso.groupBy("compound").agg(F.max("i").alias("m")).filter("m > 0").select("compound")
    return iso.join(keep, "compound", "left_semi")


def fractions(iso: DataFrame) -> DataFrame:
    """area / sum of areas of (compound, sample); NULL and negative areas count as zero.  Channels of a pair are few."""
    a = F.greatest(F.coalesce("area", F.lit(0.0)), F.lit(0.0))
    w = Window.partitionBy("compound", "sample")
    return iso.withColumn("_a", a).withColumn("fraction", div("_a", F.sum("_a").over(w))).drop("_a")


def labelling(iso: DataFrame) -> DataFrame:
    """Per (compound, sample): incorporation %, mean labels, enrichment % and the sum of the fractions."""
    t = fractions(iso).groupBy("compound", "sample").agg(
        F.max("n").alias("n"), (100 * (1 - F.max(F.when(F.col("i") == 0, F.col("fraction"))))).alias("incorporation"),
        F.sum(F.col("i") * F.col("fraction")).alias("mean_labels"), F.sum("fraction").alias("total"),
    )
    return t.withColumn("enrichment", div(F.col("mean_labels") * 100, "n"))


def interference(summary: DataFrame, design: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Compounds with more than ``threshold`` % incorporation in an unlabelled reference."""
    ref = design.filter("sample_type = 'reference'").select("sample")
    return summary.join(ref, "sample", "left_semi").groupBy("compound").agg(F.max("incorporation").alias("highest")).filter(F.col("highest") > threshold)


def labelled_compounds(summary: DataFrame, design: DataFrame, least: float = 2.0) -> DataFrame:
    """Compounds with a mean incorporation of at least ``least`` % in some condition."""
    t = summary.join(with_conditions(analysed(design)).select("sample", "condition"), "sample")
    return t.groupBy("compound", "condition").agg(F.avg("incorporation").alias("m")).groupBy("compound").agg(F.max("m").alias("highest")).filter(F.col("highest") >= least)


def incorporation_table(iso: DataFrame, design: DataFrame) -> DataFrame:
    """Long table (compound, measure, condition, n, mean, sd) of the fractions and the three summary measures."""
    f = fractions(iso).select("compound", "sample", F.concat(F.lit("M+"), "i").alias("measure"), F.col("fraction").alias("value"))
    s = labelling(iso)
    for m in ("incorporation", "mean_labels", "enrichment"):
        f = f.unionByName(s.select("compound", "sample", F.lit(m).alias("measure"), F.col(m).alias("value")))
    t = f.join(with_conditions(analysed(design)).select("sample", "condition"), "sample")
    return t.groupBy("compound", "measure", "condition").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def time_summary(rows: DataFrame, keys=("compound", "grp")) -> DataFrame:
    """n, mean, sd and standard error per key and time."""
    t = rows.groupBy(*keys, "hours").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return t.withColumn("sem", div("sd", F.sqrt("n")))


def slopes(summary: DataFrame, keys=("compound", "grp"), from_zero: bool = False) -> DataFrame:
    """Slope between consecutive times with its standard error; times of a curve are few."""
    t = summary.select(*keys, "hours", "mean", "sem")
    if from_zero:
        start = t.select(*keys).distinct().select(*keys, F.lit(0.0).alias("hours"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sem"))
        t = t.filter("hours > 0").unionByName(start)
    w = Window.partitionBy(*keys).orderBy("hours")
    before = {c: F.lag(c).over(w) for c in ("hours", "mean", "sem")}
    t = t.withColumns({f"_{c}": v for c, v in before.items()}).filter("_hours is not null")
    dt = F.col("hours") - F.col("_hours")
    se = F.sqrt(F.col("sem") * F.col("sem") + F.col("_sem") * F.col("_sem"))
    return t.select(*keys, F.col("_hours").alias("from_hours"), F.col("hours").alias("to_hours"), div(F.col("mean") - F.col("_mean"), dt).alias("slope"), div(se, dt).alias("se"))


def monotone(summary: DataFrame, keys=("compound", "grp"), share: float = 0.05, floor: float = 0.5) -> DataFrame:
    """Whether no step falls by more than max(share of the earlier mean, floor)."""
    w = Window.partitionBy(*keys).orderBy("hours")
    drop = F.lag("mean").over(w) - F.col("mean") > F.greatest(F.lag("mean").over(w) * share, F.lit(floor))
    return summary.withColumn("_d", F.coalesce(drop, F.lit(False))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_times"), (~F.bool_or("_d")).alias("monotone"))


def rate_grid(low: float = 1e-3, high: float = 50.0, steps: int = 400) -> Column:
    """Array of rates, evenly spaced on the log scale."""
    ratio = (high / low) ** (1 / (steps - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda j: F.lit(low) * F.pow(F.lit(ratio), j.cast("double")))


def first_order_fit(rows: DataFrame, keys=("compound", "grp"), top: float = 100.0, least_times: int = 3) -> DataFrame:
    """E(t) = E∞ (1 - exp(-k t)) per curve: for each k of a fixed grid E∞ is a clipped least-squares ratio; the k that fits best wins.

    Curves with fewer than ``least_times`` times have no row.  The points of a curve are summed per time first, so the
    grid multiplies times, not samples.
    """
    at = rows.filter("value is not null and hours > 0").groupBy(*keys, "hours").agg(
        F.count(F.lit(1)).cast("double").alias("c"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")
    )
    curve = at.withColumn("k", F.explode(rate_grid())).withColumn("b", 1 - F.exp(-F.col("k") * F.col("hours")))
    fit = curve.groupBy(*keys, "k").agg(
        F.count(F.lit(1)).alias("n_times"), F.sum("c").alias("n"), F.sum(F.col("s") * F.col("b")).alias("yb"), F.sum(F.col("c") * F.col("b") * F.col("b")).alias("bb"),
        F.sum("q").alias("yy"), F.sum("s").alias("y"),
    )
    e = F.least(F.lit(top), F.greatest(F.lit(0.0), div("yb", "bb")))
    fit = fit.filter(F.col("n_times") >= least_times).withColumn("e_inf", e).withColumn("rss", F.col("yy") - 2 * F.col("e_inf") * F.col("yb") + F.col("e_inf") * F.col("e_inf") * F.col("bb"))
    # where the curve is flat in k the slowest rate that fits as well is taken: equal to one part in 1e6
    least = fit.groupBy(*keys).agg(F.min("rss").alias("_least"))
    good = join_same(fit, least, keys).filter(F.col("rss") <= F.col("_least") * (1 + 1e-6) + 1e-12)
    best = good.groupBy(*keys).agg(F.min(F.struct("k", "rss", "e_inf", "n_times", "n", "yy", "y")).alias("x"))
    tss = F.col("x.yy") - F.col("x.y") * F.col("x.y") / F.col("x.n")
    return best.select(
        *keys, "x.n_times", F.col("x.n").cast("bigint").alias("n"), "x.k", "x.e_inf", (F.log(F.lit(2.0)) / F.col("x.k")).alias("t_half"), "x.rss", (1 - div("x.rss", tss)).alias("r2")
    )


def speed_ranking(fits: DataFrame, least_r2: float = 0.0) -> DataFrame:
    """Fits good enough, ranked by half-life inside each group (compounds of a study: few)."""
    w = Window.partitionBy("grp").orderBy("t_half", "compound")
    return fits.filter(F.col("r2") >= least_r2).withColumn("place", F.row_number().over(w))


def channel_race(iso: DataFrame, samples: DataFrame, least: float = 2.0) -> DataFrame:
    """Per (compound, channel): highest mean percent over times, only channels that reach ``least`` %."""
    f = fractions(iso).join(samples.select("sample", "hours"), "sample").groupBy("compound", "i", "hours").agg((F.avg("fraction") * 100).alias("pct"))
    t = f.groupBy("compound", "i").agg(F.max("pct").alias("peak"), F.min_by("hours", F.struct(-F.col("pct"), F.col("hours"))).alias("peak_hours"))
    return t.filter(F.col("peak") >= least)


def reference_m1(iso: DataFrame, design: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: compounds compared, median ratio of M+1 / M+0 in references to the expected, and the correction status."""
    ref = design.filter("sample_type = 'reference'").select("sample")
    m = iso.join(ref, "sample", "left_semi").groupBy("compound", "sample").agg(
        F.max(F.when(F.col("i") == 0, F.col("area"))).alias("m0"), F.max(F.when(F.col("i") == 1, F.col("area"))).alias("m1")
    )
    r = m.withColumn("obs", div("m1", "m0")).groupBy("compound").agg(F.avg("obs").alias("obs"))
    r = r.join(expected, "compound").withColumn("ratio", div("obs", "expected")).filter("ratio is not null")
    n = r.agg(F.count(F.lit(1)).alias("n_compounds"))
    t = attach_scalars(n, quantiles(r, [], "ratio", [0.5], ["median_ratio"]))
    status = F.when(F.col("n_compounds") < 5, "unclear").when(F.col("median_ratio") < 0.35, "corrected").when(F.col("median_ratio") > 0.7, "uncorrected").otherwise("unclear")
    return t.withColumn("status", status)


def natural_correction(iso: DataFrame, rate: float = 0.0107) -> DataFrame:
    """(compound, sample, i, fraction) freed from natural 13C: forward substitution through the binomial correction matrix of
    n atoms, negative values to zero, then divided by their sum.  The channels 0 … n of a pair come together, n is small."""
    m = iso.groupBy("compound", "sample", "n").agg(F.map_from_entries(F.collect_list(F.struct("i", F.greatest(F.coalesce("area", F.lit(0.0)), F.lit(0.0))))).alias("_m"))
    n = F.col("n").cast("int")
    at = F.transform(F.sequence(F.lit(0), n), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    # chance that k of the n - j unlabelled atoms are heavy: the binomial coefficient by its product
    choose = lambda a, k: F.aggregate(F.sequence(F.lit(0), k), F.lit(1.0), lambda s, q: F.when(q == 0, s).otherwise(s * (a - k + q) / q))
    heavy = lambda a, k: choose(a, k) * F.pow(F.lit(rate), k.cast("double")) * F.pow(F.lit(1 - rate), (a - k).cast("double"))

    def step(done, i):
        known = F.aggregate(
            F.transform(done, lambda x, j: x * heavy(n - j, i - j)), F.lit(0.0), lambda s, v: s + v
        )
        return F.concat(done, F.array((F.get("_a", i) - known) / F.pow(F.lit(1 - rate), (n - i).cast("double"))))

    m = m.withColumn("_a", at)
    m = m.withColumn("_x", F.aggregate(F.sequence(F.lit(0), n), F.array().cast("array<double>"), step))
    m = m.withColumn("_x", F.transform("_x", lambda v: F.greatest(v, F.lit(0.0))))
    whole = F.aggregate("_x", F.lit(0.0), lambda s, v: s + v)
    return m.select("compound", "sample", F.posexplode(F.transform("_x", lambda v: div(v, whole))).alias("i", "fraction"))
