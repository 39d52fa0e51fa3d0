"""Cleaning of long matrices (feature, sample, value): missing values, log scale, imputation, quality tables.

An absent (feature, sample) row is a missing value; so is NULL.  Counting needs no dense grid: what is missing is the
number of samples less the number of values.  Only imputation writes the absent cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.operators.base import attach_scalars, count_if, div, join_same, number, quantiles

SAMPLES_A_BUCKET = 1000
BANDS = ((20, "good"), (50, "fair"), (70, "poor"))


def split_qc(matrix: DataFrame, meta: DataFrame, qc: bool) -> DataFrame:
    """Rows of quality-control samples, or of the others (NULL flags count as biological)."""
    flag = F.coalesce(F.col("is_qc"), F.lit(False))
    return matrix.join(meta.filter(flag if qc else ~flag).select("sample"), "sample", "left_semi")


def strict_log2(matrix: DataFrame, strict: bool = False) -> DataFrame:
    """log2 of positive values, NULL otherwise; ``strict`` raises on a value <= 0."""
    v = F.col("value")
    bad = F.raise_error("log2 of a value that is not positive").cast("double") if strict else F.lit(None).cast("double")
    return matrix.withColumn("value", F.when(v > 0, F.log2(v)).when(v.isNotNull(), bad))


def auto_log2(matrix: DataFrame) -> DataFrame:
    """log2 only where the data look linear: the largest value is 100 or more."""
    top = matrix.agg(F.max("value").alias("_top"))
    v = F.col("value")
    return attach_scalars(matrix, top).withColumn("value", F.when(F.col("_top") < 100, v).when(v > 0, F.log2(v))).drop("_top")


def shift_log2(matrix: DataFrame) -> DataFrame:
    """log2 after a shift that makes all values positive: |min| + max(1 % of |min|, 1e-3) when min <= 0."""
    low = matrix.agg(F.min("value").alias("_low"))
    shift = F.when(F.col("_low") <= 0, F.abs("_low") + F.greatest(F.abs("_low") * 0.01, F.lit(1e-3))).otherwise(0.0)
    return attach_scalars(matrix, low).withColumn("value", F.log2(F.col("value") + shift)).drop("_low")


def missingness(matrix: DataFrame, samples: DataFrame) -> DataFrame:
    """Per feature: samples, missing (absent, NULL or zero), percent and quality band."""
    have = matrix.join(samples.select("sample"), "sample", "left_semi").groupBy("feature").agg(count_if(F.col("value") != 0).alias("n_have"))
    # features that occur in none of these samples are missing everywhere
    have = matrix.select("feature").distinct().join(have, "feature", "left")
    t = attach_scalars(have, samples.agg(F.count(F.lit(1)).alias("n_samples")))
    t = t.select("feature", "n_samples", (F.col("n_samples") - F.coalesce("n_have", F.lit(0))).alias("n_missing"))
    pct = div(F.col("n_missing") * 100.0, "n_samples")
    band = F.lit("bad")
    for limit, name in reversed(BANDS):
        band = F.when(F.col("pct_missing") < limit, name).otherwise(band)
    return t.withColumn("pct_missing", pct).withColumn("quality", band)


def filter_missing(matrix: DataFrame, table: DataFrame, max_pct: float = 30.0) -> DataFrame:
    return matrix.join(table.filter(F.col("pct_missing") <= max_pct).select("feature"), "feature", "left_semi")


def filter_missing_by_group(matrix: DataFrame, meta: DataFrame, max_share: float = 0.5, need: str = "any") -> DataFrame:
    """Features whose share of missing values is at most ``max_share`` in any group, or in all of them."""
    sizes = meta.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    have = matrix.join(meta.select("sample", "grp"), "sample").groupBy("feature", "grp").agg(F.count("value").alias("have"))
    ok = have.join(sizes, "grp").withColumn("ok", 1 - F.col("have") / F.col("n") <= max_share)
    per = ok.groupBy("feature").agg(F.bool_or("ok").alias("any"), count_if(F.col("ok")).alias("n_ok"))
    if need == "any":
        keep = per.filter("any")
    else:  # a group without any value of the feature has no row above
        keep = attach_scalars(per, sizes.agg(F.count(F.lit(1)).alias("_g"))).filter(F.col("n_ok") == F.col("_g"))
    return matrix.join(keep.select("feature"), "feature", "left_semi")


def drop_constant(matrix: DataFrame, meta: DataFrame | None = None, tiny: float = 1e-9) -> DataFrame:
    """Drops features with sd <= tiny over all samples, or inside any group when ``meta`` is given; one value has no sd."""
    if meta is None:
        sd = matrix.groupBy("feature").agg(F.stddev_samp("value").alias("sd"))
        keep = sd.filter(F.col("sd") > tiny)
    else:
        sd = matrix.join(meta.select("sample", "grp"), "sample").groupBy("feature", "grp").agg(F.stddev_samp("value").alias("sd"))
        keep = sd.groupBy("feature").agg(F.min(F.coalesce(F.col("sd"), F.lit(0.0))).alias("sd")).filter(F.col("sd") > tiny)
    return matrix.join(keep.select("feature"), "feature", "left_semi")


def absent_cells(matrix: DataFrame, samples: DataFrame) -> DataFrame:
    """(feature, sample) without a row: every feature meets the samples bucket by bucket, less the cells there are."""
    s = samples.select("sample").distinct()
    buckets = max(1, -(-s.count() // SAMPLES_A_BUCKET))
    s = s.withColumn("_b", F.pmod(F.xxhash64("sample"), F.lit(buckets)).cast("int"))
    f = matrix.select("feature").distinct().withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    gaps = f.join(s, "_b").select("feature", "sample").join(matrix.select("feature", "sample"), ["feature", "sample"], "left_anti")
    return gaps.withColumn("value", F.lit(None).cast("double"))


def impute(matrix: DataFrame, samples: DataFrame, how: str = "half_min", fraction: float = 0.5) -> DataFrame:
    """Dense matrix; missing cells get the feature's half minimum, mean, median, log-scale minimum - 1, or a fraction of
    the whole matrix's minimum (``global_min``).  Features without any value stay NULL."""
    fills = {
        "half_min": lambda: F.min("value") * fraction,
        "mean": lambda: F.avg("value"),
        "log_min": lambda: F.min("value") - 1,
    }
    dense = matrix.select("feature", "sample", F.col("value").cast("double").alias("value")).unionByName(absent_cells(matrix, samples))
    if how == "global_min":
        full = attach_scalars(dense, matrix.agg((F.min("value") * fraction).alias("_fill")))
    else:
        fill = quantiles(matrix, ["feature"], "value", [0.5], ["_fill"]) if how == "median" else matrix.groupBy("feature").agg(fills[how]().alias("_fill"))
        full = dense.join(fill, "feature", "left")
    return full.select("feature", "sample", F.coalesce("value", "_fill").alias("value"), F.col("value").isNull().alias("imputed"))


def zscores(matrix: DataFrame, axis: str = "feature", clip: float = 3.0) -> DataFrame:
    """(value - mean) / sd over each feature or sample, clipped; sd 0 gives NULL."""
    m = matrix.groupBy(axis).agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    z = div(F.col("value") - F.col("_m"), "_s")
    return matrix.join(m, axis).withColumn("z", F.when(z.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))).drop("_m", "_s")


def divide_by_factor(matrix: DataFrame, factors: DataFrame) -> DataFrame:
    """value / factor of the sample; a missing factor is 1, a zero one gives NULL."""
    return matrix.join(factors.select("sample", "factor"), "sample", "left").withColumn("value", div("value", F.coalesce("factor", F.lit(1.0)))).drop("factor")


def cv_table(matrix: DataFrame, limit: float = 20.0) -> DataFrame:
    m = matrix.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return m.withColumn("cv", div(F.col("sd") * 100, "mean")).withColumn("acceptable", F.coalesce(F.col("cv") <= limit, F.lit(False)))


def filter_cv(matrix: DataFrame, cv: DataFrame, standards: DataFrame, limit: float = 20.0) -> DataFrame:
    """Features with an acceptable CV; internal standards always stay."""
    keep = cv.filter(F.col("cv") <= limit).select("feature").union(standards.select("feature")).distinct()
    return matrix.join(keep, "feature", "left_semi")


def cv_summary(cv: DataFrame, keys=("dataset",)) -> DataFrame:
    """Per dataset: features, acceptable ones in percent, median CV."""
    n = cv.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_features"), (F.avg(F.col("acceptable").cast("double")) * 100).alias("pct_acceptable"))
    return join_same(n, quantiles(cv, keys, "cv", [0.5], ["median_cv"]), keys, "left")


def histogram(matrix: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, n): equal widths between the smallest and the largest value; the last bin holds the largest."""
    v = matrix.select(number(column).alias("v")).filter("v is not null")
    lo_hi = v.agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    at = F.coalesce(F.floor(div((F.col("v") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(0))
    return attach_scalars(v, lo_hi).groupBy(F.least(at, F.lit(bins - 1)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sample_boxes(matrix: DataFrame) -> DataFrame:
    """Five-number summary of each sample."""
    return quantiles(matrix, ["sample"], "value", [0, 0.25, 0.5, 0.75, 1], ["low", "q1", "median", "q3", "high"])


def union_datasets(parts: dict[str, DataFrame]) -> DataFrame:
    """One matrix with features named ``label::feature``; columns a part lacks are NULL."""
    out = None
    for label, part in parts.items():
        named = part.withColumn("feature", F.concat_ws("::", F.lit(label), "feature")).withColumn("dataset", F.lit(label))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def display_names(names: DataFrame) -> DataFrame:
    """(pos, feature) -> display name: the dataset prefix goes, repeats get `` (2)``, `` (3)`` in order of position."""
    bare = names.withColumn("bare", F.regexp_replace("feature", "^.*?::", ""))
    n = F.row_number().over(Window.partitionBy("bare").orderBy("pos"))
    return bare.withColumn("_n", n).select("pos", "feature", F.when(F.col("_n") == 1, F.col("bare")).otherwise(F.concat("bare", F.lit(" ("), "_n", F.lit(")"))).alias("display"))


def low_variance(matrix: DataFrame, percentile: float) -> DataFrame:
    """Features whose variance is at or above this percentile of all variances."""
    var = matrix.groupBy("feature").agg(F.var_samp("value").alias("var")).filter("var is not null")
    cut = quantiles(var, [], "var", [percentile / 100], ["cut"])
    return attach_scalars(var, cut).filter(F.col("var") >= F.col("cut"))


def top_variance(matrix: DataFrame, k: int) -> DataFrame:
    """The k features of largest variance (then by name)."""
    var = matrix.groupBy("feature").agg(F.var_samp("value").alias("var")).filter("var is not null")
    return var.orderBy(F.desc("var"), "feature").limit(k)


