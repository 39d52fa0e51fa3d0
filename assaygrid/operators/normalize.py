"""Normalisation of long matrices (feature, sample, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaygrid.operators.base import attach_scalars, div, join_same, quantiles
from assaygrid.session import cut_lineage


def median_iqr(matrix: DataFrame, keys=("sample",), source: DataFrame | None = None, avoid_null: bool = False) -> DataFrame:
    """(value - median) / IQR per key; the statistics may come from a wider table.  IQR 0 gives NULL, or counts as 1."""
    s = quantiles(matrix if source is None else source, keys, "value", [0.25, 0.5, 0.75], ["_q1", "_q2", "_q3"])
    iqr = F.col("_q3") - F.col("_q1")
    if avoid_null:
        iqr = F.when(iqr == 0, 1.0).otherwise(iqr)
    return join_same(matrix, s, keys).withColumn("value", div(F.col("value") - F.col("_q2"), iqr)).drop("_q1", "_q2", "_q3")


def robust_iqr(matrix: DataFrame) -> DataFrame:
    """(value - median) / IQR * median of IQRs + median of medians, per sample, in log2 units."""
    s = quantiles(matrix, ["sample"], "value", [0.25, 0.5, 0.75], ["_q1", "_q2", "_q3"]).withColumn("_iqr", F.col("_q3") - F.col("_q1"))
    s = cut_lineage(s)
    goal = s.agg(F.percentile("_iqr", F.lit(0.5)).alias("_gi"), F.percentile("_q2", F.lit(0.5)).alias("_gm"))
    s = attach_scalars(s, goal)
    z = div(F.col("value") - F.col("_q2"), "_iqr") * F.col("_gi") + F.col("_gm")
    return matrix.join(s, "sample").withColumn("value", z).select(*matrix.columns)


def median_centre(matrix: DataFrame, restore: bool = False) -> DataFrame:
    """value - median of the sample (+ the median of the medians)."""
    s = quantiles(matrix, ["sample"], "value", [0.5], ["_med"])
    if restore:
        s = cut_lineage(s)
        s = attach_scalars(s, s.agg(F.percentile("_med", F.lit(0.5)).alias("_grand")))
    else:
        s = s.withColumn("_grand", F.lit(0.0))
    return matrix.join(s, "sample").withColumn("value", F.col("value") - F.col("_med") + F.col("_grand")).select(*matrix.columns)


def mad_scale(matrix: DataFrame) -> DataFrame:
    """value / (1.4826 * MAD of all values); MAD 0 counts as 1."""
    med = quantiles(matrix, [], "value", [0.5], ["_med"])
    off = attach_scalars(matrix, med).withColumn("_off", F.abs(F.col("value") - F.col("_med")))
    mad = quantiles(off, [], "_off", [0.5], ["_mad"])
    scale = F.when(F.col("_mad") == 0, 1.0).otherwise(F.col("_mad") * 1.4826)
    return attach_scalars(matrix, mad).withColumn("value", F.col("value") / scale).drop("_mad")


def reference_ratio(matrix: DataFrame, meta: DataFrame, reference: Column) -> DataFrame:
    """value / mean of the reference samples of the same batch; zero or absent references give NULL."""
    m = matrix.join(meta.select("sample", "batch", reference.alias("_ref")), "sample")
    ref = m.filter("_ref").groupBy("feature", "batch").agg(F.avg("value").alias("_mean"))
    return join_same(m.filter(~F.col("_ref")), ref, ["feature", "batch"], "left").select("feature", "sample", "batch", div("value", "_mean").alias("value"))


def find_standards(features: DataFrame, pattern: str) -> DataFrame:
    """Features whose name marks an internal standard."""
    return features.filter(F.col("feature").rlike(pattern)).select("feature").distinct()


def map_standards(features: DataFrame, standards: DataFrame, by: str = "cls") -> DataFrame:
    """(feature, standard): the first standard (by name) of the feature's class, else the first of all."""
    own = standards.groupBy(by).agg(F.min("feature").alias("_own"))
    any_ = standards.agg(F.min("feature").alias("_any"))
    mapped = join_same(features, own, [by], "left")
    return attach_scalars(mapped, any_).select("feature", by, F.coalesce("_own", "_any").alias("standard"))


def standard_ratio(matrix: DataFrame, mapping: DataFrame, log2: bool = True) -> DataFrame:
    """value / value of the feature's standard in the same sample (zero or absent: NULL), as log2."""
    std = matrix.select(F.col("feature").alias("standard"), "sample", F.col("value").alias("_std"))
    m = matrix.join(mapping.select("feature", "standard"), "feature").join(std, ["standard", "sample"], "left")
    ratio = F.when(F.col("_std") > 0, F.col("value") / F.col("_std"))
    return m.select("feature", "sample", "standard", (F.when(ratio > 0, F.log2(ratio)) if log2 else ratio).alias("value"))


def standard_summary(matrix: DataFrame, standards: DataFrame) -> DataFrame:
    """Per standard: samples with a positive value, mean, CV."""
    m = matrix.join(standards.select("feature"), "feature", "left_semi").filter("value > 0")
    t = m.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return t.withColumn("cv", div(F.col("sd") * 100, "mean"))


def library_size(counts: DataFrame) -> DataFrame:
    t = counts.groupBy("sample").agg(F.sum("value").alias("total"), F.count(F.when(F.col("value") > 0, 1)).alias("detected"))
    t = cut_lineage(t)
    med = quantiles(t, [], "total", [0.5], ["_med"])
    return attach_scalars(t, med).withColumn("pct_of_median", div(F.col("total") * 100.0, "_med")).drop("_med")


def cpm(counts: DataFrame, log2: bool = False) -> DataFrame:
    """Counts per million of the sample's total; log2 with a pseudocount of 1."""
    total = counts.groupBy("sample").agg(F.sum("value").alias("_total"))
    v = div(F.col("value") * 1e6, "_total")
    return counts.join(total, "sample").withColumn("value", F.log2(v + 1) if log2 else v).drop("_total")


def size_factors(counts: DataFrame) -> DataFrame:
    """Median of ratios: exp(median over genes of log count - mean log count); genes with an absent or zero count are left out."""
    n = counts.select("sample").distinct().agg(F.count(F.lit(1)).alias("_n"))
    logs = counts.filter("value > 0").withColumn("_l", F.log("value"))
    genes = attach_scalars(logs.groupBy("feature").agg(F.avg("_l").alias("_m"), F.count(F.lit(1)).alias("_c")), n).filter("_c = _n").select("feature", "_m")
    ratio = logs.join(genes, "feature").select("sample", (F.col("_l") - F.col("_m")).alias("_r"))
    return quantiles(ratio, ["sample"], "_r", [0.5], ["_med"]).select("sample", F.exp("_med").alias("factor"))


def low_expression(counts: DataFrame, min_cpm: float = 1.0, min_fraction: float = 0.2) -> DataFrame:
    """Per gene: mean CPM over all samples, samples at or above ``min_cpm``, and whether they are enough."""
    n = counts.select("sample").distinct().agg(F.count(F.lit(1)).alias("_n"))
    t = cpm(counts).groupBy("feature").agg(F.sum("value").alias("_s"), F.count(F.when(F.col("value") >= min_cpm, 1)).alias("n_detected"))
    t = attach_scalars(t, n)
    return t.select("feature", (F.col("_s") / F.col("_n")).alias("mean_cpm"), "n_detected", (F.col("n_detected") >= F.ceil(F.col("_n") * min_fraction)).alias("kept"))

