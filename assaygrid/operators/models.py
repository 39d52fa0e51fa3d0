"""Models over samples: linear model with covariates, outlier samples, censored imputation, marker panels, default pipeline."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.functions import dist
from assaygrid.operators import clean, comparisons, normalize
from assaygrid.operators.base import attach_scalars, div, quantiles, top_k


def linear_model(matrix: DataFrame, design: DataFrame, factor: str, covariates: list[str]) -> DataFrame:
    """beta of ``factor`` (0/1 or numeric) with covariates per feature that all samples have; Wald z with the residual variance.

    The sums of products of the design's terms are one aggregate; only that matrix (terms by terms) comes to the driver.
    """
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in (factor, *covariates)]]
    k = len(terms)
    rows = design.select("sample", F.array(*terms).alias("x"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.agg(F.count(F.lit(1)), F.count_if(F.exists("x", F.isnull)), *[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]).first()
    n = sums[0]
    if sums[1]:
        raise ValueError("the design has empty cells")
    square = np.zeros((k, k))
    for (i, j), v in zip(pairs, sums[2:]):
        square[i, j] = square[j, i] = v or 0.0
    inverse = np.linalg.pinv(square)
    weights = [sum((F.lit(float(a)) * F.col("x")[i] for i, a in enumerate(line)), F.lit(0.0)) for line in inverse]
    w = rows.select("sample", F.array(*weights).alias("w"), "x")
    m = matrix.join(w, "sample").filter("value is not null")
    beta = m.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("base_mean"), F.array(*[F.sum(F.col("value") * F.col("w")[j]) for j in range(k)]).alias("b"))
    beta = beta.filter(F.col("n") == n)
    fitted = F.aggregate(F.zip_with("x", "b", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rss = m.join(beta.select("feature", "b"), "feature").groupBy("feature").agg(F.sum(F.pow(F.col("value") - fitted, F.lit(2))).alias("rss"))
    t = beta.join(rss, "feature")
    se = F.sqrt(F.col("rss") / (n - k) * F.lit(float(inverse[1, 1])))
    t = t.select("feature", "n", "base_mean", F.col("b")[1].alias("beta"), se.alias("se")).withColumn("z", div("beta", "se"))
    return t.withColumn("p", dist.norm_sf("z"))


def outlier_samples(matrix: DataFrame) -> DataFrame:
    """Mean correlation of each sample with the others over a complete grid, without forming pairs: with z-scored samples it is
    (z · sum of all z / (F - 1) - 1) / (S - 1)."""
    m = matrix.groupBy("sample").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"), F.count("value").alias("_f"))
    z = matrix.join(m, "sample").withColumn("z", div(F.col("value") - F.col("_m"), "_s"))
    total = z.groupBy("feature").agg(F.sum("z").alias("_t"))
    s = m.agg(F.count(F.lit(1)).alias("_n"))
    t = z.join(total, "feature").groupBy("sample").agg(F.sum(F.col("z") * F.col("_t")).alias("_d"), F.max("_f").alias("_f"))
    return attach_scalars(t, s).select("sample", div(div("_d", F.col("_f") - 1) - 1, F.col("_n") - 1).alias("mean_r"))


def censored_draws(matrix: DataFrame, samples: DataFrame, shift: float = 1.6, scale: float = 0.4, seed: int = 1) -> DataFrame:
    """Missing cells drawn from normal(mean - shift sd, scale sd) cut off at the feature's lower quartile, at least 0; the uniform
    numbers are hashes of (feature, sample, seed).  Features with fewer than two values get half their minimum."""
    stats = matrix.groupBy("feature").agg(
        F.count("value").alias("_n"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"), F.min("value").alias("_lo")
    )
    stats = stats.join(quantiles(matrix, ["feature"], "value", [0.25], ["_q"]), "feature", "left")
    dense = matrix.select("feature", "sample", "value").unionByName(clean.absent_cells(matrix, samples)).join(stats, "feature")
    u = (F.pmod(F.xxhash64("feature", "sample", F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)
    mu, sd = F.col("_m") - shift * F.col("_s"), F.col("_s") * scale
    top = 1 - dist.norm_upper(div(F.col("_q") - mu, sd))
    drawn = F.greatest(F.lit(0.0), mu + sd * dist.norm_ppf(u * top))
    fill = F.when(F.col("_n") < 2, F.col("_lo") / 2).when(F.col("_s") == 0, F.col("_lo")).otherwise(drawn)
    return dense.select("feature", "sample", F.coalesce("value", fill).alias("value"), F.col("value").isNull().alias("imputed"))


def stable_panel(rows: DataFrame, folds: DataFrame, a: str, b: str, k: int = 10) -> DataFrame:
    """(feature, picked, frequency): how often a feature is among the k largest |Welch t| of a training fold; ``folds`` is (split, sample)."""
    train = rows.join(folds, "sample")
    t = comparisons.welch(train, a, b, ("split", "feature")).filter("t is not null")
    best = top_k(t, ("split",), (F.desc(F.abs("t")), F.col("feature")), k)
    n = folds.agg(F.count_distinct("split").alias("_f"))
    return attach_scalars(best.groupBy("feature").agg(F.count(F.lit(1)).alias("picked")), n).select("feature", "picked", (F.col("picked") / F.col("_f")).alias("frequency"))


def default_pipeline(matrix: DataFrame, samples: DataFrame, max_missing: float = 30.0) -> DataFrame:
    """Untargeted default: missingness filter, half-minimum imputation, log2, median-IQR per sample with statistics of the unfiltered table."""
    kept = clean.filter_missing(matrix, clean.missingness(matrix, samples), max_missing)
    full = clean.strict_log2(clean.impute(kept, samples).select("feature", "sample", "value"))
    return normalize.median_iqr(full, ("sample",), clean.strict_log2(matrix))


def pca(matrix: DataFrame, k: int = 2, most_features: int = 5000) -> tuple[DataFrame, DataFrame, list[float]]:
    """Scores (sample, pc, score), loadings (feature, pc, loading) and explained variance shares of centred samples.

    The grid must be complete; the features (columns of the covariance) come to the driver and raise above
    ``most_features``.  Each component's sign makes its largest loading positive.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    names = [r.feature for r in matrix.select("feature").distinct().orderBy("feature").limit(most_features + 1).collect()]
    if len(names) > most_features:
        raise ValueError(f"more than {most_features} features")
    rows = matrix.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("feature", F.col("value").cast("double").alias("value")))).alias("_c"))
    rows = rows.select("sample", F.transform("_c", lambda x: x["value"]).alias("_v"))
    rows = rows.select("sample", array_to_vector(F.when(F.size("_v") == len(names), F.col("_v")).otherwise(F.raise_error(F.lit("the grid is not complete")))).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="s").fit(rows)
    weights = model.pc.toArray()
    sign = np.sign(weights[np.abs(weights).argmax(axis=0), range(k)])
    mean = rows.select(F.posexplode(vector_to_array("v")).alias("j", "x")).groupBy("j").agg(F.avg("x").alias("m")).orderBy("j").collect()
    shift = np.array([r.m for r in mean]) @ weights
    signs, shifts = F.array(*[F.lit(float(x)) for x in sign]), F.array(*[F.lit(float(x)) for x in shift])
    scores = model.transform(rows).select("sample", F.posexplode(vector_to_array("s")).alias("j", "x"))
    scores = scores.select("sample", (F.col("j") + 1).alias("pc"), ((F.col("x") - F.get(shifts, F.col("j"))) * F.get(signs, F.col("j"))).alias("score"))
    spark = matrix.sparkSession
    loadings = spark.createDataFrame([(f, c + 1, float(weights[i, c] * sign[c])) for i, f in enumerate(names) for c in range(k)], "feature string, pc int, loading double")
    return scores, loadings, [float(x) for x in model.explainedVariance]


def top_loadings(loadings: DataFrame, n: int) -> DataFrame:
    """The n features of largest length in the plane of the first two components."""
    t = loadings.filter("pc <= 2").groupBy("feature").agg(F.sqrt(F.sum(F.col("loading") * F.col("loading"))).alias("size"))
    return t.orderBy(F.desc("size"), "feature").limit(n)


def batch_corrected(matrix: DataFrame, design: DataFrame) -> DataFrame:
    """Location and scale of batches removed with the groups protected: values are fitted by group and batch, the batch part
    (centred over the samples) is taken out, and residuals are scaled from their batch's sd to the sd of all.

    Features that all samples have are corrected, others are left out.  Of the design (sample, grp, batch) only the counts
    by group and batch come to the driver.
    """
    cells = design.groupBy("grp", "batch").agg(F.count(F.lit(1)).alias("n")).collect()
    groups, batches = (sorted({r[c] for r in cells}) for c in ("grp", "batch"))
    x = np.array([[1.0, *(float(r.grp == g) for g in groups[1:]), *(float(r.batch == b) for b in batches[1:])] for r in cells])
    count = np.array([[float(r.n)] for r in cells])
    n = int(count.sum())
    first = len(groups)  # batch columns start here
    z = x[:, first:] - (count * x[:, first:]).sum(axis=0) / n
    weights = x @ np.linalg.pinv(x.T @ (count * x), rcond=1e-12, hermitian=True)
    by_cell = matrix.sparkSession.createDataFrame(
        [(r.grp, r.batch, weights[i].tolist(), x[i].tolist(), z[i].tolist()) for i, r in enumerate(cells)],
        "grp string, batch string, w array<double>, x array<double>, z array<double>",
    )
    w = design.select("sample", "grp", "batch").join(by_cell, ["grp", "batch"]).drop("grp")
    m = matrix.select("feature", "sample", "value").filter("value is not null").join(w, "sample")
    k = x.shape[1]
    beta = m.groupBy("feature").agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.sum(F.col("value") * F.col("w")[j]) for j in range(k)]).alias("b")).filter(F.col("_n") == n)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    t = m.join(beta.select("feature", "b"), "feature")
    t = t.withColumn("_e", F.col("value") - dot("x", "b")).withColumn("_batch", dot("z", F.slice("b", first + 1, k)))
    sd = t.groupBy("feature", "batch").agg(F.stddev_samp("_e").alias("_s"))
    every = t.groupBy("feature").agg(F.stddev_samp("_e").alias("_all"))
    t = t.join(sd, ["feature", "batch"]).join(every, "feature")
    scaled = F.col("_e") * F.coalesce(div("_all", "_s"), F.lit(1.0))
    return t.select("feature", "sample", (F.col("value") - F.col("_e") - F.col("_batch") + scaled).alias("value"))
