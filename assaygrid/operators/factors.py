"""Factors shared by several blocks of features, what they go with, and classifiers fused over blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.functions import dist
from assaygrid.operators.base import attach_scalars, count_if, div, join_same, mid_ranks, numbered, p_adjust
from assaygrid.operators.cascade import shuffled_in_bins
from assaygrid.session import cut_lineage


def _numbered_features(matrix: DataFrame, most_features: int) -> tuple[DataFrame, list]:
    f = cut_lineage(numbered(matrix.select("block", "feature").distinct(), (), ["block", "feature"], "pos"))
    d = f.count()
    if d > most_features:
        raise ValueError(f"{d} features, more than most_features = {most_features}")
    return f, [(r.block, r.feature) for r in f.orderBy("pos").collect()]  # checked above


def block_factors(matrix: DataFrame, k: int = 8, least_r2: float = 0.02, most_features: int = 2000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Principal components over blocks of equal norm: scores (sample, factor, score), loadings (block, feature, factor,
    loading) and r2 (block, factor, r2, the share of the block's sum of squares).

    ``matrix`` (block, feature, sample, value).  Samples with every feature count.  Features are centred, blocks scaled
    to norm 1.  Factors that explain ``least_r2`` of no block go; the others are ordered by their summed r2, signed so
    that the largest loading is positive.  The products of features are summed by Spark, one square of features comes
    to the driver; above ``most_features`` features it raises.
    """
    features, names = _numbered_features(matrix, most_features)
    d = len(names)
    v = matrix.filter(F.col("value").isNotNull() & ~F.isnan("value")).join(features, ["block", "feature"])
    rows = v.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("value").cast("double").alias("v")))).alias("c"))
    rows = cut_lineage(rows.filter(F.size("c") == d).select("sample", F.transform("c", lambda x: x["v"]).alias("x")))

    def sums(batches):
        import pyarrow as pa

        total = np.zeros((d + 1, d + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                x = np.asarray(batch.column("x").slice(at, 1024).flatten(), float).reshape(-1, d)
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                total += x.T @ x
        i = np.arange(d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = rows.select("x").mapInArrow(sums, "i bigint, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    both = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r"))
    got = both.orderBy("i").select(F.transform("r", lambda x: x["v"]).alias("r")).collect()  # (d + 1) squared numbers
    spark = matrix.sparkSession
    empty = spark.createDataFrame([], "sample string, factor int, score double"), spark.createDataFrame([], "block string, feature string, factor int, loading double"), spark.createDataFrame([], "block string, factor int, r2 double")
    if not got or got[0].r[0] < 2:
        return empty
    gram = np.array([r.r for r in got])
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    cov = gram[1:, 1:] - n * np.outer(mean, mean)
    block = np.array([b for b, _ in names])
    norm = {b: np.sqrt(max(cov[block == b][:, block == b].trace(), 0.0)) for b in dict.fromkeys(block)}
    scale = np.array([1 / norm[b] if norm[b] > 0 else 0.0 for b in block])
    values, vectors = np.linalg.eigh(cov * np.outer(scale, scale))
    order = np.argsort(-values)[: min(k, d)]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    r2 = {b: values * (vectors[block == b] ** 2).sum(axis=0) if norm[b] > 0 else 0 * values for b in norm}
    top, total = np.max(list(r2.values()), axis=0), np.sum(list(r2.values()), axis=0)
    keep = [i for i in np.argsort(-total, kind="stable") if top[i] >= least_r2]
    if not keep:
        return empty
    vectors = vectors[:, keep] * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])[keep]
    weights, shift = vectors * scale[:, None], (mean * scale) @ vectors

    def project(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), float).reshape(-1, d)
            z = x @ weights - shift
            yield pa.RecordBatch.from_arrays([batch.column("sample"), pa.array(list(z), pa.list_(pa.float64()))], ["sample", "z"])

    scores = rows.mapInArrow(project, "sample string, z array<double>").select("sample", F.posexplode("z").alias("f", "score"))
    scores = scores.select("sample", (F.col("f") + 1).alias("factor"), "score")
    loadings = spark.createDataFrame([(b, f, j + 1, float(vectors[i, j])) for i, (b, f) in enumerate(names) for j in range(len(keep))], empty[1].schema)
    shares = spark.createDataFrame([(str(b), j + 1, float(r2[b][i])) for b in norm for j, i in enumerate(keep)], empty[2].schema)
    return scores, loadings, shares


def factor_associations(scores: DataFrame, covariates: DataFrame) -> DataFrame:
    """(factor, covariate, kind, n, statistic, p, q) for covariates (sample, covariate, text, number).

    A covariate with numbers gives Spearman's r; one of two texts Welch's t of the lesser against the greater; one of
    more Kruskal and Wallis's H over the texts with two samples or more.  q by BH over all.
    """
    t = cut_lineage(scores.join(covariates, "sample").filter("score is not null"))
    num = mid_ranks(mid_ranks(t.filter("number is not null"), ["factor", "covariate"], "score", "_rs"), ["factor", "covariate"], "number", "_rn")
    num = num.groupBy("factor", "covariate").agg(F.count(F.lit(1)).alias("n"), F.corr("_rs", "_rn").alias("statistic"))
    tt = div(F.col("statistic") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0))), F.sqrt(1 - F.col("statistic") * F.col("statistic")))
    num = num.select("factor", "covariate", F.lit("spearman").alias("kind"), "n", "statistic", dist.t_sf(tt, (F.col("n") - 2).cast("double")).alias("p"))
    text = t.filter("number is null and text is not null")
    level = text.groupBy("factor", "covariate", "text").agg(F.count(F.lit(1)).alias("_k"), F.avg("score").alias("_m"), F.var_samp("score").alias("_v"))
    level = cut_lineage(level.filter("_k > 1"))
    levels = level.groupBy("factor", "covariate").agg(
        F.count(F.lit(1)).alias("_l"), F.sum("_k").alias("n"), F.min_by("_m", "text").alias("m1"), F.max_by("_m", "text").alias("m2"),
        F.min_by(F.col("_v") / F.col("_k"), "text").alias("e1"), F.max_by(F.col("_v") / F.col("_k"), "text").alias("e2"),
        F.min_by("_k", "text").alias("k1"), F.max_by("_k", "text").alias("k2"),
    )
    two = levels.filter("_l = 2")
    e = F.col("e1") + F.col("e2")
    df = div(e * e, F.col("e1") * F.col("e1") / (F.col("k1") - 1) + F.col("e2") * F.col("e2") / (F.col("k2") - 1))
    two = two.select("factor", "covariate", F.lit("welch").alias("kind"), "n", div(F.col("m1") - F.col("m2"), F.sqrt(e)).alias("statistic"), df.alias("_df"))
    two = two.select("factor", "covariate", "kind", "n", "statistic", dist.t_sf("statistic", "_df").alias("p"))
    more = text.join(level.select("factor", "covariate", "text"), ["factor", "covariate", "text"]).join(levels.filter("_l > 2").select("factor", "covariate", "_l", "n"), ["factor", "covariate"])
    more = mid_ranks(more, ["factor", "covariate"], "score", "_r")
    groups = more.groupBy("factor", "covariate", "text").agg(F.first("_l").alias("_l"), F.first("n").alias("n"), F.count(F.lit(1)).alias("_k"), F.sum("_r").alias("_s"))
    ties = more.groupBy("factor", "covariate", "score").agg(F.count(F.lit(1)).cast("double").alias("_t")).groupBy("factor", "covariate").agg(F.sum(F.pow("_t", F.lit(3)) - F.col("_t")).alias("_t"))
    h = groups.groupBy("factor", "covariate").agg(F.first("_l").alias("_l"), F.first("n").alias("n"), F.sum(F.col("_s") * F.col("_s") / F.col("_k")).alias("_q")).join(ties, ["factor", "covariate"])
    n = F.col("n").cast("double")
    stat = div(12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1), 1 - F.col("_t") / (n * n * n - n))
    h = h.select("factor", "covariate", F.lit("kruskal").alias("kind"), "n", stat.alias("statistic"), (F.col("_l") - 1).cast("double").alias("_df"))
    h = h.select("factor", "covariate", "kind", "n", "statistic", dist.chi2_sf("statistic", "_df").alias("p"))
    return p_adjust(num.unionByName(two).unionByName(h), "p", (), "bh", "q")


def loading_enrichment(loadings: DataFrame, sets: DataFrame, rounds: int = 500, least: int = 5, seed: int = 3) -> DataFrame:
    """(factor, block, set_id, n, mean, z, p, q): mean standardised loading of a set's members against shuffled features.

    The loadings of a block are standardised inside the factor; the null deals the features of a block anew, the same
    deal for all factors and sets.  Sets need ``least`` members in the block.
    """
    m, s = F.avg("loading").over(Window.partitionBy("factor", "block")), F.stddev_pop("loading").over(Window.partitionBy("factor", "block"))
    w = cut_lineage(loadings.withColumn("w", (F.col("loading") - m) / (s + 1e-12)).select("factor", "block", "feature", "w"))
    f = w.select("block", "feature").distinct()
    dealt = shuffled_in_bins(f.select(F.struct("block", "feature").alias("node"), F.col("block").alias("bin"), F.col("feature").alias("value")), rounds, seed)
    deals = f.select("block", "feature", F.lit(0).alias("perm"), F.col("feature").alias("as")).union(dealt.select("node.block", "node.feature", "perm", F.col("value").alias("as")))
    member = sets.select("set_id", F.col("member").alias("feature")).distinct().join(f, "feature")
    big = member.groupBy("block", "set_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    t = member.join(big, ["block", "set_id"]).join(deals, ["block", "feature"]).join(w.withColumnRenamed("feature", "as"), ["block", "as"])
    t = t.groupBy("factor", "block", "set_id", "n", "perm").agg(F.avg("w").alias("a")).groupBy("factor", "block", "set_id", "n").agg(
        F.max(F.when(F.col("perm") == 0, F.col("a"))).alias("mean"), F.avg(F.when(F.col("perm") > 0, F.col("a"))).alias("_m"), F.stddev_pop(F.when(F.col("perm") > 0, F.col("a"))).alias("_s")
    )
    t = t.withColumn("z", (F.col("mean") - F.col("_m")) / (F.col("_s") + 1e-12)).drop("_m", "_s")
    return p_adjust(t.withColumn("p", dist.norm_sf("z")), "p", (), "bh", "q")


def top_variance(matrix: DataFrame, k: int) -> DataFrame:
    """Rows of each block's k features of largest variance, ties by name."""
    v = matrix.groupBy("block", "feature").agg(F.var_samp("value").alias("_v"))
    v = v.withColumn("_n", F.row_number().over(Window.partitionBy("block").orderBy(F.col("_v").desc_nulls_last(), "feature"))).filter(F.col("_n") <= k)
    return matrix.join(v.select("block", "feature"), ["block", "feature"], "left_semi")


def auc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, auc) of score against y (0 or 1), by average ranks."""
    r = mid_ranks(scores, keys, "score", "_r")
    t = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("double").alias("_p"), F.sum(F.when(F.col("y") == 1, F.col("_r"))).alias("_s"))
    q = F.col("n") - F.col("_p")
    return t.select(*keys, "n", div(F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * q).alias("auc"))


def late_fusion(matrix: DataFrame, labels: DataFrame, folds: int = 5, top: int = 500, c: float = 0.1, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold probabilities (sample, y, block, score; block ``fused`` is their mean) and AUC (block, n, auc).

    Per block the ``top`` features of largest variance; each fold standardises by its training samples and fits L2
    logistic regression of strength 1 / ``c`` on them alone.  Samples need all of a block's chosen features.  Folds are
    dealt inside each class by the order of hashes.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    y = labels.select("sample", F.col("y").cast("int").alias("y"), F.xxhash64("sample", F.lit(seed)).alias("_h")).filter("y in (0, 1)")
    y = cut_lineage(numbered(y, ["y"], ["_h", "sample"], "_i").select("sample", "y", (F.col("_i") % folds).cast("int").alias("fold")))
    m = cut_lineage(top_variance(matrix.join(y.select("sample"), "sample", "left_semi"), top).join(y, "sample"))
    out = None
    for (block,) in sorted(tuple(r) for r in m.select("block").distinct().collect()):
        b = m.filter(F.col("block") == block)
        d = b.select("feature").distinct().count()
        rows = b.filter("value is not null").groupBy("sample", "y", "fold").agg(F.array_sort(F.collect_list(F.struct("feature", F.col("value").cast("double").alias("v")))).alias("c"))
        rows = cut_lineage(rows.filter(F.size("c") == d).select("sample", "y", "fold", F.transform("c", lambda x: x["v"]).alias("x")))  # at most ``top`` values
        for fold in range(folds):
            training = rows.filter(F.col("fold") != fold)
            if training.select("y").distinct().count() < 2:
                continue
            stats = training.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m"), (F.stddev_pop("v") + 1e-9).alias("s"))
            stats = stats.agg(F.array_sort(F.collect_list(F.struct("j", "m", "s"))).alias("_st"))
            z = attach_scalars(rows, stats).withColumn("z", array_to_vector(F.transform(F.arrays_zip("x", "_st"), lambda e: (e["x"] - e["_st"]["m"]) / e["_st"]["s"])))
            train, test = z.filter(F.col("fold") != fold), z.filter(F.col("fold") == fold)
            n = train.count()
            model = LogisticRegression(featuresCol="z", labelCol="y", regParam=1 / (c * n), standardization=False, maxIter=200, tol=1e-8).fit(train)
            p = model.transform(test).select("sample", "y", F.lit(block).alias("block"), vector_to_array("probability")[1].alias("score"))
            out = p if out is None else out.unionByName(p)
    if out is None:
        out = matrix.sparkSession.createDataFrame([], "sample string, y int, block string, score double")
    out = cut_lineage(out)
    fused = out.groupBy("sample", "y").agg(F.avg("score").alias("score")).select("sample", "y", F.lit("fused").alias("block"), "score")
    out = out.unionByName(fused)
    return out, auc(out, ["block"])
