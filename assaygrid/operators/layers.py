"""Two layers of one study: representative features, and concordance of a first with a second layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.functions import dist
from assaygrid.operators.base import attach_scalars, mid_ranks, p_adjust
from assaygrid.session import cut_lineage


def representative(features: DataFrame) -> DataFrame:
    """(key, feature, ...): of ``features`` (key, feature, mean, ...) the one of largest mean for each key, ties by name; empty keys go."""
    rest = [c for c in features.columns if c != "key"]
    t = features.filter("key is not null and key <> ''")
    top = t.groupBy("key").agg(F.max(F.coalesce(F.col("mean"), F.lit(float("-inf")))).alias("_m"))
    t = t.join(top, "key").filter(F.coalesce(F.col("mean"), F.lit(float("-inf"))) == F.col("_m")).drop("_m")
    return t.groupBy("key").agg(F.min_by(F.struct(*rest), "feature").alias("x")).select("key", "x.*")


def deming_slope(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, beta, r): orthogonal regression slope of y on x and their correlation; 1 below five pairs, 0 without covariance."""
    p = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    t = p.agg(F.count(F.lit(1)).alias("n"), F.var_samp(x).alias("sxx"), F.var_samp(y).alias("syy"), F.covar_samp(x, y).alias("sxy"), F.corr(x, y).alias("r"))
    d = F.col("syy") - F.col("sxx")
    beta = (d + F.sqrt(d * d + 4 * F.col("sxy") * F.col("sxy"))) / (2 * F.col("sxy"))
    return t.select("n", F.when(F.col("n") < 5, 1.0).when(F.abs("sxy") < 1e-12, 0.0).otherwise(beta).alias("beta"), "r")


def concordance(first: DataFrame, second: DataFrame, cut: float = 0.05) -> DataFrame:
    """(key, z_first, z_second, q_first, q_second, discordance, p, q, class, beta, coupling) of the keys that both layers have.

    ``first`` and ``second`` (key, z, q) hold one feature for each key.  The discordance is the distance from the
    Deming line through the origin, p its normal tail; class goes by the layers' q below ``cut`` and the signs.
    coupling is the correlation of the z, between 0.2 and 1, and 0.5 for five keys or fewer.
    """
    t = cut_lineage(first.select("key", F.col("z").alias("z_first"), F.col("q").alias("q_first")).join(second.select("key", F.col("z").alias("z_second"), F.col("q").alias("q_second")), "key"))
    s = deming_slope(t, "z_first", "z_second")
    coupling = F.when(F.col("n") > 5, F.greatest(F.lit(0.2), F.least(F.lit(1.0), "r"))).otherwise(0.5)
    t = attach_scalars(t, s.select("beta", coupling.alias("coupling")))
    t = t.withColumn("discordance", (F.col("z_second") - F.col("beta") * F.col("z_first")) / F.sqrt(1 + F.col("beta") * F.col("beta")))
    a, b = F.coalesce(F.col("q_first") < cut, F.lit(False)), F.coalesce(F.col("q_second") < cut, F.lit(False))
    same = F.signum("z_first") == F.signum("z_second")
    kind = F.when(a & b & same, "Coupled").when(a & b, "Opposing").when(b, "Protein-only (post-transcriptional)").when(a, "mRNA-only (buffered)").otherwise("Unchanged")
    return p_adjust(t.withColumn("class", kind).withColumn("p", dist.norm_sf("discordance")), "p", (), "bh", "q")


def within_sample_coupling(first: DataFrame, second: DataFrame, least: int = 8) -> DataFrame:
    """(key, n, rho, p, q): Spearman correlation over the shared samples of (key, sample, grp, value), group means taken out."""
    m = lambda d, n: d.filter("value is not null").select("key", "sample", "grp", F.col("value").alias(n))
    t = m(first, "x").join(m(second, "y").drop("grp"), ["key", "sample"])
    g = t.groupBy("key", "grp").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    t = t.join(g, ["key", "grp"]).select("key", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    t = mid_ranks(mid_ranks(t, ["key"], "x", "rx"), ["key"], "y", "ry")
    t = t.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho")).filter(F.col("n") >= least)
    tt = F.col("rho") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(1e-12)))
    return p_adjust(t.withColumn("p", dist.t_sf(tt, (F.col("n") - 2).cast("double"))), "p", (), "bh", "q")
