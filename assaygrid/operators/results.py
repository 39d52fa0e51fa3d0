"""Views of result tables: selections, flags, directions, orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaygrid.operators.base import col

TINY = 1e-300  # smallest p on the -log10 scale


def neglog10(p) -> Column:
    return -F.log10(F.greatest(col(p), F.lit(TINY)))


def fisher_z(r) -> Column:
    return F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), col(r))))


def passes(metric, threshold: float) -> Column:
    """metric <= threshold; NULL fails."""
    return F.coalesce(col(metric) <= threshold, F.lit(False))


def markers(stats: DataFrame, criterion: str = "both", p_cut: float = 0.05, q_cut: float = 0.05) -> DataFrame:
    """Features below the cuts (strictly) with their direction."""
    p, q = (F.coalesce(F.col(c) < cut, F.lit(False)) for c, cut in (("p", p_cut), ("q", q_cut)))
    keep = {"p": p, "fdr": q, "both": p & q}[criterion]
    return stats.filter(keep).withColumn("direction", F.when(F.col("log2fc") > 0, "Up").otherwise("Down"))


def select_for_enrichment(stats: DataFrame, metric: str = "p", threshold: float | None = 0.05, direction: str = "both") -> DataFrame:
    """Features for set tests: metric <= threshold (None: all with a value), up, down or both."""
    keep = F.col(metric).isNotNull() if threshold is None else passes(metric, threshold)
    side = {"up": F.col("log2fc") > 0, "down": F.col("log2fc") < 0, "both": F.lit(True)}[direction]
    return stats.filter(keep & F.coalesce(side, F.lit(False)))


def significant(p: str = "p", q: str = "q", cut: float = 0.05) -> Column:
    """p or q below the cut; NULL is no."""
    return F.coalesce(F.col(p) < cut, F.lit(False)) | F.coalesce(F.col(q) < cut, F.lit(False))


def directions(stats: DataFrame, p_cut: float = 0.05, fold_cut: float = 1.0, q_cut: float | None = None) -> DataFrame:
    """Volcano classes Up, Down, NS with the -log10 p axis."""
    sig = F.coalesce(F.col("p") < p_cut, F.lit(False))
    if q_cut is not None:
        sig = sig & F.coalesce(F.col("q") < q_cut, F.lit(False))
    cls = F.when(sig & (F.col("log2fc") >= fold_cut), "Up").when(sig & (F.col("log2fc") <= -fold_cut), "Down").otherwise("NS")
    return stats.withColumn("neglog10_p", neglog10("p")).withColumn("direction", cls)


def standard_view(stats: DataFrame, a: str, b: str, cut: float = 0.05) -> DataFrame:
    """The shared shape of two-group results: feature, p, fdr, log2fc, fc, significant, higher_in."""
    higher = F.when(F.col("log2fc") > 0, a).when(F.col("log2fc") < 0, b).otherwise("")
    return stats.select("feature", "p", F.col("q").alias("fdr"), "log2fc", F.pow(F.lit(2.0), "log2fc").alias("fc"), passes("q", cut).alias("significant"), higher.alias("higher_in"))


def first_rows(stats: DataFrame, sort_by: str, n: int, tie: str = "feature", rising: bool = True) -> DataFrame:
    """The first n rows by a metric, NULL last, ties by name."""
    key = F.col(sort_by).asc_nulls_last() if rising else F.col(sort_by).desc_nulls_last()
    return stats.orderBy(key, tie).limit(n)


def pair_class(ra: str, rb: str) -> Column:
    """Correlation in two states: flipped, intact, lost or gained."""
    a, b = F.col(ra), F.col(rb)
    return (
        F.when((a * b < 0) & (F.abs(a) >= 0.4) & (F.abs(b) >= 0.4), "flipped")
        .when((a * b > 0) & (F.abs(a) >= 0.6) & (F.abs(b) >= 0.6), "intact")
        .when(F.abs(a) > F.abs(b), "lost")
        .otherwise("gained")
    )
