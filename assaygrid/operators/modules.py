"""Modules of rewired pairs: strength, bootstrap stability and the checks that a real module survives.

Tables: ``matrix`` (feature, sample, grp, value and optionally batch, imputed), ``pairs`` (f1, f2, set_a, set_b,
class, delta).  A module is the pairs of one class between two sets; its statistic is the mean over pairs of the
difference of the correlations, group b less group a, in the direction seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.operators.base import count_if, div, mid_ranks, numbered, quantiles
from assaygrid.session import cut_lineage

FEW = 100_000  # rows of a table that is broadcast
SMALL_GROUP = 5  # below this many samples in a group resampling says nothing
MODULE = ["set_a", "set_b", "class"]
PAIR = [*MODULE, "f1", "f2", "sign"]


def modules_of(pairs: DataFrame, max_pairs: int | None = None, max_modules: int | None = None) -> DataFrame:
    """(set_a, set_b, class, f1, f2, sign, delta, linked) with the sets in order; of ``max_pairs`` and ``max_modules`` the strongest stay.

    Linked pairs (column linked, if there) come first, then by |delta|; modules go by mean |delta| times log2(1 + pairs).
    """
    linked = F.col("linked") if "linked" in pairs.columns else F.lit(False)
    t = pairs.select(
        F.least("set_a", "set_b").alias("set_a"), F.greatest("set_a", "set_b").alias("set_b"), "class", "f1", "f2",
        F.signum("delta").alias("sign"), "delta", F.coalesce(linked, F.lit(False)).alias("linked"),
    ).distinct()
    if max_pairs is not None:
        w = Window.partitionBy(*MODULE).orderBy(F.desc("linked"), F.desc(F.abs("delta")), "f1", "f2")
        t = t.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_pairs).drop("_n")
    if max_modules is not None:
        strength = t.groupBy(*MODULE).agg((F.avg(F.abs("delta")) * F.log2(F.count(F.lit(1)) + 1)).alias("_s"))
        t = t.join(strength.orderBy(F.desc("_s"), *MODULE).limit(max_modules).select(*MODULE), MODULE, "left_semi")
    return t


def bootstrap_weights(samples: DataFrame, rounds: int, seed: int = 1) -> DataFrame:
    """(round, sample, w): how often each sample is drawn when its group's size is drawn with replacement from the group."""
    s = cut_lineage(numbered(samples.select("sample", "grp").distinct(), ["grp"], ["sample"], "_i"))
    size = s.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    draws = s.join(size, "grp").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    hit = F.pmod(F.xxhash64("grp", "_i", "round", F.lit(seed)), F.col("_n")) + 1
    hits = draws.select("grp", "round", hit.alias("_i")).groupBy("grp", "round", "_i").agg(F.count(F.lit(1)).alias("w"))
    return hits.join(s, ["grp", "_i"]).select("round", "sample", "w")


def weighted_corr(x: str, y: str, w: str) -> Column:
    """Correlation of x and y with weights, from sums; NULL where a side does not vary."""
    n = F.sum(w)
    s = lambda v: F.sum(F.col(w) * v)
    cx, cy = F.col(x), F.col(y)
    cov = s(cx * cy) - s(cx) * s(cy) / n
    vx, vy = s(cx * cx) - s(cx) * s(cx) / n, s(cy * cy) - s(cy) * s(cy) / n
    r = cov / F.sqrt(vx * vy)
    return F.when((vx > 1e-12 * s(cx * cx)) & (vy > 1e-12 * s(cy * cy)), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _by_module(r: DataFrame, a: str, b: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean over a module's pairs of sign * (r in b - r in a), for every column of correlations; a pair without one counts 0."""
    of = lambda g, c: F.max(F.when(F.col("grp") == g, F.col(c)))
    t = r.groupBy(*PAIR, *keys).agg(*[(of(b, c) - of(a, c)).alias(c) for c in columns])
    return t.groupBy(*MODULE, *keys).agg(*[F.avg(F.coalesce(F.col("sign") * F.col(c), F.lit(0.0))).alias(c) for c in columns])


def few(table: DataFrame) -> DataFrame:
    """``table`` to be broadcast up to ``FEW`` rows: then its keys may be few, and a plain join would gather all rows of a key in one task."""
    table = cut_lineage(table)
    return F.broadcast(table) if table.count() <= FEW else table


def score_modules(
    matrix: DataFrame, pairs: DataFrame, a: str, b: str, rounds: int = 200, robust: float = 0.2, stable: float = 0.8, share: float = 0.2,
    batch_least: int = 5, seed: int = 1, max_pairs: int | None = None, max_modules: int | None = None,
) -> DataFrame:
    """One row for each module: size, mean |delta|, observed statistic, bootstrap stability, four checks, verdict and score.

    * stability: share of bootstrap rounds whose statistic is ``robust`` or more; below ``stable`` it fails.
    * method: the statistic on ranks keeps half of the observed one.
    * influence: without samples where a feature of the module lies more than 4 robust sd from its group's median (the
      furthest, at most ``share`` of a group, one at least) it keeps half, and 0.2.
    * imputation: on samples with no imputed value in a pair it keeps half, and 0.2; unknown without column imputed.
    * batch: it is 0.2 or more in every batch with ``batch_least`` samples of both groups, if there are two of them.

    robust: no failure; fragile: two or more, or stability below 0.4; else mixed.  Groups under five samples are not
    resampled: fragile from two failures, else exploratory.
    """
    m = cut_lineage(modules_of(pairs, max_pairs, max_modules))
    has = lambda c: F.col(c) if c in matrix.columns else F.lit(None)
    x = matrix.filter(F.col("grp").isin(a, b) & F.col("value").isNotNull()).select(
        "feature", "sample", "grp", F.col("value").cast("double").alias("v"), has("batch").cast("string").alias("batch"), F.coalesce(has("imputed").cast("boolean"), F.lit(False)).alias("imp")
    )
    x = cut_lineage(mid_ranks(x, ["feature", "grp"], "v", "rank"))
    names = m.select(F.explode(F.array("f1", "f2")).alias("feature"), *MODULE).distinct()
    # samples far from their group in any feature of a module
    q = few(quantiles(x, ["feature", "grp"], "v", [0.5], ["med"]))
    off = x.join(q, ["feature", "grp"]).withColumn("off", F.abs(F.col("v") - F.col("med")))
    mad = quantiles(off, ["feature", "grp"], "off", [0.5], ["mad"])
    far = off.join(few(mad.filter("mad > 0")), ["feature", "grp"]).withColumn("far", F.col("off") / (1.4826 * F.col("mad"))).filter("far > 4")
    sizes = {r.grp: r.n for r in x.select("sample", "grp").distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    na, nb = sizes.get(a, 0), sizes.get(b, 0)
    small = min(na, nb) < SMALL_GROUP
    most = F.when(F.col("grp") == a, max(1, int(share * na))).otherwise(max(1, int(share * nb)))
    worst = far.join(few(names), "feature").groupBy(*MODULE, "grp", "sample").agg(F.max("far").alias("far"))
    drop = worst.withColumn("_n", F.row_number().over(Window.partitionBy(*MODULE, "grp").orderBy(F.desc("far"), F.desc("sample")))).filter(F.col("_n") <= most)
    drop = cut_lineage(drop.select(*MODULE, "sample", F.lit(True).alias("out")))
    one = lambda side, f: x.select(F.col("feature").alias(f), "sample", *(["grp", "batch"] if side == "x" else []), F.col("v").alias(side), F.col("rank").alias(f"r{side}"), F.col("imp").alias(f"i{side}"))
    cells = one("x", "f1").join(few(m.select(*PAIR)), "f1").join(one("y", "f2"), ["f2", "sample"]).join(drop, [*MODULE, "sample"], "left")
    cells = cut_lineage(cells.withColumn("whole", ~F.col("ix") & ~F.col("iy")).withColumn("stays", F.col("out").isNull()))
    w = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    cells = cells.withColumns({"w": F.lit(1.0), "w_stay": w(F.col("stays")), "w_whole": w(F.col("whole"))})
    n_whole = count_if(F.col("whole"))
    r = cells.groupBy(*PAIR, "grp").agg(
        weighted_corr("x", "y", "w").alias("observed"), weighted_corr("rx", "ry", "w").alias("ranked"), weighted_corr("x", "y", "w_stay").alias("kept"),
        F.when(n_whole >= min(5, na, nb), weighted_corr("x", "y", "w_whole")).alias("complete"),
    )
    t = _by_module(r, a, b, [], ["observed", "ranked", "kept", "complete"])
    imputed = x.filter("imp").select("feature").join(names, "feature").groupBy(*MODULE).agg(F.count(F.lit(1)).alias("n_imputed"))
    dropped = drop.groupBy(*MODULE).agg(F.count(F.lit(1)).alias("n_dropped"))
    d = m.groupBy(*MODULE).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(F.abs("delta")).alias("mean_abs_delta"), F.avg(F.col("linked").cast("int")).alias("_linked"))
    t = d.join(t, MODULE).join(imputed, MODULE, "left").join(dropped, MODULE, "left").na.fill(0, ["n_imputed", "n_dropped"])
    t = t.withColumn("stability", F.lit(None).cast("double"))
    if not small:
        boot = cells.select(*PAIR, "grp", "sample", "x", "y").join(bootstrap_weights(x.select("sample", "grp"), rounds, seed).withColumnRenamed("w", "bw"), "sample")
        rb = boot.groupBy(*PAIR, "grp", "round").agg(weighted_corr("x", "y", "bw").alias("s"))
        kept = _by_module(rb, a, b, ["round"], ["s"]).groupBy(*MODULE).agg((count_if(F.col("s") >= robust) / F.lit(float(rounds))).alias("stability"))
        t = t.drop("stability").join(kept, MODULE, "left")
    batches = x.select("sample", "grp", "batch").filter("batch is not null").distinct().groupBy("batch").agg(count_if(F.col("grp") == a).alias("na"), count_if(F.col("grp") == b).alias("nb"))
    batches = batches.filter((F.col("na") >= batch_least) & (F.col("nb") >= batch_least)).select("batch")
    rl = cells.join(batches, "batch").groupBy(*PAIR, "grp", "batch").agg(weighted_corr("x", "y", "w").alias("s"))
    lv = _by_module(rl, a, b, ["batch"], ["s"]).groupBy(*MODULE).agg(F.count(F.lit(1)).alias("n_batches"), F.min("s").alias("batch_least"))
    t = t.join(lv, MODULE, "left").na.fill(0, ["n_batches"])
    half = 0.5 * F.col("observed")
    survives = lambda c: (F.col(c) >= half) & (F.col(c) >= 0.2)
    t = t.withColumn("method_ok", F.col("ranked") >= half)
    t = t.withColumn("influence_ok", F.lit(None).cast("boolean") if small else (F.col("n_dropped") == 0) | survives("kept"))
    t = t.withColumn("imputation_ok", (F.col("n_imputed") == 0) | survives("complete"))
    t = t.withColumn("batch_ok", F.when(F.col("n_batches") >= 2, F.col("batch_least") >= 0.2))
    fails = [F.col("stability") < stable, ~F.col("method_ok"), ~F.col("influence_ok"), ~F.col("imputation_ok"), ~F.col("batch_ok")]
    t = t.withColumn("fails", sum((F.coalesce(f.cast("int"), F.lit(0)) for f in fails), F.lit(0)))
    if small:
        verdict = F.when(F.col("fails") >= 2, "fragile").otherwise("exploratory")
    else:
        verdict = F.when(F.col("fails") == 0, "robust").when((F.col("fails") >= 2) | (F.col("stability") < 0.4), "fragile").otherwise("mixed")
    score = F.col("mean_abs_delta") * F.log2(F.col("n_pairs") + 1) * (F.coalesce("stability", F.lit(0.5)) + 0.3) * F.pow(F.lit(0.5), F.col("fails")) * (1 + 0.25 * F.col("_linked"))
    return t.withColumn("verdict", verdict).withColumn("score", score).drop("_linked")
