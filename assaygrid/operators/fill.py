"""Imputation from other samples: k nearest samples, and low-rank factors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.operators.base import numbered
from assaygrid.session import cut_lineage

TILE_VALUES = 2_000_000  # cells of a tile of samples
TILE = 4096  # samples in a tile at most
DONOR_TILES = 4  # a tile of donors is as many of these
PAIRS = 2_000_000  # distances that a task holds at once
NEAR = 64  # donors looked at first; all where these do not fill a gap


def sample_vectors(matrix: DataFrame, samples: DataFrame, zero_missing: bool, most_features: int) -> tuple[DataFrame, DataFrame, int]:
    """(features (feature, pos), vectors (sample, pos, val) of the observed cells, number of features).

    A sample's cells stand in one row, so their number is checked: more than ``most_features`` features raise.
    """
    v = F.when(~F.isnan("value"), F.col("value").cast("double"))
    cells = matrix.withColumn("value", v).join(samples.select("sample").distinct(), "sample", "left_semi")
    features = cut_lineage(numbered(matrix.select("feature").distinct(), (), ["feature"], "pos"))
    d = features.count()
    if d > most_features:
        raise ValueError(f"{d} features, more than most_features = {most_features}")
    seen = cells.filter(F.col("value").isNotNull() & ((F.col("value") != 0) if zero_missing else F.lit(True)))
    have = seen.join(features, "feature").groupBy("sample").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "value"))).alias("c"))
    empty = F.expr("cast(array() as array<struct<pos:int,value:double>>)")
    rows = samples.select("sample").distinct().join(have, "sample", "left").withColumn("c", F.coalesce("c", empty))
    return features, cut_lineage(rows.select("sample", F.col("c.pos").alias("pos"), F.col("c.value").alias("val"))), d


def gaps_of(vectors: DataFrame, d: int) -> DataFrame:
    """(sample, pos) of the cells a sample lacks."""
    every = F.sequence(F.lit(1), F.lit(d)) if d else F.expr("cast(array() as array<int>)")
    return vectors.select("sample", F.explode(F.array_except(every, "pos")).alias("pos"))


def filled(matrix_cells: DataFrame, features: DataFrame, new: DataFrame, how: str) -> DataFrame:
    """Observed cells and the new ones (sample, pos, value), flagged by ``imputed``."""
    named = new.join(features, "pos").select("feature", "sample", "value", F.lit(how).alias("imputed"))
    return matrix_cells.join(features, "pos").select("feature", "sample", "value", F.lit(None).cast("string").alias("imputed")).unionByName(named)


def observed(vectors: DataFrame) -> DataFrame:
    return vectors.select("sample", F.explode(F.arrays_zip("pos", "val")).alias("c")).select("sample", "c.pos", F.col("c.val").alias("value"))


def nearest_sample_impute(matrix: DataFrame, samples: DataFrame, k: int = 5, zero_missing: bool = False, most_features: int = 50_000) -> DataFrame:
    """(feature, sample, value, imputed): a gap becomes the mean of the feature in the k nearest samples that have it.

    The distance of two samples is Euclidean over the features both have, scaled up to all features; samples without
    a common feature are no neighbours, equal distances go by sample.  Without any neighbour the feature's mean is
    taken; a feature without values stays out.  Samples meet in tiles: a task holds a tile of samples and a larger one of
    donors and returns the k best donors of every gap among these, so no table of sample pairs is made.
    """
    features, vectors, d = sample_vectors(matrix, samples, zero_missing, most_features)
    n = vectors.count()
    tiles = max(1, -(-n // max(1, min(TILE, TILE_VALUES // max(1, d)))))
    groups = -(-tiles // DONOR_TILES)
    at = lambda count: F.pmod(F.xxhash64("sample"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    lacking = vectors.filter(F.size("pos") < d).select("sample", "pos", "val", F.lit(True).alias("asks"), at(tiles).alias("i"), every(groups).alias("j"))
    donors = vectors.select("sample", "pos", "val", F.lit(False).alias("asks"), every(tiles).alias("i"), at(groups).alias("j"))
    best = pa.list_(pa.struct([("d", pa.float64()), ("sample", pa.string()), ("value", pa.float64())]))

    def compare(t: pa.Table) -> pa.Table:
        names = np.array(t.column("sample").to_pylist(), object)
        asks = t.column("asks").combine_chunks().to_numpy(zero_copy_only=False)
        x, have = np.zeros((len(names), d)), np.zeros((len(names), d), bool)
        places = t.column("pos").combine_chunks()
        row, place = np.repeat(np.arange(len(names)), places.value_lengths().to_numpy()), places.flatten().to_numpy() - 1
        x[row, place], have[row, place] = t.column("val").combine_chunks().flatten().to_numpy(), True
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        given, there = x[b], have[b]
        # centred, so that large values do not blur small distances
        x = np.where(have, x - (np.sum(x, axis=0) / np.maximum(1, have.sum(axis=0))), 0.0)
        xb, mb = x[b], there.astype(float)
        place = np.unique(names.astype(str), return_inverse=True)[1]
        by_name = place[b]
        out_s, out_p, out_b = [], [], []

        def donors_of(dist, lacks, among):
            """(gap, its k nearest donors) among some donors, equal distances by name."""
            order = among[np.lexsort((by_name[among], dist[among]))]
            has = there[order][:, lacks]
            chosen = has & (np.cumsum(has, axis=0) <= k)
            return [order[np.flatnonzero(chosen[:, c])] for c in range(len(lacks))]

        step = max(1, PAIRS // max(1, len(b)))
        for lo in range(0, len(a) if len(b) else 0, step):
            part = a[lo : lo + step]
            ma = have[part].astype(float)
            common = ma @ mb.T
            square = (x[part] ** 2) @ mb.T - 2 * x[part] @ xb.T + ma @ (xb**2).T
            dist = np.full(common.shape, np.inf)
            np.divide(np.maximum(square, 0) * d, common, out=dist, where=common > 0)
            for r, q in enumerate(part):
                one = dist[r]
                one[by_name == place[q]] = np.inf
                gaps = np.flatnonzero(~have[q])
                fit = np.flatnonzero(np.isfinite(one))
                if not len(fit):
                    continue
                near = fit
                if len(fit) > NEAR:
                    near = fit[one[fit] <= np.partition(one[fit], NEAR - 1)[NEAR - 1]]
                rows = donors_of(one, gaps, near)
                if len(near) < len(fit):
                    few = [c for c in range(len(gaps)) if len(rows[c]) < k]
                    for c, more in zip(few, donors_of(one, gaps[few], fit) if few else []):
                        rows[c] = more
                for f, from_ in zip(gaps, rows):
                    if len(from_):
                        out_s.append(names[q])
                        out_p.append(int(f) + 1)
                        out_b.append([{"d": float(np.sqrt(one[w])), "sample": names[b[w]], "value": float(given[w, f])} for w in from_])
        return pa.table({"sample": pa.array(out_s, pa.string()), "pos": pa.array(out_p, pa.int32()), "best": pa.array(out_b, best)})

    found = lacking.unionByName(donors).groupBy("i", "j").applyInArrow(compare, "sample string, pos int, best array<struct<d:double,sample:string,value:double>>")
    found = found.groupBy("sample", "pos").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("b"))  # k for each tile
    mean = F.aggregate("b", F.lit(0.0), lambda s, e: s + e["value"]) / F.size("b")
    near = found.select("sample", "pos", mean.alias("value"))
    means = observed(vectors).groupBy("pos").agg(F.avg("value").alias("mean"))
    new = gaps_of(vectors, d).join(near, ["sample", "pos"], "left").join(means, "pos").select("sample", "pos", F.coalesce("value", "mean").alias("value"))
    return filled(observed(vectors), features, new, "knn")


def low_rank_impute(
    matrix: DataFrame, samples: DataFrame, rank: int = 3, reg: float = 0.05, steps: int = 15, seed: int = 1, floor: float | None = 0.0, zero_missing: bool = False, most_features: int = 50_000
) -> DataFrame:
    """(feature, sample, value, imputed): gaps from a factorisation of the standardised features by alternating least squares.

    Values are standardised inside their feature, factors of ``rank`` dimensions are fitted on the observed cells, and
    a gap becomes mean + sd * (feature factors . sample factors), not below ``floor``.  A sample without any value, or
    a feature without spread, gives the feature's mean; a feature without values stays out.
    """
    from pyspark.ml.recommendation import ALS

    features, vectors, d = sample_vectors(matrix, samples, zero_missing, most_features)
    ids = cut_lineage(numbered(vectors.select("sample"), (), ["sample"], "s"))
    cells = cut_lineage(observed(vectors))
    stats = cells.groupBy("pos").agg(F.avg("value").alias("m"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    stats = cut_lineage(stats)
    z = cells.join(stats.filter("sd > 0"), "pos").join(ids, "sample").select(F.col("s").cast("int").alias("s"), "pos", ((F.col("value") - F.col("m")) / F.col("sd")).cast("float").alias("z"))
    gaps = gaps_of(vectors, d).join(ids, "sample").select("sample", F.col("s").cast("int").alias("s"), "pos")
    new = gaps.withColumn("prediction", F.lit(None).cast("float"))
    if not z.isEmpty():
        als = ALS(rank=rank, maxIter=steps, regParam=reg, userCol="s", itemCol="pos", ratingCol="z", seed=seed, coldStartStrategy="nan", checkpointInterval=5)
        new = als.fit(z).transform(gaps)
    guess = F.col("m") + F.coalesce(F.when(~F.isnan("prediction"), F.col("prediction")), F.lit(0.0)) * F.col("sd")
    new = new.join(stats, "pos").select("sample", "pos", (guess if floor is None else F.greatest(guess, F.lit(floor))).alias("value"))
    return filled(cells, features, new, "low_rank")
