"""Peaks of compounds: numbering across samples by retention time, and one peak kept for each compound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from assaygrid.operators.base import join_same, number
from assaygrid.session import cut_lineage

SIGNAL_FOLD = 1.5


def assigned_places(times: np.ndarray, m: np.ndarray, refs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, reference) of the ascending ``times`` matched to the ``refs`` in order, with the least total distance; rows one after another.

    Row r has the first m[r] times and n[r] references of its padded rows, n not rising.  Best matchings of the first i
    times to the references seen so far are carried from reference to reference, for all rows at once; equal totals take
    the earlier references.  A row without a finite total is not matched.
    """
    rows, most = times.shape
    cost = np.full((rows, most + 1), np.inf)
    cost[:, 0] = 0.0
    used = np.zeros((-(-max(1, refs.shape[1]) // 62), rows, most + 1), np.int64)  # the references taken, the first ones in the highest bits
    for j in range(refs.shape[1]):
        k = np.searchsorted(-n, -j)  # rows with more than j references
        word, bit = j // 62, np.int64(1) << (61 - j % 62)
        old, before, now = cost[:k, 1:], used[:, :k, :-1].copy(), used[:, :k, 1:]
        before[word] |= bit
        with np.errstate(invalid="ignore"):
            taken = cost[:k, :-1] + np.abs(times[:k] - refs[:k, j, None])
        better, same = taken < old, (taken == old) & np.isfinite(taken)
        if same.any():
            for x, y in zip(before, now):
                better |= same & (x > y)
                same &= x == y
        cost[:k, 1:] = np.where(better, taken, old)
        used[:, :k, 1:] = np.where(better, before, now)
    end = used[:, np.arange(rows), m]
    j = np.arange(refs.shape[1])
    return np.nonzero((end[j // 62] >> (61 - j % 62)[:, None] & 1).T)


@F.arrow_udf(ArrayType(IntegerType()))
def _assigned(times: pa.Array, refs: pa.Array, places: pa.Array) -> pa.Array:
    """For each of the times its place; NULL where there are no references or times."""
    usable = pc.and_(pc.is_valid(times), pc.is_valid(refs))
    at = np.flatnonzero(usable.to_numpy(zero_copy_only=False))
    times, refs, places = (x.take(pa.array(at)) for x in (times, refs, places))
    m, n = (x.value_lengths().to_numpy() for x in (times, refs))
    order = np.argsort(-n, kind="stable")
    flat = places.flatten().to_numpy(), np.cumsum(n) - n
    picks, lengths = [], []
    for low in range(0, len(order), 1024):
        i = order[low : low + 1024]
        t, r = (_padded(x.take(pa.array(i))) for x in (times, refs))
        row, ref = assigned_places(t, m[i], r, n[i])
        picks.append(flat[0][flat[1][i[row]] + ref])
        lengths.append(np.bincount(row, minlength=len(i)))
    ends = np.r_[0, np.cumsum(np.concatenate([np.zeros(0, int), *lengths]))]
    found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, int), *picks]), pa.int32()))
    back = np.full(len(usable), -1)
    back[at[order]] = np.arange(len(order))
    return found.take(pa.array(back, mask=back < 0))


def _padded(lists: pa.Array) -> np.ndarray:
    n = lists.value_lengths().to_numpy()
    out = np.zeros((len(n), n.max(initial=0)))
    out[np.arange(out.shape[1]) < n[:, None]] = lists.flatten().to_numpy()
    return out


def number_peaks(peaks: DataFrame) -> DataFrame:
    """``peaks`` (name, sample, rt, ...) with peak, n_peaks, peak_label (``2 of 3``) and rt_mean.

    References are the medians of the retention times by order, over the samples that have all peaks of the name; every
    sample's peaks are matched to them in order, so none is merged or dropped.  A sample's peaks of one name are few and
    travel in one row; the samples of a name, which the design bounds, give one median for each place.
    Rows with a NULL rt come last in their sample and take the places left.
    """
    rest = sorted(c for c in peaks.columns if c not in ("name", "sample", "rt"))
    w = Window.partitionBy("name", "sample").orderBy(*[F.col(c).asc_nulls_last() for c in ("rt", *rest)])
    p = peaks.withColumn("_place", F.row_number().over(w)).groupBy("name", "sample").agg(F.array_sort(F.collect_list(F.struct("_place", "rt", *rest))).alias("_l"))
    p = cut_lineage(p)
    most = p.groupBy("name").agg(F.max(F.size("_l")).cast("bigint").alias("n_peaks"))
    p = join_same(p, most, ["name"])
    full = p.filter(F.size("_l") == F.col("n_peaks")).select("name", F.explode("_l").alias("_x")).select("name", "_x._place", number("_x.rt").cast("double").alias("rt"))
    refs = full.filter("rt is not null").groupBy("name", "_place").agg(F.sort_array(F.collect_list("rt")).alias("_v"))
    half = (F.size("_v") - 1) * F.lit(0.5)
    low, high = F.get("_v", F.floor(half).cast("int")), F.get("_v", F.ceil(half).cast("int"))
    refs = refs.select("name", "_place", (low + (high - low) * (half - F.floor(half))).alias("_ref"))
    refs = refs.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(F.col("_place").alias("place"), F.col("_ref").alias("rt")))).alias("_refs"))
    p = join_same(p, refs, ["name"], "left").withColumn("_times", F.col("_l.rt").cast("array<double>"))
    usable = F.col("_refs").isNotNull() & ~F.exists("_times", lambda x: x.isNull()) & (F.size("_refs") >= F.size("_times"))
    given = F.sequence(F.lit(1), F.size("_times"))
    p = p.withColumn("_picks", F.coalesce(_assigned(F.when(usable, F.col("_times")), F.when(usable, F.col("_refs.rt")), F.when(usable, F.col("_refs.place"))), given))
    p = p.select("name", "sample", "n_peaks", F.arrays_zip("_l", F.col("_picks").alias("peak")).alias("_l"))
    mean = p.select("name", F.explode("_l").alias("_x")).groupBy("name", F.col("_x.peak").alias("peak")).agg(F.round(F.avg("_x._l.rt"), 2).alias("_mean"))
    by_peak = F.map_from_entries(F.collect_list(F.when(F.col("peak").isNotNull(), F.struct("peak", "_mean"))))
    mean = mean.groupBy("name").agg(by_peak.alias("_means"), F.max(F.when(F.col("peak").isNull(), F.col("_mean"))).alias("_unplaced"))
    t = join_same(p, mean, ["name"]).select("name", "sample", "n_peaks", "_means", "_unplaced", F.explode("_l").alias("_x"))
    t = t.select("name", "sample", "n_peaks", "_x._l.*", "_x.peak", F.coalesce(F.try_element_at("_means", F.col("_x.peak")), F.when(F.col("_x.peak").isNull(), F.col("_unplaced"))).alias("rt_mean"))
    t = t.withColumn("peak_label", F.concat(F.col("peak").cast("string"), F.lit(" of "), F.col("n_peaks").cast("string")))
    return t.select(*peaks.columns, "peak", "n_peaks", "peak_label", "rt_mean")


def _duel(a: Column, b: Column) -> tuple[Column, Column]:
    """(whether a wins, reason) of two candidate peaks; the criteria are asked in turn until one tells them apart."""
    num = lambda x: x.cast("string")
    pick = lambda cond, f: F.when(cond, f(a, b)).otherwise(f(b, a))  # noqa: E731  (f(winner, loser))
    clean_a, clean_b = a["co_elutes"] == "", b["co_elutes"] == ""
    a_high = a["median_area"] >= b["median_area"]
    high, low = F.greatest(a["median_area"], b["median_area"]), F.least(a["median_area"], b["median_area"])
    fold = F.when(low > 0, high / low)
    shown = lambda digits: F.when(fold.isNull(), "infx").otherwise(F.format_string(f"%.{digits}fx", fold))
    over = lambda x: F.concat(num(x["detected"]), F.lit("/"), num(a["n_samples"]))
    join = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    criteria = [
        (clean_a != clean_b, clean_a, lambda w, l: join("other peak co-elutes with ", F.substring_index(l["co_elutes"], " (", 1), " (possible in-source fragment)")),
        (a["detected"] != b["detected"], a["detected"] > b["detected"], lambda w, l: join("detected in more samples (", over(w), " vs ", over(l), ")")),
        (a["labelled"] != b["labelled"], a["labelled"] > b["labelled"], lambda w, l: join("more labeled isotopologues (", num(w["labelled"]), " vs ", num(l["labelled"]), ")")),
        (fold.isNull() | (fold >= SIGNAL_FOLD), a_high, lambda w, l: join("higher signal (", shown(1), " median area)")),
        (a["warnings"] != b["warnings"], a["warnings"] < b["warnings"], lambda w, l: join("fewer peak warnings (", num(w["warnings"]), " vs ", num(l["warnings"]), "); signal similar (", shown(1), ")")),
    ]
    wins, reason = a_high, join("signal slightly higher (", shown(2), "); all other checks equal")
    for asks, a_wins, text in reversed(criteria):
        wins, reason = F.when(asks, a_wins).otherwise(wins), F.when(asks, pick(a_wins, text)).otherwise(reason)
    return wins, reason


def one_peak_per_compound(candidates: DataFrame, prefer: dict[str, str] | None = None) -> DataFrame:
    """``candidates`` with kept, reason and winner (place, method, compound, peak): one peak of each key stays.

    Columns: key, place (order in the source), method, compound, peak, co_elutes (text, empty for none), detected,
    n_samples, labelled, median_area, warnings.  The candidates of a key, few by nature, are met in source order and
    the winner of each meeting goes on; the rule is not transitive, so the order counts.  ``prefer`` names the method
    to take for a compound; where the key has it, only its peaks compete.
    """
    shown = [c for c in candidates.columns if c != "key"]
    fields = ["place", *[c for c in shown if c != "place"]]
    c = candidates.withColumn("co_elutes", F.coalesce("co_elutes", F.lit(""))).withColumn("median_area", F.coalesce(F.col("median_area").cast("double"), F.lit(0.0)))
    c = c.withColumns({x: F.coalesce(F.col(x), F.lit(0)) for x in ("detected", "labelled", "warnings")})
    g = c.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_c"))
    forced = F.lit(None).cast("string")
    if prefer:
        names = F.create_map(*[F.lit(x) for kv in prefer.items() for x in kv])
        forced = F.get(F.filter(F.transform("_c", lambda x: F.try_element_at(names, x["compound"])), lambda m: m.isNotNull()), F.lit(0))
    g = g.withColumn("_forced", forced)
    pool = F.filter("_c", lambda x: x["method"] == F.col("_forced"))
    g = g.withColumn("_pool", F.when(F.col("_forced").isNotNull() & (F.size(pool) > 0), pool).otherwise(F.col("_c")))
    g = g.withColumn("_win", F.aggregate(F.slice("_pool", F.lit(2), F.greatest(F.size("_pool") - 1, F.lit(0))), F.get("_pool", F.lit(0)), lambda w, x: F.when(_duel(w, x)[0], w).otherwise(x)))
    t = g.select("key", "_win", "_forced", F.explode("_c").alias("_x"))
    kept = F.col("_x.place") == F.col("_win.place")
    why = F.when(kept, "chosen").when(F.col("_forced").isNotNull() & (F.col("_x.method") != F.col("_forced")), "manual choice (PREFER)")
    why = why.otherwise(_duel(F.col("_win"), F.col("_x"))[1])
    winner = F.struct(*[F.col(f"_win.{x}").alias(x) for x in ("place", "method", "compound", "peak")])
    return t.select("key", *[f"_x.{x}" for x in shown], kept.alias("kept"), why.alias("reason"), winner.alias("winner"))
