"""Set enrichment on long tables: sets (set_id, member), universe and hits (member)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.functions import dist
from assaygrid.operators.base import attach_scalars, count_if, div, join_same, numbered, p_adjust, running
from assaygrid.session import cut_lineage


def ora_counts(sets: DataFrame, universe: DataFrame, hits: DataFrame, min_size: int = 1, sizes: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """n_universe, set_size (in the universe), n_hits (in it), hits (in the set), expected and fold per set.

    ``sizes`` (set_id, size) and ``total`` replace the sizes of the sets and of the universe by calibrated ones.
    """
    u = universe.select("member").distinct()
    h = hits.select("member").distinct().join(u, "member", "left_semi").withColumn("_hit", F.lit(1))
    s = sets.select("set_id", "member").distinct().join(u, "member", "left_semi").join(h, "member", "left")
    t = s.groupBy("set_id").agg(F.count(F.lit(1)).alias("set_size"), F.count("_hit").alias("hits"))
    if sizes is not None:
        t = join_same(t, sizes.select("set_id", F.col("size").cast("bigint").alias("_size")), ["set_id"], "left")
        t = t.withColumn("set_size", F.greatest(F.coalesce("_size", "set_size"), "hits")).drop("_size")
    n = u.agg(F.count(F.lit(1)).alias("n_universe")) if total is None else u.sparkSession.range(1).select(F.lit(total).cast("bigint").alias("n_universe"))
    t = attach_scalars(attach_scalars(t, n), h.agg(F.count(F.lit(1)).alias("n_hits")))
    t = t.filter(F.col("set_size") >= min_size).withColumn("expected", div(F.col("n_hits") * F.col("set_size") * 1.0, "n_universe"))
    return t.withColumn("fold", div("hits", "expected")).select("set_id", "n_universe", "set_size", "n_hits", "hits", "expected", "fold")


def ora(sets: DataFrame, universe: DataFrame, hits: DataFrame, **how) -> DataFrame:
    """``ora_counts`` with the hypergeometric tail, BH and Holm over the tested sets."""
    t = ora_counts(sets, universe, hits, **how)
    t = t.withColumn("p", dist.hyper_sf("hits", "n_universe", "set_size", "n_hits"))
    return p_adjust(p_adjust(t, "p", (), "bh", "q"), "p", (), "holm", "p_holm")


def unmatched(hits: DataFrame, universe: DataFrame) -> DataFrame:
    """Input members outside the universe."""
    return hits.select("member").distinct().join(universe.select("member"), "member", "left_anti")


def molecule_calls(calls: DataFrame, order: dict[str, int]) -> DataFrame:
    """One call for each member: the layer with the smallest rank in ``order`` wins, then the smallest p."""
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("layer")]
    best = F.row_number().over(Window.partitionBy("member").orderBy(rank, F.col("p").asc_nulls_last(), "layer"))
    return calls.withColumn("_n", best).filter("_n = 1").drop("_n")


def directional(sets: DataFrame, calls: DataFrame, least: int = 4, cut: float = 2.0) -> DataFrame:
    """Per set: hits up and down, z = (up - down) / sqrt(up + down) from ``least`` hits, predicted state at ±``cut``."""
    t = sets.select("set_id", "member").distinct().join(calls.select("member", "direction"), "member").groupBy("set_id").agg(
        count_if(F.col("direction") > 0).alias("up"), count_if(F.col("direction") < 0).alias("down")
    )
    n = F.col("up") + F.col("down")
    t = t.withColumn("z", F.when(n >= least, (F.col("up") - F.col("down")) / F.sqrt(n)))
    return t.withColumn("state", F.when(F.col("z") >= cut, "activated").when(F.col("z") <= -cut, "inhibited").otherwise(""))


def best_covered_set(sets: DataFrame, measured: DataFrame) -> DataFrame:
    """(member, set_id): of a member's sets those with three, then two measured members come first, then measured^2 / size, size, name."""
    size = sets.groupBy("set_id").agg(F.count_distinct("member").alias("size"))
    have = sets.select("set_id", "member").distinct().join(measured.select("member").distinct(), "member", "left_semi")
    got = have.groupBy("set_id").agg(F.count(F.lit(1)).alias("measured"))
    t = have.join(got.join(size, "set_id"), "set_id")
    tier = F.when(F.col("measured") >= 3, 0).when(F.col("measured") == 2, 1).otherwise(2)
    place = F.struct(tier, -(F.col("measured") * F.col("measured") / F.col("size")), F.col("size"), F.col("set_id"))
    return t.groupBy("member").agg(F.min(F.struct(place.alias("o"), "set_id", "measured", "size")).alias("x")).select("member", "x.set_id", "x.measured", "x.size")


def top_set_label(sets: DataFrame, enriched: DataFrame, top: int = 8, least: int = 2) -> DataFrame:
    """(member, label): the best-ranked of the ``top`` sets that holds it; labels with fewer than ``least`` members become Other."""
    first = enriched.orderBy(F.col("p").asc_nulls_last(), "set_id").limit(top)
    ranked = first.withColumn("place", F.row_number().over(Window.orderBy(F.col("p").asc_nulls_last(), "set_id")))  # ``top`` rows
    one = sets.select("set_id", "member").distinct().join(F.broadcast(ranked.select("set_id", "place")), "set_id").groupBy("member").agg(F.min(F.struct("place", "set_id")).alias("x"))
    lab = one.select("member", F.col("x.set_id").alias("label"))
    sizes = lab.groupBy("label").agg(F.count(F.lit(1)).alias("_c"))
    return lab.join(F.broadcast(sizes), "label").select("member", F.when(F.col("_c") >= least, F.col("label")).otherwise("Other").alias("label"))


def ranked_list(scores: DataFrame) -> DataFrame:
    """(member, score, rank, n_all): one score for each member, its largest by magnitude, ranked from the largest down.

    Equal scores are taken in order of member; places come from range partitions.
    """
    s = scores.filter("score is not null and not isnan(score)").groupBy("member").agg(F.max_by("score", F.struct(F.abs("score"), "score")).alias("score"))
    r = cut_lineage(numbered(s.withColumn("_down", -F.col("score")), (), ["_down", "member"], "rank").drop("_down"))
    return attach_scalars(r, r.agg(F.count(F.lit(1)).alias("n_all")))


def running_extreme(hits: str, n_hits: Column, n_all: Column) -> Column:
    """Struct (es, leading) of the running sum over ``hits``, an array of (rank, w) ordered by rank.

    A hit adds its share of the weights, a miss takes 1 / (n_all - n_hits) away; the largest value stands at a hit, the
    smallest right before one.  leading: hits up to the largest or from the smallest on, whichever is further from 0.
    """
    total = F.aggregate(hits, F.lit(0.0), lambda s, x: s + x["w"])
    misses = F.greatest(n_all - n_hits, F.lit(1)).cast("double")
    start = F.struct(total.alias("total"), F.lit(0).alias("h"), F.lit(0.0).alias("w"), F.lit(float("-inf")).alias("up"), F.lit(0).alias("at_up"), F.lit(float("inf")).alias("down"), F.lit(0).alias("at_down"))

    def step(s, x):
        share = F.when(s["total"] > 0, x["w"] / s["total"]).otherwise(1.0 / n_hits)
        before = s["w"] - (x["rank"] - s["h"] - 1) / misses
        after = before + share
        h = s["h"] + 1
        up, down = after > s["up"], before < s["down"]
        return F.struct(
            s["total"].alias("total"), h.alias("h"), (s["w"] + share).alias("w"), F.when(up, after).otherwise(s["up"]).alias("up"), F.when(up, h).otherwise(s["at_up"]).alias("at_up"),
            F.when(down, before).otherwise(s["down"]).alias("down"), F.when(down, h).otherwise(s["at_down"]).alias("at_down"),
        )

    end = lambda s: F.when(
        F.abs(s["up"]) >= F.abs(s["down"]), F.struct(s["up"].alias("es"), s["at_up"].cast("bigint").alias("leading"))
    ).otherwise(F.struct(s["down"].alias("es"), (n_hits - s["at_down"] + 1).cast("bigint").alias("leading")))
    return F.aggregate(hits, start, step, end)


def hit_lists(sets: DataFrame, ranked: DataFrame, power: float, least: int, most: int) -> DataFrame:
    """(set_id, hits, list of (rank, w)) of the sets with ``least`` to ``most`` ranked members; larger ones are never gathered."""
    found = sets.select("set_id", "member").distinct().join(ranked.select("member", "rank", F.pow(F.abs("score"), F.lit(power)).alias("w")), "member")
    found = cut_lineage(found)
    sized = found.groupBy("set_id").agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits").between(least, most))
    t = found.join(sized, "set_id").groupBy("set_id", "hits").agg(F.array_sort(F.collect_list(F.struct("rank", "w", "member"))).alias("list"))
    return t


def null_scores(ranked: DataFrame, sizes: DataFrame, rounds: int, power: float, seed: int = 1) -> DataFrame:
    """(hits, perm, es): running sums of ``rounds`` random sets of every size in ``sizes`` (hits); sets of one size share them.

    The ranks of a random set are the first distinct ones among hashes of (size, round, draw); where a set would hold
    more than half of the list, the smallest hashes of all ranks.
    """
    n = F.col("n_all")
    one = ranked.agg(F.max("n_all").alias("n_all"))
    draws = attach_scalars(sizes.select("hits").distinct(), one).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    dense = F.col("hits") * 2 > n
    # draws with replacement until ``hits`` are distinct: their expected number and eight standard deviations more
    enough = F.ceil(-1.05 * n * F.log1p(-F.col("hits") / n) + 8 * F.sqrt("hits") + 20)
    draws = draws.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.when(dense, n).otherwise(enough))))
    h = F.xxhash64("hits", "perm", "_i", F.lit(seed))
    draws = draws.select("hits", "perm", F.when(dense, F.col("_i")).otherwise(F.pmod(h, n) + 1).alias("rank"), F.when(dense, h).otherwise(F.col("_i")).alias("_o"))
    first = draws.groupBy("hits", "perm", "rank").agg(F.min("_o").alias("_o"))
    # less than twice the largest set tested
    pick = first.groupBy("hits", "perm").agg(F.array_sort(F.collect_list(F.struct("_o", "rank"))).alias("l")).select("hits", "perm", F.explode(F.slice("l", F.lit(1), F.col("hits").cast("int"))).alias("x"))
    w = pick.select("hits", "perm", "x.rank").join(ranked.select("rank", F.pow(F.abs("score"), F.lit(power)).alias("w"), "n_all"), "rank")
    t = w.groupBy("hits", "perm").agg(F.array_sort(F.collect_list(F.struct("rank", "w"))).alias("list"), F.first("n_all").alias("n_all"))
    return t.select("hits", "perm", running_extreme("list", F.col("hits"), F.col("n_all"))["es"].alias("es"))


def gsea(sets: DataFrame, scores: DataFrame, rounds: int = 1000, power: float = 1.0, least: int = 15, most: int = 500, seed: int = 1, lead: bool = True) -> DataFrame:
    """(set_id, hits, es, leading, leading_members, nes, p, q) of the sets with ``least`` to ``most`` ranked members.

    The null of a size class are the running sums of random sets of that size.  nes is es over the mean of the null of
    its sign, p the share of that null (plus one) which reaches es, q by BH over the sets tested.
    """
    ranked = ranked_list(scores)
    t = attach_scalars(hit_lists(sets, ranked, power, least, most), ranked.agg(F.max("n_all").alias("n_all")))
    t = cut_lineage(t.withColumn("x", running_extreme("list", F.col("hits"), F.col("n_all"))).select("set_id", "hits", "x.es", "x.leading", "list"))
    null = cut_lineage(null_scores(ranked, t.select("hits"), rounds, power, seed))
    same = F.when(F.col("es") >= 0, F.col("_e") >= 0).otherwise(F.col("_e") < 0)
    reach = F.when(F.col("es") >= 0, F.col("_e") >= F.col("es")).otherwise(F.col("_e") <= F.col("es"))
    m = t.select("set_id", "hits", "es").join(null.select("hits", F.col("es").alias("_e")), "hits").groupBy("set_id").agg(
        count_if(same).alias("_n"), F.avg(F.when(same, F.abs("_e"))).alias("_mean"), count_if(same & reach).alias("_k")
    )
    t = join_same(t, m, ["set_id"], "left")
    mean = F.when(F.col("_mean") > 0, F.col("_mean")).otherwise(1.0)
    t = t.withColumn("nes", F.col("es") / mean).withColumn("p", F.when(F.col("_n") > 0, (F.col("_k") + 1) / (F.col("_n") + 1)).otherwise(1.0))
    front = F.when(F.col("es") >= 0, F.slice("list", F.lit(1), F.col("leading").cast("int"))).otherwise(F.slice("list", (F.col("hits") - F.col("leading") + 1).cast("int"), F.col("leading").cast("int")))
    t = t.withColumn("leading_members", front["member"] if lead else F.lit(None)).drop("list", "_n", "_mean", "_k")
    return p_adjust(t, "p", (), "bh", "q")


def enrichment_score(sets: DataFrame, scores: DataFrame, power: float = 1.0) -> DataFrame:
    """Running-sum score of each set over the members ranked by falling score; only hits are joined to the rank.

    Hits add |score|^power over the set's sum, misses take 1 / (N - size) away; the extremes lie at hits.  Equal
    scores are taken in order of member.  Returns set_id, hits, es and the size of the leading edge.
    """
    ranked = ranked_list(scores)
    hit = sets.select("set_id", "member").distinct().join(ranked, "member").withColumn("_w", F.pow(F.abs("score"), F.lit(power)))
    sums = hit.groupBy("set_id").agg(F.count(F.lit(1)).alias("_k"), F.sum("_w").alias("_sum"))
    t = join_same(running(hit, ["set_id"], ["rank"], "_w", "_cum", "_h"), sums, ["set_id"])
    miss = div(F.col("rank") - F.col("_h"), F.col("n_all") - F.col("_k"))
    t = t.withColumn("_up", div("_cum", "_sum") - F.coalesce(miss, F.lit(0.0)))
    t = t.withColumn("_down", F.col("_up") - div("_w", "_sum"))
    e = t.groupBy("set_id").agg(
        F.max("_k").alias("hits"), F.max(F.struct("_up", (-F.col("_h")).alias("h"))).alias("top"), F.min(F.struct("_down", F.col("_h").alias("h"))).alias("low")
    )
    up = F.abs("top._up") >= F.abs("low._down")
    lead = F.when(up, -F.col("top.h")).otherwise(F.col("hits") - F.col("low.h") + 1)
    return e.select("set_id", "hits", F.when(up, F.col("top._up")).otherwise(F.col("low._down")).alias("es"), lead.cast("bigint").alias("leading"))
