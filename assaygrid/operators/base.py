"""Scale-safe building blocks shared by the operators.

Orderings inside a key never put a whole key into one task: distinct values with their counts are range-partitioned
by (key, value), ordered inside each range, and the ranges' totals are carried over by a table with one row for each
(key, range).  Where a key's rows are bounded by the study design the caller says so and one plain window does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.session import cut_lineage

METHODS = ("bh", "by", "holm", "bonferroni", "none")


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def div(a, b) -> Column:
    """a / b with NULL for a zero denominator."""
    return F.try_divide(col(a), col(b))


def rnd(c, digits: int = 6) -> Column:
    """Rounded value without negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("bigint")


def number(c) -> Column:
    """NaN is NULL: only NULL means missing."""
    return F.when(~F.isnan(col(c)), col(c))


def join_same(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL equal to NULL; the right side's keys are dropped."""
    keys = list(keys)
    if not keys:
        raise ValueError("join_same needs keys")
    names = {k: f"_r_{k}" for k in keys}
    r = right.withColumnsRenamed(names)
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[names[k]]) for k in keys])
    return left.join(r, cond, how).drop(*names.values())


def ordered_values(df: DataFrame, keys, value: str) -> DataFrame:
    """(keys, value, cnt, _b, n_less, n_le, n_all) for the distinct values of each key; NULL and NaN are left out.

    _b numbers the ranges; it grows with the value inside a key.
    """
    keys = list(keys)
    v = number(value) if dict(df.dtypes)[value] in ("double", "float") else F.col(value)
    d = df.select(*keys, v.alias(value)).filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    d = cut_lineage(d.repartitionByRange(*keys, value).withColumn("_b", F.spark_partition_id()))
    inner = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranges = d.groupBy(*keys, "_b").agg(F.sum("cnt").alias("_t"))
    # one row for each (key, range)
    outer = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = outer.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"), F.sum("_t").over(outer).alias("n_all"))
    run = join_same(d.withColumn("_run", F.sum("cnt").over(inner)), ranges, [*keys, "_b"])
    n_le = F.col("_run") + F.col("_before")
    return run.select(*keys, value, "cnt", "_b", (n_le - F.col("cnt")).alias("n_less"), n_le.alias("n_le"), "n_all")


def carried(d: DataFrame, keys, value: str, source: Column, out: str, how: str) -> DataFrame:
    """Running max over rising values (``how`` max) or running min over falling values (``how`` min) of ``source``."""
    keys = list(keys)
    fn, order = (F.max, lambda c: F.col(c).asc()) if how == "max" else (F.min, lambda c: F.col(c).desc())
    d = d.withColumn("_s", source)
    inner = Window.partitionBy(*keys, "_b").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    outer = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = d.groupBy(*keys, "_b").agg(fn("_s").alias("_t")).select(*keys, "_b", fn("_t").over(outer).alias("_c"))
    both = F.greatest if how == "max" else F.least
    return join_same(d.withColumn("_run", fn("_s").over(inner)), ranges, [*keys, "_b"]).withColumn(out, both("_run", "_c")).drop("_s", "_run", "_c")


def mid_ranks(df: DataFrame, keys, value: str, out: str = "mid_rank", bounded: bool = False) -> DataFrame:
    """Average rank of each row's value inside its key; NULL and NaN get no rank."""
    keys = list(keys)
    df = df.withColumn(value, number(value))
    if bounded:
        w = Window.partitionBy(*keys)
        rank = F.rank().over(w.orderBy(F.col(value).asc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2
        return df.withColumn(out, F.when(F.col(value).isNotNull(), rank))
    df = cut_lineage(df)  # the values are joined back: they must not be computed twice
    t = ordered_values(df, keys, value).select(*keys, value, (F.col("n_less") + (F.col("cnt") + 1) / 2).alias(out))
    return join_same(df, t, [*keys, value], "left")


def numbered(df: DataFrame, keys, order, out: str = "place") -> DataFrame:
    """``df`` with the number (from 1) of each row inside its key; keys and order tell rows apart.

    Rows are range-partitioned by key and order; what a range holds of a key is counted and carried to the next ones.
    """
    keys = list(keys)
    d = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    d = cut_lineage(d.withColumn("_at", F.monotonically_increasing_id())).withColumn("_b", F.shiftright("_at", 33))
    ranges = d.groupBy(*keys, "_b").agg(F.min("_at").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "_b", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo") + 1).alias("_shift"))
    return join_same(d, ranges, [*keys, "_b"]).withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_b", "_shift")


def running(df: DataFrame, keys, order, value: str, out: str, place: str = "place") -> DataFrame:
    """``df`` with the number of each row inside its key (``place``) and the sum of ``value`` over its rows up to this one (``out``).

    As ``numbered``: a range sums what it holds of a key, and the sums of the ranges before are carried over.
    """
    keys = list(keys)
    d = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    d = cut_lineage(d.withColumn("_at", F.monotonically_increasing_id())).withColumn("_b", F.shiftright("_at", 33))
    ranges = d.groupBy(*keys, "_b").agg(F.min("_at").alias("_lo"), F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried_ = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    ranges = ranges.select(*keys, "_b", (carried_("_n") - F.col("_lo") + 1).alias("_shift"), carried_("_t").alias("_before"))
    inner = Window.partitionBy(*keys, "_b").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    t = join_same(d.withColumn("_run", F.sum(value).over(inner)), ranges, [*keys, "_b"])
    return t.withColumn(place, F.col("_at") + F.col("_shift")).withColumn(out, F.col("_run") + F.col("_before")).drop("_at", "_b", "_shift", "_run", "_before")


def top_k(df: DataFrame, keys, order, k: int, out: str = "place") -> DataFrame:
    """The first k rows of each key; ranked per partition of the input first, so a large key is cut before it is gathered."""
    part = df.withColumn("_p", F.spark_partition_id())
    early = part.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order))).filter(F.col("_n") <= k).drop("_n", "_p")
    return early.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= k)


def quantiles(df: DataFrame, keys, value: str, probs, names, bounded: bool = False) -> DataFrame:
    """Exact linear-interpolation quantiles per key (no keys: one row)."""
    keys = list(keys)
    df = df.withColumn(value, number(value))
    if bounded:
        ps = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]))
        return df.groupBy(*keys).agg(ps.alias("_q")).select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    t = ordered_values(df, keys, value)
    cells = []
    for i, p in enumerate(probs):
        at = (F.col("n_all") - 1) * F.lit(float(p))
        holds = lambda k: (F.col("n_less") <= k) & (k < F.col("n_le"))
        lo = F.max(F.when(holds(F.floor(at)), F.col(value)))
        hi = F.max(F.when(holds(F.ceil(at)), F.col(value)))
        part = F.max(at - F.floor(at))
        cells.append((lo + (hi - lo) * part).alias(names[i]))
    return t.groupBy(*keys).agg(*cells)


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def _harmonic(m: Column) -> Column:
    exact = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(64)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / i)
    x = m.cast("double")
    tail = F.log(x) + 0.57721566490153286 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(m <= 64, exact).otherwise(tail)


def p_adjust(df: DataFrame, p: str, keys=(), method: str = "bh", out: str = "q", family_size: str | None = None, bounded: bool = False) -> DataFrame:
    """Multiple-testing adjustment inside each key; NULL and NaN p are neither ranked nor counted and stay NULL.

    ``family_size`` names a column with a larger number of tests than there are rows.  ``bounded``: the families are
    small by design (pairs of a few factor levels) and one window orders each.
    """
    if method not in METHODS:
        raise ValueError(f"unknown adjustment {method!r}")
    keys = list(keys)
    df = df.withColumn(p, number(p))
    if method == "none":
        return df.withColumn(out, F.col(p))
    if bounded:
        w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        m = (F.max(family_size).over(w) if family_size else F.count(p).over(w)).cast("double")
        d = df.withColumn("_m", m).withColumn("_le", F.count(p).over(w.orderBy(F.col(p).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0)))
        less = F.count(p).over(w.orderBy(F.col(p).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0)) - F.count(p).over(Window.partitionBy(*keys, p))
        d = d.withColumn("_less", less)
        val = _adjusted(method, p)
        if method == "holm":
            val = F.max(val).over(w.orderBy(F.col(p).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
        elif method != "bonferroni":
            val = F.min(val).over(w.orderBy(F.col(p).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
        return d.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), val))).drop("_m", "_le", "_less")
    df = cut_lineage(df)  # q is joined back on p: p must not be computed twice
    t = ordered_values(df, keys, p).withColumnsRenamed({"n_le": "_le", "n_less": "_less"}).withColumn("_m", F.col("n_all").cast("double"))
    if family_size:
        sizes = df.filter(F.col(p).isNotNull()).groupBy(*keys).agg(F.max(family_size).cast("double").alias("_m"))
        t = join_same(t.drop("_m"), sizes, keys) if keys else attach_scalars(t.drop("_m"), sizes)
    if method == "bonferroni":
        t = t.withColumn(out, _adjusted(method, p))
    else:
        t = carried(t, keys, p, _adjusted(method, p), out, "max" if method == "holm" else "min")
    return join_same(df, t.select(*keys, p, F.least(F.lit(1.0), out).alias(out)), [*keys, p], "left")


def _adjusted(method: str, p: str) -> Column:
    """Adjusted value before the running minimum or maximum, from the columns _m, _le and _less."""
    pc, m = F.col(p), F.col("_m")
    if method == "bonferroni":
        return pc * m
    if method == "holm":
        return pc * (m - F.col("_less"))
    return pc * m * (_harmonic(m) if method == "by" else F.lit(1.0)) / F.col("_le")
