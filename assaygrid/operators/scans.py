"""Text tables as DataFrames: every parser takes a DataFrame with one column ``line`` (or a wide table) and returns a typed one."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.operators.base import count_if, div

MISSING_WORDS = ("", "na", "n/a", "nan", "null", "none", "-", "nd", "n.d.")


def number_or_null(text: Column) -> Column:
    """A number, or NULL for any other cell text."""
    t = F.trim(text)
    return F.when(~F.lower(t).isin(*MISSING_WORDS), t.try_cast("double"))


def delimited(lines: DataFrame, names: list[str], separator: str = ",") -> DataFrame:
    """Fields of each line as string columns; missing trailing fields and missing-value words are NULL.  Blank and ``#`` lines go."""
    parts = F.split(F.regexp_replace("line", "^﻿", ""), re.escape(separator))
    kept = lines.filter(~F.coalesce(F.trim("line"), F.lit("")).rlike("^(#.*)?$"))
    field = lambda i: F.trim(F.get(parts, F.lit(i)))
    return kept.select(*[F.when(~F.lower(field(i)).isin(*MISSING_WORDS), field(i)).alias(n) for i, n in enumerate(names)])


def wide_to_long(wide: DataFrame, id_column: str, samples: list[str]) -> DataFrame:
    """(feature, sample, value) of the sample columns; text that is no number is NULL."""
    cells = wide.select(F.col(id_column).cast("string").alias("feature"), *[F.col(s).cast("string").alias(s) for s in samples])
    long = cells.unpivot("feature", samples, "sample", "text")
    return long.select("feature", "sample", F.col("text").try_cast("double").alias("value"))


def sample_columns(wide: DataFrame, least: float = 0.8) -> DataFrame:
    """(column, share, is_sample): columns whose non-empty cells are numbers in at least ``least`` of the rows."""
    text = {c: F.trim(F.col(c).cast("string")) for c in wide.columns}
    some = wide.agg(*[F.struct(count_if(t != "").alias("n"), count_if(t.try_cast("double").isNotNull()).alias("k")).alias(c) for c, t in text.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in wide.columns]))
    t = some.select(rows.alias("r")).select("r.column", div("r.x.k", "r.x.n").alias("share"))
    return t.withColumn("is_sample", F.coalesce(F.col("share") >= least, F.lit(False)))


def align_samples(matrix: DataFrame, meta: DataFrame) -> DataFrame:
    """(sample, in_matrix, in_meta), matched without regard to case and outer blanks; the spelling of the matrix wins."""
    key = F.lower(F.trim("sample"))
    a = matrix.select("sample", key.alias("k")).distinct().groupBy("k").agg(F.min("sample").alias("a"))
    b = meta.select("sample", key.alias("k")).distinct().groupBy("k").agg(F.min("sample").alias("b"))
    return a.join(b, "k", "full").select(F.coalesce("a", "b").alias("sample"), F.col("a").isNotNull().alias("in_matrix"), F.col("b").isNotNull().alias("in_meta"))


def set_lines(lines: DataFrame) -> DataFrame:
    """Set file lines (name, description, members, tab separated) as (set_id, member); repeated members count once."""
    parts = F.split("line", "\t")
    return lines.select(F.trim(F.get(parts, F.lit(0))).alias("set_id"), F.explode(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))).alias("member")).select("set_id", F.upper(F.trim("member")).alias("member")).filter("member <> ''").distinct()


def id_list(lines: DataFrame) -> DataFrame:
    """Identifiers separated by line ends, blanks, commas or semicolons; comments go, repeats count once."""
    words = F.explode(F.split(F.regexp_replace("line", "#.*$", ""), r"[\s,;]+"))
    return lines.select(words.alias("member")).filter("member <> ''").distinct()


def name_attributes(names: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """Attributes taken from names by patterns with one group; no match gives NULL."""
    got = {k: F.regexp_extract(column, p, 1) for k, p in patterns.items()}
    return names.withColumns({k: F.when(v != "", v) for k, v in got.items()})


def grouping_columns(meta: DataFrame, most_levels: int = 15) -> DataFrame:
    """(column, n_levels, kind): text, or numbers with at most ``most_levels`` levels, group from two levels on; other numbers are continuous."""
    kinds = dict(meta.dtypes)
    some = meta.agg(*[F.count_distinct(c).alias(c) for c in meta.columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_levels"), F.lit(kinds[c] in ("string", "boolean")).alias("text")) for c in meta.columns]))
    t = some.select(rows.alias("r")).select("r.*")
    kind = F.when(F.col("n_levels") < 2, "single").when(F.col("text") | (F.col("n_levels") <= most_levels), "grouping").otherwise("continuous")
    return t.select("column", "n_levels", kind.alias("kind"))


def contrast_table(groups: DataFrame, reference: str | None = None) -> DataFrame:
    """(contrast, a, b): every pair of groups, or every group against the reference."""
    g = groups.select("grp").distinct()
    if reference is not None:
        pairs = g.filter(F.col("grp") != reference).select(F.col("grp").alias("a"), F.lit(reference).alias("b"))
    else:  # levels of a factor: few
        levels = g.agg(F.array_sort(F.collect_set("grp")).alias("l"))
        pairs = levels.select(F.posexplode("l").alias("i", "a"), "l").select("a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b"))
    return pairs.select(F.concat_ws(" vs ", "a", "b").alias("contrast"), "a", "b")


def replicate_pairs(design: DataFrame, a: str, b: str, keys=("replicate",)) -> DataFrame:
    """Samples of groups a and b paired by equal keys; a key must name one sample of each."""
    w = Window.partitionBy("grp", *keys)
    one = design.filter(F.col("grp").isin(a, b)).withColumn("_n", F.count(F.lit(1)).over(w)).filter("_n = 1")
    x = one.filter(F.col("grp") == a).select(*keys, F.col("sample").alias("sample_a"))
    y = one.filter(F.col("grp") == b).select(*keys, F.col("sample").alias("sample_b"))
    return x.join(y, list(keys))


def map_by_priority(items: DataFrame, candidates: list[Column], library: DataFrame) -> DataFrame:
    """(item, target, priority): each item's candidate keys are looked up in (key, target); the first that is known wins."""
    keys = F.array(*[F.struct(F.lit(i).alias("priority"), c.alias("key")) for i, c in enumerate(candidates)])
    tried = items.withColumn("_c", F.explode(keys)).select("item", "_c.priority", "_c.key").filter("key is not null and key <> ''")
    found = tried.join(library.groupBy("key").agg(F.min("target").alias("target")), "key")
    best = found.groupBy("item").agg(F.min(F.struct("priority", "target")).alias("x")).select("item", "x.target", "x.priority")
    return items.select("item").distinct().join(best, "item", "left")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
