"""The driver tables seen as matrices, metadata, sets, time courses and graphs.

SQL_VIEWS holds the same relations as SQL text for the oracle; ``grid`` (all feature and sample pairs) exists there only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _by_brand_and_size(spark, sf, value) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    part = table(spark, sf, "part").select(
        "p_partkey", F.concat_ws("-", "p_brand", F.expr("cast(p_size div 10 as string)")).alias("feature")
    )
    joined = li.join(part, li.l_partkey == part.p_partkey)
    return joined.groupBy("feature", F.col("l_suppkey").cast("string").alias("sample")).agg(value.alias("value"))


def matrix_sales(spark, sf) -> DataFrame:
    return _by_brand_and_size(spark, sf, F.sum("l_extendedprice"))


def count_matrix(spark, sf) -> DataFrame:
    """Counts per brand and size class: dense enough for size factors."""
    return _by_brand_and_size(spark, sf, F.sum("l_quantity").cast("bigint"))


def log_matrix(spark, sf) -> DataFrame:
    """log2 of ``matrix_sales`` with the samples' groups."""
    m = matrix_sales(spark, sf).filter("value > 0").withColumn("value", F.log2("value"))
    return m.join(meta_sales(spark, sf).select("sample", "grp", "region", "batch", "is_qc"), "sample")


def meta_sales(spark, sf) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("s_suppkey").cast("string").alias("sample"),
        F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("B").alias("grp"),
        F.col("r_name").alias("region"),
        F.concat(F.lit("b"), F.col("s_nationkey") % 3).alias("batch"),
        (F.col("s_suppkey") % 10 == 0).alias("is_qc"),
        F.col("s_acctbal").alias("balance"),
    )


def matrix_vec(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.posexplode("embedding").alias("d", "v"), "vec_id").select(
        F.concat(F.lit("d"), F.lpad(F.col("d").cast("string"), 2, "0")).alias("feature"),
        F.col("vec_id").cast("string").alias("sample"),
        F.col("v").cast("double").alias("value"),
    )


def meta_vec(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample"),
        F.concat(F.lit("c"), F.col("label")).alias("label"),
        F.when(F.col("label") < 5, "A").otherwise("B").alias("grp"),
        F.concat(F.lit("b"), F.col("vec_id") % 2).alias("batch"),
    )


def counts(spark, sf) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").cast("string").alias("feature"), F.col("l_suppkey").cast("string").alias("sample"))
        .agg(F.sum("l_quantity").cast("bigint").alias("value"))
    )


def part_sets(spark, sf) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_name")
    words = F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("word:"), w))
    names = F.concat(
        F.array(F.concat(F.lit("type:"), "p_type"), F.concat(F.lit("brand:"), "p_brand")), words
    )
    return p.select(F.explode(F.array_distinct(names)).alias("set_id"), F.col("p_partkey").cast("string").alias("member"))


def part_score(spark, sf) -> DataFrame:
    """Part revenue, the ranked list for enrichment."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").cast("string").alias("member"))
        .agg(F.sum("l_extendedprice").alias("score"))
    )


def timecourse(spark, sf) -> DataFrame:
    return (
        table(spark, sf, "events")
        .withColumn("hours", (F.floor(F.hour("ts") / 6) * 6 + 6).cast("double"))
        .groupBy(
            F.col("event_type").alias("compound"),
            F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("grp"),
            "hours",
            F.col("user_id").cast("string").alias("sample"),
        )
        .agg(F.avg("value").alias("value"))
    )


def mid(spark, sf) -> DataFrame:
    o, l, p = (table(spark, sf, t) for t in ("orders", "lineitem", "part"))
    return (
        l.join(o, l.l_orderkey == o.o_orderkey)
        .join(p, l.l_partkey == p.p_partkey)
        .groupBy(
            F.col("p_brand").alias("compound"),
            (F.col("l_linenumber") - 1).alias("i"),
            (F.col("o_custkey") % 24).cast("string").alias("sample"),
        )
        .agg(F.sum("l_extendedprice").alias("area"))
        .withColumn("n", F.lit(6))
    )


def design_mid(spark, sf) -> DataFrame:
    """24 samples: group, treatment, time, type from the sample number."""
    s = table(spark, sf, "orders").select((F.col("o_custkey") % 24).alias("k")).distinct()
    return s.select(
        F.col("k").cast("string").alias("sample"),
        F.when(F.col("k") % 12 == 0, "reference").otherwise("labelled").alias("sample_type"),
        F.when(F.col("k") % 2 == 0, "A").otherwise("B").alias("grp"),
        F.when(F.floor(F.col("k") / 2) % 2 == 0, "ctl").otherwise("drug").alias("treatment"),
        (F.floor(F.col("k") / 4) % 3 + 1).cast("double").alias("hours"),
        (F.col("k") != 23).alias("include"),
    )


SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "matrix": ((), """SELECT p_brand || '-' || CAST(p_size // 10 AS VARCHAR) AS feature, CAST(l_suppkey AS VARCHAR) AS sample,
        sum(l_extendedprice) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""),
    "meta": ((), """SELECT CAST(s_suppkey AS VARCHAR) AS sample, CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS grp,
        r_name AS region, 'b' || CAST(s_nationkey % 3 AS VARCHAR) AS batch, (s_suppkey % 10 = 0) AS is_qc, s_acctbal AS balance
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "grid": (("matrix", "meta"), """SELECT f.feature, m.sample, m.grp, m.region, m.batch, x.value
        FROM (SELECT DISTINCT feature FROM matrix) f CROSS JOIN meta m
        LEFT JOIN matrix x ON x.feature = f.feature AND x.sample = m.sample"""),
    "mlog": (("matrix", "meta"), """SELECT feature, sample, grp, region, batch, is_qc, log2(value) AS value
        FROM matrix JOIN meta USING (sample) WHERE value > 0"""),
    "vec": ((), """SELECT 'd' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS feature, CAST(vec_id AS VARCHAR) AS sample,
        CAST(embedding[i] AS DOUBLE) AS value, 'c' || CAST(label AS VARCHAR) AS label,
        CASE WHEN label < 5 THEN 'A' ELSE 'B' END AS grp, 'b' || CAST(vec_id % 2 AS VARCHAR) AS batch
        FROM embeddings, unnest(range(1, 65)) AS t(i)"""),
    "counts": ((), """SELECT CAST(l_partkey AS VARCHAR) AS feature, CAST(l_suppkey AS VARCHAR) AS sample,
        CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2"""),
    "cmatrix": ((), """SELECT p_brand || '-' || CAST(p_size // 10 AS VARCHAR) AS feature, CAST(l_suppkey AS VARCHAR) AS sample,
        CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""),
    "sets": ((), """SELECT DISTINCT set_id, CAST(p_partkey AS VARCHAR) AS member FROM (
        SELECT p_partkey, 'type:' || p_type AS set_id FROM part UNION ALL SELECT p_partkey, 'brand:' || p_brand FROM part
        UNION ALL SELECT p_partkey, 'word:' || unnest(string_split(p_name, ' ')) FROM part)"""),
    "score": ((), """SELECT CAST(l_partkey AS VARCHAR) AS member, sum(l_extendedprice) AS score FROM lineitem GROUP BY 1"""),
    "tc": ((), """SELECT event_type AS compound, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS grp,
        CAST(floor(hour(ts) / 6.0) * 6 + 6 AS DOUBLE) AS hours, CAST(user_id AS VARCHAR) AS sample, avg(value) AS value
        FROM events GROUP BY 1, 2, 3, 4"""),
    "mid": ((), """SELECT p_brand AS compound, l_linenumber - 1 AS i, CAST(o_custkey % 24 AS VARCHAR) AS sample,
        sum(l_extendedprice) AS area, 6 AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3"""),
    "design": ((), """SELECT CAST(k AS VARCHAR) AS sample, CASE WHEN k % 12 = 0 THEN 'reference' ELSE 'labelled' END AS sample_type,
        CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END AS grp, CASE WHEN (k // 2) % 2 = 0 THEN 'ctl' ELSE 'drug' END AS treatment,
        CAST((k // 4) % 3 + 1 AS DOUBLE) AS hours, k <> 23 AS include
        FROM (SELECT DISTINCT o_custkey % 24 AS k FROM orders)"""),
}


def sql(names: str, body: str, extra: str = "") -> str:
    """WITH clause for the named views (and what they need), then optional CTEs, then the query."""
    done: list[str] = []

    def need(n):
        for d in SQL_VIEWS[n][0]:
            need(d)
        if n not in done:
            done.append(n)

    for n in names.split():
        need(n)
    parts = [f"{n} AS ({SQL_VIEWS[n][1]})" for n in done]
    if extra.strip():
        parts.append(extra.strip())
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return head + body


def R(expr: str, d: int = 6) -> str:
    """Rounded value without negative zero."""
    return f"(round({expr}, {d}) + 0.0)"


def _simpson(integrand: str, lo: str, hi: str, steps: int = 400) -> str:
    """Simpson rule over [lo, hi]; ``integrand`` uses X for the abscissa."""
    step = f"((({hi}) - ({lo})) / {steps}.0)"
    x = f"(({lo}) + i * {step})"
    return (
        f"({step} / 3.0 * list_sum(list_transform(range(0, {steps + 1}), lambda i: "
        f"(CASE WHEN i = 0 OR i = {steps} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END) * ({integrand.replace('X', x)}))))"
    )


def sql_t_p(t: str, df: str) -> str:
    """Two-sided t tail: with x = sqrt(df) tan(a), the integral of cos(a)^(df - 1) from atan(|t| / sqrt(df)); past 12 / sqrt(df)
    the integrand is below 1e-30 of its top."""
    lo = f"atan(abs({t}) / sqrt({df}))"
    integral = _simpson(f"pow(greatest(cos(X), 0.0), ({df}) - 1.0)", lo, f"least(pi() / 2, {lo} + 12.0 / sqrt({df}))")
    return f"least(1.0, 2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()) * {integral})"


def sql_norm_p(z: str) -> str:
    """Two-sided normal tail, the tail itself integrated."""
    integral = _simpson("exp(-0.5 * X * X)", f"abs({z})", f"abs({z}) + 9.0")
    return f"least(1.0, 2 * {integral} / sqrt(2 * pi()))"


def sql_chi2_p(x: str, k: str) -> str:
    """Upper chi-square tail: with x = y^2, the integral of 2 y^(k-1) exp(-y^2 / 2) from sqrt(x)."""
    integral = _simpson(f"2 * pow(X, ({k}) - 1.0) * exp(-0.5 * X * X)", f"sqrt({x})", f"sqrt({x}) + 12.0")
    return f"least(1.0, {integral} / (pow(2.0, ({k}) / 2.0) * exp(lgamma(({k}) / 2.0))))"


def sql_hyper_p(k: str, N: str, K: str, n: str) -> str:
    lc = lambda a, b: f"(lgamma(({a}) + 1.0) - lgamma(({b}) + 1.0) - lgamma(({a}) - ({b}) + 1.0))"
    term = f"exp({lc(K, 'i')} + {lc(f'({N}) - ({K})', f'({n}) - i')} - {lc(N, n)})"
    return (
        f"least(1.0, coalesce(list_sum(list_transform(range(greatest({k}, ({n}) + ({K}) - ({N}), 0), "
        f"least({K}, {n}) + 1), lambda i: {term})), 0.0))"
    )


def sql_bh(rel: str, p: str, keys: str, out: str = "q") -> str:
    """BH-adjusted copy of relation ``rel`` partitioned by ``keys`` ('' = one family)."""
    part = f"PARTITION BY {keys}" if keys else ""
    return (
        f"(SELECT * EXCLUDE (_rk, _m), CASE WHEN {p} IS NULL THEN NULL ELSE least(1.0, min({p} * _m / _rk) OVER ({part} ORDER BY {p} DESC "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS {out} FROM (SELECT *, count({p}) OVER ({part}) AS _m, "
        f"rank() OVER ({part} ORDER BY {p} ASC NULLS LAST) + count(*) OVER (PARTITION BY {keys + ',' if keys else ''} {p}) - 1 AS _rk FROM {rel}))"
    )
