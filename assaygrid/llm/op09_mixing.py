"""Mixing sources to target weights by iterative proportional fitting (operator 9, DataFrame functions only).

Documents fall into cells (source, language, topic).  The cells' token totals are raked to the three target
marginals, one after the other, ``rounds`` times.  A document of a cell is then kept with probability
min(1, s * raked weight / tokens of the cell), where s makes the expected number of kept tokens ``rate`` times all.

Targets default to a power of the token totals (a temperature per dimension); explicit shares may be given.  The
tables have no topic column, so the default topic is a rule on the text's form; any Column may take its place.
The draw compares the probability with a hash of the seed and the doc_id, so it can be repeated; rows of one doc_id
share the draw, and each keeps or leaves by its own cell.  Null source, language or topic is the value ``(none)``; null and blank texts
have no tokens and their cell's probability, which is 0 in a cell without tokens.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.llm.base import table
from assaygrid.session import cut_lineage

DIMS = ("source", "lang", "topic")
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.6}
FEW_CELLS = 10_000  # a cell table up to this size is broadcast and raked in one partition, a larger one by exchanges
WORD = r"[^ \t\n\x0B\f\r]+"


def form_topic() -> Column:
    """Stand-in topic: table-like text, else short, medium or long prose."""
    return (
        F.when(F.contains("text", F.lit(" | ")), "table")
        .when(F.col("n_tokens") < 100, "short")
        .when(F.col("n_tokens") < 1000, "medium")
        .otherwise("long")
    )


def rake(cells: DataFrame, rounds: int, temper: dict[str, float], shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with the raked weight w; all marginals sum to the token total."""
    out = cells.filter("tokens > 0")
    for d in DIMS:
        sums = out.groupBy(d).agg(F.sum("tokens").cast("double").alias("_t"))
        if shares and d in shares:
            given = F.create_map(*[F.lit(x) for kv in shares[d].items() for x in kv])
            sums = sums.withColumn("_w", F.coalesce(given[F.col(d)], F.lit(0.0)))
        else:
            sums = sums.withColumn("_w", F.pow("_t", F.lit(temper[d])))
        whole = sums.agg(F.sum("_w").alias("_sw"), F.sum("_t").alias("_st")).first()
        goal = F.col("_w") / F.lit(whole["_sw"] or 1.0) * F.lit(whole["_st"] or 0.0)
        out = out.join(sums.select(d, goal.alias(f"goal_{d}")), d)
    out = cut_lineage(out.withColumn("w", F.col("tokens").cast("double")))
    if out.count() <= FEW_CELLS:  # a checked size; in one partition the windows need no exchange
        out = out.coalesce(1)
    for r in range(rounds):
        for d in DIMS:
            out = out.withColumn("w", F.col("w") * F.try_divide(F.col(f"goal_{d}"), F.sum("w").over(Window.partitionBy(d))))
        if r % 4 == 3:
            out = cut_lineage(out)
    return out.select(*DIMS, "tokens", F.coalesce("w", F.lit(0.0)).alias("w"))


def sampling_scale(cells: DataFrame, rate: float) -> float:
    """s with sum(min(tokens, s * w)) = rate * sum(tokens): rescale over the cells not yet kept whole until none is added."""
    whole = cells.agg(F.sum("tokens").cast("double"), F.sum("w")).first()
    if not whole[0] or not whole[1]:
        return 0.0
    goal, s = rate * whole[0], rate * whole[0] / whole[1]
    while True:
        full = F.col("w") * s >= F.col("tokens")
        got = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).cast("double"), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if not got[1] or (goal - got[0]) / got[1] <= s * (1 + 1e-12):
            return s
        s = (goal - got[0]) / got[1]


def drawn(docs: DataFrame, rate: float, rounds: int, temper, shares, topic: Column | None, seed: str) -> DataFrame:
    """``docs`` with one more column, the struct ``_mix`` of (source, lang, topic, n_tokens, prob, sampled): the draw stays in its row."""
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), *docs.columns).withColumn("n_tokens", n)  # the documents' own n_tokens stays in _doc
    given = [F.coalesce(F.col(c), F.lit("(none)")).alias(c) for c in ("source", "lang")]
    topics = F.coalesce(form_topic() if topic is None else topic, F.lit("(none)"))
    rows = rows.select("_doc", "doc_id", F.struct(*given, topics.alias("topic"), "n_tokens").alias("_cell"))
    cells = cut_lineage(rows.select("_cell.*").groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    raked = cut_lineage(rake(cells, rounds, TEMPER if temper is None else temper, shares))
    s = sampling_scale(raked, rate)
    prob = raked.select(F.struct(*DIMS).alias("_key"), F.least(F.lit(1.0), F.col("w") * s / F.col("tokens")).alias("_prob"))
    if raked.count() <= FEW_CELLS:  # a checked size; a larger cell table is joined by its keys
        prob = F.broadcast(prob)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 2.0**32
    out = rows.withColumn("_key", F.struct(*[F.col(f"_cell.{d}").alias(d) for d in DIMS])).join(prob, "_key", "left").withColumn("_prob", F.coalesce("_prob", F.lit(0.0)))
    mixed = F.struct("_cell.*", F.round("_prob", 6).alias("prob"), (draw < F.col("_prob")).alias("sampled"))
    return out.select("_doc.*", mixed.alias("_mix"))


def mix(docs: DataFrame, rate: float = 0.5, rounds: int = 16, temper=None, shares=None, topic: Column | None = None, seed: str = "mix") -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, prob, sampled) for every row of ``docs``."""
    return drawn(docs.select("doc_id", "source", "lang", "text"), rate, rounds, temper, shares, topic, seed).select("doc_id", "_mix.*")


def sampled_documents(docs: DataFrame, rate: float = 0.5, rounds: int = 16, temper=None, shares=None, topic: Column | None = None, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` that their draw keeps, with mix_topic and mix_prob (in place of columns of these names)."""
    kept = drawn(docs, rate, rounds, temper, shares, topic, seed).filter("_mix.sampled")
    columns = [c for c in docs.columns if c not in ("mix_topic", "mix_prob")]
    return kept.select(*columns, F.col("_mix.topic").alias("mix_topic"), F.col("_mix.prob").alias("mix_prob"))


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op9_sql(rate: float = 0.5, rounds: int = 16, seed: str = "mix") -> str:
    """The same by unrolled window steps; the scale by the largest of the candidate scales over cells by falling ratio."""
    steps = [
        rf"""rows_ AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, text,
        CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) AS BIGINT) AS n_tokens FROM documents)""",
        """r AS (SELECT *, CASE WHEN contains(text, ' | ') THEN 'table' WHEN n_tokens < 100 THEN 'short'
        WHEN n_tokens < 1000 THEN 'medium' ELSE 'long' END AS topic FROM rows_)""",
        "c AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM r GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for d in DIMS:
        steps.append(f"t_{d} AS (SELECT {d}, CAST(sum(tokens) AS DOUBLE) AS t, pow(CAST(sum(tokens) AS DOUBLE), {TEMPER[d]}) AS p FROM c GROUP BY 1)")
        steps.append(f"g_{d} AS (SELECT {d}, p / (SELECT sum(p) FROM t_{d}) * (SELECT sum(t) FROM t_{d}) AS goal_{d} FROM t_{d})")
    steps.append("w0 AS MATERIALIZED (SELECT c.*, goal_source, goal_lang, goal_topic, CAST(tokens AS DOUBLE) AS w FROM c JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic))")
    n = 0
    for _ in range(rounds):
        for d in DIMS:
            steps.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (w * goal_{d} / sum(w) OVER (PARTITION BY {d}) AS w) FROM w{n})")
            n += 1
    steps.append(f"""lines AS (SELECT 0.0 AS ct, 0.0 AS cw UNION ALL
        SELECT sum(tokens) OVER o, sum(w) OVER o FROM w{n} WINDOW o AS (ORDER BY w / tokens DESC ROWS UNBOUNDED PRECEDING))""")
    steps.append(f"whole AS (SELECT sum(tokens) AS st, sum(w) AS sw FROM w{n})")
    steps.append(f"scale AS (SELECT max(({rate} * st - ct) / (sw - cw)) AS s FROM lines, whole WHERE sw - cw > 1e-9 * sw)")
    return (
        "WITH " + ",\n".join(steps) + f"""
        SELECT doc_id, r.source, r.lang, r.topic, n_tokens, round(p, 6) AS prob,
        CAST(CAST('0x' || substr(md5('{seed}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 < p AS sampled
        FROM (SELECT r.*, coalesce(least(1.0, w * (SELECT s FROM scale) / w{n}.tokens), 0.0) AS p FROM r LEFT JOIN w{n}
        ON r.source = w{n}.source AND r.lang = w{n}.lang AND r.topic = w{n}.topic) AS r"""
    )
