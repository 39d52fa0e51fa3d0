"""Merkle manifest of a dataset by time-forward processing (operator 12).

Every row becomes a leaf digest; leaves of one ``lang`` ascend by doc_id, runs of eight become their parent until one
node (the subroot) is left, and the subroots, ordered by lang, become the root the same way.

A node's label is (level, tree, index).  Digests travel as messages to the label of the parent: a shuffle by that label
stands for the external priority queue and delivers all messages of the lowest labels left (one level of all trees at
once); a node takes the at most eight messages addressed to it, in order, and sends its own digest on.  The reversed
sweep takes labels from high to low: every node sends each child the proof suffix (siblings from there to the root),
one message for a run of eight, until the leaves have theirs.  Texts are digested where they are read; only digests
travel.  Positions inside a tree come from a range partitioning by (lang, doc_id) and the counts of the ranges before,
so a lang that holds most rows is never in one task; a node never has more than eight children.

Null columns count as ``-``; a null doc_id stands first in its lang and is never tampered with, a null lang is the
first tree.  Rows with one doc_id are ordered by their leaf digest, so repeated rows give equal leaves side by side.
An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.llm.base import table
from assaygrid.session import cut_lineage

FAN = 8
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def part(c) -> Column:
    """A value with its length in bytes before it, ``-`` for null."""
    s = F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*[part(c) for c in ("doc_id", "source", "lang", "n_chars")], part(text)), 256)


def joined(digests: Column) -> Column:
    return F.concat_ws("", digests)


def positions(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, doc_id, leaf, ...) with idx, the place inside the tree, and n, the tree's size."""
    order = ["tree", "doc_id", "leaf"]
    # the number of a row is its range's number and its place inside; kept in a written table, as a second run may cut ranges elsewhere
    rows = cut_lineage(leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("range", F.shiftright("at", 33))
    w = Window.partitionBy("tree").orderBy("range")
    ranges = rows.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))  # one row for a tree in a range
    ranges = ranges.select(
        "tree", "range", (F.sum("c").over(w) - F.col("c") - F.col("first")).alias("shift"), F.sum("c").over(Window.partitionBy("tree")).alias("n")
    )
    return rows.join(ranges, ["tree", "range"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def upward(nodes: DataFrame, levels: int, rest: list[str]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Sweep by rising labels from ``nodes`` (tree, idx, n, digest and the columns ``rest``).

    Returns the runs (tree, idx of the parent, kids) and the nodes (tree, idx, n, digest) of every level; n is the
    number of nodes that a tree has at that level, so n = 1 marks its top.
    """
    runs, all_nodes, own = [], [nodes.select("tree", "idx", "n", "digest")], rest
    for _ in range(levels):
        message = F.struct((F.col("idx") % FAN).alias("place"), "digest", *own)
        run = (
            nodes.filter("n > 1")
            .groupBy("tree", F.expr(f"idx div {FAN}").alias("parent"))
            .agg(F.array_sort(F.collect_list(message)).alias("kids"), F.first("n").alias("n"))  # at most eight messages
        )
        run = cut_lineage(run.select("tree", F.col("parent").alias("idx"), F.ceil(F.col("n") / FAN).alias("n"), "kids"))
        nodes = run.select("tree", "idx", "n", F.sha2(joined(F.col("kids.digest")), 256).alias("digest"))
        runs.append(run)
        all_nodes.append(nodes)
        own = []
    return runs, all_nodes


def downward(runs: list[DataFrame], nodes: list[DataFrame], top: DataFrame, rest: list[str]) -> DataFrame:
    """Sweep by falling labels: (tree, idx, digest, path and ``rest``) of the lowest level.

    ``top`` (tree, path) is what stands above each tree.  A path is an array of (place, others): the node's place in
    its run and the run's other digests, joined, from the node up.
    """
    tops = lambda level: nodes[level].filter("n = 1").join(top, "tree").select("tree", "idx", "digest", "path")
    paths = tops(len(runs))
    for level in range(len(runs) - 1, -1, -1):
        extra = rest if level == 0 else []
        kid = F.explode("kids").alias("kid")
        run = runs[level].join(paths.select("tree", "idx", F.col("path").alias("suffix")), ["tree", "idx"]).select("tree", "idx", "kids", "suffix", kid)
        digests = F.col("kids.digest")
        others = joined(F.concat(F.slice(digests, F.lit(1), F.col("kid.place").cast("int")), F.slice(digests, F.col("kid.place").cast("int") + 2, F.lit(FAN))))
        path = F.concat(F.array(F.struct(F.col("kid.place").cast("int").alias("place"), others.alias("others"))), "suffix")
        run = run.select(
            "tree", (F.col("idx") * FAN + F.col("kid.place")).alias("idx"), "kid.digest", path.alias("path"), *[f"kid.{c}" for c in extra]
        )
        if level == 0:
            return run
        paths = run.unionByName(tops(level))
    raise ValueError("downward needs a run")


def levels_of(nodes: DataFrame) -> int:
    """Levels of the highest tree."""
    most, levels = nodes.agg(F.max("n")).first()[0] or 1, 0
    while most > 1:
        most, levels = -(-most // FAN), levels + 1
    return levels


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and the other digests along its path give."""
    at = lambda x: x["place"] * 64  # noqa: E731  (hex digits before the node's own)
    step = lambda d, x: F.sha2(F.concat(F.substring(x["others"], F.lit(1), at(x)), d, F.substring(x["others"], at(x) + 1, F.lit(64 * FAN))), 256)
    return F.aggregate(path, digest, step)


NO_PATH = "cast(array() as array<struct<place:int,others:string>>)"


def merkle_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, path) for every row of ``docs``.

    ``tampered`` is the text as a verifier finds it (a Column over ``docs``; by default the text itself): folded_root
    is what its leaf gives with the original proof, and verified tells whether that is the root.
    """
    text = F.col("text")
    leaves = docs.select(
        F.col("doc_id").cast("bigint"),
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),  # null before all names
        leaf_digest(text).alias("leaf"),
        leaf_digest(text if tampered is None else tampered).alias("found"),
    )
    leaves = leaves.withColumn("found", F.when(F.col("found") != F.col("leaf"), F.col("found")))
    nodes = cut_lineage(positions(leaves).withColumnRenamed("leaf", "digest"))
    rest = ["doc_id", "found"]
    levels = levels_of(nodes)
    runs, up = upward(nodes, levels, rest)
    subroots = up[0].filter("n = 1")
    for level in up[1:]:
        subroots = subroots.union(level.filter("n = 1"))
    subroots = cut_lineage(subroots.select(F.col("tree").alias("lang_tree"), F.col("digest").alias("subroot")))
    # the subroots are the leaves of one more tree
    upper = subroots.select(F.lit("").alias("tree"), F.lit(0).cast("bigint").alias("doc_id"), F.concat("lang_tree", F.lit(" "), "subroot").alias("leaf"), "subroot", "lang_tree")
    upper = cut_lineage(positions(upper).select("tree", "idx", "n", F.col("subroot").alias("digest"), "lang_tree"))
    upper_levels = levels_of(upper)
    upper_runs, upper_up = upward(upper, upper_levels, ["lang_tree"])
    start = upper.select("tree").distinct().select("tree", F.expr(NO_PATH).alias("path"))
    if upper_levels:
        above = downward(upper_runs, upper_up, start, ["lang_tree"])
    else:
        above = upper.join(start, "tree")
    top = cut_lineage(above.select(F.col("lang_tree").alias("tree"), F.col("digest").alias("subroot"), "path"))
    root = upper_up[-1].filter("n = 1").select("digest").first()  # one row
    lone = nodes.filter("n = 1").join(top.select("tree", "path"), "tree").select("tree", "idx", "digest", "path", *rest)
    found = lone
    if levels:
        found = downward(runs, up, top.select("tree", "path"), rest).unionByName(lone)
    out = found.join(top.select("tree", "subroot"), "tree").withColumn("root", F.lit(root[0] if root else None).cast("string"))
    out = out.withColumn("folded_root", folded(F.coalesce("found", "digest"), F.col("path")))  # every row is verified, tampered or not
    return out.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(joined(F.col("path.others")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "path",
    )


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return merkle_manifest(table(spark, sf_dir, "documents"), found).drop("path")


def crc_sql(text: str) -> str:
    """CRC-32 of an ASCII text in SQL: eight shifts for each character."""
    shift = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    each = f"list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, i: {shift})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ord(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda crc, b: {each}), 4294967295)"


def _tree_sql(name: str, leaves: str, levels: int) -> list[str]:
    """CTEs of one sweep: {name}0 .. levels hold (tree, idx, digest, n), {name}s0 .. the other digests left and right."""
    out = [f"{name}0 AS ({leaves})"]
    for i in range(levels):
        out.append(
            f"{name}{i + 1} AS (SELECT tree, idx // 8 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest, (any_value(n) + 7) // 8 AS n FROM {name}{i} WHERE n > 1 GROUP BY tree, idx // 8)"
        )
        pick = lambda op: f"coalesce(string_agg(y.digest, '' ORDER BY y.idx) FILTER (WHERE y.idx {op} x.idx), '')"
        out.append(
            f"{name}s{i} AS (SELECT x.tree, x.idx, {pick('<')} AS l, {pick('>')} AS r FROM {name}{i} x JOIN {name}{i} y ON x.tree = y.tree AND x.idx // 8 = y.idx // 8 WHERE x.n > 1 GROUP BY x.tree, x.idx)"
        )
    return out


def op12_sql(levels: int = 6, upper: int = 3) -> str:
    """The same by one join a level; trees of at most 8 ** levels leaves and 8 ** upper langs."""
    enc = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    head = " || ".join(enc(x) for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"))
    ctes = [
        f"""d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({head} || {enc('text')}) AS leaf,
        sha256({head} || {enc(f"translate(text, '{UPPER}', '{LOWER}')")}) AS lower_leaf, doc_id IS NOT NULL AND ({crc_sql('CAST(doc_id AS VARCHAR)')}) % 3 = 0 AS hit FROM documents)""",
        "o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d)",
    ]
    ctes += _tree_sql("t", "SELECT tree, idx, leaf AS digest, n FROM o", levels)
    tops = " UNION ALL ".join(f"SELECT tree, digest FROM t{i} WHERE n = 1" for i in range(levels + 1))
    ctes.append(f"subroots AS (SELECT tree AS lang_tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM ({tops}))")
    ctes += _tree_sql("u", "SELECT '' AS tree, idx, digest, n FROM subroots", upper)
    root = " UNION ALL ".join(f"SELECT digest FROM u{i} WHERE n = 1" for i in range(upper + 1))
    joins, proof, fold = "", [], "CASE WHEN o.hit THEN o.lower_leaf ELSE o.leaf END"
    for name, count, tree, idx in (("t", levels, "o.tree", "o.idx"), ("u", upper, "''", "s.idx")):
        for i in range(count):
            joins += f" LEFT JOIN {name}s{i} ON {name}s{i}.tree = {tree} AND {name}s{i}.idx = {idx} // {8**i}"
            proof.append(f"coalesce({name}s{i}.l || {name}s{i}.r, '')")
    steps = [f"{n}s{i}" for n, c in (("t", levels), ("u", upper)) for i in range(c)]
    shown = ", ".join(f"{x}.l AS {x}_l, {x}.r AS {x}_r" for x in steps)
    ctes.append(
        f"f0 AS (SELECT o.doc_id, o.leaf, s.digest AS subroot, sha256({' || '.join(proof)}) AS proof_sha256, {fold} AS d, {shown} FROM o JOIN subroots s ON s.lang_tree = o.tree{joins})"
    )
    for i, x in enumerate(steps):
        ctes.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN {x}_l IS NULL THEN d ELSE sha256({x}_l || d || {x}_r) END AS d) FROM f{i})")
    return f"""WITH {", ".join(ctes)}
        SELECT doc_id, leaf, subroot, root.digest AS root, proof_sha256, d AS folded_root, d = root.digest AS verified FROM f{len(steps)}, ({root}) root"""
