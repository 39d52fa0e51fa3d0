"""Embedding near-duplicates by int8 tile products with error bounds (operator 3).

Vectors with equal labels are compared by cosine.  Equal vectors of a label are one class first.  A label's classes
are dealt by hash into tiles of about ``tile`` vectors; every pair of tiles of a label is one task's group.  Inside,
unit vectors are quantised to int8 with a scale of their own; the product of two tiles of int8 codes is exact in
float32, and |x·y - x̂·ŷ| <= |ex||ŷ| + |x̂||ey| + |ex||ey| with the measured lengths of the errors.  Pairs that the
bound rules out are done; all others are recomputed in double precision from the stored components.  A group returns,
per vector, how many rows it links to, and a spanning forest of its links: no pairs leave the task.

Null, zero or non-finite vectors, vectors whose length differs from the other's, and null labels link with nothing
(component_id is their own vec_id).  Rows with a null vec_id link with nothing and have a null component, kept true.
Repeated rows under one vec_id are one node; each equal other row counts as a link when its vec_id is another one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.llm.base import components, table
from assaygrid.session import cut_lineage


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit rows, scale, length of the decoded row, upper bound of the error's length."""
    scale = np.abs(x).max(axis=1) / 127
    code = np.rint(x / scale[:, None]).astype(np.int8)
    decoded = code * scale[:, None]
    slack = 1 + 1e-9
    return code, scale, np.linalg.norm(decoded, axis=1) * slack, np.linalg.norm(x - decoded, axis=1) * slack + 1e-12


def tile_links(a: np.ndarray, b: np.ndarray | None, least: float, rows: int = 256):
    """Places (i, j) of the pairs with cosine >= least, block of rows by block; b None: pairs i < j inside a."""
    inside = b is None
    b = a if inside else b
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    qa, sa, la, ea = quantised(a / na[:, None])
    qb, sb, lb, eb = (qa, sa, la, ea) if inside else quantised(b / nb[:, None])
    fb = qb.astype(np.float32).T
    for s in range(0, len(a), rows):
        e = min(s + rows, len(a))
        lo = s if inside else 0
        near = qa[s:e].astype(np.float32) @ fb[:, lo:]  # whole numbers below 2**24: exact
        # scaled in float32: a relative error of a few 2**-24 is inside the margin of 1e-6
        bound = near * sa[s:e, None].astype(np.float32) * sb[None, lo:].astype(np.float32)
        bound += (ea[s:e, None] * lb[None, lo:] + la[s:e, None] * eb[None, lo:] + ea[s:e, None] * eb[None, lo:] + 1e-6).astype(np.float32)
        i, j = np.nonzero(bound >= least)
        i, j = i + s, j + lo
        if inside:
            i, j = i[i < j], j[i < j]
        for c in range(0, len(i), 65536):
            u, v = i[c : c + 65536], j[c : c + 65536]
            ok = np.einsum("ij,ij->i", a[u], b[v]) / (na[u] * nb[v]) >= least
            yield u[ok], v[ok]


def forest(edges: dict[int, int], i: np.ndarray, j: np.ndarray) -> None:
    """Joins the pairs into ``edges`` (parent of each node)."""

    def root(x):
        while (up := edges.get(x, x)) != x:
            edges[x] = x = edges.get(up, up)
        return x

    for x, y in zip(i.tolist(), j.tolist()):
        x, y = root(x), root(y)
        if x != y:
            edges[max(x, y)] = min(x, y)


def embedding_duplicates(rows: DataFrame, least: float = 0.98, tile: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows`` (vec_id, embedding, label)."""
    rows = rows.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("v"), "label")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.filter(usable).withColumn("v", F.transform("v", lambda x: x + 0.0))  # -0.0 equals 0.0
    classes = good.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("m"))
    sizes = classes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    classes = cut_lineage(classes.join(sizes, "label").withColumn("t", F.pmod(F.xxhash64("id", "v"), F.col("tiles")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o")
    dealt = classes.select("label", "id", "m", "v", "t", other).select(
        "label", "id", "m", "v", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), "t"
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out_links, out_to = np.zeros(len(pdf), np.int64), pdf["id"].to_numpy().copy()
        ids, m, t = pdf["id"].to_numpy(), pdf["m"].to_numpy(), pdf["t"].to_numpy()
        length = pdf["v"].map(len).to_numpy()
        for n in np.unique(length):  # only vectors of one length are compared
            use = length == n
            sides = [np.flatnonzero(use & (t == x)) for x in ((pdf["a"].iloc[0], pdf["b"].iloc[0]) if pdf["a"].iloc[0] != pdf["b"].iloc[0] else (pdf["a"].iloc[0],))]
            if any(len(s) == 0 for s in sides):
                continue
            mats = [np.stack(pdf["v"].to_numpy()[s]).astype(float) for s in sides]
            parent: dict[int, int] = {}
            for i, j in tile_links(mats[0], mats[1] if len(mats) > 1 else None, least):
                i, j = sides[0][i], sides[-1][j]
                out_links += np.bincount(i, m[j], len(pdf)).astype(np.int64) + np.bincount(j, m[i], len(pdf)).astype(np.int64)
                forest(parent, i, j)
            for x in list(parent):
                out_to[x] = ids[parent[x]]
        keep = (out_links > 0) | (out_to != ids)
        return pd.DataFrame({"id": ids[keep], "n": out_links[keep], "to": out_to[keep]})

    found = cut_lineage(dealt.groupBy("label", "a", "b").applyInPandas(compare, "id bigint, n bigint, to bigint"))
    # a vec_id with several vectors is one node: it joins the classes of all of them
    several = good.groupBy("vec_id").agg(F.count_distinct(F.xxhash64("label", "v")).alias("k")).filter("k > 1").select("vec_id")
    shared = good.join(several, "vec_id").join(classes.select("label", "v", "id"), ["label", "v"]).select("id", F.col("vec_id").alias("to"))
    comp = components(found.select("id", "to").union(shared).filter("id <> to"), "id", "to")
    # a class: its other members, and the rows of all classes it links to
    named = classes.select("label", F.col("v").alias("v"), "id", "m").join(found.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(
        comp.withColumnRenamed("node", "id"), "id", "left"
    )
    named = named.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    by_class = good.select("vec_id", "label", "v").join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = by_class.unionByName(rest)
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id"))).alias("kept"))


def op3_embedding_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs of a label in SQL, and the links followed to their smallest vec_id.
OP3_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
g AS (SELECT vec_id, v, label, sqrt(list_dot_product(v, v)) AS n FROM e
      WHERE label IS NOT NULL AND v IS NOT NULL AND NOT list_contains(list_transform(v, lambda x: x IS NULL OR NOT isfinite(x)), true)
      AND list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS c FROM e UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a WHERE r.c < l.b),
c AS (SELECT a, min(c) AS component_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN c ON c.a = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""
