"""MinHash near-duplicates by a multi-index Hamming join (operator 8).

Signature: ``positions`` min-hash values of a text's shingle set, 16 bits each; the signature distance is the number
of positions that differ.  From the similarity bound follows the distance ``t`` that a linked pair exceeds with
probability below ``miss``; every pair within ``t`` is found: cut into t//2 + 1 chunks, some chunk of such a pair has
at most one differing position (pigeonhole), so each chunk is keyed with every position left out once.

Links are confirmed on full sets.  Texts with the same set are one class.  No bucket emits its pairs.  The buckets
with the same smallest member form one group; its pivot is the member whose buckets hold most members, and groups with
the same pivot are joined.  A member's set meets the pivot's set once; what it lacks and what it has besides is kept,
which is little for near copies and gives the exact overlap of any two members.  Members that are linked to the pivot
are one component; the others are compared with all members of the group, in blocks of about ``TILE`` by ``TILE``
members that are tasks of their own, and a block returns a forest of its links.  So no link is lost, no bucket is
capped, and no task holds a group; the work is quadratic only in the members that their pivot does not link.

Null or blank texts have an empty set and link with nothing.  Rows with a null doc_id link with nothing and have a
null component (kept is true).  Repeated rows are answered row by row; a doc_id that stands for several texts is one
node, linked when any of its texts is.  Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.llm.base import WordHasher, mix, signed, slices, table, text_bytes, windows
from assaygrid.session import cut_lineage

TILE = 512  # members in a row or column of a block
TILE_ITEMS = 500_000  # items in it
LINKS_A_TASK = 100_000


def distance_bound(positions: int, similarity: float, miss: float) -> int:
    """Smallest t with P(more than t of the positions differ) <= miss at this similarity."""
    tail, t = 0.0, positions
    while t > 0:
        tail += comb(positions, t) * (1 - similarity) ** t * similarity ** (positions - t)
        if tail > miss:
            break
        t -= 1
    return t


def shingle_sets(words, data, offs, k: int):
    """For each row the sorted distinct shingle hashes; fewer than k words count as one shingle."""
    h, _, _, at = words(data, offs)
    all_k = windows(h, k)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= k:
            yield np.unique(all_k[a : b - k + 1])
        elif b > a:
            yield mix(windows(h[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def signatures(docs: DataFrame, k: int, positions: int, seed: int = 5) -> DataFrame:
    """(doc_id, n_shingles, set_id, sig): set_id is a 128-bit digest of the set, null for empty sets; sig holds four values a long."""

    def run(batches):
        words = WordHasher()
        rng = np.random.default_rng(seed)
        mul = rng.integers(1, 2**63, (positions, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(1, 2**63, (positions, 1), dtype=np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, ids, sigs = [], [], []
                for s in shingle_sets(words, *text_bytes(part.column("text")), k):
                    sizes.append(len(s))
                    if not len(s):
                        ids.append(None)
                        sigs.append(None)
                        continue
                    low = np.full(positions, 2**64 - 1, np.uint64)
                    for i in range(0, len(s), 4096):
                        low = np.minimum(low, (s[i : i + 4096] * mul + add).min(axis=1))
                    ids.append(np.array([np.sum(mix(s + np.uint64(1))), np.sum(mix(s * np.uint64(3)))], np.uint64).tobytes())
                    sigs.append(mix(low).astype(np.uint16).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_id", "sig"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, set_id binary, sig array<bigint>")


def chunk_keys(sigs: np.ndarray, t: int) -> np.ndarray:
    """Keys of each signature (rows): every chunk with every choice of its allowed number of differing positions left out."""
    n = sigs.shape[1]
    m = min(n, t // 2 + 1)
    wrong = t // m
    cuts = [i * n // m for i in range(m + 1)]
    out, tag = [], 0
    for a, b in zip(cuts, cuts[1:]):
        for gone in combinations(range(a, b), min(wrong, b - a - 1)):
            tag += 1
            key = np.full(len(sigs), tag, np.uint64)
            for j in range(a, b):
                if j not in gone:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sigs[:, j].astype(np.uint64) + np.uint64(1))
            out.append(key)
    return np.stack(out, axis=1)


def bucket_members(reps: DataFrame, positions: int, t: int) -> DataFrame:
    """(key, id): one row for each class and key."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                sigs = np.asarray(part.column("sig").flatten()).view(np.uint16).reshape(-1, positions)
                keys = chunk_keys(sigs, t)
                ids = np.repeat(np.asarray(part.column("id")), keys.shape[1])
                yield pa.RecordBatch.from_arrays([signed(keys.ravel()), pa.array(ids)], ["key", "id"])

    return reps.select("id", "sig").mapInArrow(run, "key bigint, id bigint")


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, items): shingle sets of the named documents, one for each text of a document."""

    def run(batches):
        words = WordHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [signed(s) for s in shingle_sets(words, *text_bytes(part.column("text")), k)]
                offs = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.concat_arrays([pa.array([], pa.int64()), *sets]))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "items"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(ids, "id", "left_semi")
    once = rows.withColumn("_h", F.xxhash64("text")).dropDuplicates(["id", "_h"]).select("id", "text")
    return once.mapInArrow(run, "id bigint, items array<bigint>")


def pivot_groups(classes: DataFrame, positions: int, t: int) -> DataFrame:
    """(p, id): each member of a bucket with the pivot of the bucket's group."""
    members = bucket_members(classes, positions, t)
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("r")).filter("size > 1")
    near = members.join(buckets, "key").groupBy("r", "id").agg(F.sum("size").alias("size"))
    near = cut_lineage(near)
    pivots = near.groupBy("r").agg(F.max(F.struct("size", -F.col("id"))).alias("x")).select("r", (-F.col("x.col2")).alias("p"))
    return near.join(pivots, "r").select("p", "id").distinct()


def against_pivot(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(p, id, size, base, lacks, extra): items of the pivot's set (``base`` of them) that a member lacks, and its others."""
    own = groups.join(sets.select("id", F.col("items").alias("x")), "id")
    # a document with several texts is a pivot by one of them: any set will do to tell two members' overlap
    pivots = groups.select(F.col("p").alias("id")).distinct().join(sets, "id").groupBy(F.col("id").alias("p")).agg(F.min("items").alias("y"))
    both = own.join(pivots, "p")
    return both.select("p", "id", F.size("x").alias("size"), F.size("y").alias("base"), F.array_except("y", "x").alias("lacks"), F.array_except("x", "y").alias("extra"))


def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many items each list of ``a`` has in common with each of ``b``."""
    flat_a, flat_b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)
    rows_a, rows_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    keep_a, keep_b = np.isin(flat_a, both), np.isin(flat_b, both)
    at_a, at_b = np.searchsorted(both, flat_a[keep_a]), np.searchsorted(both, flat_b[keep_b])
    rows_a, rows_b = rows_a[keep_a], rows_b[keep_b]
    for lo in range(0, len(both), 2048):  # columns of a bounded number of items at once
        in_a, in_b = (at_a >= lo) & (at_a < lo + 2048), (at_b >= lo) & (at_b < lo + 2048)
        width = min(2048, len(both) - lo)
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        x[rows_a[in_a], at_a[in_a] - lo] = 1
        y[rows_b[in_b], at_b[in_b] - lo] = 1
        out += x @ y.T
    return out


def forest(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the nodes ``a`` (rows) and ``b`` (columns) with the components of the links."""
    some = linked.any(1)
    linked, a = linked[some], a[some]
    b_names, back = np.unique(b, return_inverse=True)
    left, right = a.copy(), b_names.copy()
    if not len(a):
        return a, a
    twice = np.flatnonzero(np.isin(a, b_names))  # nodes that stand on both sides
    place = np.searchsorted(b_names, a[twice])
    while True:
        low = np.where(linked, right[back], np.iinfo(np.int64).max)
        new = np.minimum(left, low.min(1))
        high = np.where(linked, new[:, None], np.iinfo(np.int64).max).min(0)
        column = right.copy()
        np.minimum.at(column, back, high)
        new[twice] = np.minimum(new[twice], column[place])
        np.minimum.at(column, place, new[twice])
        if np.array_equal(new, left) and np.array_equal(column, right):
            break
        left, right = new, column
    nodes, roots = np.concatenate([a, b_names]), np.concatenate([left, right])
    moved = nodes != roots
    return nodes[moved], roots[moved]


def block_links(star: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members that the pivot does not link and the other members of their group."""
    tiles = lambda n: F.ceil(F.col(n) / TILE)
    weight = (F.size("lacks") + F.size("extra") + 50).cast("bigint")  # a tile is bounded in items, too
    star = star.filter("id <> p or size(lacks) > 0 or size(extra) > 0")  # all but the pivot by its own set
    counts = star.groupBy("p").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col("near"), 1).otherwise(0)).alias("n_apart"),
        F.sum(weight).alias("w"), F.sum(F.when(~F.col("near"), weight).otherwise(F.lit(0))).alias("w_apart"),
    )
    counts = counts.filter("n_apart > 0 and n > 1")
    parts = lambda n, w: F.greatest(tiles(n), F.ceil(F.col(w) / TILE_ITEMS)).cast("int")
    counts = counts.select("p", parts("n", "w").alias("cols"), parts("n_apart", "w_apart").alias("rows"))
    m = star.join(counts, "p")
    shown = ["p", "id", "size", "base", "lacks", "extra", "near"]
    tile = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = m.filter("not near").select(*shown, F.lit(True).alias("row"), tile("rows").alias("i"), every("cols").alias("j"))
    col = m.select(*shown, F.lit(False).alias("row"), tile("cols").alias("j"), every("rows").alias("i"))

    def compare(t: pa.Table) -> pa.Table:
        row = np.asarray(t.column("row").combine_chunks().to_numpy(zero_copy_only=False), bool)
        get = lambda c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        ids, size, near, base = get("id"), get("size").astype(np.int64), get("near").astype(bool), int(get("base")[0]) if t.num_rows else 0
        lists = {c: [np.asarray(x, np.int64) for x in get(c)] for c in ("lacks", "extra")}
        r, c = np.flatnonzero(row), np.flatnonzero(~row)
        if not len(r) or not len(c):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        pick = lambda name, at: [lists[name][k] for k in at]
        short = lambda at: np.array([len(x) for x in pick("lacks", at)])
        # |u & w| = |p| - |u lacks| - |w lacks| + lacked by both + extra in both
        both = base - short(r)[:, None] - short(c)[None, :] + shared(pick("lacks", r), pick("lacks", c)) + shared(pick("extra", r), pick("extra", c))
        both = np.rint(both).astype(np.int64)
        linked = (100 * both >= percent * (size[r][:, None] + size[c][None, :] - both)) & (ids[r][:, None] != ids[c][None, :])
        pivot = int(get("p")[0])
        a, b = forest(linked, ids[r], np.where(near[c], pivot, ids[c]))  # what the pivot links is one node already
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return row.unionByName(col).groupBy("p", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def joined_components(links: DataFrame) -> DataFrame:
    """(node, component) as ``components`` gives, every exchange cut to the number of links left."""
    sized = lambda df, n, key: df.repartition(max(1, n // LINKS_A_TASK), key)
    e = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"))
    n, seen = e.count(), None
    while True:
        both = sized(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), n, "u")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = sized(large, n, "u").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        small = large.join(low, "u").select(pairs.alias("x")).select("x.u", "x.v").filter("u <> v")
        e = cut_lineage(sized(small, n, "u").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, n = now, now[0]
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, positions: int = 64, miss: float = 1e-8
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked when 100 * |A ∩ B| >= percent * |A ∪ B| over their sets of ``shingle`` consecutive words.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    t = distance_bound(positions, percent / 100, miss)
    sig = cut_lineage(signatures(docs, shingle, positions))
    named = sig.filter("set_id is not null and doc_id is not null")
    classes = cut_lineage(named.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig")))
    groups = cut_lineage(pivot_groups(classes, positions, t))
    sets = full_sets(docs, groups.select("id").distinct(), shingle)
    star = against_pivot(groups, cut_lineage(sets))
    both = F.col("base") - F.size("lacks")
    star = cut_lineage(star.withColumn("near", (F.col("id") == F.col("p")) | (both * 100 >= (F.col("size") + F.col("base") - both) * percent)))
    links = star.filter("near and id <> p").select(F.col("id").alias("a"), F.col("p").alias("b")).union(block_links(star, percent))
    comp = joined_components(links)
    named = classes.join(comp.withColumnRenamed("node", "id"), "id", "left").select("set_id", F.coalesce("component", "id").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    cid = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), (F.col("doc_id").isNull() | (cid == F.col("doc_id"))).alias("kept"))


def op8_minhash_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
