"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index (operator 6).

Fit, on a bounded sample of labelled rows (``examples`` of each label, the smallest hashes of their texts; equal
texts count once): terms (words and word beginnings) whose document frequency differs between the labels (chi-square above ``chi`` and a ratio
of ``lift`` or more, the ``terms`` strongest), their inverse document frequencies, and the examples' unit TF-IDF
vectors over them.  Scoring reads every word of every text.  A text without any such term has the rate of label 1
among the examples without one.  Any other text takes its ``near`` nearest examples by exact cosine: blocks of
examples are visited by falling upper bound (query weights times block maxima) until no unseen block can change the
nearest ones.  Votes weigh 1 / (1 - cosine + 0.05) times the label's sampling weight; isotonic curves fitted on the
examples' own leave-one-out votes, one over all and one for each number of words with a term, averaged, turn the vote
into the score.

Nulls and empty texts score like any text without terms.  Without labelled rows the score is 0; with one label only
it is that label's.  Rows with a null doc_id are scored like others and are never learned from.  Repeated rows are
scored row by row; a labelled doc_id repeated with conflicting labels teaches both.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.llm.base import WordHasher, mix, slices, table, text_bytes
from assaygrid.session import cut_lineage

BLOCK = 64
MANY = 4


PREFIXES = (4, 5, 6)  # bytes of word beginnings that are terms besides whole words


class TermHasher(WordHasher):
    """Terms of texts: words, which end at ASCII white space and punctuation, and the beginnings of longer words."""

    def __init__(self):
        super().__init__(seed=6)
        self.space[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True

    def terms(self, data, offs):
        """Hashes, starts, ends and rows (in order) of all terms; a beginning's hash differs from the same word's."""
        h, starts, ends, at = self(data, offs)
        row = np.repeat(np.arange(len(offs) - 1), np.diff(at))
        parts = [(h, starts, ends, row)]
        for n in PREFIXES:
            longer = np.flatnonzero(ends - starts > n)
            s = starts[longer]
            parts.append((mix(self.hashed(data, s, s + n) + np.uint64(n)), s, s + n, row[longer]))
        h, starts, ends, row = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(row, kind="stable")
        return h[order], starts[order], ends[order], row[order]


def sieve(hashes: np.ndarray) -> np.ndarray:
    """Table over the first 16 bits of the hashes."""
    out = np.zeros(1 << 16, bool)
    out[(hashes >> np.uint64(48)).astype(np.int64)] = True
    return out


def wanted(h: np.ndarray, hashes: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """Places of the hashes that are among the sorted ``hashes``."""
    may = np.flatnonzero(table_[(h >> np.uint64(48)).astype(np.int64)])
    return may[hashes[np.minimum(np.searchsorted(hashes, h[may]), len(hashes) - 1)] == h[may]]


class Index(NamedTuple):
    """Examples with at least one term, as an inverted index in blocks of BLOCK examples."""

    ids: np.ndarray  # doc_id of each example
    label: np.ndarray
    weight: np.ndarray  # how many labelled rows of its label an example stands for
    hashes: np.ndarray  # sorted term hashes
    names: list
    idf: np.ndarray
    begin: np.ndarray  # (terms, blocks + 1): postings of a term in a block
    doc: np.ndarray  # example of each posting
    val: np.ndarray  # its unit-vector weight
    most: np.ndarray  # (terms, blocks): largest weight in the block
    blank: float  # score of a text without terms
    kind: np.ndarray  # bytes of a term that is a word's beginning, 0 for a whole word
    curves: list  # (vote, score) of the isotonic fit, by how many words of a text have a term


def nearest(ix: Index, terms: np.ndarray, q: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest examples (cosine, then position) and their cosines; ``but`` is left out."""
    bound = q @ ix.most[terms]
    best, cos = np.zeros(0, np.int64), np.zeros(0)
    for b in np.argsort(-bound, kind="stable"):
        if bound[b] <= 0 or len(cos) == k and bound[b] < cos[-1] - 1e-12:
            break
        acc = np.zeros(BLOCK)
        for t, w in zip(terms, q):
            s, e = ix.begin[t, b], ix.begin[t, b + 1]
            acc[ix.doc[s:e] - b * BLOCK] += w * ix.val[s:e]
        got = np.flatnonzero(acc > 0)
        got = got[got + b * BLOCK != but]
        best, cos = np.concatenate([best, got + b * BLOCK]), np.concatenate([cos, acc[got]])
        order = np.lexsort((best, -np.round(cos, 12)))[:k]
        best, cos = best[order], cos[order]
    return best, cos


def vote(ix: Index, best: np.ndarray, cos: np.ndarray) -> float:
    w = ix.weight[best] / (1.05 - np.minimum(cos, 1.0))
    return float(np.sum(w * ix.label[best]) / np.sum(w)) if len(best) else ix.blank


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit by pooling neighbours: (x, fitted value) at the pooled means."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order:
        pools.append([w[i] * x[i], w[i] * y[i], w[i]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            a = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], a)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def hits(kind: np.ndarray, n: np.ndarray) -> int:
    """How many words of a text have a term, up to MANY."""
    return min(MANY, int(max(n[kind == k].sum() for k in (0, *PREFIXES))))


def unit(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(tf)) * idf
    return v / np.sqrt(np.sum(v * v))


def term_rows(rows: DataFrame, columns: str) -> DataFrame:
    """``columns`` of ``rows`` and the distinct terms of its text with their counts; a beginning is shown with a ``*``."""
    names = [c.split()[0] for c in columns.split(", ")]
    kind = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32()), ("word", pa.string())]))

    def run(batches):
        words = TermHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                data, offs = text_bytes(part.column("text"))
                h, starts, ends, row = words.terms(data, offs)
                whole = np.concatenate([ends < len(data), [False]])[: len(ends)]
                whole &= ~words.space[data[np.minimum(ends, len(data) - 1)]] & ~np.isin(ends, offs)
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                out = []
                for a, b in zip(at[:-1], at[1:]):
                    u, first, n = np.unique(h[a:b], return_index=True, return_counts=True)
                    out.append([
                        {"h": int(x), "n": int(c), "word": data[starts[i] : ends[i]].tobytes().decode("utf8", "replace").lower() + "*" * int(whole[i])}
                        for x, c, i in zip(u.view(np.int64), n, first + a)
                    ])
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(out, kind)], [*names, "words"])

    return rows.select(*names, "text").mapInArrow(run, f"{columns}, words array<struct<h:bigint,n:int,word:string>>")


def fit(docs: DataFrame, labels: DataFrame, examples: int, terms: int, chi: float, lift: float, near: int) -> Index | float:
    """The index, or the score of all texts when the labels teach nothing."""
    known = labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int").alias("y")).filter("y in (0, 1)")
    known = known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0).distinct()
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).withColumn("at", F.xxhash64("text"))
    # labels meet hashes of texts, not texts; equal texts of a label are one
    told = cut_lineage(rows.select("doc_id", "at").join(known, "doc_id").groupBy("y", "at").agg(F.min("doc_id").alias("doc_id")))
    totals = {r.y: r.n for r in told.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return float(next(iter(totals), 0))
    # first the hashes below a threshold that some more than ``examples`` of a label lie under, then exactly the smallest
    share = F.when(F.col("y") == 1, min(1.0, 1.2 * examples / totals[1] + 50 / totals[1])).otherwise(min(1.0, 1.2 * examples / totals[0] + 50 / totals[0]))
    few = told.filter((F.col("at") / 2.0**64 + 0.5) <= share)
    few = few.withColumn("_n", F.row_number().over(Window.partitionBy("y").orderBy("at"))).filter(F.col("_n") <= examples).drop("_n")
    # at most 2 * examples rows go to every task
    found = cut_lineage(term_rows(rows.join(F.broadcast(few), ["doc_id", "at"]), "doc_id bigint, y int, at bigint").dropDuplicates(["doc_id", "y", "at"]))
    n = {r.y: r.n for r in found.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    df = found.select("y", F.explode("words").alias("w")).groupBy("w.h").agg(
        F.sum("y").cast("double").alias("d1"), F.sum(1 - F.col("y")).cast("double").alias("d0"), F.min("w.word").alias("word")
    )
    a, b = F.col("d1"), F.col("d0")
    c, d = n1 - a, n0 - b
    chi2 = F.pow(a * d - b * c, F.lit(2)) * (n1 + n0) / ((a + b) * (c + d + 1e-9) * n1 * n0)
    ratio = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
    vocab = df.withColumn("chi", chi2).filter(F.col("chi") >= chi).filter((ratio >= lift) | (ratio <= 1 / lift))
    vocab = vocab.orderBy(F.desc("chi"), "h").limit(terms).collect()  # at most ``terms`` rows
    scale = np.array([totals[0] / n0, totals[1] / n1])
    if not vocab:
        return totals[1] / (totals[0] + totals[1])
    hs = np.array([r.h for r in vocab], np.int64).view(np.uint64)
    order = np.argsort(hs)
    hs, names = hs[order], [vocab[i].word for i in order]
    idf = np.log((n1 + n0 + 1) / (np.array([vocab[i].d1 + vocab[i].d0 for i in order]) + 1)) + 1
    pick = F.filter("words", lambda w: w["h"].isin([r.h for r in vocab]))
    sample = found.select("doc_id", "y", "at", pick.alias("words")).orderBy("at").collect()  # at most 2 * examples rows of at most ``terms`` words
    blank = [r.y for r in sample if not r.words]
    rest = [r for r in sample if r.words]
    w_blank = sum(scale[y] for y in blank)
    p_blank = (sum(scale[y] for y in blank if y) + 0.5 * totals[1] / (totals[0] + totals[1])) / (w_blank + 0.5)
    vecs = []
    for r in rest:
        t = np.searchsorted(hs, np.array([w.h for w in r.words], np.int64).view(np.uint64))
        vecs.append((t, unit(np.array([w.n for w in r.words], float), idf[t])))
    if not vecs:
        return float(p_blank)
    # similar examples stand in the same block: order by strongest term
    by = sorted(range(len(vecs)), key=lambda i: (int(vecs[i][0][np.argmax(vecs[i][1])]), len(vecs[i][0]), rest[i]["at"]))
    rest, vecs = [rest[i] for i in by], [vecs[i] for i in by]
    term = np.concatenate([v[0] for v in vecs])
    doc = np.repeat(np.arange(len(vecs)), [len(v[0]) for v in vecs])
    val = np.concatenate([v[1] for v in vecs])
    o = np.lexsort((doc, term))
    term, doc, val = term[o], doc[o], val[o]
    blocks = -(-len(vecs) // BLOCK)
    begin = np.stack([np.searchsorted(term * (blocks + 1) + doc // BLOCK, t * (blocks + 1) + np.arange(blocks + 1)) for t in range(len(hs))])
    most = np.zeros((len(hs), blocks))
    np.maximum.at(most, (term, doc // BLOCK), val)
    label = np.array([r.y for r in rest], float)
    kind = np.array([len(x[:-1].encode()) if x[-1] == "*" else 0 for x in names])
    weight = scale[label.astype(int)]
    ix = Index(np.array([r.doc_id for r in rest]), label, weight, hs, names, idf, begin, doc, val, most, float(p_blank), kind, [])
    own = np.array([vote(ix, *nearest(ix, t, v, near, but=i)) for i, (t, v) in enumerate(vecs)])
    many = np.array([hits(kind[t], np.array([w.n for w in r.words])) for (t, _), r in zip(vecs, rest)])
    everyone = np.ones(len(many), bool)
    for m in range(MANY + 1):
        use = many == m
        use = use if 0 < label[use].sum() < use.sum() else everyone
        # one more example of either label at its end of the scale keeps small fits away from 0 and 1
        ends = lambda x, a, b: np.r_[a, x, b]
        fits = [isotonic(ends(own[u], 0.0, 1.0), ends(label[u], 0.0, 1.0), ends(weight[u], 1.0, 1.0)) for u in (use, everyone)]
        grid = np.linspace(0, 1, 201)
        ix.curves.append((grid, sum(np.interp(grid, *f) for f in fits) / 2))
    return ix


def score_toxicity(
    docs: DataFrame, labels: DataFrame, examples: int = 3000, terms: int = 2000, chi: float = 30.0, lift: float = 4.0, near: int = 15, row: bool = False
) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, words) for every row of ``docs``; with ``row`` its columns as struct ``row``.

    evidence: doc_id, cosine and label of the nearest examples; words: the terms they share with the text's vector.
    """
    ix = fit(docs, labels, examples, terms, chi, lift, near)
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches):
        words = TermHasher()
        known = sieve(ix.hashes) if isinstance(ix, Index) else None
        for batch in batches:
            for part in slices(batch, "text"):
                hit, cuts = np.zeros(0, int), np.zeros(part.num_rows + 1, int)
                if known is not None:
                    h, _, _, row = words.terms(*text_bytes(part.column("text")))
                    hit = wanted(h, ix.hashes, known)
                    cuts = np.searchsorted(row[hit], np.arange(part.num_rows + 1))
                scores, near_to, shown = [], [], []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if a == b:
                        scores.append(ix.blank if isinstance(ix, Index) else ix)
                        near_to.append([])
                        shown.append([])
                        continue
                    t, n = np.unique(np.searchsorted(ix.hashes, h[hit[a:b]]), return_counts=True)
                    best, cos = nearest(ix, t, unit(n.astype(float), ix.idf[t]), near)
                    scores.append(float(np.interp(vote(ix, best, cos), *ix.curves[hits(ix.kind[t], n)])))
                    near_to.append([{"doc_id": int(ix.ids[i]), "cosine": float(c), "toxic": int(ix.label[i])} for i, c in zip(best[:3], cos[:3])])
                    shown.append([ix.names[i] for i in t])
                score = np.clip(np.array(scores, float), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(near_to, evidence), pa.array(shown, pa.list_(pa.string())), *[part.column(c) for c in beside]],
                    ["doc_id", "score", "predicted", "evidence", "words", *beside],
                )

    beside = ["row"] if row else []
    read = docs.select(F.col("doc_id").cast("bigint"), "text", *([F.struct(*docs.columns).alias("row")] if row else []))
    kinds = "doc_id bigint, score double, predicted int, evidence array<struct<doc_id:bigint,cosine:double,toxic:int>>, words array<string>"
    out = read.mapInArrow(run, kinds + (f", row {read.schema['row'].dataType.simpleString()}" if row else ""))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted", "evidence", "words", *beside)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
