"""Language identification with bit-sliced Bloom filters of n-grams (operator 4).

Learning: the byte n-grams (lower-cased A-Z; everything that is no letter is one blank) of at most ``examples`` texts
of each language are counted; an n-gram belongs to each language where its rate is at least ``part`` of its highest
rate; a language keeps its ``grams`` most frequent ones.  All filters stand in one array: a cell holds one bit for
each language, so that the AND of the cells of an n-gram's hashes is the set of all languages that contain it.
Prediction reads the whole text: per language the hits among the text's n-grams are counted and corrected for the
filter's rate of false positives f, (hits - n * f) / (1 - f); the largest wins (then the first by name), its score is
its share of the languages' corrected hits.

Null texts and texts without letters are ``und`` with score 0, as are all texts when nothing was learned.  Null
doc_ids and null languages are never learned from; rows are predicted one by one, repeated ones alike.  The language
of a row, its source and doc_id are no inputs of its prediction.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.llm.base import mix, slices, table, text_bytes
from assaygrid.operators.base import top_k
from assaygrid.session import cut_lineage

LENGTHS = (3, 5)
BLANK = 32
PIECE = 1 << 16  # bytes of text predicted at once: their n-grams stay in the processor's cache


def letter_table() -> np.ndarray:
    out = np.full(256, BLANK, np.uint8)
    for lo, hi in ((97, 122), (128, 255)):
        out[lo : hi + 1] = np.arange(lo, hi + 1)
    out[65:91] = np.arange(97, 123)
    return out


def gram_codes(data: np.ndarray, offs: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of all rows and their rows, in order of rows for each length; runs of blanks count as one."""
    rows = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    b = letters[data]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != BLANK) | (b[:-1] != BLANK) | (rows[1:] != rows[:-1])
    b, rows = b[keep].astype(np.uint64), rows[keep]
    codes, where, x = [], [], b
    for n in range(2, min(max(LENGTHS), len(b)) + 1):  # each length from the one before
        x = (x[:-1] << np.uint64(8)) | b[n - 1 :]
        if n in LENGTHS:
            ok = rows[: len(x)] == rows[n - 1 :]
            codes.append(x[ok] | np.uint64(n << 8 * n))
            where.append(rows[: len(x)][ok])
    return (np.concatenate(codes), np.concatenate(where)) if codes else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


class Filters(NamedTuple):
    langs: list
    cells: np.ndarray  # (cells, bytes): bit l % 8 of byte l // 8 belongs to language l
    hashes: int
    false_rate: np.ndarray

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """(n-grams, bytes): languages that contain each n-gram."""
        h, n = mix(codes), np.uint64(len(self.cells) - 1)
        out = self.cells.take((h & n).view(np.int64), axis=0)
        for _ in range(1, self.hashes):
            h = mix(h + np.uint64(1))
            out &= self.cells.take((h & n).view(np.int64), axis=0)
        return out

    def hits(self, codes: np.ndarray, where: np.ndarray, rows: int) -> np.ndarray:
        """(rows, languages): how many of a row's n-grams each language contains."""
        out = []
        for i, byte in enumerate(self.masks(codes).T):
            bits = min(8, len(self.langs) - 8 * i)
            n = np.bincount((where.astype(np.int64) << bits) | byte, minlength=rows << bits).reshape(rows, -1)  # by the set of languages
            out.append(n @ ((np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1))
        return np.concatenate(out, axis=1)


def build(langs: list, grams: list[np.ndarray], hashes: int = 3) -> Filters:
    """Filters with at least eight cells for each n-gram of the largest language."""
    size = 1 << max(10, int(8 * max([1, *map(len, grams)]) - 1).bit_length())
    f = Filters(langs, np.zeros((size, -(-len(langs) // 8) or 1), np.uint8), hashes, np.zeros(len(langs)))
    for i, g in enumerate(grams):
        h, bit = mix(g), np.uint8(1 << (i % 8))
        for _ in range(hashes):
            np.bitwise_or.at(f.cells[:, i // 8], (h & np.uint64(size - 1)).astype(np.int64), bit)
            h = mix(h + np.uint64(1))
        f.false_rate[i] = np.mean((f.cells[:, i // 8] & bit) != 0) ** hashes
    return f


def fit(docs: DataFrame, examples: int, grams: int, part: float, least: int) -> Filters | None:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    rows = docs.filter(held != 1).filter("lang is not null and text is not null").select("lang", "text")
    rows = rows.withColumn("at", F.xxhash64("text"))
    told = cut_lineage(rows.select("lang", "at").distinct())  # equal texts of a language count once
    sizes = {r.lang: r.n for r in told.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    # exactly the ``examples`` smallest hashes of each language, looked for under a threshold that somewhat more lie below
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, (1.2 * examples + 50) / n))])
    few = told.filter((F.col("at") / 2.0**64 + 0.5) <= share[F.col("lang")])
    few = few.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("at"))).filter(F.col("_n") <= examples).drop("_n")
    rows = rows.join(F.broadcast(few), ["lang", "at"]).dropDuplicates(["lang", "at"]).select("lang", "text")  # ``examples`` hashes a language

    def count(batches):
        letters, held_ = letter_table(), {}
        for batch in batches:
            for piece in slices(batch, "text"):
                names = piece.column("lang").to_pylist()
                codes, where = gram_codes(*text_bytes(piece.column("text")), letters)
                label = np.array([langs.index(x) for x in names])[where] if len(where) else where
                for i in np.unique(label):
                    u, n = np.unique(codes[label == i], return_counts=True)
                    old = held_.get(i)
                    if old is not None:
                        u, at = np.unique(np.concatenate([old[0], u]), return_inverse=True)
                        n = np.bincount(at, np.concatenate([old[1], n])).astype(np.int64)
                    held_[i] = (u, n)
        for i, (u, n) in held_.items():
            for s in range(0, len(u), 100_000):
                e = min(s + 100_000, len(u))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(e - s, i, np.int32)), pa.array(u[s:e].view(np.int64)), pa.array(n[s:e])], ["l", "g", "n"]
                )

    counts = cut_lineage(rows.mapInArrow(count, "l int, g bigint, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n")))
    totals = {r.l: r.n for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    rate = F.col("n") / F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, float(n))])[F.col("l")] if totals else F.lit(0.0)
    rated = counts.withColumn("rate", rate)
    top = rated.groupBy("g").agg(F.max("rate").alias("top"))
    # where a language has fewer texts than ``least``, an n-gram needs only as many occurrences
    need = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (i, min(least, sizes[k]))])[F.col("l")]
    kept = rated.join(top, "g").filter((F.col("n") >= need) & (F.col("rate") >= part * F.col("top")))
    kept = top_k(kept, ["l"], [F.desc("n"), F.col("g")], grams).select("l", "g").toPandas()  # at most ``grams`` for each language
    return build(langs, [kept.g[kept.l == i].to_numpy(np.int64).view(np.uint64) for i in range(len(langs))])


def identify_language(docs: DataFrame, examples: int = 4000, grams: int = 50_000, part: float = 0.3, least: int = 3) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``."""
    filters = fit(docs, examples, grams, part, least)

    def run(batches):
        letters = letter_table()
        for batch in batches:
            all_names, all_scores = [], [np.zeros(0)]
            for piece in slices(batch, "text", PIECE):
                data, offs = text_bytes(piece.column("text"))
                rows = piece.num_rows
                plain = np.concatenate([[0], np.cumsum((letters[data] != BLANK) & (data < 128))])
                some = plain[offs[1:]] > plain[offs[:-1]]
                for i in np.flatnonzero(~some & (np.diff(offs) > 0)):  # letters beyond ASCII only
                    some[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode())
                names, scores = ["und"] * rows, np.zeros(rows)
                if filters is not None and some.any():
                    codes, where = gram_codes(data, offs, letters)
                    n = np.bincount(where, minlength=rows)
                    hits, f = filters.hits(codes, where, rows), filters.false_rate
                    right = np.maximum(0, (hits - n[:, None] * f) / np.maximum(1e-9, 1 - f))
                    best = right.argmax(axis=1)
                    whole = right.sum(axis=1)
                    for i in np.flatnonzero(some):
                        names[i] = filters.langs[best[i]]
                        scores[i] = right[i, best[i]] / whole[i] if whole[i] > 0 else 0.0
                all_names += names
                all_scores.append(scores)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(all_names, pa.string()), pa.array(np.concatenate(all_scores))], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))
