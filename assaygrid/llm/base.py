"""Helpers of the training-data operators: batches of bounded size, hashing of bytes and words, components of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.session import cut_lineage

SLICE_BYTES = 1 << 20  # text handled at once inside a task


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Consecutive parts of a batch with about ``most`` bytes of text each; one longer row is a part of its own."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).cast(pa.int64()))
    if not len(lengths):
        return
    part = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated UTF-8 bytes and the row offsets into them; null counts as empty."""
    col = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply), in place where it can be."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of the words of UTF-8 texts: A-Z lower-cased, words split at ASCII white space.

    One pass of array operations over the bytes: prefix sums of table[byte] * base**i, so that a word's hash is the
    difference of two sums shifted back by base**-start, then mixed with its length.
    """

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        t = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        t[65:91] = t[97:123]
        self.table, self.base = t, int(rng.integers(1, 2**60)) * 8 + 5
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.powers = self.inverse = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, self.base % 2**64, np.uint64)])
                self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(self.base, -1, 2**64), np.uint64)])

    def spans(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of all words; a row's end always ends its last word."""
        word = ~self.space[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        heads = offs[:-1][offs[:-1] < offs[1:]]
        tails = offs[1:][offs[:-1] < offs[1:]] - 1
        first[heads] = word[heads]
        last[tails] = word[tails]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of each word, and each row's offsets into them."""
        starts, ends = self.spans(data, offs)
        return self.hashed(data, starts, ends), starts, ends, np.searchsorted(starts, offs)

    def hashed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the byte spans, given in order; a very long row is hashed in pieces that begin and end between words."""
        self._grow(min(len(data), SLICE_BYTES * 2) + 1)
        out = np.empty(len(starts), np.uint64)
        done = 0
        while done < len(starts):
            lo = starts[done]
            upto = max(done + 1, int(np.searchsorted(ends, lo + SLICE_BYTES, "right")))
            hi = ends[upto - 1]
            self._grow(int(hi - lo) + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(self.table[data[lo:hi]] * self.powers[: hi - lo], out=sums[1:])
            s, e = starts[done:upto] - lo, ends[done:upto] - lo
            out[done:upto] = (sums[e] - sums[s]) * self.inverse[s] + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            done = upto
        return mix(out)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values."""
    acc = h[: max(0, len(h) - k + 1)].copy()
    for j in range(1, k):
        acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + h[j : j + len(acc)])
    return acc


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): smallest node reachable over the links, for nodes that have one.

    Large-star and small-star rounds on the edge table, each written to the shared checkpoint folder; a round keeps
    at most as many edges as there were, and the loop ends when the edge set no longer changes.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = cut_lineage(e)
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = cut_lineage(
            small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .filter("u <> v")
            .distinct()
        )
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
