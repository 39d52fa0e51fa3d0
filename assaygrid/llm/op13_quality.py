"""Document quality by attention-based multiple-instance learning (operator 13).

A document is a bag of passages of ``PASSAGE`` bytes; only the bag has a label.  A passage is described by the square
roots of the shares of its neighbouring byte classes and of hashed, lower-cased byte trigrams, and by how uneven these
shares are (repeated words).  An encoder
h = tanh(x W + b) and gated attention a = softmax over the passages of w . (tanh(h V) * sigmoid(h U)) give the
weighted representation z = sum a h, and sigmoid(z c + d) is the score; encoder, attention and classifier are learned
together from the document labels.

Fit on a bounded sample: of each label the labelled texts with the smallest hashes (equal texts count once), at most
``examples`` of them with at most ``passages`` passages in all; texts of more than a tenth of ``passages`` are scored
but not learned from.  A label's examples weigh what its rows weigh.  Scoring reads every passage of every text; a
text above a slice is read slice by slice with running attention sums.

Null and empty texts are one passage without content and scored like any other.  Without labelled rows the score is
0; with one label only it is that label's.  Rows with a null doc_id are scored and never learned from.  Repeated rows
are scored row by row; a doc_id with both labels teaches both.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.llm.base import SLICE_BYTES, slices, table, text_bytes
from assaygrid.session import cut_lineage

PASSAGE = 512
CLASSES, BUCKETS = 16, 256
FEATURES = CLASSES * CLASSES + BUCKETS + 4
HIDDEN, GATE = 32, 16


def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-cased value of every byte: letters by case, digits, blanks, frequent marks, other marks, non-ASCII."""
    kind = np.full(256, 12, np.int64)
    for i, group in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\v\f", b".", b",;:", b"!?", b"'\"`", b"()[]{}<>", b"-_/\\|", b"#$%&*+=@^~"]):
        kind[list(group)] = i
    kind[128:192], kind[192:] = 13, 14
    lower = np.arange(256)
    lower[65:91] += 32
    return kind, lower


class Passages:
    """Features of the passages of texts."""

    def __init__(self):
        self.kind, self.lower = byte_tables()

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features as bytes: 255 is 1, first passage of each text and the end); an empty text has one empty passage."""
        lengths = np.diff(offs)
        count = np.maximum(1, -(-lengths // PASSAGE))
        at = np.r_[0, np.cumsum(count)]
        within = np.arange(len(data)) - np.repeat(offs[:-1], lengths)
        passage = np.repeat(at[:-1], lengths) + within // PASSAGE
        n = at[-1]
        kind, low = self.kind[data], self.lower[data]
        pair, three = within >= 1, within >= 2
        one = kind[:-1] * CLASSES + kind[1:]
        two = ((low[:-2] * 31 + low[1:-1]) * 31 + low[2:]) * 40503 >> 4 & BUCKETS - 1
        p1, p2 = passage[1:][pair[1:]], passage[2:][three[2:]]
        size = np.maximum(1, np.bincount(passage, minlength=n))[:, None]
        pairs = np.bincount(p1 * CLASSES * CLASSES + one[pair[1:]], minlength=n * CLASSES * CLASSES).reshape(n, -1) / size
        grams = np.bincount(p2 * BUCKETS + two[three[2:]], minlength=n * BUCKETS).reshape(n, -1) / size
        uneven = [(pairs**2).sum(1), (grams**2).sum(1) * 4, grams.max(1), np.count_nonzero(grams, axis=1) ** 2 / np.minimum(size[:, 0], BUCKETS) ** 2]
        shares = np.concatenate([pairs, grams, np.stack(uneven, axis=1)], axis=1)
        return np.rint(255 * np.sqrt(np.minimum(1, shares))).astype(np.uint8), at


class Network(NamedTuple):
    enc: np.ndarray
    enc_bias: np.ndarray
    gate_v: np.ndarray
    gate_u: np.ndarray
    gate_w: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def start_weights(seed: int) -> Network:
    rng = np.random.default_rng(seed)
    scaled = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b)).astype(np.float32)
    zeros = lambda n: np.zeros(n, np.float32)
    enc = scaled(FEATURES, HIDDEN) * np.float32(3)
    return Network(enc, zeros(HIDDEN), scaled(HIDDEN, GATE), scaled(HIDDEN, GATE), scaled(GATE, 1)[:, 0], scaled(HIDDEN, 1)[:, 0], zeros(1))


def encoded(net: Network, x: np.ndarray):
    """Encoded passages with the two gate activations and the attention logits."""
    h = np.tanh(x @ net.enc + net.enc_bias)
    tv, su = np.tanh(h @ net.gate_v), sigmoid(h @ net.gate_u)
    return h, tv, su, (tv * su) @ net.gate_w


def gradients(net: Network, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Network:
    """Gradients of the weighted mean log loss over bags at[i]:at[i + 1]."""
    h, tv, su, e = encoded(net, x)
    bag = np.repeat(np.arange(len(y)), np.diff(at))
    ex = np.exp(e - np.maximum.reduceat(e, at[:-1])[bag])
    a = ex / np.add.reduceat(ex, at[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, at[:-1], axis=0)
    ds = ((sigmoid(z @ net.out + net.bias[0]) - y) * weight / weight.sum()).astype(np.float32)
    dz = ds[:, None] * net.out
    da = np.sum(h * dz[bag], axis=1)
    de = a * (da - np.add.reduceat(a * da, at[:-1])[bag])
    dt = de[:, None] * net.gate_w
    dv, du = dt * su * (1 - tv * tv), dt * tv * su * (1 - su)
    dh = a[:, None] * dz[bag] + dv @ net.gate_v.T + du @ net.gate_u.T
    dx = dh * (1 - h * h)
    return Network(x.T @ dx, dx.sum(0), h.T @ dv, h.T @ du, (tv * su).T @ de, z.T @ ds, ds.sum(keepdims=True))


def train(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, steps: int, batch: int = 64, rate: float = 0.005, decay: float = 3e-4) -> Network:
    """Adam with a falling rate over shuffled batches of bags; the same input gives the same network."""
    net, rng = start_weights(13), np.random.default_rng(13)
    first = [np.zeros_like(w) for w in net]
    second = [np.zeros_like(w) for w in net]
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if not len(order):
            order = rng.permutation(len(bags))
        part, order = order[:batch], order[batch:]
        x = np.concatenate([bags[j] for j in part]).astype(np.float32) / 255
        at = np.r_[0, np.cumsum([len(bags[j]) for j in part])]
        now = rate * (1 - step / (steps + 1))
        new = []
        for k, (w, g) in enumerate(zip(net, gradients(net, x, at, y[part], weight[part]))):
            g = g + decay * w
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            new.append((w - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
        net = Network(*new)
    return net


def sample_of(docs: DataFrame, labels: DataFrame, examples: int, passages: int) -> tuple[DataFrame | None, dict[int, int]]:
    """(doc_id, y, bag: features of all passages) of the examples, and the number of labelled texts of each label."""
    known = labels.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1)")
    known = known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0).distinct()
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).withColumn("at", F.xxhash64("text"))
    size = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE)).alias("size")
    # labels meet hashes of texts, not texts; equal texts of a label are one
    told = cut_lineage(rows.select("doc_id", "at", size).join(known, "doc_id").groupBy("y", "at").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size")))
    totals = {r.y: r.n for r in told.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return None, totals
    # first the hashes below a threshold that some more than ``examples`` of a label lie under, then exactly the smallest
    under = lambda y: min(1.0, (1.2 * examples + 50) / totals[y])
    few = told.filter((F.col("at") / 2.0**64 + 0.5) <= F.when(F.col("y") == 1, under(1)).otherwise(under(0))).filter(F.col("size") <= passages / 10)
    order = Window.partitionBy("y").orderBy("at", "doc_id")
    few = few.withColumn("_n", F.row_number().over(order)).withColumn("_s", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    few = few.filter((F.col("_n") <= examples) & (F.col("_s") <= passages)).select("y", "at", "doc_id")

    def run(batches):
        encode = Passages()
        for batch in batches:
            for part in slices(batch, "text"):
                x, at = encode(*text_bytes(part.column("text")))
                bags = [x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("at"), part.column("y"), pa.array(bags, pa.binary())], ["doc_id", "at", "y", "bag"])

    # at most 2 * examples rows go to every task
    chosen = rows.join(F.broadcast(few), ["doc_id", "at"]).select("doc_id", "at", "y", "text")
    return chosen.mapInArrow(run, "doc_id bigint, at bigint, y int, bag binary").dropDuplicates(["doc_id", "at", "y"]), totals


def fit(docs: DataFrame, labels: DataFrame, examples: int, passages: int, steps: int) -> Network | float:
    """The network, or the score of all texts when the labels teach nothing."""
    sample, totals = sample_of(docs, labels, examples, passages)
    rows = [] if sample is None else sorted(sample.collect(), key=lambda r: (r.at, r.y, r.doc_id))  # at most 2 * examples rows
    n = {y: sum(r.y == y for r in rows) for y in (0, 1)}
    if not n[0] or not n[1]:
        return totals.get(1, 0) / max(1, sum(totals.values()))
    y = np.array([r.y for r in rows], np.float32)
    weight = np.where(y == 1, totals[1] / n[1], totals[0] / n[0]).astype(np.float32)
    return train([np.frombuffer(r.bag, np.uint8).reshape(-1, FEATURES) for r in rows], y, weight / weight.mean(), steps)


def score_bags(net: Network, encode: Passages, data: np.ndarray, offs: np.ndarray):
    """(score, passages, start of the passage with most attention, its weight) of each text.

    Texts are read in slices; each keeps the running maximum of its logits and the sums scaled to it.
    """
    n = len(offs) - 1
    best, total, top = np.full(n, -np.inf), np.zeros(n), np.zeros(n, np.int64)
    z, count = np.zeros((n, HIDDEN)), np.zeros(n, np.int64)
    begin = 0
    for begin in range(0, max(1, int(np.max(np.diff(offs), initial=0))), SLICE_BYTES):
        live = np.flatnonzero((np.diff(offs) > begin) | (begin == 0))
        lo, hi = offs[:-1][live] + begin, np.minimum(offs[1:][live], offs[:-1][live] + begin + SLICE_BYTES)
        piece = data if begin == 0 and len(live) == n and np.all(hi == offs[1:]) else np.concatenate([data[a:b] for a, b in zip(lo, hi)])
        x, at = encode(piece, np.r_[0, np.cumsum(hi - lo)])
        bag = np.repeat(np.arange(len(live)), np.diff(at))
        h, _, _, e = encoded(net, x.astype(np.float32) / 255)
        high = np.maximum.reduceat(e, at[:-1])
        first = np.full(len(live), len(e))
        peak = np.flatnonzero(e == high[bag])
        np.minimum.at(first, bag[peak], peak)
        now = np.maximum(best[live], high)
        old = np.exp(best[live] - now)
        ex = np.exp(e - now[bag])
        top[live] = np.where(high > best[live], (first - at[:-1]) * PASSAGE + begin, top[live])
        total[live] = total[live] * old + np.add.reduceat(ex, at[:-1])
        z[live] = z[live] * old[:, None] + np.add.reduceat(ex[:, None] * h, at[:-1], axis=0)
        count[live] += np.diff(at)
        best[live] = now
    return sigmoid(z / total[:, None] @ net.out + net.bias[0]), count, top, 1 / total


def score_quality(docs: DataFrame, labels: DataFrame, examples: int = 2500, passages: int = 30_000, steps: int = 1000, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, top_start, top_weight) for every row of ``docs``.

    top_start is the byte at which the passage with most attention begins, top_weight that attention.
    """
    net = fit(docs, labels, examples, passages, steps)

    def run(batches):
        encode = Passages()
        for batch in batches:
            for part in slices(batch, "text"):
                data, offs = text_bytes(part.column("text"))
                if isinstance(net, Network):
                    score, count, top, weight = score_bags(net, encode, data, offs)
                else:
                    count = np.maximum(1, -(-np.diff(offs) // PASSAGE))
                    score, top, weight = np.full(len(count), net), np.zeros(len(count), np.int64), 1 / count
                # sums depend on a text's neighbours in the last digits of single precision; rounded, equal texts score alike
                score, weight = np.round(score, 5), np.round(weight, 5)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(score, pa.float64()), pa.array(count, pa.int64()), pa.array(top, pa.int64()), pa.array(weight, pa.float64())],
                    ["doc_id", "score", "n_passages", "top_start", "top_weight"],
                )

    out = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double, n_passages bigint, top_start bigint, top_weight double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    predicted = (F.col("score") >= threshold).cast("int")
    return out.select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"), "n_passages", "top_start", "top_weight")


def op13_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
