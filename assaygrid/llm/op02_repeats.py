"""Removal of repeated 200-byte strings by prefix-free parsing (operator 2).

Parse: rolling hashes of 32-byte windows are computed at every byte; a window whose hash is the smallest of all
windows of some 200-byte string is a trigger.  Every 200-byte string has one trigger at a place that its own bytes
decide, so equal strings have equal triggers at equal offsets.  The strings with one trigger in a row form a phrase
(their common text), and each text is the sequence of its phrases.
Dictionary: phrases are counted by trigger and by content.  A trigger found once has no repeated string.  A phrase
content found twice or more repeats whole: all its strings are marked, without looking at the text again.  Only
phrases that are alone under a trigger shared with other contents are open; their suffixes of 200 bytes are ranked
together with those of one copy of every other content of the trigger: equal rank means repeated.  Rank classes are
taken by hash within the trigger, since only equality of 200-byte prefixes is asked for; contents of a trigger that
fit a task are ranked there, the suffixes of triggers with more contents are dealt out one by one.
Removal: marked starts become byte ranges of their document.

Rows are told apart by doc_id and text; equal rows repeat each other.  Null doc_ids are one value; null texts are
empty.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.llm.base import WordHasher, mix, signed, slices, table, text_bytes
from assaygrid.session import cut_lineage

LENGTH, WINDOW = 200, 32
SEGMENT = 1 << 20  # bytes parsed at once; positions in a segment take 21 bits
MANY_CONTENTS = 4096  # contents of one trigger that a task ranks by itself
MARK_BITS = 22  # of a text's hash, kept beside its positions


class ByteHasher(WordHasher):
    """Hashes of byte spans, case kept."""

    def __init__(self):
        super().__init__(seed=3)
        self.table = np.random.default_rng(4).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

    def rolling(self, data: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n (a power of two) bytes from each position, by doubling."""
        x, done = self.table[data], 1
        while done < n:
            x = x[:-done] * np.uint64(0x9E3779B97F4A7C15) + x[done:]
            x ^= x >> np.uint64(29)
            done *= 2
        return mix(x)


def phrases(data: np.ndarray, offs: np.ndarray, hasher: ByteHasher):
    """(row, first start, number of starts, trigger, content) of the phrases of all rows."""
    width = LENGTH - WINDOW + 1
    for s in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
        part = data[s : s + SEGMENT + LENGTH - 1]
        h = hasher.rolling(part, WINDOW)
        low = (h >> np.uint64(21) << np.uint64(21)) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while n * 2 <= width:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        low = np.minimum(low[: len(low) - (width - n)], low[width - n :])
        trigger = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
        at = np.arange(len(trigger)) + s
        row = np.searchsorted(offs, at, "right") - 1
        ok = at + LENGTH <= offs[row + 1]
        at, row, trigger = at[ok], row[ok], trigger[ok]
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        start = at[first]
        content = hasher.hashed(part, start - s, start - s + count + LENGTH - 1)
        yield row[first], start - offs[row[first]], count, h[trigger[first]], content


def packed(mark: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (mark << (63 - MARK_BITS)) | (start << 9) | count


def parse(docs: DataFrame) -> DataFrame:
    """(doc, at, trigger, content): one row for each phrase; at packs the text's mark, first start and number of starts."""

    def run(batches):
        hasher = ByteHasher()
        for batch in batches:
            for part in slices(batch, "text"):
                doc, mark = np.asarray(part.column("doc")), np.asarray(part.column("mark"))
                for row, start, count, trigger, content in phrases(*text_bytes(part.column("text")), hasher):
                    at = packed(mark[row], start, count)
                    yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(at), signed(trigger), signed(content)], ["doc", "at", "trigger", "content"])

    return docs.select("doc", "mark", "text").mapInArrow(run, "doc bigint, at bigint, trigger bigint, content bigint")


def contexts(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """``open_`` (doc, at, trigger, alone, many) with each phrase's bytes."""
    wanted = open_.groupBy("doc").agg(F.collect_list(F.struct("at", "trigger", "alone", "many")).alias("wanted"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offs = text_bytes(part.column("text"))
                out = ([], [], [], [], [], [])
                for i, (doc, mark, wanted_) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc", "mark", "wanted")))):
                    for w in wanted_:
                        if w["at"] >> (63 - MARK_BITS) == mark:
                            start = int(offs[i]) + ((w["at"] >> 9) & 0xFFFFFFFF)
                            text = data[start : start + (w["at"] & 511) + LENGTH - 1].tobytes()
                            for c, v in zip(out, (doc, w["at"], w["trigger"], w["alone"], w["many"], text)):
                                c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc", "at", "trigger", "alone", "many", "bytes"])

    rows = docs.select("doc", "mark", "text").join(wanted, "doc")
    return rows.mapInArrow(run, "doc bigint, at bigint, trigger bigint, alone boolean, many boolean, bytes binary")


def suffix_keys(part: pa.RecordBatch | pa.Table, hasher: ByteHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset in the phrase and rank class of each 200-byte suffix; a class is one of its trigger."""
    data, offs = text_bytes(part.column("bytes"))
    count = np.asarray(part.column("at")) & 511
    row = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offs[row] + offset
    trigger = np.asarray(part.column("trigger")).view(np.uint64)[row]
    return row, offset, mix(hasher.hashed(data, start, start + LENGTH) ^ mix(trigger))


def ranges(part, row: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    """Marked starts (in order) of the rows as runs: (doc, at) like whole phrases."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(row)))
    at = np.asarray(part.column("at"))[row[first]]
    start = ((at >> 9) & 0xFFFFFFFF) + offset[first]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(part.column("doc"))[row[first]]), pa.array(packed(at >> (63 - MARK_BITS), start, count))], ["doc", "at"])


def ranked_in_tasks(texts: DataFrame) -> DataFrame:
    """Repeated runs of the open phrases whose trigger has few contents: triggers are dealt to tasks and ranked in order."""

    def run(batches):
        hasher = ByteHasher()

        def ranked(held):
            part = pa.Table.from_batches(held).combine_chunks()
            part = part.to_batches()[0]
            row, offset, key = suffix_keys(part, hasher)
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            twice &= np.asarray(part.column("alone"))[row]
            return ranges(part, row[twice], offset[twice])

        held, size, last = [], 0, None
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                t = np.asarray(part.column("trigger"))
                cut = np.flatnonzero(np.r_[last is not None and t[0] != last, t[1:] != t[:-1]])
                if size > 1 << 21 and len(cut):  # whole triggers only
                    if cut[0]:
                        held.append(part.slice(0, int(cut[0])))
                    yield ranked(held)
                    held, size = [], 0
                    part = part.slice(int(cut[0]))
                held.append(part)
                size += part.nbytes
                last = t[-1]
        if held:
            yield ranked(held)

    dealt = texts.filter("not many").select("trigger", "doc", "at", "alone", "bytes").repartition("trigger").sortWithinPartitions("trigger")
    return dealt.mapInArrow(run, "doc bigint, at bigint")


def ranked_one_by_one(texts: DataFrame) -> DataFrame:
    """The same for triggers with many contents: each suffix is a row."""

    def run(batches):
        hasher = ByteHasher()
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                row, offset, key = suffix_keys(part, hasher)
                at = np.asarray(part.column("at"))[row]
                start = ((at >> 9) & 0xFFFFFFFF) + offset
                alone = np.asarray(part.column("alone"))[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(part.column("doc"))[row]), pa.array(packed(at >> (63 - MARK_BITS), start, np.ones(len(at), np.int64))), pa.array(alone), signed(key)],
                    ["doc", "at", "alone", "key"],
                )

    suffixes = texts.filter("many").select("trigger", "doc", "at", "alone", "bytes").mapInArrow(run, "doc bigint, at bigint, alone boolean, key bigint")
    twice = suffixes.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    return suffixes.filter("alone").join(twice, "key").select("doc", "at")


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(doc, at): runs of starts of 200-byte strings that also start elsewhere."""
    parsed = parse(docs)
    triggers = parsed.groupBy("trigger").agg(F.count(F.lit(1)).alias("c"), F.min("content").alias("lo"), F.max("content").alias("hi"))
    triggers = cut_lineage(triggers.filter("c > 1").selectExpr("trigger", "lo <> hi AS mixed"))
    shared = cut_lineage(parsed.join(triggers, "trigger"))
    contents = shared.filter("mixed").groupBy("trigger", "content").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "at")).alias("one"))
    contents = cut_lineage(contents)
    whole = shared.filter("not mixed").select("doc", "at").union(
        shared.filter("mixed").join(contents.filter("c > 1").select("trigger", "content"), ["trigger", "content"]).select("doc", "at")
    )
    crowd = contents.groupBy("trigger").agg((F.count(F.lit(1)) > MANY_CONTENTS).alias("many"), F.bool_or(F.col("c") == 1).alias("any"))
    open_ = contents.join(crowd.filter("any"), "trigger").select("one.doc", "one.at", "trigger", (F.col("c") == 1).alias("alone"), "many")
    texts = cut_lineage(contexts(docs, open_))
    return whole.union(ranked_in_tasks(texts)).union(ranked_one_by_one(texts))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of ``docs``; spans are byte ranges."""
    mark = F.xxhash64("text").bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("mark", mark)
    marks = repeated_starts(rows).groupBy("doc").agg(F.collect_list("at").alias("marks"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offs = text_bytes(part.column("text"))
                mark_, marks_ = part.column("mark").to_pylist(), part.column("marks")
                removed, spans, digests, places = [], [], [], []
                for i in range(part.num_rows):
                    text = data[offs[i] : offs[i + 1]]
                    at = np.asarray(marks_[i].values) if marks_[i].is_valid else np.zeros(0, np.int64)
                    at = at[at >> (63 - MARK_BITS) == mark_[i]]
                    start = (at >> 9) & 0xFFFFFFFF
                    order = np.argsort(start)
                    start, end = start[order], np.maximum.accumulate((start + (at & 511) - 1 + LENGTH)[order]) if len(at) else start
                    new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]]) if len(at) else np.zeros(0, np.int64)
                    first, last = start[new], end[np.append(new[1:] - 1, len(end) - 1)] if len(at) else start
                    digest, done = hashlib.sha256(), 0
                    for a, b in zip(first.tolist(), last.tolist()):
                        digest.update(text[done:a])
                        done = b
                    digest.update(text[done:])
                    removed.append(int(np.sum(last - first)))
                    spans.append(len(first))
                    digests.append(digest.hexdigest())
                    places.append([{"start": a, "end": b} for a, b in zip(first.tolist(), last.tolist())])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests), pa.array(places, kind)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
                )

    joined = rows.select(F.col("doc_id").cast("bigint"), "doc", "mark", "text").join(marks, "doc", "left").select("doc_id", "mark", "text", "marks")
    return joined.mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    )


def op2_repeated_strings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
