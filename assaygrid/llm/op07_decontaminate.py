"""Benchmark decontamination by template windows (operator 7).

Words (A-Z lower-cased, punctuation between words dropped, but not inside numbers) become template words: a word
with a digit is ``<num>``, a unit after a number ``<unit>``, a capitalised word ``<name>`` inside a sentence and
``<init>`` at its start; a second style has slots for numbers and units only and so finds copies in other case; the
literal style has none and needs no plain words, but tells the operators between two numbers apart.  Each character of
a script without spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese) is a word.  Windows of ``width`` words (in the first two styles with at least ``literal`` plain words) are
hashed and joined with the benchmark's windows (a shorter item is one window; in the literal style it may be a single word).  Matches on one diagonal (position in
the document minus position in the item) are one alignment; neighbouring diagonals at most ``shift`` words apart are
one, too, since words may have been put in or left out.  Windows without a changed slot always count.  Windows with
changed slots count by style, as long as the slots of the style's changed windows are consistent: each slot value of the
item stands for one value in the document.  An item is found when an alignment covers ``cover`` of its words (by as
many words of the document) or holds a run of ``run`` words; it is re-parameterised when some slot value was changed.

A bitmap of fixed size over the benchmark's window hashes thins the document windows before the join; it can only
let too many through, the join decides.  Null or empty texts match nothing; rows with a null doc_id are returned as
clean with no items; rows repeated under one doc_id share their result; null item_ids or texts are no items; other
columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.llm.base import WordHasher, mix, signed, slices, table, text_bytes

BITS = 22  # bitmap of 2**22 bits
#: Units recognised after a number (fixed values).
UNITS = """mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec min h hr hrs ms hz khz mhz ghz w kw kwh j kj cal
kcal v a mph kmh c f k b kb mb gb tb second seconds minute minutes hour hours day days week weeks month months year
years meter meters metre metres mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds
ounce ounces liter liters litre litres gallon gallons degree degrees percent dollar dollars cent cents euro euros usd
eur gbp""".split()
NUM, UNIT, NAME, INIT = (mix(np.array([x], np.uint64))[0] for x in (101, 102, 103, 104))
KINDS = ("num", "unit", "name", "init")


class Templater(WordHasher):
    """Template words of texts as hashes, with the kind of each slot."""

    def __init__(self):
        super().__init__(seed=7)
        flag = lambda chars: np.isin(np.arange(256), list(chars))
        self.split = flag(b" \t\n\r\x0b\x0c!\"'()*,.:;<=>?[]`{|}~/\\_&#$%+-^@")
        self.joint, self.digit, self.stop = flag(b".,:/-"), flag(b"0123456789"), flag(b".!?\n")
        self.upper = flag(range(65, 91))
        self.operator = flag(b"+-*/=<>^%")
        data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
        self.units = np.sort(WordHasher.__call__(self, data, np.array([0, len(data)]))[0])

    def spans(self, data, offs):
        cut = self.split[data]
        alone, after = np.zeros(len(data), bool), np.zeros(len(data) + 4, bool)
        if len(data) and data.max() >= 0xE0:
            alone, mark = self.unspaced(data)
            for size, leads in ((3, alone & (data < 0xF0)), (4, alone & (data >= 0xF0))):
                after[np.flatnonzero(leads) + size] = True
            for k in range(3):
                cut[np.minimum(np.flatnonzero(mark) + k, len(data) - 1)] = True
        parted = alone | after[: len(data)]  # a word ends before this byte
        digit = self.digit[data]
        inside = np.zeros(len(data), bool)
        inside[1:-1] = digit[:-2] & digit[2:] & self.joint[data[1:-1]]
        word = ~cut | inside
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | parted[1:]
        last[:-1] &= ~word[1:] | parted[1:]
        some = offs[:-1] < offs[1:]
        heads, tails = offs[:-1][some], offs[1:][some] - 1
        first[heads], last[tails] = word[heads], word[tails]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    @staticmethod
    def unspaced(data):
        """First bytes of the characters of scripts without spaces, and of their punctuation."""
        a, b, c = data, np.append(data[1:], [0]), np.append(data[2:], [0, 0])
        at = lambda x, lo, hi: (x >= lo) & (x <= hi)
        wide = (a == 0xE3) & (b == 0x80)
        mark = wide & ~at(c, 0x85, 0x87)
        mark |= (a == 0xEF) & (b == 0xBC) & (at(c, 0x81, 0x8F) | at(c, 0x9A, 0xA0) | (c >= 0xBB))
        mark |= (a == 0xEF) & (b == 0xBD) & ((c == 0x80) | at(c, 0x9B, 0xA5))
        alone = at(a, 0xE3, 0xE9) & ~mark
        alone |= (a == 0xE0) & at(b, 0xB8, 0xBB) | (a == 0xE1) & (at(b, 0x80, 0x82) | at(b, 0x9E, 0x9F))
        alone |= (a == 0xEF) & (at(b, 0xA4, 0xAB) | (b == 0xBD) & (c >= 0xA6) | (b == 0xBE) & (c <= 0x9D))
        return alone | (a == 0xF0) & at(b, 0xA0, 0xB3), mark

    def joined(self, data, h, starts, ends, kind):
        """Hashes of words that follow another: a number after a number has the operators between them."""
        operators = np.concatenate([[0], np.cumsum(self.operator[data])])
        number = kind == 1
        out = h.copy()
        for i in np.flatnonzero(number[1:] & number[:-1] & (operators[starts[1:]] > operators[ends[:-1]])) + 1:
            between = data[ends[i - 1] : starts[i]]
            out[i] ^= np.uint64(zlib.crc32(between[self.operator[between]].tobytes()) + 1)
        return out

    def __call__(self, data, offs):
        """Template hashes, hashes with names kept, hashes of all words, kind of each (0: plain, else 1 + place in KINDS), word starts and ends, row offsets."""
        h, starts, ends, at = super().__call__(data, offs)
        if not len(h):
            return h, h, h, np.zeros(0, np.int8), starts, ends, at
        count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        digits, stops = count(self.digit[data]), count(self.stop[data])
        num = digits[ends] > digits[starts]
        head = np.zeros(len(h), bool)
        head[at[:-1][at[:-1] < at[1:]]] = True
        before = np.concatenate([[0], ends[:-1]])
        initial = head | (stops[starts] > stops[before])
        lead = data[starts]
        second = data[np.minimum(starts + 1, len(data) - 1)]
        cap = self.upper[lead] | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        kind = np.zeros(len(h), np.int8)
        kind[cap & ~initial] = 3
        kind[cap & initial] = 4
        kind[num] = 1
        after = np.zeros(len(h), bool)
        after[1:] = num[:-1]
        after[head] = False
        place = np.minimum(np.searchsorted(self.units, h), len(self.units) - 1)
        kind[after & ~num & (self.units[place] == h)] = 2
        return np.choose(kind, [h, NUM, UNIT, NAME, INIT]), np.choose(np.minimum(kind, 3), [h, NUM, UNIT, h]), h, kind, starts, ends, at


def template_windows(rows: DataFrame, widths: list[int], literal: int, bitmap: np.ndarray | None, short: bool) -> DataFrame:
    """(id, pos, n_words, wide, style, hash, slots) of the windows of ``rows`` (id, text) that the bitmap lets through.

    slots lists (offset in the window, kind, lower-cased value).  ``short``: a text below the width is one window.
    """
    schema = "id bigint, pos int, n_words int, wide int, style int, hash bigint, slots array<struct<o:int,kind:string,value:string>>"
    slot = pa.list_(pa.struct([("o", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))

    def hashes(t, w, later):
        acc = t[: max(0, len(t) - w + 1)].copy()
        for j in range(1, w):
            acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + later[j : j + len(acc)])
        return mix(acc + np.uint64(w))

    def run(batches):
        templater = Templater()
        for batch in batches:
            for part in slices(batch, "text"):
                data, offs = text_bytes(part.column("text"))
                template, worded, plainly, kind, starts, ends, at = templater(data, offs)
                joined = templater.joined(data, plainly, starts, ends, kind)
                ids = part.column("id").to_pylist()
                out = []
                row_of = np.repeat(np.arange(len(ids)), np.diff(at))
                # the styles: hashes, those of words that follow another, kinds that are slots in it, plain words that a window needs
                for style, t, later, slots_upto, least in ((0, plainly, joined, 0, 1), (1, template, template, 4, literal), (2, worded, worded, 2, literal)):
                    slot_at = (kind > 0) & (kind <= slots_upto)
                    plain = np.concatenate([[0], np.cumsum(~slot_at)])
                    styled = lambda x: mix(x + np.uint64(style))  # noqa: B023, E731
                    for w in widths:
                        h = styled(hashes(t, w, later))
                        if not len(h):
                            continue
                        ok = (row_of[: len(h)] == row_of[w - 1 :]) & (plain[w:] - plain[: len(h)] >= min(least, w))
                        if bitmap is not None:
                            b = (h >> np.uint64(64 - BITS)).astype(np.int64)
                            ok &= (bitmap[b >> 3] >> (b & 7)).astype(np.uint8) & 1 == 1
                        out += [(int(i), w, h[i], style, slot_at) for i in np.flatnonzero(ok)]
                    if short:
                        for a, b in zip(at[:-1], at[1:]):
                            if least <= b - a < widths[0]:
                                out.append((int(a), int(b - a), styled(hashes(t[a:b], int(b - a), later[a:b]))[0], style, slot_at))
                cols = [[], [], [], [], [], [], []]
                for i, w, x, style, slot_at in out:
                    r = row_of[i]
                    slots = [
                        {"o": int(j - i), "kind": KINDS[kind[j] - 1], "value": data[starts[j] : ends[j]].tobytes().decode("utf8", "replace").lower()}
                        for j in range(i, i + w) if slot_at[j]
                    ]
                    for c, v in zip(cols, (ids[r], i - at[r], at[r + 1] - at[r], w, style, np.uint64(x).astype(np.int64), slots)):
                        c.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), slot]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "pos", "n_words", "wide", "style", "hash", "slots"])

    return rows.filter("id is not null").mapInArrow(run, schema)


def found_items(docs: DataFrame, bench: DataFrame, width: int = 8, literal: int = 4, cover: float = 0.8, run: int = 13, shift: int = 8) -> DataFrame:
    """(doc_id, item_id, covered, longest, changed): the items found in each document."""
    items = bench.select(F.col("item_id").cast("bigint").alias("id"), "text")
    theirs = template_windows(items, [width], literal, None, True)
    # a document's window may also be that of a shorter item
    widths = sorted(r.wide for r in theirs.select("wide").distinct().collect())  # at most ``width`` numbers
    bit = F.shiftrightunsigned("hash", 64 - BITS)
    bits = np.zeros(2**BITS // 8, np.uint8)
    for (b,) in theirs.select(bit.alias("b")).distinct().toLocalIterator():  # at most 2**22 numbers
        bits[b >> 3] |= 1 << (b & 7)
    ours = template_windows(docs.select(F.col("doc_id").cast("bigint").alias("id"), "text"), widths, literal, bits, False)
    ours = ours.select(F.col("id").alias("doc_id"), F.col("pos").alias("dp"), "hash", F.col("slots").alias("ds"))
    theirs = theirs.select(F.col("id").alias("item_id"), F.col("pos").alias("ip"), "n_words", "wide", "style", "hash", F.col("slots").alias("is_"))
    pair = F.zip_with("ds", "is_", lambda d, i: F.struct(i["kind"].alias("kind"), i["value"].alias("theirs"), d["value"].alias("ours")))
    hit = ours.join(theirs, "hash").select("doc_id", "item_id", (F.col("dp") - F.col("ip")).alias("diag"), "ip", "n_words", "wide", "style", pair.alias("slots"))
    changed = F.exists("slots", lambda x: x["theirs"] != x["ours"])
    hit = hit.withColumn("style", F.when(changed, F.col("style")).otherwise(0))  # nothing to be consistent with
    window = F.struct(F.col("ip").alias("p"), "wide")
    places = [F.collect_set(F.when(F.col("style") == k, window)).alias(f"at{k}") for k in (0, 1, 2)]
    slots = [F.array_distinct(F.flatten(F.collect_set(F.when(F.col("style") == k, F.col("slots"))))).alias(f"slots{k}") for k in (1, 2)]
    lines = hit.groupBy("doc_id", "item_id", "diag").agg(F.max("n_words").alias("n_words"), *places, *slots)
    # the evidence by style; what has fewer slots counts for the styles with more
    none = F.slice("slots1", 1, 0)
    by_style = [(0, "at0", none), (2, F.array_union("at0", "at2"), F.col("slots2"))]
    by_style += [(1, F.array_union(F.array_union("at0", "at2"), "at1"), F.array_union("slots1", "slots2"))]
    each = F.array(*[F.struct(F.lit(k).alias("style"), F.array_sort(a).alias("at"), x.alias("slots")) for k, a, x in by_style])
    lines = lines.select("doc_id", "item_id", "diag", "n_words", F.explode(each).alias("e")).select("doc_id", "item_id", "diag", "n_words", "e.*").filter("size(at) > 0")
    # words covered, current run and longest run over the windows in order
    start = F.struct(F.lit(0).alias("all"), F.lit(-1).alias("upto"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s, x):
        end = x["p"] + x["wide"]
        new = F.greatest(F.lit(0), end - F.greatest(s["upto"], x["p"]))
        grown = F.when(x["p"] <= s["upto"], s["run"] + new).otherwise(x["wide"])
        return F.struct((s["all"] + new).alias("all"), F.greatest(s["upto"], end).alias("upto"), grown.alias("run"), F.greatest(s["best"], grown).alias("best"))

    lines = lines.withColumn("longest", F.aggregate("at", start, step)["best"])
    lines = lines.withColumn("in_doc", F.transform("at", lambda x: F.struct((x["p"] + F.col("diag")).alias("p"), x["wide"].alias("wide"))))
    # each diagonal is an alignment, and each chain of neighbouring ones
    own = Window.partitionBy("doc_id", "item_id", "style").orderBy("diag")
    lines = lines.withColumn("_new", F.coalesce((F.col("diag") - F.lag("diag").over(own) > shift).cast("int"), F.lit(1)))
    chain = F.struct(F.lit(True).alias("chain"), F.sum("_new").over(own).cast("int").alias("n"))
    lines = lines.withColumn("_of", F.array(F.struct(F.lit(False).alias("chain"), F.col("diag").alias("n")), chain))
    pooled = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    lines = lines.withColumn("_of", F.explode("_of")).groupBy("doc_id", "item_id", "style", "_of").agg(
        F.max("n_words").alias("n_words"), F.max("longest").alias("longest"), pooled("at"), pooled("in_doc"), pooled("slots"),
    )
    keys = F.array_distinct(F.transform("slots", lambda x: F.struct(x["kind"], x["theirs"])))
    words = F.least(F.aggregate("at", start, step)["all"], F.aggregate("in_doc", start, step)["all"])
    lines = lines.select(
        "doc_id", "item_id", (words / F.col("n_words")).alias("covered"), "longest", (F.size(keys) == F.size("slots")).alias("consistent"),
        F.exists("slots", lambda x: x["theirs"] != x["ours"]).alias("changed"),
    )
    good = lines.filter("consistent").filter((F.col("covered") >= cover) | (F.col("longest") >= run))
    best = F.row_number().over(Window.partitionBy("doc_id", "item_id").orderBy(F.desc("covered"), F.desc("longest"), "changed"))
    return good.withColumn("_n", best).filter("_n = 1").drop("_n", "consistent")


def decontaminate(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, covered, reparametrised) for every row of ``docs``."""
    found = found_items(docs, bench, **how).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("covered").alias("covered"), F.bool_or("changed").alias("reparametrised")
    )
    out = docs.select(F.col("doc_id").cast("bigint")).join(found, "doc_id", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return out.select(
        "doc_id", (F.size(ids) > 0).alias("contaminated"), F.size(ids).cast("bigint").alias("n_items"), ids.alias("item_ids"),
        F.coalesce("covered", F.lit(0.0)).alias("covered"), F.coalesce("reparametrised", F.lit(False)).alias("reparametrised"),
    )


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
