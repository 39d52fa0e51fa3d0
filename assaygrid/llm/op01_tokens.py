"""Token counts of whole texts, with huge texts encoded in overlapping chunks and spliced (operator 1).

A text longer than ``chunk`` code points is encoded piecewise.  Neighbouring chunks share ``overlap`` code points.
They are joined at a position that (a) both encodings have as a token boundary and (b) no merge can cross: the two
characters around it stand next to each other in no piece of the vocabulary.  Merges then never look across it, so
the tokens on either side are those of the whole text.  Where the shared part holds no such position the overlap is
doubled, in the end up to the rest of the text.

Nulls count as empty texts; a null or repeated doc_id is returned row by row as it comes; only ``doc_id`` and
``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.llm.base import slices, table


class Splicer:
    """Counts tokens of one text of any length with bounded encoder calls.

    ``spans(text)`` gives the end of each token in code points; ``joined`` holds every pair of neighbouring
    characters inside any vocabulary piece.
    """

    def __init__(self, spans, joined: set[str], chunk: int, overlap: int):
        self.spans, self.joined, self.chunk, self.overlap = spans, joined, chunk, overlap
        self.widened = 0

    def _stable(self, text: str, p: int) -> bool:
        pair = text[p - 1 : p + 1].replace(" ", "▁")
        return len(pair) == 2 and pair not in self.joined

    def count(self, text: str) -> int:
        if len(text) <= self.chunk:
            return len(self.spans(text))
        total, begin = 0, 0  # tokens before ``begin`` are counted
        stop = self.chunk
        ends = self.spans(text[:stop])
        base, after = 0, -1  # where this chunk starts; tokens that end after this position are still to be counted
        while stop < len(text):
            overlap = min(self.overlap, stop - begin)
            while True:
                lo = max(begin, stop - overlap)
                upto = min(len(text), lo + self.chunk + overlap)
                nxt = self.spans(text[lo:upto])
                common = np.intersect1d(ends[(ends + base > max(lo, after)) & (ends + base < stop)] + base, nxt + lo)
                cut = next((int(p) for p in common[::-1] if p > after and self._stable(text, int(p))), None)
                if cut is not None:
                    break
                self.widened += 1
                if lo == begin:  # nothing to splice at yet: this chunk grows
                    stop = min(len(text), stop + self.chunk)
                    ends = self.spans(text[base:stop])
                    if stop == len(text):
                        return total + int(np.sum(ends + base > after))
                    overlap = min(self.overlap, stop - begin)
                else:
                    overlap *= 2
            total += int(np.sum((ends + base > after) & (ends + base <= cut)))
            begin = after = cut
            base, ends, stop = lo, nxt, upto
        return total + int(np.sum(ends + base > after))


def load_piece_model(path: str):
    """The library's encoder, the character pairs inside its pieces, and token ends in code points."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    joined = set()
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            piece = model.id_to_piece(i)
            joined.update(piece[j : j + 2] for j in range(len(piece) - 1))

    def spans(text: str) -> np.ndarray:
        ends = np.fromiter((p.end for p in model.encode(text, return_type="proto").pieces), np.int64)
        ends = np.maximum.accumulate(ends) if len(ends) else ends  # bytes of one character end with its last
        raw = np.frombuffer(text.encode(), np.uint8)
        chars = np.cumsum((raw & 0xC0) != 0x80)
        return np.where(ends > 0, chars[np.maximum(ends, 1) - 1], 0) if len(ends) else ends

    return model, joined, spans


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = 1 << 15, overlap: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_chars, spliced) for every row of ``docs``."""

    def run(batches):
        model, joined, spans = load_piece_model(model_path)
        splicer = Splicer(spans, joined, chunk, overlap)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                short = [i for i, t in enumerate(texts) if len(t) <= chunk]
                counts = np.zeros(len(texts), np.int64)
                counts[short] = [len(x) for x in model.encode([texts[i] for i in short], num_threads=1)]
                long = np.ones(len(texts), bool)
                long[short] = False
                for i in np.flatnonzero(long):
                    counts[i] = splicer.count(texts[i])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), pa.array(counts), pa.array(counts > limit),
                     pa.array([len(t) for t in texts], pa.int64()), pa.array(long)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chars", "spliced"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chars bigint, spliced boolean")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
