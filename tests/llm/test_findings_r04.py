"""What the findings of round 4 asked of the training-data operators."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assaygrid.llm import op04_language as op04
from assaygrid.llm import op12_merkle as op12
from assaygrid.llm.base import text_bytes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("n", [1, 9, 70])
def test_merkle_manifest_verifies_every_row_by_its_siblings(spark, monkeypatch, n):
    """Where siblings are spoiled, no row that has any is verified, tampered or not."""
    df = spark.createDataFrame([(i, f"Text {i}", "en" if i % 3 else "de", "web", i) for i in range(n)], DOCS)
    whole = op12.merkle_manifest(df).collect()
    assert len(whole) == n and all(r.verified and r.folded_root == r.root for r in whole)
    sweep = op12.downward

    def spoiled(*args):
        path = F.transform("path", lambda x: F.struct(x["place"].alias("place"), F.translate(x["others"], "0123456789abcdef", "123456789abcdef0").alias("others")))
        return sweep(*args).withColumn("path", path)

    monkeypatch.setattr(op12, "downward", spoiled)
    for found in (None, F.lower("text")):
        rows = op12.merkle_manifest(df, found).collect()
        assert len(rows) == n
        assert [r.verified for r in rows] == [n == 1 and found is None] * n


@pytest.mark.parametrize("n_langs", [1, 4, 8, 20])
def test_language_hits_by_sets_of_languages(n_langs):
    """Counting n-grams by the set of their languages gives what each language's filter gives alone, and texts cut anywhere the same n-grams."""
    rng = np.random.default_rng(n_langs)
    texts = ["".join(rng.choice(list("abcde  Éß."), rng.integers(0, 90))) for _ in range(40)]
    data, offs = text_bytes(pa.array(texts))
    letters = op04.letter_table()
    codes, where = op04.gram_codes(data, offs, letters)
    for i, text in enumerate(texts):
        b = re.sub(rb" +", b" ", bytes(letters[np.frombuffer(text.encode(), np.uint8)]))
        want = sorted(int.from_bytes(bytes([n]) + b[j : j + n]) for n in op04.LENGTHS for j in range(len(b) - n + 1))
        assert sorted(codes[where == i].tolist()) == want
    known = np.unique(codes)
    f = op04.build([f"l{i}" for i in range(n_langs)], [known[rng.random(len(known)) < 0.3] for _ in range(n_langs)])
    masks, hits = f.masks(codes), f.hits(codes, where, len(texts))
    assert hits.shape == (len(texts), n_langs)
    for i in range(n_langs):
        assert np.array_equal(hits[:, i], np.bincount(where, (masks[:, i // 8] >> np.uint8(i % 8)) & 1, len(texts)))
