"""A training corpus from raw documents: stages that each read what the one before has kept.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of ``docs``.  Decisions belong to rows, not to ids: a row is known by a 64-bit hash of its doc_id and text,
so rows with a null doc_id, and several texts under one doc_id, are judged each on its own.  Null texts are clean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaygrid.llm.base import table
from assaygrid.llm.op06_toxicity import score_toxicity
from assaygrid.llm.op07_decontaminate import found_items
from assaygrid.llm.op08_minhash import near_duplicates
from assaygrid.llm.op09_mixing import sampled_documents
from assaygrid.llm.op10_secrets import redact_secrets

ORACLE_SQL = None  # the classifier and the confirmed near-duplicate components are beyond SQL


def row_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), "text")


def without_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored 0.5 or more go; the labels that cover this stage's documents are learned from."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), row=True)
    return scored.filter("predicted = 0").select("row.*")


def one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five-word shingles, similarity 0.8) stays: that of the smallest doc_id, null last.

    Rows alike in doc_id and text are one document, of which one row stays; texts without words are groups of their own.
    """
    keyed = docs.withColumn("_row", row_key())
    found = near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text")).filter("n_shingles > 0")
    ids = keyed.select(F.col("_row").alias("_r"), "doc_id").distinct()
    groups = found.select(F.col("doc_id").alias("_r"), "component_id").distinct().join(ids, "_r")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_r")).alias("x")).select(F.col("x._r").alias("_r"), "component_id")
    gone = groups.select("_r", "component_id").join(first, ["_r", "component_id"], "left_anti").select(F.col("_r").alias("_row"))
    left = keyed.join(gone, "_row", "left_anti")
    has_words = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    once = left.filter(has_words).dropDuplicates(["_row"])
    return once.unionByName(left.filter(F.coalesce(~has_words, F.lit(True)))).select(docs.columns)


def without_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item, literally or with changed slots, go."""
    keyed = docs.withColumn("_row", row_key())
    found = found_items(keyed.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(found.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(docs.columns)


def without_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; found secrets are replaced by their kind."""
    return redact_secrets(docs)


def to_target_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents in the target proportions, with its topic and probability."""
    return sampled_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_each_group),
    ("benchmark", without_benchmark),
    ("secrets", without_secrets),
    ("mixing", to_target_mix),
]


def run(spark, sf_dir: str) -> DataFrame:
    return reduce(lambda docs, stage: stage[1](spark, docs, sf_dir), STAGES, table(spark, sf_dir, "documents"))
