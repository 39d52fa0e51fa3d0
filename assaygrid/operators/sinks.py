"""Result tables in files: Parquet for large tables, delimited text for exchange; long form throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_matrix(matrix: DataFrame, path: str, text: bool = False) -> None:
    """feature, sample, value; text files are tab separated with a header and the empty string for NULL."""
    rows = matrix.select("feature", "sample", "value")
    if text:
        rows.write.mode("overwrite").option("header", True).option("sep", "\t").option("nullValue", "").csv(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def write_isotopologues(iso: DataFrame, path: str) -> None:
    """compound, label (M+i), sample, area as Parquet, sorted inside each file."""
    rows = iso.select("compound", F.concat(F.lit("M+"), "i").alias("label"), "sample", "area")
    rows.sortWithinPartitions("compound", "label", "sample").write.mode("overwrite").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Two Parquet tables, ``nodes`` and ``edges``, under one path; edges whose ends are no nodes go."""
    ids = nodes.select("node").distinct()
    kept = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    kept.write.mode("overwrite").parquet(f"{path}/edges")
