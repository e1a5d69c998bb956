"""Versions of a matrix (row, col, val): each stores the columns that it changes, and a manifest of where every column stands.

A manifest tells for each column the version that holds it and a digest of its contents, so that a version is restored by a
join of its manifest with the columns of all versions, and what was restored can be compared with what was saved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.sources.readers import exists


def digests(matrix: DataFrame) -> DataFrame:
    """(col, digest): equal for columns of equal rows and values, in any order. Sums that are added up before they are shuffled."""
    own = F.md5(F.concat_ws(":", F.col("row").cast("string"), F.hex(F.xxhash64("val")), F.col("val").cast("string")))
    parts = [F.sum(F.conv(F.substring(own, 1 + 14 * k, 14), 16, 10).cast("decimal(20,0)")) for k in range(2)]
    return matrix.groupBy("col").agg(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *(p.cast("string") for p in parts)).alias("digest"))


def _manifest(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest/version={version}")


def save(matrix: DataFrame, folder: str, version: int, parent: int | None = None) -> None:
    """Save a version: all columns without a parent, else those that differ from the parent's. Columns that the parent has and
    the matrix lacks are gone in this version. A version that is there already is an error."""
    spark = matrix.sparkSession
    if exists(spark, f"{folder}/manifest/version={version}"):
        raise ValueError(f"version {version} is there already")
    now = digests(matrix)
    if parent is None:
        told = now.withColumn("holder", F.lit(version))
    else:
        before = _manifest(spark, folder, parent).select("col", F.col("digest").alias("was"), F.col("holder").alias("at"))
        told = now.join(before, "col", "left").select("col", "digest", F.when(F.col("digest") == F.col("was"), F.col("at")).otherwise(version).alias("holder"))
    # the manifest last: without it there is no version, so that a run that ends between the two can be repeated
    pending = f"{folder}/pending-{version}"
    told.write.mode("overwrite").parquet(pending)
    told = spark.read.parquet(pending)
    changed = matrix.join(told.where(F.col("holder") == version).select("col"), "col", "left_semi")
    changed.select("row", "col", "val").write.mode("overwrite").parquet(f"{folder}/columns/version={version}")
    told.write.parquet(f"{folder}/manifest/version={version}")


def restore(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """(row, col, val) of a version."""
    at = _manifest(spark, folder, version).select("col", F.col("holder").alias("version"))
    return spark.read.parquet(f"{folder}/columns").join(at, ["col", "version"]).select("row", "col", "val")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """(version, n_columns, n_values) that each version holds itself."""
    return spark.read.parquet(f"{folder}/columns").groupBy("version").agg(F.count_distinct("col").alias("n_columns"), F.count(F.lit(1)).alias("n_values"))


def damaged(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """(col) whose contents aren't those that were saved, or that are missing."""
    saved = _manifest(spark, folder, version).select("col", "digest")
    return saved.join(digests(restore(spark, folder, version)), ["col", "digest"], "left_anti").select("col")
