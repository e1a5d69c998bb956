"""The corpus pipeline: documents through five of the training-data operators, each stage written and read again.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents. ORACLE_SQL is None: SQL can't express the kernel classifier, the fingerprint components or the packing.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.llm import language_id, packing, pfair, simhash, suffix_array
from proselake.llm.common import cut, ensure_checkpoint_dir
from proselake.llm.queries import TARGETS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts that are null or have no letter go."""
    model = language_id.train(docs)
    if model is None:  # nothing to learn from: keep what has a letter
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}"))).select(*COLUMNS)
    told = language_id.predict(docs.select(*COLUMNS), model)
    return told.where(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id, a null id last; of rows with one id, one.

    Rows are told apart by a hash of all their columns; of rows alike in all of them one stays.
    """
    rows = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64(*COLUMNS))
    found = simhash.near_duplicates(rows, carry=("row_key",))
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row_key"))
    kept = found.groupBy("component").agg(first.alias("first")).select("first.row_key")
    times = found.groupBy("row_key").agg(F.count(F.lit(1)).alias("n"))
    kept = cut(kept.join(times, "row_key"))
    one = rows.join(kept.where("n = 1").select("row_key"), "row_key", "left_semi").select(*COLUMNS)
    again = kept.where("n > 1").select("row_key")
    if again.isEmpty():
        return one
    return one.unionByName(rows.join(again, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS))


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings of earlier documents; documents of which nothing, or white space alone, is left go."""
    left = suffix_array.deduplicated(docs, carry=["lang", "source"]).select(F.col("id").alias("doc_id"), F.col("kept_text").alias("text"), "lang", "source")
    return left.where(F.regexp_like("text", F.lit(r"(?U)\S"))).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixed stream: sources at their target weights as long as each lasts."""
    slots = pfair.schedule(docs.select(*COLUMNS), TARGETS)
    return slots.repartitionByRange("slot", "nth").sortWithinPartitions("slot", "nth").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens. Neighbours in the mixed stream are packed together first."""
    placed = packing.packed_documents(docs)
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_languages),
    ("simhash", drop_near_copies),
    ("suffix_array", drop_repeated_strings),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = os.path.join(spark.sparkContext.getCheckpointDir(), f"pipeline-{uuid.uuid4().hex}")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # whole in the next stage's files
            place = spark._jvm.org.apache.hadoop.fs.Path(before)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        before = path
    return docs
