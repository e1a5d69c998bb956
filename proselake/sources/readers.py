"""Sources and sinks: JSON lines, seed files, documents, logs and results, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselake.functions import text as T

LABELLED = "text string, label int, source string, group_id string, is_real boolean"
PAIR = "neg string, pos string, group_id string, source string, real string, intensity string"
SCENARIO = "id string, system string, user_turns array<string>, intimate_from int, checks array<struct<expect:array<string>,reject:array<string>>>"
RESULTS = "results map<string,map<string,string>>, group_subtasks map<string,array<string>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, which can be a pattern, names anything in its own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: str = LABELLED) -> DataFrame:
    """JSON lines; a missing file is an empty table, blank lines are no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_labels(spark: SparkSession, path: str, schema: str = LABELLED) -> tuple[DataFrame, DataFrame]:
    """The labelled rows of a file, and their labels alone."""
    rows = read_jsonl(spark, path, schema)
    return rows, rows.select("label")


def read_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """(source, sentence) of all *.txt in order of files and lines, the first of equal lower-cased lines."""
    files = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", r"\r\n|[\n\r]")).alias("line", "raw")).withColumn("sentence", T.strip("raw")).where("sentence <> ''")
    first = lines.groupBy(F.lower("sentence").alias("_key")).agg(F.min(F.struct("file", "line", "sentence")).alias("_r")).select("_r.*")  # a frequent line meets in no task
    return first.select(F.regexp_replace("file", r"\.txt$", "").alias("source"), "sentence", "file", "line")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(source, text): each *.txt whole."""
    return spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("source"), F.col("value").alias("text"))


def read_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All *_pairs.jsonl of a folder, with what stands before _pairs in the file's name as `file`."""
    path = f"{folder}/*_pairs.jsonl"
    if not exists(spark, path):
        return spark.createDataFrame([], PAIR + ", file string")
    return spark.read.schema(PAIR).json(path).withColumn("file", F.regexp_extract("_metadata.file_path", r"([^/]+)_pairs\.jsonl", 1))


def read_scenarios(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    s = read_jsonl(spark, path, SCENARIO)
    return s if kind is None else s.where(F.startswith("id", F.lit(kind + "_")))


def check_scenarios(scenarios: DataFrame) -> None:
    """Every check must belong to a turn."""
    bad = scenarios.where(F.col("checks").isNotNull() & (F.size("checks") != F.size("user_turns"))).select("id").head()
    if bad:
        raise ValueError(f"{bad['id']}: checks and turns differ in number")


def read_attempted(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], "group_id string")
    return spark.read.text(path).select(T.strip("value").alias("group_id")).where("group_id <> ''")


def latest_results(spark: SparkSession, folder: str) -> DataFrame:
    """(task, metrics map<string,double>) of the newest results_*.json under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "results_*.json").load(folder)
    newest = files.agg(F.max_by("content", F.struct("modificationTime", "path")).alias("c"))
    r = newest.select(F.from_json(F.decode("c", "utf-8"), RESULTS).alias("r"))
    numbers = F.transform_values("metrics", lambda _, v: v.try_cast("double"))
    return r.select(F.explode("r.results").alias("task", "metrics")).select("task", numbers.alias("metrics"))


def result_leaves(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "results_*.json").load(folder)
    newest = files.agg(F.max_by("content", F.struct("modificationTime", "path")).alias("c"))
    return newest.select(F.explode(F.flatten(F.map_values(F.from_json(F.decode("c", "utf-8"), RESULTS)["group_subtasks"]))).alias("task")).distinct()


def fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-1 of a file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.sha1("content")).first()[0]


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """(id, replies) of a dump; its first line tells the fingerprint of the scenarios and is no row."""
    return read_jsonl(spark, path, "id string, replies array<string>").where("id IS NOT NULL")


def is_fresh(spark: SparkSession, dump: str, scenarios: str) -> bool:
    """Whether a dump was made from the scenarios as they are; an unreadable or missing first line means no."""
    if not exists(spark, dump):
        return False
    meta = read_jsonl(spark, dump, "_scen string").where("_scen IS NOT NULL").first()
    return meta is not None and meta[0] == fingerprint(spark, scenarios)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_new(rows: DataFrame, path: str, text_col: str = "text") -> None:
    """Append the rows whose stripped lower-case text the table at the path lacks."""
    from proselake.operators.dataset import new_rows

    write_jsonl(new_rows(rows, read_jsonl(rows.sparkSession, path), text_col), path, "append")


def record_attempts(rows: DataFrame, kept: str, attempted: str) -> None:
    """Append a batch of rewrites (group_id, status and others): accepted ones to `kept`, the keys of accepted and rejected ones to
    `attempted`. Keys that failed for other reasons (status error) are in neither, so that the next run tries them again; a key
    that is in `attempted` already isn't written twice."""
    spark = rows.sparkSession
    new = rows.where(F.col("status").isin("accepted", "rejected")).join(read_attempted(spark, attempted).distinct(), "group_id", "left_anti")
    # kept first: a run that ends between the two repeats the batch, and keys that are kept count as done
    done = read_jsonl(spark, kept, "group_id string").distinct()
    new = new.join(done, "group_id", "left_anti")
    write_jsonl(new.where("status = 'accepted'").drop("status"), kept, "append")
    keys = rows.where(F.col("status").isin("accepted", "rejected")).join(read_attempted(spark, attempted).distinct(), "group_id", "left_anti")
    keys.select("group_id").distinct().write.mode("append").text(attempted)


def write_predictions(scored: DataFrame, path: str, threshold: float) -> None:
    """Lines of probability, flag and text, parted by tabs."""
    line = F.concat_ws("\t", F.format_string("%.4f", "score"), F.when(F.col("score") >= threshold, "1").otherwise("0"), "text")
    scored.select(line.alias("value")).write.mode("overwrite").text(path)
