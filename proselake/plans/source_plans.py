"""Queries of sources and sinks: tables go out in a format and come back through its reader."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.operators import choices as C
from proselake.operators import dataset as D
from proselake.sources import files, lines, readers
from proselake.plans.registry import exploded_, query, sentences_, strip_, table


def labelled(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select("text", F.col("quality").alias("label"), "source", F.col("doc_id").cast("string").alias("group_id"), (F.col("toxic") == 0).alias("is_real"))


_LABELLED = "(SELECT text, quality AS label, source, CAST(doc_id AS VARCHAR) AS group_id, toxic=0 AS is_real FROM documents JOIN labels USING (doc_id))"


@query(f"SELECT md5(text) AS text, label, source, group_id, is_real FROM {_LABELLED}")
def jsonl_rows(spark, d):
    """Labelled rows as JSON lines with blank lines between, and a file that isn't there."""
    folder = files.scratch(spark)
    lines = labelled(spark, d).select(F.explode(F.array(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), F.lit(""))).alias("value"))
    lines.write.text(folder + "/rows")
    rows = readers.read_jsonl(spark, folder + "/rows").unionByName(readers.read_jsonl(spark, folder + "/missing"))
    return rows.withColumn("text", F.md5("text"))


@query(f"SELECT label, count(*) AS n FROM {_LABELLED} GROUP BY label")
def label_vector(spark, d):
    path = files.scratch(spark)
    readers.write_jsonl(labelled(spark, d), path)
    rows, labels = readers.read_labels(spark, path)
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_LINES = f"({exploded_('doc_id', sentences_('text'), 'documents')})"


def seed_file(spark, d):
    """All sentences, a line each, in files that follow one another by name."""
    folder = files.scratch(spark)
    s = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("i", "sentence"))
    s.where(~F.col("sentence").rlike(r"[\r\n]")).orderBy("doc_id", "i").select(F.col("sentence").alias("value")).write.text(folder)
    return folder


@query(f"SELECT sentence FROM (SELECT doc_id, i, {strip_('sentence')} AS sentence FROM {_LINES} WHERE NOT regexp_matches(sentence,'[\\r\\n]')) WHERE sentence<>'' QUALIFY row_number() OVER (PARTITION BY lower(sentence) ORDER BY doc_id, i)=1")
def seed_lines(spark, d):
    return readers.read_seeds(spark, seed_file(spark, d)).select("sentence")


@query("SELECT CAST(sum(length(text)+1) AS BIGINT) AS n_chars FROM documents WHERE text IS NOT NULL")
def whole_documents(spark, d):
    folder = files.scratch(spark)
    table(spark, d, "documents").where("text IS NOT NULL").select(F.col("text").alias("value")).write.text(folder)
    return readers.read_documents(spark, folder).agg(F.sum(F.length("text")).alias("n_chars"))


@query("""SELECT file, count(*) AS n, count(DISTINCT group_id) AS groups FROM (SELECT CASE WHEN doc_id%3=0 THEN 'curated' ELSE 'made' END AS file, 'pair_'||substr(sha1(text),1,12) AS group_id FROM documents WHERE text IS NOT NULL) GROUP BY file""")
def pair_files(spark, d):
    folder = files.scratch(spark)
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.lower("text").alias("neg"), F.col("text").alias("pos"), D.pair_group("text").alias("group_id"), "source", F.lit("pos").alias("real"), F.lit(None).cast("string").alias("intensity"))
    for name, part in (("curated", F.col("doc_id") % 3 == 0), ("made", F.col("doc_id") % 3 != 0)):
        readers.write_jsonl(rows.where(part).drop("doc_id"), f"{folder}/{name}_pairs.jsonl")
    readers.write_jsonl(rows.limit(1), f"{folder}/candidates.jsonl")
    return readers.read_pairs(spark, folder).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("groups"))


def scenarios(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    kind = F.when(F.col("conv_id") % 4 == 0, "collapse_").when(F.col("conv_id") % 4 == 3, "other_").otherwise("bait_")
    return c.select(F.concat(kind, F.col("conv_id")).alias("id"), F.lit("s").alias("system"), F.transform("t", lambda x: x["text"]).alias("user_turns"))


_KIND = "CASE WHEN conv_id%4=0 THEN 'collapse' WHEN conv_id%4=3 THEN 'other' ELSE 'bait' END"


@query(f"SELECT {_KIND}||'_'||conv_id AS id, count(*) AS turns FROM conversations WHERE role='user' AND {_KIND}='bait' GROUP BY conv_id")
def scenario_rows(spark, d):
    path = files.scratch(spark)
    readers.write_jsonl(scenarios(spark, d), path)
    s = readers.read_scenarios(spark, path, "bait")
    readers.check_scenarios(s)
    return s.select("id", F.size("user_turns").cast("long").alias("turns"))


@query(f"SELECT id, kind AS set FROM (SELECT DISTINCT {_KIND}||'_'||conv_id AS id, {_KIND} AS kind FROM conversations WHERE role='user') WHERE kind IN ('bait','collapse') QUALIFY row_number() OVER (PARTITION BY kind ORDER BY id)<=5")
def scenario_sets(spark, d):
    return C.scenario_sets(scenarios(spark, d), n=5).select("id", "set")


@query(f"SELECT md5({_KIND}||'_'||conv_id) AS id, count(*) FILTER (WHERE role='assistant') AS replies, true AS fresh, false AS other_fresh FROM conversations GROUP BY conv_id")
def reply_dump(spark, d):
    """A dump with the fingerprint of its scenarios: fresh for them, not for others; its first line is no row."""
    folder = files.scratch(spark)
    own = files.write_file(spark, folder + "/scenarios.jsonl", '{"id":"bait_1","user_turns":["a"]}\n')
    other = files.write_file(spark, folder + "/others.jsonl", '{"id":"bait_2","user_turns":["a"]}\n')
    files.write_file(spark, folder + "/dump/meta.jsonl", json.dumps({"_scen": readers.fingerprint(spark, own)}) + "\n")
    kind = F.when(F.col("conv_id") % 4 == 0, "collapse_").when(F.col("conv_id") % 4 == 3, "other_").otherwise("bait_")
    r = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "assistant", F.coalesce("text", F.lit("")))).alias("replies"))
    readers.write_jsonl(r.select(F.concat(kind, F.col("conv_id")).alias("id"), "replies"), folder + "/dump", "append")
    fresh, stale = (F.lit(readers.is_fresh(spark, folder + "/dump", s)) for s in (own, other))
    return readers.read_replies(spark, folder + "/dump").select(F.md5("id").alias("id"), F.size("replies").cast("long").alias("replies"), fresh.alias("fresh"), stale.alias("other_fresh"))


@query(f"SELECT md5(lower({strip_('text')})) AS key, min(label) AS label FROM (SELECT text, 1 AS label FROM benchmark UNION ALL SELECT text, 2 FROM benchmark UNION ALL SELECT text||' more', 2 FROM benchmark) GROUP BY ALL")
def appended_rows(spark, d):
    """Rows in the file, then a batch of which only new texts are appended."""
    path = files.scratch(spark)
    b = table(spark, d, "benchmark").select(T.strip("text").alias("text"))
    readers.write_jsonl(b.withColumn("label", F.lit(1)).dropDuplicates(["text"]), path)
    readers.append_new(b.select(F.concat(F.lit("  "), "text").alias("text"), F.lit(2).alias("label")).union(b.select(F.concat("text", F.lit(" more")), F.lit(2))), path)
    return readers.read_jsonl(spark, path).select(F.md5(F.lower(T.strip("text"))).alias("key"), "label")


_ATTEMPT = "CASE WHEN doc_id%5=0 THEN 'error' WHEN doc_id%5=1 THEN 'rejected' ELSE 'accepted' END"


@query("SELECT doc_id%5=0 AS was_error, count(*) FILTER (WHERE doc_id%5<>1) AS kept, count(*) AS attempted, CAST(0 AS BIGINT) AS remaining FROM documents GROUP BY ALL")
def resumed_attempts(spark, d):
    """A run in which some seeds fail, one that repeats it, and one in which what was left succeeds."""
    folder = files.scratch(spark)
    seeds = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("group_id"), "doc_id")
    status = F.when(F.col("doc_id") % 5 == 0, "error").when(F.col("doc_id") % 5 == 1, "rejected").otherwise("accepted")
    kept, attempted = folder + "/kept", folder + "/attempted"
    for _ in range(2):
        readers.record_attempts(seeds.withColumn("status", status), kept, attempted)

    def left():
        return D.remaining(seeds, readers.read_jsonl(spark, kept, "group_id string"), readers.read_attempted(spark, attempted))

    readers.record_attempts(left().withColumn("status", F.lit("accepted")), kept, attempted)
    was = (F.col("group_id").cast("long") % 5 == 0).alias("was_error")
    k = readers.read_jsonl(spark, kept, "group_id string").groupBy(was).agg(F.count(F.lit(1)).alias("kept"))
    a = readers.read_attempted(spark, attempted).groupBy(was).agg(F.count(F.lit(1)).alias("attempted"))
    r = left().groupBy((F.col("doc_id") % 5 == 0).alias("was_error")).agg(F.count(F.lit(1)).alias("remaining"))
    return k.join(a, "was_error").join(r, "was_error", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0)).cast("long"))


@query("SELECT md5(printf('%.4f', length(text)/(length(text)+64.0))||chr(9)||CASE WHEN length(text)/(length(text)+64.0)>=0.7 THEN '1' ELSE '0' END||chr(9)||replace(replace(text,chr(10),' '),chr(13),' ')) AS line FROM benchmark")
def prediction_lines(spark, d):
    path = files.scratch(spark)
    b = table(spark, d, "benchmark").select(F.translate("text", "\n\r", "  ").alias("text"), (F.length("text") / (F.length("text") + 64.0)).alias("score"))
    readers.write_predictions(b, path, 0.7)
    return spark.read.text(path).select(F.md5("value").alias("line"))


_LINES = r"(SELECT doc_id, unnest(string_split(translate(coalesce(text,''),chr(13),chr(10)),chr(10))) AS line FROM documents)"
_LINE_SCORE = "length(line)/(length(line)+64.0)"


@query(rf"SELECT md5(text) AS text, count(*) AS n, CASE WHEN {_LINE_SCORE.replace('line','text')}>=0.7 THEN 1 ELSE 0 END AS flag FROM (SELECT {strip_('line')} AS text FROM {_LINES}) WHERE text<>'' GROUP BY ALL")
def scored_lines(spark, d):
    """Lines of all documents written as text, streamed from there through a scorer to the sink of predictions, and read back."""
    lines.register(spark)
    path = files.scratch(spark)
    told = table(spark, d, "documents").select(F.explode(F.split(F.translate(F.coalesce("text", F.lit("")), "\r", "\n"), "\n")).alias("value")).select(T.strip("value").alias("value")).where("value <> ''")
    told.write.text(path + "/in")
    s = spark.readStream.format(lines.SOURCE).option("path", path + "/in").load()
    s = s.select((F.length("text") / (F.length("text") + 64.0)).alias("score"), "text")
    s.writeStream.format(lines.SINK).option("path", path + "/out").option("threshold", 0.7).option("checkpointLocation", path + "/state").trigger(once=True).start().awaitTermination()
    back = spark.read.format(lines.SOURCE).option("path", path + "/out").load().select(F.split("text", "\t", 3).alias("p"))
    return back.select(F.md5(F.get("p", F.lit(2))).alias("text"), F.get("p", F.lit(1)).cast("int").alias("flag")).groupBy("text", "flag").agg(F.count(F.lit(1)).alias("n"))
