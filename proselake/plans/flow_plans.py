"""Queries of drivers and streams: calibration, thresholds, toggles, weights, snapshots, result pages, and streams that end in the batch answer."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.operators import audit, detectors, objective
from proselake.operators import building as B
from proselake.operators import evaluation as E
from proselake.operators import scoring as S
from proselake.plans.data_plans import horner
from proselake.plans.registry import exploded_, key_, narration_, query, sentences_, strip_, table, tokens_
from proselake.sources import files
from proselake.operators import dataset as D
from proselake.streaming import deltas, ledger, state, twins

_SENT = f"({exploded_('doc_id', sentences_('text'), 'documents')})"


_SCORED = "(SELECT quality AS label, round(CASE WHEN quality=1 THEN 0.35 ELSE 0.05 END + 0.6*length(text)/(length(text)+400.0), 4) AS score FROM documents JOIN labels USING (doc_id))"


@query(f"""WITH r AS {_SCORED}, t AS (SELECT DISTINCT score AS threshold FROM r UNION SELECT 1.0), s AS (SELECT threshold, count(*) FILTER (WHERE score>=threshold AND label=1) AS tp, count(*) FILTER (WHERE score>=threshold AND label=0) AS fp, count(*) FILTER (WHERE label=1) AS pos FROM t, r GROUP BY threshold),
q AS (SELECT threshold, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END AS p, tp/pos AS r FROM s), b AS (SELECT coalesce(min(threshold) FILTER (WHERE p>=0.9)<=0.05 AND max(threshold) FILTER (WHERE p>=0.9)>=0.5, false) AS wide FROM q),
g AS (SELECT threshold, p, r FROM q WHERE p>=0.9 ORDER BY threshold LIMIT 1), f AS (SELECT threshold, p, r FROM q ORDER BY CASE WHEN p+r>0 THEN 2*p*r/(p+r) ELSE 0 END DESC, threshold LIMIT 1), c AS (SELECT * FROM g UNION ALL SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM g))
SELECT 'whole' AS split, CASE WHEN wide THEN 'degenerate' ELSE 'ok' END AS status, CASE WHEN wide THEN -1 ELSE round(threshold,4) END AS threshold, CASE WHEN wide THEN -1 ELSE round(r,4) END AS recall FROM c, b
UNION ALL SELECT 'none', 'empty', -1, -1 UNION ALL SELECT 'one class', 'single_class', -1, -1""")
def calibration(spark, d):
    """The calibration driver on a whole split, an empty one, and one of a single class; -1 where there is no threshold."""
    n = F.length("text")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("quality").alias("label"), F.round(F.when(F.col("quality") == 1, 0.35).otherwise(0.05) + 0.6 * n / (n + 400.0), 4).alias("score"))
    found = [(name, E.calibrate(part)) for name, part in (("whole", rows), ("none", rows.where("false")), ("one class", rows.where("label = 1")))]
    return spark.createDataFrame([(name, c["status"], float(c.get("threshold", -1)), float(c.get("calibration_recall", -1))) for name, c in found], "split string, status string, threshold double, recall double")


@query(f"WITH r AS {_SCORED}, s AS (SELECT *, score>=0.6 AS hit FROM r) SELECT count(*) FILTER (WHERE hit AND label=1) AS tp, count(*) FILTER (WHERE hit AND label=0) AS fp, least(15, count(*) FILTER (WHERE hit<>(label=1))) AS shown FROM s")
def evaluation_run(spark, d):
    """The evaluation driver: the threshold is read, and as many errors as a report shows."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("label", F.col("quality"))
    n = F.length("text")
    scorer = lambda c: F.round(F.when(F.col("label") == 1, 0.35).otherwise(0.05) + 0.6 * n / (n + 400.0), 4)
    confusion, errors = S.evaluated(rows, scorer, 0.6)
    return confusion.select("tp", "fp").crossJoin(errors.agg(F.count(F.lit(1)).alias("shown")))  # one row each


@query("SELECT vec_id, CAST(sum(x) AS DOUBLE) AS total FROM (SELECT vec_id, round(unnest(embedding)::DOUBLE,6) AS x FROM embeddings) GROUP BY vec_id")
def snapshot_restored(spark, d):
    """A matrix is written, edited, and read again as it was."""
    path = files.scratch(spark)
    m = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    m.write.parquet(path + "/snapshot")
    m.withColumn("x", F.col("x") * 0.5).write.parquet(path + "/edited")
    back = spark.read.parquet(path + "/snapshot")
    return back.groupBy("vec_id").agg(F.sum(F.round("x", 6)).alias("total")).withColumn("total", F.round("total", 6))


def _perplexity_sql(source: str, unit: str, most: int) -> str:
    return f"""WITH t AS (SELECT {unit}, unnest(t) AS w, generate_subscripts(t,1)-1 AS pos FROM (SELECT {unit}, {tokens_('text')} AS t FROM {source})), c AS (SELECT {unit}, pos//64 AS chunk, avg(ln(1+length(w))) AS loss, count(*) AS n FROM t WHERE pos<{64 * most} GROUP BY ALL)
SELECT {unit}, round(coalesce(exp(avg(loss) FILTER (WHERE n>=2)),-1),6) AS perplexity, count(*) FILTER (WHERE n>=2) AS n_chunks FROM c GROUP BY {unit}"""


@query(_perplexity_sql("(SELECT * FROM conversations WHERE role='assistant')", "conv_id, turn", 20))
def reply_perplexity(spark, d):
    """Perplexity of replies from a rule's token losses, of 20 chunks each at most, as the probe has it."""
    t = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.posexplode(T.tokens("text")).alias("at", "w")).withColumn("loss", F.log(1.0 + F.length("w")))
    p = S.perplexity(t, ["conv_id", "turn"], chunk=64, most_chunks=20)
    return p.select("conv_id", "turn", F.round(F.when(F.col("perplexity") == float("inf"), -1.0).otherwise(F.col("perplexity")), 6).alias("perplexity"), "n_chunks")


_ESCAPED = "replace(replace(replace(replace(sentence,'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;')"


@query(f"""SELECT doc_id, md5('<p>'||string_agg(CASE WHEN score>=0.7 THEN '<mark title="'||printf('%.2f', score)||'">'||{_ESCAPED}||'</mark>' ELSE {_ESCAPED} END, ' ' ORDER BY i)||'</p>') AS html FROM (SELECT doc_id, i, sentence, length(sentence)/(length(sentence)+64.0) AS score FROM {_SENT}) GROUP BY doc_id""")
def marked_pages(spark, d):
    """Result pages with flagged sentences marked; the detector's caps are far beyond these texts."""
    r = E.detect(table(spark, d, "documents"), lambda c: F.length(c) / (F.length(c) + 64.0), 0.7, most_chars=10_000_000, most_sentences=1_000_000)
    return E.marked_page(r).select("doc_id", F.md5("html").alias("html"))


@query(f"SELECT doc_id, CAST(least(3, len(ss)) AS BIGINT) AS n, len(list_filter(ss[:3], lambda s: length(s)>=60)) AS n_flagged FROM (SELECT doc_id, {sentences_('substr(text,1,500)')} AS ss FROM documents) WHERE len(ss)>0")
def detect_capped(spark, d):
    """The detector with its caps on characters and sentences, which are its interface."""
    r = E.detect(table(spark, d, "documents"), lambda c: F.length(c) / 100.0, 0.6, most_chars=500, most_sentences=3)
    return r.select("doc_id", F.size("sentences").cast("long").alias("n"), "n_flagged")


# ---- streams ----


def _stream(spark, d, name):
    source = table(spark, d, name)
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/{name}.parquet*")


def _ended(spark, stream, mode="append"):
    """What a stream writes to files until all input has been seen."""
    path = files.scratch(spark)
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path + "/out").option("checkpointLocation", path + "/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path + "/out")


@query(f"SELECT md5(key) AS key FROM (SELECT DISTINCT {key_('sentence')} AS key FROM {_SENT} WHERE position(chr(10) IN sentence)=0 AND position(chr(13) IN sentence)=0 AND length({strip_('sentence')})>=3)")
def stream_dedupe(spark, d):
    s = _stream(spark, d, "documents").select(F.explode(T.sentences("text")).alias("text"))
    return _ended(spark, twins.deduplicated(s)).select(F.md5("key").alias("key"))


@query("SELECT doc_id, source FROM documents")
def stream_append(spark, d):
    """An append sink that is run twice writes each row once."""
    path = files.scratch(spark)
    s = _stream(spark, d, "documents").select("doc_id", "source")
    for _ in range(2):
        twins.append_resumable(s, path + "/out", path + "/state").awaitTermination()
    return spark.read.schema("doc_id long, source string").json(path + "/out")


@query(f"SELECT opener, count(*) AS n FROM (SELECT {tokens_('sentence')}[1] AS opener FROM ({exploded_('conv_id, turn', narration_('text'), 'conversations')})) WHERE opener IS NOT NULL GROUP BY opener")
def stream_openers(spark, d):
    """Openers counted batch by batch, each batch's counts appended and summed at the end."""
    path = files.scratch(spark)
    s = _stream(spark, d, "conversations")

    def count(batch, k):
        one = batch.select(F.explode(T.narration_sentences("text")).alias("s")).select(F.get(T.tokens("s"), F.lit(0)).alias("opener")).where("opener IS NOT NULL")
        one.groupBy("opener").agg(F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path + "/out")
        return False

    twins.run_batches(s, path + "/state", count).awaitTermination()
    return spark.read.schema("opener string, n long").parquet(path + "/out").groupBy("opener").agg(F.sum("n").alias("n"))


_OUTCOME = "CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'signup' THEN 'rejected' ELSE 'error' END"
_RETRY_MS = 6 * 3_600_000


@query(f"""WITH a AS (SELECT user_id AS key, event_id AS attempt, epoch_us(ts)//1000 AS t, {_OUTCOME} AS outcome FROM events),
w AS (SELECT *, count(*) FILTER (WHERE outcome='error') OVER o AS failures, lead(t) OVER o AS next, row_number() OVER o AS n FROM a WINDOW o AS (PARTITION BY key ORDER BY t, attempt)),
e AS (SELECT key, n, failures, CASE WHEN outcome<>'error' THEN outcome WHEN failures=3 THEN 'exhausted' ELSE 'expired' END AS status, CASE WHEN outcome<>'error' OR failures=3 THEN t ELSE t+{_RETRY_MS} END AS ended
FROM w WHERE outcome<>'error' OR failures=3 OR next IS NULL OR next>t+{_RETRY_MS})
SELECT key, status, CAST(failures AS INT) AS failures, CAST(ended AS BIGINT) AS ended FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY n)=1""")
def stream_ledger(spark, d):
    """Attempts of users, from their events in slices of a quarter of the time, each slice by a stream that starts again where the last one ended."""
    path = files.scratch(spark)
    outcome = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "signup", "rejected").otherwise("error")
    a = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("attempt"), F.col("ts").cast("timestamp").alias("at"), outcome.alias("outcome"))
    first, last = a.agg(F.min(F.unix_millis("at")), F.max(F.unix_millis("at"))).first()
    quarter = F.floor((F.unix_millis("at") - first) * 4 / (last - first + 1))
    closing = spark.createDataFrame([(None, None)], "key long, attempt long").select("key", "attempt", F.timestamp_millis(F.lit(last + 40 * 86_400_000)).alias("at"), F.lit("error").alias("outcome"))
    for k in range(5):  # the last slice moves the time beyond every key's end
        (a.where(quarter == k) if k < 4 else closing).write.mode("append").parquet(path + "/in")
        stream = ledger.ledger_stream(spark.readStream.schema(a.schema).parquet(path + "/in"), 3, "6 hours", "1 day")
        with state.keyed_state(spark):
            q = stream.writeStream.format("parquet").option("path", path + "/out").option("checkpointLocation", path + "/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path + "/out").withColumn("ended", F.unix_millis("ended"))


@query(exploded_("doc_id", sentences_("text"), "documents"))
def stream_sentences(spark, d):
    """Sentences of documents whose texts come in pieces of 200 characters, a third of each text in each batch."""
    path = files.scratch(spark)
    docs = table(spark, d, "documents")
    pieces, shards = deltas.in_pieces(docs), max(64, docs.count() // 256)
    for k in range(3):
        pieces.where(F.floor(F.col("at") * 3 / F.col("n")) == k).drop("n").write.mode("append").parquet(path + "/in")
        stream = deltas.sentence_stream(spark.readStream.schema(pieces.drop("n").schema).parquet(path + "/in"), shards=shards)
        with state.keyed_state(spark):
            q = stream.writeStream.format("parquet").option("path", path + "/out").option("checkpointLocation", path + "/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path + "/out").withColumn("i", F.col("i").cast("long"))


_SLICE = horner("md5('slice:'||CAST(conv_id AS VARCHAR))", 4, 8)
_BASE = {"opener": 0.01, "struct": 0.0}
_OBJECTIVE = 0.02


@query(rf"""WITH r AS (SELECT {_SLICE} AS k, {sentences_('text')} AS ss, string_split_regex(coalesce(text,''),'\r?\n') AS ls FROM conversations WHERE role='assistant'),
f AS (SELECT k, list_transform(ss, lambda s: lower(string_split_regex(s,'\s+')[1])) AS f, len(list_filter(ls, lambda l: regexp_matches(l,'\S'))) AS n_lines, len(list_filter(ls, lambda l: regexp_matches(l,'^\s*(\*\*|#{{1,3}}\s|\d+\.\s|[-*•]\s)'))) AS marked FROM r),
b AS (SELECT k, count(*) AS done, sum(CASE WHEN len(f)>=2 THEN (len(f)-len(list_distinct(f)))/(len(f)-1) END) AS reuse, count(*) FILTER (WHERE len(f)>=2) AS told, sum(n_lines) AS n_lines, sum(marked) AS marked FROM f GROUP BY k),
s AS (SELECT s.k, coalesce(sum(done),0) AS done, coalesce(sum(reuse),0) AS reuse, coalesce(sum(told),0) AS told, coalesce(sum(n_lines),0) AS n_lines, coalesce(sum(marked),0) AS marked, (SELECT sum(done) FROM b) AS total FROM (SELECT unnest(range(0,8)) AS k) s LEFT JOIN b ON b.k<=s.k GROUP BY s.k),
e AS (SELECT k, done, total, greatest(0, coalesce(reuse/nullif(told,0),0)*done/total-{_BASE['opener']}) AS o, greatest(0, coalesce(marked/nullif(n_lines,0),0)*done/total-{_BASE['struct']}) AS m FROM s),
p AS (SELECT k, done, total, 2*o+8*o*o+2*m+8*m*m AS penalty FROM e), a AS (SELECT k, done, round({_OBJECTIVE}+penalty,6) AS value FROM p WHERE done>0 AND done<total AND penalty>{_OBJECTIVE}+0.05 ORDER BY k LIMIT 1)
SELECT CAST(k AS INT) AS batch, CAST(done AS BIGINT) AS done, value FROM a UNION ALL SELECT -1, CAST((SELECT max(total) FROM s) AS BIGINT), -1 WHERE NOT EXISTS (SELECT 1 FROM a)""")
def stream_aborted(spark, d):
    """Replies that come in eight slices, stopped at the slice after which clean replies alone could no longer save the run."""
    path = files.scratch(spark)
    replies = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    total = replies.count()
    f, lines = detectors.first_words(), F.filter(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), lambda line: line.rlike(r"\S"))
    marked = F.filter(lines, lambda line: line.rlike(r"^\s*(\*\*|#{1,3}\s|\d+\.\s|[-*•]\s)"))
    rate = detectors.reuse_rate(f)
    metrics = {"done": F.count(F.lit(1)), "reuse": F.sum(rate), "told": F.count(rate), "n_lines": F.sum(F.size(lines)), "marked": F.sum(F.size(marked))}

    def bound(m):
        rates = {"opener": m["reuse"] / m["told"] if m["told"] else 0.0, "struct": m["marked"] / m["n_lines"] if m["n_lines"] else 0.0}
        return objective.partial_reject_value(rates, _BASE, m["done"], total, _OBJECTIVE)

    sums = {}
    for k in range(8):
        replies.where(D.md5_bucket("slice", F.col("conv_id"), 8) == k).write.mode("append").parquet(path + "/in")
        stream = spark.readStream.schema(replies.schema).parquet(path + "/in")
        try:
            sums = twins.run_bounded(stream, path + "/state", lambda b, _: b.write.mode("append").parquet(path + "/out"), metrics, bound, sums)
        except twins.Aborted as a:
            done = spark.read.schema(replies.schema).parquet(path + "/out").count()
            return spark.createDataFrame([(k, done, round(a.value, 6))], "batch int, done long, value double")
    return spark.createDataFrame([(-1, total, -1.0)], "batch int, done long, value double")
