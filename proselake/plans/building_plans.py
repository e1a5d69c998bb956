"""Queries of the whole flows: data set splits, pairs, scenarios, rollout summaries, pooling and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.operators import building as B
from proselake.operators import dataset as D
from proselake.operators import detectors
from proselake.operators import vectors as V
from proselake.plans.data_plans import _TURN, PAIRS, horner, neighbours, rounded, turn_values
from proselake.plans.registry import exploded_, key_, narration_, query, sentences_, strip_, table, tokens_
from proselake.plans.text_plans import _REP, GUARD
from proselake.plans.vector_plans import LONG, long

_ROWS = f"({exploded_('doc_id', sentences_('text'), 'documents')})"
_OK = f"(position(chr(10) IN text)=0 AND position(chr(13) IN text)=0 AND length({strip_('text')})>=3)"
_FIRST = "row_number() OVER (PARTITION BY {k} ORDER BY prio, idx)=1"
_BUILD = f"""s AS (SELECT s.sentence AS text, d.source, d.doc_id, d.lang, s.doc_id*100000+s.i AS idx FROM {_ROWS} s JOIN documents d USING (doc_id)),
pool AS (SELECT text, 0 AS label, 0 AS prio, idx, doc_id FROM s WHERE lang='de' UNION ALL SELECT text, 1, 1, idx, doc_id FROM s WHERE lang='en'),
p AS (SELECT *, {key_('text')} AS key FROM pool WHERE {_OK} QUALIFY {_FIRST.format(k=key_('text'))}),
human AS (SELECT text, 0 AS prio, idx, doc_id FROM s WHERE lang IN ('fr','en')),
h AS (SELECT *, {key_('text')} AS key FROM human WHERE {_OK} QUALIFY {_FIRST.format(k=key_('text'))}),
a AS (SELECT key, label, CASE WHEN prio=0 THEN 'de_' ELSE 'en_' END||substr(md5(key),1,12) AS g, true AS pool FROM p UNION ALL SELECT key, 0, 'human_'||substr(md5(key),1,12), false FROM h WHERE key NOT IN (SELECT key FROM p)),
o AS (SELECT md5(key) AS key, label, g AS group_id, CASE WHEN pool THEN CASE WHEN {horner("md5('val:'||g)", 4, 1000)}<150 THEN 'val' ELSE 'train' END ELSE CASE WHEN {horner("md5('test:'||g)", 4, 1000)}<500 THEN 'test' ELSE 'calibration' END END AS split FROM a)"""


def _sentences(spark, d):
    docs = table(spark, d, "documents")
    s = detectors.exploded_sentences(docs, "doc_id", "text").join(docs.select("doc_id", "lang"), "doc_id")
    return s.select(F.col("sentence").alias("text"), "lang", "doc_id", (F.col("doc_id") * 100000 + F.col("i")).alias("idx"))


@query(f"WITH {_BUILD} SELECT * FROM o")
def dataset_build(spark, d):
    s = _sentences(spark, d)
    pool = D.pool([B.grouped(s.where("lang = 'de'"), "de", label=0), B.grouped(s.where("lang = 'en'"), "en", label=1)])
    human = D.pool([B.grouped(s.where("lang IN ('fr', 'en')"), "human", label=0)])
    return B.splits(pool, human).select(F.md5(T.dedup_key("text")).alias("key"), "label", "group_id", "split")


@query(f"WITH {_BUILD} SELECT split, count(*) AS n, count(*) FILTER (WHERE label=1) AS positives FROM o GROUP BY split")
def split_sizes(spark, d):
    return dataset_build(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("positives"))


@query("SELECT doc_id FROM documents WHERE source IN ('src1','src2')")
def genre_filter(spark, d):
    return B.of_genre(table(spark, d, "documents").withColumnRenamed("source", "genre"), ("src1", "src2")).select("doc_id")


_MADE = strip_("regexp_replace(regexp_replace(" + strip_("made") + ",'^\"+|\"+$','','g'),'^''+|''+$','','g')")


@query(f"""WITH p AS (SELECT doc_id, i, seed, {_MADE} AS s, CASE WHEN i%2=0 THEN 'worsen' ELSE 'improve' END AS dir FROM {PAIRS} WHERE made IS NOT NULL),
g AS (SELECT *, {horner("sha1('i'||seed)", 5, 100)} AS b FROM p WHERE position(chr(10) IN s)=0 AND length(s)>=12 AND regexp_matches(s,'[.?!]\\z') AND lower(s)<>lower(seed) AND length(s)<=2.5*length(seed) AND len({sentences_('s')})=1)
SELECT md5(CASE WHEN dir='worsen' THEN seed ELSE s END) AS neg, md5(CASE WHEN dir='worsen' THEN s ELSE seed END) AS pos, 'pair_'||substr(sha1(seed),1,12) AS group_id, CASE WHEN dir='worsen' THEN 'neg' ELSE 'pos' END AS real,
CASE WHEN dir='improve' THEN 'better' WHEN b<35 THEN 'light' WHEN b<75 THEN 'moderate' ELSE 'strong' END AS intensity FROM g""")
def build_pairs(spark, d):
    axis = B.Axis("plain", {"worsen": ("Rewrite.", "{desc}: {orig}", 0.7)}, {"light": 35, "moderate": 40, "strong": 25})
    r = neighbours(spark, d).where("made IS NOT NULL").withColumn("direction", F.when(F.col("i") % 2 == 0, "worsen").otherwise("improve")).withColumn("source", F.lit("x"))
    return axis.pairs(r).select(F.md5("neg").alias("neg"), F.md5("pos").alias("pos"), "group_id", "real", "intensity")


@query("SELECT doc_id, 'light: '||source AS content FROM documents")
def prompt_messages(spark, d):
    axis = B.Axis("plain", {"worsen": ("Rewrite.", "{desc}: {orig}", 0.7)})
    m = axis.messages("worsen", F.col("source"), F.lit("light"))
    return table(spark, d, "documents").select("doc_id", m[1]["content"].alias("content"))


_SCEN = f"(SELECT doc_id AS row, source AS task, {sentences_('text')}[1] AS passage, {sentences_('text')}[2] AS question, {tokens_('text')}[1] AS answer FROM documents)"


@query(f"""WITH q AS (SELECT * FROM {_SCEN} WHERE passage IS NOT NULL AND question IS NOT NULL AND answer IS NOT NULL), f AS (SELECT * FROM q ORDER BY row LIMIT 2),
p AS (SELECT 'Solved examples:'||chr(10)||chr(10)||string_agg({strip_('passage')}||chr(10)||{strip_('question')}||chr(10)||'Answer: '||answer, chr(10)||chr(10) ORDER BY row)||chr(10)||chr(10)||'Now answer this question:'||chr(10) AS primer FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY row) AS depth FROM q WHERE row NOT IN (SELECT row FROM f)), t AS (SELECT *, row_number() OVER (ORDER BY depth, task)-1 AS k FROM r ORDER BY depth, task LIMIT 50)
SELECT 'q_t'||task||'_'||k AS id, md5(primer||{strip_('passage')}||chr(10)||{strip_('question')}) AS prompt, lower(answer) AS expect FROM t, p""")
def question_scenarios(spark, d):
    s = T.sentences("text")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("row"), F.col("source").alias("task"), F.get(s, F.lit(0)).alias("passage"), F.get(s, F.lit(1)).alias("question"), F.get(T.tokens("text"), F.lit(0)).alias("answer"))
    q = B.question_scenarios(rows.where("passage IS NOT NULL AND question IS NOT NULL AND answer IS NOT NULL"), "One word.", 50, 2)
    return q.select("id", F.md5(F.col("user_turns")[0]).alias("prompt"), F.col("checks")[0]["expect"][0].alias("expect"))


_SCORE = "1-1/(1+CAST(length(s) AS DOUBLE)/50)"


@query(f"""WITH f AS (SELECT role, list_transform({sentences_('text')}, lambda s: lower(string_split_regex(s,'\\s+')[1])) AS f, {sentences_('text')} AS ss, text FROM conversations),
b AS (SELECT role, avg(coalesce(list_sum(list_transform(ss, lambda s: {_SCORE}))/nullif(len(ss),0),0)) AS score, avg(coalesce(list_sum(list_transform(ss, lambda s: len(string_split_regex(s,'\\s+'))))/nullif(len(ss),0),0)) AS wps, sum(len(ss)) AS sentences,
avg((len(f)-len(list_distinct(f)))/(len(f)-1)) FILTER (WHERE len(f)>=2) AS opener FROM f GROUP BY role),
l AS (SELECT role, avg(CASE WHEN regexp_matches(line,'^\\s*(\\*\\*|#{{1,3}}\\s|\\d+\\.\\s|[-*•]\\s)') THEN 1.0 ELSE 0.0 END) AS struct FROM (SELECT role, unnest(string_split_regex(text,'\\r?\\n')) AS line FROM conversations) WHERE regexp_matches(line,'\\S') GROUP BY role),
t AS (SELECT role, {tokens_('text', "[a-z'']+")} AS t FROM conversations), c AS (SELECT role, t, list_filter(t, lambda w: NOT list_contains({GUARD}, w)) AS c FROM t WHERE len(t)>=4),
n AS (SELECT role, avg(greatest({_REP} CASE WHEN len(c)>0 THEN list_max(map_values(list_histogram(c)))/len(c) ELSE 0 END)) AS intra FROM c GROUP BY role)
SELECT role, round(score,8) AS score, round(wps,8) AS wps, CAST(sentences AS BIGINT) AS sentences, round(CAST(struct AS DOUBLE),8) AS struct, round(opener,8) AS opener, round(intra,8) AS intra FROM b JOIN l USING (role) JOIN n USING (role)""")
def rollout_summary(spark, d):
    r = B.rollout_summary(table(spark, d, "conversations"), ["role"], lambda s: 1 - 1 / (1 + F.length(s).cast("double") / 50))
    return rounded(r, "score", "wps", "struct", "opener", "intra")


@query(f"""WITH f AS (SELECT role, {narration_('text')} AS ss FROM conversations), g AS (SELECT role, ss, array_to_string(ss,' ') AS t FROM f)
SELECT role, round(sum(coalesce(list_sum(list_transform(ss, lambda s: {_SCORE})),0))/sum(len(ss)),8) AS score, round(sum(len(regexp_extract_all(lower(t),'(?:^|[^\\p{{L}}\\p{{N}}_])(?:de\\s+la|of\\s+the)(?:$|[^\\p{{L}}\\p{{N}}_])')))/sum(len(regexp_extract_all(t,'[\\p{{L}}\\p{{N}}_]+'))),8) AS density FROM g GROUP BY role""")
def narration_score(spark, d):
    r = B.narration_score(table(spark, d, "conversations"), ["role"], lambda s: 1 - 1 / (1 + F.length(s).cast("double") / 50), ["of the", "de la"], apart=True)
    return rounded(r, "score", "density")


@query(f"WITH c AS (SELECT turn, avg(value) AS value FROM {_TURN} GROUP BY turn), m AS (SELECT max(turn) AS last FROM c) SELECT round(sum(value*(turn+1))/sum(turn+1),8) AS late_weighted, round(sum(value) FILTER (WHERE turn<2)/2,8) AS early, round(sum(value) FILTER (WHERE turn>last-2)/2,8) AS late, sum(value*(turn+1))/sum(turn+1)>0.2 AS passes FROM c, m")
def baseline_gate(spark, d):
    curve = turn_values(spark, d).groupBy("turn").agg(F.avg("value").alias("value"))
    return rounded(B.baseline_gate(curve), "late_weighted", "early", "late")


@query(f"""WITH r AS (SELECT sum(len({sentences_('text')})) AS n, count(*) AS turns, sum(len(regexp_extract_all(lower(text),'(?:^|[^\\p{{L}}\\p{{N}}_])of\\s+the(?:$|[^\\p{{L}}\\p{{N}}_])'))) AS a, sum(len(regexp_extract_all(lower(text),'(?:^|[^\\p{{L}}\\p{{N}}_])de\\s+la(?:$|[^\\p{{L}}\\p{{N}}_])'))) AS b, sum(len(regexp_extract_all(text,'[\\p{{L}}\\p{{N}}_]+'))) AS w FROM conversations)
SELECT round(n/turns,8) AS coverage, round(a/w,8) AS first, round(b/w,8) AS second, n/turns>=1.5 AND a>b AS passes FROM r""")
def coverage_gate(spark, d):
    return rounded(B.coverage_gate(table(spark, d, "conversations"), ["of the"], ["de la"], apart=True), "coverage", "first", "second")


@query(f"WITH {LONG}, m AS (SELECT vec_id//4 AS unit, vec_id%4<3 AS m, dim, x FROM long) SELECT unit, CAST(dim AS INT) AS dim, round(sum(x*CASE WHEN m THEN 1 ELSE 0 END)/greatest(sum(CASE WHEN m THEN 1 ELSE 0 END),1),8) AS x FROM m GROUP BY unit, dim")
def mean_pooling(spark, d):
    t = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("unit"), (F.col("vec_id") % 4 < 3).alias("m"), "embedding")
    return rounded(V.mean_pooled(t, ["unit"], mask="m"), "x")


@query(f"WITH {LONG}, c AS (SELECT dim, covar_pop(label, x) AS c FROM long GROUP BY dim) SELECT CAST(dim AS INT) AS dim, round(c/greatest(sqrt(sum(c*c) OVER ()),1e-8),8) AS axis FROM c")
def covariance_axis(spark, d):
    return rounded(V.covariance_axis(long(spark, d).withColumn("label", F.col("label").cast("double")), "label"), "axis")
