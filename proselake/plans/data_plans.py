"""Queries of dataset building, classifier analytics, grading and objectives."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.operators import dataset as D
from proselake.operators import detectors
from proselake.operators import evaluation as E
from proselake.operators import grading as G
from proselake.operators import objective as O
from proselake.plans.registry import exploded_, key_, query, sentences_, strip_, table, tokens_
from proselake.plans.text_plans import _REP, GUARD, STOP

# ---- labelled sentences: those of labelled documents, in order of source and place ----

SENT = f"({exploded_('doc_id', sentences_('text'), 'documents')})"
POOL = f"(SELECT s.sentence AS text, l.quality AS label, d.source, d.doc_id, s.i, d.doc_id*100000+s.i AS idx FROM {SENT} s JOIN documents d USING (doc_id) JOIN labels l USING (doc_id))"
VALID = f"(position(chr(10) IN text)=0 AND position(chr(13) IN text)=0 AND length({strip_('text')})>=3)"
RANKED = f"(SELECT *, {key_('text')} AS key, row_number() OVER (PARTITION BY {key_('text')} ORDER BY source, idx) AS rank, first_value(label) OVER (PARTITION BY {key_('text')} ORDER BY source, idx) AS kept_label FROM {POOL} WHERE {VALID})"


def sentences_of(docs):
    return detectors.exploded_sentences(docs, "doc_id", "text")


def pool_rows(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    s = sentences_of(docs).join(docs.select("doc_id", "source"), "doc_id").join(labels.select("doc_id", "quality"), "doc_id")
    return s.select(F.col("sentence").alias("text"), F.col("quality").alias("label"), "source", "doc_id", "i", (F.col("doc_id") * 100000 + F.col("i")).alias("idx"))


@query(f"SELECT doc_id, i, label, md5(key) AS key FROM {RANKED} WHERE rank=1")
def pool_dedupe(spark, d):
    r = D.first_of_each(pool_rows(spark, d), order=["source", "idx"])
    return r.select("doc_id", F.col("i").cast("long").alias("i"), "label", F.md5("key").alias("key"))


@query(f"SELECT count(*) FILTER (WHERE rank=1) AS kept, count(*) FILTER (WHERE rank>1) AS dup, count(*) FILTER (WHERE rank>1 AND label<>kept_label) AS conflict, (SELECT count(*) FROM {POOL} WHERE NOT {VALID}) AS bad FROM {RANKED}")
def pool_conflicts(spark, d):
    return D.dedupe_counts(pool_rows(spark, d), order=["source", "idx"])


@query(f"SELECT item_id, md5({key_('text')}) AS key FROM benchmark b WHERE {key_('text')} NOT IN (SELECT {key_('sentence')} FROM {SENT})")
def leak_anti_join(spark, d):
    pool = sentences_of(table(spark, d, "documents"))
    left = D.without_leaks(table(spark, d, "benchmark"), pool, other_col="sentence")
    return left.select("item_id", F.md5(T.dedup_key("text")).alias("key"))


@query(f"WITH b AS ({exploded_('item_id', sentences_('text'), 'benchmark')}), s AS (SELECT DISTINCT {key_('sentence')} AS k FROM {SENT}) SELECT item_id, i, {key_('sentence')} IN (SELECT k FROM s) AS leaks FROM b")
def leaking_sentences(spark, d):
    b = detectors.exploded_sentences(table(spark, d, "benchmark"), "item_id", "text")
    kept = D.without_leaks(b, sentences_of(table(spark, d, "documents")), "sentence", "sentence").select("item_id", "i", F.lit(False).alias("leaks"))
    return b.join(kept, ["item_id", "i"], "left").select("item_id", F.col("i").cast("long").alias("i"), F.coalesce("leaks", F.lit(True)).alias("leaks"))


def horner(digest: str, chunks: int, modulo: int) -> str:
    step, v = (1 << 32) % modulo, "0"
    for k in range(chunks):
        v = f"(({v})*{step} + CAST('0x'||substr({digest},{8 * k + 1},8) AS BIGINT)) % {modulo}"
    return v


@query(f"SELECT doc_id, {horner(chr(109) + 'd5(' + chr(39) + 'val:' + chr(39) + '||doc_id)', 4, 1000)} AS bucket, {horner(chr(109) + 'd5(' + chr(39) + 'val:' + chr(39) + '||doc_id)', 4, 1000)} < 150 AS validation FROM documents")
def hash_split(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", D.md5_bucket("val", k).alias("bucket"), D.held_out(k, 0.15, "val").alias("validation"))


@query(f"SELECT source, count(*) AS n, {horner(chr(109) + 'd5(' + chr(39) + 'test:' + chr(39) + '||source)', 4, 1000)} < 500 AS test FROM documents GROUP BY source")
def group_split(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("test", D.held_out(F.col("source"), 0.5, "test"))


@query(f"SELECT doc_id, 'doc_'||substr(md5({key_('text')}),1,12) AS group_id, 'pair_'||substr(sha1(text),1,12) AS pair_id FROM documents")
def stable_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", D.text_group("doc", "text").alias("group_id"), D.pair_group("text").alias("pair_id"))


@query(f"WITH b AS (SELECT doc_id, {horner('sha1(' + chr(39) + 'i' + chr(39) + '||text)', 5, 100)} AS b FROM documents) SELECT doc_id, CASE WHEN b<35 THEN 'light' WHEN b<75 THEN 'moderate' ELSE 'strong' END AS band FROM b")
def intensity_band(spark, d):
    return table(spark, d, "documents").select("doc_id", D.band("text", {"light": 35, "moderate": 40, "strong": 25}).alias("band"))


@query(f"""SELECT doc_id, count(*) FILTER (WHERE NOT regexp_matches(sentence,'[\\n\\t]') AND length(sentence) BETWEEN 15 AND 400 AND NOT (upper(sentence)=sentence AND lower(sentence)<>sentence)
AND len(regexp_extract_all(sentence,'[A-Za-z]')) >= 0.5*length(sentence)) AS kept, count(*) AS n FROM {SENT} GROUP BY doc_id""")
def sentence_keep(spark, d):
    s = sentences_of(table(spark, d, "documents"))
    return s.groupBy("doc_id").agg(F.count_if(D.keeps_sentence("sentence")).alias("kept"), F.count(F.lit(1)).alias("n"))


@query(rf"""SELECT count(*) FILTER (WHERE regexp_matches(text,'[.!?]["'')\]]?\s+[A-Z]')) AS multi, count(*) FILTER (WHERE {VALID}) AS valid, count(*) AS n FROM documents""")
def row_integrity(spark, d):
    return table(spark, d, "documents").agg(F.count_if(T.col("text").rlike(r"""[.!?]["')\]]?\s+[A-Z]""")).alias("multi"), F.count_if(D.is_single_line("text")).alias("valid"), F.count(F.lit(1)).alias("n"))


PAIRS = f"(SELECT doc_id, i, sentence AS seed, lead(sentence) OVER (PARTITION BY doc_id ORDER BY i) AS made FROM {SENT})"


def neighbours(spark, d):
    w = Window.partitionBy("doc_id").orderBy("i")
    s = sentences_of(table(spark, d, "documents"))
    return s.select("doc_id", F.col("i").cast("long").alias("i"), F.col("sentence").alias("seed"), F.lead("sentence").over(w).alias("made"))


_CLEAN = strip_("regexp_replace(regexp_replace(" + strip_("made") + ",'^\"+|\"+$','','g'),'^''+|''+$','','g')")


@query(f"""WITH p AS (SELECT doc_id, i, seed, {_CLEAN} AS s FROM {PAIRS} WHERE made IS NOT NULL)
SELECT doc_id, i, md5(s) AS rewrite FROM p WHERE position(chr(10) IN s)=0 AND length(s)>=12 AND regexp_matches(s,'[.?!]\\z') AND lower(s)<>lower(seed) AND length(s)<=2.5*length(seed) AND len({sentences_('s')})=1""")
def rewrite_validate(spark, d):
    p = neighbours(spark, d).where("made IS NOT NULL").withColumn("r", D.clean_rewrite(F.col("made"), F.col("seed")))
    return p.where("r IS NOT NULL").select("doc_id", "i", F.md5("r").alias("rewrite"))


@query(f"SELECT doc_id, i, lower({strip_('made')})<>lower({strip_('seed')}) AND length(made)/greatest(length(seed),1) BETWEEN 0.6 AND 1.6 AND NOT regexp_matches(made,'(?i)later that|the end') AS ok FROM {PAIRS} WHERE made IS NOT NULL")
def rename_guard(spark, d):
    p = neighbours(spark, d).where("made IS NOT NULL")
    return p.select("doc_id", "i", D.rename_ok(F.col("seed"), F.col("made"), "later that|the end").alias("ok"))


@query(f"""WITH p AS (SELECT seed AS neg, made AS pos, doc_id||'_'||i AS group_id, CASE doc_id%3 WHEN 0 THEN 'neg' WHEN 1 THEN 'pos' END AS real FROM {PAIRS} WHERE made IS NOT NULL)
SELECT md5(neg) AS text, 0 AS label, group_id, coalesce(real='neg',false) AS is_real FROM p UNION ALL SELECT md5(pos), 1, group_id, coalesce(real='pos',false) FROM p""")
def unpivot_pairs(spark, d):
    real = F.when(F.col("doc_id") % 3 == 0, "neg").when(F.col("doc_id") % 3 == 1, "pos")
    p = neighbours(spark, d).select(F.col("seed").alias("neg"), F.col("made").alias("pos"), F.concat_ws("_", "doc_id", "i").alias("group_id"), real.alias("real"))
    return D.pair_rows(p, "neighbours").select(F.md5("text").alias("text"), "label", "group_id", "is_real")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality=1 UNION SELECT doc_id FROM labels WHERE toxic=1)")
def resume_anti_join(spark, d):
    labels = table(spark, d, "labels")
    return D.remaining(table(spark, d, "documents").select("doc_id"), labels.where("quality = 1"), labels.where("toxic = 1"), "doc_id")


@query(f"""WITH s AS (SELECT doc_id, i, lower({strip_('sentence')}) AS k, row_number() OVER (PARTITION BY lower({strip_('sentence')}) ORDER BY doc_id, i) AS n FROM {SENT} WHERE doc_id>=100)
SELECT doc_id, i FROM s WHERE n=1 AND k NOT IN (SELECT lower({strip_('sentence')}) FROM {SENT} WHERE doc_id<100)""")
def new_sentences(spark, d):
    s = sentences_of(table(spark, d, "documents"))
    new = D.new_rows(s.where("doc_id >= 100"), s.where("doc_id < 100"), "sentence", ["doc_id", "i"])
    return new.select("doc_id", F.col("i").cast("long").alias("i"))


@query("WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)-1 AS depth FROM documents) SELECT doc_id, source, depth FROM d WHERE depth>0 ORDER BY depth, source LIMIT 100")
def round_robin(spark, d):
    r = D.round_robin(table(spark, d, "documents"), "source", "doc_id", 100, shots=1)
    return r.select("doc_id", "source", F.col("depth").cast("long").alias("depth"))


@query("SELECT doc_id, sha1('pick'||doc_id) AS shuffle_key FROM documents ORDER BY 2 LIMIT 50")
def shuffled_head(spark, d):
    return D.shuffled(table(spark, d, "documents"), "doc_id", "pick").orderBy("shuffle_key").limit(50).select("doc_id", "shuffle_key")


# ---- classifier analytics: two lexical scores of labelled documents ----

SCORED = f"(SELECT doc_id, quality AS label, round(len(list_filter(t, lambda w: NOT list_contains({STOP}, w)))/greatest(len(t),1),3) AS score, round(len(list_filter(t, lambda w: NOT list_contains({GUARD}, w)))/greatest(len(t),1),3) AS other FROM (SELECT doc_id, quality, {tokens_('text')} AS t FROM documents JOIN labels USING (doc_id)))"


def scored(spark, d):
    from proselake.functions import lexicon

    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", F.col("quality").alias("label"), T.tokens("text").alias("t"))
    n = F.greatest(F.size("t"), F.lit(1))
    return docs.select("doc_id", "label", F.round(T.content_words(F.col("t")) / n, 3).alias("score"), F.round(T.content_words(F.col("t"), lexicon.GUARD_STOPWORDS) / n, 3).alias("other"))


_SWEEP = f"""b AS (SELECT score AS threshold, sum(label) AS pos, count(*) AS n FROM {SCORED} GROUP BY 1), b1 AS (SELECT threshold, sum(pos) AS pos, sum(n) AS n FROM (SELECT * FROM b UNION ALL SELECT 1.0, 0, 0) GROUP BY 1),
c AS (SELECT threshold, sum(pos) OVER w AS tp, sum(n) OVER w - sum(pos) OVER w AS fp, sum(pos) OVER () AS p FROM b1 WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
s AS (SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, coalesce(tp/nullif(tp+fp,0),0) AS precision, coalesce(tp/nullif(p,0),0) AS recall FROM c),
f AS (SELECT *, coalesce(2*precision*recall/nullif(precision+recall,0),0) AS f1 FROM s)"""


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 8) for n in names})


@query(f"WITH {_SWEEP} SELECT threshold, tp, fp, round(precision,8) AS precision, round(recall,8) AS recall, round(f1,8) AS f1 FROM f")
def threshold_sweep(spark, d):
    return rounded(E.sweep(scored(spark, d)), "precision", "recall", "f1")


@query(f"WITH {_SWEEP}, k AS (SELECT count(*) FILTER (WHERE precision>=0.88)>0 AS met FROM f) SELECT threshold, round(precision,8) AS precision, round(recall,8) AS recall, met FROM f, k ORDER BY CASE WHEN met AND precision>=0.88 THEN 0 ELSE 1 END, CASE WHEN met THEN threshold END, f1 DESC, threshold LIMIT 1")
def pick_threshold(spark, d):
    return rounded(E.pick_threshold(E.sweep(scored(spark, d)), 0.88), "precision", "recall")


@query(f"WITH {_SWEEP} SELECT coalesce(min(threshold)<=0.55 AND max(threshold)>=0.7, false) AS too_wide FROM f WHERE precision>=0.85")
def band_check(spark, d):
    return E.band_too_wide(E.sweep(scored(spark, d)), 0.85, 0.55, 0.7)


@query(f"WITH {_SWEEP}, g AS (SELECT precision*(recall-coalesce(lag(recall) OVER (ORDER BY threshold DESC),0)) AS a FROM f) SELECT round(sum(a),8) AS average_precision FROM g")
def average_precision(spark, d):
    return rounded(E.average_precision(scored(spark, d)), "average_precision")


@query(f"SELECT label, count(*) AS n, round(sum(count(*)) OVER ()/(count(*) OVER ()*count(*)),8) AS weight FROM {SCORED} GROUP BY label")
def class_weights(spark, d):
    return rounded(E.class_weights(scored(spark, d)), "weight")


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE label=1) AS positives, count(*) FILTER (WHERE label=0) AS negatives FROM {SCORED}")
def class_distribution(spark, d):
    return D.class_distribution(scored(spark, d))


@query(f"""WITH c AS (SELECT count(*) FILTER (WHERE score<0.62 AND label=0) AS tn, count(*) FILTER (WHERE score>=0.62 AND label=0) AS fp, count(*) FILTER (WHERE score<0.62 AND label=1) AS fn, count(*) FILTER (WHERE score>=0.62 AND label=1) AS tp FROM {SCORED}),
r AS (SELECT *, coalesce(tp/nullif(tp+fp,0),0) AS p, coalesce(tp/nullif(tp+fn,0),0) AS r FROM c) SELECT tn, fp, fn, tp, round(p,8) AS precision, round(r,8) AS recall, round(coalesce(2*p*r/nullif(p+r,0),0),8) AS f1, round((tn+tp)/(tn+fp+fn+tp),8) AS accuracy FROM r""")
def confusion(spark, d):
    return rounded(E.confusion(scored(spark, d), 0.62), "precision", "recall", "f1", "accuracy")


@query(f"SELECT doc_id, label, score, CASE WHEN label=0 THEN 'false positive' ELSE 'false negative' END AS kind FROM {SCORED} WHERE (score>=0.62) <> (label=1)")
def error_rows(spark, d):
    return E.errors(scored(spark, d), 0.62).select("doc_id", "label", "score", "kind")


@query(f"SELECT round(avg(CASE WHEN (score>=0.62)=(other>=0.62) THEN 1.0 ELSE 0.0 END),8) AS agreement, round(avg(abs(score-other)),8) AS mean_difference, avg(CASE WHEN (score>=0.62)=(other>=0.62) THEN 1.0 ELSE 0.0 END)>=0.95 AS passes FROM {SCORED}")
def agreement(spark, d):
    return rounded(E.agreement(scored(spark, d), "score", "other", 0.62), "agreement", "mean_difference")


@query(f"""WITH s AS (SELECT doc_id, sentence, {tokens_('sentence')} AS t FROM {SENT}) SELECT doc_id, CAST(0.8 AS DOUBLE) AS threshold, count(*) FILTER (WHERE len(list_filter(t, lambda w: NOT list_contains({STOP}, w)))/greatest(len(t),1)>=0.8) AS n_flagged, count(*) AS n FROM s GROUP BY doc_id""")
def detect(spark, d):
    r = E.detect(table(spark, d, "documents"), lambda c: T.content_words(T.tokens(c)) / F.greatest(F.size(T.tokens(c)), F.lit(1)), 0.8, most_chars=10_000_000, most_sentences=1_000_000)
    return r.select("doc_id", F.col("threshold").cast("double").alias("threshold"), "n_flagged", F.size("sentences").cast("long").alias("n"))


# ---- grading ----

TURNS = f"(SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS said FROM conversations)"
_WORD = "regexp_matches(lower(text), '(?:^|[^\\p{{L}}\\p{{N}}_])'||{w}||'(?:$|[^\\p{{L}}\\p{{N}}_])')"


def graded(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").select("conv_id", "turn", "text", T.tokens(F.lag("text").over(w)).alias("t")).where(F.size("t") >= 3)
    return t.select("conv_id", "turn", G.answer_ok(F.col("text"), F.slice("t", 1, 2), F.slice("t", 3, 1)).alias("ok"))


_GRADED = f"(SELECT conv_id, turn, NOT {_WORD.format(w='t[3]')} AND ({_WORD.format(w='t[1]')} OR {_WORD.format(w='t[2]')}) AS ok FROM (SELECT *, {tokens_('said')} AS t FROM {TURNS} WHERE said IS NOT NULL) WHERE len(t)>=3)"


@query(f"SELECT * FROM {_GRADED}")
def answer_grading(spark, d):
    return graded(spark, d)


@query(f"WITH g AS {_GRADED} SELECT a.conv_id, a.turn FROM g a LEFT JOIN g b ON b.conv_id=a.conv_id+1 AND a.turn=b.turn WHERE a.ok AND NOT coalesce(b.ok,false)")
def grade_regressions(spark, d):
    g = graded(spark, d)
    return G.regressions(g, g.withColumn("conv_id", F.col("conv_id") - 1), ["conv_id", "turn"])


@query(f"WITH g AS {_GRADED}, r AS (SELECT avg(CASE WHEN ok THEN 1.0 ELSE 0 END) FILTER (WHERE conv_id%2=0) AS base, avg(CASE WHEN ok THEN 1.0 ELSE 0 END) FILTER (WHERE conv_id%2=1) AS edited FROM g) SELECT round(base,8) AS base, round(edited,8) AS edited, round(edited-base,8) AS delta, edited-base < -0.05 AS regressed FROM r")
def grade_delta(spark, d):
    g = graded(spark, d)
    return rounded(G.accuracy_delta(g.where("conv_id % 2 = 0"), g.where("conv_id % 2 = 1")), "base", "edited", "delta")


@query(r"SELECT item_id, position(' ' IN text)=0 AND position(',' IN text)=0 AS single, len(list_filter(string_split_regex(text,'\s+'), lambda w: position(',' IN w)=0)) AS n_single FROM benchmark")
def single_words(spark, d):
    """Whether an item is a single-word answer, and how many of its words would be one."""
    words = F.filter(F.split("text", r"\s+"), G.single_word)
    return table(spark, d, "benchmark").select("item_id", G.single_word(F.col("text")).alias("single"), F.size(words).cast("long").alias("n_single"))


# ---- objective ----

_TURN = f"(SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS turn, len(list_filter(t, lambda w: NOT list_contains({STOP}, w)))/greatest(len(t),1) AS value FROM (SELECT conv_id, turn, {tokens_('text')} AS t FROM conversations WHERE role='assistant'))"


def turn_values(spark, d):
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    t = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", place.alias("turn"), T.tokens("text").alias("t"))
    return t.select("conv_id", "turn", (T.content_words(F.col("t")) / F.greatest(F.size("t"), F.lit(1))).alias("value"))


@query(f"SELECT conv_id, round(sum(value*(turn+1))/sum(turn+1),8) AS late_weighted FROM {_TURN} GROUP BY conv_id")
def late_weighted_curve(spark, d):
    return rounded(O.late_weighted(turn_values(spark, d), ["conv_id"]), "late_weighted")


@query(f"SELECT turn, round(avg(value),8) AS mean, count(*) AS n FROM {_TURN} GROUP BY turn")
def turn_means(spark, d):
    m = turn_values(spark, d).groupBy("turn").agg(F.round(F.avg("value"), 8).alias("mean"), F.count(F.lit(1)).alias("n"))
    return m.withColumn("turn", F.col("turn").cast("long"))


@query("WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role='assistant') SELECT conv_id, turn FROM t WHERE k >= floor(n*0.5)")
def late_replies(spark, d):
    return O.late_replies(table(spark, d, "conversations").where("role = 'assistant'"), "conv_id", "turn").select("conv_id", "turn")


_RATES = f"""f AS (SELECT role, list_transform({sentences_('text')}, lambda s: lower(string_split_regex(s,'\\s+')[1])) AS f, {sentences_('text')} AS ss, text FROM conversations),
o AS (SELECT role, avg((len(f)-len(list_distinct(f)))/(len(f)-1)) FILTER (WHERE len(f)>=2) AS opener, sum(len(ss)) AS coverage FROM f GROUP BY role),
t AS (SELECT role, {tokens_('text', "[a-z'']+")} AS t FROM conversations), c AS (SELECT role, t, list_filter(t, lambda w: NOT list_contains({GUARD}, w)) AS c FROM t WHERE len(t)>=4),
n AS (SELECT role, avg(greatest({_REP} CASE WHEN len(c)>0 THEN list_max(map_values(list_histogram(c)))/len(c) ELSE 0 END)) AS intra FROM c GROUP BY role),
r AS (SELECT * FROM o JOIN n USING (role))"""


@query(f"""WITH {_RATES}, x AS (SELECT greatest(0,e.opener-b.opener) AS eo, greatest(0,e.intra-b.intra) AS ei, greatest(0,1-e.coverage/b.coverage) AS ec FROM r e, r b WHERE e.role='assistant' AND b.role='user')
SELECT round(2*eo+8*eo*eo,8) AS opener, round(3*ei+8*ei*ei,8) AS intra, round(2*ec,8) AS collapse FROM x""")
def penalty_components(spark, d):
    turns = table(spark, d, "conversations").withColumn("key", F.struct("conv_id", "turn"))

    def rates(role: str, prefix: str):
        t = turns.where(F.col("role") == role)
        o = detectors.opener_repeat(t, "key").agg(F.avg("rate").alias(f"{prefix}opener"))
        i = detectors.intra_repeat(t, "key").agg(F.avg("rate").alias(f"{prefix}intra"))
        c = t.agg(F.sum(F.size(T.sentences("text"))).alias(f"{prefix}coverage"))
        return o.crossJoin(i).crossJoin(c)  # one row each

    both = rates("assistant", "e_").crossJoin(rates("user", "b_"))
    zero = F.lit(0.0)
    parts = O.components(*({n: F.col(p + n) for n in ("opener", "intra", "coverage")} | {"audit": zero, "struct": zero} for p in ("e_", "b_")))
    return both.select(*(F.round(parts[n], 8).alias(n) for n in ("opener", "intra", "collapse")))


@query(rf"WITH p AS (SELECT len(string_split_regex({strip_('made')},'\s+'))-len(string_split_regex({strip_('seed')},'\s+')) AS x FROM {PAIRS} WHERE made IS NOT NULL) SELECT round(avg(x),8) AS delta, CASE WHEN abs(avg(x))>2 THEN 'length' ELSE '' END AS projection FROM p")
def length_confound(spark, d):
    p = neighbours(spark, d).where("made IS NOT NULL").select(F.col("seed").alias("neg"), F.col("made").alias("pos"))
    return rounded(O.length_confound(p), "delta")
