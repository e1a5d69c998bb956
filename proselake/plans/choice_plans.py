"""Queries of choices, floors, search spaces, losses and perplexity."""

from __future__ import annotations

from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.operators import building as B
from proselake.operators import choices as C
from proselake.operators import dataset as D
from proselake.operators import evaluation as E
from proselake.operators import scoring as S
from proselake.operators import vectors as V
from proselake.plans.data_plans import rounded
from proselake.plans.registry import exploded_, query, sentences_, table, tokens_
from proselake.plans.vector_plans import UNIT, direction, long

_SENT = f"({exploded_('doc_id', sentences_('text'), 'documents')})"


@query(rf"""SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(sentence,'[.!?]["'')\]]?\s+[A-Z]')) AS multi FROM {_SENT} GROUP BY doc_id""")
def multi_sentences(spark, d):
    """Rows that look like several sentences are counted, never dropped."""
    s = table(spark, d, "documents").select("doc_id", F.explode(T.sentences("text")).alias("sentence"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(D.looks_multi("sentence")).alias("multi"))


@query(f"""WITH t AS (SELECT doc_id, {tokens_('text')} AS t FROM documents)
SELECT a.doc_id, len(a.t)>3 AS own, len(b.t)>3 AND len(a.t)>=3 AND contains(' '||array_to_string(b.t,' ')||' ', ' '||array_to_string(a.t[1:3],' ')||' ') AS next FROM t a JOIN t b ON b.doc_id=a.doc_id+1 WHERE len(a.t)>=3""")
def contained_runs(spark, d):
    """Whether a text's first three words stand in it, and in the next text, as a run; never where the text is no longer than they."""
    t = table(spark, d, "documents").select("doc_id", T.tokens("text").alias("t")).where(F.size("t") >= 3)
    u = table(spark, d, "documents").select((F.col("doc_id") - 1).alias("doc_id"), T.tokens("text").alias("u"))
    first = F.slice("t", 1, 3)
    return t.join(u, "doc_id").select("doc_id", T.contains_run(first, F.col("t")).alias("own"), T.contains_run(first, F.col("u")).alias("next"))


@query("""WITH t AS (SELECT role, length(text)/(length(text)+200.0) AS p, len(regexp_extract_all(lower(text),'[aeiou]'))/greatest(1,length(text)) AS density FROM conversations),
a AS (SELECT role, avg(p) AS p, avg(density) AS density FROM t GROUP BY role) SELECT role, round(p-5*density,8) AS primary_value, round(2*greatest(0,1-density/0.5),8) AS floor, CAST(CASE WHEN role='user' THEN -5 ELSE 0 END AS DOUBLE) AS bound FROM a""")
def axis_primaries(spark, d):
    t = table(spark, d, "conversations").select("role", (F.length("text") / (F.length("text") + 200.0)).alias("p"), (F.regexp_count(F.lower("text"), F.lit("[aeiou]")) / F.greatest(F.length("text"), F.lit(1))).alias("density"), F.lit(0.5).alias("base_density"))
    r = C.axis_primary(t, ["role"]).withColumnRenamed("primary", "primary_value")
    return rounded(r, "primary_value", "floor").withColumn("bound", C.primary_floor(F.col("role") == "user", 5.0))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30")
def shown_rows(spark, d):
    """The rows of a report's table, a list cut by design."""
    return C.shown(table(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"])


_TOKEN = f"(SELECT doc_id, unnest(t) AS w, generate_subscripts(t,1)-1 AS pos FROM (SELECT doc_id, {tokens_('text')} AS t FROM documents))"


@query(f"""WITH c AS (SELECT doc_id, pos//64 AS chunk, avg(ln(1+length(w))) AS loss, count(*) AS n FROM {_TOKEN} GROUP BY ALL), p AS (SELECT doc_id, exp(avg(loss) FILTER (WHERE n>=2)) AS p, count(*) FILTER (WHERE n>=2) AS n_chunks FROM c GROUP BY doc_id)
SELECT doc_id, round(coalesce(p,-1),6) AS perplexity, n_chunks FROM p""")
def chunk_perplexity(spark, d):
    """Perplexity from token losses, here a rule's; -1 stands for infinity."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode(T.tokens("text")).alias("at", "w")).withColumn("loss", F.log(1.0 + F.length("w")))
    p = S.perplexity(t, ["doc_id"], chunk=64)
    return p.select("doc_id", F.round(F.when(F.col("perplexity") == float("inf"), -1.0).otherwise(F.col("perplexity")), 6).alias("perplexity"), "n_chunks")


@query("""WITH r AS (SELECT quality AS y, length(text)/1000.0 AS a, -length(text)/2000.0 AS b FROM documents JOIN labels USING (doc_id)), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE y=0) AS n0, count(*) FILTER (WHERE y=1) AS n1 FROM r),
w AS (SELECT y, a, b, n/(2*n0) AS w0, n/(2*n1) AS w1, greatest(a,b)+ln(exp(a-greatest(a,b))+exp(b-greatest(a,b))) AS z FROM r, n)
SELECT round(sum(0.9*(z-CASE WHEN y=1 THEN b ELSE a END)*CASE WHEN y=1 THEN w1 ELSE w0 END+0.1*((z-a)*w0+(z-b)*w1)/2)/sum(CASE WHEN y=1 THEN w1 ELSE w0 END),6) AS loss FROM w""")
def smoothed_loss(spark, d):
    r = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("quality").alias("label"), F.array(F.length("text") / 1000.0, -F.length("text") / 2000.0).alias("logits"))
    w = E.class_weights(r).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "weight"))), lambda x: x["weight"]).alias("weights"))
    r = r.crossJoin(F.broadcast(w)).withColumn("weight", F.get("weights", F.col("label")))  # one row
    return rounded(S.smoothed_loss(r), "loss").withColumn("loss", F.round("loss", 6))


@query(f"SELECT doc_id, count(*) AS n, round(avg(1/(1+exp(-(length(array_to_string(list_filter(string_split_regex(sentence,'\\s+'), lambda w: w<>'')[1:8],' '))/20.0-1)))),6) AS mean FROM {_SENT} GROUP BY doc_id")
def batched_scores(spark, d):
    """A model's probabilities through the batched scorer: texts cut at 8 words, logits by length."""
    import numpy as np

    def load(folder: str):
        return lambda texts: np.array([[0.0, len(t) / 20.0 - 1] for t in texts]).reshape(-1, 2)

    scored = S.sentence_scores(table(spark, d, "documents"), S.batched_scorer(load, "by-length", batch=16, most_tokens=8))
    return scored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query(f"""WITH {UNIT}, mat AS (SELECT dim AS row, vec_id AS col, x AS val FROM long), pr AS (SELECT col, sum(u.u*val) AS a, sum(u.a*val) AS b FROM mat JOIN u ON u.dim=mat.row GROUP BY col),
n AS (SELECT mat.row, mat.col, val-0.75*u.u*pr.a-0.25*u.a*pr.b AS new, val-0.25*u.a*pr.b AS ref FROM mat JOIN u ON u.dim=mat.row JOIN pr ON pr.col=mat.col),
k AS (SELECT col, sqrt(sum(ref*ref)) AS ref, sqrt(sum(new*new)) AS own FROM n GROUP BY col) SELECT CAST(row AS INT) AS row, n.col, round(new*k.ref/greatest(own,1e-8),8) AS new FROM n JOIN k ON k.col=n.col""")
def joint_edit(spark, d):
    """Two directions removed at once, of which only the first keeps the columns' lengths."""
    m = long(spark, d).select(F.col("dim").alias("row"), F.col("vec_id").alias("col"), F.col("x").alias("val"))
    u = V.unit(direction(spark, d), "neg", "a")
    specs = u.select(F.lit(0).alias("spec"), F.col("dim").alias("row"), F.col("u").alias("d"), F.lit(0.75).alias("weight"), F.lit(True).alias("keeps")).union(u.select(F.lit(1), "dim", "a", F.lit(0.25), F.lit(False)))
    return V.edited_matrix(m, specs).select("row", "col", F.round("new", 8).alias("new"))


@query("""WITH l AS (SELECT label AS layer, avg(embedding[1]) AS cosine, avg(embedding[2]) AS correlation, 0.4+avg(abs(embedding[3])) AS survival FROM embeddings GROUP BY label),
m AS (SELECT max(abs(cosine)) AS cosine, max(abs(correlation)) AS correlation, min(survival) AS survival FROM l WHERE layer BETWEEN 1 AND 8) SELECT round(cosine,8) AS cosine, round(correlation,8) AS correlation, round(survival,8) AS survival, cosine<0.2 AS skips_projection, correlation>0.4 AS needs_data, survival<0.5 AS under_ablates FROM m""")
def confound_report(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("layer"), *(F.get("embedding", F.lit(k)).cast("double").alias(f"x{k}") for k in range(3)))
    layers = e.groupBy("layer").agg(F.avg("x0").alias("cosine"), F.avg("x1").alias("correlation"), (0.4 + F.avg(F.abs("x2"))).alias("survival"))
    return rounded(V.confound_report(layers, 10), "cosine", "correlation", "survival")
