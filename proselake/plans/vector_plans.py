"""Queries of directions over embeddings and of rank-one removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from proselake.operators import quantized as Q
from proselake.operators import vectors as V
from proselake.operators import versions
from proselake.plans.registry import query, table
from proselake.sources import files

LONG = "long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding,1)-1 AS dim FROM embeddings)"
MEANS = LONG + ", m AS (SELECT dim, avg(x) FILTER (WHERE label<5) AS neg, avg(x) FILTER (WHERE label>=5) AS pos FROM long GROUP BY dim), r AS (SELECT *, pos-neg AS r FROM m)"
UNIT = MEANS + ", u AS (SELECT *, r/greatest(sqrt(sum(r*r) OVER ()),1e-8) AS u, neg/greatest(sqrt(sum(neg*neg) OVER ()),1e-8) AS a FROM r), o AS (SELECT *, r - (sum(r*a) OVER ())*a AS r_proj FROM u)"
PROJ = UNIT + ", p AS (SELECT vec_id, label, sum(x*u) AS p FROM long JOIN u USING (dim) GROUP BY ALL)"
def positive():
    return F.col("label") >= 5


def long(spark, d):
    return V.long_form(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


def direction(spark, d):
    return V.unit(V.class_means(long(spark, d), positive()))


def projected(spark, d):
    return V.projections(long(spark, d), direction(spark, d), ["vec_id", "label"])


@query(f"WITH {MEANS} SELECT CAST(dim AS INT) AS dim, round(neg,8) AS neg, round(pos,8) AS pos, round(r,8) AS r FROM r")
def direction_means(spark, d):
    return V.class_means(long(spark, d), positive()).select("dim", *(F.round(c, 8).alias(c) for c in ("neg", "pos", "r")))


@query(f"WITH {UNIT} SELECT CAST(dim AS INT) AS dim, round(u,8) AS u, round(r_proj,8) AS r_proj FROM o")
def orthogonalize(spark, d):
    return V.orthogonalized(direction(spark, d)).select("dim", F.round("u", 8).alias("u"), F.round("r_proj", 8).alias("r_proj"))


@query(f"WITH {PROJ} SELECT vec_id, round(p,8) AS p FROM p")
def direction_project(spark, d):
    return projected(spark, d).select("vec_id", F.round("p", 8).alias("p"))


@query(f"WITH {PROJ}, c AS (SELECT avg(p) FILTER (WHERE label>=5) AS hi, avg(p) FILTER (WHERE label<5) AS lo FROM p) SELECT round(hi-lo,8) AS separation, round(avg(CASE WHEN (p>(hi+lo)/2)=(label>=5) THEN 1.0 ELSE 0.0 END),8) AS accuracy FROM p, c GROUP BY hi, lo")
def direction_accuracy(spark, d):
    p = projected(spark, d)
    c = p.agg(F.avg(F.when(positive(), F.col("p"))).alias("hi"), F.avg(F.when(~positive(), F.col("p"))).alias("lo"))
    right = ((F.col("p") > (F.col("hi") + F.col("lo")) / 2) == positive()).cast("double")
    return p.crossJoin(F.broadcast(c)).groupBy("hi", "lo").agg(F.round(F.avg(right), 8).alias("accuracy")).select(F.round(F.col("hi") - F.col("lo"), 8).alias("separation"), "accuracy")  # one row


@query(f"WITH {PROJ} SELECT round(corr(p, label),8) AS correlation FROM p")
def pearson_label(spark, d):
    p = projected(spark, d).withColumn("y", F.col("label").cast("double"))
    return V.pearson(p, "p", "y").select(F.round("correlation", 8).alias("correlation"))


@query(f"WITH {UNIT} SELECT round(sum(r*neg)/(sqrt(sum(neg*neg))*sqrt(sum(r*r))),8) AS cosine, round(sqrt(sum(r_proj*r_proj))/sqrt(sum(r*r)),8) AS survival FROM o")
def confounds(spark, d):
    return V.confounds(V.class_means(long(spark, d), positive())).select(F.round("cosine", 8).alias("cosine"), F.round("survival", 8).alias("survival"))


_LAYERS = PROJ + """, l AS (SELECT vec_id//8 AS unit, vec_id%8 AS layer, p, (vec_id//8)%2=1 AS positive FROM p), s AS (SELECT layer, positive, p-lag(p) OVER (PARTITION BY unit ORDER BY layer) AS step FROM l),
a AS (SELECT layer, avg(step) FILTER (WHERE positive)-avg(step) FILTER (WHERE NOT positive) AS attr FROM s WHERE step IS NOT NULL GROUP BY layer), w AS (SELECT layer, attr, sum(greatest(attr,0)) OVER (ORDER BY layer)/greatest(sum(greatest(attr,0)) OVER (),1e-8) AS cum FROM a)"""


def profile(spark, d):
    p = projected(spark, d)
    unit = F.floor(F.col("vec_id") / 8)
    return V.write_profile(p.select(unit.alias("unit"), (F.col("vec_id") % 8).alias("layer"), "p", (unit % 2 == 1).alias("positive")))


@query(f"WITH {_LAYERS} SELECT layer, round(attr,8) AS attr, round(cum,8) AS cum FROM w")
def write_profile(spark, d):
    return profile(spark, d).select("layer", F.round("attr", 8).alias("attr"), F.round("cum", 8).alias("cum"))


@query(f"WITH {_LAYERS} SELECT min(layer) FILTER (WHERE cum>=0.25) AS q25, min(layer) FILTER (WHERE cum>=0.5) AS q50, min(layer) FILTER (WHERE cum>=0.75) AS q75 FROM w")
def write_quartiles(spark, d):
    return V.quartile_layers(profile(spark, d))


_MATRIX = UNIT + """, mat AS (SELECT dim AS row, vec_id AS col, x AS val FROM long), pr AS (SELECT col, sum(u.u*val) AS a, sum(u.a*val) AS b FROM mat JOIN u ON u.dim=mat.row GROUP BY col),
n AS (SELECT mat.row, mat.col, val, val-0.75*u.u*pr.a-0.25*u.a*pr.b AS new FROM mat JOIN u ON u.dim=mat.row JOIN pr ON pr.col=mat.col)"""


def removed(spark, d):
    m = long(spark, d).select(F.col("dim").alias("row"), F.col("vec_id").alias("col"), F.col("x").alias("val"))
    u = V.unit(direction(spark, d), "neg", "a")
    specs = u.select(F.lit(0).alias("spec"), F.col("dim").alias("row"), F.col("u").alias("d"), F.lit(0.75).alias("weight")).union(u.select(F.lit(1), "dim", "a", F.lit(0.25)))
    return V.rank_one_removed(m, specs)


@query(f"WITH {_MATRIX} SELECT CAST(row AS INT) AS row, col, round(new,8) AS new FROM n")
def rank1_removal(spark, d):
    return removed(spark, d).select("row", "col", F.round("new", 8).alias("new"))


@query(f"WITH {_MATRIX}, k AS (SELECT col, sqrt(sum(val*val)) AS ref, sqrt(sum(new*new)) AS own FROM n GROUP BY col) SELECT CAST(row AS INT) AS row, n.col, round(new*ref/greatest(own,1e-8),8) AS new FROM n JOIN k ON k.col=n.col")
def norm_restore(spark, d):
    return V.norms_restored(removed(spark, d)).select("row", "col", F.round("new", 8).alias("new"))


@query(f"""WITH {LONG}, v AS (SELECT unnest(range(0,4)) AS version), m AS (SELECT version, vec_id AS col, label, dim, CASE WHEN label BETWEEN 1 AND version AND dim=label THEN 0.25*x ELSE x END AS val FROM long, v)
SELECT CAST(version AS INT) AS version, col, round(sum(val*(dim+1)),6) AS total, (SELECT count(DISTINCT vec_id) FROM long l WHERE m.version=0 OR (l.label=m.version AND l.dim=m.version AND l.x<>0)) AS n_stored, CAST(0 AS BIGINT) AS n_damaged FROM m GROUP BY version, col""")
def matrix_versions(spark, d):
    """A matrix and three edits of it, each of one label's columns and made from the version before; every version is restored."""
    folder = files.scratch(spark)
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("col"), "label")
    versions.save(long(spark, d).select(F.col("dim").alias("row"), F.col("vec_id").alias("col"), F.col("x").alias("val")), folder, 0)
    spec = spark.range(1).select(F.lit(0).alias("spec"), F.lit(1.0).alias("d"), F.lit(0.75).alias("weight"), F.lit(False).alias("keeps"))
    out = None
    for k in range(4):
        if k:
            m = versions.restore(spark, folder, k - 1).join(labels, "col")
            own = V.edited_matrix(m.where(F.col("label") == k).select("row", "col", "val"), spec.withColumn("row", F.lit(k))).select("row", "col", F.col("new").alias("val"))
            versions.save(own.unionByName(m.where(~F.col("label").eqNullSafe(k)).select("row", "col", "val")), folder, k, k - 1)
        wrong = versions.damaged(spark, folder, k).agg(F.count(F.lit(1)).alias("n_damaged")).withColumn("version", F.lit(k))
        sums = versions.restore(spark, folder, k).groupBy("col").agg(F.round(F.sum(F.col("val") * (F.col("row") + 1)), 6).alias("total")).withColumn("version", F.lit(k))
        part = sums.join(F.broadcast(wrong), "version")
        out = part if out is None else out.unionByName(part)
    held = versions.stored(spark, folder).select("version", F.col("n_columns").alias("n_stored"))
    return out.join(F.broadcast(held), "version", "left").withColumn("n_stored", F.coalesce("n_stored", F.lit(0)))


_CHANNELS = f"""{LONG}, ch AS (SELECT label AS channel, dim, avg(x) AS w FROM long WHERE label IS NOT NULL GROUP BY ALL),
cs AS (SELECT channel, CASE WHEN max(abs(w))>0 THEN max(abs(w))/127 ELSE 1 END AS ws FROM ch GROUP BY channel), qw AS (SELECT ch.channel, dim, w, ws, CAST(round_even(w/ws,0) AS BIGINT) AS q FROM ch JOIN cs USING (channel)),
xs AS (SELECT vec_id, CASE WHEN max(abs(x))>0 THEN max(abs(x))/127 ELSE 1 END AS s FROM long GROUP BY vec_id), qx AS (SELECT vec_id, dim, x, s, CAST(round_even(x/s,0) AS BIGINT) AS q FROM long JOIN xs USING (vec_id)),
sc AS (SELECT vec_id, channel, sum(x*w) AS score, CAST(sum(qx.q*qw.q) AS BIGINT) AS dot, sum(qx.q*qw.q)*any_value(s)*any_value(ws) AS other FROM qx JOIN qw USING (dim) GROUP BY ALL)"""


def channels(spark, d):
    """A linear scorer: a channel for each label, its weights the label's mean vector."""
    return long(spark, d).where("label IS NOT NULL").groupBy(F.col("label").alias("channel"), "dim").agg(F.avg("x").alias("w"))


@query(f"WITH {_CHANNELS} SELECT vec_id, channel, dot, round(other,6) AS score FROM sc")
def integer_scores(spark, d):
    """Scores of every vector in every channel by integer products."""
    r = Q.integer_scores(table(spark, d, "embeddings"), channels(spark, d))
    return r.select("vec_id", "channel", "dot", F.round("score", 6).alias("score"))


@query(f"""WITH {_CHANNELS}, a AS (SELECT vec_id, arg_max(channel, (score, -channel)) AS own FROM sc GROUP BY vec_id), b AS (SELECT vec_id, arg_max(channel, (other, -channel)) AS own FROM sc GROUP BY vec_id)
SELECT count(*) AS n, round(avg(CASE WHEN a.own=b.own THEN 1.0 ELSE 0 END),6) AS agreement, (SELECT round(avg(abs(score-other)),6) FROM sc) AS mean_difference, avg(CASE WHEN a.own=b.own THEN 1.0 ELSE 0 END)>=0.95 AS passes FROM a JOIN b USING (vec_id)""")
def integer_gate(spark, d):
    """Whether decisions by integers agree with those in doubles on 95 % of the vectors."""
    e, w = table(spark, d, "embeddings"), channels(spark, d)
    g = Q.gate(Q.scores(e, w), Q.integer_scores(e, w))
    return g.select("n", F.round("agreement", 6).alias("agreement"), F.round("mean_difference", 6).alias("mean_difference"), "passes")
