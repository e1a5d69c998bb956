"""Queries of models that are learned from the tables: perplexity under a Kneser-Ney model."""

from __future__ import annotations

from pyspark.sql import functions as F

from proselake.operators import dataset as D
from proselake.operators import language_model as L
from proselake.operators import scoring as S
from proselake.plans.data_plans import horner
from proselake.plans.registry import grams_, query, table, tokens_


def _kneser_ney_sql(texts: str, keys: str, train: str, order: int = 2, chunk: int = 512, most: int | None = None) -> str:
    """WITH-clauses and a SELECT of (keys, perplexity, n_chunks) of `texts` under a model of `train`; a token's gram by position."""
    pads = "[" + ",".join(["'<s>'"] * (order - 1)) + "]"
    of = lambda source, k: f"SELECT {k} unnest(g) AS gram, generate_subscripts(g,1)-1 AS pos FROM (SELECT {k} {grams_('t', order)} AS g FROM (SELECT {k} list_concat({pads}, {tokens_('coalesce(text,chr(32))')}) AS t FROM {source}))"
    cut = lambda g: rf"regexp_replace({g},'^\S+ ','')"
    head = lambda g: rf"regexp_replace({g},'(^| )\S+$','')"
    parts = [f"n{order} AS (SELECT gram, count(*) AS n FROM ({of(train, '')}) GROUP BY gram)"]
    parts += [f"n{k} AS (SELECT {cut('gram')} AS gram, count(*) AS n FROM n{k + 1} GROUP BY 1)" for k in range(order - 1, 0, -1)]
    parts += [f"d{k} AS (SELECT CASE WHEN count(*) FILTER (WHERE n=1)=0 THEN 0.5 ELSE count(*) FILTER (WHERE n=1)/(count(*) FILTER (WHERE n=1)+2*count(*) FILTER (WHERE n=2)) END AS d FROM n{k})" for k in range(1, order + 1)]
    parts += ["u AS (SELECT d*count(*)/sum(n)/(count(*)+1) AS u, sum(n) AS total FROM n1, d1 GROUP BY d)", "p1 AS (SELECT gram, greatest(n-d,0)/total+u AS p FROM n1, d1, u)"]
    for k in range(2, order + 1):
        parts.append(f"c{k} AS (SELECT {head('gram')} AS context, sum(n) AS total, any_value(d)*count(*)/sum(n) AS b FROM n{k}, d{k} GROUP BY 1)")
        parts.append(f"p{k} AS (SELECT n{k}.gram, greatest(n-d,0)/total+b*l.p AS p FROM n{k} JOIN c{k} ON context={head(f'n{k}.gram')} JOIN p{k - 1} l ON l.gram={cut(f'n{k}.gram')}, d{k})")
    parts.append(f"e AS ({of(texts, keys + ',')})")
    parts.append(f"a{order} AS (SELECT DISTINCT gram, gram AS g{order} FROM e)")
    parts += [f"a{k} AS (SELECT *, {cut(f'g{k + 1}')} AS g{k} FROM a{k + 1})" for k in range(order - 1, 0, -1)]
    p = "coalesce(p1.p, u)"
    joins = "LEFT JOIN p1 ON p1.gram=g1"
    for k in range(2, order + 1):
        p = f"coalesce(p{k}.p, coalesce(c{k}.b,1)*{p})"
        joins += f" LEFT JOIN p{k} ON p{k}.gram=g{k} LEFT JOIN c{k} ON c{k}.context={head(f'g{k}')}"
    parts.append(f"s AS (SELECT a1.gram, -ln({p}) AS loss FROM a1 {joins}, u)")
    limit = f"WHERE pos<{chunk * most}" if most else ""
    parts.append(f"ch AS (SELECT {keys}, pos//{chunk} AS chunk, avg(loss) AS loss, count(*) AS n FROM e JOIN s USING (gram) {limit} GROUP BY ALL)")
    return f"WITH {', '.join(parts)} SELECT {keys}, round(coalesce(exp(avg(loss) FILTER (WHERE n>=2)),-1),4) AS perplexity, count(*) FILTER (WHERE n>=2) AS n_chunks FROM ch GROUP BY {keys}"


def _told(p, keys):
    return p.select(*keys, F.round(F.when(F.col("perplexity") == float("inf"), -1.0).otherwise(F.col("perplexity")), 4).alias("perplexity"), "n_chunks")


_HALF = f"(SELECT * FROM documents WHERE NOT {horner('md5(' + repr('lm:') + '||CAST(doc_id AS VARCHAR))', 4, 1000)} < 500)"


def _half_model(spark, d):
    return L.fit(table(spark, d, "documents").where(~D.held_out(F.col("doc_id"), 0.5, "lm")), order=2)


@query(_kneser_ney_sql("documents", "doc_id", _HALF))
def corpus_perplexity(spark, d):
    """Perplexity of every document in chunks of 512 tokens, under a model of the half that isn't held out."""
    docs = table(spark, d, "documents")
    return _told(S.perplexity(L.losses(_half_model(spark, d), docs, ["doc_id"]), ["doc_id"]), ["doc_id"])


@query(_kneser_ney_sql("(SELECT * FROM conversations WHERE role='assistant')", "conv_id, turn", _HALF, most=20))
def reply_model_perplexity(spark, d):
    """Perplexity of replies, 20 chunks each at most as the probe has it, under the documents' model."""
    replies = table(spark, d, "conversations").where("role = 'assistant'")
    keys = ["conv_id", "turn"]
    return _told(S.perplexity(L.losses(_half_model(spark, d), replies, keys), keys, most_chunks=20), keys)
