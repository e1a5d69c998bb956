"""Queries of trials, benchmark results, tool calls, choices and names, over rows made of the events table."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.operators import audit, selection
from proselake.operators import building as B
from proselake.operators import choices as C
from proselake.operators import dataset as D
from proselake.operators import grading as G
from proselake.operators import objective as O
from proselake.operators import vectors as V
from proselake.plans import text_plans
from proselake.plans.data_plans import rounded
from proselake.plans.registry import query, table
from proselake.sources import files, readers

EVENTS = "(SELECT event_id, ts, user_id, event_type, round(value,2) AS value, CAST(regexp_extract(props,'[0-9]+') AS INT) AS k FROM events)"
#: Shares of a user's events, and their mean value: the rates that the guards read.
RATES = f"(SELECT user_id, avg(CASE WHEN event_type='click' THEN 1.0 ELSE 0 END) AS opener, avg(CASE WHEN event_type='error' THEN 1.0 ELSE 0 END) AS audit, avg(CASE WHEN event_type='view' THEN 1.0 ELSE 0 END) AS intra, avg(CASE WHEN k<10 THEN 1.0 ELSE 0 END) AS struct, avg(value)/100 AS score, count(*) FILTER (WHERE k<60) AS done, count(*) AS total FROM {EVENTS} GROUP BY user_id)"


def events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", F.round("value", 2).alias("value"), F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"))


def rates(spark, d):
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    kind = F.col("event_type")
    return events(spark, d).groupBy("user_id").agg(
        share(kind == "click").alias("opener"), share(kind == "error").alias("audit"), share(kind == "view").alias("intra"), share(F.col("k") < 10).alias("struct"),
        (F.avg("value") / 100).alias("score"), F.count_if(F.col("k") < 60).alias("done"), F.count(F.lit(1)).alias("total"),
    )


# ---- tool calls and trial logs ----


@query(f"""WITH e AS (SELECT *, event_id%4 AS form, CASE WHEN k%3=1 THEN event_type WHEN k%3=2 THEN 'view' END AS tool FROM {EVENTS}),
b AS (SELECT *, CASE form WHEN 0 THEN 'user:'||user_id||', k: '||k WHEN 3 THEN chr(10)||' k: ['||k||', 2]' END AS body FROM e)
SELECT event_id, CASE WHEN tool IS NULL THEN body IS NULL ELSE coalesce(body IS NOT NULL AND tool=event_type AND k<50 AND contains(body, CAST(user_id AS VARCHAR)), false) END AS ok FROM b""")
def tool_call_grade(spark, d):
    """Replies of four forms, of which two hold a call, graded against a tool, an argument that a third of all k can't have, and a text."""
    e, k, user = events(spark, d), F.col("k").cast("string"), F.col("user_id").cast("string")
    reply = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("<|tool_call> call: "), "event_type", F.lit(' {user:<|"|>'), user, F.lit('<|"|>, k: '), k, F.lit("}<tool_call|>")))
        .when(F.col("event_id") % 4 == 1, F.lit("No tool is needed."))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("call: "), "event_type", F.lit(" {k: "), k, F.lit("}")))
        .otherwise(F.concat(F.lit("<|tool_call>call: "), "event_type", F.lit(" {\n k: ["), k, F.lit(", 2]}<tool_call|>")))
    )
    tool = F.when(F.col("k") % 3 == 1, F.col("event_type")).when(F.col("k") % 3 == 2, "view")
    return e.select("event_id", G.call_ok(reply, tool, F.create_map(F.lit("k"), (F.col("k") % 50).cast("string")), F.array(user)).alias("ok"))


_TRIALS = f"(SELECT event_id AS trial, value, printf('%.2f', k/100.0) AS weight, CASE WHEN k%2=0 THEN '0.25' ELSE '1.0' END AS scale FROM {EVENTS} WHERE event_type='view')"


def log(spark, d):
    """A search log: finished trials of one kind of event, and lines of all others between them."""
    scale = F.when(F.col("k") % 2 == 0, ", 'a_mlp_scale': 0.25").otherwise("")
    done = F.format_string("[I] Trial %d finished with value: %.2f and parameters: {'a_max_weight': %.2f, 'a_per_layer': True, 'b_mlp_scale': 0.5%s}. Best is trial 0.", "event_id", "value", F.col("k") / 100.0, scale)
    lines = events(spark, d).select(F.when(F.col("event_type") == "view", done).otherwise(F.concat(F.lit("Trial "), "event_id", F.lit(" was pruned"))).alias("value"))
    return G.trials(lines)


@query(f"SELECT trial, value, weight, scale FROM {_TRIALS}")
def trial_log(spark, d):
    own = G.axis_params(F.col("params"), "a")
    return log(spark, d).select("trial", "value", own["max_weight"].alias("weight"), own["mlp_scale"].alias("scale"))


@query(f"SELECT trial, value FROM {_TRIALS} ORDER BY value, trial LIMIT 1")
def best_trial(spark, d):
    return G.best_trial(log(spark, d)).select("trial", "value")


@query(f"WITH t AS {_TRIALS}, k AS (SELECT avg(value) AS m FROM (SELECT value, row_number() OVER (ORDER BY value, trial) AS n, ceil(count(*) OVER ()*0.2) AS most FROM t) WHERE n<=greatest(1,most)) SELECT trial, value, round(m+abs(m)*0.5,8) AS floor FROM t, k WHERE value <= m+abs(m)*0.5")
def trial_floor(spark, d):
    return rounded(G.under_floor(log(spark, d), 20.0, 50.0), "floor")


# ---- benchmark results ----

_METRICS = f"""m AS (SELECT event_type||'_'||(user_id%7) AS task, k<50 AS base, avg(value)/1000 AS acc, stddev_samp(value)/1000/sqrt(count(*)) AS err, event_type='view' AS leaf FROM {EVENTS} GROUP BY ALL)"""


def metrics(spark, d):
    """(task, base, metrics): what a benchmark tells of each task before and after."""
    m = events(spark, d).groupBy(F.concat("event_type", F.lit("_"), F.col("user_id") % 7).alias("task"), (F.col("k") < 50).alias("base"))
    m = m.agg((F.avg("value") / 1000).alias("acc"), (F.stddev_samp("value") / 1000 / F.sqrt(F.count(F.lit(1)))).alias("err"), F.count(F.lit(1)).cast("double").alias("n"))
    return m.select("task", "base", F.create_map(F.lit("acc,none"), "acc", F.lit("acc_stderr,none"), "err", F.lit("sample_len"), "n").alias("metrics"))


@query(f"WITH {_METRICS} SELECT b.task, 'acc,none' AS key, round(b.acc,8) AS base, round(e.acc,8) AS edited, round(e.acc-b.acc,8) AS delta, e.acc-b.acc < -0.002 AND b.acc-e.acc > coalesce(b.err,0)+coalesce(e.err,0) AS regressed FROM m b JOIN m e USING (task) WHERE b.base AND NOT e.base AND NOT b.leaf")
def bench_delta(spark, d):
    m = metrics(spark, d)
    base, edited = m.where("base").drop("base"), m.where("NOT base").drop("base")
    leaves = base.where(F.startswith("task", F.lit("view_"))).select("task")
    return rounded(G.benchmark_delta(base, edited, leaves, -0.002), "base", "edited", "delta")


@query(f"WITH {_METRICS} SELECT task, key, value FROM (SELECT task, unnest(['acc,none','acc_stderr,none']) AS key, unnest([round(acc,8),round(err,8)]) AS value FROM m WHERE NOT base) WHERE value IS NOT NULL")
def results_file(spark, d):
    """The newer of two runs, each one file named by its seconds: a benchmark's few tasks."""
    folder = files.scratch(spark)
    for k, base in enumerate((True, False)):
        rows = metrics(spark, d).where(F.col("base") == base).collect()  # five kinds of events by seven
        results = {r["task"]: {n: round(v, 8) for n, v in r["metrics"].items() if n != "sample_len" and v is not None} | {"alias": r["task"]} for r in rows}
        files.write_results(spark, f"{folder}/{k}", json.dumps({"results": results}), datetime(2024, 1, 1 + k, tzinfo=timezone.utc))
    r = readers.latest_results(spark, folder).select("task", F.explode("metrics").alias("key", "value"))
    return r.where("value IS NOT NULL")


# ---- objective ----


@query(f"""WITH v AS (SELECT *, done/total AS f FROM {RATES}), e AS (SELECT *, greatest(0,opener*f-0.1) AS a, greatest(0,audit*f-0.05) AS b, greatest(0,intra*f-0.1) AS c, greatest(0,struct*f-0.01) AS s FROM v),
p AS (SELECT *, 2*a+8*a*a+b+3*b*b+3*c+8*c*c+2*s+8*s*s AS pen FROM e) SELECT user_id, done, CASE WHEN done>0 AND done<total AND pen>score+0.05 THEN round(score+pen,8) END AS reject FROM p""")
def brain_damage_bound(spark, d):
    base = {"opener": F.lit(0.1), "audit": F.lit(0.05), "intra": F.lit(0.1), "struct": F.lit(0.01)}
    r = O.partial_reject({n: F.col(n) for n in base}, base, F.col("done"), F.col("total"), F.col("score"))
    return rates(spark, d).select("user_id", "done", F.round(r, 8).alias("reject"))


@query(f"""WITH r AS {RATES}, p AS (SELECT *, list_sort(list_filter([struct_pack(v := -round(opener,3), n := 'opener'), struct_pack(v := -round(audit,3), n := 'audit'), struct_pack(v := -round(intra,3), n := 'intra')], lambda x: -x.v>1e-4)) AS parts FROM r)
SELECT user_id, '['||array_to_string(list_transform(parts, lambda x: x.n||' '||printf('%.3f', -x.v)),' ')||']' AS fired, round(greatest(0, least(score/0.2, 6)-1.15),8) AS ratio_penalty, round(score-5*audit,8) AS two_sided,
round(least(greatest(intra*32/32, 0.2), 1),8) AS position, round(least(greatest((struct+0.1)*32/32, 0.1), 1),8) AS distance, round(score+2*(6-1.15),8) AS saturated FROM p""")
def objective_arithmetic(spark, d):
    r = rates(spark, d)
    position, distance = O.warm_start(F.lit(0.0), F.col("intra") * 32, (F.col("struct") + 0.1) * 32, F.lit(33))
    parts = {n: F.round(n, 3) for n in ("opener", "audit", "intra")}  # formatting rounds halves of doubles in its own ways
    found = r.select("user_id", O.fired(parts).alias("fired"), O.ratio_penalty(F.col("score"), F.lit(0.2)).alias("ratio_penalty"), O.two_sided(F.col("score"), F.col("audit")).alias("two_sided"), position.alias("position"), distance.alias("distance"), O.saturated_reject(F.col("score")).alias("saturated"))
    return rounded(found, "ratio_penalty", "two_sided", "position", "distance", "saturated")


@query(f"""SELECT user_id, array_to_string(list_filter([CASE WHEN score>0.25-0.15*0.25 THEN 'weak move' END, CASE WHEN 60*intra<12-1.0 THEN 'sentences shortened' END, CASE WHEN struct>0.05+0.05 THEN 'report mode' END,
CASE WHEN opener>0.1+0.10 OR audit>0.12+0.10 THEN 'repetition' END], lambda x: x IS NOT NULL),'|') AS flags FROM {RATES}""")
def red_flags(spark, d):
    base = {"score": F.lit(0.25), "wps": F.lit(12.0), "struct": F.lit(0.05), "opener": F.lit(0.1), "intra": F.lit(0.12)}
    edit = {"score": F.col("score"), "wps": 60 * F.col("intra"), "struct": F.col("struct"), "opener": F.col("opener"), "intra": F.col("audit")}
    return rates(spark, d).select("user_id", F.array_join(O.red_flags(base, edit), "|").alias("flags"))


@query(f"SELECT user_id, round(2.0*sum(value) FILTER (WHERE event_type='view')/1000+0.5*sum(value) FILTER (WHERE event_type='click')/1000+sum(k) FILTER (WHERE event_type IN ('view','click'))/100.0,8) AS objective FROM {EVENTS} GROUP BY user_id HAVING count(*) FILTER (WHERE event_type='view')>0 AND count(*) FILTER (WHERE event_type='click')>0")
def joint_objective(spark, d):
    """Two axes of each user, weighted, and their penalties."""
    axes = ["view", "click"]
    weight = B.weights("2.0,0.5", axes)
    e = events(spark, d).where(F.col("event_type").isin(axes)).groupBy("user_id", F.col("event_type").alias("axis")).agg((F.sum("value") / 1000).alias("primary"), (F.sum("k") / 100.0).alias("penalty"))
    e = e.withColumn("weight", F.when(F.col("axis") == "view", weight["view"]).otherwise(weight["click"]))
    return e.groupBy("user_id").agg(F.round(B.joint_objective(e), 8).alias("objective"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


# ---- choices and spaces ----


@query(f"SELECT n, CAST(floor(n*0.15) AS BIGINT) AS low, n AS high, CAST(floor(n*0.05) AS BIGINT) AS lower FROM (SELECT DISTINCT CAST(k+1 AS BIGINT) AS n FROM {EVENTS})")
def layer_windows(spark, d):
    n = events(spark, d).select((F.col("k") + 1).cast("long").alias("n")).distinct()
    w = n.select("n", B.layer_window(F.col("n")).alias("w"), B.layer_window(F.col("n"), 0.05).alias("v"))
    return w.select("n", F.col("w.low").alias("low"), F.col("w.high").alias("high"), F.col("v.low").alias("lower"))


_CHOSEN = f"(SELECT event_id, CASE k%5 WHEN 0 THEN '1' WHEN 1 THEN '0' END AS no, CASE user_id%3 WHEN 0 THEN 'plain' WHEN 1 THEN '' END AS po, CASE k%4 WHEN 0 THEN 'length' WHEN 1 THEN '' END AS bd, CASE k%7 WHEN 0 THEN 'plain' WHEN 1 THEN 'length' END AS fb, CASE event_id%3 WHEN 0 THEN true WHEN 1 THEN false END AS fn FROM {EVENTS})"


@query(f"SELECT event_id, coalesce(po,bd,fb,'') AS projection, CASE WHEN no IS NOT NULL THEN no='1' WHEN po IS NULL AND bd IS NULL THEN coalesce(fn,false) ELSE coalesce(po,bd,fb,'')='' END AS keeps_norms FROM {_CHOSEN}")
def projection_choices(spark, d):
    k, pick = F.col("k"), lambda c, a, b: F.when(c == 0, a).when(c == 1, b)
    own = [pick(F.col("user_id") % 3, "plain", ""), pick(k % 4, "length", ""), pick(k % 7, "plain", "length")]
    return events(spark, d).select("event_id", C.projection(*own).alias("projection"), C.keeps_norms(pick(k % 5, "1", "0"), *own, pick(F.col("event_id") % 3, True, False)).alias("keeps_norms"))


@query(f"""WITH a AS (SELECT event_type AS axis, max(k) AS layers, CASE WHEN event_type='view' THEN 0.15 ELSE 0.05 END AS low FROM {EVENTS} GROUP BY ALL)
SELECT axis||'_'||name AS key, kind, CAST(CASE WHEN name='dir_layer' THEN floor(layers*low) ELSE least END AS DOUBLE) AS least, CAST(CASE WHEN name='dir_layer' THEN layers ELSE most END AS DOUBLE) AS most
FROM a, (VALUES ('per_layer','choice',0,1),('dir_layer','int',0,0),('max_weight','float',0.2,1),('max_pos','float',0.2,1),('min_weight','float',0,0.4),('min_dist','float',0.1,1),('mlp_scale','float',0,1)) p(name,kind,least,most)""")
def joint_search_space(spark, d):
    low = F.when(F.col("event_type") == "view", 0.15).otherwise(0.05)
    return C.search_space(events(spark, d).groupBy(F.col("event_type").alias("axis")).agg(F.max("k").alias("layers"), F.first(low).alias("low")))


@query(f"""WITH t AS (SELECT user_id, max(k)/100.0 AS most, avg(k)/100 AS pos, min(k)/100.0 AS least, 0.1+avg(value)/1000 AS dist FROM {EVENTS} GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS axis, CAST(i AS INT) AS layer, round(0.5*(least+(most-least)*greatest(0,1-abs(i-pos*11)/greatest(dist*11,1e-6))),8) AS weight FROM t, range(12) r(i)""")
def joint_kernels(spark, d):
    t = events(spark, d).groupBy(F.col("user_id").cast("string").alias("axis")).agg((F.max("k") / 100).alias("max_weight"), (F.avg("k") / 100).alias("max_pos"), (F.min("k") / 100).alias("min_weight"), (0.1 + F.avg("value") / 1000).alias("min_dist"))
    return rounded(C.scaled_kernels(t, 0.5, 12), "weight")


@query("WITH l AS (SELECT label, avg(embedding[1]::DOUBLE) AS x, count(*) AS n FROM embeddings GROUP BY label) SELECT label, CAST(i AS INT) AS layer, round(0.1+(0.7+x)*greatest(0,1-abs(i-label/10.0*15)/(0.3*15)),8) AS weight FROM l, range(16) t(i)")
def kernel(spark, d):
    """A kernel for each label, its height by the label's mean and its place by the label."""
    by = table(spark, d, "embeddings").groupBy("label").agg(F.avg(F.get("embedding", F.lit(0)).cast("double")).alias("x"))
    k = V.kernel(F.lit(16), 0.8 + F.col("x"), F.col("label") / 10, F.lit(0.1), F.lit(0.3))
    return by.select("label", F.posexplode(k).alias("layer", "weight")).select("label", "layer", F.round("weight", 8).alias("weight"))


@query(f"SELECT event_type AS study, CASE WHEN count(*) FILTER (WHERE value>300)=0 THEN 1 ELSE 0 END AS seeds, round(max(k)/100.0,8) AS position FROM {EVENTS} GROUP BY event_type")
def study_seeds(spark, d):
    """The warm start of the studies, one for each kind of event, that have no trial of a value above 300 yet."""
    e, out = events(spark, d), None
    for kind in [r[0] for r in e.select("event_type").distinct().collect()]:  # a handful of kinds
        own = e.where(F.col("event_type") == kind)
        seed = own.agg((F.max("k") / 100.0).alias("max_pos"))
        n = C.seeds_of_study(own.where("value > 300"), seed).agg(F.count(F.lit(1)).cast("int").alias("seeds"))
        part = n.select(F.lit(kind).alias("study"), "seeds").join(F.broadcast(own.agg(F.first("event_type").alias("study"), F.round(F.max("k") / 100.0, 8).alias("position"))), "study")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH a AS (SELECT event_type AS axis, count(*) AS n, sum(value) AS total, row_number() OVER (ORDER BY event_type) AS nth FROM {EVENTS} GROUP BY event_type)
SELECT axis, CAST(1 AS DOUBLE) AS plain, nth/2.0 AS weighted, nth%2=1 AS improves, round(total*nth/2.0/n,6) AS weighed FROM a""")
def axis_weights(spark, d):
    """Weights of an axis for each kind of event, told one by one or not at all, and what the axes' values weigh by them."""
    e = events(spark, d)
    names = sorted(r[0] for r in e.select("event_type").distinct().collect())  # a handful of kinds
    both = {"worsen": ("s", "{orig}", 0.5), "improve": ("s", "{orig}", 0.5)}
    axes = [B.Axis(n, both if k % 2 == 0 else {"worsen": both["worsen"]}) for k, n in enumerate(names)]
    plain, weighted = B.weights(None, names), B.weights(",".join(str((k + 1) / 2) for k in range(len(names))), names)
    told = spark.createDataFrame([(a.name, plain[a.name], weighted[a.name], a.improves()) for a in axes], "axis string, plain double, weighted double, improves boolean")
    mean = e.groupBy(F.col("event_type").alias("axis")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    return mean.join(F.broadcast(told), "axis").select("axis", "plain", "weighted", "improves", F.round(F.col("total") * F.col("weighted") / F.col("n"), 6).alias("weighed"))


# ---- files and names ----


@query(f"WITH t AS (SELECT round(avg(value)/1000,4) AS own, round(avg(k)/1000,4) AS above FROM {EVENTS}) SELECT place, threshold, (SELECT count(*) FROM {EVENTS} WHERE value/1000>=threshold) AS n FROM (SELECT 'model' AS place, own AS threshold FROM t UNION ALL SELECT 'parent', above FROM t UNION ALL SELECT 'none', 0.5)")
def threshold_lookup(spark, d):
    """The threshold beside the model, else in its parent folder, else 0.5, and how many events reach it."""
    root, e = files.scratch(spark), events(spark, d)
    own, above = e.agg(F.round(F.avg("value") / 1000, 4), F.round(F.avg("k") / 1000, 4)).first()
    files.write_file(spark, f"{root}/a/model/threshold.json", json.dumps({"threshold": own}, indent=1))
    files.write_file(spark, f"{root}/a/threshold.json", json.dumps({"threshold": above}))
    found = {"model": B.read_threshold(spark, f"{root}/a/model", f"{root}/a"), "parent": B.read_threshold(spark, f"{root}/a/other", f"{root}/a"), "none": B.read_threshold(spark, f"{root}/b/model", f"{root}/b")}
    reach = e.agg(*(F.count_if(F.col("value") / 1000 >= t).alias(p) for p, t in found.items()))
    rows = F.array(*(F.struct(F.lit(p).alias("place"), F.lit(t).alias("threshold"), F.col(p).alias("n")) for p, t in found.items()))
    return reach.select(F.inline(rows))


@query("SELECT 'log' AS file, (SELECT count(*) FROM benchmark) AS n, (SELECT md5(string_agg(item_id::VARCHAR, ',' ORDER BY item_id)) FROM benchmark) AS ids UNION ALL SELECT 'log.20240102-030405.bk', (SELECT count(*) FROM benchmark)+(SELECT count(*) FROM labels), (SELECT md5(string_agg(x::VARCHAR, ',' ORDER BY x)) FROM (SELECT item_id AS x FROM benchmark UNION ALL SELECT doc_id FROM labels))")
def log_backup(spark, d):
    """Two appended batches, moved to a backup by a fresh log."""
    path = files.scratch(spark) + "/log"
    items = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("value"))
    files.write_log(items, path, fresh=True)
    files.write_log(table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("value")), path)
    backup = files.write_log(items, path, fresh=True, now=datetime(2024, 1, 2, 3, 4, 5))
    ids = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.col("value").cast("long"))), lambda x: x.cast("string")), ","))
    parts = [spark.read.text(p).agg(F.count(F.lit(1)).alias("n"), ids.alias("ids")).select(F.lit(p.rsplit("/", 1)[1]).alias("file"), "n", "ids") for p in (path, backup)]
    return parts[0].unionByName(parts[1])


@query(f"SELECT 'Org/'||event_type||'-'||k||'B-Encoder' AS name, count(*) AS n, event_type||'-'||k||'b' AS slug FROM {EVENTS} GROUP BY ALL")
def model_slugs(spark, d):
    name = F.concat(F.lit("Org/"), "event_type", F.lit("-"), "k", F.lit("B-Encoder"))
    e = events(spark, d).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("slug", T.model_slug("name"))


@query("WITH a AS (SELECT event_type AS a, CASE WHEN event_type='click' THEN '' ELSE '-'||event_type END AS s, count(*) AS n FROM events GROUP BY ALL) SELECT a AS axis, n, p.piece, p.name FROM a, LATERAL (SELECT unnest(['" + "','".join(("classifier", "pairs", "directions", "scenarios", "edited", "log", "replies")) + "']) AS piece, unnest(['models/mini400m-'||a, 'data/'||a||'/interim/'||a||'_pairs.jsonl', 'directions-base-2b'||s||'-lengthproj', 'eval_scenarios'||s||'.jsonl', 'models/base-2b'||s||'-lengthproj-normpres-edited', 'optimize-base-2b'||s||'-lengthproj-normpres.log', 'state-replies-best-base-2b.jsonl']) AS name) p")
def artifact_names(spark, d):
    """Where the pieces of an axis stand, an axis for each kind of event; the first axis has no suffix."""
    axes = events(spark, d).groupBy(F.col("event_type").alias("axis")).agg(F.count(F.lit(1)).alias("n"))
    rows = []
    for r in axes.select("axis").collect():  # a handful of kinds
        own = files.names("org/Base-2B", "org/Mini-encoder-400m", r["axis"], "click", "length", True) | {"replies": files.replies_name("state", "best", "org/Base-2B")}
        rows += [(r["axis"], piece, name) for piece, name in own.items()]
    return axes.join(F.broadcast(spark.createDataFrame(rows, "axis string, piece string, name string")), "axis")


# ---- scanners and selection ----

_CASES = {"none": None, "one off": {"cliches": False}, "two on": dict.fromkeys(audit.SCANNERS, False) | {"openers": True, "templates": True}}


def _toggled_sql() -> str:
    whole = text_plans.SQL_OF_SUMMARY
    body = whole[: whole.rindex("SELECT *, ")]
    on = {name: [s for s in audit.SCANNERS if (toggles or {}).get(s, True)] for name, toggles in _CASES.items()}
    parts = [f"SELECT '{name}' AS toggles, scanner, CAST(sum(n) AS BIGINT) AS n FROM found WHERE scanner IN ({','.join(repr(s) for s in own)}) GROUP BY scanner" for name, own in on.items()]
    return body + " UNION ALL ".join(parts)


@query(_toggled_sql())
def scanner_toggles(spark, d):
    """Issues by scanner under three sets of toggles; a scanner without a toggle is on, one that is off isn't run."""
    turns, out = table(spark, d, "conversations"), None
    for name, toggles in _CASES.items():
        s = audit.summary(turns, text_plans.BANK, toggles=toggles)
        kinds = F.array(*(F.struct(F.lit(k).alias("scanner"), F.col(k).alias("n")) for k in audit.SCANNERS))
        part = s.select(F.inline(kinds)).groupBy("scanner").agg(F.sum("n").alias("n")).where("n > 0").select(F.lit(name).alias("toggles"), "scanner", "n")
        out = part if out is None else out.unionByName(part)
    return out


_NUMBER = "CAST('0x'||substr(md5('7:'||CAST(doc_id AS VARCHAR)),1,15) AS BIGINT)"


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_NUMBER}, doc_id) <= floor(count(*) OVER ()*0.2) AS held_out FROM documents")
def exact_hold_out(spark, d):
    """A fifth of all documents, exactly, by a seeded shuffle that no partitioning changes."""
    return selection.held_out_exactly(table(spark, d, "documents").select("doc_id"), "doc_id", 0.2, 7)


@query(f"SELECT doc_id FROM documents ORDER BY {_NUMBER}, doc_id LIMIT 100")
def seeded_pilot(spark, d):
    """The first hundred documents of a seeded shuffle: a pilot of a run."""
    return selection.seeded_head(table(spark, d, "documents").select("doc_id"), "doc_id", 100, 7)
