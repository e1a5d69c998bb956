"""Grading answers and tool calls, comparing runs, and reading trial logs and benchmark results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselake.functions import text as T

CALL = r"(?s)<\|tool_call>\s*call:\s*([A-Za-z0-9_]+)\s*\{(.*?)\}\s*<tool_call\|>"
NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def mentions(reply: Column, term: Column) -> Column:
    """The term stands whole in the reply, in any case."""
    return F.regexp_like(F.lower(reply), F.concat(F.lit(r"(?U)\b"), T.escaped(F.lower(term)), F.lit(r"\b")))


def answer_ok(reply: Column, expect: Column, reject: Column) -> Column:
    """Some expected answer is there and no rejected one; null arrays are empty."""
    none = F.array().cast("array<string>")
    return ~F.exists(F.coalesce(reject, none), lambda p: mentions(reply, p)) & F.exists(F.coalesce(expect, none), lambda p: mentions(reply, p))


def call_name(reply: Column) -> Column:
    return F.nullif(F.regexp_extract(reply, CALL, 1), F.lit(""))


def call_body(reply: Column) -> Column:
    return F.when(call_name(reply).isNotNull(), F.replace(F.regexp_extract(reply, CALL, 2), F.lit('<|"|>'), F.lit("")))


def call_ok(reply: Column, tool: Column, args: Column, contains: Column) -> Column:
    """The right tool with every argument bound to its key and every text in the body; a null tool: no call at all."""
    name, body = call_name(reply), F.lower(call_body(reply))
    pairs = F.map_entries(F.coalesce(args, F.create_map().cast("map<string,string>")))

    def bound(e: Column) -> Column:
        return F.regexp_like(body, F.concat(F.lit(r"(?U)\b"), T.escaped(F.lower(e["key"])), F.lit(r"\s*:\s*\[?\s*"), T.escaped(F.lower(e["value"])), F.lit(r"\b")))

    texts = F.coalesce(contains, F.array().cast("array<string>"))
    good = (name == tool) & F.forall(pairs, bound) & F.forall(texts, lambda c: F.contains(body, F.lower(c)))
    return F.when(tool.isNull(), name.isNull()).otherwise(F.coalesce(good, F.lit(False)))


def require_same(scenarios: DataFrame, base: DataFrame, edited: DataFrame, key: str = "id") -> None:
    """Both dumps must answer every scenario."""
    both = base.select(key).join(edited.select(key), key, "left_semi")
    missing = [r[key] for r in scenarios.select(key).join(both, key, "left_anti").orderBy(key).limit(20).collect()]
    if missing:
        raise ValueError(f"stale dumps, without {', '.join(map(str, missing))}")


def regressions(base: DataFrame, edited: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that were right and no longer are; keys that `edited` lacks count as wrong (see require_same)."""
    e = edited.select(*keys, F.col("ok").alias("ok_edited"))
    return base.join(e, keys, "left").where(F.col("ok") & ~F.coalesce("ok_edited", F.lit(False))).select(*keys)


def accuracy_delta(base: DataFrame, edited: DataFrame, worst: float = -0.05) -> DataFrame:
    b = base.agg(F.avg(F.col("ok").cast("double")).alias("base"))
    e = edited.agg(F.avg(F.col("ok").cast("double")).alias("edited"))
    return b.crossJoin(e).withColumn("delta", F.col("edited") - F.col("base")).withColumn("regressed", F.col("delta") < worst)  # one row each


def metrics(results: DataFrame) -> DataFrame:
    """(task, key, name, filter, value) of a table (task, metrics map) without standard errors and bookkeeping."""
    m = results.select("task", F.explode("metrics").alias("key", "value"))
    name = F.element_at(F.split("key", ","), 1)
    return m.select("task", "key", name.alias("name"), F.coalesce(F.try_element_at(F.split("key", ","), F.lit(2)), F.lit("")).alias("filter"), "value").where(~F.endswith(name, F.lit("_stderr")) & ~name.isin("alias", "sample_len") & F.col("value").isNotNull())


def benchmark_delta(base: DataFrame, edited: DataFrame, leaves: DataFrame | None = None, least: float = -0.02) -> DataFrame:
    """(task, key, base, edited, delta, regressed): a regression is beyond `least` and beyond both standard errors together."""
    if leaves is not None:
        base = base.join(leaves.select("task").distinct(), "task", "left_anti")

    def with_error(r: DataFrame, to: str) -> DataFrame:
        err = r.select("task", F.explode("metrics").alias("k", "e"))
        m = metrics(r).withColumn("k", F.concat("name", F.lit("_stderr,"), "filter"))
        return m.join(err, ["task", "k"], "left").select("task", "key", F.col("value").alias(to), F.coalesce("e", F.lit(0.0)).alias(f"{to}_error"))

    j = with_error(base, "base").join(with_error(edited, "edited"), ["task", "key"]).withColumn("delta", F.col("edited") - F.col("base"))
    return j.select("task", "key", "base", "edited", "delta", ((F.col("delta") < least) & (-F.col("delta") > F.col("base_error") + F.col("edited_error"))).alias("regressed"))


def trials(lines: DataFrame, line: str = "value") -> DataFrame:
    """(trial, value, params) of a search log's finished trials; params is a map of text."""
    c = F.col(line)
    n = F.regexp_extract(c, r"Trial (\d+) finished with value: ", 1)
    params = F.regexp_extract(c, r"parameters: \{(.*?)\}", 1)
    pairs = F.regexp_extract_all(params, F.lit(r"'[^']+': [^,]+"), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"'([^']+)'", 1), F.regexp_extract(p, r": '?([^']*)'?$", 1)))
    return lines.where(n != "").select(n.cast("long").alias("trial"), F.regexp_extract(c, f"finished with value: ({NUMBER})", 1).cast("double").alias("value"), F.map_from_entries(entries).alias("params"))


def best_trial(log: DataFrame) -> DataFrame:
    return log.orderBy("value", "trial").limit(1)


def under_floor(log: DataFrame, percent: float = 20.0, margin: float = 20.0) -> DataFrame:
    """(trial, value, floor): values up to the mean of the best `percent`, plus `margin` percent of its size."""
    import math

    from proselake.operators.selection import among_smallest

    known = log.where("value IS NOT NULL")
    best = among_smallest(known, max(1, math.ceil(known.count() * percent / 100)), "value", "trial")
    mean = known.where(best).agg(F.avg("value")).first()[0]
    floor = F.lit(None if mean is None else mean + abs(mean) * margin / 100).cast("double")
    return known.withColumn("floor", floor).where("value <= floor").select("trial", "value", "floor")


def single_word(answer: Column) -> Column:
    return ~F.contains(answer, F.lit(" ")) & ~F.contains(answer, F.lit(","))


def axis_params(params: Column, axis: str) -> Column:
    """A trial's parameters of one axis without the axis's prefix; mlp_scale is 1.0 if it is missing."""
    own = F.map_filter(params, lambda k, _: F.startswith(k, F.lit(axis + "_")))
    own = F.transform_keys(own, lambda k, _: F.substring(k, len(axis) + 2, 1000))
    return F.when(F.map_contains_key(own, "mlp_scale"), own).otherwise(F.map_concat(own, F.create_map(F.lit("mlp_scale"), F.lit("1.0"))))
