"""Objective and guard arithmetic of an edit search, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselake.functions import text as T

#: Linear and quadratic weights of the guards, and the slacks and caps of the two ratios.
OPENER, AUDIT, INTRA, STRUCT = (2.0, 8.0), (1.0, 3.0), (3.0, 8.0), (2.0, 8.0)
COLLAPSE, COHERENCE, CAPABILITY = 2.0, 1.0, 1.0
SLACK, CAP, MARGIN, BETA = 0.15, 6.0, 0.05, 5.0


def late_weighted(df: DataFrame, unit: list[str], turn: str = "turn", value: str = "value") -> DataFrame:
    """Mean of a curve in which the n-th turn (from 0) weighs n + 1."""
    w = F.col(turn) + 1
    return df.groupBy(*unit).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("late_weighted"))


def excess(value: Column, base: Column, weights: tuple[float, float]) -> Column:
    e = F.greatest(F.lit(0.0), value - base)
    return weights[0] * e + weights[1] * e * e


def components(edit: dict[str, Column], base: dict[str, Column], floor: Column | None = None) -> dict[str, Column]:
    """Named guard penalties from the rates opener, audit, intra, struct and the coverage."""
    out = {n: excess(edit[n], base[n], w) for n, w in (("opener", OPENER), ("audit", AUDIT), ("intra", INTRA), ("struct", STRUCT))}
    shortfall = F.when(base["coverage"] != 0, 1 - edit["coverage"] / base["coverage"]).otherwise(0.0)
    return out | {"collapse": COLLAPSE * F.greatest(F.lit(0.0), shortfall), "floor": F.lit(0.0) if floor is None else floor}


def ratio_penalty(value: Column, base: Column, weight: float = 1.0) -> Column:
    return weight * F.greatest(F.lit(0.0), F.least(value / base, F.lit(CAP)) - (1 + SLACK))


def saturated_reject(base_objective: Column) -> Column:
    return base_objective + (CAPABILITY + COHERENCE) * (CAP - (1 + SLACK))


def partial_reject(rates: dict[str, Column], base: dict[str, Column], done: Column, total: Column, base_objective: Column, floor: float = 0.0) -> Column:
    """The value to abort a partial run with, or null: rates are diluted by the share that is done."""
    share = done / total
    penalty = sum((excess(rates[n] * share, base[n], w) for n, w in (("opener", OPENER), ("audit", AUDIT), ("intra", INTRA), ("struct", STRUCT))), F.lit(0.0))
    return F.when((done > 0) & (done < total) & (penalty > base_objective - floor + MARGIN), base_objective + penalty)


def partial_reject_value(rates: dict[str, float], base: dict[str, float], done: float, total: float, base_objective: float, floor: float = 0.0) -> float | None:
    """partial_reject() of numbers, for a run that is watched from outside; rates that aren't measured count as clean."""
    penalty = 0.0
    for n, (linear, square) in (("opener", OPENER), ("audit", AUDIT), ("intra", INTRA), ("struct", STRUCT)):
        e = max(0.0, rates.get(n, 0.0) * done / total - base.get(n, 0.0)) if total else 0.0
        penalty += linear * e + square * e * e
    return base_objective + penalty if 0 < done < total and penalty > base_objective - floor + MARGIN else None


def two_sided(score: Column, density: Column) -> Column:
    return score - BETA * density


def fired(parts: dict[str, Column], least: float = 1e-4) -> Column:
    """'[name 0.123 ...]' of the penalties that fired, the largest first."""
    rows = F.array(*(F.struct((-v).alias("v"), F.lit(n).alias("n")) for n, v in parts.items()))
    kept = F.array_sort(F.filter(rows, lambda r: -r["v"] > least))
    return F.concat(F.lit("["), F.array_join(F.transform(kept, lambda r: F.concat(r["n"], F.lit(" "), F.format_string("%.3f", -r["v"]))), " "), F.lit("]"))


def red_flags(base: dict[str, Column], edit: dict[str, Column]) -> Column:
    """Names of the advisory rules that fire."""
    rules = (
        ("weak move", edit["score"] > base["score"] - 0.15 * base["score"]),
        ("sentences shortened", edit["wps"] < base["wps"] - 1.0),
        ("report mode", edit["struct"] > base["struct"] + 0.05),
        ("repetition", (edit["opener"] > base["opener"] + 0.10) | (edit["intra"] > base["intra"] + 0.10)),
    )
    return F.filter(F.array(*(F.when(rule, F.lit(n)) for n, rule in rules)), lambda x: x.isNotNull())


def warm_start(q25: Column, q50: Column, q75: Column, layers: Column) -> tuple[Column, Column]:
    """(position, distance) of the first kernel from the quartile layers."""
    last = layers - 1
    return F.least(F.greatest(q50 / last, F.lit(0.2)), F.lit(1.0)), F.least(F.greatest((q75 - q25) / last, F.lit(0.1)), F.lit(1.0))


def late_replies(replies: DataFrame, unit: str, turn: str, start: Column | None = None) -> DataFrame:
    """Replies from a unit's start turn on, or else from half of its turns. Only turns are ordered; replies are joined to them."""
    from pyspark.sql import Window

    asked = F.lit(None).cast("double") if start is None else F.max(start.cast("double"))
    turns = replies.groupBy(unit, turn).agg(F.count(F.lit(1)).alias("_n"), asked.alias("_start"))
    every = Window.partitionBy(unit)
    before = F.coalesce(F.sum("_n").over(every.orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = F.coalesce(F.col("_start"), F.floor(F.sum("_n").over(every) * 0.5))
    late = turns.select(unit, turn, before.alias("_place"), begin.alias("_begin")).where("_place >= _begin").select(unit, turn)
    return replies.join(late, [unit, turn], "left_semi")


def length_confound(pairs: DataFrame, most: float = 2.0) -> DataFrame:
    """One row: mean difference in words of pos and neg, and the projection that it calls for."""
    words = lambda c: F.size(F.split(T.strip(c), r"\s+"))
    d = pairs.agg(F.avg((words("pos") - words("neg")).cast("double")).alias("delta"))
    return d.withColumn("projection", F.when(F.abs("delta") > most, "length").otherwise(""))
