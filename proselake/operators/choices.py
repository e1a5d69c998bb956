"""Choices that fall back in order, search spaces, floors and other small rules, as column expressions and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The search space of one kernel.
KERNEL = {"max_weight": (0.2, 1.0), "max_pos": (0.2, 1.0), "min_weight": (0.0, 0.4), "min_dist": (0.1, 1.0), "mlp_scale": (0.0, 1.0)}
PROJECTIONS = ("", "plain", "length")


def projection(override: Column, by_data: Column, fallback: Column) -> Column:
    """The override, else what the pairs say, else the axis's fallback, else none. Another word than PROJECTIONS fails."""
    chosen = F.coalesce(override, by_data, fallback, F.lit(""))
    return F.when(chosen.isin(*PROJECTIONS), chosen).otherwise(F.raise_error(F.concat(F.lit("no projection: "), chosen)).cast("string"))


def keeps_norms(override: Column, projection_override: Column, by_data: Column, fallback: Column, fallback_norms: Column) -> Column:
    """Override '1'; without data and override the fallback; else only raw directions keep norms."""
    no_data = projection_override.isNull() & by_data.isNull()
    raw = projection(projection_override, by_data, fallback) == ""
    return F.when(override.isNotNull(), override == "1").when(no_data, F.coalesce(fallback_norms, F.lit(False))).otherwise(raw)


def search_space(axes: DataFrame, axis: str = "axis", layers: str = "layers", low: str = "low") -> DataFrame:
    """(key, kind, least, most): the union of the axes' spaces, keys with the axis before them; low: the share of layers left out below."""
    floats = [F.struct(F.lit(k).alias("name"), F.lit("float").alias("kind"), F.lit(a).alias("least"), F.lit(b).alias("most")) for k, (a, b) in KERNEL.items()]
    layer = F.struct(F.lit("dir_layer").alias("name"), F.lit("int").alias("kind"), F.floor(F.col(layers) * F.col(low)).cast("double").alias("least"), F.col(layers).cast("double").alias("most"))
    flag = F.struct(F.lit("per_layer").alias("name"), F.lit("choice").alias("kind"), F.lit(0.0).alias("least"), F.lit(1.0).alias("most"))
    return axes.select(axis, F.explode(F.array(flag, layer, *floats)).alias("p")).select(F.concat(axis, F.lit("_"), "p.name").alias("key"), "p.kind", "p.least", "p.most")


def primary_floor(two_sided: Column, beta: float) -> Column:
    """A sure lower bound of an axis's primary."""
    return F.when(two_sided, -beta).otherwise(0.0)


def axis_primary(replies: DataFrame, keys: list[str], beta: float = 5.0, penalty: float = 2.0) -> DataFrame:
    """(keys, primary, floor) of rows (keys, p, density, base_density): p less beta times the density, and a penalty as far as the
    density falls under the base's; none where that is null or 0."""
    r = replies.groupBy(*keys).agg(F.avg("p").alias("p"), F.avg("density").alias("density"), F.avg("base_density").alias("base"))
    floor = F.when(F.col("base") > 0, penalty * F.greatest(F.lit(0.0), 1 - F.col("density") / F.col("base"))).otherwise(0.0)
    return r.select(*keys, (F.col("p") - beta * F.col("density")).alias("primary"), floor.alias("floor"))


def scaled_kernels(trial: DataFrame, strength: float, layers: int) -> DataFrame:
    """(axis, layer, weight) of a trial's kernels (axis, max_weight, max_pos, min_weight, min_dist), scaled by a strength."""
    from proselake.operators.vectors import kernel

    k = kernel(F.lit(layers), *(F.col(c) for c in ("max_weight", "max_pos", "min_weight", "min_dist")))
    return trial.select("axis", F.posexplode(F.transform(k, lambda w: w * strength)).alias("layer", "weight"))


def scenario_sets(scenarios: DataFrame, whole: bool = False, n: int | None = None, order: str = "id") -> DataFrame:
    """Scenarios with `set`: bait and collapse by the beginning of the id, or all bait; the first n of each set, if asked for."""
    kind = F.lit("bait") if whole else F.when(F.startswith("id", F.lit("bait_")), "bait").when(F.startswith("id", F.lit("collapse_")), "collapse")
    s = scenarios.withColumn("set", kind).where("set IS NOT NULL")
    if n is None:
        return s
    parts = [s.where(F.col("set") == k).orderBy(order).limit(n) for k in ("bait", "collapse")]
    return parts[0].unionByName(parts[1])


def shown(rows: DataFrame, order: list, most: int = 30) -> DataFrame:
    """The rows that a report shows: the first `most`."""
    return rows.orderBy(*order).limit(most)


def seeds_of_study(trials: DataFrame, seed: DataFrame) -> DataFrame:
    """The warm start, for a study without trials only."""
    none = trials.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
    return seed.crossJoin(none).drop("_n")  # one row at most
