"""Directions over pooled vectors and rank-one removal, in long form: a row for each vector and dimension, or matrix cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_form(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *others: str) -> DataFrame:
    """(id, others, dim, x) in double precision."""
    return vectors.select(id_col, *others, F.posexplode(F.col(vec_col).cast("array<double>")).alias("dim", "x"))


def class_means(long: DataFrame, positive: Column) -> DataFrame:
    """(dim, neg, pos, r): the class means of each dimension and their difference."""
    m = long.groupBy("dim").agg(F.avg(F.when(~positive, F.col("x"))).alias("neg"), F.avg(F.when(positive, F.col("x"))).alias("pos"))
    return m.withColumn("r", F.col("pos") - F.col("neg"))


def unit(d: DataFrame, value: str = "r", to: str = "u") -> DataFrame:
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy()))
    return d.withColumn(to, F.col(value) / F.greatest(norm, F.lit(1e-8)))


def orthogonalized(d: DataFrame, value: str = "r", against: str = "neg", to: str = "r_proj") -> DataFrame:
    """value without its part along the direction of `against`."""
    d = unit(d, against, "_a")
    dot = F.sum(F.col(value) * F.col("_a")).over(Window.partitionBy())
    return d.withColumn(to, F.col(value) - dot * F.col("_a")).drop("_a")


def projections(long: DataFrame, direction: DataFrame, keys: list[str], value: str = "u") -> DataFrame:
    """(keys, p): dot product of each vector with the direction, which has a row for each dimension."""
    return long.join(F.broadcast(direction.select("dim", value)), "dim").groupBy(*keys).agg(F.sum(F.col("x") * F.col(value)).alias("p"))  # as many rows as dimensions


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: correlation, 0 where one side doesn't vary."""
    return df.agg(F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0)).alias("correlation"))


def confounds(d: DataFrame) -> DataFrame:
    """One row: cosine of r and the negative mean, and the share of r's length that removing that mean leaves."""
    dot, nn, rr = F.sum(F.col("r") * F.col("neg")), F.sqrt(F.sum(F.col("neg") * F.col("neg"))), F.sqrt(F.sum(F.col("r") * F.col("r")))
    d = orthogonalized(d)
    return d.agg((dot / (nn * rr)).alias("cosine"), (F.sqrt(F.sum(F.col("r_proj") * F.col("r_proj"))) / rr).alias("survival"))


def write_profile(layers: DataFrame, unit_col: str = "unit", layer: str = "layer", value: str = "p", positive: str = "positive") -> DataFrame:
    """(layer, attr, cum): what each layer adds along the direction, positive minus negative units, and its running share."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(unit_col).orderBy(layer))
    s = layers.withColumn("step", step).where(F.col("step").isNotNull())
    a = s.groupBy(layer).agg((F.avg(F.when(F.col(positive), F.col("step"))) - F.avg(F.when(~F.col(positive), F.col("step")))).alias("attr"))
    mass = F.greatest(F.col("attr"), F.lit(0.0))
    run = F.sum(mass).over(Window.orderBy(layer).rowsBetween(Window.unboundedPreceding, 0))
    return a.withColumn("cum", run / F.greatest(F.sum(mass).over(Window.partitionBy()), F.lit(1e-8)))


def quartile_layers(profile: DataFrame, layer: str = "layer") -> DataFrame:
    return profile.agg(*(F.min(F.when(F.col("cum") >= q, F.col(layer))).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)))


def kernel(n: Column, most: Column, position: Column, least: Column, distance: Column) -> Column:
    """Triangular weights over n layers."""
    centre, half = position * (n - 1), F.greatest(distance * (n - 1), F.lit(1e-6))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: least + (most - least) * F.greatest(F.lit(0.0), 1 - F.abs(i - centre) / half))


def rank_one_removed(matrix: DataFrame, specs: DataFrame) -> DataFrame:
    """(row, col, val, new): the matrix without the parts along each spec's direction, all read from the original.

    matrix: (row, col, val). specs: (spec, row, d, weight), d a unit direction over rows; weights of 0 or less do nothing.
    """
    active = specs.where("weight > 0")
    m = matrix.join(F.broadcast(active), "row")  # as many rows as directions have dimensions
    proj = m.groupBy("spec", "col").agg(F.sum(F.col("d") * F.col("val")).alias("proj"))
    delta = proj.join(F.broadcast(active), "spec").groupBy("row", "col").agg(F.sum(F.col("weight") * F.col("d") * F.col("proj")).alias("delta"))
    return matrix.join(delta, ["row", "col"], "left").select("row", "col", "val", (F.col("val") - F.coalesce("delta", F.lit(0.0))).alias("new"))


def norms_restored(removed: DataFrame, reference: str = "val") -> DataFrame:
    """(row, col, val, new) with each column of `new` scaled to the length of the reference column."""
    by = removed.groupBy("col").agg(F.sqrt(F.sum(F.col(reference) * F.col(reference))).alias("ref"), F.sqrt(F.sum(F.col("new") * F.col("new"))).alias("own"))
    return removed.join(by, "col").select("row", "col", "val", (F.col("new") * F.col("ref") / F.greatest("own", F.lit(1e-8))).alias("new"))


def edited_matrix(matrix: DataFrame, specs: DataFrame) -> DataFrame:
    """(row, col, val, new): rank-one removal of all specs (spec, row, d, weight, keeps), read from the original, in one pass.

    Columns keep the length that they have after the removals of the specs that don't keep it; if no spec does, none is scaled.
    """
    every = rank_one_removed(matrix, specs.drop("keeps"))
    loose = rank_one_removed(matrix, specs.where("NOT keeps").drop("keeps")).select("row", "col", F.col("new").alias("loose"))
    some = specs.where("keeps").select(F.lit(True).alias("_some")).limit(1)
    joined = every.join(loose, ["row", "col"])
    scaled = norms_restored(joined, "loose").select("row", "col", F.col("new").alias("scaled"))
    r = every.join(scaled, ["row", "col"]).join(F.broadcast(some), how="left")  # one row at most
    return r.select("row", "col", "val", F.when(F.col("_some"), F.col("scaled")).otherwise(F.col("new")).alias("new"))


def confound_report(layers: DataFrame, n: int, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """One row from (layer, cosine, correlation, survival) of n layers: the extremes of the middle of the stack and three gates."""
    mid = layers.where(F.col("layer").between(int(low * n), int(high * n)))
    r = mid.agg(F.max(F.abs("cosine")).alias("cosine"), F.max(F.abs("correlation")).alias("correlation"), F.min("survival").alias("survival"))
    return r.select("*", (F.col("cosine") < 0.2).alias("skips_projection"), (F.col("correlation") > 0.4).alias("needs_data"), (F.col("survival") < 0.5).alias("under_ablates"))


def mean_pooled(tokens: DataFrame, keys: list[str], vec_col: str = "embedding", mask: str | None = None) -> DataFrame:
    """(keys, dim, x): mean of the tokens' vectors, of those under the mask only; 0 where the mask leaves none."""
    weight = F.lit(1.0) if mask is None else F.col(mask).cast("double")
    long = tokens.select(*keys, weight.alias("_w"), F.posexplode(F.col(vec_col).cast("array<double>")).alias("dim", "v"))
    return long.groupBy(*keys, "dim").agg((F.sum(F.col("v") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1.0))).alias("x"))


def covariance_axis(long: DataFrame, covariate: str) -> DataFrame:
    """(dim, axis): unit direction along which vectors move with the covariate, the population covariance of each dimension."""
    return unit(long.groupBy("dim").agg(F.covar_pop(covariate, "x").alias("c")), "c", "axis").select("dim", "axis")
