"""A second runtime for linear scorers: symmetric 8-bit weights for each channel, integer products, and the gate that compares.

Weights of a class (a channel) become integers by one scale for each channel; a vector's components by one scale for each
vector. Scores are sums of integer products, scaled back once; all of it is table arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 127


def scale_of(largest: Column) -> Column:
    """What one level stands for; 1 where all values are 0."""
    return F.when(largest > 0, largest / LEVELS).otherwise(1.0)


def quantized(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All columns and q (the value in levels, -127 to 127, halves to even) and scale, by groups of equal keys."""
    scale = scale_of(F.max(F.abs(value)).over(Window.partitionBy(*keys)))
    rows = rows.withColumn("scale", scale)
    return rows.withColumn("q", F.rint(F.col(value) / F.col("scale")).cast("int"))


def weights_quantized(weights: DataFrame, per_channel: bool = True) -> DataFrame:
    """(channel, dim, w) with q and scale: a scale for each channel, or one for all."""
    return quantized(weights if per_channel else weights.withColumn("_all", F.lit(0)), ["channel"] if per_channel else ["_all"], "w").drop("_all")


def _one_row(weights: DataFrame, value: str, *more: Column) -> DataFrame:
    """One row: all channels with their values in order of dim, and what else belongs to a channel."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("dim", value))), lambda x: x[value])
    by = weights.groupBy("channel").agg(in_order.alias("values"), *more)
    return F.broadcast(by.agg(F.array_sort(F.collect_list(F.struct(*by.columns))).alias("channels")))


def _each(rows: DataFrame, one: DataFrame, id_col: str, of) -> DataFrame:
    per = F.transform("channels", lambda c: F.struct(c["channel"].alias("channel"), *of(c)))
    return rows.crossJoin(one).select(id_col, F.explode(per).alias("s")).select(id_col, "s.*")  # one row


def scores(vectors: DataFrame, weights: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, channel, score) in doubles. weights: a linear model's, as many rows as channels times dimensions. Null vectors have no rows."""
    rows = vectors.select(id_col, F.col(vec_col).cast("array<double>").alias("x")).where("x IS NOT NULL")
    dot = lambda c: F.aggregate(F.zip_with("x", c["values"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return _each(rows, _one_row(weights, "w"), id_col, lambda c: [dot(c).alias("score")])


def integer_scores(vectors: DataFrame, weights: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", per_channel: bool = True) -> DataFrame:
    """(id, channel, score, dot): the same from integers; dot is the sum of integer products."""
    one = _one_row(weights_quantized(weights, per_channel), "q", F.first("scale").alias("scale"))
    rows = vectors.select(id_col, F.col(vec_col).cast("array<double>").alias("x")).where("x IS NOT NULL")
    rows = rows.withColumn("x_scale", scale_of(F.array_max(F.transform("x", F.abs))))
    rows = rows.withColumn("x_q", F.transform("x", lambda v: F.rint(v / F.col("x_scale")).cast("int")))
    dot = lambda c: F.aggregate(F.zip_with("x_q", c["values"], lambda a, b: (a * b).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    out = _each(rows.select(id_col, "x_q", "x_scale"), one, id_col, lambda c: [dot(c).alias("dot"), (F.col("x_scale") * c["scale"]).alias("scale")])
    return out.select(id_col, "channel", (F.col("dot") * F.col("scale")).alias("score"), "dot")


def decisions(scored: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(id, channel) of each vector's highest score, the lower channel of equal ones."""
    best = F.max(F.struct("score", (-F.col("channel")).alias("c")))
    return scored.groupBy(id_col).agg((-best["c"]).alias("channel"))


def gate(exact: DataFrame, other: DataFrame, id_col: str = "vec_id", least: float = 0.95) -> DataFrame:
    """One row: n, the share of equal decisions, the mean difference of scores, and whether the share reaches the gate."""
    same = decisions(exact, id_col).join(decisions(other, id_col).withColumnRenamed("channel", "other"), id_col)
    share = same.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("channel") == F.col("other")).cast("double")).alias("agreement"))
    apart = exact.join(other.select(id_col, "channel", F.col("score").alias("_o")), [id_col, "channel"]).agg(F.avg(F.abs(F.col("score") - F.col("_o"))).alias("mean_difference"))
    return share.crossJoin(apart).withColumn("passes", F.col("agreement") >= least)  # one row each
