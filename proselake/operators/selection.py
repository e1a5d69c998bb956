"""Exact selection of the k smallest rows without a global sort, and a hold-out of an exact size that rests on it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
FEW = 10_000


def kth_smallest(df: DataFrame, by: str, k: int):
    """The k-th smallest value of a column (1 is the least) that isn't null; the largest if there are fewer; None if there is none.

    Rounds of histograms: each counts rows in 1,024 bins of the range that holds the value, and goes on in that bin with its
    own least and largest value. Once a bin has few rows, they are sorted. A round sends 1,024 rows to the driver at most.
    """
    rows = df.where(F.col(by).isNotNull()).select(by)
    r = rows.agg(F.min(by).alias("lo"), F.max(by).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi, n = r["lo"], r["hi"], r["n"]
    if not n or k >= n:
        return hi
    while lo != hi:
        part = rows.where(F.col(by).between(lo, hi))
        if n <= FEW:
            return sorted(x[0] for x in part.collect())[k - 1]
        width = (float(hi) - float(lo)) / BINS or 1.0
        # doubles keep the order of any numbers, so that bins do; each bin's bounds are values as they are
        at = F.least(F.greatest(F.floor((F.col(by).cast("double") - float(lo)) / width), F.lit(0)), F.lit(BINS - 1))
        bins = part.groupBy(at.alias("bin")).agg(F.min(by).alias("lo"), F.max(by).alias("hi"), F.count(F.lit(1)).alias("n")).collect()
        for b in sorted(bins, key=lambda b: b["bin"]):
            if k <= b["n"]:
                break
            k -= b["n"]
        if (lo, hi) == (b["lo"], b["hi"]):  # numbers too close for doubles to part
            return part.orderBy(by).limit(k).agg(F.max(by)).first()[0]
        lo, hi, n = b["lo"], b["hi"], b["n"]
    return lo


def among_smallest(df: DataFrame, k: int, by: str, tie: str) -> Column:
    """Whether a row is one of the k smallest by (by, tie); the pairs should differ. Nulls of `by` never are."""
    last = kth_smallest(df, by, k) if k > 0 else None
    if last is None:
        return F.lit(False)
    need = k - df.where(F.col(by) < last).count()
    end = kth_smallest(df.where(F.col(by) == last), tie, need)
    return F.coalesce((F.col(by) < last) | ((F.col(by) == last) & (F.col(tie) <= end)), F.lit(False))


def seeded(key: Column, seed: int) -> Column:
    """A number of 60 bits that stands for a row's place in the shuffle of this seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 15), 16, 10).cast("long")


def held_out_exactly(df: DataFrame, key: str, fraction: float = 0.2, seed: int = 0, to: str = "held_out") -> DataFrame:
    """All columns and whether a row is in the hold-out: of n rows with a key, the floor of n * fraction whose seeded numbers are
    the smallest, whatever the partitions. Keys should differ; a null key is never held out."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), seeded(F.col(key), seed).alias("_h"))
    chosen = among_smallest(rows, math.floor(rows.count() * fraction), "_h", "_key")
    marked = df.withColumn("_h", F.when(F.col(key).isNotNull(), seeded(F.col(key), seed))).withColumn("_key", F.col(key))
    return marked.withColumn(to, chosen).drop("_h", "_key")


def seeded_head(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The first n rows of the shuffle of this seed."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), seeded(F.col(key), seed).alias("_h"))
    chosen = among_smallest(rows, n, "_h", "_key")
    return df.withColumn("_h", F.when(F.col(key).isNotNull(), seeded(F.col(key), seed))).withColumn("_key", F.col(key)).where(chosen).drop("_h", "_key")
