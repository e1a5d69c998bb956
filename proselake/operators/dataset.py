"""Building labelled sentence data: pooling, validation, deduplication, leaks, splits, pairs and rewrites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselake.functions import text as T

ROW = ["text", "label", "source", "group_id", "is_real"]


def md5_bucket(salt: str, key: Column, modulo: int = 1000) -> Column:
    """md5('salt:key') as a number, modulo: Horner's rule over four chunks of 32 bits."""
    return _horner(F.md5(F.concat(F.lit(salt + ":"), key.cast("string"))), 4, modulo)


def sha1_bucket(prefix: str, key: Column, modulo: int = 100) -> Column:
    return _horner(F.sha1(F.concat(F.lit(prefix), key)), 5, modulo)


def _horner(digest: Column, chunks: int, modulo: int) -> Column:
    step = (1 << 32) % modulo
    value = F.lit(0).cast("long")
    for k in range(chunks):
        value = (value * step + F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")) % modulo
    return value


def held_out(key: Column, fraction: float, salt: str) -> Column:
    return md5_bucket(salt, key) < fraction * 1000


def text_group(prefix: str, c: Column | str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.md5(T.dedup_key(c)), 1, 12))


def pair_group(c: Column | str) -> Column:
    return F.concat(F.lit("pair_"), F.substring(F.sha1(T.col(c)), 1, 12))


def band(c: Column | str, shares: dict[str, int]) -> Column:
    """Deterministic band of a seed by cumulative shares of 100."""
    b, total, out = sha1_bucket("i", T.col(c)), 0, None
    for name, share in shares.items():
        total += share
        out = F.when(b < total, name) if out is None else out.when(b < total, name)
    return out.otherwise(list(shares)[-1])


def is_single_line(c: Column | str) -> Column:
    """Non-empty, no line break, three characters or more without outer white space. Null: false."""
    text = T.col(c)
    return F.coalesce(~F.contains(text, F.lit("\n")) & ~F.contains(text, F.lit("\r")) & (F.length(T.strip(text)) >= 3), F.lit(False))


def looks_multi(c: Column | str) -> Column:
    return T.col(c).rlike(r"""[.!?]["')\]]?\s+[A-Z]""")


def keeps_sentence(c: Column | str) -> Column:
    """15 to 400 characters, no line break or tab, not all upper case, at least half ASCII letters."""
    s = T.col(c)
    n = F.length(s)
    shouted = (F.upper(s) == s) & (F.lower(s) != s)
    return F.coalesce(~s.rlike(r"[\n\t]") & n.between(15, 400) & ~shouted & (F.regexp_count(s, F.lit("[A-Za-z]")) >= 0.5 * n), F.lit(False))


def clean_rewrite(raw: Column, seed: Column, most: float = 2.5) -> Column:
    """The rewrite without outer quotes if it is one usable sentence, else null."""
    s = T.strip(F.coalesce(raw, F.lit("")))
    for mark in ('"', "'"):
        s = F.regexp_replace(s, f"^{mark}+|{mark}+$", "")
    s = T.strip(s)
    good = ~F.contains(s, F.lit("\n")) & (F.length(s) >= 12) & s.rlike(r"[.?!]\z") & (F.lower(s) != F.lower(seed)) & (F.length(s) <= most * F.length(seed)) & (F.size(T.sentences(s)) == 1)
    return F.when(good, s)


def rename_ok(seed: Column, made: Column, forbidden: str) -> Column:
    """Not an echo, 0.6 to 1.6 times as long, and without the forbidden pattern."""
    r = F.length(made) / F.greatest(F.length(seed), F.lit(1))
    return (F.lower(T.strip(made)) != F.lower(T.strip(seed))) & r.between(0.6, 1.6) & ~made.rlike("(?i)" + forbidden)


def pair_rows(pairs: DataFrame, source: str) -> DataFrame:
    """Two rows of each pair with both poles: neg (label 0) and pos (label 1) share the group; real names the real pole."""
    whole = pairs.where((F.coalesce("neg", F.lit("")) != "") & (F.coalesce("pos", F.lit("")) != ""))
    poles = F.array(*(F.struct(F.col(p).alias("text"), F.lit(y).alias("label"), F.coalesce(F.col("real") == p, F.lit(False)).alias("is_real")) for p, y in (("neg", 0), ("pos", 1))))
    return whole.select(F.explode(poles).alias("r"), "group_id").select("r.text", "r.label", F.lit(source).alias("source"), "group_id", "r.is_real")


def pool(sources: list[DataFrame]) -> DataFrame:
    """Sources in order of priority in one table: prio, and idx, a row's place in its source if the source has that column."""
    def ranked(k: int, df: DataFrame) -> DataFrame:
        idx = F.col("idx") if "idx" in df.columns else F.monotonically_increasing_id()
        return df.select(*ROW, F.lit(k).alias("prio"), idx.cast("long").alias("idx"))

    return reduce(DataFrame.unionByName, (ranked(k, s) for k, s in enumerate(sources)))


def first_of_each(rows: DataFrame, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The first valid row of each key, by `order`, with the key. An aggregate with map-side combining: a frequent key meets in no task."""
    valid = rows.where(is_single_line(text_col)).withColumn("key", T.dedup_key(text_col))
    first = F.min_by(F.struct(*rows.columns), F.struct(*(order or ["prio", "idx"])))
    return valid.groupBy("key").agg(first.alias("_r")).select("key", "_r.*")


def dedupe_counts(rows: DataFrame, text_col: str = "text", label_col: str = "label", order: list[str] | None = None) -> DataFrame:
    """One row: kept, duplicates, bad rows, and duplicates whose label differs from the kept row's."""
    by = rows.where(is_single_line(text_col)).groupBy(T.dedup_key(text_col).alias("key"), F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*(order or ["prio", "idx"]))).alias("first"))
    keys = by.groupBy("key").agg(F.sum("n").alias("n"), F.min_by("n", "first").alias("same"), F.sum(F.when(F.col("label").isNull(), F.col("n")).otherwise(0)).alias("unlabelled"), F.min_by(F.col("label").isNotNull(), "first").alias("known"))
    differ = F.when(F.col("known"), F.col("n") - F.col("same") - F.col("unlabelled")).otherwise(0)
    kept = keys.agg(F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dup"), F.coalesce(F.sum(differ), F.lit(0)).alias("conflict"))
    bad = rows.select(F.count_if(~is_single_line(text_col)).alias("bad"))
    return kept.crossJoin(bad)  # one row each


def without_leaks(human: DataFrame, pooled: DataFrame, text_col: str = "text", other_col: str = "text") -> DataFrame:
    """Human rows whose key the pool lacks."""
    keys = pooled.select(T.dedup_key(other_col).alias("_key")).distinct()
    return human.join(keys, T.dedup_key(text_col) == F.col("_key"), "left_anti")


def remaining(seeds: DataFrame, kept: DataFrame, attempted: DataFrame, key: str = "group_id") -> DataFrame:
    """Seeds of which the key was neither kept nor attempted."""
    return seeds.join(kept.select(key).union(attempted.select(key)).distinct(), key, "left_anti")


def new_rows(rows: DataFrame, existing: DataFrame, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """First rows of each stripped lower-case text that `existing` lacks. A frequent text meets in no task."""
    key = F.lower(T.strip(text_col))
    first = rows.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*rows.columns), F.struct(*(order or [text_col]))).alias("_r")).where("_key IS NOT NULL")
    return first.join(existing.select(key.alias("_key")).distinct(), "_key", "left_anti").select("_r.*")


def class_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"))


def round_robin(rows: DataFrame, task: str, order: str, n: int, shots: int = 0) -> DataFrame:
    """The first n rows taken in turn from each task, after `shots` rows of each are held out."""
    depth = F.row_number().over(Window.partitionBy(task).orderBy(order))
    # no task gives more than n rows, so that ranks beyond them are dropped before the shuffle
    return rows.withColumn("depth", depth).where(F.col("depth") <= n + shots).withColumn("depth", F.col("depth") - shots).where(F.col("depth") > 0).orderBy("depth", task).limit(n)


def shuffled(rows: DataFrame, key: str, salt: str) -> DataFrame:
    """Deterministic order by a salted hash; `shuffle_key` tells it."""
    return rows.withColumn("shuffle_key", F.sha1(F.concat(F.lit(salt), F.col(key).cast("string"))))
