"""Detectors of repeated openers and phrases and of stock expressions, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselake.functions import lexicon
from proselake.functions import text as T
from proselake.operators import phrase_bank
from proselake.sources.files import materialized


def exploded_sentences(df: DataFrame, unit: str, text_col: str, of=T.sentences) -> DataFrame:
    """(unit, i, sentence), i from 0."""
    return df.select(unit, F.posexplode(of(text_col)).alias("i", "sentence"))


def opening_monotony(df: DataFrame, unit: str = "doc_id", text_col: str = "text", n_words: int = 1, least_run: int = 4, order: str | None = None) -> DataFrame:
    """Openers of narration sentences with a run of `least_run` or more: unit, opener, count, max_run, fraction, score.

    The opener is the first n_words tokens; a sentence with fewer ends a run. score is the share of sentences whose opener
    occurs twice or more in the unit. order: texts of one unit follow one another. Windows hold openers only, never texts.
    """
    t = F.slice(T.tokens("sentence"), 1, n_words)
    opener = F.when(F.size(t) >= n_words, F.array_join(t, " "))
    more = [] if order is None else [order]
    s = df.select(unit, *more, F.posexplode(T.narration_sentences(text_col)).alias("i", "sentence")).select(unit, *more, "i", opener.alias("opener"))
    if order is not None:
        s = s.withColumn("i", F.row_number().over(Window.partitionBy(unit).orderBy(order, "i")))
    total = Window.partitionBy(unit)
    island = F.col("i") - F.row_number().over(Window.partitionBy(unit, "opener").orderBy("i"))
    s = s.withColumn("total", F.count(F.lit(1)).over(total)).withColumn("island", island).where("opener IS NOT NULL")
    runs = s.groupBy(unit, "opener", "total", "island").agg(F.count(F.lit(1)).alias("n"))
    by_opener = runs.groupBy(unit, "opener", "total").agg(F.sum("n").alias("count"), F.max("n").alias("max_run"))
    again = F.sum(F.when(F.col("count") >= 2, F.col("count")).otherwise(0)).over(Window.partitionBy(unit))
    scored = by_opener.withColumn("score", again / F.col("total")).withColumn("fraction", F.col("count") / F.col("total"))
    return scored.where(F.col("max_run") >= least_run).select(unit, "opener", "count", "max_run", "fraction", "score")


def repeated_phrases(messages: DataFrame, unit: str = "conv_id", order: str = "turn", text_col: str = "text", min_n: int = 2, max_n: int = 5, least_messages: int = 2, least_content: int = 2, in_last: bool = True, stopwords=lexicon.STOPWORDS) -> DataFrame:
    """Word runs that recur in several messages of a unit: unit, gram, phrase, n_messages, messages (their places in `order`)."""
    s = messages.select(unit, F.col(order).alias("msg"), F.explode(T.sentences(text_col)).alias("sentence")).withColumn("t", T.tokens("sentence"))
    grams = F.array_distinct(F.flatten(F.array(*(T.joined_ngrams(F.col("t"), n) for n in range(min_n, max_n + 1)))))
    g = s.select(unit, "msg", F.explode(grams).alias("phrase"))
    found = g.groupBy(unit, "phrase").agg(F.sort_array(F.collect_set("msg")).alias("messages"))
    found = found.where(F.size("messages") >= least_messages).withColumn("gram", F.split("phrase", " ")).where(T.content_words(F.col("gram"), stopwords) >= least_content)
    if in_last:
        last = messages.groupBy(unit).agg(F.max(order).alias("last"))
        found = found.join(last, unit).where(F.element_at("messages", -1) == F.col("last"))
    return found.select(unit, "gram", "phrase", F.size("messages").alias("n_messages"), "messages")


def _runs(gram: Column, least: int, most: Column) -> Column:
    """All runs of a gram of `least` to `most` words."""
    sizes = F.when(most >= least, F.sequence(F.lit(least), most)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size(gram) - n + 1), lambda i: F.array_join(F.slice(gram, i, n), " ")))))


def distinct_phrases(phrases: DataFrame, unit: str = "conv_id", stopwords=lexicon.STOPWORDS) -> DataFrame:
    """Phrases that restate no other of their unit.

    Of a phrase and one that contains it, the longer stays if both have the same messages, else the shorter; of two that
    chain head to tail over the same messages, with a content word where they meet, the better ranked: more words, then first
    in the alphabet. Phrases meet by the runs that they contain and by those that end the one and begin the other.
    """
    p = phrases.select(unit, "gram", "phrase", "messages")
    size = F.size("gram")
    inner = p.select(unit, F.explode(_runs(F.col("gram"), 1, size - 1)).alias("phrase"), F.col("phrase").alias("long"), F.col("messages").alias("long_messages"))
    nested = inner.join(p, [unit, "phrase"]).withColumn("same", F.col("messages") == F.col("long_messages"))
    contained = nested.select(unit, F.when(F.col("same"), F.col("phrase")).otherwise(F.col("long")).alias("phrase"))

    def ends(of) -> Column:
        cuts = F.when(size >= 2, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>"))
        return F.explode(F.filter(F.transform(cuts, of), lambda x: T.content_words(x, stopwords) > 0))

    tails = p.select(unit, "messages", ends(lambda k: F.slice("gram", size - k + 1, k)).alias("joint"), F.col("phrase").alias("a"), size.alias("a_size"))
    heads = p.select(unit, "messages", ends(lambda k: F.slice("gram", F.lit(1), k)).alias("joint"), F.col("phrase").alias("b"), size.alias("b_size"))
    meet = tails.join(heads, [unit, "messages", "joint"]).where("a != b")
    padded = {x: F.concat(F.lit(" "), F.col(x), F.lit(" ")) for x in "ab"}  # words hold no spaces, so a run of words is a substring
    meet = meet.where(~F.contains(padded["b"], padded["a"]) & ~F.contains(padded["a"], padded["b"]))
    a_worse = (F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a") > F.col("b")))
    chained = meet.select(unit, F.when(a_worse, F.col("a")).otherwise(F.col("b")).alias("phrase"))
    return phrases.join(contained.unionByName(chained).distinct(), [unit, "phrase"], "left_anti")


def ranked_phrases(phrases: DataFrame, unit: str = "conv_id") -> DataFrame:
    w = Window.partitionBy(unit).orderBy(F.desc("n_messages"), F.desc(F.size("gram")), "phrase")
    return phrases.withColumn("rank", F.row_number().over(w))


def two_pass_phrases(messages: DataFrame, unit: str = "conv_id", short_messages: int = 3, long_messages: int = 2, **how) -> DataFrame:
    """Two-word phrases in more messages and longer ones in fewer, each pass and then both freed of restatements."""
    every = materialized(repeated_phrases(messages, unit, min_n=2, max_n=5, least_messages=min(short_messages, long_messages), **how))
    short = distinct_phrases(every.where((F.size("gram") == 2) & (F.col("n_messages") >= short_messages)), unit)
    long = distinct_phrases(every.where((F.size("gram") > 2) & (F.col("n_messages") >= long_messages)), unit)
    return distinct_phrases(materialized(short.unionByName(long)), unit)


def cliches(df: DataFrame, bank: list, unit: str = "doc_id", text_col: str = "text", threshold: float = 0.4) -> DataFrame:
    """Stock expressions in sentences: unit, i, sentence, grp, phrase, score, a row for the best variant of each group.

    phrase_bank.found() tells what fits; the plan is as large for any bank.
    """
    return phrase_bank.found(exploded_sentences(df, unit, text_col), bank, threshold)


def distinct_hits(hits: DataFrame, unit: str = "doc_id", overlap: float = 0.5) -> DataFrame:
    """Hits of each sentence, best first, without those that share half their words with one kept before."""
    h = hits.groupBy(unit, "i", "sentence").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "grp", "phrase", "score"))).alias("hits"))

    def words(x: Column) -> Column:
        return T.tokens(x["phrase"], T.PHRASE_TOKEN)

    kept = F.aggregate(
        "hits",
        F.array().cast("array<struct<rank:double,grp:int,phrase:string,score:double>>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: T.jaccard(words(x), words(y)) >= overlap), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return h.select(unit, "i", "sentence", F.explode(kept).alias("h")).select(unit, "i", "sentence", "h.grp", "h.phrase", "h.score")


def first_words(text_col: str = "text") -> Column:
    """The first word of each sentence in lower case."""
    return F.transform(T.sentences(text_col), lambda s: F.lower(F.element_at(F.split(s, r"\s+"), 1)))


def reuse_rate(f: Column) -> Column:
    """Share of the members of a list that were there before; null for fewer than two."""
    n, d = F.size(f), F.size(F.array_distinct(f))
    return F.when(n >= 2, (n - d) / (n - 1))


def opener_repeat(df: DataFrame, unit: str, text_col: str = "text") -> DataFrame:
    """(unit, rate): share of sentences that reuse a first word of the unit; units with one sentence have no row."""
    f = df.select(unit, first_words(text_col).alias("f"))
    return f.select(unit, reuse_rate(F.col("f")).alias("rate")).where("rate IS NOT NULL")


def structure_share(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: share of non-blank lines that open like a heading, a list item or bold text."""
    lines = df.select(F.explode(F.split(F.coalesce(text_col, F.lit("")), r"\r?\n")).alias("line")).where(F.col("line").rlike(r"\S"))
    hit = F.col("line").rlike(r"^\s*(\*\*|#{1,3}\s|\d+\.\s|[-*•]\s)")
    return lines.agg(F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("structure_share"))


def intra_repeat(df: DataFrame, unit: str, text_col: str = "text", stopwords=lexicon.GUARD_STOPWORDS) -> DataFrame:
    """(unit, rate): the larger of the repeated share of 2- to 4-grams and the most frequent content word's share."""
    t = df.select(unit, T.tokens(F.coalesce(text_col, F.lit("")), T.GUARD_TOKEN).alias("t")).where(F.size("t") >= 4)
    t = t.withColumn("c", F.array_sort(T.content(F.col("t"), stopwords)))
    # places where a word of the sorted content words begins; the widest gap is the most frequent word's count
    n = F.size("c")
    begins = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get("c", i) != F.get("c", i - 1)))
    t = t.withColumn("b", begins)
    longest = F.when(n > 0, F.array_max(F.zip_with(F.slice("b", 2, F.greatest(F.lit(1), n)), F.slice("b", 1, F.greatest(F.lit(1), F.size("b") - 1)), lambda x, y: x - y))).otherwise(0)
    seq = F.greatest(*(T.repeated_share(F.col("t"), n) for n in (2, 3, 4)))
    return t.select(unit, F.greatest(seq, T.ratio(longest, F.size("c"))).alias("rate"))
