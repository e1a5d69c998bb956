"""Classifier analytics: class weights, threshold sweeps, calibration, precision and recall, agreement, batch scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proselake.functions import text as T


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): all rows over classes times the class's rows."""
    c = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    return c.select("label", "n", (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))


def _rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = T.ratio(tp, tp + fp), T.ratio(tp, tp + fn)
    return p, r, T.ratio(2 * p * r, p + r)


def confusion(rows: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """One row: tn, fp, fn, tp, precision, recall, f1, accuracy at `score >= threshold`; 0 where a rate has no cases."""
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    c = rows.agg(*(F.count_if(x).alias(n) for n, x in (("tn", ~hit & ~true), ("fp", hit & ~true), ("fn", ~hit & true), ("tp", hit & true))))
    p, r, f = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    every = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return c.select("*", p.alias("precision"), r.alias("recall"), f.alias("f1"), T.ratio(F.col("tn") + F.col("tp"), every).alias("accuracy"))


def _counted(rows: DataFrame, label: str, score: str, parts: int = 1024) -> DataFrame:
    """(threshold, pos, tp, fp, positives) at every distinct score, and at 1.0 if there is none.

    Rows are counted by score first. Running sums go over ranges of scores, each in a task of its own, and start from the
    sums of the ranges above; only those, one for each range, meet in one task.
    """
    by = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    top = rows.sparkSession.range(1).select(F.lit(1.0).alias("threshold"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"))
    by = by.unionByName(top).groupBy("threshold").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    by = by.withColumn("part", F.least(F.greatest(F.floor(F.col("threshold") * parts), F.lit(-1)), F.lit(parts)).cast("int"))
    sums = by.groupBy("part").agg(F.sum("pos").alias("part_pos"), F.sum("n").alias("part_n"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("part_pos").over(above), F.lit(0)).alias("base_pos"), F.coalesce(F.sum("part_n").over(above), F.lit(0)).alias("base_n"), F.sum("part_pos").over(Window.partitionBy()).alias("positives"))
    down = Window.partitionBy("part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    own = by.select("threshold", "pos", "part", F.sum("pos").over(down).alias("own_pos"), F.sum("n").over(down).alias("own_n")).join(base, "part")
    tp = F.col("base_pos") + F.col("own_pos")
    return own.select("threshold", "pos", tp.alias("tp"), (F.col("base_n") + F.col("own_n") - tp).alias("fp"), "positives")


def sweep(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, tp, fp, precision, recall, f1) at every distinct score and at 1.0."""
    p, r, f = _rates(F.col("tp"), F.col("fp"), F.col("positives") - F.col("tp"))
    return _counted(rows, label, score).select("threshold", "tp", "fp", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def pick_threshold(swept: DataFrame, target: float = 0.9) -> DataFrame:
    """One row: the lowest threshold with the target precision, or else the one with the best f1, the lowest of equals."""
    ok = F.col("precision") >= target
    point = F.struct("threshold", "precision", "recall")
    c = swept.agg(F.min_by(point, F.when(ok, F.col("threshold"))).alias("gate"), F.max_by(point, F.struct("f1", -F.col("threshold"))).alias("best"), F.count_if(ok).alias("n"))
    met = F.col("n") > 0
    return c.select(F.when(met, F.col("gate")).otherwise(F.col("best")).alias("p"), met.alias("met")).select("p.*", "met")


def band_too_wide(swept: DataFrame, target: float = 0.9, low: float = 0.05, high: float = 0.5) -> DataFrame:
    t = F.when(F.col("precision") >= target, F.col("threshold"))
    return swept.agg(F.coalesce((F.min(t) <= low) & (F.max(t) >= high), F.lit(False)).alias("too_wide"))


def average_precision(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Sum over distinct scores of precision times the gain in recall."""
    p, _, _ = _rates(F.col("tp"), F.col("fp"), F.lit(0))
    return _counted(rows, label, score).agg(F.sum(p * T.ratio(F.col("pos"), F.col("positives"))).alias("average_precision"))


def calibrate(rows: DataFrame, target: float = 0.9, **names) -> dict:
    """Status and threshold of a calibration split: empty, single_class, degenerate or ok."""
    label = names.get("label", "label")
    n, pos = rows.agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1)).first()
    if not n:
        return {"status": "empty"}
    if pos in (0, n):
        return {"status": "single_class"}
    s = sweep(rows, **names)
    if band_too_wide(s, target).first()[0]:
        return {"status": "degenerate"}
    p = pick_threshold(s, target).first()
    return {"status": "ok", "threshold": round(p["threshold"], 4), "target_precision": target, "calibration_precision": round(p["precision"], 4), "calibration_recall": round(p["recall"], 4), "n": n}


def errors(rows: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    kind = F.when(hit & ~true, "false positive").when(~hit & true, "false negative")
    return rows.withColumn("kind", kind).where(F.col("kind").isNotNull())


def agreement(rows: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """One row: share of equal decisions, mean absolute difference, and whether 95 % agree."""
    same = ((F.col(a) >= threshold) == (F.col(b) >= threshold)).cast("double")
    r = rows.agg(F.avg(same).alias("agreement"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mean_difference"))
    return r.withColumn("passes", F.col("agreement") >= 0.95)


def scored(df: DataFrame, scorer: Callable[[Column], Column], text_col: str = "text") -> DataFrame:
    """`df` with score: a scorer is any function from a text column to a column, native or a pandas UDF of a model."""
    return df.withColumn("score", scorer(F.col(text_col)))


def lexical_scorer(terms: list[str], scale: float = 20.0) -> Callable[[Column], Column]:
    """A deterministic stand-in for a sentence model: 1 - 1 / (1 + scale * lexicon density)."""
    return lambda c: 1 - 1 / (1 + scale * T.density(c, terms))


def logistic_scorer(train: DataFrame, text_col: str = "text", label: str = "label", features: int = 1 << 12):
    """A weighted logistic regression over hashed words, by Spark ML; gives a function from a DataFrame to one with score."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    weighted = train.join(F.broadcast(class_weights(train, label).select(F.col("label").alias("_l"), "weight")), F.col(label) == F.col("_l"))  # a row for each class
    steps = [RegexTokenizer(inputCol=text_col, outputCol="_w", pattern=r"\W+"), HashingTF(inputCol="_w", outputCol="_f", numFeatures=features), LogisticRegression(featuresCol="_f", labelCol=label, weightCol="weight", maxIter=20)]
    model = Pipeline(stages=steps).fit(weighted)
    return lambda df: model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop("_w", "_f", "rawPrediction", "probability", "prediction")


def detect(df: DataFrame, scorer: Callable[[Column], Column], threshold: float, unit: str = "doc_id", text_col: str = "text", most_chars: int = 100_000, most_sentences: int = 2000) -> DataFrame:
    """(unit, threshold, n_flagged, sentences): the detection endpoint's answer; the caps are that interface's own."""
    ss = F.slice(T.sentences(F.substring(text_col, 1, most_chars)), 1, most_sentences)
    s = df.select(unit, F.posexplode(ss).alias("i", "text"))
    s = scored(s, scorer).withColumn("flag", F.col("score") >= threshold)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("i", "text", "score", "flag"))), lambda r: r.dropFields("i"))
    return s.groupBy(unit).agg(F.lit(threshold).alias("threshold"), F.count_if("flag").alias("n_flagged"), rows.alias("sentences"))


def marked_page(answers: DataFrame, unit: str = "doc_id") -> DataFrame:
    """(unit, html): the answer of detect() as a page, flagged sentences marked with their score."""

    def escaped(c: Column) -> Column:
        return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))

    def part(s: Column) -> Column:
        return F.when(s["flag"], F.concat(F.lit('<mark title="'), T.two_decimals(s["score"]), F.lit('">'), escaped(s["text"]), F.lit("</mark>"))).otherwise(escaped(s["text"]))

    return answers.select(unit, F.concat(F.lit("<p>"), F.array_join(F.transform("sentences", part), " "), F.lit("</p>")).alias("html"))
