"""The consolidated audit of a conversation: every detector on shared segmentation, one summary row a conversation, and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselake.functions import text as T
from proselake.operators import detectors, grammar

SCANNERS = ("cliches", "openers", "templates", "contrasts", "phrases", "structure", "echoes")


def findings(turns: DataFrame, bank: list | None = None, toggles: dict[str, bool] | None = None, unit: str = "conv_id", order: str = "turn", cliche_threshold: float = 0.25, opener_run: int = 4, template_words: int = 8, template_flag: int = 2, short_messages: int = 3, long_messages: int = 2) -> DataFrame:
    """(unit, scanner, ord, what, sentence): a row for each issue. Scanners that are toggled off aren't planned at all.

    Sentences never go on from one message to the next, so that messages are looked at one by one; over a conversation only
    openers, sentence beginnings, phrases and signatures are put in order, never its whole text.
    """
    on = lambda s: (toggles or {}).get(s, True)
    answers = turns.where(F.col("role") == "assistant").withColumn("text", F.coalesce("text", F.lit("")))
    message = answers.select(F.struct(unit, order).alias("_m"), "text")
    none = F.lit("")
    parts = []

    def add(df: DataFrame, scanner: str, ord_, what, sentence=none) -> None:
        parts.append(df.select(unit, F.lit(scanner).alias("scanner"), F.array(*ord_).alias("ord"), what.alias("what"), sentence.alias("sentence")))

    if bank and on("cliches"):
        hits = detectors.distinct_hits(detectors.cliches(message, bank, "_m", threshold=cliche_threshold), "_m").withColumn(unit, F.col(f"_m.{unit}"))
        add(hits, "cliches", [F.col(f"_m.{order}").cast("double"), F.col("i").cast("double"), -F.col("score"), F.col("grp").cast("double")], F.col("phrase"), F.col("sentence"))
    if on("openers"):
        add(detectors.opening_monotony(answers, unit, least_run=opener_run, order=order), "openers", [-F.col("max_run").cast("double")], F.col("opener"))
    if on("templates"):
        t = grammar.templates(answers, unit, most=template_words, flag=template_flag, order=order).select(unit, F.posexplode("flagged").alias("k", "f"))
        add(t, "templates", [F.col("k").cast("double")], F.col("f.template"))
    if on("contrasts"):
        c = grammar.contrasts(message, "_m").withColumn(unit, F.col(f"_m.{unit}"))
        add(c, "contrasts", [F.col(f"_m.{order}").cast("double"), F.col("i").cast("double")], F.when(F.col("is_parallel"), "parallel").otherwise(""), F.col("sentence"))
    if on("phrases"):
        p = detectors.ranked_phrases(detectors.two_pass_phrases(answers, unit, short_messages, long_messages, order=order), unit)
        add(p, "phrases", [F.col("rank").cast("double")], F.col("phrase"))
    if on("structure"):
        s = grammar.structures(answers, unit, order).where("repetitive")
        add(s, "structure", [F.lit(0.0)], F.array_join("skeleton", " → "))
    if on("echoes"):
        last = grammar.previous_message(turns, unit, order)
        last = last.groupBy(unit).agg(F.max_by(F.struct("text", "said"), order).alias("l")).select(unit, "l.*")
        e = grammar.echoes(last, unit, "text", "said")
        add(e, "echoes", [F.lit(0.0)], F.col("matched_phrase"), F.col("echo"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(turns: DataFrame, bank: list | None = None, unit: str = "conv_id", **how) -> DataFrame:
    """(unit, a count for each scanner, total_issues, is_clean). Stock expressions count sentences, the others findings."""
    f = findings(turns, bank, unit=unit, **how)
    n = F.when(F.col("scanner") == "cliches", F.xxhash64(F.slice("ord", 1, 2)).cast("double")).otherwise(F.xxhash64("ord", "what", "sentence").cast("double"))
    c = f.groupBy(unit, "scanner").agg(F.when(F.first("scanner") == "cliches", F.count_distinct(n)).otherwise(F.count(F.lit(1))).alias("n"))
    wide = c.groupBy(unit).agg(*(F.coalesce(F.sum(F.when(F.col("scanner") == s, F.col("n"))), F.lit(0)).alias(s) for s in SCANNERS))
    every = turns.where("role = 'assistant'").select(unit).distinct()
    wide = every.join(wide, unit, "left").select(unit, *(F.coalesce(s, F.lit(0)).alias(s) for s in SCANNERS))
    total = sum((F.col(s) for s in SCANNERS[1:]), F.col(SCANNERS[0]))
    return wide.withColumn("total_issues", total).withColumn("is_clean", F.col("total_issues") == 0)


def density(turns: DataFrame, unit: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row: issues, sentences and issues a sentence, by the scanners of templates, phrases (two messages) and structure."""
    off = dict.fromkeys(("cliches", "openers", "contrasts", "echoes"), False)
    issues = findings(turns, None, off, unit, order, short_messages=2).agg(F.count(F.lit(1)).alias("issues"))
    n = turns.where("role = 'assistant'").agg(F.coalesce(F.sum(F.size(T.sentences("text"))), F.lit(0)).alias("sentences"))
    return issues.crossJoin(n).withColumn("density", T.ratio(F.col("issues"), F.col("sentences")))  # one row each


def report(found: DataFrame, turns: DataFrame, unit: str = "conv_id") -> DataFrame:
    """(unit, report): the findings as text, a section for each scanner in fixed order."""
    place = F.array_position(T.array_of(SCANNERS), F.col("scanner"))
    line = F.concat(F.lit("  - "), T.strip_asterisks("what"), F.when(F.col("sentence") != "", F.concat(F.lit(": "), T.strip_asterisks("sentence"))).otherwise(""))
    rows = found.select(unit, place.alias("place"), "scanner", "ord", line.alias("line"))
    s = rows.groupBy(unit, "place", "scanner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda r: r["line"]), "\n").alias("lines"))
    body = s.groupBy(unit).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(F.initcap("scanner"), F.lit("\n"), F.col("lines")).alias("t")))), lambda r: r["t"]), "\n\n").alias("body"))
    every = turns.select(unit).distinct().join(body, unit, "left")
    return every.select(unit, F.coalesce("body", F.lit("No issues found.")).alias("report"))
